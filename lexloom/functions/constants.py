"""Fixed values that results must agree on: vocabularies, entity and relation specifications, thresholds."""

from __future__ import annotations

# Vocabulary of each domain.
DOMAIN_VOCABULARY = {
    "general": ("document", "information", "government", "regulation", "institution", "department", "research", "system", "confidence", "correction", "application", "university", "technology", "development", "management", "organization"),
    "medical": ("patient", "hospital", "diagnosis", "treatment", "medicine", "clinical", "clinic", "physician", "prescription", "symptoms", "laboratory", "dosage", "recovery", "tablet"),
    "legal": ("agreement", "contract", "regulation", "statute", "court", "plaintiff", "defendant", "jurisdiction", "liability", "provision"),
    "government": ("government", "ministry", "department", "regulation", "policy", "authority", "administration", "public", "official", "citizen"),
    "financial": ("account", "transaction", "balance", "interest", "financial", "revenue", "liability", "invoice", "receipt", "payment", "statement", "total", "amount", "quantity", "customer", "currency"),
    "institutional": ("institution", "university", "department", "faculty", "student", "academic", "administration", "committee", "policy", "programme"),
}

# Fixed values: (domain, label, type, aliases).
ENTITY_SPECS = [
    ("government", "Public Administration Circular", "DocumentType", ("public administration circular",)),
    ("government", "Government", "GovernmentBody", ("government",)),
    ("government", "Ministry", "Organization", ("ministry",)),
    ("government", "Department", "Organization", ("department",)),
    ("government", "Authority", "GovernmentBody", ("authority",)),
    ("government", "Policy", "Policy", ("policy",)),
    ("government", "Regulation", "Regulation", ("regulation",)),
    ("government", "Public Offices", "Organization", ("public offices",)),
    ("government", "Implementation Report", "Report", ("implementation report",)),
    ("medical", "Patient", "Patient", ("patient",)),
    ("medical", "Physician", "Clinician", ("physician",)),
    ("medical", "Diagnosis", "Condition", ("diagnosis",)),
    ("medical", "Prescription", "Prescription", ("prescription",)),
    ("medical", "Treatment", "Treatment", ("treatment",)),
    ("medical", "Laboratory", "ClinicalService", ("laboratory",)),
    ("medical", "Hospital", "HealthcareOrganization", ("hospital",)),
    ("legal", "Agreement", "LegalInstrument", ("agreement",)),
    ("legal", "Contract", "LegalInstrument", ("contract",)),
    ("legal", "Liability", "LegalConcept", ("liability",)),
    ("legal", "Court", "Court", ("court",)),
    ("legal", "Jurisdiction", "Jurisdiction", ("jurisdiction",)),
    ("legal", "Provision", "LegalProvision", ("provision", "provisions",)),
    ("legal", "Regulation", "Regulation", ("regulation",)),
    ("financial", "Account", "FinancialAccount", ("account",)),
    ("financial", "Transaction", "Transaction", ("transaction",)),
    ("financial", "Balance", "Amount", ("balance",)),
    ("financial", "Payment", "Payment", ("payment",)),
    ("financial", "Invoice", "Invoice", ("invoice",)),
    ("financial", "Statement", "FinancialStatement", ("statement",)),
    ("financial", "Revenue", "Amount", ("revenue",)),
    ("institutional", "Institution", "Institution", ("institution",)),
    ("institutional", "University", "University", ("university",)),
    ("institutional", "Department", "Department", ("department",)),
    ("institutional", "Faculty", "PersonGroup", ("faculty",)),
    ("institutional", "Student", "PersonGroup", ("student", "students",)),
    ("institutional", "Committee", "Committee", ("committee",)),
    ("institutional", "Academic Programme", "Programme", ("academic programme", "programme",)),
    ("institutional", "Policy", "Policy", ("policy",)),
    ("general", "Document", "DocumentType", ("document",)),
    ("general", "Information", "Concept", ("information",)),
    ("general", "Research", "Activity", ("research",)),
    ("general", "System", "System", ("system",)),
    ("general", "Confidence", "Metric", ("confidence",)),
    ("general", "Correction", "Process", ("correction",)),
]

# Fixed values: (domain, source label, relation, target label).
RELATION_SPECS = [
    ("government", "Government", "HAS_MINISTRY", "Ministry"),
    ("government", "Government", "HAS_DEPARTMENT", "Department"),
    ("government", "Authority", "ISSUED", "Policy"),
    ("government", "Policy", "APPLIES_TO", "Public Offices"),
    ("government", "Department", "CONSULTED_ON", "Policy"),
    ("government", "Ministry", "REQUESTED", "Implementation Report"),
    ("government", "Public Administration Circular", "CONTAINS_POLICY", "Policy"),
    ("government", "Policy", "GOVERNED_BY", "Regulation"),
    ("medical", "Patient", "HAS_DIAGNOSIS", "Diagnosis"),
    ("medical", "Patient", "HAS_PRESCRIPTION", "Prescription"),
    ("medical", "Physician", "ISSUED", "Prescription"),
    ("medical", "Prescription", "DEFINES", "Treatment"),
    ("medical", "Laboratory", "SUPPORTS", "Diagnosis"),
    ("medical", "Hospital", "EMPLOYS", "Physician"),
    ("legal", "Contract", "FORMALIZES", "Agreement"),
    ("legal", "Agreement", "DEFINES", "Liability"),
    ("legal", "Agreement", "HAS_PROVISION", "Provision"),
    ("legal", "Court", "HAS_JURISDICTION", "Jurisdiction"),
    ("legal", "Provision", "SUBJECT_TO", "Regulation"),
    ("financial", "Account", "HAS_TRANSACTION", "Transaction"),
    ("financial", "Account", "HAS_BALANCE", "Balance"),
    ("financial", "Transaction", "SETTLED_BY", "Payment"),
    ("financial", "Payment", "REFERENCES", "Invoice"),
    ("financial", "Statement", "REPORTS", "Account"),
    ("financial", "Statement", "REPORTS", "Revenue"),
    ("institutional", "University", "HAS_DEPARTMENT", "Department"),
    ("institutional", "Department", "HAS_FACULTY", "Faculty"),
    ("institutional", "Department", "HAS_STUDENT_BODY", "Student"),
    ("institutional", "Committee", "APPROVED", "Policy"),
    ("institutional", "Committee", "GOVERNS", "Academic Programme"),
    ("institutional", "Institution", "HAS_POLICY", "Policy"),
    ("general", "Document", "DESCRIBES", "Information"),
    ("general", "Research", "EVALUATES", "System"),
    ("general", "System", "MEASURES", "Confidence"),
    ("general", "System", "PERFORMS", "Correction"),
]

# Weights and thresholds of the quality score.
QUALITY_WEIGHTS = {
    "ocr_confidence": 0.15,
    "character_accuracy": 0.20,
    "word_accuracy": 0.15,
    "valid_word_ratio": 0.10,
    "dictionary_match_ratio": 0.08,
    "noise_cleanliness": 0.10,
    "artifact_cleanliness": 0.05,
    "language_consistency": 0.07,
    "structural_consistency": 0.05,
    "non_alphanumeric_cleanliness": 0.03,
    "density_quality": 0.02,
}
HIGH, MEDIUM = 80.0, 60.0
MAX_WORD, REPEATS, SYMBOLS, DICTIONARY_ZIPF, VALID_ZIPF = 30, 4, 3, 2.0, 2.5
DENSITY_TARGET, LANGUAGE_LETTERS = 80.0, 20
SHORT_SIMILARITY, LONG_SIMILARITY, SHORT_WORD, DOMAIN_BOOST = 0.85, 0.82, 5, 0.08
MODEL_FLOOR = 0.65

# Upload rules.
MEDIA_TYPES = {".pdf": "application/pdf", ".png": "image/png", ".jpg": "image/jpeg", ".jpeg": "image/jpeg", ".tif": "image/tiff", ".tiff": "image/tiff"}
MAX_UPLOAD = 25 * 1024 * 1024


def domain_terms(domain: str | None = None) -> list[str]:
    """Terms of one domain (none for an unknown one), or of all."""
    if domain is not None:
        return list(DOMAIN_VOCABULARY.get(domain, ()))
    return sorted({t for v in DOMAIN_VOCABULARY.values() for t in v})


def check_config(weights: dict[str, float] = QUALITY_WEIGHTS, high: float = HIGH, medium: float = MEDIUM) -> None:
    """Weights are non-negative and sum to 1; 0 <= medium < high <= 100."""
    if any(w < 0 for w in weights.values()) or abs(sum(weights.values()) - 1) > 1e-9:
        raise ValueError("quality weights must be non-negative and sum to 1")
    if not 0 <= medium < high <= 100:
        raise ValueError("quality thresholds must be ordered within 0..100")
