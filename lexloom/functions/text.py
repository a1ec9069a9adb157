"""Column functions on tokens and texts. All are built-in expressions but Unicode normalisation, which Spark lacks."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from . import constants as K

#: Runs of letters (and number letters), joined by apostrophes and hyphens.
WORD = r"[\p{L}\p{Nl}\p{No}]+(?:['’\-][\p{L}\p{Nl}\p{No}]+)*"


def keep_word(t: Column) -> Column:
    """ASCII letters, digits, apostrophes and hyphens."""
    return F.regexp_replace(t, "[^A-Za-z0-9'-]", "")


def clean_word(t: Column) -> Column:
    """ASCII letters, digits, apostrophes and hyphens, lower-cased."""
    return F.lower(keep_word(t))


def ocr_canonical(t: Column) -> Column:
    """The form that look-alikes share: 0o 1l 5s 8b, rn m."""
    return F.replace(F.translate(F.lower(t), "0158", "olsb"), F.lit("rn"), F.lit("m"))


def looks_like_identifier(t: Column) -> Column:
    """Codes, numbers and mixed-case abbreviations, which no word list should correct."""
    clean = F.regexp_replace(t, "[^A-Za-z0-9'-]", "")
    letters, digits = F.regexp_replace(clean, "[^A-Za-z]", ""), F.regexp_replace(clean, "[^0-9]", "")
    odd_case = (letters != "") & ~(letters.rlike("^[a-z]+$") | letters.rlike("^[A-Z]+$") | letters.rlike("^[A-Z][a-z]*$"))
    return (clean == "") | ((digits != "") & (letters == "")) | (F.length(digits) >= 2) | (clean.contains("-") & (digits != "")) | odd_case


#: What ``looks_like_identifier`` lets pass, of a text that ``keep_word`` has been through: letters in one case or with a first capital, and one digit if there is a letter and no hyphen.
WORD_FORM = r"^(?:[a-z'-]+|[A-Z'-]+|['-]*[A-Z][a-z'-]*|(?=.*[A-Za-z])(?:[a-z']*[0-9][a-z']*|[A-Z']*[0-9][A-Z']*|'*[A-Z][a-z']*[0-9][a-z']*|'*[0-9]'*[A-Z][a-z']*))$"


def is_word(kept: Column) -> Column:
    """Not ``looks_like_identifier``, in one pattern."""
    return kept.rlike(WORD_FORM)


@F.pandas_udf(StringType())
def _nfc(s: pd.Series) -> pd.Series:
    return s.map(lambda t: None if t is None else unicodedata.normalize("NFC", t))


@F.pandas_udf(StringType())
def _nfkc(s: pd.Series) -> pd.Series:
    return s.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t))


def _ascii_or(udf, t: Column) -> Column:
    """Plain ASCII is normal already, so only other texts go to Python."""
    return F.when(t.rlike(r"^\p{ASCII}*$"), t).otherwise(udf(t))


#: White space at the edges of a text.
STRIP = r"^[\s\x1c-\x1f\u0085 ]+|[\s\x1c-\x1f\u0085 ]+$"
#: What may stand at an edge of a text that isn't stripped; the last two end a line, before which the pattern of the strip also ends.
EDGES = (*" \t\n\x0b\f\r\x1c\x1d\x1e\x1f", "\u0085", "\u00a0", "\u2028", "\u2029")


def normalize_text(t: Column, compose: bool = True) -> Column:
    """NFC, line ends as \\n, runs of spaces and tabs as one space, stripped. Texts with nothing to change skip the patterns, which cost more than all else."""
    t = F.coalesce(t, F.lit(""))
    t = _nfc(t) if compose else t
    open_edge = F.substring(t, 1, 1).isin(*EDGES) | F.substring(t, -1, 1).isin(*EDGES)
    changes = t.contains("\r") | t.contains("\t") | t.contains("  ") | open_edge
    lines = F.regexp_replace(t, "\r\n?", "\n")
    return F.when(changes, F.regexp_replace(F.regexp_replace(lines, "[ \t]+", " "), STRIP, "")).otherwise(t)


def normalize_offline(t: Column, compose: bool = True) -> Column:
    """NFKC, lower case, white space collapsed; punctuation and digits stay."""
    t = F.coalesce(t, F.lit(""))
    return F.regexp_replace(F.regexp_replace(F.lower(_nfkc(t) if compose else t), r"\s+", " "), "^ | $", "")


def words(t: Column) -> Column:
    return F.regexp_extract_all(t, F.lit(WORD), F.lit(0))


def fold(t: Column) -> Column:
    """Case folding as far as lower case and the sharp s go."""
    return F.replace(F.lower(t), F.lit("ß"), F.lit("ss"))


def clamp(x: Column) -> Column:
    """To [0, 1]; null stays null (greatest and least would skip it)."""
    return F.when(x.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), x)))


def non_alphanumeric(t: Column) -> Column:
    return F.length(F.regexp_replace(t, r"[\p{L}\p{N}]", ""))


def phrase_key(t: Column) -> Column:
    return F.regexp_replace(F.lower(t), "[^a-z0-9]+", "")


def label_key(t: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(t), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def safe_stem(name: Column, fallback: str = "document") -> Column:
    stem = F.regexp_replace(F.regexp_replace(F.regexp_replace(name, r"\.[^.]*$", ""), "[^A-Za-z0-9._-]+", "-"), "^[-._]+|[-._]+$", "")
    return F.when(stem == "", fallback).otherwise(stem)


def is_reference_id(t: Column) -> Column:
    return t.rlike(r"^[A-Z]{2,}-\d{4}-\d+$")


def title_case(t: Column) -> Column:
    """A capital at the start of every run of letters, as in O'Neil-Smith (``initcap`` knows spaces only)."""
    parts = F.regexp_extract_all(t, F.lit(r"\p{L}+|[^\p{L}]+"), F.lit(0))
    return F.array_join(F.transform(parts, lambda p: F.concat(F.upper(F.substring(p, 1, 1)), F.lower(F.substring(p, 2, 1 << 30)))), "")


def preserve_case(original: Column, replacement: Column) -> Column:
    cased = F.regexp_replace(original, r"[^\p{L}]", "") != ""
    upper = cased & (F.upper(original) == original)
    return F.when(upper, F.upper(replacement)).when(cased & (title_case(original) == original), title_case(replacement)).otherwise(replacement)


def quality_class(score: Column, high: float = K.HIGH, medium: float = K.MEDIUM) -> Column:
    return F.when(score >= high, "High Quality").when(score >= medium, "Medium Quality").when(score.isNotNull(), "Low Quality")


def domain_for(category: Column) -> Column:
    c = F.lower(category)
    return F.when(c.contains("medical"), "medical").when(c.contains("invoice") | c.contains("receipt") | c.contains("financial"), "financial").otherwise("general")


def stage_status(warnings: Column, error: Column | None = None) -> Column:
    done = F.when(F.size(warnings) > 0, "WARNING").otherwise("COMPLETED")
    return done if error is None else F.when(error.isNotNull(), "FAILED").otherwise(done)
