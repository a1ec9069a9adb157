"""Entity graphs of documents from trusted tokens, keyed by node id; evidence look-ups."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import constants as K
from ..functions import text as T

MONTHS = "January|February|March|April|May|June|July|August|September|October|November|December"


def spec_tables(spark, domain: str) -> tuple[DataFrame, DataFrame]:
    """(label, type, parts, ordinal) and (source, relation, target, ordinal); an unknown domain means general."""
    domain = domain if domain in K.DOMAIN_VOCABULARY else "general"
    own = [(label, kind, a.split(" "), i) for i, (label, kind, aliases) in enumerate((x, t, a) for d, x, t, a in K.ENTITY_SPECS if d == domain) for a in aliases]
    rel = [(s, r, t, i) for i, (s, r, t) in enumerate((s, r, t) for d, s, r, t in K.RELATION_SPECS if d == domain)]
    return spark.createDataFrame(own, "label string, type string, parts array<string>, ordinal int"), spark.createDataFrame(rel, "source string, relation string, target string, ordinal int")


def trusted(tokens: DataFrame, threshold: float) -> DataFrame:
    """Trusted tokens with their rank, so that phrases bridge what was dropped, and pages."""
    t = tokens.filter(F.col("confidence") >= threshold)
    return t.withColumn("rank", F.row_number().over(Window.partitionBy("doc_id").orderBy("pos")))


def phrase_mentions(tokens: DataFrame, specs: DataFrame, threshold: float = 0.9) -> DataFrame:
    """(doc_id, label, type, ordinal, pos, page, confidence): places where an alias's words stand in a row among trusted tokens."""
    order = Window.partitionBy("doc_id").orderBy("rank")
    t = trusted(tokens, threshold).withColumn("key", T.phrase_key(F.col("text")))
    t = t.withColumns({"k2": F.lead("key", 1).over(order), "k3": F.lead("key", 2).over(order)})
    keys = specs.select("label", "type", "ordinal", F.get("parts", F.lit(0)).alias("key"), F.get("parts", F.lit(1)).alias("p2"), F.get("parts", F.lit(2)).alias("p3"))
    hit = t.join(F.broadcast(keys), "key").filter((F.col("p2").isNull() | (F.col("p2") == F.col("k2"))) & (F.col("p3").isNull() | (F.col("p3") == F.col("k3"))))
    return hit.select("doc_id", "label", "type", "ordinal", "pos", "page", "confidence")


def entity_nodes(mentions: DataFrame) -> DataFrame:
    """One node per document and label: pages, mentions, least confidence, token positions in order."""
    return mentions.groupBy("doc_id", "label", "type", "ordinal").agg(F.array_sort(F.collect_set("page")).alias("pages"), F.count_distinct("pos").alias("mentions"), F.min("confidence").alias("confidence"), F.array_sort(F.collect_set("pos")).alias("positions")).withColumn("node_id", F.concat(F.col("doc_id").cast("string"), F.lit(":"), T.label_key(F.col("label"))))


def reference_ids(tokens: DataFrame, threshold: float = 0.9) -> DataFrame:
    """One node per identifier and document, with mentions added up."""
    t = tokens.filter((F.col("confidence") >= threshold) & T.is_reference_id(F.trim("text")))
    return t.groupBy("doc_id", F.trim("text").alias("label")).agg(F.count("*").alias("mentions"), F.min("confidence").alias("confidence"), F.array_sort(F.collect_set("page")).alias("pages"))


def date_entities(tokens: DataFrame, threshold: float = 0.9) -> DataFrame:
    """The first day, month, year in a row of each document."""
    order = Window.partitionBy("doc_id").orderBy("rank")
    t = trusted(tokens, threshold).withColumns({"before": F.lag("text").over(order), "after": F.lead("text").over(order)})
    t = t.filter(F.col("before").rlike(r"^\d{1,2}$") & F.lower("text").rlike(f"^({MONTHS.lower()})$") & F.col("after").rlike(r"^\d{4}$"))
    return t.groupBy("doc_id").agg(F.min_by(F.concat_ws(" ", "before", "text", "after"), "pos").alias("label"), F.min("pos").alias("pos"))


def graph_edges(nodes: DataFrame, relations: DataFrame) -> DataFrame:
    """(doc_id, source, relation, target, ordinal) where both ends are in the document."""
    r = F.broadcast(relations)
    a = nodes.select("doc_id", F.lower("label").alias("a"), F.col("node_id").alias("source"))
    b = nodes.select("doc_id", F.lower("label").alias("b"), F.col("node_id").alias("target"))
    x = a.join(r.select(F.lower("source").alias("a"), "relation", F.lower("target").alias("b"), "ordinal"), "a").join(b, ["doc_id", "b"])
    return x.select("doc_id", "source", "relation", "target", "ordinal")


def document_edges(nodes: DataFrame, references: DataFrame | None = None, dates: DataFrame | None = None, document_type: str = "DocumentType") -> DataFrame:
    """(doc_id, source, relation, target, ordinal): from a document to its document types, then its reference identifiers, then its date."""
    doc = F.concat(F.lit("doc:"), F.col("doc_id").cast("string")).alias("source")
    own = F.concat(F.col("doc_id").cast("string"), F.lit(":"), T.label_key(F.col("label")))
    out = nodes.filter(F.col("type") == document_type).select("doc_id", doc, F.lit("HAS_DOCUMENT_TYPE").alias("relation"), F.col("node_id").alias("target"), F.col("ordinal").cast("long").alias("ordinal"))
    if references is not None:
        rank = F.row_number().over(Window.partitionBy("doc_id").orderBy("label")) + (1 << 20)
        out = out.union(references.select("doc_id", doc, F.lit("HAS_REFERENCE"), own, rank.cast("long")))
    if dates is not None:
        out = out.union(dates.select("doc_id", doc, F.lit("DATED"), own, F.lit(1 << 40).cast("long")))
    return out


def numbered_edges(edges: DataFrame, of_documents: DataFrame, nodes: DataFrame) -> DataFrame:
    """All edges with their ids rel1, rel2, ... in each document (relations of the domain first) and the pages and positions of both ends."""
    both = edges.withColumn("phase", F.lit(0)).unionByName(of_documents.withColumn("phase", F.lit(1)))
    order = Window.partitionBy("doc_id").orderBy("phase", "ordinal", "relation", "target")
    both = both.withColumn("id", F.concat(F.lit("rel"), F.row_number().over(order).cast("string")))
    none = F.array().cast("array<bigint>")
    for end in ("source", "target"):
        ends = nodes.select("doc_id", F.col("node_id").alias(end), F.col("pages").cast("array<bigint>").alias(f"{end}_pages"), F.col("positions").cast("array<bigint>").alias(f"{end}_positions"))
        both = both.join(ends, ["doc_id", end], "left")
    union = lambda what: F.array_union(F.coalesce(f"source_{what}", none), F.coalesce(f"target_{what}", none))
    return both.select("doc_id", "id", "source", "relation", "target", F.array_sort(union("pages")).alias("pages"), union("positions").alias("positions"))


def anchor_edges(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """MENTIONS edges from the document to the first node of every part of its graph.

    A document's edges are as few as its domain's relations, so they are folded over an array of labels
    inside one row: each edge gives both ends' parts the smaller label.
    """
    ends = nodes.select("doc_id", "node_id", "ordinal")
    e = edges.join(ends.withColumnsRenamed({"node_id": "source", "ordinal": "x"}), ["doc_id", "source"]).join(ends.withColumnsRenamed({"node_id": "target", "ordinal": "y"}), ["doc_id", "target"])
    e = e.groupBy("doc_id").agg(F.collect_list(F.struct("x", "y")).alias("edges"), F.max(F.greatest("x", "y")).alias("most"))
    fold = "aggregate(edges, sequence(0, most), (l, e) -> transform(l, v -> case when v = l[e.x] or v = l[e.y] then least(l[e.x], l[e.y]) else v end))"
    roots = e.select("doc_id", F.expr(fold).alias("roots"))
    first = nodes.join(roots, "doc_id", "left").filter(F.coalesce(F.get("roots", F.col("ordinal")), F.col("ordinal")) == F.col("ordinal"))
    return first.select("doc_id", F.concat(F.lit("doc:"), F.col("doc_id").cast("string")).alias("source"), F.lit("MENTIONS").alias("relation"), F.col("node_id").alias("target"))


def graph_evidence(candidates: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(doc_id, value, node_id, relation, other): edges at either end of entities named like a candidate, within the document; two equi-joins, not one on "or"."""
    hit = candidates.select("doc_id", "value").distinct().join(nodes.select("doc_id", "node_id", F.lower("label").alias("l")), (F.lower("value") == F.col("l")) & (candidates["doc_id"] == nodes["doc_id"])).select(candidates["doc_id"].alias("doc_id"), "value", "node_id")
    out = hit.join(edges.select("doc_id", F.col("source").alias("node_id"), "relation", F.col("target").alias("other")), ["doc_id", "node_id"])
    back = hit.join(edges.select("doc_id", F.col("target").alias("node_id"), "relation", F.col("source").alias("other")), ["doc_id", "node_id"])
    return out.unionByName(back).distinct().select("doc_id", "value", "node_id", "relation", "other")


def neighbours(nodes: DataFrame, edges: DataFrame, labels: list[str], limit: int = 20) -> DataFrame:
    """One step in either direction from entities of given labels across documents, ordered, at most ``limit`` (the feature)."""
    start = nodes.filter(F.lower("label").isin([x.lower() for x in labels])).select("node_id", "label")
    both = edges.select(F.col("source").alias("node_id"), "relation", F.col("target").alias("other")).union(edges.select("target", "relation", "source"))
    return start.join(both, "node_id").select("node_id", "relation", "other").orderBy("node_id", "relation", "other").limit(limit)


def circle_layout(nodes: DataFrame, radius: float = 100.0) -> DataFrame:
    """Places on a circle by rank; beyond eight nodes the radius alternates."""
    doc = Window.partitionBy("doc_id")
    i, n = F.row_number().over(doc.orderBy("ordinal", "node_id")) - 1, F.count("*").over(doc)
    r = F.when((n > 8) & (i % 2 == 1), radius * 0.7).otherwise(radius)
    return nodes.select("doc_id", "node_id", (r * F.cos(2 * F.pi() * i / n)).alias("x"), (r * F.sin(2 * F.pi() * i / n)).alias("y"))


def write_graph(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    """Replace the graphs of the documents at hand, others stay."""
    for name, df in (("nodes", nodes), ("edges", edges)):
        df.withColumnRenamed("doc_id", "document_id").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("document_id").parquet(f"{path}/{name}")
