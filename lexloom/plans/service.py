"""Queries on what surrounds recognition: uploads, layout, evidence, prompts, evaluations, reports. Registered beside those of ``registry``."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import constants as K
from ..functions import text as T
from ..operators import candidates as cand
from ..operators import catalog, errors, graph, quality, retrieval, tokens
from ..sources import tables
from ..sources.tables import table
from .registry import _EDGES, _NODES, _TOKENS, ORACLE_SQL, QUERIES, TIE, _documents, _nodes, _round, _specs, _tokens, query

# ---------------------------------------------------------------- sources


@query(
    """WITH u AS (SELECT c_custkey, c_name || CASE c_custkey % 8 WHEN 0 THEN '.pdf' WHEN 1 THEN '.PNG' WHEN 2 THEN '.jpg' WHEN 3 THEN '.jpeg' WHEN 4 THEN '.tif' WHEN 5 THEN '.tiff' WHEN 6 THEN '.docx' ELSE '' END AS path, c_custkey * 400000 % 40000000 AS size,
CASE c_custkey % 5 WHEN 0 THEN '25504446' WHEN 1 THEN '89504E47' WHEN 2 THEN 'FFD8FFE0' WHEN 3 THEN '49492A00' ELSE '4D4D002A' END AS start FROM customer),
m AS (SELECT *, lower(regexp_extract(path, '[.][^./]+$')) AS sfx FROM u), k(sfx, media_type, starts) AS (VALUES ('.pdf', 'application/pdf', ['25504446']), ('.png', 'image/png', ['89504E47']), ('.jpg', 'image/jpeg', ['FFD8FFE0']), ('.jpeg', 'image/jpeg', ['FFD8FFE0']), ('.tif', 'image/tiff', ['49492A00', '4D4D002A']), ('.tiff', 'image/tiff', ['49492A00', '4D4D002A']))
SELECT c_custkey AS id, media_type, CAST(CASE WHEN media_type IS NULL THEN 415 WHEN size > 26214400 THEN 413 WHEN NOT list_contains(starts, start) THEN 422 ELSE 201 END AS INT) AS status FROM m LEFT JOIN k USING (sfx)"""
)
def upload_rules(spark, d):
    n = F.col("c_custkey")
    suffix = F.get(F.array(*[F.lit(x) for x in (".pdf", ".PNG", ".jpg", ".jpeg", ".tif", ".tiff", ".docx", "")]), (n % 8).cast("int"))
    start = F.get(F.array(*[F.lit(x) for x in ("25504446", "89504E47", "FFD8FFE0", "49492A00", "4D4D002A")]), (n % 5).cast("int"))
    media, status = tables.upload_verdict(F.concat("c_name", suffix), n * 400000 % 40000000, start)
    return table(spark, d, "customer").select(n.alias("id"), media.alias("media_type"), status.alias("status"))


@query(
    r"""WITH w AS (SELECT conv_id AS doc_id, turn // 4 + 1 AS page, turn AS line_index, i - 1 AS word_index, l[i] AS text, (conv_id % 100) / 100::DOUBLE AS confidence, CASE WHEN turn % 2 = 0 THEN turn * 10.0::DOUBLE ELSE 0::DOUBLE END AS top
  FROM (SELECT *, regexp_extract_all(text, '\S+') AS l FROM conversations), unnest(range(1, len(l) + 1)) AS r(i))
SELECT doc_id, page, line_index, CAST(word_index AS INT) AS word_index, 'p' || page || '-t' || row_number() OVER (PARTITION BY doc_id, page ORDER BY line_index, word_index) AS id, text, confidence, top FROM w"""
)
def recognizer_words(spark, d):
    c = table(spark, d, "conversations")
    box = F.when(F.col("turn") % 2 == 0, F.array(F.lit(0.0), F.col("turn") * 10.0, F.lit(100.0), F.col("turn") * 10.0 + 8))
    lines = c.select(F.col("conv_id").alias("doc_id"), F.expr("turn div 4 + 1").alias("page"), F.col("turn").alias("line_index"), "text", (F.col("conv_id") % 100 / 100.0).alias("score"), box.alias("line_box"), F.lit(None).cast("array<array<double>>").alias("word_boxes"))
    return tokens.recognizer_tokens(lines).select("doc_id", "page", "line_index", "word_index", "id", "text", "confidence", F.get("bbox", F.lit(1)).alias("top"))


@query(
    """SELECT l_orderkey AS doc_id, CAST(l_linenumber AS INT) AS page, l_returnflag AS text, round((l_quantity * 2 - 5) / 100, 4) AS confidence, l_quantity AS x1, l_quantity + 10 AS x2 FROM lineitem WHERE l_quantity * 2 - 5 >= 0 AND trim(l_returnflag) <> ''"""
)
def boxed_word_scan(spark, d):
    q = F.col("l_quantity")
    w = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").cast("int").alias("page"), F.col("l_returnflag").alias("text"), (q * 2 - 5).alias("conf"), q.alias("x"), F.lit(0.0).alias("y"), F.lit(10.0).alias("width"), F.lit(8.0).alias("height"))
    b = tokens.boxed_words(w)
    return b.select("doc_id", "page", "text", F.round(TIE + F.col("confidence"), 4).alias("confidence"), F.get("bbox", F.lit(0)).alias("x1"), F.get("bbox", F.lit(2)).alias("x2"))


@query("SELECT page_id AS id, coalesce(sha256(CASE WHEN page_id % 9 > 0 THEN html END), 'missing') AS sha256 FROM pages")
def file_digests(spark, d):
    return table(spark, d, "pages").select(F.col("page_id").alias("id"), tables.file_digest(F.when(F.col("page_id") % 9 > 0, F.col("html").cast("binary"))).alias("sha256"))


@query(
    """WITH r AS (SELECT o_orderkey AS id, CASE o_orderkey % 5 WHEN 0 THEN NULL WHEN 1 THEN 'FAILED' ELSE 'COMPLETED' END AS m, CASE WHEN o_orderkey % 7 > 0 THEN CASE WHEN o_orderkey % 3 = 0 THEN ' ' ELSE o_orderpriority END END AS reference, CASE WHEN o_orderkey % 11 > 0 THEN o_orderstatus END AS ocr FROM orders)
SELECT id, CASE WHEN m IS NULL THEN 'INVALID_METADATA' WHEN m = 'FAILED' THEN 'FAILED_RUN' WHEN reference IS NULL THEN 'MISSING_REFERENCE' WHEN trim(reference) = '' THEN 'EMPTY_REFERENCE' WHEN ocr IS NULL THEN 'NOT_YET_MEASURED' ELSE 'MEASURED' END AS metric_status FROM r"""
)
def artifact_status(spark, d):
    k = F.col("o_orderkey")
    status = F.when(k % 5 == 1, "FAILED").when(k % 5 != 0, "COMPLETED")
    reference = F.when(k % 7 > 0, F.when(k % 3 == 0, " ").otherwise(F.col("o_orderpriority")))
    r = table(spark, d, "orders").select(k.alias("id"), status.alias("metadata_status"), reference.alias("reference"), F.when(k % 11 > 0, F.col("o_orderstatus")).alias("ocr_text"), F.col("o_orderstatus").alias("corrected_text"))
    return catalog.artifact_status(r).select("id", "metric_status")


@query(
    """WITH m AS (SELECT item_id, item_id % 4 = 0 AS run, (item_id % 3 > 0)::INT + (item_id % 5 > 0)::INT AS files, text FROM benchmark) SELECT item_id AS document_id FROM m WHERE NOT (run AND files = 2)"""
)
def unfinished_documents(spark, d):
    b = table(spark, d, "benchmark")
    k = F.col("item_id")
    manifest = b.select(k.alias("document_id"), F.when(k % 4 == 0, "ACTUALLY_RUN").otherwise("NOT_RUN").alias("execution_status"))
    files = b.filter(k % 3 > 0).select(k.alias("document_id"), F.lit("ocr_raw.txt").alias("file")).union(b.filter(k % 5 > 0).select(k, F.lit("corrected.txt")))
    return catalog.unfinished(manifest, files, ["ocr_raw.txt", "corrected.txt"]).select("document_id")


# ---------------------------------------------------------------- names and cases


@query(
    r"""WITH n AS (SELECT DISTINCT p_brand || ' ' || p_name || ' (' || p_type || ').v1.pdf' AS name FROM part), s AS (SELECT name, regexp_replace(regexp_replace(regexp_replace(name, '[.][^.]*$', ''), '[^A-Za-z0-9._-]+', '-', 'g'), '^[-._]+|[-._]+$', '', 'g') AS stem FROM n)
SELECT name, CASE WHEN stem = '' THEN 'document' ELSE stem END AS stem, regexp_replace(lower(name), '[^a-z0-9]+', '', 'g') AS phrase_key, regexp_replace(regexp_replace(lower(name), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') AS label_key FROM s"""
)
def name_keys(spark, d):
    n = table(spark, d, "part").select(F.concat("p_brand", F.lit(" "), "p_name", F.lit(" ("), "p_type", F.lit(").v1.pdf")).alias("name")).distinct()
    c = F.col("name")
    return n.select("name", T.safe_stem(c).alias("stem"), T.phrase_key(c).alias("phrase_key"), T.label_key(c).alias("label_key"))


@query(
    r"""WITH w AS (SELECT DISTINCT p_name || '-' || p_brand AS low FROM part), o AS (SELECT low, unnest([low, upper(low), array_to_string([upper(x[1]) || lower(x[2:]) FOR x IN regexp_extract_all(low, '\p{L}+|[^\p{L}]+')], '')]) AS original FROM w), r AS (SELECT DISTINCT original, 'o''neil smith' AS replacement FROM o),
t AS (SELECT *, array_to_string([upper(x[1]) || lower(x[2:]) FOR x IN regexp_extract_all(original, '\p{L}+|[^\p{L}]+')], '') AS title FROM r)
SELECT original, CASE WHEN upper(original) = original THEN 'O''NEIL SMITH' WHEN title = original THEN 'O''Neil Smith' ELSE replacement END AS cased FROM t"""
)
def case_transfer(spark, d):
    low = F.concat("p_name", F.lit("-"), "p_brand")
    w = table(spark, d, "part").select(low.alias("w")).distinct().select(F.explode(F.array("w", F.upper("w"), T.title_case(F.col("w")))).alias("original")).distinct()
    return w.select("original", T.preserve_case(F.col("original"), F.lit("o'neil smith")).alias("cased"))


@query("SELECT l_orderkey AS run_id, CASE WHEN bool_or(l_discount > 0.09) THEN 'FAILED' WHEN count_if(l_returnflag = 'R') > 0 THEN 'WARNING' ELSE 'COMPLETED' END AS status FROM lineitem GROUP BY l_orderkey")
def stage_status(spark, d):
    s = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("run_id")).agg(F.collect_list(F.when(F.col("l_returnflag") == "R", "returned")).alias("warnings"), F.max(F.when(F.col("l_discount") > 0.09, "failed")).alias("error"))
    return s.select("run_id", T.stage_status(F.col("warnings"), F.col("error")).alias("status"))


# ---------------------------------------------------------------- pages and regions

_MEASURES = "l_orderkey AS page, l_linenumber AS id, l_quantity * 2 AS width, l_discount * 400 AS height, l_tax * 10000 AS top"


@query(f"WITH b AS (SELECT {_MEASURES} FROM lineitem) SELECT page, id, CASE WHEN width * height >= greatest(500, 0.0002::DOUBLE * 200 * 800) THEN CASE WHEN height > 22 AND width > 50 AND top < 240 THEN 'heading' ELSE 'text_block' END END AS class FROM b")
def layout_regions(spark, d):
    b = table(spark, d, "lineitem").selectExpr(*_MEASURES.replace(" AS ", " as ").split(", "))
    return b.select("page", "id", tokens.layout_class(F.col("width"), F.col("height"), F.col("top"), F.lit(200.0), F.lit(800.0)).alias("class"))


@query("SELECT l_orderkey AS page, l_linenumber AS id, [x FOR x IN [CASE WHEN l_discount * 10 > 0.7 THEN 'denoise' END, CASE WHEN l_quantity * 4 < 130 THEN 'contrast' END, CASE WHEN abs(l_tax * 200 - 8) > 0.35 AND abs(l_tax * 200 - 8) < 8 THEN 'deskew' END, CASE WHEN l_quantity > 22 THEN 'adaptive_threshold' END] IF x IS NOT NULL] AS operations FROM lineitem")
def preprocess_plan(spark, d):
    c = F.col
    return table(spark, d, "lineitem").select(c("l_orderkey").alias("page"), c("l_linenumber").alias("id"), tokens.preprocess_operations(c("l_discount") * 10, c("l_quantity") * 4, c("l_tax") * 200 - 8, c("l_quantity")).alias("operations"))


@query(
    r"""WITH p AS (SELECT doc_id, sum(1000.0::DOUBLE * (800 + 100 * i)) AS px FROM documents, unnest(range(doc_id % 3)) AS r(i) GROUP BY doc_id)
SELECT doc_id, round(length(regexp_replace(text, '[^\p{L}\p{N}]', '', 'g')) / (px / 1e6), 4) AS density FROM documents LEFT JOIN p USING (doc_id)"""
)
def text_density(spark, d):
    docs = _documents(spark, d)
    pages = docs.filter(F.col("doc_id") % 3 > 0).select("doc_id", F.explode(F.sequence(F.lit(0), F.col("doc_id") % 3 - 1)).alias("i")).select("doc_id", F.lit(1000).alias("width"), (800 + 100 * F.col("i")).alias("height"))
    return _round(quality.text_density(docs, pages), "density")


# ---------------------------------------------------------------- evidence and prompts

_LOW = f"""{_TOKENS}, low AS (SELECT doc_id, pos, text, confidence FROM tok WHERE confidence < 0.9)"""


def _low(spark, d):
    return _tokens(spark, d).filter("confidence < 0.9").select("doc_id", "pos", "text", "confidence")


def _evidence(spark, d):
    """Sets of one candidate, passages for even places, facts for places divisible by three."""
    low = _low(spark, d)
    c = lambda rank, value, source, similarity: F.struct(rank.alias("rank"), value.alias("value"), F.lit(source).alias("source"), F.lit(similarity).alias("similarity"))
    sets = low.withColumn("candidates", F.array(c(F.lit(1), F.lower("text"), "domain", 0.9), c(F.lit(None).cast("int"), F.lit("KEEP_ORIGINAL"), "original", 1.0)))
    semantic = low.filter("pos % 2 = 0").select("doc_id", "pos", F.posexplode(F.array(*[F.lit(f"passage {x}") for x in "abc"])).alias("rank", "passage"))
    facts = low.filter("pos % 3 = 0").select("doc_id", "pos", F.explode(F.array(*[F.lit(f"fact {x}") for x in "cab"])).alias("fact"))
    return sets, semantic, facts


@query(
    f"""WITH {_LOW} SELECT doc_id, pos, '{{"token":' || to_json(text) || ',"confidence":' || confidence || ',"candidates":[{{"rank":1,"value":' || to_json(lower(text)) || ',"source":"domain","similarity":0.9}},{{"rank":null,"value":"KEEP_ORIGINAL","source":"original","similarity":1.0}}],"semantic_evidence":[' ||
CASE WHEN pos % 2 = 0 THEN '"passage a","passage b"' ELSE '' END || '],"graph_evidence":[' || CASE WHEN pos % 3 = 0 THEN '"fact a","fact b"' ELSE '' END || ']}}' AS prompt FROM low"""
)
def prompt_json(spark, d):
    return cand.prompts(*_evidence(spark, d))


@query(f"WITH {_LOW} SELECT doc_id, pos, text, CAST(CASE WHEN pos % 2 = 0 THEN 3 ELSE 0 END AS INT) AS n_semantic, CAST(CASE WHEN pos % 3 = 0 THEN 3 ELSE 0 END AS INT) AS n_graph FROM low")
def hybrid_evidence(spark, d):
    return cand.combined_evidence(*_evidence(spark, d)).select("doc_id", "pos", "text", F.size("semantic").alias("n_semantic"), F.size("graph").alias("n_graph"))


@query(
    f"""WITH {_TOKENS}, {_NODES}, {_EDGES} SELECT node_id, relation, other FROM (SELECT node_id, relation, target AS other FROM nd JOIN ed ON ed.source = nd.node_id AND ed.doc_id = nd.doc_id WHERE lower(label) IN ('the', 'and')
UNION ALL SELECT node_id, relation, ed.source FROM nd JOIN ed ON ed.target = nd.node_id AND ed.doc_id = nd.doc_id WHERE lower(label) IN ('the', 'and')) ORDER BY node_id, relation, other LIMIT 20"""
)
def graph_neighbours(spark, d):
    n = _nodes(spark, d)
    return graph.neighbours(n, graph.graph_edges(n, _specs(spark)[1]), ["The", "and"])


@query(
    f"""WITH {_TOKENS}, {_NODES}, p AS (SELECT doc_id, node_id, row_number() OVER (PARTITION BY doc_id ORDER BY ordinal, node_id) - 1 AS i, count(*) OVER (PARTITION BY doc_id) AS n FROM nd)
SELECT doc_id, node_id, round(100 * cos(2 * pi() * i / n), 4) AS x, round(100 * sin(2 * pi() * i / n), 4) AS y FROM p"""
)
def graph_layout(spark, d):
    return _round(graph.circle_layout(_nodes(spark, d)), "x", "y")


# ---------------------------------------------------------------- evaluations and reports

_NOISY = r"""ns AS (SELECT conv_id * 1000 + turn AS id, text AS line, regexp_extract(text, '[A-Za-z]{3,}') AS correct FROM conversations),
cr AS (SELECT id, line, correct, upper(correct) || '0' AS corrupted, CASE WHEN correct <> '' THEN instr(line, correct) ELSE 0 END AS place FROM ns),
ij AS (SELECT id, CASE WHEN place > 0 THEN left(line, place - 1) || corrupted || substr(line, place + length(correct)) END AS text FROM cr)"""


def _noisy(spark, d):
    c = table(spark, d, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), "text", F.regexp_extract("text", "[A-Za-z]{3,}", 0).alias("correct"))
    return c.withColumn("correct", F.when(F.col("correct") != "", F.col("correct"))).withColumn("corrupted", F.concat(F.upper("correct"), F.lit("0")))


@query(f"WITH {_NOISY} SELECT id, text FROM ij")
def corruption_injection(spark, d):
    return catalog.inject_corruption(_noisy(spark, d)).select("id", "text")


@query(f"WITH {_NOISY} SELECT cr.id, CASE WHEN place > 0 THEN line END AS text FROM cr")
def corruption_undone(spark, d):
    """The corrupted texts with the corruption replaced again: the originals."""
    bad = catalog.inject_corruption(_noisy(spark, d))
    return catalog.inject_corruption(bad.select("id", "text", F.col("corrupted").alias("correct"), F.col("correct").alias("corrupted"))).select("id", "text")


_TURNS = "tu AS (SELECT conv_id * 1000 + turn AS id, text AS reference, replace(replace(text, 'th', 'tn'), 'e', 'c') AS before, replace(text, 'th', 'tn') AS after FROM conversations)"
_FINALS = r"""fw AS (SELECT id, w.a AS final, refs FROM (SELECT id, regexp_extract_all(after, '\S+') AS a, regexp_extract_all(before, '\S+') AS b, regexp_extract_all(reference, '\S+') AS refs FROM tu), unnest([{'a': a[i], 'b': b[i]} FOR i IN range(1, len(a) + 1)]) AS r(w) WHERE w.a <> w.b)"""


def _turns(spark, d):
    a = F.replace("text", F.lit("th"), F.lit("tn"))
    return table(spark, d, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), F.col("text").alias("reference"), F.replace(a, F.lit("e"), F.lit("c")).alias("before"), a.alias("after"))


@query(f"WITH {_TURNS}, {_FINALS} SELECT id, round(avg(list_contains(refs, final)::INT), 4) AS precision, round(1 - avg(list_contains(refs, final)::INT), 4) AS over_correction FROM fw GROUP BY id")
def changed_token_precision(spark, d):
    t, split = _turns(spark, d), lambda c: F.regexp_extract_all(c, F.lit(r"\S+"), F.lit(0))
    changes = t.select("id", F.explode(F.arrays_zip(split("after").alias("a"), split("before").alias("b"))).alias("w")).filter("w.a <> w.b").select("id", F.col("w.a").alias("final"))
    return _round(errors.changed_token_precision(changes, t.select("id", split("reference").alias("words"))), "precision", "over_correction")


#: Outcomes over all turns, by counts of changed characters (both replacements keep lengths, so these are distances of aligned texts).
_MEASURED = f"""{_TURNS}, ms AS (SELECT id, CASE WHEN id % 7 = 0 THEN 'FAILED_RUN' ELSE 'MEASURED' END AS metric_status, (length(regexp_replace(reference, '[^e]', '', 'g')) + (length(reference) - length(replace(reference, 'th', '')) ) / 2) / length(reference) AS b, (length(reference) - length(replace(reference, 'th', ''))) / 2 / length(reference) AS a FROM tu)"""


def _measured(spark, d):
    n = lambda a, b: F.size(F.filter(F.arrays_zip(F.split(a, "").alias("a"), F.split(b, "").alias("b")), lambda x: x["a"] != x["b"]))
    t = _turns(spark, d).select("id", F.try_divide(n("before", "reference"), F.length("reference")).alias("cer_before"), F.try_divide(n("after", "reference"), F.length("reference")).alias("cer_after"))
    return errors.outcomes(t).withColumn("metric_status", F.when(F.col("id") % 7 == 0, "FAILED_RUN").otherwise("MEASURED"))


@query(
    f"""WITH {_MEASURED}, m AS (SELECT * FROM ms WHERE metric_status = 'MEASURED') SELECT (SELECT count(*) FROM ms) AS n, count(*) AS measured, count_if(a < b) AS improved, count_if(a = b) AS unchanged, count_if(a > b) AS worsened,
round(count_if(a = 0 AND b = 0) / nullif(count_if(b = 0), 0), 4) AS clean_preservation_rate, round(avg(b), 4) AS macro_cer_before, round(avg(a), 4) AS macro_cer_after FROM m"""
)
def saved_run_summary(spark, d):
    return _round(catalog.saved_run_summary(_measured(spark, d)), "clean_preservation_rate", "macro_cer_before", "macro_cer_after")


@query(
    f"""WITH {_MEASURED} SELECT 'cer' AS metric, round(avg(b), 4) AS before, round(avg(a), 4) AS after, round(avg(b - a), 4) AS absolute_reduction, round(avg(CASE WHEN b > 0 THEN (b - a) / b END), 4) AS relative_reduction FROM ms"""
)
def before_after_means(spark, d):
    m = _measured(spark, d).agg(F.avg("cer_before").alias("before"), F.avg("cer_after").alias("after"), F.avg("absolute_reduction").alias("absolute_reduction"), F.avg("relative_reduction").alias("relative_reduction"))
    return _round(m, "before", "after", "absolute_reduction", "relative_reduction").select(F.lit("cer").alias("metric"), "before", "after", "absolute_reduction", "relative_reduction")


@query(f"WITH {_MEASURED} SELECT * FROM (SELECT 'baseline' AS strategy, 'COMPUTED' AS status, round(avg(b), 4) AS cer FROM ms UNION ALL SELECT 'full', 'COMPUTED', round(avg(a), 4) FROM ms UNION ALL SELECT unnest(['lexical_only', 'semantic_only', 'graph_only', 'lexical_semantic', 'lexical_graph', 'model_only']), 'UNAVAILABLE', NULL)")
def strategy_table(spark, d):
    r = _measured(spark, d).agg(F.avg("cer_before").alias("b"), F.avg("cer_after").alias("a")).first()  # one row
    return _round(errors.strategies(spark, r["b"], r["a"]), "cer")


@query("SELECT round(coalesce(sum(l_linenumber) / nullif(sum(l_quantity), 0), 1), 4) AS correction_accuracy, round(1 - sum(l_tax) / nullif(sum(l_quantity), 0), 4) AS token_accuracy FROM lineitem")
def micro_accuracy(spark, d):
    li = table(spark, d, "lineitem").select(F.col("l_linenumber").alias("corrected"), F.col("l_quantity").alias("injected"), F.col("l_tax").alias("edits"), F.col("l_quantity").alias("reference_units"))
    return _round(catalog.micro_accuracy(li), "correction_accuracy", "token_accuracy")


@query(
    """WITH r AS (SELECT l_linenumber + 1 AS injected, CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS left_over, l_tax AS b, l_discount AS a FROM lineitem)
SELECT CAST(sum(injected) AS BIGINT) AS injected, CAST(sum(injected - left_over) AS BIGINT) AS corrected, CAST(sum(left_over) AS BIGINT) AS unresolved, round(sum(injected - left_over) / sum(injected), 4) AS correction_accuracy, count_if(a < b) AS improved, count_if(a = b) AS unchanged, count_if(a > b) AS worsened, round(avg(b), 4) AS macro_cer_before, round(avg(a), 4) AS macro_cer_after FROM r"""
)
def constructed_summary(spark, d):
    left = F.when(F.col("l_returnflag") == "R", 1).otherwise(0)
    r = table(spark, d, "lineitem").select((F.col("l_linenumber") + 1).cast("long").alias("injected"), (F.col("l_linenumber") + 1 - left).cast("long").alias("corrected"), F.col("l_tax").alias("cer_before"), F.col("l_discount").alias("cer_after"))
    return _round(catalog.constructed_summary(r), "correction_accuracy", "macro_cer_before", "macro_cer_after")


@query("SELECT CASE WHEN count(labels.doc_id) = 0 THEN 'WITHOUT_GROUND_TRUTH' WHEN count(labels.doc_id) = count(*) THEN 'WITH_GROUND_TRUTH' ELSE 'MIXED' END AS mode FROM documents LEFT JOIN labels USING (doc_id)")
def report_mode(spark, d):
    have = table(spark, d, "labels").select("doc_id", F.lit(True).alias("t"))
    return catalog.report_mode(_documents(spark, d).join(have, "doc_id", "left").select(F.col("t").isNotNull().alias("has_truth")))


@query("SELECT * FROM (VALUES ('layout', 'UNAVAILABLE'), ('ocr', 'UNAVAILABLE'), ('retrieval:tfidf', 'READY'), ('graph', 'READY'), ('selector:rank-1 rule', 'READY')) t(component, status)")
def capability_report(spark, d):
    return catalog.capabilities(spark, {"layout": False, "ocr": False, f"retrieval:{retrieval.choose_method(False)}": True, "graph": True, "selector:rank-1 rule": True}).select("component", "status")


_CHART_METRICS = ("valid_word_ratio", "dictionary_match_ratio", "noise_ratio")


@query()
def distribution_charts(spark, d):
    return quality.distributions(QUERIES["quality_score"](spark, d), list(_CHART_METRICS))


ORACLE_SQL["distribution_charts"] = f"WITH q AS ({ORACLE_SQL['quality_score']}), l AS (SELECT unnest([{', '.join(repr(m) for m in _CHART_METRICS)}]) AS metric, unnest([{', '.join(_CHART_METRICS)}]) AS v FROM q), " + """
e AS (SELECT metric, min(v) AS lo, max(v) AS hi FROM l GROUP BY metric), b AS (SELECT metric, least(9, floor((v - lo) / (hi - lo) * 10)) AS bin FROM l JOIN e USING (metric) WHERE v IS NOT NULL), g AS (SELECT metric, i FROM e, unnest(range(10)) AS r(i))
SELECT g.metric, CAST(g.i AS INT) AS bin, count(b.bin) AS n FROM g LEFT JOIN b ON b.metric = g.metric AND b.bin = g.i GROUP BY g.metric, g.i"""


@query()
def evaluation_rows(spark, d):
    """One row per document: quality, confidence, structure."""
    t = _tokens(spark, d)
    out = QUERIES["quality_score"](spark, d).join(quality.weighted_confidence(t), "doc_id", "left").join(quality.structural_consistency(t).select("doc_id", "structural_consistency"), "doc_id", "left")
    return _round(out, "ocr_confidence", "structural_consistency")


ORACLE_SQL["evaluation_rows"] = f"SELECT q.*, ocr_confidence, n_confident, structural_consistency FROM ({ORACLE_SQL['quality_score']}) q LEFT JOIN ({ORACLE_SQL['weighted_confidence']}) c USING (doc_id) LEFT JOIN ({ORACLE_SQL['structural_consistency']}) s USING (doc_id)"


_COMPONENTS = ("ocr_confidence", "valid_word_ratio", "dictionary_match_ratio", "noise_cleanliness", "artifact_cleanliness", "language_consistency", "structural_consistency", "non_alphanumeric_cleanliness", "density_quality")


@query()
def full_quality_score(spark, d):
    """The weighted score over all components that need no true text, each rounded to four digits; page sizes are invented."""
    docs, t = _documents(spark, d), _tokens(spark, d)
    noise = quality.noise_metrics(docs, compose=False)
    pages = docs.select("doc_id", F.lit(1000).alias("width"), (F.lit(1000) + F.col("doc_id") % 7 * 100).alias("height"))
    clean = noise.select("doc_id", "n_chars", *[(1 - F.col(c)).alias(k) for c, k in (("noise_ratio", "noise_cleanliness"), ("artifact_ratio", "artifact_cleanliness"), ("non_alphanumeric_ratio", "non_alphanumeric_cleanliness"))])
    parts = [
        QUERIES["word_quality"](spark, d).select("doc_id", "valid_word_ratio", "dictionary_match_ratio"),
        quality.weighted_confidence(t).select("doc_id", "ocr_confidence"),
        quality.structural_consistency(t).select("doc_id", "structural_consistency"),
        QUERIES["language_profile"](spark, d).select("doc_id", F.col("share").alias("language_consistency")),
        quality.text_density(docs, pages).select("doc_id", quality.density_quality(F.col("density")).alias("density_quality")),
    ]
    for p in parts:
        clean = clean.join(p, "doc_id", "left")
    out = quality.final_scores(_round(clean, *_COMPONENTS), F.col("n_chars") == 0)
    return _round(out, "final_score", digits=2).select("doc_id", "n_components", "final_score", "quality_class")


def _full_score_sql() -> str:
    weights = {k: K.QUALITY_WEIGHTS[k] for k in _COMPONENTS}
    top = " + ".join(f"CASE WHEN {k} IS NULL THEN 0 ELSE {w}::DOUBLE * greatest(0, least(1, {k})) END" for k, w in weights.items())
    bottom = " + ".join(f"CASE WHEN {k} IS NULL THEN 0 ELSE {w}::DOUBLE END" for k, w in weights.items())
    share = lambda c: f"round({TIE} + (1 - {c} / nullif(n_chars, 0)), 4)"
    return rf"""WITH m AS (SELECT n.doc_id, n_chars, ocr_confidence, valid_word_ratio, dictionary_match_ratio, {share("n_noise")} AS noise_cleanliness, {share("n_artifacts")} AS artifact_cleanliness, {share("n_non_alnum")} AS non_alphanumeric_cleanliness,
  l.share AS language_consistency, structural_consistency, round({TIE} + least(1, length(regexp_replace(t.text, '[^\p{{L}}\p{{N}}]', '', 'g')) / ((1000.0::DOUBLE * (1000 + n.doc_id % 7 * 100)) / 1000000) / 80), 4) AS density_quality
  FROM ({ORACLE_SQL["noise_metrics"]}) n JOIN (SELECT doc_id, text FROM documents) t USING (doc_id) LEFT JOIN ({ORACLE_SQL["word_quality"]}) w USING (doc_id) LEFT JOIN ({ORACLE_SQL["weighted_confidence"]}) c USING (doc_id) LEFT JOIN ({ORACLE_SQL["structural_consistency"]}) s USING (doc_id) LEFT JOIN ({ORACLE_SQL["language_profile"]}) l USING (doc_id)),
f AS (SELECT doc_id, {" + ".join(f"({k} IS NOT NULL)::INT" for k in _COMPONENTS)} AS n_components, CASE WHEN n_chars = 0 THEN 0.0::DOUBLE ELSE coalesce(round(100 * ({top}) / nullif({bottom}, 0), 4), 0) END AS s FROM m)
SELECT doc_id, CAST(n_components AS INT) AS n_components, round({TIE} + s, 2) AS final_score, CASE WHEN s >= 80 THEN 'High Quality' WHEN s >= 60 THEN 'Medium Quality' ELSE 'Low Quality' END AS quality_class FROM f"""


ORACLE_SQL["full_quality_score"] = _full_score_sql()


@query(f"""WITH {_TOKENS}, {_NODES}, {_EDGES}, e AS (SELECT doc_id, 0 AS phase, ordinal, source, relation, target FROM ed UNION ALL SELECT doc_id, 1, ordinal, 'doc:' || doc_id, 'HAS_DOCUMENT_TYPE', node_id FROM nd WHERE type = 'Pair'),
pg AS (SELECT doc_id, doc_id || ':' || replace(lower(label), ' ', '-') AS node_id, page FROM mn), pe AS (SELECT e.doc_id, e.phase, e.ordinal, e.relation, e.target, count(DISTINCT pg.page) AS n_pages FROM e LEFT JOIN pg ON pg.doc_id = e.doc_id AND pg.node_id IN (e.source, e.target) GROUP BY ALL)
SELECT e.doc_id, 'rel' || row_number() OVER (PARTITION BY e.doc_id ORDER BY e.phase, e.ordinal, e.relation, e.target) AS id, e.source, e.relation, e.target, n_pages FROM e JOIN pe USING (doc_id, phase, ordinal, relation, target)""")
def document_relations(spark, d):
    """Pairs of words stand in for document types."""
    nodes = _nodes(spark, d)
    edges = graph.numbered_edges(graph.graph_edges(nodes, _specs(spark)[1]), graph.document_edges(nodes, document_type="Pair"), nodes)
    return edges.select("doc_id", "id", "source", "relation", "target", F.size("pages").cast("long").alias("n_pages"))


@query("SELECT o_orderkey AS doc_id, CAST(i AS INT) AS page FROM orders, unnest(range(1, o_orderkey % 4 + 1)) AS r(i)")
def multi_frame_scan(spark, d):
    return tokens.frame_pages(table(spark, d, "orders").select(F.col("o_orderkey").alias("doc_id"), (F.col("o_orderkey") % 4).alias("frames")))


@query("SELECT l_orderkey AS doc_id, 'p1-t' || row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_extendedprice, l_partkey, l_suppkey) AS id, l_returnflag AS text, 1.0::DOUBLE AS confidence, l_quantity * 2 AS x1, (l_quantity + 10) * 2 AS x2 FROM lineitem")
def embedded_word_tokens(spark, d):
    c = F.col
    w = table(spark, d, "lineitem").select(c("l_orderkey").alias("doc_id"), F.lit(1).alias("page"), F.struct("l_linenumber", "l_extendedprice", "l_partkey", "l_suppkey").alias("word_index"), c("l_returnflag").alias("text"), c("l_quantity").alias("x1"), F.lit(0).alias("y1"), (c("l_quantity") + 10).alias("x2"), F.lit(8).alias("y2"))
    return tokens.embedded_words(w).select("doc_id", "id", "text", "confidence", F.get("bbox", F.lit(0)).alias("x1"), F.get("bbox", F.lit(2)).alias("x2"))


_REGIONS = "SELECT l_orderkey AS page, l_linenumber AS id, floor(l_quantity / 10) AS y1, l_extendedprice AS x1 FROM lineitem"


@query(f"SELECT page, id, CAST(row_number() OVER (PARTITION BY page ORDER BY y1, x1, id) AS INT) AS position FROM ({_REGIONS})")
def layout_order(spark, d):
    r = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("page"), F.col("l_linenumber").alias("id"), F.floor(F.col("l_quantity") / 10).alias("y1"), F.col("l_extendedprice").alias("x1"))
    return tokens.layout_order(r).select("page", "id", "position")


@query("SELECT l_orderkey AS page, l_linenumber AS id, o_orderstatus AS page_status FROM lineitem JOIN orders ON o_orderkey = l_orderkey")
def regions_on_pages(spark, d):
    r = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("page"), F.col("l_linenumber").alias("id"))
    return tokens.regions_on_pages(r, table(spark, d, "orders").select(F.col("o_orderkey").alias("page"), F.col("o_orderstatus").alias("page_status")))


@query("SELECT c_custkey AS id, c_name AS name FROM customer WHERE c_custkey IN (1, 5, 7, 999999999)")
def point_lookup(spark, d):
    return catalog.by_ids(table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name")), [1, 5, 7, 999999999])


@query("SELECT o_orderkey AS id, CASE WHEN o_orderkey % 10 = 0 THEN 'CHANGED' ELSE o_orderstatus END AS status FROM orders UNION ALL SELECT o_orderkey + 1000000000, 'NEW' FROM orders WHERE o_orderkey % 50 = 1")
def run_upsert(spark, d):
    k = F.col("o_orderkey")
    o = table(spark, d, "orders")
    changes = o.filter(k % 10 == 0).select(k.alias("id"), F.lit("CHANGED").alias("status")).union(o.filter(k % 50 == 1).select(k + 1000000000, F.lit("NEW")))
    return catalog.upsert(o.select(k.alias("id"), F.col("o_orderstatus").alias("status")), changes)


@query("SELECT l_orderkey AS run, l_linenumber AS id, l_extendedprice AS price, coalesce(CASE WHEN l_linenumber % 2 = 0 THEN l_discount END, l_tax) AS shown_confidence, CASE WHEN l_returnflag = 'R' THEN 'LOW' ELSE 'KEEP' END AS shown_decision FROM lineitem")
def display_defaults(spark, d):
    c = F.col
    t = table(spark, d, "lineitem").select(c("l_orderkey").alias("run"), c("l_linenumber").alias("id"), c("l_extendedprice").alias("price"), F.when(c("l_linenumber") % 2 == 0, c("l_discount")).alias("ocr_confidence"), c("l_tax").alias("confidence"), F.when(c("l_returnflag") == "R", "LOW").alias("decision"))
    return catalog.displayed(t).select("run", "id", "price", "shown_confidence", "shown_decision")
