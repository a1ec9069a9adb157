"""Token tables: one row per token, with document, position, page, line and confidence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import constants as K
from ..functions import text as T

PAGE_TOKENS, LINE_TOKENS = 400, 12


def synthetic_confidence(doc_id: Column, pos: Column) -> Column:
    """A stand-in where no recogniser ran: integer arithmetic on (doc_id, pos), the same in every engine."""
    return F.pmod(doc_id * 31 + pos * 17, F.lit(100)) / F.lit(100.0)


def tokenize(docs: DataFrame, text: str = "text") -> DataFrame:
    """(doc_id, pos, page, line_index, text, confidence): white-space tokens of every document; pages and lines by position."""
    t = docs.select("doc_id", F.posexplode(F.regexp_extract_all(F.col(text), F.lit(r"\S+"), F.lit(0))).alias("pos", "text"))
    t = t.withColumn("pos", F.col("pos").cast("long"))
    return t.select("doc_id", "pos", F.expr(f"pos div {PAGE_TOKENS} + 1").alias("page"), F.expr(f"pos div {LINE_TOKENS}").alias("line_index"), "text", synthetic_confidence(F.col("doc_id"), F.col("pos")).alias("confidence"))


def recognizer_tokens(lines: DataFrame) -> DataFrame:
    """Words of recognised lines (doc_id, page, line_index, line_order, text, score, line_box, word_boxes): blanks are skipped, a missing box falls back to the line's, then to zeros."""
    words = lines.select("*", F.posexplode(F.regexp_extract_all("text", F.lit(r"\S+"), F.lit(0))).alias("word_index", "word"))
    boxed = words.withColumn("bbox", F.coalesce(F.get("word_boxes", F.col("word_index")), "line_box", F.array(*[F.lit(0.0)] * 4)))
    counter = F.row_number().over(Window.partitionBy("doc_id", "page").orderBy("line_index", "word_index"))
    name = F.format_string("p%d-t%d", F.col("page").cast("int"), counter)
    return boxed.select("doc_id", name.alias("id"), "page", "line_index", "word_index", F.col("word").alias("text"), F.col("score").alias("confidence"), F.col("score").alias("ocr_confidence"), "bbox")


def frame_pages(images: DataFrame) -> DataFrame:
    """A page for each frame of images (doc_id, frames); a decoder that can't tell the number gives null, and no page."""
    return images.filter("frames > 0").select("doc_id", F.explode(F.sequence(F.lit(1), F.col("frames").cast("int"))).alias("page"))


def embedded_words(words: DataFrame, scale: float = 2.0) -> DataFrame:
    """Words (doc_id, page, text, x1, y1, x2, y2) that a document itself holds, in their order ``word_index``: certain, in the rendered page's coordinates."""
    box = F.array(*[F.col(c).cast("double") * scale for c in ("x1", "y1", "x2", "y2")])
    name = F.format_string("p%d-t%d", F.col("page").cast("int"), F.row_number().over(Window.partitionBy("doc_id", "page").orderBy("word_index")))
    return words.select("doc_id", name.alias("id"), "page", "text", F.lit(1.0).alias("confidence"), F.lit(1.0).alias("ocr_confidence"), F.lit("embedded PDF text").alias("confidence_source"), box.alias("bbox"))


def boxed_words(words: DataFrame) -> DataFrame:
    """Words with percent confidence and x, y, width, height: blanks and negative confidence go, the rest is scaled."""
    kept = words.filter((F.trim("text") != "") & (F.col("conf") >= 0))
    return kept.select("doc_id", "page", "text", (F.col("conf") / 100.0).alias("confidence"), F.array("x", "y", F.col("x") + F.col("width"), F.col("y") + F.col("height")).alias("bbox"))


def confidence_gate(tokens: DataFrame, threshold: float = 0.9) -> DataFrame:
    """``tokens`` with decision (LOW or KEEP) and reason."""
    low = F.col("confidence") < threshold
    reason = F.when(low, F.format_string("confidence %.3f below threshold %.3f", "confidence", F.lit(threshold))).otherwise(F.format_string("confidence %.3f meets threshold %.3f", "confidence", F.lit(threshold)))
    return tokens.withColumns({"decision": F.when(low, "LOW").otherwise("KEEP"), "reason": reason})


def confidence_histogram(tokens: DataFrame, bins: int = 10) -> DataFrame:
    """(bin, low, high, n) for every bin, empty ones too; the last includes 1."""
    n = tokens.filter("confidence >= 0 and confidence <= 1").groupBy(F.least(F.floor(F.col("confidence") * bins), F.lit(bins - 1)).cast("int").alias("bin")).agg(F.count("*").alias("n"))
    every = tokens.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    return every.join(F.broadcast(n), "bin", "left").select("bin", (F.col("bin") / float(bins)).alias("low"), ((F.col("bin") + 1) / float(bins)).alias("high"), F.coalesce("n", F.lit(0)).alias("n"))


def confidence_summary(tokens: DataFrame, threshold: float = 0.9) -> DataFrame:
    return tokens.groupBy("doc_id").agg(F.coalesce(F.avg("confidence"), F.lit(0.0)).alias("average"), F.count_if(F.col("confidence") < threshold).alias("n_low"), F.count_if(F.col("confidence") >= threshold).alias("n_high"))


def context_window(tokens: DataFrame, reach: int = 5) -> DataFrame:
    """Each token with its neighbours on both sides, across pages."""
    frame = Window.partitionBy("doc_id").orderBy("pos").rowsBetween(-reach, reach)
    return tokens.withColumn("context", F.concat_ws(" ", F.collect_list("text").over(frame)))


def contexts_at(docs: DataFrame, every: int = 50, reach: int = 5) -> DataFrame:
    """(doc_id, pos, context) of every so-many-th token, cut from the text's row: what ``context_window`` gives there, without a window over all tokens."""
    d = docs.select("doc_id", F.regexp_extract_all("text", F.lit(r"\S+"), F.lit(0)).alias("words")).filter(F.size("words") > 0)
    d = d.select("doc_id", "words", F.explode(F.sequence(F.lit(0), F.size("words") - 1, F.lit(every))).alias("pos"))
    first = F.greatest(F.col("pos") - reach, F.lit(0))
    return d.select("doc_id", F.col("pos").cast("long").alias("pos"), F.array_join(F.slice("words", first + 1, F.col("pos") - first + reach + 1), " ").alias("context"))


def chunks(tokens: DataFrame, threshold: float = 0.9, size: int = 80) -> DataFrame:
    """Trusted tokens of each page in runs of ``size``, numbered through the document."""
    rank = F.row_number().over(Window.partitionBy("doc_id", "page").orderBy("pos")) - 1
    t = tokens.filter(F.col("confidence") >= threshold).withColumn("rank", rank).withColumn("part", F.expr(f"rank div {size}"))
    out = t.groupBy("doc_id", "page", "part").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "text"))), lambda x: x["text"]), " ").alias("text"), F.min("rank").cast("long").alias("token_start"))
    return out.select("doc_id", "page", (F.row_number().over(Window.partitionBy("doc_id").orderBy("page", "part")) - 1).cast("long").alias("chunk"), "text", "token_start")


def regrouped_lines(tokens: DataFrame, per_line: int = 18) -> DataFrame:
    """Lines by line_index, else so many tokens of a page each."""
    rank = F.row_number().over(Window.partitionBy("doc_id", "page").orderBy("pos")) - 1
    t = tokens.withColumn("line", F.coalesce(F.col("line_index"), F.expr(f"__rank div {per_line}")) if "__rank" in tokens.columns else F.coalesce(F.col("line_index"), F.floor(rank / per_line)))
    return t.groupBy("doc_id", "page", "line").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "text"))), lambda x: x["text"]), " ").alias("text"), F.count("*").alias("n_tokens"))


def layout_order(regions: DataFrame) -> DataFrame:
    """``regions`` (page, id, x1, y1) with position: from the top, then from the left."""
    return regions.withColumn("position", F.row_number().over(Window.partitionBy("page").orderBy("y1", "x1", "id")))


def regions_on_pages(regions: DataFrame, pages: DataFrame) -> DataFrame:
    """Regions with the columns of their pages; regions of unknown pages go."""
    return regions.join(pages, "page")


def reading_order(regions: DataFrame) -> DataFrame:
    """``regions`` (page, id, x1, y1, x2, y2) with column and reading_order: two columns if there are four regions or more and the median is narrow."""
    page = Window.partitionBy("page")
    r = regions.withColumns({"__n": F.count("*").over(page), "__w": F.percentile(F.col("x2") - F.col("x1"), F.lit(0.5)).over(page), "__x": F.max("x2").over(page)})
    two = (F.col("__n") >= 4) & (F.col("__w") < 0.65 * F.col("__x"))
    r = r.withColumn("column", F.when(two & ((F.col("x1") + F.col("x2")) / 2 >= F.col("__x") / 2), 1).otherwise(0)).withColumn("__two", two)
    order = Window.partitionBy("page").orderBy("column", "y1", F.when(~F.col("__two"), F.col("x1")), "id")
    return r.withColumn("reading_order", F.row_number().over(order)).drop("__n", "__w", "__x", "__two")


def layout_class(width: Column, height: Column, top: Column, page_width: Column, page_height: Column) -> Column:
    """Class of a box by its measures; null for boxes too small to count."""
    area = width * height >= F.greatest(F.lit(500.0), 0.0002 * page_width * page_height)
    heading = (height > 22) & (width > 0.25 * page_width) & (top < 0.3 * page_height)
    return F.when(area, F.when(heading, "heading").otherwise("text_block"))


def preprocess_operations(noise: Column, spread: Column, angle: Column, unevenness: Column) -> Column:
    """Which image operations measured features call for."""
    return F.array_compact(F.array(F.when(noise > 0.7, "denoise"), F.when(spread < 130, "contrast"), F.when((F.abs(angle) > 0.35) & (F.abs(angle) < 8), "deskew"), F.when(unevenness > 22, "adaptive_threshold")))


def page_kind(texts: DataFrame, least: int = 30) -> DataFrame:
    """(doc_id, kind): digital_pdf if any page has more than ``least`` characters of text."""
    own = F.length(F.regexp_replace("text", r"^\s+|\s+$", "")) > least
    return texts.groupBy("doc_id").agg(F.coalesce(F.bool_or(own), F.lit(False)).alias("d")).select("doc_id", F.when(F.col("d"), "digital_pdf").otherwise("scanned").alias("kind"))


def lexicon(docs: DataFrame, least: int = 1) -> DataFrame:
    """(word, n, zipf, is_domain): words of ``docs`` with frequencies per thousand million as logarithms, and the domain terms."""
    w = docs.select(F.explode(T.words(T.fold(F.col("text")))).alias("word")).groupBy("word").agg(F.count("*").alias("n"))
    total = w.agg(F.sum("n").alias("total"))
    terms = docs.sparkSession.createDataFrame([(t,) for t in K.domain_terms()], "word string").withColumn("is_domain", F.lit(True))
    counted = w.crossJoin(F.broadcast(total)).filter(F.col("n") >= least).select("word", "n", F.log10(F.col("n") / F.col("total") * 1e9).alias("zipf"))  # total is one row
    return counted.join(F.broadcast(terms), "word", "full_outer").select("word", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("zipf", F.lit(0.0)).alias("zipf"), F.coalesce("is_domain", F.lit(False)).alias("is_domain"))
