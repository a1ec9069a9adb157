"""Benchmark decontamination by template canonicalisation.

A text is cut once into tokens, numbers and words. Numbers, units (a word of the list right after a number) and names
turn into typed placeholders, one token for one, so that a template and the values behind it are parallel by
construction. There are two readings: in one every capitalised word is a name, in the other none is, so
that neither a new name nor other case hides a copy. Windows of ``window`` consecutive template tokens are hashed and joined with the
benchmark's; a window of an item, in either reading, may meet either reading of a text. A window with fewer than ``LITERAL`` literal
tokens is no evidence by its shape: it is known by its shape with names as words, and if that has too few as well, by its values.

A document is compared with an item if, in one reading, it has windows for at least ``coverage`` of the item's. Each
offset of the item against the text is then a candidate copy: every window of the item takes its place nearest to that offset
(at most ``GAP`` tokens off, so that words put in or left out elsewhere shift nothing), and the values of its
placeholders stand side by side with the item's. If the windows reach ``coverage``, the copy is

* ``exact`` if all values are equal,
* ``reparameterised`` if they follow a function (the same value is always replaced by the same one),
* nothing if they contradict each other.

Whatever the offsets, windows with equal values that reach ``coverage`` by themselves make an ``exact`` leak. The best result
of a pair is reported: exact before reparameterised, then the larger coverage.

Items shorter than a window are matched verbatim (in any case and punctuation); under ``LEAST`` tokens they match nothing.

DataFrame expressions only; the corpus is scanned once for hashes, and once more where something was found. The benchmark's
windows are broadcast behind a count of rows of fixed width, and joined over salts beyond it.

Defined results: null or empty texts match nothing; rows with a null doc_id or item_id are never reported; rows that share a doc_id
(or item_id) are judged each by its own text, and a pair is reported once, by its best; an empty table gives an
empty result; further columns are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import common as C

#: Tokens in a window, tokens an item needs, literal tokens of a window that its template may stand for, tokens a window may be off.
WINDOW, LEAST, LITERAL, GAP = 5, 3, 2, 8
#: Rows (item, hash, weight; 40 bytes) that may be broadcast, and parts that hot windows are dealt into beyond that.
BROADCAST_WINDOWS, SALTS = 200_000, 8

# Units of measure.
UNITS = "km|cm|mm|m|kg|mg|g|lb|oz|ml|l|h|min|s|ms|hz|khz|mhz|ghz|kb|mb|gb|tb|w|kw|v|mph|kmh|mi|ft|in|yd|percent|dollars|euros|pounds|usd|eur|gbp|hours|minutes|seconds|days|weeks|months|years|meters|metres|miles|feet|inches|grams|liters|litres|degrees"

_TOKEN = r"\p{Nd}+(?:[.,:/]\p{Nd}+)*|[\p{L}\p{M}]+"
_NUMBER = r"(?<![^ ])\p{Nd}[^ ]*"
_UNIT = rf"(?<=⟨n⟩ )(?i:{UNITS})(?![^ ])"
_NAME = r"(?<![^ ])\p{Lu}\p{Ll}[\p{L}\p{M}]*"
#: Readings: names as placeholders, names as words.
NAMES, PLAIN = 1, 2
READINGS = {NAMES: "named", PLAIN: "plain"}


def tokens(df: DataFrame, text: str) -> DataFrame:
    """``df`` with parallel arrays: the tokens in lower case (vals), and their templates with names as placeholders (named) and as words (plain)."""
    line = F.array_join(F.regexp_extract_all(F.coalesce(F.col(text), F.lit("")), F.lit(_TOKEN), F.lit(0)), " ")
    shaped = F.regexp_replace(F.regexp_replace("__line", _NUMBER, "⟨n⟩"), _UNIT, "⟨u⟩")
    arrays = {"vals": F.col("__line"), "named": F.regexp_replace("__shaped", _NAME, "⟨m⟩"), "plain": F.col("__shaped")}
    df = df.withColumn("__line", line).withColumn("__shaped", F.when(F.col("__line").rlike(r"\p{Nd}"), shaped).otherwise(F.col("__line")))
    cut = lambda c: F.when(c == "", F.array().cast("array<string>")).otherwise(F.split(F.lower(c), " "))
    return df.withColumns({k: cut(c) for k, c in arrays.items()}).drop("__line", "__shaped")


def _hash(array: str, size: int, place: str) -> Column:
    """The hash of the window of ``size`` tokens at ``place``; windows of values and of shapes are told apart, as are their sizes."""
    return F.xxhash64(F.lit(array == "vals"), F.lit(size), *[F.get(array, F.col(place) + j) for j in range(size)])


def _windows(docs: DataFrame, kinds: list[tuple[bool, int]], *carry: str) -> DataFrame:
    """Rows (carry, place, hash, size) of all windows of the needed kinds (by values, size), each hash once a place.

    Generators and not lambdas over arrays, so that windows are hashed in generated code. They are outer ones: from an inner one
    the optimizer derives a filter that computes the arrays a second time.
    """
    least = min(n for _, n in kinds)
    places = F.when(F.size("vals") >= least, F.sequence(F.lit(0), F.size("vals") - least))
    df = docs.select(*carry, "vals", *([] if all(v for v, _ in kinds) else ["named", "plain"]), F.explode_outer(places).alias("place")).filter("place is not null")
    hashes = []
    for by_values, n in kinds:
        fits = F.col("place") <= F.size("vals") - n
        for array in ["vals"] if by_values else ["plain", "named"]:
            hashes.append(F.when(fits, F.struct(_hash(array, n, "place").alias("hash"), F.lit(n).alias("size"))))
    df = df.select(*carry, "place", F.explode_outer(F.array_distinct(F.array(*hashes)) if len(hashes) > 1 else F.array(*hashes)).alias("w"))
    return df.select(*carry, "place", F.col("w.hash").alias("hash"), F.col("w.size").alias("size")).filter("hash is not null")


def item_windows(benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """(item_id, item, reading, size, total, at, hash, by_values, slots): the windows of each item, with the placeholders in them as (j, value)."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).filter("item_id is not null and text is not null")
    items = tokens(items.withColumn("item", F.xxhash64("text")).dropDuplicates(["item_id", "item"]), "text").filter(F.size("vals") >= LEAST)
    size = F.least(F.size("vals"), F.lit(window))
    items = items.select("item_id", "item", "vals", "named", "plain", size.alias("size"), (F.size("vals") - size + 1).alias("total"))
    out = None
    for reading in (NAMES, PLAIN):
        own = items if reading == PLAIN else items.filter(f"size = {window}")
        own = own.select("item_id", "item", "size", "total", F.lit(reading).alias("reading"), F.col(READINGS[reading]).alias("shape"), "plain", "vals", F.explode(F.sequence(F.lit(0), F.col("total") - 1)).alias("at"))
        out = own if out is None else out.unionByName(own)
    cut = lambda c: F.slice(c, F.col("at") + 1, F.col("size"))
    evidence = lambda c: F.size(F.filter(cut(c), lambda x: ~x.startswith("⟨"))) >= LITERAL
    hashed = F.lit(None).cast("long")
    for n in range(LEAST, window + 1):
        own = _hash("vals", n, "at")
        if n == window:
            own = F.when(evidence("shape"), _hash("shape", n, "at")).when(evidence("plain"), _hash("plain", n, "at")).otherwise(own)
        hashed = F.when(F.col("size") == n, own).otherwise(hashed)
    by_values = (F.col("size") < window) | ~(evidence("shape") | evidence("plain"))
    slots = F.filter(F.transform(cut("shape"), lambda x, j: F.struct(j.alias("j"), F.get("vals", F.col("at") + j).alias("value"), x.alias("kind"))), lambda s: s["kind"].startswith("⟨"))
    slots = F.transform(slots, lambda s: F.struct(s["j"].alias("j"), s["value"].alias("value")))
    return out.select("item_id", "item", "reading", "size", "total", "at", hashed.alias("hash"), by_values.alias("by_values"), slots.alias("slots"))


def leaks(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, coverage: float = 0.6) -> DataFrame:
    """(doc_id, item_id, coverage, n_windows, kind) for each document that holds a benchmark item; kind is exact or reparameterised."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).filter("doc_id is not null and text is not null")
    whole = C.stored(item_windows(benchmark, window), "items")
    # which kinds of windows the benchmark needs: shapes of the full size, values of few sizes
    kinds = sorted({(r["by_values"], r["size"]) for r in whole.select("by_values", "size").distinct().limit(2 * window).collect()})
    if not kinds:
        return docs.select("doc_id", F.lit(0).cast("long").alias("item_id"), F.lit(0.0).alias("coverage"), F.lit(0).cast("long").alias("n_windows"), F.lit("").alias("kind")).limit(0)
    known = whole.groupBy("item_id", "item", "reading", "hash").agg(F.count("*").alias("weight"), F.first("total").alias("total"))
    few = known.limit(BROADCAST_WINDOWS + 1).count() <= BROADCAST_WINDOWS
    spread = _windows(tokens(docs, "text").withColumn("row", F.xxhash64("text")), kinds, "doc_id", "row").select("doc_id", "row", "hash")
    if few:
        hits = spread.join(F.broadcast(known), "hash")
    else:
        known = known.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        hits = spread.withColumn("salt", F.pmod("row", F.lit(SALTS)).cast("int")).join(known, ["hash", "salt"])
    # rows alike in doc_id and text count once
    found = hits.groupBy("doc_id", "row", "item_id", "item", "reading", "hash").agg(F.first("weight").alias("weight"), F.first("total").alias("total"))
    found = found.groupBy("doc_id", "row", "item_id", "item", "reading").agg(F.sum("weight").alias("n"), F.first("total").alias("total")).filter(F.col("n") >= coverage * F.col("total"))
    found = C.stored(found.select("doc_id", "row", "item_id", "item", "reading"), "found")
    return _checked(found, docs, whole, kinds, coverage, few)


def _checked(found: DataFrame, docs: DataFrame, whole: DataFrame, kinds: list[tuple[bool, int]], coverage: float, few: bool) -> DataFrame:
    """The best copy of each found pair, by the values of its placeholders."""
    pair = ["doc_id", "row", "item_id", "item", "reading"]
    docs = docs.withColumn("row", F.xxhash64("text")).join(found.select("doc_id", "row").distinct(), ["doc_id", "row"], "left_semi")
    docs = tokens(docs, "text")
    places = _windows(docs, kinds, "doc_id", "row", "vals")
    places = places.select("doc_id", "row", "hash", "place", "vals")
    if few:
        hits = places.join(F.broadcast(whole), "hash").join(found, pair, "left_semi")
    else:
        hits = places.join(found.join(whole, ["item_id", "item", "reading"]), ["doc_id", "row", "hash"])
    hits = hits.withColumn("own", F.slice("vals", F.col("place") + 1, F.col("size"))).drop("vals")
    hits = hits.withColumns({"offset": F.col("place") - F.col("at"), "equal": F.expr("forall(slots, s -> s.value = get(own, s.j))")}).dropDuplicates([*pair, "at", "place"])
    hits = C.stored(hits.select(*pair, "total", "at", "place", "offset", "equal", "slots", "own"), "hits")
    C.release(found, whole)

    # offsets that have enough windows around them, each with its neighbours
    ways = C.stored(hits.groupBy(*pair, "offset").agg(F.count("*").alias("n"), F.first("total").alias("total")), "offsets")
    around = F.explode(F.sequence(F.col("offset") - GAP, F.col("offset") + GAP)).alias("anchor")
    anchors = ways.select(*pair, "n", "total", around).groupBy(*pair, "anchor").agg(F.sum("n").alias("n"), F.first("total").alias("total")).filter(F.col("n") >= coverage * F.col("total"))
    anchors = anchors.join(ways.select(*pair, F.col("offset").alias("anchor")), [*pair, "anchor"], "left_semi")
    # every such offset with its neighbours: the window nearest to it, and of equally near ones the earlier
    near = anchors.select(*pair, "anchor", F.explode(F.sequence(F.col("anchor") - GAP, F.col("anchor") + GAP)).alias("offset"))
    near = hits.join(near.hint("merge"), [*pair, "offset"])  # the planner doesn't see how many rows the neighbours are
    near = near.withColumn("off", F.abs(F.col("offset") - F.col("anchor")))
    copy = [*pair, "anchor"]
    first = Window.partitionBy(*copy, "at").orderBy("off", "offset")
    taken = near.withColumn("rank", F.row_number().over(first)).filter("rank = 1")
    # the value beside a placeholder is that of its nearest window
    spots = taken.select(*copy, "off", "offset", "at", "own", F.explode("slots").alias("s"))
    spots = spots.select(*copy, (F.col("at") + F.col("s.j")).alias("spot"), F.col("s.value").alias("a"), F.struct("off", "offset", "at", F.expr("get(own, s.j)").alias("b")).alias("by"))
    spots = spots.groupBy(*copy, "spot", "a").agg(F.min("by")["b"].alias("b"))
    values = spots.groupBy(*copy).agg(F.bool_and(F.col("a") == F.col("b")).alias("same"), (F.count_distinct("a", "b") == F.count_distinct("a")).alias("function"))
    copies = taken.groupBy(*copy).agg(F.count("*").alias("n_windows"), F.first("total").alias("total")).join(values, copy, "left")
    kind = F.when(F.coalesce("same", F.lit(True)), "exact").when(F.col("function"), "reparameterised")
    copies = copies.select("doc_id", "item_id", "n_windows", "total", kind.alias("kind"))
    verbatim = hits.filter("equal").groupBy(*pair).agg(F.count_distinct("at").alias("n_windows"), F.first("total").alias("total"))
    every = copies.union(verbatim.select("doc_id", "item_id", "n_windows", "total", F.lit("exact"))).filter("kind is not null")
    every = every.withColumn("coverage", F.col("n_windows") / F.col("total")).filter(F.col("coverage") >= coverage)
    best = F.min(F.struct("kind", (-F.col("coverage")).alias("less"), (-F.col("n_windows")).alias("fewer")))  # exact sorts before reparameterised
    every = every.groupBy("doc_id", "item_id").agg(best.alias("best"))
    return every.select("doc_id", "item_id", (-F.col("best.less")).alias("coverage"), (-F.col("best.fewer")).alias("n_windows"), F.col("best.kind").alias("kind"))


def drop_leaks(docs: DataFrame, benchmark: DataFrame, **how) -> DataFrame:
    """The rows of ``docs`` whose doc_id leaks no item; a null doc_id stays."""
    lost = leaks(docs, benchmark, **how).select(F.col("doc_id").alias("__lost")).distinct()
    return docs.join(lost, docs["doc_id"] == lost["__lost"], "left_anti")


def op1_decontamination(spark, sf_dir: str) -> DataFrame:
    return leaks(C.table(spark, sf_dir, "documents"), C.table(spark, sf_dir, "benchmark"))
