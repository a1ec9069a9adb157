"""Mixing sources to target weights by Pareto order sampling.

Sources get target sizes by water-filling: shares by weight of a total, none above ``limit`` times what
the source has, the excess shared again. A source whose target is r times its size takes every document
floor(r) times for certain; the rest comes from a fixed-size sample with unequal probabilities: a
document's inclusion probability grows with the square root of its size, up to 1, such that the
expected size is what is missing. Documents are ranked by random odds divided by inclusion odds and
taken from the front until the missing size is reached; a closing document fills the gap best. The random number is
a hash of doc_id and seed, so reruns agree.

Ranking needs no sort of a whole source: ranks fall into about sqrt(n) intervals, whose sums show
the interval in which the target is crossed; only that interval is ordered. A source that holds a
third of all rows is thus never in one task.

Defined results: null text has size 0; documents of size 0 are certain copies only; null is a source, the
last; rows with equal doc_id get equal random numbers and are told apart by their text; an empty table gives an
empty result; further columns are ignored by ``mix_sources`` and kept by ``mixed_documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import common as C

_SPACE = r"[\x20\x09-\x0D]+"
#: Sources (rows of a name and few numbers) that may be broadcast, and parts that a hot source is dealt into beyond that.
BROADCAST_SOURCES, SALTS = 10_000, 16


def text_size(text: str = "text"):
    """Number of words."""
    trimmed = F.btrim(F.col(text), F.lit(" \t\n\x0b\f\r"))
    return F.when(trimmed.isNull() | (trimmed == ""), F.lit(0)).otherwise(F.size(F.split(trimmed, _SPACE))).cast("long")


def targets(sizes: DataFrame, weights: tuple[float, ...], share: float, limit: float) -> DataFrame:
    """Per source: target. ``sizes`` (source, source_size) has a row a source; weights repeat along the sources in code point order, null last."""
    order = Window.orderBy(F.col("source").asc_nulls_last())
    w = sizes.withColumn("weight", F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1).cast("int")))
    w = w.withColumn("cap", F.lit(float(limit)) * F.col("source_size"))
    fill = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    every = Window.partitionBy(F.lit(1))
    w = w.withColumn("before", F.coalesce(F.sum("cap").over(fill.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
    w = w.withColumn("left", F.sum("weight").over(fill.rowsBetween(0, Window.unboundedFollowing)))
    w = w.withColumn("total", F.lit(float(share)) * F.sum("source_size").over(every))
    # the level if this source and all after it are not capped; the first source at which it holds sets it
    w = w.withColumn("level", (F.col("total") - F.col("before")) / F.col("left"))
    w = w.withColumn("level", F.min(F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.struct((F.col("cap") / F.col("weight")).alias("o"), F.col("level").alias("v")))).over(every)["v"])
    return w.select("source", F.when(F.col("level").isNull(), F.col("cap")).otherwise(F.least("cap", F.col("level") * F.col("weight"))).alias("target"))


def _same(a, b):
    return F.col(a).eqNullSafe(F.col(b))


def mix_sources(docs: DataFrame, weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, limit: float = 2.0, seed: int = 11) -> DataFrame:
    """Per row of ``docs`` (doc_id, source, text): doc_id, size, source_size, target, copies, taken."""
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), text_size().alias("size"), F.xxhash64("text").alias("tie"))
    base = C.stored(base.withColumn("source", F.col("source")), "mix")
    sizes = base.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("source_rows"))
    plan = C.stored(sizes.join(targets(sizes.select("source", "source_size"), weights, share, limit).withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s"))).drop("s"), "targets")
    plan = plan.withColumn("certain", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long"))
    plan = plan.withColumn("missing", F.col("target") - F.col("certain") * F.col("source_size"))

    # inclusion probability min(1, rate * sqrt(size)), with the expected size that is missing
    kinds = base.filter("size > 0").groupBy("source", "size").agg(F.count("*").alias("n")).join(_named(plan.select("source", "missing")), _same("source", "s")).drop("s")
    down = Window.partitionBy("source").orderBy(F.desc("size"))
    kinds = kinds.withColumn("sure", F.coalesce(F.sum(F.col("n") * F.col("size")).over(down.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    kinds = kinds.withColumn("mass", F.sum(F.col("n") * F.pow("size", F.lit(1.5))).over(down.rowsBetween(0, Window.unboundedFollowing)))
    kinds = kinds.withColumn("rate", (F.col("missing") - F.col("sure")) / F.col("mass"))
    rate = kinds.filter(F.col("rate") * F.sqrt("size") <= 1).groupBy("source").agg(F.max(F.struct("size", "rate"))["rate"].alias("rate"))
    plan = C.stored(plan.join(_named(rate), _same("source", "s"), "left").drop("s").withColumn("rate", F.coalesce("rate", F.lit(0.0))), "rates")

    # one row per source, so small that every task may hold it; checked, with a shuffled join beyond
    few = plan.limit(BROADCAST_SOURCES + 1).count() <= BROADCAST_SOURCES
    u = (F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.col("doc_id"), F.when(F.col("doc_id").isNull(), F.col("tie"))), 11).cast("double") + 0.5) / float(1 << 53)
    p = F.least(F.lit(1.0), F.col("rate") * F.sqrt("size"))
    odds = F.when((F.col("size") > 0) & (p > 0), (u / (1 - u)) * ((1 - p) / p))
    rows = _beside(base, plan, few).withColumn("rank", odds)
    parts = F.ceil(F.sqrt("source_rows"))
    rows = rows.withColumn("part", F.floor(F.col("rank") / (1 + F.col("rank")) * parts))
    sums = rows.filter("part is not null").groupBy("source", "part").agg(F.sum("size").alias("part_size"), F.first("missing").alias("missing"))
    along = Window.partitionBy("source").orderBy("part")
    sums = sums.withColumn("until", F.sum("part_size").over(along))
    edge = sums.filter(F.col("until") > F.col("missing")).groupBy("source").agg(F.min(F.struct("part", (F.col("until") - F.col("part_size")).alias("before"))).alias("e"))
    edge = C.stored(edge.select("source", F.col("e.part").alias("edge"), F.col("e.before").alias("before")), "edges")
    rows = _beside(rows, edge, few)
    inside = Window.partitionBy("source").orderBy("rank", "doc_id", "tie")
    near = rows.filter("part = edge").withColumn("until", F.col("before") + F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, 0)))
    # the last document that still fits: what follows it isn't drawn
    last = near.filter(F.col("until") <= F.col("missing")).groupBy("source").agg(F.max(F.struct("rank", "doc_id", "tie")).alias("last"), F.max("until").alias("reached"))
    stop = edge.join(_named(last), _same("source", "s"), "left").drop("s").select("source", "last", F.coalesce("reached", "before").alias("reached"))
    stop = C.stored(stop, "stops")
    rows = _beside(rows, stop, few)
    drawn = F.coalesce((F.col("edge").isNull() & F.col("part").isNotNull()) | (F.col("part") < F.col("edge")) | ((F.col("part") == F.col("edge")) & (F.struct("rank", "doc_id", "tie") <= F.col("last"))), F.lit(False))
    rows = rows.withColumn("drawn", drawn)
    gap = F.col("missing") - F.col("reached")
    better = rows.filter(~F.col("drawn") & (F.col("size") > 0) & (F.abs(F.col("size") - gap) < gap))
    closing = better.groupBy("source").agg(F.min(F.struct(F.abs(F.col("size") - gap).alias("off"), "rank", "doc_id", "tie")).alias("c")).select("source", F.col("c.doc_id").alias("c_doc"), F.col("c.tie").alias("c_tie"), F.lit(True).alias("closes"))
    rows = _beside(rows, closing, few)
    closes = F.coalesce(F.col("closes") & F.col("c_doc").eqNullSafe(F.col("doc_id")) & F.col("c_tie").eqNullSafe(F.col("tie")), F.lit(False))
    copies = F.col("certain") + F.when(F.col("drawn") | closes, 1).otherwise(0)
    return rows.select("doc_id", "size", "source_size", "target", copies.cast("long").alias("copies"), (copies * F.col("size")).cast("long").alias("taken"), "source", "tie")


def _beside(rows: DataFrame, side: DataFrame, few: bool) -> DataFrame:
    """``rows`` with the columns of ``side``, a row a source; a source may hold a third of all rows."""
    if few:
        return rows.join(F.broadcast(_named(side)), _same("source", "s"), "left").drop("s")
    dealt = _named(side).withColumn("part_of", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    rows = rows.withColumn("salt", F.pmod(F.xxhash64("doc_id", "tie"), F.lit(SALTS)).cast("int"))
    return rows.join(dealt, _same("source", "s") & (F.col("salt") == F.col("part_of")), "left").drop("s", "salt", "part_of")


def _named(df: DataFrame) -> DataFrame:
    return df.withColumnRenamed("source", "s")


def mixed_documents(docs: DataFrame, **how) -> DataFrame:
    """``docs`` as mixed: each row as often as it is taken, with its columns as they are."""
    taken = mix_sources(docs, **how).filter("copies > 0").select("doc_id", "source", "tie", "copies").distinct()
    own = {c: f"__in_{i}" for i, c in enumerate(docs.columns)}
    rows = docs.withColumnsRenamed(own)
    same = F.col(own["doc_id"]).eqNullSafe(F.col("doc_id")) & F.col(own["source"]).eqNullSafe(F.col("source")) & F.xxhash64(own["text"]).eqNullSafe(F.col("tie"))
    rows = rows.join(taken, same).withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
    return rows.select([F.col(x).alias(c) for c, x in own.items()])


def op6_mixing(spark, sf_dir: str) -> DataFrame:
    return mix_sources(C.table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")
