"""Sharding: a Feistel permutation with cycle walking over global row numbers.

Rows get gapless numbers in an order that only their content decides: a hash bucket of doc_id and text,
then doc_id, digest of the text. The number of buckets grows with the number of rows, so their row counts (one
small table) give each bucket's first number, and numbering needs no global sort. A Feistel network on
Z_a x Z_b permutes the numbers; the few results past the end walk on until they fall inside. The permuted number
gives shard and slot, so anyone can compute where a row
number goes without the table. DataFrame expressions only; one shuffle of short rows.

How far a row may walk: a * b exceeds the rows by less than a = ceil(sqrt(rows)), and a walk visits no outside place twice.
Up to 4,096 rows that makes at most 63 steps outside. Beyond, each step leads outside with a probability under 1/64,
64 of them with one of 10**-115; if it ever happened, the query fails with an error that names another seed as remedy.

The law is ``rows``: counts of the shards differ by one at most. Rows with equal texts form no unit under this law: each row
has a place of its own, and copies may fall into different shards.

Defined results: null text has no bytes and CRC 0; null doc_ids are spread by their text; rows
alike in doc_id and text are interchangeable (and numbered in one task, as short rows); an empty table gives an empty result; further columns are kept by
``shard_rows`` unless they are called shard or slot, which are replaced.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import common as C

#: Rows that a bucket holds on average, buckets at least; rounds of the network, steps of a walk.
BUCKET_ROWS, LEAST_BUCKETS, ROUNDS, SEED, WALK = 1 << 17, 64, 6, 20240607, 64


def permute(df: DataFrame, number: str, total: str, out: str, seed: int = SEED) -> DataFrame:
    """Permute 0 .. total-1. State is a struct (l, r), one round at a time, so no expression is repeated."""
    df = df.withColumn("__a", F.greatest(F.ceil(F.sqrt(F.col(total).cast("double"))).cast("long"), F.lit(1).cast("long"))).withColumn("__b", F.expr(f"greatest(({total} + __a - 1) div __a, 1L)"))
    rounds = "named_struct('l', x % __a, 'r', x div __a)"
    for i in range(ROUNDS):
        if i % 2 == 0:
            step = f"named_struct('l', pmod(s.l + pmod(xxhash64(s.r, {seed}L, {i}), __a), __a), 'r', s.r)"
        else:
            step = f"named_struct('l', s.l, 'r', pmod(s.r + pmod(xxhash64(s.l, {seed}L, {i}), __b), __b))"
        rounds = f"element_at(transform(array({rounds}), s -> {step}), 1)"
    once = f"element_at(transform(array({rounds}), s -> s.l + __a * s.r), 1)"
    walk = f"aggregate(sequence(1, {WALK}), y, (x, i) -> case when x < {total} then x else {once} end)"
    lost = f"raise_error('a row left the table {WALK} times; choose another seed than {seed}')"
    home = f"element_at(transform(array({walk}), z -> case when z < {total} then z else {lost} end), 1)"
    first = f"element_at(transform(array({number}), x -> {once}), 1)"
    return df.withColumn(out, F.expr(f"element_at(transform(array({first}), y -> case when y < {total} then y else {home} end), 1)")).drop("__a", "__b")


def number_rows(df: DataFrame, key: str = "doc_id", tie: str = "__tie") -> DataFrame:
    """``df`` with __number (0 .. n-1) and __total."""
    buckets = max(LEAST_BUCKETS, df.count() // BUCKET_ROWS)
    df = df.withColumn("__bucket", F.pmod(F.xxhash64(F.col(key).cast("long"), F.col(tie)), F.lit(buckets)).cast("int"))
    counts = df.groupBy("__bucket").agg(F.count("*").alias("__n"))  # one row for BUCKET_ROWS rows
    running = Window.orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("__bucket", F.coalesce(F.sum("__n").over(running), F.lit(0)).alias("__first"), F.sum("__n").over(Window.partitionBy(F.lit(1))).alias("__total"))
    within = F.row_number().over(Window.partitionBy("__bucket").orderBy(F.col(key).asc_nulls_last(), tie))
    return df.withColumn("__rank", within).join(F.broadcast(offsets), "__bucket").withColumn("__number", F.col("__first") + F.col("__rank") - 1).drop("__bucket", "__rank", "__first")


def shard_rows(docs: DataFrame, shards: int = 8, seed: int = SEED, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with shard (0 .. shards-1) and slot (gapless from 0 in each shard)."""
    df = docs.drop("shard", "slot").withColumn("__tie", F.xxhash64(F.col(text)))
    df = permute(number_rows(df, key), "__number", "__total", "__place", seed)
    return df.withColumn("shard", F.pmod("__place", F.lit(shards)).cast("int")).withColumn("slot", F.expr(f"__place div {shards}")).drop("__tie", "__number", "__total", "__place")


def op10_sharding(spark, sf_dir: str) -> DataFrame:
    docs = C.table(spark, sf_dir, "documents").select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text"))
    slim = docs.select("doc_id", (F.octet_length("text") + 1).cast("long").alias("size"), F.crc32(F.col("text").cast("binary")).alias("text_crc32"), F.xxhash64("text").alias("digest"))
    out = shard_rows(slim, 8, text="digest")
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
