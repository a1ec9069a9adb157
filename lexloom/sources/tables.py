"""Sources and sinks: driver tables, uploads, manifests, run artifacts, reports."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import constants as K


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def held(rows: DataFrame, most: int = 200_000) -> DataFrame:
    """A table of few rows, computed once and broadcast to where it is joined; a longer one as it is."""
    few = rows.limit(most + 1).collect()
    return F.broadcast(rows.sparkSession.createDataFrame(few, rows.schema)) if len(few) <= most else rows


def spread(rows: DataFrame, key: str) -> DataFrame:
    """A table in fewer splits than there are cores is dealt out by ``key``; larger ones stay as they are."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(cores, key) if rows.rdd.getNumPartitions() < cores else rows


def scan_uploads(spark: SparkSession, folder: str) -> DataFrame:
    """Files with media type, size, digest and an HTTP-like status; empty files give no row. Contents are read only of files whose name and size let them pass."""
    f = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    media, early = upload_verdict(F.col("path"), F.col("length"), F.lit(None).cast("string"))
    passes = media.isNotNull() & (F.col("length") <= K.MAX_UPLOAD)
    held = f.filter(F.col("length") <= K.MAX_UPLOAD).filter(passes)
    status = upload_verdict(F.col("path"), F.col("length"), F.hex(F.substring("content", 1, 4)))[1]
    held = held.select("path", media.alias("media_type"), F.col("length").alias("size"), status.alias("status"), F.sha2("content", 256).alias("sha256"))
    refused = f.filter(~passes).select("path", media.alias("media_type"), F.col("length").alias("size"), early.alias("status"), F.lit(None).cast("string").alias("sha256"))
    return held.union(refused)


def upload_verdict(path: Column, size: Column, start: Column) -> tuple[Column, Column]:
    """Media type by suffix (null: unknown) and HTTP-like status, from path, bytes and the first four bytes in hex."""
    suffix = F.lower(F.regexp_extract(path, r"(\.[^./]+)$", 1))
    media = F.create_map(*[F.lit(x) for kv in K.MEDIA_TYPES.items() for x in kv])[suffix]
    decodable = F.when(suffix == ".pdf", start == "25504446").when(suffix == ".png", start == "89504E47").when(suffix.isin(".jpg", ".jpeg"), start.startswith("FFD8")).otherwise(start.isin("49492A00", "4D4D002A"))
    return media, F.when(media.isNull(), 415).when(size > K.MAX_UPLOAD, 413).when(~decodable, 422).otherwise(201)


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """A manifest as a JSON array, or its CSV twin with arrays as JSON texts."""
    if path.endswith(".json"):
        return spark.read.option("multiLine", True).json(path)
    m = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    kinds = {"injected_error_types": "array<string>", "injected_error_details": "array<struct<intended:string,rendered:string,type:string>>", "image_quality_variations": "array<string>"}
    return m.withColumns({c: F.from_json(c, t) for c, t in kinds.items() if c in m.columns})


def read_run_artifacts(spark: SparkSession, folder: str) -> DataFrame:
    """(document_id, file, content) of all run folders; what is absent is simply no row."""
    f = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    parts = F.split("path", "/")
    return f.select(F.element_at(parts, -2).alias("document_id"), F.element_at(parts, -1).alias("file"), F.col("content").cast("string").alias("content"), F.sha2("content", 256).alias("sha256"))


def read_jdbc(spark: SparkSession, url: str, name: str, **options) -> DataFrame:
    return spark.read.format("jdbc").options(url=url, dbtable=name, **options).load()


def load_config(text: str) -> dict:
    config = json.loads(text)
    K.check_config(config["quality_weights"], config["quality_thresholds"]["high"], config["quality_thresholds"]["medium"])
    return config


def file_digest(content):
    return F.coalesce(F.sha2(content, 256), F.lit("missing"))


def write_report(rows: DataFrame, path: str) -> None:
    """A report as JSON lines and as one CSV table; nested columns are JSON texts in the CSV."""
    rows.write.mode("overwrite").json(f"{path}/json")
    flat = [F.to_json(c).alias(c) if t.startswith(("struct", "array", "map")) else F.col(c) for c, t in rows.dtypes]
    rows.select(*flat).write.mode("overwrite").option("header", True).csv(f"{path}/csv")


def write_provenance(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("doc_id").json(path)
