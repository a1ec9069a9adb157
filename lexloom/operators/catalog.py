"""Documents, runs, stages and evaluations: look-ups, totals, sweeps, reports, checks."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def run_catalog(runs: DataFrame, documents: DataFrame) -> DataFrame:
    """Runs with their documents' names, newest first."""
    d = documents.select(F.col("id").alias("document_id"), "name")
    return runs.join(d, "document_id").orderBy(F.desc("created_at"), "id")


def latest_runs(runs: DataFrame) -> DataFrame:
    """Per run: chosen (newest valid one of its document) or why not. Invalid runs are out before duplicates are told."""
    valid = F.coalesce(F.col("status") == "COMPLETED", F.lit(False)) & (F.length(F.trim(F.coalesce("text", F.lit("")))) > 0)
    order = Window.partitionBy("document_id", valid).orderBy(F.desc("updated_at"), "id")
    r = runs.withColumn("__rank", F.row_number().over(order))
    why = F.when(~F.col("status").eqNullSafe("COMPLETED"), "not completed").when(~valid, "no text").when(F.col("__rank") > 1, "duplicate: an older run of the document")
    return r.withColumns({"chosen": why.isNull(), "reason": why}).drop("__rank")


def by_ids(rows: DataFrame, ids: list, key: str = "id") -> DataFrame:
    """Point look-ups: the rows of given ids. The ids reach the scan as a filter."""
    return rows.filter(F.col(key).isin(list(ids)))


def upsert(rows: DataFrame, changes: DataFrame, key: str = "id") -> DataFrame:
    """``rows`` with changed ones replaced and new ones added. Several changes of one key are an error of the caller's: all are kept."""
    return rows.join(changes.select(key).distinct(), key, "left_anti").unionByName(changes.select(rows.columns))


def displayed(tokens: DataFrame) -> DataFrame:
    """``tokens`` with what a viewer shows: the recogniser's confidence, else the calibrated one, and KEEP where nothing was decided."""
    return tokens.withColumns({"shown_confidence": F.coalesce("ocr_confidence", "confidence"), "shown_decision": F.coalesce("decision", F.lit("KEEP"))})


def missing_runs(documents: DataFrame, runs: DataFrame) -> DataFrame:
    return documents.join(runs.select(F.col("document_id").alias("id")), "id", "left_anti")


def run_totals(runs: DataFrame) -> DataFrame:
    """Completed runs and sums of their counts, missing ones as 0."""
    names = [c for c in runs.columns if c.startswith("n_")]
    return runs.filter("status = 'COMPLETED'").agg(F.count("*").alias("runs"), *[F.coalesce(F.sum(F.coalesce(c, F.lit(0))), F.lit(0)).alias(c) for c in names])


def orphan_sweep(runs: DataFrame) -> DataFrame:
    """Runs left running or queued become FAILED, and their running stages (array of status, error) get an error."""
    lost = F.col("status").isin("RUNNING", "QUEUED")
    out = runs
    if "stages" in runs.columns:
        stages = F.transform("stages", lambda s: F.when(s["status"] == "RUNNING", s.withField("status", F.lit("FAILED")).withField("error", F.lit("the process ended during this stage"))).otherwise(s))
        out = out.withColumn("stages", F.when(lost, stages).otherwise(F.col("stages")))
    return out.withColumn("status", F.when(lost, "FAILED").otherwise(F.col("status")))


def resolve_truth(runs: DataFrame, supplied: DataFrame, files: DataFrame) -> DataFrame:
    """``runs`` (run_id, document_id, name) with the first true text that isn't blank: supplied (key, text) under run id, document id, name, stem; then files (stem, text) under document id, stem."""
    r = runs.withColumn("__stem", F.regexp_replace("name", r"\.[^.]*$", ""))
    full = lambda c: F.when(F.length(F.trim(c)) > 0, F.col(c))
    steps = [("supplied_run", supplied, "run_id"), ("supplied_document", supplied, "document_id"), ("supplied_name", supplied, "name"), ("supplied_stem", supplied, "__stem"), ("file_document", files, "document_id"), ("file_stem", files, "__stem")]
    for name, table, on in steps:
        k, v = table.columns
        # of several texts under one key the first that isn't blank, in code point order
        one = table.groupBy(F.col(k).cast("string").alias("__k")).agg(F.coalesce(F.min(full(v)), F.min(v)).alias(name))
        r = r.join(one, F.col(on).cast("string") == F.col("__k"), "left").drop("__k")
    text = F.coalesce(*[full(s) for s, _, _ in steps])
    source = F.coalesce(*[F.when(full(s).isNotNull(), s) for s, _, _ in steps])
    return r.select("run_id", "document_id", text.alias("truth"), F.coalesce(source, F.lit("missing")).alias("truth_source"))


def artifact_status(runs: DataFrame) -> DataFrame:
    """``runs`` (id, metadata_status, reference, ocr_text, corrected_text) with the metric status, the first that applies."""
    blank = lambda c: F.length(F.trim(F.coalesce(c, F.lit("")))) == 0
    s = F.when(F.col("metadata_status").isNull(), "INVALID_METADATA").when(F.col("metadata_status") == "FAILED", "FAILED_RUN").when(F.col("reference").isNull(), "MISSING_REFERENCE").when(blank("reference"), "EMPTY_REFERENCE").when(F.col("ocr_text").isNull() | F.col("corrected_text").isNull(), "NOT_YET_MEASURED").otherwise("MEASURED")
    return runs.withColumn("metric_status", s)


def saved_run_summary(measured: DataFrame) -> DataFrame:
    """One row over ``measured`` (metric_status, outcome, baseline_clean, clean_preserved, cer_before, cer_after)."""
    m = F.col("metric_status") == "MEASURED"
    return measured.agg(F.count("*").alias("n"), F.count_if(m).alias("measured"), *[F.count_if(m & (F.col("outcome") == o)).alias(o.lower()) for o in ("IMPROVED", "UNCHANGED", "WORSENED")], F.try_divide(F.count_if(m & F.col("clean_preserved")), F.count_if(m & F.col("baseline_clean"))).alias("clean_preservation_rate"), F.avg(F.when(m, F.col("cer_before"))).alias("macro_cer_before"), F.avg(F.when(m, F.col("cer_after"))).alias("macro_cer_after"))


def micro_accuracy(rows: DataFrame) -> DataFrame:
    """Corrected over injected errors (1 if none) and one minus edits over reference units."""
    return rows.agg(F.coalesce(F.try_divide(F.sum("corrected"), F.sum("injected")), F.lit(1.0)).alias("correction_accuracy"), (1 - F.try_divide(F.sum("edits"), F.sum("reference_units"))).alias("token_accuracy"))


def constructed_summary(rows: DataFrame) -> DataFrame:
    """One row over ``rows`` (injected, corrected, cer_before, cer_after): sums, accuracy (1 if nothing was injected), outcomes, macro means."""
    b, a = F.col("cer_before"), F.col("cer_after")
    total = rows.agg(F.sum("injected").alias("injected"), F.sum("corrected").alias("corrected"), (F.sum("injected") - F.sum("corrected")).alias("unresolved"), F.coalesce(F.try_divide(F.sum("corrected"), F.sum("injected")), F.lit(1.0)).alias("correction_accuracy"), F.count_if(a < b).alias("improved"), F.count_if(a == b).alias("unchanged"), F.count_if(a > b).alias("worsened"), F.avg(b).alias("macro_cer_before"), F.avg(a).alias("macro_cer_after"))
    return total


def report_rollup(rows: DataFrame, group: str, means: list[str], sums: list[str]) -> DataFrame:
    """Means and sums per group and over all (group null)."""
    return rows.rollup(group).agg(F.count("*").alias("n"), *[F.avg(c).alias(f"mean_{c}") for c in means], *[F.sum(c).alias(f"sum_{c}") for c in sums])


def status_counts(rows: DataFrame, column: str = "status") -> DataFrame:
    return rows.groupBy(column).agg(F.count("*").alias("n"))


def stage_progress(stages: DataFrame) -> DataFrame:
    """Per run: stages by status, the one at work, total time."""
    return stages.groupBy("run_id").agg(F.count_if(F.col("status").isin("COMPLETED", "WARNING")).alias("done"), F.count_if(F.col("status") == "FAILED").alias("failed"), F.count_if(F.col("status") == "WAITING").alias("waiting"), F.min(F.when(F.col("status") == "RUNNING", F.col("number"))).alias("active"), F.sum("runtime_ms").alias("runtime_ms"))


def distinct_operations(pages: DataFrame) -> DataFrame:
    return pages.select("doc_id", F.explode("operations").alias("o")).groupBy("doc_id").agg(F.array_sort(F.collect_set("o")).alias("operations"))


def report_mode(documents: DataFrame) -> DataFrame:
    n, t = F.count("*"), F.count_if("has_truth")
    return documents.agg(F.when(t == 0, "WITHOUT_GROUND_TRUTH").when(t == n, "WITH_GROUND_TRUTH").otherwise("MIXED").alias("mode"))


def dataset_checks(manifest: DataFrame, rows: int, expected_ids: DataFrame) -> DataFrame:
    """(check, ok) over ``manifest`` (document_id, input_format, challenging, n_events, intended, rendered, truth)."""
    m = manifest
    per = m.agg(
        (F.count("*") == rows).alias("row_count"),
        (F.count("*") == F.count_distinct("document_id")).alias("unique_ids"),
        F.coalesce(F.bool_and(F.when(F.col("challenging"), F.col("n_events") > 0).otherwise(F.col("n_events") == 0)), F.lit(True)).alias("events_where_challenging"),
        F.coalesce(F.bool_and(F.contains("truth", F.coalesce("intended", F.lit("")))), F.lit(True)).alias("intended_in_truth"),
        F.coalesce(F.bool_and(F.col("rendered").isNull() | ~F.contains("truth", "rendered")), F.lit(True)).alias("rendered_not_in_truth"),
    )
    checks = per.select(F.expr("stack(5, 'row_count', row_count, 'unique_ids', unique_ids, 'events_where_challenging', events_where_challenging, 'intended_in_truth', intended_in_truth, 'rendered_not_in_truth', rendered_not_in_truth) as (check, ok)"))
    ids = m.select("document_id")
    odd = ids.exceptAll(expected_ids).union(expected_ids.exceptAll(ids)).agg((F.count("*") == 0).alias("ok")).select(F.lit("id_set").alias("check"), "ok")
    return checks.union(odd)


def upsert_status(manifest: DataFrame, changes: DataFrame) -> DataFrame:
    """``manifest`` with the status that ``changes`` (document_id, execution_status) gives, others as they were."""
    c = changes.select("document_id", F.col("execution_status").alias("__new"))
    return manifest.join(c, "document_id", "left").withColumn("execution_status", F.coalesce("__new", "execution_status")).drop("__new")


def unfinished(manifest: DataFrame, artifacts: DataFrame, required: list[str]) -> DataFrame:
    """Manifest rows that lack a required file (artifacts: document_id, file) or the status ACTUALLY_RUN."""
    done = artifacts.filter(F.col("file").isin(required)).groupBy("document_id").agg(F.count_distinct("file").alias("n")).filter(F.col("n") == len(set(required)))
    ok = manifest.filter("execution_status = 'ACTUALLY_RUN'").join(done, "document_id", "left_semi").select("document_id")
    return manifest.join(ok, "document_id", "left_anti")


def signature(row: Column) -> Column:
    """SHA-256 of a struct's JSON: equal inputs, equal signature."""
    return F.sha2(F.to_json(row, {"ignoreNullFields": "false"}), 256)


def config_signature(config: dict) -> str:
    return hashlib.sha256(json.dumps(config, sort_keys=True, separators=(",", ":")).encode()).hexdigest()


def inject_corruption(lines: DataFrame) -> DataFrame:
    """``lines`` (id, text, correct, corrupted) with the first occurrence replaced; null where there is none."""
    at = F.expr("locate(correct, text)")
    return lines.withColumn("text", F.when(at > 0, F.expr("overlay(text placing corrupted from cast(locate(correct, text) as int) for length(correct))")))


def capabilities(spark, names: dict[str, bool]) -> DataFrame:
    rows = [(n, "READY" if ok else "UNAVAILABLE", "" if ok else "not installed; the rule-based stand-in is used") for n, ok in names.items()]
    return spark.createDataFrame(rows, "component string, status string, detail string")
