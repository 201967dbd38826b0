"""Whole batches in one job: files are decided, expected codes fill in what awaits review, duplicates are demoted, and outputs, comparison and reports follow.

Batches are told apart by `batch_id`; they don't wait for one another, and a file that fails is its own result.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import stored
from . import decide, reconcile


@dataclass
class Outcome:
    """Tables of a run. results: one row per file, with `output_relative_path`; plan: where files go; progress and completion: a row per batch."""

    results: DataFrame
    plan: DataFrame
    progress: DataFrame
    completion: DataFrame
    comparison: DataFrame | None = None
    counts: DataFrame | None = None
    missing: DataFrame | None = None


def run(files: DataFrame, obs: DataFrame, mode: str = "balanced", entries: DataFrame | None = None, prior: DataFrame | None = None) -> Outcome:
    """files: file_id, batch_id, file_ord, relative_name, original_name. entries: an expected list (entry_pos, entry). prior: results of an earlier run, whose successes stand.

    The decisions are made, and stored, before this returns; the tables made from them are lazy.
    """
    todo = files if prior is None else files.join(prior.filter(F.col("status") == "正确识别").select("batch_id", "relative_name"), ["batch_id", "relative_name"], "left_anti")
    named = todo.withColumnRenamed("original_name", "name")
    seen = obs if prior is None else obs.join(todo.select("file_id"), "file_id", "left_semi")
    made = decide.results(named, seen, mode).drop("readings")
    rows = made.join(todo.select("file_id", "batch_id", "file_ord", "relative_name", "original_name"), "file_id").drop("file_id").withColumn("elapsed_ms", F.lit(0)).withColumn("output_relative_path", F.lit(None).cast("string"))
    if prior is not None:
        kept = prior.filter(F.col("status") == "正确识别")
        rows = rows.unionByName(kept.select(*(F.col(c) if c in kept.columns else F.lit(None).alias(c) for c in rows.columns)))
    if entries is not None:
        inspected = reconcile.inspect_expected(entries)
        rows = reconcile.apply_expected_review(stored(rows), inspected.filter("kind = 'valid'").select("pos", F.col("value").alias("code")))
    return report(stored(reconcile.mark_duplicates(stored(rows)).drop("reclassified")), entries)


def report(results: DataFrame, entries: DataFrame | None = None) -> Outcome:
    """What follows from results."""
    plan = stored(reconcile.output_plan(results))
    placed = results.drop("output_relative_path").join(plan.select("batch_id", "relative_name", F.col("target").alias("output_relative_path")), ["batch_id", "relative_name"])
    out = Outcome(stored(placed.select(results.columns)), plan, reconcile.progress(results), reconcile.completion(results))
    if entries is not None:
        inspected = reconcile.inspect_expected(entries)
        expected = inspected.filter("kind = 'valid'").select("pos", F.col("value").alias("code"))
        bad = inspected.filter("kind = 'invalid'")
        out.comparison, out.counts, out.missing = reconcile.comparison_sheet(expected, results, bad), reconcile.comparison_counts(expected, results, bad), reconcile.missing_list(expected, results)
    return out
