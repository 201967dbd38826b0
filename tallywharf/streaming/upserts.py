"""Incremental results: each micro-batch is merged into a table of results, later duplicates demote earlier successes, and progress follows.

The state is kept in buckets by batch of files. A micro-batch reads and writes only the buckets it touches, into a folder of its own number, so one that is replayed after a failure gives the
same state; a bucket's newest version is its state, and versions older than the one before are deleted. The final state equals the batch operators' results on all rows, in whatever order they came.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import reconcile

EVENTS = "kind string, batch long, relative_name string, status string, previous_status string"
BUCKETS = 64


def at(path: str, batch: int) -> str:
    return os.path.join(path, f"state-{batch}")


def bucket():
    return F.pmod(F.xxhash64("batch_id"), F.lit(BUCKETS)).cast("int")


def file_system(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), spark.sparkContext._jvm.org.apache.hadoop.fs.Path


def versions(spark: SparkSession, path: str) -> dict[int, list[int]]:
    """For each bucket the numbers of the complete micro-batches that wrote it, newest first."""
    fs, of = file_system(spark, path)
    out: dict[int, list[int]] = {}
    if not fs.exists(of(path)):
        return out
    for s in fs.listStatus(of(path)):
        name = s.getPath().getName()
        if name.startswith("state-") and fs.exists(of(s.getPath(), "_SUCCESS")):
            for b in fs.listStatus(s.getPath()):
                if b.getPath().getName().startswith("bucket="):
                    out.setdefault(int(b.getPath().getName()[7:]), []).append(int(name[6:]))
    return {b: sorted(v, reverse=True) for b, v in out.items()}


def latest(spark: SparkSession, path: str, before: int | None = None, buckets: set[int] | None = None) -> DataFrame | None:
    """The last complete state, of micro-batches before the given one; of some buckets, or of all."""
    found = []
    for b, v in versions(spark, path).items():
        v = [x for x in v if before is None or x < before]
        if v and (buckets is None or b in buckets):
            found.append(os.path.join(at(path, v[0]), f"bucket={b}"))
    return spark.read.parquet(*found) if found else None


def clean(spark: SparkSession, path: str, upto: int) -> None:
    """Deletes versions older than the one before the newest, of micro-batches up to `upto`."""
    fs, of = file_system(spark, path)
    for b, v in versions(spark, path).items():
        for old in [x for x in v if x <= upto][2:]:
            fs.delete(of(os.path.join(at(path, old), f"bucket={b}")), True)


def merge(state: DataFrame | None, new: DataFrame, key: tuple[str, ...] = ("batch_id", "relative_name")) -> DataFrame:
    """State and new rows, the row of highest `file_ord` per key, with duplicates marked over all of them."""
    both = new if state is None else state.select(new.columns).unionByName(new)
    rows = both.groupBy(*key).agg(F.max_by(F.struct(*[c for c in new.columns if c not in key]), "file_ord").alias("r")).select(*key, "r.*").select(new.columns)
    return reconcile.mark_duplicates(rows).drop("reclassified")


def events(state: DataFrame | None, merged: DataFrame, batch: int) -> DataFrame:
    """What a batch changed: new results, and earlier ones that were demoted."""
    now = merged.select("batch_id", "relative_name", "status")
    if state is None:
        return now.select(F.lit("result").alias("kind"), F.lit(batch).cast("long").alias("batch"), "relative_name", "status", F.lit(None).cast("string").alias("previous_status"))
    j = now.join(state.select("batch_id", "relative_name", F.col("status").alias("previous_status")), ["batch_id", "relative_name"], "left")
    changed = j.filter(F.col("previous_status").isNull() | (F.col("previous_status") != F.col("status")))
    return changed.select(F.when(F.col("previous_status").isNull(), "result").otherwise("reclassified").alias("kind"), F.lit(batch).cast("long").alias("batch"), "relative_name", "status", "previous_status")


def run(stream: DataFrame, path: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Upserts a stream of results into `path`; `once` takes what is there and ends. Stop it with query.stop(): what was merged stays."""
    spark = stream.sparkSession

    def each(rows: DataFrame, batch: int) -> None:
        touched = {r[0] for r in rows.select(bucket()).distinct().collect()}  # BUCKETS at most
        if not touched:
            return
        state = latest(spark, path, batch, touched)
        merged = merge(state, rows)
        merged.withColumn("bucket", bucket()).write.mode("overwrite").partitionBy("bucket").parquet(at(path, batch))
        done = spark.read.parquet(at(path, batch)).drop("bucket")
        events(state, done, batch).write.mode("overwrite").parquet(os.path.join(path, "events", f"batch={batch}"))
        clean(spark, path, batch)

    writer = stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).outputMode("append")
    return (writer.trigger(availableNow=True) if once else writer).start()
