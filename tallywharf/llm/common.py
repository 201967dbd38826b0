"""What the corpus operators share: table access, shared scratch tables, shipping the code."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space, `[\x20\x09-\x0D]`.
BLANKS = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def whole_text(col: str = "text") -> Column:
    return F.coalesce(F.col(col).cast("string"), F.lit(""))


def ascii_lower(c: Column) -> Column:
    """A-Z lower-cased, everything else untouched.

    Values of ASCII and of Latin-1 letters that are lower case already take the fast path, where lower() changes nothing else.
    """
    plain = (F.octet_length(c) == F.char_length(c)) | ~c.rlike("[^\\x00-\\x7Fß-öø-ÿ]")
    return F.when(plain, F.lower(c)).otherwise(F.translate(c, UPPER, LOWER))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share. Where none is configured, a temporary one in local mode, which has one machine only; on a cluster that is an error."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
        where = held.get() if held.isDefined() else None
    if not where:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        where = "file://" + tempfile.mkdtemp(prefix="tallywharf-")
        spark.sparkContext.setCheckpointDir(where)
    return where


def on_disk(df: DataFrame) -> DataFrame:
    """Keeps rows that are read several times on the executors' disks. The lineage stays: what a lost executor held is worked out again.

    They are let go with the session, or by release(), since lazy results may still read them. For a few large tables only: the plans of all that
    is made from them hold theirs.
    """
    _kept.append(df.persist(StorageLevel.DISK_ONLY))
    return _kept[-1]


def written(df: DataFrame, label: str = "cut") -> DataFrame:
    """Cuts the lineage, for loops and between stages: the rows go to a Parquet table in the shared folder and are read from there.

    The table lives until the application ends, since lazy results may still read it.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tallywharf/{label}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "false").parquet(path)
    atexit.register(remove, spark, path)
    return spark.read.schema(df.schema).parquet(path)


def in_files(df: DataFrame, label: str, rows: int, row_bytes: int, file_bytes: int = 32_000_000) -> DataFrame:
    """written() in files of about `file_bytes`, for a table of at most `rows` rows; its last step runs in as many tasks."""
    return written(df.coalesce(rows * row_bytes // file_bytes + 1), label)


def compact(df: DataFrame, label: str, most: int | None = None, file_rows: int = 2_000_000) -> DataFrame:
    """written() in files of `file_rows` rows, about: for tables far smaller than what they were made from. `most`: a known bound of its rows, else they are counted."""
    rows = df if most is not None else on_disk(df)
    out = written(rows.repartition((rows.count() if most is None else most) // file_rows + 1), label)
    if most is None:
        rows.unpersist()
    return out


#: Estimated bytes up to which a counted table is broadcast; beyond, both sides of its join are shuffled.
LIGHT_BYTES = 16_000_000


def light(df: DataFrame, rows: int, row_bytes: int = 32) -> DataFrame:
    """df, of `rows` rows as counted, marked for broadcast if it is small enough."""
    return F.broadcast(df) if rows * row_bytes <= LIGHT_BYTES else df


#: Keys that are dealt to several tasks because they are the most frequent ones, and rows of such a key in a task, about.
HOTTEST, PART_ROWS = 1000, 1000


def hottest(found: DataFrame, by: str = "n", most: int = HOTTEST) -> DataFrame:
    """The `most` rows of `found` with the largest counts: a bounded table. A key outside has less than 1 / `most` of all that was counted."""
    return found.orderBy(F.col(by).desc()).limit(most)


def hot_keys(found: DataFrame, keys: list[str], by: str = "n") -> DataFrame:
    """keys, _parts: the hottest keys and how many tasks each is dealt to; `HOTTEST` rows at most."""
    return hottest(found.filter(F.col(by) > PART_ROWS), by).select(*keys, F.ceil(F.col(by) / PART_ROWS).cast("int").alias("_parts"))


def looked_up(few: DataFrame) -> DataFrame | None:
    """hot_keys() worked out now, as a local table, which keeps plans small: for tables that are stored. None if no key is hot."""
    rows = few.collect()
    return few.sparkSession.createDataFrame(rows, few.schema) if rows else None


def spread_join(rows: DataFrame, found: DataFrame, keys: list[str], own: list[str], few: DataFrame | None, how: str = "inner") -> DataFrame:
    """rows join found (one row per key). few: hot_keys(), or None.

    The hottest keys are dealt to several tasks: a row by the hash of its `own` columns, the key's row of `found` once to each.
    """
    if few is None:
        return rows.join(found, keys, how)
    parts = F.coalesce("_parts", F.lit(1))
    a = rows.join(F.broadcast(few), keys, "left").withColumn("_salt", F.pmod(F.xxhash64(*own), parts).cast("int")).drop("_parts")
    b = found.join(F.broadcast(few), keys, "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), parts - 1))).drop("_parts")
    return a.join(b, [*keys, "_salt"], how).drop("_salt")


_kept: list[DataFrame] = []


def release() -> None:
    """Lets go of what on_disk() keeps. Tables made from it lose nothing: they work it out again if they are still read."""
    while _kept:
        _kept.pop().unpersist()


def trim() -> None:
    """Gives memory that was freed back to the system: workers live on between stages."""
    try:
        import ctypes

        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a scratch table through Hadoop's file system, whichever store holds it."""
    try:
        jvm = spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # the application is ending, perhaps without a JVM
        pass


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors, once per application, so that Python workers can import it."""
    sc = spark.sparkContext
    if getattr(sc, "_tallywharf_shipped", False):
        return
    top = Path(__file__).resolve().parents[1]
    to = os.path.join(tempfile.mkdtemp(prefix="tallywharf-"), "tallywharf_ship.zip")
    with zipfile.ZipFile(to, "w") as z:
        for f in sorted(top.rglob("*.py")):
            z.write(f, f"tallywharf/{f.relative_to(top)}")
    sc.addPyFile(to)
    sc._tallywharf_shipped = True


#: Text bytes that a Python function gets at once.
PART_BYTES = 8_000_000


def arrow_map(df: DataFrame, one, schema: str, part_bytes: int = PART_BYTES) -> DataFrame:
    """mapInArrow with `one`: record batch -> dict of columns; batches are cut to about `part_bytes` first.

    A single long value is never cut, so a batch has at least one row.
    """
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    ship(df.sparkSession)
    small_batches(df.sparkSession)
    names = to_arrow_schema(_parse_datatype_string(schema)).names
    types = {f.name: f.type for f in to_arrow_schema(_parse_datatype_string(schema))}

    def run(batches):
        for batch in batches:
            rows = batch.num_rows
            if not rows:
                continue
            step = max(1, int(rows * part_bytes / max(batch.nbytes, 1)))
            for lo in range(0, rows, step):
                got = one(batch.slice(lo, step))
                yield pa.RecordBatch.from_arrays([got[n] if isinstance(got[n], pa.Array) else pa.array(got[n], types[n]) for n in names], names=names)
        trim()

    return df.mapInArrow(run, schema)


_tables: dict = {}


def worker_table(key, build):
    """A large table of a worker process, built once. Workers outlive operators: only the table asked for last is kept, so several operators in turn need no more memory than one."""
    if key not in _tables:
        _tables.clear()
        _tables[key] = build()
    return _tables[key]


def small_batches(spark: SparkSession) -> None:
    """Bounds the bytes of Spark's own Arrow batches, where the session has the default of 64 MB: a batch is held on both sides."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(key, None) in ("67108864b", "67108864", "64m", "64MB"):
        spark.conf.set(key, PART_BYTES)


def tokenizer_file(name: str) -> str:
    """The place of a public tokenizer file; only the default of a parameter."""
    import public_tokenizers

    return public_tokenizers.path(name)
