"""Readers: input folders, expected lists, journals, baselines, review folders, OCR observations. Schemas are given, never inferred."""

from __future__ import annotations

import csv
import os
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import notes, text
from ..operators.verify import BASELINE, DRAFT

# Fixed values.
SUFFIXES = [".jpg", ".jpeg", ".png", ".bmp", ".tif", ".tiff", ".pdf"]
JOURNAL = "original_name string, relative_name string, status string, container_code string, source string, failure_reason string, elapsed_ms string, review_note string, review_code string, output_relative_path string"
OBSERVATIONS = "file_id string, page_no int, seq int, stage string, region_name string, psm int, text string"


def listing(spark: SparkSession, folder: str) -> DataFrame:
    """path of all files below a folder; contents are never read."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).select("path")


def tasks_of(paths: DataFrame, root: str, output: str | None = None) -> DataFrame:
    """paths: path. Supported files below root and outside the output folder, in order of path: file_ord, path, relative_name, original_name, suffix."""
    base = root.rstrip("/") + "/"
    name = F.regexp_extract("path", r"([^/]+)\z", 1)
    rows = paths.filter(F.startswith("path", F.lit(base))).select("path", F.substr("path", F.lit(len(base) + 1)).alias("relative_name"), name.alias("original_name")).withColumn("suffix", text.suffix_of(F.col("original_name")))
    rows = rows.filter(F.col("suffix").isin(SUFFIXES))
    if output:
        out = output.rstrip("/")
        rows = rows.filter((F.col("path") != out) & ~F.startswith("path", F.lit(out + "/")))
    return rows.select(F.row_number().over(Window.orderBy("path")).alias("file_ord"), "*")  # the tasks of one folder


def scan_inputs(spark: SparkSession, root: str, output: str | None = None) -> DataFrame:
    plain = lambda p: "file:" + os.path.abspath(p) if "://" not in p and not p.startswith("file:") else p
    return tasks_of(listing(spark, root), plain(root), plain(output) if output else None)


def without_bom(c: Column) -> Column:
    return F.regexp_replace(c, "^﻿", "")


def expected_entries(spark: SparkSession, path: str) -> DataFrame:
    """entry_pos, entry from a .txt (lines), .csv (cells that aren't blank, row by row, of any width) or .xlsx (cells of the active sheet that aren't empty) list."""
    kind = os.path.splitext(path)[1].lower()
    if kind not in (".csv", ".xlsx"):
        lines = spark.read.text(path, wholetext=True).select(F.split(without_bom(F.col("value")), "\r\n|\n|\r", -1).alias("v"))
        return lines.select(F.posexplode("v").alias("line", "entry")).select(F.col("line").cast("long").alias("entry_pos"), "entry")

    def cells(frames):  # a list that people keep: one file, read by one task, as a stream of frames
        import csv

        import pandas as pd

        from . import sheets

        for frame in frames:
            for content in frame["content"]:
                found = sheets.rows(content) if kind == ".xlsx" else csv.reader(content.decode("utf-8-sig", "ignore").splitlines())
                entries = [v for row in found for v in row if v is not None and (kind == ".xlsx" or v.strip())]
                for lo in range(0, len(entries), 10_000):
                    part = entries[lo : lo + 10_000]
                    yield pd.DataFrame({"entry_pos": range(lo, lo + len(part)), "entry": part})

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(cells, "entry_pos long, entry string")


def prior_results(spark: SparkSession, path: str) -> DataFrame:
    """Rows of a report's index (the hidden sheet, else the visible one) by header: the columns of reconcile.index_rows() and row_no."""
    columns = ["original_name", "relative_name", "container_code", "source", "failure_reason", "review_code", "status", "output_relative_path"]

    def read(frames):
        import pandas as pd

        from . import sheets, sinks

        of = dict(zip(sinks.INDEX_HEADERS, columns, strict=True)) | {sinks.RESULT_HEADERS[1]: "container_code"}
        for frame in frames:
            for content in frame["content"]:
                there = sheets.names(content)
                found = list(sheets.rows(content, sinks.INDEX_SHEET if sinks.INDEX_SHEET in there else None))
                heads = [of.get(h) for h in found[0]] if found else []
                rows = [{h: v for h, v in zip(heads, row, strict=False) if h} | {"row_no": i} for i, row in enumerate(found[1:])]
                yield pd.DataFrame(rows, columns=[*columns, "row_no"]).astype(object).where(lambda x: x.notna(), None)

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(read, ", ".join(f"{c} string" for c in columns) + ", row_no long")


def csv_rows(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """Rows of a CSV with a header, by header name; row_no keeps their order. Missing columns are null."""
    head = spark.read.text(path).limit(1).collect()
    names = [c.strip() for c in next(csv.reader([head[0][0].lstrip("﻿")]), [])] if head else []
    schema = T.StructType([T.StructField(n, T.StringType()) for n in names])
    rows = spark.read.csv(path, header=True, schema=schema, multiLine=True, escape='"', enforceSchema=True) if names else spark.createDataFrame([], "filename string")
    return rows.select(*(F.col(c) if c in names else F.lit(None).cast("string").alias(c) for c in columns), F.monotonically_increasing_id().alias("row_no"))


def baseline_rows(spark: SparkSession, path: str) -> DataFrame:
    return csv_rows(spark, path, [*BASELINE, "should_recognize"])


def draft_rows(spark: SparkSession, path: str) -> DataFrame:
    return csv_rows(spark, path, DRAFT)


def default_baseline(folder: str) -> str:
    """The local baseline where there is one."""
    local = os.path.join(folder, "baseline.local.csv")
    return local if os.path.exists(local) else os.path.join(folder, "baseline.csv")


def journal_lines(spark: SparkSession, path: str) -> DataFrame:
    """line_no, line of a journal file."""
    return spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", "\n", -1)).alias("line_no", "line"))


def recovered(lines: DataFrame, tasks: DataFrame) -> DataFrame:
    """lines: line_no, line. The last sound record of each file that is a task, typed; broken lines, other files and unknown statuses are left out."""
    r = lines.select("line_no", F.from_json("line", JOURNAL).alias("r")).select("line_no", "r.*")
    r = r.filter(F.col("status").isin(notes.STATUSES)).join(tasks.select("relative_name"), "relative_name", "left_semi")
    last = r.groupBy("relative_name").agg(F.max("line_no").alias("line_no"))
    strings = ["original_name", "container_code", "failure_reason", "review_note", "review_code", "output_relative_path"]
    return r.join(last, ["relative_name", "line_no"]).select(
        "relative_name", "line_no", "status", *(notes.optional(F.col(c)).alias(c) for c in strings), notes.known(F.col("source"), notes.SOURCES).alias("source"), notes.optional_int(F.col("elapsed_ms")).alias("elapsed_ms")
    )


def review_files(paths: DataFrame, output: str) -> DataFrame:
    """dir, file_name of the files in the folders of an output folder."""
    base = output.rstrip("/") + "/"
    rel = F.split(F.substr("path", F.lit(len(base) + 1)), "/")
    return paths.filter(F.startswith("path", F.lit(base))).select(rel.alias("p")).filter(F.size("p") == 2).select(F.get("p", F.lit(0)).alias("dir"), F.get("p", F.lit(1)).alias("file_name")).orderBy(F.lower("file_name"))


def observed(pages: DataFrame, recogniser: Callable) -> DataFrame:
    """Observations from an injected recogniser: a function of an iterator of pandas frames of `pages` that yields frames of OBSERVATIONS."""
    return pages.mapInPandas(recogniser, OBSERVATIONS)
