"""Files for people and for recovery: workbooks, CSV with a byte order mark, journals. Written on the driver, to a name beside the target first; rows come as a stream, in order."""

from __future__ import annotations

import csv
import json
import os
from collections.abc import Iterable
from datetime import datetime

from pyspark.sql import DataFrame

from ..functions import notes
from ..operators import reconcile
from . import sheets

# Names of sheets, columns and files.
RESULT_SHEET, INDEX_SHEET, COMPARISON_SHEET = "识别结果", "内部索引", "箱号比对"
RESULT_HEADERS = ["原始文件名", "识别箱号", "识别状态", "处理耗时ms", "备注"]
INDEX_HEADERS = ["原始文件名", "相对路径", "原始识别箱号", "识别来源", "失败原因", "复核候选", "识别状态", "输出相对路径"]
COMPARISON_HEADERS = ["预期箱号", "状态", "对应文件", "多余识别箱号", "格式无效"]
WIDTHS, COMPARISON_WIDTHS = [52, 18, 14, 14, 52], [18, 14, 32, 18, 28]
JOURNAL = ["original_name", "relative_name", "status", "container_code", "source", "failure_reason", "elapsed_ms", "review_note", "review_code", "output_relative_path"]


def replaced(path: str, data: bytes) -> str:
    """Writes a file as a whole or not at all."""
    os.makedirs(os.path.dirname(path) or ".", exist_ok=True)
    beside = f"{path}.{os.getpid()}.tmp"
    try:
        with open(beside, "wb") as f:
            f.write(data)
        os.replace(beside, path)
    finally:
        if os.path.exists(beside):
            os.unlink(beside)
    return path


def lines(df: DataFrame, columns: list[str], *order: str) -> Iterable[list]:
    return ([r[c] for c in columns] for r in df.orderBy(*order).toLocalIterator())


def write_workbook(results: DataFrame, path: str, comparison: DataFrame | None = None) -> str:
    """The report of a batch: visible results in scan order (those without success coloured), a hidden index to resume from, and the comparison with an expected list.

    If the file is in use, the report goes to a name with the time in it. Returns the path that was written.
    """
    shown = ["original_name", "display_code", "status", "elapsed_ms", "display_note"]
    index = ["original_name", "relative_name", "container_code", "source", "failure_reason", "review_code", "status", "output_relative_path"]
    ordered = results.select("file_ord", "relative_name", *(c for c in results.columns if c not in ("file_ord", "relative_name")))
    book = [
        (RESULT_SHEET, [RESULT_HEADERS, *lines(reconcile.result_sheet(ordered, "file_ord", "relative_name"), shown, "file_ord", "relative_name")], False, WIDTHS),
        (INDEX_SHEET, [INDEX_HEADERS, *lines(reconcile.index_rows(ordered, "file_ord"), index, "file_ord", "relative_name")], True, []),
    ]
    if comparison is not None:
        book.append((COMPARISON_SHEET, [COMPARISON_HEADERS, *lines(comparison, ["expected_code", "status", "file", "extra_code", "invalid_entry"], "row_no")], False, COMPARISON_WIDTHS))
    data = sheets.workbook(book, marked=lambda row: row[2] != notes.SUCCESS)
    try:
        return replaced(path, data)
    except PermissionError:
        stem, suffix = os.path.splitext(path)
        return replaced(f"{stem}-{datetime.now():%Y%m%d-%H%M%S-%f}{suffix}", data)


def write_csv(df: DataFrame, path: str, columns: list[str], *order: str) -> str:
    """A CSV with a header and a byte order mark, as spreadsheets open it."""
    import io

    out = io.StringIO(newline="")
    w = csv.writer(out)
    w.writerow(columns)
    w.writerows(["" if v is None else v for v in row] for row in lines(df, columns, *(order or columns[:1])))
    return replaced(path, out.getvalue().encode("utf-8-sig"))


def write_missing(missing: DataFrame, path: str) -> str:
    """missing: pos, line (reconcile.missing_list)."""
    return replaced(path, "".join(f"{r[0]}\n" for r in lines(missing, ["line"], "pos")).encode("utf-8"))


def append_journal(results: DataFrame, path: str) -> int:
    """Appends results to a journal, one JSON object a line, and sees to it that they are on disk. Returns how many."""
    os.makedirs(os.path.dirname(path) or ".", exist_ok=True)
    n = 0
    with open(path, "a", encoding="utf-8", newline="\n") as f:
        for row in lines(results, JOURNAL, "file_ord", "relative_name"):
            f.write(json.dumps(dict(zip(JOURNAL, row, strict=True)), ensure_ascii=False, separators=(",", ":")) + "\n")
            n += 1
        f.flush()
        os.fsync(f.fileno())
    return n


def clear_journal(path: str, workbook: str, written: str) -> bool:
    """Deletes the journal once the report itself (not a copy under another name) is written. Whether it did."""
    if os.path.abspath(workbook) != os.path.abspath(written) or not os.path.exists(path):
        return False
    os.unlink(path)
    return True
