"""Batches: duplicates, expected lists, resume, review confirmation, verification, sources and streaming."""

import json
import random

import pytest
from pyspark.sql import functions as F

from tallywharf.functions import notes
from tallywharf.operators import batch, reconcile, verify
from tallywharf.sources import files as sources
from tallywharf.sources import sheets, sinks
from tallywharf.streaming import upserts

COLS = "batch_id string, file_ord long, relative_name string, original_name string, status string, container_code string, source string, failure_reason string, review_note string, review_code string, ocr_text string, elapsed_ms int, output_relative_path string"


def results(spark, *rows):
    """Rows of (name, status, code, review_code) and whatever else by name."""
    out = []
    for i, (name, status, code, review, *more) in enumerate(rows):
        x = more[0] if more else {}
        out.append((x.get("batch", "b"), i, x.get("path", name), name, status, code, "OCR", x.get("reason"), x.get("note"), review, x.get("text", ""), 1500, x.get("out")))
    return spark.createDataFrame(out, COLS)


def expected(spark, *codes):
    return spark.createDataFrame(list(enumerate(codes)), "pos long, code string")


def test_duplicates_are_demoted_and_stay_so(spark):
    r = results(spark, ("a", notes.SUCCESS, "C1", None), ("b", notes.SUCCESS, "C1", None, {"note": "n"}), ("c", notes.SUCCESS, "C2", None), ("d", notes.SUCCESS, "C1", None, {"batch": "other"}), ("e", notes.UNRECOGNIZED, None, "C2"))
    once = reconcile.mark_duplicates(r)
    got = {x["original_name"]: x for x in once.collect()}
    assert {n for n, x in got.items() if x["reclassified"]} == {"a", "b"}
    assert got["a"]["status"] == notes.INVALID and got["a"]["review_code"] == "C1" and "有 2 个文件" in got["a"]["review_note"] and got["b"]["review_note"].startswith("n; ")
    again = reconcile.mark_duplicates(once.drop("reclassified"))
    assert not any(x["reclassified"] for x in again.collect()) and again.filter(f"status = '{notes.INVALID}'").count() == 2


def test_expected_list(spark):
    entries = spark.createDataFrame(list(enumerate(["HNKU6331795", "invalid-line", "HNKU6331795", "HNKU6331794", "GESU5903360 45G1", " ", None])), "entry_pos long, entry string")
    got = {}
    for r in reconcile.inspect_expected(entries).orderBy("pos").collect():
        got.setdefault(r["kind"], []).append(r["value"])
    assert got == {"valid": ["HNKU6331795", "GESU5903360"], "duplicate": ["HNKU6331795"], "invalid": ["invalid-line", "HNKU6331794"]}


def test_comparison(spark):
    r = results(spark, ("a", notes.SUCCESS, "HNKU6331795", None), ("b", notes.SUCCESS, "MSKU1234565", None), ("c", notes.UNRECOGNIZED, None, "UACU5502014"))
    e = expected(spark, "HNKU6331795", "GESU5903360", " hnku6331795", "UACU5502014")
    got = {(x["kind"], x["code"]) for x in reconcile.compare_expected(e, r).collect()}
    assert got == {("matched", "HNKU6331795"), ("missing", "GESU5903360"), ("missing", "UACU5502014"), ("extra", "MSKU1234565")}
    assert [(x["code"], x["status"], x["file"]) for x in reconcile.expected_details(e, r).orderBy("pos").collect()] == [("HNKU6331795", "已识别", "a"), ("GESU5903360", "缺失", None), ("UACU5502014", "待确认命中", "c")]
    sheet = reconcile.comparison_sheet(e, r, spark.createDataFrame([(0, "bad")], "pos long, value string")).orderBy("row_no").collect()
    assert sheet[0]["extra_code"] == "MSKU1234565" and sheet[0]["invalid_entry"] == "bad" and sheet[1]["extra_code"] == ""
    assert [x["line"] for x in reconcile.missing_list(expected(spark, "HNKU6331795"), r).collect()] == [notes.NO_MISSING]


def test_expected_codes_among_review_candidates(spark):
    r = results(spark, ("a", notes.UNRECOGNIZED, None, None, {"text": "UACUSSO2014"}), ("b", notes.INVALID, "YYCU6002610", None, {"note": "n"}), ("c", notes.UNRECOGNIZED, None, "X", {"text": "UACUSSO2014"}), ("d", notes.SUCCESS, "C", None, {"text": "UACUSSO2014"}))
    got = {x["original_name"]: x for x in reconcile.apply_expected_review(r, expected(spark, "UACU5502014", "YYCU6003610", "YYCU1002610")).collect()}
    assert got["a"]["review_code"] == "UACU5502014" and got["c"]["review_code"] == "X" and got["d"]["review_code"] is None
    assert got["b"]["review_code"] is None and got["b"]["review_note"] == "n；多个预期清单候选命中（未自动采用）: YYCU1002610, YYCU6003610"


def test_resume(spark):
    r = results(spark, ("a", notes.SUCCESS, "C1", None), ("b", notes.SUCCESS, "C2", None, {"out": "正确识别/C2.jpg"}), ("c", notes.SUCCESS, "C3", None, {"out": "正确识别/gone.jpg"}), ("d", notes.INVALID, "C4", None), ("e", notes.SUCCESS, "C5", None, {"out": "../C5.jpg"}))
    done = reconcile.skippable(r, spark.createDataFrame([("正确识别/C2.jpg",), ("../C5.jpg",)], "path string"))
    tasks = r.select("relative_name")
    assert {x[0] for x in reconcile.pending(tasks, done).collect()} == {"c", "d", "e"}


def test_output_names(spark):
    r = results(spark, ("x.jpg", notes.SUCCESS, "C1", None), ("y.jpg", notes.SUCCESS, "C1", None), ("z.jpg", notes.SUCCESS, "C1", None, {"out": "正确识别/C1.jpg"}), ("u.pdf", notes.INVALID, "C", "C9"), ("v.pdf", notes.UNRECOGNIZED, None, None))
    got = {x["relative_name"]: x["target"] for x in reconcile.output_plan(r).collect()}
    assert got == {"z.jpg": "正确识别/C1.jpg", "x.jpg": "正确识别/C1-1.jpg", "y.jpg": "正确识别/C1-2.jpg", "u.pdf": "箱号错误/C9-待确认.pdf", "v.pdf": "未识别/v.pdf"}


def test_review_and_moves(spark, tmp_path):
    names = [("未识别", "HNKU6331795-待确认.jpg"), ("箱号错误", "gesu5903360-待确认-2.PDF"), ("未识别", "TEMU6779790-待确认.jpg"), ("箱号错误", "TEMU6779790-待确认.pdf"), ("未识别", "HNKU6331794-待确认.jpg"), ("未识别", "plain.jpg"), ("正确识别", "GESU5903360-1.jpg")]
    for d, n in names:
        (tmp_path / d).mkdir(exist_ok=True)
        (tmp_path / d / n).write_text(n)
    listing = sources.review_files(sources.listing(spark, str(tmp_path)), f"file:{tmp_path}")
    assert {(r["dir"], r["file_name"]) for r in listing.collect()} == set(names)
    got = {r["file_name"]: r["reason"] for r in reconcile.review_listing(listing).collect()}
    assert got == {
        "HNKU6331795-待确认.jpg": None, "gesu5903360-待确认-2.PDF": "正确识别目录已有同箱号文件", "TEMU6779790-待确认.jpg": "同一箱号对应多个待确认文件", "TEMU6779790-待确认.pdf": "同一箱号对应多个待确认文件",
        "HNKU6331794-待确认.jpg": "箱号格式或 ISO 6346 校验不通过",
    }
    chosen = reconcile.expected_reviews(reconcile.review_listing(listing), expected(spark, "HNKU6331795", "TEMU6779790"))
    plan = reconcile.confirmation_plan(chosen)
    plan = spark.createDataFrame(plan.collect(), plan.schema)
    assert tuple(reconcile.confirmation_summary(plan).first()) == (1, 0, 0)
    assert reconcile.apply_moves(plan, str(tmp_path)) == 1 and (tmp_path / "正确识别" / "HNKU6331795.jpg").exists()
    assert reconcile.apply_moves(plan, str(tmp_path)) == 0


def test_scan(spark, tmp_path):
    for n in ("b/2.JPG", "a/1.pdf", "a/x.txt", "out/3.png", "outside.png"):
        (tmp_path / n).parent.mkdir(exist_ok=True)
        (tmp_path / n).write_text("x")
    got = sources.scan_inputs(spark, str(tmp_path), str(tmp_path / "out")).orderBy("file_ord").collect()
    assert [(r["relative_name"], r["suffix"]) for r in got] == [("a/1.pdf", ".pdf"), ("b/2.JPG", ".jpg"), ("outside.png", ".png")]


def test_lists_and_baselines(spark, tmp_path):
    (tmp_path / "e.txt").write_text("﻿HNKU6331795\r\n\nx", encoding="utf-8")
    (tmp_path / "e.csv").write_text('﻿A,"b, c",\n ,d\n', encoding="utf-8")
    entries = lambda n: [r["entry"] for r in sources.expected_entries(spark, str(tmp_path / n)).orderBy("entry_pos").collect()]
    assert entries("e.txt") == ["HNKU6331795", "", "x"] and entries("e.csv") == ["A", "b, c", "d"]
    (tmp_path / "wide.csv").write_text(",".join(f"c{i}" for i in range(100)) + '\n"two\nlines",x\n', encoding="utf-8")
    assert entries("wide.csv") == [f"c{i}" for i in range(100)] + ["twolines", "x"]
    (tmp_path / "e.xlsx").write_bytes(sheets.workbook([("one", [["HNKU6331795", None, 7], [], ["a & <b>", 2.5]], False, [])]))
    assert entries("e.xlsx") == ["HNKU6331795", "7", "a & <b>", "2.5"]
    (tmp_path / "baseline.csv").write_text("﻿filename,expected_code,should_recognize\na.jpg,C1,yes\nb.jpg,,no\n", encoding="utf-8")
    assert sources.default_baseline(str(tmp_path)).endswith("baseline.csv")
    e = verify.expectations(sources.baseline_rows(spark, str(tmp_path / "baseline.csv")))
    r = results(spark, ("a.jpg", notes.SUCCESS, "C1", None), ("b.jpg", notes.SUCCESS, "C2", None))
    v = verify.verify(e, r)
    assert {x["filename"]: x["failure"] for x in v.collect()} == {"a.jpg": None, "b.jpg": "b.jpg: 期望不识别，实际识别为 C2"}
    assert tuple(verify.overall(v).first()) == (1, 2, False, "样本验收失败: 1/2")


def test_journal(spark, tmp_path):
    rec = lambda n, **k: json.dumps({"original_name": n, "relative_name": n, "status": notes.SUCCESS, "elapsed_ms": 5} | k)
    lines = [rec("a", container_code="C1"), "{broken", rec("a", container_code="C2", source="?"), rec("unknown"), rec("b", status="?"), ""]
    (tmp_path / "j.jsonl").write_text("\n".join(lines), encoding="utf-8")
    got = sources.recovered(sources.journal_lines(spark, str(tmp_path / "j.jsonl")), spark.createDataFrame([("a",), ("b",)], "relative_name string")).collect()
    assert [(r["relative_name"], r["container_code"], r["source"], r["elapsed_ms"]) for r in got] == [("a", "C2", None, 5)]


def test_drafts_and_upserts(spark):
    r = results(spark, ("x/a", notes.SUCCESS, "C1", None), ("x/b", notes.UNRECOGNIZED, None, "C2"), ("c", notes.SUCCESS, "C2", None))
    d = {x["filename"]: x for x in verify.draft(spark.createDataFrame([("x/a",), ("x/b",), ("z",)], "relative_name string"), r, expected(spark, "C1", "C2")).collect()}
    assert d["x/a"]["expected_code"] == "C1" and d["x/a"]["quality_tag"] == "x" and d["x/b"]["match_basis"] == verify.REPEATED and d["z"]["observed_status"] == verify.NOT_PROCESSED
    row = "filename string, expected_code string, expected_status string, allow_review_code string, quality_tag string, notes string"
    old = spark.createDataFrame([("b", "1", "", "", "", ""), ("a", "2", "", "", "", ""), (" ", "", "", "", "", "")], row)
    new = spark.createDataFrame([("b", "9", "", "", "", "")], row)
    assert [(x[0], x[1]) for x in verify.upsert_baseline(old, new).collect()] == [("a", "2"), ("b", "9")]


def test_stream_ends_where_the_batch_does(spark, tmp_path):
    r = results(spark, ("a", notes.SUCCESS, "C1", None), ("b", notes.SUCCESS, "C2", None), ("c", notes.SUCCESS, "C1", None), ("d", notes.UNRECOGNIZED, None, None))
    src = str(tmp_path / "in")
    stream = spark.readStream.schema(COLS).option("maxFilesPerTrigger", 1).parquet(src + "/*")
    for k, part in enumerate((r.filter("file_ord < 2"), r.filter("file_ord >= 2"))):
        part.coalesce(1).write.parquet(f"{src}/{k}")
    q = upserts.run(stream, str(tmp_path / "out"), str(tmp_path / "ck"))
    q.awaitTermination(120)
    state = upserts.latest(spark, str(tmp_path / "out"))
    cols = ["relative_name", "status", "review_code"]
    assert sorted(map(tuple, state.select(cols).collect()), key=str) == sorted(map(tuple, reconcile.mark_duplicates(r).select(cols).collect()), key=str)
    events = {(e["kind"], e["relative_name"]) for e in spark.read.parquet(str(tmp_path / "out" / "events")).collect()}
    assert ("reclassified", "a") in events or ("reclassified", "c") in events


def test_stream_rewrites_what_it_touches_and_cleans_up(spark, tmp_path):
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    parts = [results(spark, (f"f{k}", notes.SUCCESS, f"C{k % 2}", None)).withColumn("batch_id", F.lit("x" if k < 4 else "y")).withColumn("file_ord", F.lit(k).cast("long")) for k in range(5)]
    for k, part in enumerate(parts):
        part.coalesce(1).write.parquet(f"{src}/{k}")
        stream = spark.readStream.schema(part.schema).parquet(src + "/*")
        upserts.run(stream, out, str(tmp_path / "ck")).awaitTermination(120)
    kept = upserts.versions(spark, out)
    assert sorted(map(len, kept.values())) == [1, 2] and max(v[0] for v in kept.values()) == 4
    every = parts[0]
    for part in parts[1:]:
        every = every.unionByName(part)
    cols = ["relative_name", "status", "review_code"]
    assert sorted(map(str, upserts.latest(spark, out).select(cols).collect())) == sorted(map(str, reconcile.mark_duplicates(every).select(cols).collect()))


def names_by_hand(rows):
    """Files copied one after the other, each to the first free name of its folder."""
    taken, out = set(), {}
    for rel, folder, want, there in sorted(rows, key=lambda r: not r[3]):
        stem, dot, ext = want.rpartition(".")
        name, k = want, 1
        while (folder, name) in taken:
            name, k = f"{stem}-{k}.{ext}", k + 1
        taken.add((folder, name))
        out[rel] = name
    return out


@pytest.mark.parametrize("seed", range(3))
def test_output_names_are_free_ones(spark, seed):
    rnd = random.Random(seed)
    pool = ["A.jpg", "A-1.jpg", "A-2.jpg", "A-1-1.jpg", "A-1-2.jpg", "A-01.jpg", "B.jpg", "B-3.jpg", "C-1.jpg", "A-1.pdf", "A-1-1-1.jpg"]
    wants = ["A.jpg", "A.jpg", "A-1.jpg"] if not seed else [rnd.choice(pool) for _ in range(60)]
    rows, held = [], set()
    for i, w in enumerate(wants):
        there = seed == 2 and w not in held and rnd.random() < 0.2
        held |= {w} if there else set()
        rows.append((f"r{i:02}", notes.UNRECOGNIZED, w, there))
    r = spark.createDataFrame([("b", i, rel, w, folder, None, None, f"{folder}/{w}" if there else None) for i, (rel, folder, w, there) in enumerate(rows)], "batch_id string, file_ord long, relative_name string, original_name string, status string, container_code string, review_code string, output_relative_path string")
    got = reconcile.output_plan(r).collect()
    assert {x["relative_name"]: x["name"] for x in got} == names_by_hand(rows) and len({x["target"] for x in got}) == len(rows)


def test_reports_are_written_and_read_back(spark, tmp_path):
    r = results(spark, ("x/a", notes.SUCCESS, "C1", None), ("b", notes.UNRECOGNIZED, None, "C2"))
    e = expected(spark, "C1", "C9")
    book = str(tmp_path / "out" / "r.xlsx")
    bad = spark.createDataFrame([("??", 1)], "value string, pos long")
    assert sinks.write_workbook(r, book, reconcile.comparison_sheet(e, r, bad)) == book
    data = (tmp_path / "out" / "r.xlsx").read_bytes()
    assert sheets.names(data) == [sinks.RESULT_SHEET, sinks.INDEX_SHEET, sinks.COMPARISON_SHEET]
    assert [row[1:3] for row in sheets.rows(data)] == [sinks.RESULT_HEADERS[1:3], ["C1", notes.SUCCESS], ["C2", notes.UNRECOGNIZED]]
    prior = sorted(((x["relative_name"], x["status"], x["review_code"], x["row_no"]) for x in sources.prior_results(spark, book).collect()))
    assert [(a, b, d) for a, b, _, d in prior] == [("b", notes.UNRECOGNIZED, 1), ("x/a", notes.SUCCESS, 0)]
    csv_path = sinks.write_csv(r.select("relative_name", "status"), str(tmp_path / "d.csv"), ["relative_name", "status"])
    assert (tmp_path / "d.csv").read_text(encoding="utf-8-sig").splitlines()[0] == "relative_name,status" and csv_path.endswith("d.csv")
    assert sinks.write_missing(reconcile.missing_list(e, r), str(tmp_path / "m.txt")) and (tmp_path / "m.txt").read_text(encoding="utf-8") == "C9\n"
    journal = str(tmp_path / "s" / "j.jsonl")
    assert sinks.append_journal(r, journal) == 2 and sinks.append_journal(r.filter("file_ord = 0"), journal) == 1
    back = sources.recovered(sources.journal_lines(spark, journal), r.select("relative_name")).collect()
    assert {x["relative_name"] for x in back} == {"x/a", "b"}
    assert not sinks.clear_journal(journal, book, book + "x") and sinks.clear_journal(journal, book, book) and not sinks.clear_journal(journal, book, book)


def test_a_whole_batch(spark):
    files = spark.createDataFrame([(1, "b", 0, "x/a.jpg", "a.jpg"), (2, "b", 1, "y/a.jpg", "a.jpg"), (3, "b", 2, "c.jpg", "c.jpg"), (4, "o", 0, "a.jpg", "a.jpg")], "file_id long, batch_id string, file_ord long, relative_name string, original_name string")
    seen = spark.createDataFrame([(1, "HNKU6331795 45G1"), (2, "CNTR HNKU6331795"), (3, "nothing"), (4, "HNKU6331795 45G1")], "file_id long, text string").selectExpr("file_id", "1 AS page_no", "1 AS seq", "'full' AS stage", "'full' AS region_name", "CAST(NULL AS INT) AS psm", "text")
    entries = spark.createDataFrame([(0, "HNKU6331795"), (1, "TEMU6779790"), (2, "bad")], "entry_pos long, entry string")
    out = batch.run(files, seen, "fast", entries)
    got = {(r["batch_id"], r["relative_name"]): (r["status"], r["failure_reason"], r["output_relative_path"]) for r in out.results.collect()}
    assert got[("b", "x/a.jpg")] == got[("b", "x/a.jpg")][:0] + (notes.INVALID, notes.DUPLICATE, f"{notes.INVALID}/HNKU6331795-待确认.jpg")
    assert got[("b", "y/a.jpg")][2] == f"{notes.INVALID}/HNKU6331795-待确认-1.jpg" and got[("o", "a.jpg")] == (notes.SUCCESS, None, f"{notes.SUCCESS}/HNKU6331795.jpg")
    assert got[("b", "c.jpg")][0] == notes.UNRECOGNIZED
    assert {r["line"] for r in out.missing.collect()} == {"TEMU6779790"} and out.counts.first()["invalid"] == 1 and out.comparison.count() == 2
    assert {(r["batch_id"], r["success"]) for r in out.progress.collect()} == {("b", 0), ("o", 1)}
    again = batch.run(files, seen.filter("file_id <> 4"), "fast", entries, prior=out.results)
    assert {r["relative_name"]: r["status"] for r in again.results.filter("batch_id = 'o'").collect()} == {"a.jpg": notes.SUCCESS} and again.results.count() == 4


def test_recognisers_and_drafts_are_read(spark, tmp_path):
    import pandas as pd

    def read(frames):
        for f in frames:
            yield pd.DataFrame({"file_id": f["file_id"], "page_no": 1, "seq": 1, "stage": "full", "region_name": "full", "psm": None, "text": f["file_id"] + "!"}).astype({"psm": "Int32"})

    assert [tuple(r) for r in sources.observed(spark.createDataFrame([("a",)], "file_id string"), read).collect()] == [("a", 1, 1, "full", "full", None, "a!")]
    (tmp_path / "draft.csv").write_text('﻿filename,"expected_code",confirmed\n"a, b.jpg",C1,true\n', encoding="utf-8")
    got = sources.draft_rows(spark, str(tmp_path / "draft.csv")).first()
    assert (got["filename"], got["expected_code"], got["confirmed"], got["notes"]) == ("a, b.jpg", "C1", "true", None)
