"""Files decided from texts by region, as a reader of pages would see them."""

import pytest

from tallywharf.operators import decide

HEAD = "file_id string, page_no int, seq int, stage string, region_name string, psm int, text string"
P = ["priority-left-middle", "priority-left-upper", "priority-full-middle", "priority-left-lower-middle"]


def obs(file_id, full="", priority=(), grid=(), enhanced=()):
    rows = [(file_id, 1, 1, "full", "full", None, full)]
    rows += [(file_id, 1, 10 + i, "priority", P[i], None, x) for i, x in enumerate(priority)]
    rows += [(file_id, 1, 20 + i, "grid", name, None, x) for i, (name, x) in enumerate(grid)]
    k = 100
    for name, x in enhanced:
        for psm in (6, 7, 11):
            rows.append((file_id, 1, k, "enhanced", name, psm, x))
            k += 1
    return rows


def run(spark, mode, rows, name="scan.jpg"):
    files = spark.createDataFrame([("f", name)], "file_id string, name string")
    return decide.results(files, spark.createDataFrame(rows, HEAD), mode).first()


BASE = [f"enhanced-base-{b}-plain" for b in ("full-middle", "left-middle", "left-lower-middle")]
HIGH = [f"enhanced-400dpi-{b}-plain" for b in ("full-middle", "left-middle", "left-lower-middle")]

CASES = [
    ("clean", "fast", obs("f", "箱号 HNKU6331795"), "scan.jpg", ("正确识别", "HNKU6331795", "OCR", None)),
    ("by name", "fast", obs("f", "no code"), "HNKU6331795.jpg", ("正确识别", "HNKU6331795", "文件名", None)),
    ("wrong digit", "fast", obs("f", "箱号 HNKU6331794"), "scan.jpg", ("箱号错误", "HNKU6331794", "OCR", "INVALID_CHECK_DIGIT")),
    ("region over noise", "balanced", obs("f", "YBXKIKOOMIJIP 5617782 J0YBEXK", ["GESU5903360P45G130"]), "scan.jpg", ("正确识别", "GESU5903360", "OCR", None)),
    ("override", "balanced", obs("f", "noise TEMUGTT9790 45G1", ["TEMU77979045G132500"], enhanced=[(n, "TEMU677979045G132500") for n in BASE[:2]]), "scan.jpg", ("正确识别", "TEMU6779790", "OCR增强", None)),
    ("conflict", "fast", obs("f", "noise TEMUGTT9790", ["TEMU77979045G132500"]), "scan.jpg", ("箱号错误", "TEMU7797904", "OCR", "CONFLICTING_CANDIDATES")),
    ("ambiguous repair", "fast", obs("f", "OCR YYCU6002610"), "scan.jpg", ("箱号错误", "YYCU6002610", "OCR", "INVALID_CHECK_DIGIT")),
    ("guess only", "fast", obs("f", "UACUSSO2014 UACUS5O2014"), "scan.jpg", ("未识别", None, None, "NO_CONTAINER_CANDIDATE")),
    ("guess confirmed", "balanced", obs("f", "UACUSSO2014", enhanced=[(BASE[0], "UACU5502014 45G1")]), "scan.jpg", ("正确识别", "UACU5502014", "OCR增强", None)),
    ("repair confirmed", "stable", obs("f", "YYCU6002610", enhanced=[(BASE[0], "YYCU6003610 45G1")]), "scan.jpg", ("正确识别", "YYCU6003610", "OCR增强", None)),
    ("unrelated", "stable", obs("f", "YYCU6002610", enhanced=[(BASE[0], "HNKU6331795 45G1")]), "scan.jpg", ("箱号错误", "YYCU6002610", "OCR", "INVALID_CHECK_DIGIT")),
    ("repeated over single", "balanced", obs("f", "HNKU6331795", ["GESU5903360 45G1", "GESU5903360 45G1"]), "scan.jpg", ("正确识别", "GESU5903360", "OCR", None)),
    ("document confirmed", "balanced", obs("f", "", ["TEMU7797904 45G1"], enhanced=[(n, "TEMU6779790 45G1") for n in [*HIGH, *BASE]]), "scan.pdf", ("正确识别", "TEMU6779790", "OCR增强", None)),
    ("document unconfirmed", "balanced", obs("f", "", ["TEMU7797904 45G1"], enhanced=[(HIGH[0], "TEMU6779790 45G1")]), "scan.pdf", ("箱号错误", "TEMU7797904", "OCR", "INSUFFICIENT_CANDIDATE_EVIDENCE")),
]


@pytest.mark.parametrize("case", CASES, ids=[c[0] for c in CASES])
def test_case(spark, case):
    _, mode, rows, name, want = case
    got = run(spark, mode, rows, name)
    assert (got["status"], got["container_code"], got["source"], got["failure_reason"]) == want


def test_details(spark):
    assert run(spark, "fast", obs("f", "UACUSSO2014 UACUS5O2014"))["review_code"] == "UACU5502014"
    got = run(spark, "fast", obs("f", "OCR YYCU6002610"))
    assert got["review_code"] is None and "YYCU1002610" in got["review_note"]
    assert "TEMUGTT9790" in run(spark, "fast", obs("f", "noise TEMUGTT9790", ["TEMU77979045G132500"]))["review_note"]


def test_base_source_is_not_read_without_a_signal(spark):
    rows = obs("f", "", enhanced=[(HIGH[0], "TEMUGTT9790"), (HIGH[1], ""), (BASE[0], "HNKU6331795")])
    got = run(spark, "balanced", rows, "scan.pdf")
    assert got["status"] == "未识别" and not any("base" in r for r in got["readings"])


def test_settled_boxes_skip_variants_and_psms(spark):
    every = [f"enhanced-{s}-{b}-{v}" for s in ("400dpi", "base") for b in ("full-middle", "left-middle") for v in ("plain", "x2sharp")]
    got = run(spark, "balanced", obs("f", "", enhanced=[(n, "HNKU6331795") for n in every]), "scan.pdf")
    assert [r for r in got["readings"] if "enhanced" in r] == ["enhanced-400dpi-full-middle-plain:psm6", "enhanced-400dpi-full-middle-plain:psm11", "enhanced-400dpi-left-middle-plain:psm6", "enhanced-base-full-middle-plain:psm6"]


def test_a_failing_file_is_its_own_result(spark):
    got = run(spark, "fast", [("f", 1, 1, "full", None, None, "x")])
    assert got["status"] == "未识别" and got["failure_reason"].startswith("PROCESS_FAILED: ")


def test_native_fast_results_equal_the_sequential_ones(spark):
    from pyspark.sql import functions as F

    from tallywharf.plans import fixtures as fx

    d = "/root/testdata/sf0.001"
    files, o = fx.files(spark, d).withColumnRenamed("original_name", "name"), fx.observations(spark, d)
    cols = ["file_id", "status", "container_code", "source", "failure_reason", "review_note", "review_code", F.sha2("ocr_text", 256).alias("words")]
    a, b = decide.fast_results(files, o).select(cols), decide.results(files, o, "fast").select(cols)
    assert a.exceptAll(b).count() == 0 and a.count() == files.count() == b.count()


def test_files_with_their_readings_need_no_join(spark):
    """The queries decide all files in one pass; before, their observations were made twice and met the files again and again."""
    from pyspark.sql import functions as F

    from tallywharf.plans import fixtures as fx
    from tallywharf.plans import registry

    d = "/root/testdata/sf0.001"
    o = fx.observations(spark, d).unionByName(fx.enhanced_observations(spark, d)).cache()
    files = fx.files(spark, d).withColumnRenamed("original_name", "name")
    for mode in ("balanced", "stable"):
        got = registry.QUERIES[f"D1_D10_{mode}_results"](spark, d)
        assert got._jdf.queryExecution().optimizedPlan().toString().count("Join ") == 1
        want = decide.results(files, o, mode).withColumn("readings", F.size("readings")).select(got.columns)
        assert got.exceptAll(want).count() == 0 and got.count() == want.count() == files.count()
