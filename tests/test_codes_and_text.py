"""Single codes and texts: fixed vectors, and the native expressions against plain Python."""

import random

import pytest
from pyspark.sql import functions as F

from tallywharf.functions import codes, notes, regions, text
from tallywharf.operators import reading

VALID = "HNKU6331795 GESU5903360 TEMU7797904 TEMU6779790 UACU5502014 YYCU6003610 MSKU1234565 MSCU1234566 KSBU0042011".split()
REPAIRS = "YYCU1002610 YYCU3002610 YYCU6302610 YYCU6402610 YYCU6022610 YYCU6072610 YYCU6000610 YYCU6003610 YYCU6002110 YYCU6002510 YYCU6002640 YYCU6002660".split()


def one(spark, col, **values):
    df = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values)) if values else spark.range(1)
    return df.select(col).first()[0]


def test_valid_codes(spark):
    rows = spark.createDataFrame([(c,) for c in VALID], "c string").select(codes.is_valid(F.col("c")), codes.check_digit(F.left("c", F.lit(10))), F.right("c", F.lit(1)).cast("int")).collect()
    assert all(ok and a == b for ok, a, b in rows)
    assert all(map(reading.valid, VALID))


@pytest.mark.parametrize(("code", "digit"), [("HNKU6331794", 5), ("YYCU6002610", 3), ("INKU6331795", 6)])
def test_wrong_digits(spark, code, digit):
    assert one(spark, codes.check_digit(F.left("c", F.lit(10))), c=code) == digit
    assert one(spark, codes.is_valid(F.col("c")), c=code) is False


@pytest.mark.parametrize("code", ["HINKU6331795", "IJIP5617782", "", "HNKU633179", "HNKU633179５"])
def test_malformed(spark, code):
    assert one(spark, codes.is_valid(F.col("c")), c=code) is False


def test_null_is_not_valid(spark):
    assert one(spark, codes.is_valid(F.col("c")), c=None) is False
    assert one(spark, codes.check_digit(F.col("c")), c=None) is None
    assert one(spark, codes.is_valid(F.col("c")), c=" hnku6331795 ") is True


def test_repairs(spark):
    assert one(spark, codes.digit_repairs(F.col("c")), c="YYCU6002610") == REPAIRS == reading.repairs("YYCU6002610")
    assert one(spark, codes.only_repair(F.col("c")), c="YYCU6002610") is None
    assert one(spark, text.repaired_candidates(F.col("t")), t="x HINKU6331795") == ["HNKU6331795"]
    assert one(spark, text.invalid_candidates(F.col("t")), t="x HINKU6331795") == ["INKU6331795"]
    for raw, code in (("GESU59O3360", "GESU5903360"), ("UACUSSO2014", "UACU5502014"), ("UACUS5O2014", "UACU5502014")):
        assert one(spark, text.guessed_code(F.col("t")), t=raw) == code == reading.guessed(raw)


def test_native_expressions_match_plain_python(spark):
    rnd = random.Random(5)
    words = [*VALID, "YYCU6002610", "HINKU6331795", "GESU59O3360", "UACU SSO2014", "temu-779_7904", "45G1", "CNTR", "\n", "U", "ß", "x9", "", "箱号"]
    texts = ["".join(rnd.choice(words) + rnd.choice(["", " ", "-", "\t"]) for _ in range(rnd.randint(0, 7))) for _ in range(150)] + [None, ""]
    t = F.col("t")
    rows = (
        spark.createDataFrame([(x,) for x in texts], "t string")
        .select("t", text.candidates(t), text.invalid_candidates(t), text.suspicious_candidates(t), text.guessed_code(t), notes.final_note(F.coalesce(t, F.lit(""))), text.scored_matches(t, F.lit("full"), False), text.scored_matches(t, F.lit("p"), True))
        .collect()
    )
    for x, good, bad, odd, guess, note, clear, fixed in rows:
        assert tuple(good) == reading.valid_codes(x) and tuple(bad) == reading.invalid_codes(x) and tuple(odd) == reading.suspicious(x)
        assert guess == reading.guessed(x)
        assert note == reading.final_note(x or "")
        for got, region, repaired in ((clear, "full", False), (fixed, "p", True)):
            best = {}
            for m in got:
                best[m["code"]] = max(best.get(m["code"], -99), m["score"]) + 5 if m["code"] in best else m["score"]
            assert sorted(best.items()) == sorted((c.code, c.score) for c in reading.scores([reading.Seen(region, x or "")], repaired))


def test_positions_are_places_in_the_text(spark):
    t = "a HNKU 6331795-b GESU5903360"
    for m in one(spark, text.scored_matches(F.col("t"), F.lit("full"), False), t=t):
        assert reading.clean_text(t)[m["start"] : m["stop"]].replace(" ", "") == m["code"]


def test_review_scores(spark):
    got = one(spark, text.review_scores(F.lit("hnku6331795"), F.lit("GESU5903360"), F.array(F.lit("HNKU6331795"), F.lit("GESU5903360"), F.lit("X")), F.array(F.lit("X"))))
    assert [(r["code"], r["score"], r["reasons"]) for r in got] == [("GESU5903360", 90, ["enhanced_valid"]), ("X", 40, ["expected_match"]), ("HNKU6331795", 30, ["base_valid"])]
    assert one(spark, text.clear_winner(text.review_scores(F.lit(""), F.lit("A"), F.array(F.lit("A"), F.lit("B"))), 90, 25)) == "A"


def test_notes(spark):
    assert one(spark, notes.humanised(F.lit("PROCESS_FAILED: Permission denied"))).startswith("结果表可能")
    assert one(spark, notes.humanised(F.lit(None).cast("string"))) == ""
    assert one(spark, notes.with_duplicate_note(F.lit("a ; ; " + notes.DUPLICATE_PREFIX + "x"), F.lit("n"))) == "a; n"
    assert one(spark, notes.shortened(F.lit("x" * 239 + ",，;;;"))) == "x" * 239 + notes.OMITTED
    assert one(spark, notes.duration(F.lit(3725.9))) == "01:02:05"
    assert one(spark, notes.log_tag(F.lit("PermissionError"))) == "error"
    assert one(spark, notes.target_name(F.lit("a.b.PDF"), F.lit(notes.INVALID), F.lit("C"), F.lit("R"))) == "R-待确认.PDF"
    assert one(spark, notes.listed(F.array(*(F.lit(str(i)) for i in range(10))))) == "0, 1, 2, 3, 4, 5, 6, 7 等 10 个"


def test_regions(spark):
    assert one(spark, regions.evidence_region(F.lit("enhanced-400dpi-full-middle-x2sharp"))) == "full-middle"
    assert one(spark, regions.evidence_source(F.lit("enhanced-base-left-middle-plain"))) == "base"
    assert one(spark, regions.page_number(F.lit("page-0"))) == 1 and one(spark, regions.page_number(F.lit("page-12"))) == 12
    for name in ("priority-left-middle", "cell-r1-c1", "cell-r8-c3", "cell-r9-c1", "full"):
        got = one(spark, regions.review_box(F.lit(name)))
        assert (tuple(got) if got else None) == reading.review_box(name)
    pages = spark.createDataFrame([("a", 1000, 1600), ("b", 19, 500)], "page_id string, width int, height int")
    assert regions.grid_regions(pages).count() == 24
    assert [r["region_name"] for r in regions.named_regions(pages, "priority", "fast").orderBy("region_ord").collect()] == [p[0] for p in regions.PRIORITY[:3]]
    flat = spark.createDataFrame([("x", 5, 9), ("y", 0, 5), ("y", 200, 5)], "image_id string, level int, n long")
    assert {r["image_id"]: r["threshold"] for r in regions.otsu_threshold(flat).collect()} == {"x": 127, "y": 0}
    assert regions.mode_of("Stable") == "stable" and regions.mode_of("?") == regions.mode_of(None) == "balanced"
