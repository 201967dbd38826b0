"""Golden verification and baselines. All native.

An expectation is a row (filename, expected_code, expected_status, should_recognize, allow_review_code, quality_tag, notes); all strings as read from CSV.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import codes, notes
from ..functions.notes import SUCCESS

# The columns of baseline and draft files, and the words of a draft.
BASELINE = ["filename", "expected_code", "expected_status", "allow_review_code", "quality_tag", "notes"]
DRAFT = [*BASELINE, "confirmed", "observed_code", "observed_status", "observed_review_code", "match_basis"]
NOT_PROCESSED, NO_RESULT = "未处理", "未找到处理结果"
UNIQUE_SUCCESS, UNIQUE_REVIEW, REPEATED, UNMATCHED = "正确识别唯一匹配", "待确认候选唯一匹配", "候选在多个样本中重复，需人工映射", "未匹配预期清单"
DRAFT_NOTE = "预期清单唯一匹配；确认原文件内容后将 confirmed 改为 true"
NOT_FOUND = "未在处理结果中找到该样本"


def or_empty(c: Column | str) -> Column:
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))


def expectations(rows: DataFrame) -> DataFrame:
    """Typed expectations; a status decides over should_recognize."""
    have = set(rows.columns)
    get = lambda c: F.col(c) if c in have else F.lit(None).cast("string")
    status = notes.as_status(get("expected_status"))
    return rows.select(
        "filename", F.nullif(get("expected_code"), F.lit("")).alias("expected_code"), F.when(status.isNotNull(), status == SUCCESS).otherwise(notes.as_bool(get("should_recognize"))).alias("should_recognize"),
        status.alias("expected_status"), notes.as_bool(get("allow_review_code")).alias("allow_review_code"), or_empty(F.trim(get("quality_tag"))).alias("quality_tag"),
    )


def find_results(expected: DataFrame, results: DataFrame) -> DataFrame:
    """Expectations with the result of their path, or else of their name; the last result of a name counts."""
    r = results.select("file_ord", "relative_name", "original_name", F.struct("status", "container_code", "review_code").alias("r"))
    last = lambda c: r.filter(F.coalesce(c, F.lit("")) != "").groupBy(F.col(c).alias("filename")).agg(F.max_by("r", "file_ord").alias(f"_{c}"))
    j = expected.join(last("relative_name"), "filename", "left").join(last("original_name"), "filename", "left")
    return j.select(*expected.columns, F.coalesce("_relative_name", "_original_name").alias("result"))


def verdict() -> Column:
    """Null if a result is as expected, else what is wrong. For rows of find_results()."""
    name, want, got = F.col("filename"), or_empty("expected_code"), F.col("result.container_code")
    st, review = F.col("result.status"), or_empty("result.review_code")
    say = lambda *parts: F.concat(name, F.lit(": "), *(F.lit(p) if isinstance(p, str) else p for p in parts))
    wrong_code = ~F.col("expected_code").eqNullSafe(got)
    by_code = say("期望识别 ", want, "，实际为 ", or_empty(got))
    by_status = (
        F.when(st != F.col("expected_status"), say("期望状态 ", F.col("expected_status"), "，实际状态为 ", st))
        .when((st == SUCCESS) & wrong_code, by_code)
        .when((st != SUCCESS) & (review != "") & ~F.col("allow_review_code"), say("不允许待确认候选，实际为 ", review))
        .when((st != SUCCESS) & (review != "") & (want != "") & (review != want), say("期望待确认 ", want, "，实际为 ", review))
    )
    old = (
        F.when(F.col("should_recognize") & (st != SUCCESS), say("期望识别 ", want, "，实际状态为 ", st))
        .when(F.col("should_recognize") & wrong_code, by_code)
        .when(~F.col("should_recognize") & (st == SUCCESS), say("期望不识别，实际识别为 ", or_empty(got)))
    )
    return F.when(F.col("result").isNull(), say(NOT_FOUND)).when(F.col("expected_status").isNotNull(), by_status).otherwise(old)


def verify(expected: DataFrame, results: DataFrame) -> DataFrame:
    """filename, quality_tag, passed, failure."""
    return find_results(expected, results).withColumn("failure", verdict()).select("filename", "quality_tag", F.col("failure").isNull().alias("passed"), "failure")


def category_summary(verified: DataFrame) -> DataFrame:
    """quality_tag, passed, total for tags that aren't empty."""
    return verified.filter("quality_tag <> ''").groupBy("quality_tag").agg(F.count_if("passed").alias("passed"), F.count(F.lit(1)).alias("total")).orderBy("quality_tag")


def overall(verified: DataFrame) -> DataFrame:
    """One row: passed, total, ok, message."""
    n = verified.groupBy().agg(F.count_if("passed").alias("passed"), F.count(F.lit(1)).alias("total"))
    ok = F.col("passed") == F.col("total")
    return n.select("passed", "total", ok.alias("ok"), F.concat(F.when(ok, "样本验收通过: ").otherwise("样本验收失败: "), "passed", F.lit("/"), "total").alias("message"))


def draft(files: DataFrame, results: DataFrame, expected: DataFrame) -> DataFrame:
    """files: relative_name. expected: code. One draft row per file, with a suggestion where an expected code was seen in one result only."""
    own = F.when(F.col("status") == SUCCESS, F.col("container_code")).otherwise(F.col("review_code"))
    r = results.withColumn("_own", F.nullif(own, F.lit(""))).withColumn("_key", F.coalesce(F.nullif("relative_name", F.lit("")), "original_name"))
    hit = r.join(expected.select(F.col("code").alias("_own")).distinct(), "_own", "left_semi").groupBy("_own").agg(F.count(F.lit(1)).alias("_n"))
    last = r.join(hit, "_own", "left").groupBy("_key").agg(F.max_by(F.struct("status", "container_code", "review_code", "_own", "_n"), "file_ord").alias("r"))
    j = files.select(F.col("relative_name").alias("filename")).join(last, F.col("filename") == F.col("_key"), "left")
    some, st = F.col("r").isNotNull(), F.col("r.status")
    matched = some & F.col("r._n").isNotNull()
    lone = matched & (F.col("r._n") == 1)
    return j.select(
        "filename",
        F.when(lone, F.col("r._own")).otherwise("").alias("expected_code"),
        F.when(lone, st).otherwise("").alias("expected_status"),
        F.when(lone & (st != SUCCESS), "true").otherwise("false").alias("allow_review_code"),
        notes.first_segment(F.col("filename")).alias("quality_tag"),
        F.when(lone, DRAFT_NOTE).otherwise("").alias("notes"),
        F.lit("false").alias("confirmed"),
        or_empty("r.container_code").alias("observed_code"),
        F.coalesce(st, F.lit(NOT_PROCESSED)).alias("observed_status"),
        or_empty("r.review_code").alias("observed_review_code"),
        F.when(~some, NO_RESULT).when(lone & (st == SUCCESS), UNIQUE_SUCCESS).when(lone, UNIQUE_REVIEW).when(matched, REPEATED).otherwise(UNMATCHED).alias("match_basis"),
    )


def canonical_row(rows: DataFrame) -> DataFrame:
    return rows.select(*(or_empty(F.trim(F.col(c))).alias(c) if c in rows.columns else F.lit("").alias(c) for c in BASELINE))


def checked_draft(rows: DataFrame, present: DataFrame) -> DataFrame:
    """Confirmed draft rows in baseline form, with `error` where one can't be imported. present: relative_name of the files there are."""
    c = rows.filter(notes.as_bool(F.col("confirmed")))
    name = F.replace(or_empty(F.trim("filename")), F.lit("\\"), F.lit("/"))
    rows_ = c.select(
        name.alias("filename"), F.upper(or_empty(F.trim("expected_code"))).alias("expected_code"), or_empty(F.trim("expected_status")).alias("expected_status"),
        notes.as_bool(F.col("allow_review_code")).alias("allow"), or_empty(F.trim("quality_tag")).alias("quality_tag"), or_empty(F.trim("notes")).alias("notes"),
    )
    there = present.select(F.col("relative_name").alias("filename"), F.lit(True).alias("_there")).distinct()
    j = rows_.join(there, "filename", "left").withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy("filename")))
    f, code = F.col("filename"), F.col("expected_code")
    outside = F.startswith(f, F.lit("/")) | f.rlike(r"(^|/)\.\.(/|\z)")
    error = (
        F.when(f == "", "已确认记录缺少 filename")
        .when(outside, F.concat(F.lit("样本路径超出输入目录: "), f))
        .when(F.col("_there").isNull(), F.concat(F.lit("样本文件不存在: "), f))
        .when(~F.col("expected_status").isin(notes.STATUSES), F.concat(F.lit("样本状态无效: "), f, F.lit(": "), F.when(F.col("expected_status") == "", "空").otherwise(F.col("expected_status"))))
        .when((code != "") & ~codes.is_valid(code), F.concat(F.lit("预期箱号无效: "), f, F.lit(": "), code))
        .when((F.col("expected_status") == SUCCESS) & (code == ""), F.concat(F.lit("正确识别样本必须填写预期箱号: "), f))
        .when(F.col("allow") & (code == ""), F.concat(F.lit("允许待确认的样本必须填写预期箱号: "), f))
        .when(F.col("_n") > 1, F.concat(F.lit("草稿中存在重复样本路径: "), f))
    )
    return j.select("filename", "expected_code", "expected_status", F.when(F.col("allow"), "true").otherwise("false").alias("allow_review_code"), "quality_tag", "notes", error.alias("error"))


def upsert_baseline(existing: DataFrame, confirmed: DataFrame) -> DataFrame:
    """The baseline with the confirmed rows in place of those of the same file, by file name; of equal names in the baseline the last stays (row_no)."""
    old = existing.filter(or_empty(F.trim("filename")) != "")
    kept = canonical_row(old).withColumn("row_no", F.lit(0)) if "row_no" not in existing.columns else old.select(*(or_empty(F.trim(F.col(c))).alias(c) for c in BASELINE), "row_no")
    last = kept.groupBy("filename").agg(F.max_by(F.struct(*BASELINE), "row_no").alias("r")).select("r.*")
    new = confirmed.select(*BASELINE)
    return new.unionByName(last.join(new.select("filename"), "filename", "left_anti")).orderBy("filename")
