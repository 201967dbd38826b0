"""Batches of results: duplicates, expected lists, resume, review confirmation, reports. All native.

Results are rows (batch_id, file_ord, relative_name, original_name, status, container_code, source, failure_reason, review_note, review_code, ocr_text, elapsed_ms,
output_relative_path); `file_ord` is the scan order within the batch. Functions ignore columns they don't need.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import codes, notes, text
from ..functions.notes import INVALID, SUCCESS, UNRECOGNIZED

BATCH = ["batch_id"]


def filled(c: str) -> Column:
    return F.coalesce(F.col(c), F.lit("")) != ""


def tracked_code(prefix: str = "") -> Column:
    """The code under which a result can be a duplicate: its own, or the one it was demoted for."""
    s, c, r, why = (F.col(prefix + x) for x in ("status", "container_code", "review_code", "failure_reason"))
    return F.nullif(F.when(s == SUCCESS, c).when(why == notes.DUPLICATE, F.coalesce(F.nullif(r, F.lit("")), c)), F.lit(""))


def mark_duplicates(results: DataFrame, keys: list[str] = BATCH) -> DataFrame:
    """Every result whose code occurs twice in its batch becomes invalid, with the code for review. `reclassified` marks rows that changed.

    The counts are aggregated before they meet the rows, so a code that many rows share is no single task's work.
    """
    t = results.withColumn("_code", tracked_code())
    many = t.filter(F.col("_code").isNotNull()).groupBy(*keys, "_code").agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1")
    j = t.join(many, [*keys, "_code"], "left")
    hit = F.col("_n").isNotNull()
    note = notes.with_duplicate_note(F.col("review_note"), notes.duplicate_note(F.col("_code"), F.col("_n")))
    new = {"status": F.lit(INVALID), "failure_reason": F.lit(notes.DUPLICATE), "review_code": F.col("_code"), "review_note": note}
    changed = F.lit(False)
    for c, v in new.items():
        changed = changed | ~F.col(c).eqNullSafe(v)
    return j.select(*[F.when(hit, new[c]).otherwise(F.col(c)).alias(c) if c in new else F.col(c) for c in results.columns], (hit & changed).alias("reclassified"))


def inspect_expected(entries: DataFrame) -> DataFrame:
    """entries: entry_pos, entry. Rows (kind, pos, value), kind valid, duplicate or invalid, in order: codes once, codes seen again, entries without a code."""
    e = entries.select("entry_pos", F.trim("entry").alias("entry")).filter("entry <> ''").withColumn("codes", text.candidates(F.col("entry")))
    each = e.select("entry_pos", F.posexplode("codes").alias("at", "code"))
    nth = each.withColumn("n", F.row_number().over(Window.partitionBy("code").orderBy("entry_pos", "at")))
    valid = nth.filter("n = 1").select(F.lit("valid").alias("kind"), (F.col("entry_pos") * 1000 + F.col("at")).alias("pos"), F.col("code").alias("value"))
    again = nth.filter("n = 2").select(F.lit("duplicate").alias("kind"), (F.col("entry_pos") * 1000 + F.col("at")).alias("pos"), F.col("code").alias("value"))
    bad = e.filter(F.size("codes") == 0).select(F.lit("invalid").alias("kind"), (F.col("entry_pos") * 1000).alias("pos"), F.col("entry").alias("value"))
    return valid.unionByName(again).unionByName(bad)


def distinct_expected(expected: DataFrame) -> DataFrame:
    """expected: pos, code. Upper-case codes once, at their first place."""
    c = expected.select("pos", F.upper(F.trim("code")).alias("code")).filter("code <> ''")
    return c.groupBy("code").agg(F.min("pos").alias("pos"))


def first_hits(results: DataFrame, which: str) -> DataFrame:
    """code, file: the first result of each code; which: success (own codes) or review (review codes of other results)."""
    code, fits = ("container_code", F.col("status") == SUCCESS) if which == "success" else ("review_code", F.col("status") != SUCCESS)
    return results.filter(fits & filled(code)).groupBy(F.col(code).alias("code")).agg(F.min_by("original_name", F.struct("file_ord", "relative_name")).alias("file"), F.min("file_ord").alias("ord"))


def expected_details(expected: DataFrame, results: DataFrame) -> DataFrame:
    """pos, code, status, file: recognised, awaiting review, or missing."""
    e = distinct_expected(expected)
    s = first_hits(results, "success").select("code", F.col("file").alias("s"))
    r = first_hits(results, "review").select("code", F.col("file").alias("r"))
    j = e.join(s, "code", "left").join(r, "code", "left")
    return j.select("pos", "code", F.when(F.col("s").isNotNull(), notes.RECOGNIZED).when(F.col("r").isNotNull(), notes.REVIEW_HIT).otherwise(notes.MISSING).alias("status"), F.coalesce("s", "r").alias("file"))


def compare_expected(expected: DataFrame, results: DataFrame) -> DataFrame:
    """kind (matched, missing, extra), pos, code."""
    e = distinct_expected(expected)
    s = first_hits(results, "success")
    matched = e.join(s, "code", "left_semi").select(F.lit("matched").alias("kind"), "pos", "code")
    missing = e.join(s, "code", "left_anti").select(F.lit("missing").alias("kind"), "pos", "code")
    extra = s.join(e, "code", "left_anti").select(F.lit("extra").alias("kind"), F.col("ord").alias("pos"), "code")
    return matched.unionByName(missing).unionByName(extra)


def comparison_counts(expected: DataFrame, results: DataFrame, invalid_entries: DataFrame) -> DataFrame:
    """One row: the numbers of the comparison, and its message."""
    k = compare_expected(expected, results).groupBy().agg(*(F.count_if(F.col("kind") == x).alias(x) for x in ("matched", "missing", "extra")))
    n = invalid_entries.groupBy().agg(F.count(F.lit(1)).alias("invalid"))
    message = F.concat(F.lit("箱号比对: 已匹配 "), "matched", F.lit(", 缺失 "), "missing", F.lit(", 多余 "), "extra", F.lit(", 格式无效 "), "invalid")
    return k.join(n).select("*", message.alias("message"))  # one row each


def comparison_sheet(expected: DataFrame, results: DataFrame, invalid_entries: DataFrame) -> DataFrame:
    """The three lists of a comparison side by side: row_no, expected_code, status, file, extra_code, invalid_entry; shorter ones are filled up with empty strings."""

    def numbered(df: DataFrame, *order) -> DataFrame:
        return df.withColumn("row_no", F.row_number().over(Window.orderBy(*order)))  # a report for people: as long as the expected list

    d = numbered(expected_details(expected, results), "pos")
    x = numbered(compare_expected(expected, results).filter("kind = 'extra'").select(F.col("code").alias("extra_code"), "pos"), "pos", "extra_code").drop("pos")
    i = numbered(invalid_entries.select(F.col("value").alias("invalid_entry"), "pos"), "pos").drop("pos")
    j = d.join(x, "row_no", "full_outer").join(i, "row_no", "full_outer")
    blank = lambda c: F.coalesce(c, F.lit(""))
    return j.select("row_no", blank(F.col("code")).alias("expected_code"), *(blank(F.col(c)).alias(c) for c in ("status", "file", "extra_code", "invalid_entry")))


def missing_list(expected: DataFrame, results: DataFrame) -> DataFrame:
    """pos, line of the file of missing codes; one line that says so if none is."""
    m = compare_expected(expected, results).filter("kind = 'missing'").select("pos", F.col("code").alias("line"))
    none = m.groupBy().agg(F.count(F.lit(1)).alias("n")).filter("n = 0").select(F.lit(0).cast("long").alias("pos"), F.lit(notes.NO_MISSING).alias("line"))
    return m.select(F.col("pos").cast("long").alias("pos"), "line").unionByName(none)


def apply_expected_review(results: DataFrame, expected: DataFrame) -> DataFrame:
    """Results without a code of their own get the one expected code among their candidates for review; several are only noted.

    expected: pos, code. Candidates are exploded and met with the list by a semi-join, so the list may be of any length.
    """
    e = distinct_expected(expected).select("code")
    fits = F.col("status").isin(UNRECOGNIZED, INVALID) & ~filled("review_code")
    key = [c for c in ("batch_id", "relative_name") if c in results.columns]
    each = results.filter(fits).select(*key, F.posexplode(text.review_candidates(F.col("ocr_text"), F.col("container_code"))).alias("at", "code")).join(e, "code", "left_semi")
    hits = each.groupBy(*key).agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "code"))), lambda x: x["code"]).alias("_hits"))
    j = results.join(hits, key, "left")
    n = F.when(fits & F.col("_hits").isNotNull(), F.size("_hits")).otherwise(0)
    one = F.get("_hits", F.lit(0))
    note = notes.joined(F.col("review_note"), F.when(n == 1, F.concat(F.lit("预期清单唯一匹配待确认: "), one)).otherwise(F.concat(F.lit("多个预期清单候选命中（未自动采用）: "), F.array_join("_hits", ", "))))
    new = {"review_code": F.when(n == 1, one).otherwise(F.col("review_code")), "review_note": F.when(n > 0, note).otherwise(F.col("review_note"))}
    return j.select(*[new[c].alias(c) if c in new else F.col(c) for c in results.columns])


def attach_prior(tasks: DataFrame, prior: DataFrame) -> DataFrame:
    """tasks: relative_name, original_name. prior: rows of a stored index. Each prior row goes to the task of its path, or to the only task of its name; the last row of a task stays.

    Rows without a name or with an unknown status are left out. prior needs `row_no`.
    """
    only = tasks.groupBy("original_name").agg(F.count(F.lit(1)).alias("n"), F.min("relative_name").alias("by_name")).filter("n = 1").select("original_name", "by_name")
    p = prior.withColumn("original_name", notes.optional(F.col("original_name"))).withColumn("relative_name", notes.optional(F.col("relative_name"))).filter(F.col("original_name").isNotNull() & F.col("status").isin(notes.STATUSES))
    direct = tasks.select(F.col("relative_name").alias("by_path"))
    j = p.join(direct, p["relative_name"] == F.col("by_path"), "left").join(only, "original_name", "left")
    task = F.coalesce("by_path", "by_name")
    key = F.coalesce("relative_name", task)
    rows = j.withColumn("task_name", task).filter(F.col("task_name").isNotNull()).withColumn("relative_name", key)
    last = rows.groupBy("relative_name").agg(F.max("row_no").alias("row_no"))
    kept = rows.join(last, ["relative_name", "row_no"])
    strings = ["container_code", "failure_reason", "review_code", "output_relative_path"]
    return kept.select("relative_name", "task_name", "original_name", "status", *(notes.optional(F.col(c)).alias(c) for c in strings), notes.known(F.col("source"), notes.SOURCES).alias("source"))


def find_prior(tasks: DataFrame, prior: DataFrame) -> DataFrame:
    """tasks with `prior_status`, by path or else by name (which also finds a top-level file of that name)."""
    last = F.max_by("status", "row_no") if "row_no" in prior.columns else F.max("status")  # of rows that repeat a path the last one counts
    p = prior.groupBy(F.col("relative_name").alias("k")).agg(last.alias("s"))
    j = tasks.join(p.select(F.col("k").alias("k1"), F.col("s").alias("s1")), F.col("relative_name") == F.col("k1"), "left").join(p.select(F.col("k").alias("k2"), F.col("s").alias("s2")), F.col("original_name") == F.col("k2"), "left")
    return j.select(*tasks.columns, F.coalesce("s1", "s2").alias("prior_status"))


def overlay(stored: DataFrame, recovered: DataFrame, key: str = "relative_name") -> DataFrame:
    """Recovered rows in place of stored ones."""
    return recovered.unionByName(stored.join(recovered.select(key), key, "left_anti"), allowMissingColumns=True)


def skippable(prior: DataFrame, present: DataFrame) -> DataFrame:
    """Prior successes that need no work: those without a recorded output, and those whose output is safe and there (present: path, relative to the output folder)."""
    p = prior.filter(F.col("status") == SUCCESS)
    safe = F.col("output_relative_path").rlike(r"^[^/]+(/[^/]+)*\z") & ~F.col("output_relative_path").rlike(r"(^|/)\.\.(/|\z)")
    there = p.filter(filled("output_relative_path") & safe).join(present.select(F.col("path").alias("output_relative_path")).distinct(), "output_relative_path", "left_semi")
    return p.filter(~filled("output_relative_path")).unionByName(there.select(p.columns))


def pending(tasks: DataFrame, done: DataFrame) -> DataFrame:
    """Tasks that are still to do."""
    return tasks.join(done.select("relative_name"), "relative_name", "left_anti")


def retryable(results: DataFrame) -> DataFrame:
    return results.groupBy().agg(F.count_if(F.col("status").isin(UNRECOGNIZED, INVALID)).alias("n_retryable"))


def output_plan(results: DataFrame, keys: list[str] = BATCH) -> DataFrame:
    """Where each result's file goes: dir, name, target. In scan order, a file whose name is taken in its folder gets the first of -1, -2, ... that is free; a file that has its place already keeps it.

    Names that no numbered name can meet are numbered by their rank. A name that looks like a numbered one of another name there (A-1 beside A) depends on what came before: such families
    of names go as sorted streams through numbered().
    """
    want = notes.target_name(F.col("original_name"), F.col("status"), F.col("container_code"), F.col("review_code"))
    r = results.select(*keys, "relative_name", "file_ord", F.col("status").alias("dir"), want.alias("want"), F.coalesce(F.col("output_relative_path") == F.concat_ws("/", "status", want), F.lit(False)).alias("stays"))
    place = [*keys, "dir"]
    stem, suffix = text.stem_of(F.col("want")), F.regexp_extract("want", r"(?<=.)(\.[^.]+)\z", 1)
    # the names that a name could be a numbered one of, nearest first: they count as long as they are there
    numbers = F.regexp_extract(stem, r"((?:-[1-9][0-9]*)+)\z", 1)
    depth = F.size(F.split(numbers, "-")) - 1
    wants = r.select(*place, "want").distinct().withColumn("up", F.when(depth > 0, F.transform(F.sequence(F.lit(1), depth), lambda i: F.struct(i.alias("i"), F.concat(F.regexp_replace(stem, F.concat(F.lit("(-[0-9]+){"), i.cast("string"), F.lit("}$")), F.lit("")), suffix).alias("name")))))
    above = wants.select(*place, "want", F.explode("up").alias("u")).select(*place, "want", "u.i", F.col("u.name").alias("name"))
    there = above.join(wants.select(*place, F.col("want").alias("name")), [*place, "name"])
    chain = there.groupBy(*place, "want").agg(F.array_sort(F.collect_list(F.struct("i", "name"))).alias("a"))  # as many as a name has numbers
    unbroken = F.filter("a", lambda x, at: x["i"] == at + 1)
    below = chain.filter(F.size(unbroken) > 0).select(*place, "want", F.element_at(unbroken, -1)["name"].alias("root"))
    family = below.unionByName(below.select(*place, F.col("root").alias("want"), "root").distinct())
    plain = r.join(family, [*place, "want"], "left_anti")
    rank = F.row_number().over(Window.partitionBy(*place, "want").orderBy(F.col("stays").desc(), "file_ord", "relative_name")) - 1
    plain = plain.withColumn("n", rank).select(*keys, "relative_name", "dir", F.when(F.col("n") == 0, F.col("want")).otherwise(F.concat(stem, F.lit("-"), F.col("n").cast("string"), suffix)).alias("name"))
    mixed = r.join(family, [*place, "want"]).repartition(*place, "root").sortWithinPartitions(*place, "root", F.col("stays").desc(), "file_ord", "relative_name")
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in plain.schema)
    named = mixed.select(*keys, "relative_name", "dir", "root", "want", stem.alias("stem"), suffix.alias("suffix")).mapInPandas(numbered(place), schema)
    return plain.unionByName(named).select(*keys, "relative_name", "dir", "name", F.concat_ws("/", "dir", "name").alias("target"))


def numbered(place: list[str]):
    """A function of a stream of frames, sorted by folder, family and order, that gives each row its free name. It keeps a family's distinct names, and how far each has been numbered."""

    def run(frames):
        now, taken, reached = None, set(), {}
        for frame in frames:
            names = []
            for *folder, want, stem, suffix in zip(*(frame[c] for c in [*place, "root", "want", "stem", "suffix"]), strict=True):
                if folder != now:
                    now, taken, reached = folder, set(), {}
                k = reached.get(want, 1)
                if want not in taken and not was_given(want, reached):
                    taken.add(want)
                    names.append(want)
                    continue
                while f"{stem}-{k}{suffix}" in taken:
                    k += 1
                reached[want] = k + 1
                names.append(f"{stem}-{k}{suffix}")
            yield frame.assign(name=names)[[c for c in frame.columns if c not in ("root", "want", "stem", "suffix")] + ["name"]]

    return run


def was_given(name: str, reached: dict[str, int]) -> bool:
    """Whether a name was given to an earlier file as a numbered one."""
    import re

    m = re.fullmatch(r"(.+)-([1-9][0-9]*)(\.[^.]+)?", name, re.DOTALL)
    return bool(m) and int(m[2]) < reached.get(m[1] + (m[3] or ""), 0)


def result_sheet(results: DataFrame, *more: str) -> DataFrame:
    """The five visible columns of a batch's report, and `more`."""
    return results.select(
        *more, "original_name", notes.display_code(F.col("status"), F.col("container_code"), F.col("review_code")).alias("display_code"), "status", "elapsed_ms",
        notes.display_note(F.col("status"), F.col("review_note"), F.col("failure_reason")).alias("display_note"), (F.col("status") != SUCCESS).alias("highlighted"),
    )


def index_rows(results: DataFrame, *more: str) -> DataFrame:
    """The eight columns that a later run resumes from, missing values as empty strings, and `more`."""
    cols = ["original_name", "relative_name", "container_code", "source", "failure_reason", "review_code", "status", "output_relative_path"]
    return results.select(*more, *(F.coalesce(F.col(c), F.lit("")).alias(c) for c in cols))


def progress(results: DataFrame, keys: list[str] = BATCH) -> DataFrame:
    s = F.col("status")
    return results.groupBy(*keys).agg(F.count(F.lit(1)).alias("processed"), F.count_if(s == SUCCESS).alias("success"), F.count_if(s == UNRECOGNIZED).alias("unrecognized"), F.count_if(s == INVALID).alias("invalid"))


def completion(results: DataFrame, keys: list[str] = BATCH) -> DataFrame:
    """The closing line of each batch; elapsed_ms are added up."""
    p = results.groupBy(*keys).agg(F.count_if(F.col("status") == SUCCESS).alias("success"), F.count_if(F.col("status") != SUCCESS).alias("review"), F.floor(F.sum("elapsed_ms") / 1000).alias("seconds"))
    line = F.concat(F.lit("处理结束：成功 "), F.col("success").cast("string"), F.lit(" | 待复核 "), F.col("review").cast("string"), F.lit(" | 用时 "), notes.duration(F.col("seconds")))
    return p.select(*keys, "success", "review", "seconds", line.alias("message"))


def status_distribution(results: DataFrame) -> DataFrame:
    return results.groupBy("status").agg(F.count(F.lit(1)).alias("n"))


def repeated_outputs(batches: DataFrame) -> DataFrame:
    """batches: batch_id, output_dir. Output folders that several batches share."""
    return batches.groupBy("output_dir").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


# -- review of files named CODE-待确认 --------------------------------------------------------------------------------
REVIEW_NAME = r"(?i)^([A-Z]{3}U[0-9]{7})-待确认(?:-[0-9]+)?(\.[^.]+)\z"


def success_codes(files: DataFrame) -> DataFrame:
    """files: dir, file_name. Valid codes of the files that are confirmed."""
    code = F.split_part(F.upper(text.stem_of(F.col("file_name"))), F.lit("-"), F.lit(1))
    return files.filter(F.col("dir") == SUCCESS).select(code.alias("code")).filter(codes.is_valid(F.col("code"))).distinct()


def review_listing(files: DataFrame) -> DataFrame:
    """files: dir, file_name. Files that await review: dir, file_name, review_code, target_name, valid, reason."""
    c = (
        files.filter(F.col("dir").isin(UNRECOGNIZED, INVALID) & F.col("file_name").rlike(REVIEW_NAME))
        .select("dir", "file_name", F.upper(F.regexp_extract("file_name", REVIEW_NAME, 1)).alias("review_code"), F.regexp_extract("file_name", REVIEW_NAME, 2).alias("suffix"))
        .withColumn("target_name", F.concat("review_code", "suffix"))
    )
    have = success_codes(files).select(F.col("code").alias("review_code"), F.lit(True).alias("_have"))
    there = files.filter(F.col("dir") == SUCCESS).select(F.col("file_name").alias("target_name"), F.lit(True).alias("_there")).distinct()
    many = c.groupBy("review_code").agg(F.count(F.lit(1)).alias("_n"))
    j = c.join(have, "review_code", "left").join(there, "target_name", "left").join(many, "review_code")
    why = (
        F.when(F.col("_n") > 1, "同一箱号对应多个待确认文件")
        .when(~codes.is_valid(F.col("review_code")), "箱号格式或 ISO 6346 校验不通过")
        .when(F.col("_have").isNotNull(), "正确识别目录已有同箱号文件")
        .when(F.col("_there").isNotNull(), "目标文件已存在")
    )
    return j.select("dir", "file_name", "review_code", "target_name", why.isNull().alias("valid"), why.alias("reason"))


def expected_reviews(listing: DataFrame, expected: DataFrame) -> DataFrame:
    """Files of a review listing that can be confirmed for an expected code."""
    e = distinct_expected(expected).select(F.col("code").alias("review_code"))
    return listing.filter("valid").join(e, "review_code", "left_semi").select(listing.columns)


def confirmation_plan(chosen: DataFrame) -> DataFrame:
    """What confirming does with each file: file_name, review_code, action (move or skip), target, failure."""
    n = F.sum(F.col("valid").cast("int")).over(Window.partitionBy("review_code"))
    safe = F.col("dir").isin(UNRECOGNIZED, INVALID) & ~F.contains(F.col("file_name"), F.lit("/"))
    why = (
        F.when(~F.col("valid"), F.coalesce("reason", F.lit("候选不可整理")))
        .when(F.col("_n") > 1, F.concat(F.lit("同一批次存在重复箱号 "), F.col("review_code")))
        .when(~safe, "文件路径不在当前输出目录内")
    )
    rows = chosen.withColumn("_n", n).withColumn("_why", why)
    return rows.select("dir", "file_name", "review_code", F.when(F.col("_why").isNull(), "move").otherwise("skip").alias("action"), F.concat_ws("/", F.lit(SUCCESS), "target_name").alias("target"), F.concat(F.col("file_name"), F.lit(": "), F.col("_why")).alias("failure"))


def confirmation_summary(plan: DataFrame) -> DataFrame:
    a = F.col("action")
    return plan.groupBy().agg(F.count_if(a == "move").alias("moved"), F.count_if(a == "skip").alias("skipped"), F.count_if(F.col("failure").isNotNull()).alias("conflicts"))


def apply_moves(plan: DataFrame, root: str) -> int:
    """Moves the planned files within `root`, on the driver, one after the other; never over an existing file. Returns how many moved."""
    import os

    moved = 0
    # all of the plan first: it reads the folder that is about to change, and is as long as one person's list
    for r in plan.filter("action = 'move'").select("dir", "file_name", "target").collect():
        target = os.path.join(root, r["target"])
        if os.path.exists(target):
            continue
        os.makedirs(os.path.dirname(target), exist_ok=True)
        os.rename(os.path.join(root, r["dir"], r["file_name"]), target)
        moved += 1
    return moved
