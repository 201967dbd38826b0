"""One result for each file. fast_results() is native, for the mode without enhancement; results() runs any mode: natively as far as the first steps settle a file, then as a grouped map."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import codes, notes, regions, text
from . import evidence
from .evidence import PAGE, STRONG, merged

RESULT = "file_id {id}, status string, container_code string, source string, failure_reason string, review_note string, review_code string, ocr_text string, readings array<string>"
#: So many files of a batch are Python objects at once; each has a hundred readings per page at most.
AT_ONCE = 250


def results(files: DataFrame, obs: DataFrame | None = None, mode: str = "balanced") -> DataFrame:
    """files: file_id, name. One row per file, also for files without observations. An error within a file becomes its result.

    In modes with enhancement, settled_early() gives the results of the files that need none; only the others go, one by one, through the sequential part. Its table is read twice: hand
    over observations that are stored. Files that bring their observations along as an array (`rows`, see sequential()) need no obs, and go through the sequential part in one pass.
    """
    mode = regions.mode_of(mode)
    if obs is None:
        return decided(files, mode)
    if mode == "fast":
        return sequential(files, obs, mode)
    done = settled_early(files, obs)
    rest = files.select("file_id", "name").join(merged(done.select("file_id")), "file_id", "left_anti")
    return done.unionByName(sequential(rest, obs.join(merged(rest.select("file_id")), "file_id", "left_semi"), mode))


def sequential(files: DataFrame, obs: DataFrame, mode: str) -> DataFrame:
    """results() by a grouped map over files, each reading deciding on the next ones."""
    cols = ["page_no", "seq", "stage", "region_name", "psm", "text"] + (["error"] if "error" in obs.columns else [])
    per = obs.groupBy("file_id").agg(F.collect_list(F.struct(*cols)).alias("rows"))  # a hundred readings per page at most
    return decided(files.select("file_id", "name").join(merged(per), "file_id", "left"), mode)


def decided(files: DataFrame, mode: str) -> DataFrame:
    """files: file_id, name, rows (array of struct(page_no, seq, stage, region_name, psm, text), maybe error; or null). One row per file."""
    from .reading import File

    names = [c.split()[0] for c in RESULT.split(", ")]

    def values(column):
        """A column as a list; equal values are one object."""
        d = column.dictionary_encode()
        held = [*d.dictionary.to_pylist(), None]
        return [held[i] for i in d.indices.fill_null(len(held) - 1).to_pylist()]

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            kinds = {"file_id": batch.schema.field("file_id").type, "readings": pa.list_(pa.string())}
            schema = pa.schema([(n, kinds.get(n, pa.string())) for n in names])
            fields = [f.name for f in batch.schema.field("rows").type.value_type]
            page = fields.index("page_no")
            for at in range(0, batch.num_rows, AT_ONCE):
                part, out, low = batch.slice(at, AT_ONCE), [], 0
                flat = list(zip(*(values(c) for c in part.column("rows").flatten().flatten()), strict=True))
                for id_, name, n in zip(part.column("file_id").to_pylist(), part.column("name").to_pylist(), part.column("rows").value_lengths().to_pylist(), strict=True):
                    pages: dict[int, list[dict]] = {}
                    for r in flat[low : low + (n or 0)]:
                        pages.setdefault(r[page], []).append(dict(zip(fields, r)))  # noqa: B905
                    low += n or 0
                    f = File(name, mode, pages)
                    try:
                        got = f.decide()
                    except Exception as e:  # one file's failure is its result
                        got = f.result(notes.UNRECOGNIZED, reason=f"PROCESS_FAILED: {e}")
                    out.append({"file_id": id_} | got)
                yield pa.RecordBatch.from_pylist(out, schema=schema)

    return files.select("file_id", "name", "rows").mapInArrow(run, RESULT.format(id=files.schema["file_id"].dataType.simpleString()))


def page_text(keys: list[str] = PAGE):
    """The reference text of what was read, in order: label and text of each region."""
    body = said({c: F.col(c) for c in ("region_name", "psm", "text")})
    parts = F.array_sort(F.collect_list(F.struct("seq", body.alias("t"))))
    return F.array_join(F.transform(parts, lambda x: x["t"]), "")


def reference_text(obs: DataFrame, keys: list[str] = PAGE) -> DataFrame:
    return obs.groupBy(*keys).agg(page_text(keys).alias("ocr_text"))


def filename_results(files: DataFrame) -> DataFrame:
    """files: file_id, name. What the name alone tells: file_id, name_status, name_code."""
    stem = text.stem_of(F.col("name"))
    good, bad = text.candidates(stem), text.invalid_candidates(stem)
    return files.select(
        "file_id",
        F.when(F.size(good) > 0, notes.SUCCESS).when(F.size(bad) > 0, notes.INVALID).alias("name_status"),
        F.coalesce(F.get(good, F.lit(0)), F.get(bad, F.lit(0))).alias("name_code"),
    )


#: What a file's result is made of, by kind: good, clash, wrong, name, badname, none.
COLUMNS = ["file_id", "status", "container_code", "source", "failure_reason", "review_note", "review_code", "ocr_text"]


def label(x):
    """What was read, as it is named in a result: the region, and how it was segmented where that is known."""
    return F.when(x["psm"].isNull(), x["region_name"]).otherwise(F.concat(x["region_name"], F.lit(":psm"), x["psm"].cast("string")))


def said(x):
    """A reading's part of the reference text."""
    return F.when(regions.is_diagnostic(x["region_name"]), F.concat(F.lit("\n["), x["region_name"], F.lit("]"))).otherwise(F.concat(F.lit("\n["), label(x), F.lit("]\n"), F.coalesce(x["text"], F.lit(""))))


def invalid_of(readings):
    """The invalid code read in most regions, the first seen on ties; null if there is none."""

    def of(pairs):
        names = F.array_distinct(F.transform(pairs, lambda p: p["code"]))
        return F.array_min(F.transform(names, lambda c, i: F.struct((-F.size(F.array_distinct(F.filter(pairs, lambda p: p["code"] == c)))).alias("n"), i.alias("i"), c.alias("code"))))["code"]

    pairs = F.flatten(F.transform(readings, lambda x: F.transform(text.invalid_candidates(x["text"]), lambda c: F.struct(c.alias("code"), x["region"].alias("region")))))
    return codes.let(pairs, of)


def first_steps(obs: DataFrame, priority: int | None, pdf=None) -> DataFrame:
    """file_id, page_no, j (judgement), words, labels, wrong, at_full: each page read in full and then by its first `priority` regions (all, if None), up to where reading stops.

    pdf: a column of obs that says where a code needs two regions (not in fast mode). One aggregation by page.
    """
    extra = ["stage", "region_name", "psm", "text"]
    if pdf is not None:
        obs = obs.withColumn("pdf", pdf)
        extra.append("pdf")
    pages = evidence.gathered(obs.filter(F.col("stage").isin("full", "priority")), PAGE, *extra)
    full, rest = F.filter("readings", lambda x: x["stage"] == "full"), F.filter("readings", lambda x: x["stage"] == "priority")
    pages = pages.select(*PAGE, F.size(full).alias("n_full"), F.concat(full, rest if priority is None else F.slice(rest, 1, priority)).alias("r"))
    needs = F.lit(False) if pdf is None else F.get("r", F.lit(0))["pdf"]
    n_full = F.col("n_full")

    def good(k, j):
        return F.when(k == n_full, F.coalesce((j["score"] >= STRONG) & ~more(needs, j), F.lit(False))).otherwise(evidence.calm(j))

    at = evidence.first_prefix(F.col("r"), F.greatest(n_full, F.lit(1)), good)
    pages = evidence.once(evidence.once(pages, "at", at), "seen", F.when(F.size("r") > 0, F.slice("r", 1, F.coalesce("at", F.size("r")))).otherwise(F.col("r")))
    return evidence.once(pages, "j", evidence.judgement(F.col("seen"))).select(
        *PAGE, "j", needs.alias("pdf"), F.array_join(F.transform("seen", said), "").alias("words"), F.transform("seen", label).alias("labels"), invalid_of(F.col("seen")).alias("wrong"),
    )


def more(pdf, j):
    """Whether a page of a document needs a second region for its code."""
    return F.coalesce(pdf, F.lit(False)) & (j["is_repaired"] | (j["n_regions"] < 2))


def fast_results(files: DataFrame, obs: DataFrame) -> DataFrame:
    """As results() in fast mode: the full page, then three regions until one code is confirmed. All native, one aggregation by page and one pass over a file's pages.

    A page ends the file if the prefix that was read has a selection or the text so far has an invalid code; otherwise the next page goes on.
    """
    pages = first_steps(obs, 3).withColumn("ocr_text", F.array_join(F.collect_list("words").over(Window.partitionBy("file_id").orderBy("page_no")), ""))
    pages = evidence.once(pages, "bad", F.get(text.invalid_candidates(F.col("ocr_text")), F.lit(0)))
    over = F.col("j").isNotNull() | F.col("bad").isNotNull()
    order = F.struct((~over).alias("x"), F.when(over, F.col("page_no")).otherwise(-F.col("page_no")))  # the first that ends the file, else the last
    page = pages.groupBy("file_id").agg(F.min_by(F.struct("j", "ocr_text", "bad", "wrong"), order).alias("p")).select("file_id", "p.*")

    all_ = files.select("file_id", "name").join(merged(page), "file_id", "left").withColumn("ocr_text", F.coalesce("ocr_text", F.lit(""))).join(merged(filename_results(files)), "file_id")
    j = F.col("j")
    code, words_, wrong_ = j["code"], F.col("ocr_text"), F.coalesce("wrong", "bad")
    kind = (
        F.when(code.isNotNull() & ~j["strong"], "good").when(code.isNotNull(), "clash").when(F.col("bad").isNotNull(), "wrong")
        .when(F.col("name_status") == notes.SUCCESS, "name").when(F.col("name_status") == notes.INVALID, "badname").otherwise("none")
    )
    k = F.col("kind")
    named = F.when(k == "wrong", wrong_).otherwise(F.col("name_code"))
    is_wrong = k.isin("wrong", "badname")
    return all_.withColumn("kind", kind).select(
        "file_id",
        F.when(k.isin("good", "name"), notes.SUCCESS).when(k == "none", notes.UNRECOGNIZED).otherwise(notes.INVALID).alias("status"),
        F.when(k.isin("good", "clash"), code).when(k != "none", named).alias("container_code"),
        F.when((k == "good") & j["is_repaired"], "OCR修正").when(k.isin("good", "clash", "wrong"), "OCR").when(k != "none", "文件名").alias("source"),
        F.when(k == "clash", "CONFLICTING_CANDIDATES").when(is_wrong, "INVALID_CHECK_DIGIT").when(k == "none", "NO_CONTAINER_CANDIDATE").alias("failure_reason"),
        F.when((k == "good") & j["is_repaired"], F.concat(F.lit("OCR修正原始片段: "), j["raw"]))
        .when(k == "clash", notes.conflict_note(code, words_)).when(is_wrong, notes.invalid_note(named, words_)).when(k == "none", notes.final_note(words_)).alias("review_note"),
        F.when(k == "clash", code).when(is_wrong, text.review_code_for_invalid(named, words_)).when(k == "none", text.guessed_code(words_)).alias("review_code"),
        words_.alias("ocr_text"),
    )


def settled_early(files: DataFrame, obs: DataFrame) -> DataFrame:
    """Rows of `RESULT` for the files whose first page settles them, in the full page or its regions, in a mode with enhancement: a code without conflict, read in two regions where that is needed.

    Native, one aggregation by page. Files with errors or regions that couldn't be cut are left to the sequential part.
    """
    odd = F.coalesce(regions.is_diagnostic(F.col("region_name")), F.lit(True)) | (F.col("error").isNotNull() if "error" in obs.columns else F.lit(False))
    flagged = obs.select("file_id", "page_no", "seq", "stage", "region_name", "psm", "text", odd.alias("odd_row"))
    first = flagged.groupBy("file_id").agg(F.min("page_no").alias("page_no"), F.bool_or("odd_row").alias("odd")).filter(~F.col("odd")).select("file_id", "page_no")
    pdf = files.select("file_id", (text.suffix_of(F.col("name")) == ".pdf").alias("is_pdf"))
    rows = flagged.drop("odd_row").join(merged(first), PAGE).join(merged(pdf), "file_id")
    pages = first_steps(rows, None, F.col("is_pdf"))
    j = F.col("j")
    good = pages.filter(j.isNotNull() & ~j["strong"] & ~more(F.col("pdf"), j))
    nothing = F.lit(None).cast("string")
    return good.select(
        "file_id", F.lit(notes.SUCCESS).alias("status"), j["code"].alias("container_code"), F.when(j["is_repaired"], "OCR修正").otherwise("OCR").alias("source"), nothing.alias("failure_reason"),
        F.when(j["is_repaired"], F.concat(F.lit("OCR修正原始片段: "), j["raw"])).alias("review_note"), nothing.alias("review_code"), F.col("words").alias("ocr_text"), F.col("labels").alias("readings"),
    )
