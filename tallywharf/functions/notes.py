"""Messages, notes, names and small conversions, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import codes, text

# The closed domains and the wording that results must carry.
SUCCESS, UNRECOGNIZED, INVALID = "正确识别", "未识别", "箱号错误"
STATUSES = [SUCCESS, UNRECOGNIZED, INVALID]
SOURCES = ["OCR", "OCR修正", "OCR增强", "文件名", "人工修正"]
RECOGNIZED, REVIEW_HIT, MISSING = "已识别", "待确认命中", "缺失"
DUPLICATE = "DUPLICATE_CONTAINER_CODE"
DUPLICATE_PREFIX = "重复箱号冲突："
CROP_FAILED, CROP_SKIPPED, READ_FAILED = "区域裁剪失败", "区域裁剪跳过", "区域 OCR 失败"
CROP_NOTE = "区域裁剪失败/跳过，可能图片损坏或无法读取区域"
READ_NOTE = "部分区域 OCR 失败，已跳过失败区域并继续识别"
OMITTED = "……（其余候选已省略）"
NO_MISSING = "无缺失箱号"
LONGEST_NOTE, LISTED = 240, 8
GENERAL_REASONS = [
    (("permission", "denied"), "结果表可能正在被 Excel/WPS 打开，或输出目录无写入权限: "),
    (("poppler", "pdf"), "PDF 转图片失败，可能文件损坏、加密或格式异常: "),
    (("tesseract", "ocr"), "OCR 组件处理失败，可能图片无法读取或 OCR 依赖异常: "),
]
CODED_REASONS = [
    ("INVALID_CHECK_DIGIT", "识别到疑似箱号，但校验位不正确，需要人工复核"),
    ("CONFLICTING_CANDIDATES", "同一文件出现多个候选箱号，需要人工确认"),
    ("DUPLICATE_CONTAINER_CODE", "多个文件识别为同一箱号，需要逐一核对"),
    ("INSUFFICIENT_CANDIDATE_EVIDENCE", "识别到合法候选，但交叉验证证据不足，需要人工确认"),
    ("NO_CONTAINER_CANDIDATE", "未找到符合箱号格式的文本"),
    ("NO_CONTAINER_CODE", "未找到符合箱号格式的文本"),
]
STATUS_NAMES = {
    "success": SUCCESS,
    "recognized": SUCCESS,
    "unrecognized": UNRECOGNIZED,
    "invalid": INVALID,
    SUCCESS: SUCCESS,
    UNRECOGNIZED: UNRECOGNIZED,
    INVALID: INVALID,
}
TRUE_WORDS = ["1", "true", "yes", "y"]
ERROR_MARKERS = ["错误", "失败", "异常", "缺失", "无法", "未识别", "PermissionError"]


def _none(c: Column) -> Column:
    return F.coalesce(c, F.lit("")) == ""


def humanised(reason: Column) -> Column:
    """A failure reason for people: general causes first, then coded reasons, else the reason; empty for none."""
    low = F.lower(reason)
    out = reason
    for code, words in reversed(CODED_REASONS):
        out = F.when(F.contains(reason, F.lit(code)), words).otherwise(out)
    for marks, words in reversed(GENERAL_REASONS):
        hit = F.contains(low, F.lit(marks[0])) | F.contains(low, F.lit(marks[1]))
        out = F.when(hit, F.concat(F.lit(words), reason)).otherwise(out)
    return F.when(_none(reason), "").otherwise(out)


def joined(note: Column, addition: Column) -> Column:
    """The addition after the note, parted by a full-width semicolon; either alone if the other is missing."""
    return F.when(_none(note), addition).when(_none(addition), note).otherwise(F.concat(note, F.lit("；"), addition))


def with_reason(note: Column, reason: Column) -> Column:
    return codes.let(humanised(reason), lambda why: F.when(why == "", note).when(_none(note), why).when(F.contains(note, why), note).otherwise(F.concat(note, F.lit("；"), why)))


def shortened(note: Column) -> Column:
    cut = F.regexp_replace(F.left(note, F.lit(LONGEST_NOTE)), r"[ ,;，；]+\z", "")
    return F.when(_none(note), "").when(F.char_length(note) <= LONGEST_NOTE, note).otherwise(F.concat(cut, F.lit(OMITTED)))


def display_note(status: Column, note: Column, reason: Column) -> Column:
    short = shortened(note)
    return F.when(status == SUCCESS, short).otherwise(F.coalesce(with_reason(short, reason), F.lit("")))


def display_code(status: Column, code: Column, review_code: Column) -> Column:
    return F.when((status != SUCCESS) & ~_none(review_code), review_code).otherwise(F.coalesce(code, F.lit("")))


def listed(values: Column, limit: int = LISTED) -> Column:
    """Distinct values parted by commas, the first `limit`, with their number if there are more."""

    def of(d: Column) -> Column:
        shown = F.array_join(F.slice(d, 1, limit), ", ")
        return F.when(F.size(d) > limit, F.concat(shown, F.lit(" 等 "), F.size(d).cast("string"), F.lit(" 个"))).otherwise(shown)

    return codes.let(F.array_distinct(values), of)


def suspicious_note(words: Column) -> Column:
    """What looks like a code in the text, and what it may mean; null if nothing does."""


    def second(pairs: Column) -> Column:
        meant = F.when(F.size(pairs) == 1, F.get(pairs, F.lit(0))["repaired"]).otherwise(listed(F.transform(pairs, lambda p: F.concat(p["raw"], F.lit("->"), p["repaired"]))))
        return F.when(F.size(pairs) > 0, F.concat(F.lit("可能修正: "), meant, F.lit("（未自动采用）")))

    first = codes.let(text.suspicious_candidates(words), lambda some: F.when(F.size(some) > 0, F.concat(F.lit("疑似候选: "), listed(some))))
    return F.nullif(F.concat_ws("；", first, codes.let(text.guess_suggestions(words), second)), F.lit(""))


def conflict_note(code: Column, words: Column) -> Column:
    first = F.concat(F.lit("候选冲突，需人工复核: "), code)
    return codes.let(text.suspicious_candidates(words), lambda some: F.concat_ws("；", first, F.when(F.size(some) > 0, F.concat(F.lit("疑似候选: "), listed(some)))))


def repair_note(code: Column) -> Column:
    """The single-digit repairs of a code; null if there are none."""

    def of(r: Column) -> Column:
        one = F.concat(F.lit("疑似校验修正: "), code, F.lit(" -> "), F.get(r, F.lit(0)), F.lit("（待人工确认）"))
        return F.when(F.size(r) == 1, one).when(F.size(r) > 1, F.concat(F.lit("多个疑似校验修正候选（未自动采用）: "), listed(r)))

    return codes.let(codes.digit_repairs(code), of)


def final_note(words: Column) -> Column:
    failed = F.contains(words, F.lit(CROP_FAILED)) | F.contains(words, F.lit(CROP_SKIPPED))
    return F.coalesce(suspicious_note(words), F.when(failed, CROP_NOTE), F.when(F.contains(words, F.lit(READ_FAILED)), READ_NOTE))


def invalid_note(code: Column, words: Column) -> Column:
    return F.nullif(F.concat_ws("；", repair_note(code), final_note(words)), F.lit(""))


def duplicate_note(code: Column, n: Column) -> Column:
    return F.concat(F.lit(DUPLICATE_PREFIX + "同一批次有 "), n.cast("string"), F.lit(" 个文件识别为 "), code, F.lit("，需人工确认"))


def with_duplicate_note(note: Column, addition: Column) -> Column:
    """The note's parts without earlier duplicate notes, and the new one; parted by a semicolon and a blank."""
    parts = F.transform(F.split(F.coalesce(note, F.lit("")), "; ", -1), lambda p: F.trim(p))
    kept = F.filter(parts, lambda p: (p != "") & ~F.startswith(p, F.lit(DUPLICATE_PREFIX)))
    return F.array_join(F.concat(kept, F.array(addition)), "; ")


def target_name(name: Column, status: Column, code: Column, review_code: Column) -> Column:
    """The file name of a result: its code, or its review code marked as unconfirmed, or as it was."""
    suffix = F.regexp_extract(name, r"(?<=.)(\.[^./]+)\z", 1)
    by_code = F.when((status == SUCCESS) & ~_none(code), F.concat(code, suffix))
    by_review = F.when(status.isin(UNRECOGNIZED, INVALID) & ~_none(review_code), F.concat(review_code, F.lit("-待确认"), suffix))
    return F.coalesce(by_code, by_review, name)


def as_bool(c: Column) -> Column:
    return F.coalesce(F.lower(F.trim(c)).isin(TRUE_WORDS), F.lit(False))


def as_status(c: Column) -> Column:
    """A status from its name or alias; null for anything else."""
    out = F.lit(None).cast("string")
    for k, v in STATUS_NAMES.items():
        out = F.when(F.lower(F.trim(c)) == k, v).otherwise(out)
    return out


def known(c: Column, domain: list[str]) -> Column:
    return F.when(c.isin(domain), c)


def optional(c: Column) -> Column:
    return F.nullif(c.cast("string"), F.lit(""))


def optional_int(c: Column) -> Column:
    return F.coalesce(F.expr("null").cast("int") if c is None else c.try_cast("int"), F.lit(0))


def first_segment(name: Column) -> Column:
    """The first part of a nested path; empty for a plain name."""
    return F.when(F.contains(name, F.lit("/")), F.split_part(name, F.lit("/"), F.lit(1))).otherwise("")


def duration(seconds: Column) -> Column:
    s = F.greatest(seconds.cast("long"), F.lit(0))
    two = lambda x: F.lpad(x.cast("string"), 2, "0")
    h, m, r = F.floor(s / 3600), F.floor(s % 3600 / 60), s % 60
    return F.when(h > 0, F.concat_ws(":", F.when(h < 100, two(h)).otherwise(h.cast("string")), two(m), two(r))).otherwise(F.concat_ws(":", two(m), two(r)))


def journal_name(path: Column) -> Column:
    """The name of a path's journal: twenty hexadecimal digits."""
    return F.substring(F.sha2(F.lower(path), 256), 1, 20)


def log_tag(message: Column, markers: list[str] | None = None) -> Column:
    hit = F.lit(False)
    for m in markers or ERROR_MARKERS:
        hit = hit | F.contains(message, F.lit(m))
    return F.when(hit, "error").otherwise("info")


def result_message(name: Column, status: Column, code: Column, reason: Column) -> Column:
    detail = F.coalesce(F.nullif(code, F.lit("")), F.nullif(reason, F.lit("")), F.lit("无箱号"))
    return F.concat(F.lit("结果: "), name, F.lit(" -> "), status, F.lit(" ("), detail, F.lit(")"))
