"""Finding codes in recognised text, as column expressions.

Extractors give arrays of distinct values in order of first appearance. Null text counts as empty.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import codes

# What a clean, an extra-letter and a suspicious reading look like; \s and digits are ASCII.
CLEAN = r"[A-Z]{3}U\s*[0-9]{7}"
EXTRA = r"[A-Z]{4}U\s*[0-9]{7}"
SUSPICIOUS = r"[A-Z0-9]{3}U\s*[A-Z0-9]{7}"
TYPE_CODE = "[0-9]{2}[A-Z][0-9]"
KEYWORDS = "CONTAINER|CNTR|CTNR|CONT|箱号|柜号"
CONTEXT = 24
BASE, REGION_BONUS, TYPE_BONUS, KEYWORD_BONUS, REPAIRED_PENALTY, AGAIN_BONUS = 100, 20, 40, 25, 30, 5

STRINGS = "array<string>"
MATCHES = "array<struct<code:string,raw:string,start:int,stop:int,score:int,is_repaired:boolean>>"


def normalised(text: Column) -> Column:
    return F.translate(F.upper(F.coalesce(text, F.lit(""))), "-_", "  ")


def found(text: Column, pattern: str) -> Column:
    """All matches of a pattern in the normalised text, without blanks."""
    return F.transform(F.regexp_extract_all(normalised(text), F.lit(pattern), F.lit(0)), lambda m: F.regexp_replace(m, r"\s+", ""))


def candidates(text: Column) -> Column:
    """Valid codes."""
    return F.array_distinct(F.filter(found(text, CLEAN), codes.valid_if_clean))


def invalid_candidates(text: Column) -> Column:
    """Well-formed codes with a wrong check digit."""
    return F.array_distinct(F.filter(found(text, CLEAN), lambda c: ~codes.valid_if_clean(c)))


def repaired_candidates(text: Column) -> Column:
    """Valid codes behind an extra letter."""
    return F.array_distinct(F.array_compact(F.transform(found(text, EXTRA), codes.drop_extra_letter)))


def suspicious_candidates(text: Column) -> Column:
    """Readings of the right length that aren't well formed."""
    return F.array_distinct(F.filter(found(text, SUSPICIOUS), lambda c: ~c.rlike(codes.CODE)))


def guess_suggestions(text: Column) -> Column:
    """Distinct (raw, repaired) where letters taken for digits make a valid code."""
    able = F.filter(found(text, SUSPICIOUS), lambda c: c.rlike("^[A-Z]{3}U.*[OILBSZ]"))
    pairs = F.transform(able, lambda c: F.struct(c.alias("raw"), codes.guess_digits(c).alias("repaired")))
    return F.array_distinct(F.filter(pairs, lambda p: p["repaired"].isNotNull()))


def guess_evidence(text: Column) -> Column:
    """guess_suggestions() with the verdict on the repaired code."""
    return F.transform(guess_suggestions(text), lambda p: F.struct(p["raw"].alias("raw"), p["repaired"].alias("repaired"), codes.is_valid(p["repaired"]).alias("repaired_valid")))


def guessed_code(text: Column) -> Column:
    """The only repaired code of guess_suggestions(), if there is just one."""
    return codes.let(F.array_distinct(F.transform(guess_suggestions(text), lambda p: p["repaired"])), lambda all_: F.when(F.size(all_) == 1, F.get(all_, F.lit(0))))


def review_candidates(text: Column, code: Column) -> Column:
    """Codes a person might mean: valid ones, guesses, and single-digit repairs of the given and of all invalid codes."""
    wrong = F.concat(F.when(F.coalesce(code, F.lit("")) != "", F.array(code)).otherwise(F.array().cast(STRINGS)), invalid_candidates(text))
    return F.array_distinct(F.concat(candidates(text), F.transform(guess_suggestions(text), lambda p: p["repaired"]), F.flatten(F.transform(wrong, codes.digit_repairs))))


def review_code_for_invalid(code: Column, text: Column) -> Column:
    return F.coalesce(codes.only_repair(code), guessed_code(text))


def stem_of(name: Column) -> Column:
    """A file name without its last suffix."""
    return F.regexp_replace(name, r"(?<=.)\.[^.]+\z", "")


def suffix_of(name: Column) -> Column:
    """The last suffix, lower case, with its dot; empty if there is none."""
    return F.lower(F.regexp_extract(name, r"(?<=.)(\.[^./]+)\z", 1))


def score(context: Column, region: Column, repaired: bool) -> Column:
    out = F.lit(BASE - REPAIRED_PENALTY if repaired else BASE)
    out = out + F.when(region == "full", 0).otherwise(REGION_BONUS) + F.when(context.rlike(TYPE_CODE), TYPE_BONUS).otherwise(0)
    return (out + F.when(context.rlike(KEYWORDS), KEYWORD_BONUS).otherwise(0)).cast("int")


def scored_matches(text: Column, region: Column, repaired: bool) -> Column:
    """Valid matches in order: struct(code, raw, start, stop, score, is_repaired); start and stop are places in the normalised text."""
    pattern = EXTRA if repaired else CLEAN
    length = lambda parts: F.aggregate(parts, F.lit(0), lambda a, x: a + F.length(x))

    def of(n: Column) -> Column:
        return codes.let(F.regexp_extract_all(n, F.lit(pattern), F.lit(0)), lambda m: F.when(F.size(m) == 0, F.array().cast(MATCHES)).otherwise(codes.let(F.split(n, pattern, -1), lambda between: rows(n, m, between))))

    def rows(n: Column, m: Column, between: Column) -> Column:
        def one(raw: Column, i: Column) -> Column:
            start = length(F.slice(between, 1, i + 1)) + length(F.slice(m, 1, i))
            plain = F.regexp_replace(raw, r"\s+", "")
            code = codes.drop_extra_letter(plain) if repaired else F.when(codes.valid_if_clean(plain), plain)
            return F.struct(code.alias("code"), plain.alias("raw"), start.alias("start"), (start + F.length(raw)).alias("stop"))

        def rated(x: Column) -> Column:
            low = F.greatest(F.lit(0), x["start"] - CONTEXT)
            points = codes.let(F.substr(n, low + 1, x["stop"] + CONTEXT - low), lambda c: score(c, region, repaired))
            return F.struct(x["code"].alias("code"), x["raw"].alias("raw"), x["start"].alias("start"), x["stop"].alias("stop"), points.alias("score"), F.lit(repaired).alias("is_repaired"))

        return F.transform(F.filter(F.transform(m, one), lambda x: x["code"].isNotNull()), rated)

    return codes.let(normalised(text), of)


def context_of(text: Column, start: Column, stop: Column) -> Column:
    """The surroundings of a match that its score looks at."""
    low = F.greatest(F.lit(0), start - CONTEXT)
    return F.substr(normalised(text), low + 1, stop + CONTEXT - low)


def review_scores(base: Column, enhanced: Column, listed: Column, expected: Column | None = None) -> Column:
    """Candidates by review score, highest first, ties in their order: struct(code, score, reasons)."""
    b, e = F.upper(F.coalesce(base, F.lit(""))), F.upper(F.coalesce(enhanced, F.lit("")))

    def one(c: Column, i: Column) -> Column:
        parts = [(F.contains(b, c), 30, "base_valid"), (F.contains(e, c), 90, "enhanced_valid")]
        if expected is not None:
            parts.append((F.array_contains(expected, c), 40, "expected_match"))
        total = sum((F.when(hit, n).otherwise(0) for hit, n, _ in parts), F.lit(0))
        reasons = F.array_compact(F.array(*(F.when(hit, why) for hit, _, why in parts)))
        return F.struct((-total).alias("minus"), i.alias("at"), c.alias("code"), reasons.alias("reasons"))

    return F.transform(F.array_sort(F.transform(listed, one)), lambda x: F.struct(x["code"].alias("code"), (-x["minus"]).cast("int").alias("score"), x["reasons"].alias("reasons")))


def clear_winner(scores: Column, least: Column | int, margin: Column | int) -> Column:
    """The first code of review_scores(), if it has the least score and leads by the margin; else null."""
    first, second = F.get(scores, F.lit(0)), F.get(scores, F.lit(1))
    return F.when((first["score"] >= least) & (second.isNull() | (first["score"] - second["score"] >= margin)), first["code"])
