"""Container codes (ISO 6346) as column expressions: check digit, validity, repairs.

All functions take and return Columns made of built-in expressions, so they stay in generated code and can be pushed down.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values. A character's place in VALUES is its value: letters skip multiples of 11.
VALUES = "0123456789A_BCDEFGHIJK_LMNOPQRSTU_VWXYZ"
CODE = r"^[A-Z]{3}U[0-9]{7}\z"
CODE10 = r"^[A-Z]{3}U[0-9]{6}\z"
#: Letters that readers take for digits, and the digits.
CONFUSED, MEANT = "OILBSZ", "011852"

LENGTH, FIRST_DIGIT = 11, 4


def let(value: Column, use) -> Column:
    """use(value), with the value worked out once: an expression that is named several times would otherwise be repeated each time."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def canonical(c: Column) -> Column:
    return F.upper(F.trim(c))


def digit_of(code10: Column) -> Column:
    """The check digit of ten characters known to be well formed."""
    total = sum(((F.position(F.substr(code10, F.lit(i + 1), F.lit(1)), F.lit(VALUES)) - 1) * (1 << i) for i in range(10)), F.lit(0))
    return (total % 11) % 10


def digit_once(code10: Column) -> Column:
    """digit_of() with one reference to its argument: for long expressions, which would be repeated for each character."""
    weights = F.array(*(F.lit(1 << i) for i in range(10)))
    values = F.zip_with(F.split(code10, ""), weights, lambda x, w: (F.position(x, F.lit(VALUES)) - 1) * w)
    return F.aggregate(values, F.lit(0), lambda a, x: a + x) % 11 % 10


def check_digit(code10: Column) -> Column:
    """The check digit of three letters, U and six digits; null for anything else."""
    c = canonical(code10)
    return F.when(c.rlike(CODE10), digit_of(c)).cast("int")


def is_valid(code: Column) -> Column:
    """Whether the code is well formed and its last digit is its check digit; false for null."""
    c = canonical(code)
    return F.coalesce(c.rlike(CODE) & (digit_of(c) == F.substr(c, F.lit(LENGTH), F.lit(1)).cast("int")), F.lit(False))


def valid_if_clean(c: Column) -> Column:
    """is_valid() for strings that match CODE already."""
    return digit_of(c) == F.substr(c, F.lit(LENGTH), F.lit(1)).cast("int")


def drop_extra_letter(raw: Column) -> Column:
    """A twelve-character code with an extra I after its first letter, without it, if that is valid; else null."""
    short = F.concat(F.substr(raw, F.lit(1), F.lit(1)), F.substr(raw, F.lit(3)))
    return F.when((F.length(raw) == LENGTH + 1) & (F.substr(raw, F.lit(2), F.lit(1)) == "I"), let(short, lambda s: F.when(s.rlike(CODE) & valid_if_clean(s), s)))


def guess_digits(raw: Column) -> Column:
    """The code with letters in its serial number taken for the digits they resemble, if that changes it and makes it valid; else null."""
    meant = F.concat(F.substr(raw, F.lit(1), F.lit(FIRST_DIGIT)), F.translate(F.substr(raw, F.lit(FIRST_DIGIT + 1)), CONFUSED, MEANT))
    return F.when(raw.rlike("^[A-Z]{3}U"), let(meant, lambda m: F.when((m != raw) & m.rlike(CODE) & valid_if_clean(m), m)))


def digit_repairs(code: Column) -> Column:
    """All valid codes that differ from a well-formed one in one of the six serial digits; by place, then digit."""

    def of(c: Column) -> Column:
        def with_digit(i: Column, d: Column) -> Column:
            return F.concat(F.substr(c, F.lit(1), i), d.cast("string"), F.substr(c, i + 2))

        tries = F.flatten(F.transform(F.sequence(F.lit(FIRST_DIGIT), F.lit(9)), lambda i: F.transform(F.sequence(F.lit(0), F.lit(9)), lambda d: with_digit(i, d))))
        return F.when(c.rlike(CODE), F.filter(tries, lambda t: (t != c) & valid_if_clean(t))).otherwise(F.array().cast("array<string>"))

    return let(canonical(code), of)


def only_repair(code: Column) -> Column:
    """The repair of digit_repairs(), if there is just one."""
    return let(digit_repairs(code), lambda r: F.when(F.size(r) == 1, F.get(r, F.lit(0))))


def longest_shared_run(a: Column, b: Column) -> Column:
    """Length of the longest substring of a (7 characters at most) that b contains."""
    spans = [(s, n) for n in range(1, 8) for s in range(1, 9 - n)]
    return F.greatest(*(F.when((F.length(a) >= s + n - 1) & (F.position(F.substr(a, F.lit(s), F.lit(n)), b) > 0), n).otherwise(0) for s, n in spans))


def is_related(invalid: Column, enhanced: Column) -> Column:
    """Whether an enhanced reading may stand for an invalid one: one of its repairs, or the same owner and five digits in a row."""
    run = longest_shared_run(F.substr(invalid, F.lit(5)), F.substr(enhanced, F.lit(5)))
    alike = (F.length(invalid) == LENGTH) & (F.length(enhanced) == LENGTH) & (F.left(invalid, F.lit(4)) == F.left(enhanced, F.lit(4))) & (run >= 5)
    return F.array_contains(digit_repairs(invalid), enhanced) | alike
