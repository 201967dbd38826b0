"""Line deduplication (operator 2, native).

Lines are exploded as hashes of their normalised keys, distinct documents (rows) per hash are counted with
map-side partial sums, and lines whose key reaches the threshold are dropped from every document; the rest
is reassembled by position. Only hashes and positions are exploded, never the lines themselves: the text
moves once, to meet the positions to drop. Keys and texts are named by their MD5.

Defined results: each input row is a document (repeated rows count as often as they occur); null or empty
text is one empty line; columns of any name may be there; keys shorter than `min_chars` never go; a text that loses all lines becomes empty;
an empty table gives no rows. Extra columns stay.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BLANKS, ascii_lower, hottest, on_disk, whole_text


def lines_of(text: Column) -> Column:
    return F.split(text, "\n", -1)


def key_of(line: Column) -> Column:
    edges = F.concat(F.substring(line, 1, 1), F.substring(line, -1, 1))
    return ascii_lower(F.when(F.length(F.translate(edges, BLANKS, "")) < F.length(edges), F.btrim(line, F.lit(BLANKS))).otherwise(line))


def key_hashes(text: Column, min_chars: int) -> Column:
    """For each line the MD5 of its key, null for keys too short to count."""

    def one(line: Column) -> Column:
        k = key_of(line)
        return F.when(F.char_length(k) >= min_chars, F.md5(k))

    return F.transform(lines_of(text), one)


def reassembled(lines: Column, gone: Column) -> Column:
    """The lines outside the positions `gone`, joined: the runs between dropped lines, each taken once."""
    ends = F.concat(F.array_sort(gone), F.array(F.size(lines)))
    before = lambda i: F.when(i == 0, -1).otherwise(F.get(ends, F.greatest(i - 1, F.lit(0))))
    runs = F.transform(ends, lambda e, i: F.slice(lines, before(i) + 2, e - before(i) - 1))
    return F.array_join(F.when(gone.isNull(), lines).otherwise(F.flatten(runs)), "\n")


def dedup_lines(docs: DataFrame, min_docs: int = 10, min_chars: int = 1, text_col: str = "text") -> DataFrame:
    """The rows of `docs` with `text_col` reduced to its kept lines, plus `_n_lines` and `_n_dropped` (in place of columns of these names)."""
    text = whole_text(text_col)
    others = [F.col(c) for c in docs.columns if c != text_col]
    # a row goes by its text and the hash of its other columns, so copies of one text are dealt like other rows; equal rows have equal positions to drop
    named = docs.select((F.struct(*others) if others else F.struct(F.lit(0))).alias("row"), F.md5(text).alias("key"), F.xxhash64(F.lit(1), *others).alias("own"), text.alias("text"))
    by_hash = named.select("key", "own", key_hashes(F.col("text"), min_chars).alias("hs")).select("key", "own", F.array_sort(F.transform("hs", lambda h, i: F.struct(h.alias("h"), i.alias("pos")))).alias("m"))
    first = lambda x, i: F.struct(x.h.alias("h"), x.pos.alias("pos"), ((i == 0) | ~x.h.eqNullSafe(F.get("m", F.greatest(i - 1, F.lit(0)))["h"])).alias("first"))
    # explode_outer: explode() would put a filter below itself and work out the hashes twice. Kept, since count and reassembly read it.
    lines = on_disk(by_hash.select("key", "own", F.explode_outer(F.transform("m", first)).alias("x")).select("key", "own", "x.h", "x.pos", "x.first").filter(F.col("h").isNotNull()))
    often = lines.filter("first").groupBy("h").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= min_docs)
    # the lines that occur most are looked up where they lie; others, each with less than a thousandth of all lines, meet by hash
    most = F.broadcast(hottest(often).select("h"))
    found = lines.join(most, "h", "left_semi").unionByName(lines.join(most, "h", "left_anti").join(often.select("h"), "h", "left_semi"))
    gone = found.groupBy("key", "own").agg(F.collect_set("pos").alias("gone"))
    held = named.join(gone, ["key", "own"], "left").withColumn("lines", lines_of(F.col("text")))
    kept = [c for c in docs.columns if c not in ("_n_lines", "_n_dropped")]
    return held.select(
        *[reassembled(F.col("lines"), F.col("gone")).alias(c) if c == text_col else F.col("row")[c].alias(c) for c in kept],
        F.size("lines").cast("long").alias("_n_lines"),
        F.when(F.col("gone").isNull(), 0).otherwise(F.size("gone")).cast("long").alias("_n_dropped"),
    )
