"""Exact deduplication by content-defined chunk recipes (operator 9, native).

Every text is cut into chunks whose ends depend on the line before them alone, so an insertion moves no later end. Cuts are positions in the list of lines: nothing is put
into the text, and a text's chunks, one after another, are the text itself, so two texts have equal chunks only if they are equal. Chunks are deduplicated to verified
identifiers: a 64-bit hash names a chunk, and its SHA-256 verifies the name, so that two chunks that share the 64 bits get
different identifiers. A document's recipe is its ordered identifier list, and documents are equal when
their recipes are. Texts are read where they lie and never shuffled: only recipes move.

A chunk or recipe that a third of all rows has is among the thousand most frequent ones; the rows of those are dealt to several tasks (common.spread_join), and counts are
partial sums.

Defined results: null text counts as empty; empty texts form one group; a null doc_id is smaller than any
other; of rows with equal text and equal doc_id, exactly one is marked kept; control characters and marks of any kind are text like any other; an empty table gives no rows.
Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import hot_keys, spread_join, whole_text

#: One line in so many ends a chunk; longer chunks are cut at so many characters.
LINES, MAX_CHUNK = 8, 4096


def line_ends(lines: Column, every: int = LINES) -> Column:
    """Numbers of the lines that end a chunk: one in `every` by hash, and the last."""
    marked = F.transform(lines, lambda x, i: F.when((F.pmod(F.xxhash64(x), F.lit(every)) == 0) | (i == F.size(lines) - 1), i))
    return F.filter(marked, lambda i: i.isNotNull())


def cut_at(lines: Column, ends: Column, largest: int = MAX_CHUNK) -> Column:
    """The chunks: runs of lines with the line ends between and before them; concatenated, they are the text. Every text has one at least."""
    before = lambda j: F.when(j == 0, -1).otherwise(F.get(ends, F.greatest(j - 1, F.lit(0))))
    run = lambda e, j: F.array_join(F.slice(lines, before(j) + 2, e - before(j)), "\n")
    parts = F.transform(ends, lambda e, j: F.when(j == 0, run(e, j)).otherwise(F.concat(F.lit("\n"), run(e, j))))
    cut = lambda p: F.when(F.length(p) <= largest, F.array(p)).otherwise(F.regexp_extract_all(p, F.lit(f"(?s).{{1,{largest}}}"), F.lit(0)))
    return F.flatten(F.transform(parts, cut))


def chunked(docs: DataFrame) -> DataFrame:
    """docs: text and others. Adds `chunks`. Each step is read by the next one more than once, so that none is worked out inside the next."""
    lines = docs.withColumn("_lines", F.split("text", "\n", -1))
    return lines.withColumn("_ends", line_ends(F.col("_lines"))).withColumn("chunks", cut_at(F.col("_lines"), F.col("_ends"))).drop("_lines", "_ends")


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, keep_id, group_size, kept, text_sha256."""
    held = docs.select(F.col(id_col).cast("long").alias("doc_id"), whole_text(text_col).alias("text"))
    named = F.transform("chunks", lambda c: F.struct(F.xxhash64(c).alias("h"), F.sha2(c, 256).alias("s")))
    used = (
        chunked(held)
        .select("doc_id", F.sha2("text", 256).alias("text_sha256"), F.posexplode_outer(named).alias("pos", "c"))  # the outer form works the chunks out once: no filter goes below it
        .select("doc_id", "text_sha256", "pos", "c.h", "c.s")
    )
    # identifier (h, v): v tells apart chunks whose h is the same and whose SHA-256 is not
    known = used.groupBy("h", "s").agg(F.count(F.lit(1)).alias("n"))
    verified = known.groupBy("h").agg(F.array_sort(F.collect_list(F.struct("s", "n"))).alias("all")).select("h", F.posexplode("all").alias("v", "x")).select("h", "x.s", "v", "x.n")
    recipes = (
        spread_join(used, verified.drop("n"), ["h", "s"], ["doc_id", "text_sha256", "pos"], hot_keys(verified, ["h", "s"]))
        .groupBy("doc_id", "text_sha256")
        .agg(
            F.transform(F.array_sort(F.collect_set(F.struct("pos", "h", "v"))), lambda x: F.struct(x.h.alias("h"), x.v.alias("v"))).alias("recipe"),
            F.sum((F.col("pos") == 0).cast("long")).alias("copies"),
        )
    )
    # lists are compared here, whole; their digest only brings the group back to its rows
    groups = recipes.groupBy("recipe").agg(F.max("doc_id").alias("keep_id"), F.sum("copies").alias("group_size"), F.count(F.lit(1)).alias("n"))
    digest = F.sha2(F.to_json("recipe"), 256)
    of = groups.select(digest.alias("r"), "keep_id", "group_size", "n")
    return (
        spread_join(recipes.select("doc_id", "text_sha256", "copies", digest.alias("r")), of.drop("n"), ["r"], ["doc_id", "text_sha256"], hot_keys(of, ["r"]))
        .select("doc_id", "keep_id", "group_size", "text_sha256", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("nth"))
        .select(F.col("doc_id").alias(id_col), "keep_id", "group_size", (F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("nth") == 1)).alias("kept"), "text_sha256")
    )
