"""Exact top-k search by inner product on a bit-sliced index (operator 3).

Vector components are quantised to integers. A block of candidates is kept as bit slices: for dimension d and bit b, a bitmap
with the rows whose (component - least of the block) has bit b. A query's scores against the whole block are added up as
bitmaps: for every bit of the query's components, the slices of that dimension are added, shifted, by carry-save adders on whole
bitmaps; a negative component takes the complemented slices. The k largest are selected from the most significant score slice downward; rows that
are still tied at the boundary are resolved exactly, by smallest id. Blocks' lists are merged by (score descending, id ascending).

Candidates are dealt to groups of bounded size by hash. A task gets a group's candidates first, builds their index once, and then meets the queries as a stream (a
stated query set against all rows, in blocks); it returns at most k rows for each query. No task has all candidates, and none holds all queries.

Defined results: vectors that are null, empty, or hold null or non-finite components take no part on either side; vectors whose length differs
from the query's aren't its candidates; a query's own row (by vec_id) is none of its candidates; repeated vec_ids take part as often as they
occur, as candidates, and a query that occurs more than once is answered once, by the smallest of its vectors; a null vec_id takes no part; fewer than k candidates give fewer rows.
Any finite components are right: large ones are reckoned with as whole numbers of any size, and a score beyond the range of a long is ranked as it is and shown as the end of that range.
"""

from __future__ import annotations

from math import floor, isfinite

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import ship

SCALE = 1024
#: Rows of a candidate group, about.
GROUP_ROWS = 8_192
#: Components beyond this are kept as Python's integers.
WIDE = 2.0**40
LEAST, MOST = -(1 << 63), (1 << 63) - 1


class Slices:
    """The bit-sliced index of one block: rows sorted by id."""

    def __init__(self, ids: np.ndarray, values: np.ndarray):
        order = np.argsort(ids, kind="stable")
        self.ids, values = ids[order], values[order]
        self.rows, self.dims = values.shape
        self.least = values.min(0)
        up = values - self.least
        self.bits = max(1, int(up.max()).bit_length())
        self.words = -(-self.rows // 64)
        self.full = self.pack(np.ones(self.rows, bool))
        self.slices = [[self.pack(((up[:, d] >> b) & 1).astype(bool)) for b in range(self.bits)] for d in range(self.dims)]

    def pack(self, flags: np.ndarray) -> np.ndarray:
        out = np.zeros(self.words * 8, np.uint8)
        got = np.packbits(flags.astype(bool), bitorder="little")
        out[: len(got)] = got
        return out.view(np.uint64)

    def unpack(self, bitmap: np.ndarray) -> np.ndarray:
        return np.flatnonzero(np.unpackbits(bitmap.view(np.uint8), count=self.rows, bitorder="little"))

    def add(self, query: np.ndarray) -> tuple[list[np.ndarray], int]:
        """Score slices, least significant first, and what is to be added to them: score = slices + base."""
        base = 0
        at: list[list[np.ndarray]] = []  # bitmaps by weight
        for d in range(self.dims):
            q = int(query[d])
            if not q:
                continue
            # q * v = q * least + |q| * u, or, for q < 0, q * (least + top) + |q| * (top - u), where top - u is the complement of u
            top = (1 << self.bits) - 1
            base += q * (int(self.least[d]) + (top if q < 0 else 0))
            rows = [x ^ self.full for x in self.slices[d]] if q < 0 else self.slices[d]
            for s in range(abs(q).bit_length()):
                if abs(q) >> s & 1:
                    while len(at) < s + self.bits:
                        at.append([])
                    for b, x in enumerate(rows):
                        at[s + b].append(x)
        out, w = [], 0
        while w < len(at):
            here = at[w]
            if len(here) > 1 and w + 1 == len(at):
                at.append([])
            i = 0
            while len(here) - i > 1:
                if len(here) - i > 2:
                    a, b, c = here[i : i + 3]
                    x = a ^ b
                    here.append(x ^ c)
                    at[w + 1].append((a & b) | (x & c))
                    i += 3
                else:
                    a, b = here[i : i + 2]
                    here.append(a ^ b)
                    at[w + 1].append(a & b)
                    i += 2
            out.append(here[i] if here else np.zeros(self.words, np.uint64))
            w += 1
        return out, base

    def top(self, query: np.ndarray, k: int, but: int) -> list[tuple[int, int]]:
        """The k best (score, id), best first, without rows whose id is `but`."""
        score, base = self.add(query)
        own = self.pack((self.ids == but))
        maybe, sure = self.full & ~own, np.zeros(self.words, np.uint64)
        have = 0
        for x in reversed(score):
            with_bit = maybe & x
            n = int(np.bitwise_count(with_bit).sum())
            if have + n <= k:  # all of them are in
                sure |= with_bit
                have += n
                maybe &= ~x
            else:
                maybe = with_bit
            if have == k:
                break
        # what is left has equal scores: rows are in id order, so the first ones go in
        rows = np.concatenate([self.unpack(sure), self.unpack(maybe)[: k - have] if have < k else np.zeros(0, np.int64)])
        total = [base] * len(rows)
        for w, x in enumerate(score):
            for i, bit in enumerate(((x[rows // 64] >> (rows % 64).astype(np.uint64)) & np.uint64(1)).tolist()):
                total[i] += bit << w
        return sorted(zip(total, self.ids[rows].tolist(), strict=True), key=lambda t: (-t[0], t[1]))


def taking_part(vectors: DataFrame) -> DataFrame:
    """vec_id, v: the vectors that take part, as doubles."""
    v = F.col("embedding")
    fine = F.col("vec_id").isNotNull() & v.isNotNull() & (F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vectors.filter(fine).select(F.col("vec_id").cast("long"), v.cast("array<double>").alias("v"))


def quantised(values: np.ndarray, scale: int = SCALE) -> np.ndarray:
    """floor(scale * x) for finite doubles: 64-bit integers, or Python's where some are large."""
    if np.abs(values).max(initial=0) < WIDE:
        return np.floor(values * scale).astype(np.int64)
    return np.array([[floor(x * scale) if isfinite(x * scale) else int(x) * scale for x in row] for row in values.tolist()], object).reshape(values.shape)


def indexed(ids: np.ndarray, vectors: list[np.ndarray], scale: int) -> dict[int, list[Slices]]:
    """Indexes of a group by length of vector; vectors with large components have one of their own."""
    out: dict[int, list[Slices]] = {}
    size = np.array([len(v) for v in vectors])
    for n in np.unique(size).tolist():
        at = np.flatnonzero(size == n)
        values = np.stack([vectors[i] for i in at.tolist()])
        wide = np.abs(values).max(1) >= WIDE
        out[n] = [Slices(ids[at[part]], quantised(values[part], scale)) for part in (~wide, wide) if part.any()]
    return out


def beyond(score: int) -> bytes | None:
    """Where a score outside the range of a long stands among others that show as the same end of it: bytes in the order of the scores."""
    if LEAST <= score <= MOST:
        return None
    n = (abs(score).bit_length() + 7) // 8
    m = n.to_bytes(2, "big") + abs(score).to_bytes(n, "big")
    return b"\2" + m if score > 0 else b"\0" + bytes(255 - x for x in m)


def search(vectors: DataFrame, k: int = 10, every: int = 100, scale: int = SCALE) -> DataFrame:
    """query_id, rank, vec_id, score for the rows whose vec_id is divisible by `every`."""
    import pyarrow as pa

    ship(vectors.sparkSession)
    rows = taking_part(vectors)
    few = rows.filter(F.col("vec_id") % every == 0).groupBy("vec_id").agg(F.min("v").alias("v"))
    groups = max(1, -(-rows.count() // GROUP_ROWS))
    candidates = rows.select(F.pmod(F.xxhash64(F.lit(2), "vec_id", "v"), F.lit(groups)).cast("int").alias("g"), F.lit(False).alias("q"), "vec_id", "v")
    queries = few.select(F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("g"), F.lit(True).alias("q"), "vec_id", "v")

    def run(batches):
        now, ids, held, index = None, [], [], None
        for batch in batches:
            g, q, own = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
            lists = batch.column(3)
            flat, at = lists.flatten().to_numpy(), np.asarray(lists.offsets)
            at = at - at[0]
            out: list[tuple[int, int, int]] = []
            for i in range(batch.num_rows):
                if g[i] != now:
                    now, ids, held, index = g[i], [], [], None
                vector = flat[at[i] : at[i + 1]]
                if not q[i]:
                    ids.append(own[i]), held.append(vector)
                    continue
                if index is None:
                    index = indexed(np.array(ids, np.int64), held, scale)
                    ids, held = [], []
                found: list[tuple[int, int]] = []
                for part in index.get(len(vector), ()):
                    found += part.top(quantised(vector[None], scale)[0], k, own[i])
                out += [(own[i], c, s) for s, c in sorted(found, key=lambda t: (-t[0], t[1]))[:k]]
            cols = list(zip(*out, strict=True)) or [[], [], []]
            shown = [min(max(x, LEAST), MOST) for x in cols[2]]
            yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in (cols[0], cols[1], shown)), pa.array([beyond(x) for x in cols[2]], pa.binary())], names=["query_id", "vec_id", "score", "beyond"])

    each = candidates.unionByName(queries).repartition(groups, "g").sortWithinPartitions("g", "q", "vec_id")
    found = each.mapInArrow(run, "query_id long, vec_id long, score long, beyond binary")
    within = F.coalesce("beyond", F.lit(b"\1"))
    best = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), within.desc(), "vec_id"))
    return found.withColumn("rank", best).filter(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
