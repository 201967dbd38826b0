"""Packing token sequences into windows by non-negative least squares (operator 10).

A document's ids are cut into whole windows and one remainder. The plan is made on the histogram of exact lengths, `window` numbers whatever the corpus size. Lengths are rounded up to a multiple of
`QUANTUM` for the least squares only: all combinations of up to `DEPTH` such bins that fill a window exactly are enumerated, non-negative least squares finds how often to use each so that the
bin histogram is met, and the counts are rounded down. Combinations are then carried out with exact lengths, and what rounding leaves free in them is filled with shorter pieces that
are to spare. The rest is packed greedily, largest first; where nothing fits into more than `CUT` free tokens, a piece is cut, at a multiple of `GRAIN`, and its rest goes back to the stock.

Pieces get their slot from their rank within their length; ranks are counted in shards whose sizes are bounded, so that a length that most of the rows have is never in one task.
Text is tokenized once: pieces are kept without ids, with a checksum for every `GRAIN` ids, from which those of cut parts follow.

Defined results: null or empty text is the end token alone; repeated rows are packed as often as they occur; texts of any length work, very short ones are planned with their exact length; an empty
table gives no rows. Padding is counted by padding(): a sequence is padded to the window, unless its length is a power of two.
"""

from __future__ import annotations

from zlib import crc32

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bpe import automaton
from .common import arrow_map, on_disk, whole_text

WINDOW, QUANTUM, DEPTH = 4096, 32, 3
#: Free tokens of a window that are worth a cut, and ids between possible cuts.
CUT, GRAIN = 48, 16
END_ID = 2
#: Pieces of a length in a shard, about.
SHARD_ROWS = 20_000


def cut_pieces(docs: DataFrame, path: str, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, crcs: whole windows from the start, then the remainder, with the checksums of its grains (little-endian, four bytes each)."""

    def one(batch):
        a = automaton(path)
        out = {k: [] for k in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "crcs")}
        end = np.array([END_ID], "<u4").tobytes()
        for doc, ids in zip(batch.column(0).to_pylist(), a.encode(batch.column(1).to_pylist()), strict=True):
            ids += end
            n = len(ids) // 4
            for at in range(0, n, window):
                part = ids[4 * at : 4 * (at + window)]
                size = len(part) // 4
                crcs = None if size == window or size <= GRAIN else np.array([crc32(part[i : i + 4 * GRAIN]) for i in range(0, len(part), 4 * GRAIN)], "<u4").tobytes()
                for k, v in zip(out, (doc, at, size, crc32(part), n, crcs), strict=True):
                    out[k].append(v)
        return out

    return arrow_map(docs.select(F.col(id_col).cast("long"), whole_text(text_col)), one, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, crcs binary")


def part_crc(crcs: bytes, length: int, start: int, size: int) -> int:
    """The checksum of ids start to start + size of a piece of `length` ids, from those of its grains. start is a multiple of GRAIN, and so is the end unless it is the piece's."""
    out = 0
    for at, x in zip(range(0, length, GRAIN), np.frombuffer(crcs, "<u4").tolist(), strict=True):
        if start <= at < start + size:
            zeros = bytes(4 * min(GRAIN, length - at))
            out = crc32(zeros, out) ^ crc32(zeros) ^ x  # the checksum of both is linear in each
    return out


def combinations(bins: int, depth: int) -> list[tuple[int, ...]]:
    """Non-increasing tuples of 1 to `depth` bin numbers with sum `bins`."""
    out, todo = [], [((), bins, bins)]
    while todo:
        head, left, most = todo.pop()
        if left == 0:
            out.append(head)
        elif len(head) < depth:
            slots = depth - len(head)
            todo += [(head + (b,), left - b, b) for b in range(-(-left // slots), min(left, most) + 1)]
    return sorted(out, reverse=True)


def nnls(a: np.ndarray, b: np.ndarray, rounds: int = 0) -> np.ndarray:
    """min |ax - b| over x >= 0 by active sets; `rounds` bounds the outer steps (3 times the rows by default)."""
    n = a.shape[1]
    x, used = np.zeros(n), np.zeros(n, bool)
    tol = 1e-9 * max(1.0, float(np.abs(b).max(initial=0)))
    for _ in range(rounds or 3 * a.shape[0]):
        w = a.T @ (b - a @ x)
        w[used] = -np.inf
        j = int(np.argmax(w))
        if not w[j] > tol:
            break
        used[j] = True
        while True:
            at = np.flatnonzero(used)
            s = np.linalg.lstsq(a[:, at], b, rcond=None)[0]
            if s.min(initial=1) > 0:
                x[:] = 0
                x[at] = s
                break
            low = s <= 0
            step = np.min(x[at][low] / np.maximum(x[at][low] - s[low], 1e-300))
            x[at] += step * (s - x[at])
            used[at[x[at] <= tol * 1e-3]] = False
            x[~used] = 0
            if not used.any():
                break
    return x


class Stock:
    """What is still to be packed: for each length how many pieces, and which: lots (length before any cut, first rank, last rank + 1, where the part starts)."""

    def __init__(self, histogram: dict[int, int], window: int):
        self.count = np.zeros(window + 1, np.int64)
        self.lots: dict[int, list[tuple[int, int, int, int]]] = {}
        for n, k in histogram.items():
            if k:
                self.put(n, (n, 0, k, 0))

    def put(self, length: int, lot: tuple[int, int, int, int]) -> None:
        self.count[length] += lot[2] - lot[1]
        self.lots.setdefault(length, []).append(lot)

    def take(self, length: int, n: int) -> list[tuple[int, int, int, int]]:
        """Lots of n pieces."""
        self.count[length] -= n
        out, held = [], self.lots[length]
        while n:
            own, lo, hi, at = held.pop()
            if hi - lo > n:
                held.append((own, lo + n, hi, at))
                hi = lo + n
            out.append((own, lo, hi, at))
            n -= hi - lo
        return out

    def largest(self, room: int, but: dict[int, int] | None = None) -> int:
        """The largest length up to `room` of which there is more than `but` says; 0 if there is none."""
        some = self.count[: room + 1] > 0
        for n, k in (but or {}).items():
            if n <= room and self.count[n] <= k:
                some[n] = False
        at = np.flatnonzero(some)
        return int(at[-1]) if len(at) else 0


class Plan:
    """Slot rows (length before any cut, from rank, to rank, start of the part, its length, index of the first, first sequence, pieces of a sequence in the row's kind, place of the first of them)."""

    def __init__(self, stock: Stock):
        self.stock, self.rows, self.sequences = stock, [], 0

    def add(self, combo: dict[int, int], n: int, cut: tuple[int, int] | None = None) -> None:
        """n windows with `combo` (length: pieces); cut: a length and how much of one such piece goes in as well; its rest goes back."""
        place = 0
        for length in sorted(combo, reverse=True):
            self.put(self.stock.take(length, n * combo[length]), length, combo[length], place)
            place += combo[length]
        if cut:
            lots = self.stock.take(cut[0], n)
            self.put(lots, cut[1], 1, place)
            for own, lo, hi, at in lots:
                self.stock.put(cut[0] - cut[1], (own, lo, hi, at + cut[1]))
        self.sequences += n

    def put(self, lots: list[tuple[int, int, int, int]], size: int, m: int, place: int) -> None:
        index = 0
        for own, lo, hi, at in lots:
            self.rows.append((own, lo, hi, at, size, index, self.sequences, m, place))
            index += hi - lo


def solved(counts: np.ndarray, bins: int, depth: int) -> list[tuple[tuple[int, ...], int]]:
    """Combinations of bins that fill a window, with whole repeat counts that the bin counts allow."""
    left = counts.copy()
    combos = [c for c in combinations(bins, depth) if len(c) > 1]
    a = np.zeros((bins, len(combos)))
    for k, c in enumerate(combos):
        for b in c:
            a[b - 1, k] += 1
    x = nnls(a, left[1:].astype(float))
    out = []
    for k in np.argsort(-x, kind="stable"):
        need = {b: combos[k].count(b) for b in combos[k]}
        n = min([int(np.floor(x[k] + 1e-6)), *(int(left[b]) // m for b, m in need.items())])
        if n > 0:
            out.append((combos[k], n))
            for b, m in need.items():
                left[b] -= n * m
    return out


def plan(histogram: dict[int, int], window: int, quantum: int = QUANTUM, depth: int = DEPTH, cut: int = CUT) -> list[tuple[int, ...]]:
    """Slot rows (see Plan) that place each piece of the histogram of lengths. cut: free tokens above which pieces are cut; 0 for never."""
    stock = Stock(histogram, window)
    out = Plan(stock)
    count = stock.count
    if count[window]:
        out.add({window: 1}, int(count[window]))
    if not count.any():
        return out.rows
    bins = window // quantum
    of = -(-np.arange(window + 1) // quantum)
    held = np.bincount(of, weights=count, minlength=bins + 1).astype(np.int64)[: bins + 1]
    wanted = solved(held, bins, depth)
    spare = held.copy()  # of each bin what no combination needs
    for combo, n in wanted:
        for b in combo:
            spare[b] -= n
    for combo, n in wanted:
        while n:
            use: dict[int, int] = {}
            for b in combo:  # the longest pieces of a bin first
                own = range(b * quantum, (b - 1) * quantum, -1)
                length = next(x for x in own if count[x] > use.get(x, 0))
                use[length] = use.get(length, 0) + 1
            room = window - sum(x * m for x, m in use.items())
            extra: dict[int, int] = {}
            while room:
                busy = {x: use.get(x, 0) + extra.get(x, 0) for x in {*use, *extra}}
                taken = np.bincount(of[list(extra)], weights=list(extra.values()), minlength=bins + 1) if extra else 0
                open_ = (count[: room + 1] > 0) & ((spare - taken) > 0)[of[: room + 1]]
                for x, m in busy.items():
                    if x <= room and count[x] <= m:
                        open_[x] = False
                at = np.flatnonzero(open_)
                if not len(at):
                    break
                length = int(at[-1])
                extra[length] = extra.get(length, 0) + 1
                room -= length
            whole = {x: use.get(x, 0) + extra.get(x, 0) for x in {*use, *extra}}
            times = min([n, *(int(count[x]) // m for x, m in whole.items())])
            for b in {int(of[x]) for x in extra}:
                times = min(times, int(spare[b]) // sum(m for x, m in extra.items() if of[x] == b))
            out.add(whole, times)
            for x, m in extra.items():
                spare[of[x]] -= times * m
            n -= times
    while count.any():  # each turn uses up a length, or ends with a window that occurs once
        room, use = window, {}
        while room and (length := stock.largest(room, use)):
            m = int(min(count[length] - use.get(length, 0), room // length))
            use[length] = use.get(length, 0) + m
            room -= length * m
        part = None
        if cut and room > cut and (length := stock.largest(window, use)):
            part = length, room // GRAIN * GRAIN
            room -= part[1]
        need = dict(use)
        if part:
            need[part[0]] = need.get(part[0], 0) + 1
        out.add(use, min(int(count[x]) // m for x, m in need.items()), part)
    return out.rows


def pack(pieces: DataFrame, window: int = WINDOW, quantum: int = QUANTUM, depth: int = DEPTH) -> DataFrame:
    """`pieces` (with `length` from 1 to `window`) plus `sequence_id` and `offset`. With the columns of cut_pieces(), `crcs` is used to cut pieces further, and goes.

    `pieces` is read several times: hand over a table that is kept.
    """
    spark = pieces.sparkSession
    names = [c for c in pieces.columns if c != "crcs"]
    cut = CUT if "crcs" in pieces.columns else 0
    histogram = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}  # `window` rows at most
    rows = plan(histogram, window, quantum, depth, cut)
    parts = spark.createDataFrame([(k, -(-n // SHARD_ROWS)) for k, n in histogram.items()], "length long, _parts int")
    dealt = pieces.join(F.broadcast(parts), "length").withColumn("_shard", F.pmod(F.xxhash64(*names), "_parts").cast("int")).drop("_parts")
    counts = dealt.groupBy("length", "_shard").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("length").orderBy("_shard").rowsBetween(Window.unboundedPreceding, -1)
    firsts = counts.select("length", "_shard", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_first"))
    ranked = dealt.withColumn("_at", F.row_number().over(Window.partitionBy("length", "_shard").orderBy(*names)) - 1).join(firsts, ["length", "_shard"]).withColumn("_rank", F.col("_at") + F.col("_first"))
    # the plan's rows follow from the histogram, whatever the corpus size
    where = spark.createDataFrame(rows, "_b long, _lo long, _hi long, _from long, _size long, _index long, _seq long, _m long, _place long")
    placed = ranked.join(F.broadcast(where), (F.col("length") == F.col("_b")) & (F.col("_rank") >= F.col("_lo")) & (F.col("_rank") < F.col("_hi")))
    nth = F.col("_rank") - F.col("_lo") + F.col("_index")
    placed = placed.withColumn("sequence_id", F.col("_seq") + F.floor(nth / F.col("_m"))).withColumn("_slot", F.col("_place") + nth % F.col("_m"))
    if cut and any(r[4] < r[0] for r in rows):
        placed = parted(placed, names)
    order = Window.partitionBy("sequence_id").orderBy("_slot").rowsBetween(Window.unboundedPreceding, -1)
    return placed.select(*names, "sequence_id", F.coalesce(F.sum("length").over(order), F.lit(0)).cast("long").alias("offset"))


def parted(placed: DataFrame, names: list[str]) -> DataFrame:
    """Rows that stand for a part of a piece get its start, length and checksum."""

    def one(batch):
        crc = [part_crc(*r) for r in zip(*(batch.column(c).to_pylist() for c in ("crcs", "length", "_from", "_size")), strict=True)]
        at, part = batch.column("start").to_numpy(), batch.column("_from").to_numpy()
        return {n: batch.column(n) for n in held} | {"start": at + part, "length": batch.column("_size"), "ids_crc32": crc}

    held = [*names, "sequence_id", "_slot"]
    whole = placed.filter("_size = length").select(*held)
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in whole.schema)
    return whole.unionByName(arrow_map(placed.filter("_size < length"), one, kinds))


def pack_documents(docs: DataFrame, path: str, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    return pack(on_disk(cut_pieces(docs, path, window, id_col, text_col)), window)


def padding(packed: DataFrame, window: int = WINDOW) -> DataFrame:
    """One row: sequences, tokens, padded."""
    n = F.col("n")
    per = packed.groupBy("sequence_id").agg(F.sum("length").alias("n"))
    return per.agg(F.count(F.lit(1)).alias("sequences"), F.sum("n").alias("tokens"), F.sum(F.when(n.bitwiseAND(n - 1) == 0, 0).otherwise(F.lit(window) - n)).alias("padded"))
