"""Exact removal of repeated byte strings by induced suffix sorting (operator 8).

Every `length`-byte string has an anchor: its smallest hash of `length / 4` bytes, the first one on ties. Equal strings have equal anchors, so text is dealt to shards by
anchor: a run of starts that share an anchor value, with the bytes it covers, is a segment. Anchors that occur once can't belong to a repeat and end there, before
any text moves. Segments that occur as a whole more than once are repeats as they are, by hash. What is left, the different segments of an anchor, is sorted by suffix in shards of
bounded size (suffixes.py): neighbours in suffix order whose common prefix reaches `length` are repeats.

An anchor with more than `HOT` different segments (a passage at other places in a third of all texts, say) isn't put in one shard. Its starts are split by distance to the anchor into
ranges; strings of one range share a core, and cores that occur once end there; the others are split further, down to single strings. Rows stay in proportion to the segments.

Spans are worked out on the input. A start is an offset in UTF-8 bytes; matches don't cross documents.

Defined results: null text is empty; texts shorter than `length` stay as they are; rows that share doc_id and text share their spans, and are repeats of one another;
an empty table gives no rows; extra columns stay.
"""

from __future__ import annotations

from hashlib import blake2b
from struct import unpack

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, compact, hot_keys, looked_up, on_disk, ship, spread_join, trim, whole_text, worker_table
from .near_dedup import mixed
from .suffixes import repeated

LENGTH = 400
#: Different segments of an anchor beyond which it is split; bytes of a shard; starts in a segment of periodic text; bytes of text a worker hashes at once.
HOT, SHARD_BYTES, RUN, PART = 4096, 2_000_000, 4096, 750_000
#: Segments with their bytes in a file, about.
PIECE_ROWS = 60_000
NO_ID = -(1 << 63)
CODES = np.random.default_rng(11).integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
STEP = 0x9E3779B97F4A7C15


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """STEP ** i and its inverse, modulo 2 ** 64, for i < n at least."""
    size = max(1 << max(16, int(n - 1).bit_length()), 1 << 20)
    back = pow(STEP, -1, 1 << 64)
    return worker_table(("powers", size), lambda: tuple(np.concatenate([[np.uint64(1)], np.cumprod(np.full(size - 1, s, np.uint64), dtype=np.uint64)]) for s in (STEP, back)))


def sums_of(flat: np.ndarray) -> np.ndarray:
    up, _ = powers(len(flat) + 1)
    return np.concatenate([np.zeros(1, np.uint64), np.cumsum(CODES[flat] * up[: len(flat)], dtype=np.uint64)])


def digest(part: bytes) -> tuple[int, int]:
    """Names bytes where equality is decided: 128 bits of BLAKE2b."""
    return unpack("<qq", blake2b(part, digest_size=16).digest())


def gram_hashes(sums: np.ndarray, k: int) -> np.ndarray:
    """A hash of every k-byte string. It only has to be the same for equal strings: what differs and shares a hash meets in a shard, where bytes are compared."""
    n = len(sums) - k
    _, down = powers(len(sums))
    return mixed((sums[k:] - sums[:n]) * down[:n])


def smallest(h: np.ndarray, width: int) -> np.ndarray:
    """For each i the least of h[i : i + width]."""
    m, w = h, 1
    while 2 * w <= width:
        m = np.minimum(m[: len(m) - w], m[w:])
        w *= 2
    if w < width:
        m = np.minimum(m[: len(m) - (width - w)], m[width - w :])
    return m


def segments(texts: list[bytes], length: int) -> tuple[np.ndarray, ...]:
    """(text, first start, starts, anchor value, two halves of the segment's digest, whether the value occurs twice in it), for all segments of all texts."""
    sizes = np.array([len(t) for t in texts])
    none = tuple(np.zeros(0, t) for t in (*[np.int64] * 6, bool))
    if not len(sizes) or sizes.max() < length:
        return none
    flat = np.frombuffer(b"".join(texts), np.uint8)
    gram = max(1, length // 4)
    width = length - gram + 1
    sums = sums_of(flat)
    h = gram_hashes(sums, gram)
    low = smallest(h, width)
    first = np.cumsum(sizes) - sizes
    owner = np.repeat(np.arange(len(sizes)), sizes)[: len(low)]
    valid = np.arange(len(low)) + length <= (first + sizes)[owner]
    begins = valid & np.concatenate([[True], ~valid[:-1] | (low[1:] != low[:-1]) | (owner[1:] != owner[:-1])])
    ends = valid & np.concatenate([begins[1:] | ~valid[1:], [True]])
    lo, hi = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    # where the values of the runs occur, in order of value and place
    value = low[lo]
    known = np.unique(value)
    at = np.flatnonzero(h <= known[-1])
    rank = np.searchsorted(known, h[at])
    at, rank = at[known[rank] == h[at]], rank[known[rank] == h[at]]
    place = np.sort(rank * np.int64(len(h) + 1) + at)
    own = np.searchsorted(known, value) * np.int64(len(h) + 1)
    twice = np.searchsorted(place, own + hi - 1 + width) - np.searchsorted(place, own + lo) > 1
    # runs of periodic text are cut; every part of one has its value twice or belongs to a run that has
    parts = -(-(hi - lo) // RUN)
    if parts.max() > 1:
        nth = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
        lo, hi, value, twice = (np.repeat(x, parts) for x in (lo, hi, value, twice))
        lo = lo + nth * RUN
        hi = np.minimum(hi, lo + RUN)
    text = owner[lo]
    whole = memoryview(flat)
    names = np.array([digest(whole[a:b]) for a, b in zip(lo.tolist(), (hi - 1 + length).tolist(), strict=True)], np.int64).reshape(-1, 2)
    return text, lo - first[text], hi - lo, value.view(np.int64), names[:, 0], names[:, 1], twice


def anchored(docs: DataFrame, length: int) -> DataFrame:
    """docs: did, ka, nb, text. All segments: v, seg, seg2, did, ka, nb, lo, n, twice."""

    def one(batch):
        import pyarrow as pa

        cols = [batch.column(i) for i in range(3)]
        raw = [t.encode("utf-8") for t in batch.column(3).to_pylist()]
        got = [[] for _ in range(7)]
        at = 0
        while at < len(raw):
            to, size = at, 0
            while to < len(raw) and (to == at or size < PART):
                size += len(raw[to])
                to += 1
            for g, x in zip(got, segments(raw[at:to], length), strict=True):
                g.append(x + at if g is got[0] else x)
            at = to
        text, lo, n, v, seg, seg2, twice = (np.concatenate(g) for g in got)
        idx = pa.array(text)
        return {"v": v, "seg": seg, "seg2": seg2, "did": cols[0].take(idx), "ka": cols[1].take(idx), "nb": cols[2].take(idx), "lo": lo.astype(np.int32), "n": n.astype(np.int32), "twice": twice}

    return arrow_map(docs, one, "v long, seg long, seg2 long, did long, ka long, nb int, lo int, n int, twice boolean")


def shard_spans(pieces: DataFrame, length: int, shard_bytes: int) -> DataFrame:
    """pieces: v, seg, seg2, copies, did, ka, nb, lo, n, piece. Runs of repeated starts of the pieces that have no copy."""
    import pyarrow as pa

    ship(pieces.sparkSession)
    total = pieces.agg(F.sum(F.octet_length("piece"))).first()[0] or 0

    def run(group):
        import pyarrow.compute as pc

        keys = group.select(["v", "seg", "seg2"]).to_pandas()
        group = group.take(pa.array(np.flatnonzero(~keys.duplicated().to_numpy())))
        flags = repeated(group.column("piece").to_pylist(), length)
        out = {"row": [], "lo": [], "n": []}
        for i, (f, lo, copies) in enumerate(zip(flags, group.column("lo").to_pylist(), group.column("copies").to_pylist(), strict=True)):
            if copies > 1 or not f.any():
                continue
            edge = np.flatnonzero(np.diff(np.concatenate([[0], f.view(np.int8), [0]])))
            for a, b in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True):
                out["row"].append(i), out["lo"].append(lo + a), out["n"].append(b - a)
        rows = pa.array(out["row"], pa.int64())
        own = {c: pc.take(group.column(c), rows) for c in ("did", "ka", "nb")}
        trim()
        return pa.table(own | {"lo": pa.array(out["lo"], pa.int32()), "n": pa.array(out["n"], pa.int32())})

    shard = F.pmod(F.xxhash64("v"), F.lit(int(total // shard_bytes) + 1))
    return pieces.withColumn("shard", shard).groupBy("shard").applyInArrow(run, "did long, ka long, nb int, lo int, n int")


def split_spans(pieces: DataFrame, length: int) -> DataFrame:
    """As shard_spans() for anchors with very many segments: ranges of distances to the anchor, split in seven at a time."""
    gram = max(1, length // 4)
    width = length - gram + 1
    top = 1
    while top < width:
        top *= 7
    ident = ["v", "seg", "seg2", "did", "ka", "nb", "lo"]
    live = pieces.withColumn("from", F.lit(0))
    found = []
    while top > 1:
        step = top // 7

        def one(batch, step=step):
            import pyarrow as pa

            out = {k: [] for k in ("row", "from", "core", "core2", "sub", "sub2", "at", "n")}
            for i, (v, piece, frm) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("v", "piece", "from")), strict=True)):
                flat = np.frombuffer(piece, np.uint8)
                sums = sums_of(flat)
                hits = np.flatnonzero(gram_hashes(sums, gram) == np.array([v], np.int64).view(np.uint64)[0])
                starts = np.arange(len(flat) - length + 1)
                anchor = hits[np.searchsorted(hits, starts)]
                far = anchor - starts
                own = np.flatnonzero((far >= frm) & (far < frm + 7 * step))
                if not len(own):
                    continue
                kind = far[own] // step
                cut = np.flatnonzero((kind[1:] != kind[:-1]) | (anchor[own][1:] != anchor[own][:-1])) + 1
                for part in np.split(own, cut):
                    a, low = int(anchor[part[0]]), int(far[part[0]] // step * step)
                    # inside every string of the range; the piece's own starts may reach further
                    core = piece[max(a - low, 0) : a - (low + step - 1) + length]
                    whole = int(a - part[0]).to_bytes(8, "little") + piece[part[0] : part[-1] + length]
                    for k, x in zip(out, (i, low, *digest(core), *digest(whole), int(part[0]), len(part)), strict=True):
                        out[k].append(x)
            rows = pa.array(out["row"], pa.int64())
            return {c: batch.column(c).take(rows) for c in (*ident, "copies")} | {k: np.array(out[k], np.int64) for k in ("from", "core", "core2", "sub", "sub2", "at", "n")}

        kinds = "v long, seg long, seg2 long, did long, ka long, nb int, lo int, copies long, from long, core long, core2 long, sub long, sub2 long, at long, n long"
        rows = compact(arrow_map(live.select(*ident, "copies", "from", "piece"), one, kinds, PART), "split")
        key = ["v", "from", "core", "core2"]
        groups = rows.groupBy(*key).agg(F.sum("copies").alias("all"), F.min(F.struct("sub", "sub2")).alias("s1"), F.max(F.struct("sub", "sub2")).alias("s2"), F.count(F.lit(1)).alias("m")).filter(F.col("all") > 1)
        kept = spread_join(rows, groups.drop("m"), key, ident, looked_up(hot_keys(groups, key, "m")))
        done = (F.col("s1") == F.col("s2")) if step > 1 else F.lit(True)
        found.append(kept.filter(done & (F.col("copies") == 1)).select("did", "ka", "nb", (F.col("lo") + F.col("at")).cast("int").alias("lo"), F.col("n").cast("int").alias("n")))
        live = kept.filter(~done).select(*ident, "from").distinct().join(pieces, ident) if step > 1 else None
        top = step
    out = found[0]
    for f in found[1:]:
        out = out.union(f)
    return out


def repeated_spans(docs: DataFrame, length: int = LENGTH, hot: int = HOT, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """docs: did, ka, nb, text. did, ka, nb, spans (first start and number of starts of repeated strings), for documents that have any."""
    rows = on_disk(anchored(docs.filter(F.col("nb") >= length), length))
    again = rows.groupBy("v").agg(F.count(F.lit(1)).alias("total"), F.max("twice").alias("t")).filter("total > 1 or t").select("v")
    held = on_disk(rows.join(again, "v", "left_semi"))
    at = F.struct("did", "ka", "nb", "lo", F.col("n").alias("starts"))
    kinds = compact(held.groupBy("v", "seg", "seg2").agg(F.count(F.lit(1)).alias("copies"), F.max("twice").alias("twice"), F.min(at).alias("at")), "kinds")
    again = kinds.filter("copies > 1")
    whole = spread_join(held, again.select("v", "seg", "seg2"), ["v", "seg", "seg2"], ["did", "ka", "lo"], looked_up(hot_keys(again, ["v", "seg", "seg2"], "copies"))).select("did", "ka", "nb", "lo", "n")
    groups = kinds.groupBy("v").agg(F.count(F.lit(1)).alias("different"), F.count_if(F.col("copies") == 1).alias("single"), F.max("twice").alias("t")).filter("single > 0 and (different > 1 or t)").select("v", "different")
    need = compact(spread_join(kinds, groups, ["v"], ["seg"], looked_up(hot_keys(groups, ["v"], "different"))).select("v", "seg", "seg2", "copies", "different", "at.did", "at.ka", "at.nb", "at.lo", F.col("at.starts").alias("n")), "need")
    parts = [whole]
    if not need.isEmpty():
        cut = F.substring(F.col("text").cast("binary"), F.col("lo") + 1, F.col("n") + length - 1)
        pieces = compact(need.join(docs.filter(F.col("nb") >= length), ["did", "ka", "nb"]).select("v", "seg", "seg2", "copies", "different", "did", "ka", "nb", "lo", "n", cut.alias("piece")), "pieces", None, PIECE_ROWS)
        parts.append(shard_spans(pieces.filter(F.col("different") <= hot), length, shard_bytes))
        many = pieces.filter(F.col("different") > hot)
        if not many.isEmpty():
            parts.append(split_spans(many.dropDuplicates(["v", "seg", "seg2"]), length))
    spans = parts[0]
    for p in parts[1:]:
        spans = spans.union(p)
    return spans.groupBy("did", "ka", "nb").agg(F.array_sort(F.collect_set(F.struct("lo", "n"))).alias("spans"))


def removed(spans: list[dict] | None, length: int) -> list[tuple[int, int]]:
    """Maximal runs of bytes to remove, from sorted (first start, number of starts)."""
    out: list[list[int]] = []
    for s in spans or ():
        lo, hi = s["lo"], s["lo"] + s["n"] - 1 + length
        if out and lo <= out[-1][1]:
            out[-1][1] = max(out[-1][1], hi)
        else:
            out.append([lo, hi])
    return [(a, b) for a, b in out]


def dedup_substrings(docs: DataFrame, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text", as_text: bool = False, **bounds) -> DataFrame:
    """The rows of `docs` without the text, plus `_kept` (binary: the bytes outside all spans) and `_spans` (maximal removed runs, start and end).

    as_text: `_kept` is a string instead, and what is left of a character that a span cut in two is left out.
    """
    text = whole_text(text_col)
    keys = [F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("did"), F.xxhash64(text).alias("ka"), F.octet_length(text).alias("nb")]
    spans = compact(repeated_spans(docs.select(*keys, text.alias("text")), length, **bounds), "spans", None, PIECE_ROWS)
    rows = docs.select(F.struct(*[c for c in docs.columns if c != text_col]).alias("_rest"), text.alias("_text"), *keys).join(spans, ["did", "ka", "nb"], "left").select("_rest", "_text", "spans")

    def one(batch):
        import pyarrow as pa

        kept, cuts = [], []
        for t, s in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
            raw = t.encode("utf-8")
            runs = removed(s, length)
            edges = [0, *(x for r in runs for x in r), len(raw)]
            left = b"".join(raw[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True)) if runs else raw
            kept.append(left.decode("utf-8", "ignore") if as_text else left)
            cuts.append([{"start": a, "end": b} for a, b in runs])
        return {"_rest": batch.column(0), "_kept": kept, "_spans": pa.array(cuts, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))}

    kind = rows.schema["_rest"].dataType.simpleString()
    out = arrow_map(rows, one, f"_rest {kind}, _kept {'string' if as_text else 'binary'}, _spans array<struct<start:long,end:long>>")
    return out.select("_rest.*", "_kept", "_spans")

