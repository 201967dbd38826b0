"""Near-duplicate detection: MinHash bands, Bayesian sequential verification, exact confirmation (operator 6).

Documents are sets of distinct five-word shingles (64-bit names, mixed from 64-bit names of words by functions that aren't linear in the bytes). Documents with equal sets form a class, and only one row of a class goes on.
Signatures are cut into bands; classes that share a band are in one bucket.

Buckets never give all their pairs. First, each member is paired with the smallest member of a bucket: the one it shares most buckets with, and others only as long as they lie
in other components. A pair's signatures are compared a batch at
a time, and the pair is pruned once the posterior probability that its similarity reaches the threshold (uniform prior, so a binomial tail) falls below `MISS`;
survivors are confirmed on the full shingle sets, recomputed from the texts concerned. Components follow, and only buckets whose members still lie in
different components go on: there, members of different components are compared signature against signature in blocks of bounded size, and survivors are confirmed, inside tasks that
return links only, as many as join what belongs together. So no link is left out for the size of a bucket: a pair that shares a band is compared, unless its members are in one component already.
A link at the threshold shares no band with a probability below `LOST`.

Defined results: null text is empty; a set without shingles is linked with nothing; fewer words than `words` make one shingle; rows with a
null doc_id take no part (component null, kept); columns of any name may be there; words of any length count; rows that share a doc_id are searched and grouped each by its own set (groups whose smallest id is the same then show
the same component_id); an empty table gives no rows.
"""

from __future__ import annotations

from hashlib import blake2b
from math import comb

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, compact, hot_keys, in_files, light, looked_up, ship, spread_join, trim, whole_text, written
from .components import components

WORDS, HASHES, BATCH = 5, 192, 32
#: Probability of pruning a pair at the threshold, and of a link at the threshold that shares no band.
MISS, LOST = 1e-9, 1e-6
#: Members of a block of a bucket, and bytes of their sets, about.
BLOCK, BLOCK_BYTES = 512, 8_000_000
#: Bytes of text that are shingled at once.
PART = 1_500_000

LOWERED = np.arange(256, dtype=np.uint8)
LOWERED[ord("A") : ord("Z") + 1] += 32
BLANK = np.zeros(256, bool)
BLANK[[9, 10, 11, 12, 13, 32]] = True
_rng = np.random.default_rng(20_240_601)
STEP = np.uint64(0x9E3779B97F4A7C15)
PLACES = _rng.integers(0, 1 << 63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
FIRST, SECOND = (_rng.integers(0, 1 << 31, (2, HASHES), dtype=np.uint32) * np.uint32(2) + np.uint32(1)).astype(np.uint32)
#: Words of more bytes are named by BLAKE2b.
LONG_WORD = 512


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection on 64 bits that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_names(flat: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """64-bit names of the words flat[first:last]: eight bytes at a time are mixed into the state, which isn't linear in any of them; very long words by a cryptographic hash."""
    size = last - first
    out = mixed(size.astype(np.uint64) * STEP)
    eight = np.lib.stride_tricks.sliding_window_view(np.concatenate([flat, np.zeros(8, np.uint8)]), 8)
    live, k = np.flatnonzero(size <= LONG_WORD), 0
    while len(live):
        lane = eight[first[live] + k].view(np.uint64)[:, 0]
        short = np.minimum(size[live] - k, 8).astype(np.uint64)
        lane &= np.uint64(0xFFFFFFFFFFFFFFFF) >> (np.uint64(64) - np.uint64(8) * short)
        out[live] = mixed((out[live] ^ lane) + STEP)
        k += 8
        live = live[size[live] > k]
    for i in np.flatnonzero(size > LONG_WORD).tolist():
        out[i] = int.from_bytes(blake2b(flat[first[i] : last[i]].tobytes(), digest_size=8).digest(), "little")
    return out


def shingles(texts: list[str], words: int = WORDS) -> list[np.ndarray]:
    """For each text the sorted distinct hashes of its shingles."""
    raw = [t.encode("utf-8") for t in texts]
    flat = LOWERED[np.frombuffer(b"\n".join(raw) + b"\n", np.uint8)]
    blank = BLANK[flat]
    first = np.flatnonzero(~blank & np.concatenate([[True], blank[:-1]]))
    last = np.flatnonzero(~blank & np.concatenate([blank[1:], [True]])) + 1
    word = word_names(flat, first, last)
    ends = np.cumsum([len(r) + 1 for r in raw])
    cut = np.searchsorted(first, np.concatenate([[0], ends]))
    n = len(word)
    full = np.zeros(n, np.uint64)
    if n >= words:
        for k in range(words):
            full[: n - words + 1] = mixed(full[: n - words + 1] * STEP + word[k : n - words + 1 + k] * PLACES[k])
    out = []
    for lo, hi in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
        m = hi - lo
        if m >= words:
            out.append(np.unique(full[lo : hi - words + 1]))
        elif m:
            h = np.full(1, m, np.uint64)
            for k in range(m):
                h = mixed(h * STEP + word[lo + k : lo + k + 1] * PLACES[k])
            out.append(h)
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def signature(sets: np.ndarray) -> bytes:
    """HASHES minima as unsigned 32-bit integers."""
    hi, lo = (sets >> np.uint64(32)).astype(np.uint32), sets.astype(np.uint32)
    out = np.full(HASHES, 0xFFFFFFFF, np.uint32)
    for at in range(0, len(sets), 1024):
        np.minimum(out, (hi[at : at + 1024, None] * FIRST + lo[at : at + 1024, None] * SECOND).min(0), out=out)
    return out.tobytes()


def digests(batch_texts: list[str], words: int, signed: bool = True):
    """(number of shingles, digest of the set, signature if it is wanted) for each text, a part at a time."""
    lo = 0
    while lo < len(batch_texts):
        hi, size = lo, 0
        while hi < len(batch_texts) and (hi == lo or size < PART):
            size += len(batch_texts[hi])
            hi += 1
        for s in shingles(batch_texts[lo:hi], words):
            yield len(s), blake2b(s.tobytes(), digest_size=16).digest(), signature(s) if len(s) and signed else None
        lo = hi


def banding(threshold: float, lost: float = LOST) -> tuple[int, int]:
    """(rows, bands): the most rows of a band at which a link at the threshold is missed with less than `lost`."""
    for rows in range(16, 0, -1):
        if (1 - threshold**rows) ** (HASHES // rows) <= lost:
            return rows, HASHES // rows
    return 1, HASHES


def least_matches(threshold: float, miss: float = MISS, batch: int = BATCH) -> list[int]:
    """For n = batch, 2 * batch, ...: with fewer matches among n, P(similarity >= threshold) is below `miss`.

    With a uniform prior, P(S >= t | m of n) = P(Binomial(n + 1, t) <= m).
    """
    out = []
    for n in range(batch, HASHES + 1, batch):
        tail, m = 0.0, -1
        while True:
            tail += comb(n + 1, m + 1) * threshold ** (m + 1) * (1 - threshold) ** (n - m)
            m += 1
            if tail >= miss:
                break
        out.append(m)
    return out


def survive(a: np.ndarray, b: np.ndarray, least: list[int], batch: int = BATCH) -> np.ndarray:
    """Which rows of signatures a and b are not pruned; -1 or the number of matches."""
    agree = np.zeros(len(a), np.int64)
    live = np.arange(len(a))
    for k, m in enumerate(least):
        cols = slice(k * batch, (k + 1) * batch)
        agree[live] += (a[live, cols] == b[live, cols]).sum(1)
        live = live[agree[live] >= m]
    out = np.full(len(a), -1, np.int64)
    out[live] = agree[live]
    return out


def signed(col, n: int) -> np.ndarray:
    return np.frombuffer(b"".join(col.to_pylist()), np.uint32).reshape(n, HASHES)


def sketches(docs: DataFrame, words: int = WORDS, id_col: str = "doc_id", text_col: str = "text", with_sig: bool = True) -> DataFrame:
    """doc_id, n_shingles, set_key, sig (null where it isn't wanted)."""

    def one(batch):
        n, key, sig = zip(*digests(batch.column(1).to_pylist(), words, with_sig), strict=True)
        return {"doc_id": batch.column(0), "n_shingles": list(n), "set_key": list(key), "sig": list(sig)}

    return arrow_map(docs.select(F.col(id_col).cast("long"), whole_text(text_col)), one, "doc_id long, n_shingles long, set_key binary, sig binary")


def both_ends(pairs: DataFrame, things: DataFrame, x: str, y: str) -> DataFrame:
    """pairs (a, b), a stored table, with the `x` of things (id, x) for either end; a centre b of many pairs is dealt to several tasks."""
    few = looked_up(hot_keys(pairs.groupBy("b").agg(F.count(F.lit(1)).alias("n")), ["b"]))
    return spread_join(pairs.join(things.select(F.col("id").alias("a"), F.col("x").alias(x)), "a"), things.select(F.col("id").alias("b"), F.col("x").alias(y)), ["b"], ["a"], few)


def pruned(pairs: DataFrame, sigs: DataFrame, least: list[int]) -> DataFrame:
    """Of distinct pairs (a, b), those that the batches leave, with their matches."""

    def one(batch):
        a, b = signed(batch.column(2), batch.num_rows), signed(batch.column(3), batch.num_rows)
        agree = survive(a, b, least)
        on = np.flatnonzero(agree >= 0)
        return {"a": batch.column(0).take(on), "b": batch.column(1).take(on), "agree": agree[on]}

    both = both_ends(pairs, sigs.select("id", F.col("sig").alias("x")), "sa", "sb")
    return arrow_map(both.select("a", "b", "sa", "sb"), one, "a long, b long, agree long", PART)


def shared_with(own: np.ndarray, sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of a sorted set with each of several sets."""
    flat = np.concatenate(sets)
    at = np.minimum(np.searchsorted(own, flat), len(own) - 1)
    ends = np.cumsum([len(x) for x in sets])
    hits = np.concatenate([[0], np.cumsum(own[at] == flat)])
    return hits[ends] - hits[ends - [len(x) for x in sets]]


def block_links(members: DataFrame, sigs: DataFrame, sets: DataFrame, least: list[int], percent: int, rows_: int) -> DataFrame:
    """members: band, k (which band), id, comp, n (members of the bucket), size (shingles of its members). Links (a > b) between different components of a bucket, as many as join what belongs together.

    A bucket of up to BLOCK members and BLOCK_BYTES of sets is one cell; a larger one is dealt to blocks, and each pair of blocks is a cell. Within its task a cell compares each row's signature with those of all
    later components, leaves out pairs that share an earlier band (another cell has them), and confirms survivors on the full sets, the likeliest first, unless links found before join the two.
    """
    import pyarrow as pa

    ship(members.sparkSession)
    blocks = F.greatest(F.ceil(F.col("n") / BLOCK), F.ceil(8 * F.col("size") / BLOCK_BYTES)).cast("int")
    own = F.pmod(F.xxhash64("id"), blocks).cast("int")
    cells = F.transform(F.sequence(F.lit(0), blocks - 1), lambda j: F.struct(F.least(own, j).alias("i"), F.greatest(own, j).alias("j")))
    rows = members.select("band", "k", "id", "comp", own.alias("own"), F.explode(cells).alias("cell")).join(sigs.select("id", "sig"), "id").join(sets.select("id", "s"), "id")

    def run(group):
        n = group.num_rows
        order = np.argsort(group.column("comp").to_numpy(), kind="stable")
        ids, comps, own_ = (group.column(c).to_numpy()[order] for c in ("id", "comp", "own"))
        sig = signed(group.column("sig"), n)[order]
        full = group.column("s").to_pylist()
        full = [np.frombuffer(full[i], np.uint64) for i in order.tolist()]
        cell, k = group.column("cell")[0].as_py(), group.column("k")[0].as_py()
        starts = np.flatnonzero(np.concatenate([[True], comps[1:] != comps[:-1]]))
        number = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, n)))
        up = np.arange(len(starts))  # components joined so far
        a, b = [], []
        for at in range(n):
            later = starts[number[at] + 1] if number[at] + 1 < len(starts) else n
            rest = np.arange(later, n)
            if cell["i"] != cell["j"]:
                rest = rest[own_[rest] != own_[at]]
            rest = rest[up[number[rest]] != up[number[at]]]
            if not len(rest):
                continue
            agree = survive(np.broadcast_to(sig[at], (len(rest), HASHES)), sig[rest], least)
            rest, agree = rest[agree >= 0], agree[agree >= 0]
            if k and len(rest):
                same = (sig[rest, : k * rows_] == sig[at, : k * rows_]).reshape(len(rest), k, rows_).all(2).any(1)
                rest, agree = rest[~same], agree[~same]
            rest = rest[np.argsort(-agree, kind="stable")]
            for lo in range(0, len(rest), 64):
                part = rest[lo : lo + 64]
                part = part[up[number[part]] != up[number[at]]]
                if not len(part):
                    continue
                inter = shared_with(full[at], [full[i] for i in part.tolist()])
                union = len(full[at]) + np.array([len(full[i]) for i in part.tolist()]) - inter
                for r in part[100 * inter >= percent * union].tolist():
                    x, y = up[number[at]], up[number[r]]
                    if x != y:
                        a.append(max(ids[at], ids[r])), b.append(min(ids[at], ids[r]))
                        up[up == max(x, y)] = min(x, y)
        trim()
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return rows.groupBy("band", "cell").applyInArrow(run, "a long, b long")


def full_sets(ids: DataFrame, most: int, texts: DataFrame, words: int, names: DataFrame | None = None) -> DataFrame:
    """id, s: the shingle sets of documents in `ids` (distinct, at most `most`), from their texts. names (id, doc, set_key): where rows share a doc_id, what ids stand for."""

    def sets(batch):
        texts_, out, lo = batch.column(1).to_pylist(), [], 0
        while lo < len(texts_):
            hi, size = lo, 0
            while hi < len(texts_) and (hi == lo or size < PART):
                size += len(texts_[hi])
                hi += 1
            out += [s.tobytes() for s in shingles(texts_[lo:hi], words)]
            lo = hi
        return {"id": batch.column(0), "s": out, "key": [blake2b(s, digest_size=16).digest() for s in out]}

    named = None if names is None else names.join(light(ids, most), "id", "left_semi")
    docs = ids if named is None else named.select(F.col("doc").alias("id")).distinct()
    full = arrow_map(texts.select("id", "text").join(light(docs, most), "id", "left_semi"), sets, "id long, s binary, key binary")
    if named is not None:
        full = full.join(named.select(F.col("id").alias("own"), F.col("doc").alias("id"), F.col("set_key").alias("key")), ["id", "key"]).select(F.col("own").alias("id"), "s", "key")
    return full.groupBy("id").agg(F.min_by("s", "key").alias("s"))


def confirmed(pairs: DataFrame, most: int, texts: DataFrame, percent: int, words: int, names: DataFrame | None = None) -> DataFrame:
    """Of pairs (a, b), a kept table of at most `most` rows, those with 100 * intersection >= percent * union on full sets. texts: id, text; names as in full_sets()."""
    full = full_sets(pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct(), 2 * most, texts, words, names)

    def same(batch):
        on = []
        for i, (x, y) in enumerate(zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)):
            x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
            both = np.concatenate([x, y])
            both.sort()
            inter = int((both[1:] == both[:-1]).sum())
            if 100 * inter >= percent * (len(x) + len(y) - inter):
                on.append(i)
        on = np.array(on, np.int64)
        return {"a": batch.column(0).take(on), "b": batch.column(1).take(on)}

    both = both_ends(pairs.select("a", "b"), full.select("id", F.col("s").alias("x")), "sa", "sb")
    return compact(arrow_map(both.select("a", "b", "sa", "sb"), same, "a long, b long"), "links", most)


def across(pairs: DataFrame, comp: DataFrame | None) -> DataFrame:
    """Pairs whose ends lie in different components."""
    if comp is None:
        return pairs
    at = lambda c: comp.select(F.col("node").alias(c), F.col("comp").alias(f"c{c}"))
    held = pairs.join(at("a"), "a", "left").join(at("b"), "b", "left")
    return held.filter(F.coalesce("ca", "a") != F.coalesce("cb", "b")).select(*pairs.columns)


def near_sets(docs: DataFrame, percent: int, words: int, id_col: str, text_col: str) -> DataFrame:
    """For each set of shingles: set_key, root (its group), found (the smallest doc_id of the group), n (rows that have it)."""
    rows_, bands = banding(percent / 100)
    least = least_matches(percent / 100)
    n_docs = docs.count()
    # one row for each set, with its smallest id. Shingles are worked out again at the end: cheaper than keeping a signature for each document meanwhile.
    known = sketches(docs, words, id_col, text_col).filter(F.col("doc_id").isNotNull() & (F.col("n_shingles") > 0))
    classes = in_files(known.groupBy("set_key").agg(F.min("doc_id").alias("id"), F.first("sig").alias("sig"), F.first("n_shingles").alias("size"), F.count(F.lit(1)).alias("n")), "classes", n_docs, 4 * HASHES)
    names = None
    n, n_ids = classes.agg(F.count(F.lit(1)), F.count_distinct("id")).first()
    if n > n_ids:  # rows share ids: a class goes by a number of its own
        classes = written(classes.withColumnRenamed("id", "doc").withColumn("id", F.monotonically_increasing_id()), "classes")
        names = classes.select("id", "doc", "set_key")
    sigs = classes.select("id", "sig")
    sizes = classes.select("id", "size")

    keys = F.transform(F.sequence(F.lit(0), F.lit(bands - 1)), lambda i: F.xxhash64(i, F.substring("sig", i * (4 * rows_) + 1, F.lit(4 * rows_))))
    banded = sigs.select("id", F.posexplode(keys).alias("k", "band"))
    shared = banded.groupBy("band").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("center")).filter("n > 1")
    buckets = in_files(banded.join(shared, "band"), "buckets", n_docs, 4 * HASHES)

    # each member against the centre that it shares most bands with; against other centres only while they lie in other components
    stars = buckets.filter("id != center").groupBy(F.col("id").alias("a"), F.col("center").alias("b")).agg(F.count(F.lit(1)).alias("bands"))
    texts = docs.select(F.col(id_col).cast("long").alias("id"), whole_text(text_col).alias("text"))
    first = in_files(stars.groupBy("a").agg(F.max_by("b", F.struct("bands", -F.col("b"))).alias("b")), "first", n, 16)
    near = in_files(pruned(first, sigs, least), "near", n, 24)
    n_links = near.count()
    links = confirmed(near, n_links, texts, percent, words, names)
    comp = components(links, n_links)
    others = compact(across(stars.select("a", "b").join(first, ["a", "b"], "left_anti"), comp), "others")
    near = compact(pruned(others, sigs, least), "near")
    n = near.count()
    if n and not (more := confirmed(near, n, texts, percent, words, names)).isEmpty():
        links, n_links = links.union(more), n_links + n
        comp = components(links, n_links)

    # buckets that still hold several components besides their centre
    held = buckets.filter("n > 2 and id != center").join(comp.withColumnRenamed("node", "id"), "id", "left").withColumn("comp", F.coalesce("comp", "id"))
    open_ = held.groupBy("band").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).filter("lo != hi").select("band")
    members = compact(held.join(open_, "band", "left_semi").join(sizes, "id").select("band", "k", "id", "comp", "n", "size"), "members")
    of = members.groupBy("band").agg(F.sum("size").alias("size"), F.first("n").alias("m"))
    members = spread_join(members.drop("size"), of.drop("m"), ["band"], ["id"], looked_up(hot_keys(of, ["band"], "m")))
    n = members.count()
    if n:
        sets = full_sets(members.select("id").distinct(), n, texts, words, names)
        more = compact(block_links(members, sigs, sets, least, percent, rows_), "links", n)
        if not more.isEmpty():
            comp = components(links.union(more), n_links + n)

    # (set, its class, its component)
    root = F.coalesce("comp", "id")
    if names is None:
        return classes.select("set_key", "id", "n").join(comp.withColumnRenamed("node", "id"), "id", "left").select("set_key", root.alias("root"), root.alias("found"), "n")
    groups = classes.select("set_key", "id", "doc", "n").join(comp.withColumnRenamed("node", "id"), "id", "left").select("set_key", "doc", root.alias("root"), "n")
    of = groups.groupBy("root").agg(F.min("doc").alias("found"), F.count(F.lit(1)).alias("m"))
    return spread_join(groups.select("set_key", "root", "n"), of.drop("m"), ["root"], ["set_key"], looked_up(hot_keys(of, ["root"], "m"))).select("set_key", "root", "found", "n")


def placed(docs: DataFrame, groups: DataFrame, words: int, id_col: str, text_col: str) -> DataFrame:
    """Rows of near_groups() from those of near_sets()."""
    few = looked_up(hot_keys(groups, ["set_key"]))
    out = spread_join(sketches(docs, words, id_col, text_col, with_sig=False).drop("sig"), groups.drop("n"), ["set_key"], ["doc_id"], few, "left")
    component = F.when(F.col("doc_id").isNull(), None).when(F.col("n_shingles") == 0, F.col("doc_id")).otherwise(F.col("found"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def near_groups(docs: DataFrame, percent: int = 80, words: int = WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_shingles, component_id, kept."""
    return placed(docs, near_sets(docs, percent, words, id_col, text_col), words, id_col, text_col)


def keep_first(docs: DataFrame, percent: int = 80, words: int = WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of `docs`, as they are, that stay: one of each group, and all rows with a null doc_id. Rows that share a doc_id stay or go each with its own group."""
    sets = near_sets(docs, percent, words, id_col, text_col)
    groups = in_files(placed(docs, sets, words, id_col, text_col).filter(F.col("doc_id").isNotNull()).select("doc_id", "kept"), "kept", docs.count(), 16)
    named = docs.select(F.struct("*").alias("row"), F.col(id_col).cast("long").alias("id"))
    gone = groups.filter(~F.col("kept")).select(F.col("doc_id").alias("id")).distinct()
    out = named.join(light(gone, gone.count()), "id", "left_anti")
    often = groups.groupBy(F.col("doc_id").alias("id")).agg(F.count(F.lit(1)).alias("n"), F.max("kept").alias("some")).filter("n > 1 and some").select("id")
    if not often.isEmpty():  # ids that rows share: their texts tell which group a row is of
        shared = named.join(often, "id", "left_semi").withColumn("text", whole_text(f"row.`{text_col}`")).withColumn("digest", F.sha2("text", 256))

        def keyed(batch):
            n, key, _ = zip(*digests(batch.column(1).to_pylist(), words, False), strict=True)
            return {"digest": batch.column(0), "n": list(n), "set_key": list(key)}

        keys = arrow_map(shared.select("digest", "text"), keyed, "digest string, n long, set_key binary").distinct()
        of = keys.join(sets.drop("n"), "set_key", "left").select("digest", "n", "root", "found")
        stay = shared.join(of, "digest").filter("n = 0 or id = found").dropDuplicates(["id", "root"])
        out = out.join(often, "id", "left_anti").select("row").unionByName(stay.select("row"))
    return out.select("row.*")
