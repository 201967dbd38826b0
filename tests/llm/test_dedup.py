"""The deduplicating operators against brute force on small tables."""

import random
import re
from collections import Counter
from hashlib import sha256

import pytest
from pyspark.sql import functions as F

from tallywharf.llm import common, components, exact_dedup, line_dedup, near_dedup, substring_dedup, suffixes

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def table(spark, rows):
    return spark.createDataFrame([(*r, "clash", 1) for r in rows], "doc_id long, text string, keep_id string, pos int")


def test_exact(spark):
    long_ = "".join(f"line {i}\n" for i in range(3000))
    rows = [(1, "a"), (2, "a"), (3, None), (4, ""), (5, long_), (6, long_), (7, long_ + "x"), (2, "a"), (None, "a"), (8, "A"), (9, "é" * 5000), (10, "a\x01"), (11, "\x01a"), (12, "a\n\x01"), (13, "a\n")]
    got = exact_dedup.exact_groups(table(spark, rows)).collect()
    assert len(got) == len(rows)
    for r in got:
        same = [i for i, t in rows if sha256((t or "").encode()).hexdigest() == r["text_sha256"]]
        ids = [i for i in same if i is not None]
        assert r["keep_id"] == max(ids) and r["group_size"] == len(same)
    kept = [r["doc_id"] for r in got if r["kept"]]
    assert sorted(kept) == [2, 4, 6, 7, 8, 9, 10, 11, 12, 13]
    assert exact_dedup.exact_groups(table(spark, rows).filter("false")).count() == 0


def test_chunks_are_cut_by_content(spark):
    t = "".join(f"line {i} of the text\n" for i in range(400))
    a, b = (exact_dedup.chunked(spark.createDataFrame([(x,)], "text string")).first()["chunks"] for x in (t, "new start\n" + t))
    assert "".join(a) == t and len(set(a) & set(b)) >= len(a) - 1 > 20


def test_exact_with_marks(spark):
    """Control characters at places where chunks end: only equal texts are equal."""
    rnd = random.Random(3)
    part = ["line 0", "line 0\x01", "\x01", "\n", "y", "\x00", "é", "\n\n", "\x01\n", "a" * 4096, "\x02"]
    texts = ["line 0\ny", "line 0\x01\ny", "line 0\n\x01y", "a" * 4097, "a" * 4096 + "\na", "a" * 4096 + "\x01a"] + ["".join(rnd.choice(part) for _ in range(rnd.randint(0, 6))) for _ in range(300)]
    got = exact_dedup.exact_groups(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    same = Counter(texts)
    last = {t: i for i, t in enumerate(texts)}
    assert sorted((r["doc_id"], r["keep_id"], r["group_size"], r["kept"], r["text_sha256"]) for r in got) == [(i, last[t], same[t], last[t] == i, sha256(t.encode()).hexdigest()) for i, t in enumerate(texts)]
    pieces = exact_dedup.chunked(spark.createDataFrame([(t,) for t in texts], "text string")).collect()
    assert all("".join(r["chunks"]) == r["text"] and r["chunks"] for r in pieces)


def test_hot_keys_are_dealt(spark, monkeypatch):
    rows = spark.range(300).select(F.col("id"), F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("k"), F.col("id") % 40)).alias("k"))
    found = rows.filter("k != 'k7'").groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("v"))
    for part in (3, 1000):
        monkeypatch.setattr(common, "PART_ROWS", part)
        few = common.hot_keys(found, ["k"])
        assert (common.looked_up(few) is None) == (part == 1000)
        for how in ("inner", "left"):
            want = rows.join(found.drop("n"), "k", how)
            for f in (few, common.looked_up(few)):
                got = common.spread_join(rows, found.drop("n"), ["k"], ["id"], f, how)
                assert sorted(map(str, got.select(want.columns).collect())) == sorted(map(str, want.collect()))


def lines_by_hand(rows, least):
    key = lambda x: x.strip(" \t\n\x0b\x0c\r").translate(LOW)
    n = Counter(k for _, t in rows for k in {key(x) for x in (t or "").split("\n")} if k)
    out = []
    for i, t in rows:
        all_ = (t or "").split("\n")
        kept = [x for x in all_ if n[key(x)] < least]
        out.append((i, len(all_), len(all_) - len(kept), "\n".join(kept)))
    return sorted(out, key=str)


def test_lines(spark):
    rnd = random.Random(4)
    pool = ["Common", " common\t", "COMMON", "É", "é", "K", "K", "k", "", "  ", "\x0bx", "y", "İ", "ß", "z\r"]
    rows = [(i, "\n".join(rnd.choice(pool) for _ in range(rnd.randint(0, 9)))) for i in range(40)] + [(40, None), (41, ""), (5, "y\ny"), (5, "y\ny"), (None, "Common"), (42, "\n" * 300 + "y")]
    for least in (2, 10, 30):
        got = line_dedup.dedup_lines(table(spark, rows), least, 1)
        assert sorted(((r["doc_id"], r["_n_lines"], r["_n_dropped"], r["text"]) for r in got.collect()), key=str) == lines_by_hand(rows, least)
        assert got.columns[:4] == ["doc_id", "text", "keep_id", "pos"]
    assert line_dedup.dedup_lines(table(spark, rows).filter("false")).count() == 0
    clash = table(spark, rows).selectExpr("doc_id", "text", "doc_id AS key", "'a' AS _key", "1 AS gone", "2 AS lines", "3 AS _gone", "4 AS row", "5 AS own", "6 AS h", "7 AS _n_lines")
    got = line_dedup.dedup_lines(clash, 10, 1)
    assert got.columns == [*clash.columns[:-1], "_n_lines", "_n_dropped"] and all(r["key"] == r["doc_id"] and r["_key"] == "a" and r["row"] == 4 for r in got.collect())
    assert sorted(((r["doc_id"], r["_n_lines"], r["_n_dropped"], r["text"]) for r in got.collect()), key=str) == lines_by_hand(rows, 10)


def shingle_set(t):
    w = re.findall("[^\x20\x09-\x0d]+", (t or "").translate(LOW))
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def near_by_hand(rows, percent):
    ids = sorted({i for i, _ in rows if i is not None})
    sets = {i: shingle_set(t) for i, t in rows if i is not None}
    up = {i: i for i in ids}

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in ids:
        for j in ids:
            if j < i and sets[i] and sets[j]:
                inter = len(sets[i] & sets[j])
                if 100 * inter >= percent * (len(sets[i]) + len(sets[j]) - inter):
                    a, b = find(i), find(j)
                    up[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), find(i), find(i) == i) for i in ids}


def near_rows(seed, n=140):
    """Chains of near copies at about the threshold, exact copies, short and empty texts."""
    rnd = random.Random(seed)
    words = [f"w{i}" for i in range(300)]
    base = [rnd.choice(words) for _ in range(120)]
    rows = []
    for i in range(n):
        x = list(base)
        for _ in range(rnd.choice([0, 1, 1, 2, 3, 4])):
            x[rnd.randrange(120)] = rnd.choice(words)
        if rnd.random() < 0.1:
            base = x
        rows.append((i * 3 + 1, " ".join(x)))
    return [*rows, (1000, "a b c"), (1001, "A  B\tC"), (1002, "a b"), (1003, ""), (1004, None), (1005, "\n"), (1006, rows[5][1].upper())]


@pytest.mark.parametrize("seed", [1, 2])
def test_near(spark, monkeypatch, seed):
    monkeypatch.setattr(near_dedup, "BLOCK", 16)
    rows = near_rows(seed)
    got = near_dedup.near_groups(table(spark, rows), percent=85).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in got} == near_by_hand(rows, 85)


def test_near_edges(spark):
    rows = [(None, "a b c d e f"), (1, "a b c d e f"), (1, "a b c d e f"), (2, "")]
    got = sorted(((r["doc_id"], r["component_id"], r["kept"]) for r in near_dedup.near_groups(table(spark, rows)).collect()), key=str)
    assert got == sorted([(None, None, True), (1, 1, True), (1, 1, True), (2, 2, True)], key=str)
    kept = near_dedup.keep_first(table(spark, rows))
    assert kept.columns == ["doc_id", "text", "keep_id", "pos"] and sorted(str(r["doc_id"]) for r in kept.collect()) == ["1", "2", "None"]
    assert near_dedup.near_groups(table(spark, rows).filter("false")).count() == 0


def test_near_with_shared_ids(spark):
    a, b, c = (" ".join(f"{x}{i}" for i in range(60)) for x in "abc")
    rows = [(5, a), (5, b), (5, b + " end"), (5, c), (6, a + " end"), (7, b + " last"), (3, c + " end"), (8, "x y"), (5, ""), (None, a)]
    docs = table(spark, rows)
    got = sorted(((r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in near_dedup.near_groups(docs).collect()), key=str)
    want = [(5, 56, 5, True), (5, 56, 5, True), (5, 57, 5, True), (5, 56, 3, False), (6, 57, 5, False), (7, 57, 5, False), (3, 57, 3, True), (8, 1, 8, True), (5, 0, 5, True), (None, 56, None, True)]
    assert got == sorted(want, key=str)
    kept = [(r["doc_id"], r["text"][:1]) for r in near_dedup.keep_first(docs).collect()]
    assert sorted(kept, key=str) == sorted([(5, "a"), (5, "b"), (5, ""), (3, "c"), (8, "x"), (None, "a")], key=str)


def thue_morse(n, a="a", b="b"):
    t = [0]
    while len(t) < n:
        t += [1 - x for x in t]
    return "".join((a, b)[x] for x in t[:n]), "".join((b, a)[x] for x in t[:n])


def test_near_with_long_words(spark):
    """Words that collide under any polynomial modulo a power of two, and words near the bound of the lanes."""
    rows = []
    for n in (511, 512, 513, 1024, 2048, 4096):
        rows += [(len(rows) + k, f"w {x} y z q") for k, x in enumerate(thue_morse(n))]
    rows += [(100 + i, "x" * i + "\0" * (i % 3) + " same words here too") for i in range(1, 20)] + [(200, "word " * 5), (201, "w" * 9 + " " + "w" * 8 + " a b c")]
    got = near_dedup.near_groups(table(spark, rows), percent=85).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in got} == near_by_hand(rows, 85)


def test_near_keeps_other_columns(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "BLOCK_BYTES", 4000)
    rows = near_rows(5)
    want = near_by_hand(rows, 85)
    got = near_dedup.near_groups(table(spark, rows), percent=85).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in got} == want
    docs = table(spark, rows).selectExpr("doc_id", "text", "'u' AS _id", "7 AS id", "8 AS n", "9 AS _text", "10 AS row", "11 AS _salt", "12 AS set_key")
    kept = near_dedup.keep_first(docs, percent=85)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == {i for i, (_, _, k) in want.items() if k} and all(r["_id"] == "u" and r["id"] == 7 and r["row"] == 10 for r in kept.collect())


def test_pruning_bounds():
    least = near_dedup.least_matches(0.85)
    assert len(least) == near_dedup.HASHES // near_dedup.BATCH and least == sorted(least) and 0 < least[0] < near_dedup.BATCH
    for t in (0.5, 0.8, 0.85, 0.95):
        r, b = near_dedup.banding(t)
        assert (1 - t**r) ** b <= near_dedup.LOST


def test_components(spark):
    rnd = random.Random(9)
    for n, m in ((60, 40), (200, 150), (50, 200)):
        edges = [(rnd.randrange(n), rnd.randrange(n)) for _ in range(m)] + [(0, i) for i in range(300, 340)]
        up = {x: x for e in edges for x in e}
        for _ in up:
            for a, b in edges:
                up[a] = up[b] = min(up[a], up[b])
        links = spark.createDataFrame(edges, "a long, b long")
        for found in (components.components(links), components.by_stars(links)):
            assert {r["node"]: r["comp"] for r in found.collect()} == {x: c for x, c in up.items() if x != c}
    assert components.components(links.filter("false")).count() == components.by_stars(links.filter("false")).count() == 0


def test_suffix_arrays():
    import numpy as np

    rnd = random.Random(1)
    for _ in range(200):
        k = rnd.choice([2, 3, 26])
        s = [rnd.randint(1, k) for _ in range(rnd.randint(1, 60))] + [0]
        want = sorted(range(len(s)), key=lambda i: s[i:])
        assert suffixes.suffix_array(np.array(s, np.uint16), k + 1, rnd.choice([0, 40, 10**6])).tolist() == want


def substrings_by_hand(rows, length):
    raw = [(i, (t or "").encode()) for i, t in rows]
    n = Counter(b[k : k + length] for _, b in raw for k in range(len(b) - length + 1))
    out = []
    for i, b in raw:
        gone = [False] * len(b)
        for k in range(len(b) - length + 1):
            if n[b[k : k + length]] > 1:
                gone[k : k + length] = [True] * length
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        out.append((i, sum(gone), sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone)), kept))
    return sorted(out, key=str)


@pytest.mark.parametrize("hot", [4096, 2])
def test_substrings(spark, hot):
    rnd = random.Random(hot)
    base = ["".join(rnd.choice("abé\0z") for _ in range(rnd.randint(20, 60))) for _ in range(4)]
    part = lambda: rnd.choice([rnd.choice(base), "".join(rnd.choice("abcdefgh ") for _ in range(rnd.randint(0, 40))), "ab" * rnd.randint(0, 40), "z" * rnd.randint(0, 60)])
    rows = [(i, "".join(part() for _ in range(rnd.randint(0, 4)))) for i in range(50)] + [(50, None), (51, ""), (52, "same" * 9), (52, "same" * 9), (None, base[0])]
    got = substring_dedup.dedup_substrings(table(spark, rows), 20, hot=hot, shard_bytes=4000).collect()
    assert sorted(((r["doc_id"], sum(s["end"] - s["start"] for s in r["_spans"]), len(r["_spans"]), bytes(r["_kept"])) for r in got), key=str) == substrings_by_hand(rows, 20)


def test_substring_edges(spark):
    rows = [(1, "é" * 15), (2, "x" + "é" * 15)]
    t = substring_dedup.dedup_substrings(table(spark, rows), 21, as_text=True)
    assert set(t.columns) == {"doc_id", "keep_id", "pos", "_kept", "_spans"} and all("�" not in r["_kept"] for r in t.collect())
    assert substring_dedup.dedup_substrings(table(spark, rows).filter("false"), 20).count() == 0
