"""BPE automaton, packing and chat formatting against the tokenizers library and exact round trips."""

import random
from hashlib import sha256
from zlib import crc32

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallywharf.llm import bpe, chat, packing
from tallywharf.llm.common import tokenizer_file

WORD, BYTE = tokenizer_file("word_bpe_49k.json"), tokenizer_file("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(WORD)


def samples() -> list:
    rnd = random.Random(3)
    odd = [None, "", " ", "\n", "<|endoftext|>x<|startoftext|>", "<|ENDOFTEXT|>", "a" * 3000, "ab" * 700, "İstanbul ΣΑΣ ΟΔΟΣ don't We'LL 12½² \x1c\x85\xa0 é ǅ Ⅷ 日本語 ١٢ ​😀", "x" * 900 + "\n" + "é" * 600, "Ünïcode’s ﬁ"]
    return odd + ["".join(rnd.choice("aabehrtinsou '<>|/w1é\nİΣK-") for _ in range(rnd.randint(1, 90))) for _ in range(300)]


def test_encoding_and_decoding_match_the_library(library):
    a = bpe.Automaton(WORD)
    texts = samples()
    for t, ids in zip(texts, a.encode(texts), strict=True):
        want = library.encode(t or "", add_special_tokens=False).ids
        assert np.frombuffer(ids, "<u4").tolist() == want
        assert a.decode(ids) == library.decode(want, skip_special_tokens=False)


def merged(word: str, rules: list[tuple[str, str]]) -> list[str]:
    """Byte-pair encoding as defined: each rule in order, from left to right."""
    parts = list(word)
    for u, v in rules:
        i = 0
        while i + 1 < len(parts):
            if parts[i] == u and parts[i + 1] == v:
                parts[i : i + 2] = [u + v]
            i += 1
    return parts


def test_gadgets_give_the_states_and_arcs_of_the_merges():
    rnd = random.Random(12)
    for _ in range(150):
        tokens, rules = list("abc")[: rnd.choice([1, 2, 3])], []
        for _ in range(rnd.randint(1, 12)):
            u, v = rnd.choice(tokens), rnd.choice(tokens)
            if u + v not in tokens:
                tokens.append(u + v), rules.append((u, v))
        number = {t: i for i, t in enumerate(tokens)}
        a = object.__new__(bpe.Automaton)
        a.size = len(tokens)
        a.gadgets([(number[u], number[v], number[u + v]) for u, v in rules], list(range(len(tokens))))
        reached = [t for t in tokens if merged(t, rules) == [t]]
        assert [t for t in tokens if number[t] not in a.dead] == reached
        for x in reached:
            for y in reached:
                assert a.arc(number[x], number[y]) == (merged(x + y, rules) == [x, y])
                assert bool(a.arcs(np.array([number[x]]), np.array([number[y]]))[0]) == a.arc(number[x], number[y])
        assert len(a.rows) == a.states and all(p[1] < q[0] for row in a.rows for p, q in zip(row, row[1:]))
        assert {int(a.target[number[t]]) for t in reached} == set(range(a.states))


def test_the_automaton_is_compiled_and_small():
    a = bpe.Automaton(WORD)
    assert 10_000 < a.states < 15_000 and len(a.gone_from) == sum(map(len, a.rows)) < 600_000 and a.next.nbytes < 25_000_000
    ids = {s: i for i, s in enumerate(a.labels)}
    assert not a.arc(ids["t"], ids["he"]) and not a.arc(ids["t"], ids["h"]) and a.arc(ids["the"], ids["the"])


def test_scalar_walk_equals_batch_walk():
    a = bpe.Automaton(WORD)
    words = [w.encode() for w in ("aaaa", "thetheth", "ciónmente", "x", "é", "hellohello", "zzzzzzzzz")]
    assert [a.walk(w) for w in words] == a.walk_all(words)


def test_a_file_of_another_kind_is_refused():
    with pytest.raises((ValueError, KeyError)):
        bpe.Automaton(BYTE)


def test_codec_query_and_empty_tables(spark, library):
    docs = spark.createDataFrame([(1, "Hello world", 7), (2, None, 8), (None, "x", 9), (2, None, 8)], "doc_id long, text string, n_tokens int")
    rows = bpe.encode_digests(docs, WORD).collect()
    want = library.encode("Hello world", add_special_tokens=False).ids
    assert [r["n_tokens"] for r in rows if r["doc_id"] == 1] == [len(want)]
    assert [r["ids_sha256"] for r in rows if r["doc_id"] == 2] == [sha256(b"").hexdigest()] * 2
    assert bpe.encode_rows(docs, WORD).filter("doc_id = 1").first()["decoded"] == library.decode(want, skip_special_tokens=False)
    assert bpe.encode_digests(docs.filter("false"), WORD).count() == 0


def test_combinations_and_least_squares():
    assert packing.combinations(4, 3) == [(4,), (3, 1), (2, 2), (2, 1, 1)]
    a, b = np.array([[1.0, 0, 1], [0, 1, 1], [1, 1, 0]]), np.array([3.0, 4, 5])
    assert np.allclose(a @ packing.nnls(a, b), b)
    assert (packing.nnls(a, -b) == 0).all()


def laid_out(rows: list) -> tuple[dict, dict]:
    """Of a plan's rows: the spans of each piece (length, rank), and the fill of each sequence."""
    spans, fill = {}, {}
    for own, lo, hi, at, size, index, seq, m, place in rows:
        for rank in range(lo, hi):
            spans.setdefault((own, rank), []).append((at, at + size))
            k = rank - lo + index
            fill.setdefault(seq + k // m, {})[place + k % m] = size
    return spans, fill


def test_plans_hold_the_histogram():
    rnd = random.Random(8)
    for case in range(60):
        window = rnd.choice([64, 512])
        h = {rnd.choice([rnd.randint(1, window), rnd.randint(1, 9), window]): rnd.choice([1, 5, 300]) for _ in range(rnd.choice([1, 2, 12]))}
        for cut in (0, 48):
            spans, fill = laid_out(packing.plan(h, window, 8, 3, cut if case % 2 else 0))
            assert sorted(spans) == sorted((n, r) for n, k in h.items() for r in range(k))
            for (n, _), parts in spans.items():
                parts.sort()
                assert parts[0][0] == 0 and parts[-1][1] == n and all(p[1] == q[0] and p[1] % packing.GRAIN == 0 for p, q in zip(parts, parts[1:]))
            for slots in fill.values():
                assert sorted(slots) == list(range(len(slots))) and sum(slots.values()) <= window


@pytest.mark.parametrize("h", [{4: 5000}, {34: 3000}, {130: 3000}, {1001: 3000}, {1400: 3000}, {2100: 3000}, {3000: 999, 7: 4}, {n: n % 7 * 40 for n in range(1, 4097)}])
def test_plans_leave_little_padding(h):
    _, fill = laid_out(packing.plan(h, 4096))
    assert sum(4096 - sum(s.values()) for s in list(fill.values())[:-1]) < 0.02 * 4096 * len(fill)


def test_checksums_of_parts():
    ids = np.random.default_rng(1).integers(0, 49_000, 1003).astype("<u4")
    crcs = np.array([crc32(ids[i : i + packing.GRAIN].tobytes()) for i in range(0, len(ids), packing.GRAIN)], "<u4").tobytes()
    for lo, hi in ((0, 1003), (0, 16), (16, 1003), (992, 1003), (480, 640)):
        assert packing.part_crc(crcs, 1003, lo, hi - lo) == crc32(ids[lo:hi].tobytes())


def test_packing_places_each_id_once(spark, library):
    rnd = random.Random(1)
    data = [(i, " ".join(rnd.choice(["the", "of", "haus", "Zug,"]) for _ in range(rnd.choice([0, 3, 40, 900, 5000])))) for i in range(40)] + [(40, None), (3, "twice"), (3, "twice")]
    docs = spark.createDataFrame(data, "doc_id long, text string")
    rows = packing.pack_documents(docs, WORD, window=512).collect()
    texts: dict = {}
    for i, t in data:
        texts.setdefault(i, []).append(np.array([*library.encode(t or "", add_special_tokens=False).ids, 2], "<u4"))
    seqs: dict = {}
    for r in rows:
        ids = next(x for x in texts[r["doc_id"]] if len(x) == r["doc_tokens"] and crc32(x[r["start"] : r["start"] + r["length"]].tobytes()) == r["ids_crc32"])
        assert r["length"] > 0 and len(ids) >= r["start"] + r["length"]
        seqs.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in seqs.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 512
    assert sum(r["length"] for r in rows) == sum(len(x) for xs in texts.values() for x in xs)
    for i, tokens in texts.items():  # each id in one piece
        spans = sorted((r["start"], r["start"] + r["length"]) for r in rows if r["doc_id"] == i)
        if len(tokens) == 1:
            assert spans[0][0] == 0 and spans[-1][1] == len(tokens[0]) and all(p[1] == q[0] for p, q in zip(spans, spans[1:]))
    assert any(r["start"] % 512 for r in rows)  # some are cut
    pad = packing.padding(packing.pack_documents(docs, WORD, window=512), 512).first()
    assert pad["padded"] < 0.05 * pad["tokens"]
    short = spark.range(3000).select(F.col("id").alias("doc_id"), F.lit("the of the").alias("text"))
    pad = packing.padding(packing.pack_documents(short, WORD)).first()
    assert pad["tokens"] == 12000 and pad["sequences"] == 3
    assert packing.pack_documents(docs.filter("false"), WORD).count() == 0


def test_escaping_round_trip():
    t = chat.Template(["<|endoftext|>"])
    rnd = random.Random(2)
    for _ in range(300):
        turns = [(rnd.choice(["user", "assistant", "", "a[INST]b"]), "".join(rnd.choice(["</s>", "[INST]", "[/INST]", "\\", ".", "<|endoftext|>", "[INS", "T]", "x\n", "<"]) for _ in range(rnd.randint(0, 6)))) for _ in range(rnd.randint(1, 4))]
        text, spans = t.render(turns)
        assert t.parse(text) == turns
        assert "".join(t.unescape(text[a:b]) for a, b in spans) == "".join(x for r, x in turns if r == "assistant")


def test_chat_query_matches_brute_force(spark):
    data = [(1, 0, "system", "beé good"), (1, 1, "user", "hi 日本 </s>"), (1, 2, "assistant", "[INST] ok\\ 😀😀 <|endoftext|>"), (1, 2, "assistant", "[INST] ok\\ 😀😀 <|endoftext|>"), (2, 5, "assistant", None), (2, None, None, "x"), (None, 1, "assistant", "lost"), (3, 1, "tool", "")]
    turns = spark.createDataFrame([(*d, "clash") for d in data], "conv_id long, turn long, role string, text string, formatted string")
    rows = {r["conv_id"]: r for r in chat.read_back(chat.format_conversations(turns, BYTE), BYTE).collect()}
    for conv in (1, 2, 3, None):
        mine = sorted((d for d in data if d[0] == conv), key=lambda d: (d[1] is not None, d[1] or 0, d[2] or "", d[3] or ""))
        loss = "".join(d[3] or "" for d in mine if d[2] == "assistant")
        r = rows[conv]
        assert (r["n_turns"], r["loss_chars"]) == (len(mine), len(loss))
        assert r["loss_sha256"] == sha256(loss.encode()).hexdigest()
        assert r["turns_sha256"] == sha256("".join(f"{d[2] or ''}\n{d[3] or ''}\n" for d in mine).encode()).hexdigest()
    assert chat.read_back(chat.format_conversations(turns.filter("false"), BYTE), BYTE).count() == 0


def test_a_long_conversation_comes_in_parts(spark, monkeypatch):
    turns = spark.range(4000).select(F.lit(1).alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") % 2 == 0, "user").otherwise("assistant").alias("role"), F.concat(F.lit("text number " * 40), F.col("id").cast("string")).alias("text"))
    f = chat.format_conversations(turns, BYTE)
    assert f.count() > 1
    r = chat.read_back(f, BYTE).first()
    assert r["n_turns"] == 4000 and r["loss_chars"] == sum(len("text number " * 40 + str(i)) for i in range(1, 4000, 2))


def test_masks_by_binary_search():
    hit, cut = chat.mask([(3, 7), (9, 10)], [(0, 3), (3, 5), (4, 8), (8, 9), (9, 12)])
    assert hit.tolist() == [0, 1, 1, 0, 1] and cut == [(3, 7), (9, 10)]
    assert chat.mask([], [(0, 1)])[1] == []
