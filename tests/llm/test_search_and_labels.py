"""Top-k search, licence scans, the quality classifier and the pipeline."""

import random
import zlib
from fractions import Fraction
from hashlib import sha256

import numpy as np
from pyspark.sql import functions as F

from tallywharf.llm import licenses, quality, topk
from tallywharf.llm.common import table

SF = "/root/testdata/sf0.001"


def test_search(spark):
    rnd = random.Random(6)
    rows = [(i, [round(rnd.uniform(-1.5, 1.5), 1) for _ in range(5)]) for i in range(250)]
    rows += [(300, None), (400, [float("nan")] * 5), (500, [None, 1.0, 1.0, 1.0, 1.0]), (600, [1.0, 2.0]), (None, [0.0] * 5), (700, []), (800, [float("inf")] * 5), (7, rows[7][1]), (100, rows[100][1])]
    df = spark.createDataFrame([(*r, 0) for r in rows], "vec_id long, embedding array<double>, score int")
    good = [(i, [int(np.floor(1024 * x)) for x in v]) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v)]
    want = []
    for q in (0, 100, 200, 600):
        v = next(v for i, v in good if i == q)
        best = sorted(((-sum(a * b for a, b in zip(v, w, strict=True)), i) for i, w in good if i != q and len(w) == len(v)))[:10]
        want += [(q, k, i, -s) for k, (s, i) in enumerate(best, 1)]
    got = topk.search(df, k=10, every=100).collect()
    assert sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in got) == sorted(want)
    assert topk.search(df.filter("false")).count() == 0


def test_search_with_any_finite_component(spark):
    """Against integers of any size; a repeated query goes by its smallest vector."""
    rnd = random.Random(7)
    big = [0.0, 1.5, -2.25, 1e16, -1e16, 9007199254740993.0, 1e300, -1.7e308, 1e-310, 2.0**40, 2.0**53 / 1024]
    rows = [(i, [rnd.choice(big) if i % 3 else rnd.uniform(-1, 1) for _ in range(3)]) for i in range(120)] + [(100, [5.0, 5.0, 5.0]), (100, [-3.0, 1.0, 2.0]), (50, [1e16, 0.0, 0.0])]
    good = [(i, [int(Fraction(x) * 1024 // 1) for x in v]) for i, v in rows]
    want = []
    for q in (0, 50, 100):
        own = min(v for i, v in rows if i == q)
        v = [int(Fraction(x) * 1024 // 1) for x in own]
        best = sorted((-sum(a * b for a, b in zip(v, w, strict=True)), i) for i, w in good if i != q)[:10]
        want += [(q, k, i, min(max(-s, -(2**63)), 2**63 - 1)) for k, (s, i) in enumerate(best, 1)]
    got = topk.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), k=10, every=50).collect()
    assert sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in got) == sorted(want)


def test_groups_of_candidates(spark, monkeypatch):
    monkeypatch.setattr(topk, "GROUP_ROWS", 60)
    e = table(spark, SF, "embeddings")
    a = topk.search(e, 10, 100).collect()
    monkeypatch.undo()
    assert sorted(a) == sorted(topk.search(e, 10, 100).collect())


def test_licences(spark):
    rows = [
        (1, "Licensed under the Apache License, Version 2.0 (the \"License\");\n# you may not use this file except in compliance with the License.\nText."),
        (2, "This work is licensed under the GNU General Public License, version 3.\nReleased under the MIT License."),
        (3, None), (4, ""), (5, "The licence of this is unknown."), (6, "x " * 50_000 + "\nLicensed under CC BY-NC 4.0."),
        (7, "Copyright 2020 A. All rights reserved."), (7, "Released under the MIT License. Released under the MIT License."),
    ]
    df = spark.createDataFrame([(*r, "c") for r in rows], "doc_id long, text string, ids string")
    got = sorted(((r["doc_id"], r["licenses"], r["n_sentences"], r["n_unused"]) for r in licenses.scan(df).collect()))
    assert got == sorted([(1, "Apache-2.0", 2, 0), (2, "MIT GPL-3.0", 2, 0), (3, "", 0, 0), (4, "", 0, 0), (5, "", 0, 0), (6, "CC-BY-NC-4.0", 1, 0), (7, "Proprietary", 2, 0), (7, "MIT", 2, 0)])
    assert licenses.scan(df.filter("false")).count() == 0


APACHE = """
   Copyright 2020 A. Person

   Licensed under the Apache License, Version 2.0 (the "License");
   you may not use this file except in compliance with the License.
   You may obtain a copy of the License at

       http://www.apache.org/licenses/LICENSE-2.0

   Unless required by applicable law or agreed to in writing, software
   distributed under the License is distributed on an "AS IS" BASIS,
   WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
   See the License for the specific language governing permissions and
   limitations under the License."""
MIT = """Copyright (c) 2020 A. Person

Permission is hereby granted, free of charge, to any person
obtaining a copy of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY
KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY."""
BSD = """Copyright (c) 2020, A. Person
All rights reserved.

Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer."""
GPL = """This program is free software: you can redistribute it and/or modify
it under the terms of the GNU General Public License as published by
the Free Software Foundation, either version 3 of the License, or
(at your option) any later version.

This program is distributed in the hope that it will be useful,
but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE."""


def test_wrapped_licence_notices(spark):
    def marked(text, before, after=""):
        return "\n".join(f"{before}{x}{after}".rstrip() for x in text.split("\n"))

    old_gpl = GPL.replace("software: you", "software; you").replace("version 3", "version 2")
    notices = [(APACHE, "Apache-2.0"), (MIT, "MIT"), (BSD, "BSD"), (GPL, "GPL-3.0-or-later"), (old_gpl, "GPL-2.0-or-later"), (GPL.replace("GNU General", "GNU Lesser General"), "LGPL")]
    want = []
    for text, licence in notices:
        joined = "\n\n".join(" ".join(x.split()) for x in text.split("\n\n"))
        for form in (text, joined, text.replace("\n", "\r\n"), marked(text, "# "), marked(text, " * "), marked(text, ";; "), "/*\n" + marked(text, " * ", "  ") + "\n */", "code();\n" + text + "\nmore"):
            want.append((form, licence))
    names = {
        "Apache License, Version 2.0": "Apache-2.0", "MIT License": "MIT", "GNU General Public License v3.0": "GPL-3.0", "GNU General Public License, version 2": "GPL-2.0",
        "GNU Lesser General Public License": "LGPL", "BSD license": "BSD", "CC BY 4.0": "CC-BY-4.0", "CC BY-SA 4.0": "CC-BY-SA-4.0", "CC BY-NC 4.0": "CC-BY-NC-4.0", "CC0 1.0": "CC0-1.0",
    }
    for name, licence in names.items():
        for form in ("Licensed under the {}.", "This project is licensed under the {}.", "The files of this\nwork are released under the\n{}.", "It is distributed under the terms of the {}."):
            want.append((form.format(name), licence))
    want += [("This is not licensed under the MIT License.", ""), ("Licensed under the\n\nMIT License.", ""), ("." * 200_000 + " license\n" + " */" * 50_000 + "x", "")]
    got = licenses.scan(spark.createDataFrame(list(enumerate(t for t, _ in want)), "doc_id long, text string")).collect()
    assert [(t, w, r["licenses"]) for r in got for t, w in [want[r["doc_id"]]] if r["licenses"] != w] == []
    assert len(got) == len(want)


def test_forward_backward_matches_enumeration():
    from itertools import product

    rng = np.random.default_rng(3)
    per = np.array([3, 1, 4])
    node, trans = rng.normal(size=8), rng.normal(size=(2, 2))
    marginal, pair, z = quality.forward_backward(node, trans, per)
    at, want_pair, want_z = 0, np.zeros((2, 2)), 0.0
    for n in per:
        weights = {p: np.exp(sum(node[at + i] * x for i, x in enumerate(p)) + sum(trans[a, b] for a, b in zip(p, p[1:], strict=False))) for p in product((0, 1), repeat=int(n))}
        total = sum(weights.values())
        want_z += np.log(total)
        for i in range(n):
            assert np.isclose(marginal[at + i], sum(w for p, w in weights.items() if p[i]) / total)
        for p, w in weights.items():
            for a, b in zip(p, p[1:], strict=False):
                want_pair[a, b] += w / total
        at += n
    assert np.allclose(pair, want_pair) and np.isclose(z, want_z)


def test_quality_on_held_out_rows(spark):
    d = "/root/testdata/sf0.01"
    docs, labels = table(spark, d, "documents"), table(spark, d, "labels")
    model = quality.train(docs, labels)
    got = {r["doc_id"]: r for r in quality.score_documents(docs, model).collect()}
    assert len(got) == docs.count() and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in got.values())
    assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0) for i, r in got.items())
    held = [(got[r["doc_id"]]["predicted"], r["quality"]) for r in labels.collect() if got[r["doc_id"]]["held_out"]]
    assert np.mean([p == q for p, q in held]) > 0.95
    odd = spark.createDataFrame([(1, None, 5), (None, "", 6), (2, "x" * 300_000, 7), (2, "\n" * 5000, 8)], "doc_id long, text string, score int")
    assert len(quality.score_documents(odd, model).collect()) == 4 and set(quality.keep_good(odd, model).columns) == {"doc_id", "text", "score"}
    assert {r["score"] for r in quality.score_documents(odd, None).collect()} == {0.5}
    assert quality.score_documents(docs.filter("false"), model).count() == 0


def test_overlong_texts_leave_room_for_both_labels(spark, monkeypatch):
    monkeypatch.setattr(quality, "SAMPLE_BYTES", 20_000)
    rows = [(i, ("plain words of a text here\n" if i % 2 else "$$$ ### || %%%\n") * 5, i % 2) for i in range(60) if zlib.crc32(str(i).encode()) % 5]
    docs = spark.createDataFrame(rows, "doc_id long, text string, quality int")
    first = docs.orderBy(F.xxhash64("doc_id")).first()["doc_id"]
    long_ = docs.withColumn("text", F.when(F.col("doc_id") == first, F.repeat("text", 1000)).otherwise(F.col("text")))
    seen = []
    monkeypatch.setattr(quality, "fit", lambda texts, y: seen.append((texts, y)))
    quality.train(long_, docs.select("doc_id", "quality"))
    assert len(seen[-1][0]) == len(rows) - 1 and set(seen[-1][1]) == {0, 1} and max(map(len, seen[-1][0])) < 1000
    # one label comes first by hash and would fill the sample
    order = [r["doc_id"] for r in docs.orderBy(F.xxhash64("doc_id")).collect()]
    labels = spark.createDataFrame([(i, int(k > 30)) for k, i in enumerate(order)], "doc_id long, quality int")
    quality.train(docs, labels, sample=10)
    assert sorted(seen[-1][1]) == [0] * 5 + [1] * 5


def test_pipeline_matches_its_parts_done_by_hand(spark):
    import corpus_pipeline
    from test_dedup import lines_by_hand, near_by_hand, substrings_by_hand
    from tokenizers import Tokenizer

    from tallywharf.llm.common import tokenizer_file

    docs = table(spark, SF, "documents")
    model = quality.train(docs, table(spark, SF, "labels"))
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    rows = [r for r, s in zip(rows, model.score([t or "" for _, t in rows]), strict=True) if s >= 0.3]
    rows = [(i, t) for i, _, _, t in lines_by_hand(rows, 10)]
    kept = near_by_hand(rows, 80)
    rows = [(i, t) for i, t in rows if kept[i][2]]
    rows = [(i, b.decode("utf-8", "ignore")) for i, _, _, b in substrings_by_hand(rows, 400)]
    tok = Tokenizer.from_file(tokenizer_file("word_bpe_49k.json"))
    want = {i: len(tok.encode(t, add_special_tokens=False).ids) + 1 for i, t in rows}
    got = corpus_pipeline.run(spark, SF)
    assert {r["doc_id"]: r["doc_tokens"] for r in got.collect()} == want
    assert [n for n, _ in corpus_pipeline.STAGES] and sha256
