"""Document quality from a linear-chain conditional random field over lines (operator 7).

Every line gets features of its own bytes (shares of symbols, capitals, bars and repeated words, word length) and those of the lines
before and after it, in steps; two states (bad, good) form a chain along the document. Line labels for training are the
document's label. The weights maximise the penalised conditional likelihood (gradient descent with momentum, in numpy). A
document's quality is the mean of its lines' forward-backward marginals for "good", weighted by line length, brought to a probability of the label by a
logistic curve with two parameters, fitted on the same sample.

Training uses at most `SAMPLE` labelled rows, the smallest by hash of doc_id among those outside the held-out fold
(crc32 of doc_id as text, modulo 5 = 0) whose texts fit into `SAMPLE_BYTES` characters, so the driver holds a bounded sample; a text that doesn't fit is left out
and the next ones are tried, and if that leaves one label only, each label has half. Scoring covers every row. Labels, language, source and id are no
inputs. Lines are scored over all of a text, whatever its length.

Defined results: null text counts as empty; an empty text is one empty line; without any labelled row every score is 0.5; repeated
rows get equal scores; a null doc_id is not held out; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, ship, trim, whole_text, worker_table

SAMPLE, SAMPLE_BYTES, MEASURED_BYTES = 4000, 24_000_000, 4_000_000
#: Bytes of text that a worker measures at once; about forty times as many are in use meanwhile.
SCORED_BYTES = 1_500_000
FOLDS, THRESHOLD = 5, 0.3
STEPS = 150

# Classes of bytes: 0 small ASCII letter, 1 capital, 2 digit, 3 blank, 4 ordinary mark, 5 bar, 6 exclamation mark, 7 other symbol, 8 beyond ASCII.
CLASSES = np.full(256, 7, np.uint8)
CLASSES[ord("a") : ord("z") + 1] = 0
CLASSES[ord("A") : ord("Z") + 1] = 1
CLASSES[ord("0") : ord("9") + 1] = 2
CLASSES[[9, 10, 11, 12, 13, 32]] = 3
CLASSES[[ord(c) for c in ".,;:'\"?()-"]] = 4
CLASSES[ord("|")] = 5
CLASSES[ord("!")] = 6
CLASSES[128:] = 8

#: Edges of the steps of each measure.
SHARES = np.array([1e-9, 0.01, 0.02, 0.04, 0.08, 0.15, 0.3, 0.5, 0.8])
WORD = np.array([1.5, 2.5, 3.5, 4.5, 5.5, 6.5, 8, 11, 20])
MEASURES = [("share", c) for c in (1, 2, 4, 5, 6, 7, 8)] + [("again", 0), ("word", 0)]
BINS = len(SHARES) + 1
OWN = len(MEASURES) * BINS
WIDTH = 3 * OWN + 5


def measures(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(step of each measure for each line, bytes of each line, lines of each text)."""
    raw = [t.encode("utf-8") for t in texts]
    flat = np.frombuffer(b"\n".join(raw) + b"\n", np.uint8)
    ends = np.flatnonzero(flat == 10)
    starts = np.concatenate([[0], ends[:-1] + 1])
    size = ends - starts
    per_text = np.array([t.count(b"\n") + 1 for t in raw])
    kind = CLASSES[flat]
    some = np.maximum(size, 1)
    share = {c: (np.add.reduceat(kind == c, starts, dtype=np.int64) - (c == 3)) / some for c in range(1, 9)}
    # words: sums of their bytes' codes from running sums, then how many equal the word before them in the line
    blank = kind == 3
    first = np.flatnonzero(~blank & np.concatenate([[True], blank[:-1]]))
    last = np.flatnonzero(~blank & np.concatenate([blank[1:], [True]])) + 1
    table = np.random.default_rng(7).integers(1, 1 << 63, 256, dtype=np.uint64)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(table[flat], dtype=np.uint64)])
    code = sums[last] - sums[first]
    long_ = last - first
    line = np.searchsorted(ends, first)
    same = np.concatenate([[False], (code[1:] == code[:-1]) & (long_[1:] == long_[:-1]) & (line[1:] == line[:-1])])
    words = np.bincount(line, minlength=len(ends))
    again = np.bincount(line, weights=same, minlength=len(ends)) / np.maximum(words, 1)
    word = (size - share[3] * some) / np.maximum(words, 1)
    cols = []
    for name, c in MEASURES:
        v, edges = {"share": (share.get(c), SHARES), "again": (again, SHARES), "word": (word, WORD)}[name]
        cols.append(np.searchsorted(edges, v, side="right"))
    return np.stack(cols, 1).astype(np.int16), size, per_text


def features(steps: np.ndarray, per_text: np.ndarray) -> np.ndarray:
    """For each line the numbers of its features that are on: its own, the line before's, the line after's, a constant, and whether it is the first or last."""
    own = steps.astype(np.int32) + np.arange(steps.shape[1], dtype=np.int32) * BINS
    first = np.concatenate([[0], np.cumsum(per_text)[:-1]])
    prev = np.concatenate([own[:1], own[:-1]])
    prev[first] = own[first]
    last = np.cumsum(per_text) - 1
    nxt = np.concatenate([own[1:], own[-1:]])
    nxt[last] = own[last]
    ends = np.full((len(own), 3), 3 * OWN, np.int32) + np.array([0, 1, 3], np.int32)
    ends[first, 1] += 1
    ends[last, 2] += 1
    return np.concatenate([own, prev + OWN, nxt + 2 * OWN, ends], 1)


def forward_backward(node: np.ndarray, trans: np.ndarray, per_text: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """Marginal of state 1 for each line, expected transitions (2 x 2), log of the partition functions' product.

    node: log-weight of state 1 against state 0; all texts go a line ahead at each step, longest first.
    """
    order = np.argsort(-per_text, kind="stable")
    n = per_text[order]
    base = (np.cumsum(per_text) - per_text)[order]
    live = np.searchsorted(-n, -np.arange(1, int(n[0]) + 1), side="right")  # texts with at least that many lines
    alpha = np.zeros((len(node), 2))
    alpha[base, 1] = node[base]
    for i in range(1, len(live)):
        at = base[: live[i]] + i
        for s in (0, 1):
            alpha[at, s] = np.logaddexp(alpha[at - 1, 0] + trans[0, s], alpha[at - 1, 1] + trans[1, s]) + (node[at] if s else 0)
    z = np.logaddexp(*alpha[base + n - 1].T)
    beta = np.zeros((len(node), 2))
    pair = np.zeros((2, 2))
    for i in range(len(live) - 1, 0, -1):
        at = base[: live[i]] + i
        ahead = beta[at] + np.stack([np.zeros(len(at)), node[at]], 1)
        for s in (0, 1):
            beta[at - 1, s] = np.logaddexp(trans[s, 0] + ahead[:, 0], trans[s, 1] + ahead[:, 1])
            for t in (0, 1):
                pair[s, t] += np.exp(alpha[at - 1, s] + trans[s, t] + ahead[:, t] - z[: live[i]]).sum()
    total = np.empty(len(per_text))
    total[order] = z
    marginal = np.exp(np.minimum(alpha[:, 1] + beta[:, 1] - np.repeat(total, per_text), 0))
    return marginal, pair, float(z.sum())


def aggregate(marginal: np.ndarray, size: np.ndarray, per_text: np.ndarray) -> np.ndarray:
    """Length-weighted mean of the marginals of each text."""
    weight = np.maximum(size, 1).astype(float)
    starts = np.cumsum(per_text) - per_text
    return np.add.reduceat(marginal * weight, starts) / np.add.reduceat(weight, starts)


class Model:
    """weights of the node features, transitions, and the curve from aggregate to probability."""

    def __init__(self, weights: np.ndarray, trans: np.ndarray, curve: tuple[float, float]):
        self.weights, self.trans, self.curve = weights, trans, curve

    def quality(self, texts: list[str]) -> np.ndarray:
        steps, size, per_text = measures(texts)
        node = self.weights[features(steps, per_text)].sum(1)
        return aggregate(forward_backward(node, self.trans, per_text)[0], size, per_text)

    def score(self, texts: list[str]) -> np.ndarray:
        a, b = self.curve
        return 1 / (1 + np.exp(-np.clip(a * self.quality(texts) + b, -30, 30)))


def fit(texts: list[str], labels: list[int], steps: int = STEPS, penalty: float = 1.0) -> Model | None:
    """Fits on documents and their labels; None where either label is missing."""
    y = np.array(labels)
    if len(set(labels)) < 2:
        return None
    parts, lo, held = [], 0, 0
    for i, t in enumerate(texts, 1):
        held += len(t)
        if held > MEASURED_BYTES or i == len(texts):
            parts.append(measures(texts[lo:i]))
            lo, held = i, 0
    m, size, per_text = (np.concatenate(p) for p in zip(*parts, strict=True))
    x = features(m, per_text)
    line = np.repeat(y, per_text)
    first = np.cumsum(per_text) - per_text
    inner = np.ones(len(line), bool)
    inner[first] = False
    seen = np.zeros((2, 2))
    np.add.at(seen, (line[np.flatnonzero(inner) - 1], line[inner]), 1)
    w, trans = np.zeros(WIDTH), np.zeros((2, 2))
    gw2, gt2 = np.full(WIDTH, 1e-8), np.full((2, 2), 1e-8)
    mw, mt = np.zeros(WIDTH), np.zeros((2, 2))
    for k in range(1, steps + 1):
        node = w[x].sum(1)
        marginal, pair, _ = forward_backward(node, trans, per_text)
        gw = np.bincount(x.ravel(), weights=np.repeat(line - marginal, x.shape[1]), minlength=WIDTH) - penalty * w
        gt = seen - pair - penalty * trans
        gw, gt = gw / len(line), gt / len(line)
        for g, m1, m2, v in ((gw, mw, gw2, w), (gt, mt, gt2, trans)):
            m1 += 0.1 * (g - m1)
            m2 += 0.01 * (g * g - m2)
            v += 0.1 * (m1 / (1 - 0.9**k)) / (np.sqrt(m2 / (1 - 0.99**k)) + 1e-8)
    model = Model(w, trans, (1.0, 0.0))
    q = aggregate(forward_backward(w[x].sum(1), trans, per_text)[0], size, per_text)
    a, b = 6.0, -3.0
    for _ in range(50):  # Newton's steps, kept in bounds by a small penalty
        p = 1 / (1 + np.exp(-(a * q + b)))
        h = p * (1 - p) + 1e-9
        g = np.array([((y - p) * q).sum() - 0.01 * a, (y - p).sum() - 0.01 * b])
        hess = np.array([[(h * q * q).sum() + 0.01, (h * q).sum()], [(h * q).sum(), h.sum() + 0.01]])
        da, db = np.linalg.solve(hess, g)
        a, b = a + np.clip(da, -2, 2), b + np.clip(db, -2, 2)
    model.curve = (float(a), float(b))
    return model


def fold(id_col: str = "doc_id"):
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % FOLDS


def chosen(rows: list, sample: int, left: int) -> list:
    """Of rows (hash, doc_id, _y, n, x) in order, the first `sample` whose lengths n fit into `left`; half of both for each label where that has one label only."""

    def fill(rows: list, most: int, left: int) -> list:
        out = []
        for r in rows:
            if len(out) < most and r["n"] <= left:
                out.append(r)
                left -= r["n"]
        return out

    got = fill(rows, sample, left)
    return got if len({r["_y"] for r in got}) > 1 else [r for y in (0, 1) for r in fill([r for r in rows if r["_y"] == y], sample // 2, left // 2)]


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model | None:
    """Fits on at most `sample` labelled rows outside the held-out fold. Lengths are looked at first; only texts within SAMPLE_BYTES characters leave the executors."""
    order = [F.xxhash64("doc_id"), F.col("doc_id"), F.col("_y")]
    known = labels.filter(F.col("quality").isin(0, 1) & (fold() != 0)).select("doc_id", F.col("quality").alias("_y")).distinct()
    few = known.filter("_y = 0").orderBy(*order).limit(sample).union(known.filter("_y = 1").orderBy(*order).limit(sample))  # a top-k: bounded rows whatever the table
    held = docs.select(F.col("doc_id"), whole_text().alias("text"))
    sizes = held.join(F.broadcast(few), "doc_id").select("doc_id", "_y", F.char_length("text").alias("n"), F.xxhash64("text").alias("x"))
    least = sizes.groupBy("doc_id", "_y").agg(F.min(F.struct("n", "x")).alias("t"))  # of texts that share an id, the shortest
    rows = least.select(order[0].alias("hash"), "doc_id", "_y", "t.n", "t.x").collect()
    got = chosen(sorted(rows, key=lambda r: (r["hash"], r["doc_id"], r["_y"])), sample, SAMPLE_BYTES)
    if not got:
        return None
    wanted = F.broadcast(docs.sparkSession.createDataFrame([(r["doc_id"], r["x"]) for r in got], f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, x long").distinct())
    texts = held.join(wanted, "doc_id").filter(F.xxhash64("text") == F.col("x")).groupBy("doc_id").agg(F.first("text").alias("text")).collect()
    texts = {r["doc_id"]: r["text"] for r in texts}
    return fit([texts[r["doc_id"]] for r in got], [r["_y"] for r in got])


def score_documents(docs: DataFrame, model: Model | None, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, held_out, score, predicted."""

    def one(batch):
        worker_table("quality", lambda: None)
        texts = batch.column(2).to_pylist()
        score = model.score(texts) if model else np.full(len(texts), 0.5)
        return {"doc_id": batch.column(0), "held_out": batch.column(1), "score": score, "predicted": (score >= threshold).astype(np.int32)}

    rows = docs.select(F.col(id_col).cast("long"), F.coalesce(fold(id_col) == 0, F.lit(False)), whole_text(text_col))
    return arrow_map(rows, one, "doc_id long, held_out boolean, score double, predicted int", SCORED_BYTES)


def keep_good(docs: DataFrame, model: Model | None, threshold: float = THRESHOLD, text_col: str = "text") -> DataFrame:
    """The rows of `docs`, as they are, whose score reaches the threshold; all rows without a model."""
    import pyarrow as pa

    if model is None:
        return docs
    ship(docs.sparkSession)
    at = docs.columns.index(text_col)

    def run(batches):
        worker_table("quality", lambda: None)
        for batch in batches:
            step = max(1, int(batch.num_rows * SCORED_BYTES / max(batch.nbytes, 1)))
            for lo in range(0, batch.num_rows, step):
                part = batch.slice(lo, step)
                score = model.score([t or "" for t in part.column(at).to_pylist()])
                yield part.filter(pa.array(score >= threshold))
        trim()

    return docs.mapInArrow(run, docs.schema)
