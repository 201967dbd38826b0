"""BPE encoding and decoding with a tokenization automaton (operator 4).

The merge list is compiled into a deterministic automaton over tokens: reading a token leads to a state, and a state's arcs are the tokens that may follow. It starts with one state that has an arc,
back to itself, for every token that begins with a base token, and every merge u, v -> w is one gadget, applied in order: the state that u leads to is split off for u (unless u alone leads to it)
and loses its arc v, with all that is made from v later on; w gets arcs from wherever u has one, and leads where v led before. After the last gadget a sequence of tokens is what
byte-pair encoding gives exactly when it is a path.

Rows are sparse: an arc is there by default, exceptions are stored. Tokens are numbered in the order of a walk through the forest of left parts (a token's parent is its left part, younger
children first), so that what a gadget takes away, v and the children that v gets later, with all below them, is one interval of numbers. A row is a list of disjoint intervals, and all rows
are one sorted table: an arc is looked up by one binary search.

Encoding walks a word's bytes through a table of trie transitions (which tokens end here, longest first) and, at each
byte, takes the one token that has an arc from the state where it begins: table lookups for each step,
carried out for many distinct words at once. The path is then read backwards. Decoding emits the arc labels.

Texts are pre-split as the tokenizer file says: control tokens, NFC, lower case, then words. Only the rule set of
the word-level file (lower case, white space dropped, word ends) is supported; others are refused.

Defined results: null text is empty (no tokens, empty string); any length of text or word works (words of over `LONG_WORD` bytes
walk alone, through the same tables); the vocabulary path is a parameter.
"""

from __future__ import annotations

import json
import re
import unicodedata
from array import array
from bisect import bisect_left, bisect_right

import numpy as np
import regex

from .common import worker_table

#: Words kept by one worker process.
WORDS = 150_000
LONG_WORD = 400
#: Bytes with a column of their own in the trie's transition table; the others, which few transitions have, are looked up.
COLUMNS = 63

# Fixed values of the tokenizer file: its splitting pattern, by code points up to U+00FF and in general.
LATIN = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zªµºß-öø-ÿ]+|[0-9²³¹¼½¾]|[^\t-\r \x85\xa0a-z0-9ªµºß-öø-ÿ²³¹¼½¾]+")
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
GENERAL = regex.compile(SPLIT.replace(r"\s", r"\p{White_Space}"))
WORD_END = "</w>"


def byte_signs() -> dict[str, int]:
    """The printable stand-ins of byte-level vocabularies: printable bytes stand for themselves, others come from U+0100 on."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class Automaton:
    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        kinds = [x["type"] for x in (spec["normalizer"] or {}).get("normalizers", [])]
        splits = (spec["pre_tokenizer"] or {}).get("pretokenizers", [{}])
        if kinds != ["NFC", "Replace", "Lowercase"] or splits[0].get("pattern") != {"Regex": SPLIT} or model["end_of_word_suffix"] != WORD_END:
            raise ValueError(f"{path}: not a word-level file of the supported form")
        vocab: dict[str, int] = model["vocab"]
        self.size = n = max(vocab.values()) + 1
        self.labels: list[str] = [""] * n
        for s, i in vocab.items():
            self.labels[i] = s
        self.control = {x["content"]: x["id"] for x in spec["added_tokens"]}
        for s, i in self.control.items():
            self.labels += [""] * (i + 1 - len(self.labels))
            self.labels[i] = s
        self.controls = re.compile("(" + "|".join(map(re.escape, sorted(self.control, key=len, reverse=True))) + ")") if self.control else None
        self.compile(vocab, [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]])
        self.words: dict[str, bytes] = {}

    # -- construction -------------------------------------------------------------------------------------------
    def compile(self, vocab: dict[str, int], merges: list[tuple[str, str]]) -> None:
        n = self.size
        signs = byte_signs()
        ends: dict[int, bool] = {}
        spelt: list[bytes | None] = [None] * n
        for s, i in vocab.items():
            body = s[: -len(WORD_END)] if s.endswith(WORD_END) and len(s) > len(WORD_END) else s
            if len(body) == 1:
                spelt[i], ends[i] = bytes([signs[body]]), body != s
        rules = []
        for pair in merges:
            u, v, w = vocab[pair[0]], vocab[pair[1]], vocab["".join(pair)]
            if spelt[w] is not None:
                raise ValueError("a token with two merges is not supported")
            rules.append((u, v, w))
            spelt[w], ends[w] = spelt[u] + spelt[v], ends[v]
        self.gadgets(rules, [i for i in range(n) if spelt[i] is not None])
        self.trie(spelt, ends)

    def gadgets(self, rules: list[tuple[int, int, int]], tokens: list[int]) -> None:
        """Applies the merge gadgets in order. `target`: the state that a token leads to; `rows`: for each state the intervals of token numbers that have no arc from it."""
        age = {w: t for t, (_, _, w) in enumerate(rules)}
        kids: dict[int, list[int]] = {}
        for u, _, w in reversed(rules):
            kids.setdefault(u, []).append(w)  # younger ones first
        self.number, until = np.full(self.size, -1, np.int64), [0] * self.size
        count = 0
        for root in (i for i in tokens if i not in age):
            todo = [(root, False)]
            while todo:
                x, done = todo.pop()
                if done:
                    until[x] = count
                    continue
                self.number[x] = count
                count += 1
                todo.append((x, True))
                todo += [(w, False) for w in reversed(kids.get(x, ()))]
        self.target = np.zeros(self.size, np.int64)
        rows: list[list[tuple[int, int]]] = [[]]
        leads = [len(tokens) - len(rules)]  # how many tokens lead to a state
        self.dead: set[int] = set()
        for t, (u, v, w) in enumerate(rules):
            if u in self.dead or v in self.dead or any(lo <= self.number[v] < hi for lo, hi in rows[self.target[u]]):
                self.dead.add(w)  # u is never followed by v: no arc becomes w
                continue
            state, after = int(self.target[u]), int(self.target[v])
            younger = kids.get(v, [])
            k = bisect_left(younger, 1, key=lambda x: age[x] < t)  # those made before; w itself, where u is v, is not
            gone = int(self.number[v]), until[younger[k - 1]] if k else int(self.number[v]) + 1
            if leads[state] > 1:
                leads[state] -= 1
                rows.append(self.without(rows[state], *gone))
                leads.append(1)
                self.target[u] = len(rows) - 1
            else:
                if after == state:  # w leads where v led before
                    rows.append(rows[state])
                    leads.append(0)
                    after = len(rows) - 1
                rows[state] = self.without(rows[state], *gone)
            self.target[w] = after
            leads[after] += 1
        self.rows, self.states = rows, len(rows)
        flat = np.array([(s * self.size + lo, s * self.size + hi) for s, row in enumerate(rows) for lo, hi in row], np.int64).reshape(-1, 2)
        self.gone_from, self.gone_to = np.ascontiguousarray(flat[:, 0]), np.ascontiguousarray(flat[:, 1])
        self.one_from, self.one_to = array("q", self.gone_from.tobytes()), array("q", self.gone_to.tobytes())

    @staticmethod
    def without(row: list[tuple[int, int]], lo: int, hi: int) -> list[tuple[int, int]]:
        """The row with the numbers from lo to hi taken away as well."""
        i = bisect_left(row, (lo, -1))
        if i and row[i - 1][1] >= lo:
            i -= 1
            lo = row[i][0]
        j = i
        while j < len(row) and row[j][0] <= hi:
            hi = max(hi, row[j][1])
            j += 1
        return [*row[:i], (lo, hi), *row[j:]]

    def trie(self, spelt: list[bytes | None], ends: dict[int, bool]) -> None:
        """For each state of the trie of tokens: the next state by byte (the longest suffix read that begins a token), and the longest token that ends here."""
        child: dict[int, int] = {}
        depth, parent, by = [0], [0], [0]
        node_of = np.zeros(self.size, np.int64)
        for i, s in enumerate(spelt):
            if s is None:
                continue
            at = 0
            for b in s:
                k = at * 256 + b
                if k not in child:
                    child[k] = len(depth)
                    depth.append(depth[at] + 1), parent.append(at), by.append(b)
                at = child[k]
            node_of[i] = at
        count = len(depth)
        depth_, parent_, by_ = np.array(depth), np.array(parent), np.array(by)
        often = np.argsort(-np.bincount(by_[1:], minlength=256), kind="stable")[:COLUMNS]
        self.column = np.full(256, -1, np.int64)
        self.column[often] = np.arange(len(often))
        self.next = go = np.zeros((count, len(often)), np.int32)
        key = by_[1:] * count + parent_[1:]
        order = np.argsort(key)
        self.rare_key, self.rare_to = key[order], order + 1
        self.fail = fail = np.zeros(count, np.int64)
        inner, final = np.full(count, -1, np.int64), np.full(count, -1, np.int64)
        self.length = np.zeros(self.size, np.int64)
        for i, s in enumerate(spelt):
            if s is not None and i not in self.dead:
                (final if ends[i] else inner)[node_of[i]] = i
                self.length[i] = len(s) + ends[i]
        level = np.argsort(depth_, kind="stable")
        starts = np.searchsorted(depth_[level], np.arange(depth_.max() + 2))
        own_inner, own_final = inner.copy(), final.copy()
        for d in range(depth_.max() + 1):
            at = level[starts[d] : starts[d + 1]]
            if d:
                fail[at] = self.step(fail[parent_[at]], by_[at]) if d > 1 else 0
                go[at] = go[fail[at]]
                inner[at] = np.where(own_inner[at] >= 0, own_inner[at], inner[fail[at]])
                final[at] = np.where(own_final[at] >= 0, own_final[at], final[fail[at]])
            if d < depth_.max():
                below = level[starts[d + 1] : starts[d + 2]]
                below = below[self.column[by_[below]] >= 0]
                go[parent_[below], self.column[by_[below]]] = below
        self.inner, self.final = inner, final
        self.shorter = np.full(self.size, -1, np.int64)
        for i, s in enumerate(spelt):
            if s is not None:
                self.shorter[i] = (final if ends[i] else inner)[fail[node_of[i]]]

    def step(self, state: np.ndarray, byte: np.ndarray) -> np.ndarray:
        """The next states of the trie."""
        col = self.column[byte]
        out = self.next[state, col].astype(np.int64)
        live = np.flatnonzero(col < 0)
        at = state[live]
        while len(live):
            key = byte[live].astype(np.int64) * len(self.fail) + at
            k = np.minimum(np.searchsorted(self.rare_key, key), len(self.rare_key) - 1)
            hit = self.rare_key[k] == key
            out[live] = np.where(hit, self.rare_to[k], 0)
            on = ~hit & (at > 0)
            live, at = live[on], self.fail[at[on]]
        return out

    # -- arcs ---------------------------------------------------------------------------------------------------
    def arc(self, x: int, y: int) -> bool:
        """Whether the state that x leads to has an arc y."""
        at = int(self.target[x]) * self.size + int(self.number[y])
        k = bisect_right(self.one_from, at) - 1
        return k < 0 or self.one_to[k] <= at

    def arcs(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """arc() for many pairs."""
        at = self.target[x] * self.size + self.number[y]
        k = np.searchsorted(self.gone_from, at, side="right") - 1
        return (k < 0) | (self.gone_to[k] <= at)

    # -- encoding -----------------------------------------------------------------------------------------------
    def walk(self, word: bytes) -> bytes:
        """The ids of one word, step by step."""
        n, state = len(word), 0
        last = [-1] * (n + 2)
        length, shorter = self.length, self.shorter
        for i in range(1, n + 2):
            if i <= n:
                col = int(self.column[word[i - 1]])
                state = int(self.next[state, col]) if col >= 0 else int(self.step(np.array([state]), np.array([word[i - 1]]))[0])
                tok = int(self.inner[state])
            else:
                tok = int(self.final[state])
            while tok >= 0:
                before = i - int(length[tok])
                if before == 0 or (before > 0 and last[before] >= 0 and self.arc(last[before], tok)):
                    break
                tok = int(shorter[tok])
            last[i] = tok
        out, i = [], n + 1
        while i > 0:
            out.append(last[i])
            i -= int(length[last[i]])
        return np.array(out[::-1], "<u4").tobytes()

    def walk_all(self, words: list[bytes]) -> list[bytes]:
        """The ids of many words, all words a byte ahead at each step."""
        lens = np.fromiter(map(len, words), np.int64, len(words))
        order = np.argsort(-lens, kind="stable")
        lens = lens[order]
        size = lens + 2
        base = np.concatenate([[0], np.cumsum(size)[:-1]])
        text = np.zeros(int(size.sum()), np.uint8)
        flat = np.frombuffer(b"".join([words[i] for i in order.tolist()]), np.uint8)
        text[np.arange(len(flat)) + np.repeat(2 * np.arange(len(lens)) + 1, lens)] = flat  # byte i of a word at base + 1 + i
        last = np.full(len(text), -1, np.int64)
        state = np.zeros(len(words), np.int64)
        for i in range(1, int(lens[0]) + 2):
            live = int(np.searchsorted(-lens, -(i - 1), side="right"))  # words with at least i - 1 bytes
            inside = int(np.searchsorted(-lens, -i, side="right"))
            state[:inside] = self.step(state[:inside], text[base[:inside] + i])
            tok = np.concatenate([self.inner[state[:inside]], self.final[state[inside:live]]])
            open_ = np.arange(live)
            while len(open_):
                t = tok[open_]
                before = i - self.length[t]
                prev = last[base[open_] + before]
                done = before == 0
                ask = np.flatnonzero(~done & (prev >= 0))
                done[ask] = self.arcs(prev[ask], t[ask])
                open_ = open_[~done]
                tok[open_] = self.shorter[tok[open_]]
            last[base[:live] + i] = tok
        at, who = lens + 1, np.arange(len(lens))
        toks, owners, steps = [], [], []
        step = 0
        while len(who):
            t = last[base[who] + at]
            toks.append(t), owners.append(who), steps.append(np.full(len(who), step))
            at = at - self.length[t]
            who, at, step = who[at > 0], at[at > 0], step + 1
        toks, owners, steps = np.concatenate(toks), np.concatenate(owners), np.concatenate(steps)
        sort = np.lexsort((-steps, owners))
        ids = toks[sort].astype("<u4").tobytes()
        cut = np.concatenate([[0], np.cumsum(np.bincount(owners, minlength=len(lens)))]) * 4
        out: list[bytes] = [b""] * len(words)
        cut = cut.tolist()
        for k, i in enumerate(order.tolist()):
            out[i] = ids[cut[k] : cut[k + 1]]
        return out

    def split(self, text: str) -> list[str]:
        """Lower-cased words of a text without control tokens."""
        try:
            text.encode("latin-1")
            return LATIN.findall(text.lower())
        except UnicodeEncodeError:
            # lower-casing is by code point: no final form of sigma
            return GENERAL.findall(unicodedata.normalize("NFC", text).replace("Σ", "σ").lower())

    def pieces(self, text: str) -> list[str]:
        """Words and control tokens in order."""
        if self.controls is None or "<|" not in text:
            return self.split(text)
        out: list[str] = []
        for k, part in enumerate(self.controls.split(text)):
            if k % 2:
                out.append(part + "\n")  # no word holds a line end
            elif part:
                out += self.split(part)
        return out

    def learn(self, wanted: set[str]) -> None:
        """Encodes the words that are not known yet."""
        known = self.words
        new = [w for w in wanted if w not in known]
        if not new:
            return
        if len(known) + len(new) > WORDS:
            known.clear()
            new = list(wanted)
        raw = [w.encode("utf-8") for w in new]
        short = [k for k, b in enumerate(raw) if len(b) <= LONG_WORD]
        for k, b in enumerate(raw):
            if len(b) > LONG_WORD:
                known[new[k]] = self.walk(b)
        for w in [w for w in new if w[-1] == "\n"]:
            known[w] = np.array([self.control[w[:-1]]], "<u4").tobytes()
        short = [k for k in short if new[k][-1] != "\n"]
        for lo in range(0, len(short), 50_000):
            part = short[lo : lo + 50_000]
            for k, ids in zip(part, self.walk_all([raw[k] for k in part]), strict=True):
                known[new[k]] = ids

    def encode(self, texts: list[str | None], most: int = 2_000_000) -> list[bytes]:
        """For each text its ids as little-endian unsigned 32-bit integers; `most` characters are split at a time."""
        out: list[bytes] = []
        lo = 0
        while lo < len(texts):
            hi, chars = lo, 0
            while hi < len(texts) and (hi == lo or chars < most):
                chars += len(texts[hi] or "")
                hi += 1
            split = [self.pieces(t) if t else [] for t in texts[lo:hi]]
            self.learn(set().union(*split))
            get = self.words.__getitem__
            out += [b"".join(map(get, w)) for w in split]
            lo = hi
        return out

    def decode(self, ids: bytes) -> str:
        """The arc labels in order, joined as the file's missing decoder does: by a space."""
        return " ".join(map(self.labels.__getitem__, np.frombuffer(ids, "<u4").tolist()))


def automaton(path: str) -> Automaton:
    """The compiled automaton of a file, once in each process."""
    return worker_table(("automaton", path), lambda: Automaton(path))


def encode_rows(docs, path: str, id_col: str = "doc_id", text_col: str = "text"):
    """One row per input row: id, ids (little-endian unsigned 32-bit), decoded text."""
    from .common import arrow_map, whole_text

    def one(batch):
        a = automaton(path)
        ids = a.encode(batch.column(1).to_pylist())
        return {id_col: batch.column(0), "ids": ids, "decoded": [a.decode(x) for x in ids]}

    return arrow_map(docs.select(id_col, whole_text(text_col).alias(text_col)), one, f"{id_col} {docs.schema[id_col].dataType.simpleString()}, ids binary, decoded string")


def encode_digests(docs, path: str, id_col: str = "doc_id", text_col: str = "text"):
    """As encode_rows(), with digests in place of the long columns, which then never leave the worker."""
    from hashlib import sha256

    from .common import arrow_map, whole_text

    def one(batch):
        a = automaton(path)
        ids = a.encode(batch.column(1).to_pylist())
        return {
            id_col: batch.column(0),
            "n_tokens": [len(x) // 4 for x in ids],
            "ids_sha256": [sha256(x).hexdigest() for x in ids],
            "decoded_sha256": [sha256(a.decode(x).encode("utf-8")).hexdigest() for x in ids],
        }

    return arrow_map(docs.select(id_col, whole_text(text_col).alias(text_col)), one, f"{id_col} {docs.schema[id_col].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string")
