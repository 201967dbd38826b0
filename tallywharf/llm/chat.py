r"""Chat formatting with offset-aligned loss masks (operator 1).

A conversation is rendered whole, as turns `[INST]role[/INST]text</s>`, and encoded once with offsets. The sorted
character spans of the assistant texts are intersected with the token spans by binary search: a token is under the
loss when it meets such a span, and the loss spans are the intersections, joined. Control strings are added to the tokenizer as
control tokens, so no token crosses a turn.

Control strings (also the tokenizer's own) inside roles and texts are escaped reversibly: a backslash becomes two, and
a control string gets `\.` after its first character. unescape() gives back the original.

Turns come from sorted partitions as a stream. A conversation of over `PART_CHARS` is encoded in parts cut between turns; the tokens
are those of the whole, since control tokens separate turns, and memory stays bounded however many turns a conversation has.

Defined results: turns go by (turn, role, text), nulls first, repeated rows stay; null role or text counts as empty; a null
conv_id is a conversation of its own; an empty table gives no rows.
"""

from __future__ import annotations

import re
from hashlib import sha256

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ship, worker_table

OPEN, MIDDLE, END = "[INST]", "[/INST]", "</s>"
#: Characters encoded at a time, and in a part of a very long conversation.
PART_CHARS = 1_000_000

FORMATTED = "conv_id long, part int, formatted string, input_ids array<int>, loss_mask array<tinyint>, loss_spans array<struct<start:int,end:int>>"


class Template:
    """Renders, escapes and reads back; `controls` are all strings that must not occur in a text as they are."""

    def __init__(self, controls: list[str]):
        self.controls = sorted({OPEN, MIDDLE, END, *controls}, key=len, reverse=True)
        self.special = re.compile("|".join(["\\\\", *map(re.escape, self.controls)]))
        self.marks = re.compile("|".join(map(re.escape, (OPEN, MIDDLE, END))))

    def escape(self, text: str) -> str:
        return self.special.sub(lambda m: "\\\\" if m[0] == "\\" else f"{m[0][0]}\\.{m[0][1:]}", text)

    @staticmethod
    def unescape(text: str) -> str:
        return re.sub(r"\\(\\|\.)", lambda m: "\\" if m[1] == "\\" else "", text)

    def render(self, turns: list[tuple[str, str]]) -> tuple[str, list[tuple[int, int]]]:
        """The text of the turns, and the spans of the assistant's texts in it."""
        out, at, spans = [], 0, []
        for role, text in turns:
            head, body = f"{OPEN}{self.escape(role)}{MIDDLE}", self.escape(text)
            if role == "assistant" and body:
                spans.append((at + len(head), at + len(head) + len(body)))
            out += [head, body, END]
            at += len(head) + len(body) + len(END)
        return "".join(out), spans

    def parse(self, formatted: str) -> list[tuple[str, str]]:
        """The turns that render() was given."""
        parts = self.marks.split(formatted)[:-1]  # after each OPEN nothing, role, text
        return [(self.unescape(parts[i + 1]), self.unescape(parts[i + 2])) for i in range(0, len(parts), 3)]


def tools(path: str):
    """The tokenizer with the template's control tokens, and the template; once in each process."""

    def build():
        from tokenizers import AddedToken, Tokenizer, processors

        tok = Tokenizer.from_file(path)
        own = [t.content for t in tok.get_added_tokens_decoder().values()]
        tok.add_special_tokens([AddedToken(x, special=True, normalized=False) for x in (OPEN, MIDDLE, END)])
        tok.post_processor = processors.ByteLevel(trim_offsets=False)
        tok.no_truncation(), tok.no_padding()
        return tok, Template(own)

    return worker_table(("chat", path), build)


def mask(spans: list[tuple[int, int]], offsets: list[tuple[int, int]]) -> tuple[np.ndarray, list[tuple[int, int]]]:
    """For each token whether it meets a span; the intersections, joined where they touch within one span."""
    out = np.zeros(len(offsets), np.int8)
    if not spans or not offsets:
        return out, []
    starts, ends = np.array(spans).T
    lo, hi = np.array(offsets).T
    k = np.searchsorted(ends, lo, side="right")  # the first span that ends after the token's start
    safe = np.minimum(k, len(ends) - 1)
    hit = (k < len(ends)) & (starts[safe] < hi) & (lo < hi)
    out[hit] = 1
    cut: list[list[int]] = []
    for s, e, owner in zip(np.maximum(lo, starts[safe])[hit].tolist(), np.minimum(hi, ends[safe])[hit].tolist(), safe[hit].tolist(), strict=True):
        if cut and cut[-1][2] == owner and s <= cut[-1][1]:
            cut[-1][1] = max(e, cut[-1][1])
        else:
            cut.append([s, e, owner])
    return out, [(s, e) for s, e, _ in cut]


def format_conversations(turns: DataFrame, path: str) -> DataFrame:
    """Rows of `FORMATTED`: a conversation in one part, or in several in order when it is very long."""
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    ship(turns.sparkSession)
    schema = to_arrow_schema(_parse_datatype_string(FORMATTED))

    def run(batches):
        tok, template = tools(path)
        ready: list[tuple[int | None, int, str, list]] = []
        chars = 0

        def flush():
            codes = tok.encode_batch([r[2] for r in ready], add_special_tokens=False)
            cols: list[list] = [[] for _ in schema.names]
            for (conv, part, text, spans), e in zip(ready, codes, strict=True):
                hit, cut = mask(spans, e.offsets)
                for c, v in zip(cols, (conv, part, text, e.ids, hit, [{"start": s, "end": t} for s, t in cut]), strict=True):
                    c.append(v)
            ready.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, schema, strict=True)], schema=schema)

        now, part, held, size, any_ = None, 0, [], 0, False
        for b in batches:
            for conv, role, text in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                if any_ and (conv != now or size > PART_CHARS):
                    ready.append((now, part, *template.render(held)))
                    chars += size
                    part, held, size = (part + 1 if conv == now else 0), [], 0
                    if chars > PART_CHARS:
                        yield flush()
                        chars = 0
                now, any_ = conv, True
                held.append((role, text))
                size += len(role) + len(text) + 20
        if held:
            ready.append((now, part, *template.render(held)))
        if ready:
            yield flush()

    one = [F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").alias("turn"), *(F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("role", "text"))]
    rows = turns.select(*one).repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").select("conv_id", "role", "text")
    return rows.mapInArrow(run, FORMATTED)


def read_back(formatted: DataFrame, path: str) -> DataFrame:
    """Digests of format_conversations()'s rows, taken from its texts and loss spans; parts follow one another."""
    names = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_tokens long, loss_tokens long"

    def run(batches):
        import pandas as pd

        _, template = tools(path)
        now: list | None = None

        def row(x):
            return [x[0], x[1], x[2].hexdigest(), x[3], x[4].hexdigest(), *x[5:]]

        cols = [x.split()[0] for x in names.split(", ")]
        for b in batches:
            done = []
            for conv, part, text, hit, spans in zip(*(b.column(n).to_pylist() for n in ("conv_id", "part", "formatted", "loss_mask", "loss_spans")), strict=True):
                if part == 0:
                    if now:
                        done.append(row(now))
                    now = [conv, 0, sha256(), 0, sha256(), 0, 0, 0]
                turns = template.parse(text)
                loss = template.unescape("".join(text[s["start"] : s["end"]] for s in spans))
                now[2].update("".join(f"{r}\n{t}\n" for r, t in turns).encode("utf-8"))
                now[4].update(loss.encode("utf-8"))
                for i, v in ((1, len(turns)), (3, len(loss)), (5, len(text)), (6, len(hit)), (7, sum(hit))):
                    now[i] += v
            if done:
                yield pd.DataFrame(done, columns=cols)
        if now:
            yield pd.DataFrame([row(now)], columns=cols)

    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    schema = to_arrow_schema(_parse_datatype_string(names))

    def arrow(batches):
        for pdf in run(batches):
            yield pa.RecordBatch.from_arrays([pa.array([None if v != v else v for v in pdf[f.name].tolist()], f.type) for f in schema], schema=schema)

    return formatted.mapInArrow(arrow, names)
