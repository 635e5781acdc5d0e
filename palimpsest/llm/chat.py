"""Chat formatting from an event log.

A log holds, per conversation, events in sequence: whole messages, streamed deltas, edits, regenerations and
deletions. Events are dealt by ranges of (conversation, message), so a conversation of any length is spread
over tasks; each task sorts its events, folds them into final messages and renders them. The rendered
segments of a conversation, one for each range it touches, are then joined in order. Only segments meet in
one task, as they must: a conversation is one row of output.

Events of one message, in order of seq (ties: kind, role, text): `message` begins a message with its text;
`delta` appends; `edit` replaces the text; `regenerate` empties it, for deltas to come; `delete` removes it.
Deltas or edits without a message begin one. Two `message` events under one number are two messages. A null
text counts as empty, a null role as an empty one; other kinds are ignored.

Template: `<s>[INST] role [/INST]\\n` text `</s>\\n`. A backslash inside a role or text is doubled and one is put
after the first character of any control string, so no control string is ever part of a message, and
unescaping restores every text.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.common import emit, pick, slices

CONTROL = ("<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<|im_start|>", "<|im_end|>", "<|endoftext|>")
_CONTROL = re.compile("|".join(map(re.escape, CONTROL)))
_ESCAPED = re.compile(r"\\(.)", re.S)
_TURN = re.compile(r"<s>\[INST\] (.*?) \[/INST\]\n(.*?)</s>\n", re.S)
LEARNED = "assistant"
EVENT = "conv_id long, message long, seq long, kind string, role string, text string"


def escape(text: str) -> str:
    return _CONTROL.sub(lambda m: m[0][0] + "\\" + m[0][1:], text.replace("\\", "\\\\"))


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


def fold(events: list[tuple[str, str | None, str | None]]) -> list[tuple[str, str]]:
    """The final (role, text) messages of one message number's (kind, role, text) events, in order."""
    out: list[list] = []
    for kind, role, text in events:
        text = text or ""
        if kind == "message" or kind in ("delta", "edit") and not out:
            out.append([role or "", [text]])
        elif not out:
            continue
        elif kind == "delta":
            out[-1][1].append(text)
        elif kind == "edit":
            out[-1][1] = [text]
        elif kind == "regenerate":
            out[-1][1] = []
        elif kind == "delete":
            out.pop()
            continue
        if out and not out[-1][0] and role:
            out[-1][0] = role
    return [(role, "".join(parts)) for role, parts in out]


def render(messages: list[tuple[str, str]], at: int = 0) -> tuple[str, list[tuple[int, int]]]:
    """The formatted text, and the (start, length) spans of what is learned, counted from `at`."""
    parts, spans = [], []
    for role, text in messages:
        head, body = f"<s>[INST] {escape(role)} [/INST]\n", escape(text)
        if role == LEARNED:
            spans.append((at + len(head), len(body)))
        parts += [head, body, "</s>\n"]
        at += len(head) + len(body) + 5
    return "".join(parts), spans


def parse(formatted: str) -> list[tuple[str, str]]:
    """The (role, text) turns of a formatted conversation."""
    out, at = [], 0
    for m in _TURN.finditer(formatted):
        if m.start() != at:
            break
        out.append((unescape(m[1]), unescape(m[2])))
        at = m.end()
    if at != len(formatted):
        raise ValueError("not a formatted conversation")
    return out


def events_of(turns: DataFrame) -> DataFrame:
    """Rows (conv_id, turn, role, text) as `message` events; other columns are dropped."""
    own = pick(turns, conv_id="conv_id", message="turn", role="role", text="text")
    return own.select(F.col("conv_id").cast("long"), F.col("message").cast("long"), F.lit(0).cast("long").alias("seq"), F.lit("message").alias("kind"), "role", "text")


def conversations(events: DataFrame) -> DataFrame:
    """(conv_id, n_turns, formatted, loss): one row per conversation that has a message left.

    loss: array of (start, length) in code points of formatted. A null conv_id is a conversation like any
    other; null message numbers come first.
    """
    own = events.select("conv_id", "message", "seq", "kind", "role", "text")
    dealt = own.repartitionByRange(F.col("conv_id"), F.col("message")).sortWithinPartitions("conv_id", "message", "seq", "kind", "role", "text")
    span = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64())]))
    spans = "array<struct<start:long,length:long>>"
    segment = pa.schema([("conv_id", pa.int64()), ("part", pa.int32()), ("n_turns", pa.int64()), ("formatted", pa.string()), ("loss", span)])

    def segments(batches):
        part = TaskContext.get().partitionId()
        key, of, texts, loss, at, n = None, None, [], [], 0, 0
        open_events: list[tuple] = []

        def settle():
            nonlocal at, n
            if open_events:
                messages = fold(open_events)
                piece, spans = render(messages, at)
                texts.append(piece)
                loss.extend(spans)
                at += len(piece)
                n += len(messages)
                open_events.clear()

        def segment_of():
            settle()
            if n:
                yield emit(segment, {"conv_id": [of[0]], "part": [part], "n_turns": [n], "formatted": ["".join(texts)], "loss": [[{"start": a, "length": b} for a, b in loss]]})

        for b in batches:
            for conv, message, _, kind, role, text in zip(*(c.to_pylist() for c in b.columns)):
                if key != (conv, message):
                    if of is not None and of != (conv,):
                        yield from segment_of()
                        texts, loss, at, n = [], [], 0, 0
                    else:
                        settle()
                    key, of = (conv, message), (conv,)
                open_events.append((kind, role, text))
        if of is not None:
            yield from segment_of()

    cut = dealt.mapInArrow(segments, f"conv_id long, part int, n_turns long, formatted string, loss {spans}")
    met = cut.groupBy("conv_id").agg(F.sum("n_turns").alias("n_turns"), F.sort_array(F.collect_list(F.struct("part", "formatted", "loss"))).alias("segments"))
    whole = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("formatted", pa.string()), ("loss", span)])

    def joined(batches):
        for b in batches:
            formatted, loss = [], []
            for parts in b.column(2).to_pylist():
                at, spans = 0, []
                for p in parts:
                    spans += [{"start": at + s["start"], "length": s["length"]} for s in p["loss"]]
                    at += len(p["formatted"])
                formatted.append("".join(p["formatted"] for p in parts))
                loss.append(spans)
            yield emit(whole, {"conv_id": b.column(0), "n_turns": b.column(1), "formatted": formatted, "loss": loss})

    return met.mapInArrow(joined, f"conv_id long, n_turns long, formatted string, loss {spans}")


def digests(formatted: DataFrame) -> DataFrame:
    """What reading `conversations` rows back shows: turns, loss text and sizes, as digests."""
    schema = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])

    def run(batches):
        for b in slices(batches, "formatted"):
            out: list[list] = [[] for _ in schema]
            for conv, text, loss in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist()):
                turns = parse(text)
                learned = "".join(unescape(text[s["start"] : s["start"] + s["length"]]) for s in loss)
                row = [conv, len(turns), hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest(), len(learned), hashlib.sha256(learned.encode()).hexdigest(), len(text)]
                for c, v in zip(out, row):
                    c.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(out, schema)], schema=schema)

    return formatted.select("conv_id", "formatted", "loss").mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
