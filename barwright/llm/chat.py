"""Conversations as training text, with the place of every turn found by rendering prefixes of a black-box template.

A template is any function from a list of (role, text) to a string. ``format_chats`` renders the first turn, the first two,
and so on. What a turn adds to the output before it is the turn's span. Two probe texts in place of the turn's own show
how much of the span stands before and after the text: the rest is the content, which the loss mask covers for the
roles that are learnt. A template that changes what it had written (strips earlier reasoning, moves an end mark) is found
by the same comparison; its turns get no spans, and the place of the first such turn is reported.

A conversation passes as a stream of its rows in order. It is rendered in segments of at most ``SEGMENT`` turns (fewer when
their texts pass ``SEGMENT_CHARS``), each behind the last ``CONTEXT`` turns of the one before, so that rendering prefixes
costs a bounded number of renders a turn and a task holds one segment, however long the conversation is. A template may
look back further than ``CONTEXT`` turns only within a segment. The rows of one conversation come to one task because its output is one text in order.

Defined cases: turns stand in the order of turn (null first), role and text; a null role or text is an empty one. Rows that
are equal are turns of their own. A null conv_id is a conversation. Other columns are ignored. An empty table gives none.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Turns = list[tuple[str, str]]
Template = Callable[[Turns], str]

SEGMENT = 64
SEGMENT_CHARS = 1 << 20
CONTEXT = 2
LEARNT = ("assistant",)

SEGMENTS = (
    "conv_id long, segment long, formatted string, rewritten_turn long, "
    "turns array<struct<role: string, start: long, end: long, loss_start: long, loss_end: long>>"
)
_SPAN = pa.struct([("role", pa.string()), *((n, pa.int64()) for n in ("start", "end", "loss_start", "loss_end"))])
_SEGMENT = pa.schema([
    ("conv_id", pa.int64()), ("segment", pa.int64()), ("formatted", pa.string()), ("rewritten_turn", pa.int64()), ("turns", pa.list_(_SPAN)),
])

# The control strings of ``inst_template``.
_CONTROL = re.compile(r"<\\*(?=/?s>)|\[\\*(?=/?(?:INST|SYS|ROLE)\])")
_ESCAPED = re.compile(r"(?:<\\+(?=/?s>)|\[\\+(?=/?(?:INST|SYS|ROLE)\]))")
_TURN = re.compile(r"<s>\[INST\] (.*?) \[/INST\]|\[SYS\] (.*?) \[/SYS\]|\[ROLE\](.*?)\[/ROLE\] (.*?) </s>| (.*?) </s>", re.DOTALL)


def escape(text: str) -> str:
    """A backslash more behind the first character of every control string, escaped ones too, so that it can be undone.

    >>> escape("a </s> b"), unescape(escape("</s> [\\\\INST]"))
    ('a <\\\\/s> b', '</s> [\\\\INST]')
    """
    return _CONTROL.sub(lambda m: m[0] + "\\", text) if "<" in text or "[" in text else text


def unescape(text: str) -> str:
    return _ESCAPED.sub(lambda m: m[0][:-1], text) if "\\" in text else text


def inst_template(turns: Turns) -> str:
    """Marks of its own for user, assistant and system turns, and a named mark for all other roles."""
    out = []
    for role, text in turns:
        held = escape(text)
        if role == "user":
            out.append(f"<s>[INST] {held} [/INST]")
        elif role == "assistant":
            out.append(f" {held} </s>")
        elif role == "system":
            out.append(f"[SYS] {held} [/SYS]")
        else:
            out.append(f"[ROLE]{escape(role)}[/ROLE] {held} </s>")
    return "".join(out)


def read_inst(formatted: str) -> Turns:
    """The turns that ``inst_template`` wrote."""
    turns, at = [], 0
    while at < len(formatted):
        m = _TURN.match(formatted, at)
        if not m:
            raise ValueError(f"no turn at {at}")
        user, system, role, other, assistant = m.groups()
        for name, text in (("user", user), ("system", system), (role and unescape(role) or "", other), ("assistant", assistant)):
            if text is not None:
                turns.append((name, unescape(text)))
        at = m.end()
    return turns


def _content(template: Template, before: Turns, role: str, base: int, output: str) -> tuple[int, int] | None:
    """Where the text of the last turn stands in the output, by two probes that differ in all characters."""
    one, two = (template([*before, (role, probe)])[base:] for probe in ("0", "1"))
    head = len(os.path.commonprefix([one, two]))
    tail = len(os.path.commonprefix([one[::-1], two[::-1]]))
    own = output[base:]
    if len(own) < head + tail or own[:head] != one[:head] or own[len(own) - tail :] != one[len(one) - tail :]:
        return None
    return base + head, len(output) - tail


def located(template: Template, turns: Turns, context: Turns, learnt: tuple[str, ...] = LEARNT) -> tuple[str, list[dict], int | None]:
    """What the turns add behind their context, their spans in it, and the first turn that changes what stood before.

    Offsets count from the first character behind the context.
    """
    seen = list(context)
    output = start = template(seen) if seen else ""
    spans: list[dict] = []
    rewritten = None
    for place, (role, text) in enumerate(turns):
        longer = template([*seen, (role, text)])
        if not longer.startswith(output):
            rewritten = place
            break
        held = _content(template, seen, role, len(output), longer) if role in learnt else None
        begin, end = held or (None, None)
        shift = len(start)
        spans.append({
            "role": role, "start": len(output) - shift, "end": len(longer) - shift,
            "loss_start": None if begin is None else begin - shift, "loss_end": None if end is None else end - shift,
        })
        seen.append((role, text))
        output = longer
    if rewritten is None:
        return output[len(start) :], spans, None
    whole = template([*context, *turns])
    none = {"start": None, "end": None, "loss_start": None, "loss_end": None}
    return whole[len(start) :] if whole.startswith(start) else whole, [{"role": role, **none} for role, _ in turns], rewritten


def ordered(rows: DataFrame) -> DataFrame:
    """``conv_id, turn, role, text``: all rows of a conversation in one partition, in order."""
    rows = rows.select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").cast("long").alias("turn"),
        F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    )
    return rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")


def format_chats(rows: DataFrame, template: Template = inst_template, learnt: tuple[str, ...] = LEARNT, segment: int = SEGMENT) -> DataFrame:
    """Segments of formatted conversations, those of one conversation in order in one partition.

    ``formatted`` of a conversation's segments, joined, is its training text. ``turns`` has the spans in ``formatted`` (code points,
    end exclusive); ``loss_start`` and ``loss_end`` cover the text of learnt roles. ``rewritten_turn`` is the place in the
    conversation of the first turn of this segment that rewrote what stood before, null if none did.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key: tuple = ()
        number = place = chars = ready_chars = 0
        held: Turns = []
        context: Turns = []
        ready: list[dict] = []

        def flush() -> None:
            formatted, spans, rewritten = located(template, held, context, learnt)
            changed = None if rewritten is None else place + rewritten
            ready.append({"conv_id": key[0], "segment": number, "formatted": formatted, "rewritten_turn": changed, "turns": spans})

        for batch in batches:
            columns = (batch.column(n).to_pylist() for n in ("conv_id", "role", "text"))
            for conv_id, role, text in zip(*columns, strict=True):
                if key != (conv_id,):
                    if held:
                        flush()
                    ready_chars += chars
                    key, number, place, chars, held, context = (conv_id,), 0, 0, 0, [], []
                elif len(held) == segment or chars > SEGMENT_CHARS:
                    flush()
                    ready_chars += chars
                    number, place, chars, context, held = number + 1, place + len(held), 0, held[-CONTEXT:], []
                if len(ready) >= 256 or ready_chars > SEGMENT_CHARS:
                    yield pa.RecordBatch.from_pylist(ready, schema=_SEGMENT)
                    ready, ready_chars = [], 0
                held.append((role, text))
                chars += len(text)
        if held:
            flush()
        yield pa.RecordBatch.from_pylist(ready, schema=_SEGMENT)

    return ordered(rows).mapInArrow(run, SEGMENTS)


DIGESTS = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, rewritten boolean"
_DIGEST = pa.schema([
    ("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()),
    ("loss_sha256", pa.string()), ("formatted_chars", pa.int64()), ("rewritten", pa.bool_()),
])


def digests(segments: DataFrame, read: Callable[[str], Turns] = read_inst, plain: Callable[[str], str] = unescape) -> DataFrame:
    """One row a conversation, read back from ``format_chats``: its turns, and the text that the loss mask covers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key: tuple = ()
        turns = loss = None
        counts = [0, 0, 0]
        rewritten = False
        done: list[dict] = []

        def close() -> None:
            done.append({
                "conv_id": key[0], "n_turns": counts[0], "turns_sha256": turns.hexdigest(), "loss_chars": counts[1],
                "loss_sha256": loss.hexdigest(), "formatted_chars": counts[2], "rewritten": rewritten,
            })

        for batch in batches:
            columns = (batch.column(n).to_pylist() for n in ("conv_id", "formatted", "turns", "rewritten_turn"))
            for conv_id, formatted, spans, changed in zip(*columns, strict=True):
                if key != (conv_id,):
                    if key:
                        close()
                    key, counts, rewritten = (conv_id,), [0, 0, 0], False
                    turns, loss = hashlib.sha256(), hashlib.sha256()
                for role, text in read(formatted):
                    turns.update(f"{role}\n{text}\n".encode())
                    counts[0] += 1
                for span in spans:
                    if span["loss_start"] is not None:
                        text = plain(formatted[span["loss_start"] : span["loss_end"]])
                        loss.update(text.encode())
                        counts[1] += len(text)
                counts[2] += len(formatted)
                rewritten = rewritten or changed is not None
            yield pa.RecordBatch.from_pylist(done, schema=_DIGEST)
            done = []
        if key:
            close()
        yield pa.RecordBatch.from_pylist(done, schema=_DIGEST)

    return segments.mapInArrow(run, DIGESTS)
