"""Secrets in texts: three base patterns, and credential values that would be hard to guess.

The method beside the base patterns looks at values in a credential context (``pwd: x``, ``Authorization: Bearer x``,
``scheme://user:x@host`` and the like) and asks how many guesses a good guesser needs. Dynamic programming splits the value
into words, dates, repeats, keyboard walks and brute-force spans at the least total cost; costs are decimal logarithms of
guesses and add up. A value that costs ``MIN_COST`` or more and does not lie in a base span becomes a span of kind ``guess``;
it may overlap a base span that ends inside it.

Defined cases: a null text is an empty one and has no spans. Spans are code points, end exclusive, of the whole match for the
base kinds and of the value for ``guess``. Every row gives one row; repeated rows and null ids are kept as they are. An
empty table gives an empty result.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barwright.llm.flat import parts, released
from barwright.llm.words import WORDS

KINDS = ("assign", "access", "hex", "guess")

# The base patterns and their least lengths.
ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE
)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
MIN_ASSIGN, MIN_ACCESS, MIN_HEX = 6, 20, 24

#: Names of credentials, which may follow ``_`` or ``-``; the last group that matched is the value, up to its closing quote if it has one.
CONTEXT = re.compile(
    r"""(?:password|passwd|secret|token|api_?key|(?<![a-z0-9])(?:pwd|pass|passphrase|passcode|credentials?|auth|authorization|access_?key|private_?key|bearer))"""
    r"""["']?\x20*[:=]\x20*(?:bearer\x20+|basic\x20+)?(?:"([^\s"]{8,})"|'([^\s']{8,})'|["']?(?:bearer\x20+|basic\x20+)?([^\s"'<>,;]{8,}))""",
    re.ASCII | re.IGNORECASE,
)
#: User names in addresses, which may be empty; the value follows and ends at ``@``. A port is no value.
ADDRESS = re.compile(r"\b[a-z][a-z0-9+.-]{1,15}://[^\s:/@]{0,64}:(?!\d{1,5}(?:[/?#,;]|$))", re.ASCII | re.IGNORECASE)
ADDRESS_END = re.compile(r"[\s\"'<>@]")
MIN_VALUE = 8
#: What a text with a match must contain; searched by a linear automaton.
MAY_ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]"""
MAY_CONTEXT = r"""(?i)(password|passwd|secret|token|api_?key|pwd|pass|passphrase|passcode|credentials?|auth|authorization|access_?key|private_?key|bearer)["']?\x20*[:=]|://[^\s:/@]{0,64}:"""
MAY_HEX = r"[0-9a-f]{24}"

MIN_COST = 10.0

# Words that guessers try first, most frequent first, before those of ``WORDS``, and rows of a keyboard.
COMMON = (
    "password 123456 qwerty admin welcome login letmein dragon master monkey shadow secret changeme default example test "
    "user root guest demo sample hello sunshine princess football baseball iloveyou trustno superman batman summer winter "
    "spring autumn monday friday january company service server database system public private access token key value "
    "your here none null true false string todo insert placeholder required optional redacted hidden unknown"
).split()
ROWS = ("1234567890", "qwertyuiop", "asdfghjkl", "zxcvbnm", "abcdefghijklmnopqrstuvwxyz")

_RANK = {w: i + 1 for i, w in enumerate(dict.fromkeys([*COMMON, *WORDS]))}
_LONGEST = max(map(len, _RANK))
_NEXT = {(a, b) for row in ROWS for a, b in zip(row, row[1:], strict=False)} | {
    (b, a) for row in ROWS for a, b in zip(row, row[1:], strict=False)
}
_DATE = re.compile(r"(?:19|20)\d\d(?:[-/._]?(?:0[1-9]|1[0-2])(?:[-/._]?(?:0[1-9]|[12]\d|3[01]))?)?|\d{1,2}[-/.]\d{1,2}[-/.]\d{2,4}")
_LEET = str.maketrans("@4310$57!", "aaeiossti")


def _alphabet(c: str) -> float:
    """Logarithm of the number of characters a guesser tries at this place."""
    if c.isdigit():
        return 1.0
    if c.isalpha():
        return math.log10(26) if c.isascii() else 2.0
    return math.log10(33)


def guess_cost(value: str) -> float:
    """Logarithm of the guesses for the cheapest segmentation; linear in the length of the value.

    >>> guess_cost("") == 0 and guess_cost("password") < 2 < guess_cost("x9Kq2LmZ7w")
    True
    """
    n, low = len(value), value.lower()
    plain = low.translate(_LEET)
    brute = [_alphabet(c) for c in value]
    dates: dict[int, list[int]] = {}
    for i in range(n):
        if value[i].isdigit() and (m := _DATE.match(value, i)):
            dates.setdefault(m.end(), []).append(i)
    best = [0.0] + [math.inf] * n
    same = walk = 1
    period = [0] * 5  # period[p]: how many characters up to here equal the one p places before
    for end in range(1, n + 1):
        i = end - 1
        cost = best[i] + brute[i] + (0.3 if value[i].isupper() else 0.0)
        for size in range(3, min(_LONGEST, end) + 1):
            rank = _RANK.get(plain[end - size : end]) or _RANK.get(low[end - size : end])
            if rank:
                piece = value[end - size : end]
                cost = min(cost, best[end - size] + math.log10(rank + 1) + 0.3 * (piece != low[end - size : end]) + 0.3 * (not piece.isalpha()))
        for start in dates.get(end, ()):
            cost = min(cost, best[start] + 4.0)
        same = same + 1 if i and low[i] == low[i - 1] else 1
        walk = walk + 1 if i and (low[i - 1], low[i]) in _NEXT else 1
        if walk >= 3:
            cost = min(cost, best[end - walk] + 1.5 + math.log10(walk))
        if same >= 3:
            cost = min(cost, best[end - same] + brute[i] + math.log10(same))
        for p in range(2, 5):
            period[p] = period[p] + 1 if i >= p and low[i] == low[i - p] else 0
            if period[p] >= p:
                start = end - period[p] - p
                unit = best[start] + sum(brute[start : start + p])
                cost = min(cost, unit + math.log10(1 + period[p] / p))
        best[end] = cost
    return best[n]


def spans(text: str, may_assign: bool, may_access: bool, may_hex: bool, may_context: bool, min_cost: float) -> list[tuple[int, int, int]]:
    """``(start, kind, end)`` in order."""
    found = []
    if may_assign:
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= MIN_ASSIGN]
    if may_access:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= MIN_ACCESS]
    if may_hex:
        found += [(m.start(), 2, m.end()) for m in HEX.finditer(text) if m.end() - m.start() >= MIN_HEX]
    found.sort()
    if may_context:
        starts, reach = [s for s, _, _ in found], []
        for _, _, end in found:
            reach.append(max(end, reach[-1] if reach else 0))
        values = {m.span(m.lastindex) for m in CONTEXT.finditer(text)}
        stop = -1
        for m in ADDRESS.finditer(text):
            if m.end() > stop:  # the first of all addresses that end at one place holds the others' values
                end = ADDRESS_END.search(text, m.end())
                stop = end.start() if end else len(text)
                if end and end[0] == "@" and stop - m.end() >= MIN_VALUE:
                    values.add((m.end(), stop))
        for start, end in sorted(values):
            before = bisect_right(starts, start) - 1
            if (before < 0 or reach[before] < end) and guess_cost(text[start:end]) >= min_cost:
                found.append((start, 3, end))
        found.sort()
    return found


def _scanned(batch: pa.RecordBatch, min_cost: float) -> Iterator[tuple[int, str, list[tuple[int, int, int]]]]:
    """Row number, text and spans of the rows that may have any."""
    texts = batch.column("text").fill_null("")
    flags = [
        pc.match_substring_regex(texts, MAY_ASSIGN),
        pc.match_substring(texts, "AKIA"),
        pc.match_substring_regex(texts, MAY_HEX),
        pc.match_substring_regex(texts, MAY_CONTEXT),
    ]
    for i in pc.indices_nonzero(pc.or_(pc.or_(flags[0], flags[1]), pc.or_(flags[2], flags[3]))).to_pylist():
        text = texts[i].as_py()
        yield i, text, spans(text, *(f[i].as_py() for f in flags), min_cost)


def find_secrets(docs: DataFrame, min_cost: float = MIN_COST) -> DataFrame:
    """``doc_id`` and ``spans``: array of (start, kind, end), ordered by start and kind, per row."""
    kind = pa.list_(pa.struct([("start", pa.int32()), ("kind", pa.int32()), ("end", pa.int32())]))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in parts(whole):
                out: list[list[dict]] = [[] for _ in range(batch.num_rows)]
                for i, _, found in _scanned(batch, min_cost):
                    out[i] = [{"start": s, "kind": k, "end": e} for s, k, e in found]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(out, kind)], names=["doc_id", "spans"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(released(scan), "doc_id long, spans array<struct<start: int, kind: int, end: int>>")


def redact(text: str, found: list[tuple[int, int, int]]) -> str:
    """The text with every span, overlapping ones as one, replaced by the kind of its first span in brackets."""
    out, at = [], 0
    merged: list[list[int]] = []
    for start, kind, end in found:
        if merged and start < merged[-1][2]:
            merged[-1][2] = max(merged[-1][2], end)
        else:
            merged.append([start, kind, end])
    for start, kind, end in merged:
        out += [text[at:start], f"[{KINDS[kind]}]"]
        at = end
    return "".join([*out, text[at:]])


def redacted(docs: DataFrame, min_cost: float = MIN_COST) -> DataFrame:
    """All rows and columns of ``docs`` with the secrets of ``text`` replaced; ``n_chars``, if it is there, follows the new text."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in parts(whole):
                new = {i: redact(text, found) for i, text, found in _scanned(batch, min_cost) if found}
                for name, value in (("text", lambda t: t), ("n_chars", len)):
                    if new and name in batch.schema.names:
                        at = batch.schema.get_field_index(name)
                        column = batch.column(at).to_pylist()
                        for i, text in new.items():
                            column[i] = value(text)
                        batch = batch.set_column(at, batch.schema.field(at), pa.array(column, batch.schema.field(at).type))
                yield batch

    return docs.mapInArrow(released(scan), docs.schema)
