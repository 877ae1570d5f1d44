"""Repair of conversations whose turns are damaged, at the least cost of edits.

A repaired conversation is empty or has roles ``system? (user assistant)+``. Edits: keep a row, give it the role user or assistant,
delete it (required for blank and repeated rows), insert an empty turn; rows that break off cost extra unless deleted. The
cheapest edits of a row are a 4 x 4 min-plus matrix over the states of that pattern; an entry holds a cost and the edits'
letters as a rope, and of equal costs the least letters. Edits of joined sequences are products of matrices. That order
carries over to products: two edit strings of one cost over the same rows differ before either ends.

Conversations become strings of one character a row (role and fault). Re-Pair finds the pairs of symbols that are most frequent in
all conversations and makes rules of them, some in a round, each round one aggregation over the distinct strings. Every rule gets its
matrix once, from those of its two symbols; all conversations share them. At most ``MAX_RULES`` rules of at most ``RULE_ROWS``
rows are made; rows that no rule covers are spelt out, so the bound decides nothing but work.

Rows of one conversation are gathered per ``CHUNK`` turn numbers; a conversation's whole string has one byte a row. Texts go
past in order as a stream when the edits are applied, since the repaired conversation is one text in order.

Defined cases: rows stand in the order of turn (null first), role, and digest of the text. Equal rows are rows of their own, the second
one a duplicate. A null conv_id is a conversation. A role that is empty or starts with another letter than s, u, a can only be
changed or deleted. A conversation without rows has no edits. Other columns are ignored. An empty table gives none.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barwright.llm.store import stored

CHUNK = 256
MAX_RULES = 128
RULE_ROWS = 4096
#: Rules that one round may add, and the share of all rows that a rule must stand for.
ROUND_RULES, LEAST_SHARE = 8, 1 / 64
KNOWN = 100_000

# Costs of edits, blanks, ends of sentences.
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5
BLANKS = " \t\n\x0b\x0c\r"
ENDS = ".!?"

#: States of the pattern: nothing yet, after system, after user, after assistant. The pattern may end in the first and the last.
START, SYSTEM, USER, ASSISTANT = STATES = range(4)
LAST = (START, ASSISTANT)
#: The role that may follow a state by an insertion or a change, and the state it leads to.
NEXT = {START: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}
NAMES = {USER: "user", ASSISTANT: "assistant"}
#: A row that must go. Other symbols are s, u, a, o (any other role), in capitals if the text breaks off.
GONE = "x"


class Rope:
    """Joined letters: a text, or two ropes, spelt out when first asked for."""

    __slots__ = ("left", "right", "spelt")

    def __init__(self, left: Rope | None, right: Rope | None, spelt: str | None = None) -> None:
        self.left, self.right, self.spelt = left, right, spelt

    def text(self) -> str:
        if self.spelt is None:
            parts: list[str] = []
            todo = [self]
            while todo:
                rope = todo.pop()
                if rope.spelt is not None:
                    parts.append(rope.spelt)
                else:
                    todo += [rope.right, rope.left]
            self.spelt = "".join(parts)
            self.left = self.right = None
        return self.spelt


Entry = tuple[int, Rope] | None
Matrix = list[list[Entry]]


def better(a: Entry, b: Entry) -> Entry:
    if a is None or b is None:
        return a or b
    if a[0] != b[0]:
        return a if a[0] < b[0] else b
    return a if a[1].text() <= b[1].text() else b


def product(a: Matrix, b: Matrix) -> Matrix:
    """Cheapest ways through ``a``, then ``b``."""
    out: Matrix = []
    for row in a:
        line: list[Entry] = []
        for j in STATES:
            best: Entry = None
            for k, first in enumerate(row):
                second = b[k][j]
                if first is not None and second is not None:
                    cost = first[0] + second[0]
                    if best is None or cost <= best[0]:
                        best = better(best, (cost, Rope(first[1], second[1])))
            line.append(best)
        out.append(line)
    return out


def _leaf(letters: str) -> Rope:
    return Rope(None, None, letters)


def insertions() -> Matrix:
    """Cheapest insertions between two rows, none included."""
    out: Matrix = [[(0, _leaf("")) if i == j else None for j in STATES] for i in STATES]
    for start in STATES:
        state, letters = start, ""
        while len(letters) < 2:
            state, letters = NEXT[state], letters + "I"
            out[start][state] = better(out[start][state], (INSERT * len(letters), _leaf(letters)))
    return out


INSERTIONS = insertions()


def terminal(symbol: str) -> Matrix:
    """Insertions before a row, then the row's own edit."""
    edit: Matrix = [[(DELETE, _leaf("D")) if i == j else None for j in STATES] for i in STATES]
    if symbol != GONE:
        extra = TRUNCATED if symbol.isupper() else 0
        kept = {"s": SYSTEM, "u": USER, "a": ASSISTANT}.get(symbol.lower())
        for state, after in NEXT.items():
            edit[state][after] = better(edit[state][after], (REROLE + extra, _leaf("R")))
            if kept == after:
                edit[state][after] = better(edit[state][after], (KEEP + extra, _leaf("K")))
        if kept == SYSTEM:
            edit[START][SYSTEM] = (KEEP + extra, _leaf("K"))
    return product(INSERTIONS, edit)


TERMINALS = GONE + "suaoSUAO"


def matrices(rules: list[tuple[str, str]]) -> dict[str, Matrix]:
    """One matrix per symbol, the rules' bottom-up; a rule's symbols stand before it."""
    known = {c: terminal(c) for c in TERMINALS}
    for name, pair in rules:
        known[name] = product(known[pair[0]], known[pair[1]])
    return known


def compressed(marks: str, rules: list[tuple[str, str]]) -> str:
    for name, pair in rules:
        marks = marks.replace(pair, name)
    return marks


def cheapest(marks: str, rules: list[tuple[str, str]], known: dict[str, Matrix]) -> tuple[int, str]:
    """Cost and letters of the cheapest edits of a whole conversation."""
    todo = [known[c] for c in compressed(marks, rules)]
    while len(todo) > 1:  # halves, so that ropes stay shallow
        todo = [product(*todo[i : i + 2]) if i + 1 < len(todo) else todo[i] for i in range(0, len(todo), 2)]
    whole = product(todo[0], INSERTIONS) if todo else INSERTIONS
    best: Entry = None
    for state in LAST:
        best = better(best, whole[START][state])
    return best[0], best[1].text()


def grammar(strings: DataFrame, most: int = MAX_RULES) -> list[tuple[str, str]]:
    """Re-Pair rules ``(name, pair)`` for the column ``marks`` of distinct strings, each counted ``n`` times.

    Names are characters of a private area. Pairs that share no symbol join in one round. The driver gets the most frequent
    pairs only.
    """
    schema = pa.schema([("pair", pa.string()), ("n", pa.int64())])
    rules: list[tuple[str, str]] = []
    rows = {c: 1 for c in TERMINALS}
    total = strings.agg(F.sum(F.length("marks") * F.col("n"))).first()[0] or 0
    while len(rules) < most:
        so_far = list(rules)

        def count(batches: Iterator[pa.RecordBatch], so_far: list = so_far) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                total: Counter = Counter()
                for marks, n in zip(batch.column("marks").to_pylist(), batch.column("n").to_pylist(), strict=True):
                    marks = compressed(marks, so_far)
                    for pair, times in Counter(map("".join, zip(marks, marks[1:], strict=False))).items():
                        total[pair] += n * times
                yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.array(list(total.values()), pa.int64())], schema=schema)

        pairs = strings.mapInArrow(count, "pair string, n long").groupBy("pair").agg(F.sum("n").alias("n"))
        top = pairs.where("n > 1").orderBy(F.desc("n"), "pair").limit(4 * ROUND_RULES).collect()
        used: set[str] = set()
        for pair, n in top:
            size = rows[pair[0]] + rows[pair[1]]
            if n * size < LEAST_SHARE * total or used & set(pair) or size > RULE_ROWS or len(used) >= 2 * ROUND_RULES or len(rules) == most:
                continue
            used |= set(pair)
            name = chr(0xE000 + len(rules))
            rules.append((name, pair))
            rows[name] = size
        if not used:
            break
    return rules


def damaged(rows: DataFrame) -> DataFrame:
    """``conv, turn, role, text, n``: rows after damage by a checksum of conversation and turn; ``n`` copies stand side by side.

    A dropped row has no copies, so that its conversation stays known. ``conv`` is the id as text, empty for null.
    """
    turn = F.col("turn").cast("long")
    conv = F.col("conv_id").cast("long").cast("string")
    blank = F.lit(" ")
    kind = F.crc32(F.concat(F.coalesce(conv, blank), F.lit(":"), F.coalesce(turn.cast("string"), blank)).cast("binary")) % 20
    role, text = (F.coalesce(F.col(c).cast("string"), blank) for c in ("role", "text"))
    return rows.select(
        F.coalesce(conv, F.lit("")).alias("conv"),
        turn.alias("turn"),
        F.when(kind == 4, F.lit("user")).otherwise(role).alias("role"),
        F.when(kind == 1, F.lit("")).when(kind == 2, F.translate(text, ENDS, "")).otherwise(text).alias("text"),
        F.when(kind == 0, 0).when(kind == 3, 2).otherwise(1).alias("n"),
    )


def _digest() -> Column:
    return F.substring(F.sha2(F.col("text").cast("binary"), 256), 1, 32)


def strings(rows: DataFrame) -> DataFrame:
    """``conv, marks, gaps, blank, duplicate, truncated, illegal`` per conversation of ``rows(conv, turn, role, text, n)``."""
    spark = rows.sparkSession
    bare = F.rtrim(F.col("text"), F.lit(BLANKS))
    initial = F.substring("role", 1, 1)
    counted = (
        rows.select(
            "conv", "turn", "role", _digest().alias("own"), "n",
            (bare == "").alias("is_blank"),
            (~F.substring(bare, -1, 1).isin(*ENDS)).alias("is_cut"),
            F.when(initial.isin("s", "u", "a"), initial).otherwise("o").alias("initial"),
        )
        .groupBy("conv", "turn", "role", "own", "is_blank", "is_cut", "initial")
        .agg(F.sum("n").alias("n"))
    )
    counted = stored(spark, "turns", counted)
    place = F.struct(F.col("turn").isNotNull().alias("known"), "turn")  # null turns stand first
    first = counted.where("n > 0").groupBy("conv", "role", "own").agg(F.min(place).alias("first"))
    first = stored(spark, "first-turns", first)
    rows = counted.join(first, ["conv", "role", "own"], "left")
    is_first = F.coalesce(F.col("first") == place, F.lit(False))
    alone = is_first & ~F.col("is_blank")
    symbol = F.when(F.col("is_cut"), F.upper("initial")).otherwise(F.col("initial"))
    n = F.col("n").cast("int")
    rows = rows.select(
        "conv",
        F.coalesce(F.floor(F.col("turn") / F.lit(CHUNK)), F.lit(-(2**62))).alias("chunk"),
        F.when(n > 0, F.struct(
            F.col("turn").isNotNull().alias("known"), "turn", "role", "own",
            F.when(alone, F.concat(symbol, F.repeat(F.lit(GONE), n - 1))).otherwise(F.repeat(F.lit(GONE), n)).alias("marks"),
            F.repeat("initial", n).alias("roles"),
        )).alias("entry"),
        F.when(F.col("is_blank"), F.col("n")).otherwise(0).alias("blank"),
        F.when(F.col("is_blank"), 0).when(is_first, F.col("n") - 1).otherwise(F.col("n")).alias("duplicate"),
        F.when(alone & F.col("is_cut") & (n > 0), 1).otherwise(0).alias("truncated"),
        F.when(n > 0, F.col("turn")).alias("turn"),
    )
    sums = [F.sum(c).alias(c) for c in ("blank", "duplicate", "truncated")]
    ends = [F.min("turn").alias("lowest"), F.max("turn").alias("highest")]
    chunks = rows.groupBy("conv", "chunk").agg(F.sort_array(F.collect_list("entry")).alias("entries"), *sums, *ends)
    turns = F.array_distinct(F.filter("entries.turn", lambda t: t.isNotNull()))
    chunks = chunks.select(
        "conv", "blank", "duplicate", "truncated", "lowest", "highest",
        F.size(turns).cast("long").alias("turns"),
        F.struct("chunk", *(F.array_join(f"entries.{c}", "").alias(c) for c in ("marks", "roles"))).alias("part"),
    )
    whole = chunks.groupBy("conv").agg(
        F.sort_array(F.collect_list("part")).alias("parts"), *sums,
        F.min("lowest").alias("lowest"), F.max("highest").alias("highest"), F.sum("turns").alias("turns"),
    )
    marks, roles = (F.array_join(F.col(f"parts.{c}"), "") for c in ("marks", "roles"))

    def pairs(of: str) -> Column:
        return F.length("roles") - F.length(F.replace(F.col("roles"), F.lit(of), F.lit(of[0])))

    wide = F.col("highest").cast("decimal(38,0)") - F.col("lowest").cast("decimal(38,0)") + 1 - F.col("turns")
    most = F.lit(2**63 - 1).cast("decimal(38,0)")
    gaps = F.when(wide.isNull(), 0).otherwise(F.least(wide, most).cast("long"))
    illegal = F.greatest(F.length("roles") - 1, F.lit(0)) - pairs("su") - pairs("ua") - pairs("au")
    whole = whole.withColumns({"marks": marks, "roles": roles})
    return whole.select(
        "conv", "marks", gaps.alias("gaps"), *(F.col(c).cast("long").alias(c) for c in ("blank", "duplicate", "truncated")),
        illegal.cast("long").alias("illegal"),
    )


NUMBERS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")


def edits(found: DataFrame) -> DataFrame:
    """``strings`` with ``cost`` and ``audit``, the letters of the cheapest edits in order."""
    found = stored(found.sparkSession, "strings", found)
    rules = grammar(stored(found.sparkSession, "marks", found.groupBy("marks").agg(F.count("*").alias("n"))))
    names = [*found.columns]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = matrices(rules)
        done: dict[str, tuple[int, str]] = {}
        for batch in batches:
            out = []
            for marks in batch.column("marks").to_pylist():
                if marks not in done:
                    if len(done) >= KNOWN:
                        done.clear()
                    done[marks] = cheapest(marks, rules, known)
                out.append(done[marks])
            columns = [pa.array([cost for cost, _ in out], pa.int64()), pa.array([audit for _, audit in out], pa.string())]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), *columns], names=[*names, "cost", "audit"])

    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in found.schema)
    return found.mapInArrow(run, f"{fields}, cost long, audit string")


def _stream(rows: DataFrame, found: DataFrame) -> DataFrame:
    """Per conversation the row of its edits, then its rows in order."""
    heads = found.select(
        "conv", F.lit(0).alias("kind"), F.lit(None).cast("long").alias("turn"), F.lit(None).cast("string").alias("role"),
        F.lit(None).cast("string").alias("own"), F.lit(None).cast("string").alias("text"), F.lit(0).alias("n"), *NUMBERS, "audit",
    )
    body = rows.where("n > 0").select(
        "conv", F.lit(1).alias("kind"), "turn", "role", _digest().alias("own"), "text", "n",
        *(F.lit(None).cast("long").alias(c) for c in NUMBERS), F.lit(None).cast("string").alias("audit"),
    )
    return heads.unionByName(body).repartition("conv").sortWithinPartitions("conv", "kind", "turn", "role", "own")


class _Walk:
    """Applies the letters of one conversation to its rows as they come."""

    def __init__(self, audit: str) -> None:
        self.audit, self.at, self.state = audit, 0, START

    def _step(self) -> str:
        self.state = NEXT[self.state]
        return NAMES[self.state]

    def inserted(self) -> Iterator[tuple[str, str, str]]:
        while self.audit[self.at : self.at + 1] == "I":
            self.at += 1
            yield "I", self._step(), ""

    def row(self, role: str, text: str) -> Iterator[tuple[str, str, str]]:
        yield from self.inserted()
        letter = self.audit[self.at]
        self.at += 1
        if letter == "K":
            self.state = SYSTEM if role[:1] == "s" else NEXT[self.state]
            yield letter, role, text
        elif letter == "R":
            yield letter, self._step(), text


def _walked(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple[dict | None, str, list[tuple[str, str, str]]]]]:
    """Per batch: (columns of a new conversation or None, its name, repaired turns)."""
    walk: _Walk | None = None
    conv = ""
    for batch in batches:
        out: list = []
        numbers = [batch.column(c) for c in (*NUMBERS, "audit")]
        columns = (batch.column(c).to_pylist() for c in ("conv", "kind", "role", "text", "n"))
        for i, (name, kind, role, text, n) in enumerate(zip(*columns, strict=True)):
            if kind == 0:
                if walk:
                    out.append((None, conv, list(walk.inserted())))
                head = {c: v[i].as_py() for c, v in zip((*NUMBERS, "audit"), numbers, strict=True)}
                walk, conv = _Walk(head["audit"]), name
                out.append((head, conv, []))
            else:
                for _ in range(n):
                    out.append((None, conv, list(walk.row(role, text))))
        yield out
    yield [(None, conv, list(walk.inserted()))] if walk else []


TURNS = "conv_id long, place long, role string, text string, edit string"


def repaired(rows: DataFrame, found: DataFrame) -> DataFrame:
    """The turns of the repaired conversations in order, with the edit (K, R, I) that each comes from."""
    schema = pa.schema([("conv_id", pa.int64()), ("place", pa.int64()), *((n, pa.string()) for n in ("role", "text", "edit"))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = 0
        for walked in _walked(batches):
            out = []
            for head, conv, turns in walked:
                place = 0 if head else place
                for letter, role, text in turns:
                    out.append((int(conv) if conv else None, place, role, text, letter))
                    place += 1
            columns = zip(*out, strict=True) if out else ([],) * 5
            yield pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    return _stream(rows, found).mapInArrow(run, TURNS)


REPORT = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


def report(rows: DataFrame, found: DataFrame) -> DataFrame:
    """One row a conversation: its faults, cost, edits, and the digest of ``role:text`` of its repaired turns, joined by line feeds."""
    schema = pa.schema([
        ("conv_id", pa.int64()), *((n, pa.int64()) for n in NUMBERS), ("audit", pa.string()), ("repaired_sha256", pa.string()),
    ])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head: dict | None = None
        name, digest, empty = "", hashlib.sha256(), True

        def row() -> dict:
            return {"conv_id": int(name) if name else None, **head, "repaired_sha256": digest.hexdigest()}

        for walked in _walked(batches):
            done = []
            for new, conv, turns in walked:
                if new:
                    if head:
                        done.append(row())
                    head, name, digest, empty = new, conv, hashlib.sha256(), True
                for _, role, text in turns:
                    digest.update(f"{'' if empty else chr(10)}{role}:{text}".encode())
                    empty = False
            yield pa.RecordBatch.from_pylist(done, schema=schema)
        if head:
            yield pa.RecordBatch.from_pylist([row()], schema=schema)

    return _stream(rows, found).mapInArrow(run, REPORT)
