"""Chat formatting, conversation repair and hard negatives against plain Python, on the smallest table and on odd rows."""

from __future__ import annotations

import hashlib
import itertools
import math
import random
import re
import zlib
from collections import defaultdict

import pandas as pd
import pytest

from barwright.llm import chat, negatives, repair

CHATS = "conv_id long, turn long, role string, text string"
VECTORS = "vec_id long, embedding array<float>, label int"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Write rows as a table beside nothing else; extra columns may follow."""

    def make(name, rows, schema, **extra):
        where = str(tmp_path_factory.mktemp("sf"))
        df = spark.createDataFrame(rows, schema)
        for column, value in extra.items():
            df = df.selectExpr("*", f"{value} as {column}")
        df.repartition(2).write.parquet(f"{where}/{name}.parquet")
        return where

    return make


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


# 11: chats

HOSTILE = ["<s>", "</s>", "[INST]", "[/INST]", "[SYS]", "[ROLE]", "[/ROLE]", "<", "[", "\\", "<\\s>", "[\\\\INST]", " ", "é\U0001f600", "\n"]

ODD_CHATS = [
    (1, 0, "user", None), (1, 1, None, "null role"), (1, None, "assistant", "null turn"), (None, 0, "user", "null conversation"),
    (2, 0, "assistant", ""), (2, 0, "assistant", ""), (2, 0, "assistant", " [/INST] </s>"), (2, 0, "user", "tie"), (3, 5, "", "empty role"),
    (4, 0, "assistant</s>", "x"), (4, 1, "[/ROLE]", "</s>"), (5, 0, "assistant", "0"), (5, 1, "assistant", "1 </s"), (6, 0, "assistant", "x" * 200_000),
    *((7, n, "user" if n % 2 else "assistant", f"turn {n} </s>") for n in range(200)),
]


def expected_chats(rows):
    groups = defaultdict(list)
    for conv, turn, role, text in rows:
        groups[conv].append((turn is not None, turn or 0, role or "", text or ""))
    out = {}
    for conv, turns in groups.items():
        turns.sort()
        loss = "".join(t for _, _, r, t in turns if r == "assistant")
        whole = chat.inst_template([(r, t) for _, _, r, t in turns])
        out[conv] = (len(turns), sha("".join(f"{r}\n{t}\n" for _, _, r, t in turns)), len(loss), sha(loss), len(whole), False)
    return out


def got_chats(rows):
    names = ("n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "rewritten")
    return {r["conv_id"]: tuple(r[n] for n in names) for r in rows}


def test_chats_of_the_table(run, sf_dir):
    frame = pd.read_parquet(f"{sf_dir}/conversations.parquet")
    rows = [*frame[["conv_id", "turn", "role", "text"]].itertuples(index=False, name=None)]
    rows += [(-7, 0, "user", "</s>[INST] ok [/INST]"), (-7, 1, "assistant", "</s>[INST] ok [/INST]")]
    assert got_chats(run("op11_chat_formatting", sf_dir)) == expected_chats(rows)


def test_chats_of_odd_rows(run, folder):
    made = folder("conversations", ODD_CHATS, CHATS, segment="1", formatted="'x'", turns="0", kind="2")
    got = got_chats(run("op11_chat_formatting", made))
    del got[-7]
    assert got == expected_chats(ODD_CHATS)


def test_no_chats(run, folder):
    assert [r["conv_id"] for r in run("op11_chat_formatting", folder("conversations", [], CHATS))] == [-7]


def test_control_strings_come_back():
    dice = random.Random(4)
    for _ in range(3000):
        text = "".join(dice.choices(HOSTILE, k=dice.randrange(7)))
        held = chat.escape(text)
        assert chat.unescape(held) == text
        assert not re.search(r"</?s>|\[/?(INST|SYS|ROLE)\]", held)
        turns = [(role, "".join(dice.choices(HOSTILE, k=3))) for role in dice.choices(["user", "assistant", "system", "tool", "[/ROLE]"], k=4)]
        whole = chat.inst_template(turns)
        assert chat.read_inst(whole) == turns
        formatted, spans, rewritten = chat.located(chat.inst_template, turns, [])
        assert formatted == whole and rewritten is None
        for span, (role, own) in zip(spans, turns, strict=True):
            if role == "assistant":
                assert chat.unescape(whole[span["loss_start"] : span["loss_end"]]) == own


def test_segments_join_to_the_whole_conversation(spark):
    rows = [(1, n, ("user", "assistant")[n % 2], f"text {n} [INST]") for n in range(150)]
    df = chat.format_chats(spark.createDataFrame(rows, CHATS), segment=16)
    parts = sorted((r["segment"], r["formatted"], r["turns"]) for r in df.collect())
    assert len(parts) == 10
    assert "".join(f for _, f, _ in parts) == chat.inst_template([(r, t) for _, _, r, t in rows])
    assert all(f[s["start"] : s["end"]].count("text") == 1 for _, f, spans in parts for s in spans)


def test_templates_that_rewrite_history_are_found(spark):
    def closing(turns):  # an end mark behind the last turn only
        return "".join(f"<{r}>{t}" for r, t in turns) + "<end>"

    def stripping(turns):  # drops the thoughts of all turns but the last
        kept = [(r, t if n == len(turns) - 1 else re.sub("<think>.*</think>", "", t)) for n, (r, t) in enumerate(turns)]
        return "".join(f"<{r}>{t}" for r, t in kept)

    rows = [(1, 0, "user", "a"), (1, 1, "assistant", "b"), (2, 0, "user", "q"), (2, 1, "assistant", "<think>x</think>y"), (2, 2, "user", "z")]
    df = spark.createDataFrame(rows, CHATS)
    assert {r["conv_id"]: r["rewritten_turn"] for r in chat.format_chats(df, closing).collect()} == {1: 1, 2: 1}
    got = {r["conv_id"]: r for r in chat.format_chats(df, stripping).collect()}
    assert {c: r["rewritten_turn"] for c, r in got.items()} == {1: None, 2: 2}
    assert got[2]["formatted"] == "<user>q<assistant>y<user>z"
    assert all(s["start"] is None for s in got[2]["turns"])


# 12: repair


def damaged(rows):
    """conv -> rows (turn, role, text) after damage, in order."""
    out = defaultdict(list)
    for conv, turn, role, text in rows:
        own = out[conv]
        key = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        kind = zlib.crc32(key.encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if kind == 1:
            text = ""
        if kind == 2:
            text = re.sub("[.!?]", "", text)
        if kind == 4:
            role = "user"
        own += [(turn, role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    for own in out.values():
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], sha(r[2])))
    return out


def faults(rows):
    seen, out = set(), []
    for _, role, text in rows:
        last = re.findall(r"[^\x20\x09-\x0D]", text)[-1:]
        if not last:
            out.append("blank")
        elif (role, text) in seen:
            out.append("duplicate")
        else:
            out.append("none" if last[0] in ".!?" else "truncated")
        seen.add((role, text))
    return out


def all_audits(rows, found):
    """(cost, audit, repaired turns) of every way to edit, with at most two insertions at a place."""
    grammar = re.compile("(s?(ua)+)?")

    def after(done):
        return "assistant" if done and done[-1][0][:1] == "u" else "user"

    ways = [(0, "", [])]
    for step in range(len(rows) + 1):
        more = []
        for cost, audit, done in ways:
            for _ in range(3):
                more.append((cost, audit, done))
                cost, audit, done = cost + 5, audit + "I", [*done, (after(done), "")]
        ways = more
        if step == len(rows):
            break
        (_, role, text), fault = rows[step], found[step]
        more = []
        for cost, audit, done in ways:
            more.append((cost + 2, audit + "D", done))
            if fault not in ("blank", "duplicate"):
                extra = 5 * (fault == "truncated")
                more.append((cost + extra, audit + "K", [*done, (role, text)]))
                more.append((cost + 1 + extra, audit + "R", [*done, (after(done), text)]))
        ways = [w for w in more if re.fullmatch("s?(ua)*u?", "".join(r[:1] if r else "?" for r, _ in w[2]))]
    return [w for w in ways if grammar.fullmatch("".join(r[:1] for r, _ in w[2]))]


def expected_repairs(rows):
    out = {}
    for conv, own in damaged(rows).items():
        found = faults(own)
        turns = [t for t, _, _ in own if t is not None]
        cost, audit, done = min(all_audits(own, found), key=lambda w: (w[0], w[1]))
        pairs = [a[1][:1] + b[1][:1] for a, b in itertools.pairwise(own)]
        out[conv] = (
            max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0,
            found.count("blank"), found.count("duplicate"), found.count("truncated"),
            sum(p not in ("su", "ua", "au") for p in pairs), cost, audit, sha("\n".join(f"{r}:{t}" for r, t in done)),
        )
    return out


REPAIR = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


def got_repairs(rows):
    return {r["conv_id"]: tuple(r[n] for n in REPAIR) for r in rows}


def test_repairs_of_odd_rows(run, folder):
    dice = random.Random(8)
    roles = ["user", "assistant", "system", "tool", "", None, "useful", "Assistant"]
    texts = ["a.", "b!", "c", " \t", "", None, "d?\n", "a."]
    rows = [(conv, turn, dice.choice(roles), dice.choice(texts)) for conv in range(60) for turn in dice.sample(range(-5, 9), dice.randrange(1, 5))]
    rows += [(conv, n, role, f"{n}.") for conv in range(100, 140) for n, role in enumerate(["user", "assistant"] * 2)]
    rows += [(None, 0, "user", "x."), (200, None, "user", "x."), (200, None, "user", "x."), (200, 2**62, "assistant", "y.")]
    rows += [(201, 3, "user", "tie a."), (201, 3, "assistant", "tie b."), (201, 3, "user", "tie c.")]
    made = folder("conversations", rows, CHATS, n="1", conv="'c'", marks="2", audit="'KK'")
    assert got_repairs(run("op12_conversation_repair", made)) == expected_repairs(rows)


def test_no_conversations(run, folder):
    assert run("op12_conversation_repair", folder("conversations", [], CHATS)) == []


def test_every_letter_of_the_cheapest_edits(spark):
    """Short strings of all symbols: cost and letters are those of the enumeration, with and without rules."""
    names = {"s": "system", "u": "user", "a": "assistant", "o": "tool"}
    dice = random.Random(2)
    marks = {"".join(p) for n in range(3) for p in itertools.product("xsuaoSUA", repeat=n)} | {"".join(dice.choices("xsuaoSUAO", k=5)) for _ in range(25)}
    rules = [("", "ua"), ("", ""), ("", "xx"), ("", "a")]
    known = repair.matrices(rules)
    for own in sorted(marks):
        rows = [(n, names.get(c.lower(), "user"), f"{n}") for n, c in enumerate(own)]
        found = ["blank" if c == "x" else "truncated" if c.isupper() else "none" for c in own]
        best = min(all_audits(rows, found), key=lambda w: (w[0], w[1]))[:2]
        assert repair.cheapest(own, rules, known) == best == repair.cheapest(own, [], known), own


def test_rules_cover_common_structures_only_once(spark):
    strings = spark.createDataFrame([("ua" * 300, 5), ("sua", 9), ("x" * 5000, 4), ("o", 3)], "marks string, n long")
    rules = repair.grammar(strings, 40)
    seen = set(repair.TERMINALS)
    for name, pair in rules:
        assert set(pair) <= seen and name not in seen
        seen.add(name)
    assert len(repair.compressed("ua" * 300, rules)) < 20
    assert len(repair.compressed("x" * 5000, rules)) < 40
    plain = repair.cheapest("x" * 5000 + "u", [], repair.matrices([]))
    assert plain == repair.cheapest("x" * 5000 + "u", rules, repair.matrices(rules)) == (10002, "D" * 5001)


def test_long_conversation_over_many_chunks(spark):
    rows = [(1, n, ("user", "assistant")[n % 2], f"text {n}.") for n in range(1500)]
    turns = repair.damaged(spark.createDataFrame(rows, CHATS))
    found = repair.edits(repair.strings(turns))
    got = repair.report(turns, found).collect()[0]
    own = damaged(rows)[1]
    assert (got["blank"], got["duplicate"], got["truncated"]) == tuple(faults(own).count(f) for f in ("blank", "duplicate", "truncated"))
    done = sorted((r["place"], r["role"], r["text"], r["edit"]) for r in repair.repaired(turns, found).collect())
    assert sha("\n".join(f"{r}:{t}" for _, r, t, _ in done)) == got["repaired_sha256"]
    assert re.fullmatch("(ua)+", "".join(r[0] for _, r, _, _ in done))
    assert got["audit"].replace("D", "") == "".join(e for _, _, _, e in done)


# 13: hard negatives


def expected_negatives(rows):
    by_id = {}
    for vec_id, vector, label in rows:
        if vec_id is None or label is None or vector is None or any(x is None or not math.isfinite(x) for x in vector):
            continue
        label = int(math.fmod(label + 1, 10)) if vec_id % 7 == 0 else label
        own = (label, [math.floor(256 * float(x)) for x in vector])
        by_id[vec_id] = min(by_id.get(vec_id, own), own)
    out = set()
    for anchor, (label, x) in by_id.items():
        if anchor % 100:
            continue
        scores = {i: (sum(a * b for a, b in zip(x, y, strict=False)), c) for i, (c, y) in by_id.items() if i != anchor}
        near = sorted((-s, i) for i, (s, c) in scores.items() if c == label)[:5]
        for s, positive in near:
            far = sorted((-n, i) for i, (n, c) in scores.items() if c != label and 30 * -s <= 100 * n <= 90 * -s)[:10]
            out |= {(anchor, positive, rank, i, -s, -n) for rank, (n, i) in enumerate(far, 1)}
    return out


def got_negatives(rows):
    return [tuple(r[n] for n in ("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")) for r in rows]


def test_negatives_of_the_table(run, sf_dir):
    frame = pd.read_parquet(f"{sf_dir}/embeddings.parquet")
    rows = [(i, v.tolist(), c) for i, v, c in frame[["vec_id", "embedding", "label"]].itertuples(index=False)]
    got = got_negatives(run("op13_hard_negatives", sf_dir))
    assert len(got) == len(set(got)) and set(got) == expected_negatives(rows)


def test_negatives_of_odd_rows(run, folder):
    dice = random.Random(3)
    rows = [(i, [dice.choice([-0.5, 0.0, 0.25, 0.5]) for _ in range(6)], dice.randrange(3)) for i in range(-200, 401)]
    rows += [(i, [0.5, 0.5, 0.5, 0.5, 0.5, 0.5], dice.randrange(3)) for i in range(500, 601)]  # equal vectors: ties
    rows += [(700, None, 1), (800, [0.5, None], 1), (900, [0.5, float("nan")], 1), (1000, [float("inf")], 1), (1100, [0.5, 0.5], None), (None, [0.5], 1)]
    rows += [(1200, [], 1), (1300, [0.5] * 3, 2), (1400, [0.5] * 9, 2), (1400, [0.5] * 9, 2), (1500, [0.25] * 6, 1), (1500, [0.25] * 6, 0)]
    made = folder("embeddings", rows, VECTORS, block="0", kind="1", score="2", q="'q'")
    got = got_negatives(run("op13_hard_negatives", made))
    assert len(got) == len(set(got)) and set(got) == expected_negatives(rows)


def test_no_vectors(run, folder):
    assert run("op13_hard_negatives", folder("embeddings", [], VECTORS)) == []


def test_bounds_hold_and_prune():
    import numpy as np

    dice = np.random.default_rng(1)
    x = np.cumsum(dice.integers(-20, 21, (400, 64)), 1).astype(float)  # neighbouring components are alike
    mean, deviation = negatives.summaries(x, 16)
    block = negatives.Block(np.arange(400), np.zeros(400), x, negatives.levels(mean, deviation, 64))
    rows = np.arange(1, 400)
    exact = x[rows] @ x[0]
    widths = []
    for level, summary in enumerate(block.levels):
        low, high = block.bounds(level, summary[0], rows)
        assert (low <= exact).all() and (exact <= high).all()
        widths.append((high - low).mean())
    assert widths == sorted(widths, reverse=True) and widths[-1] < widths[0] / 3
    best = negatives.nearest(block, rows, x[0], [level[0] for level in block.levels], [(-(2**62), 2**62)], 5)
    assert [r for _, r, _ in best] == sorted(rows, key=lambda r: (-(x[r] @ x[0]), r))[:5]
