"""Each operator against plain Python, on the smallest table and on odd rows."""

from __future__ import annotations

import zlib
from collections import Counter, defaultdict

import brute
import pytest


def fold(i, n):
    return zlib.crc32(str(i).encode()) % n


# 1: near duplicates


def test_near_groups_of_the_table(run, sf_dir, documents):
    expected = brute.components(documents)
    got = run("op1_minhash_dedup", sf_dir)
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == expected
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got)


def test_near_groups_of_odd_rows(run, table_dir, odd):
    rows = [r for r in odd if r[0] is not None]
    base = [f"w{i}" for i in range(200)]
    for n in range(40):  # a chain: neighbours are similar, the ends are not
        rows.append((100 + n, " ".join(base[: 4 * n] and [f"x{i}" for i in range(4 * n)] + base[4 * n :] or base)))
    expected = brute.components(dict(rows))
    got = run("op1_minhash_dedup", table_dir(rows))
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == expected
    assert len(got) == len(expected)


def test_one_id_with_three_texts_joins_all_their_groups(run, table_dir):
    texts = {3: "alpha beta gamma delta", 5: "one two three four five", 7: "red green blue yellow", 11: "one two three four five", 13: "quite another text here"}
    rows = [*texts.items(), (9, texts[3]), (9, texts[5]), (9, texts[7])]
    got = {r["doc_id"]: r["component_id"] for r in run("op1_minhash_dedup", table_dir(rows))}
    assert got == {3: 3, 5: 3, 7: 3, 9: 3, 11: 3, 13: 13}


def test_tensored_keys_cost_fewer_minhashes():
    from barwright.llm import minhash

    similarity = 0.8
    found = (1 - (1 - similarity**minhash.ROWS) ** minhash.GROUPS) ** 2
    assert found > 0.998
    assert 2 * minhash.ROWS * minhash.GROUPS < minhash.GROUPS**2 * 2 * minhash.ROWS


# 2: exact duplicates


def expected_exact(rows):
    groups = defaultdict(set)
    for i, t in rows:
        groups[brute.lower(t)].add(i)
    out = {}
    for text, ids in groups.items():
        known = [i for i in ids if i is not None]
        keep = max(known) if known else None
        for i in ids:
            out[i, brute.sha(text)] = (keep, len(ids), i == keep)
    return out


def test_exact_groups(run, table_dir, odd):
    rows = [*odd, (20, "Same Text"), (21, "same text"), (22, "same texT"), (23, "other one"), (24, "other two"), (24, "a third")]
    got = run("op2_exact_dedup", table_dir(rows))
    assert {(r["doc_id"], r["text_sha256"]): (r["keep_id"], r["group_size"], r["kept"]) for r in got} == expected_exact(rows)
    assert len(got) == len(expected_exact(rows))


# 3: language


def test_language_of_held_out_rows(run, sf_dir, documents):
    import pandas as pd

    langs = dict(pd.read_parquet(f"{sf_dir}/documents.parquet")[["doc_id", "lang"]].itertuples(index=False))
    got = {r["doc_id"]: r for r in run("op3_language_id", sf_dir)}
    assert set(got) == set(documents)
    assert all(r["held_out"] == (fold(i, 4) == 2) for i, r in got.items())
    held = [i for i, r in got.items() if r["held_out"] and len(documents[i]) > 100]
    assert sum(got[i]["lang_pred"] == langs[i] for i in held) >= 0.98 * len(held)
    assert all(0 <= r["score"] <= 1 for r in got.values())


def test_language_of_odd_rows(run, table_dir, odd):
    rows = [(*r, "xx" if k % 2 else "yy") for k, r in enumerate(odd)]
    got = run("op3_language_id", table_dir(rows))
    assert len(got) == len(rows)
    und = {i for i, t in odd if i is not None and not any(c.isalpha() for c in t or "")}
    assert {r["doc_id"] for r in got if r["lang_pred"] == "und" and r["doc_id"] is not None} == und
    assert {r["lang_pred"] for r in run("op3_language_id", table_dir([(1, "abc", None)]))} == {"und"}


def test_the_language_of_the_mixture_must_explain_a_word():
    """One word that another language explains does not keep a text whose own language explains none."""
    import numpy as np
    import pyarrow as pa
    from barwright.llm import language as g

    table = np.full((g.BUCKETS, 2), -12.0, np.float32)  # both below chance
    table[:, 1] = -13.0
    texts = pa.array(["one two three four five six seven zzz", "zzz", "one", "7 8"])
    grams, _ = g.word_grams(g.flat(pa.array(["zzz"])), g.flat(pa.array(["zzz"])).words())
    table[grams, 1] = -10.0
    found = g._mixed(pa.RecordBatch.from_arrays([texts], names=["text"]), ["a", "b"], table)
    assert found.best.tolist() == [0, 1, 0, 0]
    assert g.explained(found).tolist() == [False, True, False, False]
    assert found.lettered.tolist() == [True, True, True, False]


def test_mixture_has_both_languages(spark):
    import numpy as np
    from barwright.llm.language import shares

    logs = np.log(np.array([[0.9, 0.05, 0.05]] * 60 + [[0.05, 0.9, 0.05]] * 40))
    share = shares(logs, np.array([0, 100, 100]))
    assert abs(share[0, 0] - 0.6) < 0.1 and abs(share[0, 1] - 0.4) < 0.1 and share[0, 2] == 0
    assert share[1].sum() == 0
    alone = shares(logs[:60], np.array([0, 60]))
    assert alone.tolist() == [[1, 0, 0]]


# 4: byte-level BPE


@pytest.fixture(scope="session")
def encoding():
    import base64

    import public_tokenizers as public
    import tiktoken

    lines = open(public.path("byte_bpe_multi_50k.tiktoken"), "rb")  # noqa: SIM115
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("own", pat_str=public.PATTERN, mergeable_ranks=ranks, special_tokens={})


def same_ids(got, rows, encoding):
    expected = Counter()
    for i, text in rows:
        ids = encoding.encode_ordinary(text or "")
        expected[i, len(ids), brute.sha(",".join(map(str, ids))), brute.sha(text or "")] += 1
    assert Counter((r["doc_id"], r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in got) == expected


def test_bpe_of_the_table(run, sf_dir, documents, encoding):
    same_ids(run("op4_byte_bpe", sf_dir), documents.items(), encoding)


def test_bpe_of_odd_rows(run, table_dir, odd, encoding):
    rows = [
        *odd, (30, "it's we'll     x　y \n\n z  "), (31, "aaaa" * 500 + "abab" * 300), (32, "<|endoftext|> ́e 123 ٣٤"),
        (33, "\x00\x01 \x85 ​ ﻿"),
    ]
    same_ids(run("op4_byte_bpe", table_dir(rows)), rows, encoding)


def test_bpe_without_known_words(spark, documents, encoding):
    from barwright.llm import bpe, queries

    docs = spark.createDataFrame([(i, documents[i]) for i in sorted(documents)[:5]], "doc_id long, text string")
    coder = queries.byte_bpe("byte_bpe_multi_50k.tiktoken")
    for r in bpe.encode(docs, coder, known_words=1).collect():
        assert r["ids"] == encoding.encode_ordinary(documents[r["doc_id"]])


# 5: language-model scores


def test_scores(run, sf_dir, documents):
    import math

    train = {i: t for i, t in documents.items() if fold(i, 10) != 0}
    counts = Counter(w for t in train.values() for w in [*brute.words(brute.lower(t)), None])
    n, v = sum(counts.values()), len(counts)
    got = {r["doc_id"]: r for r in run("op5_lm_score", sf_dir)}
    assert set(got) == set(documents)
    for i, t in documents.items():
        tokens = [*brute.words(brute.lower(t)), None]
        r = got[i]
        assert (r["held_out"], r["n_tokens"], r["train_tokens"]) == (fold(i, 10) == 0, len(tokens), n)
        assert r["n_known"] == sum(w in counts for w in tokens)
        base = sum(math.log10((counts[w] + 0.1) / (n + 0.1 * (v + 1))) for w in tokens)
        assert r["base_score"] == pytest.approx(base, rel=1e-9)
        assert r["score"] < 0


def test_scores_of_odd_rows(run, table_dir, odd):
    got = run("op5_lm_score", table_dir(odd))
    assert len(got) == len(odd)
    assert {r["n_tokens"] for r in got if r["doc_id"] in (1, 2, 3)} == {1}
    assert len({r["score"] for r in got if r["doc_id"] in (4, 5)}) == 1


def test_attention_learns_and_scores_once():
    import numpy as np
    from barwright.llm import attention as a

    rng = np.random.default_rng(0)
    ids = np.tile(np.arange(8), 400)
    kinds = a.classes(np.bincount(ids, minlength=a.CLASSES * 2).astype(float))
    seq = kinds.of[ids]
    windows = np.stack([seq[s : s + a.CONTEXT + 1] for s in rng.integers(0, 2000, 256)])
    learner = a.Adam(a.Model.first(np.bincount(seq, minlength=a.CLASSES)))
    losses = [learner.fit(windows[k % 4 * 64 : k % 4 * 64 + 64]) for k in range(120)]
    assert losses[-1] < 0.5 * losses[0]
    model = a.Model.of_flat(learner.values)
    scorer = a.Scorer(model, kinds)
    text = ids[:101]
    whole = scorer.score(text, np.array([0, 101]))[0]
    slow = 0.0
    for t in range(100):  # one place at a time, with the window that the place belongs to
        low = max(0, t // a.STRIDE * a.STRIDE - (a.CONTEXT - a.STRIDE))
        c = kinds.of[text[low : t + 1]].astype(int)
        s = model.k[c] @ model.q[c[-1]] / np.sqrt(a.WIDTH) + model.d[np.arange(len(c))[::-1]]
        w = np.exp(s - s.max())
        z = (model.r[c[-1]] + w @ model.v[c] / w.sum()) @ model.u + model.b
        p = np.exp(z - z.max())
        slow += np.log10(p[kinds.of[text[t + 1]]] / p.sum()) + kinds.log_within[text[t + 1]]
    assert whole == pytest.approx(slow, rel=1e-3)


def test_gradients_are_those_of_the_loss():
    import numpy as np
    from barwright.llm import attention as a

    rng = np.random.default_rng(1)
    model = a.Model.of_flat(rng.normal(0, 0.3, a.Model.first(np.ones(a.CLASSES)).flat().shape))
    window = rng.integers(0, a.CLASSES, (4, a.CONTEXT + 1))
    _, g = a.gradients(model, window)
    flat, grad = model.flat().astype(np.float64), g.flat()
    for place in np.argsort(-np.abs(grad))[[0, 5, 50, 200, 400]]:
        up, down = flat.copy(), flat.copy()
        up[place] += 1e-2
        down[place] -= 1e-2
        slope = (a.gradients(a.Model.of_flat(up), window)[0] - a.gradients(a.Model.of_flat(down), window)[0]) / 2e-2
        assert grad[place] == pytest.approx(slope, rel=0.1, abs=2e-4)


def of_many_ids():
    """Ids that share classes and groups, and a text in which each is followed by the same one."""
    import numpy as np
    from barwright.llm import attention as a

    ids = np.tile(np.random.default_rng(3).permutation(600), 40).astype("<u2")
    counts = np.bincount(ids, minlength=900).astype(float)
    kinds = a.classes(counts)
    return ids, counts, kinds, a.tree_of(kinds, counts)


def test_context_tells_ids_of_a_class_apart():
    import numpy as np
    from barwright.llm import attention as a

    ids, counts, kinds, tree = of_many_ids()
    model, words = a.Model.first(np.bincount(kinds.of, counts, a.CLASSES)), a.Words.first(len(counts), tree)
    bounds = np.array([0, 601])
    plain = a.Scorer(model, kinds).score(ids[:601], bounds)[0]
    start = a.Scorer(model, kinds, words, tree).score(ids[:601], bounds)[0]
    assert start == pytest.approx(plain, rel=1e-3)  # vectors of zeros leave the frequencies
    learner = a.Learner(model, words, tree, kinds.of)
    at = np.random.default_rng(4).integers(0, len(ids) - a.CONTEXT - 1, (64, 200))
    for k in range(200):
        learner.fit(np.stack([ids[s : s + a.CONTEXT + 1] for s in at[:, k]]))
    learnt = a.Scorer(learner.model()[0], kinds, learner.model()[1], tree).score(ids[:601], bounds)[0]
    assert learnt > 0.2 * plain  # the class alone leaves more than 25 ids open


def test_ids_share_all_probability():
    import numpy as np
    from barwright.llm import attention as a

    rng = np.random.default_rng(5)
    counts = rng.integers(0, 50, 2000).astype(float)
    kinds = a.classes(counts)
    tree = a.tree_of(kinds, counts)
    assert (tree.node[0] >= 0).any() and (tree.node[1] >= 0).any()
    words = a.Words(*(rng.normal(0, 0.5, t.shape).astype(np.float32) for t in vars(a.Words.first(2000, tree)).values()))
    model = a.Model.of_flat(rng.normal(0, 0.3, a.Model.first(np.ones(a.CLASSES)).flat().shape))
    scorer = a.Scorer(model, kinds, words, tree)
    text = [5, 7, 1999, 3]
    many = np.array([[*text, i] for i in range(2000)])
    ends = scorer.score(many.ravel(), np.arange(0, 10001, 5)) - scorer.score(np.array(text), np.array([0, 4]))
    assert (10**ends).sum() == pytest.approx(1, rel=1e-3)


def test_gradients_of_ids_are_those_of_the_loss():
    import numpy as np
    from barwright.llm import attention as a

    rng = np.random.default_rng(6)
    counts = rng.integers(0, 50, 700).astype(float)
    kinds = a.classes(counts)
    tree = a.tree_of(kinds, counts)
    model = a.Model.of_flat(rng.normal(0, 0.3, a.Model.first(np.ones(a.CLASSES)).flat().shape))
    tables = [rng.normal(0, 0.3, t.shape).astype(np.float32) for t in vars(a.Words.first(700, tree)).values()]
    window = rng.integers(0, 700, (4, a.CONTEXT + 1))
    _, g, p, (ids, _, rows), runs = a.word_gradients(model, a.Words(*tables), tree, kinds.of, window)
    slopes = [np.zeros_like(t) for t in tables]
    slopes[0][ids], slopes[1] = rows, p
    for start, end, run, _ in runs:
        slopes[2][start:end] += run

    def loss(tables, model=model):
        return a.word_gradients(model, a.Words(*tables), tree, kinds.of, window)[0]

    for which, slope in enumerate(slopes):
        for place in np.argsort(-np.abs(slope), axis=None)[[0, 5, 20]]:
            up, down = ([t.copy() for t in tables] for _ in range(2))
            up[which].flat[place] += 1e-2
            down[which].flat[place] -= 1e-2
            assert slope.flat[place] == pytest.approx((loss(up) - loss(down)) / 2e-2, rel=0.1, abs=2e-4)
    flat = model.flat()
    for place in np.argsort(-np.abs(g.flat()))[[0, 50, 400]]:
        up, down = flat.copy(), flat.copy()
        up[place] += 1e-2
        down[place] -= 1e-2
        assert g.flat()[place] == pytest.approx((loss(tables, a.Model.of_flat(up)) - loss(tables, a.Model.of_flat(down))) / 2e-2, rel=0.1, abs=2e-4)


def test_scores_see_the_order_of_rare_words(spark):
    """Words that all have the same frequency: only a model of ids can know which one follows."""
    from pyspark.sql import functions as F

    from barwright.llm import queries, scoring

    words = ["river", "garden", "window", "market", "silver", "doctor", "forest", "yellow", "winter", "summer"]
    forwards = " ".join(words * 30)
    rows = [(i, forwards) for i in range(40)] + [(90, forwards), (91, " ".join(words[::-1] * 30))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    got = {r["doc_id"]: r for r in scoring.score_texts(docs, F.col("doc_id") < 90, queries.vocabulary("word_bpe_49k.json")).collect()}
    assert got[90]["base_score"] == pytest.approx(got[91]["base_score"])
    assert got[90]["score"] > got[91]["score"] + 50


# 6: secrets


def test_base_spans(run, sf_dir, documents, table_dir, odd):
    for rows, folder in ((list(documents.items()), sf_dir), (odd, table_dir(odd))):
        got = run("op6_secret_scan", folder)
        expected = Counter()
        for i, t in rows:
            spans = brute.base_spans(t)
            expected[(i, *(sum(k == n for _, k, _ in spans) for n in range(3)), brute.base_digest(t))] += 1
        assert Counter((r["doc_id"], r["n_assign"], r["n_access"], r["n_hex"], r["base_sha256"]) for r in got) == expected


def test_guess_costs():
    from barwright.llm.secrets import guess_cost, spans

    easy = ["", "password", "P@ssword1", "qwertyuiop", "aaaaaaaaaaaa", "abcabcabcabc", "20240131", "changeme123456", "1234567890"]
    hard = ["x9Kq2LmZ7w", "tR4!vB8#kP0z", "h7dk29fjq0"]
    assert max(map(guess_cost, easy)) < 8 < 10 <= min(map(guess_cost, hard))
    assert guess_cost("z9Kq" * 5000) < 20  # long values take linear time
    text = "pwd: x9Kq2LmZ7w and pass=password1 postgres://me:tR4!vB8#kP0z@host password=x9Kq2LmZ7w"
    found = [(text[s:e], k) for s, k, e in spans(text, True, True, True, True, 10.0)]
    assert found == [("x9Kq2LmZ7w", 3), ("tR4!vB8#kP0z", 3), ("password=x9Kq2LmZ7w", 0)]


def guessed(text):
    from barwright.llm.secrets import MIN_COST, spans

    return [text[s:e] for s, k, e in spans(text, True, True, True, True, MIN_COST) if k == 3]


def test_values_in_every_context(run, table_dir):
    cases = [
        ("password: $Tr0ub4dor&3xQ!", "$Tr0ub4dor&3xQ!"), ("password=ab$Kd93!xQ7z", "ab$Kd93!xQ7z"), ('token: "!x9Kq2LmZ7w#"', "!x9Kq2LmZ7w#"),
        ("password=abcdef$Kd93!xQ7z", "abcdef$Kd93!xQ7z"), ("AWS_SECRET_ACCESS_KEY=wJalr7XUtnF+EMI", "wJalr7XUtnF+EMI"),
        ("DB_PASS=x9Kq2LmZ7w", "x9Kq2LmZ7w"), ("MYSQL_PWD=x9Kq2LmZ7w", "x9Kq2LmZ7w"), ("x-auth: x9Kq2LmZ7w", "x9Kq2LmZ7w"),
        ("redis://:tR4!vB8#kP0z@host", "tR4!vB8#kP0z"), ("api_key='a,b@;9Kq2LmZ7w'", "a,b@;9Kq2LmZ7w"), ("Authorization: Bearer x9Kq2LmZ7w", "x9Kq2LmZ7w"),
    ]
    for text, value in cases:
        assert guessed(f"a {text} b") == [value]
    got = run("op6_secret_scan", table_dir([(i, text) for i, (text, _) in enumerate(cases)]))
    assert all("guess:" in r["spans"] for r in got) and len(got) == len(cases)
    assert guessed("password=x9Kq2LmZ7w compass: x9Kq2LmZ7w") == []


def test_clean_texts_keep_their_words():
    clean = [
        "see http://localhost:8080/index.html for more", "http://localhost:8080/users/@someone and https://example.org:8443/a/b?c=d#e",
        "Authorization: mandatory", "credentials: certificate", "auth: authentication is required", "bearer: messenger", "pass: mountain",
        "credentials: username/password", "hosts http://alpha:9200,http://beta:9200/path-and-file.html", "http://[::1]:8080/index.html",
    ]
    assert [t for t in clean if guessed(t)] == []
    assert guessed("http://localhost:8080/to?u=postgres://me:tR4!vB8#kP0z@host") == ["tR4!vB8#kP0z"]
    assert guessed("amqp://me:tR4!vB/8#kP,0z@host:5672/x") == ["tR4!vB/8#kP,0z"]
    assert len(guessed("ab://c:" * 30000 + "x9Kq2LmZ7w@host")) == 1  # one value for all addresses that end at one place


def test_redaction(spark):
    from barwright.llm.secrets import redacted

    docs = spark.createDataFrame([(1, "a password=abc123def x", 22), (2, None, 0), (3, "nothing", 7)], "doc_id long, text string, n_chars long")
    assert [tuple(r) for r in redacted(docs).orderBy("doc_id").collect()] == [(1, "a [assign] x", 12), (2, None, 0), (3, "nothing", 7)]


# 7: repeated passages


def check_repeats(got, texts):
    expected = {i: (n, n - len(kept), brute.sha(" ".join(kept))) for i, (n, kept) in brute.repeats(texts).items()}
    assert {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in got} == expected
    assert len(got) == len(texts)


def test_repeats_of_the_table(run, sf_dir, documents):
    check_repeats(run("op7_substring_dedup", sf_dir), documents)


def test_repeats_of_odd_rows(run, table_dir, odd):
    rows = [r for r in odd if r[0] is not None]
    a = [f"a{i}" for i in range(60)]
    rows += [
        (40, " ".join(a)), (41, " ".join(["z"] * 3 + a[5:24])), (42, " ".join(["y"] * 3 + a[5:25] + ["q"])), (43, " ".join(a[:30] + a[:30])),
        (44, " ".join(a[20:45] + ["m"] + a[21:41])), (39, " ".join(a[41:60] + ["n"])), (45, " ".join(["n2"] * 25 + a[40:60] + ["n2"] * 25)),
        (46, " ".join(["A0", *a[1:21]])),
    ]
    check_repeats(run("op7_substring_dedup", table_dir(rows)), dict(rows))


def test_repeats_of_many_texts_without_own_ids(run, table_dir):
    passage = [f"p{i}" for i in range(25)]
    rows = []
    for n in range(3000):
        own = [f"{n}x{i}" for i in range(1 + n % 40)]
        rows.append((None if n % 2 else 7, " ".join(own + (passage if n % 100 < 2 else []))))
    got = run("op7_substring_dedup", table_dir([*rows, *rows[:50]]))
    kept = Counter((r["doc_id"], r["n_words"], r["kept_sha256"]) for r in got)
    whole, cut = Counter(), Counter()
    for i, text in rows:
        w = brute.words(text)
        (cut if "p0" in w else whole)[i, len(w), brute.sha(" ".join(x for x in w if x[0] != "p"))] += 1
    first = [r for r in got if r["n_words"] > 25 and (r["doc_id"], r["n_words"], r["kept_sha256"]) not in whole + cut]
    assert len(got) == len(rows) and whole <= kept
    assert [(r["doc_id"], r["n_removed"]) for r in first] == [(None, 0)]  # no id comes first
    assert sum(kept[k] for k in cut) == sum(cut.values()) - 1


def test_repeats_of_random_texts(run, table_dir):
    import random

    rng = random.Random(5)
    passages = [[rng.choice("abcdefgh") + str(rng.randrange(9)) for _ in range(rng.randrange(18, 40))] for _ in range(6)]
    rows = []
    for i in range(60):
        text = []
        for _ in range(rng.randrange(1, 6)):
            p = rng.choice(passages)
            text += p[rng.randrange(4) : len(p) - rng.randrange(4)] if rng.random() < 0.7 else [f"u{rng.randrange(10**6)}" for _ in range(9)]
        rows.append((i, " ".join(text)))
    check_repeats(run("op7_substring_dedup", table_dir(rows)), dict(rows))


# 8: packing


def check_packing(got, rows):
    import numpy as np
    import public_tokenizers as public
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public.path("word_bpe_49k.json"))
    tokenizer.encode_special_tokens = True
    pieces = defaultdict(list)
    sequences = defaultdict(list)
    for r in got:
        pieces[r["doc_id"], r["doc_tokens"]].append(r)
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for i, text in rows:
        ids = np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 1], "<u4")
        own = sorted(pieces[i, len(ids)], key=lambda r: r["start"])
        repeats = sum(1 for j, t in rows if (j, t) == (i, text))
        assert sum(r["length"] for r in own) == repeats * len(ids)
        for r in own:
            assert r["ids_crc32"] == zlib.crc32(ids[r["start"] : r["start"] + r["length"]].tobytes())
    padding = total = 0
    for placed in sequences.values():
        end = 0
        for offset, length in sorted(placed):
            assert offset == end and length > 0
            end += length
        assert end <= 2048
        total += end
        padding += 0 if end & (end - 1) == 0 else 2048 - end
    assert padding <= 0.01 * total


def test_packing(run, sf_dir, documents, table_dir, odd):
    check_packing(run("op8_packing", sf_dir), list(documents.items()))
    check_packing(run("op8_packing", table_dir(odd)), odd)


# 9: licences


def test_licences(run, table_dir):
    from barwright.llm import licenses

    mit = [s for s, k in licenses.SENTENCES.items() if k.startswith("mit")]
    rows = [
        (1, None), (2, ""), (3, "unfinished line\nThis work is licensed under the GNU General Public License, version 3.\nMore text."),
        (4, "Licensed under the Apache License, Version 2.0. Released under the MIT\n  License. Licensed under CC BY-NC 4.0."),
        (5, ":\n".join([mit[0].upper(), mit[1] + ".\n" + mit[2]]) + "."), (6, "Licensed under my own terms. The MIT License is fine."),
        (7, "// SPDX-License-Identifier: MIT\n"), (7, "// SPDX-License-Identifier: MIT\n"), (8, "licensed under " * 20000), (None, "Released under the MIT License."),
        (9, "x\n" * 20000 + "Released under the MIT License"),
    ]
    got = run("op9_license_scan", table_dir(rows))
    assert Counter((r["doc_id"], r["licenses"]) for r in got) == Counter(
        [
            (1, ""), (2, ""), (3, "GPL-3.0"), (4, "Apache-2.0,MIT,CC-BY-NC-4.0"), (5, "MIT"), (6, ""), (7, "MIT"), (7, "MIT"), (8, ""),
            (None, "MIT"), (9, "MIT"),
        ]
    )


GPL = """This program is free software{0} you can redistribute it and/or modify
 * it under the terms of the GNU General Public License as published by
 * the Free Software Foundation{1} either version {2} of the License, or
 * (at your option) any later version.
 *
 * This program is distributed in the hope that it will be useful,
 * but WITHOUT ANY WARRANTY; without even the implied warranty of
 * MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
 * GNU General Public License for more details.
"""

APACHE = """Copyright 2020 Someone

   Licensed under the Apache License, Version 2.0 (the "License");
   you may not use this file except in compliance with the License.
   You may obtain a copy of the License at

       http://www.apache.org/licenses/LICENSE-2.0

   Unless required by applicable law or agreed to in writing, software
   distributed under the License is distributed on an "AS IS" BASIS,
   WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
   See the License for the specific language governing permissions and
   limitations under the License.
"""

MPL = """This Source Code Form is subject to the terms of the Mozilla Public
 * License, v. 2.0. If a copy of the MPL was not distributed with this
 * file, You can obtain one at https://mozilla.org/MPL/2.0/."""


def test_licences_of_standard_notices(run, table_dir):
    from barwright.llm import licenses

    identifiers = licenses.identifiers
    notices = [(GPL.format(";", ";", 2), "GPL-2.0-or-later"), (GPL.format(":", ",", 3), "GPL-3.0-or-later"), (APACHE, "Apache-2.0"), (MPL, "MPL-2.0")]
    rows, expected = [], {}
    for n, (notice, licence) in enumerate(notices):
        for m, text in enumerate([notice, f"/* Some file.\n *\n * {notice}\n */\nint main;", notice.split("any later")[0].split("2.0")[0]]):
            rows.append((10 * n + m, text))
            expected[10 * n + m] = licence if m < 2 else ""
    mit = [s for s, k in licenses.SENTENCES.items() if k.startswith("mit")]
    rows.append((98, f"{mit[0]}:\n\n{mit[1]}.\n\n{mit[2]}."))
    expected[98] = "MIT"
    rows.append((99, "\n".join(notice for notice, _ in notices)))
    expected[99] = ",".join(licence for _, licence in notices)
    got = run("op9_license_scan", table_dir(rows))
    assert {r["doc_id"]: r["licenses"] for r in got} == expected
    assert [known for _, _, known in identifiers(APACHE)] == ["name:Apache-2.0", "apache-comply", "apache-copy"]
    assert identifiers(MPL)[0][1] == MPL.index("2.0.") + 4


def test_licences_of_the_table(run, sf_dir, documents):
    """Against a scan of every sentence of every text, without the search for anchors."""
    import re

    from barwright.llm import licenses

    for r in run("op9_license_scan", sf_dir):
        text, found = documents[r["doc_id"]], []
        starts = {0} | {m.end() for m in re.finditer(r"[.!?:;](?=\s|$)|\n", text)}
        ends = sorted({m.end() for m in re.finditer(r"[.!?:;](?=\s|$)", text)} | {len(text)})
        for start in sorted(starts):
            end = next((e for e in ends if e > start), None)
            known = end and licenses.identifier(text, start, end)
            if known:
                found.append(known)
        assert r["licenses"] == ",".join(licenses.licences(found))


# 10: quality


def test_statistics(run, sf_dir, documents, table_dir, odd):
    for rows, folder in ((list(documents.items()), sf_dir), (odd, table_dir(odd))):
        got = run("op10_quality_rules", folder)
        names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
        expected = Counter((i, *(brute.statistics(t)[n] for n in names)) for i, t in rows)
        assert Counter((r["doc_id"], *(r[n] for n in names)) for r in got) == expected
        for r in got:
            assert r["base_failed"] == (r["n_words"] < 50 or 100 * r["n_repeat_words"] > 50 * r["n_words"])
            assert not (r["base_failed"] and r["kept"])


def test_trees_learn_and_keep_constraints():
    import numpy as np
    from barwright.llm.trees import train

    rng = np.random.default_rng(3)
    x = rng.normal(size=(2000, 3))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0.5)).astype(float)
    trees = train(x, y, [0, 0, 0])
    assert ((trees.score(x) > 0.5) == (y > 0)).mean() > 0.95
    noisy = (x[:, 2] + rng.normal(size=2000) > 0).astype(float)
    for sign in (1, -1):
        steps = np.column_stack([np.zeros(200), np.zeros(200), np.linspace(-4, 4, 200)])
        score = train(x, noisy, [0, 0, sign]).score(steps)
        assert (np.diff(score) * sign >= -1e-12).all()
    assert (train(x, np.ones(2000), [0, 0, 0]).score(x) > 0.99).all()
    assert len(train(np.zeros((0, 3)), np.zeros(0), [0, 0, 0]).score(x)) == 2000


# all


ALL = [
    "op1_minhash_dedup", "op2_exact_dedup", "op3_language_id", "op4_byte_bpe", "op5_lm_score", "op6_secret_scan", "op7_substring_dedup",
    "op8_packing", "op9_license_scan", "op10_quality_rules", "pipeline",
]


@pytest.mark.parametrize("name", ALL)
def test_empty_table(run, table_dir, name):
    assert run(name, table_dir([])) == []
