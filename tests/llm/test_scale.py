"""What keeps the training-data operators' work in proportion to their input."""

from __future__ import annotations

import itertools
import random

DOCS = "doc_id long, text string"


def _family(rng, first_id, size, edits, words=60):
    """A base text and variants of it, each with some words of its own."""
    base = [f"w{rng.randrange(10**6)}" for _ in range(words)]
    out = []
    for i in range(size):
        text = list(base)
        for at in rng.sample(range(words), edits if i else 0):
            text[at] = f"x{rng.randrange(10**6)}"
        out.append((first_id + i, " ".join(text)))
    return out


def _sets(rows):
    out = {}
    for doc_id, text in rows:
        words = text.split()
        out[doc_id] = set(zip(words, words[1:], strict=False))
    return out


def _similar(sets):
    pairs = itertools.combinations(sorted(sets), 2)
    return {(a, b) for a, b in pairs if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])}


def _met(spark, rows, joined=()):
    from barwright.llm import minhash

    docs = spark.createDataFrame(rows, DOCS)
    sets = _sets(rows)
    classes = spark.createDataFrame([(i, len(s)) for i, s in sets.items()], "class_id long, n_shingles long")
    prefixes = minhash._prefixes(classes, docs, 2, 80)
    return minhash._met(prefixes, spark.createDataFrame(list(joined), "node long, component long")), sets


def test_a_pair_across_components_comes_once(spark):
    """Near copies share up to all of their rarest shingles; they met once for each of them."""
    from barwright.llm import minhash

    rng = random.Random(5)
    rows = _family(rng, 0, 12, 3) + _family(rng, 100, 8, 4) + _family(rng, 200, 6, 9) + [(300, "a b c"), (301, "a b c d"), (302, "a")]
    met, sets = _met(spark, rows)
    got = [tuple(r) for r in minhash._across(met, 80).collect()]
    assert len(got) == len(set(got))
    assert _similar(sets) <= set(got)
    assert all(sets[a] & sets[b] for a, b in got)


def test_long_prefixes_leave_no_pair_out(spark):
    """Sets that first meet beyond the tokens which a row holds."""
    from barwright.llm import minhash

    rng = random.Random(6)
    base = [f"b{i}" for i in range(900)]
    rows = []
    for i in range(6):
        text, edits = list(base), sorted(rng.sample(range(1, 899), 22))
        for at in edits:
            text[at] = f"own{i}-{at}"
        rows.append((i, " ".join(text)))
        rows.append((10 + i, " ".join(w for at in edits for w in text[at - 1 : at + 2])))  # so that the edits are shared, but with another text
    met, sets = _met(spark, rows)
    got = {tuple(r) for r in minhash._across(met, 80).collect()}
    assert _similar(sets) and _similar(sets) <= got


def test_components_meet_by_one_member_each(spark):
    """A round takes no more pairs than rows, however large the components are."""
    from barwright.llm import minhash

    rng = random.Random(7)
    rows = _family(rng, 0, 40, 2)
    joined = [(i, i % 2) for i in range(40)]
    met, sets = _met(spark, rows, joined)
    got = {tuple(r) for r in minhash._by_component(met, 80).collect()}
    assert 0 < len(got) <= met.count()
    assert all((a - b) % 2 for a, b in got)
    across = {(a, b) for a, b in _similar(sets) if (a - b) % 2}
    assert got & across and across <= {tuple(r) for r in minhash._across(met, 80).collect()}


def test_near_copies_that_buckets_keep_apart(spark):
    """The whole search with few sub-keys, so that most links are left to the rounds and the search across components."""
    from barwright.llm import minhash

    rng = random.Random(8)
    rows = _family(rng, 0, 30, 3) + _family(rng, 100, 20, 4) + [(200, ""), (201, None)]
    docs = spark.createDataFrame(rows, DOCS)
    full = {r["doc_id"]: r["component_id"] for r in minhash.near_duplicates(docs, shingle=2).collect()}
    parent = {i: i for i, _ in rows}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in _similar(_sets([r for r in rows if r[1]])):
        x, y = sorted((root(a), root(b)))
        parent[y] = x
    assert full == {i: root(i) for i in parent}
