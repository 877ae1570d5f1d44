"""The pipeline's stages against plain Python."""

from __future__ import annotations

import zlib

import brute
import corpus_pipeline
import pytest

CLASHING = "doc_id long, text string, lang string, source string, n_chars long, row string, id string, own string, gone string, digest string, key string"


def stage(name):
    return dict(corpus_pipeline.STAGES)[name]


def test_stages_in_order():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "exact_dedup", "near_dedup", "secret_scan", "packing"]


@pytest.mark.parametrize("name", ["language_id", "exact_dedup", "near_dedup", "secret_scan"])
def test_columns_and_clashing_names(spark, sf_dir, odd, name):
    rows = [(i, t, "en", "s", len(t or ""), *"abcdef") for i, t in odd]
    docs = spark.createDataFrame(rows, CLASHING)
    out = stage(name)(spark, docs, sf_dir)
    assert out.schema.names == docs.schema.names
    assert [f.dataType for f in out.schema.fields] == [f.dataType for f in docs.schema.fields]
    got = [tuple(r) for r in out.collect()]
    if name == "language_id":
        expected = [r for r in rows if any(c.isalpha() for c in r[1] or "")]
    elif name == "exact_dedup":
        best = {}
        for r in rows:
            key = brute.lower(r[1])
            if key not in best or (-1 if r[0] is None else r[0]) > (-1 if best[key][0] is None else best[key][0]):
                best[key] = r
        expected = list(best.values())
    elif name == "near_dedup":
        groups = brute.components({i: t for i, t in odd if i is not None}, k=5)
        expected = [r for r in rows if r[0] is None or groups[r[0]][1] == r[0]]
    else:
        assert len(got) == len(rows)
        assert not any(brute.base_spans(r[1]) for r in got)
        return
    assert sorted(got, key=str) == sorted(expected, key=str)


def test_run(spark, sf_dir, documents):
    import numpy as np
    import public_tokenizers as public
    from barwright.llm import secrets
    from tokenizers import Tokenizer

    best = {}
    for i, t in documents.items():
        if any(c.isalpha() for c in t or ""):
            best[brute.lower(t)] = max(i, best.get(brute.lower(t), i))
    left = {i: documents[i] for i in best.values()}
    groups = brute.components(left, k=5)
    left = {i: t for i, t in left.items() if groups[i][1] == i}
    tokenizer = Tokenizer.from_file(public.path("word_bpe_49k.json"))
    tokenizer.encode_special_tokens = True
    expected = {}
    for i, t in left.items():
        text = secrets.redact(t, secrets.spans(t, True, True, True, True, secrets.MIN_COST))
        expected[i] = np.array([*tokenizer.encode(text, add_special_tokens=False).ids, 1], "<u4").tobytes()
    got = corpus_pipeline.run(spark, sf_dir).orderBy("doc_id", "start").collect()
    made = {}
    for r in got:
        assert r["start"] == len(made.get(r["doc_id"], b"")) // 4
        assert r["ids_crc32"] == zlib.crc32(r["ids"])
        made[r["doc_id"]] = made.get(r["doc_id"], b"") + bytes(r["ids"])
    assert made == expected


def test_languages_decide_what_is_text(spark, sf_dir, documents):
    """Clean documents stay, noise in letters goes, and where nothing was learnt only the letters decide."""
    schema = "doc_id long, text string, lang string"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    noise = [(-1, "zqxjkvbw wqzxkjhq xqzvwkjy", None), (-2, "漢字漢字 龘靐齉", None), (-3, "12345 --- 67", "en"), (-4, None, "en"), (-5, "", None)]
    rows = docs.unionByName(spark.createDataFrame(noise, schema))
    kept = {r["doc_id"] for r in stage("language_id")(spark, rows, sf_dir).collect()}
    assert kept == {i for i, t in documents.items() if any(c.isalpha() for c in t or "")}
    unlabelled = rows.withColumn("lang", rows["lang"].substr(0, 0).cast("string")).replace("", None, subset=["lang"])
    kept = {r["doc_id"] for r in stage("language_id")(spark, unlabelled, sf_dir).collect()}
    assert kept == {i for i, t in documents.items() if any(c.isalpha() for c in t or "")} | {-1, -2}
    assert stage("language_id")(spark, rows.limit(0), sf_dir).count() == 0


def test_stages_of_an_empty_table(spark, sf_dir):
    empty = spark.createDataFrame([], CLASHING)
    for name, run in corpus_pipeline.STAGES:
        assert run(spark, empty, sf_dir).count() == 0, name


def test_packing_ignores_clashing_columns(spark, sf_dir, odd):
    rows = [(i, t, "en", "s", 0, *"abcdef") for i, t in odd]
    names = "doc_id long, text string, lang string, source string, start long, ids string, part string, `window` string, merge string, offset string, length string"
    got = stage("packing")(spark, spark.createDataFrame(rows, names), sf_dir).collect()
    plain = stage("packing")(spark, spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string"), sf_dir).collect()
    assert sum(r["length"] for r in got) == sum(r["length"] for r in plain)
    assert sum(r["doc_tokens"] for r in got if r["start"] == 0) == sum(r["length"] for r in got)
