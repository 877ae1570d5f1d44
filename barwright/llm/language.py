"""Language of a text as a mixture: expectation-maximisation over the words, languages chosen by penalised likelihood.

Learning counts hashed n-grams of bytes (words in lower case with a blank at both ends) per language, summed on the cluster
over every learning document; the table has languages x ``BUCKETS`` cells, whatever the corpus. A word's likelihood in a
language is the product of its n-grams' smoothed probabilities. For every text, EM estimates the share of each language
in its words. Languages are taken one by one, best first, while the log-likelihood gains more than ``penalty`` times the
logarithm of the number of words; the largest share is the answer, the share is its score.

Defined cases: a text that is null or has no letter is ``und`` with score 0. With nothing learnt, every text is ``und``.
Equal shares go to the language that comes first in alphabetical order. Documents without a language teach nothing. Every
row gives one row; repeated rows and null ids are kept (a null id is never held out). Empty tables give empty results.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barwright.llm.flat import Flat, LOWER, Words, flat, parts, released

GRAM = 4
BUCKETS = 1 << 16
SMOOTHING = 0.5
PENALTY = 3.0
ROUNDS = 12


@dataclass
class Languages:
    names: list[str]
    logs: np.ndarray  # [BUCKETS, languages]: logarithm of the n-gram's probability


def word_grams(texts: Flat, words: Words) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all n-grams, and where those of each word start. A word of n bytes has n - 1 or one of them."""
    sizes = words.ends - words.starts
    per_word = np.maximum(sizes + 2 - GRAM + 1, 1)
    starts = np.cumsum(per_word) - per_word
    data = LOWER[texts.data].astype(np.uint32)
    padded = np.concatenate([np.full(1, 32, np.uint32), data, np.full(GRAM, 32, np.uint32)])
    at = np.repeat(words.starts - starts, per_word) + np.arange(per_word.sum())  # of the gram's first byte, in padded
    last = np.repeat(words.ends + 1, per_word)  # place of the closing blank, in padded
    h = np.zeros(len(at), np.uint32)
    for i in range(GRAM):
        place = at + i
        c = np.where(place > last, 0, padded[np.minimum(place, len(padded) - 1)])
        if i == 0:
            c[starts] = 32
        c[place == last] = 32
        h = (h ^ c) * np.uint32(0x01000193) + np.uint32(i + 1)
    h ^= h >> np.uint32(15)
    h *= np.uint32(0x2C1B3C6D)
    h ^= h >> np.uint32(13)
    return h & np.uint32(BUCKETS - 1), starts


def learn(docs: DataFrame) -> Languages:
    """Count n-grams of all rows with a language; the driver gets one row of counts per language."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes: dict[str, int] = {}
        total = np.zeros(0, np.int64)
        for whole in batches:
            for batch in parts(whole):
                code = np.array([codes.setdefault(x, len(codes)) for x in batch.column("lang").to_pylist()], np.int64)
                if len(total) < len(codes) * BUCKETS:
                    total = np.append(total, np.zeros(len(codes) * BUCKETS - len(total), np.int64))
                texts = flat(batch.column("text"))
                words = texts.words()
                grams, starts = word_grams(texts, words)
                sizes = np.diff(np.append(starts, len(grams))[words.bounds])
                total += np.bincount(np.repeat(code * BUCKETS, sizes) + grams, minlength=len(total))
        for lang, code in codes.items():
            own = total[code * BUCKETS : (code + 1) * BUCKETS]
            at = np.flatnonzero(own)
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(at), pa.string()), pa.array(at, pa.int32()), pa.array(own[at])], names=["lang", "bucket", "n"]
            )

    rows = docs.where("lang is not null and text is not null").select(F.col("lang").cast("string").alias("lang"), "text")
    counts = rows.mapInArrow(released(count), "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()
    names = sorted(counts["lang"].unique())
    table = np.full((BUCKETS, len(names)), SMOOTHING)
    for k, name in enumerate(names):
        own = counts[counts["lang"] == name]
        table[own["bucket"].to_numpy(), k] += own["n"].to_numpy()
    return Languages(names, np.log(table / table.sum(axis=0)).astype(np.float32))


def shares(logs: np.ndarray, bounds: np.ndarray, rounds: int = ROUNDS, penalty: float = PENALTY) -> np.ndarray:
    """Share of every language in every text. ``logs[w, l]``: of word w in language l; texts are ranges of words.

    All texts go on together: each has its own set of languages, which grows while that pays.
    """
    n_texts, n_langs = len(bounds) - 1, logs.shape[1]
    sizes = np.diff(bounds)
    full = np.flatnonzero(sizes)
    out = np.zeros((n_texts, n_langs))
    if not len(full) or not n_langs:
        return out
    at = bounds[full]
    top = logs.max(axis=1, keepdims=True)
    p = np.exp(logs - top)  # relative to the best language; cancels out in shares
    p += 1e-9
    single = np.add.reduceat(np.log(p), at, axis=0)
    order = np.argsort(-single, axis=1, kind="stable")
    text_of = np.repeat(np.arange(len(full)), sizes[full])
    best = np.zeros((len(full), n_langs))
    best[np.arange(len(full)), order[:, 0]] = 1
    likelihood = single[np.arange(len(full)), order[:, 0]]
    growing = np.arange(len(full))
    member = best > 0
    for k in range(1, n_langs):
        # Only texts in which some words clearly prefer another language can gain from one more.
        rows = np.flatnonzero(np.isin(text_of, growing)) if len(growing) < len(full) else np.arange(len(text_of))
        mine = text_of[rows]
        current = np.log(np.einsum("ij,ij->i", p[rows], best[mine]))
        gain = np.zeros((len(full), n_langs))
        starts = np.flatnonzero(np.append(True, mine[1:] != mine[:-1])) if len(mine) else np.zeros(0, int)
        gain[mine[starts]] = np.add.reduceat(np.maximum(np.log(p[rows]) - current[:, None], 0), starts, axis=0) if len(mine) else 0
        gain[member] = -1
        add = gain.argmax(axis=1)
        need = penalty * np.log(sizes[full] + 1)
        growing = growing[gain[growing, add[growing]] > need[growing]]
        if not len(growing):
            break
        rows = np.flatnonzero(np.isin(text_of, growing))
        mine = text_of[rows]
        starts = np.flatnonzero(np.append(True, mine[1:] != mine[:-1]))
        trial = best.copy()
        wider = member.copy()
        wider[growing, add[growing]] = True
        trial[growing] = wider[growing] / wider[growing].sum(axis=1, keepdims=True)
        own = p[rows]
        for _ in range(rounds):
            weight = own * trial[mine]
            weight /= weight.sum(axis=1, keepdims=True)
            trial[growing] = np.add.reduceat(weight, starts, axis=0) / sizes[full][growing][:, None]
        reached = np.add.reduceat(np.log(np.einsum("ij,ij->i", own, trial[mine])), starts)
        better = reached > likelihood[growing] + need[growing]
        growing, reached = growing[better], reached[better]
        best[growing], member[growing], likelihood[growing] = trial[growing], wider[growing], reached
        if not len(growing):
            break
    out[full] = best
    return out


@dataclass
class Mixed:
    """What the mixture says of a batch of texts; ``best`` and ``share`` of every text, the others of its words."""

    lettered: np.ndarray
    best: np.ndarray
    share: np.ndarray
    logs: np.ndarray
    sizes: np.ndarray  # n-grams of each word
    bounds: np.ndarray


def _mixed(batch: pa.RecordBatch, names: list[str], table: np.ndarray) -> Mixed:
    """For every row: whether it has a letter, the number of its language, that language's share."""
    lettered = pc.match_substring_regex(batch.column("text"), r"\p{L}").fill_null(False).to_numpy(zero_copy_only=False)
    texts = flat(batch.column("text"))
    words = texts.words()
    if not names:
        none = np.zeros(len(texts))
        return Mixed(lettered, none.astype(int), none, np.zeros((len(words.starts), 0)), words.ends - words.starts, words.bounds)
    grams, starts = word_grams(texts, words)
    logs = np.add.reduceat(table[grams], starts, axis=0) if len(starts) else np.zeros((0, len(names)))
    share = shares(logs.astype(np.float64), words.bounds)
    best = share.argmax(axis=1)
    top = np.clip(share[np.arange(len(texts)), best], 0, 1)
    return Mixed(lettered, best, top, logs, np.diff(np.append(starts, len(grams))), words.bounds)


def identify(docs: DataFrame, model: Languages) -> DataFrame:
    """``doc_id, lang_pred, score`` per row."""
    sent = docs.sparkSession.sparkContext.broadcast((model.names, model.logs))  # languages x BUCKETS floats

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, table = sent.value
        for whole in batches:
            for batch in parts(whole):
                found = _mixed(batch, names, table)
                known = found.lettered & bool(names)
                labels = [names[b] if k else "und" for b, k in zip(found.best, known, strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id"), pa.array(labels, pa.string()), pa.array(np.where(known, found.share, 0.0))],
                    names=["doc_id", "lang_pred", "score"],
                )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(released(predict), "doc_id long, lang_pred string, score double")


def explained(found: Mixed) -> np.ndarray:
    """Whether the language that the mixture gives to a text explains a word of it better than chance.

    By chance all n-grams are equally likely.
    """
    own = found.logs[np.arange(len(found.logs)), np.repeat(found.best, np.diff(found.bounds))]
    good = np.zeros(len(own) + 1, np.int64)
    np.cumsum(own > -math.log(BUCKETS) * found.sizes, out=good[1:])
    return good[found.bounds[1:]] > good[found.bounds[:-1]]


def known_rows(docs: DataFrame, model: Languages) -> DataFrame:
    """The rows of ``docs``, all columns, that are text in a learnt language.

    The mixture names each text's language, as in :func:`identify`. A text without a letter goes, and one in which that
    language explains no word. Where no language was learnt, only the letters decide: what cannot be told is kept. Null
    and empty texts have no letter. Repeated rows are judged alike.
    """
    sent = docs.sparkSession.sparkContext.broadcast((model.names, model.logs))

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, table = sent.value
        for whole in batches:
            for batch in parts(whole):
                found = _mixed(batch, names, table)
                wanted = found.lettered & explained(found) if names else found.lettered
                yield batch.filter(pa.array(wanted))

    return docs.mapInArrow(released(keep), docs.schema)


def fold(doc_id: Column, n: int) -> Column:
    """crc32 of the id's decimal text, modulo n; null for a null id."""
    return F.crc32(doc_id.cast("long").cast("string").cast("binary")) % n
