"""Quality rules: document statistics, two fixed rules, and boosted trees over the statistics.

The trees are fitted on a bounded sample of labelled rows: the ``MAX_TRAINING`` labelled documents whose id hashes lowest.
Everything else covers every row and every whole text. More symbols, repeated lines or repeated words never raise a score.

Defined cases: a null text is an empty one, has no words and fails the rules. Every row gives one row; repeated rows and null
ids are kept. Labels without an id or a quality are left out; of several labels of one id the lowest counts. Without
labelled rows, or with one class only, the trees give a constant, and that class or the rules alone decide. An empty table
gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barwright.llm.flat import SEPARATOR, Flat, flat, mix, parts
from barwright.llm.trees import Trees, train

MAX_TRAINING = 20_000
#: Below this probability of good quality a document goes; well under one half, since losing clean text costs more.
MIN_SCORE = 0.3

# The rules' symbols and limits.
SYMBOLS = "#*$%&|<>"
MIN_WORDS = 50

BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
EXTRA = ("n_lines", "n_distinct", "n_digits", "n_upper", "n_stops", "n_commas", "longest_word")
#: Name and monotonic constraint of what the trees see.
FEATURES = (
    ("log_words", 0), ("word_length", 0), ("symbol_rate", -1), ("dup_line_rate", -1), ("repeat_rate", -1),
    ("words_a_line", 0), ("distinct_rate", 0), ("digit_rate", 0), ("upper_rate", 0), ("stop_rate", 0), ("comma_rate", 0), ("longest_word", 0),
)

_IS = {c: np.zeros(256, bool) for c in ("symbol", "digit", "upper")}
_IS["symbol"][[ord(c) for c in SYMBOLS]] = True
_IS["digit"][48:58] = True
_IS["upper"][65:91] = True


def statistics(texts: Flat) -> dict[str, np.ndarray]:
    """Counts of every text, all columns of ``BASE`` and ``EXTRA``."""
    data, offsets = texts.data, texts.offsets
    words = texts.words()
    n_texts = len(texts)

    def count(mask: np.ndarray, bounds: np.ndarray = offsets) -> np.ndarray:
        sums = np.zeros(len(mask) + 1, np.int64)
        np.cumsum(mask, out=sums[1:])
        return sums[bounds[1:]] - sums[bounds[:-1]]

    out = {
        "n_words": np.diff(words.bounds),
        "word_chars": count(~SEPARATOR[data] & ((data & 0xC0) != 0x80)),
        "n_symbols": count(_IS["symbol"][data]),
        "n_digits": count(_IS["digit"][data]),
        "n_upper": count(_IS["upper"][data]),
        "n_stops": count(data == 46),
        "n_commas": count(data == 44),
    }
    full = np.flatnonzero(np.diff(offsets))
    breaks = np.flatnonzero(data == 10)
    starts = np.union1d(offsets[full], breaks + 1)
    starts = starts[starts < len(data)]
    ends = np.append(starts[1:], len(data))
    ends = ends - ((ends > starts) & (data[np.maximum(ends, 1) - 1] == 10)) if len(starts) else ends
    has_word = np.searchsorted(words.starts, ends) > np.searchsorted(words.starts, starts)
    starts, ends = starts[has_word], ends[has_word]
    text_of = np.searchsorted(offsets, starts, "right") - 1
    out["n_lines"] = np.bincount(text_of, minlength=n_texts)
    keys = mix(texts.byte_hashes(starts, ends) + text_of.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    _, first = np.unique(keys, return_index=True)
    out["n_dup_lines"] = out["n_lines"] - np.bincount(text_of[first], minlength=n_texts)

    word_text = words.text_of()
    keys = mix(words.hashes + word_text.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    _, first = np.unique(keys, return_index=True)
    out["n_distinct"] = np.bincount(word_text[first], minlength=n_texts)
    at = words.gram_starts(3)
    keys = words.sequence_hashes(at, at + 3) + word_text[at].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    _, inverse, counts = np.unique(mix(keys), return_inverse=True, return_counts=True)
    twice = at[counts[inverse] > 1]
    covered = np.zeros(len(words.hashes) + 3, bool)
    for i in range(3):
        covered[twice + i] = True
    out["n_repeat_words"] = count(covered[: len(words.hashes)], words.bounds)
    longest = np.zeros(n_texts, np.int64)
    np.maximum.at(longest, word_text, words.ends - words.starts)
    out["longest_word"] = longest
    return out


def features(s: dict[str, np.ndarray]) -> np.ndarray:
    words, chars = np.maximum(s["n_words"], 1), np.maximum(s["word_chars"], 1)
    lines = np.maximum(s["n_lines"], 1)
    return np.column_stack([
        np.log1p(s["n_words"]), s["word_chars"] / words, s["n_symbols"] / chars, s["n_dup_lines"] / lines, s["n_repeat_words"] / words,
        words / lines, s["n_distinct"] / np.sqrt(words), s["n_digits"] / chars, s["n_upper"] / words, s["n_stops"] / words, s["n_commas"] / words,
        s["longest_word"],
    ])


def base_failed(s: dict[str, np.ndarray]) -> np.ndarray:
    return (s["n_words"] < MIN_WORDS) | (100 * s["n_repeat_words"] > 50 * s["n_words"])


def document_statistics(docs: DataFrame) -> DataFrame:
    """``doc_id`` and the counts of ``BASE`` and ``EXTRA`` per row."""
    return _mapped(docs, None)


def fit(docs: DataFrame, labels: DataFrame, max_training: int = MAX_TRAINING) -> Trees:
    """Trees from at most ``max_training`` labelled documents, whichever ids hash lowest."""
    target = (
        labels.select(F.col("doc_id").cast("long").alias("label_id"), F.col("quality").cast("int").alias("good"))
        .where("label_id is not null and good is not null")
        .groupBy("label_id")
        .agg(F.min("good").alias("good"))
        .orderBy(F.xxhash64("label_id"), "label_id")
        .limit(max_training)
    )
    sample = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    ids = target.select(F.col("label_id").alias("doc_id"))
    stats = document_statistics(sample.join(ids, "doc_id", "left_semi"))
    rows = stats.join(target, stats["doc_id"] == target["label_id"]).drop("label_id").toPandas().sort_values("doc_id")
    rows = rows.drop_duplicates("doc_id")
    columns = {c: rows[c].to_numpy() for c in (*BASE, *EXTRA)}
    return train(features(columns), rows["good"].to_numpy(float), [m for _, m in FEATURES])


def apply_rules(docs: DataFrame, trees: Trees, min_score: float = MIN_SCORE) -> DataFrame:
    """``doc_id``, all counts, ``base_failed``, ``score`` and ``kept`` per row."""
    return _mapped(docs, trees, min_score)


def _mapped(docs: DataFrame, trees: Trees | None, min_score: float = MIN_SCORE) -> DataFrame:
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in parts(whole):
                s = statistics(flat(batch.column("text")))
                columns = [batch.column("doc_id"), *(pa.array(s[c], pa.int64()) for c in (*BASE, *EXTRA))]
                names = ["doc_id", *BASE, *EXTRA]
                if trees is not None:
                    failed, score = base_failed(s), trees.score(features(s))
                    columns += [pa.array(failed), pa.array(score), pa.array(~failed & (score >= min_score))]
                    names += ["base_failed", "score", "kept"]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    schema = "doc_id long, " + ", ".join(f"{c} long" for c in (*BASE, *EXTRA))
    if trees is not None:
        schema += ", base_failed boolean, score double, kept boolean"
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(scan, schema)
