"""Passages that repeat across documents: seeds by winnowed anchors, extension, removal of all but the first occurrence.

A window is ``WINDOW`` consecutive words. Of the ``ANCHOR``-word grams in a window, the one with the least hash is its anchor, so equal
windows have equal anchors, and neighbouring windows mostly share one. A row is written per anchor occurrence and not per
window. Only anchors that occur twice are seeds.

A seed is extended both ways over the stretch of words that its windows cover. Occurrences whose whole stretch is equal form a
class; all but the first of a class are repeats over the full stretch. So a passage with a billion copies is one class,
counted on the map side. The first occurrences of different classes of one anchor are compared window by window: equal
windows have equal 128-bit hashes, and all but the first are repeats. The union of the covered words is the union of
the maximal repeats of at least ``WINDOW`` words. No pairs are made, and nothing is capped.

Defined cases: a null text has no words. Shorter texts than a window never lose words. "Earlier" is a smaller doc_id, or an earlier start
in the same document; a null id comes first. Rows with the same id and text are one document; rows with the same id and
different texts are told apart by two 64-bit hashes of the text. An empty table gives an empty result.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barwright.llm.flat import PART_BYTES, Words, flat, mix, parts, signed
from barwright.llm.store import stored

WINDOW = 20
ANCHOR = 4

NO_ID = -(2**63)

#: What names a document and orders it: the id and 128 bits of the text.
KEY = ("doc_id", "tag", "tag_2")

_WORD = re.compile(rb"[^\x20\x09-\x0D]+")
#: Places of grams that a packed value can hold; longer parts than this many words are single texts.
_PLACE_BITS = np.uint64(24)


def stretches(words: Words, window: int, anchor: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Anchor occurrences: the anchor's hash, its place, and the first and last window that it serves."""
    n = len(words.hashes)
    windows = words.gram_starts(window)
    empty = np.zeros(0, np.int64)
    if not len(windows):
        return empty.astype(np.uint64), empty, empty, empty
    prefix = words.prefix()
    starts = np.arange(n - anchor + 1)
    grams = words.sequence_hashes(starts, starts + anchor, prefix)
    place_mask = (np.uint64(1) << _PLACE_BITS) - np.uint64(1)
    packed = (grams & ~place_mask) | (starts.astype(np.uint64) & place_mask)  # equal hashes: the first place wins
    width, least = 1, packed
    span = window - anchor + 1
    while 2 * width <= span:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    if width < span:
        least = np.minimum(least[: len(packed) - span + 1], least[span - width :][: len(packed) - span + 1])
    chosen = least[windows]
    place = windows + ((chosen & place_mask).astype(np.int64) - windows) % (1 << int(_PLACE_BITS))
    new = np.append(True, (place[1:] != place[:-1]) | (windows[1:] != windows[:-1] + 1))
    at = np.flatnonzero(new)
    last = np.append(at[1:], len(windows)) - 1
    return grams[place[at]], place[at], windows[at], windows[last]


def _key(docs: DataFrame) -> DataFrame:
    """``KEY`` and ``text``; the least long stands for no id."""
    text = F.col("text").cast("string")
    content = F.coalesce(text, F.lit(""))
    return docs.select(
        F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc_id"),
        F.xxhash64(content).alias("tag"),
        F.xxhash64(F.lit(1), content).alias("tag_2"),  # the first value seeds the hash of the second
        text.alias("text"),
    )


def _packed(keyed: DataFrame) -> DataFrame:
    """``KEY`` and ``packed``: texts compressed for a shuffle."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in parts(whole):
                texts = batch.column("text").fill_null("").cast(pa.binary()).to_pylist()
                packed = pa.array([zlib.compress(t, 1) for t in texts], pa.binary())
                yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in KEY), packed], names=[*KEY, "packed"])

    return keyed.mapInArrow(pack, "doc_id long, tag long, tag_2 long, packed binary")


def _unpacked(whole: pa.RecordBatch) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Parts of a batch and their texts."""
    for batch in parts(whole, "packed", PART_BYTES // 3):
        yield batch, [zlib.decompress(p) for p in batch.column("packed").to_pylist()]


def _spans(keyed: DataFrame, window: int, anchor: int) -> DataFrame:
    """``KEY`` and ``spans``: per document with repeats the word ranges (start, end) that go; they may overlap."""
    spark = keyed.sparkSession

    def occurrences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in parts(whole):
                words = flat(batch.column("text")).words()
                anchors, place, first, last = stretches(words, window, anchor)
                own = words.text_of()[first] if len(first) else first
                stretch = words.sequence_hashes(first, last + window) if len(first) else anchors
                stretch = mix(stretch + (place - first).astype(np.uint64))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(signed(anchors)),
                        pa.array(signed(stretch)),
                        *(batch.column(k).take(pa.array(own)) for k in KEY),
                        pa.array((first - words.bounds[own]).astype(np.int32)),
                        pa.array((last - first + 1).astype(np.int32)),
                    ],
                    names=["anchor", "stretch", *KEY, "first", "n"],
                )

    def windows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch, texts in _unpacked(whole):
                words = flat(pa.array(texts, pa.binary())).words()
                prefix = words.prefix()
                stretches_of = batch.column("stretches")
                counts = np.diff(stretches_of.offsets.to_numpy())
                inner = stretches_of.flatten()
                first, n = inner.field("first").to_numpy().astype(np.int64), inner.field("n").to_numpy().astype(np.int64)
                own = np.repeat(np.arange(batch.num_rows), counts)
                start = np.repeat(first, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                own = np.repeat(own, n)
                at = start + words.bounds[own]
                one = words.sequence_hashes(at, at + window, prefix)
                half = window // 2
                two = mix(words.sequence_hashes(at, at + half, prefix) + np.uint64(3) * words.sequence_hashes(at + half, at + window, prefix))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(signed(one)),
                        pa.array(signed(two)),
                        *(batch.column(k).take(pa.array(own)) for k in KEY),
                        pa.array(start.astype(np.int32)),
                    ],
                    names=["one", "two", *KEY, "first"],
                )

    schema = "anchor long, stretch long, doc_id long, tag long, tag_2 long, first int, n int"
    found = keyed.mapInArrow(occurrences, schema)
    # What is counted by a key is written before it is joined by that key: only then can the join's hot keys be split.
    twice = stored(spark, "repeat-anchors", found.groupBy("anchor").count().where("count > 1").select("anchor"))
    seeds = stored(spark, "repeat-seeds", found.join(twice, "anchor", "left_semi"))

    earliest = F.min(F.struct(*KEY, "first")).alias("earliest")
    classes = stored(spark, "repeat-classes", seeds.groupBy("anchor", "stretch", "n").agg(earliest))
    here = F.struct(*KEY, "first")
    copies = (
        seeds.join(classes, ["anchor", "stretch", "n"])
        .where(here != F.col("earliest"))
        .select(*KEY, F.col("first").alias("start"), (F.col("first") + F.col("n") + (window - 1)).alias("end"))
    )

    several = stored(spark, "repeat-several", classes.groupBy("anchor").count().where("count > 1").select("anchor"))
    firsts = classes.join(several, "anchor", "left_semi").select("earliest.*", "n")
    per_doc = firsts.groupBy(*KEY).agg(F.collect_set(F.struct("first", "n")).alias("stretches"))
    texts = _packed(keyed).join(per_doc, [*KEY])
    windows = stored(
        spark,
        "repeat-windows",
        texts.mapInArrow(windows_of, "one long, two long, doc_id long, tag long, tag_2 long, first int").distinct(),
    )
    origins = windows.groupBy("one", "two").agg(earliest, F.count("*").alias("n")).where("n > 1").drop("n")
    origins = stored(spark, "repeat-origins", origins)
    later = (
        windows.join(origins, ["one", "two"])
        .where(here != F.col("earliest"))
        .select(*KEY, F.col("first").alias("start"), (F.col("first") + window).alias("end"))
    )
    spans = F.collect_set(F.struct("start", "end")).alias("spans")
    return copies.unionByName(later).groupBy(*KEY).agg(spans)


def without_repeats(docs: DataFrame, window: int = WINDOW, anchor: int = ANCHOR) -> DataFrame:
    """``doc_id, n_words, n_removed, text`` per document; the text's remaining words are joined by one blank."""
    keyed = _key(docs)
    spans = _spans(keyed, window, anchor)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch, texts in _unpacked(whole):
                ranges = batch.column("spans")
                out, sizes, gone = [], [], []
                for i, text in enumerate(texts):
                    words = _WORD.findall(text)
                    found = ranges[i]
                    removed = 0
                    if found.is_valid and len(found.values):
                        edges = np.zeros(len(words) + 1, np.int64)
                        np.add.at(edges, found.values.field("start").to_numpy(), 1)
                        np.add.at(edges, found.values.field("end").to_numpy(), -1)
                        stays = np.cumsum(edges)[:-1] == 0
                        removed = len(words) - int(stays.sum())
                        sizes.append(len(words))
                        words = compress(words, stays.tolist())
                    else:
                        sizes.append(len(words))
                    gone.append(removed)
                    out.append(b" ".join(words))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(gone, pa.int64()), pa.array(out, pa.binary()).cast(pa.string())],
                    names=["doc_id", "n_words", "n_removed", "text"],
                )

    joined = _packed(keyed).join(spans, [*KEY], "left").dropDuplicates([*KEY])
    out = joined.mapInArrow(cut, "doc_id long, n_words long, n_removed long, text string")
    return out.withColumn("doc_id", F.nullif("doc_id", F.lit(NO_ID)))
