"""Hard negatives of anchors among all vectors: exact integer scores behind bounds from segment summaries.

A vector of whole numbers is cut into segments; its mean and deviation (root of the mean squared distance from it) are stored
for each. Over a segment of m components the inner product of two vectors lies within m times the product of the means, plus
or minus m times the product of the deviations. The finest summaries are stored with the vector, and halves are merged into
coarser ones. For an anchor all rows of a block are bounded by one segment, the rows that can still count by two, then
four, and so on; only what is left after the finest level is scored component by component. Bounds only decide
what need not be scored: a row goes when at least as many others as are asked for are surely better, or when its score surely
lies outside every wanted range.

All rows are dealt evenly to blocks of at most ``BLOCK_ROWS``, by hash of the id, so neither a common label nor equal vectors make a
block larger. Every anchor goes to every block, rows stay where they are: a task holds one block as arrays and streams
the anchors past it. Each block returns its best rows an anchor, and a window per anchor takes the best of all blocks.

Defined cases: rows with a null id, label or vector, or a null or non-finite component, take no part. Of several rows with one id
the one with the least label, then the least vector, counts. Shorter vectors are filled up with zeros. Quantised
components are held within plus or minus the root of 2^53 / dimension (46,340 times 256 at 64 dimensions), where scores are
exact. Equal scores stand in the order of ids. An anchor without positives, or a positive without negatives in its range,
has no rows. Other columns are ignored. An empty table gives none.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barwright.llm.store import stored

BLOCK_ROWS = 65_536
#: Least number of blocks, so that small tables use the cluster too; all tasks of a larger table hold full blocks.
LEAST_BLOCKS = 64
#: Segments of the finest level.
SEGMENTS = 16
POSITIVES = 5
NEGATIVES = 10
#: Range of a negative's score in hundredths of the positive's.
LOW, HIGH = 30, 90

VECTORS = "vec_id long, label long, vector binary, mean binary, deviation binary"


def quantised(rows: DataFrame, scale: int = 256) -> DataFrame:
    """``vec_id, label, q`` of the rows that take part, one row an id."""
    q = F.transform(F.col("embedding"), lambda x: F.floor(scale * F.greatest(F.lit(-1e15), F.least(F.lit(1e15), x.cast("double")))))
    sound = F.forall(
        F.col("embedding"),
        lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < F.lit(float("inf"))),
    )
    rows = rows.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.coalesce(sound, F.lit(False)))
    rows = rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), q.alias("q"))
    return rows.groupBy("vec_id").agg(F.min(F.struct("label", "q")).alias("v")).select("vec_id", "v.label", "v.q")


def summaries(x: np.ndarray, segments: int) -> tuple[np.ndarray, np.ndarray]:
    """Means and deviations, (rows, segments) each; the width of ``x`` is a multiple of ``segments``."""
    parts = x.reshape(len(x), segments, -1)
    return parts.mean(2), parts.std(2)


def levels(mean: np.ndarray, deviation: np.ndarray, width: int) -> list[np.ndarray]:
    """Per level, coarsest first, [means, deviations] times the root of the segment's length, so that bounds are inner products.

    Two halves merge into their mean and into a deviation from it that adds the squared distance of the halves' means.
    """
    out = []
    while True:
        root = math.sqrt(width / mean.shape[1])
        out.append(np.hstack([mean, deviation]) * root)
        if mean.shape[1] == 1:
            return out[::-1]
        a, b = mean[:, ::2], mean[:, 1::2]
        variance = (deviation[:, ::2] ** 2 + deviation[:, 1::2] ** 2) / 2 + ((a - b) / 2) ** 2
        mean, deviation = (a + b) / 2, np.sqrt(variance)


@dataclass
class Block:
    """Vectors of one block, in the order of ids."""

    ids: np.ndarray
    labels: np.ndarray
    x: np.ndarray
    levels: list[np.ndarray]

    def bounds(self, level: int, own: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Least and greatest possible scores; ``own`` holds the anchor's summaries of this level."""
        half = len(own) // 2
        held = self.levels[level][rows]
        middle, spread = held[:, :half] @ own[:half], held[:, half:] @ own[half:]
        slack = 1e-9 * (np.abs(middle) + spread) + 1e-6  # rounding never drops a row
        return middle - spread - slack, middle + spread + slack


def _kth_largest(values: np.ndarray, k: int) -> float:
    return float(np.partition(values, len(values) - k)[len(values) - k]) if len(values) >= k else -math.inf


def nearest(block: Block, rows: np.ndarray, x: np.ndarray, own: list[np.ndarray], ranges: list[tuple[int, int]], k: int) -> list[tuple[int, int, int]]:
    """For each range (least, greatest score, ends included) the ``k`` best of ``rows``: (number of the range, row, score)."""
    for level, summary in enumerate(own):
        if len(rows) <= k:
            break
        low, high = block.bounds(level, summary, rows)
        keep = np.zeros(len(rows), bool)
        for least, greatest in ranges:
            sure = low[(low >= least) & (high <= greatest)]
            keep |= (high >= max(least, _kth_largest(sure, k))) & (low <= greatest)
        rows = rows[keep]
    scores = np.rint(block.x[rows] @ x).astype(np.int64)
    order = np.lexsort((block.ids[rows], -scores))
    rows, scores = rows[order], scores[order]
    found = []
    for number, (least, greatest) in enumerate(ranges):
        first = np.searchsorted(-scores, -greatest, "left")
        last = min(np.searchsorted(-scores, -least, "right"), first + k)
        found += [(number, int(r), int(s)) for r, s in zip(rows[first:last], scores[first:last], strict=True)]
    return found


def limits(positive: int, low: int = LOW, high: int = HIGH) -> tuple[int, int]:
    """Least and greatest score s with low * positive <= 100 * s <= high * positive."""
    return -(-low * positive // 100), high * positive // 100


def summarised(rows: DataFrame, segments: int = SEGMENTS) -> tuple[DataFrame, int]:
    """The vectors of ``quantised`` with their finest summaries, and their common width."""
    widest = rows.agg(F.max(F.size("q"))).first()[0] or 0
    dimension = max(widest, 1)
    width = -(-dimension // segments) * segments
    most = math.isqrt(2**53 // dimension)
    schema = pa.schema([("vec_id", pa.int64()), ("label", pa.int64()), *((n, pa.binary()) for n in ("vector", "mean", "deviation"))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            q = batch.column("q")
            sizes = np.diff(q.offsets.to_numpy())
            x = np.zeros((batch.num_rows, width))
            x[np.arange(width)[None, :] < sizes[:, None]] = q.flatten().to_numpy(zero_copy_only=False)
            x = np.clip(x, -most, most)
            mean, deviation = summaries(x, segments)
            columns = [[r.tobytes() for r in m] for m in (x.astype("<i4"), mean, deviation)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("vec_id"), batch.column("label"), *(pa.array(c, pa.binary()) for c in columns)], schema=schema
            )

    return rows.mapInArrow(run, VECTORS), width


def _matrix(column: pa.Array, kind: str) -> np.ndarray:
    rows = column.to_pylist()
    return np.frombuffer(b"".join(rows), kind).reshape(len(rows), -1).astype(float)


def _past_blocks(
    vectors: DataFrame, anchors: DataFrame, blocks: int, width: int, k: int, shares: tuple[int, int] | None = None
) -> DataFrame:
    """``anchor_id, number, score, vec_id``: for every anchor, range and block the ``k`` best rows.

    Without ``shares`` these are rows of the anchor's label at any score, else rows of other labels in the range that
    ``shares`` gives for each of the anchor's ``scores``.
    """
    block = F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int")
    rows = vectors.select(block.alias("block"), F.lit(0).alias("kind"), "*", F.lit(None).cast("array<bigint>").alias("scores"))
    past = anchors.select(
        F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), F.lit(1).alias("kind"), *vectors.columns, "scores"
    )
    schema = pa.schema([(n, pa.int64()) for n in ("anchor_id", "number", "score", "vec_id")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here: int | None = None
        waiting: list[pa.RecordBatch] = []
        held: Block | None = None
        by_label: dict[int, np.ndarray] = {}

        def load() -> Block:
            table = pa.Table.from_batches(waiting)
            ids = table["vec_id"].to_numpy()
            order = np.argsort(ids, kind="stable")
            x, mean, deviation = (_matrix(table[n], t)[order] for n, t in (("vector", "<i4"), ("mean", "<f8"), ("deviation", "<f8")))
            return Block(ids[order], table["label"].to_numpy()[order], x, levels(mean, deviation, width))

        for batch in batches:
            of = batch.column("block").to_numpy()
            kinds = batch.column("kind").to_numpy()
            cuts = np.flatnonzero((np.diff(of) != 0) | (np.diff(kinds) != 0)) + 1
            for start, end in zip([0, *cuts], [*cuts, len(of)], strict=True):
                part = batch.slice(start, end - start)
                if of[start] != here:
                    here, waiting, held = int(of[start]), [], None
                if kinds[start] == 0:
                    waiting.append(part)
                    continue
                if not waiting:
                    continue  # a block without rows
                if held is None:
                    held = load()
                    by_label = {int(c): np.flatnonzero(held.labels == c) for c in np.unique(held.labels)}
                out: list[tuple[int, int, int, int]] = []
                x, mean, deviation = (_matrix(part.column(n), t) for n, t in (("vector", "<i4"), ("mean", "<f8"), ("deviation", "<f8")))
                own = levels(mean, deviation, width)
                columns = (part.column(n).to_pylist() for n in ("vec_id", "label", "scores"))
                for i, (anchor, label, scores) in enumerate(zip(*columns, strict=True)):
                    if shares:
                        rows, ranges = np.flatnonzero(held.labels != label), [limits(s, *shares) for s in scores]
                    else:
                        rows, ranges = by_label.get(label, np.zeros(0, np.int64)), [(-(2**62), 2**62)]
                        rows = rows[held.ids[rows] != anchor]
                    best = nearest(held, rows, x[i], [level[i] for level in own], ranges, k)
                    out += [(anchor, number, score, int(held.ids[row])) for number, row, score in best]
                columns = zip(*out, strict=True) if out else ([],) * 4
                yield pa.RecordBatch.from_arrays([pa.array(list(c), pa.int64()) for c in columns], schema=schema)

    dealt = rows.unionByName(past).repartition(blocks, "block").sortWithinPartitions("block", "kind")
    return dealt.mapInArrow(run, "anchor_id long, number long, score long, vec_id long")


def _best(found: DataFrame, keys: list[str], k: int) -> DataFrame:
    order = Window.partitionBy(*keys).orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def mine(
    vectors: DataFrame,
    is_anchor: Column,
    positives: int = POSITIVES,
    negatives: int = NEGATIVES,
    low: int = LOW,
    high: int = HIGH,
    segments: int = SEGMENTS,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score`` for ``vectors(vec_id, label, q)``.

    The anchors are the vectors that meet ``is_anchor``, a condition on ``vec_id`` and ``label``.
    """
    spark = vectors.sparkSession
    table, width = summarised(stored(spark, "vectors", vectors), segments)
    table = stored(spark, "summaries", table)
    blocks = max(LEAST_BLOCKS, -(-table.count() // block_rows))
    anchors = table.where(is_anchor)
    near = _past_blocks(table, anchors.withColumn("scores", F.lit(None).cast("array<bigint>")), blocks, width, positives)
    entry = F.struct("rank", F.col("vec_id").alias("positive_id"), "score")  # at most ``positives`` of them
    near = _best(near, ["anchor_id"], positives).groupBy("anchor_id").agg(F.sort_array(F.collect_list(entry)).alias("positives"))
    near = stored(spark, "positives", near)
    asked = anchors.join(near.withColumnRenamed("anchor_id", "vec_id"), "vec_id").withColumn("scores", F.col("positives.score"))
    far = _best(_past_blocks(table, asked, blocks, width, negatives, (low, high)), ["anchor_id", "number"], negatives)
    pairs = near.select("anchor_id", F.posexplode("positives").alias("number", "p"))
    return far.join(pairs, ["anchor_id", "number"]).select(
        "anchor_id", F.col("p.positive_id").alias("positive_id"), F.col("rank").cast("int").alias("rank"),
        F.col("vec_id").alias("negative_id"), F.col("p.score").alias("positive_score"), F.col("score").alias("negative_score"),
    )
