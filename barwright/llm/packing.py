"""Bounded-space online packing of documents into sequences of at most ``SIZE`` tokens.

Every partition keeps at most ``OPEN`` windows. A document, or what is left of it beyond whole sequences, goes into the fullest
window that it fits (best fit). When it fits none and all are open, the fullest is filled up with the document's head and
emitted. The windows that are open at a partition's end are merged: ``MERGED`` partitions' leftovers at a time are
joined and cut into whole sequences, and what remains is cut into sequences whose lengths are powers of two, which
need no padding. Leftovers of one merge are at most ``OPEN * MERGED`` windows, whatever the table holds.

Defined cases: a null text is an empty one and has only the end id. Every row is packed, repeated rows and null ids too. An empty
table gives no pieces. Sequence ids are unique, not gapless.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barwright.llm.flat import parts, released
from barwright.llm.store import stored
from barwright.llm.subwords import subwords

SIZE = 2048
OPEN = 16
MERGED = 32
END = 1

PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, ids binary"
_ID = 4  # bytes of an id


class Packer:
    """Packs the documents of one partition."""

    def __init__(self, size: int, n_open: int) -> None:
        self.size, self.n_open = size, n_open
        self.windows: list[tuple[int, list]] = []
        self.done: list[list] = []

    def add(self, doc_id: int | None, ids: bytes) -> None:
        total, at = len(ids) // _ID, 0
        while total - at >= self.size:
            self.done.append([(doc_id, at, ids[at * _ID : (at + self.size) * _ID], total)])
            at += self.size
        while at < total:
            rest = total - at
            fits = [(fill, k) for k, (fill, _) in enumerate(self.windows) if fill + rest <= self.size]
            if fits:
                fill, k = max(fits)
            elif len(self.windows) < self.n_open:
                fill, k = 0, len(self.windows)
                self.windows.append((0, []))
            else:
                fill, k = max((fill, -k) for k, (fill, _) in enumerate(self.windows))
                k = -k
            take = min(rest, self.size - fill)
            pieces = self.windows[k][1]
            pieces.append((doc_id, at, ids[at * _ID : (at + take) * _ID], total))
            self.windows[k] = (fill + take, pieces)
            at += take
            if fill + take == self.size:
                self.done.append(pieces)
                del self.windows[k]


def _rows(sequences: list[list], ids: list[int | None], keep_ids: bool) -> list[tuple]:
    out = []
    for pieces, number in zip(sequences, ids, strict=True):
        offset = 0
        for doc_id, start, held, total in pieces:
            length = len(held) // _ID
            out.append((doc_id, start, length, zlib.crc32(held), total, number, offset, held if keep_ids else None))
            offset += length
    return out


def merge(pieces: list[tuple], size: int) -> list[list]:
    """Cut the joined pieces into sequences of ``size``, the rest into powers of two."""
    left = sum(len(p[2]) // _ID for p in pieces)
    sequences: list[list] = []
    room = 0
    for doc_id, start, held, total in pieces:
        at = 0
        while at < len(held):
            if not room:
                room = size if left >= size else 1 << (left.bit_length() - 1)
                sequences.append([])
            take = min(room, len(held) // _ID - at // _ID)
            sequences[-1].append((doc_id, start + at // _ID, held[at : at + take * _ID], total))
            at += take * _ID
            room -= take
            left -= take
    return sequences


def pack(
    docs: DataFrame, vocabulary: str, size: int = SIZE, n_open: int = OPEN, merged: int = MERGED, with_ids: bool = False
) -> DataFrame:
    """Pieces: ``doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, ids`` (null unless ``with_ids``)."""
    end = END.to_bytes(_ID, "little")
    batch_schema = pa.schema([
        *((n, pa.int64()) for n in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")),
        ("ids", pa.binary()), ("part", pa.int64()), ("window", pa.int32()),
    ])

    def batch(rows: list[tuple], part: int, windows: list[int | None]) -> pa.RecordBatch:
        columns = [list(c) for c in zip(*rows, strict=True)] if rows else [[] for _ in range(8)]
        columns += [[part] * len(rows), windows]
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, batch_schema, strict=True)], schema=batch_schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        words, packer, number = subwords(vocabulary), Packer(size, n_open), part << 31
        for whole in batches:
            for own in parts(whole):
                texts = own.column("text").fill_null("").cast(pa.binary()).to_pylist()
                for doc_id, ids in zip(own.column("doc_id").to_pylist(), words.texts(texts), strict=True):
                    packer.add(doc_id, ids + end)
                rows = _rows(packer.done, list(range(number, number + len(packer.done))), with_ids)
                number += len(packer.done)
                packer.done = []
                yield batch(rows, part, [None] * len(rows))
        rows, windows = [], []
        for k, (_, pieces) in enumerate(packer.windows):
            own = _rows([pieces], [None], True)
            rows += own
            windows += [k] * len(own)
        yield batch(rows, part, windows)

    def finish(key: tuple, left: pd.DataFrame) -> pd.DataFrame:
        left = left.sort_values(["part", "window", "offset"], kind="stable")
        ids = [None if pd.isna(i) else int(i) for i in left["doc_id"]]  # text: pandas has no whole numbers beside nulls
        pieces = list(zip(ids, left["start"].tolist(), left["ids"], left["doc_tokens"].tolist(), strict=True))
        sequences = merge(pieces, size)
        first = ((1 << 30) + int(key[0])) << 31
        out = pd.DataFrame(_rows(sequences, list(range(first, first + len(sequences))), with_ids), columns=names)
        return out.astype({"doc_id": "Int64"})

    names = [c.split()[0] for c in PIECE.split(", ")]
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    packed = stored(docs.sparkSession, "packing", rows.mapInArrow(released(run), f"{PIECE}, part long, window int"))
    left = packed.where("window is not null").withColumn("merge", F.floor(F.col("part") / merged))
    left = left.withColumn("doc_id", F.col("doc_id").cast("string"))
    return packed.where("window is null").select(*names).unionByName(left.groupBy("merge").applyInPandas(finish, PIECE))
