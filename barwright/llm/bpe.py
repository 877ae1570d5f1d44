"""Byte-level BPE by ranks, in Spark's higher-order functions; decoding joins the ids' binary pieces.

A word is a match of the vocabulary's pattern. Its bytes (as characters U+0000 to U+00FF) are folded: each step finds the
least rank among neighbouring pieces and joins its first pair, or in long words all pairs of that rank from left to right, until
no pair has a rank. The
ranks are a literal: an array of small maps, since a lookup in one map walks through all its keys.

Of the distinct words the ``KNOWN_WORDS`` that occur most often are encoded once and become a literal too. This saves work and
decides nothing: any other word is folded where it occurs, with the same ids. So a bound does no harm, and the words are
counted in every ``COUNTED``-th text only, chosen by a hash of the text. No text is shuffled.

Defined cases: a null text is an empty one, has no ids and decodes to no bytes. Every row gives one row, with all its columns
and ``ids``. An empty table gives an empty result. Strings of special tokens are ordinary text. Words of any length are encoded
whole.
"""

from __future__ import annotations

import base64
import json
import zlib
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KNOWN_WORDS = 1 << 17
SHORT = 48  # bytes; the two folds give the same ids and differ in the work of a step
COUNTED = 8
BUCKETS = 1 << 13


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(piece): int(rank) for piece, rank in map(bytes.split, lines)}


def _let(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then`` of a value that is computed once."""
    return F.get(F.transform(F.array(value), then), 0)


def _literal_map(entries: dict[str, object], value_type: str, buckets: int) -> Callable[[Column], Column]:
    """A lookup in a literal array of maps; null if the key is missing."""
    held: list[dict] = [{} for _ in range(buckets)]
    for key, value in entries.items():
        held[zlib.crc32(key.encode()) % buckets][key] = value
    literal = F.from_json(F.lit(json.dumps(held, separators=(",", ":"))), f"array<map<string,{value_type}>>")
    return lambda key: F.try_element_at(F.get(literal, (F.crc32(key.cast("binary")) % buckets).cast("int")), key)


class Bpe:
    """Expressions for one vocabulary."""

    def __init__(self, ranks: dict[bytes, int], pattern: str) -> None:
        self.pattern = "(?U)" + pattern  # white space as Unicode has it
        self.rank = _literal_map({k.decode("latin-1"): v for k, v in ranks.items()}, "int", BUCKETS)
        pieces: list[str | None] = [None] * (max(ranks.values(), default=-1) + 1)
        for piece, rank in ranks.items():
            pieces[rank] = piece.hex()
        self.pieces = F.from_json(F.lit(json.dumps(pieces)), "array<string>")

    def words(self, text: Column) -> Column:
        return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(self.pattern), F.lit(0))

    def _join_first(self, acc: Column) -> Column:
        """Join the first pair of the least rank and look up the two ranks that this changes."""
        pieces, ranks = acc["pieces"], acc["ranks"]

        def joined(p: Column) -> Column:  # counted from 1
            return _let(
                F.concat(F.get(pieces, p - 1), F.get(pieces, p)),
                lambda piece: F.struct(
                    F.concat(F.slice(pieces, F.lit(1), p - 1), F.array(piece), F.slice(pieces, p + 2, F.size(pieces))).alias("pieces"),
                    F.concat(
                        F.slice(ranks, F.lit(1), F.greatest(p - 2, F.lit(0))),
                        F.when(p > 1, F.array(self.rank(F.concat(F.get(pieces, p - 2), piece)))).otherwise(F.array().cast("array<int>")),
                        F.array(self.rank(F.concat(piece, F.get(pieces, p + 1)))),
                        F.slice(ranks, p + 2, F.size(ranks)),
                    ).alias("ranks"),
                    F.lit(False).alias("done"),
                ),
            )

        return _let(
            F.array_min(ranks),
            lambda least: F.when(least.isNull(), F.struct(pieces.alias("pieces"), ranks.alias("ranks"), F.lit(True).alias("done"))).otherwise(
                _let(F.array_position(ranks, least).cast("int"), joined)
            ),
        )

    def _fold_short(self, start: Column) -> Column:
        ranks = F.transform(start, lambda p, i: self.rank(F.concat(p, F.get(start, i + 1))))
        return F.aggregate(
            F.sequence(F.lit(1), F.size(start)),
            F.struct(start.alias("pieces"), ranks.alias("ranks"), F.lit(False).alias("done")),
            lambda acc, _: F.when(acc["done"], acc).otherwise(self._join_first(acc)),
            lambda acc: acc["pieces"],
        )

    def _fold_long(self, start: Column) -> Column:
        return F.aggregate(
            F.sequence(F.lit(1), F.size(start)),
            F.struct(start.alias("pieces"), F.lit(False).alias("done")),
            lambda acc, _: F.when(acc["done"], acc).otherwise(self._join_all(acc["pieces"])),
            lambda acc: acc["pieces"],
        )

    def _join_all(self, pieces: Column) -> Column:
        """Join all pairs of the least rank: fewer steps for long words."""
        pair = lambda p, i: self.rank(F.concat(p, F.get(pieces, i + 1)))

        def joined(ranks: Column, least: Column) -> Column:
            marks = F.array_join(F.transform(ranks, lambda r: F.when(r == least, "1").otherwise("0")), "")
            marks = F.split(F.regexp_replace(marks, "11", "10"), "")  # of overlapping pairs the first is joined
            return _let(
                marks,
                lambda m: F.filter(
                    F.transform(
                        pieces,
                        lambda p, i: F.when(F.get(m, i - 1) == "1", F.lit(None))
                        .when(F.get(m, i) == "1", F.concat(p, F.get(pieces, i + 1)))
                        .otherwise(p),
                    ),
                    lambda p: p.isNotNull(),
                ),
            )

        return _let(
            F.transform(pieces, pair),
            lambda ranks: _let(
                F.array_min(ranks),
                lambda least: F.when(least.isNull(), F.struct(pieces.alias("pieces"), F.lit(True).alias("done"))).otherwise(
                    F.struct(joined(ranks, least).alias("pieces"), F.lit(False).alias("done"))
                ),
            ),
        )

    def encode_word(self, word: Column) -> Column:
        """Ids of one word."""
        start = F.split(F.decode(word.cast("binary"), "ISO-8859-1"), "")
        folded = _let(
            start, lambda s: F.when(F.size(s) <= SHORT, self._fold_short(s)).otherwise(self._fold_long(s))
        )
        return F.transform(folded, self.rank)

    def decode(self, ids: Column) -> Column:
        """Bytes of a list of ids."""
        return F.unhex(F.array_join(F.transform(ids, lambda i: F.get(self.pieces, i)), ""))


def encode(docs: DataFrame, bpe: Bpe, known_words: int = KNOWN_WORDS) -> DataFrame:
    """All columns of the input and ``ids``."""
    counted = docs.where(F.pmod(F.xxhash64("text"), F.lit(COUNTED)) == 0)
    words = counted.select(F.explode(bpe.words(F.col("text"))).alias("word"))
    frequent = words.groupBy("word").count().orderBy(F.desc("count"), "word").limit(known_words)
    rows = frequent.select("word", bpe.encode_word(F.col("word")).alias("ids")).collect()  # known_words rows at most
    known = _literal_map({r["word"]: r["ids"] for r in rows}, "array<int>", max(known_words // 8, 1))
    ids = F.transform(bpe.words(F.col("text")), lambda w: F.coalesce(known(w), bpe.encode_word(w)))
    return docs.withColumn("ids", F.flatten(ids))
