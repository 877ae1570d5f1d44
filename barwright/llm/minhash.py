"""Near-duplicate documents by MinHash with tensored banding, every link confirmed on the full shingle sets.

Two collections of ``GROUPS`` sub-keys are made per document, each sub-key from ``ROWS`` minhashes. A table's key is a pair: sub-key i of
the first collection and sub-key j of the second. So ``GROUPS**2`` tables of ``2 * ROWS`` minhashes each cost ``2 * GROUPS * ROWS`` minhashes
and not ``2 * GROUPS**2 * ROWS``. Two documents of similarity s share a table with probability
``(1 - (1 - s**ROWS)**GROUPS)**2``: 0.9987 at 0.8, 0.99999 at 0.9, 0.02 at 0.25.

Documents with equal sets are one class first, so copies never meet pairwise. Sub-keys that only one class has are dropped
before pairs of sub-keys are formed. In a table's bucket every class is compared with the smallest one. Where a bucket's
members are then still in several components, they are compared across components by a join on their rarest shingles: in
rounds one member of each component first, until a round links nothing, then all that are still apart, each pair once. This leaves out
no similar pair; links inside a component can't change the result.

Defined cases: a null or wordless text has no shingles, is in no link and a component of its own. Fewer words than a shingle are
one shingle. Rows with the same doc_id are one document, linked with whatever one of its texts is linked with; ``n_shingles`` is
that of its largest set. Rows without doc_id are left out, since a component is named by ids. An empty table
gives an empty result. Shingles are compared by 64-bit hashes of their words.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from operator import add

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barwright.llm.components import components
from barwright.llm.flat import Flat, flat, mix, parts, released, signed
from barwright.llm.store import stored

SHINGLE = 5
PERCENT = 80
ROWS = 3
GROUPS = 10
MARKS = 512
HEAD = 32

_RANDOM = np.random.default_rng(7919)
_ODD = _RANDOM.integers(0, 2**63, 4096, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_sets(texts: Flat, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of all texts, sorted within each, and the bounds of the texts."""
    words = texts.words(lower=True)
    n_words = np.diff(words.bounds)
    starts = words.gram_starts(k)
    short = np.flatnonzero((n_words > 0) & (n_words < k))
    starts = np.concatenate([starts, words.bounds[short]])
    ends = np.concatenate([starts[: len(starts) - len(short)] + k, words.bounds[short + 1]])
    text_of = np.searchsorted(words.bounds, starts, "right") - 1
    hashes = words.sequence_hashes(starts, ends)
    order = np.argsort(text_of, kind="stable")
    hashes, sizes = hashes[order], np.bincount(text_of, minlength=len(texts))
    bounds = np.append(0, np.cumsum(sizes))
    for a, b in zip(bounds[:-1], bounds[1:], strict=True):
        hashes[a:b].sort()
    if len(hashes):
        own = np.repeat(np.arange(len(texts)), sizes)
        new = np.append(True, (hashes[1:] != hashes[:-1]) | (own[1:] != own[:-1]))
        hashes = hashes[new]
        bounds = np.append(0, np.cumsum(np.bincount(own[new], minlength=len(texts))))
    return hashes, bounds


def minhashes(hashes: np.ndarray, bounds: np.ndarray, n: int) -> np.ndarray:
    """[texts with shingles, n] minhashes."""
    full = np.flatnonzero(np.diff(bounds))
    out = np.empty((len(full), n), np.uint64)
    for f in range(n):
        values = hashes * _ODD[2 * f]
        values ^= values >> np.uint64(32)
        values *= _ODD[2 * f + 1]
        out[:, f] = np.minimum.reduceat(values, bounds[full])
    return out


def _sketches(docs: DataFrame, shingle: int, rows: int, groups: int) -> DataFrame:
    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in parts(whole):
                hashes, bounds = shingle_sets(flat(batch.column("text")), shingle)
                sizes = np.diff(bounds)
                full = np.flatnonzero(sizes)
                digests = np.zeros((2, batch.num_rows), np.uint64)
                subkeys = np.zeros((batch.num_rows, 2 * groups), np.uint64)
                if len(full):
                    digests[0, full] = np.add.reduceat(mix(hashes), bounds[full])
                    digests[1, full] = np.add.reduceat(mix(hashes ^ np.uint64(0x5851F42D4C957F2D)), bounds[full])
                    least = minhashes(hashes, bounds, 2 * groups * rows).reshape(len(full), 2 * groups, rows)
                    folded = np.zeros((len(full), 2 * groups), np.uint64)
                    for r in range(rows):
                        folded = mix(folded * np.uint64(31) + least[:, :, r])
                    subkeys[full] = folded
                lists = pa.ListArray.from_arrays(
                    pa.array(np.arange(batch.num_rows + 1, dtype=np.int32) * 2 * groups), pa.array(signed(subkeys.ravel()))
                )
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(signed(digests[0])), pa.array(signed(digests[1])), lists],
                    names=["doc_id", "n_shingles", "d1", "d2", "subkeys"],
                )

    return docs.mapInArrow(released(sketch), "doc_id long, n_shingles long, d1 long, d2 long, subkeys array<long>")


def _confirmed(pairs: DataFrame, docs: DataFrame, shingle: int, percent: int) -> DataFrame:
    """The pairs (a, b) of classes whose representatives' full sets are similar enough."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in parts(whole, "text_b"):
                left, left_bounds = shingle_sets(flat(batch.column("text_a")), shingle)
                right, right_bounds = shingle_sets(flat(batch.column("text_b")), shingle)
                linked = np.zeros(batch.num_rows, bool)
                for i in range(batch.num_rows):
                    x, y = left[left_bounds[i] : left_bounds[i + 1]], right[right_bounds[i] : right_bounds[i + 1]]
                    both = len(np.intersect1d(x, y, assume_unique=True))
                    linked[i] = 100 * both >= percent * (len(x) + len(y) - both)
                yield batch.select(["a", "b"]).filter(pa.array(linked))

    texts = docs.select(F.col("doc_id").alias("text_id"), "text")
    left = pairs.join(texts, pairs["a"] == texts["text_id"]).select("a", "b", F.col("text").alias("text_a"))
    both = left.join(texts, left["b"] == texts["text_id"]).select("a", "b", "text_a", F.col("text").alias("text_b"))
    return both.mapInArrow(released(compare), "a long, b long")


def _prefixes(classes: DataFrame, docs: DataFrame, shingle: int, percent: int) -> DataFrame:
    """``class_id, n_shingles, marks, place, token``: the rarest shingles of ``classes(class_id, n_shingles)`` that similar sets must share.

    Of the shingles of a set, rarest first, similar sets share one of the first ``n - ceil(percent * n / 100) + 1``: what one of two
    similar sets lacks is less than that. ``place`` counts them from 1. A set's marks are ``MARKS`` bits, each the parity of the
    shingles that hash to it, so that bits which differ are no more than the shingles which differ.
    """
    spark = classes.sparkSession
    words = MARKS // 64

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in parts(whole):
                hashes, bounds = shingle_sets(flat(batch.column("text")), shingle)
                n = batch.num_rows
                place = np.repeat(np.arange(n) * MARKS, np.diff(bounds)) + (mix(hashes) % np.uint64(MARKS)).astype(np.int64)
                parity = np.bincount(place, minlength=n * MARKS) & 1
                marks = np.packbits(parity.astype(np.uint8)).view(np.int64)
                lists = [
                    pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(signed(hashes))),
                    pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * words), pa.array(marks)),
                ]
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(c) for c in ("class_id", "n_shingles")), *lists], names=["class_id", "n_shingles", "tokens", "marks"]
                )

    texts = classes.join(docs.withColumnRenamed("doc_id", "text_id"), F.col("class_id") == F.col("text_id")).drop("text_id")
    sets = texts.mapInArrow(released(gather), "class_id long, n_shingles long, tokens array<long>, marks array<long>")
    sets = stored(spark, "near-sets", sets)
    tokens = sets.select("class_id", "n_shingles", F.explode("tokens").alias("token"))
    counts = stored(spark, "near-token-counts", tokens.groupBy("token").agg(F.count("*").alias("n")))
    first = F.col("n_shingles") - F.ceil(F.col("n_shingles") * percent / 100) + 1
    prefixes = (
        tokens.join(counts, "token")
        .groupBy("class_id", "n_shingles")
        .agg(F.sort_array(F.collect_list(F.struct("n", "token"))).alias("all"))  # one text's shingles
        .select("class_id", F.slice("all", F.lit(1), first.cast("int")).alias("x"))
        .join(sets.drop("tokens"), "class_id")
        .select("class_id", "n_shingles", "marks", F.posexplode("x.token").alias("place", "token"))
        .withColumn("place", F.col("place") + 1)
    )
    return stored(spark, "near-prefixes", prefixes)


def _met(prefixes: DataFrame, joined: DataFrame) -> DataFrame:
    """The rows of ``prefixes`` whose token several components have, with ``component`` and the token's largest one, ``home``."""
    spark = prefixes.sparkSession
    rows = prefixes.join(joined.withColumnRenamed("node", "class_id"), "class_id", "left")
    rows = stored(spark, "near-with-components", rows.withColumn("component", F.coalesce("component", "class_id")))
    sizes = rows.groupBy("token", "component").agg(F.count("*").alias("n"))
    homes = sizes.groupBy("token").agg(F.max(F.struct("n", "component")).alias("home"), F.count("*").alias("n")).where("n > 1")
    homes = stored(spark, "near-homes", homes.select("token", F.col("home.component").alias("home")))
    return stored(spark, "near-met", rows.join(homes, "token"))


def _similar(a: str, b: str, percent: int) -> Column:
    """Whether two rows of ``_met`` at their token, given as structs, may be of similar sets.

    Leaves out no similar pair at its first common token: there the sets share that token and at most what comes after it in either.
    """
    differ = reduce(add, (F.bit_count(F.col(f"{a}.marks")[i].bitwiseXOR(F.col(f"{b}.marks")[i])) for i in range(MARKS // 64)))
    return F.expr(
        f"100 * least({a}.n_shingles, {b}.n_shingles) >= {percent} * greatest({a}.n_shingles, {b}.n_shingles)"
        f" and {100 + percent} * (1 + least({a}.n_shingles - {a}.place, {b}.n_shingles - {b}.place)) >= {percent} * ({a}.n_shingles + {b}.n_shingles)"
    ) & ((100 + percent) * differ <= (100 - percent) * F.expr(f"{a}.n_shingles + {b}.n_shingles"))


_ONE = ("class_id", "n_shingles", "place", "marks")


def _by_component(met: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b): at every token, one member of each component and one of the largest. No more rows than ``met`` has."""
    ones = met.groupBy("token", "home", "component").agg(F.min(F.struct(*_ONE)).alias("x"))
    of_home = F.max(F.when(F.col("component") == F.col("home"), F.col("x"))).alias("y")
    homes = stored(met.sparkSession, "near-home-members", ones.groupBy("token").agg(of_home))
    return (
        ones.where("component <> home")
        .join(homes, "token")
        .where(_similar("x", "y", percent))
        .select(F.least("x.class_id", "y.class_id").alias("a"), F.greatest("x.class_id", "y.class_id").alias("b"))
    )


def _across(met: DataFrame, percent: int) -> DataFrame:
    """All pairs (a, b) in different components that may be similar enough.

    For every token the members of its largest component only meet others. A pair is taken at its first common token: each row
    holds the first ``HEAD`` tokens of its set; only a pair without a common one among these may come several times.
    """
    tokens = F.sort_array(F.collect_list(F.struct("place", "token")))  # one text's shingles
    heads = met.groupBy("class_id").agg(F.slice(tokens, 1, HEAD).alias("head")).select("class_id", F.col("head.token").alias("head"))
    met = met.join(stored(met.sparkSession, "near-heads", heads), "class_id")
    met = stored(met.sparkSession, "near-met", met.select("token", "component", "home", "head", F.struct(*_ONE).alias("x")))
    guests = met.where("component <> home").select(
        F.col("token").alias("own"), F.col("component").alias("guest"), F.col("head").alias("own_head"), F.col("x").alias("y")
    )
    first = F.get(F.array_intersect("own_head", "head"), 0)
    once = F.expr("guest <> component and (component = home or y.class_id < x.class_id)")
    pairs = guests.join(
        met, (F.col("own") == F.col("token")) & once & _similar("x", "y", percent) & (first.isNull() | (first == F.col("token")))
    )
    return pairs.select(F.least("x.class_id", "y.class_id").alias("a"), F.greatest("x.class_id", "y.class_id").alias("b"))


def near_duplicates(
    docs: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT, rows: int = ROWS, groups: int = GROUPS
) -> DataFrame:
    """``doc_id, n_shingles, class_id, component_id, kept`` per document. Equal sets have equal ``class_id``."""
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where(
        "doc_id is not null"
    )
    sketches = stored(spark, "near-sketches", _sketches(docs, shingle, rows, groups))
    filled = sketches.where("n_shingles > 0")
    digest = ["n_shingles", "d1", "d2"]
    classes = stored(
        spark, "near-classes", filled.groupBy(*digest).agg(F.min("doc_id").alias("class_id"), F.min("subkeys").alias("subkeys"))
    )
    members = filled.select("doc_id", *digest).join(classes.drop("subkeys"), digest).select("doc_id", "n_shingles", "class_id")

    slots = classes.select("class_id", "n_shingles", F.posexplode("subkeys").alias("slot", "subkey"))
    # What is counted by a key is written before it is joined by that key: only then can the join's hot keys be split.
    shared = slots.groupBy("slot", "subkey").count().where("count > 1").select("slot", "subkey")
    shared = stored(spark, "near-shared", shared)
    usable = slots.join(shared, ["slot", "subkey"], "left_semi")
    usable = stored(spark, "near-subkeys", usable)
    per_class = usable.groupBy("class_id", "n_shingles").agg(F.collect_list(F.struct("slot", "subkey")).alias("all"))
    first = F.explode(F.filter("all", lambda x: x["slot"] < groups))
    second = F.explode(F.filter("all", lambda x: x["slot"] >= groups))
    tables = (
        per_class.withColumn("x", first)
        .withColumn("y", second)
        .select("class_id", "n_shingles", F.xxhash64("x.slot", "x.subkey", "y.slot", "y.subkey").alias("key"))
    )
    tables = stored(spark, "near-tables", tables)
    leaders = tables.groupBy("key").agg(F.min(F.struct("class_id", "n_shingles")).alias("leader"), F.count("*").alias("n")).where("n > 1")
    leaders = stored(spark, "near-leaders", leaders.drop("n"))
    near_size = "100 * least(n_shingles, leader.n_shingles) >= {p} * greatest(n_shingles, leader.n_shingles)".format(p=percent)
    pairs = (
        tables.join(leaders, "key")
        .where("class_id <> leader.class_id")
        .where(near_size)
        .select(F.col("leader.class_id").alias("a"), F.col("class_id").alias("b"))
        .distinct()
    )
    # different texts of one id: every class of the id is linked to its least
    several = members.groupBy("doc_id").agg(F.min("class_id").alias("a"), F.max("class_id").alias("b")).where("a <> b")
    several = stored(spark, "near-repeated-ids", several.select("doc_id", "a"))
    several = members.join(several, "doc_id").where("class_id <> a").select("a", F.col("class_id").alias("b")).distinct()
    links = _confirmed(pairs, docs, shingle, percent).unionByName(several)
    links = stored(spark, "near-links", links)
    joined = components(links)

    placed = tables.join(joined.withColumnRenamed("node", "class_id"), "class_id", "left").select(
        "key", "class_id", "n_shingles", F.coalesce("component", "class_id").alias("component")
    )
    placed = stored(spark, "near-placed", placed)
    mixed = placed.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.count("*").alias("n"))
    mixed = mixed.where("low <> high and n > 2")
    mixed = stored(spark, "near-mixed", mixed.select("key"))  # of two members one is the leader, which met the other
    left_over = placed.join(mixed, "key", "left_semi").select("class_id", "n_shingles").distinct()
    left_over = stored(spark, "near-left", left_over)
    if not left_over.isEmpty():
        # few texts are left, and every round looks at them: the others are not shuffled again
        left_docs = docs.join(left_over.select(F.col("class_id").alias("doc_id")), "doc_id", "left_semi")
        left_docs = stored(spark, "near-left-texts", left_docs)
        prefixes = _prefixes(left_over, left_docs, shingle, percent)
        met, tried = _met(prefixes, joined), spark.createDataFrame([], "a long, b long")
        candidates = _by_component
        while True:
            found = stored(spark, "near-across", candidates(met, percent).distinct().join(tried, ["a", "b"], "left_anti"))
            more = stored(spark, "near-links", _confirmed(found, left_docs, shingle, percent))
            if not more.isEmpty():
                links = links.unionByName(more)
                joined = components(links)
            if candidates is _across:
                break
            tried = tried.unionByName(found)
            if more.isEmpty():
                candidates = _across  # no more of the cheap links: whatever is still apart
            else:
                met = _met(prefixes, joined)
    joined = joined.withColumnRenamed("node", "class_id")
    placed_docs = members.join(joined, "class_id", "left").withColumn("component_id", F.coalesce("component", "class_id"))
    alone = sketches.where("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("class_id"), F.col("doc_id").alias("component_id"))
    return (
        placed_docs.select("doc_id", "n_shingles", "class_id", "component_id")
        .unionByName(alone)
        .groupBy("doc_id")
        .agg(F.max("n_shingles").alias("n_shingles"), F.min("class_id").alias("class_id"), F.min("component_id").alias("component_id"))
        .withColumn("kept", F.col("doc_id") == F.col("component_id"))
    )
