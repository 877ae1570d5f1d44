"""The training-data pipeline: stages over the documents, each on what the one before kept.

Every stage returns the columns of its input, the last one the pieces of packed sequences with their ids. A row is named by its
id and text where a stage joins its verdicts back, so rows without an id go through every stage too.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barwright.llm import exact, language, minhash, packing, secrets
from barwright.llm.queries import vocabulary
from barwright.session import scratch_dir


def _wrapped(docs: DataFrame) -> DataFrame:
    """Rows as one struct, so that no helper column can clash with a column of the documents."""
    return docs.select(F.struct("*").alias("row")).withColumn("id", F.col("row.doc_id").cast("long"))


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the rows that are text in a language which some row names; where none is named, those with a letter.

    Null and empty texts go. Very long texts are judged whole, repeated rows alike, in any order. An empty table stays empty.
    """
    return language.known_rows(docs, language.learn(docs))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of equal texts (A-Z in lower case), that with the largest id.

    Null and empty texts are equal. A row without an id stays only where no equal text has one. Of repeated rows, equal in id and
    text, one stays. Texts are compared whole. An empty table stays empty.
    """
    least = F.lit(-(2**63)).cast("long")  # stands for no id, so that join and repeated rows share one shuffle
    gone = exact.exact_duplicates(docs).where("not kept").select(F.coalesce("doc_id", least).alias("id"), F.col("digest").alias("own"))
    rows = _wrapped(docs).withColumns({"id": F.coalesce("id", least), "own": exact.text_digest(F.col("row.text"))})
    return rows.join(gone, ["id", "own"], "left_anti").dropDuplicates(["id", "own"]).select("row.*")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the row with the smallest id of each group of near copies (five words, 0.8).

    Texts without words are nobody's copies, and rows without an id take no part: all of them stay. Rows that share the kept
    id stay together. Sets are those of whole texts. An empty table stays empty.
    """
    gone = minhash.near_duplicates(docs).where("not kept").select("doc_id")
    rows = _wrapped(docs)
    return rows.join(gone, rows["id"] == gone["doc_id"], "left_anti").select("row.*")


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces secrets by their kinds in brackets, in whole texts; all rows stay, null texts as they are.

    Secrets that overlap are replaced as one, by the kind of the first. ``n_chars`` follows the text. Repeated rows and rows without
    an id are treated alike. An empty table stays empty.
    """
    return secrets.redacted(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs the rows into sequences: pieces with their ids.

    A null or empty text is the end id alone. Every row is packed, repeated ones and those without an id too; a long text is cut
    into pieces. Other columns are left behind. An empty table gives no pieces.
    """
    return packing.pack(docs, vocabulary("word_bpe_49k.json"), with_ids=True)


STAGES = [
    ("language_id", language_id),
    ("exact_dedup", exact_dedup),
    ("near_dedup", near_dedup),
    ("secret_scan", secret_scan),
    ("packing", packed),
]

#: Models, subwords and links are not for SQL; the tests hold the result against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written as Parquet and read again by the next one."""
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        folder = f"{scratch_dir(spark, f'pipeline-{name}')}/t"
        stage(spark, rows, sf_dir).write.parquet(folder)
        rows = spark.read.parquet(folder)
    return rows
