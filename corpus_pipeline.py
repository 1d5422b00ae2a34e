"""A corpus from raw documents to packed training sequences.

Each stage works on all that the one before kept: low quality goes, lines that many documents share go, one document of each
group of near duplicates stays, strings that start earlier already go, and what is left is packed. Rows that repeat in full are near
duplicates of each other; documents without a word are none. Texts that lose everything stay as empty documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skywake.llm import lines, neardup, packing, quality, suffixes
from skywake.llm.common import crc_mod, table, written

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: What a text does not change.
ALONG = ("lang", "source")


def _documents(rows: DataFrame) -> DataFrame:
    """`rows` as documents, with the length of the text as it is now."""
    return rows.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject."""
    docs = docs.select(*COLUMNS)
    model = quality.learn(docs, table(spark, sf_dir, "labels"), crc_mod(F.col("doc_id"), 5) != 0)
    return quality.score(docs, model).where("predicted = 1").select(*COLUMNS)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that five or more share, but for the last."""
    return _documents(lines.LineIndex.built(docs).clean(docs, keep=ALONG))


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, that with the smallest id."""
    stay = neardup.near_duplicates(docs).where("kept").select(F.col("doc_id").alias("of"), "tag").distinct()
    rows = docs.select(*COLUMNS)
    same = rows["doc_id"].eqNullSafe(stay["of"]) & (F.xxhash64(rows["text"]) == stay["tag"])
    return rows.join(stay, same, "left_semi").dropDuplicates(["doc_id", "text"])


def drop_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the strings of 100 bytes that start earlier; a character that is cut goes whole."""
    return _documents(suffixes.without_repeats(docs, keep=ALONG))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' tokens in sequences."""
    packed = packing.pack(docs)
    return packed.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "n_loss")


STAGES = [
    ("quality classifier", keep_quality),
    ("line dedup", drop_lines),
    ("MinHash near-dedup", one_of_each),
    ("suffix-array dedup", drop_repeats),
    ("packing", pack),
]

#: SQL can express none of the first, third, fourth and fifth stage.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packed pieces of all documents that stay."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-").lower())
    return STAGES[-1][1](spark, docs, sf_dir)
