"""A corpus pipeline of five stages over documents: quality, repeated lines, near copies, benchmark leaks, tokens.

Each stage works on all that the one before it kept, is written as Parquet and read again. All columns of documents pass
through, whatever their names; only n_chars is told anew where lines have gone.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowloom.llm import bpe, decontaminate, line_dedup, quality, simhash
from flowloom.llm.support import scratch_path, ship


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier selects, each row by itself: repeated rows and equal texts fare alike. A null or empty text is graded as such; without labels all stay."""
    ship(spark)
    return quality.select_good(docs, _table(spark, sf_dir, "labels")).select(*docs.columns)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that a document with a smaller doc_id holds; one of which nothing is left goes.

    Rows of one doc_id are one document, null ids are one that comes last; a null or blank text loses nothing and stays.
    """
    ship(spark)
    kept = line_dedup.dedup_lines(docs)
    blank = F.trim(F.translate("text", "\t\n\r", "   ")) == ""
    return kept.where(~(blank & (F.col("n_dropped") > 0))).withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (five-word shingles, similarity 0.8 or more), the document with the smallest doc_id.

    Groups of SimHash fingerprints come first and are verified; an exact search adds the pairs that fingerprints do not bring together.
    One row stays of repeated rows; null and empty texts are copies of each other; a null id comes last. Long texts are compared whole.
    """
    ship(spark)
    return simhash.first_of_similar(docs).select(*docs.columns)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item, edits included. Null texts hold none, null items are in none; without items all stay."""
    ship(spark)
    return decontaminate.without_leaks(docs, _table(spark, sf_dir, "benchmark"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with their token ids and the digest of what these decode to. A null or empty text has no ids; every row stays."""
    ship(spark)
    coded = bpe.encode_documents(docs.select("doc_id", "text", "lang", "source"))
    return coded.select("doc_id", "lang", "source", "ids", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("quality classifier", keep_good),
    ("line dedup", drop_repeated_lines),
    ("simhash near-dedup", drop_near_copies),
    ("benchmark decontamination", drop_leaks),
    ("bpe tokens", tokens),
]

#: Learned weights and the tokenizer are beyond SQL; the tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    docs = _table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        out = stage(spark, docs, sf_dir)
        path = scratch_path(spark, name.replace(" ", "_"))
        out.write.parquet(path)
        docs = spark.read.schema(out.schema).parquet(path)
    return docs
