"""The corpus pipeline: language ID, near-duplicates, repeated passages, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; run() applies them one after the other to the documents
of sf_dir. All but the last return the columns of documents; the last returns pieces of packed token sequences.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quadloom.llm import langid, minhash, packing, substrings
from quadloom.llm.common import apart, table


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be told. The text model is fitted on a bounded sample of the labelled documents."""
    found = langid.identify_documents(docs, langid.fit(docs))
    return found.where("langid.kept").select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (five-word shingles, similarity of 0.8 or more): that with the smallest id.

    Each row is judged by its own text, also where ids are null or repeated: rows without an id come after all others, and rows
    that share an id (or have none) are told apart by a hash of their texts. Of rows equal in id and text one stays, that whose
    columns have the least hash. Texts without words are like no other text.
    """
    nulls = lambda names: [F.col(f"`{c}`").isNull() for c in names]
    hashed = lambda names: F.xxhash64(*(F.col(f"`{c}`") for c in names), *nulls(names))
    rows = docs.withColumns({"_key": hashed(["doc_id", "text"]), "_row": hashed(docs.columns)})
    groups = minhash.near_duplicates(rows, words=5, percent=80, doc_id="_key").select(F.col("doc_id").alias("_key"), F.col("component_id").alias("_group")).distinct()
    members = rows.select("doc_id", "_key", "_row").distinct().join(groups, "_key")
    # The first of each group is joined apart, so that the rows of a large group are split among tasks.
    first = members.groupBy("_group").agg(F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "_key", "_row")).alias("first"))
    gone = members.join(apart(first, "_group"), "_group").where("_key != first._key OR _row != first._row").select("_key", "_row")
    return rows.join(gone, ["_key", "_row"], "left_anti").dropDuplicates(["_key", "_row"]).select(*docs.columns)


def drop_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the words of 20-word windows that start earlier in the corpus; n_chars follows the text."""
    return substrings.remove_repeats(docs).withColumn("n_chars", F.length("text").cast("long"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 2048 tokens."""
    return packing.pack_texts(docs)


STAGES = [
    ("language ID", identify_language),
    ("MinHash near-dedup", drop_near_duplicates),
    ("substring dedup", drop_repeated_passages),
    ("packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
    return docs


#: Naive Bayes over hashed trigrams and byte-pair encoding are beyond SQL; tests hold each stage against a brute-force version.
ORACLE_SQL = None
