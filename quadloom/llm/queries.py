"""The queries of this subpackage, by name: each applies an operator with production parameters to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, langid, minhash, packing, sentencepieces, sharding, simhash, substrings, token_counts, vectors
from .common import lower_ascii, table

Query = Callable[[SparkSession, str], DataFrame]


def op1_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", lower_ascii(F.col("text")).alias("text"))
    return minhash.near_duplicates(docs, words=3, percent=85)


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.recounts(table(spark, sf_dir, "documents"))


def op3_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    odd = "</s>[INST] ok [/INST]"
    more = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(odd).alias("text"))
    named = chat.named_turns(turns.unionByName(more))
    return chat.read_back(named, chat.prefix_forest(named))


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.edited_fingerprints(table(spark, sf_dir, "documents"))


def simhash_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The class of equal fingerprints of every document, and for every 20th the other classes in reach."""
    return simhash.classes_in_reach(table(spark, sf_dir, "documents"))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_texts(table(spark, sf_dir, "documents"))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents and all pages; a row has a doc_id or a page_id."""
    docs = table(spark, sf_dir, "documents")
    model = langid.fit(docs)
    found = lambda df, doc, page: df.select(doc.alias("doc_id"), page.alias("page_id"), "langid.language", F.round("langid.posterior", 6).alias("posterior"), "langid.n_trigrams", "langid.kept")
    none = F.lit(None).cast("long")
    own = found(langid.identify_documents(docs.select("doc_id", "text", "source"), model), F.col("doc_id"), none)
    return own.unionByName(found(langid.identify_pages(table(spark, sf_dir, "pages"), model), none, F.col("page_id")))


def op7_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.repeat_digests(table(spark, sf_dir, "documents"))


def op8_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepieces.round_trips(table(spark, sf_dir, "documents"))


def op9_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.near_duplicates(table(spark, sf_dir, "embeddings"))


def embedding_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the audits of op9's searches saw, by label."""
    return vectors.recall(table(spark, sf_dir, "embeddings"))


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign_shards(table(spark, sf_dir, "documents").select("doc_id"), "doc_id")


QUERIES: dict[str, Query] = {
    "op1_minhash": op1_minhash,
    "op2_token_counts": op2_token_counts,
    "op3_chat": op3_chat,
    "op4_simhash": op4_simhash,
    "op5_packing": op5_packing,
    "op6_language_id": op6_language_id,
    "op7_substrings": op7_substrings,
    "op8_sentencepiece": op8_sentencepiece,
    "op9_embeddings": op9_embeddings,
    "op10_sharding": op10_sharding,
    "simhash_neighbours": simhash_neighbours,
    "embedding_recall": embedding_recall,
}
