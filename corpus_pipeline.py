"""A corpus pipeline over the table documents; part of the training-data subpackage.

Each stage takes (spark, docs, sf_dir), works on all that the stage before it kept, and
returns the columns of documents; the last one returns the documents' piece ids.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tangentia.llm.decontaminate import benchmark_leaks
from tangentia.llm.jaccard_join import jaccard_components
from tangentia.llm.queries import model_path, table
from tangentia.llm.runtime import rested, saved, without
from tangentia.llm.sentencepiece_codec import encode_pieces
from tangentia.llm.substring_dedup import dedup_substrings
from tangentia.llm.toxicity import fit_toxicity, with_toxicity

TOXIC = 0.3


def packed(docs: DataFrame) -> DataFrame:
    """(rest, doc_id, text, row_key): rest has all columns but the text, so that no name of theirs can clash.

    By row_key rows are found and removed, whatever their id; rows alike in id and text have the same.
    """
    key = F.xxhash64(F.col("doc_id").isNull(), "doc_id", F.col("text").isNull(), "text")
    return docs.select(F.struct(*[c for c in docs.columns if c != "text"]).alias("rest"), "doc_id", "text", key.alias("row_key"))


def unpacked(rows: DataFrame, docs: DataFrame, **changed: Column) -> DataFrame:
    """The columns of docs, from rows of packed(docs), some of them changed."""
    of = lambda c: changed.get(c, F.col("text") if c == "text" else F.col("rest")[c])
    return rows.select(*[of(c).alias(c) for c in docs.columns])


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score TOXIC or more go.

    Null and empty texts have no evidence and stay; repeated rows and rows with null ids are
    scored like others, but null ids teach nothing. An empty table stays empty.
    """
    rested(spark)
    scorer = fit_toxicity(docs, table(spark, sf_dir, "labels"))
    return unpacked(with_toxicity(packed(docs).select("rest", "text"), scorer).filter(F.col("score") < TOXIC), docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents that links of five-word shingles with a Jaccard of 0.8 or more connect, the one with the smallest id stays.

    Null ids come after all others. Of rows of one id the one with the least hash of its text comes first, and of rows
    that are alike in id and text one stays. Documents without words are in no group: they stay, repeated
    rows of them once.
    """
    rested(spark)
    rows = packed(docs)
    place = F.struct(F.col("doc_id").isNull().alias("last"), F.col("doc_id").alias("id"), F.col("row_key").alias("key"))
    found = saved(jaccard_components(rows.select(place.alias("place"), "text"), k=5, num=80, den=100, id_col="place"))
    gone = found.filter(F.col("component_id") != F.col("place")).select(F.col("place.key").alias("row_key"))
    again = saved(found.groupBy("place").agg(F.count("*").alias("n")).filter("n > 1").select(F.col("place.key").alias("row_key")))
    kept = without(rows, gone, "row_key")
    if again.isEmpty():
        return unpacked(kept, docs)
    once = kept.join(again, "row_key", "left_semi").dropDuplicates(["row_key"])
    return unpacked(without(kept, again, "row_key").unionAll(once.select(kept.columns)), docs)


def substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words of passages that a document with a smaller id has are taken out; documents that lose all words go.

    A document that loses words has the others joined by one space; the others' texts stay.
    Null ids, null texts and repeated rows are as dedup_substrings says: rows with a null id stay whole.
    """
    rested(spark)
    out = dedup_substrings(packed(docs).drop("row_key"))
    cut = F.col("n_removed") > 0
    text = F.when(cut, F.col("kept_text")).otherwise(F.col("text"))
    n_chars = F.when(cut, F.length("kept_text").cast("long")).otherwise(F.col("rest")["n_chars"])
    return unpacked(out.filter(~cut | (F.col("n_removed") < F.col("n_words"))), docs, text=text, n_chars=n_chars)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a passage of the benchmark go, those with null ids too; others with the id of such a document stay.

    Null and empty texts hold no passage. An empty benchmark takes nothing.
    """
    rested(spark)
    rows = packed(docs)
    kept = without(rows, benchmark_leaks(rows, table(spark, sf_dir, "benchmark"), id_col="row_key"), "row_key")
    return unpacked(kept, docs)


def pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, piece_ids, n_pieces, round_trip of each document; null and empty texts have no pieces, and rows stay as they are."""
    rested(spark)
    out = encode_pieces(docs.select("doc_id", "text"), model_path(), verify=True)
    return out.select("doc_id", "piece_ids", F.size("piece_ids").cast("long").alias("n_pieces"), "round_trip")


STAGES = [
    ("toxicity", toxicity),
    ("near_duplicates", near_duplicates),
    ("substring_dedup", substrings),
    ("decontaminate", decontaminate),
    ("sentencepiece", pieces),
]

#: SQL can't express the fitted models and the search; tests/llm hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what a stage keeps is written to the shared checkpoint folder and read again by the next."""
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = saved(docs)
    return docs
