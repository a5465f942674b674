"""From raw documents to packed training sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the next
stage's docs. All but the last return the columns of ``documents``, whatever further columns it has.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from fillwise.llm.common import shared_folder


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rule and lie within their (language, source) group's robust distance.

    Null and empty texts have no words and go. Null languages and sources are groups like others. Repeated rows and ids are
    judged each by its text, equal texts of a group alike. An empty table stays empty.
    """
    from fillwise.llm.quality import keep_good
    return keep_good(docs)


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is told by a wide enough margin.

    Null texts, and texts without letters, have no language and go. ``lang`` is read only to learn the dictionaries; where
    it is null a row is judged all the same. Equal margins are rejected, so no tie decides. Repeated rows are each judged.
    """
    from fillwise.llm.langid import keep_identified
    return keep_identified(docs)


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: the one with the smallest doc_id.

    Null and empty texts are near-duplicates of each other. A null doc_id comes after all others; rows that share an id are
    told apart by their texts, and of repeated rows one stays.
    """
    from fillwise.llm.simhash import keep_one
    return keep_one(docs)


def suffix_array_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages of ``suffix_dedup.PASSAGE`` bytes or more that also start elsewhere.

    Each copy of a passage goes, wherever it stands; no copy is preferred, so there are no ties. Null texts stay null and
    empty ones empty. Repeated rows repeat each other and lose what is long enough. No row goes.
    """
    from fillwise.llm.suffix_dedup import cut_repeats
    return cut_repeats(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in sequences of at most 2048 tokens, with their ids.

    Null and empty texts are one token, the end mark. Repeated rows are packed once each, null ids kept. Between equally
    good places the fullest window is taken.
    """
    import public_tokenizers as P

    from fillwise.llm.packing import pack
    return pack(docs, P.path("word_bpe_49k.json"))


STAGES = [("quality_rules", quality_rules), ("language_id", language_id), ("simhash_near_dedup", simhash_near_dedup),
          ("suffix_array_dedup", suffix_array_dedup), ("packing", packing)]

#: Robust estimates, compression sizes and packing can't be said in SQL; tests/llm compares with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows over all of ``documents``; the stages between are written to the shared folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = shared_folder(spark, "pipeline")
    for name, stage in STAGES:
        path = f"{folder}/{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
