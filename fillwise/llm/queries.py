"""Registered queries of the corpus operators: name -> (spark, sf_dir) -> DataFrame, and the SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def register(fn):
    QUERIES[fn.__name__] = fn
    return fn


ORACLE["op3_embedding_near_dedup"] = """
WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND list_cosine_similarity(a.e, b.e) >= 0.9),
r(a, c) AS (SELECT vec_id, vec_id FROM v UNION SELECT l.a, r.c FROM l JOIN r ON l.b = r.a),
c AS (SELECT a AS vec_id, min(c) AS component_id FROM r GROUP BY a)
SELECT c.vec_id, (SELECT count(*) FROM l WHERE l.a = c.vec_id) AS n_links, c.component_id, c.vec_id = c.component_id AS kept FROM c"""

#: Base32 of a SHA-1: 32 letters of five bits each, cut from the 40 hexadecimal digits.
ORACLE["op6_warc"] = """
WITH p AS (SELECT page_id, coalesce(html, '') AS payload FROM pages),
m AS (SELECT *, max(page_id) OVER (PARTITION BY payload) AS first, sha1(payload) AS h FROM p)
SELECT page_id, CAST(strlen(payload) AS BIGINT) AS payload_bytes,
       array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(
         1 + ((CAST('0x' || rpad(substr(h, CAST(5 * i // 4 + 1 AS INT), 2), 2, '0') AS INT) >> CAST(3 - 5 * i % 4 AS INT)) & 31) AS INT), 1)), '') AS payload_digest,
       CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> first THEN first END AS refers_to
FROM m"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@register
def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from fillwise.llm.quality import quality
    return quality(table(spark, sf_dir, "documents"))


@register
def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from fillwise.llm.langid import identify
    return identify(table(spark, sf_dir, "documents"))


@register
def op5_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from fillwise.llm.simhash import near_duplicates
    return near_duplicates(table(spark, sf_dir, "documents"))


@register
def op9_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers as P
    from pyspark.sql import functions as F

    from fillwise.llm.bpe import decode, encode
    path = P.path("byte_bpe_multi_50k.tiktoken")
    out = decode(encode(table(spark, sf_dir, "documents"), path, P.PATTERN), path, P.PATTERN)
    return out.select("doc_id", F.size("ids").cast("long").alias("n_tokens"),
                      F.sha2(F.array_join("ids", ","), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


@register
def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers as P
    from pyspark.sql import functions as F

    from fillwise.llm.packing import pack
    out = pack(table(spark, sf_dir, "documents"), P.path("word_bpe_49k.json"))
    return out.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


@register
def op4_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from fillwise.llm.suffix_dedup import PASSAGE, dedup
    out = dedup(table(spark, sf_dir, "documents"), passage=PASSAGE)

    def covered(spans: str):
        return F.aggregate(spans, F.lit(0).cast("long"), lambda n, x: n + x["e"] - x["s"])

    return out.select("doc_id", "n_bytes", covered("removed").alias("n_removed"), F.size("removed").cast("long").alias("n_spans"),
                      F.sha2("kept", 256).alias("kept_sha256"), covered("passages").alias("n_passage_bytes"))


@register
def op3_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from fillwise.llm.embed_dedup import near_duplicates
    return near_duplicates(table(spark, sf_dir, "embeddings"))


@register
def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from fillwise.llm.common import shared_folder
    from fillwise.llm.warc import read, write
    folder = shared_folder(spark, "warc")
    return read(write(table(spark, sf_dir, "pages"), folder), folder).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@register
def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers as P

    from fillwise.llm.bpe import encode
    from fillwise.llm.common import shared_folder
    from fillwise.llm.token_scan import files, named, scan, write
    folder = shared_folder(spark, "tokens")
    encoded = encode(table(spark, sf_dir, "documents"), P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN, chunk=None)
    order = write(encoded, folder, end_id=50_256)
    return named(scan(files(spark, folder, names=order.select("file").distinct()), folder, end_id=50_256), order).select("doc_id", "n_tokens", "start", "terminated")


@register
def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from fillwise.llm.license_scan import scan
    return scan(table(spark, sf_dir, "documents"))


@register
def op12_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    from fillwise.llm.resampling import resample
    out = resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_features", "weight", "score", "rank")


@register
def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from fillwise.llm.periodic_runs import periodic_runs, planted
    out = periodic_runs(planted(table(spark, sf_dir, "documents")))
    longest = F.array_min(F.transform("runs", lambda r: F.struct((-r["length"]).alias("minus"), r["start"].alias("start"), r["period"].alias("period"))))
    line = F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"]))
    return out.withColumn("longest", longest).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), F.col("longest.start"), (-F.col("longest.minus")).alias("length"), F.col("longest.period"),
        F.expr("(-1000 * longest.minus) div longest.period").alias("exponent_milli"),
        F.sha2(F.concat(F.array_join(line, "\n"), F.when(F.size("runs") > 0, "\n").otherwise("")), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"))


@register
def op13_streaming_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers as P
    from pyspark.sql import functions as F

    from fillwise.llm.streaming_bpe import decode, encode
    path = P.path("word_bpe_49k.json")
    out = decode(encode(table(spark, sf_dir, "documents"), path), path)
    return out.select("doc_id", F.floor(F.octet_length("ids") / 4).alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"),
                      F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))
