"""The registered queries of the operators: one thin function each."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, brown_lm, html_extract, infill, learned_ann, maxscore, ngram_join, packing, resampling, secret_scan, sharding, sql, toxicity, url_filter


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def word_bpe() -> str:
    """Path of the vocabulary that the queries use; operators take any path."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    number = lambda k: F.size(F.filter("base", lambda s: s.kind == k)).cast("long")
    return found.select(
        "doc_id",
        number(0).alias("n_assign"),
        number(1).alias("n_access"),
        number(2).alias("n_hex"),
        F.sha2(secret_scan.spans_text(F.col("base")), 256).alias("base_sha256"),
        secret_scan.spans_text(F.col("found")).alias("spans"),
    )


def op2_learned_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return learned_ann.nearest(table(spark, sf_dir, "embeddings"), F.col("id") % 20 == 0)


def op3_window_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), word_bpe())


def op4_maxscore(spark: SparkSession, sf_dir: str) -> DataFrame:
    return maxscore.topk(table(spark, sf_dir, "embeddings"), F.col("id") % 50 == 0)


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    offsets = F.array_join(F.transform("spans", lambda s: F.concat_ws(":", s.start.cast("string"), s.end.cast("string"))), ",")
    return toxicity.score(docs, model, spans=True).select(
        "doc_id",
        toxicity.held_out().alias("held_out"),
        "score",
        (F.col("score") >= toxicity.REJECT).cast("int").alias("predicted"),
        offsets.alias("offsets"),
    )


def op6_byte_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sharding.with_sizes(table(spark, sf_dir, "documents"))
    return sharding.balanced_shards(rows, 16).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


def op7_brown_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return brown_lm.score(table(spark, sf_dir, "documents"))


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(table(spark, sf_dir, "documents"), word_bpe())


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return url_filter.filter_urls(pages).select("page_id", "host", "path", "rule", "verdict")


def op10_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.join(table(spark, sf_dir, "documents"))


def op11_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return html_extract.extract(pages, html_extract.fit(pages)).select("page_id", "url", "text", "n_chars")


def op12_ngram_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampling.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return infill.digests(table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_secret_scan": op1_secret_scan,
    "op2_learned_ann": op2_learned_ann,
    "op3_window_packing": op3_window_packing,
    "op4_maxscore": op4_maxscore,
    "op5_toxicity": op5_toxicity,
    "op6_byte_shards": op6_byte_shards,
    "op7_brown_lm": op7_brown_lm,
    "op8_bpe": op8_bpe,
    "op9_url_filter": op9_url_filter,
    "op10_ngram_join": op10_ngram_join,
    "op11_html_extract": op11_html_extract,
    "op12_ngram_resampling": op12_ngram_resampling,
    "op13_fill_in_middle": op13_fill_in_middle,
}
ORACLE_SQL = sql.ORACLE_SQL
