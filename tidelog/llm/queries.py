"""Registered queries of the operators in this package, with SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.llm import centroids, decontaminate, exact_dedup, host_rules, importance, jaccard, langid, license_scan, mixing, oracles
from tidelog.llm import substring, suffix_dedup
from tidelog.llm import toxicity as toxic
from tidelog.llm import url_filter

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(oracle: str | None = None) -> Callable[[Query], Query]:
    def register(function: Query) -> Query:
        QUERIES[function.__name__] = function
        if oracle is not None:
            ORACLES[function.__name__] = oracle
        return function

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def hex_sha256(value: Column | str) -> Column:
    return F.sha2(F.col(value) if isinstance(value, str) else value, 256)


def total(spans: str) -> Column:
    """Length of all ranges [start, end)."""
    return F.aggregate(spans, F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])


def fold(column: str, folds: int, held_out: int) -> Column:
    """Is the row held out? A null id is."""
    return F.coalesce(F.pmod(F.crc32(F.col(column).cast("string")), F.lit(folds)) == held_out, F.lit(True))


@query()
def op1_language_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = langid.train(docs.where(~fold("doc_id", 3, 1)))
    return langid.predict(docs, model).select("doc_id", fold("doc_id", 3, 1).alias("held_out"), "lang_pred", "score", "languages")


@query(oracles.EXACT_DEDUP)
def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.mark_duplicates(table(spark, sf_dir, "documents")).select(
        "doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256")
    )


@query(oracles.JACCARD)
def op3_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.join_components(table(spark, sf_dir, "documents"))


@query(oracles.SUBSTRING)
def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.remove_repeats(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "n_removed", hex_sha256("kept_text").alias("kept_sha256")
    )


@query(oracles.DECONTAMINATE)
def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.find_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        "n_words",
        total("hits").alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        hex_sha256(F.array_join("items", ",")).alias("items_sha256"),
        (F.size("hits") > 0).alias("contaminated"),
    )


@query()
def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = toxic.fit(docs, labels.where(~fold("doc_id", 4, 2)))
    return toxic.score(docs, model).select(
        "doc_id",
        fold("doc_id", 4, 2).alias("held_out"),
        "score",
        F.when(F.col("score") >= 0.3, 1).otherwise(0).alias("predicted"),
    )


URL_RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]


@query(oracles.URL_FILTER)
def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    return url_filter.judge(table(spark, sf_dir, "pages"), rules)


@query(oracles.MIXTURE)
def op8_source_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf_dir, "documents"), preference=mixing.longer_first)
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


@query()
def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = license_scan.scan_licenses(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.explode("matches").alias("match")).select("doc_id", "match.*")


@query(oracles.SUFFIX_DEDUP)
def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeats(table(spark, sf_dir, "documents")).select(
        "doc_id",
        "n_bytes",
        "n_removed",
        F.size("removed").cast("long").alias("n_spans"),
        hex_sha256("kept").alias("kept_sha256"),
    )


@query(oracles.HOST_RULES)
def op11_host_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return host_rules.judge(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


@query(oracles.CENTROIDS)
def op12_centroid_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.cluster(table(spark, sf_dir, "embeddings"))


@query(oracles.IMPORTANCE)
def op13_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    drawn = importance.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return drawn.select("doc_id", "n_features", "weight", "score", "rank")
