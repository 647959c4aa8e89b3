"""One query for each operator, over its whole table, and the pipeline of them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from renewlens.llm import (
    centroids,
    decontamination,
    hidden_markov,
    licences,
    lines,
    min_max_hash,
    mixing,
    periodic_runs,
    personal_data,
    quality,
    sql,
    token_ids,
    toxicity,
    url_filter,
)
from renewlens.llm.common import fold, table, text_of, words_of

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")

Query = Callable[[SparkSession, str], DataFrame]


def _hidden_markov(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hidden_markov.score(table(spark, sf_dir, "documents"), fold("doc_id", 7) == 2)


def _personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal_data.find(table(spark, sf_dir, "documents"))


def _mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def _quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    # Which of several failing rules is named depends on measured costs, so it is left out.
    return quality.judge(table(spark, sf_dir, "documents")).drop("rejected_by")


def _min_max_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return min_max_hash.near_duplicates(table(spark, sf_dir, "documents"), words=4)


def _toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    model = toxicity.fit(documents, table(spark, sf_dir, "labels"), fold("doc_id", 5) != 0)
    scored = toxicity.score(documents, model)
    return scored.select("doc_id", (fold("doc_id", 5) == 0).alias("held_out"), "score", "predicted")


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = lines.dedup_lines(table(spark, sf_dir, "documents"))
    return left.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def _token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_ids.round_trip(table(spark, sf_dir, "documents"), tokenizer=TOKENIZER)


def _decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.find_leaks(
        table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    )


def _licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.scan(table(spark, sf_dir, "documents"))


def _with_periodic_tails(documents: DataFrame) -> DataFrame:
    """Every tenth text, by a hash of its id, has its last part replaced by copies of some words."""
    text = F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")
    tailed = F.col("hash") % 10 == 0
    period = F.expr("1 + (n - a) div (3 + g % 8)")
    taken = F.expr("transform(sequence(0L, n - 1), i -> words[int(if(i < a, i, a + (i - a) % p))])")
    return (
        documents.select("doc_id", "text", F.crc32(text).alias("hash"))
        .withColumn("words", F.when(tailed, words_of(text_of("text"))))
        .withColumns({"g": F.expr("hash div 10"), "n": F.size("words").cast("bigint")})
        .withColumn("a", F.expr("if(n > 0, g % n, 0)"))
        .withColumn("p", period)
        .select(
            "doc_id",
            F.when(tailed & (F.col("n") > 0), F.array_join(taken, " "))
            .otherwise(F.col("text"))
            .alias("text"),
        )
    )


def _periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic_runs.runs_of(_with_periodic_tails(table(spark, sf_dir, "documents")))
    ranked = F.transform(
        "runs",
        lambda run: F.struct(
            run["length"].alias("length"),
            (-run["start"]).alias("back"),
            (-run["period"]).alias("less"),
        ),
    )
    lines = F.transform(
        "runs",
        lambda run: F.concat(F.concat_ws(",", run["start"], run["length"], run["period"]), F.lit("\n")),
    )
    best = F.array_max(ranked)
    digests = found.select(
        "doc_id",
        F.size("runs").cast("bigint").alias("n_runs"),
        best.alias("best"),
        F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
        "n_words",
    )
    return digests.select(
        "doc_id",
        "n_runs",
        (-F.col("best.back")).alias("start"),
        F.col("best.length").alias("length"),
        (-F.col("best.less")).alias("period"),
        F.expr("1000 * best.length div -best.less").alias("exponent_milli"),
        "runs_sha256",
        "collapsed_sha256",
        "n_words",
    )


def _centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = centroids.cluster(table(spark, sf_dir, "embeddings"), number=16, rounds=3)
    sums = centroids.inertia(found.assigned)
    total = sum(sums.values())
    rows = [
        (number, sums.get(number, 0), total, ",".join(map(str, centroid)))
        for number, centroid in enumerate(found.centroids)
    ]
    # One row per centroid.
    facts = spark.createDataFrame(
        rows, "cluster int, cluster_inertia bigint, inertia bigint, components string"
    )
    return found.assigned.join(F.broadcast(facts), "cluster").select(
        "vec_id",
        "cluster",
        "distance",
        "cluster_inertia",
        "inertia",
        F.sha2("components", 256).alias("centroid_sha256"),
    )


# The rules of the query.
URL_RULES = (
    url_filter.Rule("block", "net"),
    url_filter.Rule("allow", "example.net", "/en/"),
    url_filter.Rule("block", "example.com", "/de/"),
    url_filter.Rule("allow", "org", "/fr/"),
)


def _url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = url_filter.fit(url_filter.labelled_urls(spark))
    return url_filter.judge(table(spark, sf_dir, "pages"), URL_RULES, model)


def queries() -> dict[str, Query]:
    return {
        "op1_hidden_markov": _hidden_markov,
        "op2_personal_data": _personal_data,
        "op3_mixing": _mixing,
        "op4_quality_rules": _quality,
        "op5_min_max_hash": _min_max_hash,
        "op6_toxicity": _toxicity,
        "op7_line_dedup": _lines,
        "op8_token_ids": _token_ids,
        "op9_decontamination": _decontamination,
        "op10_licences": _licences,
        "op11_periodic_runs": _periodic_runs,
        "op12_centroids": _centroids,
        "op13_url_filter": _url_filter,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op3_mixing": sql.MIXING,
        "op4_quality_rules": sql.QUALITY,
        "op5_min_max_hash": sql.MIN_MAX_HASH,
        "op7_line_dedup": sql.LINES,
        "op9_decontamination": sql.DECONTAMINATION,
        "op12_centroids": sql.CENTROIDS,
    }
