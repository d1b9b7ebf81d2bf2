"""Result tables and trial logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PARAMS = "map<string,string>"


def write_metrics(df: DataFrame, path: str, by: tuple[str, ...] = ("method", "fold")) -> None:
    """Per-user or summary metrics as CSV with a header, one folder per value of `by`."""
    keys = [c for c in by if c in df.columns]
    df.write.mode("overwrite").option("header", True).partitionBy(*keys).csv(path)


def read_metrics(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Metrics CSV with a declared schema."""
    return spark.read.schema(schema).option("header", True).csv(path)


def read_detailed_results(spark: SparkSession, path: str, ks: tuple[int, ...] = (5, 10)) -> DataFrame:
    """`fold, method, user, total_purchases` and metrics from files <method>_keyset<fold>_detailed_results.csv."""
    names = [f"{m}@{k}" for k in ks for m in ("HR", "WHR", "nDCG", "recall", "precision")]
    raw = spark.read.option("header", True).csv(path).withColumn("_path", F.input_file_name())
    return raw.select(
        F.regexp_extract("_path", r"keyset_?(\d+)", 1).cast("bigint").alias("fold"),
        F.regexp_extract("_path", r"([^/]+)_keyset_?\d+[^/]*$", 1).alias("method"),
        F.col("user").cast("string").alias("user"), F.col("`total purchases`").cast("int").alias("total_purchases"),
        *[F.col(f"`{n}`").cast("double").alias(n) for n in names])


def read_best_params(spark: SparkSession, path: str) -> DataFrame:
    """`dataset, best_parameters, best_score, metric, timestamp` from a best-parameter file."""
    entry = f"struct<best_parameters:{PARAMS}, best_score:double, metric:string, timestamp:string>"
    text = spark.read.text(path, wholetext=True)
    return text.select(F.explode(F.from_json("value", f"map<string,{entry}>")).alias("dataset", "e")).select("dataset", "e.*")


def read_trials(spark: SparkSession, path: str) -> DataFrame:
    """`dataset, trial_id, params, metrics, score`, one row per trial of a tuning log."""
    trial = f"struct<combination_id:bigint, parameters:{PARAMS}, metrics:map<string,double>, score:double>"
    doc = f"struct<dataset:string, best_metric:string, best_score:double, all_results:array<{trial}>>"
    text = spark.read.text(path, wholetext=True).select(F.from_json("value", doc).alias("d"))
    return text.select("d.dataset", F.explode("d.all_results").alias("r")).select(
        "dataset", F.col("r.combination_id").alias("trial_id"), F.col("r.parameters").alias("params"),
        F.col("r.metrics").alias("metrics"), F.col("r.score").alias("score"))


def write_trials(trials: DataFrame, path: str) -> None:
    """Trials as JSON lines."""
    trials.write.mode("overwrite").json(path)


def write_trial_log(trials: DataFrame, path: str, best_metric: str) -> None:
    """Tuning logs as `read_trials` takes them, one object per dataset in a folder of its own; a dataset has as many trials as its grid."""
    row = F.struct(F.col("trial_id").alias("combination_id"), F.col("params").alias("parameters"), "metrics", "score")
    logs = trials.groupBy("dataset").agg(F.max("score").alias("best_score"), F.collect_list(row).alias("all_results"))
    doc = F.to_json(F.struct("dataset", F.lit(best_metric).alias("best_metric"), "best_score", "all_results"))
    logs.select(doc.alias("value"), F.col("dataset").alias("log")).write.mode("overwrite").partitionBy("log").text(path)


def read_trial_lines(spark: SparkSession, path: str) -> DataFrame:
    """What `write_trials` wrote from the columns of `read_trials`."""
    return spark.read.schema(f"dataset string, trial_id bigint, params {PARAMS}, metrics map<string,double>, score double").json(path)
