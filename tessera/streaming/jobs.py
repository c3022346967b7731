"""Resumable job logs over Structured Streaming: each job's result is kept once, however often a batch is tried.

The reference point is an append-only log with an idempotent key; nothing here adds windows or watermarks to it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tessera.operators.lineage import pending
from tessera.operators.selection import keep_first
from tessera.sources.files import exists


def log_results(stream: DataFrame, path: str, checkpoint: str, key: list[str], order: str):
    """Start a query that appends results to a Parquet log under path: the first by order of each key, keys that are logged already left out.

    Each micro-batch is written under its number and replaces what a failed attempt of it left.
    """

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        fresh = keep_first(batch, key, [F.col(order)])
        if exists(spark, path):
            logged = spark.read.option("basePath", path).parquet(path).filter(F.col("batch") != number)
            fresh = pending(fresh, logged, key)
        fresh.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def read_log(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    if not exists(spark, path):
        return spark.createDataFrame([], schema)
    return spark.read.option("basePath", path).parquet(path).drop("batch")


def run_status(jobs: DataFrame, results: DataFrame, key: list[str], status: str) -> DataFrame:
    """One row: jobs, completed, errors, pending and the run's status: running while jobs are pending, else completed or completed_with_errors."""
    done = jobs.select(*key).distinct().join(results.select(*key, status), key, "left")
    counts = done.agg(
        F.count("*").alias("jobs"),
        F.coalesce(F.sum((F.col(status) == "completed").cast("long")), F.lit(0)).alias("completed"),
        F.coalesce(F.sum((F.col(status) == "error").cast("long")), F.lit(0)).alias("errors"),
        F.coalesce(F.sum(F.col(status).isNull().cast("long")), F.lit(0)).alias("pending"),
    )
    return counts.withColumn("status", F.when(F.col("pending") > 0, "running").when(F.col("errors") > 0, "completed_with_errors").otherwise("completed"))
