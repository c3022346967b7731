"""Bootstrap intervals over clusters.

hash_bootstrap draws by a hash, so SQL can repeat it and draws spread over the cluster;
the python_* ones repeat Mersenne Twister runs of a seed exactly.
"""

from __future__ import annotations

import random

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def clusters(df: DataFrame, group: list[str], cluster: str, value: Column) -> DataFrame:
    """Per cluster: total, n, and place from 0 in the order of its name."""
    per = df.groupBy(*group, cluster).agg(F.sum(value).alias("total"), F.count(value).alias("n"))
    order = W.partitionBy(*group).orderBy(cluster) if group else W.orderBy(cluster)
    return per.withColumn("place", F.row_number().over(order) - 1)


def hash_bootstrap(per_cluster: DataFrame, draws: int, seed: int, level: float = 0.95) -> DataFrame:
    """One row: estimate (sum of totals over sum of n), low, high, clusters, draws.

    Slot s of draw d takes the cluster at md5(seed:d:s) modulo their number. The clusters are
    aggregates, a row for each, and travel; draws are dealt over tasks.
    """
    spark = per_cluster.sparkSession
    count = per_cluster.agg(F.count("*").alias("__k"), F.sum("total").alias("__t"), F.sum("n").alias("__n"))
    slots = spark.range(draws).withColumnRenamed("id", "draw").crossJoin(F.broadcast(count)).withColumn("slot", F.explode(F.sequence(F.lit(0), (F.col("__k") - 1).cast("int"))))
    pick = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("draw").cast("string"), F.col("slot").cast("string"))), 1, 15), 16, 10).cast("long") % F.col("__k")
    drawn = slots.select("draw", pick.alias("place")).join(per_cluster, "place").groupBy("draw").agg((F.sum("total") / F.sum("n")).alias("__e"))
    tail = (1 - level) / 2
    ends = drawn.agg(F.percentile("__e", F.lit(tail)).alias("low"), F.percentile("__e", F.lit(1 - tail)).alias("high"), F.count("*").alias("draws"))
    return count.crossJoin(ends).select((F.col("__t") / F.col("__n")).alias("estimate"), "low", "high", F.col("__k").alias("clusters"), "draws")


_SCHEMA = "estimate double, low double, high double, clusters int, draws int"


def _interpolated(values: list[float], p: float) -> float:
    values = sorted(values)
    place = (len(values) - 1) * p
    below = int(place)
    above = min(below + 1, len(values) - 1)
    return values[below] + (values[above] - values[below]) * (place - below)


def _per_group(per_cluster: DataFrame, group: list[str], estimate) -> DataFrame:
    fields = ", ".join([*(f"`{g}` {per_cluster.schema[g].dataType.simpleString()}" for g in group), _SCHEMA])

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("place")
        out = estimate(rows)
        return pd.DataFrame([{**{g: rows[g].iloc[0] for g in group}, **out}])

    return (per_cluster.groupBy(*group) if group else per_cluster.groupBy(F.lit("all").alias("__all"))).applyInPandas(run, fields)


def python_equal_clusters(per_cluster: DataFrame, group: list[str], draws: int = 10000, seed: int = 20261025) -> DataFrame:
    """Clusters weigh the same: means of cluster means, interpolated ends. The seed's stream is taken slot by slot."""

    def estimate(rows: pd.DataFrame) -> dict:
        means = (rows["total"] / rows["n"]).tolist()
        stream, k = random.Random(seed), len(means)
        drawn = [sum(means[stream.randrange(k)] for _ in range(k)) / k for _ in range(draws)]
        return {"estimate": sum(means) / k, "low": _interpolated(drawn, 0.025), "high": _interpolated(drawn, 0.975), "clusters": k, "draws": draws}

    return _per_group(per_cluster, group, estimate)


def python_weighted_ratio(per_cluster: DataFrame, group: list[str], draws: int = 2000, seed: int = 20261102, fewest: int = 1) -> DataFrame:
    """Sum of totals over sum of n of drawn clusters; ends are the sorted draws at int(share * draws). Fewer clusters than fewest have no interval."""

    def estimate(rows: pd.DataFrame) -> dict:
        pairs = list(zip(rows["total"], rows["n"], strict=True))
        out = {"estimate": sum(t for t, _ in pairs) / sum(n for _, n in pairs), "clusters": len(pairs)}
        if len(pairs) < fewest:
            return {**out, "low": None, "high": None, "draws": 0}
        stream = random.Random(seed)
        chosen = (stream.choices(pairs, k=len(pairs)) for _ in range(draws))
        drawn = sorted(sum(t for t, _ in some) / sum(n for _, n in some) for some in chosen)
        return {**out, "low": drawn[int(0.025 * draws)], "high": drawn[int(0.975 * draws)], "draws": draws}

    return _per_group(per_cluster, group, estimate)
