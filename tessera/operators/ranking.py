"""Dense scores, rank fusion, gates on scores, and top-k. Every order is total."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.functions.vectors import dot, unit

RRF_K, LEXICAL_WEIGHT, DENSE_WEIGHT = 60, 0.35, 0.65
LEAST_SCORE, LEAST_MARGIN, NEAR_TIE, SUPPORTED_TIE, SUPPLEMENT_MARGIN = 0.60, 0.04, 0.93, 0.91, 0.05


def cosine(queries: DataFrame, docs: DataFrame, query_id: str, id_col: str, query_vector: str, vector: str) -> DataFrame:
    """(query id, id, score) of all pairs, exactly. The queries travel; their number times the documents' is the work that an exact search takes."""
    q = queries.select(query_id, unit(F.col(query_vector)).alias("__q"))
    d = docs.select(id_col, unit(F.col(vector)).alias("__d"))
    return d.crossJoin(F.broadcast(q)).select(query_id, id_col, dot(F.col("__q"), F.col("__d")).alias("score"))


def top_k(df: DataFrame, group: list[str], order: list[Column], k: int, rank: str = "rank") -> DataFrame:
    """The first k of each group with their rank from 1. Spark cuts each task's groups to k before it shuffles them."""
    return df.withColumn(rank, F.row_number().over(W.partitionBy(*group).orderBy(*order))).filter(F.col(rank) <= max(0, k))


def fused(df: DataFrame, group: list[str], lexical: str, dense: str, tie: str, k: int = RRF_K, lexical_weight: float = LEXICAL_WEIGHT, dense_weight: float = DENSE_WEIGHT) -> DataFrame:
    """df with lexical_rank, dense_rank and fused: weighted reciprocal ranks.

    Both ranks cover all candidates, ties in the order of tie; a candidate without lexical score keeps
    its rank but gets nothing for it, one without a dense score nothing for that.
    """
    lexical_order = W.partitionBy(*group).orderBy(F.coalesce(lexical, F.lit(0.0)).desc(), tie)
    dense_order = W.partitionBy(*group).orderBy(F.coalesce(dense, F.lit(0.0)).desc(), tie)
    ranked = df.withColumn("lexical_rank", F.row_number().over(lexical_order)).withColumn("dense_rank", F.row_number().over(dense_order))
    first = F.when(F.coalesce(lexical, F.lit(0.0)) > 0, lexical_weight / (k + F.col("lexical_rank"))).otherwise(0.0)
    second = F.when(F.col(dense).isNotNull(), dense_weight / (k + F.col("dense_rank"))).otherwise(0.0)
    return ranked.withColumn("fused", first + second)


def fused_top(df: DataFrame, lexical: str, dense: str, tie: str, k: int, rrf_k: int = RRF_K, lexical_weight: float = LEXICAL_WEIGHT, dense_weight: float = DENSE_WEIGHT) -> DataFrame:
    """The first k rows of fused() for one query, without sorting all candidates.

    Only rows near the top of either list can come first: what is below place r in both gets
    (lexical_weight + dense_weight) / (rrf_k + r + 1) at most. So the first r of each list are
    candidates, their ranks are counted over all rows, and if the k-th best doesn't beat that
    bound, r grows. df is read several times; a table is best.
    """
    weight = lexical_weight + dense_weight
    r = max(k, int(weight * (rrf_k + k) / max(lexical_weight, dense_weight)) - rrf_k + 1)
    low, high = F.coalesce(lexical, F.lit(0.0)), F.coalesce(dense, F.lit(0.0))
    n = df.count()
    while True:
        first = df.filter(F.col(lexical) > 0).orderBy(F.desc(lexical), tie).limit(r)
        second = df.filter(F.col(dense).isNotNull()).orderBy(F.desc(dense), tie).limit(r)
        found = first.withColumn("__list", F.lit(0)).unionByName(second.withColumn("__list", F.lit(1))).collect()
        whole = all(sum(x["__list"] == k for x in found) < r for k in (0, 1))  # both lists are here
        candidates = df.sparkSession.createDataFrame(list({x[tie]: x[:-1] for x in found}.values()), df.schema)
        own = candidates.select(F.col(tie).alias("__id"), low.alias("__l"), high.alias("__d"))
        ahead = df.select(F.col(tie).alias("__other"), low.alias("__x"), high.alias("__y")).crossJoin(F.broadcast(own))
        before = lambda x, y: ((F.col(x) > F.col(y)) | ((F.col(x) == F.col(y)) & (F.col("__other") < F.col("__id")))).cast("int")
        ranks = ahead.groupBy("__id").agg((F.sum(before("__x", "__l")) + 1).cast("int").alias("lexical_rank"), (F.sum(before("__y", "__d")) + 1).cast("int").alias("dense_rank"))
        first_part = F.when(low > 0, lexical_weight / (rrf_k + F.col("lexical_rank"))).otherwise(0.0)
        second_part = F.when(F.col(dense).isNotNull(), dense_weight / (rrf_k + F.col("dense_rank"))).otherwise(0.0)
        best = candidates.join(ranks, candidates[tie] == ranks["__id"]).drop("__id").withColumn("fused", first_part + second_part).orderBy(F.desc("fused"), tie).limit(k)
        rows = best.collect()
        if r >= n or whole or len(rows) == k and rows[-1]["fused"] > weight / (rrf_k + r + 1):
            return df.sparkSession.createDataFrame(rows, best.schema)
        r *= 4


def confident(df: DataFrame, group: list[str], score: str, tie: str, least: float = LEAST_SCORE, margin: float = LEAST_MARGIN) -> DataFrame:
    """The best row of each group, if it scores least and leads the second by margin; with the lead (null if alone)."""
    order = W.partitionBy(*group).orderBy(F.col(score).desc(), tie)
    ranked = df.withColumn("lead", F.col(score) - F.lead(score).over(order)).withColumn("__rank", F.row_number().over(order))
    return ranked.filter((F.col("__rank") == 1) & (F.col(score) >= least) & (F.col("lead").isNull() | (F.col("lead") >= margin))).drop("__rank")


def near_tie(df: DataFrame, group: list[str], score: str, share: float = NEAR_TIE, supported: Column | None = None, supported_share: float = SUPPORTED_TIE) -> DataFrame:
    """Rows within share of their group's best score, and within supported_share of it where words or concepts support them too."""
    best = F.max(score).over(W.partitionBy(*group))
    near = F.col(score) >= share * F.col("__best")
    if supported is not None:
        near = near | (F.coalesce(supported, F.lit(False)) & (F.col(score) >= supported_share * F.col("__best")))
    return df.withColumn("__best", best).filter(near).drop("__best")


def supplement(primary: DataFrame, secondary: DataFrame, group: list[str], score: str, margin: float = SUPPLEMENT_MARGIN) -> DataFrame:
    """Rows of secondary in groups whose best secondary beats every primary by margin, or that have no primary."""
    best = secondary.groupBy(*group).agg(F.max(score).alias("__second"))
    held = primary.groupBy(*group).agg(F.max(score).alias("__first"))
    passing = best.join(held, group, "left").filter(F.col("__first").isNull() | (F.col("__second") - F.col("__first") >= margin)).select(*group)
    return secondary.join(passing, group, "left_semi")


def rank_metrics(ranked: DataFrame, group: list[str], relevant: Column, rank: str, cutoffs: tuple[int, ...] = (1, 3)) -> DataFrame:
    """One row a group: the first rank of a relevant row (null if none), its reciprocal (0 if none), and a hit for each cutoff."""
    first = ranked.groupBy(*group).agg(F.min(F.when(relevant, F.col(rank))).alias("first_rank"))
    hits = [F.coalesce(F.col("first_rank") <= k, F.lit(False)).cast("int").alias(f"hit_{k}") for k in cutoffs]
    return first.select("*", F.coalesce(1.0 / F.col("first_rank"), F.lit(0.0)).alias("reciprocal_rank"), *hits)


def budget_rank(pool: DataFrame, group: list[str], score: str, tie: str, budget: int, tier: Column | None = None) -> DataFrame:
    """The first budget rows by relevance, or by tier before relevance."""
    order = [F.col(score).desc(), F.col(tie).asc()]
    return top_k(pool, group, [tier.asc_nulls_last(), *order] if tier is not None else order, budget)
