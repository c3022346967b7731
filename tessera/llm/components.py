"""Connected components of a link table, by alternating large and small stars. Links never leave the cluster."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.shared import cut, release


def connected(links: DataFrame, most_rounds: int = 50) -> DataFrame:
    """links (a, b) of ids -> (id, component): the smallest id that each linked id can reach.

    A large star hooks each node's larger neighbours to its smallest one, a small star its smaller
    ones; both keep components whole, and after a logarithmic number of rounds every node hangs
    on its component's smallest id. The sums of both ends tell whether a round changed anything.
    """
    edges = links.filter("a <> b").select(F.greatest("a", "b").alias("v"), F.least("a", "b").alias("u")).distinct()
    before, last = None, None
    for _ in range(most_rounds):
        both = edges.select(F.col("v").alias("x"), F.col("u").alias("y")).unionByName(edges.select(F.col("u").alias("x"), F.col("v").alias("y")))
        low = both.groupBy("x").agg(F.least(F.min("y"), F.col("x")).alias("m"))
        large = both.join(low, "x").filter("y > x").select(F.col("y").alias("v"), F.col("m").alias("u")).filter("v <> u").distinct()
        low = large.groupBy(F.col("v").alias("x")).agg(F.min("u").alias("m"))
        hooked = large.join(low, large.v == low.x)
        small = hooked.filter("u <> m").select(F.col("u").alias("v"), F.col("m").alias("u")).unionByName(low.select(F.col("x").alias("v"), F.col("m").alias("u")))
        edges = cut(small.filter("v <> u").distinct(), "stars")
        if last is not None:
            release(last)
        last = edges
        state = edges.agg(F.count("*"), F.sum(F.col("u").cast("decimal(38,0)")), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before:
            break
        before = state
    else:
        raise RuntimeError(f"components didn't settle in {most_rounds} rounds")
    return edges.select(F.col("v").alias("id"), F.col("u").alias("component")).unionByName(edges.select(F.col("u").alias("id"), F.col("u").alias("component"))).groupBy("id").agg(F.min("component").alias("component"))
