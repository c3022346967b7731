"""Mixing sources to target weights by weighted fair queueing. DataFrame functions only.

Every copy of a document gets a virtual finish time: the words of its source up to and with it,
in shuffled order, divided by the source's target. All copies are range-sorted by that time
and the mix is what comes before the total budget is used up.

Running sums are taken in two steps, over ranges and then within a range. There are as many
ranges as the rows call for, so neither a source with a third of all rows nor the global order
ever meets in one task, however many rows there are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.llm.shared import cut, n_words

WEIGHTS = (5, 2, 1)
MAX_COPIES = 3
#: All sources' shuffled orders are cut into as many slots as make so many rows each if there were one source; ranges of virtual time hold about so many.
SLOT_ROWS, RANGE_ROWS = 1000, 20_000
RANK_BITS = 60


def shuffled_rank(doc_id: Column, seed: int) -> Column:
    """RANK_BITS random-looking bits that depend on the id and the seed alone."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), doc_id.cast("string"))), 1, 15), 16, 10).cast("long")


def water_level(sources: DataFrame, max_copies: int) -> DataFrame:
    """(key, weight, source_size) -> the same with target: shares of the total by weight, none above max_copies times its source, the excess reshared.

    Targets are least(cap, level * weight); the level follows from the order of cap / weight. One row per source is sorted here, not one per document.
    """
    everything = W.partitionBy().rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    by_ratio = W.orderBy("__ratio", "__key")
    capped = (
        sources.withColumn("__cap", F.col("source_size") * F.lit(float(max_copies)))
        .withColumn("__ratio", F.col("__cap") / F.col("__weight"))
        .withColumn("__total", F.sum("source_size").over(everything).cast("double"))
        .withColumn("__before", F.coalesce(F.sum("__cap").over(by_ratio.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0)))
        .withColumn("__rest", F.sum("__weight").over(by_ratio.rowsBetween(W.currentRow, W.unboundedFollowing)))
        .withColumn("__level", (F.col("__total") - F.col("__before")) / F.col("__rest"))
    )
    level = F.max("__level").over(everything)  # too few capped sources give a lower level, and so do too many
    return capped.withColumn("target", F.coalesce(F.least("__cap", level * F.col("__weight")), F.lit(0.0)))


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_copies: int = MAX_COPIES, seed: int = 17, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """docs without the text, with size, source_size, target and taken.

    Sources in order of their code points, null last, weigh weights, repeating. A null or blank
    text has size 0 and is never taken. Repeated rows count once each; rows without an id are shuffled
    by their text instead. An empty table gives an empty result. Columns of the same names are replaced.
    """
    rows = docs.count()
    bits = max(4, (rows // SLOT_ROWS).bit_length())
    kept = [F.col(c) for c in docs.columns if c not in (text_col, "size", "source_size", "target", "taken")]
    key = F.concat(F.when(F.col(source_col).isNull(), "1").otherwise("0"), F.coalesce(F.col(source_col), F.lit("")))
    sized = docs.select(*kept, n_words(F.col(text_col)).alias("size"), key.alias("__key"), shuffled_rank(F.coalesce(F.col(id_col).cast("string"), F.md5(F.coalesce(F.col(text_col), F.lit("")))), seed).alias("__rank"))
    sized = cut(sized.withColumn("__slot", F.shiftright("__rank", RANK_BITS - bits)), "sized")

    slots = sized.groupBy("__key", "__slot").agg(F.sum("size").alias("__slot_size"))
    turn = (F.row_number().over(W.orderBy("__key")) - 1) % len(weights)
    sources = slots.groupBy("__key").agg(F.sum("__slot_size").alias("source_size")).withColumn("__weight", F.element_at(F.array(*map(F.lit, weights)), (turn + 1).cast("int")).cast("double"))
    targets = water_level(sources, max_copies).select("__key", "source_size", "target", "__total")
    offsets = slots.withColumn("__offset", F.sum("__slot_size").over(W.partitionBy("__key").orderBy("__slot")) - F.col("__slot_size")).join(targets, "__key").drop("__slot_size")

    within = W.partitionBy("__key", "__slot").orderBy("__rank", id_col, "size").rowsBetween(W.unboundedPreceding, W.currentRow)
    queued = sized.withColumn("__run", F.sum("size").over(within)).join(offsets, ["__key", "__slot"])
    finish = ((F.col("__copy") - 1) * F.col("source_size") + F.col("__offset") + F.col("__run")) / F.col("target")
    copies = (
        queued.filter((F.col("size") > 0) & (F.col("target") > 0))
        .select("__key", "__slot", "__run", "__rank", "size", "source_size", "target", "__offset", "__total", id_col, F.explode(F.sequence(F.lit(1), F.lit(max_copies))).alias("__copy"))
        .withColumn("__finish", finish)
    )
    by_time = ["__finish", "__key", "__run", "__copy"]
    ranges = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), max_copies * rows // RANGE_ROWS)
    ranged = cut(copies.repartitionByRange(ranges, *by_time).withColumn("__range", F.spark_partition_id()), "queue")
    times = ranged.groupBy("__range").agg(F.sum("size").alias("__range_size"))
    times = times.select("__range", (F.sum("__range_size").over(W.orderBy("__range")) - F.col("__range_size")).alias("__earlier"))  # a row a range
    order = W.partitionBy("__range").orderBy(*by_time).rowsBetween(W.unboundedPreceding, W.currentRow)
    total = F.col("__total")
    taken = (
        ranged.join(times, "__range")
        .filter(F.col("__earlier") < total)
        .withColumn("__so_far", F.col("__earlier") + F.sum("size").over(order))
        .filter(F.col("__so_far") <= total)
        .groupBy("__key", "__slot", "__run", "__rank")
        .agg(F.sum("size").alias("taken"))
    )
    names = [c for c in docs.columns if c not in (text_col, "size", "source_size", "target", "taken")]
    return queued.join(taken, ["__key", "__slot", "__run", "__rank"], "left").select(*names, "size", "source_size", "target", F.when(F.col("size") > 0, F.coalesce("taken", F.lit(0))).otherwise(0).cast("long").alias("taken"))


def op3_weighted_fair_mix(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return mix(docs).select("doc_id", "size", "source_size", "target", "taken")


SQL = r"""
WITH sized AS (
  SELECT doc_id, concat(CASE WHEN source IS NULL THEN '1' ELSE '0' END, coalesce(source, '')) AS k,
         coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         ('0x' || substr(md5('17:' || doc_id::VARCHAR), 1, 15))::BIGINT AS h
  FROM documents),
src AS (
  SELECT k, sum(size)::BIGINT AS source_size,
         list_extract([5.0, 2.0, 1.0]::DOUBLE[], ((row_number() OVER (ORDER BY k) - 1) % 3 + 1)::BIGINT) AS w
  FROM sized GROUP BY k),
lev AS (
  SELECT *, source_size::DOUBLE * 3.0::DOUBLE AS cap, source_size::DOUBLE * 3.0::DOUBLE / w AS ratio,
         (sum(source_size) OVER ())::DOUBLE AS total FROM src),
lev2 AS (
  SELECT *, (total - coalesce(sum(cap) OVER (ORDER BY ratio, k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0))
         / sum(w) OVER (ORDER BY ratio, k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS lv FROM lev),
tgt AS (
  SELECT k, source_size, total, least(cap, (SELECT max(lv) FROM lev2) * w) AS target FROM lev2),
run AS (
  SELECT s.*, t.source_size, t.target, t.total,
         sum(size) OVER (PARTITION BY s.k ORDER BY h, doc_id, size ROWS UNBOUNDED PRECEDING) AS c
  FROM sized s JOIN tgt t ON s.k = t.k),
copies AS (
  SELECT doc_id, k, size, total, c, e, ((e - 1) * source_size + c)::DOUBLE / target AS fin
  FROM run, (SELECT unnest([1, 2, 3]) AS e) WHERE size > 0 AND target > 0),
ordered AS (
  SELECT doc_id, size, total,
         sum(size) OVER (ORDER BY fin, k, c, e ROWS UNBOUNDED PRECEDING) AS so_far FROM copies),
taken AS (SELECT doc_id, sum(size)::BIGINT AS taken FROM ordered WHERE so_far <= total GROUP BY doc_id)
SELECT run.doc_id, run.size, run.source_size, run.target, coalesce(taken.taken, 0)::BIGINT AS taken
FROM run LEFT JOIN taken ON run.doc_id = taken.doc_id
"""
