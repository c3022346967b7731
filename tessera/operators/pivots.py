"""Exact nearest vectors by cosine, with groups around pivots that a query may leave out.

Every vector belongs to the pivot that it is nearest to. The angles between a group's vectors and its
pivot lie between two bounds, so by the triangle inequality for angles no vector of the group is closer
to a query than the query's angle to the pivot less those. A query visits the groups of the highest
bounds first, and then those whose bounds reach its k-th score. Pivots are a bounded sample; which
ones they are changes the work and not the result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.operators.dense import ROWS, Leaders, apart, dealt, keys, matrix, units
from tessera.session import kept

#: Pivots are the square root of the vectors in number, so many at most.
MOST_PIVOTS = 512
#: Queries are answered in sets of about so many; a set's vectors travel to every task.
SET_QUERIES = 2000
#: Groups that a query visits before its k-th score is known.
FIRST = 4
#: Scores that differ by less may swap places when they are rounded.
SLACK = 2e-6


def grouped(docs: DataFrame, id_col: str, vector: str) -> tuple[DataFrame, np.ndarray]:
    """((id, group, near, vector) as a table, sorted by group in each file; the pivots). near is the cosine to the pivot. Vectors that are null are left out."""
    spark = docs.sparkSession
    own = docs.filter(F.col(vector).isNotNull()).select(F.col(id_col).alias("id"), F.col(vector).cast("array<double>").alias("vector"))
    n = own.count()
    few = own.orderBy(F.xxhash64("id"), "id").limit(min(MOST_PIVOTS, int(n**0.5) + 1)).select("vector").collect()  # MOST_PIVOTS vectors
    pivots = spark.sparkContext.broadcast(units(np.array([r["vector"] for r in few], np.float64)) if few else np.zeros((0, 0)))
    kind = own.schema["id"].dataType.simpleString()

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                near = units(matrix(batch.column(1))) @ pivots.value.T
                group = near.argmax(axis=1)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(group, pa.int32()), pa.array(near[np.arange(len(group)), group]), batch.column(1)], ["id", "group", "near", "vector"])

    return kept(dealt(own).mapInArrow(assign, f"id {kind}, group int, near double, vector array<double>").sortWithinPartitions("group"), "grouped"), pivots.value


def bounds(queries: np.ndarray, pivots: np.ndarray, least: np.ndarray, most: np.ndarray) -> np.ndarray:
    """queries x groups: the highest cosine that a vector of the group can have. least and most: of the cosines of the group's vectors with its pivot."""
    angle = np.arccos(np.clip(queries @ pivots.T, -1, 1))
    outer, inner = np.arccos(np.clip(least, -1, 1)), np.arccos(np.clip(most, -1, 1))
    gap = np.maximum(0, np.maximum(angle - outer, inner - angle))
    out = np.cos(gap)
    out[~queries.any(axis=1)] = 1.0  # a query of zeros has no angles
    return out


def nearest(queries: DataFrame, docs: DataFrame, query_id: str, id_col: str, query_vector: str, vector: str, k: int, digits: int = 6, itself: bool = False) -> tuple[DataFrame, dict]:
    """((query id, id, score, rank) of each query's k nearest vectors, how many pairs were computed and how many there are).

    Equal scores, after rounding to digits, are in the order of id. Without itself a query's own id is
    none of its neighbours. Queries are taken in sets of about SET_QUERIES.
    """
    table, pivots = grouped(docs, id_col, vector)
    sizes = {r["group"]: r for r in table.groupBy("group").agg(F.count("*").alias("n"), F.min("near").alias("least"), F.max("near").alias("most"), F.min(F.exists("vector", lambda x: x != 0)).alias("fine")).collect()}  # a row a pivot
    groups = np.array(sorted(sizes), np.int64)
    if not len(groups):
        return queries.sparkSession.createDataFrame([], f"{query_id} {queries.schema[query_id].dataType.simpleString()}, {id_col} {docs.schema[id_col].dataType.simpleString()}, score double, rank int"), {"computed": 0, "all": 0}
    counts, least, most = (np.array([sizes[g][name] for g in groups]) for name in ("n", "least", "most"))
    least = np.where([sizes[g]["fine"] for g in groups], least, -1.0)  # a vector of zeros has no angle either
    asked = queries.filter(F.col(query_vector).isNotNull()).select(F.col(query_id).alias("q"), F.col(query_vector).cast("array<double>").alias("v"))
    n = asked.count()
    sets = n // SET_QUERIES + 1
    out, computed = None, 0
    for number in range(sets):
        rows = asked.filter(F.pmod(F.xxhash64("q"), F.lit(sets)) == number).collect()  # about SET_QUERIES vectors
        if rows:
            found, pairs = _answered(table, pivots, groups, counts, least, most, rows, asked.schema["q"].dataType.simpleString(), k, digits, itself)
            out, computed = found if out is None else out.unionByName(found), computed + pairs
    if out is None:
        out = table.select(F.lit(None).cast(asked.schema["q"].dataType).alias("q"), "id", F.lit(0.0).alias("score"), F.lit(0).alias("rank")).limit(0)
    return out.select(F.col("q").alias(query_id), F.col("id").alias(id_col), "score", "rank"), {"computed": int(computed), "all": int(n * counts.sum())}


def _answered(table: DataFrame, pivots, groups, counts, least, most, rows: list, kind: str, k: int, digits: int, itself: bool) -> tuple[DataFrame, int]:
    spark = table.sparkSession
    names, vectors = [r["q"] for r in rows], units(np.array([r["v"] for r in rows], np.float64))
    bound = bounds(vectors, pivots[groups], least, most)
    order = np.argsort(-bound, axis=1, kind="stable")
    early = np.zeros(bound.shape, bool)
    np.put_along_axis(early, order[:, :FIRST], True, axis=1)
    leading = kept(_best(_visited(table, groups, vectors, names, early, kind, k, digits, itself), k), "leading")
    reached = {r["q"]: r["score"] for r in leading.filter(F.col("rank") == k).select("q", "score").collect()}  # a row a query of the set
    score = np.array([reached.get(name, -2.0) for name in names])
    late = (bound + SLACK >= score[:, None]) & ~early
    found = _visited(table, groups, vectors, names, late, kind, k, digits, itself).unionByName(leading.drop("rank"))
    return _best(found, k), ((early | late) * counts).sum()


def _best(df: DataFrame, k: int) -> DataFrame:
    return df.withColumn("rank", F.row_number().over(W.partitionBy("q").orderBy(F.desc("score"), "id"))).filter(F.col("rank") <= k)


def _visited(table: DataFrame, groups: np.ndarray, vectors: np.ndarray, names: list, visits: np.ndarray, kind: str, k: int, digits: int, itself: bool) -> DataFrame:
    """(q, id, score): of the groups that each query visits, the k best of every task. A task holds k rows a query, however many vectors it passes."""
    spark = table.sparkSession
    own = table.schema["id"].dataType.simpleString()
    place = np.full(int(groups.max()) + 1, -1)
    place[groups] = np.arange(len(groups))
    sent = spark.sparkContext.broadcast((vectors, names, visits, place))
    schema = f"q {kind}, id {own}, score double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries, names, visits, place = sent.value
        labels, leaders = keys(pa.array(names)), Leaders(len(names), k)
        for batch in batches:
            for lo in range(0, batch.num_rows, ROWS):  # rows are in the order of their group, so a block has few of them
                part = batch.slice(lo, ROWS)
                visited = visits[:, place[part.column(1).to_numpy()]]
                asked, rows = np.flatnonzero(visited.any(axis=1)), np.flatnonzero(visited.any(axis=0))
                if not len(asked):
                    continue
                scores = np.round(queries[asked] @ units(matrix(part.column(2)))[rows].T, digits) + 0.0
                scores[~visited[np.ix_(asked, rows)]] = -np.inf
                ids = keys(part.column(0))[rows]
                leaders.offer(scores if itself else apart(scores, labels[asked], ids), ids, asked)
        if leaders.held is not None:
            q, s, i = leaders.held
            yield pa.RecordBatch.from_arrays([pa.array(labels[q]).cast(kinds[0]), pa.array(i).cast(kinds[1]), pa.array(s)], ["q", "id", "score"])

    from pyspark.sql.pandas.types import to_arrow_type
    from pyspark.sql.types import _parse_datatype_string

    kinds = to_arrow_type(_parse_datatype_string(kind)), to_arrow_type(table.schema["id"].dataType)
    wanted = [int(g) for g in groups[visits.any(axis=0)]]
    return table.filter(F.col("group").isin(wanted) if wanted else F.lit(False)).select("id", "group", "vector").mapInArrow(run, schema)
