"""Exact cosine search of many queries over many vectors, block by block; what a query keeps is settled where the vectors are.

The number of products is queries times vectors, as an exact search takes. They are numpy's, a block
at a time, and only a query's best rows, or those above its limit, leave a task.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Queries are answered in sets of about so many; a set's vectors travel to every task.
SET_QUERIES = 2000
#: Rows of a block of products.
ROWS = 1024
#: Scores that differ by less may change places when they are rounded.
SLACK = 2e-6


def units(vectors: np.ndarray) -> np.ndarray:
    """Rows of length 1; a row of zeros stays so and has cosine 0 with everything."""
    norm = np.linalg.norm(vectors, axis=1, keepdims=True)
    return np.divide(vectors, norm, out=np.zeros_like(vectors), where=norm > 0)


def matrix(column: pa.Array) -> np.ndarray:
    """A column of equally long arrays as rows of doubles."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)


def directions(column: pa.Array) -> np.ndarray:
    """matrix() with rows of length 1; a row of zeros, or none, is an error."""
    rows = matrix(column)
    if column.null_count or not rows.any(axis=1).all():
        raise ValueError("a vector of zeros has no direction")
    return units(rows)


def keys(column: pa.Array) -> np.ndarray:
    """Ids as numpy values that compare as Spark's do."""
    out = column.to_numpy(zero_copy_only=False)
    return out.astype(str) if out.dtype == object else out


class Leaders:
    """The k best of what is offered to each of n queries, equal scores in the order of id."""

    def __init__(self, n: int, k: int) -> None:
        self.n, self.k = n, k
        self.least = np.full(n, -np.inf)  # the k-th score, once there are k
        self.held: tuple | None = None
        self.last: np.ndarray | None = None  # and its id

    def offer(self, scores: np.ndarray, ids: np.ndarray, asked: np.ndarray | None = None) -> None:
        """scores: asked queries (all, by default) x ids; -inf where a row isn't one of the query's."""
        asked = np.arange(self.n) if asked is None else asked
        least = self.least[asked]
        if scores.shape[1] > self.k and np.count_nonzero(scores >= least[:, None]) > 4 * self.k * len(asked):
            least = np.maximum(least, np.partition(scores, -self.k, axis=1)[:, -self.k])
        hit = (scores >= least[:, None]) & (scores > -np.inf)
        if self.last is not None:
            hit &= (scores > self.least[asked][:, None]) | (ids[None, :] < self.last[asked][:, None]) | ~np.isfinite(self.least[asked])[:, None]
        q, at = np.nonzero(hit)
        if not len(q):
            return
        new = asked[q], scores[q, at], ids[at]
        q, s, i = new if self.held is None else (np.concatenate(pair) for pair in zip(self.held, new, strict=True))
        order = np.lexsort((i, -s, q))
        q, s, i = q[order], s[order], i[order]
        starts = np.searchsorted(q, np.arange(self.n))
        place = np.arange(len(q)) - starts[q]
        first = place < self.k
        kth = np.flatnonzero(place == self.k - 1)
        self.last = np.zeros(self.n, i.dtype) if self.last is None else self.last.astype(np.result_type(self.last, i))
        self.least[q[kth]], self.last[q[kth]] = s[kth], i[kth]
        self.held = q[first], s[first], i[first]


def _sets(queries: DataFrame, query_id: str, extra: list[str]) -> Iterator[list]:
    asked = queries.select(query_id, *extra)
    sets = asked.count() // SET_QUERIES + 1
    for number in range(sets):
        rows = asked.filter(F.pmod(F.xxhash64(query_id), F.lit(sets)) == number).collect()  # about SET_QUERIES of them
        if rows:
            yield rows


def _codes(values: list) -> tuple[dict, np.ndarray]:
    """Distinct values that aren't null by number, and each value's number; -1 for null."""
    code = {v: n for n, v in enumerate(dict.fromkeys(v for v in values if v is not None))}
    return code, np.array([code.get(v, -1) for v in values], np.int64)


def dealt(df: DataFrame) -> DataFrame:
    """df by its id over as many partitions as there are cores, whatever files it comes in."""
    return df.repartition(max(1, df.sparkSession.sparkContext.defaultParallelism), "id")


def _spread(docs: DataFrame, id_col: str, vector: str, side: str | None) -> DataFrame:
    """(id, vector, side), dealt()."""
    own = docs.select(F.col(id_col).alias("id"), F.col(vector).cast("array<double>").alias("vector"), F.col(side) if side else F.lit(None).cast("int").alias("side"))
    return dealt(own.toDF("id", "vector", "side"))


def _scored(docs: DataFrame, rows: list, query_id: str, query_vector: str, query_side: str | None, digits: int, run: Callable, schema: str) -> DataFrame:
    """docs through run(query ids, sides of queries, blocks), a block being (scores, ids, sides of rows)."""
    names = [r[query_id] for r in rows]
    code, sides = _codes([r[query_side] for r in rows] if query_side else [None] * len(rows))
    vectors = directions(pa.array([r[query_vector] for r in rows], pa.list_(pa.float64())))
    sent = docs.sparkSession.sparkContext.broadcast((vectors, names, code, sides))

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        queries, _, code, _ = sent.value
        for batch in batches:
            for lo in range(0, batch.num_rows, ROWS):
                part = batch.slice(lo, ROWS)
                own = part.column(2).to_pylist()
                # a value that no query has keeps a number of its own: it is neither null nor any query's
                scores = np.round(queries @ directions(part.column(1)).T, digits) + 0.0  # no negative zeros
                yield scores, part.column(0), own, np.array([-1 if v is None else code.get(v, len(code)) for v in own], np.int64)

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, names, _, sides = sent.value
        yield from run(names, sides, blocks(batches))

    return docs.mapInArrow(answer, schema)


def apart(scores: np.ndarray, names: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """scores with -inf where a query meets itself."""
    order = np.argsort(names, kind="stable")
    at = np.searchsorted(names, ids, sorter=order)
    for j in np.flatnonzero(at < len(names)):
        n = at[j]
        while n < len(names) and names[order[n]] == ids[j]:
            scores[order[n], j] = -np.inf
            n += 1
    return scores


ALL, SAME, OTHER = 0, 1, 2


def nearest(queries: DataFrame, docs: DataFrame, query_id: str, id_col: str, query_vector: str, vector: str, k: int, digits: int = 6, query_side: str | None = None, side: str | None = None, part: str | None = None) -> DataFrame:
    """(query id, id, score, side or part, rank): each query's k nearest vectors but its own, equal scores after rounding in the order of id.

    With query_side and side the k nearest of those that agree (SAME), and of those that don't (OTHER); a
    null agrees with nothing and differs from nothing. With part the k nearest of each value of that column.
    """
    kind, asked = docs.schema[id_col].dataType.simpleString(), queries.schema[query_id].dataType.simpleString()
    name = part or "side"
    of_part = docs.schema[part].dataType.simpleString() if part else "int"
    schema = f"q {asked}, id {kind}, score double, side {of_part}"
    arrow = _arrow(schema, docs)
    own = _spread(docs, id_col, vector, part or side)

    def run(names: list, sides: np.ndarray, blocks: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
        held: dict = {}
        labels = keys(pa.array(names))
        for scores, column, values, codes in blocks:
            ids = keys(column)
            scores = apart(scores, labels, ids)
            if part:
                for value in dict.fromkeys(values):
                    at = np.array([v == value for v in values])
                    held.setdefault(value, Leaders(len(names), k)).offer(scores[:, at], ids[at])
            elif side:
                agree = sides[:, None] == codes[None, :]
                known = (sides >= 0)[:, None] & (codes >= 0)[None, :]
                held.setdefault(SAME, Leaders(len(names), k)).offer(np.where(agree & known, scores, -np.inf), ids)
                held.setdefault(OTHER, Leaders(len(names), k)).offer(np.where(~agree & known, scores, -np.inf), ids)
            else:
                held.setdefault(ALL, Leaders(len(names), k)).offer(scores, ids)
        for value, leaders in held.items():
            if leaders.held is not None:
                q, s, i = leaders.held
                yield pa.RecordBatch.from_arrays([pa.array(labels[q]).cast(arrow[0].type), pa.array(i).cast(arrow[1].type), pa.array(s), pa.array([value] * len(q), arrow[3].type)], schema=arrow)

    found = [_scored(own, rows, query_id, query_vector, query_side, digits, run, schema) for rows in _sets(queries, query_id, [query_vector, *([query_side] if query_side else [])])]
    if not found:
        found = [docs.sparkSession.createDataFrame([], schema)]
    order = W.partitionBy("q", "side").orderBy(F.desc("score"), "id")
    best = reduce(DataFrame.unionByName, found).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return best.select(F.col("q").alias(query_id), F.col("id").alias(id_col), "score", F.col("side").alias(name), "rank")


def within(queries: DataFrame, docs: DataFrame, query_id: str, id_col: str, query_vector: str, vector: str, least: Column, same_least: Column | None = None, digits: int = 6, query_side: str | None = None, side: str | None = None) -> DataFrame:
    """(query id, id, score): each query's vectors but its own that score least, or same_least if their sides agree. A null limit admits nothing."""
    kind, asked = docs.schema[id_col].dataType.simpleString(), queries.schema[query_id].dataType.simpleString()
    schema = f"q {asked}, id {kind}, score double"
    arrow = _arrow(schema, docs)
    own = _spread(docs, id_col, vector, side)
    limited = queries.withColumns({"__least": least.cast("double"), "__same": (F.lit(None) if same_least is None else same_least).cast("double")})

    def found_of(rows: list) -> DataFrame:
        bounds = [np.array([np.inf if r[c] is None else r[c] for r in rows]) for c in ("__least", "__same")]

        def run(names: list, sides: np.ndarray, blocks: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
            labels = keys(pa.array(names))
            for scores, column, _, codes in blocks:
                ids = keys(column)
                scores = apart(scores, labels, ids)
                hit = scores >= bounds[0][:, None]
                if side:
                    hit |= (scores >= bounds[1][:, None]) & (sides[:, None] == codes[None, :]) & (codes >= 0)[None, :]
                q, at = np.nonzero(hit)
                for lo in range(0, len(q), 10_000):
                    a, b = q[lo : lo + 10_000], at[lo : lo + 10_000]
                    yield pa.RecordBatch.from_arrays([pa.array(labels[a]).cast(arrow[0].type), pa.array(ids[b]).cast(arrow[1].type), pa.array(scores[a, b])], schema=arrow)

        return _scored(own, rows, query_id, query_vector, query_side, digits, run, schema)

    found = [found_of(rows) for rows in _sets(limited, query_id, [query_vector, "__least", "__same", *([query_side] if query_side else [])])]
    if not found:
        found = [docs.sparkSession.createDataFrame([], schema)]
    return reduce(DataFrame.unionByName, found).select(F.col("q").alias(query_id), F.col("id").alias(id_col), "score")


def _arrow(schema: str, docs: DataFrame) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(docs.sparkSession.createDataFrame([], schema).schema)
