"""Ranked lexical search for a table of items over a clustered index, with exact stopping.

Recursive graph bisection orders documents so that those which share terms stand together: the
documents are halved again and again, swapping those across that lower the cost of coding each side's
term lists. It is fitted on a sample; every node's term gains then route every document down the tree. A
leaf's documents, in blocks of about BLOCK, are the shards, and each block holds its terms' postings
with the largest contribution of each. A block's bound for an item is the sum of those.

An item visits the blocks of the highest bounds, takes its K best documents so far from them, and then
those whose bounds can still reach the K-th score; the others can't hold a document that counts. All
documents are counted and indexed. What is indexed of them are the terms that items ask for.

Terms are compared by 64-bit hashes. All scores are 64-bit integers.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from tessera.llm.shared import cut, map_arrow, release
from tessera.llm.vector import Chunk, chunks

K = 20
#: The bisection is fitted on about so many documents and on so many of their most frequent terms, down to leaves of so many.
SAMPLE, FEATURES, LEAST_LEAF, SWAPS = 4096, 2048, 32, 20
#: Documents a block; and how many blocks an item visits in the first rounds, before it visits all that are left.
BLOCK, ROUNDS = 2048, (4, 32)
#: Items are answered in sets of about so many terms; these travel to every task.
SET_TERMS = 400_000
#: Sums below this are exact in doubles.
EXACT = 1 << 53

_BYTES = np.arange(256)
#: ASCII digits and letters, and every byte of other characters.
IN_TERM = (_BYTES >= 0x80) | ((_BYTES >= 0x30) & (_BYTES <= 0x39)) | ((_BYTES | 0x20 >= 0x61) & (_BYTES | 0x20 <= 0x7A) & (_BYTES >= 0x41))


@dataclass
class Terms:
    """Of n documents: how many terms each has, and its distinct terms with their counts, document by document."""

    n_terms: np.ndarray
    document: np.ndarray
    term: np.ndarray
    count: np.ndarray


def terms_of(c: Chunk, wanted: np.ndarray | None = None) -> Terms:
    """Terms are hashes, or, with wanted, their places there; other terms are counted in n_terms only."""
    low = c.lowered
    starts, ends = low.runs(IN_TERM[low.data])
    place = np.searchsorted(starts, c.offsets)
    document, term = np.repeat(np.arange(c.n), np.diff(place)), low.hashes(starts, ends)
    if wanted is not None:
        at = np.searchsorted(wanted, term)
        held = np.flatnonzero(wanted[np.minimum(at, len(wanted) - 1)] == term) if len(wanted) else np.zeros(0, np.int64)
        document, term = document[held], at[held]
        key, count = np.unique(document * max(1, len(wanted)) + term, return_counts=True)
        return Terms(np.diff(place), key // max(1, len(wanted)), key % max(1, len(wanted)), count)
    order = np.lexsort((term, document))
    document, term = document[order], term[order]
    first = np.flatnonzero(np.append(True, (document[1:] != document[:-1]) | (term[1:] != term[:-1]))) if len(term) else np.zeros(0, np.int64)
    return Terms(np.diff(place), document[first], term[first], np.diff(np.append(first, len(term))))


@dataclass
class Tree:
    """Nodes in heap order. gains: nodes x features, of standing on the left; a document goes right where its sum is under least. feature: term -> its column, or -1."""

    gains: np.ndarray
    least: np.ndarray
    feature: np.ndarray

    def route(self, n: int, document: np.ndarray, term: np.ndarray) -> np.ndarray:
        """The leaf of each of n documents, from 0."""
        node = np.zeros(n, np.int64)
        column = self.feature[term] if len(term) else np.zeros(0, np.int64)
        document, column = document[column >= 0], column[column >= 0]
        for _ in range(int(math.log2(len(self.least) + 1))):
            total = np.bincount(document, self.gains[node[document], column], n)
            node = 2 * node + 1 + (total < self.least[node])
        return node - len(self.least)


def _cost(degree: np.ndarray, size: int) -> np.ndarray:
    return degree * np.log2(size / (degree + 1))


def bisect(x: np.ndarray) -> np.ndarray:
    """Gains per feature of standing in the left half, after swaps between the halves of the documents x (documents x features, 0 or 1)."""
    n, half = len(x), len(x) // 2
    left = np.arange(n) < half
    for turn in range(SWAPS + 1):
        a, b = x[left].sum(axis=0), x[~left].sum(axis=0)
        both = _cost(a, half) + _cost(b, n - half)
        to_right = np.where(a > 0, both - _cost(np.maximum(a - 1, 0), half) - _cost(b + 1, n - half), 0)
        to_left = np.where(b > 0, both - _cost(a + 1, half) - _cost(np.maximum(b - 1, 0), n - half), 0)
        if turn == SWAPS:
            break
        ones, others = np.flatnonzero(left), np.flatnonzero(~left)
        ones, others = (i[np.argsort(-(x[i] @ g), kind="stable")] for i, g in ((ones, to_right), (others, to_left)))
        pairs = min(len(ones), len(others))
        swap = (x[ones[:pairs]] @ to_right) + (x[others[:pairs]] @ to_left) > 0
        if not swap.any():
            break
        left[ones[:pairs][swap]], left[others[:pairs][swap]] = False, True
    return (to_left - to_right).astype(np.float32)


def fit(rows: list[np.ndarray], n_terms: int) -> Tree:
    """The tree for sampled documents, given as places of their terms."""
    degree = np.bincount(np.concatenate(rows), minlength=n_terms) if rows else np.zeros(n_terms, np.int64)
    chosen = np.argsort(-degree, kind="stable")[: min(FEATURES, int((degree > 0).sum()))]
    feature = np.full(n_terms, -1, np.int64)
    feature[chosen] = np.arange(len(chosen))
    x = np.zeros((len(rows), len(chosen)), np.float32)
    for i, r in enumerate(rows):
        x[i, feature[r][feature[r] >= 0]] = 1
    depth = max(0, (len(rows) // LEAST_LEAF).bit_length() - 1)
    gains, least = np.zeros(((1 << depth) - 1, len(chosen)), np.float32), np.zeros((1 << depth) - 1)
    members = {0: np.arange(len(rows))}
    for node in range(len(least)):
        here = members.pop(node)
        if len(here) > 1:
            gains[node] = bisect(x[here])
            total = x[here].astype(np.float64) @ gains[node]
            least[node] = np.median(total)
            members[2 * node + 1], members[2 * node + 2] = here[total >= least[node]], here[total < least[node]]
        else:
            members[2 * node + 1], members[2 * node + 2] = here, here[:0]
    return Tree(gains, least, feature)


def _tree(docs: DataFrame, text_col: str, wanted) -> Tree:
    """Fitted in one task on a sample of about SAMPLE documents; all, where there are fewer. Only the tree comes to the driver. What is found doesn't depend on it."""
    share = min(1.0, SAMPLE / max(1, docs.count()))
    sample = docs if share == 1.0 else docs.sample(share, seed=5)

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for c in chunks(batch.column(0)):
                t = terms_of(c, wanted.value)
                ends = np.searchsorted(t.document, np.arange(c.n + 1))
                yield pa.RecordBatch.from_arrays([pa.array([t.term[a:b].astype("<i4").tobytes() for a, b in zip(ends[:-1], ends[1:], strict=True)], pa.binary())], ["terms"])

    def fitted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = sorted(r for batch in batches for r in batch.column(0).to_pylist())
        rows = [rows[i] for i in np.random.default_rng(5).permutation(len(rows))]
        tree = fit([np.frombuffer(r, "<i4") for r in rows], len(wanted.value))
        yield pa.RecordBatch.from_arrays([pa.array([a.tobytes()], pa.binary()) for a in (tree.gains, tree.least, tree.feature)], ["gains", "least", "feature"])

    row = sample.select(text_col).transform(map_arrow, vectors, "terms binary").repartition(1).transform(map_arrow, fitted, "gains binary, least binary, feature binary").first()
    least, gains = np.frombuffer(row["least"]), np.frombuffer(row["gains"], np.float32)
    return Tree(gains.reshape(len(least), len(gains) // max(1, len(least))), least, np.frombuffer(row["feature"], np.int64))


@dataclass
class Index:
    """blocks: a table (__block, ids, terms, counts, most, places, parts); n_docs and n_terms are N and L."""

    blocks: DataFrame
    n_docs: int
    n_terms: int


def build(docs: DataFrame, wanted, id_col: str, text_col: str) -> Index:
    """The clustered index of every row of docs, for the terms wanted (a broadcast array of sorted hashes).

    A block's documents ascend by id, null last. parts are the contributions (10**9 * tf) div (1000 * tf + 12 * m)
    of its postings, term by term; places those documents' places in the block. Rows of a leaf are dealt
    to its blocks by the hash of a row number, so copies without end don't fill one block.
    """
    spark = docs.sparkSession
    tree = spark.sparkContext.broadcast(_tree(docs, text_col, wanted))  # nodes x FEATURES at most
    kind = docs.schema[id_col].dataType

    def forward(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for c in chunks(batch.column(1)):
                t = terms_of(c, wanted.value)
                leaf = tree.value.route(c.n, t.document, t.term)
                ends = np.searchsorted(t.document, np.arange(c.n + 1))
                term, count = t.term.astype("<i4"), t.count.astype("<i4")
                packed = [pa.array([column[a:b].tobytes() for a, b in zip(ends[:-1], ends[1:], strict=True)], pa.binary()) for column in (term, count)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(c.lo, c.n), pa.array(t.n_terms, pa.int64()), pa.array(leaf, pa.int32()), *packed], ["id", "n", "leaf", "terms", "counts"])

    rows = docs.select(F.col(id_col).alias("id"), text_col).transform(map_arrow, forward, f"id {kind.simpleString()}, n long, leaf int, terms binary, counts binary")
    rows = cut(rows.withColumn("__row", F.monotonically_increasing_id()), "forward")
    n_docs, n_terms = rows.agg(F.count(F.when(F.col("n") > 0, 1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    sizes = rows.groupBy("leaf").agg(F.count("*").alias("__size"))  # a row a leaf of the tree
    m = F.expr(f"CAST(75 + (CAST(25 AS DECIMAL(20, 0)) * n * {n_docs}L) div {max(1, n_terms)}L AS LONG)")
    deal = F.pmod(F.xxhash64("__row"), F.expr(f"__size div {BLOCK} + 1"))
    dealt = rows.filter(F.length("terms") > 0).join(F.broadcast(sizes), "leaf").select(F.expr("CAST(leaf AS LONG) << 40").alias("__leaf"), deal.alias("__deal"), "id", m.alias("m"), "terms", "counts")
    names = ["__block", "ids", "terms", "counts", "most", "places", "parts"]
    schema = pa.schema([("__block", pa.int64()), ("ids", pa.list_(to_arrow_type(kind))), ("terms", pa.list_(pa.int32())), ("counts", pa.list_(pa.int32())), ("most", pa.list_(pa.int64())), ("places", pa.binary()), ("parts", pa.binary())])

    def block(table: pa.Table) -> pa.Table:
        table = table.sort_by([("id", "ascending")])  # null last
        lengths = np.array([len(x) // 4 for x in table.column("terms").to_pylist()])
        place = np.repeat(np.arange(len(lengths)), lengths)
        term, tf = (np.frombuffer(b"".join(table.column(name).to_pylist()), "<i4").astype(np.int64) for name in ("terms", "counts"))
        part = (1_000_000_000 * tf) // (1000 * tf + 12 * np.repeat(table.column("m").to_numpy(), lengths))
        order = np.lexsort((place, term))
        term, place, part = term[order], place[order], part[order]
        own, first, counts = np.unique(term, return_index=True, return_counts=True)
        row = [table.column("__leaf")[0].as_py() | table.column("__deal")[0].as_py(), table.column("id").to_pylist(), own, counts, np.maximum.reduceat(part, first), place.astype("<i4").tobytes(), part.astype("<i4").tobytes()]
        return pa.table([pa.array([v], f.type) for v, f in zip(row, schema, strict=True)], schema=schema)

    ddl = f"__block long, ids array<{kind.simpleString()}>, terms array<int>, counts array<int>, most array<long>, places binary, parts binary"
    blocks = cut(dealt.groupBy("__leaf", "__deal").applyInArrow(block, ddl).select(*names), "blocks")
    release(rows)
    return Index(blocks, n_docs, n_terms)


@dataclass
class Items:
    """The items of a set, one after the other: places of terms, and weights times how often the item has them."""

    offsets: np.ndarray
    terms: np.ndarray
    weights: np.ndarray

    def bounds(self, terms: np.ndarray, most: np.ndarray, size: int) -> np.ndarray:
        """What a document of a block can score, for each item."""
        full = np.zeros(size, np.int64)
        full[terms] = most
        total = np.zeros(len(self.terms) + 1, np.int64)
        np.cumsum(self.weights * full[self.terms], out=total[1:])
        return total[self.offsets[1:]] - total[self.offsets[:-1]]


def best_of_block(row: dict, items: Items, asked: list[int], k: int) -> Iterator[tuple[int, object, int]]:
    """(item, document, score) of the block's k best documents of each item asked, equal scores by place."""
    own, ends = np.array(row["terms"]), np.append(0, np.cumsum(row["counts"]))
    places, parts = (np.frombuffer(row[name], "<i4") for name in ("places", "parts"))
    for item in asked:
        terms, weights = (x[items.offsets[item] : items.offsets[item + 1]] for x in (items.terms, items.weights))
        at = np.searchsorted(own, terms)
        held = np.flatnonzero(own[np.minimum(at, len(own) - 1)] == terms)
        at, weights = at[held], weights[held]
        lengths = ends[at + 1] - ends[at]
        take = np.arange(lengths.sum()) + np.repeat(ends[at] - np.append(0, np.cumsum(lengths)[:-1]), lengths)
        gained = parts[take] * np.repeat(weights, lengths)
        if float(weights.sum()) * 1e6 < EXACT:
            score = np.bincount(places[take], gained, len(row["ids"])).astype(np.int64)
        else:
            score = np.zeros(len(row["ids"]), np.int64)
            np.add.at(score, places[take], gained)
        if len(score) > k:
            least = np.partition(score, len(score) - k)[len(score) - k]
            found = np.flatnonzero(score >= max(1, least))
        else:
            found = np.flatnonzero(score > 0)
        for i in found[np.argsort(-score[found], kind="stable")][:k]:
            yield item, row["ids"][i], int(score[i])


def _ranked(df: DataFrame, k: int) -> DataFrame:
    return df.withColumn("rank", F.row_number().over(W.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("id")))).filter(F.col("rank") <= k)


def visit(index: Index, items, size: int, k: int, rounds: tuple[int, ...] = ROUNDS) -> tuple[DataFrame, list[int]]:
    """((item, id, score, rank) of the k best documents of each item, pairs of item and block visited in each round).

    items is a broadcast Items. A round visits the blocks of highest bound that an item hasn't visited
    and that can reach its k-th score so far; the last round visits all of them. A bound equal to that
    score is visited, for the document may have the smaller id.
    """
    kind = index.blocks.schema["ids"].dataType.elementType.simpleString()

    def bounds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                bound = items.value.bounds(np.array(r["terms"]), np.array(r["most"]), size)
                found = np.flatnonzero(bound > 0)
                yield pa.RecordBatch.from_arrays([pa.array(found, pa.int32()), pa.array(np.full(len(found), r["__block"]), pa.int64()), pa.array(bound[found], pa.int64())], ["item", "__block", "bound"])

    def scores(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                r = batch.slice(i, 1).to_pylist()[0]
                found = list(best_of_block(r, items.value, r["asked"], k))
                columns = zip(*found, strict=True) if found else ([], [], [])
                yield pa.RecordBatch.from_arrays([pa.array(v, f) for v, f in zip(columns, (pa.int32(), batch.schema.field("ids").type.value_type, pa.int64()), strict=True)], ["item", "id", "score"])

    pairs = cut(index.blocks.select("__block", "terms", "most").transform(map_arrow, bounds, "item int, __block long, bound long"), "bounds")
    best, seen, counts = None, None, []
    for most in (*rounds, None):
        due = pairs
        if best is not None:
            reached = best.filter(F.col("rank") == k).select("item", F.col("score").alias("__least"))
            due = due.join(reached, "item", "left").filter(F.col("__least").isNull() | (F.col("bound") >= F.col("__least"))).drop("__least").join(seen, ["item", "__block"], "left_anti")
        if most is not None:
            due = due.withColumn("__turn", F.row_number().over(W.partitionBy("item").orderBy(F.desc("bound"), "__block"))).filter(F.col("__turn") <= most).drop("__turn")
        due = cut(due.select("item", "__block"), "visits")
        counts.append(due.count())
        if counts[-1] == 0:
            break
        asked = due.groupBy("__block").agg(F.sort_array(F.collect_list("item")).alias("asked"))  # an item once
        found = index.blocks.drop("most").join(asked, "__block").transform(map_arrow, scores, f"item int, id {kind}, score long")
        best = cut(_ranked(found if best is None else found.unionByName(best.drop("rank")), k), "best")
        seen = due if seen is None else seen.unionByName(due)
    return best if best is not None else _ranked(index.blocks.sparkSession.createDataFrame([], f"item int, id {kind}, score long"), k), counts


def search(docs: DataFrame, items: DataFrame, k: int = K, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", set_terms: int = SET_TERMS) -> DataFrame:
    """(item, rank, document, score) of each item's k best documents with a score above 0.

    A null text has no terms. Rows that share an item's id are one item with the terms of all of them,
    those without one too. Every row of docs is a document of its own, also where rows share an id; a null
    id comes last among equal scores. Terms that no document has count for nothing. An empty table, or items without
    terms, give an empty result. A text of any length is one document; other columns are left out. Items are
    answered in sets of about set_terms terms, so what travels to tasks doesn't grow with them.
    """
    spark = docs.sparkSession
    own = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))

    def asked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for c in chunks(batch.column(1)):
                t = terms_of(c)
                ends = np.searchsorted(t.document, np.arange(c.n + 1))
                columns = [pa.array([x[a:b].tobytes() for a, b in zip(ends[:-1], ends[1:], strict=True)], pa.binary()) for x in (t.term, t.count.astype(np.int64))]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(c.lo, c.n), *columns], ["item", "terms", "counts"])

    kind = items.schema[item_col].dataType.simpleString()
    told = cut(items.select(F.col(item_col).alias("item"), F.col(item_text_col).alias("text")).transform(map_arrow, asked, f"item {kind}, terms binary, counts binary"), "items")
    sets = 1 + (told.agg(F.sum(F.length("terms"))).first()[0] or 0) // 8 // set_terms
    out = None
    for number in range(sets):
        rows = told.filter(F.pmod(F.xxhash64("item"), F.lit(sets)) == number).filter(F.length("terms") > 0).collect()  # about set_terms terms
        if rows:
            found = _answered(own, rows, k, kind)
            out = found if out is None else out.unionByName(found)
    if out is None:
        out = spark.createDataFrame([], f"item {kind}, rank int, id {docs.schema[id_col].dataType.simpleString()}, score long")
    return out.select(F.col("item").alias(item_col), "rank", F.col("id").alias(id_col), "score")


def _answered(docs: DataFrame, rows: list, k: int, kind: str) -> DataFrame:
    spark = docs.sparkSession
    together: dict = {}
    for r in rows:
        counts = together.setdefault(r["item"], {})
        for term, n in zip(np.frombuffer(r["terms"], np.uint64).tolist(), np.frombuffer(r["counts"], np.int64).tolist(), strict=True):
            counts[term] = counts.get(term, 0) + n
    hashes = np.array(sorted({t for counts in together.values() for t in counts}), np.uint64)
    index = build(docs, spark.sparkContext.broadcast(hashes), "id", "text")
    df = index.blocks.select(F.explode(F.arrays_zip("terms", "counts")).alias("x")).groupBy("x.terms").agg(F.sum("x.counts").alias("df"))
    n = F.lit(float(2 * index.n_docs + 2))
    weights = np.zeros(len(hashes), np.int64)
    for r in df.select("terms", F.floor(1000 * F.log(n / (2 * F.col("df") + 1))).cast("long").alias("w")).collect():  # a row a term of the set
        weights[r["terms"]] = r["w"]
    names = list(together)
    places = [np.searchsorted(hashes, np.fromiter(together[i], np.uint64)) for i in names]
    times = [np.fromiter(together[i].values(), np.int64) for i in names]
    offsets = np.append(0, np.cumsum([len(p) for p in places]))
    terms = np.concatenate(places)
    found, _ = visit(index, spark.sparkContext.broadcast(Items(offsets, terms, weights[terms] * np.concatenate(times))), len(hashes), k)
    labels = spark.createDataFrame(list(enumerate(names)), f"item int, name {kind}")
    return found.join(F.broadcast(labels), "item").select(F.col("name").alias("item"), "rank", "id", "score")


def op13_clustered_ranked_search(spark, sf_dir):
    return search(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms FROM documents),
q AS (
  SELECT item_id, term, count(*)::BIGINT AS times FROM (
    SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark) GROUP BY ALL),
s AS (SELECT count(*) FILTER (WHERE len(terms) > 0)::BIGINT AS n_docs, sum(len(terms))::BIGINT AS n_terms FROM d),
tf AS (
  SELECT doc_id, n, term, count(*)::BIGINT AS tf FROM (SELECT doc_id, len(terms)::BIGINT AS n, unnest(terms) AS term FROM d)
  WHERE term IN (SELECT term FROM q) GROUP BY ALL),
w AS (SELECT term, floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * df + 1)))::BIGINT AS w FROM (SELECT term, count(*) AS df FROM tf GROUP BY term), s),
scored AS (
  SELECT item_id, doc_id, sum(times * w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * n_docs) // n_terms))))::BIGINT AS score
  FROM q JOIN tf USING (term) JOIN w USING (term), s GROUP BY ALL)
SELECT item_id, (row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id))::INT AS rank, doc_id, score
FROM scored WHERE score > 0 QUALIFY rank <= 20
"""
