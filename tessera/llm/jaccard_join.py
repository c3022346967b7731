"""N-gram Jaccard join by set-relation skipping.

Sets are the distinct three-word shingles of lower-cased texts. Two sets with a Jaccard likeness
of t at least share a shingle among the first (1 - t) of either, in any order of shingles that
all sets agree on; rare ones first makes for short lists. An index list is a shingle with the
sets that have it among their first ones, each with its size and the shingle's place in it.

Two relations between sets spare most of the work:

* Position: a set of n shingles that meets a list at place p can have n - p in common at most, so
  its partners' sizes end at (n - p)(1 + t) / t - n. Lists lie in blocks by size, and a set probes
  the blocks from its own to that size alone and skips the others.
* Similarity: what a set links to follows, for the most part, from a similar set whose answers are
  known. In each list and coarse block all sets are held against one centre, the set with the
  earliest place (the fewest rare shingles). Those that link to it form one component with it and
  need no pairs among themselves. Of the others the differences from the centre are known, and by
  the triangle inequality two sets differ by at least the difference and at most the sum of
  theirs. So most pairs with a common centre are decided without comparing the sets; the rest
  are verified.

So copies cost one pair a set, and still no link between components is lost.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.components import connected
from tessera.llm.shared import counted_join, cut, map_arrow, release
from tessera.llm.vector import Chunk, chunks

SHINGLE = 3
THRESHOLD = (90, 100)
#: Shingles' frequencies are estimated in 2**SKETCH_BITS counters, a fixed size whatever the input.
SKETCH_BITS, BLOCK, TURNS = 22, 1 << 16, 16
#: Tables of pairs up to this many rows are sent to every executor, larger ones are joined.
SMALL_ROWS = 200_000
#: Counters of a set's shingles by hash, which bound what two sets have in common.
BINS = 64
#: Sizes in a block of an index list differ by at most this factor.
BLOCK_RATIO = 1.02
#: Sets that many others are held against travel to these, unless they are longer.
LONG = 20_000
#: A batch of sets that a worker hands over holds about so many shingles.
ROWS_ITEMS = 200_000

NODE = "__node long, __size long, __set binary, __bins binary, __tokens array<long>"


def sets_of(c: Chunk, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles of each document, sorted; and n + 1 places in them."""
    hashes, at = c.lowered.shingles(size)
    doc = np.repeat(np.arange(c.n), np.diff(at))
    order = np.lexsort((hashes, doc))
    hashes, doc = hashes[order], doc[order]
    new = np.append(True, (hashes[1:] != hashes[:-1]) | (doc[1:] != doc[:-1])) if len(hashes) else np.zeros(0, bool)
    hashes, doc = hashes[new], doc[new]
    return hashes, np.searchsorted(doc, np.arange(c.n + 1))


def sketch(docs: DataFrame, text_col: str, size: int, bits: int = SKETCH_BITS) -> np.ndarray:
    """Levels (0 to 255, logarithmic) of how many sets have a shingle of each of 2**bits buckets.

    A task counts up to 255 in each bucket and hands its counters on in blocks. These are added up as
    they come, first in TURNS lots a block and then over the lots, so that no task reads what all
    tasks wrote. The levels only set an order, so an estimate is as good as a count for right results.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, some, turn = np.zeros(1 << bits, np.int32), False, TaskContext.get().partitionId() % TURNS
        for batch in batches:
            for c in chunks(batch.column(0)):
                some = True
                np.add.at(count, (sets_of(c, size)[0] >> np.uint64(64 - bits)).astype(np.int64), 1)
        if some:
            small = np.minimum(count, 255).astype(np.uint16).reshape(-1, min(BLOCK, len(count)))
            for k, row in enumerate(small):
                yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([turn], pa.int32()), pa.array([row.tobytes()], pa.binary())], ["block", "turn", "counts"])

    def added(batches: Iterator[pa.RecordBatch]) -> dict[tuple[int, int], np.ndarray]:
        total: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            for k, turn, counts in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                row = np.frombuffer(counts, np.uint16).astype(np.int64)
                total[k, turn] = total[k, turn] + row if (k, turn) in total else row
        return total

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (k, _), row in added(batches).items():
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([0], pa.int32()), pa.array([np.minimum(row, 65535).astype(np.uint16).tobytes()], pa.binary())], ["block", "turn", "counts"])

    def levels(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (k, _), row in added(batches).items():
            level = np.minimum(255, 4 * np.log2(1 + row)).astype(np.uint8)
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([level.tobytes()], pa.binary())], ["block", "counts"])

    schema = "block int, turn int, counts binary"
    lots = docs.select(text_col).transform(map_arrow, run, schema).repartition("block", "turn").transform(map_arrow, add, schema)
    rows = lots.repartition("block").transform(map_arrow, levels, "block int, counts binary").collect()
    out = np.zeros(1 << bits, np.uint8)
    for r in rows:
        out[r["block"] * BLOCK : r["block"] * BLOCK + len(r["counts"])] = np.frombuffer(r["counts"], np.uint8)
    return out


def index_rows(docs: DataFrame, id_col: str, text_col: str, size: int, threshold: tuple[int, int], levels: np.ndarray) -> DataFrame:
    """Of each row: its id, the size and hash of its set, and its first shingles in order. Repeats of a set in one task have no shingles: the hash links them. Nor have rows without an id, which link with nothing."""
    bits = int(levels.size).bit_length() - 1
    shared = docs.sparkSession.sparkContext.broadcast(levels)
    num, den = threshold

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        level = shared.value
        for batch in batches:
            for c in chunks(batch.column(1)):
                hashes, at = sets_of(c, size)
                rank = level[(hashes >> np.uint64(64 - bits)).astype(np.int64)]
                doc = np.repeat(np.arange(c.n), np.diff(at))
                ordered = hashes[np.lexsort((hashes, rank, doc))].astype(np.int64)
                sizes = np.diff(at)
                first = np.where(sizes > 0, sizes - -(-sizes * num // den) + 1, 0)
                digest = [hashlib.md5(hashes[a:b].tobytes()).digest() for a, b in zip(at[:-1], at[1:], strict=True)]
                known = batch.column(0).slice(c.lo, c.n).is_valid().to_pylist()
                for i, d in enumerate(digest):
                    if not known[i] or d in seen:
                        first[i] = 0
                    elif len(seen) < 1_000_000:
                        seen.add(d)
                places = np.concatenate([[0], np.cumsum(first)]).astype(np.int32)
                take = np.arange(places[-1]) + np.repeat(at[:-1] - places[:-1], first)
                tokens = pa.ListArray.from_arrays(pa.array(places), pa.array(ordered[take], pa.int64()))
                bins = np.bincount(doc * BINS + (hashes >> np.uint64(20)).astype(np.int64) % BINS, minlength=c.n * BINS).reshape(c.n, BINS)
                bins = [b.tobytes() for b in np.minimum(bins, 255).astype(np.uint8)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(c.lo, c.n), pa.array(sizes, pa.int64()), pa.array(digest, pa.binary()), pa.array(bins, pa.binary()), tokens], ["__node", "__size", "__set", "__bins", "__tokens"])

    return docs.select(F.col(id_col).cast("long").alias("__node"), text_col).transform(map_arrow, run, NODE)


def plausible(pairs: DataFrame, nodes: DataFrame, threshold: tuple[int, int]) -> DataFrame:
    """pairs (a, b) whose sets may link: the sum over BINS of the smaller count bounds what two sets have in common."""
    num, den = threshold
    bins = nodes.select("__node", "__size", "__bins")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, m = (batch.column(k).to_numpy() for k in (2, 3))
            x, y = (np.frombuffer(b"".join(batch.column(k).to_pylist()), np.uint8).reshape(-1, BINS) for k in (4, 5))
            # a count of 255 stands for any larger one
            full = (x == 255).any(axis=1) | (y == 255).any(axis=1)
            most = np.minimum(np.minimum(x, y).sum(axis=1, dtype=np.int64), np.minimum(n, m))
            keep = pa.array(full & (den * np.minimum(n, m) >= num * np.maximum(n, m)) | ((num + den) * most >= num * (n + m)))
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(1).filter(keep)], ["a", "b"])

    first = bins.select(F.col("__node").alias("a"), F.col("__size").alias("__n"), F.col("__bins").alias("__x"))
    second = bins.select(F.col("__node").alias("b"), F.col("__size").alias("__m"), F.col("__bins").alias("__y"))
    return pairs.join(first, "a").join(second, "b").select("a", "b", "__n", "__m", "__x", "__y").transform(map_arrow, run, "a long, b long")


def compared(pairs: DataFrame, docs: DataFrame, id_col: str, text_col: str, size: int) -> DataFrame:
    """pairs (a, b) with common, n and m: what their sets have in common, and their sizes. Sets are made anew from the texts that take part and meet at a, those of frequent centres at b."""
    parts = pairs.select(F.col("b").alias("__node"), F.struct(F.col("a").alias("key"), F.col("b").alias("other")).alias("__part"))
    parts = parts.unionByName(pairs.select("a").distinct().select(F.col("a").alias("__node"), F.struct(F.col("a").alias("key"), F.lit(None).cast("long").alias("other")).alias("__part")))
    parts = cut(parts.groupBy("__node").agg(F.collect_list("__part").alias("__parts"), F.count("*").alias("__n")), "parts")
    total = parts.agg(F.sum("__n")).first()[0] or 0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column(1).to_pylist()
            for c in chunks(batch.column(0)):
                hashes, at = sets_of(c, size)
                hashes = hashes.astype(np.int64)
                for i in range(c.n):
                    own, wanted = hashes[at[i] : at[i + 1]], keys[c.lo + i]
                    step = max(1, ROWS_ITEMS // max(1, len(own)))
                    for lo in range(0, len(wanted), step):
                        some = wanted[lo : lo + step]
                        items = pa.ListArray.from_arrays(pa.array(np.arange(len(some) + 1) * len(own), pa.int32()), pa.array(np.tile(own, len(some))))
                        yield pa.RecordBatch.from_arrays([pa.array([x["key"] for x in some], pa.int64()), pa.array([x["other"] for x in some], pa.int64()), items], ["a", "b", "__items"])

    some = docs.select(F.col(id_col).cast("long").alias("__node"), text_col).join(F.broadcast(parts.drop("__n")) if total <= SMALL_ROWS else parts.drop("__n"), "__node")
    sets = cut(some.select(text_col, "__parts").transform(map_arrow, run, "a long, b long, __items array<long>"), "sets")
    rows = sets.filter("b IS NOT NULL")
    often = rows.groupBy("a").agg(F.count("*").alias("__n"))
    centres = sets.filter("b IS NULL").select("a", F.col("__items").alias("__other")).join(often, "a")
    centres = centres.withColumn("__n", F.when(F.size("__other") <= LONG, F.col("__n")).otherwise(0))
    common = F.size(F.array_intersect("__items", "__other")).cast("long")
    out = cut(counted_join(rows, centres, ["a"], total, 50).select("a", "b", common.alias("common"), F.size("__other").cast("long").alias("n"), F.size("__items").cast("long").alias("m")).distinct(), "compared")
    release(parts, sets)
    return out


def linked(threshold: tuple[int, int]) -> F.Column:
    """Of common, n and m: whether the sets link."""
    num, den = threshold
    return (F.col("common") > 0) & (den * F.col("common") >= num * (F.col("n") + F.col("m") - F.col("common")))


def verified(pairs: DataFrame, docs: DataFrame, id_col: str, text_col: str, size: int, threshold: tuple[int, int]) -> DataFrame:
    """Those of pairs (a, b) whose sets link."""
    return compared(pairs, docs, id_col, text_col, size).filter(linked(threshold)).select("a", "b")


def possible(n: str, p: str, m: str, q: str, threshold: tuple[int, int]) -> F.Column:
    """Whether sets of n and m shingles that meet at places p and q (from 0) can link, if nothing before these is common: by size, and by what can follow."""
    num, den = threshold
    n, p, m, q = (F.col(x) for x in (n, p, m, q))
    most = F.least(n - p, m - q)
    return (den * F.least(n, m) >= num * F.greatest(n, m)) & ((num + den) * most >= num * (n + m))


def size_block(size: F.Column) -> F.Column:
    return F.floor(F.log(size.cast("double")) / float(np.log(BLOCK_RATIO))).cast("int")


def by_centre(threshold: tuple[int, int], n: str, x: str, m: str, y: str) -> F.Column:
    """Of sets of n and m shingles that differ from one centre in x and y shingles: whether they link, or null where these figures don't tell."""
    num, den = threshold
    n, x, m, y = (F.col(c) for c in (n, x, m, y))
    room = (den - num) * (n + m)  # they link if they differ in no more than this over num + den
    return F.when((num + den) * (x + y) <= room, True).when((num + den) * F.abs(x - y) > room, False)


def components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SHINGLE, threshold: tuple[int, int] = THRESHOLD) -> DataFrame:
    """docs' ids with n_shingles and component_id, one row per row.

    Sets link when den * intersection >= num * union. component_id is the smallest id that links
    lead to. Null, empty and blank texts have no shingles and link with nothing. Rows of one id
    are one node. A row without an id has its size and no component. Ties and repeated rows link as
    equal sets do. An empty table gives an empty result. Other columns are left out, so their names
    don't matter.
    """
    num, den = threshold
    levels = sketch(docs, text_col, size)
    nodes = cut(index_rows(docs, id_col, text_col, size, threshold, levels), "nodes")
    known = nodes.filter(F.col("__node").isNotNull() & (F.col("__size") > 0))
    same = known.groupBy("__set").agg(F.min("__node").alias("__low"), F.count("*").alias("__n")).filter("__n > 1")
    twins = counted_join(known.select("__node", "__set"), same, ["__set"], known.count()).filter("__node <> __low").select(F.col("__low").alias("a"), F.col("__node").alias("b"))

    # index lists of two sets or more; counts first, so that a frequent shingle's list needn't meet in one task
    rows = known.select("__node", F.col("__size").cast("int").alias("__size"), F.posexplode("__tokens").alias("__place", "__token"))
    often = cut(rows.groupBy("__token").agg(F.count("*").alias("__n")).filter("__n > 1"), "often")
    lists = counted_join(rows, often, ["__token"], known.agg(F.sum(F.size("__tokens"))).first()[0] or 0)
    lists = cut(lists.withColumn("__group", F.floor(F.log(F.col("__size").cast("double")) / float(np.log(den / num))).cast("int")), "lists")
    centres = lists.groupBy("__token", "__group").agg(F.min(F.struct("__place", "__node", "__size")).alias("__centre"), F.count("*").alias("__n"))
    placed = cut(counted_join(lists, cut(centres, "centres"), ["__token", "__group"], lists.count()), "placed")
    release(often, lists)
    stars = placed.select("__node", "__size", "__place", F.col("__centre.__node").alias("a"), F.col("__centre.__size").alias("__cs"), F.col("__centre.__place").alias("__cp"))
    stars = stars.filter("__node <> a").filter(possible("__size", "__place", "__cs", "__cp", threshold)).select("a", F.col("__node").alias("b")).distinct()
    answers = compared(cut(plausible(stars, known, threshold), "pairs"), docs, id_col, text_col, size)
    links = cut(answers.filter(linked(threshold)).select("a", "b").unionByName(twins), "links")
    first = cut(connected(links), "components")

    # what still may link: sets of different components that meet in a list
    first = first.select(F.col("id").alias("__node"), F.col("component").alias("__comp"))
    owned = placed.join(F.broadcast(first) if first.count() <= SMALL_ROWS else first, "__node", "left").withColumn("__comp", F.coalesce("__comp", "__node"))
    owned = cut(owned.select("__token", "__node", "__size", "__place", F.col("__centre.__node").alias("__from"), "__comp"), "owned")
    mixed = owned.groupBy("__token").agg(F.min("__comp").alias("__a"), F.max("__comp").alias("__b"), F.count("*").alias("__n")).filter("__a <> __b").select("__token", "__n")
    rest = counted_join(owned, cut(mixed, "mixed"), ["__token"], owned.count())
    several = known.groupBy("__node").agg((F.min("__set") != F.max("__set")).alias("__several")).filter("__several")  # ids of several sets: no figure is theirs alone
    single = answers.join(several, F.col("a") == F.col("__node"), "left_anti")
    apart = single.select(F.col("a").alias("__from"), F.col("b").alias("__node"), (F.col("n") + F.col("m") - 2 * F.col("common")).alias("__apart"))
    rest = rest.join(apart, ["__from", "__node"], "left").join(several, "__node", "left")
    own = F.when(F.col("__from") == F.col("__node"), 0).otherwise(F.col("__apart"))
    rest = cut(rest.withColumn("__apart", F.when(F.col("__several").isNull(), own)).drop("__several"), "rest")
    other = rest.select("__token", size_block(F.col("__size")).alias("__block"), *(F.col(c).alias(f"{c}2") for c in ("__node", "__size", "__place", "__comp", "__from", "__apart")))
    reach = F.floor((F.col("__size") - F.col("__place")) * (num + den) / num) - F.col("__size")
    probes = rest.withColumn("__reach", reach).filter("__reach >= __size").withColumn("__block", F.explode(F.sequence(size_block(F.col("__size")), size_block(F.col("__reach")))))
    later = (F.col("__size") < F.col("__size2")) | (F.col("__size") == F.col("__size2")) & (F.col("__node") < F.col("__node2"))
    met = probes.join(other, ["__token", "__block"]).filter(later & (F.col("__comp") != F.col("__comp2"))).filter(possible("__size", "__place", "__size2", "__place2", threshold))
    told = F.when(F.col("__from") == F.col("__from2"), by_centre(threshold, "__size", "__apart", "__size2", "__apart2"))
    met = met.select(F.col("__node").alias("a"), F.col("__node2").alias("b"), told.alias("told")).groupBy("a", "b").agg(F.max("told").alias("told"))
    met = cut(met.filter("told IS NULL OR told"), "met")
    done = answers.select("a", "b").unionByName(answers.select(F.col("b").alias("a"), F.col("a").alias("b")))
    pairs = cut(plausible(met.filter("told IS NULL").select("a", "b").join(done, ["a", "b"], "left_anti"), known, threshold), "pairs")
    found = verified(pairs, docs, id_col, text_col, size, threshold).unionByName(met.filter("told").select("a", "b"))
    labels = connected(cut(links.unionByName(found), "links")).select(F.col("id").alias("__node"), "component")
    release(placed, owned, rest)
    return nodes.join(labels, "__node", "left").select(F.col("__node").alias(id_col), F.col("__size").alias("n_shingles"), F.coalesce("component", "__node").alias("component_id"))


def op8_set_relation_join(spark, sf_dir):
    return components(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))


SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents),
sh AS (
  SELECT DISTINCT doc_id, s FROM (
    SELECT doc_id, CASE WHEN len(w) < 3 THEN list_aggregate(w, 'string_agg', ' ') ELSE w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] END AS s
    FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 2, CASE WHEN len(w) > 0 THEN 1 ELSE 0 END) + 1)) AS i FROM words))),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
common AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2),
links AS (
  SELECT a, b FROM common JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 90 * (x.n + y.n - c)),
both_ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (
  SELECT doc_id AS a, doc_id AS b FROM documents
  UNION
  SELECT r.a, l.b FROM reach r JOIN both_ways l ON r.b = l.a)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, m.c AS component_id
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id JOIN (SELECT a, min(b) AS c FROM reach GROUP BY a) m ON m.a = d.doc_id
"""
