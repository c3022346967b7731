"""Merkle dataset manifest: a tree of digests over the rows of each group, a root over the groups, and each row's proof.

Levels are windows. Nodes of one parent meet in a window partitioned by group and parent index, and
its ordered, full-frame collect_list gives both the parent's preimage and each node's siblings. Only
a run's first row carries the parent on, so a parent is hashed once and counted once in the next level.

Rows are dealt out by group and block, a block being LEVELS levels of one subtree. All windows of
these levels share that one shuffle and one sort, as each partitions by more columns than the rows
were dealt by. Then each block is one row of the next climb, FAN ** LEVELS times fewer. A group of any
size is thus spread over its blocks, and proofs come back down by joins on group and block.
DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.llm.shared import cut, documents, release

FAN, LEVELS = 3, 6
#: Rows are numbered in ranges of about so many; one range of one group is numbered in one task.
RANGE_ROWS = 1_000_000
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
NO_STEPS = "array<struct<before:string,after:string>>"


def field(value: Column) -> Column:
    """What a leaf hashes of one value: `-` for null, else its UTF-8 byte count, a colon and the value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def digest(*values: Column) -> Column:
    return F.sha2(F.concat(*(field(v) for v in values)).cast("binary"), 256)


def numbered(nodes: DataFrame, order: list[str]) -> DataFrame:
    """nodes (a table with __key) with __idx, their places from 0 in their group, and __n, the group's size. order has to be total.

    Ranges of the whole order are counted, and a row's place is that of its range in its group plus
    that within, so neither a group nor the table is ordered in one task.
    """
    spark = nodes.sparkSession
    ranges = max(int(spark.conf.get("spark.sql.shuffle.partitions")), nodes.count() // RANGE_ROWS)
    ranged = cut(nodes.repartitionByRange(ranges, "__key", *order).withColumn("__range", F.spark_partition_id()), "ranged")
    counts = ranged.groupBy("__key", "__range").agg(F.count("*").alias("__rows"))
    group = W.partitionBy("__key")
    starts = counts.select("__key", "__range", (F.sum("__rows").over(group.orderBy("__range")) - F.col("__rows")).alias("__start"), F.sum("__rows").over(group).alias("__n"))
    within = F.row_number().over(W.partitionBy("__key", "__range").orderBy(*order)) - 1
    return ranged.withColumn("__within", within).join(starts, ["__key", "__range"]).withColumn("__idx", F.col("__start") + F.col("__within")).drop("__range", "__within", "__start")


def _nodes_at(level: int) -> Column:
    """How many nodes the group has so many levels up."""
    return F.expr(f"(__n + {FAN**level - 1}) div {FAN**level}")


def climb(nodes: DataFrame) -> DataFrame:
    """nodes (__key, __idx, __n, __digest) with __block, __steps (before and after: what a node's run has on either side of it, level by level) and, in a block's first row, __top: the digest LEVELS levels up.

    A level at which the group is one node already is no step. A last run of one node is one, with nothing on either side.
    """
    at = ["__idx", *(f"__p{k}" for k in range(1, LEVELS)), "__block"]
    out = nodes.withColumns({name: F.expr(f"__idx div {FAN**k}") for k, name in enumerate(at) if k})
    out = out.repartition("__key", "__block").sortWithinPartitions("__key", *reversed(at)).withColumn("__d0", F.col("__digest"))
    steps = []
    for k in range(LEVELS):
        run = W.partitionBy("__key", *reversed(at[k + 1 :])).orderBy(*reversed(at[: k + 1])).rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
        out = out.withColumn(f"__run{k}", F.collect_list(f"__d{k}").over(run))  # one digest a node: other rows have null
        members, place, grows = F.col(f"__run{k}"), (F.col(at[k]) % FAN).cast("int"), _nodes_at(k) > 1
        before, after = F.array_join(F.slice(members, 1, place), ""), F.array_join(F.slice(members, place + 2, FAN), "")
        steps.append(F.struct(grows.alias("grows"), before.alias("before"), after.alias("after")))
        parent = F.when(grows, F.sha2(F.array_join(members, "").cast("binary"), 256)).otherwise(F.col(f"__d{k}"))
        out = out.withColumn(f"__d{k + 1}", F.when(F.col("__idx") % FAN ** (k + 1) == 0, parent))
    taken = F.transform(F.filter(F.array(*steps), lambda s: s["grows"]), lambda s: F.struct(s["before"].alias("before"), s["after"].alias("after")))
    return out.withColumn("__steps", taken).withColumnRenamed(f"__d{LEVELS}", "__top").drop(*(f"__run{k}" for k in range(LEVELS)), *(f"__d{k}" for k in range(LEVELS)), *at[1:-1])


def forest(nodes: DataFrame) -> tuple[list[DataFrame], DataFrame]:
    """(tables of nodes, one a climb; (__key, __root) of each group). nodes: (__key, __idx, __n, __digest), a table."""
    layers = [nodes]
    while (nodes.agg(F.max("__n")).first()[0] or 0) > 1:
        tops = climb(nodes.select("__key", "__idx", "__n", "__digest")).filter("__top IS NOT NULL")
        nodes = cut(tops.select("__key", F.col("__block").alias("__idx"), _nodes_at(LEVELS).alias("__n"), F.col("__top").alias("__digest")), "nodes")
        layers.append(nodes)
    return layers, nodes.select("__key", F.col("__digest").alias("__root"))


def proofs(layers: list[DataFrame], above: DataFrame) -> DataFrame:
    """The first layer's rows with __path, their own steps followed by those of above (__key, __path and more, one row a group), which are carried along.

    Joins are by group and block: a block's row meets its FAN ** LEVELS nodes, never a whole group.
    """
    path = above.withColumn("__idx", F.lit(0).cast("long"))
    for nodes in reversed(layers[:-1]):
        over = path.drop("__n", "__digest").withColumnsRenamed({"__idx": "__block", "__path": "__above"})
        path = climb(nodes).join(over, ["__key", "__block"]).withColumn("__path", F.concat("__steps", "__above")).drop("__steps", "__above", "__block", "__top")
    return path if len(layers) > 1 else layers[0].join(above, "__key")


def fold(leaf: Column, path: Column) -> Column:
    """The root that a leaf and its path give."""
    return F.aggregate(path, leaf, lambda acc, s: F.sha2(F.concat(s["before"], acc, s["after"]).cast("binary"), 256))


def proof(path: Column) -> Column:
    """The siblings' digests, level by level, left to right."""
    return F.array_join(F.transform(path, lambda s: F.concat(s["before"], s["after"])), "")


def manifest(docs: DataFrame, fields: tuple[str, ...] = FIELDS, group_col: str = "source", id_col: str = "doc_id", altered: Column | None = None) -> DataFrame:
    """(id, leaf, altered_leaf, subroot, root, path) of every row: path is an array of (before, after), to be used with fold() and proof().

    A row's leaf is the digest of its fields, null or not. Groups ascend by their bytes, null first;
    rows of a group ascend by id, null first, rows of one id by leaf, and equal rows are leaves of
    their own. altered is what the last field is replaced by in altered_leaf, null where it isn't; such a
    leaf is no part of the tree. A single row is its group's subroot, and a single group's subroot is the
    root. An empty table gives an empty result. Long texts are hashed in one go where they are read, and
    never shuffled. Other columns than the fields are left out, so their names can't clash.
    """
    values = [F.col(c) for c in fields]
    leaf = digest(*values)
    other = leaf if altered is None else F.when(altered.isNotNull(), digest(*values[:-1], altered)).otherwise(leaf)
    key = F.coalesce(F.concat(F.lit("1"), F.col(group_col).cast("string")), F.lit("0"))
    leaves = cut(docs.select(key.alias("__key"), F.col(id_col).alias("__id"), leaf.alias("__digest"), other.alias("__altered"), F.monotonically_increasing_id().alias("__row")), "leaves")
    nodes = cut(numbered(leaves, ["__id", "__digest", "__row"]), "nodes")
    release(leaves)
    layers, subroots = forest(nodes)
    groups = cut(subroots.select(F.lit("").alias("__key"), F.col("__key").alias("__group"), F.col("__root").alias("__digest")), "subroots")
    upper, root = forest(cut(numbered(groups, ["__group"]), "groups"))
    above = proofs(upper, root.withColumn("__path", F.array().cast(NO_STEPS)))
    above = cut(above.select(F.col("__group").alias("__key"), "__path", F.col("__digest").alias("__subroot"), "__root"), "above")
    out = proofs(layers, above)
    return out.select(F.col("__id").alias(id_col), F.col("__digest").alias("leaf"), F.col("__altered").alias("altered_leaf"), F.col("__subroot").alias("subroot"), F.col("__root").alias("root"), F.col("__path").alias("path"))


def op12_merkle_manifest(spark, sf_dir):
    tampered = F.crc32(F.col("doc_id").cast("string")) % 2 == 0
    without = F.when(tampered & F.contains(F.col("text"), F.lit("\n")), F.translate("text", "\n", ""))
    out = manifest(documents(spark, sf_dir), altered=without)
    folded = fold(F.col("altered_leaf"), F.col("path"))
    out = out.select("doc_id", "leaf", "subroot", "root", F.sha2(proof(F.col("path")).cast("binary"), 256).alias("proof_sha256"), folded.alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


# DuckDB has no crc32: the table of the 256 byte steps comes from the polynomial, and a recursion goes over the id's digits.
SQL = r"""
WITH RECURSIVE
bits AS (
  SELECT range AS b, range::BIGINT AS c, 0 AS k FROM range(256)
  UNION ALL
  SELECT b, CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END, k + 1 FROM bits WHERE k < 8),
steps AS (SELECT b, c FROM bits WHERE k = 8),
crc AS (
  SELECT DISTINCT doc_id, doc_id::VARCHAR AS rest, 4294967295::BIGINT AS c FROM documents WHERE doc_id IS NOT NULL
  UNION ALL
  SELECT doc_id, substr(rest, 2), xor(crc.c // 256, steps.c)
  FROM crc JOIN steps ON steps.b = xor(crc.c % 256, ascii(rest)) WHERE rest <> ''),
picked AS (SELECT doc_id FROM crc WHERE rest = '' AND xor(c, 4294967295) % 2 = 0),
parts AS (
  SELECT doc_id, coalesce('1' || source, '0') AS g,
         coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id::VARCHAR, '-') || coalesce(strlen(source) || ':' || source, '-')
         || coalesce(strlen(lang) || ':' || lang, '-') || coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars::VARCHAR, '-') AS head,
         text, replace(text, chr(10), '') AS cut FROM documents),
leaves AS (
  SELECT parts.doc_id, g, sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS leaf,
         sha256(head || CASE WHEN picked.doc_id IS NULL THEN coalesce(strlen(text) || ':' || text, '-') ELSE coalesce(strlen(cut) || ':' || cut, '-') END) AS altered
  FROM parts LEFT JOIN picked ON parts.doc_id = picked.doc_id),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, count(*) OVER (PARTITION BY g) AS n FROM leaves),
low AS (
  SELECT 0 AS lvl, g, i, n, leaf AS d FROM placed
  UNION ALL
  SELECT lvl + 1, g, i // 3, (n + 2) // 3, sha256(string_agg(d, '' ORDER BY i)) FROM low WHERE n > 1 GROUP BY lvl, g, i // 3, n),
sub AS (SELECT g, d AS subroot, row_number() OVER (ORDER BY g) - 1 AS gi, count(*) OVER () AS gn FROM low WHERE n = 1),
high AS (
  SELECT 0 AS lvl, gi AS i, gn AS n, subroot AS d FROM sub
  UNION ALL
  SELECT lvl + 1, i // 3, (n + 2) // 3, sha256(string_agg(d, '' ORDER BY i)) FROM high WHERE n > 1 GROUP BY lvl, i // 3, n),
walk AS (
  SELECT doc_id, leaf, g, false AS up, 0 AS lvl, i, i AS at, n, altered AS acc, '' AS trail FROM placed
  UNION ALL
  SELECT w.doc_id, w.leaf, w.g, w.up, w.lvl + 1, w.i, w.at // 3, (w.n + 2) // 3,
         sha256(string_agg(CASE WHEN low.i = w.at THEN w.acc ELSE low.d END, '' ORDER BY low.i)),
         w.trail || coalesce(string_agg(low.d, '' ORDER BY low.i) FILTER (WHERE low.i <> w.at), '')
  FROM walk AS w JOIN low ON low.g = w.g AND low.lvl = w.lvl AND low.i // 3 = w.at // 3
  WHERE w.n > 1 GROUP BY w.doc_id, w.leaf, w.g, w.up, w.lvl, w.i, w.at, w.n, w.acc, w.trail),
climb AS (
  SELECT w.doc_id, w.leaf, w.i, sub.subroot, sub.g, 0 AS lvl, sub.gi AS at, sub.gn AS n, w.acc, w.trail FROM walk AS w JOIN sub ON w.g = sub.g WHERE w.n = 1
  UNION ALL
  SELECT c.doc_id, c.leaf, c.i, c.subroot, c.g, c.lvl + 1, c.at // 3, (c.n + 2) // 3,
         sha256(string_agg(CASE WHEN high.i = c.at THEN c.acc ELSE high.d END, '' ORDER BY high.i)),
         c.trail || coalesce(string_agg(high.d, '' ORDER BY high.i) FILTER (WHERE high.i <> c.at), '')
  FROM climb AS c JOIN high ON high.lvl = c.lvl AND high.i // 3 = c.at // 3
  WHERE c.n > 1 GROUP BY c.doc_id, c.leaf, c.i, c.subroot, c.g, c.lvl, c.at, c.n, c.acc, c.trail)
SELECT climb.doc_id, climb.leaf, climb.subroot, high.d AS root, sha256(climb.trail) AS proof_sha256, climb.acc AS folded_root, climb.acc = high.d AS verified
FROM climb, high WHERE climb.n = 1 AND high.n = 1
"""
