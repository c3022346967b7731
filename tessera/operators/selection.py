"""Choosing among ranked evidence: tiers, merges, caps, covers and hash picks."""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions.text import hash_mod
from tessera.session import kept, release

# Authority of lineages, lower first, and scopes that only give context.
AUTHORITY = {"sumijo_feedback": 0, "expert_annotation": 1, "web_coaching": 2, "web_database": 2}
CONTEXT_SCOPES = ("other_range_context", "unspecified_context")


def scope_tier(label: Column) -> Column:
    return F.when(label.isin(*CONTEXT_SCOPES), 2).when(label == "global_context", 1).otherwise(0)


def authority(lineage: Column, table: dict[str, int] | None = None, default: int = 3) -> Column:
    table = AUTHORITY if table is None else table
    return F.coalesce(F.element_at(F.create_map(*(F.lit(x) for kv in table.items() for x in kv)), lineage), F.lit(default))


def keep_first(df: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    return df.withColumn("__n", F.row_number().over(W.partitionBy(*key).orderBy(*order))).filter("__n = 1").drop("__n")


def merge_tiers(primary: DataFrame, fallback: DataFrame, group: list[str], key: str, position: str, tiers: list[Column], k: int) -> DataFrame:
    """Both lists as one of up to k: by tiers, within them in order (primary before fallback, by position), each key once; with rank."""
    both = primary.withColumn("__list", F.lit(0)).unionByName(fallback.withColumn("__list", F.lit(1)), allowMissingColumns=True)
    order = [*tiers, F.col("__list"), F.col(position)]
    once = keep_first(both, [*group, key], order)
    return once.withColumn("rank", F.row_number().over(W.partitionBy(*group).orderBy(*order))).filter(F.col("rank") <= max(0, k)).drop("__list")


def interleave(df: DataFrame, group: list[str], list_col: str, first: object, order: list[Column], k: int, local: object | None = None) -> DataFrame:
    """Two ranked lists in turn, first's rows leading; of list local at most min(3, (k + 1) // 2) rows, or min(3, k) where it stands alone."""
    ranked = df.withColumn("__n", F.row_number().over(W.partitionBy(*group, list_col).orderBy(*order)))
    if local is not None:
        alone = F.min(F.col(list_col) == local).over(W.partitionBy(*group))
        ranked = ranked.withColumn("__cap", F.when(alone, min(3, k)).otherwise(min(3, (k + 1) // 2))).filter((F.col(list_col) != local) | (F.col("__n") <= F.col("__cap"))).drop("__cap")
    turn = W.partitionBy(*group).orderBy("__n", F.when(F.col(list_col) == first, 0).otherwise(1))
    return ranked.withColumn("rank", F.row_number().over(turn)).filter(F.col("rank") <= k).drop("__n")


def cap_label(df: DataFrame, group: list[str], label: Column, order: list[Column], most: int) -> DataFrame:
    """At most most rows with label in each group; other rows untouched."""
    marked = df.withColumn("__capped", F.coalesce(label, F.lit(False)))
    return marked.withColumn("__n", F.row_number().over(W.partitionBy(*group, "__capped").orderBy(*order))).filter(~F.col("__capped") | (F.col("__n") <= most)).drop("__n", "__capped")


def keep_best(df: DataFrame, group: list[str], score: str, applies: Column) -> DataFrame:
    """Where a row that applies scores above 0: only those at the group's best such score; else all rows."""
    best = F.max(F.when(applies, F.col(score))).over(W.partitionBy(*group))
    return df.withColumn("__best", F.coalesce(best, F.lit(0.0))).filter((F.col("__best") <= 0) | (applies & (F.col(score) == F.col("__best")))).drop("__best")


def siblings(df: DataFrame, key: str, ids: str, same: list[str]) -> DataFrame:
    """(key, sibling): other rows with the same set of ids and equal same columns."""
    sets = df.filter(F.size(ids) > 0).select(key, *same, F.sort_array(F.array_distinct(ids)).alias("__ids"))
    other = sets.select(F.col(key).alias("sibling"), *same, "__ids")
    return sets.join(other, ["__ids", *same]).filter(F.col(key) != F.col("sibling")).select(key, "sibling")


def representative(df: DataFrame, group: str, order: list[Column], salt: str = "") -> DataFrame:
    """The row of each group that a hash of the group's name picks."""
    here = W.partitionBy(group)
    numbered = df.withColumn("__n", F.row_number().over(here.orderBy(*order)) - 1).withColumn("__size", F.count("*").over(here))
    return numbered.filter(F.col("__n") == hash_mod(F.col(group).cast("string"), F.col("__size"), salt)).drop("__n", "__size")


def hash_order(text: Column, salt: str = "") -> Column:
    """A key that shuffles: the same for everyone who knows the salt."""
    return F.sha2(F.concat(F.lit(salt), text), 256)


def stratified_split(df: DataFrame, stratum: str, key: str, share: float, salt: str) -> DataFrame:
    """df with chosen: of each stratum the first round(share * n) rows in the order of a salted hash."""
    here = W.partitionBy(stratum)
    place = F.row_number().over(here.orderBy(hash_order(F.col(key).cast("string"), salt), key))
    return df.withColumn("__n", F.count("*").over(here)).withColumn("chosen", place <= F.round(F.col("__n") * share)).drop("__n")


#: Candidates of a group that one round looks at; facets of all groups' candidates together, shared evenly, and what a group gets at least.
CANDIDATES, CANDIDATE_FACETS, LEAST_FACETS = 20_000, 4_000_000, 1000
#: Rows that add nothing are numbered in ranges of about so many.
RANGE_ROWS = 500_000


def diverse_order(df: DataFrame, group: list[str], facets: str, score: str, second: str, key: str) -> DataFrame:
    """df with position: each place goes to the row that adds most new facets; ties by score, second and key, all descending. Rows are known by group and key.

    What a row adds never grows, so figures from before a round bound those after it. A round takes each
    group's best candidates and places them one by one, as long as the best left beats every row that
    isn't a candidate. Then all rows lose the facets placed since, where they are. A group of any size so
    brings CANDIDATES rows and its share of CANDIDATE_FACETS at most to a task, and the facets placed in a
    round, 8 bytes each, travel to all; rows that add nothing are only sorted.
    """
    fields = {f.name: f for f in df.schema}
    kinds = {c: fields[c].dataType.simpleString() for c in (*group, key)}
    names = F.array_sort(F.array_distinct(F.transform(F.coalesce(facets, F.array().cast(fields[facets].dataType)), lambda x: F.xxhash64(x))))
    group_id = F.xxhash64(*group)
    rows = kept(df.select(*group, F.col(key).alias("__key"), F.col(score).cast("double").alias("__score"), F.col(second).cast("double").alias("__second"), names.alias("__new"), group_id.alias("__group")), "rows")
    head, placed, offset = [*group, "__key"], [], 0
    here = W.partitionBy("__group")

    def place(table: pd.DataFrame) -> pd.DataFrame:
        """Rows in order of merit; those that aren't candidates are cut off but for the first, which the others have to beat."""
        bar = None if table["__last"].iloc[-1] else len(table) - 1
        n = len(table) if bar is None else bar
        sizes = table["__new"].map(len).to_numpy()
        ends = np.cumsum(sizes)
        flat = np.concatenate([np.asarray(x, np.int64) for x in table["__new"]]) if ends[-1] else np.zeros(0, np.int64)
        found, numbers = np.unique(flat, return_inverse=True)
        fresh, out = np.ones(len(found), bool), []
        tie = {i: r for r, i in enumerate(sorted(range(len(table)), key=lambda i: (table["__score"].iat[i], table["__second"].iat[i], table["__key"].iat[i]), reverse=True))}
        heap = [(-int(sizes[i]), tie[i], i) for i in range(n)]
        heapq.heapify(heap)
        limit = None if bar is None else (-int(sizes[bar]), tie[bar])
        while heap:
            gain, order, i = heap[0]
            own = numbers[ends[i] - sizes[i] : ends[i]]
            adds = -int(np.count_nonzero(fresh[own]))
            if adds > gain:
                heapq.heapreplace(heap, (adds, order, i))
                continue
            if adds == 0 or (limit is not None and (adds, order) > limit):
                break
            heapq.heappop(heap)
            fresh[own] = False
            out.append(i)
        chosen = table.iloc[out]
        return chosen[[*head, "__group"]].assign(__at=range(1, len(out) + 1), __new=list(chosen["__new"]))

    def without(sent):
        def run(batches):
            for batch in batches:
                table = batch.to_pandas()
                out = []
                for g, new in zip(table["__group"], table["__new"], strict=True):
                    gone, new = sent.value.get(g), np.asarray(new, np.int64)
                    out.append(new if gone is None or not len(new) else new[gone[np.minimum(np.searchsorted(gone, new), len(gone) - 1)] != new])
                yield pa.RecordBatch.from_arrays([pa.array(out, pa.list_(pa.int64())) if name == "__new" else batch.column(i) for i, name in enumerate(batch.schema.names)], batch.schema.names)

        return run

    schema = ", ".join([*(f"{c} {kinds[c]}" for c in group), f"__key {kinds[key]}, __group long, __at int, __new array<long>"])
    starts: dict[int, int] = {}
    most = max(LEAST_FACETS, CANDIDATE_FACETS // max(1, rows.select("__group").distinct().count()))
    while rows.filter(F.size("__new") > 0).head(1):
        # who the candidates are is settled without their facets, which then come from where the rows are
        slim = rows.filter(F.size("__new") > 0).select("__group", "__key", "__score", "__second", F.size("__new").alias("__size"))
        merit = [F.desc("__size"), F.desc("__score"), F.desc("__second"), F.desc("__key")]
        ranked = slim.withColumn("__n", F.row_number().over(here.orderBy(*merit))).filter(F.col("__n") <= CANDIDATES + 1)
        upto = F.sum("__size").over(here.orderBy("__n").rowsBetween(W.unboundedPreceding, W.currentRow))
        some = ranked.withColumn("__upto", upto).withColumn("__in", (F.col("__n") == 1) | ((F.col("__n") <= CANDIDATES) & (F.col("__upto") <= most)))
        edge = F.max(F.when(F.col("__in"), F.col("__n"))).over(here) + 1  # the first that is no candidate
        some = some.withColumn("__edge", edge).withColumn("__last", F.max("__n").over(here) < F.col("__edge")).filter(F.col("__n") <= F.col("__edge"))
        some = rows.join(F.broadcast(some.select("__group", "__key", "__n", "__last")), ["__group", "__key"])  # as many rows as their facets at most
        turn = kept(some.groupBy("__group").applyInPandas(lambda t: place(t.sort_values("__n", ignore_index=True)), schema), "turn")
        counts = {r["__group"]: r["n"] for r in turn.groupBy("__group").agg(F.count("*").alias("n")).collect()}  # a row a group
        before = F.coalesce(F.element_at(F.create_map(*(F.lit(x) for kv in starts.items() for x in kv)), F.col("__group")), F.lit(0)) if starts else F.lit(0)
        placed.append(turn.select(*head, (F.col("__at") + before).alias("position")))
        starts = starts | {g: starts.get(g, 0) + n for g, n in counts.items()}
        gone = turn.select("__group", F.explode("__new").alias("f")).distinct().sort("__group", "f").toArrow()
        of, found = gone.column("__group").to_numpy(), gone.column("f").to_numpy()
        ends = np.append(np.flatnonzero(of[1:] != of[:-1]) + 1, len(of)) if len(of) else np.zeros(0, np.int64)
        sent = rows.sparkSession.sparkContext.broadcast({int(of[a]): found[a:b] for a, b in zip(np.append(0, ends[:-1]), ends, strict=True)})
        left = rows.join(F.broadcast(turn.select("__group", "__key")), ["__group", "__key"], "left_anti").select(*rows.columns)
        before_turn, rows = rows, kept(left.mapInArrow(without(sent), rows.schema), "rows")
        release(before_turn)
    before = F.coalesce(F.element_at(F.create_map(*(F.lit(x) for kv in starts.items() for x in kv)), F.col("__group")), F.lit(0)) if starts else F.lit(0)
    order = [F.asc("__group"), F.desc("__score"), F.desc("__second"), F.desc("__key")]
    n = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), rows.count() // RANGE_ROWS)
    ranged = kept(rows.drop("__new").repartitionByRange(n, *order).withColumn("__range", F.spark_partition_id()), "ranged")
    sizes = ranged.groupBy("__group", "__range").agg(F.count("*").alias("__size"))
    sizes = sizes.select("__group", "__range", (F.sum("__size").over(here.orderBy("__range")) - F.col("__size")).alias("__start"))
    within = F.row_number().over(W.partitionBy("__group", "__range").orderBy(*order[1:]))
    placed.append(ranged.withColumn("__within", within).join(sizes, ["__group", "__range"]).select(*head, (F.col("__start") + F.col("__within") + before).cast("int").alias("position")))
    places = placed[0]
    for more in placed[1:]:
        places = places.unionByName(more)
    return df.join(places.withColumnRenamed("__key", key), [*group, key])


def set_cover(df: DataFrame, group: list[str], covers: str, value: str, key: str, k: int) -> DataFrame:
    """Of each group up to k rows whose covers, arrays of small numbers from 0, reach most of them: then fewest rows, highest total value, and the keys highest in order.

    A table of the best choice for each reached set of numbers, one row after the other; a row of the result has its place.
    Of rows that cover the same, a best choice takes only the first by value and key, so the others aren't gathered.
    """
    schema = T.StructType([*df.schema, T.StructField("place", T.IntegerType())])

    def choose(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values([value, key], ascending=[False, False], ignore_index=True)
        masks = [sum(1 << int(x) for x in set(c)) if c is not None else 0 for c in rows[covers]]
        best: dict[int, tuple[int, ...]] = {0: ()}

        def merit(chosen: tuple[int, ...]) -> tuple:
            return (-len(chosen), sum(rows[value][i] for i in chosen), tuple(rows[key][i] for i in chosen))

        for i, mask in enumerate(masks):
            for reached, chosen in list(best.items()):
                if len(chosen) < k and reached | mask != reached:
                    now = (*chosen, i)
                    if reached | mask not in best or merit(now) > merit(best[reached | mask]):
                        best[reached | mask] = now
        most = max(best, key=lambda m: (m.bit_count(), merit(best[m])))
        return rows.iloc[list(best[most])].assign(place=range(1, len(best[most]) + 1))

    same = F.sort_array(F.array_distinct(F.coalesce(covers, F.array().cast(df.schema[covers].dataType))))
    firsts = keep_first(df.withColumn("__same", same), [*group, "__same"], [F.desc(value), F.desc(key)]).drop("__same")
    return firsts.groupBy(*group).applyInPandas(choose, schema)


def guidance_score(text: Column, ranges: Column, facets: dict[str, tuple[str, ...]], actions: tuple[str, ...], strong: tuple[str, ...], negative: tuple[str, ...]) -> Column:
    """How practical a text is: 4 a facet named in a clause with an action, 2 an action (4 at most), 3 a strong term, 1 a repeated range (3 at most), less 6 a negative term; 0 without facet or action."""
    low = F.lower(text)
    clauses = F.filter(F.split(low, r"[.!?。！？;；\r\n]+"), lambda c: F.trim(c) != "")

    def has(clause: Column, terms: tuple[str, ...]) -> Column:
        return F.exists(F.array(*map(F.lit, terms)), lambda t: F.contains(clause, t))

    active = F.filter(clauses, lambda c: has(c, actions))

    def named(terms: tuple[str, ...]) -> Column:
        return F.exists(active, lambda c: has(c, terms)).cast("int")

    def count(terms: tuple[str, ...]) -> Column:
        return sum((F.contains(low, F.lit(t)).cast("int") for t in terms), F.lit(0))

    n_facets = sum((named(terms) for terms in facets.values()), F.lit(0))
    n_actions = sum((named((t,)) for t in actions), F.lit(0))
    repeats = F.least(F.lit(3), F.greatest(F.lit(0), F.coalesce(F.size(ranges), F.lit(0)) - 1))
    total = 4.0 * n_facets + 2.0 * F.least(F.lit(4), n_actions) + 3.0 * count(strong) + repeats - 6.0 * count(negative)
    return F.when((n_facets > 0) & (n_actions > 0), F.greatest(F.lit(0.0), total)).otherwise(0.0)
