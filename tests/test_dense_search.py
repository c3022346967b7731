"""Block-wise dense search against all pairs: ties, sides, parts, limits; and what a task holds."""

import numpy as np
import pytest

from tessera.operators import dense, pivots
from tessera.plans import retrieval_queries, review_queries
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def vectors():
    draw = np.random.default_rng(3)
    few = draw.normal(size=(40, 6))
    return [(i, few[i % 40 if i % 7 else 0].tolist(), None if i % 11 == 0 else i % 4) for i in range(500)]  # copies of 40 vectors, one very frequent


@pytest.fixture(scope="module")
def tables(spark, vectors):
    docs = spark.createDataFrame(vectors, "id long, v array<double>, label int").repartition(3)
    return docs.filter("id % 50 = 0").select(F.col("id").alias("q"), "v", F.col("label").alias("mine")), docs


@pytest.fixture(scope="module")
def pairs(vectors):
    unit = dense.units(np.array([v for _, v, _ in vectors]))
    scores = np.round(unit @ unit.T, 6)
    return [(q, i, float(scores[q, i]) + 0.0, vectors[q][2], vectors[i][2]) for q in range(0, 500, 50) for i in range(500) if i != q]


def firsts(pairs, k):
    out = []
    for q in range(0, 500, 50):
        out += [(q, i, s, n) for n, (q, i, s, *_) in enumerate(sorted((p for p in pairs if p[0] == q), key=lambda p: (-p[2], p[1]))[:k], 1)]
    return out


@pytest.mark.parametrize("rows", [7, 1024])
def test_nearest_equals_all_pairs(tables, pairs, monkeypatch, rows):
    monkeypatch.setattr(dense, "ROWS", rows)
    monkeypatch.setattr(dense, "SET_QUERIES", 3)
    queries, docs = tables
    ask = lambda **by: sorted((r["q"], r["id"], r["score"], r["rank"], r[4 - 1]) for r in dense.nearest(queries, docs, "q", "id", "v", "v", 6, **by).collect())
    assert [x[:4] for x in ask()] == sorted(firsts(pairs, 6))
    sides = ask(query_side="mine", side="label")
    assert [x[:4] for x in sides if x[4] == dense.SAME] == sorted(firsts([p for p in pairs if p[3] is not None and p[3] == p[4]], 6))
    assert [x[:4] for x in sides if x[4] == dense.OTHER] == sorted(firsts([p for p in pairs if None not in p[3:] and p[3] != p[4]], 6))
    parts = dense.nearest(queries, docs, "q", "id", "v", "v", 6, part="label").collect()
    for label in (None, 0, 1, 2, 3):
        assert sorted((r["q"], r["id"], r["score"], r["rank"]) for r in parts if r["label"] == label) == sorted(firsts([p for p in pairs if p[4] == label], 6))


def test_within_equals_all_pairs(tables, pairs):
    queries, docs = tables
    got = dense.within(queries, docs, "q", "id", "v", "v", F.lit(0.8), F.lit(0.1), query_side="mine", side="label").collect()
    assert sorted(map(tuple, got)) == sorted(p[:3] for p in pairs if p[2] >= 0.8 or p[2] >= 0.1 and p[3] is not None and p[3] == p[4])


def test_a_vector_of_zeros_is_an_error(spark, tables):
    queries, docs = tables
    with pytest.raises(Exception, match="no direction"):
        dense.nearest(queries, docs.unionByName(spark.createDataFrame([(900, [0.0] * 6, 1)], docs.schema)), "q", "id", "v", "v", 2).collect()


def test_leaders_hold_k_rows_a_query_however_many_tie():
    leaders = dense.Leaders(5, 3)
    for lo in range(900, -1, -100):
        leaders.offer(np.ones((5, 100)), np.arange(lo, lo + 100))
        assert len(leaders.held[0]) == 15
    assert leaders.held[2].tolist() == [0, 1, 2] * 5


def test_a_task_of_the_pivot_search_gives_k_rows_a_query(spark, tables):
    queries, docs = tables
    table, points = pivots.grouped(docs, "id", "v")
    groups = np.array(sorted(r["group"] for r in table.select("group").distinct().collect()))
    asked = queries.collect()
    visits = np.ones((len(asked), len(groups)), bool)
    out = pivots._visited(table, groups, dense.units(np.array([r["v"] for r in asked])), [r["q"] for r in asked], visits, "bigint", 4, 6, False)
    assert out.count() <= table.rdd.getNumPartitions() * len(asked) * 4


@pytest.mark.parametrize("query", [retrieval_queries.budgeted_rank_conditions, retrieval_queries.near_tie_band, retrieval_queries.supported_tie_band, retrieval_queries.dense_margin_supplement, retrieval_queries.gold_recall_rollup, retrieval_queries.confidence_margin_gate, review_queries.unit_recall_coverage, review_queries.retrieval_diagnostics])
def test_no_query_builds_rows_of_all_pairs(spark, query):
    plan = query(spark, SF)._jdf.queryExecution().toString()
    assert "NestedLoopJoin" not in plan and "CartesianProduct" not in plan
