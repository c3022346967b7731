"""Percentiles, interval joins and set containment that don't rest on small groups, short intervals or rare ids."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import intervals, lineage, metrics


@pytest.mark.parametrize(("cuts", "few"), [(1024, 100_000), (4, 10)])
def test_percentiles_of_groups_of_any_size(spark, monkeypatch, cuts, few):
    monkeypatch.setattr(metrics, "CUTS", cuts)
    monkeypatch.setattr(metrics, "FEW", few)
    draw = random.Random(4)
    groups = {
        "one": [3.5], "two": [1.0, 2.0], "same": [7.0] * 50, "wide": [draw.choice([-1, 1]) * 10 ** draw.uniform(-9, 9) for _ in range(300)], "ties": [float(draw.randint(0, 5)) for _ in range(200)],
        "skew": [0.0] * 100 + [1e15, 5.0, 5.0, math.nextafter(5.0, 6.0)], "near": [1.0 + k * 2**-50 for k in range(40)],
    }
    rows = [(g, v) for g, values in groups.items() for v in values] + [("one", None), ("none", None)]
    df = spark.createDataFrame(rows, "g string, v double").repartition(4)
    shares = {"a": ("linear", 0.5), "b": ("linear", 0.95), "c": ("lower", 0.9), "d": ("nearest", 0.95), "e": ("linear", 0.0), "f": ("nearest", 1.0)}
    got = {r["g"]: r for r in metrics.percentiles(df, ["g"], "v", shares).collect()}
    assert set(got) == set(groups)
    for g, values in groups.items():
        values, n, r = sorted(values), len(values), got[g]
        exact = [values[int((n - 1) * 0.9)], values[math.ceil(0.95 * n) - 1], values[0], values[-1]]
        assert [r[c] for c in "cdef"] == exact, g
        assert [r["a"], r["b"]] == pytest.approx([np.percentile(values, 50), np.percentile(values, 95)], rel=1e-12), g


def test_intervals_of_all_lengths_meet_once(spark):
    draw = random.Random(6)
    make = lambda n, first: [(first + i, draw.choice("xy"), s := draw.randint(-2000, 10**6), s + int(10 ** draw.uniform(0, 6)) - 1) for i in range(n)]
    a, b = [*make(200, 0), (900, "x", 5, 5), (901, "y", -10**9, 10**9), (902, "x", 9, 3)], [*make(200, 0), (900, "x", 5, 5), (901, "y", 6, 6), (902, "x", None, 3)]
    left, right = spark.createDataFrame(a, "i long, g string, s long, e long"), spark.createDataFrame(b, "j long, g string, s2 long, e2 long")
    got = sorted((r["i"], r["j"]) for r in intervals.join_any_length(left, right, "s", "e", "s2", "e2", ["g"]).collect())
    wanted = sorted((i, j) for i, g, s, e in a for j, h, t, f in b if g == h and t is not None and s <= e and t <= f and s <= f and t <= e)
    assert got == wanted and len(got) > 500
    assert intervals.join_any_length(left.limit(0), right, "s", "e", "s2", "e2", ["g"]).count() == 0
    level = left.filter("i = 901").select(intervals._level("s", "e").alias("x")).first()["x"]
    assert level == 31


def test_sets_meet_on_their_rarest_id(spark):
    draw = random.Random(8)
    ids = [f"a{i}" for i in range(12)]
    some = lambda k: ["all", *draw.sample(ids, draw.randint(0, k))]
    asked = [(i, draw.sample(some(3), 1) + some(2)) for i in range(60)] + [(100, []), (101, None), (102, ["missing", "all"]), (103, ["all", "all", None])]
    held = [(i, some(6)) for i in range(80)] + [(200, None), (201, []), (202, [None])]
    got = {r["i"]: r["matches"] for r in lineage.resolve_overrides(spark.createDataFrame(asked, "i long, w array<string>"), spark.createDataFrame(held, "r long, ids array<string>"), "i", "r", "w", "ids").collect()}
    assert got == {i: sum(set(filter(None, w or ())) <= set(h or ()) for _, h in held) for i, w in asked}


@pytest.mark.parametrize(("candidates", "facets"), [(20_000, 2_000_000), (3, 2_000_000), (50, 12)])
def test_the_greedy_order_is_the_step_by_step_one(spark, monkeypatch, candidates, facets):
    from tessera.operators import selection

    monkeypatch.setattr(selection, "CANDIDATES", candidates)
    monkeypatch.setattr(selection, "CANDIDATE_FACETS", facets)
    monkeypatch.setattr(selection, "LEAST_FACETS", 4)
    draw = random.Random(5)
    rows = [(g, f"k{i:02}", sorted(draw.sample(range(25), draw.randint(0, 6))) if i % 9 else None, float(draw.randint(0, 3)), float(draw.randint(0, 2))) for g in "ab" for i in range(24)] + [("c", "k", [], 1.0, 1.0)]
    wanted = {}
    for g in "abc":
        left, seen, n = [r for r in rows if r[0] == g], set(), 0
        while left:
            best = max(left, key=lambda r: (len(set(r[2] or ()) - seen), r[3], r[4], r[1]))
            left.remove(best)
            seen |= set(best[2] or ())
            n += 1
            wanted[g, best[1]] = n
    df = spark.createDataFrame(rows, "g string, k string, f array<int>, s double, t double").repartition(3)
    got = selection.diverse_order(df, ["g"], "f", "s", "t", "k")
    assert {(r["g"], r["k"]): r["position"] for r in got.collect()} == wanted and got.columns == [*df.columns, "position"] or set(got.columns) == {*df.columns, "position"}
    assert selection.diverse_order(df.limit(0), ["g"], "f", "s", "t", "k").count() == 0
