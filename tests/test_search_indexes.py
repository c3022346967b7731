"""The stored postings and the pivot groups against scoring everything."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.functions import text as X
from tessera.operators import lexical, pivots, postings, ranking
from tessera.session import scratch


@pytest.fixture(scope="module")
def corpus(spark):
    draw = random.Random(7)
    word = lambda letter, i: letter + chr(97 + i // 26) + chr(97 + i % 26)
    one, two = [word("a", i) for i in range(60)], [word("b", i) for i in range(60)]
    texts = [" ".join(draw.choices(words, [1 / (i + 1) for i in range(60)], k=draw.randint(0, 60))) for words in (one, two) for _ in range(300)]
    docs = spark.createDataFrame([*enumerate(texts), (900, None), (901, ""), (902, texts[5])], "id long, text string").repartition(3)
    asked = spark.createDataFrame([(1, "aab aah aau aah"), (2, "bac bad bbo bbp bbq"), (3, "nothing here"), (4, None), (5, "aaa baa ach")], "q int, text string")
    return docs, asked


@pytest.mark.parametrize(("block", "first"), [(1024, 4), (40, 2)])
def test_postings_find_what_scoring_everything_finds(spark, corpus, monkeypatch, block, first):
    docs, asked = corpus
    monkeypatch.setattr(postings, "BLOCK", block)
    path = scratch(spark, "index")
    postings.store(docs, "id", X.tokens(F.col("text")), path)
    index = postings.load(spark, path)
    assert (index.n, index.terms.count()) == (603, 120)
    best, visited = postings.search(index, asked, "q", X.tokens(F.col("text")), 7, 6, first)
    every = lexical.score_queries(docs, "id", X.tokens(F.col("text")), asked, "q", X.tokens(F.col("text"))).withColumn("score", F.round("score", 6))
    wanted = ranking.top_k(every, ["q"], [F.desc("score"), F.col("id")], 7)
    rows = lambda df: sorted((r["q"], r["rank"], r["id"], round(r["score"], 5)) for r in df.collect())
    assert rows(best) == rows(wanted) and len(rows(best)) == 21
    if block == 40:
        pairs = index.lists.select("block").distinct().count() * 3
        assert visited.count() < 0.7 * pairs
    lists = index.lists.groupBy("term", "block").agg(F.count("*").alias("n"), F.max(F.size("docs")).alias("most"), F.max("top").alias("top"), F.first("docs").alias("docs"))
    assert lists.filter("n > 1").count() == 0
    mean = docs.agg(F.avg(F.size(F.coalesce(X.tokens(F.col("text")), F.array())))).first()[0]
    low = lists.select("top", F.array_max(F.transform("docs", lambda d: lexical.weight(d["tf"], d["dl"], F.lit(index.mean)))).alias("w"))
    assert low.filter(F.abs(F.col("top") - F.col("w")) > 1e-12).count() == 0 and index.mean == pytest.approx(mean)


def test_postings_of_an_empty_table(spark, corpus):
    docs, asked = corpus
    index = postings.store(docs.limit(0), "id", X.tokens(F.col("text")), scratch(spark, "index"))
    assert postings.search(index, asked, "q", X.tokens(F.col("text")), 3)[0].count() == 0


def all_pairs(vectors, asked, k, itself):
    held = pivots.units(np.array([v for _, v in vectors]))
    out = []
    for q, v in asked:
        scores = np.round(held @ pivots.units(np.array([v]))[0], 6)
        rows = sorted((-s, i) for s, (i, _) in zip(scores.tolist(), vectors, strict=True) if itself or i != q)[:k]
        out += [(q, n, i, -s + 0.0) for n, (s, i) in enumerate(rows, 1)]
    return sorted(out)


@pytest.mark.parametrize("itself", [False, True])
def test_nearest_equals_all_pairs_and_leaves_groups_out(spark, itself):
    random_ = np.random.default_rng(4)
    centres = random_.normal(size=(12, 8))
    vectors = [(i, (centres[i % 12] + 0.1 * random_.normal(size=8)).tolist()) for i in range(600)] + [(700, [0.0] * 8), (701, (-centres[0]).tolist()), (702, centres[1].tolist()), (703, centres[1].tolist())]
    asked = [(i, v) for i, v in vectors if i % 50 == 0 or i == 702]
    docs = spark.createDataFrame([*vectors, (999, None)], "id long, v array<double>").repartition(3)
    queries = spark.createDataFrame([*asked, (998, None)], "q long, v array<double>")
    best, pairs = pivots.nearest(queries, docs, "q", "id", "v", "v", 5, itself=itself)
    got = sorted((r["q"], r["rank"], r["id"], r["score"] + 0.0) for r in best.collect())
    assert got == all_pairs(vectors, asked, 5, itself)
    assert pairs["all"] == len(asked) * len(vectors) and pairs["computed"] < 0.5 * pairs["all"]
    assert pivots.nearest(queries, docs.limit(0), "q", "id", "v", "v", 5)[0].count() == 0 == pivots.nearest(queries.limit(0), docs, "q", "id", "v", "v", 5)[0].count()


def test_bounds_hold_for_every_vector():
    random_ = np.random.default_rng(2)
    vectors, some = pivots.units(random_.normal(size=(400, 5))), pivots.units(random_.normal(size=(9, 5)))
    near = vectors @ some.T
    group = near.argmax(axis=1)
    least, most = (np.array([f(near[group == g, g]) for g in range(9)]) for f in (np.min, np.max))
    queries = pivots.units(random_.normal(size=(50, 5)))
    bound = pivots.bounds(queries, some, least, most)
    assert all((queries @ vectors[group == g].T).max() <= bound[:, g].max() + 1e-9 for g in range(9)) and ((queries @ vectors.T) <= bound[:, group] + 1e-9).all()
