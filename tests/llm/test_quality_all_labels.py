"""The quality model learns from every labelled document, however many there are."""

import numpy as np
import pytest

from tessera.llm import quality_rank


def table(spark, n):
    draw = np.random.default_rng(1)
    rows, labels = [], []
    for i in range(n):
        good = i % 5 > 0
        words = ["".join(draw.choice(list("abcdefgh"), 5)) for _ in range(int(draw.integers(12, 30)))] if good else ["$$$!!"] * int(draw.integers(3, 30))
        rows.append((i, " ".join(words)))
        labels.append((i, int(good)))
    return rows, labels


@pytest.mark.parametrize("group", [40, 4000])
def test_each_label_counts(spark, group):
    rows, labels = table(spark, 300)
    docs, known = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int")
    model = quality_rank.train(docs, known, group=group)
    again = quality_rank.train(docs.repartition(5), known.repartition(3), group=group)
    assert (model.weights == again.weights).all() and model.cut == again.cut
    score = {r["doc_id"]: r["predicted"] for r in quality_rank.rank(docs, model).collect()}
    assert np.mean([score[i] == q for i, q in labels]) > 0.97
    # a single document of other figures than all the rest moves the model: nothing is left out
    odd = (1000, "a|b|c|d " * 40)
    moved = quality_rank.train(docs.unionByName(spark.createDataFrame([odd], docs.schema)), known.unionByName(spark.createDataFrame([(1000, 0)], known.schema)), group=group)
    assert (moved.centre != model.centre).any() and (moved.weights != model.weights).any()


def test_more_labels_than_any_sample_and_copies_are_weighed(spark):
    rows, labels = table(spark, 60)
    docs, known = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int")
    many = docs.selectExpr("explode(sequence(0, 99)) AS k", "doc_id", "text").selectExpr("doc_id + 1000 * k AS doc_id", "text")
    lots = known.selectExpr("explode(sequence(0, 99)) AS k", "doc_id", "quality").selectExpr("doc_id + 1000 * k AS doc_id", "quality")
    one, hundred = quality_rank.train(docs, known), quality_rank.train(many, lots)  # 6000 labels: the sample had 4000 at most
    assert np.allclose(one.centre, hundred.centre, atol=1e-12) and np.allclose(one.weights, hundred.weights, atol=1e-6)
