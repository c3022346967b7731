"""What a table of requests looks at of every record."""

import random
import re

from pyspark.sql import functions as F

from tessera import batch, corpus
from tessera.functions import text as X
from tessera.operators import questions


def test_texts_without_hangul_have_the_tokens_and_concepts_of_the_rules(spark):
    draw = random.Random(4)
    parts = ["a", "p", "F", "ab", "Été", "7", "17", "ß", "x1", "-", " ", "\n", "音", "ÿp", "The"]
    texts = ["", None, *("".join(draw.choices(parts, k=draw.randint(1, 12))) for _ in range(300))]
    df = spark.createDataFrame(list(enumerate(texts)), "k int, t string")
    got = df.select("t", X.document_tokens(F.col("t")).alias("d"), questions.concepts(F.col("t")).alias("c"), questions.concepts(F.col("t"), stop=("the",)).alias("s")).collect()
    for r in got:
        if r["t"] is not None:
            tokens = [t for t in re.findall(X.TOKEN, r["t"].lower()) if len(t) > 1 or re.fullmatch("[0-9]", t) or t in X.KEPT_LETTERS]
            distinct = list(dict.fromkeys(tokens))
            assert (r["d"], r["c"], r["s"]) == (tokens, distinct, [c for c in distinct if c != "the"])
        else:
            assert r["d"] is None and r["c"] is None


def test_requests_meet_records_by_several_concepts_and_nothing_else_is_computed_of_the_others(spark, monkeypatch):
    texts = [f"{('alpha', 'beta', 'gamma')[i % 3]} common {('delta', 'omega')[i % 2]}" for i in range(60)] + ["beta something"] * 5
    rows = [(f"r{i:02}", "expert_annotation", "p", "t", None, text, None, None, None, [], "whole_piece", "global") for i, text in enumerate(texts)]
    records = batch.completed(corpus.texts(spark.createDataFrame(rows, corpus.RECORD)))
    asked = batch.understood(spark.createDataFrame([("q", "beta omega common", None, None, None, 5, None)], batch.REQUEST))
    looked = batch.looked_at(records)
    assert looked.columns == ["id", "__dl", "__terms", "__known"]
    pairs = sorted(r["id"] for r in batch.met(records, looked, asked).collect())
    assert pairs == [f"r{i:02}" for i in range(60) if i % 3 == 1 and i % 2 == 1]  # not all 25 with beta
    held, tables = batch.kept, {}

    def noted(df, name):
        tables[name] = held(df, name)
        return tables[name]

    monkeypatch.setattr(batch, "kept", noted)
    assert batch.scored(records, asked).count() == 10
    assert tables["found"].count() == 10
