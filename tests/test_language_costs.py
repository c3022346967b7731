"""Rules of language without work that is repeated for each word, and the same results as plain definitions."""

from __future__ import annotations

import random
import re

from pyspark.sql import functions as F

from tessera import guidance
from tessera.functions import text as X
from tessera.operators import questions
from tessera.plans import catalog

DATA = "/root/testdata/sf0.001"


def plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def made_up(spark, n=300):
    draw = random.Random(5)
    parts = [*guidance.ALL_TERMS, *guidance.SUBJECT_TERMS, *guidance.ADVICE_TERMS, *guidance.WHOLE_PIECE_TERMS, *questions.RELATION_ROOTS, "음", "2마디부터", "4마디", "measures 2-3", "은", "하나요", "x"]
    rows = [(k, "".join(draw.choice(parts) + draw.choice(("", " ")) for _ in range(draw.randint(0, 9)))) for k in range(n)]
    return rows, spark.createDataFrame(rows, "k int, q string").withColumn("w", F.split("q", " "))


def test_token_forms_are_looked_up_once_a_token(spark):
    assert plan(catalog.queries()["token_rules"](spark, DATA)).count("element_at(") <= 4


def test_broad_questions_hold_no_word_against_each_term(spark):
    assert "startswith(" not in plan(catalog.queries()["broad_question_rules"](spark, DATA)).lower()


def test_terms_and_prefixes_are_those_of_plain_definitions(spark):
    rows, df = made_up(spark)
    got = df.select("k", guidance.asked_terms(F.col("q")).alias("t"), guidance.asked_facets(F.col("q")).alias("f"), questions.relations(F.col("w")).alias("r"), F.filter("w", lambda c: X.begins_either_way(c, guidance.ALL_TERMS)).alias("b")).collect()
    either = lambda c, terms: any(c.startswith(t) or t.startswith(c) for t in terms)
    for r in got:
        q = rows[r["k"]][1]
        assert r["t"] == [t for t in guidance.ALL_TERMS if t in q.lower()]
        assert r["f"] == [name for name, terms in guidance.FACETS.items() if any(t in q.lower() for t in terms)]
        assert r["r"] == [c for c in q.split(" ") if either(c, questions.RELATION_ROOTS)]
        assert r["b"] == [c for c in q.split(" ") if either(c, guidance.ALL_TERMS)]


def test_texts_without_a_unit_run_no_pass(spark, monkeypatch):
    class Never(dict):
        def __getitem__(self, pattern):
            assert pattern == questions.UNIT
            return re.compile(pattern)

    monkeypatch.setattr(questions, "_COMPILED", Never())
    assert questions.mentioned_ranges("3 to 4 그리고 첫 17") == []


def test_concepts_hold_no_word_against_each_root_and_compile_no_pattern_a_text(spark):
    shown = plan(catalog.queries()["concept_rules"](spark, DATA)).lower()
    assert "exists(" not in shown


def test_pieces_are_counted_without_a_shuffle_of_pieces(spark):
    df = catalog.queries()["char_ngram_variants"](spark, DATA)
    shown = df._jdf.queryExecution().executedPlan().toString()
    assert shown.count("Exchange hashpartitioning") + shown.count("Exchange (") + shown.count("Exchange RoundRobin") == 1 and not re.search(r"hashpartitioning\(doc_id#\d+L?, gram", shown)


def test_pieces_of_a_text_are_those_of_its_tokens(spark):
    texts = ["", "ab abc 12 123x45é", "가나다라 가나 é1éa 나a", "\U0001d400abcd\U0001d401 ab-cde", "X", None]
    df = spark.createDataFrame(list(enumerate(texts)), "k int, t string")
    for r in df.select("k", X.token_grams(F.col("t"), (2, 3)).alias("g")).collect():
        t = texts[r["k"]]
        if t is not None:
            tokens = re.findall(X.TOKEN, t.lower())
            assert r["g"] == [w[i : i + n] for n in (2, 3) for w in tokens if len(w) > n for i in range(len(w) - n + 1)]
