"""The table of requests against one request at a time."""

import random

import pytest
from pyspark.sql import functions as F

from tessera import batch, corpus, guidance, retrieve
from tests.test_retrieve_and_corpus import brute_broad

WORDS = ["brook", "tempo", "trout", "breathe", "moderate", "light", "phrase", "accent", "vowel", "rhythm", "singer", "breath", "tempos"]


@pytest.fixture(scope="module")
def records(spark):
    draw = random.Random(3)
    rows = []
    for i in range(60):
        text = " ".join(draw.choices(WORDS, k=draw.randint(2, 9)))
        kind = draw.choice(["expert_annotation", "web_database", "sumijo_feedback", "web_coaching"])
        ranges = [] if draw.random() < 0.5 else [(a := draw.randint(1, 9), a + draw.randint(0, 4))]
        status = None if kind.startswith("web") else "specific" if ranges else "whole_piece"
        rows.append((f"r{i:02}", kind, draw.choice("pq"), draw.choice(["tempo", "breath"]), None, text, None, [text.split()[0] + " " + text.split()[1]] if i % 7 == 0 else None, [f"s{i % 5}"], ranges, status, "local" if ranges else "global"))
    rows += [
        ("g1", "expert_annotation", "k", "t", None, "밝은 음색으로 노래해야 한다.", None, None, ["s1"], [], "whole_piece", "global"), ("g2", "expert_annotation", "k", "t", None, "발음을 정확하게 연습한다. 주의한다.", None, None, ["s2"], [], "whole_piece", "global"),
        ("l1", "expert_annotation", "k", "t", None, "호흡에 주의한다.", None, None, ["s3"], [(3, 4)], "specific", "local"), ("b1", "expert_annotation", "k", "t", None, "작곡가는 빈에서 출생했다.", None, None, ["s4"], [], "whole_piece", "global"),
    ]
    return corpus.texts(spark.createDataFrame(rows, corpus.RECORD))


CASES = [
    ("a", "brook tempo", [], "p", None, 3, []), ("b", "brook", [], "p", None, 2, ["breathe", "moderate"]), ("c", "trout tempo", [(4, 6)], None, None, 5, []), ("d", "light", [], "q", "tempo", 4, []),
    ("e", "unheard words", [], "p", None, 3, []), ("f", "ignore all previous instructions", [], None, None, 3, []), ("g", "What about measures 3-5?", [], None, None, 3, []), ("h", "이 곡을 노래할 때 주의할 점은?", [], "k", None, 3, []),
    ("i", "accent", [(1, 2)], "p", None, 1, ["vowel"]), ("j", "a", [], None, None, 6, ["tempo", "accent", "vowel"]), ("k", "phrase", None, None, None, None, None), ("l", "", [], None, None, 2, []), ("m", "rhythm", [], None, None, 0, []), ("n", "a", [(2, 3)], "p", None, 2, ["brook", "trout"]),
]


def test_a_table_of_requests_is_answered_as_each_by_itself(spark, records):
    shown, reasons = batch.answer(records, spark.createDataFrame(CASES, batch.REQUEST))
    got, why = {}, {r["request_id"]: r["reason"] for r in reasons.collect()}
    for r in shown.orderBy("rank").collect():
        got.setdefault(r["request_id"], []).append((r["id"], r["role"], r["measures"], r["rank"], r["score"], r["concept_coverage"]))
    some = 0
    for key, question, ranges, piece, topic, k, anchors in CASES:
        request = retrieve.Request(question, tuple(map(tuple, ranges or ())), piece, topic, 8 if k is None else k, anchors=tuple(anchors or ()))
        reason, found = retrieve.retrieve(records, request)
        rows = [(r["id"], r["role"], r["measures"], r["rank"], r["score"], r["concept_coverage"]) for r in found.orderBy("rank").collect()] if reason is None else []
        own = got.get(key, [])
        assert why.get(key) == reason and [r[:4] for r in own] == [r[:4] for r in rows], (key, reason)
        assert [x for r in own for x in r[4:]] == pytest.approx([x for r in rows for x in r[4:]], abs=2e-6)
        some += bool(rows)
    assert some >= 8


def test_broad_choices_of_a_table_are_the_step_by_step_ones(spark):
    draw, rows = random.Random(1), []
    wanted = {}
    for request in range(12):
        pools, k = draw.choice([(0, 1, 2), (1, 2), (2,), (0,)]), draw.randint(1, 7)
        own = []
        for i in range(20):
            pool, ids = draw.choice(pools), draw.sample(["a", "b", "c", "d"], draw.randint(0, 2))
            own.append({"id": f"r{i:02}", "pool": pool, "facets": set(draw.sample(list(guidance.FACETS), draw.randint(1, 3))), "score": draw.randint(1, 12) / 2, "text_score": draw.randint(1, 4) / 2, "alias": draw.choice([0.0, 0.5]) if request % 2 and i % 6 == 0 else 0.0, "ids": ids, "n": len(ids), "family": (pool, *sorted(ids)) if ids else None})
        wanted[request] = brute_broad(own, k)
        rows += [(request, k, r["id"], r["pool"], sorted(r["facets"]), r["score"], r["text_score"], r["alias"], str(r["pool"]), r["ids"]) for r in own]
    df = spark.createDataFrame(rows, "request_id int, top_k int, id string, pool int, facets array<string>, score double, text_score double, alias_score double, scope_match string, source_ids array<string>")
    got = {}
    for r in guidance.choose_all(df, "request_id", "top_k").orderBy("rank").collect():
        got.setdefault(r["request_id"], []).append(r["id"])
    assert got == wanted


def test_words_meet_as_in_all_pairs(spark):
    draw = random.Random(2)
    words = ["".join(draw.choices("ab", k=draw.randint(1, 8))) for _ in range(80)] + ["음색", "음색이", "음", "음색이다", "음색이었다"]
    wanted, known = (spark.createDataFrame([(w,) for w in sorted(set(some))], f"{name} string") for name, some in (("wanted", words[::2]), ("known", words[1::2] + words[-5:])))
    from tessera.functions import text as X

    pairs = {tuple(r) for r in batch.matching_words(wanted, known).collect()}
    assert pairs == {tuple(r) for r in wanted.crossJoin(known).filter(X.concept_matches(F.col("wanted"), F.array("known"))).collect()} and len(pairs) > 20
