"""run() against the stages done by hand on a small corpus."""

import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tessera.llm import bpe, mixing, registry, toxicity
from tessera.llm.vector import concatenated

from .test_llm_operators import brute_components, prose


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    rows, labels = [], []
    for i in range(160):
        words = prose(i, 40 + i % 30).split()
        if i % 8 == 0:
            words[5] = "nincompoop"
        text = "a line that many documents share\n" + " ".join(words)
        rows.append((i, text, "en", f"s{i % 4}", len(text)))
        labels.append((i, i % 2, int(i % 8 == 0)))
    for k in range(6):
        rows.append((200 + k, rows[17 + k][1], "en", "s1", rows[17 + k][4]))
    rows += [(300, None, None, None, None), (301, "", "en", "s9", 0), (8, rows[9][1], "en", "s0", rows[9][4])]
    folder = tmp_path_factory.mktemp("sf")
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return str(folder)


def test_stages_and_run(spark, corpus):
    docs = spark.read.parquet(f"{corpus}/documents.parquet")
    columns = docs.columns
    rows = [tuple(r) for r in docs.collect()]
    model = toxicity.train(docs, spark.read.parquet(f"{corpus}/labels.parquet").select("doc_id", "toxic"))
    rows = [r for r in rows if model.score(concatenated([(r[1] or "").encode()]))[0] < 0.5]
    assert not any("nincompoop" in (r[1] or "") for r in rows) and len(rows) >= 140

    key = lambda x: x.strip(" \t\n\x0b\x0c\r").lower()
    holders = defaultdict(set)
    for r in rows:
        for line in (r[1] or "").split("\n"):
            if len(key(line)) >= 10:
                holders[key(line)].add(r[0])
    rows = [(r[0], "\n".join(x for x in (r[1] or "").split("\n") if len(holders[key(x)]) < 2 or min(holders[key(x)]) == r[0]), *r[2:]) for r in rows]

    component = brute_components([(r[0], r[1]) for r in rows], 3, lambda c, u: 100 * c >= 90 * u)
    rows = [r for r in rows if component[r[0]] == r[0]]

    held = spark.createDataFrame([(r[0], r[1], r[3]) for r in rows], "doc_id long, text string, source string")
    taken = {r["doc_id"]: r["taken"] // max(1, r["size"]) for r in mixing.mix(held).collect()}
    tokens, pattern = bpe.vocabulary()
    machine = bpe.Transducer(tokens)
    import regex

    expected = sorted((r[0], [t for p in regex.findall(pattern, r[1]) for t in machine.encode(p.encode())]) for r in rows for _ in range(taken[r[0]]))
    got = corpus_pipeline.run(spark, corpus)
    assert sorted((r["doc_id"], list(r["token_ids"])) for r in got.collect()) == expected
    assert got.filter("not round_trip or n_tokens <> size(token_ids)").count() == 0

    stage = docs
    for name, f in corpus_pipeline.STAGES[:-1]:
        stage = f(spark, stage, corpus)
        assert stage.columns == columns, name
    empty = docs.limit(0)
    for name, f in corpus_pipeline.STAGES:
        assert f(spark, empty, corpus).count() == 0, name


def test_stage_order_and_registration():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "line dedup", "n-gram Jaccard join", "mixing sources to target weights", "byte-level BPE encoding and decoding"]
    names = set(registry.queries())
    assert {re.match(r"op(\d+)_", n)[1] for n in names - {"pipeline"}} == {str(k) for k in range(1, 14)} and set(registry.oracle_sql()) <= names


def test_repeated_rows_keep_their_copies(spark):
    docs = spark.createDataFrame([(1, "a b", "x"), (1, "a b", "x"), (2, "c", "x"), (None, "d e f", None)], "doc_id long, text string, source string")
    got = corpus_pipeline.mix_sources(spark, docs, "")
    total = sum(r["taken"] for r in mixing.mix(docs).collect())
    assert got.select(F.sum(F.size(F.split("text", " ")))).first()[0] == total
