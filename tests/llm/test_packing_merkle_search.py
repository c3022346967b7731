"""Packing, the Merkle manifest and ranked search against brute-force versions, and on awkward tables."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tessera.llm import merkle, packing, ranked_search
from tessera.llm.vector import concatenated

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, leaf string, sequence_id long, score long, id long, __key string"
ODD = [
    "", " \t\n ", "It's the dog's, WE'LL see... \"quoted\". (so) [x]. a,b;c", "<|endoftext|> and <|startoftext|>x<|ENDOFTEXT|>", "é é Ñandú ÇA İstanbul ß ẞ ΟΔΟΣ", "a\x1cb\x85c d　e f", "日本語のテキスト 한국어 العربية",
    "12345 3.14 x2y 1,000", "#### $$$ %%% don't 'tis 's", "́start ﻿bom zero‍width", "word</w> </w> a</w>b", "𝔘𝔫𝔦 🙂🙃 🇩🇪!", "a" * 3000 + ". end", "ends.. twice!! ?a? .b. über, naïve; señor: ÿ ÷× x÷y",
]


def prose(seed, n, vocabulary=300):
    random = np.random.default_rng(seed)
    words = ["".join(random.choice(["th", "an", "er", "ing", "ou", "re", "st", "ea"], 3)) for _ in range(vocabulary)]
    return " ".join(words[i] for i in random.integers(0, vocabulary, n))


def table(spark, rows):
    return spark.createDataFrame([(i, t, la, s, len(t or ""), "x", 7, 7, 7, "k") for i, t, la, s in rows], SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def rows():
    random = np.random.default_rng(4)
    many = [(i, prose(i % 40, int(random.integers(1, 300))) + ("\nmore\n" if i % 3 else ""), "en", ["a", "b", None, "ü", "z", ""][min(5, i % 9)]) for i in range(900)]
    return [*many, *[(2000 + i, t, None, "odd") for i, t in enumerate(ODD)], (5000, None, "fr", "alone"), (5001, prose(5, 30000, 2000), "fr", "b"), (5002, "twice", "fr", "b"), (5002, "twice", "fr", "b"), (None, "no id", None, None), (None, None, None, None)]


# packing


def tokens(texts):
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    return [np.array([*e.ids, 2], "<u4") for e in tokenizer.encode_batch(texts, add_special_tokens=False)]


def test_words_give_the_tokenizers_ids(rows):
    texts = [t or "" for _, t, _, _ in rows]
    for limit in (packing.KEPT_BYTES, -1):
        words = packing.WordIds(packing.word_tokenizer())
        words.held = limit + 1
        got = [i for lo in range(0, len(texts), 100) for i in words.encode([t.encode() for t in texts[lo : lo + 100]])]
        assert got == [x[:-1].tobytes() for x in tokens(texts)]


def packed(df, **options):
    found = defaultdict(list)
    for r in packing.pack(df, packing.word_tokenizer(), **options).collect():
        found[r["sequence_id"]].append(r)
    return found


@pytest.mark.parametrize("options", [{}, {"open_windows": 2, "fan_in": 2, "length": 64, "slack": 3}])
def test_every_id_is_in_one_piece(spark, rows, options):
    length, slack = options.get("length", 4096), options.get("slack", packing.SLACK)
    sequences = packed(table(spark, rows), **options)
    pieces = Counter()
    for parts in sequences.values():
        at = 0
        for r in sorted(parts, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
            pieces[r["doc_id"], r["start"], r["length"], r["ids_crc32"], r["doc_tokens"]] += 1
        assert length - slack <= at <= length or at & (at - 1) == 0
    of = defaultdict(Counter)
    for (i, start, n, crc, total), times in pieces.items():
        of[i][start, n, crc, total] += times
    wanted = defaultdict(list)
    for (i, *_), ids in zip(rows, tokens([t or "" for _, t, _, _ in rows]), strict=True):
        wanted[i].append(ids)
    assert set(of) == set(wanted)
    for i, all_ids in wanted.items():
        found = sorted(of[i].elements())
        assert sum(n for _, n, _, _ in found) == sum(map(len, all_ids))
        if len(all_ids) == 1:
            at = 0
            for start, n, crc, total in found:
                assert (start, total, crc) == (at, len(all_ids[0]), zlib.crc32(all_ids[0][at : at + n].tobytes()))
                at += n


def test_packing_an_empty_table(spark):
    df = packing.pack(table(spark, [(1, "x", "a", "b")]).limit(0), packing.word_tokenizer())
    assert df.columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"] and df.count() == 0


def test_the_fullest_window_goes_and_the_best_fit_takes():
    packer = packing.Packer(0, 10, 2, 1)
    for i, n in enumerate((6, 7, 3, 4, 8, 5)):  # 3 fills up 7, 4 fills up 6
        packer.add(packing.Piece(i, 0, n, bytes(4 * n)))
    assert [[(p.doc_id, len(p)) for p in w] for _, w in packer.done] == [[(1, 7), (2, 3)], [(0, 6), (3, 4)]]
    packer.add(packing.Piece(9, 0, 6, bytes(24)))  # fits neither 8 nor 5: the window of 8 is filled up with its head
    assert [(p.doc_id, len(p)) for p in packer.done[2][1]] == [(4, 8), (9, 2)]
    packer.close()
    assert [sum(map(len, w)) for _, w in packer.done[3:]] == [8, 1]


# Merkle manifest


def enc(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def climbed(nodes):
    """(root, [path of each leaf]) by a loop; a path is a list of (before, after)."""
    paths, of = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for leaf, at in enumerate(of):
            lo = at - at % 3
            paths[leaf].append(("".join(nodes[lo:at]), "".join(nodes[at + 1 : lo + 3])))
        nodes, of = [h(*nodes[i : i + 3]) for i in range(0, len(nodes), 3)], [at // 3 for at in of]
    return nodes[0], paths


def by_loop(rows):
    """Leaf digest, subroot, root and path of each row, in the order of group, id and leaf."""
    groups = defaultdict(list)
    for i, t, la, s in rows:
        groups[(s is not None, (s or "").encode())].append(((i is not None, i or 0), h(*map(enc, (i, s, la, len(t or ""), t))), i))
    subroots, out = [], []
    for key in sorted(groups):
        members = sorted(groups[key])
        subroot, paths = climbed([leaf for _, leaf, _ in members])
        out += [(i, leaf, len(subroots), p) for (_, leaf, i), p in zip(members, paths, strict=True)]
        subroots.append(subroot)
    root, upper = climbed(subroots)
    return [(i, leaf, subroots[g], root, p + upper[g]) for i, leaf, g, p in out]


@pytest.mark.parametrize("n", [1, 3, 10, 2700])
def test_manifest_equals_a_loop(spark, rows, n):
    if n == 2700:  # more than one climb
        rows = [*rows, *((10_000 + i, "t", None, "b") for i in range(n))]
    else:
        rows = rows[:n]
    got = [(r["doc_id"], r["leaf"], r["subroot"], r["root"], [tuple(s) for s in r["path"]]) for r in merkle.manifest(table(spark, rows)).collect()]
    key = lambda x: (x[0] is not None, x[0] or 0, x[1], str(x[4]))
    assert sorted(got, key=key) == sorted(by_loop(rows), key=key)


def test_proofs_tell_of_tampering(spark, rows):
    altered = F.when(F.col("doc_id") % 2 == 0, F.translate("text", "\n", ""))
    df = merkle.manifest(table(spark, rows), altered=altered)
    text = {i: t for i, t, _, _ in rows}
    for r in df.select("doc_id", merkle.fold(F.col("leaf"), F.col("path")).alias("own"), merkle.fold(F.col("altered_leaf"), F.col("path")).alias("other"), "root").collect():
        assert r["own"] == r["root"]
        i = r["doc_id"]
        assert (r["other"] != r["root"]) == (i is not None and i % 2 == 0 and "\n" in (text[i] or ""))


def test_manifest_of_an_empty_table(spark):
    assert merkle.manifest(table(spark, [(1, "x", "a", "b")]).limit(0)).count() == 0


# ranked search


TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return [re.sub("[A-Z]", lambda m: m[0].lower(), t) for t in TERM.findall(text or "")]


def ranked_by_loop(docs, items, k=20):
    held = [(i, Counter(terms(t))) for i, t in docs]
    n_docs, n_terms = sum(bool(c) for _, c in held), sum(c.total() for _, c in held)
    df = Counter(t for _, c in held for t in c)
    out = set()
    for item, text in items:
        found = []
        for i, c in held:
            m = 75 + (25 * c.total() * n_docs) // max(1, n_terms)
            score = sum(times * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 12 * m)) for t, times in Counter(terms(text)).items() if c[t])
            if score > 0:
                found.append((-score, i is None, i or 0, i))
        out |= {(item, rank, i, -s) for rank, (s, _, _, i) in enumerate(sorted(found)[:k], 1)}
    return out


ITEMS = [(1, "thaner thaner The ingouer, THANER?"), (2, None), (3, ""), (4, "zzz qqq"), (5, "ñandú ÇA twice"), (6, "no id more"), (6, "twice"), (None, "more dog"), (7, prose(5, 400, 2000))]


def test_search_equals_a_loop(spark, rows, monkeypatch):
    docs = [(i, t) for i, t, _, _ in rows]
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    merged = defaultdict(list)
    for i, t in ITEMS:
        merged[i].append(t or "")
    wanted = ranked_by_loop(docs, [(i, " ".join(t)) for i, t in merged.items()])
    for block, sample, rounds, exact, set_terms in ((2048, 4096, (4, 32), 1 << 53, 400_000), (20, 100, (1, 2), 0, 50)):
        monkeypatch.setattr(ranked_search, "BLOCK", block)
        monkeypatch.setattr(ranked_search, "SAMPLE", sample)
        monkeypatch.setattr(ranked_search, "EXACT", exact)
        monkeypatch.setattr(ranked_search.visit, "__defaults__", (rounds,))
        got = ranked_search.search(table(spark, rows), items, set_terms=set_terms).collect()
        assert len(got) == len(wanted) and {tuple(r) for r in got} == wanted


def test_blocks_that_cannot_count_are_left_alone(spark):
    """Documents of two vocabularies: an item of one never visits the other's blocks, and not all of its own."""
    docs = [(i, prose(i % 7, 40, 50) if i % 2 else " ".join(f"w{(i * k) % 97}" for k in range(1, 30))) for i in range(2000)]
    items = spark.createDataFrame([(1, docs[1][1])], "item_id long, text string")
    asked = sorted({t for t in terms(docs[1][1])})
    c = concatenated([" ".join(asked).encode()])
    hashes = np.sort(ranked_search.terms_of(c).term)
    df = table(spark, [(i, t, None, None) for i, t in docs])
    index = ranked_search.build(df, spark.sparkContext.broadcast(hashes), "doc_id", "text")
    assert (index.n_docs, index.n_terms) == (2000, sum(len(terms(t)) for _, t in docs))
    held = sum(len(r["ids"]) for r in index.blocks.collect())
    assert held == sum(bool(set(terms(t)) & set(asked)) for _, t in docs)
    assert {tuple(r) for r in ranked_search.search(df, items).collect()} == ranked_by_loop(docs, [(1, docs[1][1])])


def test_search_of_empty_tables(spark):
    some, items = table(spark, [(1, "x y", "a", "b")]), spark.createDataFrame(ITEMS, "item_id long, text string")
    assert ranked_search.search(some.limit(0), items).count() == 0
    none = ranked_search.search(some, items.limit(0))
    assert none.columns == ["item_id", "rank", "doc_id", "score"] and none.count() == 0


def test_bisection_puts_what_shares_terms_together():
    random = np.random.default_rng(3)
    kinds = random.integers(0, 2, 400)
    rows = [np.unique(random.integers(0, 50, 20) + 50 * k).astype(np.int32) for k in kinds]
    tree = ranked_search.fit(rows, 100)
    document = np.repeat(np.arange(400), [len(r) for r in rows])
    leaf = tree.route(400, document, np.concatenate(rows))
    mixed = sum(min((kinds[leaf == x] == 0).sum(), (kinds[leaf == x] == 1).sum()) for x in np.unique(leaf))
    assert mixed <= 20 and len(np.unique(leaf)) == 8
