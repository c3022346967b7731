"""Each operator against a brute-force version, and on awkward tables."""

import hashlib
import re
from collections import defaultdict

import numpy as np
import pytest

from tessera.llm import bpe, compression, jaccard_join, language_id, line_dedup, minhash, mixing, quality_rank, suffix_dedup, toxicity
from tessera.llm.components import connected
from tessera.llm.difference_cover import repeats, suffix_array
from tessera.llm.vector import chunks, concatenated

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, taken long, n_lines long, kept boolean, size long, token_ids string"


def prose(seed, n, vocabulary=400):
    random = np.random.default_rng(seed)
    words = ["".join(random.choice(["th", "an", "er", "ing", "ou", "re", "st", "ea"], 3)) for _ in range(vocabulary)]
    return " ".join(words[i] for i in random.integers(0, vocabulary, n))


@pytest.fixture(scope="module")
def docs(spark):
    long = prose(9, 30000, 3000)
    near = prose(3, 300)
    texts = [
        (0, prose(1, 200), "en", "a"), (1, prose(1, 200), "en", "b"), (2, None, "en", None), (3, "", None, "a"), (4, " \t\n ", "de", "c"),
        (5, near, "de", "b"), (6, near.replace(near.split()[150], "changed", 1), "de", None), (7, long, "fr", "a"), (8, "one", "fr", "d"), (8, "one", "fr", "d"),
        (9, "Shared line of text\nown line here 1\nx\nShared LINE of text  \n", "fr", "e"), (10, "shared line of text\nown line here 2\nx", None, ""), (11, "héé ñandú\n\nhéé ñandú", "es", "a"), (None, "nobody's text, nobody's text", "es", "a"), (None, None, None, None),
    ]
    rows = [(i, t, la, s, len(t or ""), 0.5, 7, 7, True, 7, "x") for i, t, la, s in texts]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def by_id(df):
    return {r["doc_id"]: r for r in df.collect() if r["doc_id"] is not None}


# compression


def test_base_figures_match_a_loop():
    texts = [prose(1, 50), "a b c d e f a b c d e", "", "x\nx\n\n x\nx", "## $5 é\té", "a a a a a a a"]
    c = concatenated([t.encode() for t in texts])
    got = compression.base_figures(c)
    for i, t in enumerate(texts):
        words, windows, covered = WORD.findall(t), defaultdict(list), set()
        for j in range(len(words) - 4):
            windows[tuple(words[j : j + 5])].append(j)
        for places in windows.values():
            if len(places) > 1:
                covered |= {k for j in places for k in range(j, j + 5)}
        lines = [x for x in t.split("\n") if WORD.search(x)]
        expected = [len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(covered)]
        assert [got[k][i] for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")] == expected, t


def test_compression_keeps_prose_and_drops_repeats_and_noise(spark, docs, empty):
    import base64

    noise = base64.b64encode(np.random.default_rng(1).bytes(6000)).decode()
    random = np.random.default_rng(4)
    letters, often = list("etaoinshrdlucmfwypvbgk"), np.array([12, 9, 8, 8, 7, 7, 6, 6, 6, 4, 4, 3, 3, 2, 2, 2, 2, 2, 1, 1, 2, 1], float)
    words = ["".join(random.choice(letters, int(n), p=often / often.sum())) for n in random.integers(2, 9, 600)]
    text = {1: " ".join(words[int(600 * x**2)] for x in random.random(900)), 2: "the same words again and again " * 100, 3: " ".join(noise[i : i + 9] for i in range(0, 8000, 9))}
    got = by_id(compression.judge(spark.createDataFrame(list(text.items()), "doc_id long, text string")))
    assert [got[k]["kept"] for k in (1, 2, 3)] == [True, False, False] and not got[3]["base_failed"]
    awkward = by_id(compression.judge(docs))
    assert awkward[2]["n_words"] == 0 and awkward[2]["base_failed"] and compression.judge(docs).count() == docs.count()
    assert compression.judge(empty).count() == 0


def plain_prose(seed, n_words):
    random = np.random.default_rng(seed)
    letters, often = list("etaoinshrdlucmfwypvbgk"), np.array([12, 9, 8, 8, 7, 7, 6, 6, 6, 4, 4, 3, 3, 2, 2, 2, 2, 2, 1, 1, 2, 1], float)
    words = ["".join(random.choice(letters, int(n), p=often / often.sum())) for n in random.integers(2, 9, 600)]
    return " ".join(words[int(600 * x**2)] for x in random.random(n_words))


def test_every_chunk_is_measured():
    import zstandard

    text = plain_prose(4, 3000).encode()
    texts = [b"", text[:40], text[:4095], text[:4096], text[:4126], text[:4146], text[: 2 * 4096 + 1500]]
    whole, parts = compression.ratios(concatenated(texts), compression.LEVEL, compression.CHUNK)
    press = zstandard.ZstdCompressor(level=compression.LEVEL, write_content_size=False, write_checksum=False).compress
    assert [[x["size"] for x in p] for p in parts] == [[], [], [], [4096], [4126], [4096, 50], [4096, 4096, 1500]]
    for t, w, p in zip(texts, whole, parts, strict=True):
        assert w == (len(t) / len(press(t)) if t else 1)
        place = 0
        for x in p:
            assert x["ratio"] == x["size"] / len(press(t[place : place + x["size"]]))
            place += x["size"]
        assert place in (0, len(t))


def test_limits_follow_the_documents_and_only_tighten():
    random = np.random.default_rng(6)
    values = {3: random.normal(0.6, 0.02, 30_000), 5: random.normal(0.9, 0.02, 10)}
    counted = [(k, int(c), int(n)) for k, v in values.items() for c, n in zip(*np.unique(np.floor((v - compression.LOWEST) / compression.CELL), return_counts=True), strict=True)]
    wide = {k: (0.5, 9.0) for k in (3, 5, 7)}
    found = compression.learnt(counted, wide, 8.0, 4.0)
    q1, q2, q3 = np.percentile(values[3], [25, 50, 75])
    spread = max(q2 - q1, q3 - q2)
    assert np.allclose(np.log(found[3]), [q2 - 8 * spread, q2 + 4 * spread], atol=0.03)
    assert found[7] == wide[7] and 0.5 < found[5][0] < found[3][0] * 1.5 and found[3][1] < found[5][1] < 9.0
    narrow = {k: (1.8, 1.85) for k in (3, 5)}
    assert compression.learnt(counted, narrow, 8.0, 4.0)[3] == pytest.approx(narrow[3])


@pytest.mark.parametrize("n", [40, 80, 160, 240])
def test_noise_goes_whatever_its_share(spark, n):
    """From a fifth of the corpus to three fifths."""
    import base64

    random = np.random.default_rng(8)
    prose_rows = [(i, plain_prose(4, 400 + 5 * i)[: 600 + 40 * (i % 50)]) for i in range(160)]
    noise = [(1000 + i, " ".join(base64.b64encode(random.bytes(9)).decode()[: int(random.integers(5, 12))] for _ in range(60 + i % 200))) for i in range(n)]
    got = by_id(compression.judge(spark.createDataFrame(prose_rows + noise, "doc_id long, text string")))
    assert not any(got[i]["kept"] for i, _ in noise) and not any(got[i]["base_failed"] for i, _ in noise)
    assert sum(got[i]["kept"] for i, _ in prose_rows) >= 159


def test_verdicts_match_a_loop(spark):
    import base64

    noise = base64.b64encode(np.random.default_rng(1).bytes(30000)).decode()
    texts = [plain_prose(4, 30 * (i % 40) + 100)[: 300 + 900 * (i % 12)] for i in range(160)]
    foul = [plain_prose(4, 1500)[:4300] + " " + noise[:3800], plain_prose(4, 900)[:4096] + noise[:2000], " ".join(noise[i : i + 9] for i in range(0, 5000, 9)), "one two three four five six seven eight nine ten eleven " * 30]
    rows = list(enumerate([*texts, *foul]))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = by_id(compression.judge(df))
    measured = compression.measure(df)
    steps, of_chunks = compression.limits(measured)

    def limit(n, k):
        return float(np.interp(np.log2(n) * compression.STEPS - 0.5, range(len(steps)), [x[k] for x in steps]))

    for r in measured.collect():
        inside = lambda ratio, n: limit(n, 0) <= ratio <= limit(n, 1)
        odd = sum(c["size"] for c in r["chunks"] if not (of_chunks[0] <= c["ratio"] <= of_chunks[1] if c["size"] == compression.CHUNK else inside(c["ratio"], c["size"])))
        expected = not r["base_failed"] and inside(r["ratio"], r["n_bytes"]) and odd <= compression.CHUNK_SHARE * r["n_bytes"]
        assert got[r["doc_id"]]["kept"] == expected, r["doc_id"]
    assert not any(got[len(texts) + i]["kept"] for i in range(len(foul))) and sum(got[i]["kept"] for i in range(len(texts))) >= 150


# mixing


def test_mix_reaches_targets_and_is_whole(spark, docs, empty):
    rows = [(i, "w " * (1 + i % 17), f"s{i % 5}" if i % 3 else "s0") for i in range(600)] + [(700, None, None), (701, "a b c", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.mix(df).collect()
    assert {r["doc_id"] for r in got} == {r[0] for r in rows} and len(got) == len(rows)
    sources = sorted({r["source"] for r in got}, key=lambda s: (s is None, s))
    total = sum(r["size"] for r in got)
    size, weight, target = {}, {}, {}
    for k, s in enumerate(sources):
        size[s], weight[s] = sum(r["size"] for r in got if r["source"] == s), (5, 2, 1)[k % 3]
    free, left = set(sources), float(total)
    while free:
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = [s for s in free if share[s] > 3 * size[s]]
        if not over:
            target |= share
            break
        for s in over:
            target[s] = 3.0 * size[s]
            left -= target[s]
        free -= set(over)
    for s in sources:
        mine = [r for r in got if r["source"] == s]
        assert mine[0]["target"] == pytest.approx(target[s]) and mine[0]["source_size"] == size[s]
        assert abs(sum(r["taken"] for r in mine) - target[s]) <= 18
    assert all(r["taken"] <= 3 * r["size"] and r["taken"] % max(1, r["size"]) == 0 for r in got)
    again = {r["doc_id"]: r["taken"] for r in mixing.mix(df.repartition(7)).collect()}
    assert again == {r["doc_id"]: r["taken"] for r in got}
    assert mixing.mix(docs).count() == docs.count() and mixing.mix(empty).count() == 0
    assert by_id(mixing.mix(docs))[2]["taken"] == 0


# line dedup


def test_lines_match_a_loop(docs, empty):
    rows = [(r["doc_id"], r["text"] or "") for r in docs.collect()]
    blanks = " \t\n\x0b\x0c\r"
    key = lambda x: "".join(c.lower() if "A" <= c <= "Z" else c for c in x.strip(blanks))
    holders = defaultdict(set)
    for i, t in rows:
        if i is not None:
            for line in t.split("\n"):
                if len(key(line)) >= 10:
                    holders[key(line)].add(i)
    expected = sorted((str(i), "\n".join(x for x in t.split("\n") if i is None or len(holders[key(x)]) < 2 or min(holders[key(x)]) == i)) for i, t in rows)
    got = line_dedup.drop_repeated_lines(docs)
    assert sorted((str(r["doc_id"]), r["text"]) for r in got.collect()) == expected
    nine, ten = by_id(got)[9], by_id(got)[10]
    assert (nine["n_lines"], nine["n_dropped"], ten["n_dropped"]) == (5, 0, 1)
    assert line_dedup.drop_repeated_lines(empty).count() == 0
    three = line_dedup.drop_repeated_lines(docs, min_docs=3)
    assert by_id(three)[10]["n_dropped"] == 0


# Jaccard join, components


def shingles(t, k):
    w = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


def brute_components(rows, k, test):
    sets, root = [(i, shingles(t, k)) for i, t in rows], {i: i for i, _ in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for n, (i, a) in enumerate(sets):
        for j, b in sets[:n]:
            if a and b and test(len(a & b), len(a | b)):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return {i: find(i) for i, _ in rows}


@pytest.mark.parametrize("seed", [1, 2])
def test_derived_answers_lose_no_link(spark, seed):
    """Families whose members drift away from their centre, of sizes that make lists with many blocks, and ids with several texts."""
    random = np.random.default_rng(seed)
    rows = []
    for family in range(3):
        words = prose(100 * seed + family, 60 + 50 * family).split()
        for i in range(45):
            mine = list(words)
            for _ in range(int(random.integers(0, 6))):
                k = int(random.integers(0, len(mine)))
                mine[k : k + int(random.integers(0, 2))] = [f"edit{random.integers(0, 25)}"] * int(random.integers(0, 2))
            rows.append((family * 45 + i, " ".join(mine)))
    rows += [(7, rows[60][1]), (50, rows[100][1])]
    links = defaultdict(set)
    for i, t in rows:
        for j, u in rows:
            x, y = shingles(t, 3), shingles(u, 3)
            if x and y and 100 * len(x & y) >= 90 * len(x | y):
                links[i].add(j)
    expected = {}
    for i, _ in rows:
        seen, todo = set(), [i]
        while todo:
            k = todo.pop()
            if k not in seen:
                seen.add(k)
                todo += links[k]
        expected[i] = min(seen)
    got = jaccard_join.components(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()
    assert len(got) == len(rows) and {r["doc_id"]: r["component_id"] for r in got} == expected and len(set(expected.values())) > 3


def test_join_matches_all_pairs(spark):
    base = [prose(s, 120) for s in range(4)]
    rows, random = [], np.random.default_rng(5)
    for i in range(120):
        words = base[i % 4].split()
        for _ in range(int(random.integers(0, 5))):
            words[int(random.integers(0, len(words)))] = f"edit{random.integers(0, 40)}"
        rows.append((int(i * 7 % 120), " ".join(words) if i % 11 else " ".join(words[:2])))
    expected = brute_components(rows, 3, lambda c, u: 100 * c >= 90 * u)
    got = by_id(jaccard_join.components(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)))
    assert {i: r["component_id"] for i, r in got.items()} == expected
    assert len(set(expected.values())) > 8
    assert all(r["n_shingles"] == len(shingles(dict(rows)[i], 3)) for i, r in got.items())


def test_join_on_awkward_tables(docs, empty):
    got = jaccard_join.components(docs).collect()
    assert len(got) == docs.count() and jaccard_join.components(empty).count() == 0
    ids = {r["doc_id"]: r["component_id"] for r in got if r["doc_id"] is not None}
    assert ids[1] == 0 and ids[6] == 5 and ids[2] == 2 and ids[4] == 4
    assert all(r["component_id"] is None for r in got if r["doc_id"] is None)


def test_join_links_copies_of_a_row_without_an_id(spark):
    text = prose(1, 120)
    near = text.replace(text.split()[60], "changed", 1)
    rows = [(None, text), (None, text), (5, text), (3, near), (9, prose(2, 120)), (None, near)]
    got = jaccard_join.components(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)).collect()
    assert {r["doc_id"]: r["component_id"] for r in got if r["doc_id"] is not None} == {5: 3, 3: 3, 9: 9}
    assert [(r["n_shingles"], r["component_id"]) for r in got if r["doc_id"] is None] == [(len(shingles(t, 3)), None) for i, t in rows if i is None]


def test_components_of_chains_and_stars(spark):
    links = [(i, i + 1) for i in range(10, 40)] + [(100, 100 + k) for k in range(1, 20)] + [(7, 39)]
    got = {r["id"]: r["component"] for r in connected(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**{i: 7 for i in [7, *range(10, 41)]}, **{100 + k: 100 for k in range(20)}}
    assert connected(spark.createDataFrame([], "a long, b long")).count() == 0


# MinHash


def test_fingerprints_estimate_likeness(spark, docs, empty):
    rows = [(i, prose(i // 2, 150 + 10 * (i % 2))) for i in range(0, 30)] + [(40, None), (41, "ééé x"), (50, "a b c")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = [r for r in minhash.fingerprints(df, partitions=4).orderBy("doc_id").collect()]
    assert [r["doc_id"] for r in got] == [i for i, _ in rows]
    for k, ((_, t), r) in enumerate(zip(rows, got, strict=True)):
        t, following = t or "", rows[(k + 1) % len(rows)][1] or ""
        quarter = len(t) // 4
        changed = t[: len(t) - quarter] + following[:quarter]
        assert r["edited_sha256"] == hashlib.sha256(changed.encode()).hexdigest() and r["n_chars"] == len(t)
        own = minhash.signatures(concatenated([t.encode(), changed.encode(), following.encode()]))
        assert [r["fingerprint"], r["edited_fingerprint"]] == minhash.hexed(own[:2])
        assert r["near_next"] == (own[0] == own[2]).mean()
        raw = lambda x: {tuple(w[i : i + 5]) for w in [WORD.findall(x)] for i in range(max(1, len(w) - 4)) if w}
        a, b = raw(t), raw(changed)
        assert abs(r["near_edited"] - (len(a & b) / len(a | b) if a | b else 1)) < 0.2
    assert minhash.fingerprints(docs).count() == docs.count() and minhash.fingerprints(empty).count() == 0


def test_fingerprints_tell_long_texts_apart():
    random = np.random.default_rng(6)
    texts = [b" ".join(b"%d" % w for w in random.integers(0, 1 << 40, 100_000)) for _ in range(2)]
    own = minhash.signatures(concatenated([*texts, texts[0][: len(texts[0]) // 2], b"", b" "]))
    assert (own[0] == own[1]).mean() < 0.03 and abs((own[0] == own[2]).mean() - 0.5) < 0.2
    assert (own[3:] == minhash.EMPTY).all() and (own[:3] == minhash.EMPTY).mean() < 0.02
    assert not (minhash.band_keys(own[:1], 16) == minhash.band_keys(own[1:2], 16)).any()


def test_near_duplicates_are_verified(docs, empty):
    got = {r["doc_id"]: r["class_id"] for r in minhash.near_duplicates(docs).collect()}
    assert got[1] == 0 and got[6] == 5 and got[2] == 2 and got[9] == 9
    assert minhash.near_duplicates(docs).count() == docs.count() and minhash.near_duplicates(empty).count() == 0


def test_bands_recall_pairs_at_the_threshold():
    random, met, pairs = np.random.default_rng(12), 0, 400
    for _ in range(pairs):
        common = random.integers(0, 1 << 62, 160, np.uint64)
        a, b = (np.concatenate([common, random.integers(0, 1 << 62, 20, np.uint64)]) for _ in range(2))  # 160 of 200: 0.8
        hashes, at = np.concatenate([a, b]), np.array([0, 180, 360])
        keys = minhash.band_keys(minhash.small(minhash.minima(hashes, at[:-1], at[1:])), minhash.BANDS)
        met += bool((keys[0] == keys[1]).any())
    assert met == pairs


# suffix sorting


@pytest.mark.parametrize("alphabet", [1, 2, 4, 50])
def test_suffix_array_is_sorted(alphabet):
    random = np.random.default_rng(alphabet)
    for n in [*range(0, 30), 100, 401]:
        text = random.integers(1, alphabet + 1, n)
        assert suffix_array(text).tolist() == sorted(range(n), key=lambda i: text[i:].tolist())
        for length in (1, 2, 5):
            count = defaultdict(int)
            for i in range(n - length + 1):
                count[tuple(text[i : i + length])] += 1
            assert repeats(text, length).tolist() == [i <= n - length and count[tuple(text[i : i + length])] > 1 for i in range(n)]


@pytest.mark.parametrize("most", [5000, 2])
def test_repeats_match_brute_force(spark, most):
    random = np.random.default_rng(2)
    passage = "".join(random.choice(list("abcd é"), 160))
    texts = [prose(i, 60) for i in range(12)]
    for i in (1, 4, 5, 7):
        k = int(random.integers(0, 100))
        texts[i] = texts[i][:k] + passage[: 90 + 15 * i] + texts[i][k:]
    texts += [texts[0], "ab" * 150, "", texts[3][:50] + texts[3][:50], passage * 3]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    raw = [t.encode() for t in texts]
    expected = suffix_dedup.brute_force(raw, 80)
    got = by_id(suffix_dedup.remove_repeats(df, 80, spread=40, gram=6, narrow=(12, 4, 1), most=most))
    for i, (t, runs) in enumerate(zip(raw, expected, strict=True)):
        kept, place = b"", 0
        for a, b in runs:
            kept, place = kept + t[place:a], b
        kept += t[place:]
        assert (got[i]["n_bytes"], got[i]["n_spans"], bytes(got[i]["kept"])) == (len(t), len(runs), kept), i


def test_repeats_on_awkward_tables(docs, empty):
    got = suffix_dedup.remove_repeats(docs)
    rows = by_id(got)
    assert got.count() == docs.count() and suffix_dedup.remove_repeats(empty).count() == 0
    assert rows[0]["n_removed"] == rows[0]["n_bytes"] > 400 and rows[8]["n_removed"] == 0 and rows[2]["n_bytes"] == 0


def test_rows_without_an_id_are_told_apart_where_short_hashes_agree(spark):
    from pyspark.sql import functions as F

    pool = spark.range(200_000).select(F.concat_ws(" ", *(F.md5(F.concat(F.col("id").cast("string"), F.lit(f"-{k}"))) for k in range(24))).alias("text"))
    twins = pool.groupBy(F.hash("text").alias("h")).agg(F.collect_list("text").alias("texts")).filter(F.size("texts") > 1).first()["texts"][:2]
    texts = [twins[0], twins[1][:450] + "#" + twins[1][450:], twins[1]]  # what is cut from the last must not be cut from the first
    got = suffix_dedup.remove_repeats(spark.createDataFrame([(None, t) for t in texts], "doc_id long, text string")).collect()
    expected = suffix_dedup.brute_force([t.encode() for t in texts])
    assert sorted(r["n_removed"] for r in got) == sorted(sum(b - a for a, b in runs) for runs in expected)
    assert next(r for r in got if bytes(r["kept"]).startswith(twins[0][:50].encode()))["n_removed"] == 0


def test_shared_passages_are_told_at_any_length_in_bytes(spark):
    short = " ".join(f"w{i % 7}{i}" for i in range(51))  # fewer than 400 bytes
    texts = [prose(20 + i, 200, 4000) for i in range(8)]
    texts[1] = texts[1][:600] + " " + short + " " + texts[1][600:]
    texts[5] = short + "\n" + texts[5]
    texts += [short[:100], None, ""]
    got = by_id(suffix_dedup.remove_repeats(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)))
    assert len(short) < 400 and sorted(i for i in got if got[i]["n_shared_passages"]) == [1, 5]
    assert all(r["n_removed"] == 0 for r in got.values())


def registered(spark, folder, name):
    from tessera.llm import registry

    return registry.queries()[name](spark, str(folder))


def test_held_out_rows_teach_nothing(spark, tmp_path):
    """The registered classifiers: the crc32 rules, and no label of a held-out row, no lang, source or id in a score."""
    import zlib

    random = np.random.default_rng(3)
    rows, labels = [], []
    for i in range(160):
        bad = i % 4 == 0
        words = prose(i, 60, 300).split()
        if bad:
            words[int(random.integers(0, 60))] = "nincompoop"
            words = [w + "###" if k % 3 == 0 else w for k, w in enumerate(words)]
        rows.append((i, " ".join(words), "en" if i % 2 else "de", f"s{i % 3}", 1))
        labels.append((i, int(not bad), int(bad)))
    rest = lambda i, m: zlib.crc32(str(i).encode()) % m
    outputs = {}
    for kind in ("plain", "changed"):
        folder = tmp_path / kind
        changed = kind == "changed"
        # held-out labels flipped, other columns and held-out languages replaced
        df = [(i, t, ("xx" if rest(i, 4) == 2 else la) if changed else la, "s" if changed else s, n) for i, t, la, s, n in rows]
        spark.createDataFrame(df, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
        known = [(i, 1 - q if changed and rest(i, 4) == 2 else q, 1 - t if changed and rest(i, 5) == 0 else t) for i, q, t in labels]
        spark.createDataFrame(known, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
        outputs[kind] = {n: {r["doc_id"]: r.asDict() for r in registered(spark, folder, n).collect()} for n in ("op1_string_kernel_toxicity", "op5_hierarchical_language_id", "op9_bradley_terry_quality")}
    assert outputs["plain"] == outputs["changed"]
    one, five, nine = outputs["plain"].values()
    for i, _, _, _, _ in rows:
        assert one[i]["held_out"] == (rest(i, 5) == 0) and five[i]["held_out"] == nine[i]["held_out"] == (rest(i, 4) == 2)
        assert one[i]["predicted"] == int(one[i]["score"] >= 0.5) and nine[i]["predicted"] == int(nine[i]["score"] >= 0.7)
    assert np.mean([one[i]["predicted"] == (i % 4 == 0) for i in one if one[i]["held_out"]]) > 0.9
    assert np.mean([nine[i]["predicted"] == (i % 4 != 0) for i in nine if nine[i]["held_out"]]) > 0.9


def test_very_long_texts_are_scored_whole(spark):
    words = prose(5, 200000, 2000)
    df = spark.createDataFrame([(i, prose(i, 50) + (" nincompoop" if i % 2 else "")) for i in range(60)] + [(100, words), (101, words + " you nincompoop")], "doc_id long, text string")
    known = spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id long, toxic int")
    got = by_id(toxicity.score(df, toxicity.train(df, known)))
    assert len(words) > toxicity.CHUNK_BYTES and (got[100]["predicted"], got[101]["predicted"]) == (0, 1)


def test_a_landmark_of_four_letters_is_like_itself():
    letters = "abcdefghijklmnopqrstuvwxyzñéêôçßäöü"
    for a in letters:
        for b in letters:
            marks = toxicity.Landmarks([f"{a}{b}ko"])
            words = np.zeros((1, toxicity.WIDTH), np.uint16)
            words[0, :4] = toxicity.encode(f"{a}{b}ko")
            assert marks.similarities(words)[0, 0] == pytest.approx(1.0), (a, b)


def test_lines_of_a_long_document_are_dropped_in_linear_time(spark):
    import time

    text = "\n".join(f"line number {i}" for i in range(60000))
    df = spark.createDataFrame([(1, text), (2, text + "\nits own last line")], "doc_id long, text string")
    began = time.time()
    got = by_id(line_dedup.drop_repeated_lines(df))
    assert (got[1]["n_dropped"], got[2]["n_dropped"], got[2]["text"]) == (0, 60000, "its own last line") and time.time() - began < 60


def test_lines_of_three_documents(spark):
    df = spark.createDataFrame([(k, f"in all of them\nin the first two\nown line {k}" if k < 3 else "in all of them") for k in (1, 2, 3)] + [(2, "in all of them\nanother text")], "doc_id long, text string")
    got = sorted((r["doc_id"], r["text"]) for r in line_dedup.drop_repeated_lines(df, min_docs=3).collect())
    assert got == [(1, "in all of them\nin the first two\nown line 1"), (2, "another text"), (2, "in the first two\nown line 2"), (3, "")]


# byte-level BPE


@pytest.fixture(scope="module")
def vocabulary():
    return bpe.vocabulary()


def test_transducer_encodes_as_the_library(vocabulary):
    tiktoken = pytest.importorskip("tiktoken")
    tokens, pattern = vocabulary
    library = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks={t: i for i, t in enumerate(tokens)}, special_tokens={})
    machine, random = bpe.Transducer(tokens, most_states=500), np.random.default_rng(3)
    pieces = [b"", b"a", b" unbelievable", b"aaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaa", "日本語テキスト".encode(), b"    \n\n   ", b"=" * 77]
    pieces += [bytes(random.choice(list(alphabet), int(n))) for alphabet in (b"ab", b"aeinrst ", bytes(range(256))) for n in random.integers(1, 60, 40)]
    for piece in pieces:
        assert machine.encode(piece) == (library._core_bpe.encode_single_piece(piece) if piece else []), piece


def test_both_engines_split_alike(vocabulary):
    import regex

    _, pattern = vocabulary
    assert pattern in bpe.PLAIN
    split, general = bpe.splitter(pattern), regex.compile(pattern).findall
    for place in [*range(0x600), 0x2003, 0x3000, 0x4E00, 0x1F600]:
        ch = chr(place)
        for text in (f"a {ch}b{ch} 1{ch}  {ch}{ch} ", f"{ch}_{ch}'ll {ch}\n\n{ch}", ch):
            assert split(text) == general(text), hex(place)


def test_round_trip_and_digest(docs, empty, vocabulary):
    tiktoken = pytest.importorskip("tiktoken")
    tokens, pattern = vocabulary
    library = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks={t: i for i, t in enumerate(tokens)}, special_tokens={})
    texts = {r["doc_id"]: r["text"] or "" for r in docs.collect() if r["doc_id"] is not None}
    got = by_id(bpe.digest(docs, tokens, pattern))
    for i, t in texts.items():
        ids = library.encode_ordinary(t)
        assert (got[i]["n_tokens"], got[i]["ids_sha256"]) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest())
        assert got[i]["decoded_sha256"] == hashlib.sha256(t.encode()).hexdigest()
    ids = bpe.encode(docs, tokens, pattern)
    assert bpe.decode(ids, tokens).filter("decoded <> encode(coalesce(text, ''), 'UTF-8')").count() == 0 and "decoded" not in ids.columns
    assert bpe.digest(docs, tokens, pattern).count() == docs.count() and bpe.digest(empty, tokens, pattern).count() == 0


def test_stream_decoding_waits_for_whole_characters(vocabulary):
    tokens, _ = vocabulary
    ids = [tokens.index(bytes([b])) for b in "a日ñ".encode()]
    stream = bpe.StreamDecoder(tokens)
    assert [stream.feed([i]) for i in ids] == ["a", "", "", "日", "", "ñ"]
    assert bpe.StreamDecoder(tokens).feed(ids[:2], final=True) == "a�"


def test_query_decodes_through_the_stream(spark, docs, vocabulary, monkeypatch):
    import pyarrow as pa

    fed, tokens = [], vocabulary[0]

    class Watched(bpe.StreamDecoder):
        def feed(self, ids, final=False):
            fed.extend(ids)
            return super().feed(ids, final)

    here = lambda df, run, schema, **_: spark.createDataFrame(pa.Table.from_batches(run(iter(df.toArrow().to_batches()))))
    monkeypatch.setattr(bpe, "StreamDecoder", Watched)
    monkeypatch.setattr(bpe, "map_arrow", here)
    rows = bpe.digest(docs.filter("doc_id in (9, 11)"), *vocabulary).collect()
    assert rows and sum(r["n_tokens"] for r in rows) == len(fed)
    text = "héé 日本語 ñandú"
    ids = np.array([tokens.index(bytes([b])) for b in text.encode()])
    assert {bpe.streamed(tokens, ids, step) for step in (1, 2, 3, 100)} == {text.encode()}
    assert bpe.streamed(tokens, ids[:2], 1) == "h�".encode() and bpe.streamed(tokens, ids[:0]) == b""


# classifiers


def test_language_families_then_duels(spark, docs, empty):
    sample = {"en": "the quick brown fox jumps over the lazy dog with this and that which", "de": "der schnelle braune fuchs springt über den faulen hund und nicht mit", "fr": "le renard brun rapide saute par dessus le chien paresseux avec les", "es": "el rápido zorro marrón salta sobre el perro perezoso con los que"}
    random, rows = np.random.default_rng(1), []
    for i in range(240):
        lang = list(sample)[i % 4]
        rows.append((i, " ".join(random.choice(sample[lang].split(), 12)), lang if i % 7 else None))
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language_id.train(df.filter("doc_id < 160"))
    assert sorted(map(sorted, model.families.values())) == [["de", "en"], ["es", "fr"]]
    got = by_id(language_id.identify(df.filter("doc_id >= 160"), model))
    assert np.mean([r["lang_pred"] == list(sample)[i % 4] for i, r in got.items()]) > 0.97
    awkward = by_id(language_id.identify(docs, model))
    assert awkward[2]["lang_pred"] == awkward[4]["lang_pred"] == "und" and awkward[2]["score"] == 0.0
    assert by_id(language_id.identify(spark.createDataFrame([(1, "日本語"), (2, "12 – 3")], "doc_id long, text string"), model))[2]["lang_pred"] == "und"
    nothing = language_id.train(empty)
    assert by_id(language_id.identify(docs, nothing))[0]["lang_pred"] == "und"


def test_quality_ranks_prose_above_junk(spark, docs, empty):
    rows, labels = [], []
    for i in range(200):
        junk = i % 5 == 0
        rows.append((i, " ".join(w + "$$$" for w in prose(i, 60).split()) if junk else prose(i, 60 + i)))
        labels.append((i, 0 if junk else 1))
    df, known = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int")
    model = quality_rank.train(df, known.filter("doc_id < 120"))
    got = by_id(quality_rank.rank(df.filter("doc_id >= 120"), model))
    assert np.mean([r["predicted"] == (i % 5 != 0) for i, r in got.items()]) > 0.95
    assert all(0 <= r["score"] <= 1 for r in quality_rank.rank(docs, model).collect()) and quality_rank.rank(empty, model).count() == 0
    untrained = quality_rank.train(empty, known.limit(0))
    assert quality_rank.rank(docs, untrained).count() == docs.count()


def test_kernel_by_hand():
    assert toxicity.kernel(toxicity.encode("cat")[None], toxicity.encode("car"), 2, 0.5)[0] == pytest.approx(0.5**4)
    assert toxicity.kernel(toxicity.encode("cat")[None], toxicity.encode("cat"), 2, 0.5)[0] == pytest.approx(2 * 0.5**4 + 0.5**6)


def slow_kernel(s, t, order, decay):
    from itertools import combinations

    total = 0.0
    for a in combinations(range(len(s)), order):
        for b in combinations(range(len(t)), order):
            if all(s[i] == t[j] for i, j in zip(a, b, strict=True)):
                total += decay ** (a[-1] - a[0] + 1 + b[-1] - b[0] + 1)
    return total


@pytest.mark.parametrize(("a", "b"), [("gapped", "gaxpped"), ("aaaa", "aaa"), ("banana", "ananas"), ("abc", "xyz")])
def test_kernel_matches_its_definition(a, b):
    for order in (1, 2, 3, 4):
        assert toxicity.kernel(toxicity.encode(a)[None], toxicity.encode(b), order, 0.6)[0] == pytest.approx(slow_kernel(a, b, order, 0.6), rel=1e-5, abs=1e-7)


def test_toxicity_finds_gapped_insults(spark, docs, empty):
    rows, labels = [], []
    for i in range(240):
        words = prose(i, 60).split()
        if i % 4 == 0:
            words[10] = ["blockhead", "nincompoop"][i // 4 % 2]
        rows.append((i, " ".join(words)))
        labels.append((i, int(i % 4 == 0)))
    df, known = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    model = toxicity.train(df, known.filter("doc_id < 160"))
    got = by_id(toxicity.score(df.filter("doc_id >= 160"), model))
    assert all(r["predicted"] == (i % 4 == 0) for i, r in got.items())
    tries = [(1, "what a b l o c k h e a d he is"), (2, "you nincom-poop!"), (3, "you blockxhead you"), (4, "a kind and patient reader"), (5, None), (6, "")]
    found = by_id(toxicity.score(spark.createDataFrame(tries, "doc_id long, text string"), model))
    assert [found[k]["predicted"] for k in range(1, 7)] == [1, 1, 1, 0, 0, 0]
    assert toxicity.score(docs, model).count() == docs.count() and toxicity.score(empty, model).count() == 0
    assert toxicity.score(docs, toxicity.train(empty, known.limit(0))).filter("predicted = 1").count() == 0


def test_chunks_cut_by_size_and_take_nulls():
    import pyarrow as pa

    column = pa.array(["ab", None, "", "x" * 50, "é"])
    got = [(c.lo, c.hi, c.data.tobytes().decode()) for c in chunks(column.slice(1), 10)]
    assert [x for c in got for x in range(c[0], c[1])] == [0, 1, 2, 3] and "".join(c[2] for c in got) == "x" * 50 + "é"


def test_near_duplicates_match_all_pairs(spark):
    base, random, rows = [prose(s, 150) for s in (50, 51, 52)], np.random.default_rng(8), []
    for i in range(60):
        words = base[i % 3].split()
        for _ in range(int(random.integers(0, 3))):
            words[int(random.integers(0, len(words)))] = f"edit{random.integers(0, 9)}"
        rows.append((i * 11 % 60, " ".join(words)))
    expected = brute_components(rows, 5, lambda c, u: c >= 0.8 * u)
    got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(4))
    assert {r["doc_id"]: r["class_id"] for r in got.collect()} == expected
