"""Toxicity: a gap-weighted subsequence kernel with Nystroem landmarks under a linear support vector machine.

The kernel of two strings sums, over all subsequences of ORDER letters that both have, DECAY to
the power of the letters spanned in either. An insult with letters inserted or spaced out still
shares most of its subsequences with the landmark, at a discount for each gap.

A sentence's string is its words: letters only, lower case, with runs of single letters joined
("i d i o t", "i.d.i.o.t"). A sentence stands with a landmark as its best word does, and a
document as its best sentence. These similarities, whitened by the landmarks' own kernel
matrix, are the Nystroem features. Landmarks are the strings that best tell toxic documents of
the labelled sample from clean ones, with some ordinary words as a background. The machine is
trained on sentences: all of the clean documents and, of each toxic one, the sentence that
looks most toxic to the machine of the round before.
"""

from __future__ import annotations

import pickle
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.linear import fit_logistic, fit_svm, sigmoid
from tessera.llm.vector import Chunk, chunks, concatenated, mix64, powers, random_words
from tessera.llm.shared import map_arrow

ORDER, DECAY = 4, 0.7
LANDMARKS, BACKGROUND = 48, 2
#: Learnt from at most so many labelled documents of either kind.
TOXIC_SAMPLE, CLEAN_SAMPLE = 450, 1300
#: Words longer than this are read in overlapping windows of this length.
WIDTH = 24
LONGEST, SHORTEST = 9, 4
#: A landmark comes from so many toxic documents at least.
FEWEST = 4
ROUNDS = 3
#: Of the sampled documents with a landmark, so many are toxic.
SHARE = 0.93
#: The weight of words with an inserted letter against all toxic sentences.
GAPPED_WEIGHT = 0.2
#: A worker remembers up to 2**SEEN_BITS words that are like no landmark; likenesses up to LEAST count as none.
SEEN_BITS, LEAST = 20, 0.05
CHUNK_BYTES = 1 << 20


def _letters() -> np.ndarray:
    """For each code point below 0x10000: 0 for none, else its folded letter."""
    table = np.zeros(0x10000, np.uint16)
    for i in range(0x10000):
        ch = chr(i)
        if ch.isalpha():
            low = ch.lower()
            table[i] = ord(low) if len(low) == 1 and ord(low) < 0x10000 else i
    return table


_table: list[np.ndarray] = []


def letters() -> np.ndarray:
    if not _table:
        _table.append(_letters())
    return _table[0]


_LETTER_WORDS = random_words(0x10000, 23)
_BITS = np.uint32(1) << (np.arange(0x10000) * 2654435761 % (1 << 32) >> 27).astype(np.uint32)


@dataclass
class Words:
    """The words of a chunk: code holds all letters; starts and ends bound the words in it; sentence and doc place them."""

    code: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    sentence: np.ndarray
    doc: np.ndarray

    def keys(self) -> np.ndarray:
        forward, inverse = powers(len(self.code) + 1)
        total = np.zeros(len(self.code) + 1, np.uint64)
        np.cumsum(_LETTER_WORDS[self.code] * forward[:-1], out=total[1:])
        return mix64((total[self.ends] - total[self.starts]) * inverse[self.starts])

    def matrix(self, at: np.ndarray) -> np.ndarray:
        """Rows of WIDTH letters, 0 beyond the end."""
        size = self.ends[at] - self.starts[at]
        place = self.starts[at][:, None] + np.arange(WIDTH)
        return np.where(np.arange(WIDTH) < size[:, None], self.code[np.minimum(place, len(self.code) - 1)], 0).astype(np.uint16)


def split_words(c: Chunk) -> Words:
    points = np.frombuffer(c.data.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
    starts = (c.data & 0xC0) != 0x80
    before = np.zeros(len(c.data) + 1, np.int64)
    np.cumsum(starts, out=before[1:])
    offsets = before[c.offsets]
    points = np.where(points < 0x10000, points, 0).astype(np.uint16)
    code = letters()[points]
    blank = (points == 32) | (points >= 9) & (points <= 13) | (points == 0xA0)
    ender = (points == ord(".")) | (points == ord("!")) | (points == ord("?")) | (points == 10)
    is_letter = code > 0
    token_break = np.cumsum(blank)
    doc_of = np.repeat(np.arange(c.n), np.diff(offsets))
    at = np.flatnonzero(is_letter)
    if not len(at):
        none = np.zeros(0, np.int64)
        return Words(np.zeros(0, np.uint16), none, none, none, none)
    token = token_break[at]
    doc = doc_of[at]
    new = np.empty(len(at), bool)
    new[0] = True
    new[1:] = (token[1:] != token[:-1]) | (doc[1:] != doc[:-1])
    firsts = np.flatnonzero(new)
    sizes = np.diff(np.append(firsts, len(at)))
    single = sizes == 1
    merge = np.zeros(len(firsts), bool)
    merge[1:] = single[1:] & single[:-1] & (doc[firsts[1:]] == doc[firsts[:-1]])
    firsts = firsts[~merge]
    ends = np.append(firsts[1:], len(at))
    # a sentence ends at an ender that blanks follow
    stop = ender.copy()
    stop[:-1] &= blank[1:] | (points[:-1] == 10)
    sentence = np.cumsum(stop)[at[firsts]] + doc[firsts]  # + doc: a new document is a new sentence
    code = code[at]
    long = np.flatnonzero(ends - firsts > WIDTH)
    if len(long):
        more_s, more_e, more_i = [], [], []
        for i in long:
            s = np.arange(firsts[i] + WIDTH // 2, ends[i] - WIDTH // 2, WIDTH // 2)
            more_s.append(s)
            more_e.append(np.minimum(s + WIDTH, ends[i]))
            more_i.append(np.full(len(s), i))
        ends = ends.copy()
        ends[long] = firsts[long] + WIDTH
        keep = np.concatenate([np.arange(len(firsts)), *more_i])
        order = np.argsort(keep, kind="stable")
        docs, sentence = doc[firsts][keep][order], sentence[keep][order]
        return Words(code, np.concatenate([firsts, *more_s])[order], np.concatenate([ends, *more_e])[order], sentence, docs)
    return Words(code, firsts, ends, sentence, doc[firsts])


def kernel(words: np.ndarray, landmark: np.ndarray, order: int = ORDER, decay: float = DECAY) -> np.ndarray:
    """The subsequence kernel of each row of words with one landmark.

    The usual recursion: inner[t, j] holds, for prefixes of landmark and words, the weight of their
    common subsequences of the current length, carried on to the prefixes' ends.
    """
    n, width = words.shape
    m, d = len(landmark), np.float32(decay)
    columns = np.ascontiguousarray(words.T)
    equal = (columns[None] == landmark[:, None, None]).astype(np.float32) * (d * d)
    inner, spare = np.ones((m + 1, width + 1, n), np.float32), np.zeros((m + 1, width + 1, n), np.float32)
    carried, term = np.empty(n, np.float32), np.empty(n, np.float32)
    for length in range(1, order):
        spare[: length] = 0
        for t in range(length, m + 1):
            carried[:] = 0
            spare[t, :length] = 0
            for j in range(length, width + 1):
                np.multiply(equal[t - 1, j - 1], inner[t - 1, j - 1], out=term)
                carried *= d
                carried += term
                np.multiply(spare[t - 1, j], d, out=spare[t, j])
                spare[t, j] += carried
        inner, spare = spare, inner
    return np.einsum("tjn,tjn->n", equal[order - 1 :], inner[order - 1 : m, :width])


def encode(word: str) -> np.ndarray:
    return np.array([letters()[min(ord(ch), 0xFFFF)] or ord(ch) for ch in word], np.uint16)


@dataclass
class Landmarks:
    strings: list[str]

    def __post_init__(self) -> None:
        self.codes = [encode(s) for s in self.strings]
        width = max([len(c) for c in self.codes], default=1)
        rows = np.zeros((len(self.codes), width), np.uint16)
        for i, c in enumerate(self.codes):
            rows[i, : len(c)] = c
        self.own = np.array([kernel(rows[i : i + 1], c)[0] for i, c in enumerate(self.codes)])
        # a word needs letters of ORDER-long subsequences of the landmark: at least this many distinct bits
        self.masks = [np.bitwise_or.reduce(_BITS[np.unique(c)]) for c in self.codes]
        self.needed = [_distinct(c) if len(c) == ORDER else min(_distinct(c), 3) for c in self.codes]
        gram = np.array([kernel(rows, c) / k for c, k in zip(self.codes, self.own, strict=True)]).T if self.codes else np.zeros((0, 0))
        gram = np.minimum(1.0, (gram + gram.T) / 2)
        value, vector = np.linalg.eigh(gram + 0.05 * np.eye(len(gram))) if len(gram) else (np.ones(0), np.zeros((0, 0)))
        self.whiten = vector @ np.diag(1 / np.sqrt(np.maximum(value, 0.05))) @ vector.T
        self._unlike: np.ndarray | None = None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_unlike": None}  # what a worker remembers stays with it

    @property
    def unlike(self) -> np.ndarray:
        if self._unlike is None:
            self._unlike = np.zeros(1 << SEEN_BITS, np.uint64)
        return self._unlike

    def similarities(self, words: np.ndarray) -> np.ndarray:
        """n x landmarks: kernel over the landmark's own kernel, at most 1."""
        out = np.zeros((len(words), len(self.codes)), np.float32)
        if not len(words):
            return out
        masks = np.bitwise_or.reduce(np.where(words > 0, _BITS[words], np.uint32(0)), axis=1)
        size = (words > 0).sum(axis=1)
        for k, code in enumerate(self.codes):
            at = np.flatnonzero((np.bitwise_count(masks & self.masks[k]) >= self.needed[k]) & (size >= ORDER))
            for lo in range(0, len(at), 4096):
                some = at[lo : lo + 4096]
                found = words[some]
                width = int((found > 0).sum(axis=1).max())
                out[some, k] = np.minimum(1.0, kernel(found[:, :width], code) / self.own[k])
        return out


def _distinct(code: np.ndarray) -> int:
    """The fewest distinct mask bits in any ORDER letters taken from the landmark."""
    from itertools import combinations

    return min(int(np.bitwise_count(np.bitwise_or.reduce(_BITS[list(some)]))) for some in combinations(code.tolist(), ORDER))


def sentence_features(c: Chunk, marks: Landmarks) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(features, document, sentence) of the sentences with a word that is like a landmark."""
    w = split_words(c)
    m = len(marks.codes)
    if not len(w.starts) or not m:
        return np.zeros((0, m), np.float32), np.zeros(0, np.int64), np.zeros(0, np.int64)
    keys = w.keys()
    fresh = np.flatnonzero((marks.unlike[keys & np.uint64((1 << SEEN_BITS) - 1)] != keys) & (w.ends - w.starts >= ORDER))
    if not len(fresh):
        return np.zeros((0, m), np.float32), np.zeros(0, np.int64), np.zeros(0, np.int64)
    keys, first, inverse = np.unique(keys[fresh], return_index=True, return_inverse=True)
    found = marks.similarities(w.matrix(fresh[first]))
    like = found.max(axis=1) > LEAST
    keys = keys[~like]
    marks.unlike[keys & np.uint64((1 << SEEN_BITS) - 1)] = keys
    at = np.flatnonzero(like[inverse])
    hit, inverse = fresh[at], inverse[at]
    if not len(hit):
        return np.zeros((0, m), np.float32), np.zeros(0, np.int64), np.zeros(0, np.int64)
    sentence = w.sentence[hit]
    starts = np.flatnonzero(np.append(True, sentence[1:] != sentence[:-1]))
    return np.maximum.reduceat(found[inverse], starts, axis=0), w.doc[hit][starts], sentence[starts]


def _strings(word: str) -> set[str]:
    return {word[i : i + k] for k in range(SHORTEST, LONGEST + 1) for i in range(len(word) - k + 1)}


def _slot(s: str) -> int:
    """One of 2**22 counters, the same in every run."""
    return zlib.crc32(s.encode("utf-8", "surrogatepass")) & (1 << 22) - 1


def _vocabularies(texts: list[str]) -> Iterator[set[str]]:
    for text in texts:
        w = split_words(concatenated([text.encode("utf-8", "replace")]))
        yield {w.code[a:b].tobytes().decode("utf-16-le", "replace") for a, b in zip(w.starts, w.ends, strict=True)}


def pick_landmarks(toxic: list[str], clean: list[str], most: int = LANDMARKS, background: int = BACKGROUND) -> list[str]:
    """The strings of SHORTEST to LONGEST letters that best tell toxic documents from clean ones, then some ordinary words.

    A string counts if chance would hardly give it to so many toxic documents and so few clean
    ones, given how many strings were tried. Documents that share their smallest words' hashes are
    copies and count once. Strings in, around or always beside a better one are left out.
    """
    # counters by hash first, so that only strings that may be frequent are ever kept
    counters, tried = np.zeros(1 << 22, np.int16), 0
    for words in _vocabularies(toxic):
        found = {_slot(s) for x in words for s in _strings(x)}
        counters[list(found)] += 1
        tried += len(found)
    copies: dict[frozenset, int] = {}
    frequent: dict[str, int] = {}  # a bit for each group of copies
    for words in _vocabularies(toxic):
        group = copies.setdefault(frozenset(sorted(words, key=lambda x: (-len(x), x))[:3]), len(copies))
        for s in {s for x in words for s in _strings(x) if counters[_slot(s)] >= FEWEST}:
            frequent[s] = frequent.get(s, 0) | 1 << group
    frequent = {s: v for s, v in frequent.items() if v.bit_count() >= FEWEST}
    good = dict.fromkeys(frequent, 0)
    known: dict[str, frozenset[str]] = {}
    none: frozenset[str] = frozenset()
    common: dict[str, int] = {}
    for words in _vocabularies(clean):
        found: set[str] = set()
        for x in words:
            if x not in known:
                known[x] = frozenset(_strings(x) & good.keys()) or none
            found |= known[x]
            common[x] = common.get(x, 0) + 1
        for s in found:
            good[s] += 1
    base = len(copies) / max(1, len(copies) + len(clean))
    tried = np.log(max(10, tried)) + 2

    def evidence(s: str) -> float:
        a, b = frequent[s].bit_count(), good[s]
        share = a / (a + b)
        return a * np.log(share / base) + (b * np.log((1 - share) / (1 - base)) if b else 0.0) - tried if share > max(base, SHARE) else 0.0

    out: list[str] = []
    for value, _, s in sorted(((evidence(s), len(s), s) for s in frequent), reverse=True):
        if value <= 0 or len(out) == most - background:
            break
        beside = lambda x: (frequent[x] & frequent[s]).bit_count() > 0.9 * frequent[s].bit_count()  # noqa: B023, E731
        if not any(s in x or x in s or beside(x) and len(set(_strings(x)) & set(_strings(s))) for x in out):
            out.append(s)
    ordinary = sorted((x for x in common if len(x) >= 7), key=lambda x: (-common[x], x))
    return out + ordinary[:background]


def gapped_words(marks: Landmarks, clean: np.ndarray) -> np.ndarray:
    """Similarities of landmarks of five letters or more with one letter inserted, so that the machine learns to allow for gaps.

    Only those that stand out: hardly any clean sentence is as like the landmark. Inserted are two letters that it lacks.
    """
    kept = [np.zeros((0, len(marks.strings)), np.float32)]
    for k, s in enumerate(marks.strings):
        if len(s) < 5:
            continue
        forms = [s[:i] + letter + s[i:] for letter in [x for x in "xeaon" if x not in s][:2] for i in range(1, len(s))]
        words = np.zeros((len(forms), WIDTH), np.uint16)
        for i, r in enumerate(forms):
            words[i, : len(r)] = encode(r)
        found = marks.similarities(words)
        kept.append(found[[(clean[:, k] >= 0.9 * v).sum() <= 1 for v in found[:, k]]])
    return np.concatenate(kept)


@dataclass
class Model:
    marks: Landmarks
    weights: np.ndarray
    bias: float
    slope: float
    shift: float

    def score(self, c: Chunk) -> np.ndarray:
        """The probability of each document's most toxic sentence."""
        best = np.full(c.n, self.bias)
        if len(self.weights):
            x, doc, _ = sentence_features(c, self.marks)
            np.maximum.at(best, doc, x @ self.marks.whiten @ self.weights + self.bias)
        return sigmoid(self.slope * best + self.shift)


def fit(toxic: list[str], clean: list[str]) -> Model:
    marks = Landmarks(pick_landmarks(toxic, clean) if toxic and clean else [])
    if not marks.codes:
        return Model(marks, np.zeros(0), 0.0, 0.0, -2.0)
    x, doc = [], []
    for texts, start in ((toxic, 0), (clean, len(toxic))):
        for lo in range(0, len(texts), 64):
            a, d, _ = sentence_features(concatenated([t.encode("utf-8", "replace") for t in texts[lo : lo + 64]]), marks)
            x.append(a)
            doc.append(d + start + lo)
    x_raw, doc = np.concatenate(x), np.concatenate(doc)
    x = x_raw.astype(np.float64) @ marks.whiten
    n = len(toxic) + len(clean)
    # a document without any likeness to a landmark is one sentence of zeros
    bare = np.setdiff1d(np.arange(n), doc)
    x, doc = np.concatenate([x, np.zeros((len(bare), x.shape[1]))]), np.concatenate([doc, bare])
    bad = doc < len(toxic)
    gapped = gapped_words(marks, x_raw[doc[: len(x_raw)] >= len(toxic)]).astype(np.float64) @ marks.whiten
    use = np.ones(len(doc), bool)
    for _ in range(ROUNDS):
        y = np.where(bad[use], 1.0, -1.0)
        share = np.where(y > 0, 1.0 / (y > 0).sum(), 1.5 / max(1, (y < 0).sum()))
        if len(gapped):
            share = np.append(share, np.full(len(gapped), GAPPED_WEIGHT / len(gapped)))
        w, b = fit_svm(np.concatenate([x[use], gapped]), np.append(y, np.ones(len(gapped))), c=500.0, weight=share, steps=400)
        margin = x @ w + b
        order = np.lexsort((-margin, doc))
        top = np.zeros(len(doc), bool)
        top[order[np.append(True, doc[order][1:] != doc[order][:-1])]] = True
        use = ~bad | top
    best = np.full(n, b)
    np.maximum.at(best, doc, margin)
    slope, shift = fit_logistic(best[:, None], (np.arange(n) < len(toxic)).astype(float), ridge=1e-4)
    return Model(marks, w, b, float(slope[0]), shift)


def train(docs: DataFrame, labels: DataFrame, label_col: str = "toxic", toxic_sample: int = TOXIC_SAMPLE, clean_sample: int = CLEAN_SAMPLE, id_col: str = "doc_id", text_col: str = "text") -> Model:
    """Fit on at most toxic_sample and clean_sample labelled documents, picked by a hash of the id; whole texts. Null labels, ids and texts teach nothing.

    The sample meets in one task, which hands the driver the model alone. Rows that share an id
    share its label, and an id with both labels teaches both; other columns don't matter.
    """
    known = labels.filter(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull()).select(F.col(id_col).alias("__id"), F.col(label_col).cast("int").alias("__label"))
    order = [F.xxhash64(F.col("__id").cast("string"), F.lit("tox")), "__id"]
    picked = known.filter("__label = 1").orderBy(*order).limit(toxic_sample).unionByName(known.filter("__label = 0").orderBy(*order).limit(clean_sample))
    rows = docs.select(id_col, text_col).join(F.broadcast(picked), F.col(id_col) == F.col("__id")).filter(F.col(text_col).isNotNull()).select("__id", text_col, "__label")

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sample = sorted((r for batch in batches for r in zip(*(c.to_pylist() for c in batch.columns), strict=True)), key=lambda r: (r[0], r[1]))
        model = fit([t for _, t, bad in sample if bad], [t for _, t, bad in sample if not bad])
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(model)], pa.binary())], ["model"])

    made = rows.repartition(1).transform(map_arrow, learn, "model binary").collect()
    return pickle.loads(made[0]["model"]) if made else fit([], [])


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with score (0 to 1) and predicted (1 from 0.5 up).

    A null or empty text scores as one that is like no landmark. A score depends on the text alone,
    so rows of equal texts tie, whatever their ids; a tie at 0.5 is toxic. Very long texts are read
    whole, a chunk at a time. An empty table gives an empty result. Columns of these names are replaced.
    """
    rest = [c for c in docs.columns if c not in (text_col, "score", "predicted")]
    shape = T.StructType([*docs.select(*rest, text_col).schema, T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for c in chunks(batch.column(len(rest)), CHUNK_BYTES):
                found = model.score(c)
                columns = [batch.column(i).slice(c.lo, c.n) for i in range(len(rest) + 1)]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(found, pa.float64()), pa.array((found >= 0.5).astype(np.int32))], [*rest, text_col, "score", "predicted"])

    return docs.select(*rest, text_col).transform(map_arrow, run, shape)


def op1_string_kernel_toxicity(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))
    model = train(docs, labels.filter(~held_out).select("doc_id", "toxic"))
    return score(docs, model).select("doc_id", held_out.alias("held_out"), "score", "predicted")
