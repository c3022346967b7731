"""Language ID by hierarchical discrimination: the family first, then one-versus-one linear support vector machines within it.

Features are hashed counts of byte bigrams, trigrams and quadgrams of the lower-cased text, with digits and symbols as blanks.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.linear import fit_svm, sigmoid
from tessera.llm.vector import LOWER, Chunk, chunks
from tessera.llm.shared import map_arrow

#: Language codes by family. A code that isn't here is a family of its own.
FAMILIES = {
    "germanic": ("en", "de", "nl", "sv", "da", "no", "nb", "nn", "is", "af", "fy", "lb"),
    "romance": ("fr", "es", "it", "pt", "ca", "ro", "gl", "oc"),
    "slavic": ("ru", "uk", "be", "pl", "cs", "sk", "bg", "mk", "sr", "hr", "bs", "sl"),
    "uralic": ("fi", "et", "hu"),
    "baltic": ("lt", "lv"),
    "turkic": ("tr", "az", "kk", "uz"),
    "semitic": ("ar", "he", "mt"),
    "indo-aryan": ("hi", "bn", "mr", "ne", "ur", "pa", "gu"),
}
#: Learnt from at most so many documents of each of at most so many languages.
LANGUAGES = 200
PER_LANGUAGE = 1200
DIMENSIONS = 2048
GRAMS = (2, 3, 4)
UNDETERMINED = "und"

_bytes = np.arange(256)
_CLASS = np.where((_bytes >= 97) & (_bytes <= 122) | (_bytes >= 128), _bytes, 32)[LOWER].astype(np.uint64)


def features(c: Chunk, dimensions: int = DIMENSIONS) -> np.ndarray:
    """n x dimensions, rows of length 1 (0 for a text without letters)."""
    out = np.zeros(c.n * dimensions)
    x = _CLASS[c.data]
    doc = np.repeat(np.arange(c.n), np.diff(c.offsets))
    for k in GRAMS:
        if len(x) < k:
            continue
        code = np.zeros(len(x) - k + 1, np.uint64)
        for j in range(k):
            code = code * np.uint64(256) + x[j : len(x) - k + 1 + j]
        slot = ((code * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40)) % np.uint64(dimensions)
        same = (doc[: len(slot)] == doc[k - 1 :]) & ((code & np.uint64(0xFFFF)) != np.uint64(0x2020))
        out += np.bincount(doc[: len(slot)][same] * dimensions + slot[same].astype(np.int64), minlength=len(out))
    out = np.sqrt(out.reshape(c.n, dimensions))
    return (out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-9)).astype(np.float32)


def family_of(lang: str) -> str:
    return next((k for k, v in FAMILIES.items() if lang.split("-")[0].lower() in v), f"only:{lang}")


@dataclass
class Model:
    """families: name -> its languages; each pair (a, b) of either level has a weight vector and a bias, positive for a."""

    families: dict[str, list[str]]
    family_pairs: list[tuple[str, str, np.ndarray, float]]
    language_pairs: dict[str, list[tuple[str, str, np.ndarray, float]]]

    def predict(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        names = sorted(self.families)
        picked, sure = vote(names, self.family_pairs, x)
        lang, score = np.full(len(x), UNDETERMINED, object), sure.copy()
        for i, name in enumerate(names):
            at = np.flatnonzero(picked == i)
            if len(at):
                inner, more = vote(self.families[name], self.language_pairs[name], x[at])
                lang[at] = np.array(self.families[name], object)[inner]
                score[at] *= more
        return lang, score


def vote(names: list[str], pairs: list[tuple], x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The name that wins most duels, ties by summed margins; and how sure its duels are."""
    wins, sums, low = np.zeros((len(x), len(names))), np.zeros((len(x), len(names))), np.full((len(x), len(names)), 1.0)
    for a, b, w, bias in pairs:
        i, j = names.index(a), names.index(b)
        margin = x @ w + bias
        wins[:, i] += margin > 0
        wins[:, j] += margin <= 0
        sums[:, i] += margin
        sums[:, j] -= margin
        low[:, i] = np.minimum(low[:, i], sigmoid(3 * margin))
        low[:, j] = np.minimum(low[:, j], sigmoid(-3 * margin))
    best = np.argmax(wins + 1e-3 * np.tanh(sums), axis=1)
    return best, low[np.arange(len(x)), best]


def duels(names: list[str], of: np.ndarray, x: np.ndarray) -> list[tuple[str, str, np.ndarray, float]]:
    out = []
    for a, b in combinations(names, 2):
        at = np.flatnonzero((of == a) | (of == b))
        y = np.where(of[at] == a, 1.0, -1.0)
        weight = np.where(y > 0, 1 / max(1, (y > 0).sum()), 1 / max(1, (y < 0).sum()))
        w, bias = fit_svm(x[at].astype(np.float64), y, c=300.0, weight=weight)
        out.append((a, b, w.astype(np.float32), bias))
    return out


def fit(x: np.ndarray, lang: np.ndarray) -> Model:
    langs = sorted(set(lang))
    families: dict[str, list[str]] = {}
    for name in langs:
        families.setdefault(family_of(name), []).append(name)
    family = np.array([family_of(v) for v in lang], object)
    return Model(families, duels(sorted(families), family, x), {k: duels(v, lang, x) for k, v in families.items()})


def train(docs: DataFrame, per_language: int = PER_LANGUAGE, languages: int = LANGUAGES, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model:
    """Fit on about per_language documents of each of the languages most frequent values, picked by a hash of the id; whole texts.

    Rows without language or text teach nothing. Without any row the model answers `und`. Rows that
    share an id are picked together; the order of rows and other columns don't matter.
    """
    known = docs.filter(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    counted = known.groupBy(lang_col).agg(F.count("*").alias("n")).orderBy(F.desc("n"), lang_col).limit(languages)
    counts = {r[0]: r[1] for r in counted.collect()}
    if not counts:
        return Model({}, [], {})
    share = F.lit(0.0)
    for name, n in counts.items():
        share = F.when(F.col(lang_col) == name, F.lit(min(1.0, per_language / n))).otherwise(share)
    picked = known.filter((F.pmod(F.xxhash64(F.col(id_col).cast("string"), F.lit("lid")), F.lit(1 << 30)) / float(1 << 30)) < share)
    sample = picked.select(text_col, lang_col).transform(map_arrow, _hashed, f"lang string, x binary").toPandas()
    sample = sample.sort_values(["lang", "x"], ignore_index=True)
    if not len(sample):
        return Model({}, [], {})
    return fit(np.stack([np.frombuffer(v, np.float16) for v in sample["x"]]).astype(np.float32), sample["lang"].to_numpy(object))


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for c in chunks(batch.column(0)):
            rows = [r.tobytes() for r in features(c).astype(np.float16)]
            yield pa.RecordBatch.from_arrays([batch.column(1).slice(c.lo, c.n), pa.array(rows, pa.binary())], ["lang", "x"])


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, lang_pred, score) of every row; `und` and 0 for a null text or one without a letter.

    A prediction depends on the text alone; tied duels go by summed margins. Very long texts are read
    whole. An empty table gives an empty result. Other columns are left out.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for c in chunks(batch.column(1)):
                letters = c.per_document((_CLASS != 32)[c.data]) > 0
                suspects = np.flatnonzero(letters & (c.per_document(((_bytes >= 97) & (_bytes <= 122))[LOWER][c.data]) == 0))
                for i in suspects:  # bytes beyond ASCII need not be letters
                    letters[i] = any(map(str.isalpha, c.data[c.offsets[i] : c.offsets[i + 1]].tobytes().decode("utf-8", "replace")))
                lang, score = model.predict(features(c)) if model.families else (np.full(c.n, UNDETERMINED, object), np.zeros(c.n))
                lang[~letters], score = UNDETERMINED, np.where(letters, score, 0.0)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(c.lo, c.n), pa.array(lang, pa.string()), pa.array(score, pa.float64())], [id_col, "lang_pred", "score"])

    return docs.select(id_col, text_col).transform(map_arrow, run, f"`{id_col}` {docs.schema[id_col].dataType.simpleString()}, lang_pred string, score double")


def op5_hierarchical_language_id(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))
    model = train(docs.filter(~held_out).select("doc_id", "text", "lang"))
    return identify(docs, model).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")
