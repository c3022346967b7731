"""Quality classifier by Bradley-Terry pairwise ranking.

A pair of a better and a worse labelled document is a comparison that the better one wins
with probability sigmoid(s(better) - s(worse)); s is linear in figures of the text, so fitting
is logistic regression on feature differences. Scores are then shifted and scaled so that the
cut, a quantile of the training scores, lies at the threshold.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.compression import base_figures
from tessera.llm.linear import sigmoid
from tessera.llm.vector import Chunk, chunks
from tessera.llm.shared import cut, map_arrow, release
from tessera.operators.metrics import LINEAR, percentiles

#: Labelled documents are compared in groups of about so many; each group has so many of a label, or all of that label.
GROUP, LEAST = 4000, 20
RIDGE, STEPS = 2e-3, 30
THRESHOLD = 0.7

_b = np.arange(256)
_UPPER, _ALPHA = (_b >= 65) & (_b <= 90), (_b >= 97) & (_b <= 122) | (_b >= 65) & (_b <= 90) | (_b >= 128)
_DIGIT = (_b >= 48) & (_b <= 57)
_PUNCT = np.isin(_b, np.frombuffer(b".,;:'\"-()", np.uint8))
_BANG = np.isin(_b, np.frombuffer(b"!?", np.uint8))
_PIPE = _b == ord("|")
_SYMBOL = np.isin(_b, np.frombuffer(b"#*$%&<>@^~_=+/\\{}[]`", np.uint8))
KNOTS = (0.02, 0.1, 0.3)


def figures(c: Chunk) -> np.ndarray:
    """n x m figures of the texts: logs, and shares with steps at KNOTS."""
    base = base_figures(c)
    size = np.maximum(1, np.diff(c.offsets))
    words = np.maximum(1, base["n_words"])
    lower = c.lowered
    keys = lower.hashes(*c.words) if len(c.words[0]) else np.zeros(0, np.uint64)
    salt = np.repeat(np.arange(c.n, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15), base["n_words"])
    _, first = np.unique(keys ^ salt, return_index=True)
    fresh = np.zeros(len(keys) + 1, np.int64)
    fresh[first + 1] = 1
    fresh = np.cumsum(fresh)
    distinct = fresh[c.word_offsets[1:]] - fresh[c.word_offsets[:-1]]
    twice = np.zeros(len(keys) + 1, np.int64)
    if len(keys) > 1:
        twice[2:] = np.cumsum(keys[1:] == keys[:-1])
    bounds = np.minimum(c.word_offsets + 1, len(keys))
    stutter = np.maximum(0, twice[c.word_offsets[1:]] - twice[np.minimum(bounds[:-1], len(keys))])
    lines = c.per_document(c.data == 10) + 1
    ends = c.words[1]
    last_bang = np.concatenate([[0], np.cumsum(_BANG[c.data[ends - 1]])]) if len(ends) else np.zeros(1, int)
    bang_words = last_bang[c.word_offsets[1:]] - last_bang[c.word_offsets[:-1]]
    shares = [
        c.per_document(_UPPER[c.data]) / size,
        c.per_document(_BANG[c.data]) / size * 5,
        c.per_document(_PIPE[c.data]) / words,
        c.per_document(_SYMBOL[c.data]) / size * 3,
        c.per_document(_DIGIT[c.data]) / size * 3,
        c.per_document(_PUNCT[c.data]) / words,
        1 - c.per_document(_ALPHA[c.data] | (c.data == 32)) / size,
        base["n_repeat_words"] / words,
        base["n_dup_lines"] / lines,
        stutter / words,
        bang_words / words,
        1 - distinct / words,
    ]
    out = [np.log(words), np.log(size / words), np.log(lines), np.log1p(words / lines)]
    for s in shares:
        out += [s, *(np.clip((s - k) / k, -1, 1) for k in KNOTS)]
    out.append((base["n_words"] < 10).astype(float))
    out.append(np.log1p(distinct) / np.log1p(words))
    return np.stack(out, axis=1)


@dataclass
class Model:
    centre: np.ndarray
    spread: np.ndarray
    weights: np.ndarray
    slope: float
    cut: float

    def score(self, x: np.ndarray) -> np.ndarray:
        raw = np.clip((x - self.centre) / self.spread, -6, 6) @ self.weights
        return sigmoid(self.slope * (raw - self.cut) + np.log(THRESHOLD / (1 - THRESHOLD)))


def train(docs: DataFrame, labels: DataFrame, label_col: str = "quality", id_col: str = "doc_id", text_col: str = "text", group: int = GROUP) -> Model:
    """Fit on all labelled documents, read whole. labels: (id, label). Null labels and ids teach nothing.

    Documents of equal figures and label are one with a weight. They are dealt by a hash of the figures into
    groups of about group, and in each every better one is compared with every worse one; Newton's steps add
    up the groups' sums, so the driver gets sums of the figures' number squared alone. The cut is the exact
    quantile of all labelled documents' scores below which the share of 0 lies. Rows that share an id share
    its label; the order of rows and other columns don't matter.
    """
    known = labels.filter(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).select(F.col(id_col).alias("__id"), F.col(label_col).cast("int").alias("__label"))
    kind = docs.schema[id_col].dataType.simpleString()
    measured = docs.select(id_col, text_col).transform(map_arrow, _measured, f"id {kind}, x binary")  # the join moves figures, not texts
    own = cut(measured.join(known, F.col("id") == F.col("__id")).groupBy("__label", "x").agg(F.count("*").alias("n")).select(F.col("__label").alias("label"), "x", "n"), "figures")
    counts = {r["label"]: (r["rows"], r["n"]) for r in own.groupBy("label").agg(F.count("*").alias("rows"), F.sum("n").alias("n")).collect() if r["label"] in (0, 1)}
    if not counts:
        release(own)
        return Model(np.zeros(1), np.ones(1), np.zeros(1), 1.0, 0.0)
    total, groups = sum(n for _, n in counts.values()), sum(rows for rows, _ in counts.values()) // group + 1
    dealt = own.filter("label IN (0, 1)").withColumn("own", F.pmod(F.xxhash64("x"), F.lit(groups)).cast("int"))
    rare = [label for label, (rows, _) in counts.items() if groups > 1 and rows < LEAST * groups]  # too few to be in every group: they go to all
    places = F.when(F.col("label").isin(rare), F.sequence(F.lit(0), F.lit(groups - 1))).otherwise(F.array("own")) if rare else F.array("own")
    packed = cut(dealt.withColumn("place", F.explode(places)).groupBy("place").applyInArrow(_packed, "place int, figures binary, labels binary, weights binary, owned binary"), "groups")
    try:
        return _fitted(packed, {label: n for label, (_, n) in counts.items()}, total)
    finally:
        release(own, packed)


def _packed(table: pa.Table) -> pa.Table:
    """A group as one row, in an order of its own. A rare document is owned by one of the groups that it goes to."""
    table = table.sort_by([("label", "ascending"), ("x", "ascending")])
    place = table.column("place")[0].as_py()
    column = lambda name: table.column(name).to_numpy()
    packed = [b"".join(table.column("x").to_pylist()), column("label").astype(np.int8).tobytes(), column("n").astype(np.float64).tobytes(), (column("own") == place).astype(np.float64).tobytes()]
    return pa.table({"place": pa.array([place], pa.int32()), **{name: pa.array([v], pa.binary()) for name, v in zip(("figures", "labels", "weights", "owned"), packed, strict=True)}})


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """(place, figures, labels, weights, weights of the group's own) of each group."""
    for batch in batches:
        for i in range(batch.num_rows):
            place, figures_, labels, weights, owned = (batch.column(c)[i].as_py() for c in range(5))
            labels, weights = np.frombuffer(labels, np.int8), np.frombuffer(weights)
            yield place, np.frombuffer(figures_).reshape(len(labels), -1), labels, weights, weights * np.frombuffer(owned)


def _summed(packed: DataFrame, sums: Callable) -> np.ndarray:
    """The sum over groups of an array that sums gives for each, added up in the groups' order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for place, *rest in _groups(batches):
            yield pa.RecordBatch.from_arrays([pa.array([place], pa.int32()), pa.array([np.asarray(sums(*rest), np.float64).tobytes()], pa.binary())], ["place", "v"])

    rows = packed.transform(map_arrow, run, "place int, v binary").toLocalIterator()  # sums of one size a group
    found = {r["place"]: np.frombuffer(bytes(r["v"])) for r in rows}
    return np.sum([found[place] for place in sorted(found)], axis=0)


def _fitted(packed: DataFrame, counts: dict[int, int], total: int) -> Model:
    centre = _summed(packed, lambda x, labels, weights, owned: owned @ x) / total
    spread = np.maximum(np.sqrt(_summed(packed, lambda x, labels, weights, owned: owned @ (x - centre) ** 2) / total), 1e-6)
    if len(counts) < 2:
        return Model(centre, spread, np.zeros(len(centre)), 1.0, -1.0 if 1 in counts else 1.0)
    scaled = lambda x: np.clip((x - centre) / spread, -6, 6)
    m = len(centre)
    w = np.zeros(m)
    for _ in range(STEPS):

        def newton(x: np.ndarray, labels: np.ndarray, weights: np.ndarray, owned: np.ndarray, w: np.ndarray = w) -> np.ndarray:
            z = scaled(x)
            good, bad, n = z[labels == 1], z[labels == 0], np.outer(weights[labels == 1], weights[labels == 0])
            p = sigmoid((good @ w)[:, None] - (bad @ w)[None, :])
            pull, curve = n * (p - 1), n * np.maximum(p * (1 - p), 1e-6)
            gradient = pull.sum(axis=1) @ good - pull.sum(axis=0) @ bad
            cross = good.T @ (curve @ bad)
            square = (good * curve.sum(axis=1)[:, None]).T @ good + (bad * curve.sum(axis=0)[:, None]).T @ bad - cross - cross.T
            return np.concatenate([[n.sum()], gradient, square.ravel()])

        sums = _summed(packed, newton)
        penalty = np.full(m, RIDGE * sums[0])
        step = np.linalg.solve(sums[1 + m :].reshape(m, m) + np.diag(penalty + 1e-9), sums[1 : 1 + m] + penalty * w)
        w = w - step * min(1.0, 4.0 / max(1e-12, np.abs(step).max()))
        if np.abs(step).max() < 1e-8:
            break

    def scores(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, x, _, _, owned in _groups(batches):
            mine = owned > 0
            raw = scaled(x[mine]) @ w
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(raw, owned[mine].astype(np.int64)))], ["s"])

    raw = packed.transform(map_arrow, scores, "s double").withColumn("g", F.lit(0))
    limit = percentiles(raw, ["g"], "s", {"cut": (LINEAR, counts[0] / total)}).first()["cut"]
    return Model(centre, spread, w, 1.0, float(limit))


def _measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for c in chunks(batch.column(1)):
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(c.lo, c.n), pa.array([r.tobytes() for r in figures(c)], pa.binary())], ["id", "x"])


def rank(docs: DataFrame, model: Model, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score, predicted) of every row; a null text scores as an empty one, which has no words and so ranks with the worst.

    A score depends on the text alone, so equal texts tie; a score of threshold is predicted 1. Very
    long texts are read whole. An empty table gives an empty result. Other columns are left out.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for c in chunks(batch.column(1)):
                x = figures(c)
                score = model.score(x if len(model.weights) > 1 else x[:, :1])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(c.lo, c.n), pa.array(score, pa.float64()), pa.array((score >= threshold).astype(np.int32))], [id_col, "score", "predicted"])

    return docs.select(id_col, text_col).transform(map_arrow, run, f"`{id_col}` {docs.schema[id_col].dataType.simpleString()}, score double, predicted int")


def op9_bradley_terry_quality(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))
    model = train(docs, labels.filter(~held_out).select("doc_id", "quality"))
    return rank(docs, model).select("doc_id", held_out.alias("held_out"), "score", "predicted")
