"""Quality rules: zstandard ratios of whole documents and of fixed chunks, held against limits for their length.

Text that repeats itself, or is built from few characters, compresses better than prose of its
length, and noise or ciphertext worse. The longer a text, the better it compresses and the less
prose varies, so limits go by length. Fixed bands hold whatever the corpus is. Within them, for each
half doubling of the length, the median of the ratios less or plus so many times their quartiles'
distance from it, interpolated between lengths, tightens them. Only documents whose ratio is within the
fixed band are learnt from, so a corpus full of noise neither widens limits nor moves them onto
itself. What is learnt counts by how many documents it comes from, beside PRIOR for the band.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.vector import IS_START, Chunk, chunks, shingle
from tessera.llm.shared import cut, map_arrow

LEVEL, CHUNK = 3, 4096
#: (bytes, lowest ratio, highest ratio) of whole documents, raw size over compressed size.
BANDS = ((50, 0.60, 1.45), (200, 1.10, 1.80), (500, 1.25, 2.05), (1000, 1.35, 2.20), (2000, 1.45, 2.35), (4096, 1.50, 2.50), (16384, 1.50, 2.75), (131072, 1.50, 3.10))
#: The same for full chunks; and the share of a document's bytes that may lie in chunks outside their limits.
CHUNK_BAND, CHUNK_SHARE = (1.40, 2.90), 0.05
#: Limits for each half doubling of the length: how many quartile distances (at least LEAST_SPREAD) the log of a ratio may lie below and above the median.
STEPS, BELOW, ABOVE, LEAST_SPREAD, PRIOR = 2, 8.0, 4.0, 0.01, 30
#: Logs of ratios are counted in cells of this width, LOWEST up; lengths up to 2**LONGEST bytes.
CELL, LOWEST, HIGHEST, LONGEST = 0.002, -2.0, 8.0, 40
SYMBOLS = b"#*$%&|<>"
MIN_WORDS, REPEAT_PERCENT, WINDOW = 10, 20, 5

SCHEMA = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, n_bytes long, ratio double, chunks array<struct<size:int,ratio:double>>"

_IS_SYMBOL = np.isin(np.arange(256), np.frombuffer(SYMBOLS, np.uint8))


def repeated(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each key, how often it occurs; and whether it's the first."""
    _, first, inverse, counts = np.unique(keys, return_index=True, return_inverse=True, return_counts=True)
    is_first = np.zeros(len(keys), bool)
    is_first[first] = True
    return counts[inverse], is_first


def base_figures(c: Chunk) -> dict[str, np.ndarray]:
    starts, ends = c.words
    places, n = c.word_offsets, c.n
    out = {"n_words": np.diff(places), "n_symbols": c.per_document(_IS_SYMBOL[c.data]), "word_chars": c.per_document(c.in_word & IS_START[c.data])}
    salt = np.arange(n, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)

    windows, window_places = shingle(c.hashes(starts, ends), places, WINDOW, whole=False)
    covered = np.zeros(len(starts) + 1, np.int64)
    if len(windows):
        sizes = np.diff(window_places)
        counts, _ = repeated(windows ^ np.repeat(salt, sizes))
        at = np.arange(len(windows)) + np.repeat(places[:-1] - window_places[:-1], sizes)
        at = at[counts > 1]
        np.add.at(covered, at, 1)
        np.add.at(covered, at + WINDOW, -1)
    inside = np.concatenate([[0], np.cumsum(np.cumsum(covered[:-1]) > 0)])
    out["n_repeat_words"] = inside[places[1:]] - inside[places[:-1]]

    line_starts, line_ends = c.runs(c.data != 10)
    with_word = np.concatenate([[0], np.cumsum(c.in_word)])
    has = with_word[line_ends] > with_word[line_starts]
    line_starts, line_ends = line_starts[has], line_ends[has]
    line_places = np.searchsorted(line_starts, c.offsets)
    dup = np.zeros(len(line_starts) + 1, np.int64)
    if len(line_starts):
        _, first = repeated(c.hashes(line_starts, line_ends) ^ np.repeat(salt, np.diff(line_places)))
        np.cumsum(~first, out=dup[1:])
    out["n_dup_lines"] = dup[line_places[1:]] - dup[line_places[:-1]]
    return out


def band(size: np.ndarray, bands=BANDS) -> tuple[np.ndarray, np.ndarray]:
    x = np.log(np.maximum(size, 1))
    at, low, high = (np.array(v, float) for v in zip(*bands, strict=True))
    return np.interp(x, np.log(at), low), np.interp(x, np.log(at), high)


def ratios(c: Chunk, level: int, chunk: int, least: int = BANDS[0][0]) -> tuple[np.ndarray, list[list[dict]]]:
    """Of each document: the ratio of the whole, and sizes and ratios of its chunks, the rest behind the last full one too.

    A rest shorter than least is part of the chunk before it. Documents shorter than a chunk are one whole, without chunks.
    """
    press = zstandard.ZstdCompressor(level=level, write_content_size=False, write_checksum=False).compress
    view = memoryview(np.ascontiguousarray(c.data))
    whole, parts = np.ones(c.n), []
    for i in range(c.n):
        a, b = int(c.offsets[i]), int(c.offsets[i + 1])
        if a < b:
            whole[i] = (b - a) / len(press(view[a:b]))
        cuts = [*range(a, b, chunk), b] if b - a >= chunk else []
        if len(cuts) > 2 and b - cuts[-2] < least:
            del cuts[-2]
        parts.append([{"size": y - x, "ratio": (y - x) / len(press(view[x:y]))} for x, y in zip(cuts[:-1], cuts[1:], strict=True)])
    return whole, parts


def measure(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", level: int = LEVEL, chunk: int = CHUNK) -> DataFrame:
    """One row per row of docs: the id, base figures, size in bytes, ratio of the whole and of the chunks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for c in chunks(batch.column(1)):
                f = base_figures(c)
                failed = (f["n_words"] < MIN_WORDS) | (100 * f["n_repeat_words"] > REPEAT_PERCENT * f["n_words"])
                whole, parts = ratios(c, level, chunk)
                names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
                kind = pa.list_(pa.struct([("size", pa.int32()), ("ratio", pa.float64())]))
                columns = [batch.column(0).slice(c.lo, c.n), *(pa.array(f[k], pa.int64()) for k in names), pa.array(failed), pa.array(np.diff(c.offsets), pa.int64()), pa.array(whole), pa.array(parts, kind)]
                yield pa.RecordBatch.from_arrays(columns, [id_col, *names, "base_failed", "n_bytes", "ratio", "chunks"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).transform(map_arrow, run, f"`{id_col}` {kind}, {SCHEMA}")


def length_step(size: Column) -> Column:
    return F.floor(F.log2(F.greatest(size, F.lit(1)).cast("double")) * STEPS).cast("int")


def quartiles(cells: np.ndarray, counts: np.ndarray) -> tuple[float, float, float]:
    """Of values counted in sorted cells."""
    total = np.cumsum(counts)
    return tuple(LOWEST + CELL * float(cells[np.searchsorted(total, share * total[-1])] + 0.5) for share in (0.25, 0.5, 0.75))


def learnt(counted: list, bands: dict[int, tuple[float, float]], below: float, above: float) -> dict[int, tuple[float, float]]:
    """{step: (lowest, highest ratio)} for the steps of bands, never wider than these. counted: (step, cell, n)."""
    out = dict(bands)
    for step in {r[0] for r in counted}:
        cells, counts = np.array(sorted((r[1], r[2]) for r in counted if r[0] == step)).T
        q1, q2, q3 = quartiles(cells, counts)
        spread, trust = max(q2 - q1, q3 - q2, LEAST_SPREAD), counts.sum() / (counts.sum() + PRIOR)
        low, high = np.log(bands[step])
        out[step] = (float(np.exp(max(low, low + trust * (q2 - below * spread - low)))), float(np.exp(min(high, high + trust * (q2 + above * spread - high)))))
    return out


def limits(measured: DataFrame, bands=BANDS, chunk: int = CHUNK, chunk_band: tuple[float, float] = CHUNK_BAND, below: float = BELOW, above: float = ABOVE) -> tuple[list[tuple[float, float]], tuple[float, float]]:
    """(lowest, highest) ratio for each step of the length, and for full chunks, from all documents and chunks that pass the base rule and lie within the fixed bands.

    What comes to the driver are counts in cells of length and ratio, a fixed number of cells at most, whatever the input.
    """
    low, high = band(2.0 ** ((np.arange(LONGEST * STEPS) + 0.5) / STEPS), bands)
    fixed = {k: (float(low[k]), float(high[k])) for k in range(LONGEST * STEPS)} | {-1: chunk_band}
    cell = lambda r: F.floor((F.least(F.greatest(F.log(r), F.lit(LOWEST)), F.lit(HIGHEST)) - LOWEST) / CELL).cast("int")
    within = lambda step, r: r.between(F.get(F.array(*map(F.lit, low.tolist())), step), F.get(F.array(*map(F.lit, high.tolist())), step))
    fit = measured.filter("NOT base_failed AND n_bytes > 0")
    wholes = fit.withColumn("step", length_step(F.col("n_bytes"))).filter(within(F.col("step"), F.col("ratio"))).select("step", cell(F.col("ratio")).alias("cell"))
    full = fit.select(F.explode("chunks").alias("c")).filter((F.col("c.size") == chunk) & F.col("c.ratio").between(*chunk_band)).select(F.lit(-1).alias("step"), cell(F.col("c.ratio")).alias("cell"))
    counted = [tuple(r) for r in wholes.unionByName(full).groupBy("step", "cell").agg(F.count("*").alias("n")).collect()]
    found = learnt(counted, fixed, below, above)
    return [found[k] for k in range(LONGEST * STEPS)], found[-1]


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bands=BANDS, level: int = LEVEL, chunk: int = CHUNK, chunk_band: tuple[float, float] = CHUNK_BAND, chunk_share: float = CHUNK_SHARE, below: float = BELOW, above: float = ABOVE) -> DataFrame:
    """One row per row of docs: the id, base figures, verdict (kept), whole ratio and share of bytes in odd chunks.

    A null or empty text has no words and fails the base rule. Very long texts are compressed whole.
    Repeated rows are judged alike. An empty table gives an empty result. Other columns of docs are left out.
    """
    measured = cut(measure(docs, id_col, text_col, level, chunk), "measured")
    steps, of_chunks = limits(measured, bands, chunk, chunk_band, below, above)

    def limit(size: Column, k: int) -> Column:
        """Interpolated between the middles of steps."""
        values = F.array(*(F.lit(s[k]) for s in steps))
        x = F.log2(F.greatest(size, F.lit(1)).cast("double")) * STEPS - 0.5
        at = F.least(F.greatest(F.floor(x), F.lit(0)), F.lit(len(steps) - 2)).cast("int")
        share = F.least(F.greatest(x - at, F.lit(0.0)), F.lit(1.0))
        return F.get(values, at) * (1 - share) + F.get(values, at + 1) * share

    def odd(c: Column) -> Column:
        is_full = c["size"] == chunk
        return (c["ratio"] < F.when(is_full, of_chunks[0]).otherwise(limit(c["size"], 0))) | (c["ratio"] > F.when(is_full, of_chunks[1]).otherwise(limit(c["size"], 1)))

    outside = F.aggregate(F.filter("chunks", odd), F.lit(0).cast("long"), lambda total, c: total + c["size"])
    out = measured.withColumn("odd_chunks", F.when(F.size("chunks") > 0, outside / F.col("n_bytes")).otherwise(0.0))
    within = F.col("ratio").between(limit(F.col("n_bytes"), 0), limit(F.col("n_bytes"), 1))
    out = out.withColumn("kept", ~F.col("base_failed") & within & (F.col("odd_chunks") <= chunk_share))
    return out.select(id_col, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "ratio", "odd_chunks")


def op2_compression_bands(spark, sf_dir):
    return judge(spark.read.parquet(f"{sf_dir}/documents.parquet"))
