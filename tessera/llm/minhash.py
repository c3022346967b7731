"""Document fingerprints: MinHash by multiply-add-shift permutations over word shingles, in vectorised numpy.

Two texts' fingerprints agree in a share of their places that estimates the Jaccard likeness of
their sets of five-word shingles. near_duplicates() joins signature bands in Spark and verifies
the likeness exactly.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.llm.components import connected
from tessera.llm.jaccard_join import sets_of, verified
from tessera.llm.shared import counted_join, cut, map_arrow
from tessera.llm.vector import IS_START, Chunk, chunks, concatenated, mix64, random_words, shingle

#: 32 bands of 4 places miss a pair of likeness 0.8 with a probability of (1 - 0.8**4)**32, 5 in 10**8.
PERMUTATIONS, SHINGLE, BANDS, LIKENESS = 128, 5, 32, (80, 100)
CHUNK_BYTES = 1 << 18
#: Signatures keep 16 bits of a hash of each minimum: the minimum itself falls towards 0 as sets grow, its top bits with it.
EMPTY = np.uint16(0xFFFF)
TOP = np.uint64(0xFFFFFFFFFFFFFFFF)


def minima(hashes: np.ndarray, starts: np.ndarray, ends: np.ndarray, permutations: int = PERMUTATIONS) -> np.ndarray:
    """permutations x segments: the smallest permuted hash of each segment, all ones for an empty one."""
    out = np.full((permutations, len(starts)), TOP, np.uint64)
    full = np.flatnonzero(ends > starts)
    if not len(full):
        return out
    x = hashes >> np.uint64(32)
    factors, shifts = random_words(permutations, 11) | np.uint64(1), random_words(permutations, 13)
    cuts = np.stack([starts[full], np.minimum(ends[full], len(x))], axis=1).ravel()
    padded = np.concatenate([x, x[-1:]])  # so that an end is a valid place
    value = np.empty_like(padded)
    for k in range(permutations):
        np.multiply(padded, factors[k], out=value)
        np.add(value, shifts[k], out=value)
        out[k, full] = np.minimum.reduceat(value, cuts)[::2]
    return out


def small(least: np.ndarray) -> np.ndarray:
    """minima as segments x permutations of 16 bits. Places of different minima agree with a chance of 2**-16, whatever the sets' sizes; empty sets' are all ones."""
    return np.where(least == TOP, EMPTY, (mix64(least) >> np.uint64(48)).astype(np.uint16)).T


def places(c: Chunk, size: int) -> tuple[np.ndarray, np.ndarray]:
    return shingle(c.hashes(*c.words), c.word_offsets, size)


def signatures(c: Chunk, permutations: int = PERMUTATIONS, size: int = SHINGLE) -> np.ndarray:
    """n x permutations of 16 bits."""
    hashes, at = places(c, size)
    return small(minima(hashes, at[:-1], at[1:], permutations))


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The share of equal places; 1 for two empty sets."""
    return (a == b).mean(axis=1)


def hexed(signature: np.ndarray) -> list[str]:
    return [r.tobytes().hex() for r in signature.astype(">u2")]


def band_keys(signature: np.ndarray, bands: int) -> np.ndarray:
    """n x bands hashes of the bands' places, the band's number with them. A band's places fill whole 64-bit words."""
    words = np.ascontiguousarray(signature).view(np.uint64).reshape(len(signature), bands, -1)
    factors = random_words(words.shape[2] + bands, 17) | np.uint64(1)
    return mix64((words * factors[: words.shape[2]]).sum(axis=2, dtype=np.uint64) + factors[words.shape[2] :]).astype(np.int64)


def edited(c: Chunk, following: Chunk) -> tuple[list[bytes], list[bytes], np.ndarray, np.ndarray]:
    """Each text with its last quarter replaced by the head of the text that follows.

    Also the part that the edit touches (from four words before it), the number of shingles that stand before that part, and n_chars.
    """
    def positions(x: Chunk) -> tuple[np.ndarray, np.ndarray]:
        at = np.append(np.flatnonzero(IS_START[x.data]), len(x.data))
        return at, np.searchsorted(at, x.offsets)

    own, own_at = positions(c)
    other, other_at = positions(following)
    n_chars, n_other = np.diff(own_at), np.diff(other_at)
    quarter = n_chars // 4
    cuts = own[own_at[:-1] + n_chars - quarter]
    heads = other[other_at[:-1] + np.minimum(quarter, n_other)]
    whole_words = np.searchsorted(c.words[1], cuts, "left")  # words that end before the cut
    shared = np.maximum(0, np.minimum(whole_words, c.word_offsets[1:]) - c.word_offsets[:-1])
    data, next_data = c.data.tobytes(), following.data.tobytes()
    texts, tails = [], []
    for i in range(c.n):
        a, b, head = int(c.offsets[i]), int(cuts[i]), next_data[int(following.offsets[i]) : int(heads[i])]
        texts.append(data[a:b] + head)
        start = int(c.words[0][c.word_offsets[i] + shared[i] - SHINGLE + 1]) if shared[i] >= SHINGLE else a
        tails.append(data[start:b] + head)
    return texts, tails, np.where(shared >= SHINGLE, shared - SHINGLE + 1, 0), n_chars


def pair_rows(c: Chunk, following: Chunk) -> dict[str, np.ndarray | list]:
    """Fingerprints of texts, of their edited texts and of what follows."""
    texts, tails, kept, n_chars = edited(c, following)
    hashes, at = places(c, SHINGLE)
    common = minima(hashes, at[:-1], at[:-1] + kept)
    rest = minima(hashes, at[:-1] + kept, at[1:])
    t = concatenated(tails)
    more, more_at = places(t, SHINGLE)
    short = (kept > 0) & (np.diff(t.word_offsets) < SHINGLE)  # no shingle of its own
    changed = minima(more, more_at[:-1], np.where(short, more_at[:-1], more_at[1:]))
    return {"n_chars": n_chars, "edited_sha256": [hashlib.sha256(x).hexdigest() for x in texts], "own": small(np.minimum(common, rest)), "changed": small(np.minimum(common, changed))}


def op6_schema(kind: str) -> str:
    return f"doc_id {kind}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, part int, first binary, text binary"


def _emit(ids: pa.Array, rows: dict, next_own: np.ndarray) -> list[pa.Array]:
    n = len(ids)
    return [ids, pa.array(rows["n_chars"], pa.int64()), pa.array(rows["edited_sha256"], pa.string()), pa.array(hexed(rows["own"]), pa.string()), pa.array(hexed(rows["changed"]), pa.string()), pa.array(likeness(rows["own"], rows["changed"])), pa.array(likeness(rows["own"], next_own)), pa.nulls(n, pa.int32()), pa.nulls(n, pa.binary()), pa.nulls(n, pa.binary())]


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", partitions: int | None = None) -> DataFrame:
    """Of every row: fingerprint of the text and of its edited text, and likenesses to that and to the next row's text.

    The next row is the one with the next larger id, the first after the last; rows of one id are
    ordered by text, null ids come first. A null text is an empty one; the fingerprint of a text
    without words is all ones and equals that of another such text. Other columns are left out.

    Rows are range-sorted once and read as a stream; only the last row of each partition waits
    for the first row of the next, and these few rows are paired in a second step.
    """
    spark = docs.sparkSession
    kind = docs.schema[id_col].dataType.simpleString()
    schema = op6_schema(kind)
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    names = [f.split()[0] for f in schema.split(", ")]

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, first, held = TaskContext.get().partitionId(), None, None
        for batch in batches:
            for c in chunks(batch.column(1), CHUNK_BYTES):
                ids = batch.column(0).slice(c.lo, c.n)
                data = c.data.tobytes()
                texts = [data[c.offsets[i] : c.offsets[i + 1]] for i in range(c.n)]
                if held is None:
                    first = texts[0]
                else:
                    ids, texts = pa.concat_arrays([held[0], ids]), [held[1], *texts]
                if len(texts) > 1:
                    both = concatenated(texts)
                    rows = pair_rows(*_neighbours(both))
                    last = signatures(Chunk(0, 1, both.data[both.offsets[-2] :], both.offsets[-2:] - both.offsets[-2]))
                    yield pa.RecordBatch.from_arrays(_emit(ids[:-1], rows, np.concatenate([rows["own"][1:], last])), names)
                held = ids[-1:], texts[-1]
        if held is not None:
            empty = [pa.nulls(1, pa.int64()), *[pa.nulls(1, pa.string())] * 3, *[pa.nulls(1, pa.float64())] * 2]
            yield pa.RecordBatch.from_arrays([held[0], *empty, pa.array([part], pa.int32()), pa.array([first], pa.binary()), pa.array([held[1]], pa.binary())], names)

    def close(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                own, following = (concatenated([batch.column(k)[i].as_py()]) for k in (1, 2))
                yield pa.RecordBatch.from_arrays(_emit(batch.column(0).slice(i, 1), pair_rows(own, following), signatures(following)), names)

    ordered = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).repartitionByRange(n, "doc_id").sortWithinPartitions("doc_id", "text")
    table = cut(ordered.transform(map_arrow, stream, schema), "fingerprints")
    waiting = table.filter(F.col("part").isNotNull())
    turns = waiting.select("part").withColumn("follows", F.coalesce(F.lead("part").over(W.orderBy("part")), F.min("part").over(W.partitionBy())))
    heads = waiting.select(F.col("part").alias("follows"), F.col("first").alias("next"))
    closed = waiting.join(turns, "part").join(heads, "follows").select("doc_id", "text", "next").transform(map_arrow, close, schema)
    done = table.filter(F.col("part").isNull()).unionByName(closed)
    return done.drop("part", "first", "text")


def _neighbours(c: Chunk) -> tuple[Chunk, Chunk]:
    """All texts but the last, and all but the first."""
    return Chunk(0, c.n - 1, c.data[: c.offsets[-2]], c.offsets[:-1]), Chunk(0, c.n - 1, c.data[c.offsets[1] :], c.offsets[1:] - c.offsets[1])


def near_duplicates(docs: DataFrame, threshold: tuple[int, int] = LIKENESS, bands: int = BANDS, permutations: int = PERMUTATIONS, size: int = SHINGLE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, class_id) of every row: near-duplicate classes, the smallest id of each. Links are pairs that agree in a band and whose lower-cased shingle sets have a Jaccard likeness of threshold, verified exactly.

    In each bucket of a band all members are verified against the bucket's smallest id, so copies
    cost one pair a row; then pairs of a bucket that are still in different classes are verified
    too. Null texts and ids, and texts without words, are classes of their own.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for c in chunks(batch.column(1), CHUNK_BYTES):
                hashes, at = sets_of(c, size)
                sig = small(minima(hashes, at[:-1], at[1:], permutations))
                keys = [k if b > a else [] for k, a, b in zip(band_keys(sig, bands), at[:-1], at[1:], strict=True)]
                whole = [hashlib.md5(hashes[a:b].tobytes()).digest() for a, b in zip(at[:-1], at[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(c.lo, c.n), pa.array(whole, pa.binary()), pa.array(keys, pa.list_(pa.int64()))], ["__node", "__set", "__bands"])

    nodes = docs.filter(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("__node"), text_col)
    known = cut(nodes.transform(map_arrow, run, "__node long, __set binary, __bands array<long>").filter(F.size("__bands") > 0), "bands")
    same = known.groupBy("__set").agg(F.min("__node").alias("__low"), F.count("*").alias("__n"))
    twins = counted_join(known.select("__node", "__set"), same.filter("__n > 1"), ["__set"], known.count()).filter("__node <> __low").select(F.col("__low").alias("a"), F.col("__node").alias("b"))
    # one text stands for each set
    firsts = known.join(same.select(F.col("__low").alias("__node")), "__node", "left_semi").dropDuplicates(["__node"])
    buckets = cut(firsts.select("__node", F.explode("__bands").alias("__band")), "buckets")
    lowest = buckets.groupBy("__band").agg(F.min("__node").alias("a"), F.count("*").alias("__n")).filter("__n > 1")
    stars = cut(counted_join(buckets, lowest, ["__band"], buckets.count()).filter("__node <> a").select("a", F.col("__node").alias("b")).distinct(), "pairs")
    links = cut(verified(stars, docs, id_col, text_col, size, threshold).unionByName(twins), "links")
    classes = connected(links).select(F.col("id").alias("__node"), F.col("component").alias("__class"))
    placed = cut(buckets.join(lowest.select("__band"), "__band", "left_semi").join(classes, "__node", "left").withColumn("__class", F.coalesce("__class", "__node")), "placed")
    mixed = placed.join(placed.groupBy("__band").agg(F.min("__class").alias("x"), F.max("__class").alias("y")).filter("x <> y").select("__band"), "__band")
    other = mixed.select("__band", F.col("__node").alias("b"), F.col("__class").alias("__other"))
    rest = mixed.join(other, "__band").filter("__class < __other").select(F.col("__node").alias("a"), "b").distinct().join(stars, ["a", "b"], "left_anti")
    found = verified(cut(rest, "pairs"), docs, id_col, text_col, size, threshold)
    final = connected(cut(links.unionByName(found), "links")).withColumnRenamed("component", "class_id")
    return docs.select(id_col).join(final, F.col(id_col).cast("long") == F.col("id"), "left").select(id_col, F.coalesce("class_id", F.col(id_col)).alias("class_id"))


def op6_minhash_fingerprints(spark, sf_dir):
    return fingerprints(spark.read.parquet(f"{sf_dir}/documents.parquet"))
