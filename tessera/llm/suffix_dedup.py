"""Exact removal of repeated strings of LENGTH bytes, by suffix sorting with a difference cover.

Sorting all suffixes of a corpus would move each byte many times, so the text is reduced first,
without losing a repeat:

1. Each window of LENGTH bytes has a sample in it: of the GRAM-byte strings that start in its
   first SPREAD places, the one with the smallest hash. The place depends on the window's bytes
   alone, so equal windows have their sample at the same offset (a cover of differences that
   the content chooses). Windows with one sample make a cell of up to SPREAD windows; all of
   them contain its core, the LENGTH - SPREAD + 1 bytes from the sample on.
2. Cells are counted by core and by their whole span. A core that occurs once has no repeated
   window. A span that occurs twice is repeated throughout.
3. What is left are cells at the ends of repeats. Their text around the core is fetched, they
   are cut into narrower cells, and counted again.
4. The cells that are still open are strings over bytes and core names. Those of one core name
   are brought together, and the suffixes of their text are sorted: sampled triples at places 1
   and 2 modulo 3, recursion on their names, a merge with the other suffixes; then adjacent
   suffixes are compared over a window. Cores with more than MOST strings are cut narrower
   instead, down to single windows, so that no group grows without bound.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.llm.difference_cover import repeats
from tessera.llm.shared import counted_join, cut, map_arrow
from tessera.llm.vector import Chunk, chunks, mix64, random_words

LENGTH, SPREAD, GRAM = 400, 192, 16
#: Cells of SPREAD windows are cut into cells of NARROW[0], and so on where too many meet.
NARROW = (48, 8, 1)
MOST = 5000
#: Requests for texts, and removed runs, up to this many rows are sent to every executor; more of them are joined.
SMALL_REQUESTS, SMALL_RUNS = 20_000, 400_000
SEGMENT = 1 << 22
#: Passages of so many words that documents share show in strings of so many words, one in each run of PASSAGE_WORDS.
PASSAGE_WORDS, PASSAGE_CORE = 51, 26

ROW = "__doc long, __text long"
CELL = f"{ROW}, __core long, __span long, __at int, __low int, __high int"
OPEN = f"{ROW}, __core long, __at int, __low int, __high int, __left binary, __right binary, __wanted boolean"


def smallest(keys: np.ndarray, spread: int) -> np.ndarray:
    """For each place p with spread keys from it on: the place of the smallest (the first of equal ones). Two sweeps over blocks, whatever the spread."""
    n = len(keys) - spread + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    out = np.empty(n, np.int64)
    for lo in range(0, n, SEGMENT):
        hi = min(n, lo + SEGMENT)
        part = keys[lo : hi + spread - 1]
        packed = (part >> np.uint64(24) << np.uint64(24)) | np.arange(len(part), dtype=np.uint64)
        blocks = -(-len(packed) // spread) + 1
        padded = np.full(blocks * spread, np.uint64(0xFFFFFFFFFFFFFFFF))
        padded[: len(packed)] = packed
        grid = padded.reshape(blocks, spread)
        forward = np.minimum.accumulate(grid, axis=1).ravel()
        backward = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
        count = hi - lo
        out[lo:hi] = (np.minimum(backward[:count], forward[spread - 1 : spread - 1 + count]) & np.uint64(0xFFFFFF)).astype(np.int64) + lo
    return out


def cells_of(c: Chunk, length: int, spread: int, gram: int) -> dict[str, np.ndarray]:
    """doc (in the chunk), sample, first and last window (all as places in the chunk), hashes of core and span."""
    n = len(c.data)
    if n < length:
        return {k: np.zeros(0, np.int64) for k in ("doc", "at", "low", "high")} | {k: np.zeros(0, np.uint64) for k in ("core", "span")}
    begin = np.arange(n - gram + 1)
    at = smallest(c.hashes(begin, begin + gram), spread)[: n - length + 1]
    doc = np.repeat(np.arange(c.n), np.diff(c.offsets))[: len(at)]
    inside = np.arange(len(at)) + length <= c.offsets[1:][doc]
    p = np.flatnonzero(inside)
    if not len(p):
        return cells_of(Chunk(0, 0, c.data[:0], np.zeros(1, np.int64)), length, spread, gram)
    a, d = at[p], doc[p]
    new = np.append(True, (a[1:] != a[:-1]) | (d[1:] != d[:-1]) | (p[1:] != p[:-1] + 1))
    low = p[new]
    high = p[np.append(np.flatnonzero(new)[1:] - 1, len(p) - 1)]
    at, doc = a[new], d[new]
    return {"doc": doc, "at": at, "low": low, "high": high, "core": c.hashes(at, at + length - spread + 1), "span": c.hashes(low, high + length)}


def keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(row key, text). A row is known by its id and 64 bits of a hash of its text, so that rows may share an id; a null id is an id."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(-(1 << 63))).alias("__doc"), F.xxhash64(text).alias("__text"), text.alias("__body"))


def cells(rows: DataFrame, length: int, spread: int, gram: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in CELL.split(", ")]
        for batch in batches:
            for c in chunks(batch.column(2)):
                f = cells_of(c, length, spread, gram)
                base = c.offsets[f["doc"]]
                keys = [batch.column(k).slice(c.lo, c.n).take(pa.array(f["doc"])) for k in (0, 1)]
                yield pa.RecordBatch.from_arrays([*keys, pa.array(f["core"].astype(np.int64)), pa.array(f["span"].astype(np.int64)), *(pa.array((f[k] - base).astype(np.int32)) for k in ("at", "low", "high"))], names)

    return rows.transform(map_arrow, run, CELL)


def per_row(rows: DataFrame, parts: DataFrame, columns: list[str]) -> DataFrame:
    """rows with their parts as __parts, an array of structs; rows without any are left out. parts is sent along if small, else joined."""
    lists = cut(parts.groupBy("__doc", "__text").agg(F.collect_list(F.struct(*columns)).alias("__parts"), F.count("*").alias("__n")), "lists")
    total = lists.agg(F.sum("__n")).first()[0] or 0
    lists = lists.drop("__n")
    return rows.join(F.broadcast(lists) if total <= SMALL_REQUESTS else lists, ["__doc", "__text"])


def fetch(rows: DataFrame, wanted: DataFrame, length: int, spread: int) -> DataFrame:
    """The text of open cells before and behind their core."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in OPEN.split(", ")]
        for batch in batches:
            for i in range(batch.num_rows):
                doc, text = batch.column(0)[i].as_py(), batch.column(1)[i].as_py()
                body = batch.column(2)[i].as_buffer().to_pybytes()
                out = [(doc, text, x["__core"], x["__at"], x["__low"], x["__high"], body[x["__low"] : x["__at"]], body[x["__at"] + length - spread + 1 : x["__high"] + length], x["__wanted"]) for x in batch.column(3)[i].as_py()]
                types = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.bool_())
                yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*out, strict=True), types, strict=True)], names)

    return per_row(rows, wanted, ["__core", "__at", "__low", "__high", "__wanted"]).select("__doc", "__text", "__body", "__parts").transform(map_arrow, run, OPEN)


def narrower(open_cells: DataFrame, spread: int, width: int) -> DataFrame:
    """Cells of up to spread windows cut into cells of up to width.

    A window at offset r before its sample is: the last r bytes of left, the core, the first
    spread - 1 - r bytes of right. Cells of offsets j to j + width - 1 share a longer core.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in OPEN.split(", ")]
        types = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.bool_())
        for batch in batches:
            for lo in range(0, batch.num_rows, 4096):
                out = []
                for doc, text, core, at, low, high, left, right, wanted in zip(*(c.to_pylist() for c in batch.slice(lo, 4096).columns), strict=True):
                    most, least = at - low, at - high
                    for j in range(least // width * width, most + 1, width):
                        k = j + width - 1
                        top, bottom = min(most, k), max(least, j)
                        inner = left[len(left) - j :] if j else b""
                        key = xxhash.xxh3_64(core.to_bytes(8, "little", signed=True) + bytes((j & 255, j >> 8)) + inner + b"|" + right[: max(0, spread - 1 - k)]).intdigest()
                        out.append((doc, text, key - (1 << 63), at - j, at - top, at - bottom, left[len(left) - top : len(left) - j], right[max(0, spread - 1 - k) : spread - 1 - bottom], wanted))
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*out, strict=True), types, strict=True)], names)

    return open_cells.transform(map_arrow, run, OPEN)


def sorted_repeats(group: DataFrame, width: int) -> DataFrame:
    """Repeated windows of wanted cells, by the suffix array of all strings that a task holds. Strings of one core are in one task; each ends in a symbol of its own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        table = pa.Table.from_batches(held)
        core = table.column("__core").to_numpy()
        order = np.argsort(core, kind="stable")
        bounds = np.flatnonzero(np.append(True, core[order][1:] != core[order][:-1]))
        bounds = np.append(bounds, len(order))
        left, right = table.column("__left").to_pylist(), table.column("__right").to_pylist()
        at, wanted = table.column("__at").to_numpy(), table.column("__wanted").to_numpy(zero_copy_only=False)
        docs, texts = table.column("__doc").to_numpy(), table.column("__text").to_numpy()
        lo = 0
        while lo < len(bounds) - 1:
            hi = int(max(lo + 1, np.searchsorted(bounds, bounds[lo] + 4 * MOST, "right") - 1))
            members = order[bounds[lo] : bounds[hi]]
            names = 257 + np.repeat(np.arange(hi - lo), np.diff(bounds[lo : hi + 1]))
            pieces, starts, place = [], [], 0
            for k, (i, name) in enumerate(zip(members, names, strict=True)):
                piece = np.concatenate([np.frombuffer(left[i], np.uint8).astype(np.int64) + 1, [name], np.frombuffer(right[i], np.uint8).astype(np.int64) + 1, [257 + hi - lo + k]])
                pieces.append(piece)
                starts.append(place)
                place += len(piece)
            # a window of this cell: r bytes, the core, width - 1 - r bytes
            found = repeats(np.concatenate(pieces), width)
            rows = []
            for k, i in enumerate(members):
                if not wanted[i]:
                    continue
                hit = np.flatnonzero(found[starts[k] : starts[k] + len(left[i]) + 1])
                if len(hit):
                    ends = np.flatnonzero(np.append(hit[1:] != hit[:-1] + 1, True))
                    firsts = np.append(0, ends[:-1] + 1)
                    rows += [(docs[i], texts[i], at[i] - len(left[i]) + hit[a], at[i] - len(left[i]) + hit[b]) for a, b in zip(firsts, ends, strict=True)]
            if rows:
                d, t, a, b = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(d, pa.int64()), pa.array(t, pa.int64()), pa.array(a, pa.int32()), pa.array(b, pa.int32())], ["__doc", "__text", "__low", "__high"])
            lo = hi

    n = int(group.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # few bytes, much work: not to be coalesced
    return group.repartition(n, "__core").transform(map_arrow, run, f"{ROW}, __low int, __high int")


def repeated_windows(rows: DataFrame, length: int = LENGTH, spread: int = SPREAD, gram: int = GRAM, narrow: tuple[int, ...] = NARROW, most: int = MOST) -> DataFrame:
    """(row key, low, high): runs of places where a string of length bytes starts that also starts elsewhere. A place may be in several runs."""
    spans = ["__doc", "__text", "__low", "__high"]
    all_cells = cut(cells(rows, length, spread, gram), "cells")
    cores = all_cells.groupBy("__core").agg(F.count("*").alias("__n"), F.min("__span").alias("__a"), F.max("__span").alias("__b")).filter("__n > 1").select("__core", "__n", (F.col("__a") == F.col("__b")).alias("__one"))
    repeated = cut(counted_join(all_cells, cut(cores, "cores"), ["__core"], all_cells.count()), "repeated")
    found = [repeated.filter("__one").select(*spans)]
    several = repeated.filter("NOT __one").drop("__one")
    kinds = several.groupBy("__core", "__span").agg(F.count("*").alias("__n"), F.min(F.struct("__doc", "__text", "__at", "__low", "__high")).alias("__first"))
    kinds = cut(kinds, "kinds")
    found.append(counted_join(several, kinds.filter("__n > 1").select("__core", "__span", "__n"), ["__core", "__span"], several.count()).select(*spans))
    lone = kinds.groupBy("__core").agg(F.min("__n").alias("__least")).filter("__least = 1").select("__core")
    wanted = kinds.join(lone, "__core").select("__core", "__first.*", (F.col("__n") == 1).alias("__wanted"))
    here = cut(fetch(rows, wanted, length, spread), "open")

    for step, width in enumerate(narrow):
        here = cut(narrower(here, spread, width), f"narrow{width}")
        same = here.groupBy("__core", "__left", "__right").agg(F.count("*").alias("__n"), F.min(F.struct("__doc", "__text", "__at", "__low", "__high")).alias("__first"), F.max("__wanted").alias("__wanted"))
        same = cut(same, f"same{width}")
        twice = same.filter("__n > 1 AND __wanted").select("__core", "__left", "__right")
        found.append(here.filter("__wanted").join(twice, ["__core", "__left", "__right"]).select(*spans))
        single = F.col("__wanted") & (F.col("__n") == 1)
        groups = same.groupBy("__core").agg(F.count("*").alias("__kinds"), F.max(single).alias("__some")).filter("__kinds > 1 AND __some").select("__core", "__kinds")
        left = same.join(groups, "__core").select("__first.__doc", "__first.__text", "__core", "__first.__at", "__first.__low", "__first.__high", "__left", "__right", single.alias("__wanted"), "__kinds")
        if width == 1:
            break  # a cell of one window is its core
        left = cut(left, f"left{width}")
        found.append(sorted_repeats(left.filter(F.col("__kinds") <= most), width))
        here = left.filter(F.col("__kinds") > most).drop("__kinds")
        spread = width
        if step + 1 == len(narrow) or not here.head(1):
            break
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return out


def passage_strings(rows: DataFrame, words: int, core: int) -> DataFrame:
    """(row key, string hash): of each words consecutive words, the string of core words in them with the smallest hash. Equal runs of words have the same one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        factors = random_words(core, 7) | np.uint64(1)
        for batch in batches:
            for c in chunks(batch.column(2)):
                each = c.hashes(*c.words)
                n = len(each) - core + 1
                if len(each) < words:
                    continue
                keys = np.zeros(n, np.uint64)
                for k in range(core):
                    keys += each[k : k + n] * factors[k]
                keys = mix64(keys)
                at = smallest(keys, words - core + 1)
                doc = np.repeat(np.arange(c.n), np.diff(c.word_offsets))[: len(at)]
                inside = np.flatnonzero(np.arange(len(at)) + words <= c.word_offsets[1:][doc])
                at, doc = at[inside], doc[inside]
                new = np.append(True, at[1:] != at[:-1]) if len(at) else np.zeros(0, bool)
                at, doc = at[new], doc[new]
                keys_of = [batch.column(k).slice(c.lo, c.n).take(pa.array(doc)) for k in (0, 1)]
                yield pa.RecordBatch.from_arrays([*keys_of, pa.array(keys[at].view(np.int64))], ["__doc", "__text", "__string"])

    return rows.transform(map_arrow, run, f"{ROW}, __string long")


def shared_passages(rows: DataFrame, words: int = PASSAGE_WORDS, core: int = PASSAGE_CORE) -> DataFrame:
    """(row key, __shared): how many of a row's passage strings rows of other ids have too. Above 0 wherever two documents share words consecutive words, however short these are in bytes."""
    strings = cut(passage_strings(rows, words, core), "strings")
    spread = strings.groupBy("__string").agg(F.min("__doc").alias("__a"), F.max("__doc").alias("__b"), F.count("*").alias("__n")).filter("__a <> __b").select("__string", "__n")
    return counted_join(strings, cut(spread, "spread"), ["__string"], strings.count()).groupBy("__doc", "__text").agg(F.count("*").alias("__shared"))


def merged_spans(windows: DataFrame, length: int) -> DataFrame:
    """(row key, start, end): maximal runs of bytes that the windows cover; runs that touch are one."""
    spans = windows.select("__doc", "__text", F.col("__low").alias("__s"), (F.col("__high") + length).alias("__e")).groupBy("__doc", "__text", "__s").agg(F.max("__e").alias("__e"))
    order = W.partitionBy("__doc", "__text").orderBy("__s")
    reach = F.max("__e").over(order.rowsBetween(W.unboundedPreceding, -1))
    run = F.sum(F.when(F.col("__reach") >= F.col("__s"), 0).otherwise(1)).over(order.rowsBetween(W.unboundedPreceding, W.currentRow))
    return spans.withColumn("__reach", reach).withColumn("__run", run).groupBy("__doc", "__text", "__run").agg(F.min("__s").alias("__start"), F.max("__e").alias("__end")).drop("__run")


def remove_repeats(docs: DataFrame, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """(id, n_bytes, n_removed, n_spans, n_shared_passages, kept binary) of every row: the bytes left when each byte of a repeated string of length bytes is gone.

    n_shared_passages tells of repeats that are too short for that: see shared_passages().

    Strings are judged on the input; matches don't cross rows. A null text is an empty one. Texts
    shorter than length lose nothing. Rows that are equal repeat each other and, from length bytes
    on, lose everything. kept may break within a character.
    """
    rows = keyed(docs, id_col, text_col)
    spans = merged_spans(repeated_windows(rows, length, **options), length)
    lists = cut(spans.groupBy("__doc", "__text").agg(F.sort_array(F.collect_list(F.struct("__start", "__end"))).alias("__spans"), F.count("*").alias("__n")), "spans")
    total = lists.agg(F.sum("__n")).first()[0] or 0
    lists = cut(lists.drop("__n").join(shared_passages(rows), ["__doc", "__text"], "full_outer"), "figures")
    total = max(total, lists.count())
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                part = batch.slice(lo, 512)
                sizes, removed, counts, kept = [], [], [], []
                shared = pc.fill_null(part.column(3), 0)
                for body, cuts in zip(part.column(1), part.column(2).to_pylist(), strict=True):
                    data = body.as_buffer().to_pybytes()
                    out, place = [], 0
                    for x in cuts or ():
                        out.append(data[place : x["__start"]])
                        place = x["__end"]
                    out.append(data[place:])
                    kept.append(b"".join(out))
                    sizes.append(len(data))
                    removed.append(len(data) - len(kept[-1]))
                    counts.append(len(cuts or ()))
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(v, pa.int64()) for v in (sizes, removed, counts)), shared, pa.array(kept, pa.binary())], [id_col, "n_bytes", "n_removed", "n_spans", "n_shared_passages", "kept"])

    full = docs.select(F.col(id_col), *[F.col(c) for c in (text_col,)])
    full = full.select(F.col(id_col).alias("__id"), F.coalesce(F.col(text_col), F.lit("")).alias("__body"))
    full = full.withColumns({"__doc": F.coalesce(F.col("__id").cast("long"), F.lit(-(1 << 63))), "__text": F.xxhash64("__body")})
    joined = full.join(F.broadcast(lists) if total <= SMALL_RUNS else lists, ["__doc", "__text"], "left").select("__id", "__body", "__spans", "__shared")
    return joined.transform(map_arrow, run, f"`{id_col}` {kind}, n_bytes long, n_removed long, n_spans long, n_shared_passages long, kept binary")


def op7_difference_cover_dedup(spark, sf_dir):
    out = remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"), "n_shared_passages")


def brute_force(texts: list[bytes], length: int = LENGTH) -> list[list[tuple[int, int]]]:
    """The removed runs of each text, by a table of all windows. For tests."""
    count: dict[bytes, int] = {}
    for t in texts:
        for i in range(len(t) - length + 1):
            key = hashlib.md5(t[i : i + length]).digest()
            count[key] = count.get(key, 0) + 1
    out = []
    for t in texts:
        runs: list[tuple[int, int]] = []
        for i in range(len(t) - length + 1):
            if count[hashlib.md5(t[i : i + length]).digest()] > 1:
                if runs and runs[-1][1] >= i:
                    runs[-1] = (runs[-1][0], i + length)
                else:
                    runs.append((i, i + length))
        out.append(runs)
    return out
