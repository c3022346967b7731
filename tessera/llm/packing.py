"""Bounded-space online packing of documents' token ids into sequences.

Each task tokenises the rows it reads and packs them as they come. It keeps OPEN windows at most, puts
a document's piece into the window that it fits best, and when it fits none, emits the fullest: with a
gap of SLACK tokens at most as it is, else filled up with the head of the piece at hand. Whole
sequences of a long document are emitted at once. What is left open at a task's end, OPEN windows, goes
on to a merge with that of FAN_IN - 1 other tasks, placed by falling length, and so on until one merge
is left. The last one strings its open pieces together and cuts the rest at powers of two, which need no
padding. So no task holds more than FAN_IN * OPEN windows, however many rows there are.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import compress
from operator import not_

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.shared import cut, emptiers, map_arrow

LENGTH, OPEN, SLACK, FAN_IN, END_ID = 4096, 64, 16, 16, 2
#: A worker keeps the ids of so many bytes of words at most, and is handed texts of about so many bytes at a time.
KEPT_BYTES, CHUNK_BYTES = 96 << 20, 1 << 20
ID_BYTES, LONG_WORD = 4, 1000
#: A sequence's number: the round that emitted it, its task or group there, and a count.
ROUND_BITS, GROUP_BITS = 56, 28


#: A word of small Latin letters (ASCII and U+00DF to U+00FF), which no rule of this tokenizer changes or splits, and the run of ASCII marks behind it. Apostrophes and `<` may begin what isn't a run of marks.
PLAIN = re.compile(rb"((?:[a-z]|\xc3[\x9f-\xb6\xb8-\xbf]){1,1000})([!-&(-/:;=>?@\[-`{-~]*)").fullmatch


def _parts(words: list[bytes], size: int = 2000) -> Iterator[list[bytes]]:
    return (words[lo : lo + size] for lo in range(0, len(words), size))


def _ids(tokenizer, text: bytes) -> np.ndarray:
    return np.array(tokenizer.encode_batch_fast([text.decode("utf-8", "replace")], add_special_tokens=False)[0].ids, "<u4")


class WordIds(dict):
    """Ids of words (bytes without ASCII white space) as little-endian 32-bit words, made by the tokenizer once each.

    Nothing that the tokenizer looks for may cross white space, which it drops, so that a text's ids
    are those of its words. New words go to the tokenizer many at a time. Plain words are told apart by
    the ids that end a word, where the vocabulary marks these, and need no more than its merges; others
    stand with one of its special tokens between them: it cuts its input there before anything else.
    """

    def __init__(self, tokenizer: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task is one core
        from tokenizers import Tokenizer

        super().__init__()
        self.tokenizer, self.held = Tokenizer.from_str(tokenizer), 0
        said = json.loads(tokenizer)
        normalizer, suffix, vocabulary = said.get("normalizer") or {}, said["model"].get("end_of_word_suffix"), said["model"]["vocab"]
        self.lowers = "Lowercase" in [n["type"] for n in normalizer.get("normalizers", [normalizer]) if n]
        self.plain = None
        if suffix:
            self.ends = np.zeros(max([*vocabulary.values(), *(t["id"] for t in said.get("added_tokens", []))]) + 1, bool)
            self.ends[[i for token, i in vocabulary.items() if token.endswith(suffix)]] = True
            bytes_only = [{"type": "CharDelimiterSplit", "delimiter": " "}, {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": False, "use_regex": False}]
            self.plain = Tokenizer.from_str(json.dumps(said | {"normalizer": None, "added_tokens": [], "pre_tokenizer": {"type": "Sequence", "pretokenizers": bytes_only}}))
        self.specials = [(t["content"].encode(), t["id"]) for t in said.get("added_tokens", []) if t["special"] and not (t["normalized"] or t["lstrip"] or t["rstrip"] or t["single_word"])]

    def words(self, text: bytes) -> list[bytes]:
        """The words; lower-cased, where the tokenizer does so itself and no special token could come of it, so that fewer differ."""
        return (text.lower() if self.lowers and b"<" not in text else text).split()

    def learn(self, new: list[bytes]) -> None:
        rest, letters, stopped = new, [], []
        if self.plain is not None:
            found = list(zip(new, map(PLAIN, new), strict=True))
            letters = [w for w, m in found if m and not m[2]]
            stopped = [(w, m[1], m[2]) for w, m in found if m and m[2]]
            rest = [w for w, m in found if not m]
            letters += {w for _, w, _ in stopped if w not in self}.difference(letters)
            rest += {w for _, _, w in stopped if w not in self}.difference(rest)
        for part in _parts(letters):  # one run of letters a word: its last id, and no other, ends a word
            ids = _ids(self.plain, b" ".join(part))
            ends = np.flatnonzero(self.ends[ids]) + 1
            if len(ends) != len(part):
                rest += part
                continue
            data, ends = ids.tobytes(), (ends * ID_BYTES).tolist()
            self.update(zip(part, (data[a:b] for a, b in zip([0, *ends], ends, strict=False)), strict=True))
        mark, mark_id = self.specials[0] if self.specials else (None, None)
        odd = [w for w in rest if mark is None or b"<" in w or len(w) > LONG_WORD]
        for w in odd:
            self[w] = _ids(self.tokenizer, w).tobytes()
        for part in _parts([w for w in rest if w not in self] if odd else rest):
            ids = _ids(self.tokenizer, mark.join(part))
            ends = np.append(np.flatnonzero(ids == mark_id), len(ids)) * ID_BYTES
            data, at = ids.tobytes(), 0
            for word, end in zip(part, ends.tolist(), strict=True):
                self[word] = data[at:end]
                at = end + ID_BYTES
        for word, letters_, marks in stopped:
            self[word] = self[letters_] + self[marks]
        self.held += 180 * (len(new) + len(stopped)) + 2 * sum(map(len, new))

    def encode(self, texts: list[bytes]) -> list[bytes]:
        if self.held > KEPT_BYTES:
            self.clear()
            self.held = 0
        words, ends = [], [0]
        for t in texts:
            words += self.words(t)
            ends.append(len(words))
        ids = list(map(self.get, words))
        missing = list(compress(range(len(words)), map(not_, ids)))
        self.learn(list({words[i] for i in missing}))
        for i in missing:
            ids[i] = self[words[i]]
        return [b"".join(ids[a:b]) for a, b in zip(ends[:-1], ends[1:], strict=True)]


_loaded: dict[int, WordIds] = {}
emptiers.append(_loaded.clear)


def loaded(tokenizer: str) -> WordIds:
    key = zlib.crc32(tokenizer.encode())
    if key not in _loaded:
        _loaded.clear()
        _loaded[key] = WordIds(tokenizer)
    return _loaded[key]


@dataclass
class Piece:
    """Ids of one document from start on. doc_tokens: how many the document has."""

    doc_id: object
    start: int
    doc_tokens: int
    ids: bytes

    def __len__(self) -> int:
        return len(self.ids) // ID_BYTES

    def split(self, n: int) -> tuple[Piece, Piece]:
        """The first n ids and the others."""
        return Piece(self.doc_id, self.start, self.doc_tokens, self.ids[: n * ID_BYTES]), Piece(self.doc_id, self.start + n, self.doc_tokens, self.ids[n * ID_BYTES :])


@dataclass
class Packer:
    """Windows of length ids, open_windows of them at most. Emitted ones are in done, as (number, pieces)."""

    first_number: int
    length: int = LENGTH
    open_windows: int = OPEN
    slack: int = SLACK
    done: list[tuple[int, list[Piece]]] = field(default_factory=list)
    gaps: list[tuple[int, int]] = field(default_factory=list)  # (gap, window), ascending
    windows: dict[int, list[Piece]] = field(default_factory=dict)
    opened: int = 0
    emitted: int = 0

    def emit(self, pieces: list[Piece]) -> None:
        self.done.append((self.first_number + self.emitted, pieces))
        self.emitted += 1

    def add(self, piece: Piece) -> None:
        while len(piece) >= self.length:
            whole, piece = piece.split(self.length)
            self.emit([whole])
        while len(piece):
            n = len(piece)
            at = bisect_left(self.gaps, (n, -1))
            if at < len(self.gaps):  # the smallest gap that takes it
                gap, window = self.gaps.pop(at)
                self.windows[window].append(piece)
                if gap == n:
                    self.emit(self.windows.pop(window))
                else:
                    insort(self.gaps, (gap - n, window))
                return
            if len(self.gaps) < self.open_windows:
                self.windows[self.opened] = [piece]
                insort(self.gaps, (self.length - n, self.opened))
                self.opened += 1
                return
            gap, window = self.gaps.pop(0)
            if gap > self.slack:
                head, piece = piece.split(gap)
                self.windows[window].append(head)
            self.emit(self.windows.pop(window))

    def left(self) -> list[Piece]:
        """The open windows' pieces, the fullest window's first."""
        return [p for _, window in self.gaps for p in self.windows[window]]

    def close(self) -> None:
        """Emit what is open without padding: full sequences, then powers of two."""
        pieces = self.left()
        self.gaps, self.windows = [], {}
        rest = sum(map(len, pieces))
        pieces.reverse()
        while rest:
            size = self.length if rest >= self.length else 1 << (rest.bit_length() - 1)
            rest -= size
            taken = []
            while size:
                piece = pieces.pop()
                if len(piece) > size:
                    piece, more = piece.split(size)
                    pieces.append(more)
                taken.append(piece)
                size -= len(piece)
            self.emit(taken)


def _schema(kind: pa.DataType) -> pa.Schema:
    longs = [(name, pa.int64()) for name in ("start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")]
    return pa.schema([("doc_id", kind), *longs, ("part", pa.int64()), ("ids", pa.binary())])


def _placed(done: list[tuple[int, list[Piece]]], schema: pa.Schema) -> pa.RecordBatch:
    rows = []
    for number, pieces in done:
        offset = 0
        for p in pieces:
            rows.append((p.doc_id, p.start, len(p), zlib.crc32(p.ids), p.doc_tokens, number, offset, None, None))
            offset += len(p)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True) if rows else [[]] * len(schema), schema, strict=True)], schema=schema)


def _open(pieces: list[Piece], part: int, schema: pa.Schema) -> pa.RecordBatch:
    columns = [[p.doc_id for p in pieces], [p.start for p in pieces], [len(p) for p in pieces], [None] * len(pieces), [p.doc_tokens for p in pieces], *[[None] * len(pieces)] * 2, [part] * len(pieces), [p.ids for p in pieces]]
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def pack(docs: DataFrame, tokenizer: str, end_id: int = END_ID, length: int = LENGTH, open_windows: int = OPEN, slack: int = SLACK, fan_in: int = FAN_IN, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset) of every piece. tokenizer: the text of its JSON file.

    A document is its text's ids and then end_id. A null, empty or blank text is end_id alone. A text
    longer than a sequence is cut into whole sequences and a rest. Every row is a document of its own,
    also where rows share an id or have none; the id comes back as it is. An empty table gives an empty
    result. Other columns are left out, so their names can't clash. Sequences have length ids, slack
    fewer at most, or a power of two. The tokens don't depend on how rows are dealt to tasks, the packing does.
    """
    spark = docs.sparkSession
    source = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
    from pyspark.sql.pandas.types import to_arrow_type

    schema = _schema(to_arrow_type(source.schema["doc_id"].dataType))
    packed = spark.sparkContext.broadcast(tokenizer)  # one vocabulary file
    end = np.array([end_id], "<u4").tobytes()

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, part = loaded(packed.value), TaskContext.get().partitionId()
        packer = Packer(part << GROUP_BITS, length, open_windows, slack)

        def flush(texts: list[bytes], ids: list) -> None:
            for i, found in zip(ids, words.encode(texts), strict=True):
                packer.add(Piece(i, 0, len(found) // ID_BYTES + 1, found + end))

        for batch in batches:
            texts, ids, held = [], [], 0
            for i, t in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                texts.append(t.as_py() or b"")
                ids.append(i)
                held += len(texts[-1])
                if held >= CHUNK_BYTES:
                    flush(texts, ids)
                    texts, ids, held = [], [], 0
                    yield _placed(packer.done, schema)
                    packer.done.clear()
            flush(texts, ids)
            yield _placed(packer.done, schema)
            packer.done.clear()
        yield _open(packer.left(), part, schema)

    def merged(turn: int, last: bool):
        def run(table: pa.Table) -> pa.Table:
            group = table.column("__group")[0].as_py()
            packer = Packer((turn << ROUND_BITS) | (group << GROUP_BITS), length, open_windows, slack)
            found = [Piece(r["doc_id"], r["start"], r["doc_tokens"], r["ids"]) for r in table.drop_columns(["__group"]).to_pylist()]
            for piece in sorted(found, key=lambda p: (-len(p), p.start, repr(p.doc_id), p.ids)):
                packer.add(piece)
            if last:
                packer.close()
            batches = [_placed(packer.done, schema), *([] if last else [_open(packer.left(), group, schema)])]
            return pa.Table.from_batches(batches, schema)

        return run

    tables = [cut(source.transform(map_arrow, first, _ddl(source)), "packed")]
    parts = (tables[0].agg(F.max("part")).first()[0] or 0) + 1
    turn, last = 0, False
    while not last:
        turn, last = turn + 1, parts <= fan_in
        grouped = tables[-1].filter("ids IS NOT NULL").withColumn("__group", F.expr(f"part div {fan_in}")).groupBy("__group")
        tables.append(cut(grouped.applyInArrow(merged(turn, last), _ddl(source)), "merged"))
        parts = -(-parts // fan_in)
    out = None
    for t in tables:
        placed = t.filter("ids IS NULL").drop("ids", "part")
        out = placed if out is None else out.unionByName(placed)
    return out


def _ddl(source: DataFrame) -> str:
    return f"doc_id {source.schema['doc_id'].dataType.simpleString()}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, part long, ids binary"


def word_tokenizer() -> str:
    import public_tokenizers

    with open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8") as f:
        return f.read()


def op11_bounded_space_packing(spark, sf_dir):
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"), word_tokenizer())
