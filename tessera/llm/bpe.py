"""Byte-level BPE encoding and decoding.

The merges are compiled, as texts ask for it, into a deterministic transducer over bytes. A
state is the last token that is settled and the bytes after it that aren't; each byte read
moves on and emits the tokens that no continuation can change any more.

Two facts carry it. A sequence of tokens is the encoding of its bytes just if each adjacent pair
is (the merges would leave it as it is), so the encoding of a prefix follows from those of
shorter ones. And a token that reaches beyond what has been read starts where a suffix of it is
the start of some token; what the encodings up to all such places have in common is settled.
Lookahead is bounded by the longest token.

Decoding joins the tokens' bytes and runs them through an incremental UTF-8 machine, so a
stream may be cut anywhere, also within a character.
"""

from __future__ import annotations

import base64
import codecs
import hashlib
import re
from array import array
from bisect import bisect_left, bisect_right
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from tessera.llm.shared import emptiers, map_arrow

#: A worker keeps at most so many states and so many encoded pieces.
MOST_STATES, MOST_PIECES, LONG_PIECE = 220_000, 150_000, 48
#: Rows are encoded and handed on so many at a time, and ids decoded.
ROWS, STEP = 256, 4096
#: No rank; and tokens with a common start that are tried one by one.
NEVER, MANY = 1 << 30, 6


def read_ranks(path: str) -> list[bytes]:
    """The tokens of a rank file in order of their ids."""
    with open(path, "rb") as file:
        rows = sorted((int(rank), base64.b64decode(token)) for token, rank in map(bytes.split, filter(None, map(bytes.strip, file))))
    if [r for r, _ in rows] != list(range(len(rows))):
        raise ValueError(f"{path}: the ranks aren't 0, 1, 2, ...")
    return [token for _, token in rows]


class State(dict):
    """byte -> (state, settled tokens), as far as it has been asked for.

    last: the last settled token (-1: none); rest: open bytes; back: for each place in them start
    and number of the token that ends there, and a bit for each boundary of the encoding up to it;
    live: places where a token that reaches beyond the open bytes may start; tail: what is left to
    emit if the piece ends here.
    """

    __slots__ = ("last", "rest", "back", "live", "tail")


class Transducer:
    """Encodes the bytes of one piece at a time."""

    def __init__(self, tokens: list[bytes], most_states: int = MOST_STATES) -> None:
        self.tokens, self.most_states = tokens, most_states
        self.ids = {t: i for i, t in enumerate(tokens)}
        self.longest = max(map(len, tokens))
        self.starts = {t[:k] for t in tokens for k in range(len(t))}
        self.ordered = sorted(tokens)
        self.fits: dict[int, bool] = {}
        self.follows: dict[tuple[int, bytes], int] = {}
        self.spans: dict[bytes, tuple[int, int]] = {}
        self.edges: dict[int, list] = {}
        self.reset()

    def reset(self) -> None:
        self.states: dict[tuple, State] = {}
        self.first = self.state(-1, b"", ((0, -1, 0),), (0,))

    def state(self, last: int, rest: bytes, back: tuple, live: tuple) -> State:
        # what came before matters only by the tokens that it lets follow
        key = (self.followers(last, rest) if live[0] == 0 else 0, rest, back)
        found = self.states.get(key)
        if found is None:
            found = self.states[key] = State()
            found.last, found.rest, found.back, found.live, found.tail = last, rest, back, live, None
        return found

    def merged(self, data: bytes, trace: list | None = None) -> list[bytes]:
        """The merges carried out as they are defined: the adjacent pair of lowest rank first."""
        parts, ids = [data[i : i + 1] for i in range(len(data))], self.ids
        while len(parts) > 1:
            rank, at = min((ids.get(parts[i] + parts[i + 1], NEVER), i) for i in range(len(parts) - 1))
            if rank == NEVER:
                break
            if trace is not None:
                trace.append((rank, at, parts[0], parts[-1], len(parts)))
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def edge(self, token: int, right: bool) -> list[tuple[bytes, int, int]]:
        """The parts that stand at an end of the token while it is merged: (part, rank that makes it, rank that uses it up)."""
        key = token << 1 | right
        found = self.edges.get(key)
        if found is None:
            trace: list = []
            self.merged(self.tokens[token], trace)
            found, made = [], -1
            for rank, at, first, last, n in trace:
                if right and at == n - 2 or not right and at == 0:
                    found.append((last if right else first, made, rank))
                    made = rank
            found.append((self.tokens[token], made, NEVER))
            self.edges[key] = found
        return found

    def fit(self, a: int, b: int) -> bool:
        """Whether tokens a and b, side by side, stay as they are: no merge across the border comes before those within."""
        if a < 0:
            return True
        key = a << 20 | b
        found = self.fits.get(key)
        if found is None:
            if len(self.fits) > 200_000:
                self.fits.clear()
            found = True
            for x, x_made, x_used in self.edge(a, True):
                for y, y_made, y_used in self.edge(b, False):
                    if x_made < y_used and y_made < x_used:
                        rank = self.ids.get(x + y, NEVER)
                        if rank < x_used and rank <= y_used and rank < NEVER:
                            found = False
            self.fits[key] = found
        return found

    def followers(self, last: int, start: bytes) -> int:
        """Which tokens that begin with start, and are longer, may stand after last: a bit for each, 0 for none; -2 - last if there are too many to try."""
        if start not in self.starts:
            return 0
        lo, hi = self.spans.get(start) or self.spans.setdefault(start, (bisect_right(self.ordered, start), bisect_left(self.ordered, start + b"\xff" * self.longest)))
        if last < 0 or hi - lo > MANY:
            return -2 - last
        key = (last, start)
        found = self.follows.get(key)
        if found is None:
            if len(self.follows) > 150_000:
                self.follows.clear()
            found = self.follows[key] = sum(1 << k for k in range(hi - lo) if self.fit(last, self.ids[self.ordered[lo + k]]))
        return found

    def step(self, state: State, byte: int) -> tuple[State, tuple[int, ...]]:
        last, rest, back, live = state.last, state.rest + bytes((byte,)), state.back, state.live
        n = len(rest)
        for i in live:
            token = self.ids.get(rest[i:])
            if token is not None and self.fit(back[i][1] if i else last, token) and (i or last >= 0 or self.alone(token)):
                back += ((i, token, back[i][2] | 1 << n),)
                break
        else:
            raise ValueError(f"no token for the byte {byte:#x}")
        live = (*(j for j in live if self.followers(back[j][1] if j else last, rest[j:])), n)
        common = -1
        for j in live:  # boundaries that the encodings up to all these places have
            common &= back[j][2]
        settled: list[int] = []
        if common:
            top = k = common.bit_length() - 1
            while k:
                settled.append(back[k][1])
                k = back[k][0]
            settled.reverse()
            last, rest = settled[-1], rest[top:]
            # places before the boundary are none of a live encoding
            back = ((0, -1, 0), *((max(0, b[0] - top), b[1], b[2] >> top & ~1) for b in back[top + 1 :]))
            live = tuple(j - top for j in live)
        found = state[byte] = (self.state(last, rest, back, live), tuple(settled))
        return found

    def alone(self, token: int) -> bool:
        return self.merged(self.tokens[token]) == [self.tokens[token]]

    def end(self, state: State) -> tuple[int, ...]:
        if state.tail is None:
            out, k = [], len(state.rest)
            while k:
                out.append(state.back[k][1])
                k = state.back[k][0]
            state.tail = tuple(reversed(out))
        return state.tail

    def encode(self, piece: bytes) -> list[int]:
        if len(self.states) > self.most_states:
            self.reset()
        state, out = self.first, []
        for byte in piece:
            move = state.get(byte)
            if move is None:
                move = self.step(state, byte)
            state, settled = move
            if settled:
                out += settled
        out += self.end(state)
        return out


class Pieces(dict):
    """Encoded pieces: text -> the ids as 32-bit words. Misses go through the transducer; when full it starts anew."""

    def __init__(self, transducer: Transducer, most: int = MOST_PIECES) -> None:
        super().__init__()
        self.transducer, self.most = transducer, most

    def __missing__(self, piece: str) -> bytes:
        found = array("i", self.transducer.encode(piece.encode("utf-8"))).tobytes()
        if len(piece) <= LONG_PIECE:
            if len(self) >= self.most:
                self.clear()
            self[piece] = found
        return found


_pieces: dict[bytes, Pieces] = {}
emptiers.append(_pieces.clear)


def pieces_of(tokens: list[bytes]) -> Pieces:
    """One cache per vocabulary and worker, so that tasks profit from each other."""
    key = hashlib.sha256(b"\0".join(tokens)).digest()
    if key not in _pieces:
        _pieces.clear()
        _pieces[key] = Pieces(Transducer(tokens))
    return _pieces[key]


class StreamDecoder:
    """Turns ids into text as they come; characters that are cut wait for their rest. Broken UTF-8 becomes U+FFFD."""

    def __init__(self, tokens: list[bytes]) -> None:
        self.tokens = tokens
        self.machine = codecs.getincrementaldecoder("utf-8")("replace")

    def feed(self, ids: Iterable[int], final: bool = False) -> str:
        return self.machine.decode(b"".join(map(self.tokens.__getitem__, ids)), final)


def streamed(tokens: list[bytes], ids: np.ndarray, step: int = STEP) -> bytes:
    """The UTF-8 bytes of the text that ids decode to, step of them at a time."""
    stream = StreamDecoder(tokens)
    parts = [stream.feed(ids[k : k + step].tolist()) for k in range(0, len(ids), step)]
    return "".join([*parts, stream.feed((), final=True)]).encode()


class ByteTable:
    """The bytes of all tokens side by side, for decoding arrays of ids without a loop."""

    def __init__(self, tokens: list[bytes]) -> None:
        self.data = np.frombuffer(b"".join(tokens), np.uint8)
        self.ends = np.cumsum([len(t) for t in tokens])
        self.starts = np.concatenate([[0], self.ends[:-1]])

    def decode(self, ids: np.ndarray) -> bytes:
        if not len(ids):
            return b""
        sizes = self.ends[ids] - self.starts[ids]
        places = np.cumsum(sizes)
        return self.data[np.arange(places[-1]) + np.repeat(self.starts[ids] - places + sizes, sizes)].tobytes()


#: The characters below U+0250 that the standard library's classes sort as the pattern's do. Texts of these alone, under the pattern that PLAIN renders, take the faster engine.
PLAIN_TEXT = re.compile(r"[\x00-\x1b\x20-\xb1\xb4-\xb8\xba\xbb\xbf-\u024f]*\Z")
PLAIN = {
    r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+""": r"""'s|'t|'re|'ve|'m|'ll|'d| ?[^\W\d_]+| ?[0-9]+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+""",
}


def splitter(pattern: str) -> Callable[[str], list[str]]:
    """Finds the matches of a pattern in a text."""
    general = regex.compile(pattern).findall
    if pattern not in PLAIN:
        return general
    fast, plain = re.compile(PLAIN[pattern]).findall, PLAIN_TEXT.match
    return lambda text: fast(text) if plain(text) else general(text)


def encode(docs: DataFrame, tokens: list[bytes], pattern: str, text_col: str = "text", decoded: bool = False) -> DataFrame:
    """docs with token_ids array<int>: each match of pattern encoded by itself, without special tokens. A null text is an empty one.

    decoded: also decoded binary, what the ids alone decode to, streamed through StreamDecoder. Columns of these names are replaced.
    """
    rest = [c for c in docs.columns if c not in (text_col, "token_ids", *["decoded"] * decoded)]
    added = [T.StructField("token_ids", T.ArrayType(T.IntegerType(), False)), *[T.StructField("decoded", T.BinaryType())] * decoded]
    schema = T.StructType([*docs.select(*rest, text_col).schema, *added])
    packed = docs.sparkSession.sparkContext.broadcast(tokens)  # one vocabulary, fixed in size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache, find = pieces_of(packed.value), splitter(pattern)
        for batch in batches:
            for lo in range(0, batch.num_rows, ROWS):
                part = batch.slice(lo, ROWS)
                found = [b"".join(map(cache.__getitem__, find(x))) if x else b"" for x in part.column(len(rest)).to_pylist()]
                offsets = np.zeros(len(found) + 1, np.int32)
                np.cumsum([len(x) // 4 for x in found], out=offsets[1:])
                ids = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(found), np.int32)))
                whole = [pa.array([streamed(packed.value, np.frombuffer(f, np.int32)) for f in found], pa.binary())] if decoded else []
                yield pa.RecordBatch.from_arrays([*part.columns, ids, *whole], schema.names)

    return docs.select(*rest, text_col).transform(map_arrow, run, schema, keep_caches=True)


def decode(df: DataFrame, tokens: list[bytes], ids_col: str = "token_ids") -> DataFrame:
    """df with decoded binary in place of the ids: the tokens' bytes. Null ids decode to nothing. A column named decoded is replaced."""
    rest = [c for c in df.columns if c not in (ids_col, "decoded")]
    schema = T.StructType([*df.select(*rest).schema, T.StructField("decoded", T.BinaryType())])
    packed = df.sparkSession.sparkContext.broadcast(tokens)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = ByteTable(packed.value)
        for batch in batches:
            for lo in range(0, batch.num_rows, ROWS):
                part = batch.slice(lo, ROWS)
                out = [table.decode(row.values.to_numpy()) if row.is_valid else b"" for row in part.column(len(rest))]
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(out, pa.binary())], schema.names)

    return df.select(*rest, ids_col).transform(map_arrow, run, schema, keep_caches=True)


def digest(docs: DataFrame, tokens: list[bytes], pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256) of every row: encoded, then decoded from the ids alone."""
    ids = encode(docs.select(id_col, text_col), tokens, pattern, text_col, decoded=True)
    return ids.select(id_col, F.size("token_ids").cast("long").alias("n_tokens"), F.sha2(F.array_join("token_ids", " "), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def vocabulary() -> tuple[list[bytes], str]:
    import public_tokenizers

    return read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken")), public_tokenizers.PATTERN


def op4_transducer_bpe(spark, sf_dir):
    return digest(spark.read.parquet(f"{sf_dir}/documents.parquet"), *vocabulary())
