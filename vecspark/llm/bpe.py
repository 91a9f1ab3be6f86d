"""Byte-level BPE encoding and decoding with the exact merges of a rank file, in linear time.

Bytes are mapped to Latin-1, so that an Aho-Corasick automaton over characters finds every
vocabulary token in a piece in one pass. From the longest match at each place the encoder
walks on, and steps back to a shorter match where two adjacent tokens would not stand next to
each other after the merges. Whether two tokens may is worked out once and remembered.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from hashlib import sha256

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession

from vecspark.llm.common import row_batches
from vecspark.llm.register import query

VOCABULARY = "byte_bpe_multi_50k.tiktoken"
KEPT_PIECES = 600_000  # pieces a worker remembers; the memory stays bounded, results do not depend on it
KEPT_LENGTH = 64  # longer pieces are not remembered
KEPT_PAIRS = 1_000_000
LONG_TEXT = 1 << 20  # texts of more characters are encoded part by part
MAX_RANKS = 32 << 20  # bytes of a rank file that may be broadcast


def read_ranks(path: str) -> bytes:
    """A rank file as it is: lines of a base64 token and its rank. A vocabulary is small; its size is checked."""
    with open(path, "rb") as f:
        lines = f.read(MAX_RANKS + 1)
    if len(lines) > MAX_RANKS:
        raise ValueError(f"{path} is larger than {MAX_RANKS} bytes")
    return lines


class Merges:
    """The tables that follow from a rank file, and the memory of one worker."""

    def __init__(self, lines: bytes, pattern: str):
        self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines.splitlines())}
        self.tokens = {r: t for t, r in self.ranks.items()}
        self.pattern = regex.compile(pattern)
        self.halves: dict[int, tuple[int, int]] = {}  # the two tokens a token is merged from
        self.shorter: dict[int, int] = {}  # the longest token that begins a token
        self.automaton = ahocorasick.Automaton()
        self.usual: set[int] = set()
        for token, rank in sorted(self.ranks.items(), key=lambda x: x[1]):
            if len(token) > 1:
                parts = self.merged([token[i : i + 1] for i in range(len(token))], rank)
                if len(parts) != 2:
                    continue  # merges never make it; it only stands for a whole piece
                a, b = self.ranks[parts[0]], self.ranks[parts[1]]
                if not (a in self.usual and b in self.usual and max(a, b) < rank):
                    raise ValueError(f"token {rank} is not made of earlier tokens")
                self.halves[rank] = (a, b)
            self.usual.add(rank)
            self.automaton.add_word(token.decode("latin-1"), (len(token), rank))
        self.automaton.make_automaton()
        for rank in self.usual:
            token = self.tokens[rank]
            for n in range(len(token) - 1, 0, -1):
                if (r := self.ranks.get(token[:n])) in self.usual:
                    self.shorter[rank] = r
                    break
        self.sizes = [0] * (max(self.tokens) + 1)
        for rank, token in self.tokens.items():
            self.sizes[rank] = len(token)
        self.pairs: dict[tuple[int, int], bool] = {}
        self.packed: dict[str, bytes] = {}

    def merged(self, parts: list[bytes], below: int) -> list[bytes]:
        """Merge the adjacent pair of lowest rank, first one first, as long as that rank is below the bound."""
        while len(parts) > 1:
            rank, i = min((self.ranks.get(parts[i] + parts[i + 1], below), i) for i in range(len(parts) - 1))
            if rank >= below:
                break
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return parts

    def adjacent(self, left: int, right: int) -> bool:
        """Whether merging the bytes of both tokens leaves just these two tokens.

        Both are taken apart again, the later merge first. At each step the tokens that meet
        at the border must not form a token that would have been merged before that step.
        """
        known = self.pairs.get((left, right))
        if known is not None:
            return known
        a, b, border = left, right, None  # border: the step undone last, as (rank, is it on the right)
        fits = True
        while True:
            joined = self.ranks.get(self.tokens[a] + self.tokens[b])
            if joined is not None and joined in self.usual and (border is None or (joined, 0) < border):
                fits = False
                break
            undo_left = a in self.halves and (border is None or (a, 0) < border)
            undo_right = b in self.halves and (border is None or (b, 1) < border)
            # Of equal merges the left one comes first, so the right one is undone first.
            if undo_left and (not undo_right or (a, 0) > (b, 1)):
                border, a = (a, 0), self.halves[a][1]
            elif undo_right:
                border, b = (b, 1), self.halves[b][0]
            else:
                break
        if len(self.pairs) >= KEPT_PAIRS:
            self.pairs.clear()
        self.pairs[(left, right)] = fits
        return fits

    def piece(self, data: bytes) -> list[int]:
        """Token ids of one match of the pattern."""
        whole = self.ranks.get(data)
        if whole is not None:
            return [whole]
        n = len(data)
        longest = [0] * n
        for end, (size, rank) in self.automaton.iter(data.decode("latin-1")):
            longest[end - size + 1] = rank  # later ends are longer
        sizes, pairs = self.sizes, self.pairs
        token = longest[0]
        out, at, dead = [token], sizes[token], set()  # dead: places from which no valid ending is left
        while at < n:
            last, token = out[-1], longest[at]
            while True:
                end = at + sizes[token]
                if end not in dead:
                    fits = pairs.get((last, token))
                    if fits if fits is not None else self.adjacent(last, token):
                        out.append(token)
                        at = end
                        break
                token = self.shorter.get(token)
                while token is None:  # nothing fits here: shorten the token before
                    dead.add(at)
                    at -= sizes[last]
                    out.pop()
                    token, last = self.shorter.get(last), out[-1] if out else None
                if last is None:  # the first token has no neighbour on its left
                    while sizes[token] in dead:
                        token = self.shorter[token]
                    out.append(token)
                    at = sizes[token]
                    break
        return out

    def pack(self, pieces: list[str]) -> bytes:
        """Ids of the pieces, one after the other, as little-endian unsigned 32-bit integers."""
        packed = self.packed
        for p in set(pieces).difference(packed):
            if len(packed) >= KEPT_PIECES:
                packed.clear()  # the texts at hand fill it again with what is frequent
                return b"".join(self.pack_one(p) for p in pieces)
            packed[p] = self.pack_one(p)
        return b"".join(map(packed.__getitem__, pieces))

    def pack_one(self, piece: str) -> bytes:
        known = self.packed.get(piece)
        if known is None:
            known = np.array(self.piece(piece.encode()), dtype="<u4").tobytes()
            if len(piece) <= KEPT_LENGTH:
                self.packed[piece] = known
        return known

    def encode(self, text: str) -> Iterator[bytes]:
        """Packed ids of the text, in parts of bounded size."""
        if len(text) <= LONG_TEXT:
            found = self.pattern.findall(text)
            if max(map(len, found), default=0) <= KEPT_LENGTH:
                yield self.pack(found)
                return
            yield b"".join(map(self.pack_one, found))
            return
        held: list[bytes] = []
        for m in self.pattern.finditer(text):
            held.append(self.pack_one(m[0]))
            if len(held) >= 100_000:
                yield b"".join(held)
                held = []
        yield b"".join(held)

    def decode(self, packed: bytes) -> bytes:
        return b"".join(map(self.tokens.__getitem__, np.frombuffer(packed, dtype="<u4").tolist()))


def tables(shared: Broadcast) -> Merges:
    """The tables of this worker, built once and kept beside the broadcast ranks."""
    state = shared.value
    if "merges" not in state:
        state["merges"] = Merges(state["lines"], state["pattern"])
    return state["merges"]


def share(spark: SparkSession, path: str, pattern: str) -> Broadcast:
    return spark.sparkContext.broadcast({"lines": read_ranks(path), "pattern": pattern})


def encode_digests(docs: DataFrame, path: str, pattern: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Encode every whole text and decode the ids again; ids and bytes as SHA-256 digests.

    One row per row of ``docs``, no shuffle. NULL texts count as empty: no token, digests of
    no bytes. NULL and repeated ids are kept as they are. Other columns are not read.
    """
    shared = share(docs.sparkSession, path, pattern)

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = tables(shared)
        for b in row_batches(batches, 1):
            counts, ids, decoded = [], [], []
            for t in b.column(1):
                n, a, d = 0, sha256(), sha256()
                for packed in m.encode(t.as_py() or ""):
                    n += len(packed) // 4
                    a.update(packed)
                    d.update(m.decode(packed))
                counts.append(n)
                ids.append(a.hexdigest())
                decoded.append(d.hexdigest())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(counts, pa.int64()), pa.array(ids, pa.string()), pa.array(decoded, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    kind = docs.schema[doc_id].dataType.simpleString()
    return docs.select(doc_id, text).mapInArrow(digests, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")


def encode_ids(docs: DataFrame, path: str, pattern: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, ids): the token ids of every whole text, NULL texts without any."""
    shared = share(docs.sparkSession, path, pattern)

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = tables(shared)
        for b in row_batches(batches, 1):
            ids = [np.frombuffer(b"".join(m.encode(t.as_py() or "")), dtype="<u4").astype(np.int32) for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(ids, pa.list_(pa.int32()))], ["doc_id", "ids"])

    return docs.select(doc_id, text).mapInArrow(encoded, f"doc_id {docs.schema[doc_id].dataType.simpleString()}, ids array<int>")


def decode_ids(tokens: DataFrame, path: str, pattern: str, doc_id: str = "doc_id", ids: str = "ids") -> DataFrame:
    """(doc_id, bytes): the bytes the ids stand for; NULL ids give no bytes."""
    shared = share(tokens.sparkSession, path, pattern)

    def decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = tables(shared)
        for b in batches:
            out = [b"".join(map(m.tokens.__getitem__, x.as_py() or [])) for x in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.binary())], ["doc_id", "bytes"])

    return tokens.select(doc_id, ids).mapInArrow(decoded, f"doc_id {tokens.schema[doc_id].dataType.simpleString()}, bytes binary")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return encode_digests(docs, public_tokenizers.path(VOCABULARY), public_tokenizers.PATTERN)


@query("op2_byte_bpe")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stage(spark, spark.read.parquet(f"{sf_dir}/documents.parquet"), sf_dir)
