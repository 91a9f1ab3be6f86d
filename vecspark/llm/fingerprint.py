"""Document fingerprints: invertible Bloom lookup sketches of a text's paragraphs.

A paragraph's digest is hashed into three cells of a sketch; a cell holds how many digests
fell into it, their XOR and the XOR of their check values. Subtracting the sketches of two
versions cancels what both have. Peeling takes the digests that are alone in a cell, one
after the other, out of the rest and so recovers which paragraphs differ on either side.
Where too many differ for the size of the sketch, both are made anew, twice as large.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vecspark.llm.common import row_batches, tasks_for, text_bytes
from vecspark.llm.register import query

CELLS = 30  # of the sketch that is the fingerprint
HASHES = 3  # cells a digest falls into, one in each third of the sketch
LARGEST = 8  # a sketch of more cells than so many times the digests is not tried
WORDS = 16  # a longer sentence is cut after so many words
TASK_BYTES = 16 << 20
CHUNK = 512  # documents that one round of numpy works on
FIRST_WORDS = 2
CHUNK_CHARS = 4 << 20
NO_ID = -(1 << 63)  # where a NULL id is ordered
SENTENCE = re.compile(r"[^.!?]*[.!?]+|[^.!?]+")

U = np.uint64


def paragraphs(text: str) -> list[str]:
    """The units that are compared: lines, cut into sentences, and these after every 16 words.

    The first 16 words of a text are cut after every 2, so that short texts have several units
    as well. Cuts only depend on what stands before them, so a change leaves earlier units alone.
    """
    out, seen = [], 0
    for line in text.split("\n"):
        for sentence in SENTENCE.findall(line):
            words = sentence.split()
            i = 0
            while i < len(words):
                n = FIRST_WORDS if seen < WORDS else WORDS
                out.append(" ".join(words[i : i + n]))
                i, seen = i + n, seen + n
    return out


def digests(text: str) -> np.ndarray:
    """A 64-bit digest per unit; the second and later copies of a unit get digests of their own."""
    seen: dict[int, int] = {}
    out = []
    for p in paragraphs(text):
        d = xxhash.xxh64_intdigest(p)
        n = seen.get(d, 0)
        seen[d] = n + 1
        out.append(d if not n else xxhash.xxh64_intdigest(d.to_bytes(8, "little"), n))
    return np.array(out, dtype=np.uint64)


def spread(x: np.ndarray, seed: int) -> np.ndarray:
    x = (x ^ U(seed * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)) * U(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> U(33))) * U(0xC4CEB9FE1A85EC53)
    return x ^ (x >> U(33))


def checks(x: np.ndarray) -> np.ndarray:
    return (spread(x, 77) & U(0xFFFFFFFF)).astype(np.uint32)


def places(x: np.ndarray, cells: int) -> np.ndarray:
    """The cells of each digest, [digest, hash]; each hash has a part of the sketch to itself."""
    part = U(cells // HASHES)
    return np.stack([(spread(x, cells + h) % part + U(h) * part).astype(np.int64) for h in range(HASHES)], axis=1)


class Sketches:
    """Sketches of many documents at once, as arrays of [document * cells]."""

    def __init__(self, documents: int, cells: int):
        self.documents, self.cells = documents, cells
        self.count = np.zeros(documents * cells, dtype=np.int32)
        self.keys = np.zeros(documents * cells, dtype=np.uint64)
        self.checks = np.zeros(documents * cells, dtype=np.uint32)

    def add(self, owner: np.ndarray, x: np.ndarray, sign) -> None:
        at = (places(x, self.cells) + (owner * self.cells)[:, None]).ravel()
        np.add.at(self.count, at, np.repeat(np.broadcast_to(np.asarray(sign, dtype=np.int32), x.shape), HASHES))
        np.bitwise_xor.at(self.keys, at, np.repeat(x, HASHES))
        np.bitwise_xor.at(self.checks, at, np.repeat(checks(x), HASHES))

    def peel(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Take out all that can be: owners, digests and signs of what was found, and which documents came out empty.

        A digest has at most one turn in a document, so peeling ends whatever the cells hold.
        """
        owners, found, signs = [], [], []
        for _ in range(64 + self.cells):
            pure = np.flatnonzero((np.abs(self.count) == 1) & (checks(self.keys) == self.checks))
            if not len(pure):
                break
            owner, x, sign = pure // self.cells, self.keys[pure], self.count[pure]
            order = np.lexsort((x, owner))
            owner, x, sign = owner[order], x[order], sign[order]
            once = np.ones(len(x), dtype=bool)
            once[1:] = (owner[1:] != owner[:-1]) | (x[1:] != x[:-1])
            owner, x, sign = owner[once], x[once], sign[once]
            self.add(owner, x, -sign)
            owners.append(owner)
            found.append(x)
            signs.append(sign)
        left = (self.count != 0) | (self.keys != 0) | (self.checks != 0)
        done = ~left.reshape(self.documents, self.cells).any(axis=1)
        if not owners:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int32), done
        return np.concatenate(owners), np.concatenate(found), np.concatenate(signs), done

    def texts(self) -> list[str]:
        """Each sketch as text: counts, keys and check values."""
        n = self.documents
        parts = [a.reshape(n, self.cells).astype(k).view(np.uint8).reshape(n, -1) for a, k in ((self.count, "<i4"), (self.keys, "<u8"), (self.checks, "<u4"))]
        return [base64.b85encode(row.tobytes()).decode() for row in np.concatenate(parts, axis=1)]


def joined(parts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Owners and digests of a list of digest arrays."""
    return np.repeat(np.arange(len(parts)), [len(p) for p in parts]), np.concatenate([np.zeros(0, np.uint64), *parts])


def fingerprints(parts: list[np.ndarray], cells: int = CELLS) -> list[str]:
    s = Sketches(len(parts), cells)
    s.add(*joined(parts), 1)
    return s.texts()


def differing(left: list[np.ndarray], right: list[np.ndarray], cells: int = CELLS) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each pair the digests only the left has and only the right has, from the difference of their sketches."""
    out: list = [None] * len(left)
    todo = list(range(len(left)))
    while todo:
        a, b = [left[i] for i in todo], [right[i] for i in todo]
        s = Sketches(len(todo), cells)
        s.add(*joined(a), 1)
        s.add(*joined(b), -1)
        owner, x, sign, done = s.peel()
        order = np.argsort(owner, kind="stable")
        owner, x, sign = owner[order], x[order], sign[order]
        cuts = np.searchsorted(owner, np.arange(len(todo) + 1))
        again = []
        for k, i in enumerate(todo):
            part, way = x[cuts[k] : cuts[k + 1]], sign[cuts[k] : cuts[k + 1]]
            if done[k]:
                out[i] = (part[way > 0], part[way < 0])
            elif cells > LARGEST * (len(a[k]) + len(b[k]) + CELLS):
                out[i] = (np.setdiff1d(a[k], b[k]), np.setdiff1d(b[k], a[k]))  # no sketch could be peeled
            else:
                again.append(i)
        todo, cells = again, cells * 2
    return out


def likeness(left: list[np.ndarray], right: list[np.ndarray]) -> list[float]:
    """Digests in both over digests in either, 1 if neither has any."""
    out = []
    for (only_left, only_right), a, b in zip(differing(left, right), left, right, strict=True):
        apart, all_of = len(only_left) + len(only_right), len(a) + len(b)
        out.append(1.0 if not all_of else (all_of - apart) / (all_of + apart))
    return out


def edited(text: str, following: str) -> str:
    """The last floor(n/2) code points replaced by the first as many of the following text, or all of it."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def with_next(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """Rows (doc_id, text, part, guest), dealt out by ranges of the ids and ordered in each part.

    A part's last row is a guest: the first document of the next range or, in the last part,
    the first of all. So each document stands before the one that follows it. The limits of
    the ranges, one per task, are ids of documents, found from the ids alone.
    """
    n = tasks_for(docs.sparkSession, text_bytes(docs, text), TASK_BYTES)
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    found = rows.agg(
        F.percentile_approx("doc_id", [i / n for i in range(1, n)] or [0.5], 100 * n).alias("limits"), F.min("doc_id").alias("least"), F.count_if(F.col("doc_id").isNull()).alias("nulls")
    ).first()
    least = NO_ID if found["nulls"] else found["least"]
    limits = np.array(sorted({*(found["limits"] or [])} - {least}) if n > 1 else [], dtype=np.int64)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = pc.fill_null(b.column(0), NO_ID).to_numpy()
            part, first = np.searchsorted(limits, ids, side="right"), np.isin(ids, limits)
            for of, guest in ((np.ones(len(ids), bool), False), (first, True), (ids == least, True)):
                own = np.flatnonzero(of)
                at = np.full(len(own), len(limits)) if guest and of is not first else part[own] - guest
                yield pa.RecordBatch.from_arrays([*b.take(pa.array(own)).columns, pa.array(at.astype(np.int32)), pa.array(np.full(len(own), guest))], ["doc_id", "text", "part", "guest"])

    dealt = rows.mapInArrow(deal, "doc_id long, text string, part int, guest boolean")
    return dealt.repartition(n, "part").sortWithinPartitions("part", "guest", F.col("doc_id").asc_nulls_first(), "text")


def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple[int | None, str, str]]]:
    """(doc_id, text, following text) of the ordered rows, some hundred at a time."""
    held, before, size = [], None, 0
    for b in row_batches(batches, 1):
        for i, t, part, guest in zip(*(c.to_pylist() for c in b.columns), strict=True):
            if before is not None and before[2] == part and not before[3]:
                held.append((before[0], before[1], t))
                size += len(before[1]) + len(t)
            before = (i, t, part, guest)
            if len(held) >= CHUNK or size > CHUNK_CHARS:
                yield held
                held, size = [], 0
    if held:
        yield held


def compare_with_edits(docs: DataFrame, cells: int = CELLS, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, sketch_cells) of every row.

    The next document is the next by id; rows of one id follow each other by text, NULL ids
    come first, and the first document follows the last (a single one follows itself). NULL
    texts count as empty: no digest, a sketch of empty cells. Two empty texts are alike (1).
    Texts are shuffled once, by ranges of the ids.
    """

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in pairs(batches):
            changed = [edited(t, n) for _, t, n in rows]
            own, of_edited, of_next = ([digests(t) for t in ts] for ts in ([t for _, t, _ in rows], changed, [n for _, _, n in rows]))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([i for i, _, _ in rows], pa.int64()),
                    pa.array([len(t) for _, t, _ in rows], pa.int64()),
                    pa.array([sha256(t.encode()).hexdigest() for t in changed]),
                    pa.array(fingerprints(own, cells)),
                    pa.array(fingerprints(of_edited, cells)),
                    pa.array(likeness(own, of_edited), pa.float64()),
                    pa.array(likeness(own, of_next), pa.float64()),
                ],
                ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
            )

    schema = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return with_next(docs, doc_id, text).mapInArrow(compare, schema)


@query("op9_fingerprints")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare_with_edits(spark.read.parquet(f"{sf_dir}/documents.parquet"))
