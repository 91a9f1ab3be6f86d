"""Exact removal of passages that an earlier document has, by a logarithmic family of suffix indexes.

Every 50 bytes are the beginning of a suffix. Documents come in batches of rising ids. The
suffixes of a batch, sorted by the hash of their first bytes, are its index; it is scanned
against the indexes of earlier batches, and indexes of like size are merged, so that a new
batch meets few of them. Each task holds such a family for its range of hashes.

Only suffixes that may repeat are sent at all. The 50 bytes of a suffix hold 27 grams of 24
bytes; the least of their hashes is its mark. Suffixes in a row with the same mark are a
run, and equal strings have equal marks, so three exchanges do, each of what is left:

1. the marks of a batch; those that another batch has are answered;
2. runs of such marks as a whole; whole runs that an earlier batch has are found here, which
   are most of a long match. Marks whose runs are not all alike are answered as well;
3. single suffixes of such runs, which are those at both ends of a match.

Texts are shuffled once and stay in their tasks; each exchange meets them by its batch.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vecspark.llm.common import fresh, mix64, planes, tasks_for, text_bytes, unplanes
from vecspark.llm.register import query

LENGTH = 50  # bytes of a match
GRAM = 24
MARKS = LENGTH - GRAM + 1  # grams of a suffix, and suffixes of a run at most
BATCH_BYTES = 4 << 20  # a suffix that is looked at takes some hundred bytes, and all of a batch may be
TASK_MARKS = 64 << 20  # bytes of text whose marks one task indexes
CHUNK = 1 << 15  # positions worked on at a time: small enough for a processor's cache
NO_ID = -(1 << 63)

U = np.uint64
C1, C2, C3, C4 = U(0x9E3779B97F4A7C15), U(0xC2B2AE3D27D4EB4F), U(0x165667B19E3779F9), U(0xD6E8FEB86659FD93)
ASK, ANSWER = "bucket int, part int, kind int, a binary, b binary", "part int, kind int, a binary"
MARK, RUN, ALIKE, SUFFIX, MIXED = range(5)  # kinds of rows


# ---- runs of suffixes with one mark ----


def eights(buf: np.ndarray) -> np.ndarray:
    """The 8 bytes from each position on, as a number; a view."""
    return np.ndarray((len(buf) - 7,), dtype="<u8", buffer=buf, strides=(1,))


def marks(e: np.ndarray, start: int, n: int) -> np.ndarray:
    """The marks of n suffixes from a position on."""
    g = n + MARKS - 1
    h = e[start : start + g] * C1
    t = e[start + 8 : start + 8 + g] * C2
    h += t
    np.multiply(e[start + 16 : start + 16 + g], C3, out=t)
    h ^= t
    np.right_shift(h, U(32), out=t)
    h ^= t
    h *= C4
    have = 1
    while have < MARKS:
        step = min(have, MARKS - have)
        h = np.minimum(h[:-step], h[step:])
        have += step
    return h


def runs(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(mark, first suffix, last suffix, document) of each run of the documents in the padded buffer.

    Runs do not cross documents and hold 27 suffixes at most, counted from their first.
    """
    e, total = eights(buf), int(ends[-1]) if len(ends) else 0
    heads, values, before = [], [], None
    for c in range(0, total, CHUNK):
        m = marks(e, c, min(CHUNK, total - c))
        new = np.flatnonzero(m[1:] != m[:-1]) + 1
        if before is None or m[0] != before:
            new = np.concatenate(([0], new))
        heads.append(new + c)
        values.append(m[new] >> U(16))
        own = starts[np.searchsorted(starts, c) : np.searchsorted(starts, c + len(m))]
        heads.append(own)  # a document begins a run, whatever stands before it
        values.append(m[own - c] >> U(16))
        before = m[-1]
    if not heads:
        return np.zeros(0, U), *(np.zeros(0, np.int64),) * 3
    lo, first = np.unique(np.concatenate(heads), return_index=True)
    mark = np.concatenate(values)[first]
    hi = np.append(lo[1:], total) - 1
    doc = np.searchsorted(ends, lo, side="right")
    hi = np.minimum(hi, ends[doc] - LENGTH)
    ok = hi >= lo
    mark, lo, hi, doc = mark[ok], lo[ok], hi[ok], doc[ok]
    if len(lo) and (hi - lo).max() >= MARKS:
        pieces = (hi - lo) // MARKS + 1
        place = np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        mark, end, doc = np.repeat(mark, pieces), np.repeat(hi, pieces), np.repeat(doc, pieces)
        lo = np.repeat(lo, pieces) + place * MARKS
        hi = np.minimum(lo + MARKS - 1, end)
    return mark, lo, hi, doc


def spread_marks(mark: np.ndarray) -> np.ndarray:
    """Other numbers of 48 bits for the marks, one for each: marks are minima of hashes and crowd at the low end, these do not."""
    for _ in range(2):
        mark = (mark * C1) & U((1 << 48) - 1)
        mark = mark ^ (mark >> U(24))
    return mark


def suffix_hash(buf: np.ndarray, at: np.ndarray) -> np.ndarray:
    """A hash of the 50 bytes from each position on."""
    e = eights(buf)
    h = mix64(e[at])
    for k in (8, 16, 24, 32, 40, LENGTH - 8):
        h = mix64(h * C1 + e[at + k])
    return h


def run_hash(buf: np.ndarray, mark: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """A hash of all bytes of a run: its first and last suffix cover them."""
    return mix64(suffix_hash(buf, lo) * C2 + mix64(suffix_hash(buf, hi) * C3 + mark * C1 + (hi - lo).astype(np.uint64)))


def suffixes(lo: np.ndarray, hi: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(position, document) of every suffix of the runs."""
    n = hi - lo + 1
    place = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    return np.repeat(lo, n) + place, np.repeat(doc, n)


# ---- sorted arrays: exchange, membership, levels ----


def among(x: np.ndarray, ordered: np.ndarray) -> np.ndarray:
    if not len(ordered):
        return np.zeros(len(x), dtype=bool)
    return ordered[np.minimum(np.searchsorted(ordered, x), len(ordered) - 1)] == x


def packed(x: np.ndarray) -> bytes:
    """A sorted array as the byte planes of its steps."""
    return planes(np.diff(x, prepend=U(0)))


def unpacked(b: bytes) -> np.ndarray:
    return np.cumsum(unplanes(b), dtype=np.uint64)


class Family:
    """Sorted indexes (keys, batch that had the key first), each at least twice as large as the next."""

    def __init__(self):
        self.levels: list[tuple[np.ndarray, np.ndarray]] = []

    def scan(self, keys: np.ndarray, batch: int) -> np.ndarray:
        """Of each of the sorted distinct keys the batch that had it first, -1 if none has; new keys are added."""
        first = np.full(len(keys), -1, dtype=np.int64)
        for k, v in self.levels:
            at = np.minimum(np.searchsorted(k, keys), len(k) - 1)
            hit = k[at] == keys
            first[hit] = v[at[hit]]
        new = keys[first < 0]
        if len(new):
            self.levels.append((new, np.full(len(new), batch, dtype=np.int64)))
        while len(self.levels) > 1 and len(self.levels[-2][0]) < 2 * len(self.levels[-1][0]):
            (k1, v1), (k2, v2) = self.levels.pop(), self.levels.pop()
            k, v = np.concatenate([k1, k2]), np.concatenate([v1, v2])
            order = np.argsort(k, kind="stable")
            self.levels.append((k[order], v[order]))
        return first


def rows_of(schema: str, rows: list[tuple]) -> pa.Table:
    kinds = {"int": pa.int32(), "binary": pa.binary()}
    pa.default_memory_pool().release_unused()  # workers live on and would keep what the last batch needed
    fields = [f.split() for f in schema.split(", ")]
    columns = list(zip(*rows, strict=True)) if rows else [()] * len(fields)
    return pa.table({n: pa.array(c, kinds[k]) for (n, k), c in zip(fields, columns, strict=True)})


def asked(part: int, kind: int, keys: np.ndarray, bits: int, buckets: int, more: np.ndarray | None = None) -> list[tuple]:
    """Sorted keys dealt to buckets by their leading bits."""
    bucket = ((keys >> U(bits - 32)) * U(buckets) >> U(32)).astype(np.int64)
    cuts = np.searchsorted(bucket, np.arange(buckets + 1)).tolist()
    return [(i, part, kind, packed(keys[s:e]), planes(more[s:e]) if more is not None else None) for i, (s, e) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)) if e > s]


# ---- one batch ----


class Batch:
    """The texts of one part, ordered by id, in one padded buffer; NULL is empty."""

    def __init__(self, table: pa.Table, text: str, doc_id: str):
        ids = pc.fill_null(table[doc_id].cast(pa.int64()), NO_ID).to_numpy()
        self.order = np.argsort(ids, kind="stable")
        texts = pc.fill_null(table[text], "").cast(pa.large_binary()).take(pa.array(self.order)).combine_chunks()
        texts = texts.chunk(0) if isinstance(texts, pa.ChunkedArray) else texts
        offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset :][: len(texts) + 1]
        n = int(offsets[-1] - offsets[0])
        self.buf = np.zeros(n + 128, dtype=np.uint8)
        if n:
            self.buf[:n] = np.frombuffer(texts.buffers()[2], dtype=np.uint8)[offsets[0] : offsets[0] + n]
        self.ends = offsets[1:] - offsets[0]
        self.starts = offsets[:-1] - offsets[0]
        ordered = ids[self.order]
        self.rank = np.cumsum(np.concatenate(([0], ordered[1:] != ordered[:-1]))) if len(ids) else ids  # equal ids are no smaller than each other
        full = self.ends > self.starts
        self.mark, self.lo, self.hi, doc = runs(self.buf, self.starts[full], self.ends[full])
        self.mark = spread_marks(self.mark)
        self.doc = np.flatnonzero(full)[doc] if len(doc) else doc

    def only(self, keep: np.ndarray) -> None:
        self.mark, self.lo, self.hi, self.doc = self.mark[keep], self.lo[keep], self.hi[keep], self.doc[keep]

    def later(self, keys: np.ndarray, doc: np.ndarray) -> np.ndarray:
        """Where a key is also that of a document of smaller id in this batch."""
        order = np.lexsort((self.rank[doc], keys))
        k, r = keys[order], self.rank[doc][order]
        head = np.ones(len(k), dtype=bool)
        head[1:] = k[1:] != k[:-1]
        least = r[np.maximum.accumulate(np.where(head, np.arange(len(k)), 0))] if len(k) else r
        out = np.zeros(len(k), dtype=bool)
        out[order] = r > least
        return out

    def repeated(self, answer: np.ndarray) -> None:
        """Keep runs whose mark another batch has, or other documents of this one."""
        keys, count = np.unique(self.mark, return_counts=True)
        self.only(among(self.mark, answer) | among(self.mark, keys[count > 1]))


def answers(table: pa.Table, kind: int) -> np.ndarray:
    own = table.filter(pc.equal(table["kind"], kind))
    parts = [unpacked(x) for x in own["a"].to_pylist()]
    return np.sort(np.concatenate(parts)) if parts else np.zeros(0, np.uint64)


def part_of(doc_id: Column, limits: list[int]) -> Column:
    """The number of limits up to an id, by halving; NULL stands before all."""
    if not limits:
        return F.lit(0)
    sorted_limits, steps = F.lit(limits), [1 << k for k in reversed(range(len(limits).bit_length()))]
    found = F.aggregate(
        F.lit(steps), F.lit(0), lambda at, step: F.when((at + step <= len(limits)) & (F.get(sorted_limits, at + step - 1) <= doc_id), at + step).otherwise(at)
    )
    return F.when(doc_id.isNull(), 0).otherwise(found)


def remove_repeats(docs: DataFrame, as_text: bool = True, doc_id: str = "doc_id", text: str = "text", names: tuple[str, str, str] = ("n_bytes", "n_removed", "n_spans")) -> DataFrame:
    """All rows and columns, the text without bytes that a 50-byte string of an earlier document covers.

    Earlier is a smaller id; rows of one id do not count against each other, and rows without
    id come before all others. Matches are of UTF-8 bytes and judged on the input. Adds the
    bytes a text had, how many went, and in how many stretches. The text left is a string, in
    which characters that lost some of their bytes are left out; without ``as_text`` it is
    the bytes. NULL texts count as empty.
    """
    spark = docs.sparkSession
    size = text_bytes(docs, text)
    n = tasks_for(spark, size, BATCH_BYTES)
    buckets = tasks_for(spark, size, TASK_MARKS)
    ids = docs.select(F.col(doc_id).cast("long").alias("id"))
    limits = sorted(set(ids.agg(F.percentile_approx("id", [i / n for i in range(1, n)] or [0.5], 100 * n)).first()[0] or [])) if n > 1 else []
    part, given = fresh(docs, "part"), docs.columns
    batches = docs.withColumn(part, part_of(F.col(doc_id).cast("long"), limits).cast("int")).repartition(n, part)

    def along(p: int, *known: tuple[int, np.ndarray]) -> list[tuple]:
        """What a batch has been answered goes along with its next question and comes back with the answer."""
        return [(p % buckets, p, kind, packed(x), None) for kind, x in known if len(x)]

    def ask_marks(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        b = Batch(table, text, doc_id)
        return rows_of(ASK, asked(key[0].as_py(), MARK, np.unique(b.mark), 48, buckets))

    def answer_marks(table: pa.Table) -> pa.Table:
        """To each batch its marks that other batches have."""
        family, out = Family(), {}
        for p, a in sorted(zip(table["part"].to_pylist(), table["a"].to_pylist(), strict=True)):
            keys = unpacked(a)
            first = family.scan(keys, p)
            out.setdefault(p, []).append(keys[first >= 0])
            for f in np.unique(first[first >= 0]).tolist():
                out.setdefault(f, []).append(keys[first == f])
        return rows_of(ANSWER, [(p, MARK, packed(u)) for p, x in out.items() if len(u := np.unique(np.concatenate(x)))])

    def ask_runs(key: tuple[pa.Scalar, ...], table: pa.Table, answer: pa.Table) -> pa.Table:
        b, p = Batch(table, text, doc_id), key[0].as_py()
        marked = answers(answer, MARK)
        b.repeated(marked)
        h = run_hash(b.buf, b.mark, b.lo, b.hi)
        out = asked(p, RUN, np.unique(h), 64, buckets) + along(p, (MARK, marked))
        order = np.lexsort((h, b.mark))
        mark, h = b.mark[order], h[order]
        head = np.flatnonzero(np.concatenate((np.ones(min(1, len(mark)), bool), mark[1:] != mark[:-1])))
        last = np.append(head[1:], len(mark)) - 1 if len(head) else head
        # Of each mark its run, or 0 if it has several here.
        only = np.where(h[head] == h[last], h[head], U(0))
        bucket = ((mark[head] >> U(16)) * U(buckets) >> U(32)).astype(np.int64)
        cuts = np.searchsorted(bucket, np.arange(buckets + 1)).tolist()
        out += [(i, p, ALIKE, packed(mark[head][s:e]), planes(only[s:e])) for i, (s, e) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)) if e > s]
        return rows_of(ASK, out)

    def answer_runs(table: pa.Table) -> pa.Table:
        """To each batch its runs that an earlier batch has, and its marks whose runs differ."""
        family, out, alike = Family(), [], []
        for p, kind, a, b in sorted(zip(*(table[c].to_pylist() for c in ("part", "kind", "a", "b")), strict=True), key=lambda r: r[:2]):
            keys = unpacked(a)
            if kind == RUN:
                found = keys[family.scan(keys, p) >= 0]
                if len(found):
                    out.append((p, RUN, packed(found)))
            elif kind == MARK:
                out.append((p, kind, a))
            else:
                alike.append((p, keys, unplanes(b)))
        if alike:
            mark, only = np.concatenate([k for _, k, _ in alike]), np.concatenate([x for _, _, x in alike])
            order = np.argsort(mark, kind="stable")
            mark, only = mark[order], only[order]
            head = np.flatnonzero(np.concatenate(([True], mark[1:] != mark[:-1])))
            least, most = np.minimum.reduceat(only, head), np.maximum.reduceat(only, head)
            mixed = mark[head][(least != most) | (least == 0)]
            out += [(p, MIXED, packed(found)) for p, k, _ in alike if len(found := k[among(k, mixed)])]
        return rows_of(ANSWER, out)

    def open_suffixes(b: Batch, answer: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Runs that are covered as a whole are returned as (first, last); of others that may be in part: suffixes, documents."""
        b.repeated(answers(answer, MARK))
        h = run_hash(b.buf, b.mark, b.lo, b.hi)
        covered = among(h, answers(answer, RUN)) | b.later(h, b.doc)
        some = ~covered & among(b.mark, answers(answer, MIXED))
        return b.lo[covered], b.hi[covered], *suffixes(b.lo[some], b.hi[some], b.doc[some])

    def ask_suffixes(key: tuple[pa.Scalar, ...], table: pa.Table, answer: pa.Table) -> pa.Table:
        b, p = Batch(table, text, doc_id), key[0].as_py()
        _, _, at, _ = open_suffixes(b, answer)
        known = [(kind, answers(answer, kind)) for kind in (MARK, RUN, MIXED)]
        return rows_of(ASK, asked(p, SUFFIX, np.unique(suffix_hash(b.buf, at)), 64, buckets) + along(p, *known))

    def answer_suffixes(table: pa.Table) -> pa.Table:
        family, out = Family(), []
        for p, kind, a in sorted(zip(*(table[c].to_pylist() for c in ("part", "kind", "a")), strict=True), key=lambda r: r[:2]):
            if kind == SUFFIX:
                keys = unpacked(a)
                found = keys[family.scan(keys, p) >= 0]
                if len(found):
                    out.append((p, SUFFIX, packed(found)))
            else:
                out.append((p, kind, a))
        return rows_of(ANSWER, out)

    def cut(table: pa.Table, answer: pa.Table) -> pa.Table:
        b = Batch(table, text, doc_id)
        lo, hi, at, doc = open_suffixes(b, answer)
        keys = suffix_hash(b.buf, at)
        at = at[among(keys, answers(answer, SUFFIX)) | b.later(keys, doc)]
        change = np.zeros(len(b.buf) + 1, dtype=np.int32)
        np.add.at(change, np.concatenate([lo, at]), 1)
        np.add.at(change, np.concatenate([hi, at]) + LENGTH, -1)
        gone = np.cumsum(change, out=change)[:-1] > 0
        np.cumsum(gone, out=change[1:])
        change[0] = 0
        removed = (change[b.ends] - change[b.starts]).astype(np.int64)
        kept, spans = [], []
        for s, e, r in zip(b.starts.tolist(), b.ends.tolist(), removed.tolist(), strict=True):
            if not r:
                kept.append(b.buf[s:e].tobytes())
                spans.append(0)
            else:
                g = gone[s:e]
                kept.append(b.buf[s:e][~g].tobytes())
                spans.append(int(g[0]) + int((g[1:] & ~g[:-1]).sum()))
        ordered = table.take(pa.array(b.order))
        left = pa.array([k.decode("utf-8", "ignore") for k in kept], pa.string()) if as_text else pa.array(kept, pa.binary())
        columns = {c: left if c == text else ordered[c] for c in given}
        counts = (b.ends - b.starts, removed, np.array(spans, dtype=np.int64))
        pa.default_memory_pool().release_unused()
        return pa.table(columns | {c: pa.array(x.astype(np.int64)) for c, x in zip(names, counts, strict=True)})

    # One plan: the batches are one exchange, which all four passes over the texts share.
    def exchanged(questions: DataFrame, reply) -> DataFrame:
        return questions.repartition(buckets, "bucket").groupBy("bucket").applyInArrow(reply, ANSWER)

    def met(reply: DataFrame, step, schema) -> DataFrame:
        return batches.groupBy(part).cogroup(reply.groupBy("part")).applyInArrow(step, schema)

    reply = exchanged(batches.groupBy(part).applyInArrow(ask_marks, ASK), answer_marks)
    reply = exchanged(met(reply, ask_runs, ASK), answer_runs)
    reply = exchanged(met(reply, ask_suffixes, ASK), answer_suffixes)
    fields = [T.StructField(f.name, (T.StringType() if as_text else T.BinaryType()) if f.name == text else f.dataType) for f in docs.schema]
    return met(reply, cut, T.StructType(fields + [T.StructField(c, T.LongType()) for c in names]))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without repeated passages; documents of which nothing is left go. ``n_chars`` follows the text."""
    names = tuple(fresh(docs, c) for c in ("n_bytes", "n_removed", "n_spans"))
    rows = remove_repeats(docs, names=names).where(f"{names[1]} = 0 OR {names[1]} < {names[0]}")
    if "n_chars" in docs.columns:
        rows = rows.withColumn("n_chars", F.when(F.col(names[1]) > 0, F.char_length("text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType))
    return rows.select(*docs.columns)


SQL = r"""
WITH docs AS (
    SELECT row_number() OVER () AS r, doc_id, hex(encode(coalesce(text, ''))) AS h, strlen(coalesce(text, '')) AS n FROM documents
), suffixes AS (
    SELECT r, doc_id, i, substr(h, 2 * i + 1, 100) AS s FROM (SELECT *, unnest(generate_series(0, n - 50)) AS i FROM docs WHERE n >= 50)
), covered AS (
    SELECT r, i FROM (SELECT r, doc_id, i, min(doc_id) OVER (PARTITION BY s) AS first FROM suffixes) WHERE first < doc_id
), spans AS (
    SELECT r, min(i) AS s, max(i) + 50 AS e FROM (
        SELECT r, i, sum(new) OVER (PARTITION BY r ORDER BY i) AS g FROM (
            SELECT r, i, CASE WHEN i - lag(i, 1, -100) OVER (PARTITION BY r ORDER BY i) > 50 THEN 1 ELSE 0 END AS new FROM covered)) GROUP BY r, g
), pieces AS (
    SELECT r, s, e, coalesce(lag(e) OVER (PARTITION BY r ORDER BY s), 0) AS b, lead(s) OVER (PARTITION BY r ORDER BY s) IS NULL AS last FROM spans
), kept AS (
    SELECT p.r, sum(e - s) AS removed, count(*) AS spans,
           string_agg(substr(h, 2 * b + 1, 2 * (s - b)) || CASE WHEN last THEN substr(h, 2 * e + 1) ELSE '' END, '' ORDER BY s) AS k
    FROM pieces p JOIN docs USING (r) GROUP BY p.r
)
SELECT doc_id, n::BIGINT AS n_bytes, coalesce(removed, 0)::BIGINT AS n_removed, coalesce(spans, 0)::BIGINT AS n_spans, sha256(unhex(coalesce(k, h))) AS kept_sha256
FROM docs LEFT JOIN kept USING (r)
"""


@query("op8_suffix_dedup", SQL)
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), as_text=False)
    return rows.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("text", 256).alias("kept_sha256"))
