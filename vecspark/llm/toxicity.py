"""Toxicity by nearest labelled examples: exact TF-IDF cosine over block-max inverted indexes.

A text is the TF-IDF vector of the beginnings of its words. The examples of each label have an
index of their own: posting lists cut into blocks of examples that are alike, each with the
greatest weight in it. The sum of these over a text's terms bounds the cosine with any example
of a block, so blocks that cannot hold one of the nearest are never scored.

The nearest examples of either label vote with their similarity. A vote counts in full for the
part of the similarity that comes from terms tied to the label and is set against the other
side's votes for the rest. A curve fitted on the examples, each without its own vote, turns the
votes into a probability; the nearest examples are returned as evidence.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from vecspark.llm.common import fresh, row_batches, written
from vecspark.llm.register import query

PER_CLASS = 4000  # labelled examples of each class that are fitted, at most
TERMS_PER_CLASS = 8_000_000  # and at most so many terms of all of them together: bounds the model when examples are very long
LETTERS = 4  # of a word's beginning
NEIGHBOURS = 15
EVIDENCE = 5
TIE = 5.0  # standard deviations by which a term must be more frequent with a label
BLOCK, GROUPS = 32, 16  # examples of a block, groups of like examples that blocks are cut from
DENSE = 1000  # the terms of most examples, so many, are kept as small dense matrices; results do not depend on it
TOGETHER = 32  # texts searched at once
KEPT_ANSWERS = 50_000  # what a worker remembers; results do not depend on it
START = re.compile(rf"([^\W\d_]{{1,{LETTERS}}})[^\W\d_]*")  # of each word


def counts(text: str) -> Counter:
    """How often the text has each term."""
    return Counter(START.findall(text.lower()))


def unit(counted: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """TF-IDF weights of length 1; a term counts less the more often it is repeated."""
    w = (1 + np.log(counted.astype(np.float64))) * idf
    return w / max(math.sqrt(float(w @ w)), 1e-300)


def spans(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """All places of the spans, one span after the other."""
    return np.arange(sizes.sum()) + np.repeat(starts - (np.cumsum(sizes) - sizes), sizes)


class BlockMaxIndex:
    """Unit vectors of examples. ``vectors``: (terms in order, weights above 0) of each."""

    def __init__(self, vectors: list[tuple[np.ndarray, np.ndarray]], n_terms: int):
        self.n, self.n_terms = len(vectors), n_terms
        self.order = self.alike(vectors)  # the example at each place
        self.place = np.argsort(self.order)
        self.blocks = -(-self.n // BLOCK)
        sizes = np.array([len(t) for t, _ in vectors], dtype=np.int64)
        self.ends = np.concatenate([[0], np.cumsum(sizes)])
        self.terms = np.concatenate([t for t, _ in vectors] or [np.zeros(0)]).astype(np.int64)
        self.weights = np.concatenate([w for _, w in vectors] or [np.zeros(0)])
        place, by = np.repeat(self.place, sizes), self.weights.astype(np.float32)
        held = np.bincount(self.terms, minlength=n_terms)
        dense = np.argsort(-held, kind="stable")[:DENSE]
        self.column = np.full(n_terms, -1, dtype=np.int64)
        self.column[dense] = np.arange(len(dense))
        col = self.column[self.terms]
        self.matrix = np.zeros((self.blocks, len(dense), BLOCK), dtype=np.float32)
        own = col >= 0
        self.matrix[place[own] // BLOCK, col[own], place[own] % BLOCK] = by[own]
        self.most = self.matrix.max(axis=2, initial=0).T.copy()  # (dense term, block)
        # All other terms: postings by term and block, and for each such pair its greatest weight.
        t, place, by = self.terms[~own], place[~own], by[~own]
        at = np.lexsort((place, t))
        t, self.who, self.by = t[at], place[at], by[at]
        new = np.ones(len(t), dtype=bool)
        new[1:] = (np.diff(t) != 0) | (np.diff(self.who // BLOCK) != 0)
        self.pair_start = np.flatnonzero(new)
        self.pair_size = np.diff(np.append(self.pair_start, len(t)))
        self.pair_block = self.who[self.pair_start] // BLOCK
        self.pair_most = np.maximum.reduceat(self.by, self.pair_start) if len(t) else np.zeros(0, dtype=np.float32)
        self.lists = np.searchsorted(t[self.pair_start], np.arange(n_terms + 1))
        # Of sums of non-negative numbers in single precision: each summand is rounded, and so is each sum.
        self.slack = 2.5 * (len(dense) + int(sizes.max(initial=0)) + 8) * 2.0**-24

    @staticmethod
    def alike(vectors: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        """An order in which examples with the same terms are near each other.

        On random projections: first some groups around centres far from each other, then each
        parted again and again at the middle of its widest direction.
        """
        rng = np.random.default_rng(7)
        table = rng.normal(size=(4096, 32)).astype(np.float32)
        x = np.array([w @ table[t % 4096] for t, w in vectors]).reshape(len(vectors), 32)
        centres = x[:1]
        while len(centres) < min(GROUPS, len(x) // BLOCK):
            away = ((x[:, None, :] - centres[None, :, :]) ** 2).sum(axis=2).min(axis=1)
            centres = np.concatenate([centres, x[[int(away.argmax())]]])
        of = np.zeros(len(x), dtype=np.int64)
        for _ in range(10 if len(centres) > 1 else 0):
            of = ((x[:, None, :] - centres[None, :, :]) ** 2).sum(axis=2).argmin(axis=1)
            centres = np.array([x[of == c].mean(axis=0) if (of == c).any() else centres[c] for c in range(len(centres))])
        out, todo = [], [own for c in reversed(range(max(1, len(centres)))) if len(own := np.flatnonzero(of == c))]
        while todo:
            own = todo.pop()
            if len(own) <= BLOCK:
                out.append(own)
                continue
            y = x[own] - x[own].mean(axis=0)
            along = np.linalg.eigh(y.T @ y)[1][:, -1]
            ranked, half = np.argsort(y @ along, kind="stable"), int((y @ along <= 0).sum())
            half = half if BLOCK // 4 <= half <= len(own) - BLOCK // 4 else len(own) // 2
            todo += [own[ranked[half:]], own[ranked[:half]]]
        return np.concatenate(out) if out else np.zeros(0, dtype=np.int64)

    def split(self, part: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, tuple]:
        """The dense part of the texts, and (text, term, weight) of the rest."""
        row = np.repeat(np.arange(len(part)), [len(t) for t, _ in part])
        t, w = np.concatenate([t for t, _ in part]).astype(np.int64), np.concatenate([w for _, w in part]).astype(np.float32)
        col = self.column[t]
        q = np.zeros((len(part), len(self.most)), dtype=np.float32)
        q[row[col >= 0], col[col >= 0]] = w[col >= 0]
        return q, (row[col < 0], t[col < 0], w[col < 0])

    def bounds(self, part: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, tuple]:
        """(text, block) bounds of cosines, and the split of the texts."""
        q, (row, t, w) = self.split(part)
        n = self.lists[t + 1] - self.lists[t]
        pair = spans(self.lists[t], n)
        upper = np.bincount(np.repeat(row, n) * self.blocks + self.pair_block[pair], np.repeat(w, n) * self.pair_most[pair], len(part) * self.blocks)
        return (q @ self.most + upper.reshape(len(part), self.blocks)) * (1 + self.slack), q, (row, t, w)

    def score(self, near: np.ndarray, q: np.ndarray, rest: tuple, chosen: np.ndarray) -> None:
        """Fill in the cosines with all examples of the chosen blocks."""
        for b in np.flatnonzero(chosen).tolist():
            near[:, b * BLOCK : (b + 1) * BLOCK] = q @ self.matrix[b]
        row, t, w = rest
        n = self.lists[t + 1] - self.lists[t]
        pair = spans(self.lists[t], n)
        row, w = np.repeat(row, n), np.repeat(w, n)
        own = chosen[self.pair_block[pair]]
        row, w, pair = row[own], w[own], pair[own]
        size = self.pair_size[pair]
        at = spans(self.pair_start[pair], size)
        near += np.bincount(np.repeat(row, size) * near.shape[1] + self.who[at], np.repeat(w, size) * self.by[at], near.size).reshape(near.shape).astype(np.float32)

    def search_all(self, queries: list[tuple[np.ndarray, np.ndarray]], k: int, without: list[int] | None = None, marked: np.ndarray | None = None) -> list[list[tuple[float, int, float]]]:
        """For each, the k examples of highest cosine above 0, as (cosine, example, part); of equal ones those that stand first.

        ``part`` is what the terms with a weight in ``marked`` have of the cosine.
        """
        out: list[list[tuple[float, int, float]]] = [[] for _ in queries]
        if not self.n:
            return out
        exact, marked = np.zeros(self.n_terms), np.zeros(self.n_terms) if marked is None else marked
        few = min(-(-k // BLOCK) + 2, self.blocks)
        upper = np.concatenate([self.bounds(queries[s : s + TOGETHER])[0] for s in range(0, len(queries), TOGETHER)]) if queries else np.zeros((0, 1))
        ranked = np.argsort(upper.argmax(axis=1), kind="stable")  # texts that go to the same blocks are searched together
        self.scored = self.all_blocks = 0
        for first in range(0, len(ranked), TOGETHER):
            own = ranked[first : first + TOGETHER].tolist()
            part = [queries[i] for i in own]
            most, q, rest = upper[own], *self.split(part)
            near = np.zeros((len(part), self.blocks, BLOCK), dtype=np.float32)
            skip = np.array([-1 if without is None else without[i] for i in own])
            has = np.flatnonzero(skip >= 0)
            chosen, least = np.zeros(self.blocks, dtype=bool), np.zeros(len(part))
            more = chosen.copy()
            more[np.argpartition(-most, few - 1, axis=1)[:, :few].ravel()] = True
            while more.any():
                self.score(near.reshape(len(part), -1), q, rest, more)
                near[has, self.place[skip[has]] // BLOCK, self.place[skip[has]] % BLOCK] = 0
                chosen |= more
                seen = near[:, chosen].reshape(len(part), -1)
                if seen.shape[1] > k:
                    least = np.partition(seen, seen.shape[1] - k, axis=1)[:, seen.shape[1] - k] * (1 - 2 * self.slack)
                more = ((most > 0) & (most >= least[:, None])).any(axis=0) & ~chosen
            self.scored += int(chosen.sum()) * len(part)
            self.all_blocks += self.blocks * len(part)
            for i, (t, w), row, low in zip(own, part, near.reshape(len(part), -1), least.tolist(), strict=True):
                found = np.sort(self.order[np.flatnonzero((row[: self.n] > 0) & (row[: self.n] >= low))])
                if not len(found):
                    continue
                exact[t] = w
                sizes = self.ends[found + 1] - self.ends[found]
                at, cuts = spans(self.ends[found], sizes), np.cumsum(sizes) - sizes
                each = exact[self.terms[at]] * self.weights[at]
                scores, tied = np.add.reduceat(each, cuts), np.add.reduceat(each * marked[self.terms[at]], cuts)
                exact[t] = 0
                top = np.lexsort((found, -scores))[:k]
                out[i] = list(zip(np.minimum(1.0, scores[top]).tolist(), found[top].tolist(), tied[top].tolist(), strict=True))
        return out


class Model:
    """What a worker needs, made from plain data: bounded by the examples."""

    def __init__(self, state: dict):
        self.names, self.idf, self.curve = {t: i for i, t in enumerate(state["names"])}, state["idf"], state["curve"]
        self.ids, self.own = state["ids"], state["digests"]
        self.vectors = [[(t, unit(c, self.idf[t])) for t, c in side] for side in state["examples"]]
        self.indexes = [BlockMaxIndex(side, len(self.names)) for side in self.vectors]
        self.tied = self.ties()

    def ties(self) -> np.ndarray:
        """1 for terms that go with toxic examples by more than ``TIE`` standard deviations, else 0."""
        n = [max(1, len(side)) for side in self.vectors]
        held = [np.bincount(np.concatenate([t for t, _ in side] or [np.zeros(0, dtype=np.int64)]), minlength=len(self.names)) for side in self.vectors]
        share = (held[0] + held[1] + 1) / (n[0] + n[1] + 2)
        apart = (held[1] + 0.5) / (n[1] + 1) - (held[0] + 0.5) / (n[0] + 1)
        return (apart > TIE * np.sqrt(share * (1 - share) * (1 / n[0] + 1 / n[1]))).astype(np.float64)

    def vector(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        known = {self.names[t]: n for t, n in counts(text).items() if t in self.names}
        t = np.array(sorted(known), dtype=np.int64)
        return t, unit(np.array([known[i] for i in t.tolist()], dtype=np.int64), self.idf[t])

    def votes(self, queries: list[tuple[np.ndarray, np.ndarray]], without: list[tuple[int, int]]) -> tuple[np.ndarray, list]:
        """Of each text what its neighbours say, as (1, toxic against clean, part that is tied to toxic), and the neighbours."""
        near = [index.search_all(queries, NEIGHBOURS, [w[y] for w in without], self.tied) for y, index in enumerate(self.indexes)]
        out = np.zeros((len(queries), 3))
        for i in range(len(queries)):
            no, yes = (sum(s * s for s, _, _ in near[y][i]) / NEIGHBOURS for y in (0, 1))
            share = sum(s * x for s, _, x in near[1][i]) / (NEIGHBOURS * yes) if yes else 0.0
            out[i] = 1.0, math.log((yes + 1e-3) / (no + 1e-3)), math.sqrt(max(0.0, share))
        return out, near

    def scores(self, texts: list[str]) -> list[tuple[float, list[tuple]]]:
        without = [self.own.get(digest_of(t), (-1, -1)) for t in texts]
        x, near = self.votes([self.vector(t) for t in texts], without)
        z = np.clip(x @ self.curve, -30, 30)
        found = [sorted([(-s, y, j) for y in (0, 1) for s, j, _ in near[y][i]])[:EVIDENCE] for i in range(len(texts))]
        return [(p, [(self.ids[y][j], y, -s) for s, y, j in e]) for p, e in zip((1 / (1 + np.exp(-z))).tolist(), found, strict=True)]


def digest_of(text: str) -> bytes:
    return hashlib.blake2b(text.encode(), digest_size=16).digest()


def model_of(state: dict) -> Model:
    """The model of this worker, built once and kept beside the broadcast data."""
    if "model" not in state:
        state["model"] = Model(state)
    return state["model"]


def training_labels(labels: DataFrame, doc_id: str = "doc_id", label: str = "toxic") -> DataFrame:
    """(doc_id, toxic) of the rows to learn from: crc32 of the id as text, mod 5, is not 0; ids that labels disagree on are left out."""
    rows = labels.where(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 != 0).where(F.col(label).isin(0, 1))
    rows = rows.groupBy(F.col(doc_id).alias("doc_id")).agg(F.min(label).alias("toxic"), F.max(label).alias("other"))
    return rows.where("toxic = other").select("doc_id", F.col("toxic").cast("int"))


def fit(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS, doc_id: str = "doc_id", text: str = "text") -> dict | float:
    """Fit on at most ``per_class`` labelled documents of each class, the first by a hash of their ids.

    Equal texts of one label are one example. How many documents have a term is counted over
    all documents. The driver holds the examples' vectors, at most ``TERMS_PER_CLASS`` terms of
    each class; what would go beyond is left out from the end. If one of the classes or all
    terms are missing, the model is one number: the share of toxic labels.
    """
    spark = docs.sparkSession
    known = training_labels(labels)
    rates = {r["toxic"]: r["count"] for r in known.groupBy("toxic").count().collect()}
    prior = rates.get(1, 0) / max(1, sum(rates.values()))
    if len(rates) < 2:
        return prior
    chosen = [known.where(F.col("toxic") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class) for y in (0, 1)]
    picked = written(chosen[0].unionAll(chosen[1]), "toxic-chosen")  # at most twice per_class rows
    texts = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text")).join(F.broadcast(picked), "doc_id")

    def vectors_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in row_batches(batches, 1, 1 << 20):
            held = [sorted(counts(t).items()) for t in b.column("text").to_pylist()]
            made = [pa.array([digest_of(t) for t in b.column("text").to_pylist()], pa.binary()), pa.array([len(h) for h in held], pa.int64())]
            made += [pa.array([[t for t, _ in h] for h in held], pa.list_(pa.string())), pa.array([[n for _, n in h] for h in held], pa.list_(pa.int32()))]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("toxic"), *made], ["doc_id", "toxic", "digest", "n", "terms", "counts"])

    kind = docs.schema[doc_id].dataType.simpleString()
    schema = f"doc_id {kind}, toxic int, digest binary, n long, terms array<string>, counts array<int>"
    rows = written(texts.select("doc_id", "text", "toxic").mapInArrow(vectors_of, schema), "toxic-vectors")
    first = rows.groupBy("toxic", "digest").agg(F.min("doc_id").alias("doc_id"), F.first("n").alias("n"))
    order = Window.partitionBy("toxic").orderBy(F.xxhash64("doc_id"), "doc_id", "digest")
    first = first.withColumn("place", F.row_number().over(order)).where(F.col("place") <= per_class)
    first = first.withColumn("upto", F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))).where((F.col("upto") <= TERMS_PER_CLASS) & (F.col("n") > 0))
    kept = rows.join(F.broadcast(first.select("toxic", "digest", "doc_id")), ["toxic", "digest", "doc_id"]).dropDuplicates(["toxic", "digest"])
    table = kept.orderBy("doc_id", "toxic").select("doc_id", "toxic", "digest", "terms", "counts").toArrow()
    y = table.column("toxic").to_numpy()
    sizes = {c: int((y == c).sum()) for c in (0, 1)}
    if not all(sizes.values()):
        return prior
    terms = table.column("terms").combine_chunks()
    coded = terms.flatten().dictionary_encode()
    names = coded.dictionary.to_pylist()
    counted, ends = table.column("counts").combine_chunks().flatten().to_numpy(), terms.offsets.to_numpy()
    coded = coded.indices.to_numpy()
    examples: list[list] = [[], []]
    ids: list[list] = [[], []]
    digests: dict[bytes, list[int]] = {}
    for i, (doc, label, d) in enumerate(zip(table.column("doc_id").to_pylist(), y.tolist(), table.column("digest").to_pylist(), strict=True)):
        own = slice(ends[i] - ends[0], ends[i + 1] - ends[0])
        at = np.argsort(coded[own])
        digests.setdefault(d, [-1, -1])[label] = len(examples[label])
        examples[label].append((coded[own][at].astype(np.int32), counted[own][at]))
        ids[label].append(doc)
    del table, terms, coded, counted
    shared = spark.sparkContext.broadcast(names)

    def documents_with(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = {t: i for i, t in enumerate(shared.value)}
        n = np.zeros(len(known) + 1, dtype=np.int64)  # the last counts documents
        for b in row_batches(batches, 0):
            for t in b.column(0).to_pylist():
                n[[known[w] for w in set(START.findall((t or "").lower())) if w in known]] += 1
            n[-1] += b.num_rows
        some = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(n[some])], ["term", "n"])

    df = np.zeros(len(names) + 1)
    sums = docs.select(F.col(text)).mapInArrow(documents_with, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).toArrow()
    df[sums.column(0).to_numpy()] = sums.column(1).to_numpy()
    shared.destroy()  # workers live on and would keep it
    state = {"names": names, "idf": np.log((1 + df[-1]) / (1 + df[:-1])) + 1, "examples": examples, "ids": ids, "digests": digests, "id_type": kind, "curve": np.zeros(3)}
    state["curve"] = fit_curve(spark, state, (rates[0] / sizes[0], rates[1] / sizes[1]))
    return state


def fit_curve(spark: SparkSession, state: dict, rates: tuple[float, float]) -> np.ndarray:
    """Logistic curve over the votes, each class weighed as it is among all labelled rows; no example, and no copy of it, votes for itself."""
    shared = spark.sparkContext.broadcast(state)
    twins = {(y, i): tuple(own) for own in state["digests"].values() for y, i in enumerate(own) if i >= 0}
    places = [(y, i, *twins[y, i]) for y in (0, 1) for i in range(len(state["examples"][y]))]

    def voted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model_of(shared.value)
        for b in batches:
            for s in range(0, b.num_rows, 8 * TOGETHER):
                own = b.slice(s, 8 * TOGETHER).to_pylist()
                x, _ = m.votes([m.vectors[r["y"]][r["i"]] for r in own], [(r["a"], r["b"]) for r in own])
                yield pa.RecordBatch.from_arrays([pa.array([r["y"] for r in own], pa.int32()), pa.array([r["i"] for r in own], pa.int32()), pa.array(x[:, 1]), pa.array(x[:, 2])], ["y", "i", "against", "tied"])

    rows = spark.createDataFrame(pa.table({c: pa.array([p[k] for p in places], pa.int32()) for k, c in enumerate("yiab")})).repartition(spark.sparkContext.defaultParallelism, "i")
    found = rows.mapInArrow(voted, "y int, i int, against double, tied double").orderBy("y", "i").toArrow()  # a row per example
    shared.destroy()  # and the model made from it
    y = found.column("y").to_numpy().astype(np.float64)
    x = np.column_stack([np.ones(len(y)), found.column("against").to_numpy(), found.column("tied").to_numpy()])
    each, c = np.where(y > 0, rates[1], rates[0]), np.zeros(3)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ c, -30, 30)))
        pull = np.array([1e-3, 1e-2, 1e-2])  # keeps the curve finite where classes part cleanly
        step = np.linalg.solve((x * (each * p * (1 - p))[:, None]).T @ x + np.diag(pull), x.T @ (each * (y - p)) - pull * c)
        c = c + step / max(1.0, float(np.abs(step).max()) / 5)
    return c


def score_documents(docs: DataFrame, model: dict | float, score: str = "score", evidence: str = "evidence", text: str = "text") -> DataFrame:
    """All rows and columns, with a score from 0 to 1 and the nearest examples as evidence.

    A text without known terms, such as an empty or NULL one, has no neighbours and gets the
    score of that. An example with the very same text is no neighbour, as when the curve was
    fitted. Nothing but the text is an input of the score. No shuffle.
    """
    at = docs.columns.index(text)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, seen = shared.value, {}
        m = m if isinstance(m, float) else model_of(m)
        ids = pa.string() if isinstance(m, float) else pa.array([i for side in m.ids for i in side]).type
        pairs = pa.list_(pa.struct([("doc_id", ids), ("toxic", pa.int32()), ("similarity", pa.float64())]))
        for b in row_batches(batches, at, 1 << 20):
            texts = [t or "" for t in b.column(at).to_pylist()]
            if isinstance(m, float):
                out = [(m, [])] * len(texts)
            else:
                keys = [digest_of(t) for t in texts]
                if len(seen) >= KEPT_ANSWERS:
                    seen.clear()
                new = {k: t for k, t in zip(keys, texts, strict=True) if k not in seen}
                if new:
                    seen |= zip(new, m.scores(list(new.values())), strict=True)
                out = [seen[k] for k in keys]
            near = [[{"doc_id": i, "toxic": y, "similarity": s} for i, y, s in e] for _, e in out]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([s for s, _ in out], pa.float64()), pa.array(near, pairs)], [*b.schema.names, score, evidence])

    columns = ", ".join(f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in docs.schema)
    kind = "string" if isinstance(model, float) else model["id_type"]
    return docs.mapInArrow(scored, f"{columns}, `{score}` double, `{evidence}` array<struct<doc_id: {kind}, toxic: int, similarity: double>>")


def held_out(doc_id: str = "doc_id"):
    """Whether labels of this id are not learnt from; false for a NULL id."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted, evidence) of every row; predicted is 1 from a score of 0.5."""
    rows = score_documents(docs.select("doc_id", "text"), fit(docs, labels))
    return rows.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "evidence")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that are not predicted toxic, with their columns."""
    score, evidence = fresh(docs, "score"), fresh(docs, "evidence")
    model = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return score_documents(docs, model, score, evidence).where(F.col(score) < 0.5).select(*docs.columns)


@query("op1_toxicity")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
