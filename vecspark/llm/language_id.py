"""Language by a bidirectional gated recurrent network over bytes, trained with numpy.

The network reads windows of bytes forwards and backwards at once and gives every byte a
probability of each language; a document's probabilities are the mean over all its bytes. It is
trained by backpropagation through time on windows of a bounded sample of labelled documents.
Gates are cut lines instead of sigmoids, which costs a third of the time and nothing else here.

Texts stay where they are: no shuffle but that of the sample, and tasks hold windows of about a
megabyte of text at a time.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from vecspark.llm.common import row_batches
from vecspark.llm.register import query

HIDDEN = 16  # numbers of each direction
SPAN = 64  # bytes of a window
DOCS = 200  # documents of each language that are learnt from, at most
PIECES = 16  # windows taken from each, spread over its whole text
STEPS, BATCH, RATE, SEED = 300, 128, 0.01, 11
TOGETHER = 2048  # windows read at once by a task
KEPT_ANSWERS = 50_000  # what a worker remembers; results do not depend on it
UNKNOWN = "und"


def new_network(languages: int, rng: np.random.Generator) -> dict[str, np.ndarray]:
    """``table``: what a byte adds to the two gates and the candidate, by direction; ``turn``: what the state adds."""
    network = {
        "table": rng.normal(0, 0.1, (3, 512, HIDDEN)), "turn": rng.normal(0, HIDDEN**-0.5, (3, 2, HIDDEN, HIDDEN)),
        "out": rng.normal(0, 0.1, (2, HIDDEN, languages)), "bias": np.zeros(languages),
    }
    network["turn"][:2] *= 0.25
    network["table"][:2] += 0.5  # gates half open
    return {k: v.astype(np.float32) for k, v in network.items()}


def both_ways(x: np.ndarray) -> np.ndarray:
    """(step, direction, window) rows of ``table``, from bytes (window, place)."""
    x = x.T.astype(np.int64)
    return np.stack([x, x[::-1] + 256], axis=1)


def run(network: dict, ways: np.ndarray, keep: bool = False) -> tuple[np.ndarray, list]:
    """States (step, direction, window, number) after each step; with ``keep`` also what the way back needs."""
    steps, _, n = ways.shape
    table, turn = network["table"], network["turn"]
    states, kept = np.empty((steps, 2, n, HIDDEN), dtype=np.float32), []
    h = np.zeros((2, n, HIDDEN), dtype=np.float32)
    x, g = np.empty((3, 2, n, HIDDEN), dtype=np.float32), np.empty((3, 2, n, HIDDEN), dtype=np.float32)
    for t in range(steps):
        np.take(table, ways[t], axis=1, out=x)
        np.matmul(h, turn, out=g)
        gates = x[:2]
        gates += g[:2]
        np.clip(gates, 0, 1, out=gates)
        new = gates[1] * g[2]
        new += x[2]
        np.tanh(new, out=new)
        if keep:
            kept.append((h, gates.copy(), new, g[2].copy()))
        h = np.subtract(h, new, out=states[t])
        h *= gates[0]
        h += new
    return states, kept


def chances(network: dict, states: np.ndarray) -> np.ndarray:
    """(place, window, language): the probabilities at every place, from the states of both directions."""
    z = states[:, 0] @ network["out"][0] + states[::-1, 1] @ network["out"][1] + network["bias"]
    z -= z.max(axis=-1, keepdims=True)
    np.exp(z, out=z)
    z /= z.sum(axis=-1, keepdims=True)
    return z


def slopes(network: dict, x: np.ndarray, labels: np.ndarray, counts: np.ndarray) -> tuple[dict, float]:
    """Gradients of the mean cross-entropy over all places that count, and that mean. x, counts: (window, place)."""
    ways = both_ways(x)
    states, kept = run(network, ways, keep=True)
    p, w = chances(network, states), (counts.T / counts.sum()).astype(np.float32)
    own = p[:, np.arange(len(labels)), labels]
    loss = float(-(np.log(np.maximum(own, 1e-9)) * w).sum())
    p[:, np.arange(len(labels)), labels] -= 1
    p *= w[:, :, None]
    flat = p.reshape(-1, p.shape[-1])
    out = {"bias": flat.sum(axis=0), "out": np.stack([states[:, 0].reshape(-1, HIDDEN).T @ flat, states[::-1, 1].reshape(-1, HIDDEN).T @ flat])}
    back = np.stack([p @ network["out"][0].T, (p @ network["out"][1].T)[::-1]], axis=1)
    turn, d_turn = network["turn"].transpose(0, 1, 3, 2), np.zeros_like(network["turn"])
    d_table, d = np.zeros_like(network["table"]), np.zeros_like(kept[0][0])
    adds = np.empty((len(kept), 3, *d.shape), dtype=np.float32)
    for t in reversed(range(len(kept))):
        h, gates, new, g = kept[t]
        d = d + back[t]
        open_ = (gates > 0) & (gates < 1)
        d_new = d * (1 - gates[0]) * (1 - new * new)
        adds[t, 0] = d * (h - new) * open_[0]
        adds[t, 1] = d_new * g * open_[1]
        adds[t, 2] = d_new
        d_g = np.stack([adds[t, 0], adds[t, 1], d_new * gates[1]])
        d_turn += h.transpose(0, 2, 1) @ d_g
        d = d * gates[0] + (d_g @ turn).sum(axis=0)
    for k in range(3):
        np.add.at(d_table[k], ways.reshape(-1), adds[:, k].reshape(-1, HIDDEN))
    return out | {"turn": d_turn, "table": d_table}, loss


def train(x: np.ndarray, sizes: np.ndarray, labels: np.ndarray, languages: int, steps: int = STEPS) -> dict[str, np.ndarray]:
    """Fit on windows (bytes, how many of them are text, the language's number), as many of each language in a batch on average."""
    rng = np.random.default_rng(SEED)
    network = new_network(languages, rng)
    mean, square = ({k: np.zeros_like(v) for k, v in network.items()} for _ in range(2))
    share = 1 / np.bincount(labels, minlength=languages)[labels]
    share /= share.sum()
    for step in range(1, steps + 1):
        own = rng.choice(len(x), BATCH, p=share)
        part, n = x[own].copy(), sizes[own].copy()
        cut = rng.random(BATCH) < 0.25  # some are shorter, as the windows of short texts
        n[cut] = np.minimum(n[cut], rng.integers(4, SPAN, int(cut.sum())))
        counts = np.arange(SPAN)[None, :] < n[:, None]
        part[~counts] = 32
        d, _ = slopes(network, part, labels[own], counts)
        norm = np.sqrt(sum(float((v * v).sum()) for v in d.values()))
        rate = RATE * min(1.0, 2 * (1 - (step - 1) / steps))
        for k, v in d.items():
            v = v * min(1.0, 1.0 / max(norm, 1e-9))
            mean[k] = 0.9 * mean[k] + 0.1 * v
            square[k] = 0.99 * square[k] + 0.01 * v * v
            network[k] -= (rate * (mean[k] / (1 - 0.9**step)) / (np.sqrt(square[k] / (1 - 0.99**step)) + 1e-6)).astype(np.float32)
    return network


def has_letter(text: str | None) -> bool:
    return text is not None and any(map(str.isalpha, text))


def windows(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of all windows of the texts: all bytes, where each starts, which of its places are its own (from, to), and how many each text has.

    The last window of a text ends with it and overlaps the one before, whose places are not
    counted again. A text below one window goes on with blanks, which are not counted.
    """
    sizes = np.array([len(t) for t in texts], dtype=np.int64)
    room = np.maximum(sizes, SPAN)
    whole = np.frombuffer(b"".join(t if len(t) >= SPAN else t.ljust(SPAN) for t in texts), dtype=np.uint8)
    n = -(-room // SPAN)
    first = np.repeat(np.cumsum(n) - n, n)
    k = np.arange(n.sum()) - first
    room_of, size_of = np.repeat(room, n), np.repeat(sizes, n)
    at = np.minimum(k * SPAN, room_of - SPAN)
    low = k * SPAN - at
    high = np.minimum(SPAN, size_of - at)
    return whole, at + np.repeat(np.cumsum(room) - room, n), np.stack([low, high]), n


def read(network: dict, texts: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For parts of all windows: (place, window, language) probabilities, which places count, and the text each window is of."""
    whole, start, own, n = windows(texts)
    of = np.repeat(np.arange(len(texts)), n)
    places = np.arange(SPAN)
    for a in range(0, len(start), TOGETHER):
        part = slice(a, a + TOGETHER)
        p = chances(network, run(network, both_ways(whole[start[part, None] + places]))[0])
        low, high = own[0, part], own[1, part]
        yield p, (places[:, None] >= low) & (places[:, None] < high), of[part]


def pooled(network: dict, texts: list[bytes]) -> np.ndarray:
    """(text, language): the mean of the probabilities at all bytes of each text; texts are not empty."""
    out = np.zeros((len(texts), len(network["bias"])))
    for p, counts, of in read(network, texts):
        np.add.at(out, of, np.einsum("twl,tw->wl", p, counts.astype(np.float32)).astype(np.float64))
    return out / np.array([len(t) for t in texts])[:, None]


def held_out(doc_id: Column) -> Column:
    """Whether the id's row is kept out of learning; false for a NULL id, which is not learnt from either."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def fit(docs: DataFrame, per_language: int = DOCS, steps: int = STEPS, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> dict:
    """Learn from at most ``per_language`` documents of each language, the first by a hash of id and text.

    Only rows with a language, an id that is not held out and a text with a letter are learnt
    from. Windows are cut where the texts are; the driver gets those and nothing else, at most
    ``PIECES`` of ``SPAN`` bytes for each document. Without such rows nothing is known.
    """
    rows = docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text"), F.col(lang).alias("lang"))
    rows = rows.where(F.col("lang").isNotNull() & F.col("id").isNotNull() & ~held_out(F.col("id")) & F.col("text").rlike(r"\p{L}"))
    rows = rows.withColumn("h", F.xxhash64("id", "text"))
    first = rows.groupBy("lang", "h").agg(F.lit(1)).select("lang", "h")
    first = first.withColumn("n", F.row_number().over(Window.partitionBy("lang").orderBy("h"))).where(F.col("n") <= per_language)
    bounds = first.groupBy("lang").agg(F.max("h").alias("most"))  # a row per language
    body = F.encode("text", "UTF-8")
    last = F.greatest(F.octet_length(body) - SPAN, F.lit(0))
    pieces = F.transform(F.sequence(F.lit(0), F.lit(PIECES - 1)), lambda i: F.substring(body, (last * i / (PIECES - 1)).cast("int") + 1, F.lit(SPAN)))
    chosen = rows.join(F.broadcast(bounds), "lang").where("h <= most").select("lang", "h", F.array_distinct(pieces).alias("pieces"))
    chosen = chosen.groupBy("lang", "h").agg(F.first("pieces").alias("pieces")).orderBy("lang", "h").toArrow().combine_chunks()
    langs = sorted(set(chosen.column("lang").to_pylist()))
    if not langs:
        return {"langs": [], "network": None}
    number = {v: i for i, v in enumerate(langs)}
    cut = [(p, number[r["lang"]]) for r in chosen.to_pylist() for p in r["pieces"]]
    x = np.frombuffer(b"".join(p.ljust(SPAN) for p, _ in cut), dtype=np.uint8).reshape(-1, SPAN)
    return {"langs": langs, "network": train(x, np.array([len(p) for p, _ in cut]), np.array([y for _, y in cut]), len(langs), steps)}


def predict(docs: DataFrame, model: dict, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, lang_pred, score) of every row: the language of the highest mean probability, and that.

    A NULL text, one without a letter and every text under a model without languages is ``und``
    with a score of 0. Of equal probabilities the first language by code point is taken. NULL
    and repeated ids are kept as they are, equal texts get equal answers. Whole texts are read,
    other columns are not. No shuffle.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def answered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        langs, network, seen = shared.value["langs"], shared.value["network"], {}
        for b in row_batches(batches, 1, 1 << 20):
            texts = b.column(1).to_pylist()
            known = [bool(langs) and has_letter(t) for t in texts]
            bodies = [t.encode() if k else b"" for t, k in zip(texts, known, strict=True)]
            keys = [hashlib.blake2b(t, digest_size=16).digest() for t in bodies]
            if len(seen) >= KEPT_ANSWERS:
                seen.clear()
            new = {k: t for k, t in zip(keys, bodies, strict=True) if t and k not in seen}
            if new:
                p = pooled(network, list(new.values()))
                best = p.argmax(axis=1)
                seen |= zip(new, zip(best.tolist(), np.clip(p.max(axis=1), 0, 1).tolist(), strict=True), strict=True)
            out = [seen[k] if t else None for k, t in zip(keys, bodies, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([langs[o[0]] if o else UNKNOWN for o in out], pa.string()), pa.array([o[1] if o else 0.0 for o in out], pa.float64())], ["doc_id", "lang_pred", "score"]
            )

    kind = docs.schema[doc_id].dataType.simpleString()
    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).mapInArrow(answered, f"doc_id {kind}, lang_pred string, score double")


def label_positions(docs: DataFrame, model: dict, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, labels) of every row: one byte for each byte of the text, the number of its likeliest language.

    NULL texts, and all under a model without languages, have no labels (empty).
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def labelled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        langs, network = shared.value["langs"], shared.value["network"]
        for b in row_batches(batches, 1, 1 << 20):
            bodies = [(t or "").encode() for t in b.column(1).to_pylist()]
            parts: list[list[bytes]] = [[] for _ in bodies]
            some = [i for i, t in enumerate(bodies) if t and langs]
            if some:
                for p, counts, of in read(network, [bodies[i] for i in some]):
                    best = p.argmax(axis=2).astype(np.uint8)
                    for w, i in enumerate(of.tolist()):
                        parts[some[i]].append(best[counts[:, w], w].tobytes())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([b"".join(x) for x in parts], pa.binary())], ["doc_id", "labels"])

    kind = docs.schema[doc_id].dataType.simpleString()
    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).mapInArrow(labelled, f"doc_id {kind}, labels binary")


def identify(docs: DataFrame, per_language: int = DOCS) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) of every row; learnt from the rows that are not held out."""
    out = predict(docs, fit(docs, per_language))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


@query("op11_language_id")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(spark.read.parquet(f"{sf_dir}/documents.parquet"))
