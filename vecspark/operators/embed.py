"""Text to vector.

An embedder has ``dims`` and ``column(text, task)``, which returns a struct of ``embedding``
and ``error``. Exactly one of the two is set: a text that cannot be embedded has an error
and no vector, and the other texts of its batch are not affected.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from hashlib import md5
from typing import Protocol

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vecspark.functions.text import trim_text
from vecspark.operators.validation import Rule, dims_rule, with_errors
from vecspark.schema import EXTERNAL_SERVICE_ERROR, TASK_DOCUMENT

RESULT = "struct<embedding: array<float>, error: string>"
EMPTY = "Empty embedding response"
HASH_ROWS = 1024  # texts summed up at a time, so that a batch never holds all its sums in double
HASH_BYTES = 4 << 20  # of texts cut into words at a time: words take several times the text


class Embedder(Protocol):
    dims: int

    def column(self, text: Column, task: str) -> Column: ...


class HashingEmbedder:
    """Offline embedder: signed feature hashing of the words of a text.

    A token is a lower-case run of letters and digits. Of its MD5, the first four bytes
    choose the bucket and the next bit the sign. Each Arrow batch is cut into tokens, its
    distinct tokens are hashed once, and the signs are added up with numpy. There is no
    shuffle, and a text's length affects only its own row. The model is lexical, so the task
    does not change the vector.

    ``normalize=False`` keeps whole-number weights: cosine similarity does not depend on the
    length, and sums of whole numbers are exact in any order.
    """

    def __init__(self, dims: int = 256, normalize: bool = True) -> None:
        self.dims = dims
        self.normalize = normalize

    def column(self, text: Column, task: str = TASK_DOCUMENT) -> Column:
        dims, normalize = self.dims, self.normalize

        @F.arrow_udf(RESULT)
        def hashed(texts: pa.Array) -> pa.Array:
            sums = _bucket_sums(texts, dims)
            if normalize:
                length = np.sqrt(np.square(sums, dtype=np.float64).sum(axis=1, keepdims=True))
                sums = np.divide(sums, length, out=np.zeros_like(sums), where=length > 0)
            empty = ~sums.any(axis=1)
            offsets = np.arange(len(texts) + 1, dtype=np.int32) * dims
            vectors = pa.ListArray.from_arrays(pa.array(offsets), pa.array(sums.ravel()), mask=pa.array(empty))
            errors = pa.array(np.full(len(texts), EMPTY), pa.string(), mask=~empty)
            return pa.StructArray.from_arrays([vectors, errors], ["embedding", "error"])

        # Without this mark a filter on the result would run the function a second time.
        return hashed.asNondeterministic()(F.lower(F.coalesce(text, F.lit(""))))


def _bucket_sums(texts: pa.Array, dims: int) -> np.ndarray:
    """Sums of token signs per text and bucket; exact, as they are small whole numbers.

    Texts are taken in turn, some at a time, so that what is needed besides the sums does not
    grow with the batch.
    """
    sums = np.empty((len(texts), dims), dtype=np.float32)
    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    at = 0
    while at < len(texts):
        upto = int(np.searchsorted(ends, (ends[at - 1] if at else 0) + HASH_BYTES, side="right"))
        upto = min(max(upto, at + 1), at + HASH_ROWS)
        _sum_words(texts[at:upto], sums[at:upto])
        at = upto
    pa.default_memory_pool().release_unused()  # workers live on and would keep what the batch needed
    return sums


def _sum_words(texts: pa.Array, sums: np.ndarray) -> None:
    tokens = pc.split_pattern_regex(texts, pattern=r"[^\pL\pN]+")
    words = tokens.flatten().dictionary_encode()
    distinct = words.dictionary.cast(pa.binary()).to_pylist()
    dims = sums.shape[1]
    codes = np.frombuffer(b"".join([md5(w).digest()[:8] for w in distinct]), dtype=">u8")
    bucket = ((codes >> np.uint64(32)) % np.uint64(dims)).astype(np.int64)
    sign = np.where(codes & np.uint64(1 << 31), -1.0, 1.0)
    sign[[w == b"" for w in distinct]] = 0.0
    index, n = words.indices.to_numpy(), len(texts)
    row = np.repeat(np.arange(n) * dims, np.diff(tokens.offsets.to_numpy()))
    sums[:] = np.bincount(row + bucket[index], weights=sign[index], minlength=n * dims).reshape(n, dims)


class ModelEmbedder:
    """A plug-in model: ``load()`` returns ``embed(texts, task) -> list of vectors``.

    The model is loaded once per Python worker task, not per batch. When a batch fails, its
    texts are tried one by one, so that only the texts that really fail get an error.
    """

    def __init__(
        self,
        load: Callable[[], Callable[[Sequence[str], str], Sequence[Sequence[float] | None]]],
        dims: int,
        batch_size: int = 64,
        service: str = "embedding model",
    ) -> None:
        self.load = load
        self.dims = dims
        self.batch_size = batch_size
        self.service = service

    def column(self, text: Column, task: str = TASK_DOCUMENT) -> Column:
        load, dims, size = self.load, self.dims, self.batch_size

        @F.pandas_udf(RESULT)
        def generate(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
            model = load()
            for texts in batches:
                rows: list[tuple] = []
                for i in range(0, len(texts), size):
                    rows.extend(_embed_batch(model, list(texts.iloc[i : i + size]), task, dims))
                yield pd.DataFrame(rows, columns=["embedding", "error"])

        return generate.asNondeterministic()(text)


def _embed_batch(model, texts: list[str | None], task: str, dims: int) -> list[tuple]:
    if None in texts:
        # Rows that already failed a check carry no text and are not sent to the model.
        known = iter(_embed_batch(model, [t for t in texts if t is not None], task, dims))
        return [(None, EMPTY) if t is None else next(known) for t in texts]
    if not texts:
        return []
    try:
        vectors = list(model(texts, task))
        if len(vectors) != len(texts):
            raise ValueError(f"Expected {len(texts)} vectors, got {len(vectors)}")
    except Exception as e:
        if len(texts) == 1:
            return [(None, str(e) or type(e).__name__)]
        return [row for t in texts for row in _embed_batch(model, [t], task, dims)]
    return [_checked(v, dims) for v in vectors]


def _checked(vector: Sequence[float] | None, dims: int) -> tuple:
    if vector is None or len(vector) == 0:
        return None, EMPTY
    if len(vector) != dims:
        return None, f"Expected {dims} dims, got {len(vector)}"
    return np.asarray(vector, dtype=np.float32), None


def embed_texts(
    df: DataFrame, embedder: Embedder, text: str = "content", out: str = "embedding", task: str = TASK_DOCUMENT
) -> DataFrame:
    """Add the vector of the trimmed text, and ``embed_error`` where there is none."""
    result = df.withColumn("_embedded", embedder.column(trim_text(F.col(text)), task))
    return result.withColumns(
        {out: F.col("_embedded")["embedding"], "embed_error": F.col("_embedded")["error"]}
    ).drop("_embedded")


def with_embed_errors(df: DataFrame, embedder: Embedder, vector: str = "embedding") -> DataFrame:
    """Turn failed and wrongly sized vectors into quarantine errors; ``error_cause`` keeps the reason."""
    service = getattr(embedder, "service", "embedding model")
    failed = Rule(
        F.col("embed_error").isNotNull(), f"Error from external service: {service}", "embedding", EXTERNAL_SERVICE_ERROR
    )
    out = with_errors(df, [failed, dims_rule(F.col(vector), embedder.dims, service)])
    got = F.coalesce(F.size(vector).cast("string"), F.lit("none"))
    wrong_size = F.concat(F.lit(f"Expected {embedder.dims} dims, got "), got)
    cause = F.when(F.col("error_code") == EXTERNAL_SERVICE_ERROR, F.coalesce(F.col("embed_error"), wrong_size))
    return out.withColumn("error_cause", cause).drop("embed_error")


def embed_weights(df: DataFrame, id: str, vector: str = "embedding") -> DataFrame:
    """Long form of sparse vectors: one row per non-zero bucket."""
    return df.select(id, F.posexplode(vector).alias("bucket", "weight")).filter(F.col("weight") != 0)
