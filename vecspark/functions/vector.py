"""Vector columns: text form, size, cosine similarity and distance."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F


def parse_vector(text: Column) -> Column:
    """``'[0.1,0.2]'`` to ``array<float>``; NULL for anything that is not a finite vector."""
    v = F.from_json(text, "array<float>")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    alone = text.rlike(r"^\s*\[[^\[\]]*\]\s*$")  # the JSON reader stops after the first value
    return F.when(alone & (F.size(v) > 0) & finite, v)


def format_vector(vector: Column) -> Column:
    """A vector as ``'[a,b,...]'`` text."""
    return F.to_json(vector)


def embedding_dim(vector: Column) -> Column:
    return F.size(vector)


def dot(a: Column, b: Column) -> Column:
    """Dot product in double precision, summed left to right."""
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda acc, x: acc + x)


def _ratio(dots: Column, aa: Column, bb: Column) -> Column:
    # NaN compares greater than every number, so it must not reach a threshold test.
    return F.nanvl(F.try_divide(dots, F.sqrt(aa * bb)), F.lit(None).cast("double"))


def cosine_similarity(a: Column, b: Column) -> Column:
    """Cosine of the angle, -1..1; NULL for zero-length or unequally long vectors."""
    return _ratio(dot(a, b), dot(a, a), dot(b, b))


def cosine_distance(a: Column, b: Column) -> Column:
    """``1 - similarity``, 0..2."""
    return 1 - cosine_similarity(a, b)


def vector_literal(values: Sequence[float]) -> Column:
    return F.lit(np.asarray(values, dtype=np.float64))


def similarity_to_native(vector: Column, query: Sequence[float]) -> Column:
    """Similarity to one fixed query vector as a column expression; its length is computed once."""
    q = np.asarray(query, dtype=np.float64)
    return _ratio(dot(vector, vector_literal(q)), dot(vector, vector), F.lit(float(row_dots(q[None, :], q)[0])))


# ---- Arrow form: the same left-to-right sums over a whole batch of vectors at once ----

CHUNK_ROWS = 2048  # rows whose double-precision copy is held at a time


def arrow_matrix(vectors: pa.Array, dims: int) -> np.ndarray:
    """The vectors as a float32 matrix, without a copy when all have ``dims`` elements.

    A missing or wrongly sized vector becomes a zero row, a NULL element becomes NaN.
    """
    if isinstance(vectors, pa.ChunkedArray):
        vectors = vectors.combine_chunks()
    n = len(vectors)
    fits = (np.diff(vectors.offsets.to_numpy()) == dims) & vectors.is_valid().to_numpy(zero_copy_only=False)
    if fits.all():
        return vectors.flatten().to_numpy(zero_copy_only=False).reshape(n, dims)
    matrix = np.zeros((n, dims), dtype=np.float32)
    matrix[fits] = vectors.filter(pa.array(fits)).flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)
    return matrix


def row_dots(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Dot products of the rows of ``a`` with the matching rows of ``b``, or with one vector.

    Products are added dimension by dimension in double, as the column form adds them.
    """
    out = np.empty(len(a))
    for i in range(0, len(a), CHUNK_ROWS):
        left = a[i : i + CHUNK_ROWS].T.astype(np.float64, order="C")
        right = b if b.ndim == 1 else b[i : i + CHUNK_ROWS].T.astype(np.float64, order="C")
        total, product = np.zeros(left.shape[1]), np.empty(left.shape[1])
        for x, y in zip(left, right, strict=True):
            np.multiply(x, y, out=product)
            total += product
        out[i : i + CHUNK_ROWS] = total
    return out


def cosines(dots: np.ndarray, aa: np.ndarray, bb: np.ndarray) -> np.ndarray:
    """Similarity from dot products and squared lengths; NaN for a zero or infinite length."""
    scale = np.sqrt(aa * bb)
    out = np.full(len(scale), np.nan)
    np.divide(dots, scale, out=out, where=(scale > 0) & np.isfinite(scale))
    return out


def similarity_to(vector: Column, query: Sequence[float]) -> Column:
    """Similarity to one fixed query vector, computed per Arrow batch.

    Only the vector column crosses to Python; the other columns of the row stay in the JVM.
    """
    q = np.asarray(query, dtype=np.float64)
    qq = row_dots(q[None, :], q)

    @F.arrow_udf("double")
    def score(vectors: pa.Array) -> pa.Array:
        m = arrow_matrix(vectors, len(q))
        sims = cosines(row_dots(m, q), row_dots(m, m), qq)
        return pa.array(sims, mask=np.isnan(sims))

    # Declared so that a filter on the similarity is not worked out from the vector again.
    return score.asNondeterministic()(vector.cast("array<float>"))
