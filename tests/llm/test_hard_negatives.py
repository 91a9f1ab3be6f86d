"""Hard negatives against a plain loop over all pairs, and what the tree leaves out."""

from __future__ import annotations

import math

import numpy as np
import pytest

from vecspark.llm import hard_negatives

SCHEMA = "vec_id long, embedding array<float>, label int, row long, id long, q string, place int, windows string"


def plain(rows: list[tuple]) -> list[tuple]:
    known = []
    for i, v, y in rows:
        if y is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        known.append((i, (y + 1) % 10 if i is not None and i % 7 == 0 else y, [math.floor(256 * float(np.float32(x))) for x in v]))
    last = 1 << 62
    out = []
    for n, (i, y, v) in enumerate(known):
        if i is None or i % 100:
            continue
        scores = sorted(((-sum(a * b for a, b in zip(v, w, strict=False)), j if j is not None else last, m, z) for m, (j, z, w) in enumerate(known) if m != n))
        for s, j, _, _ in [x for x in scores if x[3] == y][:5]:
            kept = [(t, k) for t, k, _, z in scores if z != y and 30 * -s <= 100 * -t <= 90 * -s]
            out += [(i, j if j != last else None, r, k if k != last else None, -s, -t) for r, (t, k) in enumerate(kept[:10], 1)]
    return sorted(out, key=str)


def random_rows(n: int, seed: int) -> list[tuple]:
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(12, 16))
    v = centres[rng.integers(0, 12, n)] + 0.6 * rng.normal(size=(n, 16))
    v = (v / np.linalg.norm(v, axis=1)[:, None] * rng.choice([0.2, 1.0, 3.0], n)[:, None]).astype(np.float32)
    return [(i, [float(x) for x in v[i]], int(y)) for i, y in enumerate(rng.integers(0, 10, n))]


def frame(spark, rows):
    return spark.createDataFrame([r + (1, 2, "q", 3, "w") for r in rows], SCHEMA).repartition(3)


@pytest.mark.parametrize("n", [0, 1, 900])
def test_mine(spark, n):
    rows = random_rows(n, 5)
    if n > 1:
        v = rows[0][1]
        rows += [
            (None, v, 3), (None, v, rows[0][2]), (1000, None, 1), (1100, [*v[:3], None], 1), (1200, [*v[:15], float("nan")], 1), (1300, [*v[:15], float("inf")], 1), (1400, v, None),
            (1500, [], 2), (1600, v[:5], 3), (1700, [0.0] * 16, 3), (100, v, 4), (100, v, 4), (1800, [x * 1000 for x in v], 5),
        ]
        rows += [(2000 + i, v, i % 3) for i in range(1500)]  # many copies: one leaf, many slices, ties
    got = sorted((tuple(r) for r in hard_negatives.mine(frame(spark, rows)).collect()), key=str)
    assert got == plain(rows)
    assert n < 2 or len(got) > 500


def test_siblings_are_left_out_by_their_ranges(spark):
    rng = np.random.default_rng(2)
    centres = 4 * rng.normal(size=(40, 8))
    x = np.floor(256 * (centres[rng.integers(0, 40, 6000)] + 0.1 * rng.normal(size=(6000, 8))))
    tree = hard_negatives.Tree(x[:1500], float((x * x).sum(axis=1).max()))
    leaf = tree.place(x)
    a = x[:50]
    scores = a @ x.T
    most = scores.max(axis=1)
    least = most * 0.9
    seen = 0
    hit = np.zeros((50, tree.leaves), dtype=bool)
    for n, who in tree.reached(a, least, most):
        hit[who, n] = True
        seen += len(who) * int((leaf == n).sum())
    inside = (scores >= least[:, None]) & (scores <= most[:, None])
    assert all(hit[w, leaf[np.flatnonzero(inside[w])]].all() for w in range(50))
    assert seen < 0.5 * 50 * 6000
