"""Which documents of the join meet: all that can be linked, and hardly any that only share a passage."""

from __future__ import annotations

import random

import numpy as np
import pytest

from vecspark.llm import ngram_join

U = np.uint64


def corpus(n: int, seed: int = 5) -> tuple[list[tuple[int, str]], set[int]]:
    """Texts of their own words around a passage that all of them share, and two near copies of every tenth."""
    rng = random.Random(seed)
    words = lambda k: [f"v{rng.randrange(50_000)}" for _ in range(k)]
    passage = words(16)
    docs, near = [], set()
    for i in range(n):
        k = rng.choice([24, 30, 60, 90])
        t = words(k)
        at = rng.randrange(k)
        t = t[:at] + passage + t[at:]
        docs.append((10 * i, " ".join(t)))
        if i % 10 == 0:
            docs += [(10 * i + j, " ".join([*t[:-1], f"x{rng.randrange(9999)}"])) for j in (1, 2)]
            near |= {10 * i, 10 * i + 1, 10 * i + 2}
    return docs, near


def test_documents_that_share_only_a_passage_do_not_meet(spark):
    docs, near = corpus(3000)
    sets = [ngram_join.shingle_set(t, 5, {}) for _, t in docs]
    rows = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    sizes = (max(map(len, sets)), sum(map(len, sets)), len(sets))
    edges = ngram_join.candidate_edges(rows, sizes, 5, 80, 100, "doc_id", "text").distinct().collect()
    met = {i for e in edges for i in e}
    assert near <= met
    assert len(met - near) < 200, len(met - near)  # of 2,700; before the filter of shared keys 1,409 met
    assert {(e["a"], e["b"]) for e in edges} >= {(i, i + 1) for i in near if i % 10 == 0}


@pytest.mark.parametrize("num", [80, 90])
def test_linked_sets_keep_a_key_in_common(num):
    rng = np.random.default_rng(num)
    common = rng.integers(0, 2**64, 40, dtype=U)  # tokens of very many sets
    sets = []
    for _ in range(400):
        n = int(rng.choice([1, 2, 3, 5, 8, 13, 20, 40, 90, 400]))
        a = np.concatenate([rng.integers(0, 2**64, n, dtype=U), rng.choice(common, int(rng.integers(0, 40)), replace=False)])
        b = a.copy()
        for i in rng.choice(len(b), int(rng.integers(0, len(b) // 6 + 1)), replace=False):
            b[i] = rng.choice(common) if rng.random() < 0.5 else rng.integers(0, 2**64, dtype=U)
        sets += [np.unique(a), np.unique(b[: len(b) - int(rng.integers(0, 2)) * (len(b) // 15)])]
    firsts = ngram_join.bands(num, 100, max(map(len, sets)) + 1)
    key, owner, code = [], [], []
    for i, s in enumerate(sets):
        for role, (k, least) in enumerate(ngram_join.meeting_keys(s, firsts, num, 100)):
            key.append(k)
            owner.append(np.full(len(k), i, dtype=U))
            code.append(np.full(len(k), 2 * least + role, dtype=U))
    shared = ngram_join.shared_keys(*(np.concatenate(c) for c in (key, owner, code)))
    assert (shared[3] > 1).all()
    kept = {}
    for k, o in zip(*(c.tolist() for c in ngram_join.rarest_keys(*shared)), strict=True):
        kept.setdefault(o, set()).add(k)
    pairs = 0
    for i in range(len(sets)):
        for j in range(i):
            a, b = sets[i], sets[j]
            if 100 * min(len(a), len(b)) >= num * max(len(a), len(b)) and ngram_join.linked(len(np.intersect1d(a, b)), len(a), len(b), num, 100):
                pairs += 1
                assert kept.get(i, set()) & kept.get(j, set()), (len(a), len(b))
    assert pairs > 100


def test_a_row_that_comes_twice_shares_nothing_with_itself():
    key, owner, code = (np.array(x, dtype=U) for x in ([7, 7, 8, 8, 8], [1, 1, 1, 2, 2], [2, 2, 2, 4, 4]))
    assert [c.tolist() for c in ngram_join.shared_keys(key, owner, code)] == [[8, 8], [1, 2], [2, 4], [2, 2]]
    none = [np.zeros(0, U)] * 4
    assert [len(c) for c in (*ngram_join.shared_keys(*none[:3]), *ngram_join.rarest_keys(*none))] == [0] * 6
