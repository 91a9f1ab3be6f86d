"""The join on ids that repeat with differing, equal and empty texts, against plain sets."""

from __future__ import annotations

import random

from vecspark.llm import ngram_join

WORDS, NUM, DEN = 3, 90, 100


def shingles(text):
    w = (text or "").lower().split()
    return frozenset(tuple(w[i : i + WORDS]) for i in range(max(1, len(w) - WORDS + 1))) if w else frozenset()


def plain(rows):
    """Rows are nodes: (id, size of the set, least id of what is linked)."""
    sets = [shingles(t) for _, t in rows]
    up = list(range(len(rows)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if rows[i][0] is not None and rows[j][0] is not None and sets[i] and sets[j]:
                both = len(sets[i] & sets[j])
                if DEN * both >= NUM * (len(sets[i]) + len(sets[j]) - both):
                    up[max(root(i), root(j))] = min(root(i), root(j))
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[root(i)] = min(d, least.get(root(i), d))
    return [(d, len(sets[i]), None if d is None else least[root(i)]) for i, (d, _) in enumerate(rows)]


def corpus():
    rng = random.Random(3)
    text = lambda n: [f"w{rng.randrange(400)}" for _ in range(n)]
    near = lambda words: " ".join([*words[:-1], f"x{rng.randrange(999)}"])
    a, b, c, d = text(80), text(90), text(70), text(120)
    rows = [(1, " ".join(a)), (1, " ".join(b)), (5, near(b)), (6, near(a)), (7, " ".join(c)), (7, ""), (8, near(c)), (7, None), (9, "  ")]
    rows += [(20, " ".join(d)), (20, near(d)), (20, " ".join(d)), (21, near(d)), (None, " ".join(d)), (None, None), (30, "same"), (30, "same"), (31, "SAME"), (32, "")]
    return rows + [(40 + i, " ".join(text(40))) for i in range(30)]


def test_components(spark):
    rows = corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = [tuple(r) for r in ngram_join.jaccard_components(docs, WORDS, NUM, DEN).collect()]
    assert sorted(got, key=str) == sorted(plain(rows), key=str)


def test_one_of_each_keeps_every_text_that_nothing_stands_for(spark):
    rows = corpus()
    docs = spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id long, text string, node int, own_node int").repartition(3)
    out = ngram_join.one_of_each(docs, WORDS, NUM, DEN)
    assert out.columns == docs.columns
    kept = [(r["doc_id"], r["text"]) for r in out.collect()]
    want = {(d, t) for (d, t), (_, n, c) in zip(rows, plain(rows), strict=True) if d is None or not n or d == c}
    # Of the two linked texts of id 20, and of the equal rows of id 30, one stays.
    assert {k for k in kept if k[0] != 20} == {w for w in want if w[0] != 20} and len(kept) == len(want) - 1
    assert len([k for k in kept if k[0] == 20]) == 1


def test_ids_that_do_not_repeat_with_other_texts_are_their_own_numbers(spark):
    docs = spark.createDataFrame([(3, "a b c"), (4, "a b c"), (4, "a b c")], "doc_id long, text string")
    assert [r[0] for r in docs.select(ngram_join.own_nodes(docs, 3, "doc_id", "text").alias("n")).collect()] == [3, 4, 4]
