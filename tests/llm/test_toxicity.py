"""Toxicity against a plain version: loops over all terms and all examples."""

from __future__ import annotations

import math
import random
import zlib

import numpy as np

from vecspark.llm import toxicity


def corpus():
    rng = random.Random(5)
    words = ["".join(rng.choices("abcdefghij", k=rng.randint(2, 8))) for _ in range(900)]
    bad = [f"{a}{b}" for a in ("zorp", "quux", "vlim", "wrekk", "yatt") for b in ("", "ah", "os", "ine")] * 3
    rows = []
    for i in range(400):
        text = rng.choices(words, k=rng.randint(5, 90))
        if i % 4 == 0:
            text += rng.sample(bad, 3)
        rng.shuffle(text)
        rows.append((i, (". " if i % 3 else " ").join(text) + "!"))
    return rows


def plain(rows, known, curve):
    """Scores and evidence by loops over all terms and all examples, with plain dictionaries."""
    found = {i: toxicity.counts(t) for i, t in rows}
    text = dict(rows)
    examples, seen = [], set()
    for i in sorted(known):
        if (text[i], known[i]) not in seen and found[i]:
            seen.add((text[i], known[i]))
            examples.append(i)
    vocabulary = {t for i in examples for t in found[i]}
    idf = {t: math.log((1 + len(rows)) / (1 + sum(t in f for f in found.values()))) + 1 for t in vocabulary}
    yes, no = ([i for i in examples if known[i] == y] for y in (1, 0))
    tied = set()
    for t in vocabulary:
        a, b = sum(t in found[i] for i in yes), sum(t in found[i] for i in no)
        share = (a + b + 1) / (len(examples) + 2)
        if (a + 0.5) / (len(yes) + 1) - (b + 0.5) / (len(no) + 1) > toxicity.TIE * math.sqrt(share * (1 - share) * (1 / len(yes) + 1 / len(no))):
            tied.add(t)

    def unit(f):
        w = {t: (1 + math.log(n)) * idf[t] for t, n in f.items() if t in idf}
        size = math.sqrt(sum(x * x for x in w.values()))
        return {t: x / size for t, x in w.items()}

    units = {i: unit(found[i]) for i in examples}
    out = {}
    for i, _ in rows:
        q = unit(found[i])
        sides = []
        for side in (no, yes):
            near = sorted((-sum(x * units[e].get(t, 0.0) for t, x in q.items()), e) for e in side if text[e] != text[i])
            sides.append([(-s, e) for s, e in near if s < 0][: toxicity.NEIGHBOURS])
        against, pro = (sum(s * s for s, _ in side) / toxicity.NEIGHBOURS for side in sides)
        part = sum(s * sum(x * units[e].get(t, 0.0) for t, x in q.items() if t in tied) for s, e in sides[1])
        share = part / (toxicity.NEIGHBOURS * pro) if pro else 0.0
        z = curve[0] + curve[1] * math.log((pro + 1e-3) / (against + 1e-3)) + curve[2] * math.sqrt(share)
        evidence = sorted((-s, y, e) for y in (0, 1) for s, e in sides[y])[: toxicity.EVIDENCE]
        out[i] = 1 / (1 + math.exp(-z)), [-s for s, _, _ in evidence]
    return out, vocabulary, tied


def test_scores_are_those_of_plain_loops(spark):
    rows = corpus()
    rows += [(400 + i, rows[4 * i][1]) for i in range(20)]  # copies of toxic texts
    truth = {i: int(i % 4 == 0 or i >= 400) for i, _ in rows}
    labels = spark.createDataFrame([(i, 1, y) for i, y in truth.items()], "doc_id long, quality int, toxic int")
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    known = {i: y for i, y in truth.items() if zlib.crc32(str(i).encode()) % 5}
    model = toxicity.fit(docs, labels)
    want, vocabulary, tied = plain(rows, known, model["curve"])
    assert set(model["names"]) == vocabulary and tied
    got = {r["doc_id"]: r for r in toxicity.toxicity(docs, labels).collect()}
    for i, (score, near) in want.items():
        assert abs(got[i]["score"] - score) < 1e-6
        assert [round(e["similarity"], 9) for e in got[i]["evidence"]] == [round(s, 9) for s in near]
    held = [i for i in truth if i not in known]
    assert sum(got[i]["predicted"] == truth[i] for i in held) >= 0.9 * len(held)


def test_blocks_that_cannot_reach_are_not_scored():
    """Examples of a few kinds with words of their own: a text is compared with those of its kind."""
    rng = np.random.default_rng(1)
    vectors = []
    for i in range(1200):
        t = np.concatenate([np.arange(5), np.sort(5 + rng.choice(295, 15, replace=False))]) + 300 * (i % 6)
        w = (rng.random(20) + 0.1) * np.where(np.arange(20) < 5, 3, 1)
        vectors.append((t, w / np.sqrt(w @ w)))
    index = toxicity.BlockMaxIndex(vectors, 1800)
    asked = vectors
    found = index.search_all(asked, 15)
    assert index.scored < 0.5 * index.all_blocks
    dense = np.zeros((1200, 1800))
    for i, (t, w) in enumerate(vectors):
        dense[i, t] = w
    for (t, w), got in zip(asked, found, strict=True):
        scores = dense[:, t] @ w
        best = np.lexsort((np.arange(1200), -scores))[:15]
        assert [i for _, i, _ in got] == best[scores[best] > 0].tolist()


def test_odd_ids_and_long_examples(spark, monkeypatch):
    monkeypatch.setattr(toxicity, "TERMS_PER_CLASS", 60)
    rows = [(f"d{i}", " ".join(f"{'bad' if i % 2 else 'fine'}{chr(97 + (i * j) % 26)} w{chr(97 + j % 26)}" for j in range(3 + i))) for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id string, text string")
    labels = spark.createDataFrame([(i, 1, int(i[1:]) % 2) for i, _ in rows], "doc_id string, quality int, toxic int")
    model = toxicity.fit(docs, labels)
    assert 0 < sum(len(t) for t, _ in model["examples"][1]) <= 60
    got = toxicity.toxicity(docs, labels).collect()
    assert len(got) == 40 and all(e["doc_id"].startswith("d") for r in got for e in r["evidence"])
