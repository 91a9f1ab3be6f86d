"""The network's gradients, its windows, held-out accuracy and odd rows."""

from __future__ import annotations

import zlib

import numpy as np

from vecspark.llm import language_id as lang

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, id long, h long, labels string"


def test_gradients_by_differences():
    rng = np.random.default_rng(3)
    network = {k: v.astype(np.float64) for k, v in lang.new_network(3, rng).items()}
    x, labels, n = rng.integers(97, 103, (5, 9)).astype(np.uint8), np.array([0, 1, 2, 1, 0]), np.array([9, 4, 9, 1, 7])
    counts = np.arange(9)[None, :] < n[:, None]

    def loss(net):
        states = []  # the same steps in double, one place at a time
        for way in (0, 1):
            h, own = np.zeros((5, lang.HIDDEN)), []
            for t in range(9) if way == 0 else reversed(range(9)):
                row, g = net["table"][:, x[:, t].astype(int) + 256 * way], np.einsum("bi,kij->kbj", h, net["turn"][:, way])
                z, r = np.clip(row[0] + g[0], 0, 1), np.clip(row[1] + g[1], 0, 1)
                new = np.tanh(row[2] + r * g[2])
                h = z * h + (1 - z) * new
                own.append(h)
            states.append(own if way == 0 else own[::-1])
        z = np.array([f @ net["out"][0] + b @ net["out"][1] + net["bias"] for f, b in zip(*states, strict=True)])
        p = np.exp(z) / np.exp(z).sum(-1, keepdims=True)
        return -(np.log(p[:, np.arange(5), labels]) * counts.T).sum() / counts.sum()

    small = {k: v.astype(np.float32) for k, v in network.items()}
    slopes, mean = lang.slopes(small, x, labels, counts)
    assert abs(mean - loss(network)) < 1e-5
    for k, v in network.items():
        flat = np.abs(slopes[k]).reshape(-1)
        for at in flat.argsort()[-6:]:  # the steepest of each
            step = np.zeros(v.size)
            step[at] = 1e-5
            step = step.reshape(v.shape)
            rise = (loss(network | {k: v + step}) - loss(network | {k: v - step})) / 2e-5
            assert abs(rise - slopes[k].reshape(-1)[at]) < 1e-3 * max(1.0, abs(rise)), k


def test_every_byte_counts_once():
    texts = [b"a", b"b" * 63, b"c" * 64, b"d" * 65, b"e" * 1000]
    network = lang.new_network(2, np.random.default_rng(1))
    held = np.zeros(5, dtype=int)
    for _, counts, of in lang.read(network, texts):
        np.add.at(held, of, counts.sum(axis=0))
    assert held.tolist() == [len(t) for t in texts]
    p = lang.pooled(network, texts)
    assert np.allclose(p.sum(axis=1), 1, atol=1e-5)
    assert np.allclose(p, np.concatenate([lang.pooled(network, [t]) for t in texts]), atol=1e-6)


def test_documents_that_are_held_out(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    model = lang.fit(docs)
    got = {r["doc_id"]: r for r in lang.identify(docs).collect()}
    again = {r["doc_id"]: r["lang_pred"] for r in lang.predict(docs, model).collect()}
    asked = [r for r in docs.collect() if zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2 and r["lang"] is not None and lang.has_letter(r["text"])]
    assert len(asked) > 30 and np.mean([got[r["doc_id"]]["lang_pred"] == r["lang"] for r in asked]) >= 0.95
    assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % 4 == 2) and 0 <= r["score"] <= 1 for i, r in got.items())
    assert {i: r["lang_pred"] for i, r in got.items()} == again
    text = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    for r in lang.label_positions(docs.limit(30), model).collect():
        assert len(r["labels"]) == len(text[r["doc_id"]].encode())


def test_labels_and_sources_are_not_looked_at(spark):
    """The language of the held-out rows and all other columns change nothing."""
    rows = [(i, f"der und die nicht {i}" if i % 2 else f"the and of with {i}", "de" if i % 2 else "en", "s", 1) for i in range(60)]
    kept = [zlib.crc32(str(i).encode()) % 4 == 2 for i in range(60)]
    other = [(i, t, ("xx" if k else y), "other", 9) for (i, t, y, _, _), k in zip(rows, kept, strict=True)]
    out = [sorted(map(tuple, lang.identify(spark.createDataFrame([r + (0.1, 5, 6, "l") for r in part], SCHEMA)).collect())) for part in (rows, other)]
    assert out[0] == out[1] and {r[2] for r in out[0]} == {"de", "en"}


def test_odd_rows(spark):
    rows = [
        (1, "the and of with", "en"), (1, "the and of with", "en"), (2, None, "en"), (3, "", "de"), (4, " 12 34 %&", "de"), (None, "no id of the", "en"), (5, "der und die nicht", "de"),
        (6, "x" * 500_000, None), (7, "Ünïcödé 日本語 \U0001f600", None), (8, "the end", "en"), (9, "das Ende der", "de"), (10, "\U0001f600", "fr"),
    ]
    docs = spark.createDataFrame([(*r, "s", 1, 0.5, 1, 2, "x") for r in rows], SCHEMA).repartition(3)
    got = lang.identify(docs).collect()
    assert len(got) == len(rows)
    none = [r for r in got if r["lang_pred"] == "und"]
    assert sorted(r["doc_id"] for r in none) == [2, 3, 4, 10] and {r["score"] for r in none} == {0.0}
    assert {r["lang_pred"] for r in got} <= {"en", "de", "und"}
    assert [r["held_out"] for r in got if r["doc_id"] is None] == [False]
    assert lang.identify(docs.where("false")).collect() == []
    assert {r["lang_pred"] for r in lang.identify(docs.withColumn("lang", lang.F.lit(None).cast("string"))).collect()} == {"und"}
