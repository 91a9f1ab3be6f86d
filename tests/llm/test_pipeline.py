"""The whole pipeline on planted documents, each stage held against plain Python."""

from __future__ import annotations

import hashlib
import random
import re
from collections import defaultdict

import public_tokenizers
import pytest

import corpus_pipeline
from vecspark.llm import toxicity
from vecspark.llm.common import written

WORDS = ["".join(random.Random(n).choices("abcdefghijklmnopqrst", k=3 + n % 6)) for n in range(1500)]
BAD = ["zorpling", "quuxhead", "vlimmer", "wrekker", "yattface"]
PASSAGE = " ".join(f"shared{i} passage{i}" for i in range(40))


def planted() -> tuple[list[tuple], list[tuple]]:
    rng = random.Random(9)
    text = lambda n: rng.choices(WORDS, k=n)
    rows, toxic = [], set()
    for i in range(260):
        words = text(rng.randint(60, 140))
        if i % 5 == 0:
            toxic.add(i)
            for w in rng.sample(BAD, 3):
                words.insert(rng.randrange(len(words)), w)
        rows.append((i, words))
    for i in range(260, 290):  # copies of clean documents, exact and but for a word
        words = list(rows[4 * (i - 260) + 1 + ((4 * (i - 260) + 1) % 5 == 0)][1])
        if i % 2:
            words[rng.randrange(len(words))] = "changed"
        rows.append((i, words))
    out = []
    for i, words in rows:
        t = " ".join(words)
        if i % 17 == 3 and i < 260 and i not in toxic:
            t = f"{t[: len(t) // 2]} {PASSAGE} {t[len(t) // 2 :]}"
        out.append((i, t, "en", ("a", "b", "c", None)[0 if i % 3 else i % 4], len(t)))
    out += [(290, None, "en", "a", None), (291, "", None, "b", 0), (292, "short text", "en", "c", 10)]
    return out, [(i, 1, int(i in toxic)) for i in range(200)]


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("planted"))
    rows, labels = planted()
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    tables = [docs]
    for name, stage in corpus_pipeline.STAGES:
        tables.append(written(stage(spark, tables[-1], folder), f"test-{name}"))
    final = corpus_pipeline.run(spark, folder)
    return [[tuple(r) for r in t.collect()] for t in tables], [t.columns for t in tables], [tuple(r) for r in final.collect()]


def shingles(text: str | None) -> frozenset:
    w = (text or "").lower().split()
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def test_toxic_documents_go(stages):
    (before, after, *_), columns, _ = stages
    toxic = {r[0] for r in before if any(w in (r[1] or "") for w in BAD)}
    assert columns[1] == columns[0]
    assert set(after) <= set(before)
    gone = {r[0] for r in before} - {r[0] for r in after}
    assert len(gone & toxic) >= 0.9 * len(toxic) and len(gone - toxic) <= 2


def test_one_of_each_group_stays(stages):
    (_, before, after, *_), _, _ = stages
    sets, up = {r[0]: shingles(r[1]) for r in before}, {r[0]: r[0] for r in before}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    ids = sorted(sets)
    for i in ids:
        for j in ids:
            if j < i and sets[i] and sets[j]:
                k = len(sets[i] & sets[j])
                if 100 * k >= 80 * (len(sets[i]) + len(sets[j]) - k):
                    up[max(root(i), root(j))] = min(root(i), root(j))
    assert sorted(after) == sorted(r for r in before if root(r[0]) == r[0])
    assert len(after) < len(before)


def test_repeated_passages_go(stages):
    (_, _, before, after, *_), _, _ = stages
    seen: dict[bytes, int] = {}
    texts = {r[0]: (r[1] or "").encode() for r in before}
    for i in sorted(texts):
        for k in range(len(texts[i]) - 49):
            seen.setdefault(texts[i][k : k + 50], i)
    got = {r[0]: (r[1] or "").encode() for r in after}
    assert set(got) == set(texts)
    removed = 0
    for i, t in texts.items():
        cover = bytearray(len(t))
        for k in range(len(t) - 49):
            if seen[t[k : k + 50]] < i:
                cover[k : k + 50] = b"\1" * 50
        kept = bytes(b for b, c in zip(t, cover, strict=True) if not c)
        removed += kept != t
        assert got[i] == kept.decode(errors="ignore").encode()
    assert removed > 3


def test_sources_come_near_their_targets(stages):
    (*_, before, after, _), _, _ = stages
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    held, taken, most = defaultdict(int), defaultdict(int), defaultdict(int)
    for r in before:
        held[r[3]] += size(r[1])
        most[r[3]] = max(most[r[3]], size(r[1]))
    for r in after:
        taken[r[3]] += size(r[1])
    names = sorted(held, key=lambda s: (s is None, s))
    weight, target, free, left = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}, {}, set(names), float(sum(held.values()))
    while True:
        level = left / sum(weight[s] for s in free)
        cut = [s for s in free if weight[s] * level > 3 * held[s]]
        if not cut:
            break
        for s in cut:
            target[s] = 3.0 * held[s]
            left -= target[s]
            free.discard(s)
    target |= {s: weight[s] * level for s in free}
    assert all(abs(taken[s] - target[s]) <= most[s] / 2 + 1e-6 for s in names)
    assert set(after) <= set(before)


def test_tokens_of_what_is_left(stages):
    (*_, before, after), _, final = stages
    import tiktoken

    from vecspark.llm import bpe

    path, pattern = public_tokenizers.path(bpe.VOCABULARY), public_tokenizers.PATTERN
    own = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=bpe.Merges(bpe.read_ranks(path), pattern).ranks, special_tokens={})
    want = []
    for r in before:
        ids = own.encode_ordinary(r[1] or "")
        want.append((r[0], len(ids), hashlib.sha256(b"".join(x.to_bytes(4, "little") for x in ids)).hexdigest(), hashlib.sha256((r[1] or "").encode()).hexdigest()))
    assert sorted(after) == sorted(want)
    assert sorted(final) == sorted(after)  # the whole run is its stages one after the other


def test_words_are_cut_to_beginnings():
    assert toxicity.counts("Zorpling zorp, ZORPS x1y") == {"zorp": 3, "x": 1, "y": 1}
