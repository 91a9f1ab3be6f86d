"""Every operator and stage on nulls, empty and long texts, ties, repeats, empty tables and clashing columns."""

from __future__ import annotations

import hashlib
import zlib
from collections import defaultdict

import public_tokenizers
import pytest

import corpus_pipeline
from vecspark.llm import bpe, fingerprint, mixing, ngram_join, quality, sharding, suffix_dedup, toxicity, url_filter, warc
from vecspark.session import run_folder

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, part int, score double, size long, n_removed long, words string, place string"
PASSAGE = "a passage of some length that stands in two of the documents, word by word, and has to go"


def long_text(n: int) -> str:
    return " ".join(f"word{i * 7919 % 10007}" for i in range(n))


ROWS = [
    (1, "one two three four five six seven eight nine ten " + PASSAGE, "en", "b", 1),
    (2, "eleven twelve " + PASSAGE + " thirteen Ünïcödé", "en", "a", 1),
    (3, None, None, None, None),
    (4, "", "en", "", 0),
    (5, " \n\t ", "de", "a", 4),
    (None, "a text without an id", "en", "a", 1),
    (6, long_text(60_000), "en", "a", 1),
    (7, "x" * 300_000, "en", "b", 1),
    (8, "one two three four five six seven eight nine ten " + PASSAGE, "en", "b", 1),
    (9, "same same", "fr", None, 9),
    (9, "same same", "fr", None, 9),
    (10, "you are stupid trash 日本語 \U0001f600", "en", "a", 1),
    (11, " " * 100_000, "en", "a", 1),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([r + (7, 0.5, 3, 1, "w", "p") for r in ROWS], SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(i, 1, int(i in (2, 10)), "x") for i in range(1, 11)] + [(None, None, 1, "x"), (1, 1, None, "x")], "doc_id long, quality int, toxic int, text string")


def texts():
    return [(r[0], r[1] or "") for r in ROWS]


@pytest.mark.parametrize("place", range(5))
def test_stage(spark, docs, none, labels, tmp_path, place):
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    name, stage = corpus_pipeline.STAGES[place]
    for table in (docs, none):
        out = stage(spark, table, str(tmp_path))
        rows = out.collect()
        if place < 4:
            assert out.columns == table.columns
        if table is none:
            assert rows == []
    kept = sorted((r["doc_id"] is not None, r["doc_id"] or 0) for r in stage(spark, docs, str(tmp_path)).collect())
    if name == "ngram_jaccard_join":
        assert [i for _, i in kept] == [0, 1, 2, 3, 4, 5, 6, 7, 9, 10, 11]
    if name == "byte_bpe":
        assert len(kept) == len(ROWS)


def test_bpe(docs, none):
    import tiktoken

    path, pattern = public_tokenizers.path(bpe.VOCABULARY), public_tokenizers.PATTERN
    ranks = bpe.Merges(bpe.read_ranks(path), pattern).ranks
    own = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    short = docs.where("doc_id <> 7 OR doc_id IS NULL")
    got = sorted(tuple(r[1:]) for r in bpe.encode_digests(short, path, pattern).collect())
    want = []
    for i, t in texts():
        if i == 7:
            continue
        ids = own.encode_ordinary(t)
        want.append((len(ids), hashlib.sha256(b"".join(x.to_bytes(4, "little") for x in ids)).hexdigest(), hashlib.sha256(t.encode()).hexdigest()))
    assert got == sorted(want)
    assert bpe.encode_digests(none, path, pattern).collect() == []
    back = bpe.decode_ids(bpe.encode_ids(docs, path, pattern), path, pattern).collect()
    assert sorted(bytes(r["bytes"]) for r in back) == sorted(t.encode() for _, t in texts())


def test_toxicity(spark, docs, none, labels):
    rows = toxicity.toxicity(docs, labels).collect()
    assert len(rows) == len(ROWS) and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in rows)
    assert all(r["held_out"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in rows)
    assert toxicity.toxicity(none, labels).collect() == []
    assert {r["score"] for r in toxicity.toxicity(docs, labels.where("false")).collect()} == {0.0}


def test_block_max_search_is_exact():
    import numpy as np

    rng = np.random.default_rng(1)
    vectors = []
    for _ in range(500):
        t = np.sort(rng.choice(40, rng.integers(0, 6), replace=False))
        w = rng.random(len(t)) + 0.1
        vectors.append((t, w / max(1e-9, np.sqrt(w @ w))))
    index = toxicity.BlockMaxIndex(vectors, 40)
    dense = np.zeros((500, 40))
    for i, (t, w) in enumerate(vectors):
        dense[i, t] = w
    for (t, w), got in zip(vectors[:100], index.search_all(vectors[:100], 15), strict=True):
        scores = dense[:, t] @ w
        want = np.lexsort((np.arange(500), -scores))[:15]
        assert [i for _, i, _ in got] == want[scores[want] > 0].tolist()


def test_url_rules(spark):
    urls = ["http://A.com/x", "http://com/", "http://acom/", "http://example.com/en/1", "http://b.example.com/en/", "http://x.www.example.com/en/#a", "http://example.com/en?x", "no url", None, "://", "http://h.net/es/?q", "http://h.net", "a://b://c/d"]
    pages = spark.createDataFrame([(i % 12, u, "x", "y") for i, u in enumerate(urls)], "page_id long, url string, host string, rule string")
    got = [(r["host"], r["path"], r["rule"], r["verdict"]) for r in url_filter.filter_urls(pages.coalesce(1)).collect()]
    assert got == [
        ("a.com", "/x", "com/", "allow"), ("com", "/", "com/", "allow"), ("acom", "/", None, "allow"), ("example.com", "/en/1", "example.com/en/", "block"),
        ("b.example.com", "/en/", "example.com/en/", "block"), ("x.www.example.com", "/en/", "www.example.com/en/", "allow"), ("example.com", "/en", "com/", "allow"),
        ("", "", None, "allow"), ("", "", None, "allow"), ("", "", None, "allow"), ("h.net", "/es/", "net/es/", "block"), ("h.net", "", None, "allow"), ("b:", "//c/d", None, "allow"),
    ]
    assert url_filter.filter_urls(pages.where("false")).collect() == []


def test_url_digests_that_collide():
    rules = [(f"h{i}.org/p", "block") for i in range(50)]
    hosts, keys, lengths = url_filter.build_index(rules, digest=lambda b: len(b) % 2)
    index = url_filter.UrlIndex(hosts, keys, [r for r, _ in rules], lengths, digest=lambda b: len(b) % 2)
    assert index.decide([(f"h{i}.org", "/pq") for i in range(52)]) == [*range(50), -1, -1]


def test_warc(spark):
    rows = [(1, "http://a/\r\nX: y", "<p>é</p>", "k"), (2, None, "<p>é</p>", "k"), (3, "u", None, "k"), (4, "u", "", "k"), (None, "u", "", "k"), (5, "u", "<b>" + "z" * 200_000, "k"), (5, "u", "w", "k"), (5, "v", "w", "k"), (6, "u", "\r\n\r\n", "k")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, digest string").repartition(3)
    folder = run_folder(spark, "warc")
    index = warc.write_archives(pages, folder)
    got = warc.read_archives(index, folder)
    kinds = sorted((r["page_id"] or 0, r["payload_bytes"], r["record_type"], r["refers_to"] or 0) for r in got.collect())
    assert kinds == sorted([(1, 9, "revisit", 2), (2, 9, "response", 0), (3, 0, "revisit", 4), (4, 0, "response", 0), (0, 0, "revisit", 4), (5, 200003, "response", 0), (5, 1, "response", 0), (5, 1, "response", 0), (6, 4, "response", 0)])
    assert all(warc.b32_sha1(bytes(r["block"])) == r["payload_digest"] for r in got.where("record_type = 'response'").collect())
    assert warc.read_archives(index.where("page_id = 5"), folder).count() == 3
    empty = run_folder(spark, "warc")
    assert warc.read_archives(warc.write_archives(pages.where("false"), empty), empty).collect() == []


def test_quality(docs, none):
    got = {(r["doc_id"], r["n_words"]): r for r in quality.judge(docs).collect()}
    assert len(quality.judge(docs).collect()) == len(ROWS)
    for i, t in texts():
        words = t.encode().split()
        seen = defaultdict(list)
        for k in range(len(words) - 7):
            seen[tuple(words[k : k + 8])].append(k)
        repeated = {j for ks in seen.values() if len(ks) > 1 for k in ks for j in range(k, k + 8)}
        r = got[(i, len(words))]
        assert (r["n_repeat_words"], r["base_failed"]) == (len(repeated), len(words) < 20 or 100 * len(repeated) > 30 * len(words))
        assert r["word_chars"] == sum(len(w.decode()) for w in words) and not (r["base_failed"] and r["kept"])
    assert quality.judge(none).collect() == []


def test_quality_order_does_not_change_verdicts(docs):
    rules = quality.standard_rules()
    one, other = (docs.where(quality.cascade(r)).count() for r in (rules, rules[::-1]))
    assert one == other == quality.keep_good(docs).count()


def test_sharding(spark, docs, none):
    folder = run_folder(spark, "map")
    rows = sharding.shard_documents(docs, shards=4, map_folder=folder).collect()
    by = defaultdict(list)
    for r in rows:
        by[r["shard"]].append(r["slot"])
    assert len(rows) == len(ROWS) and all(sorted(s) == list(range(len(s))) for s in by.values())
    assert sorted((r["size"], r["text_crc32"]) for r in rows) == sorted((len(t.encode()) + 1, zlib.crc32(t.encode())) for _, t in texts())
    assert sharding.shard_documents(none).collect() == []
    again = sharding.shard_documents(docs, shards=4, map_folder=folder)
    assert {r["map_version"] for r in again.collect()} == {2}


def test_rebalance_moves_few_slots():
    sizes = [100 + i % 7 for i in range(400)]
    first = sharding.assign(sizes, 8)
    grown = sharding.rebalance(sizes, first, 9)
    held = [sum(s for s, k in zip(sizes, grown, strict=True) if k == j) for j in range(9)]
    moved = sum(a != b for a, b in zip(first, grown, strict=True))
    assert max(held) - min(held) <= 2 * max(sizes) and moved <= 400 / 9 + 8


def test_mixing(docs, none):
    rows = mixing.mix(docs).collect()
    assert len(rows) == len(ROWS) and all(r["taken"] == r["copies"] * r["size"] and 0 <= r["copies"] <= 3 for r in rows)
    assert {(r["doc_id"], r["taken"]) for r in mixing.mix(docs).collect()} == {(r["doc_id"], r["taken"]) for r in rows}
    out = mixing.mixed(docs)
    assert out.columns == docs.columns and out.count() == sum(r["copies"] for r in rows if r["copies"] > 0)
    assert mixing.mix(none).collect() == [] and mixing.mixed(none).collect() == []


def test_fingerprints(docs, none):
    rows = fingerprint.compare_with_edits(docs).collect()
    ordered = sorted(texts(), key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    want = sorted(hashlib.sha256(fingerprint.edited(t, ordered[(k + 1) % len(ordered)][1]).encode()).hexdigest() for k, (_, t) in enumerate(ordered))
    assert sorted(r["edited_sha256"] for r in rows) == want
    same = [r["fingerprint"] for r in rows if r["doc_id"] in (1, 8)]
    assert len(set(same)) == 1 and all(0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1 for r in rows)
    assert fingerprint.compare_with_edits(none).collect() == []
    one = fingerprint.compare_with_edits(docs.where("doc_id = 1")).collect()
    assert len(one) == 1 and one[0]["near_next"] == 1.0


def test_peeling_finds_the_difference():
    import numpy as np

    rng = np.random.default_rng(2)
    left, right = [], []
    for n in (0, 1, 5, 40, 900):
        both, a, b = (rng.integers(1, 1 << 62, n, dtype=np.uint64) for _ in range(3))
        left.append(np.concatenate([both, a]))
        right.append(np.concatenate([both, b[: n // 2]]))
    for (x, y), a, b in zip(fingerprint.differing(left, right), left, right, strict=True):
        assert set(x.tolist()) == set(a.tolist()) - set(b.tolist()) and set(y.tolist()) == set(b.tolist()) - set(a.tolist())


def test_suffixes(spark, docs, none):
    rows = suffix_dedup.remove_repeats(docs.select("doc_id", "text"), as_text=False).collect()
    first = {}
    data = [(-1 if i is None else i, t.encode()) for i, t in texts()]
    for i, t in data:
        for k in range(len(t) - 49):
            s = t[k : k + 50]
            first[s] = min(first.get(s, i), i)
    want = []
    for i, t in data:
        gone = bytearray(len(t))
        for k in range(len(t) - 49):
            if first[t[k : k + 50]] < i:
                gone[k : k + 50] = b"\1" * 50
        want.append((len(t), sum(gone), len([x for x in bytes(gone).split(b"\0") if x]), bytes(c for c, g in zip(t, gone, strict=True) if not g)))
    assert sorted((r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["text"])) for r in rows) == sorted(want)
    assert suffix_dedup.remove_repeats(none).collect() == []


def test_levels_are_geometric():
    import numpy as np

    family, seen = suffix_dedup.Family(), {}
    rng = np.random.default_rng(3)
    for batch in range(40):
        keys = np.unique(rng.integers(0, 5000, 200, dtype=np.uint64))
        assert family.scan(keys, batch).tolist() == [seen.get(k, -1) for k in keys.tolist()]
        for k in keys.tolist():
            seen.setdefault(k, batch)
    sizes = [len(k) for k, _ in family.levels]
    assert all(a >= 2 * b for a, b in zip(sizes, sizes[1:]))


def test_join(docs, none):
    rows = ngram_join.jaccard_components(docs, 3, 90, 100).collect()
    assert len(rows) == len(ROWS)
    by = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in rows}
    assert by[8][1] == 1 and by[3] == (0, 3) and by[4] == (0, 4) and by[5] == (0, 5) and by[9] == (1, 9) and by[None][1] is None
    assert ngram_join.jaccard_components(none).collect() == []


@pytest.mark.parametrize("words, num", [(3, 90), (5, 80)])
def test_join_against_all_pairs(spark, words, num, monkeypatch):
    import random

    monkeypatch.setattr(ngram_join, "BLOCK_TOKENS", 2_000)  # blocks are cut into pieces
    rng = random.Random(words)
    base = [f"w{i}" for i in range(60)]
    docs = []
    for i in range(150):
        t = [rng.choice(base) for _ in range(rng.randint(1, 60))] if i < 60 or i % 3 == 0 else docs[rng.randrange(i)][1].split()
        if i >= 60:
            t = t[: rng.choice([len(t), len(t), max(1, len(t) - 2)])]
            t[rng.randrange(len(t))] = rng.choice(base)
        docs.append((i, " ".join(t)))
    sets = {i: ngram_join.shingle_set(t, words, {}) for i, t in docs}
    root = {i: i for i, _ in docs}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, _ in docs:
        for j in range(i):
            k = len(set(sets[i].tolist()) & set(sets[j].tolist()))
            if 100 * k >= num * (len(sets[i]) + len(sets[j]) - k):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    got = ngram_join.jaccard_components(spark.createDataFrame(docs, "doc_id long, text string"), words, num, 100)
    assert {r["doc_id"]: r["component_id"] for r in got.collect()} == {i: find(i) for i, _ in docs}


def test_queries_on_given_tables_match_sql(spark, sf):
    from tests.compare import connect, differences
    from vecspark.llm.queries import ORACLES, QUERIES

    con = connect(sf)
    for name, sql in ORACLES.items():
        assert differences(QUERIES[name](spark, sf).toPandas(), con.execute(sql).fetchdf()) == [], name
