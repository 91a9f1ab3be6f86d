"""The manifest against plain Python, on nulls, repeats, lone leaves and clashing columns."""

from __future__ import annotations

import hashlib
import zlib
from collections import defaultdict

import pytest

from vecspark.llm import merkle

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, tree long, pos long, digest string, path string, level int"


def sha(s: str) -> str:
    return hashlib.sha256(s.encode()).hexdigest()


def plain(rows: list[tuple]) -> list[tuple]:
    """(doc_id, leaf, subroot, root, proof, folded, verified) by the book."""

    def leaf(i, t, lang, source, n):
        return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (i, source, lang, n, t)))

    def tree(level: list[str]) -> tuple[str, list[list[str]]]:
        levels = [level]
        while len(level) > 1:
            level = [sha("".join(level[k : k + 16])) for k in range(0, len(level), 16)]
            levels.append(level)
        return level[0], levels

    def walk(levels: list[list[str]], pos: int, node: str) -> tuple[str, str]:
        proof = ""
        for level in levels[:-1]:
            run = level[pos - pos % 16 : pos - pos % 16 + 16]
            left, right = "".join(run[: pos % 16]), "".join(run[pos % 16 + 1 :])
            node, proof, pos = sha(left + node + right), proof + left + right, pos // 16
        return node, proof

    groups = defaultdict(list)
    for i, t, lang, source, n in rows:
        low = t.translate({c: c + 32 for c in range(65, 91)}) if t is not None and i is not None and zlib.crc32(str(i).encode()) % 5 == 0 else t
        groups[source].append(((i is not None, i or 0), leaf(i, t, lang, source, n), leaf(i, low, lang, source, n), i))
    sources = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = []
    for s in sources:
        groups[s].sort(key=lambda g: g[:2])
        trees.append(tree([g[1] for g in groups[s]]))
    if not trees:
        return []
    root, tops = tree([t for t, _ in trees])
    out = []
    for k, s in enumerate(sources):
        for pos, (_, one, now, i) in enumerate(groups[s]):
            node, proof = walk(trees[k][1], pos, now)
            node, more = walk(tops, k, node)
            out.append((i, one, trees[k][0], root, sha(proof + more), node, node == root))
    return out


def ordered(rows):
    return sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, *map(str, r[1:])))


ROWS = [
    (1, "Some Text", "en", "b", 9), (2, "Ünïcödé ABC", "de", "", 4), (3, None, None, None, None), (4, "", "en", "\U0001f600", 0), (None, "NO ID", "en", "b", 1), (None, "NO ID", "en", "b", 1),
    (5, "Same", "en", "b", 1), (5, "Same", "en", "b", 1), (5, "OTHER", "en", "b", 1), (6, "X" * 400_000, "en", "￿", 1), (7, " \n", None, "b", None), (-1, "Minus", "en", "b", 2),
]


@pytest.mark.parametrize("n", [0, 12, 400])
def test_audit(spark, n):
    rows = ROWS[:n] + [(100 + 7 * i, f"Text {i % 90} OF many", "en", "many" if i % 20 else f"s{i}", i) for i in range(n - 12)]
    docs = spark.createDataFrame([r + (1, 2, "d", "p", 3) for r in rows], SCHEMA).repartition(3)
    got = [tuple(r) for r in merkle.audit(docs).collect()]
    assert ordered(got) == ordered(plain(rows))


def test_only_every_second_level_is_stored(spark):
    docs = spark.createDataFrame([(i, f"t{i}", "en", "a", 1) for i in range(4200)], "doc_id long, text string, lang string, source string, n_chars long")
    made = merkle.manifest(docs)
    assert [t.count() for t in made.levels] == [4200, 17, 1]  # not the 263 and 2 nodes between them
    assert made.trees.select("height").first()[0] == 4
    want = plain([(i, f"t{i}", "en", "a", 1) for i in range(4200)])
    assert made.root == want[0][3]
    got = made.proofs().select("id", merkle.proof_digest(merkle.F.col("path")).alias("p")).collect()
    assert sorted(map(tuple, got)) == sorted((r[0], r[4]) for r in want)
