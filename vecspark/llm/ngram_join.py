"""Similarity join of shingle sets: exact blocks over the cluster, signature trees within them.

Two sets of a Jaccard similarity of at least t differ in few tokens. Cut the space of token
hashes into some parts more than that, and at least as many parts of both sets are equal. So
sets that can be linked meet under several equal parts. A set that shares too few parts with
all others goes, the others keep the rarest of their shared parts, as many as are sure to
have one in common with a linked set. Sets that still meet, directly or over others, form a
block; blocks are small and hold near copies almost alone. In a block a signature tree is built: a node has the OR of its sets' token bitmaps and the range of their
sizes. Two nodes are looked into only if the tokens their bitmaps share could be enough for
their sizes; leaves are compared token by token.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vecspark.llm.common import components, fresh, keys_join, mix64, planes, row_batches, tasks_for, unplanes, written
from vecspark.llm.register import query

BITS = 4096  # of a token bitmap
LEAF = 32  # sets of a leaf
FANOUT = 8
BLOCK_TOKENS = 16_000_000  # a block of more tokens is cut by sizes, and a level of sizes of more tokens into slices
KEY_ROWS = 2_000_000  # keys that one task brings together
CHUNK_KEYS = 500_000  # keys a task sorts before it hands them on

U = np.uint64
C1, C2, C3 = U(0x9E3779B97F4A7C15), U(0xC2B2AE3D27D4EB4F), U(0x165667B19E3779F9)


# ---- sets ----


def word_hashes(words: list[bytes], memory: dict[bytes, int]) -> np.ndarray:
    """A 64-bit hash per word."""
    import xxhash

    out = []
    for w in words:
        h = memory.get(w)
        if h is None:
            h = xxhash.xxh3_64_intdigest(w)
            if len(memory) < 200_000:
                memory[w] = h
        out.append(h)
    return np.array(out, dtype=np.uint64)


def shingle_set(text: str | None, n: int, memory: dict[bytes, int]) -> np.ndarray:
    """Sorted distinct hashes of the n-word shingles, words in ASCII lower case; fewer words make one shingle."""
    words = (text or "").encode().lower().split()  # bytes part at 0x20 and 0x09 to 0x0D
    if not words:
        return np.zeros(0, dtype=np.uint64)
    h = word_hashes(words, memory)
    m = max(1, len(words) - n + 1)
    out = np.full(m, min(len(words), n), dtype=np.uint64)
    for k in range(min(len(words), n)):
        out = mix64(out * C1 + h[k : k + m])
    return np.unique(out)


def set_digest(tokens: np.ndarray) -> bytes:
    return blake2b(tokens.tobytes(), digest_size=16).digest()


def linked(inter: int, a: int, b: int, num: int, den: int) -> bool:
    return den * inter >= num * (a + b - inter)


# ---- keys under which sets meet ----


def bands(num: int, den: int, upto: int) -> list[int]:
    """First sizes of the bands: a set of one band is only linked within it and with the next."""
    out = [1]
    while out[-1] <= upto:
        out.append(out[-1] * den // num + 1)
    return out


def differing(band: int, firsts: list[int], num: int, den: int) -> int:
    """How many tokens linked sets can differ in, the smaller one in this band.

    Sets of sizes a <= b with a Jaccard of num / den have b <= a * den / num and share at least
    num * (a + b) / (num + den); what they don't share is at most a * (den - num) / num.
    """
    return (firsts[band + 1] - 1) * (den - num) // num


def meeting_keys(tokens: np.ndarray, firsts: list[int], num: int, den: int) -> list[tuple[np.ndarray, int]]:
    """The keys of one set's parts, as the smaller and as the larger one of a pair, and how many of them a linked set has as well at least.

    A part is a range of token hashes, its key the mixed sum of the tokens in it. Parts that
    are empty say nothing and have no key: there are some parts more than tokens to differ
    in, so that linked sets have an equal part besides, unless both have more empty ones
    than that. Only such sets, which are rare, have keys for their empty parts as well.
    """
    n = len(tokens)
    own = int(np.searchsorted(firsts, n, side="right")) - 1
    sums = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum(mix64(tokens), out=sums[1:])
    out = []
    for band in (own, own - 1):
        if band < 0:
            out.append((np.zeros(0, dtype=np.uint64), 1))
            continue
        apart = differing(band, firsts, num, den)
        m = apart + 1 + (apart > 0) + apart // 4
        edges = (np.arange(1, m, dtype=np.float64) * (2.0**64 / m)).astype(np.uint64)
        cuts = np.concatenate(([0], np.searchsorted(tokens, edges), [n]))
        part, held = sums[cuts[1:]] - sums[cuts[:-1]], cuts[1:] - cuts[:-1]
        keys = mix64(part * C2 + mix64(np.arange(m, dtype=np.uint64) * C3 + U(band)) + held.astype(np.uint64))
        empty = int((held == 0).sum())
        out.append((keys[held > 0], m - apart - empty) if empty < m - apart else (keys, 1))
    return out


def changed(*columns: np.ndarray) -> np.ndarray:
    """Where a row of ordered columns differs from the row before."""
    first = np.ones(len(columns[0]), dtype=bool)
    first[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in columns])
    return first


def dealt(place: np.ndarray, buckets: int, *columns: np.ndarray) -> Iterator[tuple]:
    """(bucket, columns as byte planes) of the rows, by the range their place is in; they are ordered by place."""
    bucket = ((place >> U(32)) * U(buckets) >> U(32)).astype(np.int64)
    cuts = np.searchsorted(bucket, np.arange(buckets + 1))
    for i, (s, e) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
        if e > s:
            yield i, *(planes(np.ascontiguousarray(c[s:e]).view(np.uint64)) for c in columns)


def gathered(batches: Iterator[pa.RecordBatch], columns: int) -> list[np.ndarray]:
    """The columns of all rows that ``dealt`` brought together."""
    parts = [[np.zeros(0, np.uint64)] for _ in range(columns)]
    for b in batches:
        for own, c in zip(parts, b.columns[1:], strict=True):
            own += [unplanes(x.as_py()) for x in c]
    return [np.concatenate(own) for own in parts]


def shared_keys(key: np.ndarray, owner: np.ndarray, code: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The rows of keys that several owners have, each owner once, with their number."""
    order = np.lexsort((owner, key))
    key, owner, code = key[order], owner[order], code[order]
    once = changed(key, owner)
    key, owner, code = key[once], owner[once], code[once]
    first = changed(key)
    size = np.diff(np.append(np.flatnonzero(first), len(key))).astype(np.uint64)[np.cumsum(first) - 1]
    several = size > 1
    return key[several], owner[several], code[several], size[several]


def rarest_keys(key: np.ndarray, owner: np.ndarray, code: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each owner's shared keys the rarest, all but one less than a linked set has in common with it.

    The order by number of owners, then key, is the same for all owners. The first key that two
    linked sets share in it has as many shared ones after it, so both of them keep it. An owner
    with fewer shared keys than a linked set has in common with it is linked with none.
    """
    order = np.lexsort((key, size, code, owner))
    key, owner, code = key[order], owner[order], code[order]
    starts = np.flatnonzero(changed(owner, code))
    held = np.diff(np.append(starts, len(key)))
    place = np.arange(len(key)) - np.repeat(starts, held)
    keep = place + (code >> U(1)).astype(np.int64) <= np.repeat(held, held)
    return key[keep], owner[keep]


def profiles(docs: DataFrame, words: int, doc_id: str, text: str) -> DataFrame:
    """(doc_id, n, digest): size and digest of every document's set."""

    def profile(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memory: dict[bytes, int] = {}
        for b in row_batches(batches, 1):
            sets = [shingle_set(t, words, memory) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array([set_digest(s) for s in sets], pa.binary())], ["doc_id", "n", "digest"])

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(profile, "doc_id long, n long, digest binary")


def candidate_edges(docs: DataFrame, sizes: tuple[int, int, int], words: int, num: int, den: int, doc_id: str, text: str) -> DataFrame:
    """Edges (a, b) between documents that meet under a key; each task and each key make a star, never all pairs.

    Keys come together by the range of their values; those that several documents have go to
    the documents, by the range of the mixed id. What a document keeps of them comes together by
    key again. There a task hands on each key once, with the least id it has there, so that a key
    of very many documents is small after the shuffle.
    """
    largest, total, _ = sizes
    firsts = bands(num, den, largest + 1)
    # A set of n tokens has about 2 * (n * (den - num) / num * 5 / 4 + 1) keys.
    buckets = tasks_for(docs.sparkSession, 2.5 * total * (den - num) / num, KEY_ROWS)

    def batched(rows: Iterable[tuple], names: list[str]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int32(), *[pa.bool_() if n == "star" else pa.binary() for n in names[1:]]]
        made = lambda own: pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*own, strict=True), kinds, strict=True)], names)
        own, count = [], 0
        for r in rows:
            own.append(r)
            count += len(r[1]) // 8
            if count >= CHUNK_KEYS:
                yield made(own)
                own, count = [], 0
        if own:
            yield made(own)

    def packed(key: np.ndarray, owner: np.ndarray, code: np.ndarray) -> Iterator[pa.RecordBatch]:
        order = np.argsort(key)
        key = key[order]
        yield from batched(dealt(key, buckets, key, owner[order], code[order]), ["bucket", "keys", "owners", "codes"])

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memory: dict[bytes, int] = {}
        held, owners, codes, count = [], [], [], 0
        for b in row_batches(batches, 1):
            for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                s = shingle_set(t, words, memory)
                if not len(s):
                    continue
                for role, (k, common) in enumerate(meeting_keys(s, firsts, num, den)):
                    held.append(k)
                    owners.append(np.full(len(k), i, dtype=np.int64))
                    codes.append(np.full(len(k), 2 * common + role, dtype=np.uint64))
                    count += len(k)
                if count >= CHUNK_KEYS:
                    yield from packed(np.concatenate(held), np.concatenate(owners), np.concatenate(codes))
                    held, owners, codes, count = [], [], [], 0
        if held:
            yield from packed(np.concatenate(held), np.concatenate(owners), np.concatenate(codes))

    def share(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, owner, code, size = shared_keys(*gathered(batches, 3))
        place = mix64(owner)
        order = np.argsort(place)
        yield from batched(dealt(place[order], buckets, key[order], owner[order], code[order], size[order]), ["bucket", "keys", "owners", "codes", "sizes"])

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, owner = rarest_keys(*gathered(batches, 4))
        owner = owner.view(np.int64)
        order = np.lexsort((owner, key))
        key, owner = key[order], owner[order]
        first = changed(key)
        least = owner[np.maximum.accumulate(np.where(first, np.arange(len(key)), 0))] if len(key) else owner
        star = np.unique(np.stack([least[~first], owner[~first]], axis=1), axis=0)
        star = star[star[:, 0] != star[:, 1]]
        rows = [(*r, False) for r in dealt(key[first], buckets, key[first], owner[first])]
        if len(star):
            rows.append((int(star[0, 0] % buckets), planes(np.ascontiguousarray(star[:, 0]).view(np.uint64)), planes(np.ascontiguousarray(star[:, 1]).view(np.uint64)), True))
        yield from batched(rows, ["bucket", "keys", "owners", "star"])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, owner = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
        edges = [np.zeros((0, 2), np.int64)]
        for b in batches:
            for k, o, star in zip(b.column(1), b.column(2), b.column(3).to_pylist(), strict=True):
                x, y = unplanes(k.as_py()), unplanes(o.as_py()).view(np.int64)
                if star:
                    edges.append(np.stack([x.view(np.int64), y], axis=1))
                else:
                    key.append(x)
                    owner.append(y)
        k, o = np.concatenate(key), np.concatenate(owner)
        order = np.lexsort((o, k))
        k, o = k[order], o[order]
        first = changed(k)
        least = o[np.maximum.accumulate(np.where(first, np.arange(len(k)), 0))] if len(k) else o
        edges.append(np.stack([least[~first], o[~first]], axis=1))
        e = np.unique(np.concatenate(edges), axis=0)
        e = e[e[:, 0] != e[:, 1]]
        yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(e[:, 0])), pa.array(np.ascontiguousarray(e[:, 1]))], ["a", "b"])

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).where("doc_id IS NOT NULL")
    rows = rows.mapInArrow(keys, "bucket int, keys binary, owners binary, codes binary")
    rows = rows.repartition(buckets, "bucket").mapInArrow(share, "bucket int, keys binary, owners binary, codes binary, sizes binary")
    rows = rows.repartition(buckets, "bucket").mapInArrow(pick, "bucket int, keys binary, owners binary, star boolean")
    return rows.repartition(buckets, "bucket").mapInArrow(meet, "a long, b long")


# ---- signature trees ----


class Node:
    """Children, or sets by number in a leaf; OR of their bitmaps, range of their sizes, most tokens lost to shared bits.

    A leaf has the bitmaps, sizes and losses of its sets besides, one row each.
    """

    __slots__ = ("children", "sets", "bits", "least", "most", "lost", "maps", "sizes", "losses")

    def __init__(self, children, sets, bits, least, most, lost, maps=None, sizes=None, losses=None):
        self.children, self.sets, self.bits, self.least, self.most, self.lost = children, sets, bits, least, most, lost
        self.maps, self.sizes, self.losses = maps, sizes, losses


def bitmap(tokens: np.ndarray) -> np.ndarray:
    out = np.zeros(BITS, dtype=bool)
    out[(tokens & U(BITS - 1)).astype(np.int64)] = True
    return np.packbits(out).view(np.uint64)


def build_tree(sets: list[np.ndarray]) -> Node:
    """Sets ordered by size, in steps of a tenth, and least token: leaves are of like sizes, near copies stand side by side."""
    sizes = np.array([len(s) for s in sets], dtype=np.int64)
    step = (np.log(sizes) / np.log(1.1)).astype(np.int64)
    order = np.lexsort((sizes, np.array([s[0] for s in sets], dtype=np.uint64), step))
    level = []
    for s in range(0, len(order), LEAF):
        own = order[s : s + LEAF]
        maps = np.stack([bitmap(sets[i]) for i in own])
        losses = sizes[own] - np.bitwise_count(maps).sum(axis=1)
        level.append(Node(None, own, np.bitwise_or.reduce(maps), int(sizes[own].min()), int(sizes[own].max()), int(losses.max()), maps, sizes[own], losses))
    while len(level) > 1:
        level = [
            Node(own, None, np.bitwise_or.reduce([c.bits for c in own]), min(c.least for c in own), max(c.most for c in own), max(c.lost for c in own))
            for own in (level[s : s + FANOUT] for s in range(0, len(level), FANOUT))
        ]
    return level[0]


def pairs_in_reach(x: Node, y: Node, num: int, den: int) -> np.ndarray:
    """Of two leaves the pairs of sets that can be linked, by the same bound as for nodes."""
    a, b = x.sizes[:, None], y.sizes[None, :]
    shared = np.bitwise_count(x.maps[:, None, :] & y.maps[None, :, :]).sum(axis=2, dtype=np.int64) + np.minimum(x.losses[:, None], y.losses[None, :])
    return (den * np.minimum(a, b) >= num * np.maximum(a, b)) & (shared * (num + den) >= num * (a + b))


def within_reach(x: Node, y: Node, num: int, den: int) -> bool:
    """Whether a set below x and one below y can be linked at all.

    They must be of like sizes, and they can't share more tokens than the nodes share bits, plus
    the tokens that fell on bits already set.
    """
    if den * min(x.most, y.most) < num * max(x.least, y.least):
        return False
    shared = int(np.bitwise_count(x.bits & y.bits).sum()) + min(x.lost, y.lost)
    return shared * (num + den) >= num * (x.least + y.least)


class Union:
    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = self.up[i]
        return i

    def join(self, i: int, j: int) -> bool:
        i, j = self.root(i), self.root(j)
        self.up[max(i, j)] = min(i, j)
        return i != j


def tree_links(left: list[np.ndarray], right: list[np.ndarray] | None, num: int, den: int, every: bool = False) -> list[tuple[int, int]]:
    """Links between sets of the left and of the right, or among the left ones, by a traversal of both trees.

    By default just as many links as connect what is linked: sets that are connected already
    are not compared again. With ``every`` all links.
    """
    a = build_tree(left)
    b = a if right is None else build_tree(right)
    others = left if right is None else right
    shift = 0 if right is None else len(left)
    union, out = Union(len(left) + (0 if right is None else len(right))), []
    stack = [(a, b)]
    while stack:
        x, y = stack.pop()
        if not within_reach(x, y, num, den):
            continue
        if x.children is None and y.children is None:
            near = pairs_in_reach(x, y, num, den)
            if x is y:
                near = np.triu(near, 1)
            if not every:
                up = [np.array([union.root(int(i) + k) for i in n.sets]) for n, k in ((x, 0), (y, shift))]
                near &= up[0][:, None] != up[1][None, :]
            for p, q in np.argwhere(near).tolist():
                i, j = int(x.sets[p]), int(y.sets[q])
                s, t = left[i], others[j]
                if (every or union.root(i) != union.root(j + shift)) and linked(len(np.intersect1d(s, t, assume_unique=True)), len(s), len(t), num, den):
                    union.join(i, j + shift)
                    out.append((i, j))
        elif x is y:
            own = x.children
            stack += [(own[i], own[j]) for i in range(len(own)) for j in range(i, len(own))]
        elif y.children is None or (x.children is not None and len(x.children) >= len(y.children)):
            stack += [(c, y) for c in x.children]
        else:
            stack += [(x, c) for c in y.children]
    return out


# ---- the join ----


def links(docs: DataFrame, words: int, num: int, den: int, every: bool = False, doc_id: str = "doc_id", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """Profiles of all documents (doc_id, n, digest, first) and links (a, b) between the firsts of unequal sets.

    ``first`` is the least id with an equal set. The links connect whatever is linked; with
    ``every`` they are all links, as many as there are.
    """
    rows = written(profiles(docs, words, doc_id, text), "shingle-profiles")
    sizes = rows.agg(F.max("n"), F.sum("n"), F.count(F.lit(1))).first()
    equal = rows.where("n > 0 AND doc_id IS NOT NULL").groupBy("digest").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("copies"))
    # Only digests of several rows are joined; adaptive execution splits one that very many rows have.
    repeated = written(equal.where("copies > 1").select("digest", "first"), "shingle-copies")
    rows = rows.join(repeated, "digest", "left").withColumn("first", F.when(F.col("doc_id").isNotNull(), F.coalesce("first", "doc_id")))
    rows = written(rows.select("doc_id", "n", "digest", "first"), "shingle-firsts")
    # Documents of equal sets are one node, that of the least id, and only that has keys.
    copies = rows.where("doc_id <> first").select("doc_id").distinct()
    alone = keys_join(docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")), copies, "doc_id", "left_anti", 16)
    edges = written(candidate_edges(alone, (sizes[0] or 0, sizes[1] or 0, sizes[2]), words, num, den, "doc_id", "text").distinct(), "meeting")
    spark = docs.sparkSession
    if edges.isEmpty():
        return rows, spark.createDataFrame([], "a long, b long")
    # What meets, directly or over others, is a block.
    blocks = components(edges, "blocks")
    held = written(blocks.join(rows.where("doc_id = first").select("first", "n").distinct(), blocks["node"] == F.col("first")).select(F.col("node").alias("doc_id"), F.col("root").alias("block"), "n"), "block-members")
    if held.isEmpty():
        return rows, spark.createDataFrame([], "a long, b long")
    # A block of many tokens is cut by levels of sizes: linked sets are of one level or of two
    # side by side. A level of many tokens is cut into slices. Each group compares a slice with
    # itself and a slice of the next level, or two slices of a level.
    per = held.groupBy("block").agg(F.sum("n").alias("tokens"))
    group = [F.lit(0).alias(c) for c in ("level", "first_slice", "second_slice", "kind", "side")]
    small = held.join(per.where(F.col("tokens") <= BLOCK_TOKENS).select("block"), "block").select("doc_id", "block", *group)
    cut = held.join(per.where(F.col("tokens") > BLOCK_TOKENS).select("block"), "block")
    cut = cut.withColumn("level", F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(den / num))).cast("int"))
    sliced = cut.groupBy("block", "level").agg(F.ceil(F.sum("n") / BLOCK_TOKENS).cast("int").alias("slices"))
    sliced = sliced.groupBy("block").agg(F.map_from_entries(F.collect_list(F.struct("level", "slices"))).alias("slices"))  # a few dozen levels
    cut = cut.join(sliced, "block")
    count = {d: F.coalesce(F.try_element_at("slices", F.col("level") + d), F.lit(0)) for d in (-1, 0, 1)}
    cut = cut.withColumn("slice", F.pmod(F.xxhash64("doc_id"), count[0]).cast("int"))

    def meets(n: Column, level: Column, first, second, kind: int, side) -> Column:
        """Groups of this row with each of n slices."""
        every = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
        made = lambda j: F.struct(level.alias("level"), first(j).alias("first_slice"), second(j).alias("second_slice"), F.lit(kind).alias("kind"), side(j).alias("side"))
        return F.transform(every, made)

    own, level = F.col("slice"), F.col("level")
    with_next = meets(F.greatest(count[1], F.lit(1)), level, lambda j: own, lambda j: j, 0, lambda j: F.lit(0))
    with_last = meets(count[-1], level - 1, lambda j: j, lambda j: own, 0, lambda j: F.lit(1))
    beside = meets(count[0], level, lambda j: F.least(own, j), lambda j: F.greatest(own, j), 1, lambda j: (own > j).cast("int"))
    beside = F.filter(beside, lambda g: g["first_slice"] != g["second_slice"])
    cut = cut.select("doc_id", "block", F.explode(F.concat(with_next, with_last, beside)).alias("g")).select("doc_id", "block", "g.*")
    members = written(small.unionByName(cut), "block-pairs")
    texts = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).where("doc_id IS NOT NULL")
    ids = members.select("doc_id").distinct()
    texts = keys_join(texts, ids, "doc_id", "left_semi", 16)

    def token_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memory: dict[bytes, int] = {}
        for b in row_batches(batches, 1):
            sets = [shingle_set(t, words, memory) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([s.tobytes() for s in sets], pa.binary())], ["doc_id", "tokens"])

    sets = texts.mapInArrow(token_sets, "doc_id long, tokens binary")
    if not rows.where("doc_id IS NOT NULL").groupBy("doc_id").count().where("count > 1").isEmpty():
        sets = sets.groupBy("doc_id").agg(F.min("tokens").alias("tokens"))

    def compare(table: pa.Table) -> pa.Table:
        ids, sides = table["doc_id"].to_pylist(), table["side"].to_pylist()
        tokens = [np.frombuffer(t, dtype=np.uint64) for t in table["tokens"].to_pylist()]
        at = sorted(range(len(ids)), key=lambda i: ids[i])
        left, right = ([i for i in at if sides[i] == side] for side in (0, 1))
        within = table["kind"][0].as_py() == 0 and table["second_slice"][0].as_py() == 0
        found = []
        for others in ([None] if within else []) + ([right] if right else []):
            if left:
                pairs = tree_links([tokens[i] for i in left], None if others is None else [tokens[i] for i in others], num, den, every)
                found += [(ids[left[i]], ids[(others or left)[j]]) for i, j in pairs]
        found = sorted((min(x), max(x)) for x in found)
        return pa.table({"a": pa.array([a for a, _ in found], pa.int64()), "b": pa.array([b for _, b in found], pa.int64())})

    grouped = keys_join(sets, members, "doc_id", "inner", 48).groupBy("block", "level", "first_slice", "second_slice", "kind")
    return rows, written(grouped.applyInArrow(compare, "a long, b long"), "links")


def own_nodes(docs: DataFrame, words: int, doc_id: str, text: str) -> Column:
    """A number for each row to be told apart by: its id, unless ids repeat with different sets.

    Then it is a hash of id and text. That no two different sets of an id or ids share one is
    checked, and another seed is taken if they do.
    """
    id = F.col(doc_id).cast("long")
    if docs.where(id.isNotNull()).groupBy(id.alias("i")).agg(F.count(F.lit(1)).alias("n")).where("n > 1").isEmpty():
        return id
    rows = docs.select(id.alias("doc_id"), F.col(text).alias("text")).where("doc_id IS NOT NULL")
    sets = written(profiles(rows, words, "doc_id", "text").select("doc_id", "digest").distinct(), "shingle-ids")
    if sets.groupBy("doc_id").count().where("count > 1").isEmpty():
        return id
    seed = 0
    while True:
        node = F.when(id.isNotNull(), F.xxhash64(F.lit(seed), id, F.col(text)))
        # Equal texts of an id are one row here, so a number that several rows have is that of different texts.
        several = docs.select(node.alias("node"), id.alias("doc_id"), F.sha2(F.coalesce(F.col(text), F.lit("")), 256).alias("text")).where("doc_id IS NOT NULL")
        if several.distinct().groupBy("node").count().where("count > 1").isEmpty():
            return node
        seed += 1


def grouped(docs: DataFrame, words: int, num: int, den: int, doc_id: str, text: str, node: Column) -> DataFrame:
    """(node, doc_id, n, component_id, stands) of every row; ``stands``: it has its component's least id, and the least node with it."""
    rows = docs.select(node.alias("node"), F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    named = written(rows.select("node", "doc_id").where("node IS NOT NULL").distinct(), "shingle-nodes")
    sets, edges = links(rows, words, num, den, doc_id="node", text="text")
    found = components(edges, "linked").select(F.col("node").alias("first"), F.col("root"))
    sets = sets.withColumnRenamed("doc_id", "node").join(found, "first", "left").withColumn("root", F.coalesce("root", "first")).join(named, "node", "left")
    sets = written(sets.select("node", "doc_id", "n", "root"), "shingle-roots")
    # Of each component the least id: taken in each task first, so that a large component is small after the shuffle.
    least = sets.where("root IS NOT NULL").groupBy("root").agg(F.min(F.struct("doc_id", "node")).alias("least"))
    alone = F.when(F.col("n") == 0, F.col("doc_id"))  # without a set
    out = sets.join(least, "root", "left")
    return out.select("node", "doc_id", "n", F.coalesce(alone, "least.doc_id").alias("component_id"), (alone.isNotNull() | (F.col("least.node") == F.col("node")) | F.col("node").isNull()).alias("stands"))


def jaccard_components(docs: DataFrame, words: int = 5, num: int = 80, den: int = 100, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row: what links of num / den or more connect.

    A document's set holds its distinct word shingles; with fewer words, the whole sequence. NULL,
    empty and blank texts have no set and are linked with nothing. A row without id is
    linked with nothing and has no component. Rows that repeat an id with different texts are
    documents of their own: each is in the component of its own set, which is named by the least
    id in it.
    """
    node = own_nodes(docs, words, doc_id, text)
    rows = grouped(docs, words, num, den, doc_id, text, node)
    return rows.select("doc_id", F.col("n").alias("n_shingles"), "component_id")


def one_of_each(docs: DataFrame, words: int = 5, num: int = 80, den: int = 100, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of the documents that no smaller id stands for, with their columns.

    Of rows that repeat id and text one stays. Rows that repeat an id with texts that are not
    linked all stay. Rows without id stay.
    """
    node = own_nodes(docs, words, doc_id, text)
    found = written(grouped(docs, words, num, den, doc_id, text, node), "near-copies")
    gone, own = fresh(docs, "gone_node"), fresh(docs, "own_node")
    ids = found.where("NOT stands").select(F.col("node").alias(gone)).distinct()
    if ids.count() * 16 <= 64 << 20:
        ids = F.broadcast(ids)
    kept = docs.withColumn(own, node)
    kept = kept.join(ids, kept[own] == ids[gone], "left_anti")
    if not found.where("node IS NOT NULL").groupBy("node").count().where("count > 1").isEmpty():
        kept = kept.where(F.col(own).isNull()).unionByName(kept.where(F.col(own).isNotNull()).dropDuplicates([own]))
    return kept.select(*docs.columns)


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, with its columns: five words, a similarity of 0.8."""
    return one_of_each(docs)


SQL = r"""
WITH RECURSIVE words AS (
    SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), shingles AS (
    SELECT DISTINCT doc_id, array_to_string(w[i:i + 2], ' ') AS s
    FROM (SELECT doc_id, w, unnest(generate_series(1, greatest(1, len(w) - 2))) AS i FROM words WHERE len(w) > 0)
), sizes AS (
    SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id
), pairs AS (
    SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k
    FROM shingles a JOIN sizes x ON a.doc_id = x.doc_id JOIN shingles b ON a.s = b.s AND a.doc_id < b.doc_id
    JOIN sizes y ON b.doc_id = y.doc_id AND 100 * least(x.n, y.n) >= 90 * greatest(x.n, y.n)
    GROUP BY a.doc_id, b.doc_id
), edges AS (
    SELECT a, b FROM pairs JOIN sizes x ON a = x.doc_id JOIN sizes y ON b = y.doc_id WHERE 100 * k >= 90 * (x.n + y.n - k)
), sides AS (
    SELECT a, b FROM edges UNION ALL SELECT b, a FROM edges
), reach AS (
    SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT reach.a, sides.b FROM reach JOIN sides ON reach.b = sides.a
)
SELECT d.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, least_id AS component_id
FROM documents d LEFT JOIN sizes USING (doc_id) LEFT JOIN (SELECT a AS doc_id, min(b) AS least_id FROM reach GROUP BY a) USING (doc_id)
"""


@query("op10_ngram_jaccard_join", SQL)
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(spark.read.parquet(f"{sf_dir}/documents.parquet"), words=3, num=90, den=100)
