"""URL rules by sorted digest arrays: 64-bit xxhash keys in memory-mapped files, probed by binary search.

The index is two sorted arrays of digests, one of the hosts that rules name and one of whole
rules, with the full strings beside them. A probe finds a digest by binary search over all
candidates of a batch at once; a hit counts only if the stored string equals the candidate,
so two strings of one digest do no harm. Spark hands the files to every executor
(``addFile``), where all its workers map the same pages.
"""

from __future__ import annotations

import os
from collections.abc import Iterable, Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vecspark.llm.register import query
from vecspark.session import shared_root

ALLOW, BLOCK = "allow", "block"
MAX_INDEX = 1 << 30  # bytes; a list of rules is configuration and does not grow with the pages

# A rule is a host, followed by the beginning of a path.
RULES = (
    ("com/", ALLOW),
    ("example.com/en/", BLOCK),
    ("www.example.com/en/", ALLOW),
    ("net/es/", BLOCK),
    ("net/fr/", BLOCK),
)


def digest_array(strings: Iterable[str], digest=xxhash.xxh64_intdigest) -> tuple[np.ndarray, np.ndarray, bytes, np.ndarray]:
    """Sorted digests, the ends of their strings, the strings, and the order they were given in."""
    given = [s.encode() for s in strings]
    keys = np.array([digest(s) for s in given], dtype="<u8")
    order = np.argsort(keys, kind="stable")
    ends = np.cumsum([0, *(len(given[i]) for i in order)]).astype("<i8")
    return keys[order], ends, b"".join(given[i] for i in order), order


class DigestArray:
    """A sorted digest array in one bytes-like object, such as a mapped file; nothing is copied."""

    def __init__(self, buffer, digest=xxhash.xxh64_intdigest):
        n = int(np.frombuffer(buffer, "<i8", 1)[0])
        self.keys = np.frombuffer(buffer, "<u8", n, 8)
        self.values = np.frombuffer(buffer, "<i8", n, 8 + 8 * n)
        self.ends = np.frombuffer(buffer, "<i8", n + 1, 8 + 16 * n)
        self.strings = memoryview(buffer)[16 + 24 * n :]
        self.digest = digest

    @staticmethod
    def packed(strings: list[str], values: list[int], digest=xxhash.xxh64_intdigest) -> bytes:
        keys, ends, joined, order = digest_array(strings, digest)
        return b"".join([np.array([len(keys)], "<i8").tobytes(), keys.tobytes(), np.array(values, "<i8")[order].tobytes(), ends.tobytes(), joined])

    def find(self, wanted: list[bytes]) -> np.ndarray:
        """For each string its value, or -1 where it is not stored."""
        out = np.full(len(wanted), -1, dtype=np.int64)
        if not len(self.keys) or not wanted:
            return out
        digests = np.fromiter((self.digest(w) for w in wanted), dtype=np.uint64, count=len(wanted))
        at = np.searchsorted(self.keys, digests)
        near = np.minimum(at, len(self.keys) - 1)
        for i in np.flatnonzero(self.keys[near] == digests):
            j = int(at[i])
            while j < len(self.keys) and self.keys[j] == digests[i]:  # all strings of this digest
                if self.strings[self.ends[j] : self.ends[j + 1]] == wanted[i]:
                    out[i] = self.values[j]
                    break
                j += 1
        return out


def split_rule(rule: str) -> tuple[str, str]:
    host, slash, path = rule.partition("/")
    return host, slash + path


class UrlIndex:
    """Which rule a host and a path fall under. Files: ``hosts`` and ``rules``, as ``DigestArray`` packs them."""

    def __init__(self, hosts, rules, names: list[str], lengths: list[list[int]], digest=xxhash.xxh64_intdigest):
        self.hosts, self.rules, self.names, self.lengths = DigestArray(hosts, digest), DigestArray(rules, digest), names, lengths

    def decide(self, urls: list[tuple[str, str]]) -> list[int]:
        """For each host and path the position of its longest rule, or -1.

        A rule fits its host and subdomains. Of two rules as long, the one of the longer host
        wins. First the host and its parents are probed, then, for those that rules name, the
        beginnings of the path that such a rule has the length of.
        """
        parents, owner = [], []
        for i, (host, _) in enumerate(urls):
            at = 0
            while True:
                parents.append(host[at:])
                owner.append(i)
                at = host.find(".", at) + 1
                if not at:
                    break
        named = self.hosts.find([p.encode() for p in parents])
        tried, of = [], []
        for k in np.flatnonzero(named >= 0):
            path = urls[owner[k]][1]
            for n in self.lengths[named[k]]:
                if n <= len(path):
                    tried.append(parents[k] + path[:n])
                    of.append((owner[k], len(parents[k])))
        best: dict[int, tuple[int, int, int]] = {}
        for text, (i, host), rule in zip(tried, of, self.rules.find([t.encode() for t in tried]), strict=True):
            if rule >= 0:
                best[i] = max(best.get(i, (-1, -1, -1)), (len(text), host, int(rule)))
        return [best[i][2] if i in best else -1 for i in range(len(urls))]


def build_index(rules: list[tuple[str, str]], digest=xxhash.xxh64_intdigest) -> tuple[bytes, bytes, list[list[int]]]:
    lengths: dict[str, set[int]] = {}
    for rule, _ in rules:
        host, path = split_rule(rule)
        lengths.setdefault(host, set()).add(len(path))
    hosts = list(lengths)
    return DigestArray.packed(hosts, list(range(len(hosts))), digest), DigestArray.packed([r for r, _ in rules], list(range(len(rules))), digest), [sorted(lengths[h]) for h in hosts]


def ship(spark: SparkSession, data: bytes) -> str:
    """Write bytes to the shared folder and have Spark place them on each executor; the file's name."""
    name = f"urls-{sha256(data).hexdigest()}.bin"
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    path = jvm.org.apache.hadoop.fs.Path(f"{shared_root(spark)}/{name}")
    fs = path.getFileSystem(conf)
    if not fs.exists(path):
        out = fs.create(path, True)
        out.write(bytearray(data))
        out.close()
    spark.sparkContext.addFile(fs.makeQualified(path).toString())
    return name


def filter_urls(pages: DataFrame, rules: list[tuple[str, str]] = list(RULES), default: str = ALLOW, page_id: str = "page_id", url: str = "url") -> DataFrame:
    """(page_id, host, path, rule, verdict) of every row; a url that no rule fits gets ``default``.

    The rules are a list of settings: their packed size is checked against a fixed bound.
    A NULL url or one without ``://`` has an empty host and path, so no rule fits. Repeated
    and NULL page ids are kept as they are; other columns are not read. No shuffle.
    """
    spark = pages.sparkSession
    rules = list(dict(rules).items())
    hosts, keys, lengths = build_index(rules)
    if len(hosts) + len(keys) > MAX_INDEX:
        raise ValueError(f"the rules take more than {MAX_INDEX} bytes")
    host_file, rule_file = ship(spark, hosts), ship(spark, keys)
    names, verdicts = [r for r, _ in rules] + [None], [v for _, v in rules] + [default]

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mapped = [np.memmap(SparkFiles.get(os.path.basename(f)), dtype=np.uint8, mode="r") for f in (host_file, rule_file)]
        index = UrlIndex(*mapped, names, lengths)
        for b in batches:
            found = index.decide(list(zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True)))
            yield pa.RecordBatch.from_arrays(
                [*b.columns, pa.array([names[i] for i in found], pa.string()), pa.array([verdicts[i] for i in found], pa.string())], ["page_id", "host", "path", "rule", "verdict"]
            )

    rest = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://(.*)$", 1)
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    parts = pages.select(F.col(page_id).alias("page_id"), host.alias("host"), path.alias("path"))
    kind = pages.schema[page_id].dataType.simpleString()
    return parts.mapInArrow(judge, f"page_id {kind}, host string, path string, rule string, verdict string")


SQL = r"""
WITH parts AS (
    SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
           regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
    FROM (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages)
), rules(rule, rule_host, rule_path, verdict) AS (VALUES
    ('com/', 'com', '/', 'allow'), ('example.com/en/', 'example.com', '/en/', 'block'),
    ('www.example.com/en/', 'www.example.com', '/en/', 'allow'), ('net/es/', 'net', '/es/', 'block'), ('net/fr/', 'net', '/fr/', 'block')
)
SELECT page_id, any_value(host) AS host, any_value(path) AS path, arg_max(rule, length(rule)) AS rule,
       coalesce(arg_max(verdict, length(rule)), 'allow') AS verdict
FROM (SELECT row_number() OVER () AS r, * FROM parts) p
LEFT JOIN rules ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path)
GROUP BY r, page_id
"""


@query("op4_url_filters", SQL)
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(spark.read.parquet(f"{sf_dir}/pages.parquet"))
