"""Quality rules as a short-circuit cascade, in DataFrame operations only.

On a sample the share of rows each rule rejects and the time it takes are measured; the
cascade asks first the rules that reject most for their cost, and a later rule is only worked
out for rows that all earlier ones let pass. The order changes the cost, never the verdict.

Counts that are put out anyway are worked out once and rules look at those columns; what a
rule costs is then what it costs beyond them.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Sequence
from functools import partial
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vecspark.llm.common import BLANKS, blank_split, fresh, written
from vecspark.llm.register import query

SAMPLE_ROWS = 1000  # rows that costs and selectivities are measured on, about; verdicts are for all rows
TIMES, TRIES = 4, 3  # how often a rule is worked out for each row of the sample, and how many timings the best is taken of
SYMBOLS = "#*$%&|<>"
WINDOW = 8


class Rule(NamedTuple):
    name: str
    rejects: Column  # true, false or NULL; NULL rejects nothing


def body(text: Column) -> Column:
    return F.coalesce(text, F.lit(""))


def word_chars(text: Column) -> Column:
    """Code points in words."""
    return F.char_length(F.translate(body(text), BLANKS, "")).cast("long")


def n_symbols(text: Column) -> Column:
    return (F.char_length(body(text)) - F.char_length(F.translate(body(text), SYMBOLS, ""))).cast("long")


def worded_lines(text: Column) -> Column:
    return F.filter(F.split(body(text), "\n", -1), lambda line: F.btrim(line, F.lit(BLANKS)) != "")


def n_dup_lines(text: Column) -> Column:
    """Lines with a word that equal an earlier line."""
    lines = worded_lines(text)
    return (F.size(lines) - F.size(F.array_distinct(lines))).cast("long")


def bound(value: Column, function: Callable[[Column], Column]) -> Column:
    """The function of a value that is worked out once, however often the function looks at it."""
    return F.element_at(F.transform(F.array(value), lambda x: function(x)), 1)


def n_repeat_words(words: Column) -> Column:
    """Words in windows of 8 that the text has twice or more.

    Hashes of the windows tell whether any can be equal at all, which they are in few texts.
    Only then the windows themselves are sorted, so that equal ones stand side by side.
    """
    last = F.size(words) - WINDOW
    starts = F.sequence(F.lit(0), last)

    def doubled(hashes: Column, width: int) -> Column:
        """Hashes of windows twice as wide, from those of windows that follow each other."""
        n = F.greatest(F.size(hashes) - width, F.lit(0))
        return F.zip_with(F.slice(hashes, F.lit(1), n), F.slice(hashes, F.lit(1 + width), n), lambda a, b: F.xxhash64(a, b))

    hashes = F.transform(words, lambda w: F.xxhash64(w))
    for width in (1, 2, 4):
        hashes = bound(hashes, partial(doubled, width=width))
    keyed = F.sort_array(F.transform(starts, lambda i: F.struct(F.concat_ws(" ", *[F.get(words, i + k) for k in range(WINDOW)]).alias("w"), i.alias("i"))))

    def covered(sorted_windows: Column) -> Column:
        same = F.filter(
            F.transform(
                sorted_windows,
                lambda x, k: F.when(
                    F.coalesce(F.get(sorted_windows, k - 1)["w"] == x["w"], F.lit(False)) | F.coalesce(F.get(sorted_windows, k + 1)["w"] == x["w"], F.lit(False)), x["i"]
                ),
            ),
            lambda i: i.isNotNull(),
        )
        start = F.struct(F.lit(-WINDOW).alias("at"), F.lit(0).alias("n"))
        return F.aggregate(
            F.sort_array(same), start, lambda acc, i: F.struct(i.alias("at"), (acc["n"] + F.least(F.lit(WINDOW), i - acc["at"])).alias("n")), lambda acc: acc["n"]
        )

    slow = bound(keyed, covered)
    some = F.size(F.array_distinct(hashes)) < last + 1
    return F.when(last < 1, 0).when(some, slow).otherwise(0).cast("long")


def base_failed(n_words: Column, n_repeat: Column) -> Column:
    return (n_words < 20) | (100 * n_repeat > 30 * n_words)


def counts(text: Column, words: Column) -> dict[str, Column]:
    """What rules compare, by name."""
    return {
        "n_words": F.size(words).cast("long"), "word_chars": word_chars(text), "n_symbols": n_symbols(text), "n_dup_lines": n_dup_lines(text),
        "n_lines": F.size(worded_lines(text)).cast("long"),
    }


def standard_rules(text: str = "text", words: Column | None = None, counted: dict[str, Column] | None = None) -> list[Rule]:
    """Rules of thumb for running text, as counts compared with counts.

    ``words`` and ``counted`` are columns that hold the words and the ``counts`` of the text;
    without them both are worked out from the text.
    """
    t = F.col(text)
    words = blank_split(t) if words is None else words
    c = counts(t, words) if counted is None else counted
    n = c["n_words"]
    letters = F.char_length(F.regexp_replace(body(t), r"\P{L}", ""))
    capitals = F.char_length(body(t)) - F.char_length(F.regexp_replace(body(t), r"\p{Lu}", ""))
    with_letter = F.size(F.filter(words, lambda w: w.rlike(r"\p{L}")))
    return [
        Rule("symbols", 10 * c["n_symbols"] > n),
        Rule("short_words", c["word_chars"] < 2 * n),
        Rule("long_words", c["word_chars"] > 15 * n),
        Rule("repeated_lines", 2 * c["n_dup_lines"] > c["n_lines"]),
        Rule("few_letters", 10 * with_letter < 6 * n),
        Rule("capitals", 10 * capitals > 4 * letters),
    ]


def sampled(docs: DataFrame, rows: int = SAMPLE_ROWS) -> DataFrame:
    """About so many rows, drawn where they are; all of a table that has no more."""
    return docs.sample(min(1.0, rows / max(1, docs.count())), seed=1)


def measure(docs: DataFrame, rules: Sequence[Rule], rows: int = SAMPLE_ROWS) -> list[tuple[Rule, float, float]]:
    """Each rule with the share of a sample it rejects and the seconds that takes beyond reading the sample.

    Rows are drawn where they are and written, so none meet in one task. A rule is worked out
    some times for each row, first to warm up and then for the best of a few timings; what the
    same job takes without a rule is taken off.
    """
    sample = written(sampled(docs, rows), "quality-sample")
    again = sample.withColumn(fresh(sample, "time"), F.explode(F.sequence(F.lit(1), F.lit(TIMES))))

    def timed(verdict: Column) -> tuple[float, float]:
        job, best = again.agg(F.avg(verdict.cast("int"))), float("inf")
        for turn in range(1 + TRIES):
            start = time.perf_counter()
            share = job.first()[0]
            best = min(best, time.perf_counter() - start) if turn else best
        return share or 0.0, best

    # All columns are read, and nothing is worked out from them.
    idle = timed(F.hash(*[F.col(c).isNull() for c in sample.columns]).isNull())[1]
    out = []
    for rule in rules:
        share, seconds = timed(F.coalesce(rule.rejects, F.lit(False)))
        out.append((rule, share, max(0.0, seconds - idle)))
    return out


def ordered(measured: Sequence[tuple[Rule, float, float]]) -> list[Rule]:
    """Most rejections per cost first; rules as good as each other as they were given."""
    return [r for r, _, _ in sorted(measured, key=lambda m: -m[1] / max(m[2], 1e-3))]


def cascade(rules: Sequence[Rule]) -> Column:
    """True where no rule rejects. CASE works a branch out only if those before it did not hold."""
    out = None
    for rule in rules:
        rejects = F.coalesce(rule.rejects, F.lit(False))
        out = F.when(rejects, False) if out is None else out.when(rejects, False)
    return F.lit(True) if out is None else out.otherwise(True)


def keep_good(docs: DataFrame, rules: Sequence[Rule] | None = None, text: str = "text") -> DataFrame:
    """The rows that pass all rules, with the columns they had.

    NULL and empty texts have no words and no symbols, so the standard rules let them pass.
    """
    rules = standard_rules(text) if rules is None else rules
    return docs.where(cascade(ordered(measure(docs, rules))))


def judge(docs: DataFrame, rules: Sequence[Rule] | None = None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept) of every row.

    NULL, empty and blank texts have no words and fail the base. NULL and repeated ids are kept
    as they are, other columns are not read. No shuffle.
    """
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    t, words = F.col("text"), F.col("words")
    own = counts(t, words)

    def with_counts(part: DataFrame) -> DataFrame:
        part = part.withColumn("words", blank_split(t))
        return part.select("doc_id", "text", "words", *[c.alias(name) for name, c in own.items()])

    rules = standard_rules("text", words, {name: F.col(name) for name in own}) if rules is None else rules
    order = ordered(measure(with_counts(sampled(rows)), rules))
    counted = with_counts(rows)
    counted = counted.withColumn("n_repeat_words", n_repeat_words(words))
    counted = counted.withColumn("base_failed", base_failed(F.col("n_words"), F.col("n_repeat_words")))
    counted = counted.withColumn("kept", F.when(F.col("base_failed"), False).otherwise(cascade(order)))
    return counted.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


SQL = r"""
WITH docs AS (
    SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words,
           list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM documents
), windows AS (
    SELECT r, i, array_to_string(words[i:i + 7], ' ') AS w FROM (SELECT r, words, unnest(generate_series(1, len(words) - 7)) AS i FROM docs)
), repeated AS (
    SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, w) AS n FROM windows) WHERE n > 1
), covered AS (
    SELECT r, sum(least(8, i - before)) AS n FROM (SELECT r, i, lag(i, 1, -100) OVER (PARTITION BY r ORDER BY i) AS before FROM repeated) GROUP BY r
), counts AS (
    SELECT doc_id, text, words, lines, len(words)::BIGINT AS n_words, length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
           (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
           (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(n, 0)::BIGINT AS n_repeat_words
    FROM docs LEFT JOIN covered USING (r)
), base AS (
    SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM counts
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT (base_failed OR 10 * n_symbols > n_words OR word_chars < 2 * n_words OR word_chars > 15 * n_words OR 2 * n_dup_lines > len(lines)
            OR 10 * len(list_filter(words, lambda w: regexp_matches(w, '\p{L}'))) < 6 * n_words
            OR 10 * length(regexp_replace(text, '\P{Lu}', '', 'g')) > 4 * length(regexp_replace(text, '\P{L}', '', 'g'))) AS kept
FROM base
"""


@query("op5_quality_rules", SQL)
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(spark.read.parquet(f"{sf_dir}/documents.parquet"))
