"""Mixing sources to target weights by Pareto order sampling, in DataFrame operations only.

A source whose target is r times its size takes floor(r) whole copies of each document for
certain. The rest of the target is sampled: every document draws a uniform number U and is
ranked by the odds U / (1 - U) divided by the odds of its inclusion probability, which is the
fraction of r left after the whole copies. Documents are taken in this order until their
words fill the rest of the target, so the size of the sample in words is fixed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from vecspark.llm.common import blank_split, fresh, numbered, tasks_for, written
from vecspark.llm.register import query

WEIGHTS = (5, 2, 1)  # of the sources by code point, repeating, NULL last
MOST = 3  # times its size that a source, and so a document, is used at most
SEED = "mix-1"
BUCKETS = 1024  # parts of the order that sums are taken over, at each of two levels


def uniform(doc_id: Column, seed: str) -> Column:
    """A number strictly between 0 and 1 that follows from the id and the seed: 48 bits of an MD5."""
    digest = F.md5(F.concat_ws(":", F.lit(seed), F.coalesce(doc_id.cast("string"), F.lit("null"))).cast("binary"))
    return (F.conv(F.substring(digest, 1, 12), 16, 10).cast("double") + 0.5) / F.lit(float(1 << 48))


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """(source, source_size, target) from (source, source_size): shares of the total by weight.

    A source gets ``most`` times its size at most; what it can't take is shared by weight among
    the others, until none is above. With sources in the order of size per weight, those that
    are cut come first: one is cut if the level left to it and those after it is above its own.
    The table has a row per source; its windows run over that alone.
    """
    number = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*map(F.lit, weights)), (number % len(weights) + 1).cast("int"))
    rows = sizes.withColumn("weight", weight.cast("long")).withColumn("cap", F.col("source_size") * most)
    order = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    upto = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    whole = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rows = rows.withColumn("left_words", F.sum("source_size").over(whole) - F.sum("cap").over(upto) + F.col("cap"))
    rows = rows.withColumn("left_weight", F.sum("weight").over(whole) - F.sum("weight").over(upto) + F.col("weight"))
    level = F.col("left_words") / F.col("left_weight")
    rows = rows.withColumn("cut", F.col("cap") / F.col("weight") <= level)
    # The level falls along the sources that aren't cut; the first of them has the right one.
    rows = rows.withColumn("level", F.max(F.when(~F.col("cut"), level)).over(whole))
    target = F.when(F.col("cut"), F.col("cap").cast("double")).otherwise(F.col("weight") * F.col("level"))
    return rows.select("source", "source_size", target.alias("target"))


def order_columns(rows: DataFrame, goal: DataFrame, seed: str, own: dict[str, str]) -> DataFrame:
    """The rows with what their source's targets ask for and their place in its order: whole, chance, rest, rank, u, outer, inner."""
    source, u = F.col(f"r.{own['source']}"), uniform(F.col(own["doc_id"]), seed)
    drawn = rows.alias("r").join(F.broadcast(goal).alias("g"), source.eqNullSafe(F.col("g.source"))).select("r.*", "source_size", "target", "whole", "chance", "rest")
    rank = (u / (1 - u)) / (F.col("chance") / (1 - F.col("chance")))
    # The order of the ranks within a source is that of U, which buckets can be cut from.
    drawn = drawn.withColumn("rank", F.when(F.col("chance") > 0, rank)).withColumn("u", u)
    return drawn.withColumn("outer", F.floor(F.col("u") * BUCKETS)).withColumn("inner", F.floor(F.col("u") * BUCKETS * BUCKETS))


def mix(docs: DataFrame, seed: str = SEED, weights: tuple[int, ...] = WEIGHTS, most: int = MOST, doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """(doc_id, source, size, source_size, target, copies, taken) of every row, copies 0 and up.

    Sizes are words. The words taken of a source differ from its target by half a document
    at most. Sums over the order are taken over buckets of it, then over buckets within the
    one bucket where the target is reached; only the rows of that last part are sorted, so a
    source with most of the rows does not fill one task. Reruns agree.

    NULL and empty texts have size 0 and are taken 0 words. NULL is a source of its own.
    Rows of one id draw the same number; rows that are equal in id, source and size are
    interchangeable, and as many of them are taken as the target asks for. Sources without
    words have target 0. Other columns are not read.
    """
    drawn, _, ends = drawn_and_ends(docs, seed, weights, most, doc_id, text, source)
    out = drawn.alias("d").join(ends.alias("e"), F.col("d.source").eqNullSafe(F.col("e.source")), "left")
    before_cut = F.col("d.inner") < F.col("e.inner")
    at_cut = (F.col("d.inner") == F.col("e.inner")) & (F.struct("d.rank", "d.doc_id", "d.size", "d.row") <= F.col("e.cut"))
    extra = F.when((F.col("chance") > 0) & (F.col("rest") > 0) & F.coalesce(before_cut | at_cut, F.lit(False)), 1).otherwise(0)
    copies = (F.col("whole") + extra).cast("int")
    return out.select("d.doc_id", "d.source", "d.size", "source_size", "target", copies.alias("copies"), (copies * F.col("d.size")).cast("long").alias("taken"))


def drawn_and_ends(docs: DataFrame, seed: str, weights: tuple[int, ...], most: int, doc_id: str, text: str, source: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The rows in their sources' order, the targets of the sources, and of each source the place where its order is cut."""
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), F.size(blank_split(F.col(text))).cast("long").alias("size"))
    rows = written(rows.withColumn("row", F.monotonically_increasing_id()), "mix-sizes")  # parts rows that are equal in all else
    goal = targets(rows.groupBy("source").agg(F.sum("size").alias("source_size")), weights, most)
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    goal = goal.withColumn("whole", F.floor(ratio)).withColumn("chance", ratio - F.floor(ratio))
    goal = written(goal.withColumn("rest", F.col("target") - F.col("whole") * F.col("source_size")), "mix-targets")

    drawn = written(order_columns(rows, goal, seed, {"doc_id": "doc_id", "source": "source"}), "mix-ranks")

    def reached(sums: DataFrame, bucket: str) -> DataFrame:
        """Of each source the bucket in which the rest of the target is reached, and the words before it."""
        held = F.sum("words").over(Window.partitionBy("source").orderBy(bucket).rowsBetween(Window.unboundedPreceding, Window.currentRow))
        held = sums.withColumn("upto", held + F.col("before")).where("upto >= rest")
        return held.groupBy("source").agg(F.min(bucket).alias(bucket), F.min(F.col("upto") - F.col("words")).alias("before"), F.first("rest").alias("rest"))

    live = drawn.where("chance > 0 AND rest > 0 AND size > 0")
    sums = live.groupBy("source", "outer").agg(F.sum("size").alias("words"), F.first("rest").alias("rest")).withColumn("before", F.lit(0).cast("long"))
    outer = written(reached(sums, "outer"), "mix-outer")
    at_outer = F.col("d.source").eqNullSafe(F.col("o.source")) & (F.col("d.outer") == F.col("o.outer"))
    inside = live.alias("d").join(outer.alias("o"), at_outer).select("d.source", "d.inner", "d.size", "o.rest", "o.before")
    sums = inside.groupBy("source", "inner").agg(F.sum("size").alias("words"), F.first("rest").alias("rest"), F.first("before").alias("before"))
    inner = written(reached(sums, "inner"), "mix-inner")
    at_inner = F.col("d.source").eqNullSafe(F.col("i.source")) & (F.col("d.inner") == F.col("i.inner"))
    last = live.alias("d").join(inner.alias("i"), at_inner).select("d.source", "d.rank", "d.doc_id", "d.size", "d.row", "i.rest", "i.before")
    upto = F.sum("size").over(Window.partitionBy("source").orderBy("rank", F.col("doc_id").asc_nulls_first(), "size", "row").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    last = last.withColumn("upto", upto + F.col("before"))
    # The document that crosses the target is taken if that comes nearer to it.
    last = last.where("upto <= rest OR upto - rest < rest - (upto - size)")
    cut = last.groupBy("source").agg(F.max(F.struct("rank", "doc_id", "size", "row")).alias("cut"))
    ends = written(
        inner.alias("i").join(cut.alias("c"), F.col("i.source").eqNullSafe(F.col("c.source")), "left").select("i.source", "i.inner", "c.cut"), "mix-ends"
    )
    return drawn, goal, ends


def mixed(docs: DataFrame, seed: str = SEED, doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """The rows of the mix with all their columns, each as often as it has copies.

    A row's copies follow from its source's targets and its place before or after the cut of
    the source's order, a row per source, so texts are not shuffled. Rows that share id,
    source and size but are copied unequally often can't be told apart: only those at a
    cut can be, and as many of them as there should be, the first in an order written once, get
    one copy more.
    """
    drawn, goal, ends = drawn_and_ends(docs, seed, WEIGHTS, MOST, doc_id, text, source)
    at = [F.col("d.source").eqNullSafe(F.col("e.source")), F.col("d.inner") == F.col("e.inner")]
    at += [F.col(f"d.{c}").eqNullSafe(F.col(f"e.cut.{c}")) for c in ("rank", "doc_id", "size")]
    tied = drawn.alias("d").join(F.broadcast(ends.where("cut IS NOT NULL")).alias("e"), at[0] & at[1] & at[2] & at[3] & at[4])
    tied = tied.where("d.chance > 0 AND d.rest > 0").groupBy("e.source").agg(F.count_if(F.col("d.row") <= F.col("e.cut.row")).alias("extra"), F.count(F.lit(1)).alias("n"))
    goal = goal.alias("g").join(ends.alias("e"), F.col("g.source").eqNullSafe(F.col("e.source")), "left")
    goal = goal.join(tied.alias("t"), F.col("g.source").eqNullSafe(F.col("t.source")), "left")
    goal = written(goal.select("g.*", F.struct(F.col("e.inner").alias("inner"), "cut", "extra", (F.col("extra") < F.col("n")).alias("parts")).alias("end")), "mix-cuts")

    # The documents' own columns stand apart from those of the order.
    row, size = F.struct(*[F.col(c) for c in docs.columns]).alias("doc"), F.size(blank_split(F.col(text))).cast("long").alias("size")
    rows = docs.select(row, F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), size)
    out = order_columns(rows, goal.drop("end"), seed, {"doc_id": "doc_id", "source": "source"})
    out = out.alias("d").join(F.broadcast(goal.select("source", "end")).alias("e"), F.col("d.source").eqNullSafe(F.col("e.source"))).select("d.*", "end")
    key, cut = F.struct("rank", "doc_id", "size"), F.struct("end.cut.rank", "end.cut.doc_id", "end.cut.size")
    inside = (F.col("inner") == F.col("end.inner")) & F.col("end.cut").isNotNull()
    sampled = (F.col("chance") > 0) & (F.col("rest") > 0)
    out = out.withColumn("tie", F.coalesce(sampled & inside & key.eqNullSafe(cut), F.lit(False)))
    taken = sampled & F.coalesce((F.col("inner") < F.col("end.inner")) | (inside & (key <= cut)), F.lit(False))
    parts = F.col("tie") & F.col("end.parts")
    copies = F.col("whole").cast("int") + F.when(taken & ~F.coalesce(parts, F.lit(False)), 1).otherwise(0)
    chosen = out.where(~F.coalesce(parts, F.lit(False))).select("doc.*", copies.alias(fresh(docs, "mix_copies")))
    times = chosen.columns[-1]
    if not goal.where("end.parts").isEmpty():
        few = out.where(parts).select("doc", "source", "whole", "end.extra").withColumn("row", F.monotonically_increasing_id())
        group = F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit("-"))  # a source has one cut
        few = few.withColumn("group", group).select("doc", "group", "whole", "extra", "row")
        ranked = numbered(few, "group", [F.col("group"), F.col("row")], tasks_for(docs.sparkSession, 0, 1), "mix-unequal", "place")
        ranked = ranked.select("doc.*", (F.col("whole") + (F.col("place") < F.col("extra")).cast("int")).cast("int").alias(times))
        chosen = chosen.unionByName(ranked)
    chosen = chosen.where(F.col(times) > 0)
    return chosen.withColumn(times, F.explode(F.sequence(F.lit(1), times))).select(*docs.columns)


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents as often as the target weights of their sources ask for, with their columns."""
    return mixed(docs)


SQL = r"""
WITH sizes AS (
    SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
           (('0x' || substr(md5('mix-1:' || coalesce(doc_id::VARCHAR, 'null')), 1, 12))::BIGINT::DOUBLE + 0.5) / 281474976710656.0 AS u
    FROM documents
), sources AS (
    SELECT source, sum(size)::BIGINT AS source_size, 3 * sum(size)::BIGINT AS cap,
           [5, 2, 1][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3] AS weight
    FROM sizes GROUP BY source
), rest AS (
    SELECT *, sum(source_size) OVER () - coalesce(sum(cap) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS words,
           sum(weight) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS weights
    FROM sources WINDOW o AS (ORDER BY cap / weight, source NULLS LAST)
), levels AS (
    SELECT *, cap / weight <= words / weights AS cut, max(CASE WHEN cap / weight > words / weights THEN words / weights END) OVER () AS level FROM rest
), goals AS (
    SELECT source, source_size, CASE WHEN cut THEN cap::DOUBLE ELSE weight * level END AS target FROM levels
), ratios AS (
    SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS whole,
           CASE WHEN source_size > 0 THEN target / source_size - floor(target / source_size) ELSE 0 END AS chance FROM goals
), ranks AS (
    SELECT s.doc_id, s.size, r.*, target - whole * source_size AS rest,
           CASE WHEN chance > 0 THEN (u / (1 - u)) / (chance / (1 - chance)) END AS rank
    FROM sizes s JOIN ratios r ON s.source IS NOT DISTINCT FROM r.source
), sums AS (
    SELECT *, sum(size) OVER (PARTITION BY source ORDER BY rank, doc_id NULLS FIRST, size ROWS UNBOUNDED PRECEDING) AS upto FROM ranks
)
SELECT doc_id, size, source_size, target,
       (size * (whole + CASE WHEN chance > 0 AND (upto <= rest OR upto - rest < rest - (upto - size)) THEN 1 ELSE 0 END))::BIGINT AS taken
FROM sums
"""


@query("op3_mixing", SQL)
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "size", "source_size", "target", "taken")
