"""Ingest: check, stamp, embed, check the vectors, append; bad rows go to quarantine."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vecspark.functions.ids import keyed_uuid
from vecspark.functions.text import trim_text
from vecspark.operators.embed import Embedder, embed_texts, with_embed_errors
from vecspark.operators.requests import parse_create_requests
from vecspark.operators.validation import ERROR_COLUMNS, text_rules, with_errors
from vecspark.schema import TASK_DOCUMENT, VALIDATION_ERROR
from vecspark.session import configure, run_folder, spread
from vecspark.sources.corpus import key_stats, one_per_key, read_corpus, utc_now
from vecspark.sources.key_log import KeyLog, broadcast_if_small
from vecspark.sources.vector_index import VectorIndex

REPEATED_ID = "request id is used by another request of the batch"
STORED_ID = "request id is used by another request stored before"
STORED = ("id", "content", "embedding", "metadata", "created_at")


def said() -> Column:
    """A digest of what a request says: its trimmed text and its metadata."""
    return F.md5(F.to_json(F.struct(trim_text(F.col("content")).alias("content"), "metadata")))


def check_contents(requests: DataFrame) -> DataFrame:
    """Errors for (request_id, content, metadata) rows."""
    return with_errors(requests, text_rules(F.col("content"), "content"))


def check_bodies(requests: DataFrame) -> DataFrame:
    """Errors for (request_id, body) rows."""
    return parse_create_requests(requests)


def prepare_documents(checked: DataFrame, embedder: Embedder, created_at: Column | None = None) -> DataFrame:
    """Stamp and embed checked rows. Rows with an error stay in the result and are not embedded."""
    accepted = F.col("error_code").isNull()
    stamped = checked.select(
        "request_id",
        (F.col("id") if "id" in checked.columns else keyed_uuid(F.col("request_id"))).alias("id"),
        F.when(accepted, trim_text(F.col("content"))).alias("content"),
        "metadata",
        (utc_now() if created_at is None else created_at).alias("created_at"),
        *ERROR_COLUMNS,
    )
    return with_embed_errors(embed_texts(stamped, embedder, task=TASK_DOCUMENT), embedder)


def other_contents(keyed: DataFrame) -> DataFrame:
    """Of requests with the same id, those that do not say what the least of them says.

    They get an error, unless they have one, and an id of their own. Only rows of repeated
    ids are shuffled as a whole.
    """
    whole = F.struct("content", "metadata", *ERROR_COLUMNS)
    repeated = keyed.groupBy("id").agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1").select("id")
    several = keyed.join(repeated, "id", "left_semi")
    first = several.groupBy("id").agg(F.min(whole).alias("_first"))
    others = several.join(first, "id").filter(~whole.eqNullSafe(F.col("_first"))).drop("_first")
    return one_per_key(refused(others.select(*keyed.columns), REPEATED_ID))


def refused(rows: DataFrame, message: str) -> DataFrame:
    """Rows with this error, unless they have one, under ids of their own that follow from what they say."""
    what = F.to_json(F.struct("content", "metadata", *ERROR_COLUMNS))
    rows = rows.withColumn("id", keyed_uuid(F.lit("other content"), F.col("id"), what))
    accepted = F.col("error_code").isNull()
    error = {"error_message": message, "error_field": "request_id", "error_code": VALIDATION_ERROR}
    return rows.withColumns({c: F.when(accepted, F.lit(v)).otherwise(F.col(c)) for c, v in error.items()})


def key_log(spark: SparkSession, table: str, digest: Column) -> KeyLog:
    """The log of a table; of one that has rows and no log yet, made from its rows."""
    log = KeyLog(spark, table)
    if not log.exists():
        rows = read_corpus(spark, table)
        if not rows.isEmpty():
            log.begin("")
            log.add("", log.missing(rows).select("id", digest.alias("said")))
    return log


def _put(log: KeyLog, batch: str, rows: DataFrame, table: str, columns: tuple[str, ...], digest: Column, again: bool) -> None:
    """Add rows to a table and to its log. ``again``: part of that may have been done before."""
    new = rows
    if again:  # only after a failure the table itself is looked into
        there = rows.select("id").join(read_corpus(rows.sparkSession, table).select("id"), "id", "left_semi").distinct()
        new = rows.join(broadcast_if_small(there), "id", "left_anti")
    new.select(*columns).write.mode("append").parquet(table)
    log.add(batch, (log.missing(rows) if again else rows).select("id", digest.alias("said")))


def add_staged(log: KeyLog, refusals: KeyLog, batch: str, staging: str, index: VectorIndex | None, again: bool = False) -> None:
    """Add a staged batch: the good rows to the table and the index, the others to quarantine, and commit."""
    staged = log.spark.read.parquet(staging)
    good, bad = staged.filter(F.col("error_code").isNull()), staged.filter(F.col("error_code").isNotNull()).drop("embedding")
    if index is not None:
        index.append(good)
    _put(log, batch, good, log.table, STORED, said(), again)
    if not bad.isEmpty():
        bad = refusals.missing(bad) if not again else bad
        _put(refusals, batch, bad, refusals.table, tuple(bad.columns), F.lit(""), again)
    log.commit(batch)


def index_documents(
    requests: DataFrame,
    embedder: Embedder,
    table: str,
    quarantine_table: str,
    created_at: Column | None = None,
    index: VectorIndex | None = None,
) -> DataFrame:
    """Ingest (request_id, content, metadata) or (request_id, body) rows into a corpus table.

    Returns one outcome row per request that is new, without vectors. A request's id follows
    from its request id: running the same batch again adds nothing to either table, also after
    a run that was cut off. A refused request is tried again when it comes again. Of requests
    that share an id within a batch, exact repeats count once; of differing ones the least is
    taken and the others are refused. A request that says something else than a stored one of
    its id is refused as well: every request is stored, refused, or says what one of them says.

    Ids are looked up in the table's ``KeyLog``; neither table is scanned. Known rows are
    dropped before the embedding, the expensive step, and the embedded batch is written once
    and read from there. With an index, the stored rows are added to it, too.
    """
    spark = configure(requests.sparkSession)
    log, refusals = key_log(spark, table, said()), key_log(spark, quarantine_table, F.lit(""))
    for batch, staging in log.unfinished():
        if staging:
            add_staged(log, refusals, batch, staging, index, again=True)
        else:
            log.add(batch, log.missing(read_corpus(spark, table)).select("id", said().alias("said")))
            log.commit(batch)
    checked = check_bodies(requests) if "body" in requests.columns else check_contents(requests)
    extra = [] if created_at is None else ["_created_at"]
    if extra:
        checked = checked.withColumn("_created_at", created_at)
    checked = checked.select("request_id", "content", "metadata", *ERROR_COLUMNS, *extra)
    # Requests without an id are told apart by what they bring: none is lost but an exact repeat.
    brought = keyed_uuid(F.lit("no request id"), *[F.to_json(F.struct(c)) for c in ("content", "metadata", "error_code")])
    keyed = checked.withColumn("id", F.when(F.col("request_id").isNull(), brought).otherwise(keyed_uuid(F.col("request_id"))))

    # Parsed once; what follows reads the columns it needs from here.
    folder = run_folder(spark, "parsed")
    keyed.withColumn("digest", said()).write.parquet(folder)
    keyed = spark.read.schema(keyed.withColumn("digest", said()).schema).parquet(folder)
    stats = key_stats(keyed)
    known = log.known(keyed.select("id"))
    fresh, some = keyed.drop("digest"), known.count()
    if some:
        known = broadcast_if_small(known, rows=some)
        fresh = fresh.join(known.select("id"), "id", "left_anti")
    new = one_per_key(fresh, stats=stats)
    if stats.most > 1:
        new = new.unionByName(other_contents(fresh))
    if some:
        clash = keyed.join(known, "id").filter(~F.col("digest").eqNullSafe(F.col("said")) | F.col("error_code").isNotNull())
        if not clash.isEmpty():
            new = new.unionByName(one_per_key(refused(clash.select(*fresh.columns), STORED_ID)))
    new = spread(new, "id", stats.rows)
    staged = prepare_documents(new, embedder, F.col("_created_at") if extra else None)

    staging = run_folder(spark, "staged")
    staged.write.parquet(staging)
    add_staged(log, refusals, log.begin(staging), staging, index)
    log.compact()
    staged = spark.read.parquet(staging)
    return staged.withColumn("embedding_dim", F.size("embedding")).drop("embedding")
