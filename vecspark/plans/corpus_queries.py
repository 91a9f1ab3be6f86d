"""Registered queries: scan, text and display columns, append, schema steps, inspection."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vecspark.functions import display, ids, text, vector
from vecspark.operators.inspection import DISTINCT_ERROR, column_sketches, corpus_count, corpus_health, merged_profile
from vecspark.operators.search import with_similarity
from vecspark.plans import views
from vecspark.plans.registry import query
from vecspark.sources.corpus import (
    AddColumn,
    Backfill,
    RequireNotNull,
    corpus_append,
    corpus_scan,
    new_rows,
    not_null_violations,
    schema_evolve,
    strip_embedding,
)
from vecspark.session import run_folder
from vecspark.sources.table_log import VersionedTable


@query(
    "corpus_scan",
    f"WITH {views.DOCUMENTS} SELECT id, content, metadata, created_at FROM docs",
)
def _scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus_scan(views.documents(spark, sf_dir))


@query("strip_embedding", "SELECT vec_id, label FROM embeddings")
def _strip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return strip_embedding(views.table(spark, sf_dir, "embeddings"))


@query(
    "vector_parse",
    """SELECT 'vector' AS kind, vec_id AS id, TRUE AS parsed, pos - 1 AS position, embedding[pos]::DOUBLE AS value
       FROM (SELECT vec_id, embedding, unnest(range(1, len(embedding) + 1)) AS pos FROM embeddings)
       UNION ALL SELECT 'text', doc_id, FALSE, -1, 0.0 FROM documents
       UNION ALL SELECT 'props', event_id, FALSE, -1, 0.0 FROM events""",
)
def _parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors from their text form; texts that are no vectors stay unparsed."""
    e = views.table(spark, sf_dir, "embeddings")
    literals = e.select(F.lit("vector").alias("kind"), F.col("vec_id").alias("id"), vector.format_vector("embedding").alias("s"))
    literals = literals.union(views.table(spark, sf_dir, "documents").select(F.lit("text"), "doc_id", "text"))
    literals = literals.union(views.table(spark, sf_dir, "events").select(F.lit("props"), "event_id", "props"))
    parsed = literals.select("kind", "id", vector.parse_vector(F.col("s")).alias("v"))
    long = parsed.select("kind", "id", F.col("v").isNotNull().alias("parsed"), F.posexplode_outer("v").alias("position", "x"))
    return long.select(
        "kind",
        "id",
        "parsed",
        F.coalesce("position", F.lit(-1)).cast("bigint").alias("position"),
        F.coalesce(F.col("x").cast("double"), F.lit(0.0)).alias("value"),
    )


@query("vector_format", "SELECT vec_id AS id, len(embedding)::BIGINT AS elements, 0::BIGINT AS changed FROM embeddings")
def _format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors to text and back: how many elements differ afterwards."""
    e = views.vectors(spark, sf_dir)
    back = e.select("id", "embedding", vector.parse_vector(vector.format_vector(F.col("embedding"))).alias("again"))
    pairs = F.zip_with("embedding", "again", lambda a, b: ~a.eqNullSafe(b))
    return back.select(
        "id",
        F.size(F.split(vector.format_vector(F.col("embedding")), ",")).cast("bigint").alias("elements"),
        F.size(F.filter(pairs, lambda x: x)).cast("bigint").alias("changed"),
    )


@query(
    "trim_text",
    f"WITH {views.PADDED_TEXTS} SELECT doc_id, form, trimmed FROM measured",
)
def _trim(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.padded_texts(spark, sf_dir).select("doc_id", "form", text.trim_text(F.col("content")).alias("trimmed"))


@query("utf16_length", f"WITH {views.PADDED_TEXTS} SELECT doc_id, form, units::BIGINT AS units FROM measured")
def _units(spark: SparkSession, sf_dir: str) -> DataFrame:
    trimmed = text.trim_text(F.col("content"))
    return views.padded_texts(spark, sf_dir).select("doc_id", "form", text.utf16_length(trimmed).cast("bigint").alias("units"))


@query("embedding_dim", "SELECT vec_id AS id, len(embedding)::BIGINT AS dim FROM embeddings")
def _dim(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.vectors(spark, sf_dir).select("id", vector.embedding_dim(F.col("embedding")).cast("bigint").alias("dim"))


_DISPLAY_SQL = f"""WITH {views.SCORED_VECTORS}
SELECT id, round(greatest(0.0, least(1.0, similarity)), 3) AS score,
       round(1 - greatest(0.0, least(1.0, similarity)), 3) AS distance,
       round(greatest(0.0, least(1.0, similarity)) * 100, 6) AS percent
FROM scored"""


@query("score_display", _DISPLAY_SQL)
def _display(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = with_similarity(views.vectors(spark, sf_dir), views.first_vector(spark, sf_dir))
    shown = display.score_display(F.col("similarity"))
    return scored.select(
        "id", shown["score"].alias("score"), shown["distance"].alias("distance"), F.round(shown["percent"], 6).alias("percent")
    )


@query(
    "content_preview",
    f"""WITH {views.DOCUMENTS}
    SELECT id, CASE WHEN length(content) > 80 THEN substr(content, 1, 80) || chr(8230) ELSE content END AS preview
    FROM docs""",
)
def _preview(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.documents(spark, sf_dir).select("id", text.content_preview(F.col("content")).alias("preview"))


def _uuid_sql(key: str) -> str:
    h = f"""md5('["' || {key} || '"]')"""
    return f"""substr({h}, 1, 8) || '-' || substr({h}, 9, 4) || '-4' || substr({h}, 14, 3) || '-'
       || translate(substr({h}, 17, 1), '01234567cdef', '89ab89ab89ab') || substr({h}, 18, 3) || '-' || substr({h}, 21, 12)"""


@query("id_prefix", f"SELECT doc_id, substr({_uuid_sql('doc_id')}, 1, 8) || chr(8230) AS shown FROM documents")
def _prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = views.table(spark, sf_dir, "documents")
    return d.select("doc_id", text.id_prefix(ids.keyed_uuid(F.col("doc_id"))).alias("shown"))


@query(
    "metadata_source",
    f"""WITH {views.DOCUMENTS}
    SELECT 'document' AS kind, id, source FROM (SELECT id, metadata->>'$.source' AS source FROM docs)
    UNION ALL SELECT 'event', event_id, '' FROM events""",
)
def _source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The source of each document; event properties have none."""
    d = views.documents(spark, sf_dir).select(F.lit("document").alias("kind"), "id", "metadata")
    e = views.table(spark, sf_dir, "events").select(F.lit("event"), "event_id", "props")
    return d.union(e).select(
        "kind", "id", F.coalesce(display.metadata_source(F.col("metadata")), F.lit("")).alias("source")
    )


@query("iso_timestamp", "SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S.%gZ') AS iso FROM events")
def _iso(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.table(spark, sf_dir, "events").select("event_id", display.iso_timestamp(F.col("ts")).alias("iso"))


@query("short_date", "SELECT event_id, strftime(ts, '%b %-d, %I:%M %p') AS shown FROM events")
def _short(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.table(spark, sf_dir, "events").select("event_id", display.short_date(F.col("ts")).alias("shown"))


@query(
    "trace_ids",
    """SELECT event_id, CASE WHEN event_type = 'error' THEN 36 ELSE length(user_id::VARCHAR) END::BIGINT AS id_length,
       event_type <> 'error' AS given FROM events""",
)
def _trace(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Correlation ids, given or fresh; error events come without one here."""
    e = views.table(spark, sf_dir, "events").select(
        "event_id", F.when(F.col("event_type") != "error", F.col("user_id").cast("string")).alias("correlation_id")
    )
    traced = e.withColumn("trace_id", ids.trace_id(F.col("correlation_id")))
    return traced.select(
        "event_id",
        F.length("trace_id").cast("bigint").alias("id_length"),
        F.col("trace_id").eqNullSafe(F.col("correlation_id")).alias("given"),
    )


@query(
    "new_rows",
    f"""WITH {views.DOCUMENTS}
    SELECT id, content, metadata, created_at FROM docs WHERE id NOT IN (SELECT doc_id FROM labels)""",
)
def _new_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents to append when the labelled ones are stored already."""
    stored = views.table(spark, sf_dir, "labels").select(F.col("doc_id").alias("id"))
    return new_rows(views.documents(spark, sf_dir), stored)


@query(
    "corpus_append",
    f"""WITH {views.DOCUMENTS}
    SELECT id, metadata, created_at, length(content)::BIGINT AS chars FROM docs""",
)
def _append(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Append the labelled documents, then all documents: each is stored once."""
    path = run_folder(spark, "append")
    staged = views.documents(spark, sf_dir).withColumn("embedding", F.array(F.length("content").cast("float")))
    labelled = views.table(spark, sf_dir, "labels").select(F.col("doc_id").alias("id"))
    corpus_append(staged.join(labelled, "id", "left_semi"), path)
    corpus_append(staged, path)
    stored = spark.read.parquet(path)
    return stored.select("id", "metadata", "created_at", F.length("content").cast("bigint").alias("chars"))


@query(
    "schema_evolve",
    """SELECT d.doc_id, d.lang, coalesce(l.quality::VARCHAR, '{}') AS metadata, 'none' AS test_field
    FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id""",
)
def _evolve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fill a partly missing column, require it, add a new one; adding an old one changes nothing."""
    d = views.table(spark, sf_dir, "documents").select("doc_id", "lang")
    q = views.table(spark, sf_dir, "labels").select("doc_id", F.col("quality").cast("string").alias("metadata"))
    steps = (
        AddColumn("metadata", "string"),
        Backfill("metadata", "{}"),
        RequireNotNull("metadata"),
        AddColumn("test_field", "string", default="none"),
        AddColumn("lang", "int"),
    )
    return schema_evolve(d.join(q, "doc_id", "left"), steps)


@query(
    "table_versions",
    """SELECT 'first' AS version, doc_id, lang, '' AS metadata, '' AS test_field FROM documents WHERE doc_id % 3 = 0
    UNION ALL SELECT 'before', doc_id, lang, CASE doc_id % 3 WHEN 0 THEN '' ELSE source END, '' FROM documents WHERE doc_id % 3 < 2
    UNION ALL SELECT 'last', doc_id, lang, CASE doc_id % 3 WHEN 0 THEN '{}' ELSE source END, CASE doc_id % 3 WHEN 2 THEN 'new' ELSE 'none' END FROM documents""",
)
def _versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents appended under three schemas; the first, an earlier and the last version are read."""
    d = views.table(spark, sf_dir, "documents")
    part = [d.filter(F.col("doc_id") % 3 == i) for i in range(3)]
    table = VersionedTable(spark, run_folder(spark, "versions"))
    first = table.append(part[0].select("doc_id", "lang"))
    table.evolve(AddColumn("metadata", "string"))
    before = table.append(part[1].select("doc_id", "lang", F.col("source").alias("metadata")))
    table.evolve(Backfill("metadata", "{}"), RequireNotNull("metadata"), AddColumn("test_field", "string", default="none"))
    table.append(part[2].select("doc_id", "lang", F.col("source").alias("metadata"), F.lit("new").alias("test_field")))
    out = None
    for name, version in (("first", first), ("before", before), ("last", None)):
        rows = table.read(version)
        shown = [F.coalesce(c, F.lit("")).alias(c) if c in rows.columns else F.lit("").alias(c) for c in ("metadata", "test_field")]
        rows = rows.select(F.lit(name).alias("version"), "doc_id", "lang", *shown)
        out = rows if out is None else out.unionByName(rows)
    return out


@query(
    "not_null_violations",
    """SELECT count(*) FILTER (d.text IS NULL) AS text, count(*) FILTER (l.quality IS NULL) AS quality
    FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id""",
)
def _violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = views.table(spark, sf_dir, "documents").select("doc_id", "text")
    labelled = d.join(views.table(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id", "left")
    return not_null_violations(labelled, ["text", "quality"])


@query("corpus_count", "SELECT count(*) AS n FROM documents")
def _count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus_count(views.documents(spark, sf_dir))


_PROFILED = {"documents": ("doc_id", "text", "lang", "source", "n_chars"), "events": ("event_id", "ts", "user_id", "event_type", "value", "props")}
_KINDS = {"doc_id": "bigint", "n_chars": "bigint", "event_id": "bigint", "user_id": "bigint", "value": "double", "ts": "timestamp_ntz"}
_UNSHOWN = ("value", "ts")  # texts of these differ between engines


def _profile_sql() -> str:
    rows = []
    for table, columns in _PROFILED.items():
        for i, c in enumerate(columns, 1):
            low, high = ("''", "''") if c in _UNSHOWN else (f"left(min({c})::VARCHAR, 40)", f"left(max({c})::VARCHAR, 40)")
            rows.append(
                f"SELECT '{table}' AS table_name, {i} AS ordinal_position, '{c}' AS column_name, '{_KINDS.get(c, 'string')}' AS data_type, count(*) AS n_rows, "
                f"count(*) FILTER ({c} IS NULL) AS nulls, {low} AS low, {high} AS high, TRUE AS distinct_close FROM {table}"
            )
    return " UNION ALL ".join(rows)


@query("corpus_columns", _profile_sql())
def _columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Profile of every column of two tables: sketched in parts, stored, read again and merged; distinct counts held against exact ones."""
    out = None
    for name, columns in _PROFILED.items():
        rows = views.table(spark, sf_dir, name)
        folder = run_folder(spark, "sketches")
        column_sketches(rows, F.pmod(F.col(columns[0]), F.lit(7))).write.parquet(folder)
        profile = merged_profile(spark.read.parquet(folder))
        exact = rows.agg(F.array(*[F.struct(F.lit(c).alias("column_name"), F.count_distinct(c).alias("n")) for c in columns]).alias("c"))
        exact = exact.select(F.explode("c").alias("c")).select("c.*")
        close = F.abs(F.col("n_distinct") - F.col("n")) <= F.col("n") * DISTINCT_ERROR
        shown = [F.when(F.col("column_name").isin(*_UNSHOWN), "").otherwise(F.substring(c, 1, 40)).alias(c) for c in ("low", "high")]
        profile = profile.join(F.broadcast(exact), "column_name")
        part = profile.select(F.lit(name).alias("table_name"), "ordinal_position", "column_name", "data_type", "n_rows", "nulls", *shown, close.alias("distinct_close"))
        out = part if out is None else out.unionByName(part)
    return out


@query(
    "corpus_health",
    f"""WITH {views.DOCUMENTS}
    SELECT count(*) AS documents, 0::BIGINT AS null_content, 0::BIGINT AS blank_content,
           count(*) FILTER (e.vec_id IS NULL OR len(e.embedding) <> 64) AS wrong_dims,
           count(*) FILTER (list_dot_product(e.embedding::DOUBLE[], e.embedding::DOUBLE[]) = 0) AS zero_vectors,
           min(created_at) AS oldest, max(created_at) AS newest
    FROM docs d LEFT JOIN embeddings e ON d.id = e.vec_id""",
)
def _health(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Health of the documents with their vectors; documents without one count as wrong size."""
    corpus = views.documents(spark, sf_dir).join(views.vectors(spark, sf_dir), "id", "left")
    return corpus_health(corpus, views.VECTOR_DIMS)
