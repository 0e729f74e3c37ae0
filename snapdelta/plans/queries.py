"""Queries over the test tables, each with the SQL that checks it.

The state these queries compare with is derived from the tables: English documents are stored as they
are now, other languages but Spanish with an older text, Spanish not yet, and the benchmark items
stand for documents that have been deleted since (their keys are negative).
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from snapdelta.functions import (
    content_hash,
    display_date,
    entity_id,
    hash_of_columns,
    parent_path,
    relative_path,
    require,
    target_path,
    version_stamp,
)
from snapdelta.functions.status import COMPONENT_MISSING, RESULT
from snapdelta.operators import components, delta, versions
from snapdelta.plans import file_flows, python_stages, steps, table_flows
from snapdelta.plans.stages import Pipeline, Stage, clean, errors
from snapdelta.session import scratch_dir
from snapdelta.sources import files, log, snapshots, state

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

FIRST_RUN = dt.datetime(2024, 3, 1, 6, 30, 0)
SECOND_RUN = dt.datetime(2024, 3, 2, 6, 30, 0)
DOC = ["doc_id"]

PRIOR_SQL = """
prior AS (
    SELECT doc_id, sha256(CASE WHEN lang = 'en' THEN text ELSE text || '#v0' END) AS content_hash
    FROM documents WHERE lang <> 'es'
    UNION ALL
    SELECT -1 - item_id AS doc_id, sha256(text) AS content_hash FROM benchmark
)"""


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under its function name, with its check in SQL."""

    def register(function: Query) -> Query:
        QUERIES[function.__name__] = function
        if sql is not None:
            ORACLES[function.__name__] = sql
        return function

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def older_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents as the first run found them, deleted ones included."""
    return _known_then(spark, sf_dir).select("doc_id", "text").unionByName(_deleted(spark, sf_dir))


def _known_then(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents that the first run found and that are still there, with their older texts."""
    text = F.when(F.col("lang") == "en", F.col("text")).otherwise(F.concat("text", F.lit("#v0")))
    return table(spark, sf_dir, "documents").where("lang <> 'es'").select("doc_id", "source", text.alias("text"))


def _deleted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select((-1 - F.col("item_id")).alias("doc_id"), "text")


def prior_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The hashes stored by the first run."""
    return older_documents(spark, sf_dir).select("doc_id", content_hash("text").alias("content_hash"))


def with_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys of the documents with their present and their stored hash."""
    current = table(spark, sf_dir, "documents").select("doc_id", content_hash("text").alias("current_hash"))
    return delta.with_prior(current, prior_state(spark, sf_dir), DOC)


def labelled(spark: SparkSession, sf_dir: str, docs: DataFrame | None = None) -> DataFrame:
    """Documents as entities, with a ``label`` component where there is one."""
    docs = table(spark, sf_dir, "documents").select("doc_id") if docs is None else docs
    label = table(spark, sf_dir, "labels").select("doc_id", F.struct("quality", "toxic").alias("label"))
    return components.get_component(docs, label, DOC)


# --- Component tables -----------------------------------------------------------------------------


@query(
    """
    SELECT user_id, event_type, arg_max(value, (ts, event_id)) AS value, arg_max(event_id, (ts, event_id)) AS event_id
    FROM events GROUP BY user_id, event_type
    """
)
def q_set_component(spark: SparkSession, sf_dir: str) -> DataFrame:
    feed = table(spark, sf_dir, "events").select("user_id", "event_type", "ts", "event_id", "value")
    return components.latest(feed, ["user_id", "event_type"], ["ts", "event_id"], ["value", "event_id"])


@query(
    """
    SELECT coalesce(b.doc_id, u.doc_id) AS doc_id,
           CASE WHEN u.doc_id IS NOT NULL THEN u.lang ELSE b.lang END AS lang
    FROM (SELECT doc_id, lang FROM documents) b
    FULL JOIN (SELECT doc_id, CASE WHEN toxic = 0 THEN 'q' || quality::VARCHAR END AS lang FROM labels
               UNION ALL SELECT -1 - item_id, 'new' FROM benchmark) u ON b.doc_id = u.doc_id
    """
)
def q_upsert_component(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = table(spark, sf_dir, "documents").select("doc_id", "lang")
    rated = F.when(F.col("toxic") == 0, F.concat(F.lit("q"), F.col("quality").cast("string")))
    updates = table(spark, sf_dir, "labels").select("doc_id", rated.alias("lang"))
    number = (-1 - F.col("item_id")).alias("doc_id")
    added = table(spark, sf_dir, "benchmark").select(number, F.lit("new").alias("lang"))
    return components.upsert(base, updates.unionByName(added), DOC)


@query(
    """
    SELECT doc_id, lang, CASE WHEN n_chars > 2000 THEN 'long' WHEN lang = 'en' THEN 'english' END AS mark
    FROM documents
    """
)
def q_replace_component(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars")
    docs = components.declare(docs, {"mark": "struct<mark:string>"})
    docs = components.set_component(docs, "mark", F.struct(F.lit("english").alias("mark")), F.col("lang") == "en")
    docs = components.set_component(docs, "mark", F.struct(F.lit("long").alias("mark")), F.col("n_chars") > 2000)
    return docs.select("doc_id", "lang", "mark.mark")


@query("SELECT d.doc_id, l.quality || '/' || l.toxic AS label FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id")
def q_get_component(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id")
    label = F.format_string("%d/%d", "quality", "toxic").alias("label")
    return components.get_component(docs, table(spark, sf_dir, "labels").select("doc_id", label), DOC)


@query("SELECT d.doc_id, d.lang FROM documents d WHERE EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)")
def q_has_component(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang")
    return components.with_component(docs, table(spark, sf_dir, "labels"), DOC)


@query("SELECT d.doc_id, d.lang FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)")
def q_missing_component(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang")
    return components.missing_component(docs, table(spark, sf_dir, "labels"), DOC)


@query(
    """
    SELECT doc_id FROM documents UNION SELECT doc_id FROM labels
    UNION SELECT conv_id AS doc_id FROM conversations
    """
)
def q_list_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    talks = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc_id"))
    return components.list_entities(
        [table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), talks], DOC
    )


@query("SELECT doc_id, sha256(doc_id::VARCHAR) AS entity_id FROM documents")
def q_entity_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", entity_id("doc_id").alias("entity_id"))


@query(
    """
    SELECT sha256('/corpus/' || source) AS entity_id, '/corpus/' || source AS file_path
    FROM documents GROUP BY source
    """
)
def q_seed_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = F.concat(F.lit("/corpus/"), F.col("source"))
    seeds = components.seed_entities(table(spark, sf_dir, "documents"), folder, entity_id("_path"))
    return seeds.select("entity_id", "file_path.file_path")


# --- Stages ---------------------------------------------------------------------------------------


def _label_stage() -> Stage:
    return Stage(
        "Labels",
        [lambda df: df.withColumn(RESULT, require(components.has_component("label"), COMPONENT_MISSING))],
    )


@query(
    """
    SELECT d.doc_id, l.doc_id IS NULL AS failed, CASE WHEN l.doc_id IS NULL THEN 'Component missing.' END AS error_message
    FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id
    """
)
def q_row_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = Pipeline([_label_stage()], key=DOC).run(labelled(spark, sf_dir), distinct_input=True)
    return rows.select("doc_id", F.col("error").isNotNull().alias("failed"), "error.error_message")


def _two_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    quality, toxic = F.col("label.quality"), F.col("label.toxic")
    rules = Stage(
        "Rules",
        [
            lambda df: df.withColumn(RESULT, require(quality == 1, "Quality is low.")),
            lambda df: df.withColumn(RESULT, require(toxic.isNull() | (toxic == 0), "Toxic.")),
        ],
    )
    keep = Stage("Nothing fails here", [lambda df: df.withColumn(RESULT, require(F.lit(True), "never"))])
    return Pipeline([rules, keep], key=DOC).run(labelled(spark, sf_dir), distinct_input=True)


_TWO_RULES_SQL = """
    SELECT d.doc_id, CASE WHEN l.toxic = 1 THEN 'Toxic.'
                          WHEN l.quality IS DISTINCT FROM 1 THEN 'Quality is low.' END AS error_message
    FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id
"""


@query(_TWO_RULES_SQL)
def q_error_last_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _two_rules(spark, sf_dir).select("doc_id", "error.error_message")


@query(f"SELECT * FROM ({_TWO_RULES_SQL}) WHERE error_message IS NOT NULL")
def q_error_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return errors(_two_rules(spark, sf_dir)).select("doc_id", "error.error_message")


@query("SELECT doc_id, quality FROM labels WHERE quality = 1 AND toxic = 0")
def q_clean_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clean(_two_rules(spark, sf_dir)).select("doc_id", "label.quality")


@query(
    """
    SELECT 'doc:' || doc_id::VARCHAR AS entity_id, NULL AS file_path, NULL AS error_message FROM labels
    UNION ALL
    SELECT 'folder:' || source, source, 'Component missing.' FROM documents GROUP BY source
    """
)
def q_entity_refresh(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.concat(F.lit("doc:"), F.col("doc_id").cast("string")).alias("entity_id")
    docs = labelled(spark, sf_dir).select(name, "label")
    # Labelled documents are given twice, and unlabelled ones have no component at all.
    given = docs.unionByName(docs.where("label is not null"))

    def folders(_: DataFrame) -> DataFrame:
        source = table(spark, sf_dir, "documents").select("source").distinct()
        path = F.struct(F.col("source").alias("file_path")).alias("file_path")
        return source.select(F.concat(F.lit("folder:"), "source").alias("entity_id"), path)

    rows = Pipeline([Stage("Folders", generators=[folders]), _label_stage()]).run(given)
    return rows.select("entity_id", "file_path.file_path", "error.error_message")


@query(
    """
    SELECT l.doc_id, l.quality, CASE WHEN l.toxic = 1 THEN 'first' END AS first_stage, 'second' AS second_stage
    FROM labels l
    """
)
def q_stored_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels")
    storage = labels.select("doc_id", F.struct("quality", "toxic").alias("label"))

    def mark(name: str) -> Stage:
        def transform(df: DataFrame) -> DataFrame:
            return components.set_component(df, name, F.struct(F.lit(name).alias("mark")))

        return Stage(name, [transform], components={name: "struct<mark:string>"})

    given = labels.where("toxic = 1").select("doc_id")
    rows = Pipeline([mark("first"), mark("second")], key=DOC).run(given, storage)
    return rows.select(
        "doc_id", "label.quality", F.col("first.mark").alias("first_stage"), F.col("second.mark").alias("second_stage")
    )


@query(
    f"""
    WITH {PRIOR_SQL}
    SELECT d.doc_id, sha256(d.text) AS current_hash, p.content_hash AS previous_hash,
           CASE WHEN sha256(d.text) IS DISTINCT FROM p.content_hash THEN '20240302063000' END AS version,
           CASE WHEN l.doc_id IS NULL THEN 'Component missing.' END AS error_message
    FROM documents d LEFT JOIN prior p ON d.doc_id = p.doc_id LEFT JOIN labels l ON d.doc_id = l.doc_id
    """
)
def q_stage_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    hashed = table(spark, sf_dir, "documents").select("doc_id", content_hash("text").alias("current_hash"))
    stages = [
        _label_stage(),
        Stage(
            steps.HASHING,
            [table_flows.look_up(prior_state(spark, sf_dir), DOC)],
            components=steps.component_types("file_hash"),
        ),
        Stage(
            steps.DECISION,
            [steps.decide(("file_hash",), SECOND_RUN)],
            components=steps.component_types("backup_date"),
        ),
    ]
    rows = Pipeline(stages, key=DOC).run(labelled(spark, sf_dir, hashed), distinct_input=True)
    return rows.select(
        "doc_id", "file_hash.*", version_stamp(F.col("backup_date.backup_date")).alias("version"), "error.error_message"
    )


# --- Change detection -----------------------------------------------------------------------------


@query("SELECT doc_id, sha256(text) AS content_hash FROM documents")
def q_content_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", content_hash("text").alias("content_hash"))


@query(
    """
    SELECT l_orderkey, l_linenumber, sha256(
        length(l_partkey::VARCHAR) || ':' || l_partkey || ';' || length(l_suppkey::VARCHAR) || ':' || l_suppkey || ';' ||
        length(l_quantity::DECIMAL(18,2)::VARCHAR) || ':' || l_quantity::DECIMAL(18,2) || ';' ||
        length(l_extendedprice::DECIMAL(18,2)::VARCHAR) || ':' || l_extendedprice::DECIMAL(18,2) || ';' ||
        length(l_returnflag) || ':' || l_returnflag || ';' || length(l_linestatus) || ':' || l_linestatus || ';'
    ) AS content_hash FROM lineitem
    """
)
def q_row_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    money = [F.col(c).cast("decimal(18,2)") for c in ("l_quantity", "l_extendedprice")]
    row = content_hash("l_partkey", "l_suppkey", *money, "l_returnflag", "l_linestatus")
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", row.alias("content_hash"))


@query(
    f"""
    WITH {PRIOR_SQL}
    SELECT d.doc_id, sha256(d.text) AS current_hash, p.content_hash AS previous_hash
    FROM documents d LEFT JOIN prior p ON d.doc_id = p.doc_id
    """
)
def q_prior_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_hashes(spark, sf_dir)


@query(
    """
    SELECT d.doc_id, l.doc_id IS NOT NULL AS is_success,
           CASE WHEN l.doc_id IS NULL THEN 'Required components missing.' END AS error_message
    FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id
    """
)
def q_required_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = labelled(spark, sf_dir)
    status = require(components.has_component("doc_id", "label"), "Required components missing.")
    return rows.withColumn(RESULT, status).select("doc_id", f"{RESULT}.*")


@query(
    f"""
    WITH {PRIOR_SQL}
    SELECT d.doc_id, sha256(d.text) AS current_hash
    FROM documents d LEFT JOIN prior p ON d.doc_id = p.doc_id
    WHERE p.content_hash IS DISTINCT FROM sha256(d.text)
    """
)
def q_changed(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = with_hashes(spark, sf_dir)
    return rows.where(delta.changed(F.col("current_hash"), F.col("previous_hash"))).select("doc_id", "current_hash")


@query(
    """
    WITH before AS (SELECT conv_id, turn, CASE WHEN role = 'user' THEN sha256(text) ELSE sha256(text || '?') END AS h
                    FROM conversations WHERE turn > 0)
    SELECT c.conv_id, c.turn, sha256(c.text) AS current_hash
    FROM conversations c LEFT JOIN before b ON b.conv_id = c.conv_id AND b.turn = c.turn
    WHERE b.h IS DISTINCT FROM sha256(c.text)
    """
)
def q_changed_composite_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations")
    text = F.when(F.col("role") == "user", F.col("text")).otherwise(F.concat("text", F.lit("?")))
    before = turns.where("turn > 0").select("conv_id", "turn", content_hash(text).alias("content_hash"))
    current = turns.select("conv_id", "turn", content_hash("text").alias("current_hash"))
    rows = delta.with_prior(current, before, ["conv_id", "turn"])
    differs = delta.changed(F.col("current_hash"), F.col("previous_hash"))
    return rows.where(differs).select("conv_id", "turn", "current_hash")


@query(
    f"""
    WITH {PRIOR_SQL}
    SELECT d.doc_id, '2024-03-02 06:30:00' AS backup_date
    FROM documents d LEFT JOIN prior p ON d.doc_id = p.doc_id
    WHERE p.content_hash IS DISTINCT FROM sha256(d.text)
    """
)
def q_stamp_changed(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = with_hashes(spark, sf_dir).select("doc_id", F.struct("current_hash", "previous_hash").alias("file_hash"))
    stamped = steps.decide(("file_hash",), SECOND_RUN)(rows).where(components.has_component("backup_date"))
    return stamped.select("doc_id", display_date(F.col("backup_date.backup_date")).alias("backup_date"))


@query(
    f"""
    WITH {PRIOR_SQL}, changed AS (
        SELECT d.doc_id, sha256(d.text) AS content_hash
        FROM documents d LEFT JOIN prior p ON d.doc_id = p.doc_id
        WHERE p.content_hash IS DISTINCT FROM sha256(d.text))
    SELECT coalesce(c.doc_id, p.doc_id) AS doc_id, coalesce(c.content_hash, p.content_hash) AS content_hash
    FROM prior p FULL JOIN changed c ON p.doc_id = c.doc_id
    """
)
def q_state_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    changed = q_changed(spark, sf_dir).withColumnRenamed("current_hash", "content_hash")
    return delta.merge_state(prior_state(spark, sf_dir), changed, DOC)


# --- Feeds and Python stages ----------------------------------------------------------------------


_KINDS = ("click", "error", "purchase", "signup")


@query(
    f"""
    WITH last AS (
        SELECT user_id, event_type, arg_max(event_id, (ts, event_id)) AS event_id, arg_max(value, (ts, event_id)) AS value
        FROM events GROUP BY user_id, event_type
    ),
    held AS (
        SELECT *, event_type = 'error' AND event_id % 2 = 1 AS malformed FROM last
        WHERE event_type <> 'view' AND NOT (event_type = 'signup' AND event_id % 2 = 0)
    )
    SELECT user_id, {", ".join(f"max(event_id) FILTER (event_type = '{k}' AND NOT malformed) AS {k}_event, "
                               f"max(value) FILTER (event_type = '{k}' AND NOT malformed) AS {k}_value" for k in _KINDS)},
           CASE WHEN bool_or(malformed) THEN 'Component malformed: error_seen' END AS error_message
    FROM held GROUP BY user_id
    """
)
def q_component_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as writes of JSON components in any order: some take theirs away, some are malformed, views are not declared."""
    events = table(spark, sf_dir, "events")
    payload = (
        F.when((F.col("event_type") == "error") & (F.col("event_id") % 2 == 1), F.concat(F.lit("{value: "), F.col("event_id")))
        .when((F.col("event_type") == "signup") & (F.col("event_id") % 2 == 0), F.lit("null"))
        .otherwise(F.to_json(F.struct(F.col("event_id").alias("event"), "value")))
    )
    kind = F.concat("event_type", F.lit("_seen"))
    feed = events.select("user_id", "ts", "event_id", kind.alias("component_type"), payload.alias("payload"))
    declared = {f"{k}_seen": "struct<event:bigint,value:double>" for k in _KINDS}
    wide = components.from_feed(feed, ["user_id"], declared, ("ts", "event_id"))
    fields = [F.col(f"{k}_seen.{field}").alias(f"{k}_{field}") for k in _KINDS for field in ("event", "value")]
    return wide.select("user_id", *fields, "error.error_message")


@query(
    """
    WITH parts AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents)
    SELECT doc_id::VARCHAR AS entity_id, len(lines)::BIGINT AS n_lines, NULL::BIGINT AS number, NULL::BIGINT AS n_chars,
           CASE WHEN len(lines) = 1 THEN 'Text is a single line.' END AS error_message
    FROM parts
    UNION ALL
    SELECT doc_id || '/' || i, NULL, i, length(lines[i + 1]), CASE WHEN lines[i + 1] = '' THEN 'Line is empty.' END
    FROM (SELECT doc_id, lines, unnest(range(len(lines))) AS i FROM parts)
    """
)
def q_python_stages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Plain Python logic on every document, and a table function that makes an entity of each of its lines."""

    def shape(row):
        n = row["text"].count("\n") + 1
        found = {"shape": {"n_lines": n}}
        return found if n > 1 else python_stages.Failed("Text is a single line.", found)

    def lines(row):
        for number, line in enumerate(row["text"].split("\n")):
            made = {"entity_id": f"{row['entity_id']}/{number}", "line": {"number": number, "n_chars": len(line)}}
            yield made if line else made | {"error": {"error_message": "Line is empty."}}

    types = {"shape": "struct<n_lines:bigint>", "line": "struct<number:bigint,n_chars:bigint>"}
    reads = ["entity_id", "text"]
    made = f"entity_id string, line {types['line']}, error struct<error_message:string>"
    docs = table(spark, sf_dir, "documents")
    docs = docs.select(F.col("doc_id").cast("string").alias("entity_id"), F.coalesce("text", F.lit("")).alias("text"))
    stage = Stage(
        "Lines",
        [python_stages.row_transform(shape, ["text"], {"shape": types["shape"]})],
        generators=[python_stages.entity_maker(lines, reads, made)],
        components=types,
    )
    rows = Pipeline([stage]).run(docs, distinct_input=True)
    return rows.select("entity_id", "shape.n_lines", "line.number", "line.n_chars", "error.error_message")


# --- Paths, stamps and versions -------------------------------------------------------------------


@query(
    """
    SELECT page_id,
           regexp_replace(url, '^https?://[^/]+/', '') AS below,
           '../../' || regexp_replace(url, '^https?://[^/]+/', '') AS beside,
           CASE WHEN url = regexp_extract(url, '^(.*)/[^/]*$', 1) THEN '.' ELSE regexp_extract(url, '/([^/]*)$', 1) END AS own
    FROM pages
    """
)
def q_relative_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    url = F.col("url")
    site = F.regexp_extract(url, "^(https?://[^/]+)/", 1)
    return table(spark, sf_dir, "pages").select(
        "page_id",
        relative_path(url, site).alias("below"),
        relative_path(url, F.concat(site, F.lit("/archive/2024"))).alias("beside"),
        relative_path(url, parent_path(url)).alias("own"),
    )


@query("SELECT event_id, strftime(ts, '%Y%m%d%H%M%S') AS version, strftime(ts, '%Y-%m-%d %H:%M:%S') AS line FROM events")
def q_version_stamp(spark: SparkSession, sf_dir: str) -> DataFrame:
    ts = F.col("ts")
    return table(spark, sf_dir, "events").select(
        "event_id", version_stamp(ts).alias("version"), display_date(ts).alias("line")
    )


@query(
    """
    SELECT page_id, '/backup/20240302063000/' || regexp_replace(url, '^https?://[^/]+/', '') AS target,
           regexp_extract('/backup/20240302063000/' || regexp_replace(url, '^https?://[^/]+/', ''), '^(.*)/[^/]*$', 1) AS folder
    FROM pages
    """
)
def q_target_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    url = F.col("url")
    relative = relative_path(url, F.regexp_extract(url, "^(https?://[^/]+)/", 1))
    stamp = version_stamp(F.lit(SECOND_RUN))
    target = target_path("/backup/", stamp, relative)
    return table(spark, sf_dir, "pages").select("page_id", target.alias("target"), parent_path(target).alias("folder"))


def _days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A version log with one date per day that has events."""
    day = F.to_date("ts").cast("timestamp").alias("backup_date")
    return table(spark, sf_dir, "events").select(day).distinct()


@query(
    """
    SELECT strftime(d, '%Y-%m-%d %H:%M:%S') AS line
    FROM (SELECT date_trunc('day', ts) AS d FROM events UNION SELECT date_trunc('day', o_orderdate) FROM orders)
    """
)
def q_log_add(spark: SparkSession, sf_dir: str) -> DataFrame:
    ordered = table(spark, sf_dir, "orders").select(F.to_date("o_orderdate").cast("timestamp").alias("backup_date"))
    return versions.log_add(_days(spark, sf_dir), ordered).select(display_date(F.col("backup_date")).alias("line"))


@query(
    """
    SELECT row_number() OVER (ORDER BY ts DESC) AS position, strftime(ts, '%Y-%m-%d %H:%M:%S') AS line
    FROM (SELECT DISTINCT ts FROM events)
    """
)
def q_versions_desc(spark: SparkSession, sf_dir: str) -> DataFrame:
    dates = table(spark, sf_dir, "events").select(F.col("ts").alias("backup_date"))
    return versions.version_lines(dates).select("position", "line")


@query(
    """
    SELECT string_agg(strftime(d, '%Y-%m-%d %H:%M:%S'), ', ' ORDER BY d DESC) AS dates
    FROM (SELECT DISTINCT date_trunc('day', ts) AS d FROM events)
    """
)
def q_versions_component(spark: SparkSession, sf_dir: str) -> DataFrame:
    listed = versions.versions_component(_days(spark, sf_dir))
    lines = F.transform("backup_dates.dates", lambda date: display_date(date))
    return listed.select(F.array_join(lines, ", ").alias("dates"))


@query("SELECT strftime(max(ts), '%Y%m%d%H%M%S') AS version, CAST(NULL AS VARCHAR) AS error_message FROM events")
def q_latest_version(spark: SparkSession, sf_dir: str) -> DataFrame:
    newest = versions.latest_version(table(spark, sf_dir, "events").select(F.col("ts").alias("backup_date")))
    return newest.select(version_stamp(F.col("backup_date")).alias("version"), f"{RESULT}.error_message")


@query(
    """
    WITH days AS (SELECT DISTINCT date_trunc('day', ts) AS d FROM events)
    SELECT strftime(d + INTERVAL 1 DAY, '%Y%m%d%H%M%S') AS version,
           CASE WHEN d + INTERVAL 1 DAY NOT IN (SELECT d FROM days) THEN 'Backup date not found.' END AS error_message
    FROM days
    """
)
def q_missing_version(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = F.col("backup_date")
    stored = _days(spark, sf_dir)
    requests = stored.select(version_stamp(day + F.expr("INTERVAL 1 DAY")).alias("version"))
    checked = versions.check_versions(requests, stored.select(version_stamp(day).alias("version")))
    return checked.select("version", f"{RESULT}.error_message")


def _events_by_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as files: the day is the version, the user the path, and (ts, event_id) the order."""
    version = version_stamp(F.to_date("ts").cast("timestamp")).alias("version")
    return table(spark, sf_dir, "events").select(version, "user_id", "ts", "event_id", "value")


@query(
    """
    SELECT strftime(date_trunc('day', ts), '%Y%m%d%H%M%S') AS version, user_id, arg_max(event_id, (ts, event_id)) AS event_id,
           arg_max(value, (ts, event_id)) AS value
    FROM events GROUP BY 1, 2
    """
)
def q_last_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = versions.last_wins(_events_by_day(spark, sf_dir), ["version", "user_id"], ["ts", "event_id"])
    return rows.select("version", "user_id", "event_id", "value")


@query(
    """
    SELECT user_id, arg_max(event_id, (ts, event_id)) AS event_id
    FROM events WHERE date_trunc('day', ts) = (SELECT max(date_trunc('day', ts)) FROM events) GROUP BY user_id
    """
)
def q_restore_latest_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _events_by_day(spark, sf_dir)
    # The newest version is one row: an aggregate without groups.
    newest = F.broadcast(rows.agg(F.max("version").alias("version")))
    restored = rows.join(newest, "version", "left_semi")
    return versions.last_wins(restored, ["version", "user_id"], ["ts", "event_id"]).select("user_id", "event_id")


# --- Stores and flows -----------------------------------------------------------------------------


@query("SELECT doc_id, text, lang, sha256(text) AS content_hash, '20240301063000' AS version FROM documents")
def q_versioned_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = scratch_dir(spark, "roundtrip")
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    table_flows.backup_table(spark, docs, DOC, ["text"], store, FIRST_RUN)
    return table_flows.restore_table(spark, store, FIRST_RUN, DOC).rows


@query(
    """
    SELECT doc_id, text, 'mine' AS content_hash, source AS version FROM documents
    """
)
def q_roundtrip_reserved_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = scratch_dir(spark, "reserved")
    docs = table(spark, sf_dir, "documents")
    docs = docs.select("doc_id", "text", F.lit("mine").alias("content_hash"), F.col("source").alias("version"))
    table_flows.backup_table(spark, docs, DOC, ["text"], store, FIRST_RUN)
    return table_flows.restore_table(spark, store, FIRST_RUN, DOC).rows


@query(
    """
    SELECT doc_id, len(string_split(text, chr(10))) AS lines FROM documents
    WHERE lang <> 'en' AND string_split(text, chr(10)) IS DISTINCT FROM [text]
    """
)
def q_changed_nested(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts as arrays of lines against the same texts as arrays of one."""
    docs = table(spark, sf_dir, "documents").withColumn("lines", F.split("text", "\n"))
    before = docs.withColumn("lines", F.when(F.col("lang") == "en", F.col("lines")).otherwise(F.array("text")))
    hashed = docs.select("doc_id", F.size("lines").cast("long").alias("lines"), hash_of_columns(docs, ["lines"]).alias("current_hash"))
    known = before.select("doc_id", hash_of_columns(before, ["lines"]).alias("content_hash"))
    rows = delta.with_prior(hashed, known, DOC)
    return rows.where(delta.changed(F.col("current_hash"), F.col("previous_hash"))).select("doc_id", "lines")


@query(
    """
    SELECT doc_id, CASE WHEN source = 'src0' OR lang = 'fr' THEN 'again' ELSE lang END AS lang, '20240301063000' AS version
    FROM documents
    """
)
def q_same_version_overwrite(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = scratch_dir(spark, "overwrite")
    docs = table(spark, sf_dir, "documents")
    snapshots.write_version(spark, store, "20240301063000", docs.select("doc_id", "lang"))
    again = docs.where("source = 'src0' or lang = 'fr'").select("doc_id", F.lit("again").alias("lang"))
    snapshots.write_version(spark, store, "20240301063000", again)
    return snapshots.read_version(spark, store, "20240301063000", DOC)


@query(
    f"""
    WITH {PRIOR_SQL}
    SELECT doc_id, sha256(text) AS content_hash FROM documents
    UNION ALL SELECT doc_id, content_hash FROM prior WHERE doc_id < 0
    """
)
def q_state_generations(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = scratch_dir(spark, "state")
    key = [T.StructField("doc_id", T.LongType())]
    state.save_state(spark, store, prior_state(spark, sf_dir), key)
    stored = state.load_state(spark, store, key)
    current = table(spark, sf_dir, "documents").select("doc_id", content_hash("text").alias("current_hash"))
    rows = delta.with_prior(current, stored, DOC)
    rows = rows.where(delta.changed(F.col("current_hash"), F.col("previous_hash")))
    state.save_state(spark, store, rows.withColumnRenamed("current_hash", "content_hash"), key)
    return state.load_state(spark, store, key)


@query(f"WITH {PRIOR_SQL} SELECT doc_id::VARCHAR AS key, content_hash FROM prior")
def q_state_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = scratch_dir(spark, "state-json")
    rows = prior_state(spark, sf_dir).select(F.col("doc_id").cast("string").alias("path"), "content_hash")
    state.save_state(spark, f"{base}/old/state", rows, file_flows.STATE_KEY)
    return state.load_state(spark, f"{_handed_over(spark, base)}/state", file_flows.STATE_KEY).withColumnRenamed("path", "key")


def _handed_over(spark: SparkSession, base: str) -> str:
    """The store ``old`` exported as many documents and one more time as one, and imported again."""
    for source, goal, entries in (("old", "half", 50), ("half", "new", 10_000_000)):
        hashes, dates = f"{base}/{goal}-hashes", f"{base}/{goal}-dates"
        file_flows.export_store(spark, f"{base}/{source}", hashes, dates, entries)
        file_flows.import_store(spark, hashes, dates, f"{base}/{goal}")
    return f"{base}/new"


@query("SELECT DISTINCT strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS line FROM orders")
def q_log_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = scratch_dir(spark, "log-json")
    dates = table(spark, sf_dir, "orders").select(F.col("o_orderdate").cast("timestamp").alias("backup_date"))
    log.append_log(spark, f"{base}/old/log", dates)
    handed = log.load_log(spark, f"{_handed_over(spark, base)}/log")
    return handed.select(display_date(F.col("backup_date")).alias("line"))


@query(
    """
    SELECT DISTINCT strftime(d, '%Y-%m-%d %H:%M:%S') AS line
    FROM (SELECT date_trunc('day', ts) AS d FROM events UNION ALL SELECT o_orderdate FROM orders)
    """
)
def q_log_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = scratch_dir(spark, "log")
    dates = table(spark, sf_dir, "orders").select(F.col("o_orderdate").cast("timestamp").alias("backup_date"))
    for part in (_days(spark, sf_dir), dates):
        log.append_log(spark, store, part)
    return log.load_log(spark, store).select(display_date(F.col("backup_date")).alias("line"))


def _two_runs(spark: SparkSession, sf_dir: str) -> tuple[str, DataFrame]:
    """A store with a run over the older documents and one over the present ones."""
    store = scratch_dir(spark, "backup")
    table_flows.backup_table(spark, older_documents(spark, sf_dir), DOC, ["text"], store, FIRST_RUN)
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return store, table_flows.backup_table(spark, docs, DOC, ["text"], store, SECOND_RUN)


@query(
    f"""
    WITH {PRIOR_SQL}
    SELECT d.doc_id, sha256(d.text) AS current_hash, p.content_hash AS previous_hash,
           CASE WHEN p.content_hash IS DISTINCT FROM sha256(d.text) THEN '20240302063000' END AS version,
           CAST(NULL AS VARCHAR) AS error_message
    FROM documents d LEFT JOIN prior p ON d.doc_id = p.doc_id
    """
)
def q_backup(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, report = _two_runs(spark, sf_dir)
    return report.select(
        "doc_id", "file_hash.*", version_stamp(F.col("backup_date.backup_date")).alias("version"), "error.error_message"
    )


@query(
    """
    SELECT row_number() OVER (ORDER BY d DESC) AS position, strftime(d, '%Y-%m-%d %H:%M:%S') AS line
    FROM (SELECT DISTINCT date_trunc('day', ts) AS d FROM events)
    """
)
def q_query_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = scratch_dir(spark, "versions")
    log.append_log(spark, f"{store}/log", _days(spark, sf_dir))
    return steps.query_versions(spark, store).select("position", "line")


@query(
    """
    SELECT doc_id, CASE WHEN lang = 'en' THEN text ELSE text || '#v0' END AS text FROM documents WHERE lang <> 'es'
    UNION ALL SELECT -1 - item_id, text FROM benchmark
    """
)
def q_restore_version(spark: SparkSession, sf_dir: str) -> DataFrame:
    store, _ = _two_runs(spark, sf_dir)
    return table_flows.restore_table(spark, store, FIRST_RUN, DOC).rows.select("doc_id", "text")


@query("SELECT doc_id, text, '20240302063000' AS version FROM documents WHERE lang <> 'en'")
def q_restore_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    store, _ = _two_runs(spark, sf_dir)
    return table_flows.restore_latest_table(spark, store, DOC).rows.select("doc_id", "text", "version")


@query(
    """
    SELECT doc_id, text FROM documents UNION ALL SELECT -1 - item_id, text FROM benchmark
    """
)
def q_restore_over(spark: SparkSession, sf_dir: str) -> DataFrame:
    store, _ = _two_runs(spark, sf_dir)
    first = table_flows.restore_table(spark, store, FIRST_RUN, DOC).rows
    last = table_flows.restore_latest_table(spark, store, DOC).rows
    return table_flows.put_over(first.select("doc_id", "text"), last, DOC)


@query(
    """
    SELECT doc_id, text FROM documents UNION ALL SELECT -1 - item_id, text FROM benchmark
    """
)
def q_restore_into(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last version put into a stored table that holds the first, of which only the files concerned are written anew."""
    store, _ = _two_runs(spark, sf_dir)
    target = f"{store}/target"
    table_flows.restore_table(spark, store, FIRST_RUN, DOC).rows.select("doc_id", "text").write.parquet(target)
    table_flows.restore_into(spark, target, table_flows.restore_latest_table(spark, store, DOC).rows, DOC)
    return spark.read.parquet(target)


@query(
    """
    WITH days AS (SELECT strftime(date_trunc('day', ts) + INTERVAL 6 HOUR, '%Y%m%d%H%M%S') AS version FROM events)
    SELECT min(version) AS version, CAST(NULL AS VARCHAR) AS error_message FROM days
    UNION ALL SELECT '19990101000000', 'Backup date not found.'
    """
)
def q_restore_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The entity tables of a restore that finds its version and of one that does not."""
    store, _ = _two_event_runs(spark, sf_dir)
    first = snapshots.stored_versions(spark, f"{store}/versions")[0]
    tables = [table_flows.restore_table(spark, store, v, ["event_id"]).entities for v in (first, "19990101000000")]
    version = F.regexp_extract("file_path.file_path", "([^/]+)$", 1)
    return tables[0].unionByName(tables[1]).select(version.alias("version"), "error.error_message")


def _two_event_runs(spark: SparkSession, sf_dir: str) -> tuple[str, DataFrame]:
    """A store of events in which each has its own day, six in the morning, as stamp: first those with even ids, then all."""
    store = scratch_dir(spark, "stamped")
    stamp = (F.to_date("ts").cast("timestamp") + F.expr("INTERVAL 6 HOURS")).alias("day")
    events = table(spark, sf_dir, "events").select("event_id", "user_id", "value", stamp)
    key, content = ["event_id"], ["user_id", "value"]
    table_flows.backup_table(spark, events.where("event_id % 2 = 0"), key, content, store, FIRST_RUN, stamp_col="day")
    return store, table_flows.backup_table(spark, events, key, content, store, SECOND_RUN, stamp_col="day")


@query(
    """
    SELECT row_number() OVER (ORDER BY d DESC) AS position, strftime(d, '%Y-%m-%d %H:%M:%S') AS line
    FROM (SELECT DISTINCT date_trunc('day', ts) + INTERVAL 6 HOUR AS d FROM events)
    """
)
def q_stamped_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    store, _ = _two_event_runs(spark, sf_dir)
    return steps.query_versions(spark, store).select("position", "line")


@query(
    """
    WITH days AS (SELECT *, date_trunc('day', ts) + INTERVAL 6 HOUR AS d FROM events)
    SELECT event_id, user_id, value, strftime(d, '%Y%m%d%H%M%S') AS version FROM days WHERE d = (SELECT max(d) FROM days)
    """
)
def q_restore_stamped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest version, to which both runs wrote."""
    store, _ = _two_event_runs(spark, sf_dir)
    return table_flows.restore_latest_table(spark, store, ["event_id"]).rows.select("event_id", "user_id", "value", "version")


@query(
    """
    SELECT event_id, CASE WHEN event_id % 2 = 1 THEN strftime(date_trunc('day', ts), '%Y%m%d') || '060000' END AS version FROM events
    """
)
def q_backup_stamped(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, report = _two_event_runs(spark, sf_dir)
    return report.select("event_id", version_stamp(F.col("backup_date.backup_date")).alias("version"))


@query(
    """
    SELECT doc_id, (SELECT count(DISTINCT date_trunc('day', ts)) FROM events) AS n_dates,
           (SELECT strftime(max(date_trunc('day', ts)), '%Y-%m-%d %H:%M:%S') FROM events) AS newest,
           (SELECT strftime(min(date_trunc('day', ts)), '%Y-%m-%d %H:%M:%S') FROM events) AS oldest, 0 AS n_of_none
    FROM documents JOIN labels USING (doc_id)
    """
)
def q_versions_on_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The list of versions as a component of every entity, by a pipeline of one stage; and the list of an empty log."""
    entities = labelled(spark, sf_dir).where(components.has_component("label"))
    days = _days(spark, sf_dir)
    listed = Pipeline([steps.list_versions(days)], key=DOC).run(entities, distinct_input=True)
    listed = listed.withColumnRenamed("backup_dates", "all_dates")
    listed = Pipeline([steps.list_versions(days.limit(0))], key=DOC).run(listed, distinct_input=True)
    dates = F.col("all_dates.dates")
    return listed.select(
        "doc_id", F.size(dates).cast("long").alias("n_dates"), display_date(dates[0]).alias("newest"),
        display_date(F.element_at(dates, -1)).alias("oldest"), F.size("backup_dates.dates").alias("n_of_none"),
    )


# --- File trees -----------------------------------------------------------------------------------


def _as_files(rows: DataFrame) -> DataFrame:
    """Rows with a relative path: documents by source and id, deleted ones in a hidden folder."""
    folder = F.coalesce(F.col("source"), F.lit(".deleted"))
    name = F.concat(folder, F.lit("/"), F.col("doc_id").cast("string"), F.lit(".txt"))
    return rows.select(name.alias("file"), "text")


_FILE_SQL = "source || '/' || doc_id || '.txt'"


def write_tree(rows: DataFrame, root: str) -> str:
    written = files.write_texts(_as_files(rows), root, "file", "text", f"{root}.staging")
    failed = written.agg(F.count("error")).first()[0]
    if failed:
        raise OSError(f"{failed} files not written below {root}")
    return root


def older_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The older documents with the source of each document of their key, NULL for deleted ones.

    A key that occurs once has the source of its own row. Only rows whose keys occur again are joined, so texts need no shuffle.
    """
    sources = table(spark, sf_dir, "documents").select("doc_id", "source")
    deleted = _deleted(spark, sf_dir)
    own = F.when(F.col("doc_id").isNotNull(), F.col("source")).alias("source")
    older = _known_then(spark, sf_dir).select("doc_id", own, "text").unionByName(deleted, allowMissingColumns=True)
    again = sources.select("doc_id").unionByName(deleted.select("doc_id")).groupBy("doc_id").count().where("count > 1")
    # Written, so that Spark knows their size when it plans the joins.
    path = scratch_dir(spark, "keys")
    again.where("doc_id IS NOT NULL").select("doc_id").write.parquet(path)
    again = spark.read.schema(again.select("doc_id").schema).parquet(path)
    if again.isEmpty():
        return older
    joined = older.drop("source").join(again, DOC, "left_semi").join(sources, DOC, "left")
    return older.join(again, DOC, "left_anti").unionByName(joined)


def _two_file_runs(spark: SparkSession, sf_dir: str) -> tuple[str, DataFrame]:
    """A file tree backed up twice: with the older documents, and with the present ones written over."""
    base = files.posix(scratch_dir(spark, "files"))
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    tree = write_tree(older_sources(spark, sf_dir), f"{base}/tree")
    file_flows.backup_files(spark, tree, f"{base}/versions", f"{base}/store", FIRST_RUN)
    write_tree(docs, tree)
    return base, file_flows.backup_files(spark, tree, f"{base}/versions", f"{base}/store", SECOND_RUN)


@query(f"SELECT {_FILE_SQL} AS file, strlen(text)::BIGINT AS size, sha256(text) AS sha256 FROM documents")
def q_file_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    tree = write_tree(docs, files.posix(scratch_dir(spark, "tree")))
    found = files.inventory(spark, tree)
    return found.select(relative_path(F.col("path"), tree).alias("file"), "size", "sha256")


@query(
    f"""
    SELECT {_FILE_SQL} AS file, sha256(text) AS current_hash,
           CASE WHEN lang = 'en' THEN sha256(text) WHEN lang <> 'es' THEN sha256(text || '#v0') END AS previous_hash,
           CASE WHEN lang <> 'en' THEN '20240302063000' END AS version, CAST(NULL AS VARCHAR) AS error_message
    FROM documents
    UNION ALL
    SELECT '.deleted/' || (-1 - item_id) || '.txt', sha256(text), sha256(text), NULL, NULL FROM benchmark
    UNION ALL
    SELECT '.', NULL, NULL, NULL, 'Required components missing.'
    """
)
def q_backup_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    base, report = _two_file_runs(spark, sf_dir)
    return report.select(
        relative_path(F.col("file_path.file_path"), f"{base}/tree").alias("file"),
        "file_hash.*",
        version_stamp(F.col("backup_date.backup_date")).alias("version"),
        "error.error_message",
    )


@query(f"SELECT {_FILE_SQL} AS file, sha256(text) AS sha256 FROM documents WHERE lang <> 'en'")
def q_restore_latest_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    base, _ = _two_file_runs(spark, sf_dir)
    target = f"{base}/restored"
    file_flows.restore_latest_files(spark, f"{base}/store", f"{base}/versions", target)
    return files.inventory(spark, target).select(relative_path(F.col("path"), target).alias("file"), "sha256")


@query(
    f"""
    SELECT {_FILE_SQL} AS file, sha256(text) AS sha256 FROM documents
    UNION ALL SELECT '.deleted/' || (-1 - item_id) || '.txt', sha256(text) FROM benchmark
    """
)
def q_restore_files_over(spark: SparkSession, sf_dir: str) -> DataFrame:
    base, _ = _two_file_runs(spark, sf_dir)
    files.remove_tree(spark, f"{base}/tree")
    target = f"{base}/restored"
    for run in (FIRST_RUN, SECOND_RUN):
        file_flows.restore_files(spark, f"{base}/versions", run, target)
    return files.inventory(spark, target).select(relative_path(F.col("path"), target).alias("file"), "sha256")
