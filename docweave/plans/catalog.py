"""Registered queries: every operator run over the test tables, with a DuckDB twin.

Each query takes ``(spark, sf_dir)`` and returns a DataFrame over the whole
tables; ``ORACLES`` holds the equivalent SQL over the same tables.  Results
are typed columns (no JSON text: number printing and key order differ
between engines), and every computed column carries the same alias in both.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docweave.functions.documents import as_documents, typed_from_documents
from docweave.functions.paths import get_field, has_field
from docweave.functions.predicates import Cond
from docweave.functions.sizing import spread
from docweave.operators.enrich import (enrich, enrich_from_table, short_code,
                                       short_code_collisions)
from docweave.operators.filter import filter_docs
from docweave.operators.reshape import (add_field, flatten_doc, remove_field, rename_field,
                                        set_entity, trim)
from docweave.operators.routing import fan_out, merge, partition
from docweave.operators.split import branch, branch_exists, branch_fields, split
from docweave.operators.user import flat_map_docs
from docweave.plans.dataflow import Dataflow
from docweave.session import scratch_path
from docweave.streaming.keyed import configure_state, keyed_ticks, new_items_keyed
from docweave.streaming.runner import new_items_stream, run_stream, stream_table
from docweave.sinks.writers import log_sink
from docweave.sinks.payloads import (bars_payload, boxes_payload, map_payload,
                                     message_payload, timeline_payload)
from docweave.sources.envelope import (classify_documents, decode_envelope, from_envelope,
                                       parse_documents, split_malformed, to_envelope,
                                       with_documents)
from docweave.sources.custom import source_from_function
from docweave.sources.feeds import new_items, parse_feed, snapshot_diff
from docweave.sources.social import sample_stream, track_keywords

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def deco(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql.strip()
        return fn
    return deco


def table(spark: SparkSession, sf_dir: str, name: str, heavy: bool = False) -> DataFrame:
    """A test table; ``heavy=True`` spreads a narrow scan before CPU-heavy per-row work."""
    df = spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
    return spread(df) if heavy else df


# --- filter (F1-F19) --------------------------------------------------------------

@query("filter_permit_all", """
SELECT * FROM events WHERE event_type = 'purchase' AND value > 100""")
def q_filter_permit_all(spark, sf):
    return filter_docs(table(spark, sf, "events"),
                       [Cond("event_type", "==", "purchase"), Cond("value", ">", "100")])


@query("filter_permit_any", """
SELECT * FROM events WHERE event_type = 'purchase' OR value > 300""")
def q_filter_permit_any(spark, sf):
    return filter_docs(table(spark, sf, "events"),
                       [Cond("event_type", "==", "purchase"), Cond("value", ">", "300")],
                       match="any")


@query("filter_block_all", """
SELECT * FROM events WHERE NOT coalesce(event_type = 'purchase' AND value > 100, false)""")
def q_filter_block_all(spark, sf):
    return filter_docs(table(spark, sf, "events"),
                       [Cond("event_type", "==", "purchase"), Cond("value", ">", "100")],
                       action="block")


@query("filter_block_any", """
SELECT * FROM events WHERE NOT coalesce(event_type = 'purchase' OR value > 300, false)""")
def q_filter_block_any(spark, sf):
    return filter_docs(table(spark, sf, "events"),
                       [Cond("event_type", "==", "purchase"), Cond("value", ">", "300")],
                       action=" BLOCK ", match="Any")


@query("filter_numeric_ops", """
SELECT event_id, user_id, value FROM events
WHERE value >= 10 AND value <= 200 AND user_id < 100 AND CAST(event_id AS DOUBLE) > 50""")
def q_filter_numeric_ops(spark, sf):
    ev = table(spark, sf, "events").select("event_id", "user_id", "value")
    return filter_docs(ev, [Cond("value", ">=", "10"), Cond("value", "<=", "200d"),
                            Cond("user_id", "<", "1e2"), Cond("event_id", ">", " 50 ")])


@query("filter_nested_path", """
SELECT event_id, user_id, event_type, CAST(json_extract(props, '$.k') AS BIGINT) AS k
FROM events WHERE CAST(json_extract(props, '$.k') AS DOUBLE) >= 50""")
def q_filter_nested_path(spark, sf):
    ev = table(spark, sf, "events")
    docs = ev.select("event_id", "user_id", "event_type",
                     F.from_json("props", "k bigint").alias("props"))
    out = filter_docs(docs, [Cond("props.k", ">=", "50")])
    return out.select("event_id", "user_id", "event_type", F.col("props.k").alias("k"))


def _event_docs(spark, sf) -> DataFrame:
    """Events as VARIANT documents: ``{"event_id", "user_id", "event_type", "value", "props": {...}}``."""
    ev = table(spark, sf, "events", heavy=True)
    body = F.struct("event_id", "user_id", "event_type", "value",
                    F.try_parse_json("props").alias("props"))
    return ev.select(F.lit("event").alias("entity"), F.to_variant_object(body).alias("doc"))


@query("filter_variant_path", """
SELECT event_id, event_type, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events
WHERE event_type = 'click' AND CAST(json_extract(props, '$.k') AS DOUBLE) >= 50""")
def q_filter_variant_path(spark, sf):
    docs = _event_docs(spark, sf)
    out = filter_docs(docs, [Cond("event_type", "==", "click"), Cond("props.k", ">=", "50")],
                      doc="doc")
    return out.select(get_field(out, "event_id", "doc", "bigint").alias("event_id"),
                      get_field(out, "event_type", "doc", "string").alias("event_type"),
                      get_field(out, "props.k", "doc", "bigint").alias("k"))


@query("filter_contains_text", """
SELECT p_partkey, p_name FROM part WHERE contains(p_name, 'widget')""")
def q_filter_contains_text(spark, sf):
    part = table(spark, sf, "part").select("p_partkey", "p_name")
    return filter_docs(part, [Cond("p_name", "containsText", "widget")])


@query("filter_notcontains", """
SELECT p_partkey, p_name FROM part WHERE p_name IS NOT NULL AND NOT contains(p_name, 'red')""")
def q_filter_notcontains(spark, sf):
    part = table(spark, sf, "part").select("p_partkey", "p_name")
    return filter_docs(part, [Cond("p_name", "notcontains", "red")])


def _priorities(spark, sf) -> DataFrame:
    """One document per customer with the set of its order priorities (an array field)."""
    return (table(spark, sf, "orders").groupBy("o_custkey")
            .agg(F.collect_set("o_orderpriority").alias("priorities")))


@query("filter_array_contains", """
SELECT o_custkey, CAST(count(DISTINCT o_orderpriority) AS INTEGER) AS n_priorities
FROM orders GROUP BY o_custkey HAVING list_contains(list(o_orderpriority), '1-URGENT')""")
def q_filter_array_contains(spark, sf):
    out = filter_docs(_priorities(spark, sf), [Cond("priorities", "contains", "1-URGENT")])
    return out.select("o_custkey", F.size("priorities").alias("n_priorities"))


@query("filter_array_notcontains", """
SELECT o_custkey, CAST(count(DISTINCT o_orderpriority) AS INTEGER) AS n_priorities
FROM orders GROUP BY o_custkey HAVING NOT list_contains(list(o_orderpriority), '5-LOW')""")
def q_filter_array_notcontains(spark, sf):
    out = filter_docs(_priorities(spark, sf), [Cond("priorities", "notcontains", "5-LOW")])
    return out.select("o_custkey", F.size("priorities").alias("n_priorities"))


@query("filter_match_field_regex", """
SELECT p_partkey, p_type FROM part WHERE regexp_full_match('ECONOMY', p_type)""")
def q_filter_match_field_regex(spark, sf):
    part = table(spark, sf, "part").select("p_partkey", "p_type")
    return filter_docs(part, [Cond("p_type", "match", "ECONOMY")])


@query("filter_strict_equality", """
SELECT * FROM events WHERE false""")
def q_filter_strict_equality(spark, sf):
    # a number is never equal to the text "12.31": only JSON strings compare
    return filter_docs(table(spark, sf, "events"), [Cond("value", "==", "12.31")])


@query("filter_strict_inequality", """
SELECT * FROM events WHERE value IS NOT NULL""")
def q_filter_strict_inequality(spark, sf):
    return filter_docs(table(spark, sf, "events"), [Cond("value", "!=", "12.31")])


@query("filter_coerce_equality", """
SELECT * FROM events WHERE value = 12.31 OR value = 100""")
def q_filter_coerce_equality(spark, sf):
    return filter_docs(table(spark, sf, "events"),
                       [Cond("value", "==", "12.31"), Cond("value", "==", "100")],
                       match="any", coerce=True)


# --- splits (C1-C8, CF1-CF6, E1-E3) --------------------------------------------------

@query("split_numeric", """
SELECT o_orderkey, o_totalprice,
       CASE WHEN o_totalprice > 100000 THEN 'yes' ELSE 'no' END AS branch
FROM orders""")
def q_split_numeric(spark, sf):
    orders = table(spark, sf, "orders").select("o_orderkey", "o_totalprice")
    return branch(orders, "o_totalprice", ">", "100000")


@query("split_numeric_yes", """
SELECT o_orderkey, 'bigOrder' AS entity FROM orders WHERE o_totalprice >= 250000""")
def q_split_numeric_yes(spark, sf):
    orders = table(spark, sf, "orders").select("o_orderkey", "o_totalprice")
    return split(orders, "o_totalprice", ">=", "250000", entity="bigOrder").yes \
        .select("o_orderkey", "entity")


@query("split_numeric_no", """
SELECT o_orderkey FROM orders WHERE NOT coalesce(o_totalprice >= 250000, false)""")
def q_split_numeric_no(spark, sf):
    orders = table(spark, sf, "orders").select("o_orderkey", "o_totalprice")
    return split(orders, "o_totalprice", ">=", "250000").no.select("o_orderkey")


@query("split_regex", r"""
SELECT doc_id, CASE WHEN regexp_matches(text, 'MIT License\..+token', 's')
                    THEN 'yes' ELSE 'no' END AS branch
FROM documents""")
def q_split_regex(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "text")
    return branch(docs, "text", "RegexExpression", r"MIT License\..+token").select("doc_id", "branch")


@query("split_regex_number", r"""
SELECT event_id, CASE WHEN regexp_matches(CAST(user_id AS VARCHAR), '^1[0-9]$', 's')
                      THEN 'yes' ELSE 'no' END AS branch
FROM events""")
def q_split_regex_number(spark, sf):
    ev = table(spark, sf, "events").select("event_id", "user_id")
    return branch(ev, "user_id", "RegexExpression", "^1[0-9]$").select("event_id", "branch")


@query("split_contains", """
SELECT doc_id, lang, CASE WHEN contains(text, 'License') THEN 'yes' ELSE 'no' END AS branch
FROM documents""")
def q_split_contains(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "lang", "text")
    return branch(docs, "text", "containsText", "License").select("doc_id", "lang", "branch")


@query("split_string_eq", """
SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 'yes' ELSE 'no' END AS branch
FROM orders""")
def q_split_string_eq(spark, sf):
    orders = table(spark, sf, "orders").select("o_orderkey", "o_orderstatus")
    return branch(orders, "o_orderstatus", "==", "F").select("o_orderkey", "branch")


@query("split_fields_lt", """
SELECT l_orderkey, l_linenumber, CASE WHEN l_discount < l_tax THEN 'yes' ELSE 'no' END AS branch
FROM lineitem""")
def q_split_fields_lt(spark, sf):
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_discount", "l_tax")
    return branch_fields(li, "l_discount", "<", "l_tax").select("l_orderkey", "l_linenumber",
                                                                 "branch")


@query("split_fields_eq", """
SELECT p_partkey, CASE WHEN upper(split_part(p_name, ' ', 1)) = p_type
                       THEN 'yes' ELSE 'no' END AS branch
FROM part""")
def q_split_fields_eq(spark, sf):
    part = table(spark, sf, "part").withColumn(
        "first_word", F.upper(F.substring_index("p_name", " ", 1)))
    return branch_fields(part, "first_word", "==", "p_type").select("p_partkey", "branch")


@query("split_fields_ne", """
SELECT p_partkey, CASE WHEN upper(split_part(p_name, ' ', 1)) <> p_type
                       THEN 'yes' ELSE 'no' END AS branch
FROM part""")
def q_split_fields_ne(spark, sf):
    part = table(spark, sf, "part").withColumn(
        "first_word", F.upper(F.substring_index("p_name", " ", 1)))
    return branch_fields(part, "first_word", "!=", "p_type").select("p_partkey", "branch")


@query("split_fields_regex", """
SELECT p_partkey, CASE WHEN regexp_full_match(p_type, '(?i)' || split_part(p_name, ' ', 1) || '.*')
                       THEN 'yes' ELSE 'no' END AS branch
FROM part""")
def q_split_fields_regex(spark, sf):
    part = table(spark, sf, "part").withColumn(
        "pattern", F.concat(F.lit("(?i)"), F.substring_index("p_name", " ", 1), F.lit(".*")))
    return branch_fields(part, "pattern", "RegexExpression", "p_type").select("p_partkey", "branch")


def _documents_labels(spark, sf) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", "lang", "source")
    return enrich_from_table(docs, table(spark, sf, "labels"), "doc_id",
                             columns=["quality", "toxic"])


@query("split_exists", """
SELECT d.doc_id, CASE WHEN l.quality IS NOT NULL THEN 'yes' ELSE 'no' END AS branch
FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id""")
def q_split_exists(spark, sf):
    return branch_exists(_documents_labels(spark, sf), "quality").select("doc_id", "branch")


@query("split_variant", """
SELECT event_id, CASE WHEN value > 250 THEN 'yes' ELSE 'no' END AS branch FROM events""")
def q_split_variant(spark, sf):
    docs = _event_docs(spark, sf)
    out = branch(docs, "value", ">", "250", doc="doc")
    return out.select(get_field(out, "event_id", "doc", "bigint").alias("event_id"), "branch")


# --- reshaping (P1-P15) ------------------------------------------------------------------

@query("rename_top", """
SELECT event_id, ts, user_id, event_type, value AS amount, props FROM events""")
def q_rename_top(spark, sf):
    return rename_field(table(spark, sf, "events"), "value", "amount")


@query("rename_nested", """
SELECT event_id, ts, user_id, value, props, event_type AS meta_type FROM events""")
def q_rename_nested(spark, sf):
    moved = rename_field(table(spark, sf, "events"), "event_type", "meta.type")
    return flatten_doc(moved, "_")


@query("rename_missing", """
SELECT *, CAST(NULL AS VARCHAR) AS note FROM events""")
def q_rename_missing(spark, sf):
    return rename_field(table(spark, sf, "events"), "no_such_field", "note")


@query("rename_variant", """
SELECT event_id, event_type AS kind, CAST(json_extract(props, '$.k') AS BIGINT) AS k,
       CAST(NULL AS VARCHAR) AS event_type
FROM events""")
def q_rename_variant(spark, sf):
    docs = rename_field(_event_docs(spark, sf), "event_type", "meta.kind", doc="doc")
    return docs.select(get_field(docs, "event_id", "doc", "bigint").alias("event_id"),
                       get_field(docs, "meta.kind", "doc", "string").alias("kind"),
                       get_field(docs, "props.k", "doc", "bigint").alias("k"),
                       get_field(docs, "event_type", "doc", "string").alias("event_type"))


def _nested_orders(spark, sf, heavy: bool = False) -> DataFrame:
    """Orders as nested documents ``{o: {key, total, cust: {id}, state: {status, priority}}}``."""
    o = table(spark, sf, "orders", heavy=heavy)
    return o.select(F.struct(
        F.col("o_orderkey").alias("key"),
        F.col("o_totalprice").alias("total"),
        F.struct(F.col("o_custkey").alias("id")).alias("cust"),
        F.struct(F.col("o_orderstatus").alias("status"),
                 F.col("o_orderpriority").alias("priority")).alias("state"),
    ).alias("o"), F.col("o_orderdate").alias("date"))


NESTED_FLAT_SQL = """
SELECT o_orderkey AS o_key, o_totalprice AS o_total, o_custkey AS o_cust_id,
       o_orderstatus AS o_state_status, o_orderpriority AS o_state_priority, o_orderdate AS date
FROM orders"""


@query("flatten_typed", NESTED_FLAT_SQL)
def q_flatten_typed(spark, sf):
    return flatten_doc(_nested_orders(spark, sf), "_")


def _flat_fields(df: DataFrame, doc: str, names: dict[str, str]) -> DataFrame:
    return df.select(*[get_field(df, n, doc, t).alias(n) for n, t in names.items()])


@query("flatten_variant", """
SELECT o_orderkey AS o_key, o_totalprice AS o_total, o_custkey AS o_cust_id,
       o_orderstatus AS o_state_status, o_orderpriority AS o_state_priority FROM orders""")
def q_flatten_variant(spark, sf):
    nested = _nested_orders(spark, sf, heavy=True)
    docs = nested.select(F.to_variant_object(F.struct("o")).alias("doc"))
    flat = flatten_doc(docs, "_", doc="doc")
    return _flat_fields(flat, "doc", {"o_key": "bigint", "o_total": "double",
                                      "o_cust_id": "bigint", "o_state_status": "string",
                                      "o_state_priority": "string"})


@query("trim_allows", """
SELECT o_orderkey AS o_key, o_custkey AS o_cust_id FROM orders""")
def q_trim_allows(spark, sf):
    # "o.state" names a parent: it keeps nothing; "date" is not listed
    kept = trim(_nested_orders(spark, sf), ["o.key", " o.cust.id ", "o.state"], "allows")
    return flatten_doc(kept, "_")


@query("trim_delete", """
SELECT o_orderkey AS o_key, o_orderstatus AS o_state_status, o_orderdate AS date FROM orders""")
def q_trim_delete(spark, sf):
    # deleting the only leaf of o.cust removes the emptied object too
    gone = trim(_nested_orders(spark, sf), ["o.cust.id", "o.total", "o.state.priority"],
                "DELETE")
    return flatten_doc(gone, "_")


@query("trim_variant", """
SELECT o_orderkey AS o_key, o_custkey AS o_cust_id,
       CAST(NULL AS VARCHAR) AS o_state_status FROM orders""")
def q_trim_variant(spark, sf):
    nested = _nested_orders(spark, sf, heavy=True)
    docs = nested.select(F.to_variant_object(F.struct("o")).alias("doc"))
    kept = trim(docs, ["o.key", "o.cust.id"], "allows", doc="doc")
    return kept.select(get_field(kept, "o.key", "doc", "bigint").alias("o_key"),
                       get_field(kept, "o.cust.id", "doc", "bigint").alias("o_cust_id"),
                       get_field(kept, "o.state.status", "doc", "string").alias("o_state_status"))


@query("add_field_nested", """
SELECT event_id, user_id, CAST(ts AS DATE) AS meta_day, 'v1' AS meta_source_version FROM events""")
def q_add_field_nested(spark, sf):
    ev = table(spark, sf, "events").select("event_id", "user_id", "ts")
    out = add_field(ev, "meta.day", F.to_date("ts"))
    out = add_field(out, "meta.source.version", F.lit("v1"))
    return flatten_doc(out.drop("ts"), "_")


@query("remove_field_nested", """
SELECT o_orderkey AS o_key, o_totalprice AS o_total, o_orderstatus AS o_state_status,
       o_orderpriority AS o_state_priority, o_orderdate AS date FROM orders""")
def q_remove_field_nested(spark, sf):
    return flatten_doc(remove_field(_nested_orders(spark, sf), "o.cust.id"), "_")


@query("add_remove_variant", """
SELECT o_orderkey AS o_key, CAST(NULL AS BIGINT) AS o_cust_id, o_orderstatus AS o_flag FROM orders""")
def q_add_remove_variant(spark, sf):
    nested = _nested_orders(spark, sf, heavy=True)
    docs = nested.select(F.to_variant_object(F.struct("o")).alias("doc"), "o")
    docs = add_field(docs, "o.flag", F.col("o.state.status"), doc="doc")
    docs = remove_field(docs, "o.cust.id", doc="doc")
    return docs.select(get_field(docs, "o.key", "doc", "bigint").alias("o_key"),
                       get_field(docs, "o.cust.id", "doc", "bigint").alias("o_cust_id"),
                       get_field(docs, "o.flag", "doc", "string").alias("o_flag"))


@query("has_field", """
SELECT d.doc_id, l.quality IS NOT NULL AS has_quality, false AS has_missing
FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id""")
def q_has_field(spark, sf):
    df = _documents_labels(spark, sf)
    return df.select("doc_id", has_field(df, "quality").alias("has_quality"),
                     has_field(df, "no.such.field").alias("has_missing"))


@query("set_entity", """
SELECT 'click' AS entity, event_id FROM events""")
def q_set_entity(spark, sf):
    return set_entity(table(spark, sf, "events").select("event_id"), "click") \
        .select("entity", "event_id")


ENVELOPE_SCHEMA = "event_id bigint, user_id bigint, event_type string, value double, props string"


@query("envelope_roundtrip", """
SELECT 'event' AS entity, event_id, user_id, event_type, value, props FROM events""")
def q_envelope_roundtrip(spark, sf):
    ev = table(spark, sf, "events").select("event_id", "user_id", "event_type", "value", "props")
    env = to_envelope(ev, entity="event")
    return from_envelope(env, ENVELOPE_SCHEMA)


@query("decode_envelope", """
SELECT event_type AS entity, props AS map FROM events""")
def q_decode_envelope(spark, sf):
    ev = table(spark, sf, "events")
    records = ev.select(F.col("event_type").alias("topic"), F.encode("props", "UTF-8").alias("value"))
    return decode_envelope(records)


@query("malformed_split", """
SELECT event_id,
       CASE WHEN json_valid(m) AND json_type(m) = 'OBJECT' THEN 'good'
            WHEN json_valid(m) THEN 'not an object' ELSE 'malformed' END AS status
FROM (SELECT event_id, CASE WHEN event_type = 'error' THEN substr(props, 1, length(props) - 1)
                            WHEN event_type = 'signup' THEN '[' || props || ']'
                            ELSE props END AS m FROM events)""")
def q_malformed_split(spark, sf):
    ev = table(spark, sf, "events", heavy=True)
    # error events carry a truncated payload, signups a JSON array instead of an object
    env = ev.select("event_id", F.lit("event").alias("entity"),
                    F.when(F.col("event_type") == "error",
                           F.expr("substring(props, 1, length(props) - 1)"))
                    .when(F.col("event_type") == "signup", F.concat(F.lit("["), "props", F.lit("]")))
                    .otherwise(F.col("props")).alias("map"))
    return classify_documents(env).select("event_id", "status")


@query("malformed_dead_letter", """
SELECT event_id, CASE WHEN json_valid(m) THEN 'not an object' ELSE 'malformed' END AS reason
FROM (SELECT event_id, CASE WHEN event_type = 'error' THEN substr(props, 1, length(props) - 1)
                            WHEN event_type = 'signup' THEN '[' || props || ']'
                            ELSE props END AS m FROM events)
WHERE CASE WHEN json_valid(m) THEN json_type(m) <> 'OBJECT' ELSE true END""")
def q_malformed_dead_letter(spark, sf):
    ev = table(spark, sf, "events")
    env = ev.select("event_id", F.lit("event").alias("entity"),
                    F.when(F.col("event_type") == "error",
                           F.expr("substring(props, 1, length(props) - 1)"))
                    .when(F.col("event_type") == "signup", F.concat(F.lit("["), "props", F.lit("]")))
                    .otherwise(F.col("props")).alias("map"))
    return split_malformed(env).no.select("event_id", "reason")


@query("parse_documents_variant", """
SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events""")
def q_parse_documents_variant(spark, sf):
    ev = table(spark, sf, "events", heavy=True)
    env = to_envelope(ev.select("event_id", "props"), entity="event")
    docs = parse_documents(env)
    inner = docs.withColumn("props", F.try_parse_json(get_field(docs, "props", "doc", "string")))
    return inner.select(get_field(inner, "event_id", "doc", "bigint").alias("event_id"),
                        F.try_variant_get("props", "$.k", "bigint").alias("k"))


# --- feeds (S3-S5) ---------------------------------------------------------------------

NEW_ITEMS_SQL = """
WITH d AS (SELECT event_id, user_id, event_type, CAST(ts AS DATE) AS day FROM events),
p AS (SELECT day, CAST(dense_rank() OVER (ORDER BY day) AS BIGINT) AS poll_seq
      FROM (SELECT DISTINCT day FROM d)),
r AS (SELECT d.*, p.poll_seq FROM d JOIN p USING (day))
SELECT event_id, user_id, event_type, poll_seq FROM r
WHERE NOT EXISTS (SELECT 1 FROM r r2 WHERE r2.poll_seq = r.poll_seq - 1
                  AND r2.user_id = r.user_id AND r2.event_type = r.event_type)"""


@query("new_items", NEW_ITEMS_SQL)
def q_new_items(spark, sf):
    ev = table(spark, sf, "events").select("event_id", "user_id", "event_type",
                                          F.to_date("ts").alias("day"))
    return new_items(ev, ["user_id", "event_type"], poll="day") \
        .select("event_id", "user_id", "event_type", "poll_seq")


@query("new_items_by_feed", """
WITH d AS (SELECT event_id, event_type AS feed, user_id, CAST(ts AS DATE) AS day FROM events),
p AS (SELECT feed, day, CAST(dense_rank() OVER (PARTITION BY feed ORDER BY day) AS BIGINT) AS poll_seq
      FROM (SELECT DISTINCT feed, day FROM d)),
r AS (SELECT d.*, p.poll_seq FROM d JOIN p USING (feed, day))
SELECT event_id, feed, user_id, poll_seq FROM r
WHERE NOT EXISTS (SELECT 1 FROM r r2 WHERE r2.feed = r.feed AND r2.poll_seq = r.poll_seq - 1
                  AND r2.user_id = r.user_id)""")
def q_new_items_by_feed(spark, sf):
    ev = table(spark, sf, "events").select("event_id", F.col("event_type").alias("feed"),
                                          "user_id", F.to_date("ts").alias("day"))
    return new_items(ev, "user_id", poll="day", feed="feed") \
        .select("event_id", "feed", "user_id", "poll_seq")


@query("snapshot_diff", """
SELECT c.event_id, c.user_id FROM events c
WHERE c.ts >= TIMESTAMP '2024-01-04 00:00:00'
  AND NOT EXISTS (SELECT 1 FROM events p WHERE p.ts < TIMESTAMP '2024-01-04 00:00:00'
                  AND p.user_id = c.user_id AND p.event_type = c.event_type)""")
def q_snapshot_diff(spark, sf):
    ev = table(spark, sf, "events").select("event_id", "user_id", "event_type", "ts")
    cut = F.lit("2024-01-04 00:00:00").cast("timestamp_ntz")
    current = ev.where(F.col("ts") >= cut)
    previous = ev.where(F.col("ts") < cut)
    return snapshot_diff(current, previous, ["user_id", "event_type"]).select("event_id", "user_id")


def _xml_text(col):
    escaped = F.replace(F.replace(F.replace(col, F.lit("&"), F.lit("&amp;")),
                                  F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    return escaped


@query("parse_feed", """
SELECT doc_id, CAST(i - 1 AS BIGINT) AS guid, lang AS category, trim(parts[i], ' ') AS title
FROM (SELECT doc_id, lang, string_split(text, chr(10)) AS parts,
             generate_series(1, len(string_split(text, chr(10)))) AS ii FROM documents),
     unnest(ii) AS t(i)""")
def q_parse_feed(spark, sf):
    docs = table(spark, sf, "documents", heavy=True)
    # one feed snapshot per document: every line of the text is an <item>
    items = F.transform(F.split("text", "\n", -1), lambda line, i: F.concat(
        F.lit("<item><guid>"), i.cast("string"), F.lit("</guid><category>"), F.col("lang"),
        F.lit("</category><title>"), _xml_text(line), F.lit("</title></item>")))
    snap = docs.select("doc_id", F.concat(F.lit("<rss><channel><title>"), F.col("source"),
                                          F.lit("</title>"), F.array_join(items, ""),
                                          F.lit("</channel></rss>")).alias("xml"))
    parsed = parse_feed(snap, "xml", "guid bigint, category string, title string", keep=["doc_id"])
    return parsed.select("doc_id", "guid", "category",
                         F.coalesce("title", F.lit("")).alias("title"))


@query("track_keywords", r"""
SELECT doc_id, lang FROM documents
WHERE regexp_matches(lower(text), '(^|\W)(license|licensed|token)(\W|$)')""")
def q_track_keywords(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "lang", "text")
    return track_keywords(docs, "text", [" License", "licensed ", "TOKEN"]).select("doc_id", "lang")


@query("sample_hash", """
SELECT o_orderkey FROM orders
WHERE (('0x' || substr(md5(CAST(o_orderkey AS VARCHAR)), 1, 8))::BIGINT % 10000) < 1000""")
def q_sample_hash(spark, sf):
    orders = table(spark, sf, "orders").select("o_orderkey")
    return sample_stream(orders, "o_orderkey", 0.1)


# --- enrichment (X1-X3) --------------------------------------------------------------------

@query("short_code", """
SELECT page_id, url, substr(md5(url), 1, 8) AS short FROM pages""")
def q_short_code(spark, sf):
    pages = table(spark, sf, "pages").select("page_id", "url")
    return short_code(pages, "url", "short", 8)


@query("short_code_collisions", """
SELECT substr(md5(url), 1, 4) AS code, count(DISTINCT url) AS n_values FROM pages
GROUP BY 1 HAVING count(DISTINCT url) > 1""")
def q_short_code_collisions(spark, sf):
    return short_code_collisions(table(spark, sf, "pages"), "url", 4)


@query("enrich_from_table", """
SELECT s.s_suppkey, s.s_name, n.n_name AS nation FROM supplier s
LEFT JOIN nation n ON s.s_nationkey = n.n_nationkey""")
def q_enrich_from_table(spark, sf):
    sup = table(spark, sf, "supplier").select("s_suppkey", "s_name", "s_nationkey")
    out = enrich_from_table(sup, table(spark, sf, "nation"), "s_nationkey", "n_nationkey",
                            {"n_name": "nation"})
    return out.drop("s_nationkey")


def _md5_prefix(keys: pd.Series) -> pd.Series:
    return keys.map(lambda u: hashlib.md5(u.encode("utf-8")).hexdigest()[:10])


@query("enrich_fn", """
SELECT page_id, substr(md5(url), 1, 10) AS short FROM pages""")
def q_enrich_fn(spark, sf):
    pages = table(spark, sf, "pages").select("page_id", "url")
    return enrich(pages, "url", "short", _md5_prefix).select("page_id", "short")


# --- routing (R1-R7) --------------------------------------------------------------------

def _scattered(spark, sf) -> DataFrame:
    """Events dealt over eight partitions by their id, so that a user's rows lie in several."""
    return table(spark, sf, "events").select("event_id", "user_id").repartition(8, "event_id")


def _places(df: DataFrame) -> DataFrame:
    return (df.select("user_id", F.spark_partition_id().alias("pid")).distinct()
            .groupBy("user_id").agg(F.count("*").alias("n")))


@query("partition_field", """
SELECT user_id, CAST(1 AS BIGINT) AS n_partitions, count(*) > 20 AS scattered_before
FROM events GROUP BY user_id""")
def q_partition_field(spark, sf):
    scattered = _scattered(spark, sf)
    sizes = scattered.groupBy("user_id").agg(F.count("*").alias("rows"))
    # users with many rows are in several partitions before, and in one after
    before = _places(scattered).withColumnRenamed("n", "n_before").join(sizes, "user_id")
    after = _places(partition(scattered, "field", 8, "user_id"))
    return after.join(before, "user_id").select(
        "user_id", F.col("n").alias("n_partitions"),
        ((F.col("n_before") > 1) & (F.col("rows") > 20)).alias("scattered_before"))


@query("partition_shuffle", """
SELECT count(*) AS n_rows, count(DISTINCT event_id) AS n_ids, CAST(8 AS BIGINT) AS n_partitions,
       true AS balanced FROM events""")
def q_partition_shuffle(spark, sf):
    lopsided = table(spark, sf, "events").select("event_id").coalesce(1)
    dealt = partition(lopsided, "shuffle", 8).select("event_id", F.spark_partition_id().alias("pid"))
    each = dealt.groupBy("pid").agg(F.count("*").alias("n"))
    n = dealt.agg(F.count("*").alias("n_rows"), F.countDistinct("event_id").alias("n_ids"))
    return n.crossJoin(each.agg(F.count("*").alias("n_partitions"),
                                (F.max("n") <= 1.2 * F.min("n") + 8).alias("balanced")))  # one row each


@query("merge_sources", """
SELECT * FROM (SELECT c_custkey AS key, c_name AS name, c_nationkey AS nationkey,
                      c_acctbal AS acctbal, c_mktsegment AS segment FROM customer)
UNION ALL BY NAME
SELECT * FROM (SELECT s_suppkey AS key, s_name AS name, s_nationkey AS nationkey,
                      s_acctbal AS acctbal FROM supplier)""")
def q_merge_sources(spark, sf):
    c = table(spark, sf, "customer").select(
        F.col("c_custkey").alias("key"), F.col("c_name").alias("name"),
        F.col("c_nationkey").alias("nationkey"), F.col("c_acctbal").alias("acctbal"),
        F.col("c_mktsegment").alias("segment"))
    s = table(spark, sf, "supplier").select(
        F.col("s_suppkey").alias("key"), F.col("s_name").alias("name"),
        F.col("s_nationkey").alias("nationkey"), F.col("s_acctbal").alias("acctbal"))
    return merge(c, s)


@query("fan_out", """
SELECT 'by_type' AS sink, event_type AS k, count(*) AS n FROM events GROUP BY event_type
UNION ALL
SELECT 'by_day' AS sink, CAST(CAST(ts AS DATE) AS VARCHAR) AS k, count(*) AS n FROM events
GROUP BY CAST(ts AS DATE)""")
def q_fan_out(spark, sf):
    ev = table(spark, sf, "events").select("event_type", "ts")
    out = scratch_path(spark, "fan-out")

    def by_type(df):
        df.groupBy(F.col("event_type").alias("k")).agg(F.count("*").alias("n")) \
            .write.mode("overwrite").parquet(f"{out}/by_type")

    def by_day(df):
        df.groupBy(F.to_date("ts").cast("string").alias("k")).agg(F.count("*").alias("n")) \
            .write.mode("overwrite").parquet(f"{out}/by_day")

    fan_out(ev, [by_type, by_day])
    return (spark.read.parquet(f"{out}/by_type").select(F.lit("by_type").alias("sink"), "k", "n")
            .unionByName(spark.read.parquet(f"{out}/by_day")
                         .select(F.lit("by_day").alias("sink"), "k", "n")))


# --- sinks (K1-K7) ---------------------------------------------------------------------------

@query("log_envelope", """
SELECT 'part' AS entity, p_partkey, p_name, p_size FROM part""")
def q_log_envelope(spark, sf):
    part = table(spark, sf, "part").select("p_partkey", "p_name", "p_size")
    env = to_envelope(part, entity="part")
    return from_envelope(env, "p_partkey bigint, p_name string, p_size int")


@query("bars_payload", """
SELECT c_custkey, 'w-balance' AS widget_id, 'balance' AS label, c_acctbal AS number, NULL::BIGINT AS whole
FROM customer
UNION ALL
SELECT c_custkey, 'w-nation' AS widget_id, 'nation' AS label, NULL, c_nationkey FROM customer""")
def q_bars_payload(spark, sf):
    cust = table(spark, sf, "customer")
    out = bars_payload(cust, [("balance", "w-balance", "c_acctbal"),
                              {"label": "nation", "id": "w-nation", "field": "c_nationkey"}],
                       keep=["c_custkey"])
    # read back from the payload: the values the widgets get
    number = F.get_json_object("payload", "$.value")
    balance = F.col("widget_id") == "w-balance"
    return out.select("c_custkey", "widget_id", "label", F.when(balance, number.cast("double")).alias("number"),
                      F.when(~balance, number.cast("bigint")).alias("whole"))


@query("boxes_payload", """
SELECT o_orderkey, 'b1' AS widget_id, 'total' AS label, o_totalprice AS number,
       CAST(NULL AS VARCHAR) AS text FROM orders
UNION ALL
SELECT o_orderkey, 'b2', 'customer', CAST(o_custkey AS DOUBLE), NULL FROM orders
UNION ALL
SELECT o_orderkey, 'b3', 'status', NULL, '"' || o_orderstatus || '"' FROM orders
UNION ALL
SELECT o_orderkey, 'b4', 'urgent', NULL,
       CASE WHEN o_orderpriority = '5-LOW' THEN NULL ELSE CAST(o_orderpriority = '1-URGENT' AS VARCHAR) END
FROM orders""")
def q_boxes_payload(spark, sf):
    # a number, an integer, a string, and a boolean that is null for some
    orders = table(spark, sf, "orders").withColumn("urgent", F.when(
        F.col("o_orderpriority") != "5-LOW", F.col("o_orderpriority") == "1-URGENT"))
    out = boxes_payload(orders, [("total", "b1", "o_totalprice"), ("customer", "b2", "o_custkey"),
                                 ("status", "b3", "o_orderstatus"), ("urgent", "b4", "urgent")],
                        keep=["o_orderkey"])
    # the value as it stands in the payload: strings keep their quotes
    raw = F.nullif(F.regexp_extract("payload", r'^\{"value":(.*)\}$', 1), F.lit(""))
    numeric = F.col("widget_id").isin("b1", "b2")
    return out.select("o_orderkey", "widget_id", "label", F.when(numeric, raw.cast("double")).alias("number"),
                      F.when(~numeric, raw).alias("text"))


@query("map_payload", """
SELECT s_suppkey, 'map-1' AS widget_id, s_nationkey AS latitude, s_acctbal AS longitude,
       s_name FROM supplier""")
def q_map_payload(spark, sf):
    sup = table(spark, sf, "supplier")
    out = map_payload(sup, "s_nationkey", "s_acctbal", [" s_name "], "map-1", keep=["s_suppkey"])
    return out.select("s_suppkey", "widget_id", "value.latitude", "value.longitude", "value.s_name")


@query("timeline_payload", """
SELECT event_id, CAST(floor(epoch(ts)) AS BIGINT) AS timestamp, event_type AS content,
       CAST(user_id AS VARCHAR) AS title, CAST(NULL AS VARCHAR) AS image FROM events""")
def q_timeline_payload(spark, sf):
    ev = table(spark, sf, "events")
    out = timeline_payload(ev, content="event_type", title="user_id", image="no_image",
                           timestamp="ts", widget_id="tl", keep=["event_id"])
    return out.select("event_id", "timestamp", "value.content", "value.title", "value.image")


@query("message_payload", """
SELECT o_orderkey, 'Order priority ' || o_orderpriority AS message FROM orders""")
def q_message_payload(spark, sf):
    orders = table(spark, sf, "orders")
    return message_payload(orders, "o_orderpriority", "Order priority", keep=["o_orderkey"])


# --- user code (U1-U3) --------------------------------------------------------------------

def _lines(rec: dict):
    for i, line in enumerate(rec["text"].split("\n")):
        yield {"doc_id": rec["doc_id"], "line_no": i, "line": line}


@query("flat_map_user", """
SELECT doc_id, CAST(i - 1 AS BIGINT) AS line_no, parts[i] AS line
FROM (SELECT doc_id, string_split(text, chr(10)) AS parts,
             generate_series(1, len(string_split(text, chr(10)))) AS ii FROM documents),
     unnest(ii) AS t(i)""")
def q_flat_map_user(spark, sf):
    docs = table(spark, sf, "documents", heavy=True).select("doc_id", "text")
    return flat_map_docs(docs, _lines, "doc_id bigint, line_no bigint, line string")


# --- dataflow wiring (G1) ---------------------------------------------------------------------------

@query("readme_example", """
SELECT 'purchase' AS entity, event_id, user_id, event_type, value AS amount FROM events
WHERE event_type = 'purchase' AND value > 100""")
def q_readme_example(spark, sf):
    out = scratch_path(spark, "readme-example")
    p = (Dataflow()
         .source("events", lambda s: table(s, sf, "events")
                 .select("event_id", "user_id", "event_type", "value"))
         .transform("purchases", lambda df: filter_docs(
             df, [Cond("event_type", "==", "purchase"), Cond("value", ">", "100")]), "events")
         .transform("rename", lambda df: rename_field(df, "value", "amount"),
                    ("purchases", None, "shuffle", None, 2))
         .sink("log", lambda df: log_sink(df, out, entity="purchase"), "rename"))
    p.run(spark)
    logged = spark.read.text(out).select(F.lit("purchase").alias("entity"), F.col("value").alias("map"))
    return from_envelope(logged, "event_id bigint, user_id bigint, event_type string, amount double")


# --- user source (S9, S10) -------------------------------------------------------------

def _id_batches(span: tuple[int, int]):
    """A user source's rows for the ids of one range, as Arrow batches."""
    import numpy as np
    import pyarrow as pa

    for at in range(span[0], span[1], 4096):
        ids = np.arange(at, min(at + 4096, span[1]), dtype=np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(ids * ids % 97)], names=["doc_id", "code"])


@query("user_source", """
SELECT d.doc_id, d.lang, d.doc_id * d.doc_id % 97 AS code FROM documents d""")
def q_user_source(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "lang")
    # one partition for every 4096 ids that the table has rows of
    spans = [(r.low, r.high + 1) for r in docs.groupBy(F.floor(F.col("doc_id") / 4096)).agg(
        F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).collect()]
    source_from_function(spark, "docweave_codes", "doc_id bigint, code bigint", spans, _id_batches)
    return docs.join(spark.read.format("docweave_codes").load(), "doc_id")


# --- streaming (D4, R8, S5) ------------------------------------------------------------------

def _drain(spark: SparkSession, stream: DataFrame, name: str) -> DataFrame:
    """Run a stream over what is there (availableNow) into parquet; read the result."""
    out = scratch_path(spark, name)
    q = (stream.writeStream.format("parquet").option("checkpointLocation", f"{out}/_ckpt")
         .trigger(availableNow=True).start(f"{out}/data"))
    q.awaitTermination()
    return spark.read.parquet(f"{out}/data")


@query("stream_filter", """
SELECT * FROM events WHERE event_type = 'purchase' AND value > 100""")
def q_stream_filter(spark, sf):
    ev = stream_table(spark, sf, "events")
    return _drain(spark, filter_docs(ev, [Cond("event_type", "==", "purchase"),
                                          Cond("value", ">", "100")]), "stream-filter")


@query("stream_split", """
SELECT event_id, CASE WHEN value > 250 THEN 'yes' ELSE 'no' END AS branch FROM events""")
def q_stream_split(spark, sf):
    ev = stream_table(spark, sf, "events").select("event_id", "value")
    return _drain(spark, branch(ev, "value", ">", "250").select("event_id", "branch"),
                  "stream-split")


@query("stream_new_items", """
WITH d AS (SELECT event_id, user_id, event_type,
                  CAST(date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) + 1 AS BIGINT) AS poll_seq
           FROM events)
SELECT event_id, user_id, event_type, poll_seq FROM d
WHERE NOT EXISTS (SELECT 1 FROM d d2 WHERE d2.poll_seq = d.poll_seq - 1
                  AND d2.user_id = d.user_id AND d2.event_type = d.event_type)""")
def q_stream_new_items(spark, sf):
    # the poller numbers its polls: here one poll per day since 2024-01-01.  The events are
    # landed in slices of 121 hours, so polls lie across the borders of files and of
    # micro-batches, and the stream stops and starts again in the middle
    day = F.datediff(F.to_date("ts"), F.lit("2024-01-01").cast("date"))
    polls = table(spark, sf, "events").select("event_id", "user_id", "event_type", (day + 1).alias("poll"),
                                              F.floor((day * 24 + F.hour("ts")) / 121).alias("slice"))
    out = scratch_path(spark, "stream-new-items")
    schema = polls.drop("slice").schema
    last = polls.agg(F.max("slice")).first()[0]

    def write(batch, batch_id):
        batch.drop("poll").write.mode("overwrite").parquet(f"{out}/data/batch={batch_id}")

    def go(slices):
        for i in slices:
            (polls.where(F.col("slice") == i).drop("slice").coalesce(1)
             .write.mode("append").parquet(f"{out}/feed/slice={i:04}"))
        stream = (spark.readStream.schema(schema).option("recursiveFileLookup", "true")
                  .option("maxFilesPerTrigger", 2).parquet(f"{out}/feed"))
        q = new_items_stream(stream, ["user_id", "event_type"], "poll", write, f"{out}/_ckpt",
                             available_now=True)
        q.awaitTermination()

    go(range(0, last // 2 + 1))
    go(range(last // 2 + 1, last + 1))
    return spark.read.parquet(f"{out}/data").select("event_id", "user_id", "event_type",
                                                    "poll_seq")


def _landed_days(spark, sf, out):
    """Events landed in folders of 5 days, in parallel; ``land(i)`` brings folder i to the watched place."""
    day = F.datediff(F.to_date("ts"), F.lit("2024-01-01").cast("date"))
    events = table(spark, sf, "events").select("event_id", "user_id", "event_type", F.col("ts").cast("timestamp").alias("ts"),
                                               (day + 1).cast("bigint").alias("poll"), F.floor(day / 5).alias("slice"))
    last = events.agg(F.max("slice")).first()[0]

    def land(i):
        events.where(F.col("slice") == i).drop("slice").write.mode("append").parquet(f"{out}/feed/slice={i:04}")

    def stream():
        return (spark.readStream.schema(events.drop("slice").schema).option("recursiveFileLookup", "true")
                .parquet(f"{out}/feed"))

    return land, stream, int(last)


def _in_runs(spark, result, out, land, last, runs=3):
    """The stream started, ended and started again, each time over some more folders."""
    configure_state(spark)
    for run in range(runs):
        for i in range(run * (last + 1) // runs, (run + 1) * (last + 1) // runs):
            land(i)
        q = run_stream(result(), lambda batch, i: batch.write.mode("overwrite").parquet(f"{out}/data/batch={i}"),
                       f"{out}/ckpt", available_now=True)
        q.awaitTermination()
    return spark.read.schema(result().schema).parquet(f"{out}/data").drop("batch")


@query("stream_new_items_keyed", """
WITH d AS (SELECT event_id, user_id, event_type,
                  CAST(date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) + 1 AS BIGINT) AS poll
           FROM events)
SELECT event_id, user_id, event_type, poll FROM d
WHERE NOT EXISTS (SELECT 1 FROM d d2 WHERE d2.poll = d.poll - 1
                  AND d2.user_id = d.user_id AND d2.event_type = d.event_type)""")
def q_stream_new_items_keyed(spark, sf):
    # one entry of keyed state per item; the stream is stopped and started again twice
    out = scratch_path(spark, "stream-keyed")
    land, stream, last = _landed_days(spark, sf, out)

    def fresh():
        polls = stream().select("event_id", "user_id", "event_type", "poll")
        return new_items_keyed(polls, ["user_id", "event_type"], "poll")

    return _in_runs(spark, fresh, out, land, last).select("event_id", "user_id", "event_type", "poll")


WEEK = 7 * 86_400_000


@query("stream_key_ticks", f"""
WITH ends AS (SELECT epoch_ms(max(ts)) AS w FROM events),
     u AS (SELECT user_id, epoch_ms(min(ts)) AS first FROM events GROUP BY user_id)
SELECT user_id, unnest(range((first // {WEEK} + 1) * {WEEK}, w + 1, {WEEK})) AS tick_at,
       generate_subscripts(range((first // {WEEK} + 1) * {WEEK}, w + 1, {WEEK}), 1) AS n_ticks
FROM u, ends""")
def q_stream_key_ticks(spark, sf):
    # a weekly tick for every user from their first event on, by event time; a batch
    # brings rows or a tick for most users, so users share calls
    out = scratch_path(spark, "stream-key-ticks")
    land, stream, last = _landed_days(spark, sf, out)

    def ticks():
        return keyed_ticks(stream().select("user_id", "ts"), "user_id", lambda entry, rows: entry or (0,),
                           lambda key, entry, tick: ((entry[0] + 1,), [(key[0], tick, entry[0] + 1)]),
                           "n bigint", "user_id bigint, tick_at bigint, n_ticks bigint", WEEK, time="ts",
                           buckets=2048)

    return _in_runs(spark, ticks, out, land, last)


@query("stream_tick", """
SELECT CAST(0 AS BIGINT) AS batch_id, count(*) AS n_rows, CAST(1 AS BIGINT) AS n_ticks FROM events""")
def q_stream_tick(spark, sf):
    ev = stream_table(spark, sf, "events")
    out = scratch_path(spark, "stream-tick")

    def count(batch, batch_id):
        batch.agg(F.count("*").alias("n_rows")).select(F.lit(batch_id).cast("bigint")
                                                       .alias("batch_id"), "n_rows") \
            .write.mode("overwrite").parquet(f"{out}/ticks/b={batch_id}")

    ticks = []
    q = run_stream(ev, count, f"{out}/_ckpt", available_now=True, on_tick=ticks.append)
    q.awaitTermination()
    seen = F.array(*[F.lit(t) for t in ticks]).cast("array<bigint>")
    return spark.read.parquet(f"{out}/ticks").select(
        "batch_id", "n_rows", F.size(F.filter(seen, lambda t: t == F.col("batch_id"))).cast("bigint").alias("n_ticks"))


# --- VARIANT-mode twins of more operators -------------------------------------------------

@query("filter_variant_array_contains", """
SELECT o_custkey FROM orders GROUP BY o_custkey
HAVING list_contains(list(o_orderpriority), '1-URGENT')""")
def q_filter_variant_array_contains(spark, sf):
    pri = _priorities(spark, sf)
    docs = pri.select(F.to_variant_object(F.struct("o_custkey", "priorities")).alias("doc"))
    out = filter_docs(docs, [Cond("priorities", "contains", "1-URGENT")], doc="doc")
    return out.select(get_field(out, "o_custkey", "doc", "bigint").alias("o_custkey"))


@query("split_fields_variant", """
SELECT l_orderkey, l_linenumber,
       CASE WHEN l_discount < l_tax THEN 'yes' ELSE 'no' END AS branch
FROM lineitem""")
def q_split_fields_variant(spark, sf):
    li = table(spark, sf, "lineitem", heavy=True)
    docs = li.select(F.to_variant_object(F.struct(
        "l_orderkey", "l_linenumber", F.struct("l_discount", "l_tax").alias("price"))).alias("doc"))
    out = branch_fields(docs, "price.l_discount", "<", "price.l_tax", doc="doc")
    return out.select(get_field(out, "l_orderkey", "doc", "bigint").alias("l_orderkey"),
                      get_field(out, "l_linenumber", "doc", "int").alias("l_linenumber"),
                      "branch")


@query("split_exists_variant", """
SELECT d.doc_id, CASE WHEN l.toxic IS NOT NULL THEN 'yes' ELSE 'no' END AS branch
FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id""")
def q_split_exists_variant(spark, sf):
    df = _documents_labels(spark, sf)
    docs = df.select(F.to_variant_object(F.struct("doc_id", "toxic")).alias("doc"))
    out = branch_exists(docs, "toxic", doc="doc")
    return out.select(get_field(out, "doc_id", "doc", "bigint").alias("doc_id"), "branch")


@query("match_field_variant", """
SELECT p_partkey FROM part WHERE regexp_full_match('SMALL', p_type)""")
def q_match_field_variant(spark, sf):
    part = table(spark, sf, "part")
    docs = part.select(F.to_variant_object(F.struct("p_partkey", "p_type")).alias("doc"))
    out = filter_docs(docs, [Cond("p_type", "match", "SMALL")], doc="doc")
    return out.select(get_field(out, "p_partkey", "doc", "bigint").alias("p_partkey"))


@query("timeline_variant", """
SELECT event_id, event_type AS content, CAST(user_id AS VARCHAR) AS title FROM events""")
def q_timeline_variant(spark, sf):
    docs = _event_docs(spark, sf)
    out = timeline_payload(docs, content="event_type", title="user_id", timestamp="event_id",
                           doc="doc", widget_id="tl")
    return out.select(F.try_variant_get("timestamp", "$", "bigint").alias("event_id"),
                      "value.content", "value.title")


@query("bars_variant", """
SELECT event_id, 'w-value' AS widget_id, 'value' AS label, value, CAST(NULL AS VARCHAR) AS text FROM events
UNION ALL
SELECT event_id, 'w-k', 'k', NULL, NULL FROM events
UNION ALL
SELECT event_id, 'w-type', 'type', NULL, event_type FROM events""")
def q_bars_variant(spark, sf):
    docs = _event_docs(spark, sf)
    # "props.k" names a top-level key with a dot, which no document has
    out = bars_payload(docs, [("value", "w-value", "value"), ("k", "w-k", "props.k"),
                              ("type", "w-type", "event_type")], doc="doc", keep=["doc"])
    payload = F.get_json_object("payload", "$.value")
    return out.select(get_field(out, "event_id", "doc", "bigint").alias("event_id"), "widget_id", "label",
                      F.when(F.col("widget_id") != "w-type", payload.cast("double")).alias("value"),
                      F.when(F.col("widget_id") == "w-type", payload).alias("text"))


@query("track_keywords_variant", r"""
SELECT doc_id FROM documents
WHERE regexp_matches(lower(text), '(^|\W)(license|licensed|token)(\W|$)')""")
def q_track_keywords_variant(spark, sf):
    docs = table(spark, sf, "documents", heavy=True)
    vdocs = docs.select(F.to_variant_object(F.struct("doc_id", "text")).alias("doc"))
    out = track_keywords(vdocs, "text", ["license", "licensed", "token"], doc="doc")
    return out.select(get_field(out, "doc_id", "doc", "bigint").alias("doc_id"))


@query("envelope_chain", """
SELECT 'event' AS entity, event_id, user_id, value AS amount, CAST(NULL AS VARCHAR) AS value
FROM events WHERE event_type = 'purchase' AND value > 100""")
def q_envelope_chain(spark, sf):
    # the reference's model end to end: JSON text envelopes in, JSON text envelopes out
    ev = table(spark, sf, "events", heavy=True).select("event_id", "user_id", "event_type",
                                                       "value")
    env = to_envelope(ev, entity="event")
    out = with_documents(env, lambda d: trim(rename_field(filter_docs(
        d, [Cond("event_type", "==", "purchase"), Cond("value", ">", "100")], doc="doc"),
        "value", "amount", doc="doc"), ["event_type"], "delete", doc="doc"), dead_letter=False)
    return from_envelope(out, "event_id bigint, user_id bigint, amount double, value string")


@query("typed_from_documents", """
SELECT 'event' AS entity, event_id, user_id, event_type, value,
       CAST(json_extract(props, '$.k') AS BIGINT) AS props_k
FROM events WHERE event_type = 'view' AND value >= 10""")
def q_typed_from_documents(spark, sf):
    # VARIANT documents -> typed columns (schema inferred once), then a typed filter
    docs = _event_docs(spark, sf)
    typed = typed_from_documents(docs)
    out = filter_docs(typed, [Cond("event_type", "==", "view"), Cond("value", ">=", "10")])
    return flatten_doc(out, "_", keep=["entity"])
