"""Enrichment, routing, user code, payloads and sinks."""

import json

import pandas as pd
import pytest
from pyspark.sql import functions as F

from docweave.operators.enrich import enrich, enrich_from_table, short_code
from docweave.operators.routing import fan_out, merge, partition
from docweave.operators.user import flat_map_docs, map_batches
from docweave.sinks.payloads import (bars_payload, boxes_payload, map_payload,
                                     message_payload, timeline_payload)
from docweave.sinks.writers import log_sink, push_rows, sink_from_function
from docweave.sources.envelope import parse_documents


def test_enrich_distinct_keys_and_failures(spark):
    df = spark.createDataFrame([(1, "a"), (2, "a"), (3, "bad"), (4, None)], "id int, u string")
    calls = spark.sparkContext.accumulator(0)

    def fn(keys: pd.Series) -> pd.Series:
        calls.add(len(keys))
        if (keys == "bad").any():
            raise RuntimeError("service down")
        return keys.str.upper()

    out = {r.id: r.up for r in enrich(df, "u", "up", fn).collect()}
    assert out == {1: "A", 2: "A", 3: None, 4: None}


def test_enrich_variant_nested_target(spark):
    docs = parse_documents(spark.createDataFrame([("e", '{"u":"x"}')], "entity string, map string"))
    out = enrich(docs, "u", "meta.short", lambda k: k + "!", doc="doc")
    assert json.loads(out.select(F.to_json("doc")).first()[0]) == {"u": "x", "meta": {"short": "x!"}}


def test_short_code_and_table(spark):
    df = spark.createDataFrame([(1, "http://a"), (2, None)], "id int, url string")
    rows = {r.id: r.code for r in short_code(df, "url", "code", 6).collect()}
    assert len(rows[1]) == 6 and rows[2] is None
    m = spark.createDataFrame([("http://a", "A")], "url string, name string")
    out = enrich_from_table(df, m, "url", columns={"name": "site"}).collect()
    assert sorted((r.id, r.site) for r in out) == [(1, "A"), (2, None)]


def test_partition_field_one_partition_per_key(spark):
    df = spark.range(1000).select((F.col("id") % 37).alias("k"))
    tagged = partition(df, "field", 8, "k").select("k", F.spark_partition_id().alias("p"))
    assert tagged.groupBy("k").agg(F.countDistinct("p").alias("n")).where("n > 1").count() == 0
    with pytest.raises(ValueError):
        partition(df, "global")  # all rows through one task: left out
    assert partition(df, "shuffle", 5).rdd.getNumPartitions() == 5
    with pytest.raises(ValueError):
        partition(df, "bogus")


def test_merge_and_fan_out(spark):
    a = spark.createDataFrame([(1, "x")], "k int, a string")
    b = spark.createDataFrame([(2, 3.0)], "k int, b double")
    m = merge(a, b)
    assert sorted(m.columns) == ["a", "b", "k"] and m.count() == 2
    assert fan_out(m, [lambda d: d.count(), lambda d: d.where("k = 1").count()]) == [2, 1]


def test_flat_map_user_errors(spark):
    df = spark.createDataFrame([(1, "a\nb"), (2, None)], "id int, text string")

    def lines(rec):
        for i, line in enumerate(rec["text"].split("\n")):
            yield {"id": rec["id"], "n": i, "line": line}

    schema = "id int, n int, line string"
    with pytest.raises(Exception):
        flat_map_docs(df, lines, schema).collect()
    assert flat_map_docs(df, lines, schema, on_error="skip").count() == 2
    q = flat_map_docs(df, lines, schema, on_error="quarantine")
    assert q.where("_error IS NOT NULL").count() == 1 and q.count() == 3
    assert json.loads(q.where("_error IS NOT NULL").first()._input) == {"id": 2, "text": None}
    state = flat_map_docs(df.where("text IS NOT NULL"), lambda r, s: [{"id": r["id"], "n": s, "line": ""}],
                          schema, prepare=lambda: 7, cleanup=lambda s: None)
    assert state.first().n == 7
    doubled = map_batches(df, lambda p: p.assign(id=p.id * 2), "id int, text string")
    assert sorted(r.id for r in doubled.collect()) == [2, 4]


def test_user_code_sees_exact_values(spark):
    big = 9007199254740993
    df = spark.createDataFrame([(big, "a"), (None, "b")], "n long, s string")
    seen = flat_map_docs(df, lambda r: [{"n": r["n"], "kind": type(r["n"]).__name__}], "n long, kind string")
    assert sorted(map(tuple, seen.collect()), key=str) == sorted([(big, "int"), (None, "NoneType")], key=str)


def test_user_code_on_documents(spark):
    docs = parse_documents(spark.createDataFrame(
        [("e", '{"a":{"b":[1,2.5,null]},"n":9007199254740993}'), ("f", '{"skip":true}')], "entity string, map string"))

    def split(d):
        for i, x in enumerate(d.get("a", {}).get("b", [])):
            yield {"i": i, "x": x, "n": d["n"], "old": {"a": d["a"]}}

    out = flat_map_docs(docs, split, doc="doc")
    assert out.columns == docs.columns and dict(out.dtypes)["doc"] == "variant"
    got = sorted((r[0], json.loads(r[1])["x"], json.loads(r[1])["n"]) for r in
                 out.select("entity", F.to_json("doc")).collect() if json.loads(r[1])["x"] is not None)
    assert got == [("e", 1, 9007199254740993), ("e", 2.5, 9007199254740993)]
    bad = flat_map_docs(docs, lambda d: [{"n": d["n"]}], doc="doc", on_error="quarantine")
    dead = bad.where("_error IS NOT NULL").first()
    assert json.loads(dead._input)["doc"] == {"skip": True} and bad.count() == 2


def test_many_rows_from_one_document(spark):
    df = spark.createDataFrame([(20_000,)], "n int")
    assert flat_map_docs(df, lambda r: ({"i": i} for i in range(r["n"])), "i int").count() == 20_000


def test_enrich_in_place_keeps_the_old_value(spark):
    df = spark.createDataFrame([(1, "bad"), (2, "ok"), (3, None)], "id int, u string")

    def fn(keys):
        if (keys == "bad").any():
            raise RuntimeError("down")
        return keys + "!"

    assert {r.id: r.u for r in enrich(df, "u", "u", fn).collect()} == {1: "bad", 2: "ok!", 3: None}


def test_broadcasts_are_bounded_by_bytes(spark):
    from docweave.functions.sizing import fits, sized_broadcast
    wide = spark.range(100).select(F.repeat(F.lit("x"), 10_000).alias("t"), F.parse_json(F.lit("{}")).alias("v"))
    assert fits(wide) and not fits(wide, max_bytes=500_000) and not fits(wide, max_rows=99)
    assert sized_broadcast(wide, max_bytes=500_000) is wide


def test_bars_boxes(spark):
    df = spark.createDataFrame([(1, 2.5, None)], "id int, v double, w double")
    bars = bars_payload(df, [("v", "w1", "v"), ("w", "w2", "w")], keep=["id"])
    got = {r.widget_id: r.payload for r in bars.collect()}
    assert got == {"w1": '{"value":2.5}', "w2": "{}"}
    with pytest.raises(ValueError):
        boxes_payload(df, [("v", "w1", "v"), ("w", "w2", "w")])
    assert boxes_payload(df, [("v", "1", "v"), ("w", "2", "w"), ("v", "3", "v")]).count() == 3


def test_payload_holds_the_json_value(spark):
    df = spark.createDataFrame([(1, "F", 5, True, [1, 2])], "id int, s string, n long, b boolean, a array<int>")
    bars = [(c, f"w-{c}", c) for c in ("s", "n", "b", "a", "none")]
    want = {"w-s": {"value": "F"}, "w-n": {"value": 5}, "w-b": {"value": True}, "w-a": {"value": [1, 2]}, "w-none": {}}
    got = {r.widget_id: json.loads(r.payload) for r in bars_payload(df, bars).collect()}
    assert got == want
    docs = df.select(F.to_variant_object(F.struct("s", "n", "b", "a")).alias("doc"))
    assert {r.widget_id: json.loads(r.payload) for r in bars_payload(docs, bars, doc="doc").collect()} == want


def test_map_timeline_message(spark):
    docs = parse_documents(spark.createDataFrame(
        [("e", '{"geo":{"lat":1.5,"lon":2},"name":"n","t":"hello","ts":100}')],
        "entity string, map string"))
    m = json.loads(map_payload(docs, "geo.lat", "geo.lon", ["name"], "m", doc="doc").first().payload)
    assert m == {"value": {"latitude": 1.5, "longitude": 2, "name": "n"}}
    t = json.loads(timeline_payload(docs, content="t", title="nope", timestamp="ts", doc="doc")
                   .first().payload)
    assert t == {"timestamp": 100, "value": {"content": "hello"}}
    t2 = timeline_payload(docs, content="t", doc="doc", now=F.lit(42)).first()
    assert json.loads(t2.payload)["timestamp"] == 42
    msg = message_payload(docs, "nope", "Hi", doc="doc").first().message
    assert msg == "Hi null"


def test_push_rows_retries_and_failures(spark):
    df = spark.createDataFrame([("ok",), ("flaky",), ("bad",)], "payload string")

    class Client:
        def __init__(self):
            self.seen = {}

    def send(client, body):
        client.seen[body] = client.seen.get(body, 0) + 1
        if body == "bad" or (body == "flaky" and client.seen[body] < 2):
            raise IOError("http 500")

    st = {r.payload: (r.ok, r.attempts) for r in push_rows(df, Client, send, retries=2).collect()}
    assert st == {"ok": (True, 1), "flaky": (True, 2), "bad": (False, 3)}


def test_push_rows_carry_the_target(spark):
    df = spark.createDataFrame([(1, "w1", "x"), (2, "w2", "y")], "id int, widget_id string, payload string")

    def send(client, body, row):
        if row["widget_id"] == "w2":
            raise IOError(f"{row['id']} refused")

    out = {r.id: r for r in push_rows(df, lambda: None, send, retries=0).collect()}
    assert (out[1].widget_id, out[1].ok) == ("w1", True)
    assert (out[2].widget_id, out[2].ok, out[2].payload) == ("w2", False, "y") and "2 refused" in out[2].error


def test_sinks_write(spark, tmp_path):
    df = spark.createDataFrame([(1, "a")], "k int, v string")
    log_sink(df, str(tmp_path / "log"), entity="x")
    assert json.loads(spark.read.text(str(tmp_path / "log")).first().value) == {"k": 1, "v": "a"}
    seen = spark.sparkContext.accumulator(0)
    sink_from_function(df, lambda row: seen.add(row["k"]))
    assert seen.value == 1


def test_push_sink_failure_table(spark, tmp_path):
    from docweave.sinks.writers import push_sink
    df = spark.createDataFrame([("a",), ("b",)], "payload string")

    def send(client, body):
        if body == "b":
            raise IOError("refused")

    push_sink(df, lambda: None, send, str(tmp_path / "fail"), retries=0)
    assert [r.payload for r in spark.read.parquet(str(tmp_path / "fail")).collect()] == ["b"]


def test_readme_envelope_example(spark, tmp_path):
    from docweave.functions.predicates import Cond
    from docweave.operators.filter import filter_docs
    from docweave.operators.reshape import rename_field
    from docweave.sources.envelope import read_documents, with_documents
    from conftest import SF01

    landing = str(tmp_path / "landing")
    (spark.read.parquet(f"{SF01}/part.parquet")
     .select(F.to_json(F.struct(F.col("p_partkey").alias("id"), F.col("p_name").alias("title"))))
     .write.text(landing))
    env = read_documents(spark, landing, entity="rssItem")
    out, dead = with_documents(env, lambda d: rename_field(
        filter_docs(d, [Cond("title", "containsText", "widget")], doc="doc"),
        "title", "rsstitle", doc="doc"))
    assert dead.count() == 0
    log_sink(out, str(tmp_path / "logs"))
    logged = [json.loads(r.value) for r in spark.read.text(str(tmp_path / "logs")).collect()]
    want = spark.read.parquet(f"{SF01}/part.parquet").where("p_name LIKE '%widget%'").count()
    assert len(logged) == want and all("widget" in d["rsstitle"] and "title" not in d for d in logged)


def test_enrich_failure_leaves_variant_doc_unchanged(spark):
    docs = parse_documents(spark.createDataFrame([("e", '{"u":"bad"}'), ("e", '{"u":"ok"}')],
                                                 "entity string, map string"))

    def fn(keys):
        if (keys == "bad").any():
            raise RuntimeError("down")
        return keys + "!"

    out = {json.loads(r[0])["u"]: json.loads(r[0]) for r in
           enrich(docs, "u", "short", fn, doc="doc").select(F.to_json("doc")).collect()}
    assert out["bad"] == {"u": "bad"} and out["ok"] == {"u": "ok", "short": "ok!"}


def test_enrich_batch_size_caps_calls(spark):
    df = spark.range(0, 50).selectExpr("id", "concat('k', id % 20) AS k").coalesce(1)
    sizes = spark.sparkContext.accumulator(0)

    def fn(keys):
        assert len(keys) <= 7
        sizes.add(1)
        return keys.str.upper()

    out = enrich(df, "k", "up", fn, batch_size=7)
    assert out.where("up = upper(k)").count() == 50
    assert sizes.value >= 3


def test_sample_random(spark):
    from docweave.sources.social import sample_stream
    n = sample_stream(spark.range(10000), None, 0.3, method="random").count()
    assert 2500 < n < 3500


def test_spread_only_narrow_scans(spark):
    from docweave.functions.sizing import spread
    from conftest import SF01
    scan = spark.read.parquet(f"{SF01}/events.parquet")
    assert spread(scan, 8).rdd.getNumPartitions() == 8
    grouped = scan.groupBy("user_id").count()
    assert spread(grouped, 8) is grouped  # behind a shuffle: unchanged, nothing executed


def test_idempotency_key_stable(spark):
    from docweave.sinks.writers import idempotency_key
    df = spark.createDataFrame([("a",), ("a",), ("b",)], "payload string")
    keys = [r.k for r in df.select(idempotency_key(F.col("payload")).alias("k")).collect()]
    assert keys[0] == keys[1] != keys[2]


def test_spread_sees_splits_without_rows(spark, tmp_path):
    # one row group in a file of many splits: all rows are one task's
    import pyarrow as pa
    import pyarrow.parquet as pq
    from docweave.functions.sizing import spread
    pq.write_table(pa.table({"id": list(range(60_000))}), f"{tmp_path}/one.parquet", row_group_size=1 << 20)
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        for k in before:
            spark.conf.set(k, "20000")
        scan = spark.read.parquet(f"{tmp_path}/one.parquet")
        assert scan.rdd.getNumPartitions() >= 4
        out = spread(scan, 4)
        sizes = [n for n in out.rdd.mapPartitions(lambda rows: [sum(1 for _ in rows)]).collect() if n]
        assert max(sizes) < 30_000 and sum(sizes) == 60_000
        assert out.agg(F.countDistinct("id")).first()[0] == 60_000
        pq.write_table(pa.table({"id": list(range(60_000))}), f"{tmp_path}/many.parquet", row_group_size=5000)
        scan = spark.read.parquet(f"{tmp_path}/many.parquet")
        assert spread(scan, 2) is scan
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
