"""Dataflow wiring, batch = stream parity, incremental new items."""

import pytest
from pyspark.sql import functions as F

from docweave.functions.predicates import Cond
from docweave.operators.filter import filter_docs
from docweave.operators.reshape import rename_field
from docweave.operators.split import split
from docweave.plans.dataflow import Edge, Dataflow
from docweave.sources.feeds import new_items
from docweave.streaming.runner import fan_out_stream, new_items_stream, stream_table

from conftest import SF01


def test_dataflow_rules(spark):
    with pytest.raises(ValueError):
        Dataflow().source("s", lambda s: s.range(1)).validate()
    with pytest.raises(ValueError):
        Dataflow().sink("k", lambda d: d).validate()
    with pytest.raises(ValueError):
        (Dataflow().source("s", lambda s: s.range(1)).transform("t", lambda d: d)
         .sink("k", lambda d: d, "t")).validate()
    with pytest.raises(ValueError):
        (Dataflow().source("s", lambda s: s.range(1))
         .sink("k", lambda d: d, Edge("s", grouping="bogus"))).validate()
    with pytest.raises(ValueError):
        (Dataflow().source("s", lambda s: s.range(1))
         .transform("a", lambda d: d, "b").transform("b", lambda d: d, "a")
         .sink("k", lambda d: d, "a")).validate()


def test_dataflow_split_streams_and_union(spark):
    p = (Dataflow()
         .source("nums", lambda s: s.range(10).withColumnRenamed("id", "v"))
         .source("more", lambda s: s.range(100, 103).withColumnRenamed("id", "v"))
         .transform("big", lambda d: split(d, "v", ">=", "5"), "nums")
         .sink("yes", lambda d: sorted(r.v for r in d.collect()), Edge("big", "yes"), "more")
         .sink("no", lambda d: d.count(), Edge("big", "no", "field", "v", 4)))
    out = p.run(spark)
    assert out["yes"] == [5, 6, 7, 8, 9, 100, 101, 102]
    assert out["no"] == 5


def test_readme_example(spark):
    ev = spark.read.parquet(f"{SF01}/events.parquet")
    p = (Dataflow().source("events", lambda s: ev)
         .transform("f", lambda d: filter_docs(d, [Cond("event_type", "==", "purchase"),
                                                   Cond("value", ">", "100")]), "events")
         .transform("r", lambda d: rename_field(d, "value", "amount"), "f")
         .sink("log", lambda d: d.count(), "r"))
    assert p.run(spark)["log"] == ev.where("event_type = 'purchase' AND value > 100").count()


def test_batch_equals_stream(spark, tmp_path):
    conds = [Cond("event_type", "==", "click"), Cond("value", "<", "50")]
    batch = filter_docs(spark.read.parquet(f"{SF01}/events.parquet"), conds)
    stream = filter_docs(stream_table(spark, SF01, "events"), conds)
    q = (stream.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "ck"))
         .trigger(availableNow=True).start(str(tmp_path / "out")))
    q.awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out"))
    assert got.count() == batch.count()
    assert got.exceptAll(batch).count() == 0


def test_new_items_stream_across_batches(spark, tmp_path):
    ev = (spark.read.parquet(f"{SF01}/events.parquet")
          .select("event_id", "user_id", "event_type",
                  (F.datediff(F.to_date("ts"), F.lit("2024-01-01").cast("date")) + 1).alias("poll")))
    src = tmp_path / "polls"
    ev.repartition(1, "poll").write.partitionBy("poll").parquet(str(src))
    stream = (spark.readStream.schema(spark.read.parquet(str(src)).schema)
              .option("maxFilesPerTrigger", 3).parquet(str(src)))
    out = tmp_path / "new"

    def write(batch, batch_id):
        batch.write.mode("overwrite").parquet(f"{out}/b={batch_id}")

    q = new_items_stream(stream, ["user_id", "event_type"], "poll", write,
                         str(tmp_path / "ck"), state_path=str(tmp_path / "state"),
                         available_now=True)
    q.awaitTermination()
    got = spark.read.parquet(str(out)).select("event_id")
    expect = new_items(ev, ["user_id", "event_type"], "poll", dense=True).select("event_id")
    assert spark.read.parquet(str(out)).select("b").distinct().count() > 1  # several batches
    assert got.count() == expect.count()
    assert got.exceptAll(expect).count() == 0


def test_fan_out_stream(spark, tmp_path):
    seen = []
    stream = stream_table(spark, SF01, "events")
    q = fan_out_stream(stream, [lambda b, i: seen.append(("a", b.count())),
                                lambda b, i: seen.append(("b", b.where("value > 100").count()))],
                       str(tmp_path / "ck"), available_now=True)
    q.awaitTermination()
    assert seen[0] == ("a", 10000) and seen[1][0] == "b"


def test_enrich_on_a_stream(spark, tmp_path):
    from docweave.operators.enrich import enrich
    stream = stream_table(spark, SF01, "pages").select("page_id", "url")
    out = enrich(stream, "url", "host", lambda s: s.str.extract(r"://([^/]+)")[0])
    q = (out.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "ck"))
         .trigger(availableNow=True).start(str(tmp_path / "out")))
    q.awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out"))
    assert got.count() == 250 and got.where("host IS NULL").count() == 0


def test_new_items_rejects_streams(spark):
    with pytest.raises(ValueError):
        new_items(stream_table(spark, SF01, "events"), "user_id", "ts")


def _write_polls(spark, folder, files):
    """One file per list of (feed, poll, item) rows, in the order of their names."""
    for i, rows in enumerate(files):
        df = spark.createDataFrame(rows, "feed string, poll long, item string")
        df.coalesce(1).write.mode("append").parquet(f"{folder}/f={i:03}")


def test_polls_across_batches_and_a_restart(spark, tmp_path):
    """A poll may span files and micro-batches; a restarted stream knows what was there."""
    files = [[("f", 1, "A"), ("f", 1, "B"), (None, 1, "N")], [("f", 2, "A"), (None, 2, "N")],
             [("f", 2, "B"), ("f", 2, "C"), ("f", None, "A")], [("f", 3, "B"), ("g", 1, "B")],
             [("f", 3, "D"), ("g", 1, "E"), ("g", 2, "E")]]
    src, out = tmp_path / "polls", tmp_path / "new"
    schema = "feed string, poll long, item string"

    def go():
        stream = (spark.readStream.schema(schema).option("maxFilesPerTrigger", 1)
                  .option("recursiveFileLookup", "true").parquet(str(src)))
        q = new_items_stream(stream, "item", "poll",
                             lambda b, i: b.write.mode("overwrite").parquet(f"{out}/b={i}"),
                             str(tmp_path / "ck"), feed="feed", available_now=True)
        q.awaitTermination()

    _write_polls(spark, src, files[:2])
    go()
    for i, rows in enumerate(files[2:], 2):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{src}/f={i:03}")
        go()
    got = sorted((str(r.feed), str(r.poll), r.item) for r in spark.read.parquet(str(out)).collect())
    rows = [r for f in files for r in f]
    batch = new_items(spark.createDataFrame(rows, schema), "item", "poll", "feed", dense=True).collect()
    assert got == sorted((str(r.feed), str(r.poll), r.item) for r in batch)
    assert ("f", "2", "B") not in got and ("f", "None", "A") in got and ("None", "2", "N") not in got


def test_state_errors_are_raised(spark, tmp_path):
    from docweave.streaming import runner
    like = spark.createDataFrame([], "item string, poll_seq long")
    assert runner._previous_state(spark, str(tmp_path / "none"), 3, like).count() == 0
    with pytest.raises(Exception):
        runner._previous_state(spark, "nostore://x/y", 3, like)


def test_whole_documents_as_streamed_items(spark, tmp_path):
    src = tmp_path / "docs"
    for i, rows in enumerate([[(1, '{"a":1,"b":2}'), (1, '{"c":3}')], [(2, '{"b":2,"a":1}'), (2, '{"c":4}')]]):
        spark.createDataFrame(rows, "poll long, text string").coalesce(1).write.parquet(f"{src}/f={i}")
    stream = (spark.readStream.schema("poll long, text string").option("maxFilesPerTrigger", 1)
              .option("recursiveFileLookup", "true").parquet(str(src))
              .withColumn("doc", F.parse_json("text")))
    seen = []
    q = new_items_stream(stream, "doc", "poll", lambda b, i: seen.extend(r.text for r in b.select("text").collect()),
                         str(tmp_path / "ck"), available_now=True)
    q.awaitTermination()
    assert sorted(seen) == ['{"a":1,"b":2}', '{"c":3}', '{"c":4}']


def test_streaming_enrich_sends_keys_only(spark, tmp_path):
    from docweave.operators.enrich import enrich
    big = 9007199254740993
    spark.createDataFrame([(1, big, "x", None), (2, None, "y", "z")], "id int, k long, a string, b string") \
        .coalesce(1).write.parquet(str(tmp_path / "src"))
    stream = spark.readStream.schema("id int, k long, a string, b string").parquet(str(tmp_path / "src"))
    out = enrich(stream, "k", "text", lambda keys: keys.astype(str))
    q = (out.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "ck"))
         .trigger(availableNow=True).start(str(tmp_path / "out")))
    q.awaitTermination()
    got = sorted(map(tuple, spark.read.parquet(str(tmp_path / "out")).collect()))
    assert got == [(1, big, "x", None, str(big)), (2, None, "y", "z", None)]


def test_shared_nodes_run_once(spark):
    calls = spark.sparkContext.accumulator(0)

    def slow(df):
        from docweave.operators.user import flat_map_docs

        def one(r):
            calls.add(1)
            return [r]
        return flat_map_docs(df, one, "id long")

    p = (Dataflow().source("s", lambda s: s.range(2)).transform("t", slow, "s")
         .sink("a", lambda d: d.count(), "t").sink("b", lambda d: d.count(), "t"))
    assert p.run(spark) == {"a": 2, "b": 2} and calls.value == 2


def test_several_streaming_sources(spark, tmp_path):
    out = tmp_path / "out"
    p = (Dataflow()
         .source("nations", lambda s: stream_table(s, SF01, "nation").select(F.col("n_name").alias("name")))
         .source("regions", lambda s: stream_table(s, SF01, "region").select(F.col("r_name").alias("name")))
         .transform("upper", lambda d: d.withColumn("name", F.upper("name")), "nations", "regions")
         .sink("all", lambda d, b, src: d.write.mode("overwrite").parquet(f"{out}/{src}={b}"), "upper"))
    for q in p.run_stream(spark, str(tmp_path / "ck"), available_now=True):
        q.awaitTermination()
    assert spark.read.option("recursiveFileLookup", "true").parquet(str(out)).count() == 30


def test_sink_and_split_parallelism(spark):
    p = (Dataflow().source("s", lambda s: s.range(100))
         .transform("t", lambda d: split(d, "id", ">", "49"), "s", parallelism=3)
         .sink("yes", lambda d: d.rdd.getNumPartitions(), Edge("t", "yes"))
         .sink("no", lambda d: d.rdd.getNumPartitions(), Edge("t", "no"), parallelism=5))
    assert p.run(spark) == {"yes": 3, "no": 5}


def test_source_and_log_components(spark, tmp_path):
    from docweave.plans.components import component, credentials
    xml = "<rss><channel><item><title>One</title><n>1</n></item><item><title>Two</title></item></channel></rss>"
    landed = lambda s, p: s.createDataFrame([(xml,)], "xml string")
    p = (Dataflow().source("feed", component("rss", {"url": "u", "frequency": "5"}, doc="doc", landed=landed))
         .transform("only", component("filter", {"conditions": [
             {"field": "title", "operator": "==", "value": "One"}]}, doc="doc"), "feed")
         .sink("log", component("log", {}, doc="doc", path=str(tmp_path / "log")), "only"))
    p.run(spark)
    assert [r.value for r in spark.read.text(str(tmp_path / "log")).collect()] == ['{"n":1,"title":"One"}'] or \
        [r.value for r in spark.read.text(str(tmp_path / "log")).collect()] == ['{"n":"1","title":"One"}']
    tweets = lambda s, p: s.createDataFrame([("a token",), ("none",)], "text string")
    got = component("twitter", {"keywords": ["token"], "consumerKey": "k"}, landed=tweets)(spark)
    assert got.count() == 1 and credentials({"consumerKey": "k", "x": 1}) == {"consumerKey": "k"}


def test_read_feed_attributes(spark, tmp_path):
    from docweave.sources.feeds import read_feed
    (tmp_path / "f.xml").write_text('<rss><channel><item><guid isPermaLink="false">g1</guid>'
                                    '<n>5</n></item></channel></rss>')
    row = read_feed(spark, str(tmp_path)).first()
    assert row.guid.content == "g1" and row.guid.isPermaLink is False and row.n == 5


def test_user_stream_source_and_foreach_sink(spark, tmp_path):
    import pyarrow.parquet as pq
    from docweave.sinks.writers import sink_from_function
    from docweave.sources.custom import source_from_function

    path = f"{SF01}/labels.parquet"
    n = pq.ParquetFile(path).metadata.num_rows

    def read_range(a, b):
        t = pq.read_table(path, columns=["doc_id", "quality"]).slice(a, b - a)
        yield from zip(t.column("doc_id").to_pylist(), t.column("quality").to_pylist())

    source_from_function(spark, "docweave_test_stream", "doc_id bigint, quality int",
                         [], lambda d: iter(()), latest=lambda opts: n,
                         read_range=read_range, range_splits=4)
    stream = spark.readStream.format("docweave_test_stream").load()
    out = tmp_path / "seen"
    out.mkdir()

    def process(row, state):
        state.append(row["doc_id"])

    def cleanup(state):
        if state:
            (out / f"part-{state[0]}-{len(state)}.txt").write_text("\n".join(map(str, state)))

    q = sink_from_function(stream, process, prepare=list, cleanup=cleanup,
                           checkpoint=str(tmp_path / "ck"))
    q.processAllAvailable()
    q.stop()
    seen = [int(x) for f in out.iterdir() for x in f.read_text().split()]
    assert sorted(seen) == sorted(pq.read_table(path).column("doc_id").to_pylist())


def test_run_stream_processing_time_ticks(spark, tmp_path):
    from docweave.streaming.runner import run_stream
    ticks, rows = [], []
    stream = stream_table(spark, SF01, "region")
    q = run_stream(stream, lambda b, i: rows.append(b.count()), str(tmp_path / "ck"),
                   every="1 second", on_tick=ticks.append)
    q.processAllAvailable()
    q.stop()
    assert sum(rows) == 5 and ticks and ticks[0] == 0


def test_dataflow_run_stream_reads_source_once(spark, tmp_path):
    out = tmp_path / "out"
    p = (Dataflow()
         .source("events", lambda s: stream_table(s, SF01, "events"))
         .source("nation", lambda s: s.read.parquet(f"{SF01}/nation.parquet"))
         .transform("big", lambda d: split(d, "value", ">", "100"), "events")
         .sink("yes", lambda d, b: d.write.mode("overwrite").parquet(f"{out}/yes/b={b}"),
               Edge("big", "yes"))
         .sink("no", lambda d, b: d.write.mode("overwrite").parquet(f"{out}/no/b={b}"),
               Edge("big", "no")))
    q = p.run_stream(spark, str(tmp_path / "ck"), available_now=True)
    q.awaitTermination()
    yes = spark.read.parquet(f"{out}/yes").count()
    no = spark.read.parquet(f"{out}/no").count()
    assert yes + no == 10000 and yes == spark.read.parquet(f"{SF01}/events.parquet").where("value > 100").count()


def test_map_field_udf(spark):
    from docweave.operators.user import map_field
    df = spark.createDataFrame([(1, "abc"), (2, None)], "id int, s string")
    out = {r.id: r.meta.n for r in map_field(df, "s", "meta.n", lambda x: x.str.len(), "int").collect()}
    assert out == {1: 3, 2: None}


def test_new_items_stream_prunes_old_state(spark, tmp_path):
    ev = (spark.read.parquet(f"{SF01}/events.parquet")
          .select("event_id", "user_id", "event_type",
                  (F.datediff(F.to_date("ts"), F.lit("2024-01-01").cast("date")) + 1).alias("poll")))
    src = tmp_path / "polls"
    ev.repartition(1, "poll").write.partitionBy("poll").parquet(str(src))
    stream = (spark.readStream.schema(spark.read.parquet(str(src)).schema)
              .option("maxFilesPerTrigger", 5).parquet(str(src)))
    q = new_items_stream(stream, ["user_id", "event_type"], "poll", lambda b, i: None,
                         str(tmp_path / "ck"), state_path=str(tmp_path / "state"),
                         available_now=True)
    q.awaitTermination()
    left = sorted(p.name for p in (tmp_path / "state").iterdir() if p.name.startswith("batch="))
    assert 1 <= len(left) <= 2


def test_batch_equals_stream_variant_chain(spark, tmp_path):
    from docweave.functions.paths import get_field
    from docweave.operators.reshape import flatten_doc, trim

    def chain(ev):
        docs = ev.select("event_id", F.to_variant_object(F.struct(
            "event_type", "value", F.try_parse_json("props").alias("props"))).alias("doc"))
        d = filter_docs(docs, [Cond("props.k", ">=", "20"), Cond("event_type", "!=", "error")],
                        doc="doc")
        d = rename_field(d, "props.k", "meta.k", doc="doc")
        d = trim(d, ["meta.k", "value"], doc="doc")
        d = flatten_doc(d, "_", doc="doc")
        return d.select("event_id", get_field(d, "meta_k", "doc", "bigint").alias("k"),
                        get_field(d, "value", "doc", "double").alias("value"))

    batch = chain(spark.read.parquet(f"{SF01}/events.parquet"))
    q = (chain(stream_table(spark, SF01, "events")).writeStream.format("parquet")
         .option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True)
         .start(str(tmp_path / "out")))
    q.awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out"))
    assert got.count() == batch.count() > 0
    assert got.exceptAll(batch).count() == 0 and batch.exceptAll(got).count() == 0


def test_stream_table_folder(spark, tmp_path):
    spark.read.parquet(f"{SF01}/nation.parquet").repartition(3).write.parquet(
        str(tmp_path / "nation.parquet"))
    s = stream_table(spark, str(tmp_path), "nation", max_files_per_trigger=1)
    seen = []
    from docweave.streaming.runner import run_stream
    q = run_stream(s, lambda b, i: seen.append(b.count()), str(tmp_path / "ck"), available_now=True)
    q.awaitTermination()
    assert sum(seen) == 25 and len(seen) == 3


def test_dataflow_explain(spark, capsys):
    p = (Dataflow().source("events", lambda s: s.read.parquet(f"{SF01}/events.parquet"))
         .transform("f", lambda d: filter_docs(d, [Cond("value", ">", "100")]), "events")
         .sink("log", lambda d: d.count(), "f"))
    p.explain(spark)
    out = capsys.readouterr().out
    assert "== sink log ==" in out


def test_dataflow_parallelism(spark):
    p = (Dataflow().source("nums", lambda s: s.range(100))
         .transform("spread", lambda d: d.withColumn("x", F.col("id") * 2), "nums", parallelism=3)
         .sink("parts", lambda d: d.rdd.getNumPartitions(), "spread"))
    assert p.run(spark)["parts"] == 3


def test_components_from_parameters(spark):
    from docweave.plans.components import component
    from docweave.sources.envelope import to_envelope, with_documents
    ev = spark.read.parquet(f"{SF01}/events.parquet").select("event_id", "event_type", "value")
    flow = (Dataflow()
            .source("events", lambda s: ev)
            .transform("only", component("filter", {
                "action": "permit", "match": "all", "entity": "purchase",
                "conditions": [{"field": "event_type", "operator": "==", "value": "purchase"},
                               {"field": "value", "operator": ">", "value": "100"}]}), "events")
            .transform("big", component("conditional", {"field": "value", "operator": ">=",
                                                        "value": "300"}), "only")
            .transform("renamed", component("rename", {"find": "value", "replace": "amount"}),
                       Edge("big", "no"))
            .sink("out", lambda d: d.collect(), "renamed"))
    rows = flow.run(spark)["out"]
    want = ev.where("event_type = 'purchase' AND value > 100 AND value < 300").count()
    assert len(rows) == want and {r.entity for r in rows} == {"purchase"}
    assert "amount" in rows[0].asDict()
    with pytest.raises(ValueError):
        component("rename", {"find": "a"})
    with pytest.raises(ValueError):
        component("filter", {"conditions": [], "bogus": 1})
    env = to_envelope(ev, entity="event")
    flat = with_documents(env, component("flatten", {"separator": "-"}, doc="doc"), dead_letter=False)
    assert flat.count() == ev.count()


@pytest.mark.parametrize("kind,params", [
    ("conditional_fields", {"field1": "lo", "operator": "<", "field2": "hi"}),
    ("exists", {"field": "name"}),
    ("trim", {"action": "delete", "field": ["hi"]}),
    ("short_url", {"field": "url", "saveTo": "short"}),
    ("bars", {"bars": [{"label": "lo", "id": "w1", "field": "lo"}]}),
    ("boxes", {"bars": [("a", "1", "lo"), ("b", "2", "hi"), ("c", "3", "lo")]}),
    ("map", {"latField": "lo", "lonField": "hi", "field": ["name"], "id": "m"}),
    ("timeline", {"contentField": "name", "id": "t"}),
    ("message", {"fieldToTweet": "name", "customText": "Hi", "consumerKey": "k", "accessToken": "t"}),
])
def test_every_component_kind_runs(spark, kind, params):
    from docweave.operators.split import Split
    from docweave.plans.components import component
    df = spark.createDataFrame([("e", 1.0, 2.0, "n", "http://a")],
                               "entity string, lo double, hi double, name string, url string")
    out = component(kind, params)(df)
    frames = [out.yes, out.no] if isinstance(out, Split) else [out]
    assert sum(f.count() for f in frames) >= 1
