"""Sources: envelopes, malformed documents, feeds, new items, keywords, samples."""

from pyspark.sql import functions as F

from docweave.sources.envelope import (decode_envelope, parse_documents, split_malformed,
                                       to_envelope)
from docweave.sources.feeds import new_items, parse_feed, read_feed, snapshot_diff
from docweave.sources.social import sample_stream, track_keyword_table, track_keywords


def test_decode_envelope(spark):
    df = spark.createDataFrame([("t", bytearray(b"a\xffb"))], "topic string, value binary")
    assert decode_envelope(df).first().asDict() == {"entity": "t", "map": "a�b"}


def test_malformed(spark):
    df = spark.createDataFrame([("e", "{bad"), ("e", "[1]"), ("e", '{"k":1}')],
                               "entity string, map string")
    s = split_malformed(df)
    assert [r.map for r in s.yes.collect()] == ['{"k":1}']
    assert sorted(r.reason for r in s.no.collect()) == ["malformed", "not an object"]


def test_duplicate_keys_last_wins(spark):
    df = parse_documents(spark.createDataFrame([("e", '{"a":1,"a":2}')], "entity string, map string"))
    assert df.select(F.try_variant_get("doc", "$.a", "int")).first()[0] == 2


def test_envelope_keeps_nulls(spark):
    df = spark.createDataFrame([(1, None)], "a int, b string")
    assert to_envelope(df, entity="x").first().asDict() == {"entity": "x", "map": '{"a":1,"b":null}'}


def _polls(spark, rows):
    return spark.createDataFrame(rows, "feed string, poll int, item string")


def test_new_items_golden(spark):
    df = _polls(spark, [("f", 1, "A"), ("f", 1, "B"), ("f", 2, "B"), ("f", 2, "C"), ("f", 3, "A")])
    got = sorted((r.poll_seq, r.item) for r in new_items(df, "item", "poll", "feed").collect())
    assert got == [(1, "A"), (1, "B"), (2, "C"), (3, "A")]


def test_new_items_duplicates_and_gaps(spark):
    df = _polls(spark, [("f", 1, "A"), ("f", 1, "A"), ("f", 2, "A"), ("f", 2, "B"), ("f", 2, "B"),
                        ("g", 10, "B"), ("g", 30, "B"), ("g", 40, None), ("g", 50, None)])
    got = sorted((r.feed, r.poll_seq, r.item or "-") for r in
                 new_items(df, "item", "poll", "feed").collect())
    # feed g: polls 10, 30, 40, 50 are its 1st..4th; null items compare equal
    assert got == [("f", 1, "A"), ("f", 1, "A"), ("f", 2, "B"), ("f", 2, "B"),
                   ("g", 1, "B"), ("g", 3, "-")]


def test_new_items_single_poll_identity(spark):
    df = _polls(spark, [("f", 7, "A"), ("f", 7, "B"), ("f", 7, "A")])
    assert new_items(df, "item", "poll", "feed").count() == 3


def test_snapshot_diff(spark):
    cur = spark.createDataFrame([(1, "a"), (2, "b"), (2, "b")], "k int, v string")
    prev = spark.createDataFrame([(1, "z")], "k int, v string")
    assert sorted(r.k for r in snapshot_diff(cur, prev, "k").collect()) == [2, 2]


FEED = """<?xml version="1.0"?><rss><channel><title>t</title>
<item><title> One </title><link>http://a/1</link></item>
<item><title>Two &amp; more</title><link>http://a/2</link></item>
</channel></rss>"""
ONE = "<rss><channel><item><title>Only</title><link>http://a/3</link></item></channel></rss>"


def test_parse_feed(spark):
    df = spark.createDataFrame([(1, FEED), (2, ONE)], "poll int, xml string")
    out = parse_feed(df, "xml", "title string, link string", keep=["poll"])
    got = sorted((r.poll, r.title, r.entity) for r in out.collect())
    assert got == [(1, "One", "rssItem"), (1, "Two & more", "rssItem"), (2, "Only", "rssItem")]


def test_read_feed_files(spark, tmp_path):
    (tmp_path / "poll1.xml").write_text(FEED)
    (tmp_path / "poll2.xml").write_text(ONE)
    out = read_feed(spark, str(tmp_path), "title string, link string")
    assert sorted(r.title for r in out.collect()) == ["One", "Only", "Two & more"]


def test_track_keywords(spark):
    df = spark.createDataFrame([(1, "The Token is here"), (2, "tokens everywhere"),
                                (3, "big-token."), (4, "nothing")], "id int, text string")
    assert sorted(r.id for r in track_keywords(df, "text", [" token "]).collect()) == [1, 3]


def test_keyword_table_equals_the_pattern(spark):
    import random
    rng = random.Random(3)
    pieces = ["a", "ab", "b", "c++", "+", "++", "é", "éa", "_", "-", " ", " ", " ", ".", "x1", "\u0301", "\u200d", "$", "\n"]
    texts = [(i, "".join(rng.choices(pieces, k=rng.randrange(0, 9)))) for i in range(400)] + [(1000, None), (1001, "")]
    words = [" AB ", "a b", "c++", "++", "+", "éa", "a-b", "a.b", "x1 a", "$", "_", "É", "a\u0301"]
    docs = spark.createDataFrame([(i, t, t) for i, t in texts], "id int, text string, word string").repartition(3)
    for chosen in ([w] for w in words):
        want = sorted(r.id for r in track_keywords(docs, "text", chosen).collect())
        table = spark.createDataFrame([(w,) for w in [*chosen, None, " ", *chosen]], "word string")
        assert sorted(r.id for r in track_keyword_table(docs, "text", table, "word").collect()) == want, chosen
        if chosen[0] in ("c++", "a b", "++", "éa"):
            assert sorted(r.id for r in track_keyword_table(docs, "text", table, "word", max_rows=0).collect()) == want
    every = spark.createDataFrame([(w,) for w in words], "word string")
    want = sorted(r.id for r in track_keywords(docs, "text", words).collect())
    assert 0 < len(want) < len(texts)
    for rows in (100, 0):
        out = track_keyword_table(docs, "text", every, "word", max_rows=rows)
        assert out.columns == docs.columns and sorted(r.id for r in out.collect()) == want
    assert track_keyword_table(docs, "text", every.where("false"), "word").count() == 0
    assert track_keyword_table(docs, "text", every.where("false"), "word", max_rows=0).count() == 0


def test_the_keyword_join_shuffles_no_texts_by_word(spark):
    # keywords of one word need no text beside the anchors; for the others it comes once per row
    docs = spark.range(300).select("id", F.concat(F.lit("alpha beta w"), F.col("id") % 50, F.lit(" C++ ; w7 (x)")).alias("text")) \
        .unionByName(spark.createDataFrame([(900, None), (901, "w3"), (901, "w3"), (902, "gamma")], "id bigint, text string"))
    for words, longer in ((["W3", "w49", "none"], False), (["w3", "Beta W7", "w7 (x", "++"], True), (["beta w8", "a w9"], True)):
        table = spark.createDataFrame([(w,) for w in words], "word string")
        out = track_keyword_table(docs, "text", table, "word", max_rows=0)
        want = sorted(r.id for r in track_keywords(docs, "text", words).collect())
        assert sorted(r.id for r in out.collect()) == want and want
        plan = out._jdf.queryExecution().optimizedPlan().toString()
        assert ("__lowered" in plan) == longer


def test_a_keyword_table_is_made_once(spark):
    # the table may be derived from all the texts: measuring, listing and joining it must not derive it again
    docs = spark.createDataFrame([(1, "a w3 b"), (2, "none"), (3, "W7")], "id int, text string")
    for rows in (100, 5, 0):
        made = spark.sparkContext.accumulator(0)

        def count(i, made=made):
            made.add(1)
            return (f"w{i}",)

        table = spark.createDataFrame(spark.sparkContext.parallelize(range(20), 2).map(count), "word string")
        got = track_keyword_table(docs, "text", table, "word", max_rows=rows)
        assert sorted(r.id for r in got.collect()) == [1, 3]
        assert made.value == 20, rows


def test_ten_thousand_keywords(spark):
    docs = spark.range(2000).select("id", F.concat(F.lit("see k"), F.col("id") * 7, F.lit("x, and so on")).alias("text"))
    table = spark.range(10_000).select(F.concat(F.lit("K"), "id", F.lit("X")).alias("word"))
    for rows in (20_000, 0):
        got = track_keyword_table(docs, "text", table, "word", max_rows=rows)
        assert got.count() == 1429 and got.agg(F.max("id")).first()[0] == 1428


def test_sample_hash_is_stable(spark):
    df = spark.range(20000)
    a = sample_stream(df, "id", 0.25)
    n = a.count()
    assert 4000 < n < 6000
    assert a.exceptAll(sample_stream(df, "id", 0.25)).count() == 0


def test_new_items_whole_document_items(spark):
    rows = [(1, '{"a":1,"b":2}'), (1, '{"c":3}'), (2, '{"b":2,"a":1}'), (2, '{"c":4}')]
    df = spark.createDataFrame(rows, "poll int, item string").withColumn("doc", F.parse_json("item"))
    got = sorted((r.poll_seq, r.item) for r in new_items(df, "doc", "poll").collect())
    # the same object with its keys in another order is the same item
    assert got == [(1, '{"a":1,"b":2}'), (1, '{"c":3}'), (2, '{"c":4}')]


def test_with_documents_split_and_dead_letter(spark):
    from docweave.operators.split import split
    from docweave.sources.envelope import with_documents
    env = spark.createDataFrame([("e", '{"n":5}'), ("e", '{"n":50}'), ("e", "{bad")],
                                "entity string, map string")
    (out, dead) = with_documents(env, lambda d: split(d, "n", ">", "10", doc="doc"),
                                 dead_letter=True)
    assert [r.map for r in out.yes.collect()] == ['{"n":50}']
    assert [r.map for r in out.no.collect()] == ['{"n":5}']
    assert dead.count() == 1


def test_dense_number_distributed(spark):
    from docweave.sources.feeds import dense_number
    vals = spark.range(0, 5000, 7).select((F.col("id") * 3).alias("v"))
    out = dense_number(vals, "v", "seq", partitions=6)
    got = sorted((r.v, r.seq) for r in out.collect())
    assert [s for _, s in got] == list(range(1, len(got) + 1))


def test_read_documents_text_and_typed(spark, tmp_path):
    from docweave.sources.envelope import read_documents
    (tmp_path / "d.json").write_text('{"a":1,"b":{"c":"x"}}\n{bad\n{"a":2}\n')
    env = read_documents(spark, str(tmp_path), entity="tweet")
    assert env.columns == ["entity", "map"] and env.count() == 3
    typed = read_documents(spark, str(tmp_path), entity="tweet", schema="a bigint, b struct<c:string>")
    rows = sorted(typed.collect(), key=lambda r: (r.a is None, r.a))
    assert [r.a for r in rows] == [1, 2, None]
    assert rows[2]["_corrupt_record"] == "{bad" and rows[0].b.c == "x"
