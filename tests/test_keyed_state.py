"""Streams with one entry of state per key: restarts, polls cut across batches, timers."""

import random
import time
from collections import Counter
from datetime import UTC, datetime

import pytest

from docweave.sources.feeds import new_items
from docweave.streaming.keyed import configure_state, keyed_ticks, new_items_keyed
from docweave.streaming.runner import run_stream


@pytest.fixture(scope="module")
def rocks(spark):
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    yield configure_state(spark)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)


class Feed:
    """A watched folder; ``run`` starts the stream anew over what has been landed since."""

    def __init__(self, spark, folder, schema):
        self.spark, self.folder, self.schema, self.landed = spark, str(folder), schema, 0

    def run(self, make, *parts):
        for rows in parts:
            self.spark.createDataFrame(rows, self.schema).coalesce(1).write.parquet(f"{self.folder}/in/{self.landed:03}")
            self.landed += 1
        stream = self.spark.readStream.schema(self.schema).option("recursiveFileLookup", "true") \
            .option("maxFilesPerTrigger", 1).parquet(f"{self.folder}/in")
        run_stream(make(stream), lambda b, i: b.write.mode("overwrite").parquet(f"{self.folder}/out/{i}"),
                   f"{self.folder}/ckpt", available_now=True).awaitTermination()
        return Counter(map(tuple, self.spark.read.option("recursiveFileLookup", "true")
                           .parquet(f"{self.folder}/out").collect()))


def test_new_items_equal_the_batch_form(rocks, tmp_path):
    rnd = random.Random(1)
    rows = [(rnd.choice(["a", "b", None]), p, rnd.choice(["x", "y", "z", None]), n)
            for p in range(1, 9) for n in range(rnd.randrange(3, 8))]
    rows += [("a", None, "x", 99), ("a", None, "x", 99)]
    schema = "feed string, poll bigint, item string, n bigint"
    feed = Feed(rocks, tmp_path, schema)
    cuts = [0, 7, 11, 12, 25, len(rows)]  # within polls
    parts = [rows[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]

    def make(stream):
        return new_items_keyed(stream, "item", "poll", feed="feed")

    feed.run(make, *parts[:2])
    got = feed.run(make, *parts[2:])
    keys = {(f, p, i) for f, p, i, _ in rows}
    assert got == Counter(r for r in rows if r[1] is None or (r[0], r[1] - 1, r[2]) not in keys)
    # where every poll has rows the batch operator gives the same
    dense = [r for r in rows if r[1] is not None and r[0] == "a"]
    if {r[1] for r in dense} == set(range(1, 9)):
        batch = new_items(rocks.createDataFrame(dense, schema), "item", "poll", feed="feed")
        assert Counter(map(tuple, batch.select("feed", "poll", "item", "n").collect())) == \
            Counter({r: n for r, n in got.items() if r[0] == "a" and r[1] is not None})


def test_a_poll_goes_to_the_workers_once(rocks, tmp_path):
    rows = [(n, p, i) for n, (p, i) in enumerate([(1, "x"), (1, "x"), (2, "x"), (2, "y"), (3, "y"), (3, "z"), (None, "x"), (5, "z")])]
    want = Counter([rows[0], rows[1], rows[3], rows[5], rows[6], rows[7]])
    for kind, item, once in (("bigint", "item", True), ("int", "item", False), ("bigint", ["item"], True)):
        feed = Feed(rocks, tmp_path / f"{kind}-{len(item)}", f"n bigint, poll {kind}, item string")
        made = []

        def make(stream, item=item, made=made):
            made.append(new_items_keyed(stream, item, "poll"))
            return made[-1]

        feed.run(make, rows[:3])
        assert feed.run(make, rows[3:]) == want
        assert made[0].columns == ["n", "poll", "item"] and made[0].schema["poll"].dataType.simpleString() == kind
        assert ("cast(poll" not in made[0]._jdf.queryExecution().analyzed().toString()) == once


def test_the_state_has_one_entry_per_item(rocks, tmp_path):
    schema = "poll bigint, item string"
    feed = Feed(rocks, tmp_path, schema)
    for poll in range(1, 5):
        got = feed.run(lambda s: new_items_keyed(s, "item", "poll"), [(poll, f"i{k}") for k in range(20)])
    assert got == Counter((1, f"i{k}") for k in range(20))
    state = rocks.read.format("statestore").load(f"{tmp_path}/ckpt")
    assert state.count() == 20 and state.select("value.groupState.last").distinct().collect()[0][0] == 4


def test_event_time_ticks(rocks, tmp_path):
    feed = Feed(rocks, tmp_path, "k string, at timestamp")

    def make(stream):
        def on_tick(key, entry, tick):
            n = entry[0] + 1
            return ((n,) if n < 3 or key[0] != "gone" else None), [(key[0], tick, n)]  # one key ends after three

        return keyed_ticks(stream, "k", lambda e, rows: e or (0,), on_tick, "n int", "k string, tick bigint, n int",
                           10_000, time="at")

    def at(k, s):
        return (k, datetime.fromtimestamp(s, UTC))

    feed.run(make, [at("a", 3), at("gone", 5)], [at("b", 27)])
    got = feed.run(make, [at("a", 31)], [at("b", 61)])
    want = [("a", t * 10_000, t) for t in range(1, 7)] + [("gone", t * 10_000, t) for t in range(1, 4)]
    want += [("b", (t + 2) * 10_000, t) for t in range(1, 5)]
    assert got == Counter(want)


def test_ticks_by_the_clock_without_new_rows(rocks, tmp_path):
    rocks.createDataFrame([("a",), ("b",)], "k string").coalesce(1).write.parquet(f"{tmp_path}/in/0")
    stream = rocks.readStream.schema("k string").option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")
    out = keyed_ticks(stream, "k", lambda e, rows: ((e or (0,))[0] + len(rows),),
                      lambda key, entry, tick: (entry, [(key[0], tick, entry[0])]),
                      "n bigint", "k string, tick bigint, n bigint", 1000)
    rows = []
    q = run_stream(out, lambda b, i: rows.extend(map(tuple, b.collect())), f"{tmp_path}/ckpt", every="1 second")
    end = time.time() + 60
    while time.time() < end and min(Counter(r[0] for r in rows).values(), default=0) < 2:
        time.sleep(0.5)
    q.stop()
    ticks = Counter((k, t) for k, t, _ in rows)
    assert set(ticks.values()) == {1} and all(t % 1000 == 0 for _, t in ticks) and {n for *_, n in rows} == {1}
    assert {k for k, _ in ticks} == {"a", "b"}


def test_keys_of_a_bucket_share_calls(rocks, tmp_path):
    def at(k, n, s):
        return (k, n, datetime.fromtimestamp(s, UTC) if s is not None else None)

    big = 2**60 + 1
    first = [at("a", 1, 3), at("a", big, 12), at(None, 1, 5), at("gone", None, 5), at("a", 1, 2), at("b", None, None), at("b", 2, None)]
    later = [[at("b", None, 27), at("a", big, 33)], [at(None, 1, 36), at("a", 1, 40)], [at("b", 2, 71)]]
    got = {}
    for buckets in (None, 1, 3):
        calls = rocks.sparkContext.accumulator(0)

        def make(stream, buckets=buckets, calls=calls):
            def on_tick(key, entry, tick):
                k, n = (None if v != v else v for v in key)
                entry = entry[0] + 1, entry[1]
                return (entry if k != "gone" or entry[0] < 3 else None), [(k, None if n is None else int(n), tick, *entry)]

            def update(entry, rows):
                calls.add(1)
                assert list(rows.index) == list(range(len(rows))) and list(rows.columns) == ["k", "n", "at"]
                return (entry[0] if entry else 0), (entry[1] if entry else 0) + len(rows)

            return keyed_ticks(stream, ["k", "n"], update, on_tick, "ticks int, seen bigint",
                               "k string, n bigint, tick bigint, ticks int, seen bigint", 10_000, time="at", buckets=buckets)

        feed = Feed(rocks, tmp_path / str(buckets), "k string, n bigint, at timestamp")
        feed.run(make, first, later[0])
        got[buckets] = feed.run(make, *later[1:])
        assert calls.value == 11
        if buckets == 1:  # an entry by the columns that are null, not by key
            state = rocks.read.format("statestore").load(f"{tmp_path}/1/ckpt")
            assert 0 < state.count() <= 3
    assert got[None] == got[1] == got[3] and {r[:2] for r in got[1]} == {("a", 1), ("a", big), (None, 1), ("gone", None), ("b", None), ("b", 2)}
    with pytest.raises(ValueError, match="buckets"):
        keyed_ticks(rocks.readStream.format("rate").load(), "timestamp", None, None, "n int", "n int", 1000, buckets=2)
