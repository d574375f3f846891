"""Keyed state in the state store: new items by item, and timers per key.

``applyInPandasWithState`` keeps one small entry per key, so what a micro-batch
writes follows its own keys and not the whole feed.  ``configure_state`` selects
the RocksDB store, whose entries need not fit into memory.  State lies in the
stream's checkpoint: a restarted stream goes on with it, a replayed batch reads
the state of the batch before.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupStateTimeout

from docweave.sources.feeds import SEQ, comparable_keys

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def configure_state(spark: SparkSession) -> SparkSession:
    """RocksDB for state, with changelog checkpoints: a batch uploads what it changed."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    spark.conf.set("spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled", "true")
    return spark


def _names(columns: str | Sequence[str] | None) -> list[str]:
    return [columns] if isinstance(columns, str) else list(columns or [])


def new_items_keyed(df: DataFrame, item: str | Sequence[str], poll: str, feed: str | Sequence[str] | None = None,
                    forget_after_ms: int | None = None) -> DataFrame:
    """The rows of a stream of polls whose item was not in its feed's previous poll.

    The rows of ``new_items``; ``poll`` numbers each feed's polls densely, as the
    poller does.  An item's entry is its last two polls.  A poll may come in
    several micro-batches, as long as the polls of a feed come one after the
    other; within a micro-batch rows may come in any order.  Duplicates within a
    poll all pass, rows without a poll (NULL) too; NULL is an item like others.
    A late row of a poll before the last two passes.  With ``forget_after_ms``
    (processing time, more than two polls take) entries of items that have not
    been seen for so long are dropped; without it an entry stays.

    Rows of one item are held until the item's polls of the micro-batch are
    known, so the source's admission limit (``maxFilesPerTrigger``) bounds a
    task's memory.  Where one item may fill a micro-batch, use
    ``new_items_stream``, whose join splits hot items.
    """
    items, feeds = _names(item), _names(feed)
    columns = list(df.columns)
    # a poll that is a bigint goes to the workers once, every column costs time per key
    sole = isinstance(df.schema[poll].dataType, T.LongType) and poll not in (*items, *feeds) \
        and (poll == SEQ or SEQ not in columns)
    numbered = df.withColumnRenamed(poll, SEQ) if sole else df.withColumn(SEQ, F.col(poll).cast("bigint"))
    rows, keys = comparable_keys(numbered, items)
    sent = [SEQ if sole and c == poll else c for c in columns]
    schema = T.StructType([rows.schema[c] for c in sent])
    whole = sent == list(rows.columns)

    def fresh(key, frames, state):
        if state.hasTimedOut:
            state.remove()
            return
        known = set(state.get) if state.exists else set()
        held: list[tuple] = []
        for frame in frames:
            polls = [None if p != p else int(p) for p in frame[SEQ].to_numpy().tolist()]
            known.update(p for p in polls if p is not None)
            if not all(p is not None and p - 1 in known for p in polls):
                held.append((frame, polls))
        for frame, polls in held:
            new = [i for i, p in enumerate(polls) if p is None or p - 1 not in known]
            if new:
                out = frame if len(new) == len(polls) else frame.take(new)
                yield out if whole else out[sent]
        last = sorted(known)[-2:]
        if last:
            state.update((last[-1], last[0]))  # the same one twice if there is one only
            if forget_after_ms is not None:
                state.setTimeoutDuration(forget_after_ms)

    timeout = GroupStateTimeout.NoTimeout if forget_after_ms is None else GroupStateTimeout.ProcessingTimeTimeout
    out = rows.groupBy(*feeds, *keys).applyInPandasWithState(
        fresh, schema, "last bigint, before bigint", "append", timeout)
    return out.withColumnRenamed(SEQ, poll) if sole else out


#: Types whose values are the same in a frame, in an entry of state and as a key of a dict.
_PLAIN = (T.StringType(), T.BooleanType(), T.ByteType(), T.ShortType(), T.IntegerType(), T.LongType())


def _begin(times: pd.Series, now: int) -> int:
    """The earliest of ``times`` in milliseconds, or ``now`` where all are null."""
    values = times.to_numpy().astype("datetime64[ns]").view("int64")
    least = values.min()
    if least == pd.NaT.value:
        values = values[values != least]
        if not len(values):
            return now
        least = values.min()
    return int(least) // 1_000_000


def _by_key(frame: pd.DataFrame, names: Sequence[str], nulls: Sequence[bool]) -> Iterable[tuple[tuple, pd.DataFrame]]:
    """The rows of each key, in their order; ``nulls`` tells the key columns that are null in all rows."""
    places: dict[tuple, list[int]] = {}
    columns = [[None] * len(frame) if null else frame[n].tolist() for n, null in zip(names, nulls, strict=True)]
    for i, key in enumerate(zip(*columns, strict=True)):
        places.setdefault(key, []).append(i)
    ordered = frame.take([i for at in places.values() for i in at])
    end = 0
    for key, at in places.items():
        begin, end = end, end + len(at)
        rows = ordered.iloc[begin:end]
        rows.index = pd.RangeIndex(len(at))
        yield key, rows


def keyed_ticks(df: DataFrame, keys: str | Sequence[str], update: Callable[[tuple | None, pd.DataFrame], tuple],
                on_tick: Callable[[tuple, tuple, int], tuple[tuple | None, Iterable[tuple]]],
                state: str, output: str, every_ms: int, time: str | None = None, delay: str = "0 seconds",
                buckets: int | None = None) -> DataFrame:
    """A periodic tick for every key of a stream, also while no row of the key comes.

    ``update(entry or None, rows)`` gives a key's new entry (a tuple of the
    schema ``state``); ``on_tick(key, entry, tick)`` gives the entry to go on
    with, or None to drop the key and its timer, and rows of ``output``.  Ticks
    are the multiples of ``every_ms`` in epoch milliseconds after the key's
    first row.  With ``time`` they follow event time: a tick fires, once, when
    the watermark (``delay`` behind the latest row) has passed it, and rows
    older than the watermark are dropped.  Without, they follow the clock, and
    a tick that a stopped stream has missed fires when it is started again.
    Rows of a key are given to ``update`` one batch at a time.

    Spark calls Python once per key and batch, which takes milliseconds.  Where
    a batch brings rows or ticks for most keys, ``buckets`` lets the keys that
    hash alike share a call, an entry of state and a timer; each keeps its own
    entry and ticks in it.  A batch then writes the whole entry of every bucket
    that it touches, so choose it for some hundred to a thousand keys a bucket;
    as for shuffle partitions, the number holds as long as the checkpoint.
    Keys are strings, booleans or whole numbers then, nulls are None, and a
    column of ``rows`` has the pandas type of its bucket's rows.
    """
    names = _names(keys)
    entry = T._parse_datatype_string(state)
    out_schema = T._parse_datatype_string(output)
    out_names = out_schema.names

    def due(key, own, tick, now, rows):
        """Ticks until ``now``: the entry and the tick to go on with."""
        while own is not None and tick <= now:
            own, made = on_tick(key, own, tick)
            rows += made
            tick += every_ms
        return own, tick

    def taken(own, tick, frame, now):
        begin = _begin(frame[time], now) if time else now
        first = (max(begin, now) // every_ms + 1) * every_ms
        return update(own, frame), first if own is None else min(tick, first)

    def wait(group, tick, now):
        if time:
            group.setTimeoutTimestamp(tick)
        else:
            group.setTimeoutDuration(max(1, tick - now))

    def clock(group):
        return group.getCurrentWatermarkMs() if time else group.getCurrentProcessingTimeMs()

    def step(key, frames, group):
        now = clock(group)
        own, tick = (tuple(group.get[:-1]), group.get[-1]) if group.exists else (None, None)
        rows: list[tuple] = []
        # ticks that are due come before the rows of this batch
        own, tick = due(key, own, tick, now, rows)
        if not group.hasTimedOut:
            for frame in frames:
                if len(frame):
                    own, tick = taken(own, tick, frame, now)
        if own is None:
            if group.exists:
                group.remove()
        else:
            group.update((*own, tick))
            wait(group, tick, now)
        if rows:
            yield pd.DataFrame(rows, columns=out_names)

    def step_bucket(bucket, frames, group):
        now = clock(group)
        rows: list[tuple] = []
        held = {}
        if group.exists:
            for key, own, tick in group.get[0]:
                own, tick = due(tuple(key), tuple(own), tick, now, rows)
                if own is not None:
                    held[tuple(key)] = own, tick
        if not group.hasTimedOut:
            for frame in frames:
                if len(frame):
                    for key, part in _by_key(frame[columns], names, bucket[1:]):
                        held[key] = taken(*held.get(key, (None, None)), part, now)
        if not held:
            if group.exists:
                group.remove()
        else:
            group.update(([(key, tuple(own), tick) for key, (own, tick) in held.items()],))
            wait(group, min(tick for _, tick in held.values()), now)
        if rows:
            yield pd.DataFrame(rows, columns=out_names)

    source = df.withWatermark(time, delay) if time else df
    timeout = GroupStateTimeout.EventTimeTimeout if time else GroupStateTimeout.ProcessingTimeTimeout
    if buckets is None:
        kept = T.StructType([*entry.fields, T.StructField("__next", T.LongType())])
        return source.groupBy(*names).applyInPandasWithState(step, out_schema, kept, "append", timeout)
    columns = list(df.columns)
    types = [df.schema[n].dataType for n in names]
    if any(t not in _PLAIN for t in types):
        raise ValueError("with buckets, keys are strings, booleans or whole numbers")
    key_type = T.StructType([T.StructField(f"_{i}", t) for i, t in enumerate(types)])
    one = T.StructType([T.StructField("key", key_type), T.StructField("entry", entry), T.StructField("next", T.LongType())])
    # a bucket's keys are null in the same columns, so a frame has no whole numbers among nulls
    nulls = {f"__null{i}": F.col(n).isNull() for i, n in enumerate(names)}
    dealt = source.withColumns({"__bucket": F.pmod(F.xxhash64(*names), F.lit(buckets)), **nulls})
    return dealt.groupBy("__bucket", *nulls).applyInPandasWithState(
        step_bucket, out_schema, T.StructType([T.StructField("keys", T.ArrayType(one))]), "append", timeout)
