"""Running operators as streams.

Every operator of the package is a DataFrame -> DataFrame function made of
Catalyst expressions, so it applies unchanged to ``spark.readStream`` input.
This module adds what only a stream needs: a file-stream reader for the
tables, a runner with a trigger and a periodic ``on_tick`` hook, one-pass
fan-out to several sinks, and incremental new-item detection with its state
kept as a table under the checkpoint folder.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docweave.sources.feeds import SEQ, comparable_keys, null_safe_on, snapshot_diff


def stream_table(spark: SparkSession, sf_dir: str, table: str,
                 max_files_per_trigger: int | None = None) -> DataFrame:
    """A file stream over ``<sf_dir>/<table>.parquet`` (one file or a folder of files)."""
    path = f"{sf_dir.rstrip('/')}/{table}.parquet"
    schema = spark.read.parquet(path).schema
    reader = spark.readStream.schema(schema)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    jvm = spark.sparkContext._jvm
    hpath = jvm.org.apache.hadoop.fs.Path(path)
    fs = hpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if fs.getFileStatus(hpath).isDirectory():
        return reader.parquet(path)  # a table stored as a folder of files
    # a table stored as one file: stream its folder, keeping only that file
    return reader.option("pathGlobFilter", f"{table}.parquet").parquet(sf_dir)


def run_stream(df: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str,
               every: str | None = None, available_now: bool = False,
               on_tick: Callable[[int], None] | None = None, query_name: str | None = None):
    """Start a stream whose micro-batches go to ``sink(batch_df, batch_id)``.

    ``every`` is a processing-time trigger ("5 seconds"); ``on_tick`` runs
    once per micro-batch after the sink (the periodic tick of the
    reference).  ``available_now`` processes what is there and stops.
    """
    def each(batch: DataFrame, batch_id: int) -> None:
        sink(batch, batch_id)
        if on_tick is not None:
            on_tick(batch_id)

    w = df.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
    if query_name:
        w = w.queryName(query_name)
    if available_now:
        w = w.trigger(availableNow=True)
    elif every:
        w = w.trigger(processingTime=every)
    return w.start()


def fan_out_stream(df: DataFrame, writers: Sequence[Callable[[DataFrame, int], None]],
                   checkpoint: str, **kwargs):
    """Read the source once per micro-batch and hand it to every writer."""
    def sink(batch: DataFrame, batch_id: int) -> None:
        batch.persist()
        try:
            for w in writers:
                w(batch, batch_id)
        finally:
            batch.unpersist()
    return run_stream(df, sink, checkpoint, **kwargs)



def _drop_old_states(spark: SparkSession, root: str, keep_from: int) -> None:
    """Delete state snapshots of batches before ``keep_from`` (Hadoop FS, any store)."""
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    base = jvm.org.apache.hadoop.fs.Path(root)
    fs = base.getFileSystem(conf)
    if not fs.exists(base):
        return
    for st in fs.listStatus(base):
        name = st.getPath().getName()
        if name.startswith("batch="):
            try:
                bid = int(name.split("=", 1)[1])
            except ValueError:
                continue
            if bid < keep_from:
                fs.delete(st.getPath(), True)


def _state_batches(spark: SparkSession, root: str) -> list[int]:
    """Ids of the batches that have left a state; errors of the store are raised."""
    jvm = spark.sparkContext._jvm
    base = jvm.org.apache.hadoop.fs.Path(root)
    fs = base.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(base):
        return []
    found = []
    for st in fs.listStatus(base):
        name = st.getPath().getName()
        done = jvm.org.apache.hadoop.fs.Path(st.getPath(), "_SUCCESS")
        if name.startswith("batch=") and name[6:].isdigit() and fs.exists(done):
            found.append(int(name[6:]))
    return sorted(found)


def _previous_state(spark: SparkSession, root: str, batch_id: int,
                    empty_like: DataFrame) -> DataFrame:
    """State written by the latest batch before ``batch_id`` (empty for the first)."""
    earlier = [b for b in _state_batches(spark, root) if b < batch_id]
    if not earlier:
        return empty_like.limit(0)
    return spark.read.schema(empty_like.schema).parquet(f"{root}/batch={earlier[-1]}")


def new_items_stream(df: DataFrame, item: str | Sequence[str], poll: str,
                     output: Callable[[DataFrame, int], None], checkpoint: str,
                     state_path: str | None = None,
                     feed: str | Sequence[str] | None = None, **kwargs):
    """Incremental new-item detection over a stream of polls.

    ``poll`` numbers each feed's polls densely, as the poller does.  Micro-batch
    borders know nothing of polls: a poll may come in several batches, as long
    as the polls of a feed come one after the other.  An item is
    compared with the whole previous poll, by the same anti join as
    ``new_items``; the state therefore keeps the keys of each feed's last *two*
    polls.  It is a table per batch id under the checkpoint (or
    ``state_path``), so a replayed batch gives the same answer and a restarted
    stream goes on where it stopped.  Rows without a poll (NULL) all pass.
    VARIANT items (whole documents) are compared by their JSON text.
    """
    spark = df.sparkSession
    feeds = [feed] if isinstance(feed, str) else list(feed or [])
    items = [item] if isinstance(item, str) else list(item)
    state_root = state_path or f"{checkpoint.rstrip('/')}/new-items-state"

    def sink(batch: DataFrame, batch_id: int) -> None:
        rows, keys_of = comparable_keys(batch.withColumn(SEQ, F.col(poll).cast("bigint")), items)
        key_cols = feeds + keys_of
        keys = rows.where(F.col(SEQ).isNotNull()).select(*key_cols, SEQ).distinct()
        all_keys = keys.unionByName(_previous_state(spark, state_root, batch_id, keys)).distinct()
        shifted = all_keys.withColumn(SEQ, F.col(SEQ) + 1)
        fresh = snapshot_diff(rows, shifted, key_cols + [SEQ])
        output(fresh.drop(*[c for c in keys_of if c not in items]), batch_id)
        # state for the next batch: keys of each feed's last two polls seen so far
        last = (all_keys.groupBy(*feeds) if feeds else all_keys.groupBy()).agg(F.max(SEQ).alias("__last"))
        if feeds:
            ends = last.select(*[F.col(f).alias(f"__f{i}") for i, f in enumerate(feeds)], "__last")
            on = null_safe_on(all_keys, ends, [(f, f"__f{i}") for i, f in enumerate(feeds)])
            joined = all_keys.join(ends, on)
        else:
            joined = all_keys.crossJoin(F.broadcast(last))  # one row
        latest = joined.where(F.col(SEQ) >= F.col("__last") - 1).select(*key_cols, SEQ)
        latest.write.mode("overwrite").parquet(f"{state_root}/batch={batch_id}")
        # a replay of this batch needs batch_id - 1; older snapshots are never read again
        _drop_old_states(spark, state_root, batch_id - 1)

    return run_stream(df, sink, checkpoint, **kwargs)
