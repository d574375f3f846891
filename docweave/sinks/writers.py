"""Sinks that write or push documents (K1, K6, K8, K9).

* ``log_sink``: the JSON text of every document -- to text files (batch or
  stream) or to the console (stream).
* ``push_rows``: post each payload through a client made once per task,
  with retries; returns every row with its status, so failures land in a
  table, with their widget and key, instead of being swallowed.
* ``sink_from_function``: a user sink with ``prepare`` / ``process`` /
  ``cleanup`` per task, for batch and streaming inputs.
"""

from __future__ import annotations

import inspect
import time
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docweave.sources.envelope import to_envelope

#: Columns that ``push_rows`` adds; input columns of the same names are replaced.
STATUS = T.StructType([T.StructField("ok", T.BooleanType()), T.StructField("attempts", T.IntegerType()),
                       T.StructField("error", T.StringType())])


def idempotency_key(payload: Column) -> Column:
    """A stable key per payload (same text, same key, on every re-run)."""
    return F.xxhash64(payload.cast("string"))


def log_sink(df: DataFrame, path: str | None = None, doc: str | None = None,
             entity: str | None = None, checkpoint: str | None = None,
             mode: str = "append"):
    """Write ``map`` (the document's JSON text) of every row (K1).

    Batch: text files under ``path`` (required).  Stream: text files with a
    checkpoint, or the console when ``path`` is None.  Returns the streaming
    query, or None for batch.
    """
    if doc is None and set(df.columns) == {"entity", "map"}:
        text = df.select("map")  # already an envelope: write its JSON text as is
    else:
        text = to_envelope(df, entity=entity, doc=doc).select("map")
    if df.isStreaming:
        w = text.writeStream.outputMode("append")
        if path is None:
            return w.format("console").option("truncate", "false").start()
        if checkpoint is None:
            raise ValueError("a streaming file sink needs a checkpoint location")
        return w.format("text").option("checkpointLocation", checkpoint).start(path)
    if path is None:
        raise ValueError("a batch log sink needs a path")
    text.write.mode(mode).text(path)
    return None


def _with_row(send: Callable) -> bool:
    """Does ``send`` take the row as a third argument?"""
    kinds = [p.kind for p in inspect.signature(send).parameters.values()]
    places = sum(k in (inspect.Parameter.POSITIONAL_ONLY, inspect.Parameter.POSITIONAL_OR_KEYWORD) for k in kinds)
    return places >= 3 or inspect.Parameter.VAR_POSITIONAL in kinds


def _push_batches(client_factory: Callable, send: Callable, payload: str, retries: int, backoff: float,
                  close: Callable | None):
    row_too = _with_row(send)

    def post(client, row: dict) -> tuple[bool, int, str | None]:
        body, err, n = row[payload], None, 0
        body = None if body is None else str(body)
        for n in range(1, retries + 2):
            try:
                send(client, body, row) if row_too else send(client, body)
                return True, n, None
            except Exception as exc:  # noqa: BLE001 - remote failure
                err = f"{type(exc).__name__}: {exc}"
                if backoff:
                    time.sleep(backoff * n)
        return False, n, err

    def run(batches):
        client = client_factory()
        try:
            for batch in batches:
                rows = batch.to_pylist() if row_too else batch.select([payload]).to_pylist()
                done = [post(client, r) for r in rows]
                status = [pa.array([d[i] for d in done], t) for i, t in
                          enumerate((pa.bool_(), pa.int32(), pa.string()))]
                yield pa.RecordBatch.from_arrays([*batch.columns, *status],
                                                 names=[*batch.schema.names, *STATUS.names])
        finally:
            if close is not None:
                close(client)
    return run


def push_rows(df: DataFrame, client_factory: Callable, send: Callable,
              payload: str = "payload", retries: int = 2, backoff: float = 0.0,
              close: Callable | None = None) -> DataFrame:
    """Post every payload; every row comes back with ``ok, attempts, error`` (K6).

    ``send(client, body)`` posts one payload; ``send(client, body, row)`` also
    gets the row as a dict, with the ``widget_id`` and any key that the
    address depends on.  Lazy like any DataFrame: write the result (e.g. the
    rows with ``ok = false`` to a failure table) to run it.  Delivery is
    at-least-once: a task re-run after a lost executor posts its payloads
    again, so the receiver should de-duplicate on
    ``idempotency_key(payload)`` (or, in a stream, on the batch id passed to
    ``foreachBatch``).
    """
    src = df.select(*[F.to_json(F.col(f"`{f.name}`")).alias(f.name) if isinstance(f.dataType, T.VariantType)
                      else F.col(f"`{f.name}`") for f in df.schema.fields if f.name not in STATUS.names])
    return src.mapInArrow(_push_batches(client_factory, send, payload, retries, backoff, close),
                          T.StructType([*src.schema.fields, *STATUS.fields]))


def push_sink(df: DataFrame, client_factory: Callable, send: Callable, failures_path: str,
              payload: str = "payload", retries: int = 2, backoff: float = 0.0,
              close: Callable | None = None, checkpoint: str | None = None):
    """Push every payload and keep the failures as a table (K6).

    Batch: runs the pushes and appends the failed rows to ``failures_path``.
    Stream: one ``foreachBatch`` per micro-batch; the failed rows of batch
    ``b`` go to ``failures_path/batch=b`` (overwritten on replay).
    """
    if df.isStreaming:
        def each(batch: DataFrame, batch_id: int) -> None:
            st = push_rows(batch, client_factory, send, payload, retries, backoff, close)
            st.where(~F.col("ok")).write.mode("overwrite").parquet(
                f"{failures_path}/batch={batch_id}")
        w = df.writeStream.foreachBatch(each)
        if checkpoint:
            w = w.option("checkpointLocation", checkpoint)
        return w.start()
    st = push_rows(df, client_factory, send, payload, retries, backoff, close)
    st.where(~F.col("ok")).write.mode("append").parquet(failures_path)
    return None


class _RowWriter:
    """``foreach`` writer built from three functions (streaming user sink)."""

    def __init__(self, process: Callable, prepare: Callable | None, cleanup: Callable | None):
        self._process, self._prepare, self._cleanup = process, prepare, cleanup
        self._state = None

    def open(self, partition_id, epoch_id):
        self._state = self._prepare() if self._prepare else None
        return True

    def process(self, row):
        if self._prepare:
            self._process(row.asDict(recursive=True), self._state)
        else:
            self._process(row.asDict(recursive=True))

    def close(self, error):
        if self._cleanup:
            self._cleanup(self._state)
        if error:
            raise error


def sink_from_function(df: DataFrame, process: Callable, prepare: Callable | None = None,
                       cleanup: Callable | None = None, checkpoint: str | None = None):
    """Run a user sink over every row (K8, K9).

    Batch: ``foreachPartition`` (``prepare`` / ``cleanup`` once per task).
    Stream: ``writeStream.foreach`` with the same three functions; returns
    the streaming query.
    """
    if df.isStreaming:
        w = df.writeStream.foreach(_RowWriter(process, prepare, cleanup))
        if checkpoint:
            w = w.option("checkpointLocation", checkpoint)
        return w.start()

    def per_partition(rows):
        state = prepare() if prepare else None
        try:
            for r in rows:
                if prepare:
                    process(r.asDict(recursive=True), state)
                else:
                    process(r.asDict(recursive=True))
        finally:
            if cleanup:
                cleanup(state)

    df.foreachPartition(per_partition)
    return None
