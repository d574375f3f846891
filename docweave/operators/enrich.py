"""Enrichment: look up a derived value for a field and store it.

The reference calls a remote service once per document.  Here the lookup
runs once per *distinct key*: keys are de-duplicated (partial aggregation
before the shuffle), looked up in Arrow batches with one client per task,
and joined back.  A key whose lookup fails gets NULL; the document is kept.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from docweave.functions import paths as P
from docweave.functions.sizing import (DEFAULT_BROADCAST_ROWS, broadcast_derived,
                                       sized_broadcast)
from docweave.operators.reshape import add_field

KEY = "__enrich_key"
VAL = "__enrich_value"
#: Keys whose values a streaming task remembers; beyond that it starts anew.
STREAM_KEYS = 100_000


def _chunks(batches, size: int | None):
    for pdf in batches:
        if not size or len(pdf) <= size:
            yield pdf
        else:
            for start in range(0, len(pdf), size):
                yield pdf.iloc[start:start + size]


def _call(fn: Callable, keys: pd.Series, client, with_client: bool,
          vectorized: bool) -> pd.Series:
    """Look up one chunk of keys; if the batch call fails, one key at a time (NULL on error)."""
    if vectorized:
        try:
            out = fn(keys, client) if with_client else fn(keys)
            return pd.Series(out, index=keys.index)
        except Exception:  # noqa: BLE001 - fall back to single keys
            pass
    vals = []
    for k in keys:
        try:
            if vectorized:
                one = (fn(pd.Series([k]), client) if with_client else fn(pd.Series([k]))).iloc[0]
            else:
                one = fn(k, client) if with_client else fn(k)
        except Exception:  # noqa: BLE001 - a failed key keeps the document without value
            one = None
        vals.append(one)
    return pd.Series(vals, index=keys.index, dtype=object)


def _lookup_batches(fn: Callable, vectorized: bool, client_factory: Callable | None,
                    close: Callable | None, batch_size: int | None = None):
    """``mapInPandas`` body over distinct keys: one client per task."""
    def run(batches):
        client = client_factory() if client_factory else None
        try:
            for pdf in _chunks(batches, batch_size):
                keys = pdf[KEY]
                vals = _call(fn, keys, client, client_factory is not None, vectorized)
                yield pd.DataFrame({KEY: keys, VAL: vals})
        finally:
            if close is not None and client is not None:
                close(client)
    return run


def enrich(df: DataFrame, field: str, save_to: str, fn: Callable,
           return_type: str = "string", vectorized: bool = True,
           client_factory: Callable | None = None, close: Callable | None = None,
           doc: str | None = None, max_broadcast_rows: int = DEFAULT_BROADCAST_ROWS,
           entity: str | None = None, batch_size: int | None = None) -> DataFrame:
    """Store ``fn(value of field)`` at ``save_to`` (X1); ``entity`` overrides the record type.

    ``batch_size`` caps the keys per call of ``fn`` (a remote service's batch limit).

    ``fn`` takes a pandas Series of distinct keys (``vectorized=True``) or one
    key, plus the client from ``client_factory`` when given.  The keyed
    results are joined back with a broadcast when their number is proven
    small, otherwise with a shuffle join.  The lookup results are
    checkpointed to the shared checkpoint folder first, so each key is looked
    up once even when executors are lost or the plan is evaluated again.
    """
    if entity is not None:
        df = df.withColumn("entity", F.lit(entity))
    ref = P.resolve(df, field, doc)
    key = P.v_string(ref.column) if ref.is_variant else ref.column
    base = df.withColumn(KEY, key)
    if df.isStreaming:
        value = _stream_lookup(fn, return_type, vectorized, client_factory, close, batch_size)(key)
        return add_field(df.withColumn(VAL, value), save_to, F.col(VAL), doc, skip_null=True).drop(VAL)
    keys = base.select(KEY).where(F.col(KEY).isNotNull()).distinct()
    looked = keys.mapInPandas(_lookup_batches(fn, vectorized, client_factory, close, batch_size),
                              f"{KEY} {keys.schema[KEY].dataType.simpleString()}, "
                              f"{VAL} {return_type}")
    looked = broadcast_derived(looked, max_broadcast_rows)
    joined = base.join(looked, KEY, "left")
    # a failed lookup keeps the document as it was, as the reference does
    out = add_field(joined, save_to, F.col(VAL), doc, skip_null=True)
    return out.drop(KEY, VAL)


def _stream_lookup(fn: Callable, return_type: str, vectorized: bool, client_factory: Callable | None,
                   close: Callable | None, batch_size: int | None):
    """Streaming form: an Arrow UDF over the key column alone, one client per task.

    A stream cannot be counted or checkpointed inside the plan, so keys are
    looked up where they are, each once per task.  The other columns do not
    leave the JVM.
    """
    def run(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        client = client_factory() if client_factory else None
        known: dict = {}
        try:
            for column in columns:
                keys = column.to_pylist()
                fresh = [k for k in dict.fromkeys(keys) if k is not None and k not in known]
                for chunk in _chunks([pd.DataFrame({KEY: pd.Series(fresh, dtype=_dtype(column.type))})],
                                     batch_size) if fresh else ():
                    values = _call(fn, chunk[KEY], client, client_factory is not None, vectorized)
                    known.update(zip(chunk[KEY].tolist(), values.tolist(), strict=True))
                out = [known.get(k) for k in keys]
                yield pa.array([None if v is None or v is pd.NA or v != v else v for v in out], target)
                if len(known) > STREAM_KEYS:
                    known.clear()
        finally:
            if close is not None and client is not None:
                close(client)

    target = to_arrow_type(T._parse_datatype_string(return_type))
    run.__annotations__ = {"columns": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.arrow_udf(run, return_type)


def _dtype(kind: pa.DataType):
    """A pandas type that holds the keys exactly (there are no nulls among them)."""
    return "int64" if pa.types.is_integer(kind) else "float64" if pa.types.is_floating(kind) else object


def short_code_expr(value: Column, length: int = 8) -> Column:
    """Deterministic code: the first ``length`` hex digits of md5."""
    if not 1 <= length <= 32:
        raise ValueError("length must be within 1..32")
    return F.substring(F.md5(value.cast("string")), 1, length)


def short_code(df: DataFrame, field: str, save_to: str, length: int = 8,
               doc: str | None = None, entity: str | None = None) -> DataFrame:
    """Offline short code of a field, stored at ``save_to``."""
    if entity is not None:
        df = df.withColumn("entity", F.lit(entity))
    ref = P.resolve(df, field, doc)
    value = P.v_string(ref.column) if ref.is_variant else ref.column
    return add_field(df, save_to, short_code_expr(value, length), doc)


def short_code_collisions(df: DataFrame, field: str, length: int = 8) -> DataFrame:
    """Codes shared by more than one distinct value (should be empty)."""
    return (df.select(F.col(field).alias("value"))
            .where(F.col("value").isNotNull()).distinct()
            .groupBy(short_code_expr(F.col("value"), length).alias("code"))
            .agg(F.count("*").alias("n_values"))
            .where(F.col("n_values") > 1))


def enrich_from_table(df: DataFrame, mapping: DataFrame, left_on: str | Sequence[str],
                      right_on: str | Sequence[str] | None = None,
                      columns: Sequence[str] | dict[str, str] | None = None,
                      max_broadcast_rows: int = DEFAULT_BROADCAST_ROWS) -> DataFrame:
    """Add columns looked up in a mapping table (X3): a left join, never dropping a row.

    ``columns`` picks mapping columns (a dict renames them).  The mapping is
    expected to hold one row per key, as a lookup service answers one value;
    a key with several rows multiplies the document like any join.
    """
    lk = [left_on] if isinstance(left_on, str) else list(left_on)
    rk = lk if right_on is None else ([right_on] if isinstance(right_on, str) else list(right_on))
    if columns is None:
        picked = {c: c for c in mapping.columns if c not in rk}
    elif isinstance(columns, dict):
        picked = dict(columns)
    else:
        picked = {c: c for c in columns}
    right = mapping.select(*[F.col(r).alias(f"__map_{i}") for i, r in enumerate(rk)],
                           *[F.col(c).alias(a) for c, a in picked.items()])
    cond = [df[l] == right[f"__map_{i}"] for i, l in enumerate(lk)]
    out = df.join(sized_broadcast(right, max_broadcast_rows), cond, "left")
    return out.drop(*[f"__map_{i}" for i in range(len(rk))])
