"""Dataflow edges: groupings, unions and fan-out.

* ``shuffle``: balanced round-robin repartition;
* ``field``: same key -> same partition (hash repartition on the key; a key
  with most of the rows is one large partition by definition);
* ``none``: keep the upstream partitioning (no exchange).
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docweave.functions import paths as P

# The grouping names of the reference ("none": no exchange, ours).  Its
# "global" grouping, all rows through one task, is left out: no operator needs it.
GROUPINGS = ("shuffle", "field", "none")


def partition(df: DataFrame, grouping: str = "shuffle", n: int | None = None,
              key: str | Sequence[str] | None = None, doc: str | None = None) -> DataFrame:
    g = (grouping or "").strip().lower()
    if g not in GROUPINGS:
        raise ValueError(f"unknown grouping {grouping!r}; expected one of {GROUPINGS}")
    if g == "none":
        return df
    if g == "shuffle":
        return df.repartition(n) if n else df.repartition()
    if key is None:
        raise ValueError("field grouping needs a key")
    keys = [key] if isinstance(key, str) else list(key)
    cols = []
    for k in keys:
        ref = P.resolve(df, k, doc)
        cols.append(F.col(k) if (doc is None and k in df.columns) else ref.column.cast("string")
                    if ref.is_variant else ref.column)
    return df.repartition(n, *cols) if n else df.repartition(*cols)


def merge(*dfs: DataFrame, by_name: bool = True) -> DataFrame:
    """Bag union of several inputs (R5); columns missing on one side become null."""
    if not dfs:
        raise ValueError("merge needs at least one input")
    if by_name:
        return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), dfs)
    return reduce(lambda a, b: a.union(b), dfs)


def fan_out(df: DataFrame, writers: Sequence[Callable[[DataFrame], object]],
            persist: bool = False) -> list[object]:
    """Feed one batch input to several sinks.

    By default every sink reads the input by itself: pruned scans cost less
    than storing all columns of a large input.  ``persist=True`` computes it
    once, for a narrow input that is expensive to compute or not repeatable.

    Streaming inputs use ``docweave.streaming.fan_out_stream`` instead.
    """
    if df.isStreaming:
        raise ValueError("use docweave.streaming.fan_out_stream for a streaming input")
    if persist:
        df = df.persist()
    try:
        return [w(df) for w in writers]
    finally:
        if persist:
            df.unpersist()
