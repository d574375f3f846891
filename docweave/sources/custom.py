"""User-written sources (S9, S10) on the Python Data Source API.

The reference's user source is an object with ``open`` / ``nextTuple`` /
``close`` polled by one task.  Here a source is split into partitions that
Spark reads in parallel: the user gives the list of partitions (small
descriptors such as file names or id ranges) and a function that yields the
rows of one partition.  A streaming source also gives ``latest()`` -- the
current end offset -- and reads the rows between two offsets, so Spark
checkpoints offsets and replays a micro-batch after a failure.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable, Iterator, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (DataSource, DataSourceReader, DataSourceStreamReader,
                                    InputPartition)

# what a source is told of a condition: (column, comparison, value)
Wanted = tuple[str, str, object]
_COMPARISONS = ("=", "<", "<=", ">", ">=", "in")
_WANTED = "docweave.wanted"


class _Part(InputPartition):
    def __init__(self, value):
        super().__init__(value)
        self.value = value


def source_from_function(spark: SparkSession, name: str, schema: str,
                         partitions: Callable[[dict], Sequence] | Sequence,
                         read: Callable[[object], Iterable],
                         latest: Callable[[dict], int] | None = None,
                         read_range: Callable[[int, int], Iterable[tuple]] | None = None,
                         range_splits: int = 1, searches: bool = False) -> None:
    """Register a data source ``name``; read it with ``spark.read.format(name)``.

    ``partitions(options)`` (or a fixed list) gives one descriptor per
    partition and ``read(descriptor)`` yields its rows as tuples, or whole
    ``pyarrow.RecordBatch``es, which cost no Python work per row.  For
    streaming, ``latest(options)`` returns the current end offset (an int)
    and ``read_range(start, end)`` yields the rows in ``[start, end)``; each
    micro-batch range is cut into ``range_splits`` partitions.

    With ``searches``, both functions get a list of ``(column, comparison, value)`` as
    their last argument (empty for a plain load).  Rows that do not meet all of them need
    not be read, and ``partitions`` may leave out descriptors without such rows.
    """
    def told(options: dict) -> tuple:
        return ([tuple(w) for w in json.loads(options.get(_WANTED, "[]"))],) if searches else ()

    class _Reader(DataSourceReader):
        def __init__(self, options: dict):
            self.options = options

        def partitions(self):
            parts = partitions(self.options, *told(self.options)) if callable(partitions) else partitions
            # a scan without partitions would be read as one
            return [_Part(p) for p in parts] or [_Part(None)]

        def read(self, partition) -> Iterator[tuple]:
            if partition.value is not None:
                yield from read(partition.value, *told(self.options))

    class _StreamReader(DataSourceStreamReader):
        def __init__(self, options: dict):
            self.options = options

        def initialOffset(self) -> dict:
            return {"offset": 0}

        def latestOffset(self) -> dict:
            return {"offset": int(latest(self.options))}

        def partitions(self, start: dict, end: dict):
            lo, hi = int(start["offset"]), int(end["offset"])
            if hi <= lo:
                return []
            n = max(1, min(range_splits, hi - lo))
            step = -(-(hi - lo) // n)
            return [_Part((a, min(a + step, hi))) for a in range(lo, hi, step)]

        def read(self, partition) -> Iterator[tuple]:
            a, b = partition.value
            yield from read_range(a, b)

        def commit(self, end: dict) -> None:
            pass

    class _Source(DataSource):
        @classmethod
        def name(cls) -> str:
            return name

        def schema(self) -> str:
            return schema

        def reader(self, schema):
            return _Reader(self.options)

        def streamReader(self, schema):
            if latest is None or read_range is None:
                raise ValueError(f"source {name!r} has no streaming reader")
            return _StreamReader(self.options)

    spark.dataSource.register(_Source)


def read_where(spark: SparkSession, name: str, wanted: Sequence[Wanted], **options) -> DataFrame:
    """Rows of a searching source that meet all of ``wanted``.

    A condition is ``(column, comparison, value)`` with one of ``= < <= > >= in``
    and a number, text, boolean or (``in``) a list of them.  The source leaves
    out what it can, and Spark tests every row that it gives, so the result is
    that of a plain load with the same filter; nulls meet no condition.
    """
    out = spark.read.format(name).options(**options).option(_WANTED, json.dumps([list(w) for w in wanted])).load()
    for column, comparison, value in wanted:
        if comparison not in _COMPARISONS:
            raise ValueError(f"unknown comparison {comparison!r}; expected one of {_COMPARISONS}")
        c = F.col(f"`{column}`")
        out = out.where(c.isin(list(value)) if comparison == "in" else
                        {"=": c == value, "<": c < value, "<=": c <= value, ">": c > value, ">=": c >= value}[comparison])
    return out
