"""Helpers shared by the training-data operators.

Every operator reads its input columns *by position* (``pick``, ``Carried``),
so extra columns, columns whose names differ only in case, and repeated names
never make a reference ambiguous.  Intermediate tables are written to the
shared folder the session names in ``spark.checkpoint.dir`` (``materialise``):
they cut lineage, survive lost executors, and are removed when the driver ends.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import zipfile
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

import docweave
from docweave.session import scratch_path

#: Rows of one Arrow batch handed to a Python task; with texts of a few KB a
#: batch is one or two MB, and ``maxBytesPerBatch`` cuts it earlier for long texts.
ARROW_ROWS = 400


_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send the package to the executors once per application, so that they need no install."""
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    root = Path(docweave.__file__).parent
    folder = tempfile.mkdtemp(prefix="docweave-package-")  # the driver's own; Spark sends the file from there
    atexit.register(shutil.rmtree, folder, True)
    with zipfile.ZipFile(f"{folder}/docweave.zip", "w", zipfile.ZIP_DEFLATED) as out:
        for path in sorted(root.rglob("*.py")):
            out.write(path, str(path.relative_to(root.parent)))
    spark.sparkContext.addPyFile(f"{folder}/docweave.zip")
    _SHIPPED.add(app)


def prepare(spark: SparkSession) -> None:
    """Small Arrow batches (a Python task never holds more than one of them), and the package on the executors."""
    ship(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(16 << 20))


def position(df: DataFrame, name: str) -> int:
    """Index of a column: the exact name first, else the first that differs in case only."""
    if name in df.columns:
        return df.columns.index(name)
    lowered = [c.lower() for c in df.columns]
    if name.lower() not in lowered:
        raise ValueError(f"no column {name!r} in {df.columns}")
    return lowered.index(name.lower())


def renumbered(df: DataFrame) -> DataFrame:
    """The same columns under the names c0, c1, ..."""
    return df.toDF(*[f"c{i}" for i in range(len(df.columns))])


def pick(df: DataFrame, **columns: str) -> DataFrame:
    """``pick(docs, id="doc_id", text="text")``: only these columns, renamed."""
    flat = renumbered(df)
    return flat.select(*[F.col(f"c{position(df, name)}").alias(new) for new, name in columns.items()])


class Carried:
    """All columns of ``df`` under unique internal names, and the way back.

    ``self.df`` has the columns c0..cn; ``back(out, *results)`` restores the
    original names and appends result columns.  An input column that has the
    name of a result column (whatever the case) gives way to the result.
    """

    def __init__(self, df: DataFrame):
        self.names = list(df.columns)
        self.df = renumbered(df)

    def col(self, name: str) -> Column:
        if name in self.names:
            return F.col(f"c{self.names.index(name)}")
        lowered = [c.lower() for c in self.names]
        return F.col(f"c{lowered.index(name.lower())}")

    def back(self, out: DataFrame, *results: str) -> DataFrame:
        taken = {r.lower() for r in results}
        kept = [(i, n) for i, n in enumerate(self.names) if n.lower() not in taken]
        flat = out.select(*[f"c{i}" for i, _ in kept], *results)
        return flat.toDF(*[n for _, n in kept], *results)


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back (lineage is cut there)."""
    spark = df.sparkSession
    ship(spark)
    path = scratch_path(spark, name)
    df.write.mode("overwrite").parquet(path)
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(hadoop)
    return spark.read.schema(df.schema).parquet(path)


def broadcast_within(df: DataFrame, max_rows: int) -> DataFrame:
    """A hint to broadcast a *materialised* table that has at most ``max_rows`` rows.

    A larger one is returned as it is, and Spark joins it by a shuffle.
    """
    return F.broadcast(df) if df.limit(max_rows + 1).count() <= max_rows else df


def utf8_parts(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of an Arrow string column; null counts as empty.

    Both are views of the Arrow buffers where the column has no nulls.
    """
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    n = len(column)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    kind = np.int64 if wide else np.int32
    bounds = np.frombuffer(offsets, kind, n + 1, column.offset * np.dtype(kind).itemsize).astype(np.int64)
    whole = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return whole[bounds[0]:bounds[-1]], bounds - bounds[0]


def utf8_rows(column: pa.Array) -> Iterator[bytes]:
    """The UTF-8 bytes of every text; null counts as empty."""
    data, bounds = utf8_parts(column)
    whole = data.tobytes()
    ends = bounds.tolist()
    for a, b in zip(ends, ends[1:], strict=False):
        yield whole[a:b]


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (multiply and xor-shift rounds)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def numbered(df: DataFrame, key: str, name: str, before=None, schema: T.StructType | None = None) -> DataFrame:
    """Add ``number``: 0, 1, 2, ... without gaps among the rows of each ``key``.

    No window over a key: every task numbers its own rows per key, the counts
    per (task, key) are summed up over the tasks, and each row adds the start
    of its task.  So a key with a third of all rows stays spread over tasks.
    ``key`` is an int column without nulls and few distinct values per task.
    The rows are written once, so that both uses see the same numbering.
    Given ``before`` (batches -> batches of ``schema``), the numbered rows are
    what it makes of ``df``, in the same Python task.
    """
    schema = T.StructType([*(schema or df.schema).fields, T.StructField("task", T.IntegerType()),
                           T.StructField("local", T.LongType())])

    def number(batches):
        from pyspark import TaskContext

        task = TaskContext.get().partitionId()
        seen: dict[int, int] = {}
        for batch in before(batches) if before else batches:
            keys = batch.column(key).to_numpy(zero_copy_only=False)
            order = np.argsort(keys, kind="stable")
            values, first, counts = np.unique(keys[order], return_index=True, return_counts=True)
            local = np.empty(len(keys), np.int64)
            within = np.arange(len(keys)) - np.repeat(first, counts)
            start = np.array([seen.get(v, 0) for v in values.tolist()], np.int64)
            local[order] = within + np.repeat(start, counts)
            for v, n in zip(values.tolist(), counts.tolist(), strict=True):
                seen[v] = seen.get(v, 0) + n
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(np.full(len(keys), task, np.int32)), pa.array(local)],
                names=[*batch.schema.names, "task", "local"])

    rows = materialise(df.mapInArrow(number, schema), name)
    counts = rows.groupBy(key, "task").agg(F.count("*").alias("n"))
    earlier = Window.partitionBy(key).orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(F.col(key), F.col("task"),
                           F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("begin"))
    return (rows.join(starts, [key, "task"])
            .withColumn("number", F.col("begin") + F.col("local"))
            .drop("task", "local", "begin"))
