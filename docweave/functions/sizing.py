"""Size checks before a broadcast.

A side is broadcast only when a bounded action proves it small, in rows *and*
in bytes: at most ``max_rows + 1`` rows are read and their text is measured, so
the check itself stays cheap when the side turns out to be large.  Beyond
either bound the plain DataFrame is returned and Spark plans a shuffle join
(AQE may still switch to a broadcast from runtime statistics, and splits skewed
partitions).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

DEFAULT_BROADCAST_ROWS = 2_000_000
DEFAULT_BROADCAST_BYTES = 64 << 20
#: Rows of one task after ``spread``, at most.
SPREAD_ROWS = 50_000


def row_count_at_most(df: DataFrame, max_rows: int) -> int | None:
    """Number of rows if it is at most ``max_rows``, else None (bounded scan)."""
    n = df.limit(max_rows + 1).count()
    return n if n <= max_rows else None


def fits(df: DataFrame, max_rows: int = DEFAULT_BROADCAST_ROWS, max_bytes: int = DEFAULT_BROADCAST_BYTES) -> bool:
    """Has ``df`` at most ``max_rows`` rows and about ``max_bytes`` bytes? (one bounded scan)

    Strings and binaries count by their length, nested values by their JSON
    text, other columns as eight bytes.
    """
    if max_rows <= 0:
        return False
    size = F.lit(0).cast("long")
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.StringType, T.BinaryType)):
            width = F.octet_length(c)
        elif isinstance(f.dataType, (T.StructType, T.ArrayType, T.MapType, T.VariantType)):
            width = F.octet_length(F.to_json(F.struct(c)))
        else:
            width = F.lit(8)
        size = size + F.coalesce(width, F.lit(0)) + 8
    n, total = df.limit(max_rows + 1).agg(F.count("*"), F.coalesce(F.sum(size), F.lit(0))).first()
    return n <= max_rows and total <= max_bytes


def sized_broadcast(df: DataFrame, max_rows: int = DEFAULT_BROADCAST_ROWS,
                    max_bytes: int = DEFAULT_BROADCAST_BYTES) -> DataFrame:
    """``broadcast(df)`` when ``df`` is proven small, else ``df``.

    For a side read from storage (a mapping table): the bounded check reads
    only that side.  A side *derived* from a large input goes through
    ``broadcast_derived`` instead, so the derivation is not run twice.
    """
    return F.broadcast(df) if fits(df, max_rows, max_bytes) else df


def broadcast_derived(df: DataFrame, max_rows: int = DEFAULT_BROADCAST_ROWS,
                      max_bytes: int = DEFAULT_BROADCAST_BYTES) -> DataFrame:
    """Materialise a derived side once, then broadcast it if it is small.

    The checkpoint in the shared checkpoint folder cuts the lineage, so lost
    executors do not repeat the work (nor remote lookups), and nothing stays
    cached.
    """
    from docweave.session import checkpoint_root
    checkpoint_root(df.sparkSession)
    return sized_broadcast(df.checkpoint(eager=True), max_rows, max_bytes)


def spread(df: DataFrame, min_partitions: int | None = None) -> DataFrame:
    """Spread a narrow input over the cluster before CPU-heavy per-row work (opt-in).

    No operator calls this by itself.

    A small table stored as one file with one row group is scanned by a
    single task; per-row work on it (VARIANT edits, XML parsing, regexes,
    Python user code) would then use one core.  When the input has fewer
    partitions than ``min_partitions`` (default: the session's default
    parallelism) it is hash-repartitioned on a per-row id; an input that is
    already split -- any large table -- is returned unchanged, so no shuffle
    is added at scale.  Splits of a file hold nothing when its row groups are
    larger than they are: where the fullest partition has more than twice a
    task's share of the rows, the input is spread too.  A task gets
    ``SPREAD_ROWS`` rows at most.  The row id (partition index and position) keeps
    identical rows apart -- hashing the content would send all copies of a
    hot document to one task -- and avoids the local sort that a round-robin
    repartition runs to stay deterministic.
    """
    target = min_partitions or df.sparkSession.sparkContext.defaultParallelism
    try:
        # an input behind a shuffle is already spread; asking an adaptive plan
        # for its RDD would run those stages early, so only scans are checked
        if "Exchange" in df._jdf.queryExecution().executedPlan().toString():
            return df
        current = df.rdd.getNumPartitions()
        # rows by partition: of a scan, read from the footers of its files
        total, fullest = df.groupBy(F.spark_partition_id()).count().agg(
            F.coalesce(F.sum("count"), F.lit(0)), F.coalesce(F.max("count"), F.lit(0))).first()
    except Exception:  # no JVM plan view (e.g. a remote session): leave it as it is
        return df
    if current >= target and fullest * target <= 2 * total:
        return df
    return df.repartition(max(target, -(-total // SPREAD_ROWS)), F.monotonically_increasing_id())
