"""Sharding of indivisible groups by Karmarkar-Karp differencing (law: bytes).

Rows with equal texts form a group that is never divided.  Spark sums the
bytes of each group; the groups are hashed over tasks, and each task runs
multi-way Karmarkar-Karp differencing on its own groups: every group begins as
a partial partition (its bytes in one bin, the other bins empty), and the two
partial partitions with the largest spread (largest less smallest bin) are
combined again and again in opposite order, the fullest bin of one with the
emptiest of the other, until one partition per task is left.  The tasks'
partitions are combined in the same way, ``FAN_IN`` at a time per task while
there are more than that and in one task at the end, so no step holds more
than ``FAN_IN`` x shards numbers.  The spread that is left is small against a
single group, unless one group alone is larger than a fair shard.

Each row then looks up its group's bin, and rows are numbered per shard by
counts per task, so a shard is never gathered in one place.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialise, numbered, pick

SHARDS = 40
#: Added to the bytes of every row.
ROW_BYTES = 16
#: Partial partitions that one task combines at most.
FAN_IN = 4096


def difference(partitions: list[list[tuple[int, int]]], n_bins: int) -> tuple[list[tuple[int, int]], dict[int, int]]:
    """Combine partial partitions into one.

    A partition is a list of (bytes, bin name), at most ``n_bins`` of them in
    falling order; bins that are not listed are empty.  Returns the final
    partition and, for every name that was merged into another, that other
    (follow it until a name of the final partition is reached).
    """
    heap = []
    for i, bins in enumerate(partitions):
        spread = bins[0][0] - (bins[-1][0] if len(bins) == n_bins else 0)
        heap.append((-spread, i, bins))
    heapq.heapify(heap)
    merged: dict[int, int] = {}
    serial = len(heap)
    while len(heap) > 1:
        _, _, a = heapq.heappop(heap)
        _, _, b = heapq.heappop(heap)
        free = n_bins - len(a)
        if free >= len(b):
            bins = a + b
        else:
            # the fullest of b meet the empty bins of a, the rest its smallest ones
            bins = a[:len(a) - (len(b) - free)] + b[:free]
            for (x, name), (y, other) in zip(reversed(a), b[free:], strict=False):
                bins.append((x + y, name))
                merged[other] = name
        bins.sort(reverse=True)
        spread = bins[0][0] - (bins[-1][0] if len(bins) == n_bins else 0)
        heapq.heappush(heap, (-spread, serial, bins))
        serial += 1
    return (heap[0][2] if heap else []), merged


def _root(name: int, merged: dict[int, int]) -> int:
    while name in merged:
        name = merged[name]
    return name


def partition_groups(groups: DataFrame, n_bins: int, fan_in: int = FAN_IN) -> DataFrame:
    """(key, bin) for ``groups`` with the columns key (binary) and bytes (long); keys are distinct.

    Level 0 works within the tasks that hold the groups; the levels above
    combine the partitions of ``fan_in`` tasks each.
    """

    def local(batches):
        from pyspark import TaskContext

        keys, sizes = [], []
        for batch in batches:
            keys.append(batch.column("key"))
            sizes.append(batch.column("bytes").to_numpy())
        if not keys:
            return
        size = np.concatenate(sizes)
        final, merged = difference([[(s, i)] for i, s in enumerate(size.tolist())], n_bins)
        place = {name: at for at, (_, name) in enumerate(final)}
        bins = np.array([place[_root(i, merged)] for i in range(len(size))], np.int32)
        sums = np.array([s for s, _ in final], np.int64)
        at = 0
        task = TaskContext.get().partitionId()
        for column in keys:
            own = bins[at:at + len(column)]
            at += len(column)
            yield pa.RecordBatch.from_arrays(
                [column, pa.array(np.full(len(own), task, np.int64)), pa.array(own), pa.array(sums[own])],
                names=["key", "part", "bin", "sum"])

    placed = materialise(groups.mapInArrow(local, "key binary, part long, bin int, sum long"), "shard-groups")
    # (part, bin) of level 0 -> the bins of the level reached so far
    now = materialise(placed.groupBy("part", "bin").agg(F.max("sum").alias("sum"))
                      .select(F.col("part").alias("part0"), F.col("bin").alias("bin0"), "part", "bin", "sum"),
                      "shard-parts")

    def combine(batches):
        rows = pa.Table.from_batches(list(batches), schema) if batches else None
        if rows is None or not rows.num_rows:
            return
        group = rows.column("up").to_numpy()
        part, bin_, total = (rows.column(c).to_numpy() for c in ("part", "bin", "sum"))
        for up in np.unique(group).tolist():
            at = np.flatnonzero(group == up)
            partitions: dict[int, list[tuple[int, int]]] = {}
            for i in at.tolist():
                partitions.setdefault(int(part[i]), []).append((int(total[i]), i))
            final, merged = difference([sorted(p, reverse=True) for _, p in sorted(partitions.items())], n_bins)
            place = {name: k for k, (_, name) in enumerate(final)}
            new = [place[_root(i, merged)] for i in at.tolist()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(at), up, np.int64)), pa.array(part[at]), pa.array(bin_[at]),
                 pa.array(new, pa.int32()), pa.array([final[k][0] for k in new], pa.int64())],
                names=["up", "part", "bin", "new_bin", "new_sum"])

    schema = pa.schema([("up", pa.int64()), ("part", pa.int64()), ("bin", pa.int32()), ("sum", pa.int64())])
    parts = now.select("part").distinct().count()  # one per task
    while parts > 1:
        parts = -(-parts // fan_in)
        up = (F.col("part") % parts).cast("long")
        level = now.groupBy("part", "bin").agg(F.max("sum").alias("sum")).select(up.alias("up"), "part", "bin", "sum")
        joined = level.repartition(parts, "up").mapInArrow(
            combine, "up long, part long, bin int, new_bin int, new_sum long")
        now = materialise(now.join(joined, ["part", "bin"]).select(
            "part0", "bin0", F.col("up").alias("part"), F.col("new_bin").alias("bin"),
            F.col("new_sum").alias("sum")), "shard-parts")
    final = now.select(F.col("part0").alias("part"), F.col("bin0").alias("bin"), F.col("bin").alias("shard"))
    return placed.join(final, ["part", "bin"]).select("key", F.col("shard").alias("bin"))


def shard_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                    n_shards: int = SHARDS) -> DataFrame:
    """Every row of ``docs`` with its shard and its slot there.

    Columns ``doc_id, size, text_crc32, law, shard, slot, grown_shard``.  The
    size is the text's UTF-8 bytes plus 16; a null text has no bytes and is in
    the group of the empty text.  Equal texts share a shard; repeated rows have
    slots of their own; an empty table gives an empty table.
    """
    base = pick(docs, doc_id=id_col, text=text_col)
    text = F.coalesce("text", F.lit(""))
    rows = base.select("doc_id", (F.octet_length(text) + ROW_BYTES).cast("long").alias("size"),
                       F.crc32(text.cast("binary")).alias("text_crc32"),
                       F.substring(F.unhex(F.sha2(text, 256)), 1, 16).alias("key"))
    rows = materialise(rows, "shard-rows")
    groups = rows.groupBy("key").agg(F.sum("size").alias("bytes"))
    placed = rows.join(partition_groups(groups, n_shards), "key").select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), F.col("bin").alias("shard"))
    return numbered(placed, "shard", "shard-slots").select(
        "doc_id", "size", "text_crc32", "law", "shard", F.col("number").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"))


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 40 shards of nearly equal bytes; equal texts together."""
    return shard_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
