"""The prefix trie of conversations, by count-min screening of prefix digests.

A turn is a 128-bit digest of its role and text, made where it is read, so that
no text is ever shuffled.  A prefix is the sum, in two 64-bit words, of its
turns' digests mixed with their positions: sums of parts add up, so a
conversation of any length is cut by a range-partitioned sort and every task
needs only the sums of what stands before it (``running``, one row per task).

* Each task counts its prefixes in a count-min sketch whose counters stop at
  two; the sketches are added up block by block and broadcast (``SKETCH_CELLS``
  bounds their size).
* An estimate of one is exact: no other conversation has that prefix, and so
  none has a longer one.  Such tails are nodes of one member each and are
  emitted where they are; only the prefixes before them are shuffled and
  grouped exactly by their digests.
* Sums over subtrees need no walk over levels.  A conversation that is a
  node's smallest member is so in all deeper nodes too; what it adds to the
  bytes saved below a node is therefore a difference of two of its own running
  sums, and a childless node is counted by its smallest member.
* The hash over the members that end at a node is over text of any length: it
  is joined in sorted pieces in parallel, then hashed piece by piece.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .common import materialise, mixed, pick

#: Rows of counters of the sketch, and counters of a row at most (2 bits each: 32 MB in all).
SKETCH_ROWS, SKETCH_CELLS = 4, 1 << 25
#: Counters of one block when sketches are added up.
SKETCH_BLOCK = 1 << 16

_EMPTY_SHA = hashlib.sha256(b"").hexdigest()


def _half(digest: Column, at: int) -> Column:
    """8 bytes of a digest in hex as a signed long."""
    high = F.conv(F.substring(digest, at, 8), 16, 10).cast("long")
    low = F.conv(F.substring(digest, at + 8, 8), 16, 10).cast("long")
    return F.shiftleft(high, 32).bitwiseOR(low)


def turn_digests(df: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
                 text_col: str = "text") -> DataFrame:
    """(conv, turn, t1, t2, n_bytes): a digest and the UTF-8 bytes of the text of every turn.

    Null roles and texts count as empty.  Rows without a conversation go.
    """
    rows = pick(df, conv=conv_col, turn=turn_col, role=role_col, text=text_col).filter("conv IS NOT NULL")
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    sha = F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256)
    return (rows.select(F.col("conv").cast("long").alias("conv"), "turn", sha.alias("sha"),
                        F.octet_length(text).cast("long").alias("n_bytes"))
            .select("conv", "turn", _half(F.col("sha"), 1).alias("t1"), _half(F.col("sha"), 17).alias("t2"), "n_bytes"))


def _wider(df: DataFrame, **columns: T.DataType) -> T.StructType:
    return T.StructType([*df.schema.fields, *[T.StructField(c, kind) for c, kind in columns.items()]])


def running(df: DataFrame, order: list, sums: dict[str, str], name: str) -> DataFrame:
    """``df`` with, per ``conv`` and in the order given, the sums so far of columns (wrapping at 64 bits).

    ``sums`` maps a new column to the column it sums up; ``last`` tells whether
    a row is its conversation's last.  Range partitions are cut anywhere, also
    within a conversation: a task sums up its own rows, and one row per task
    (its first and last conversation and the sums of the last) tells the
    following tasks what to add.  ``edge``: 1 for rows of the task's first
    conversation, plus 2 for its last row.
    """
    spark = df.sparkSession
    schema = _wider(df, **dict.fromkeys(sums, T.LongType()), last=T.BooleanType(), task=T.IntegerType(),
                    edge=T.IntegerType())
    width = len(df.columns)
    places = [df.columns.index(c) for c in sums.values()]
    conv_at = df.columns.index("conv")

    def scan(batches):
        from pyspark import TaskContext

        task = TaskContext.get().partitionId()
        before = [0] * len(places)  # of the conversation that goes on
        current = first = None
        pending = None  # the last row is held back until the next one is known

        def emit(columns, sums_, last, edge):
            n = len(last)
            return pa.RecordBatch.from_arrays(
                [*columns, *[pa.array(s.view(np.int64)) for s in sums_], pa.array(last),
                 pa.array(np.full(n, task, np.int32)), pa.array(edge)], schema=arrow)

        def flush(next_conv):
            columns, totals, conv = pending
            edge = (1 if conv == first else 0) + (2 if next_conv is None else 0)
            return emit(columns, totals, np.array([next_conv is not None and next_conv != conv]),
                        np.array([edge], np.int32))

        arrow = to_arrow_schema(schema)
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            conv = batch.column(conv_at).to_numpy()
            if pending is not None:
                yield flush(int(conv[0]))
            new = np.ones(n, bool)
            new[1:] = conv[1:] != conv[:-1]
            if current is not None:
                new[0] = conv[0] != current
            else:
                first = int(conv[0])
            begin = np.maximum.accumulate(np.where(new, np.arange(n), -1))
            totals = []
            for k, place in enumerate(places):
                values = batch.column(place).to_numpy().astype(np.int64).view(np.uint64)
                whole = np.cumsum(values)
                zero = np.concatenate([np.zeros(1, np.uint64), whole])
                carried = np.array([before[k]], np.uint64)
                totals.append(np.where(begin >= 0, whole - zero[np.maximum(begin, 0)], whole + carried))
            before = [int(t[-1]) for t in totals]
            current = int(conv[-1])
            pending = ([c.slice(n - 1, 1) for c in batch.columns], [t[-1:] for t in totals], current)
            if n > 1:
                yield emit([c.slice(0, n - 1) for c in batch.columns], [t[:-1] for t in totals],
                           conv[1:] != conv[:-1], np.where(conv[:-1] == first, 1, 0).astype(np.int32))
        if pending is not None:
            yield flush(None)

    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    keyed = df.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    done = materialise(keyed.mapInArrow(scan, schema), name)
    # one row per task: its last one; and whether all of the task is one conversation
    ends = done.filter("edge >= 2").select("task", "conv", "edge", *sums).orderBy("task").collect()
    heads = {r.task: r.conv for r in done.filter("edge = 1").groupBy("task").agg(F.first("conv").alias("conv")).collect()}
    add, lasts = [], []
    carry = {c: 0 for c in sums}
    conv = None
    for k, end in enumerate(ends):
        head = heads.get(end.task, end.conv)
        if head != conv:
            carry = {c: 0 for c in sums}
        add.append((end.task, *[_signed(carry[c]) for c in sums]))
        if end.edge == 3:  # one conversation only: what came before goes on
            carry = {c: carry[c] + end[c] for c in sums}
        else:
            carry = {c: end[c] for c in sums}
        conv = end.conv
        following = ends[k + 1] if k + 1 < len(ends) else None
        lasts.append(following is None or heads.get(following.task, following.conv) != conv)
    carried = spark.createDataFrame([(*a, last) for a, last in zip(add, lasts, strict=True)],
                                    ", ".join(["task int", *[f"add_{c} bigint" for c in sums], "ends boolean"]))
    joined = done.join(F.broadcast(carried), "task")  # a row per task
    first_conv = F.col("edge").isin(1, 3)
    return joined.select(
        *[done.columns[i] for i in range(width)],
        *[F.when(first_conv, _wrapping(F.col(c), F.col(f"add_{c}"))).otherwise(F.col(c)).alias(c) for c in sums],
        F.when(F.col("edge") >= 2, F.col("ends")).otherwise(F.col("last")).alias("last"))


def _signed(x: int) -> int:
    x &= (1 << 64) - 1
    return x - (1 << 64) if x >> 63 else x


def _wrapping(a: Column, b: Column) -> Column:
    """a + b modulo 2^64, without the overflow check of ANSI mode: xor and carry by halves."""
    low = a.bitwiseAND(F.lit(0xFFFFFFFF)) + b.bitwiseAND(F.lit(0xFFFFFFFF))
    high = F.shiftrightunsigned(a, 32) + F.shiftrightunsigned(b, 32) + F.shiftrightunsigned(low, 32)
    return F.shiftleft(high, 32).bitwiseOR(low.bitwiseAND(F.lit(0xFFFFFFFF)))


def numbered_turns(turns: DataFrame) -> DataFrame:
    """(conv, pos, t1, t2, n_bytes): places from 1 by turn (null first); ties by the turns' digests."""
    rows = turns.withColumn("one", F.lit(1).cast("long"))
    order = ["conv", F.col("turn").asc_nulls_first(), "t1", "t2"]
    # repeated rows are told apart, so that many of them are cut by the sort as well
    rows = materialise(rows, "trie-turns").withColumn("row", F.monotonically_increasing_id())
    return running(rows, [*order, "row"], {"pos": "one"}, "trie-numbered").select(
        "conv", "pos", "t1", "t2", "n_bytes")


def _digest(t: np.ndarray, pos: np.ndarray, salt: int) -> np.ndarray:
    return mixed(t.view(np.uint64) + mixed(pos.astype(np.uint64) + np.uint64(salt)))


def prefix_digests(turns: DataFrame) -> DataFrame:
    """(conv, pos, n_bytes, d1, d2, upto, last) and the parents' digests p1, p2, of gapless numbered turns.

    ``upto`` sums the bytes up to a turn.
    """
    schema = "conv bigint, pos bigint, n_bytes bigint, h1 bigint, h2 bigint"

    def place(batches):
        for batch in batches:
            conv, pos, t1, t2, n_bytes = (c.to_numpy() for c in batch.columns)
            # both words enter both hashes
            h1 = _digest((t1.view(np.uint64) ^ mixed(t2.view(np.uint64))), pos, 0x9E3779B97F4A7C15)
            h2 = _digest((t2.view(np.uint64) + mixed(t1.view(np.uint64) ^ np.uint64(0xD1B54A32D192ED03))), pos,
                         0xA0761D6478BD642F)
            yield pa.RecordBatch.from_arrays(
                [pa.array(conv), pa.array(pos), pa.array(n_bytes), pa.array(h1.view(np.int64)),
                 pa.array(h2.view(np.int64))], names=["conv", "pos", "n_bytes", "h1", "h2"])

    placed = turns.select("conv", "pos", "t1", "t2", "n_bytes").mapInArrow(place, schema)
    out = running(placed, ["conv", "pos"], {"d1": "h1", "d2": "h2", "upto": "n_bytes"}, "trie-prefixes")

    def less(a: str, b: str) -> Column:
        return _wrapping(_wrapping(F.col(a), F.bitwise_not(F.col(b))), F.lit(1).cast("long"))

    return out.select("conv", "pos", "n_bytes", "d1", "d2", less("d1", "h1").alias("p1"), less("d2", "h2").alias("p2"),
                      "upto", "last")


def _cells(d1: np.ndarray, d2: np.ndarray, cells: int) -> list[np.ndarray]:
    a, b = mixed(d1.view(np.uint64)), mixed(d2.view(np.uint64)) | np.uint64(1)
    return [((a + np.uint64(k) * b) >> np.uint64(7)) & np.uint64(cells - 1) for k in range(SKETCH_ROWS)]


def sketch(prefixes: DataFrame, cells: int) -> np.ndarray:
    """Counters 0, 1, 2 (two or more) of ``SKETCH_ROWS`` rows of ``cells`` counters.

    A task counts into its own sketch and passes on the blocks it has touched;
    a block's counters are added up in a stream, one block in memory at a time.
    """
    size = min(SKETCH_BLOCK, cells)
    schema = "block int, counts binary"

    def count(batches):
        mine = np.zeros((SKETCH_ROWS, cells), np.uint8)
        for batch in batches:
            d1, d2 = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for row, at in zip(mine, _cells(d1, d2, cells), strict=True):
                touched, n = np.unique(at, return_counts=True)
                row[touched] = np.minimum(row[touched] + np.minimum(n, 2), 2)
        blocks = mine.reshape(-1, size)
        some = np.nonzero(blocks.any(axis=1))[0]
        for at in range(0, len(some), 16):
            part = some[at:at + 16]
            yield pa.RecordBatch.from_arrays(
                [pa.array(part.astype(np.int32)), pa.array([_packed(blocks[k]) for k in part], pa.binary())],
                names=["block", "counts"])

    def add(batches):
        current, total = None, None
        for batch in batches:
            for block, counts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if block != current:
                    if current is not None:
                        yield _one_block(current, total)
                    current, total = block, np.zeros(size, np.uint8)
                total = np.minimum(total + _unpacked(counts, size), 2)
        if current is not None:
            yield _one_block(current, total)

    parts = int(prefixes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    added = (prefixes.select("d1", "d2").mapInArrow(count, schema)
             .repartition(parts, "block").sortWithinPartitions("block").mapInArrow(add, schema)).toArrow()
    out = np.zeros((SKETCH_ROWS * cells // size, size), np.uint8)
    for block, counts in zip(added.column("block").to_pylist(), added.column("counts").to_pylist(), strict=True):
        out[block] = _unpacked(counts, size)
    return out.reshape(SKETCH_ROWS, cells)


def _one_block(block: int, counts: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([_packed(counts)], pa.binary())],
                                      names=["block", "counts"])


def _packed(counts: np.ndarray) -> bytes:
    """Two bits per counter, as two bit maps."""
    return np.packbits(counts > 0).tobytes() + np.packbits(counts > 1).tobytes()


def _unpacked(data: bytes, size: int) -> np.ndarray:
    bits = np.unpackbits(np.frombuffer(data, np.uint8)).reshape(2, -1)[:, :size]
    return bits[0] + bits[1]


def screened(prefixes: DataFrame, cells: int | None = None) -> DataFrame:
    """``prefixes`` with ``alone`` (no other conversation has this prefix, proved by the sketch) and ``top``.

    ``top``: the tail of a conversation begins here, or may begin here.  A
    prefix that is not ``alone`` may still be the only one of its kind.
    """
    spark = prefixes.sparkSession
    if cells is None:
        cells = 1 << int(np.clip(np.ceil(np.log2(8 * prefixes.count() + 1)), 10, np.log2(SKETCH_CELLS)))
    counts = sketch(prefixes, cells)
    shared = spark.sparkContext.broadcast([_packed(row) for row in counts])
    schema = _wider(prefixes, alone=T.BooleanType(), top=T.BooleanType())

    def screen(batches):
        size = len(shared.value[0]) // 2
        twice = [np.frombuffer(row, np.uint8)[size:] for row in shared.value]
        before_conv = before_pos = None
        before = False
        for batch in batches:
            conv, pos, d1, d2 = (batch.column(k).to_numpy() for k in ("conv", "pos", "d1", "d2"))
            shared_ = np.ones(len(conv), bool)
            for row, at in zip(twice, _cells(d1, d2, size * 8), strict=True):
                at = at.astype(np.int64)
                shared_ &= (row[at >> 3] >> (7 - (at & 7)) & 1).astype(bool)
            # after a prefix that is alone all longer ones are; files may be read in any order
            n = len(conv)
            new = np.ones(n, bool)
            new[1:] = (conv[1:] != conv[:-1]) | (pos[1:] != pos[:-1] + 1)
            first_alone = np.maximum.accumulate(np.where(~shared_, np.arange(n), -1))
            begin = np.maximum.accumulate(np.where(new, np.arange(n), -1))
            alone = first_alone >= begin
            goes_on = n > 0 and before and conv[0] == before_conv and pos[0] == before_pos + 1
            if goes_on:
                alone |= begin == 0
            known = np.zeros(n, bool)  # the row before is of the same conversation and alone
            known[1:] = ~new[1:] & alone[:-1]
            if n:
                known[0] = goes_on
                before_conv, before_pos, before = conv[-1], pos[-1], bool(alone[-1])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(alone), pa.array(alone & ~known)],
                                             names=[*batch.schema.names, "alone", "top"])

    return materialise(prefixes.mapInArrow(screen, schema), "trie-screened")


def ends_hash(ends: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, ends_sha256): SHA-256 of each key's values of ``conv``, ascending and joined by commas.

    Range partitions join their own values to pieces; a key's pieces are hashed
    in order as they stream by, so no list is ever held.
    """
    n_keys = len(keys)
    pieces_schema = ", ".join([*[f"{k} bigint" for k in keys], "low bigint", "piece string"])
    hashes_schema = ", ".join([*[f"{k} bigint" for k in keys], "ends_sha256 string"])

    def join(batches):
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            columns = [c.to_numpy() for c in batch.columns]
            new = np.zeros(n, bool)
            new[0] = True
            for c in columns[:n_keys]:
                new[1:] |= c[1:] != c[:-1]
            bounds = [*np.nonzero(new)[0].tolist(), n]
            conv = columns[n_keys].tolist()
            yield pa.RecordBatch.from_arrays(
                [*[pa.array(c[bounds[:-1]]) for c in columns[:n_keys]], pa.array(columns[n_keys][bounds[:-1]]),
                 pa.array([",".join(map(str, conv[a:b])) for a, b in zip(bounds, bounds[1:], strict=False)])],
                names=[*keys, "low", "piece"])

    def digest(batches):
        current, state = None, None
        out: list[tuple] = []
        for batch in batches:
            for *key, _, piece in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if key != current:
                    if current is not None:
                        out.append((*current, state.hexdigest()))
                    current, state = key, hashlib.sha256(piece.encode())
                else:
                    state.update(b"," + piece.encode())
            if len(out) >= 5000:
                yield _rows(out, keys)
                out = []
        if current is not None:
            out.append((*current, state.hexdigest()))
            yield _rows(out, keys)

    parts = int(ends.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    pieces = (ends.select(*keys, "conv").repartitionByRange(parts, *keys, "conv").sortWithinPartitions(*keys, "conv")
              .mapInArrow(join, pieces_schema))
    return (pieces.repartition(parts, *keys).sortWithinPartitions(*keys, "low").mapInArrow(digest, hashes_schema))


def _rows(rows: list[tuple], keys: list[str]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True))
    return pa.RecordBatch.from_arrays([*[pa.array(c, pa.int64()) for c in columns[:-1]], pa.array(columns[-1])],
                                      names=[*keys, "ends_sha256"])


def prefix_trie(turns: DataFrame, convs: DataFrame, cells: int | None = None) -> DataFrame:
    """The nodes of the trie of numbered turns (conv, pos from 1 without gaps, t1, t2, n_bytes).

    ``convs`` (conv) lists every conversation once, those without turns too.
    Columns: ``conv_id`` (smallest member), ``depth``, ``parent_conv_id`` (null
    for the root), ``n_convs``, ``n_children``, ``n_leaves``, ``saved_tokens``,
    ``ends_sha256``.  No conversation: no node.
    """
    zero, one = F.lit(0).cast("long"), F.lit(1).cast("long")
    rows = screened(prefix_digests(turns), cells)
    maybe, tails = rows.filter("NOT alone"), rows.filter("alone")
    key = ["d1", "d2"]
    groups = materialise(maybe.groupBy(*key).agg(
        F.min("conv").alias("low"), F.min("pos").alias("depth"), F.count("*").alias("n_convs"),
        F.min("p1").alias("p1"), F.min("p2").alias("p2"),
        F.max(~F.col("last")).alias("inner")), "trie-groups")
    placed = materialise(maybe.join(groups.select(*key, "low", "inner"), key).select(
        *key, "conv", "pos", "n_bytes", "upto", "last", "low", "inner"), "trie-placed")
    # per conversation: what it repeats of smaller ones, and whether it counts a childless node
    repeats = F.col("low") < F.col("conv")
    convs_ = materialise(placed.groupBy("conv").agg(
        F.max(F.when(repeats, F.col("upto"))).alias("repeated"),
        F.max(F.when(F.col("last"), (~repeats & ~F.col("inner")).cast("long"))).alias("leaf")), "trie-convs").select(
        "conv", F.coalesce("repeated", zero).alias("repeated"), F.coalesce("leaf", one).alias("leaf"))
    saved = F.greatest(F.col("repeated") - (F.col("upto") - F.col("n_bytes")), zero)
    below = placed.join(convs_, "conv").groupBy(*key).agg(
        F.sum("leaf").alias("n_leaves"), F.sum(saved).alias("saved_tokens"))
    tops = tails.filter("top").select(*key, "p1", "p2", "conv", "pos", "last")
    inner = F.col("pos") > 1
    children = (groups.filter("depth > 1").select("p1", "p2")
                .unionByName(tails.filter("top").filter(inner).select("p1", "p2"))
                .groupBy("p1", "p2").agg(F.count("*").alias("n_children"))
                .select(F.col("p1").alias("d1"), F.col("p2").alias("d2"), "n_children"))
    parents = groups.select(F.col("d1").alias("p1"), F.col("d2").alias("p2"), F.col("low").alias("parent"))
    ends = ends_hash(placed.filter("last"), key)
    tree = convs.agg(F.min("conv").alias("root"), F.count("*").alias("n")).first()
    root = F.lit(tree.root).cast("long")
    shared = (groups.join(below, key).join(children, key, "left").join(ends, key, "left")
              .join(parents, ["p1", "p2"], "left").select(
        F.col("low").alias("conv_id"), "depth",
        F.when(F.col("depth") == 1, root).otherwise(F.coalesce("parent", "low")).alias("parent_conv_id"),
        "n_convs", F.coalesce("n_children", zero).alias("n_children"), "n_leaves", "saved_tokens",
        F.coalesce("ends_sha256", F.lit(_EMPTY_SHA)).alias("ends_sha256")))

    def tail(df: DataFrame, parent: Column) -> DataFrame:
        return df.select(
            F.col("conv").alias("conv_id"), F.col("pos").alias("depth"), parent.alias("parent_conv_id"),
            one.alias("n_convs"), F.when(F.col("last"), zero).otherwise(one).alias("n_children"),
            one.alias("n_leaves"), zero.alias("saved_tokens"),
            F.when(F.col("last"), F.sha2(F.col("conv").cast("string"), 256)).otherwise(_EMPTY_SHA)
            .alias("ends_sha256"))

    own = F.col("conv")
    starts = tail(tops.join(parents, ["p1", "p2"], "left"), F.when(inner, F.coalesce("parent", own)).otherwise(root))
    if not tree.n:
        return starts.filter(F.lit(False))
    with_turns = rows.filter("pos = 1").select("conv")
    silent = convs.join(with_turns, "conv", "left_anti")
    first = groups.filter("depth = 1").agg(F.count("*")).first()[0] + tails.filter("pos = 1").count()
    # conversations that only have tails repeat nothing and count one childless node each
    whole = convs_.agg(F.sum("repeated"), F.sum("leaf"), F.count("*")).first()
    talking = tree.n - silent.count()
    n_leaves = (whole[1] or 0) + talking - whole[2] if first else 1
    sha = ends_hash(silent.select(zero.alias("node"), "conv"), ["node"])
    spark = turns.sparkSession
    top = spark.createDataFrame(
        [(0, tree.root, 0, None, tree.n, first, n_leaves, whole[0] or 0)],
        "node bigint, conv_id bigint, depth bigint, parent_conv_id bigint, n_convs bigint, n_children bigint, "
        "n_leaves bigint, saved_tokens bigint")
    top = top.join(sha, "node", "left").drop("node").withColumn(
        "ends_sha256", F.coalesce("ends_sha256", F.lit(_EMPTY_SHA)))
    return (top.unionByName(shared).unionByName(starts)
            .unionByName(tail(tails.filter("NOT top"), own)))


def conversation_trie(df: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
                      text_col: str = "text") -> DataFrame:
    """``prefix_trie`` of a table of conversations with one row per turn.

    Turns are ordered by ``turn``, null first, and among equal ones by their
    digests; repeated rows are turns of their own.  Null roles and texts count
    as empty, rows without a conversation take no part, an empty table has no
    nodes.
    """
    turns = numbered_turns(turn_digests(df, conv_col, turn_col, role_col, text_col))
    return prefix_trie(turns, materialise(turns.select("conv").distinct(), "trie-ids"))


#: Contract of the query: conversations of a run of ids share the first turns of the run's first one.
RUN, HEAD = 5, 9


def rebuilt_turns(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The numbered turns of the rebuilt conversations, and all conversations."""
    lengths = turns.groupBy("conv").agg(F.max("pos").alias("n"))
    base = F.col("conv") - F.col("conv") % RUN
    head = F.crc32(F.col("conv").cast("string").cast("binary")) % HEAD
    convs = lengths.select("conv", base.alias("base"), head.alias("h"))
    had = lengths.select(F.col("conv").alias("base"), F.col("n").alias("there"))
    convs = materialise(convs.join(had, "base", "left").withColumn(
        "taken", F.least("h", F.coalesce("there", F.lit(0).cast("long")))), "trie-rebuilt")
    heads = turns.filter((F.col("conv") % RUN == 0) & (F.col("pos") < HEAD))  # at most 8 rows for 5 conversations each
    first = convs.filter("taken > 0").join(heads.withColumnRenamed("conv", "base"), "base").filter(
        F.col("pos") <= F.col("taken")).select("conv", "pos", "t1", "t2", "n_bytes")
    rest = turns.join(convs.select("conv", "h", "taken"), "conv").filter(F.col("pos") > F.col("h")).select(
        "conv", (F.col("pos") - F.col("h") + F.col("taken")).alias("pos"), "t1", "t2", "n_bytes")
    return first.unionByName(rest), convs.select("conv")


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The trie of the rebuilt ``conversations``."""
    turns = materialise(numbered_turns(turn_digests(spark.read.parquet(f"{sf_dir}/conversations.parquet"))),
                        "trie-places")
    rebuilt, convs = rebuilt_turns(turns)
    return prefix_trie(rebuilt, convs)


OP12_SQL = """
WITH turns AS (
    SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
           row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) AS pos
    FROM conversations WHERE conv_id IS NOT NULL),
lists AS (
    SELECT conv_id, list({'role': role, 'text': text} ORDER BY pos) AS l,
           xor(4294967295::BIGINT, list_reduce(list_prepend(4294967295::BIGINT, list_transform(
               string_split(conv_id::VARCHAR, ''), lambda c: ord(c)::BIGINT)),
               lambda crc, b: list_reduce(
                   [xor(crc, b), 0, 0, 0, 0, 0, 0, 0, 0],
                   lambda x, y: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384::BIGINT) ELSE x >> 1 END))
           ) % 9 AS h
    FROM turns GROUP BY conv_id),
rebuilt AS (
    SELECT c.conv_id, list_concat(coalesce(b.l[1:c.h], []), c.l[c.h + 1:]) AS l
    FROM lists c LEFT JOIN lists b ON b.conv_id = c.conv_id - c.conv_id % 5),
paths AS (
    SELECT conv_id, d, sha256(to_json(l[1:d])::VARCHAR) AS node, d = len(l) AS at_end,
           CASE WHEN d = 0 THEN 0 ELSE octet_length(encode(l[d].text)) END AS n_bytes
    FROM (SELECT conv_id, l, unnest(range(len(l) + 1)) AS d FROM rebuilt)),
nodes AS (
    SELECT node, d AS depth, min(conv_id) AS conv_id, count(*) AS n_convs, max(n_bytes) AS n_bytes,
           bool_or(NOT at_end) AS inner_node,
           sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (WHERE at_end), '')) AS ends_sha256
    FROM paths GROUP BY node, d),
below AS (
    SELECT a.node, a.d, sum((n.n_convs - 1) * n.n_bytes) AS saved,
           count(*) FILTER (WHERE NOT n.inner_node) AS n_leaves,
           count(*) FILTER (WHERE n.depth = a.d + 1) AS n_children
    FROM nodes n JOIN paths a ON a.conv_id = n.conv_id AND a.d <= n.depth GROUP BY a.node, a.d)
SELECT n.conv_id, n.depth, p.conv_id AS parent_conv_id, n.n_convs, b.n_children, b.n_leaves,
       CAST(b.saved AS BIGINT) AS saved_tokens, n.ends_sha256
FROM nodes n JOIN below b ON b.node = n.node AND b.d = n.depth
LEFT JOIN paths pp ON pp.conv_id = n.conv_id AND pp.d = n.depth - 1
LEFT JOIN nodes p ON p.node = pp.node AND p.depth = pp.d
"""
