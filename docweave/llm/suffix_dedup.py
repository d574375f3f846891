"""Suffix-array dedup: remove every byte covered by a ``WINDOW``-byte string that occurs elsewhere too.

Sorting the suffix of every byte would move each byte ``WINDOW`` times.  So
only *anchors* are sorted: the anchor of a window is the place of the smallest
hash among its ``GRAM``-byte strings (the first of equal ones).  It depends on
the window's content alone, so equal windows have equal anchors at the same
offset; neighbouring windows share theirs, about one place in 70 is an anchor.
An anchor p with the windows that begin at a..b has the block [a, b + WINDOW).

1. Count anchors by the hash of their gram (two integers each, partially
   aggregated).  A gram that occurs once belongs to no repeated window.  If
   all blocks of a gram are equal, all their windows are repeated.
2. The rest -- blocks that agree in the gram but not altogether -- needs the
   suffixes: identical blocks are merged with their number; then the suffixes
   that begin at the anchors are range-partitioned by their bytes (Spark
   samples the splitters) and each bucket sorts its suffixes by multikey
   quicksort with words of eight bytes, and in the same way the bytes before
   the anchors, read backwards.  The common prefixes of neighbours in both
   orders tell for every offset o which windows [p - o, p - o + WINDOW) are
   equal.
3. Then buckets are compared across their boundaries.  A window can occur in
   another bucket only if the part of it from the anchor on is also a prefix of
   the bucket's first or last suffix.  Of those windows, ``SLICE`` neighbouring
   offsets at a time share a core; the 128-bit hashes of the different cores of
   a bucket are counted over all buckets, and only where a core occurs again
   the windows around it are hashed and counted in the same way.  So a gram may
   be so frequent that it fills many buckets, and no task holds it as a whole.
4. All windows of a block share the anchor, so what they cover is one
   interval from the smallest to the largest offset that is repeated.

Anchors whose gram cannot be repeated are left out early by Bloom filters of
the repeated grams, of a fixed largest size; a false positive costs a row in a
join.  Texts are named by a 128-bit hash: equal texts have equal results.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import materialise, mixed, pick, utf8_parts

WINDOW = 200
GRAM = 64
#: Offsets that an anchor may have within a window.
OFFSETS = WINDOW - GRAM + 1
#: Neighbouring offsets whose windows are compared across buckets by their common core first.
SLICE = 16
#: Windows that are worked on at once.
SEGMENT = 1 << 18
#: Bits of a Bloom filter at most (64 MB); with more grams than that is good for, more anchors pass.
MAX_BLOOM_BITS = 1 << 29
PROBES = 3
#: Suffixes of a bucket, on average.
BUCKET = 20_000

_BASES = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)
_PLACE = np.uint64((1 << 20) - 1)


@lru_cache(maxsize=2)
def _powers(base: int) -> tuple[np.ndarray, np.ndarray]:
    """base^i and base^-i modulo 2^64 for the places of a segment."""
    n = SEGMENT + OFFSETS + WINDOW + 8
    out = []
    for b in (base, pow(base, -1, 1 << 64)):
        steps = np.full(n, b, np.uint64)
        steps[0] = 1
        out.append(np.multiply.accumulate(steps))
    return out[0], out[1]


def _sums(values: np.ndarray, base: int) -> np.ndarray:
    return np.concatenate([np.zeros(1, np.uint64), np.cumsum(values * _powers(base)[1][:len(values)])])


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each ``width`` consecutive values (blockwise running minima from both sides)."""
    n = len(values)
    blocks = -(-n // width)
    padded = np.full(blocks * width, np.iinfo(values.dtype).max, values.dtype)
    padded[:n] = values
    table = padded.reshape(blocks, width)
    forward = np.minimum.accumulate(table, axis=1).ravel()
    backward = np.minimum.accumulate(table[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(backward[:n - width + 1], forward[width - 1:n])


def anchors_of(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, ...]:
    """(anchor, first window, last window, hash of the gram, hash of the block) of the texts
    that lie between ``bounds``; places count from the begin of ``data``."""
    out: list[tuple] = []
    n_windows = len(data) - WINDOW + 1
    for begin in range(0, max(0, n_windows), SEGMENT):
        end = min(begin + SEGMENT, n_windows)
        # one window more before, to see whether a run began earlier, and a whole run more after
        low, high = max(0, begin - 1), min(n_windows, end + OFFSETS)
        values = data[low:high - 1 + WINDOW].astype(np.uint64) + np.uint64(1)
        sums = _sums(values, _BASES[0])
        n_grams = len(values) - GRAM + 1
        grams = mixed((sums[GRAM:] - sums[:n_grams]) * _powers(_BASES[0])[0][:n_grams])
        place = (sliding_min((grams & ~_PLACE) | np.arange(n_grams, dtype=np.uint64), OFFSETS)
                 & _PLACE).astype(np.int64)
        # windows that reach into the next text
        across = np.zeros(high - low + 1, np.int32)
        np.add.at(across, np.clip(bounds[1:] - WINDOW + 1 - low, 0, high - low), 1)
        np.add.at(across, np.clip(bounds[1:] - low, 0, high - low), -1)
        whole = np.cumsum(across[:-1]) == 0
        change = np.ones(len(place) + 1, np.bool_)
        change[1:-1] = (place[1:] != place[:-1]) | (whole[1:] != whole[:-1])
        cuts = np.flatnonzero(change)
        first, last = cuts[:-1], cuts[1:] - 1
        keep = whole[first] & (first + low >= begin) & (first + low < end)
        first, last = first[keep], last[keep]
        at = place[first]
        more = _sums(values, _BASES[1])
        block = mixed((more[last + WINDOW] - more[first]) * _powers(_BASES[1])[0][first]
                      + (last - first).astype(np.uint64))
        out.append((at + low, first + low, last + low, grams[at].view(np.int64), block.view(np.int64)))
    if not out:
        return tuple(np.zeros(0, np.int64) for _ in range(5))
    return tuple(np.concatenate(part) for part in zip(*out, strict=True))


# --- Bloom filters of grams -------------------------------------------------

def bloom_filter(grams: DataFrame, rows: int) -> np.ndarray:
    """Bits (packed, lowest first) of a Bloom filter of the column gram, built by Spark."""
    n_bits = min(MAX_BLOOM_BITS, 1 << max(16, (16 * rows).bit_length()))
    a = F.shiftrightunsigned("gram", 32)
    b = F.col("gram").bitwiseAND(F.lit((1 << 32) - 1)).bitwiseOR(F.lit(1))
    places = F.array(*[(a + b * i).bitwiseAND(F.lit(n_bits - 1)) for i in range(PROBES)])
    bits = grams.select(F.explode(places).alias("bit"))
    # Spark numbers the values from 1: value v is bit (v - 1) % 32768 of bucket 1 + (v - 1) / 32768
    value = F.col("bit") + 1
    buckets = (bits.groupBy(F.bitmap_bucket_number(value).alias("bucket"))
               .agg(F.bitmap_construct_agg(F.bitmap_bit_position(value)).alias("bits")))
    out = np.zeros(n_bits // 8, np.uint8)
    for r in buckets.toLocalIterator():  # at most MAX_BLOOM_BITS altogether
        at = int(r.bucket - 1) * 4096
        out[at:at + 4096] = np.frombuffer(r.bits, np.uint8)
    return out


def in_bloom(bloom: np.ndarray, n_bits: int, gram: np.ndarray) -> np.ndarray:
    value = gram.view(np.uint64)
    a, b = value >> np.uint64(32), value & np.uint64((1 << 32) - 1) | np.uint64(1)
    out = np.ones(len(value), np.bool_)
    for i in range(PROBES):
        bit = (a + np.uint64(i) * b) & np.uint64(n_bits - 1)
        out &= (bloom[(bit >> np.uint64(3)).astype(np.int64)] >> (bit & np.uint64(7)).astype(np.uint8)) & 1 > 0
    return out


# --- sorting ----------------------------------------------------------------

def multikey_order(words: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Order of the rows of ``words`` (n x w, big-endian words), shorter rows first among equal ones.

    Multikey quicksort with a word as character: sort by the first word, then
    every group of equal words by the next one; rows that are alone are done.
    """
    order = np.argsort(words[:, 0], kind="stable")
    group = np.zeros(len(order), np.int64)
    group[1:] = np.cumsum(words[order[1:], 0] != words[order[:-1], 0])
    for column in (*words.T[1:], lengths):
        size = np.bincount(group)
        open_ = np.flatnonzero(size[group] > 1)
        if not len(open_):
            break
        value = column[order[open_]]
        inner = np.lexsort((value, group[open_]))
        order[open_] = order[open_[inner]]
        value = column[order[open_]]
        new = np.zeros(len(order), np.bool_)
        new[1:] = group[1:] != group[:-1]
        differs = np.flatnonzero((value[1:] != value[:-1]) & (group[open_[1:]] == group[open_[:-1]]))
        new[open_[differs + 1]] = True
        group = np.cumsum(new)
    return order


def sorted_prefixes(strings: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray]:
    """(order of the strings, common prefix of each with the one before it; the first has 0)."""
    n = len(strings)
    padded = -(-width // 8) * 8
    table = np.frombuffer(b"".join([s.ljust(padded, b"\0") for s in strings]), np.uint8).reshape(n, padded)
    lengths = np.fromiter(map(len, strings), np.int64, n)
    order = multikey_order(table.view(">u8").astype(np.uint64), lengths)
    rows = table[order]
    differ = rows[1:] != rows[:-1]
    common = np.where(differ.any(axis=1), differ.argmax(axis=1), padded)
    shorter = np.minimum(lengths[order][1:], lengths[order][:-1])
    return order, np.concatenate([[0], np.minimum(common, shorter)])


def _classes(order: np.ndarray, common: np.ndarray, depth: int) -> np.ndarray:
    """A number per row; rows with the same first ``depth`` bytes have the same."""
    out = np.empty(len(order), np.int64)
    out[order] = np.cumsum(common < depth)
    return out


class Bucket:
    """The suffixes of a bucket, sorted both ways.

    ``right`` are the bytes from the anchors on, ``left`` those before them,
    backwards; ``times`` tells how often each pair occurs.
    """

    def __init__(self, right: list[bytes], left: list[bytes], times: np.ndarray):
        n = len(right)
        self.times = times
        self.right = sorted_prefixes(right, WINDOW)
        self.left = sorted_prefixes(left, OFFSETS)
        self.r_length = np.fromiter(map(len, right), np.int64, n)
        self.l_length = np.fromiter(map(len, left), np.int64, n)
        # the longest prefix that each suffix shares with the bucket's first or last one
        order, common = self.right
        whole = self.r_length[order]
        from_first = np.minimum.accumulate(np.concatenate([whole[:1], common[1:]]))
        to_last = np.minimum.accumulate(np.concatenate([whole[-1:], common[:0:-1]]))[::-1]
        self.edge = np.empty(n, np.int64)
        self.edge[order] = np.maximum(from_first, to_last)

    def classes(self, rows: np.ndarray, ahead: int, back: int):
        """(first row, class of each row, times of each class) by ``ahead`` bytes from the anchor and ``back`` before."""
        n = len(self.times)
        both = _classes(*self.right, ahead)[rows] * (n + 1) + (_classes(*self.left, back)[rows] if back else 0)
        _, first, where = np.unique(both, return_index=True, return_inverse=True)
        return rows[first], where, np.bincount(where, self.times[rows]).astype(np.int64)

    def compare(self):
        """What the bucket tells about its windows.

        Returns (smallest, largest) offset whose window occurs twice in the
        bucket (-1 where none does); the windows that may occur in another
        bucket, as lists of (rows, offset, times), one row for each different
        window; and the cores, as lists of (rows, slice, times, alone).  The
        windows around a core that is ``alone`` in the bucket are left to the
        comparison of cores.
        """
        n = len(self.times)
        smallest, largest = np.full(n, -1), np.full(n, -1)
        windows, cores = [], []
        for begin in range(0, OFFSETS, SLICE):
            end = min(begin + SLICE, OFFSETS)  # offsets begin .. end - 1
            top = np.minimum(end - 1, self.l_length)  # the largest that the row has
            rows = np.flatnonzero((top >= begin) & (self.r_length >= WINDOW - top) & (self.edge >= WINDOW - top))
            shared = np.zeros(n, np.bool_)  # rows whose core occurs twice in the bucket
            if len(rows):
                first, where, number = self.classes(rows, WINDOW - end + 1, begin)
                alone = np.bincount(where) == 1
                shared[rows] = ~alone[where]
                cores.append((first, begin // SLICE, number, alone))
            for o in range(begin, end):
                has = np.flatnonzero((self.r_length >= WINDOW - o) & (self.l_length >= o))
                if not len(has):
                    continue
                first, where, number = self.classes(has, WINDOW - o, o)
                again = has[number[where] > 1]
                smallest[again] = np.where(smallest[again] < 0, o, smallest[again])
                largest[again] = o
                reach = (self.edge[first] >= WINDOW - o) & shared[first]
                if reach.any():
                    windows.append((first[reach], o, number[reach]))
        return smallest, largest, windows, cores


def _hashes(left: list[bytes], right: list[bytes], rows: list[int], back: int, ahead: int) -> np.ndarray:
    """128-bit hashes, as pairs of integers, of ``back`` bytes before the anchors and ``ahead`` from them on."""
    digests = [xxhash.xxh3_128_digest(left[i][:back][::-1] + right[i][:ahead]) for i in rows]
    return np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2)


# --- the operator -----------------------------------------------------------

def _named(docs: DataFrame) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    return docs.withColumns({"h1": F.xxhash64(text), "h2": F.xxhash64(F.lit(1), text)})


def repeated_grams(docs: DataFrame) -> DataFrame:
    """(gram, mixed) of the grams that are the anchor of two or more blocks; mixed: the blocks differ."""

    def run(batches):
        for batch in batches:
            _, _, _, gram, block = anchors_of(*utf8_parts(batch.column("text")))
            yield pa.RecordBatch.from_arrays([pa.array(gram), pa.array(block)], names=["gram", "block"])

    anchors = docs.select("text").mapInArrow(run, "gram long, block long")
    return (anchors.groupBy("gram").agg(F.count("*").alias("n"), F.min("block").alias("low"),
                                        F.max("block").alias("high"))
            .filter("n > 1").select("gram", (F.col("low") != F.col("high")).alias("mixed")))


def _occurrences(docs: DataFrame, every: np.ndarray, mixed_ones: np.ndarray) -> DataFrame:
    """Anchors that pass the filters: h1, h2, at, first, last, gram, block, and for mixed grams right, left."""
    shared = docs.sparkSession.sparkContext.broadcast((every, mixed_ones))

    def run(batches):
        all_bits, mixed_bits = shared.value
        for batch in batches:
            data, bounds = utf8_parts(batch.column("text"))
            at, first, last, gram, block = anchors_of(data, bounds)
            keep = in_bloom(all_bits, len(all_bits) * 8, gram)
            at, first, last, gram, block = (x[keep] for x in (at, first, last, gram, block))
            row = np.searchsorted(bounds, first, side="right") - 1
            begin = bounds[row]
            right, left = [None] * len(at), [None] * len(at)
            whole = data.tobytes()
            for i in np.flatnonzero(in_bloom(mixed_bits, len(mixed_bits) * 8, gram)).tolist():
                right[i] = whole[at[i]:last[i] + WINDOW]
                left[i] = whole[first[i]:at[i]][::-1]
            rows = pa.array(row)
            yield pa.RecordBatch.from_arrays(
                [batch.column("h1").take(rows), batch.column("h2").take(rows), pa.array(at - begin),
                 pa.array(first - begin), pa.array(last - begin), pa.array(gram), pa.array(block),
                 pa.array(right, pa.binary()), pa.array(left, pa.binary())],
                names=["h1", "h2", "at", "first", "last", "gram", "block", "right", "left"])

    return docs.select("h1", "h2", "text").mapInArrow(
        run, "h1 long, h2 long, at long, first long, last long, gram long, block long, right binary, left binary")


_COMPARED = ("gram long, block long, kind int, smallest int, largest int, w1 long, w2 long, times long, "
             "alone boolean")
_LOCAL, _WINDOW, _CORE = 0, 1, 2


def _rows(kind, gram, block, smallest, largest, hashes, times, alone=None) -> pa.RecordBatch:
    n = len(gram)
    empty = pa.nulls(n, pa.int64())
    return pa.RecordBatch.from_arrays(
        [pa.array(gram), pa.array(block), pa.array(np.full(n, kind, np.int32)),
         pa.array(np.broadcast_to(smallest, n).astype(np.int32)), pa.array(np.broadcast_to(largest, n).astype(np.int32)),
         empty if hashes is None else pa.array(hashes[:, 0].copy()),
         empty if hashes is None else pa.array(hashes[:, 1].copy()),
         empty if times is None else pa.array(times), pa.array(np.zeros(n, np.bool_) if alone is None else alone)],
        names=[c.split()[0] for c in _COMPARED.split(", ")])


def _compare_buckets(batches):
    """A bucket of suffixes: the offsets it tells itself, and the windows and cores to compare across buckets."""
    held = [b for b in batches if b.num_rows]
    if not held:
        return
    rows = pa.Table.from_batches(held)
    right, left = rows.column("right").to_pylist(), rows.column("left").to_pylist()
    gram, block = rows.column("gram").to_numpy(), rows.column("block").to_numpy()
    smallest, largest, windows, cores = Bucket(right, left, rows.column("times").to_numpy()).compare()
    some = smallest >= 0
    yield _rows(_LOCAL, gram[some], block[some], smallest[some], largest[some], None, None)
    for row, o, number in windows:
        yield _rows(_WINDOW, gram[row], block[row], o, o, _hashes(left, right, row.tolist(), o, WINDOW - o), number)
    for row, part, number, alone in cores:
        begin, end = part * SLICE, min((part + 1) * SLICE, OFFSETS)
        hashes = _hashes(left, right, row.tolist(), begin, WINDOW - end + 1)
        hashes = hashes ^ np.int64(part + 1)  # cores of different slices have nothing to do with each other
        yield _rows(_CORE, gram[row], block[row], part, part, hashes, number, alone)


def _open_cores(batches):
    """Windows around cores that occur in several buckets; columns gram, block, right, left, times, part."""
    for batch in batches:
        if not batch.num_rows:
            continue
        right, left = batch.column("right").to_pylist(), batch.column("left").to_pylist()
        gram, block = batch.column("gram").to_numpy(), batch.column("block").to_numpy()
        times, part = batch.column("times").to_numpy(), batch.column("part").to_numpy()
        for begin in np.unique(part).tolist():
            for o in range(begin * SLICE, min((begin + 1) * SLICE, OFFSETS)):
                row = np.array([i for i in np.flatnonzero(part == begin).tolist()
                                if len(left[i]) >= o and len(right[i]) >= WINDOW - o], np.int64)
                if len(row):
                    yield _rows(_WINDOW, gram[row], block[row], o, o,
                                _hashes(left, right, row.tolist(), o, WINDOW - o), times[row])


def repeated_intervals(docs: DataFrame) -> DataFrame:
    """(h1, h2, spans): for each text with repeats the intervals of bytes to remove, not merged.

    ``docs`` has the columns text, h1, h2.
    """
    grams = materialise(repeated_grams(docs), "suffix-grams")
    n_all, n_mixed = grams.agg(F.count("*"), F.count_if("mixed")).first()
    occurring = _occurrences(docs, bloom_filter(grams, n_all), bloom_filter(grams.filter("mixed"), n_mixed))
    found = materialise(occurring.join(grams, "gram"), "suffix-anchors")

    blocks = (found.filter("mixed").groupBy("gram", "block")
              .agg(F.count("*").alias("times"), F.first("right").alias("right"), F.first("left").alias("left")))
    blocks = materialise(blocks, "suffix-blocks")
    compared = materialise(
        blocks.repartitionByRange(max(1, -(-blocks.count() // BUCKET)), "right", "left")
        .mapInArrow(_compare_buckets, _COMPARED), "suffix-compared")
    cores = compared.filter(F.col("kind") == _CORE)
    again = cores.groupBy("w1", "w2").agg(F.sum("times").alias("all")).filter(F.col("all") > 1)
    opened = (cores.filter("alone").join(again, ["w1", "w2"])
              .select("gram", "block", F.col("smallest").alias("part")).join(blocks, ["gram", "block"])
              .select("gram", "block", "right", "left", "times", "part").mapInArrow(_open_cores, _COMPARED))
    windows = materialise(compared.filter(F.col("kind") == _WINDOW).unionByName(opened), "suffix-windows")
    again = windows.groupBy("w1", "w2").agg(F.sum("times").alias("all")).filter(F.col("all") > 1)
    across = windows.join(again, ["w1", "w2"]).select("gram", "block", "smallest", "largest")
    # stored, so that the join below has two plain sides and a hot block is split
    offsets = materialise(
        compared.filter(F.col("kind") == _LOCAL).select("gram", "block", "smallest", "largest").unionByName(across)
        .groupBy("gram", "block").agg(F.min("smallest").alias("smallest"), F.max("largest").alias("largest")),
        "suffix-offsets")

    pure = found.filter("not mixed").select("h1", "h2", F.col("first").alias("start"),
                                            (F.col("last") + WINDOW).alias("end"))
    partly = (found.filter("mixed").select("h1", "h2", "at", "gram", "block").join(offsets, ["gram", "block"])
              .select("h1", "h2", (F.col("at") - F.col("largest")).alias("start"),
                      (F.col("at") - F.col("smallest") + WINDOW).alias("end")))
    return (pure.unionByName(partly).distinct().groupBy("h1", "h2")
            .agg(F.collect_list(F.struct("start", "end")).alias("spans")))


def merged(spans: list[dict], size: int) -> list[tuple[int, int]]:
    """Maximal runs of the bytes that the spans cover."""
    out: list[list[int]] = []
    for start, end in sorted((s["start"], s["end"]) for s in spans or ()):
        if out and start <= out[-1][1]:
            out[-1][1] = max(out[-1][1], end)
        else:
            out.append([start, end])
    return [(a, min(b, size)) for a, b in out]


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                   with_bytes: bool = False) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept_sha256`` (and ``kept``, binary) of every row.

    Texts count as UTF-8 bytes, null as empty; matches never cross texts;
    repeated rows are occurrences of each other, so all their bytes go if there
    are at least ``WINDOW``; an empty table gives an empty table.  Kept bytes
    may end within a character.
    """
    base = _named(pick(docs, doc_id=id_col, text=text_col))
    spans = materialise(repeated_intervals(base), "suffix-spans")
    rows = base.join(spans, ["h1", "h2"], "left").select("doc_id", "text", "spans")
    schema = T.StructType([
        base.schema["doc_id"], T.StructField("n_bytes", T.LongType()), T.StructField("n_removed", T.LongType()),
        T.StructField("n_spans", T.LongType()), T.StructField("kept_sha256", T.StringType()),
        *([T.StructField("kept", T.BinaryType())] if with_bytes else [])])

    def run(batches):
        for batch in batches:
            data, bounds = utf8_parts(batch.column("text"))
            whole = data.tobytes()
            columns: list[list] = [[], [], [], [], []]
            for i, spans_of in enumerate(batch.column("spans").to_pylist()):
                text = whole[bounds[i]:bounds[i + 1]]
                runs = merged(spans_of, len(text))
                at, kept = 0, []
                for a, b in runs:
                    kept.append(text[at:a])
                    at = b
                left = b"".join([*kept, text[at:]])
                for column, value in zip(columns, (len(text), len(text) - len(left), len(runs),
                                                   hashlib.sha256(left).hexdigest(), left), strict=True):
                    column.append(value)
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary())
            made = [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *made[:len(schema) - 1]], names=schema.names)

    return rows.mapInArrow(run, schema)


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the bytes that a repeated 200-byte string covers."""
    return remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"))
