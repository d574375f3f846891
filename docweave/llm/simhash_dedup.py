"""SimHash near-dedup by anchor-point covering.

Fingerprints of 64 bits link when they differ in at most two bits.  The
anchors are a covering code: bits 0..22 and bits 23..45 are each covered by
the perfect binary Golay code (length 23, covering radius 3), so the 2^24
pairs of code words cover the first 46 bits with radius 6.  Two fingerprints
at distance 2 or less differ in e1 and e2 bits of the two halves with
e1 + e2 <= 2.  If x has the code word c1 within 3 of its first half and c2
within 3 of its second half (its *home* anchor), then y is within 3 + e1 of c1
and 3 + e2 of c2.  So it suffices to replicate y to every anchor within the
covering radius plus the threshold -- here told apart by half: excess over 3
of at most 2 in total -- and to compare, per anchor, the fingerprints at home
there with all the others (about 60 anchors per fingerprint).

Work per anchor is bounded: up to ``MAX_ANCHOR`` distinct fingerprints of an
anchor are compared directly; an anchor with more (a very large family of near
copies) hands them to an exact second way, where each fingerprint is grouped
under itself and its 64 neighbours at distance 1.  Two fingerprints differ in
at most 2 bits exactly if they share such a key, and a key has at most 65
distinct fingerprints, however large the family is.  In both ways only links
that join something new within their group are emitted, never all pairs.
"""

from __future__ import annotations

from functools import lru_cache
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Carried, materialise, pick, utf8_rows
from .components import connected_components

SEED = 42
SHINGLE_WORDS = 3
MAX_DISTANCE = 2
#: Distinct fingerprints that one anchor compares directly.
MAX_ANCHOR = 2048
#: Generator polynomial of the binary Golay code, x^11+x^10+x^6+x^5+x^4+x^2+1.
GOLAY = 0b110001110101
HALF = 23


def shingle_hashes(text: bytes, n_words: int = SHINGLE_WORDS) -> np.ndarray:
    """XXH64 of every shingle, repeats included.

    A-Z become lower case; words are runs of other bytes than U+0020 and
    U+0009..U+000D; a text of fewer words is one shingle, one without words none.
    """
    words = text.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    if len(words) < n_words:
        shingles = [b" ".join(words)]
    else:
        shingles = [b" ".join(s) for s in zip(*(words[i:] for i in range(n_words)), strict=False)]
    return np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(SEED)), np.uint64, len(shingles))


def simhash(hashes: np.ndarray) -> int:
    """Bit i is 1 if it is set in over half the hashes; zero without hashes."""
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        bits = np.unpackbits(hashes[at:at + (1 << 16)].astype("<u8").view(np.uint8).reshape(-1, 8),
                             axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    over = (2 * ones > len(hashes)).astype(np.uint8)
    return int(np.packbits(over, bitorder="little").view("<u8")[0])


def with_fingerprints(docs: DataFrame, text: str, n_words: int = SHINGLE_WORDS) -> DataFrame:
    """``docs`` without ``text``, with the column ``fp`` (long, the 64 bits)."""
    from pyspark.sql import types as T

    kept = [f.name for f in docs.schema.fields if f.name != text]
    schema = T.StructType([*[docs.schema[k] for k in kept], T.StructField("fp", T.LongType())])

    def run(batches):
        for batch in batches:
            fps = np.fromiter((simhash(shingle_hashes(t, n_words)) for t in utf8_rows(batch.column(text))),
                              np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([*[batch.column(k) for k in kept], pa.array(fps.view(np.int64))],
                                             names=[*kept, "fp"])

    return docs.mapInArrow(run, schema)


@lru_cache(maxsize=4)
def golay_tables(extra: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(syndromes of 23-bit words, error patterns by syndrome, their excess over weight 3).

    Every pattern of weight 3 + ``extra`` or less is listed under its
    syndrome; word XOR pattern is then a code word.  Rows are padded with
    excess ``extra`` + 1.
    """
    syndromes = np.zeros(1 << HALF, np.uint16)
    for bit in range(HALF):
        rest = 1 << bit
        for at in range(HALF - 1, 10, -1):
            if rest >> at & 1:
                rest ^= GOLAY << (at - 11)
        syndromes[1 << bit:2 << bit] = syndromes[:1 << bit] ^ np.uint16(rest)
    rows: list[list[tuple[int, int]]] = [[] for _ in range(2048)]
    for weight in range(3 + extra + 1):
        for places in combinations(range(HALF), weight):
            pattern = sum(1 << p for p in places)
            rows[syndromes[pattern]].append((pattern, max(0, weight - 3)))
    width = max(map(len, rows))
    patterns = np.zeros((2048, width), np.int64)
    excess = np.full((2048, width), extra + 1, np.int8)
    for s, row in enumerate(rows):
        patterns[s, :len(row)] = [p for p, _ in row]
        excess[s, :len(row)] = [x for _, x in row]
    return syndromes, patterns, excess


def anchors_of(fps: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(index into ``fps``, anchor, is it the home anchor) of all replicas."""
    syndromes, patterns, excess = golay_tables(distance)
    low, high = (fps & ((1 << HALF) - 1)), ((fps >> HALF) & ((1 << HALF) - 1))
    s_low, s_high = syndromes[low], syndromes[high]
    total = excess[s_low][:, :, None] + excess[s_high][:, None, :]
    index, i, j = np.nonzero(total <= distance)
    first = low[index] ^ patterns[s_low[index], i]
    second = high[index] ^ patterns[s_high[index], j]
    return index, (second << HALF) | first, total[index, i, j] == 0


def links_of(fps: np.ndarray, home: np.ndarray, distance: int) -> list[tuple[int, int]]:
    """Links of one anchor that join something new: a spanning forest of its link graph."""
    out: list[tuple[int, int]] = []
    label = np.arange(len(fps))
    for x in np.flatnonzero(home).tolist():
        near = np.flatnonzero(np.bitwise_count((fps ^ fps[x]).view(np.uint64)) <= distance)
        near = near[label[near] != label[x]]
        if len(near):
            joined, first = np.unique(label[near], return_index=True)
            out.extend((int(fps[x]), int(fps[y])) for y in near[first].tolist())
            label[np.isin(label, joined)] = label[x]
    return out


_LINKS = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("crowded", pa.bool_())])


def _compare(distance: int):
    """For ``mapInArrow`` over rows sorted by anchor: links (a, b), or members of crowded anchors."""

    def rows(links: list[tuple[int, int]], crowd: list[np.ndarray]) -> pa.RecordBatch:
        pairs = np.array(links, np.int64).reshape(-1, 2)
        members = np.concatenate([*crowd, np.zeros(0, np.int64)])
        flags = np.repeat([False, True], [len(pairs), len(members)])
        return pa.RecordBatch.from_arrays(
            [pa.array(np.concatenate([pairs[:, 0], members])), pa.array(np.concatenate([pairs[:, 1], members])),
             pa.array(flags)], schema=_LINKS)

    def run(batches):
        # the group that the next batch may go on with
        anchor, crowded = None, False
        fps, home = np.zeros(0, np.int64), np.zeros(0, np.bool_)
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = batch.column("anchor").to_numpy()
            all_fps = batch.column("fp").to_numpy()
            all_home = batch.column("home").to_numpy(zero_copy_only=False)
            begins = np.concatenate([[0], np.flatnonzero(keys[1:] != keys[:-1]) + 1])
            ends = np.concatenate([begins[1:], [len(keys)]])
            at_home = np.add.reduceat(all_home.astype(np.int64), begins)
            # the first and the last group may go on over a border; of the others, those with a pair
            wanted = (ends - begins > 1) & (at_home > 0)
            wanted[0] = wanted[-1] = True
            links: list[tuple[int, int]] = []
            crowd: list[np.ndarray] = []
            for begin, end in zip(begins[wanted].tolist(), ends[wanted].tolist(), strict=True):
                if keys[begin] == anchor:
                    fps = np.concatenate([fps, all_fps[begin:end]])
                    home = np.concatenate([home, all_home[begin:end]])
                else:
                    if crowded:
                        crowd.append(fps)
                    else:
                        links += links_of(fps, home, distance)
                    anchor, crowded = keys[begin], False
                    fps, home = all_fps[begin:end], all_home[begin:end]
                if len(fps) > MAX_ANCHOR or crowded:  # passed on at once: the buffer stays small
                    crowded = True
                    crowd.append(fps)
                    fps, home = fps[:0], home[:0]
            yield rows(links, crowd)
        yield rows([] if crowded else links_of(fps, home, distance), [fps] if crowded else [])

    return run


def fingerprint_links(fps: DataFrame, distance: int = MAX_DISTANCE) -> DataFrame:
    """Links (a, b) between the distinct fingerprints ``fp``; their components are those of all links."""
    if distance != 2:
        raise ValueError("the anchors and the second way are laid out for a distance of 2")

    def replicate(batches):
        for batch in batches:
            values = batch.column("fp").to_numpy()
            for at in range(0, len(values), 1024):
                part = values[at:at + 1024]
                index, anchor, home = anchors_of(part, distance)
                yield pa.RecordBatch.from_arrays([pa.array(anchor), pa.array(part[index]), pa.array(home)],
                                                 names=["anchor", "fp", "home"])

    replicas = fps.select("fp").mapInArrow(replicate, "anchor long, fp long, home boolean")
    compared = materialise(replicas.repartition("anchor").sortWithinPartitions("anchor")
                           .mapInArrow(_compare(distance), "a long, b long, crowded boolean"), "simhash-links")
    direct = compared.filter("not crowded").select("a", "b")
    crowd = compared.filter("crowded").select(F.col("a").alias("fp")).distinct()
    near = F.concat(F.array("fp"), F.transform(
        F.sequence(F.lit(0), F.lit(63)),
        lambda i: F.col("fp").bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), i))))
    keyed = crowd.select("fp", F.explode(near).alias("key"))
    lowest = keyed.groupBy("key").agg(F.min("fp").alias("low"))
    second = keyed.join(lowest, "key").filter("fp <> low").select(F.col("fp").alias("a"), F.col("low").alias("b"))
    return direct.unionByName(second.distinct())


def near_components(prints: DataFrame, distance: int = MAX_DISTANCE) -> DataFrame:
    """(fp, root) of every fingerprint that has a link; equal root = same component.

    ``prints`` is a stored table with the column ``fp``; its distinct values
    are compared, so exact copies cost one fingerprint.
    """
    links = fingerprint_links(prints.select("fp").distinct(), distance)
    return connected_components(links).select(F.col("node").alias("fp"), "root")


def simhash_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                       n_words: int = SHINGLE_WORDS, distance: int = MAX_DISTANCE) -> DataFrame:
    """``doc_id, fp, component_id`` for every row of ``docs``.

    ``component_id`` is the smallest id reachable over links (null ids are
    never the smallest unless a component has no other).  Null texts count as
    empty; texts without words have the fingerprint zero, linked like any
    other; repeated rows give repeated rows; an empty table an empty table.
    """
    base = pick(docs, id=id_col, text=text_col)
    prints = materialise(with_fingerprints(base, "text", n_words), "simhash-prints")
    roots = near_components(prints, distance)
    lowest = prints.groupBy("fp").agg(F.min("id").alias("low"))
    rooted = lowest.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    named = rooted.groupBy("root").agg(F.min("low").alias("component_id"))
    # stored, so that the join below has two plain sides and a hot fingerprint is split
    by_print = materialise(rooted.join(named, "root").select("fp", "component_id"), "simhash-components")
    return prints.join(by_print, "fp").select(F.col("id").alias("doc_id"), "fp", "component_id")


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                         n_words: int = SHINGLE_WORDS, distance: int = MAX_DISTANCE) -> DataFrame:
    """One row of each component of near duplicates, with the columns of ``docs``.

    The row with the smallest id stays (null ids last; among rows with the
    same smallest id exactly one).  The rows are written once with a tag, so
    that equal ids and repeated rows are told apart.
    """
    carried = Carried(docs)
    own = [f"c{i}" for i in range(len(carried.names))]
    tagged = materialise(carried.df.select(*own, F.monotonically_increasing_id().alias("tag")), "simhash-docs")
    base = tagged.select(carried.col(id_col).alias("id"), "tag", carried.col(text_col).alias("text"))
    prints = materialise(with_fingerprints(base, "text", n_words), "simhash-prints")
    order = F.struct(F.col("id").isNull().alias("no_id"), F.col("id").alias("id"), F.col("tag").alias("tag"))
    roots = near_components(prints, distance)
    lowest = prints.groupBy("fp").agg(F.min(order).alias("low"), F.count("*").alias("n"))
    rooted = lowest.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    # rows to drop: all but the first of every component of two or more rows
    firsts = (rooted.groupBy("root").agg(F.min("low").alias("first"), F.sum("n").alias("rows"))
              .filter("rows > 1"))
    kept = materialise(rooted.join(firsts, "root").select("fp", F.col("first.tag").alias("first_tag")),
                       "simhash-kept")
    dropped = (prints.join(kept, "fp")
               .filter("tag <> first_tag").select("tag"))
    return tagged.join(dropped, "tag", "left_anti").select(*own).toDF(*carried.names)


def op7_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its SimHash fingerprint and its component of near duplicates."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return simhash_components(docs).select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
