"""Best-fit packing by bin-completion branch and bound.

Documents become pieces of at most ``CAPACITY`` token ids and the pieces are
packed into as few sequences as possible.  Only the *lengths* of pieces
matter, and there are at most ``CAPACITY`` different ones, so Spark counts the
pieces of each length and the search runs over that histogram, whose size does
not grow with the corpus:

* A best-fit decreasing solution is the first incumbent.
* Bin completion takes the largest length left and branches over fillings of
  the room beside it.  A first, quick search tries the likely ones: exact ones
  of one, two and three lengths and the fullest of all, each for as many
  sequences as the counts allow, so a path has at most one step per length.
* If that leaves a gap to the bound, a second search enumerates all undominated
  fillings, lazily and by rising waste, each for as many sequences as the
  counts allow and then for fewer.  A filling is dominated if a length that is
  left fits into its waste, alone or in place of some of its items.
* A branch is cut when its waste exceeds what a better solution than the
  incumbent may waste.  A search ends at the lower bound (Martello and Toth's
  L2), with all branches tried, or after ``NODES`` steps (the second one also
  after ``NODES * TRIES`` looks at fillings) with the best solution found;
  these limits concern optimality only, every piece is always packed.

The solution is a list of patterns (lengths, how often).  The pieces of each
length are numbered without gaps, by counts per task, and piece number r of a
length takes the r-th place that the patterns have for it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import numbered, pick
from .tokens import VOCABULARY, crc32, encoded

CAPACITY = 4096
END_ID = 1
#: Steps of the search after which the best solution found is used.
NODES = 6000
#: Largest lengths that a filling of three or more is begun with, in the quick search.
TRIED = 64
#: Looks at possible fillings for each step of the second search.
TRIES = 30

Pattern = tuple[tuple[int, ...], int]


def lower_bound(counts: np.ndarray, capacity: int) -> int:
    """Martello and Toth's L2: for each k, lengths over capacity - k stand alone,
    those over half take a sequence each, and the others down to k fill up."""
    size = np.arange(capacity + 1)
    n = np.concatenate([[0], np.cumsum(counts[1:])])  # of lengths up to i
    total = np.concatenate([[0], np.cumsum((size * counts)[1:])])
    best = -(-int(total[-1]) // capacity)
    half = capacity // 2
    for k in range(0, half + 1):
        alone = int(n[capacity] - n[capacity - k])
        over = int(n[capacity - k] - n[half])
        room = over * capacity - int(total[capacity - k] - total[half])
        small = int(total[half] - (total[k - 1] if k else 0))
        best = max(best, alone + over + max(0, -(-(small - room) // capacity)))
    return best


def best_fit(counts: np.ndarray, capacity: int) -> list[Pattern]:
    """Best-fit decreasing over the histogram; equal sequences are kept as one group."""
    groups: list[list[list]] = [[] for _ in range(capacity + 1)]  # by room: [lengths, how often]
    has = np.zeros(capacity + 1, np.bool_)
    for size in range(capacity, 0, -1):
        left = int(counts[size])
        while left:
            rooms = np.flatnonzero(has[size:])
            if len(rooms):
                room = size + int(rooms[0])
                lengths, often = groups[room].pop()
                used = min(often, left)
                if often > used:
                    groups[room].append([lengths, often - used])
                has[room] = bool(groups[room])
                items = (*lengths, size)
            else:
                per, room = capacity // size, capacity
                used = max(1, left // per) if left >= per else 1
                times = min(per, left)
                groups[capacity - size * times].append([(size,) * times, used])
                has[capacity - size * times] = True
                left -= used * times
                continue
            groups[room - size].append([items, used])
            has[room - size] = True
            left -= used
    return [(tuple(lengths), often) for room in groups for lengths, often in room]


def _exact(counts: np.ndarray, room: int, most: int, items: int) -> Iterator[tuple[int, ...]]:
    """Fillings of exactly ``room`` by ``items`` lengths of at most ``most``, larger ones first."""
    if items == 1:
        if 0 < room <= most and counts[room]:
            yield (room,)
        return
    top = min(most, room - items + 1)
    if top < 1:
        return
    if items == 2:
        low = -(-room // 2)
        if low > top:
            return
        larger = np.arange(top, low - 1, -1)
        fits = (counts[larger] > 0) & (counts[room - larger] > (larger == room - larger))
        for a in larger[fits].tolist():
            yield (a, room - a)
        return
    low = -(-room // items)
    for a in (np.flatnonzero(counts[low:top + 1])[::-1][:TRIED] + low).tolist():
        counts[a] -= 1
        try:
            for rest in _exact(counts, room - a, a, items - 1):
                yield (a, *rest)
        finally:
            counts[a] += 1


def _fullest(counts: np.ndarray, room: int) -> tuple[int, ...]:
    """The filling with the largest total up to ``room`` (sums as bits of an integer), larger lengths first."""
    mask = (1 << (room + 1)) - 1
    sizes = np.flatnonzero(counts[:room + 1])[::-1].tolist()
    reached = [1]
    used = []
    for size in sizes:
        sums, times = reached[-1], min(int(counts[size]), room // size)
        step = 1
        while times:
            take = min(step, times)
            sums |= sums << (size * take)
            times -= take
            step *= 2
        reached.append(sums & mask)
        used.append(size)
        if reached[-1] >> room & 1:
            break
    goal = reached[-1].bit_length() - 1
    out: list[int] = []
    for i in range(len(used) - 1, -1, -1):
        while not reached[i] >> goal & 1:
            out.append(used[i])
            goal -= used[i]
    return tuple(out)


def likely_fillings(counts: np.ndarray, room: int, allowed: int) -> Iterator[tuple[int, ...]]:
    """Fillings of ``room`` by rising waste: without waste by one, two or three
    lengths, then the fullest of all, if it wastes no more than ``allowed``."""
    for items in (1, 2, 3):
        exact = next(_exact(counts, room, room, items), None)
        if exact is not None:
            yield exact
    fullest = _fullest(counts, room)
    waste = room - sum(fullest)
    if waste <= allowed and (waste or len(fullest) not in (1, 2, 3)):
        yield fullest


def _sums(items: tuple[int, ...]) -> set[int]:
    """Totals of two or more of the items; of two only if there are many items."""
    if len(items) > 12:
        return {a + b for i, a in enumerate(items) for b in items[:i]}
    one_or_more, several = set(), set()
    for x in items:
        several |= {x + t for t in one_or_more}
        one_or_more |= {x + t for t in one_or_more} | {x}
    return several


def undominated_fillings(counts: np.ndarray, room: int, allowed: int, looks: list[int]) -> Iterator[tuple[int, ...]]:
    """All undominated fillings of ``room`` that waste no more than ``allowed``, by
    rising waste and larger items first, while ``looks`` are left.

    The exchange of a length that is left for items of at most its size, where
    the waste makes up the difference, is never worse: such fillings are
    dominated.  (With over 12 items, exchanges for three or more of them are
    not looked for; a filling too many costs time only.)
    """
    left = counts[:room + 1]
    sizes = np.flatnonzero(left)[::-1].tolist()
    upto = np.cumsum(left)
    sums = 1  # reachable totals, as bits
    for size in sizes:
        times, step = min(int(left[size]), room // size), 1
        while times:
            take = min(step, times)
            sums |= sums << (size * take)
            times -= take
            step *= 2
    sums &= (1 << (room + 1)) - 1

    def within(low: int, high: int, items: tuple[int, ...]) -> bool:
        """Is a length from low to high left beside the items?"""
        if high < low:
            return False
        return int(upto[high] - (upto[low - 1] if low else 0)) > sum(low <= x <= high for x in items)

    def dominated(items: tuple[int, ...], waste: int) -> bool:
        return (within(1, waste, items) or any(within(x + 1, x + waste, items) for x in set(items))
                or any(within(t, t + waste, items) for t in _sums(items)))

    def of_total(total: int, at: int) -> Iterator[tuple[int, ...]]:
        if not total:
            yield ()
            return
        for i in range(at, len(sizes)):
            size = sizes[i]
            if size > total or not sums >> (total - size) & 1:
                continue
            looks[0] -= 1
            if looks[0] < 0:
                return
            for times in range(min(int(left[size]), total // size), 0, -1):
                for rest in of_total(total - size * times, i + 1):
                    yield (size,) * times + rest

    for waste in range(0, min(allowed, room) + 1):
        if looks[0] < 0:
            return
        if sums >> (room - waste) & 1:
            for items in of_total(room - waste, 0):
                if not dominated(items, waste):
                    yield items


def _search(counts: np.ndarray, capacity: int, best: list[Pattern], bound: int, nodes: int, thorough: bool) -> list[Pattern]:
    """Depth first; each level has the choices for its largest length."""
    total = int((counts * np.arange(capacity + 1)).sum())
    n_best = sum(often for _, often in best)
    looks = [nodes * TRIES]

    def choices(now: np.ndarray, largest: int, waste: int, closed: set) -> Iterator[tuple]:
        """(pattern, how often, lengths, need of each, closed fillings of the branch)."""
        without = now.copy()
        without[largest] -= 1
        room, allowed = capacity - largest, (n_best - 1) * capacity - total - waste
        found_by = (undominated_fillings(without, room, allowed, looks) if thorough
                    else likely_fillings(without, room, allowed))
        for found in found_by:
            if found in closed:
                continue
            lengths = tuple(sorted((largest, *found), reverse=True))
            sizes, need = np.unique(lengths, return_counts=True)
            often = int((now[sizes] // need).min())
            closed = closed | {found}  # all branches with it are under this choice
            for times in range(often, 0, -1) if thorough else (often,):
                yield lengths, times, sizes, need, closed if thorough else set()

    path: list[Pattern] = []
    levels: list[list] = []  # [choices, counts, sequences, waste, largest]
    state = (counts, 0, 0, 0, set())
    steps = 0
    while n_best > bound and steps < nodes:
        now, sequences, waste, before, closed = state
        if not now.any():
            if sequences < n_best:
                n_best, best = sequences, list(path)
        elif sequences < n_best - 1:
            largest = int(np.flatnonzero(now)[-1])
            levels.append([choices(now, largest, waste, closed if largest == before else set()),
                           now, sequences, waste, largest])
        state = None
        while levels and state is None:
            level = levels[-1]
            if len(path) >= len(levels):
                del path[len(levels) - 1:]
            options, held, begun, wasted, first = level
            chosen = next(options, None)
            if chosen is None:
                levels.pop()
                continue
            lengths, often, sizes, need, closed = chosen
            lost = capacity - sum(lengths)
            spare = (n_best - 1) * capacity - total - wasted
            if lost * often > spare:
                if thorough or lost > spare:
                    continue
                often = spare // lost  # not repeated beyond what the bound allows
            after = held.copy()
            after[sizes] -= need * often
            path.append((lengths, often))
            state = (after, begun + often, wasted + lost * often, first, closed)
            steps += 1
        if state is None:
            break
    return best


def plan_sequences(counts: np.ndarray, capacity: int, nodes: int = NODES) -> list[Pattern]:
    """Patterns (lengths in falling order, how often) that use up ``counts``."""
    counts = counts.astype(np.int64)
    full: list[Pattern] = [((capacity,), int(counts[capacity]))] if counts[capacity] else []
    counts = counts.copy()
    counts[capacity] = 0
    if not counts.any():
        return full
    best = best_fit(counts, capacity)
    bound = lower_bound(counts, capacity)
    for thorough in (False, True):
        best = _search(counts, capacity, best, bound, nodes, thorough)
    return full + [(tuple(sorted(lengths, reverse=True)), often) for lengths, often in best]


class Places:
    """Where piece number r of each length goes, as flat arrays searched at once."""

    def __init__(self, patterns: list[Pattern]):
        taken: dict[int, int] = {}
        rows, base = [], 0
        for lengths, often in patterns:
            offset = 0
            for size in dict.fromkeys(lengths):
                times = lengths.count(size)
                rows.append((size, taken.get(size, 0), times, base, offset))
                taken[size] = taken.get(size, 0) + times * often
                offset += size * times
            base += often
        table = np.array(sorted(rows), np.int64).reshape(-1, 5)
        self.key = (table[:, 0] << 44) + table[:, 1]
        self.first, self.times, self.base, self.offset = table[:, 1:].T

    def of(self, length: np.ndarray, number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(sequence, offset) of the pieces with these numbers among those of their length."""
        at = np.searchsorted(self.key, (length << 44) + number, side="right") - 1
        nth = number - self.first[at]
        return (self.base[at] + nth // self.times[at],
                self.offset[at] + nth % self.times[at] * length)


def cut_pieces(docs: DataFrame, capacity: int, with_ids: bool, vocabulary: str):
    """(batches of doc_id, text -> batches of pieces, their schema).

    ``doc_id, piece, start, length, ids_crc32, key`` (the length as int) and
    ``ids``, little-endian unsigned 32-bit integers.
    """
    schema = T.StructType([
        docs.schema["doc_id"], T.StructField("piece", T.IntegerType()), T.StructField("start", T.LongType()),
        T.StructField("length", T.LongType()), T.StructField("ids_crc32", T.LongType()),
        T.StructField("key", T.IntegerType()), *([T.StructField("ids", T.BinaryType())] if with_ids else [])])

    def run(batches):
        for batch in batches:
            row, piece, start, length, crc, data = [], [], [], [], [], []
            for i, ids in enumerate(encoded(batch.column("text"), vocabulary)):
                whole = np.append(ids, np.uint32(END_ID))
                for p, at in enumerate(range(0, len(whole), capacity)):
                    part = whole[at:at + capacity]
                    row.append(i)
                    piece.append(p)
                    start.append(at)
                    length.append(len(part))
                    crc.append(crc32(part))
                    if with_ids:
                        data.append(part.astype("<u4").tobytes())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()),
                 pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64()),
                 pa.array(length, pa.int32()), *([pa.array(data, pa.binary())] if with_ids else [])],
                names=schema.names)

    return run, schema


def pack_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY,
                   with_ids: bool = False, vocabulary: str = VOCABULARY) -> DataFrame:
    """Every piece of every document with its sequence and its offset there.

    Columns: ``doc_id, piece, start, length, ids_crc32, sequence_id, offset``
    and, ``with_ids``, the piece's ids.  A null text counts as empty (one
    piece: the end id); repeated rows and equal ids are packed once for each
    row; sequences are gapless from offset 0; an empty table gives an empty
    table.
    """
    base = pick(docs, doc_id=id_col, text=text_col)
    cut, schema = cut_pieces(base, capacity, with_ids, vocabulary)
    rows = numbered(base, "key", "pieces", cut, schema)
    histogram = rows.groupBy("key").agg((F.max("number") + 1).alias("n")).collect()  # at most ``capacity`` rows
    counts = np.zeros(capacity + 1, np.int64)
    for r in histogram:
        counts[r.key] = r.n
    places = docs.sparkSession.sparkContext.broadcast(Places(plan_sequences(counts, capacity)))
    kept = [f for f in rows.schema.fields if f.name not in ("key", "number")]
    schema = T.StructType([*kept, T.StructField("sequence_id", T.LongType()),
                           T.StructField("offset", T.LongType())])

    def place(batches):
        for batch in batches:
            sequence, offset = places.value.of(batch.column("length").to_numpy(),
                                               batch.column("number").to_numpy())
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(f.name) for f in kept], pa.array(sequence), pa.array(offset)],
                names=schema.names)

    return rows.mapInArrow(place, schema)


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, packed into sequences of 4096 token ids."""
    return pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
