"""Packing: the plan uses every length exactly, near the bound; the query's law holds."""

import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from docweave.llm import packing as P
from docweave.llm.common import prepare
from docweave.llm.tokens import VOCABULARY


def check_plan(counts, capacity, plan):
    used = np.zeros(capacity + 1, np.int64)
    for lengths, often in plan:
        assert sum(lengths) <= capacity and often > 0
        for x in lengths:
            used[x] += often
    assert (used == counts).all()
    return sum(often for _, often in plan)


def optimum(sizes, capacity):
    """Brute force for few pieces."""
    best = [len(sizes)]
    sizes = sorted(sizes, reverse=True)

    def go(i, rooms):
        if len(rooms) >= best[0]:
            return
        if i == len(sizes):
            best[0] = len(rooms)
            return
        for r in sorted(set(rooms)):
            if r >= sizes[i]:
                rest = list(rooms)
                rest.remove(r)
                go(i + 1, [*rest, r - sizes[i]])
        go(i + 1, [*rooms, capacity - sizes[i]])
    go(0, [])
    return best[0]


@pytest.mark.parametrize("seed", range(25))
def test_small_plans_are_optimal(seed):
    rng = np.random.default_rng(seed)
    sizes = rng.integers(1, 60, 11)
    counts = np.bincount(sizes, minlength=101)
    n = check_plan(counts, 100, P.plan_sequences(counts, 100))
    assert n == optimum(sizes.tolist(), 100)


def test_pairs_that_the_largest_would_spoil():
    sizes = [78, 73, 68, 54, 29, 22, 17, 16, 15, 12, 10, 6]  # 78+16+6, 73+15+12, 68+22+10, 54+29+17
    counts = np.bincount(sizes, minlength=101)
    assert check_plan(counts, 100, P.plan_sequences(counts, 100)) == 4


def test_full_sequences_are_found_again():
    rng = np.random.default_rng(17)
    for _ in range(4000):
        sizes = []
        n = int(rng.integers(2, 5))
        for _ in range(n):
            cuts = np.sort(rng.choice(np.arange(1, 100), int(rng.integers(1, 4)), replace=False))
            sizes += np.diff([0, *cuts, 100]).tolist()
        counts = np.bincount(sizes, minlength=101)
        assert check_plan(counts, 100, P.plan_sequences(counts, 100)) == n


def test_repeated_lengths_are_optimal():
    rng = np.random.default_rng(18)
    for _ in range(300):
        sizes = np.repeat(rng.integers(8, 60, 4), rng.integers(1, 4, 4))[:11]
        counts = np.bincount(sizes, minlength=101)
        assert check_plan(counts, 100, P.plan_sequences(counts, 100)) == optimum(sizes.tolist(), 100)


def test_undominated_fillings_against_brute_force():
    from itertools import combinations

    def dominated(items, others, room):
        waste = room - sum(items)
        subsets = {sum(c): len(c) for k in range(len(items) + 1) for c in combinations(items, k)}
        return any(t <= x <= t + waste and not (k == 1 and x == t) for t, k in subsets.items() for x in others)

    rng = np.random.default_rng(19)
    for _ in range(200):
        sizes = rng.integers(1, 20, 8).tolist()
        counts, room = np.bincount(sizes, minlength=41), int(rng.integers(5, 40))
        every = {tuple(sorted(c, reverse=True)) for k in range(9) for c in combinations(sizes, k) if sum(c) <= room}
        want = set()
        for items in every:
            others = list(sizes)
            for x in items:
                others.remove(x)
            if not dominated(items, others, room):
                want.add(items)
        got = list(P.undominated_fillings(counts, room, room, [10**6]))
        assert len(got) == len(set(got)) and set(got) == want
        assert [room - sum(x) for x in got] == sorted(room - sum(x) for x in got)


def test_branch_and_bound_beats_best_fit():
    better = 0
    for seed in range(60):
        rng = np.random.default_rng(seed)
        counts = np.bincount(rng.integers(20, 70, 40), minlength=101)
        fit = check_plan(counts, 100, P.best_fit(counts, 100))
        n = check_plan(counts, 100, P.plan_sequences(counts, 100, nodes=2000))
        assert P.lower_bound(counts, 100) <= n <= fit
        better += n < fit
    assert better


def test_large_plan_is_near_the_bound():
    rng = np.random.default_rng(5)
    lengths = np.minimum(4096, rng.lognormal(6.3, 0.9, 100_000).astype(int) + 1)
    counts = np.bincount(lengths, minlength=4097)
    n = check_plan(counts, 4096, P.plan_sequences(counts, 4096))
    assert n <= P.lower_bound(counts, 4096) + 2


def test_query_law(spark):
    prepare(spark)
    rows = [(1, "Hello, world. 'tis"), (2, None), (3, ""), (3, ""), (None, "x " * 9000), (5, "e" * 5000), (5, "a b c")]
    rows += [(10 + i, "word " * (i * 7 % 900)) for i in range(300)]
    docs = spark.createDataFrame([(d, t, "k", 7) for d, t in rows], "doc_id long, text string, KEY string, number long")
    out = P.pack_documents(docs, with_ids=True).collect()
    tok = Tokenizer.from_file(VOCABULARY)
    want = []
    for d, t in rows:
        ids = [*tok.encode(t or "", add_special_tokens=False).ids, 1]
        for k in range(0, len(ids), 4096):
            part = np.array(ids[k:k + 4096], "<u4").tobytes()
            want.append((d, k // 4096, k, len(part) // 4, zlib.crc32(part), part))
    got = [(r.doc_id, r.piece, r.start, r.length, r.ids_crc32, bytes(r.ids)) for r in out]
    assert sorted(got, key=str) == sorted(want, key=str)
    by = {}
    for r in out:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for spans in by.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= 4096
    total = sum(r.length for r in out)
    assert len(by) <= -(-total // 4096) + 1


def test_empty_table(spark):
    prepare(spark)
    assert P.pack_documents(spark.createDataFrame([], "doc_id long, text string")).count() == 0
