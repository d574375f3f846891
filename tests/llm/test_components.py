"""Connected components of chains, stars and random graphs."""

import random

import pytest

from docweave.llm import components as C


def brute(pairs):
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a, b in pairs:
        low, high = sorted((find(a), find(b)))
        root[high] = low
    return {frozenset(x for x in root if find(x) == r) for r in {find(x) for x in root}}


def found(spark, pairs):
    out = C.connected_components(spark.createDataFrame(pairs, "a long, b long")).collect()
    assert len({r.node for r in out}) == len(out)
    groups = {}
    for r in out:
        groups.setdefault(r.root, set()).add(r.node)
    assert all(root in group for root, group in groups.items())
    return {frozenset(g) for g in groups.values()}


def test_a_long_chain_ends_in_few_rounds(spark, monkeypatch):
    written = []
    plain = C.materialise
    monkeypatch.setattr(C, "materialise", lambda df, name: written.append(name) or plain(df, name))
    chain = [(i, i + 1) for i in range(1000)]
    assert found(spark, chain) == {frozenset(range(1001))}
    assert written.count("edges") == 2 and written.count("hooks") <= 12


@pytest.mark.parametrize("seed", [0, 1])
def test_random_graphs(spark, seed):
    rnd = random.Random(seed)
    names = rnd.sample(range(10_000), 300)
    chain = list(zip(names[:150], names[1:150], strict=False))
    loose = [(rnd.choice(names[150:]), rnd.choice(names[150:])) for _ in range(110)]
    pairs = chain + [(b, a) for a, b in loose] + loose[:20]
    assert found(spark, pairs) == {g for g in brute([p for p in pairs if p[0] != p[1]]) if len(g) > 1}


def test_star_and_empty(spark):
    assert found(spark, [(7, i) for i in range(100, 400)] + [(3, 3)]) == {frozenset([7, *range(100, 400)])}
    assert C.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0
