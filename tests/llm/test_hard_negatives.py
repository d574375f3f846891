"""Hard negatives against brute force on small and hostile tables."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from docweave.llm import hard_negatives as H
from docweave.llm.common import prepare

SCHEMA = "vec_id bigint, embedding array<float>, label int"


def brute(rows, step=5, positives=5, negatives=3):
    fine = {}
    for i, v, label in sorted((r for r in rows if None not in r), key=lambda r: (r[0], r[2])):
        if all(x is not None and math.isfinite(x) for x in v):
            fine.setdefault(i, (label, [math.floor(256 * float(np.float32(x))) for x in v]))

    def score(a, b):
        return sum(x * y for x, y in zip(a, b, strict=False))

    out = set()
    for a, (label, v) in fine.items():
        if a % step:
            continue
        scored = sorted((-score(v, w), i, other) for i, (other, w) in fine.items() if i != a)
        for s, p, _ in [x for x in scored if x[2] == label][:positives]:
            fit = [x for x in scored if x[2] != label and 50 * -s <= 100 * -x[0] <= 95 * -s][:negatives]
            out |= {(a, p, k + 1, n, -s, -t) for k, (t, n, _) in enumerate(fit)}
    return out


def mined(spark, rows, step=5):
    prepare(spark)
    df = spark.createDataFrame(rows, SCHEMA).repartition(4)
    return {tuple(r) for r in H.mine_hard_negatives(df, F.col("id") % step == 0).collect()}


def vectors(seed, n, width, labels=3, spread=0.5):
    rnd = random.Random(seed)
    centres = [[rnd.gauss(0, 0.1) for _ in range(width)] for _ in range(labels)]
    return [(i, [x + rnd.gauss(0, 0.1 * spread) for x in rnd.choice(centres)], rnd.randrange(labels)) for i in range(n)]


@pytest.mark.parametrize("seed,width", [(1, 8), (2, 40)])
def test_equals_brute_force(spark, seed, width):
    rows = vectors(seed, 120, width)
    assert mined(spark, rows) == brute(rows)


def test_edge_cases(spark):
    nan, inf = float("nan"), float("inf")
    rows = vectors(3, 60, 6) + [
        (None, [0.1] * 6, 1), (100, None, 1), (105, [0.1] * 6, None), (110, [0.1, None], 1),
        (115, [nan] * 6, 1), (120, [inf] * 6, 1), (125, [], 0), (130, [0.5, 0.5], 0), (135, [0.0] * 6, 2),
        (140, [-0.1] * 6, 2), (145, [0.2] * 9, 1)]
    rows += [(200 + i, [0.3] * 6, i % 2) for i in range(12)]  # ties
    rows += rows[:3]  # repeated rows count once
    got = mined(spark, rows)
    assert got == brute(rows) and got
    df = spark.createDataFrame(rows, SCHEMA)
    clash = df.select("*", F.lit(1).alias("id"), F.lit("x").alias("LABEL"), F.lit(2).alias("v"))
    assert {tuple(r) for r in H.mine_hard_negatives(clash, F.col("id") % 5 == 0).collect()} == got
    empty = H.mine_hard_negatives(df.limit(0), F.col("id") % 5 == 0)
    assert empty.count() == 0 and empty.columns[0] == "anchor_id"


def test_scores_beyond_doubles(spark):
    rows = [(i, [float(2 ** 20 + i), float(3 ** 14)], i % 2) for i in range(30)]
    assert mined(spark, rows) == brute(rows)


def test_blocks_of_anchors(spark, monkeypatch):
    rows = vectors(5, 100, 5)
    whole = mined(spark, rows, 2)
    monkeypatch.setattr(H, "BLOCK", 12)
    assert mined(spark, rows, 2) == whole == brute(rows, 2)


@pytest.mark.parametrize("seed", range(20))
def test_threshold_pairs_misses_nothing(seed):
    rng = np.random.default_rng(seed)
    width = int(rng.integers(1, 70))
    a = np.floor(rng.normal(size=(9, width)) * rng.choice([1, 20, 100], size=width))
    x = np.floor(rng.normal(size=(200, width)) * rng.choice([0, 1, 50], size=(200, 1)))
    least = rng.choice([-np.inf, -50.0, 0.0, 10.0, 2000.0, 1e9], size=9)
    i, j, score = H.threshold_pairs(a, x, least)
    want = a @ x.T
    expected = {(p, q, want[p, q]) for p, q in np.argwhere(want >= least[:, None]).tolist()}
    assert set(zip(i.tolist(), j.tolist(), score.tolist(), strict=True)) == expected
    assert len(i) == len(expected)
