"""Sharding: groups stay whole, shards are near equal, slots are gapless."""

import zlib

import numpy as np

from docweave.llm import sharding as S
from docweave.llm.common import prepare


def final_bins(sizes, n_bins):
    final, merged = S.difference([[(s, i)] for i, s in enumerate(sizes)], n_bins)
    place = {name: at for at, (_, name) in enumerate(final)}
    bins = [place[S._root(i, merged)] for i in range(len(sizes))]
    sums = np.bincount(bins, sizes, minlength=n_bins)
    assert [s for s, _ in final] == sums[:len(final)].tolist()
    return sums


def test_differencing_on_known_numbers():
    # two-way differencing of 8,7,6,5,4 leaves a difference of 2
    assert sorted(final_bins([8, 7, 6, 5, 4], 2).tolist()) == [14, 16]


def test_spread_is_far_below_an_item():
    rng = np.random.default_rng(0)
    sizes = rng.lognormal(7, 1, 5000).astype(int).tolist()
    sums = final_bins(sizes, 40)
    assert sums.max() - sums.min() <= min(sizes) + 2


def test_laws_and_edge_cases(spark):
    prepare(spark)
    rng = np.random.default_rng(1)
    rows = [(i, "y" * int(n)) for i, n in enumerate(rng.lognormal(6, 1, 2000))]
    rows += [(5000 + i, "hot text") for i in range(300)] + [(1, None), (1, None), (None, ""), (7, "é" * 40_000)]
    docs = spark.createDataFrame([(d, t, 1, "s") for d, t in rows],
                                 "doc_id long, text string, size int, KEY string").repartition(7)
    out = S.shard_documents(docs, n_shards=10).collect()
    want = sorted(((d, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for d, t in rows), key=str)
    assert sorted(((r.doc_id, r["size"], r.text_crc32) for r in out), key=str) == want
    by_text, sums, slots = {}, {}, {}
    for r in out:
        by_text.setdefault(r.text_crc32, set()).add(r.shard)
        sums[r.shard] = sums.get(r.shard, 0) + r["size"]
        slots.setdefault(r.shard, []).append(r.slot)
        assert r.law == "bytes" and r.grown_shard is None and 0 <= r.shard < 10
    assert all(len(s) == 1 for s in by_text.values())
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    mean = sum(sums.values()) / 10
    assert max(sums.values()) <= max(mean * 1.01, 80_016 + 16)


def test_levels_above_the_tasks(spark):
    rng = np.random.default_rng(2)
    groups = spark.createDataFrame([(int(i).to_bytes(8, "big"), int(s)) for i, s in enumerate(rng.integers(1, 10_000, 3000))],
                                   "key binary, bytes long").repartition(23)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    out = S.partition_groups(groups, 8, fan_in=4).join(groups, "key").groupBy("bin").sum("bytes").collect()
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    sums = [r[1] for r in out]
    assert len(sums) == 8 and max(sums) - min(sums) < 100


def test_empty_table(spark):
    assert S.shard_documents(spark.createDataFrame([], "doc_id long, text string")).count() == 0
