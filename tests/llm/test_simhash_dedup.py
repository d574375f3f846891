"""SimHash near-dedup against brute force."""

import numpy as np
import pytest
import xxhash

from docweave.llm import simhash_dedup as S
from docweave.llm.common import prepare


def brute_fp(text):
    words = (text or "").encode().lower().split()
    n = len(words)
    shingles = [b" ".join(words[i:i + 3]) for i in range(max(1, n - 2))] if n else []
    hs = [xxhash.xxh64_intdigest(s, seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def brute_components(rows):
    fps = [brute_fp(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for i in range(len(rows)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 2:
                root[find(i)] = find(j)
    out = {}
    for i, (d, _) in enumerate(rows):
        out.setdefault(find(i), []).append(d)
    low = {r: min((d for d in ds if d is not None), default=None) for r, ds in out.items()}
    return sorted(((d, fps[i], low[find(i)]) for i, (d, _) in enumerate(rows)), key=str)


def signed(x):
    return x - (1 << 64) if x >> 63 else x


@pytest.fixture(scope="module")
def ready(spark):
    prepare(spark)
    return spark


def test_golay_covers_with_radius_three():
    syndromes, patterns, excess = S.golay_tables(2)
    assert (np.sort(excess, axis=1)[:, 0] == 0).all()
    assert ((excess == 0).sum(axis=1) == 1).all()
    assert (excess <= 2).sum() == sum(len(list(S.combinations(range(23), w))) for w in range(6))


def test_links_within_two_bits_are_found(ready):
    rng = np.random.default_rng(1)
    base = rng.integers(0, 1 << 63, 300, dtype=np.int64)
    base[::2] ^= np.int64(-1)  # negative ones too
    fps = set(base.tolist())
    for x in base[:150].tolist():
        for _ in range(3):
            y = x
            for b in rng.choice(64, rng.integers(1, 4), replace=False).tolist():
                y ^= signed(1 << b)
            fps.add(signed(y & (1 << 64) - 1))
    fps = sorted(fps)
    df = ready.createDataFrame([(f,) for f in fps], "fp long")
    got = {r.fp: r.root for r in S.near_components(df).collect()}
    arr = np.array(fps)
    root = list(range(len(fps)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    near = np.bitwise_count((arr[:, None] ^ arr[None, :]).view(np.uint64)) <= 2
    for i, j in zip(*np.nonzero(np.triu(near, 1))):
        root[find(int(i))] = find(int(j))
    want = {}
    for i, f in enumerate(fps):
        want.setdefault(find(i), set()).add(f)
    have = {}
    for f in fps:
        have.setdefault(got.get(f, f), set()).add(f)
    assert sorted(map(sorted, want.values())) == sorted(map(sorted, have.values()))


def test_crowded_anchor_takes_the_second_way(ready, monkeypatch):
    rng = np.random.default_rng(2)
    center = 0x123456789ABCDEF
    fps = {center}
    while len(fps) < 3000:
        x = center
        for b in rng.choice(20, 5).tolist():
            x ^= 1 << b
        fps.add(x)
    df = ready.createDataFrame([(f,) for f in sorted(fps)], "fp long")
    roots = S.near_components(df).collect()
    assert len(roots) == len(fps) and len({r.root for r in roots}) == 1


def test_components_and_edge_cases(ready):
    words = [f"w{i}" for i in range(400)]
    rng = np.random.default_rng(3)
    rows = []
    for i in range(30):
        ws = rng.choice(words, 120).tolist()
        rows.append((i, " ".join(ws)))
        ws[5] = "changed"
        rows.append((100 + i, " ".join(ws)))
        rows.append((200 + i, " ".join(ws).upper()))
    rows += [(900, None), (901, ""), (902, " \n"), (903, "one"), (904, "One"), (905, "one two"),
             (None, "one two"), (906, "x " * 200_000), (907, "x " * 150_000), (907, "x " * 150_000),
             (None, "alone in the world of words")]
    docs = ready.createDataFrame([(d, t, "z", d, 1) for d, t in rows],
                                 "doc_id long, text string, TEXT string, fp long, tag int")
    got = S.simhash_components(docs).collect()
    assert sorted(((r.doc_id, r.fp & (1 << 64) - 1, r.component_id) for r in got), key=str) == brute_components(rows)
    kept = S.drop_near_duplicates(docs)
    assert kept.columns == docs.columns
    ids = [r[0] for r in kept.collect()]
    want = {c for _, _, c in brute_components(rows)}
    assert sorted(ids, key=str) == sorted(want, key=str)


def test_empty_table(ready):
    docs = ready.createDataFrame([], "doc_id long, text string")
    assert S.simhash_components(docs).count() == 0
    assert S.drop_near_duplicates(docs).count() == 0
