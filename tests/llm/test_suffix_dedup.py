"""Suffix-array dedup against brute force over all windows."""

import hashlib
import random

import numpy as np
import pytest

from docweave.llm import suffix_dedup as S
from docweave.llm.common import prepare


def brute(texts):
    w, seen = S.WINDOW, {}
    data = [(t or "").encode() for t in texts]
    for t in data:
        for i in range(len(t) - w + 1):
            seen[t[i:i + w]] = seen.get(t[i:i + w], 0) + 1
    out = []
    for t in data:
        gone = np.zeros(len(t), np.bool_)
        for i in range(len(t) - w + 1):
            if seen[t[i:i + w]] > 1:
                gone[i:i + w] = True
        edges = np.diff(np.concatenate([[0], gone.astype(np.int8)]))
        kept = bytes(np.frombuffer(t, np.uint8)[~gone])
        out.append((len(t), int(gone.sum()), int((edges == 1).sum()), hashlib.sha256(kept).hexdigest()))
    return out


def rows_of(spark, texts, **kw):
    prepare(spark)
    docs = spark.createDataFrame([(i, t, "s", 1) for i, t in enumerate(texts)],
                                 "doc_id long, text string, SPANS string, h1 int").repartition(3)
    out = S.remove_repeats(docs, **kw).collect()
    return [(r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in sorted(out, key=lambda r: r.doc_id)]


def make(seed):
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdeé") for _ in range(rng.randint(2, 9))) for _ in range(400)]
    fill = lambda n: " ".join(rng.choice(words) for _ in range(n))
    passages = [fill(60) for _ in range(6)]
    texts = []
    for _ in range(120):
        parts = []
        for _ in range(rng.randint(1, 4)):
            parts.append(fill(rng.randint(0, 50)))
            if rng.random() < 0.6:  # a piece of a passage, with borders of its own
                p = rng.choice(passages)
                a = rng.randint(0, 200)
                parts.append(p[a:a + rng.randint(150, 320)])
        texts.append("".join(parts))
    base = fill(300)
    for _ in range(12):  # near copies
        ws = base.split(" ")
        for _ in range(4):
            ws[rng.randrange(len(ws))] = rng.choice(words)
        texts.append(" ".join(ws))
    texts += [base, base, None, "", "x" * 199, "x" * 200, "ab" * 150, "y" * 1000, "\0" * 300 + "q" + "\0" * 250,
              fill(3000), "z" * 5 + fill(40)]
    return texts


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_brute_force(spark, seed):
    texts = make(seed)
    assert rows_of(spark, texts) == brute(texts)


def test_many_buckets_and_a_frequent_head(spark, monkeypatch):
    monkeypatch.setattr(S, "BUCKET", 7)
    rng = random.Random(3)
    line = "this line stands in a third of all texts, and is long enough to hold whole grams of an anchor or more. "
    noise = lambda n: "".join(rng.choice("abcdefghij ") for _ in range(n))
    texts = [noise(150) + line * rng.randint(1, 2) + noise(rng.randint(0, 200)) for _ in range(80)] + make(4)
    assert rows_of(spark, texts) == brute(texts)


def test_segments_do_not_matter(monkeypatch):
    rng = np.random.default_rng(0)
    data = rng.integers(97, 101, 6000).astype(np.uint8)
    data[1000:1700] = 97
    bounds = np.array([0, 10, 10, 900, 3100, 3299, 6000])
    want = S.anchors_of(data, bounds)
    monkeypatch.setattr(S, "SEGMENT", 150)
    got = S.anchors_of(data, bounds)
    for a, b in zip(want, got):
        assert (a == b).all()
    at, first, last, _, _ = want
    covered = np.zeros(6000, int)
    for p, a, b in zip(at, first, last):
        covered[a:b + 1] += 1
        assert (p >= b) and p - a < S.OFFSETS
    starts = [s for lo, hi in zip(bounds[:-1], bounds[1:]) for s in range(lo, hi - S.WINDOW + 1)]
    assert covered[starts].tolist() == [1] * len(starts) and covered.sum() == len(starts)


def test_multikey_order():
    rng = random.Random(0)
    strings = [bytes(rng.choice(b"\0ab") for _ in range(rng.randint(0, 40))) for _ in range(500)] + [b"", b"a", b"a\0"]
    order, common = S.sorted_prefixes(strings, 40)
    got = [strings[i] for i in order]
    assert got == sorted(strings)
    for i in range(1, len(got)):
        a, b = got[i - 1], got[i]
        n = next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
        assert common[i] == n


def test_kept_bytes_and_empty_table(spark):
    prepare(spark)
    docs = spark.createDataFrame([(1, "é" * 100 + "tail"), (2, "é" * 100), (None, "short")], "doc_id long, text string")
    out = {r.doc_id: bytes(r.kept) for r in S.remove_repeats(docs, with_bytes=True).collect()}
    assert out == {1: b"tail", 2: b"", None: b"short"}
    assert S.remove_repeats(spark.createDataFrame([], "doc_id long, text string")).count() == 0
