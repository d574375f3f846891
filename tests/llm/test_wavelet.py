"""Wavelet-matrix files: queries against plain arrays, and an exact round trip."""

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from docweave.llm import wavelet as W
from docweave.llm.common import prepare
from docweave.llm.tokens import VOCABULARY, crc32


@pytest.mark.parametrize("n", [0, 1, 7, 1000, 100_003])
def test_queries(n):
    rng = np.random.default_rng(n)
    ids = np.minimum(49_407, rng.zipf(1.3, n)).astype(np.uint32) if n else np.zeros(0, np.uint32)
    docs = pa.RecordBatch.from_arrays([pa.array([5, None]), pa.array([n, 0])], names=["doc_id", "n_ids"])
    f = W.WaveletFile(W.build(ids, docs))
    assert (f.ids() == ids).all() and f.documents().column("doc_id").to_pylist() == [5, None]
    for i in rng.integers(0, n, 20).tolist() if n else []:
        assert f.access(i) == ids[i]
        v = int(ids[i])
        assert f.rank(v, i) == int((ids[:i] == v).sum()) and f.count(v) == int((ids == v).sum())
        where = np.flatnonzero(ids == v)
        k = int(rng.integers(0, len(where)))
        assert f.select(v, k) == where[k]
    assert f.count(49_407 if n < 2 else 60_000) in (0, int((ids == 49_407).sum()))
    with pytest.raises(IndexError):
        f.access(n)


def test_wide_ids():
    ids = np.array([1 << 19, 5, 1 << 19, 0], np.uint32)
    docs = pa.RecordBatch.from_arrays([pa.array([1]), pa.array([4])], names=["doc_id", "n_ids"])
    f = W.WaveletFile(W.build(ids, docs))
    assert f.ids().tolist() == ids.tolist() and f.select(1 << 19, 1) == 2


def test_round_trip(spark):
    prepare(spark)
    rng = np.random.default_rng(0)
    rows = [(int(i), " ".join(f"w{x}#" for x in rng.integers(0, 500, int(rng.integers(0, 300)))))
            for i in rng.permutation(400)]
    rows += [(None, "no id"), (7, None), (7, ""), (7, "#" * 100_000), (1000, "é# " * 60_000)]
    docs = spark.createDataFrame([(d, t, d, "t") for d, t in rows],
                                 "doc_id long, text string, start long, TEXT string").repartition(5)
    out = W.wavelet_round_trip(docs, shard_ids=5000).collect()
    tok = Tokenizer.from_file(VOCABULARY)
    want = {}
    for d, t in rows:
        ids = np.array([*tok.encode(t or "", add_special_tokens=False).ids, 2])
        want.setdefault(d, []).append((len(ids), crc32(ids)))
    got = {}
    for r in out:
        got.setdefault(r.doc_id, []).append((r.n_tokens, r.ids_crc32))
    assert {d: sorted(x) for d, x in got.items()} == {d: sorted(x) for d, x in want.items()}
    at, last = 0, -1
    for r in sorted(out, key=lambda r: r.start):
        assert r.start == at
        at += r.n_tokens
        now = -1 if r.doc_id is None else r.doc_id
        assert now >= last
        last = now


def test_empty_table(spark):
    assert W.wavelet_round_trip(spark.createDataFrame([], "doc_id long, text string")).count() == 0
