"""Mixing: words by definition, the fit against its optimality conditions, targets and copies."""

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from docweave.llm import mixing as M
from docweave.llm.common import prepare, utf8_parts

SF01 = "/root/testdata/sf0.01"


def test_words_by_definition():
    texts = ["Hello, wörld && x1\ty!", None, "", "a", "&&& hello HELLO", " . "]
    hashed, row = M.words_of(*utf8_parts(pa.array(texts)))
    split = re.compile(rb"[0-9a-z\x80-\xff]+|[^0-9a-z\x80-\xff\x00-\x20]+")
    words = [(i, w) for i, t in enumerate(texts) for w in split.findall((t or "").encode().lower())]
    assert row.tolist() == [i for i, _ in words]
    seen = {}
    for h, (_, w) in zip(hashed.tolist(), words):
        assert seen.setdefault(w, h) == h
    assert len(set(seen.values())) == len(seen)


def test_softmax_separates():
    rng = np.random.default_rng(0)
    y = rng.integers(0, 3, 900)
    x = np.column_stack([rng.normal(size=(900, 2)) + 3 * np.array([[0, 0], [1, 0], [0, 1]])[y], np.ones(900)])
    w = M.fit_softmax(x, y, 3)
    assert ((x @ w).argmax(axis=1) == y).mean() > 0.9


def test_rates_meet_the_optimality_conditions(spark):
    prepare(spark)
    rng = np.random.default_rng(1)
    p = rng.dirichlet([1, 0.5, 0.2], 3000)
    t = rng.integers(1, 900, 3000)
    table = spark.createDataFrame([(int(n), [float(x) for x in row]) for n, row in zip(t, p)],
                                  "tokens long, p array<double>").repartition(6).cache()
    goal = np.array([0.6, 0.3, 0.1])
    rates = M.fit_rates(table, goal)
    r = rates.of(p)
    n = t.sum()
    shares = (r * t) @ p / n
    assert np.abs(shares - goal).max() < 3e-3 and (r >= 0).all()
    # gradient zero where the rate is positive, not negative where it is zero
    gradient = p @ (shares - goal) + M.RIDGE * (r - 1)
    assert np.abs(gradient[r > 1e-6]).max() < 3e-3 and gradient[r <= 1e-6].min(initial=0) > -3e-3


def test_corpus(spark):
    prepare(spark)
    docs = spark.read.parquet(f"{SF01}/documents.parquet")
    labels = M.labelled_domains(spark.read.parquet(f"{SF01}/labels.parquet"))
    targets = {"good": 0.8, "poor": 0.2}
    out = M.mix(docs, labels, targets).cache()
    n, good, poor, copied = out.agg(
        F.sum("tokens"), F.expr("sum(rate * tokens * posteriors['good'])"),
        F.expr("sum(rate * tokens * posteriors['poor'])"), F.expr("sum(copies * tokens)")).first()
    assert abs(good / n - 0.8) < 0.05 and abs(poor / n - 0.2) < 0.05 and abs(copied / n - 1) < 0.2
    copies = {r.doc_id: r.copies for r in out.collect()}
    assert all(abs(r.copies - r.rate) < 1 for r in out.collect())
    rows = M.mixed_corpus(docs.withColumn("p", F.lit(1)), labels, targets)
    assert rows.columns == [*docs.columns, "p"]
    seen = {r.doc_id: r["count"] for r in rows.groupBy("doc_id").count().collect()}
    assert seen == {d: c for d, c in copies.items() if c}


def test_edge_cases(spark):
    prepare(spark)
    docs = spark.createDataFrame([(1, "good words here", "a"), (2, None, "b"), (2, None, "b"), (None, "", "c"),
                                  (4, "bad words here " * 60_000, "d")], "doc_id long, text string, TOKENS string")
    labels = spark.createDataFrame([(1, "good"), (4, "bad"), (4, "worse"), (None, "good"), (9, None)],
                                   "id long, domain string")
    out = M.mix(docs, labels, {"good": 1.0}).collect()
    assert len(out) == 5 and all(r.rate >= 0 for r in out)
    assert sorted(r.tokens for r in out) == [0, 0, 0, 3, 180_000]
    none = labels.filter("false")
    assert [r.copies for r in M.mix(docs, none, {"good": 1.0}).collect()] == [1] * 5
    assert M.mixed_corpus(docs, none, {"good": 1.0}).count() == 5
    empty = docs.filter("false")
    assert M.mix(empty, labels, {"good": 1.0}).count() == 0 and M.mixed_corpus(empty, labels, {"good": 1.0}).count() == 0
