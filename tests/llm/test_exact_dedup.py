"""Exact dedup against brute force."""

import hashlib
import random
import re

import pytest

from docweave.llm import exact_dedup as E
from docweave.llm.common import prepare


def brute(rows):
    groups = {}
    norm = [re.sub(r"[\x20\x09-\x0D]+", " ", t or "") for _, t in rows]
    for (d, _), n in zip(rows, norm):
        groups.setdefault(n, []).append(d)
    out = []
    for (d, _), n in zip(rows, norm):
        ids = sorted(groups[n], key=lambda x: (x is None, x))
        out.append((d, ids[0], len(ids), hashlib.sha256(n.encode()).hexdigest()))
    return sorted(out, key=str)


def rows():
    rng = random.Random(1)
    out = [(i, " ".join(rng.choice("abcdef") for _ in range(rng.randint(1, 5)))) for i in range(600)]
    out += [(1000 + i, "hot  text\n") for i in range(300)] + [(1400, "hot text "), (1401, " hot\ttext")]
    out += [(7, None), (8, ""), (9, " \x0b"), (10, "\x0c"), (None, "a b"), (None, "only here"), (None, "only here"),
            (2000, "same"), (2000, "same"), (2001, "long " * 400_000), (2002, "long  " * 400_000), (2003, "a b")]
    return out


@pytest.mark.parametrize("words", [2_000_000, 0])
def test_equals_brute_force(spark, words):
    prepare(spark)
    docs = spark.createDataFrame([(d, t, "x", False, 5) for d, t in rows()],
                                 "doc_id long, text string, Text string, kept boolean, tag int").repartition(5)
    out = E.mark_duplicates(docs, max_broadcast_words=words)
    assert out.columns == ["doc_id", "text", "Text", "tag", *E.RESULTS]
    out = out.toDF("doc_id", "text", "t2", "tag", *E.RESULTS).collect()
    assert sorted(((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in out), key=str) == brute(rows())
    kept = {}
    for r in out:
        if r.kept:
            assert r.doc_id == r.keep_id
        kept[r.text_sha256] = kept.get(r.text_sha256, 0) + r.kept
    assert set(kept.values()) == {1}


def test_drop_keeps_the_columns(spark):
    docs = spark.createDataFrame([(2, "a b", 1), (1, "a  b", 2), (3, "c", 3)], "doc_id long, text string, keep_id int")
    out = E.drop_duplicates(docs)
    assert out.columns == docs.columns
    assert sorted(map(tuple, out.collect())) == [(1, "a  b", 2), (3, "c", 3)]


def test_only_possible_repeats_pass_the_filter(spark):
    from pyspark.sql import functions as F
    hashes = spark.range(20_000).select(F.xxhash64("id").alias("h"))
    assert E.repeated_filter(hashes, 1 << 12).count() < 60
    twice = hashes.unionByName(hashes.limit(100))
    assert E.repeated_filter(twice, 1 << 12).count() > 90


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert E.mark_duplicates(docs).count() == 0 and E.drop_duplicates(docs).count() == 0


def test_no_python_in_the_plan(spark):
    docs = spark.createDataFrame(rows()[:50], "doc_id long, text string")
    assert "Python" not in E.mark_duplicates(docs)._jdf.queryExecution().toString()
