"""Every pipeline stage against brute force on its own input."""

import re

import numpy as np
import pytest

import corpus_pipeline as C
from docweave.llm import mixing
from docweave.llm.common import prepare

from .test_simhash_dedup import brute_components

SF001 = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """The tables before and after each stage, over the small documents and some odd rows."""
    prepare(spark)
    docs = spark.read.parquet(f"{SF001}/documents.parquet")
    first = docs.first()
    odd = [(9001, None, "en", "s", 0), (9002, "123", "en", "s", 3), (9003, first.text, "en", "s", 1),
           (9004, first.text.replace(" ", "  "), None, "s", 1), (9005, "", None, None, None),
           (9006, first.text + " more", "en", "s", 1)]
    docs = docs.unionByName(spark.createDataFrame(odd, docs.schema))
    tables, root = [docs], tmp_path_factory.mktemp("stages")
    for i, (_, stage) in enumerate(C.STAGES):
        stage(spark, tables[-1], SF001).write.parquet(f"{root}/{i}")
        tables.append(spark.read.parquet(f"{root}/{i}"))
    return [[r.asDict() for r in t.collect()] for t in tables]


def test_names_and_columns(stages):
    assert [n for n, _ in C.STAGES] == ["language ID", "exact dedup", "SimHash near-dedup",
                                        "mixing sources to target weights", "best-fit packing"]
    for rows in stages[:5]:
        assert set(rows[0]) == {"doc_id", "text", "lang", "source", "n_chars"}


def test_language_id_drops_only_texts_without_letters(stages):
    dropped = {r["doc_id"] for r in stages[0]} - {r["doc_id"] for r in stages[1]}
    assert dropped == {9001, 9002, 9005}


def test_language_id_keeps_letters_without_a_known_ngram(spark):
    prepare(spark)
    docs = spark.read.parquet(f"{SF001}/documents.parquet")
    odd = [(9101, "A.", "en", "s", 2), (9102, "b c d", None, "s", 5), (9103, "\u4dae\U00020b9f", "en", "s", 2),
           (9104, "\u0416", None, None, 1), (9105, "qzxj vxqk", "de", "s", 9),
           (9106, "4 5", "en", "s", 3), (9107, "?!", None, "s", 2)]
    docs = docs.unionByName(spark.createDataFrame(odd, docs.schema))
    kept = {r.doc_id for r in C.language_id(spark, docs, SF001).select("doc_id").collect()}
    assert {r.doc_id for r in docs.select("doc_id").collect()} - kept == {9106, 9107}


def test_exact_dedup(stages):
    low = {}
    for r in stages[1]:
        key = re.sub(r"[\x20\x09-\x0D]+", " ", r["text"])
        low[key] = min(low.get(key, r["doc_id"]), r["doc_id"])
    assert sorted(r["doc_id"] for r in stages[2]) == sorted(low.values())


def test_near_dedup(stages):
    rows = [(r["doc_id"], r["text"]) for r in stages[2]]
    assert sorted(r["doc_id"] for r in stages[3]) == sorted({c for _, _, c in brute_components(rows)})


def test_mixing_repeats_whole_rows(spark, stages):
    docs = spark.createDataFrame([tuple(r.values()) for r in stages[3]], list(stages[3][0]))
    labels = mixing.labelled_domains(spark.read.parquet(f"{SF001}/labels.parquet"))
    copies = {r.doc_id: r.copies for r in mixing.mix(docs, labels, mixing.TARGETS).collect()}
    seen = {}
    for r in stages[4]:
        seen[r["doc_id"]] = seen.get(r["doc_id"], 0) + 1
    assert seen == {d: c for d, c in copies.items() if c}
    text = {r["doc_id"]: r["text"] for r in stages[3]}
    assert all(text[r["doc_id"]] == r["text"] for r in stages[4])


def test_packing(stages):
    counted = {}
    for r in stages[5]:
        if r["piece"] == 0:
            counted[r["doc_id"]] = counted.get(r["doc_id"], 0) + 1
    want = {}
    for r in stages[4]:
        want[r["doc_id"]] = want.get(r["doc_id"], 0) + 1
    assert counted == want
    total = np.array([r["length"] for r in stages[5]]).sum()
    used = {r["sequence_id"] for r in stages[5]}
    assert len(used) <= -(-total // 4096) + 1


def test_run_and_query(spark, stages):
    from docweave.llm.catalog import QUERIES
    assert sum(k.startswith("op") for k in QUERIES) == 13
    assert C.run(spark, SF001).count() > 100


def test_empty_table(spark, tmp_path):
    docs = spark.read.parquet(f"{SF001}/documents.parquet").filter("false")
    for _, stage in C.STAGES:
        docs = stage(spark, docs, SF001)
        assert docs.count() == 0
