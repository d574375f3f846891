"""Language ID: n-grams by definition, filter properties, held-out accuracy."""

import zlib

import numpy as np
import pyarrow as pa

from docweave.llm import language_id as L
from docweave.llm.common import prepare, utf8_parts

SF01 = "/root/testdata/sf0.01"


def brute_grams(text):
    folded = bytes(b + 32 if 65 <= b < 91 else b if 97 <= b < 123 or b > 127 else 32 for b in text.encode())
    padded = b" " + folded + b" "
    return [int.from_bytes(padded[i:i + 4], "big") for i in range(len(padded) - 3) if b" " not in padded[i + 1:i + 3]]


def test_grams_by_definition():
    texts = ["Hello, wörld of x1y", "", "a", "of", None, "  the   END", "ok"]
    gram, row = L.grams_of(*utf8_parts(pa.array(texts)))
    for i, t in enumerate(texts):
        assert gram[row == i].tolist() == brute_grams(t or "")


def test_filter_returns_all_languages():
    rng = np.random.default_rng(0)
    members = [(f"l{i:02}", int(g)) for i in range(70) for g in rng.integers(0, 1 << 32, 400)]
    model = L.build_filter(members)
    masks = model.masks(np.array([g for _, g in members], np.uint64))
    for (lang, _), mask in zip(members, masks.T):
        i = model.languages.index(lang)
        assert int(mask[i // 64]) >> (i % 64) & 1
    absent = rng.integers(0, 1 << 32, 20_000).astype(np.uint64)
    hits = np.mean([(model.masks(absent)[i // 64] >> np.uint64(i % 64)) & np.uint64(1) for i in range(70)])
    assert abs(hits - model.false_rate.mean()) < 0.01


def test_held_out_accuracy(spark):
    prepare(spark)
    docs = spark.read.parquet(f"{SF01}/documents.parquet")
    out = L.predict_languages(docs).join(docs.select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in out if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in out)
    assert np.mean([r.lang == r.lang_pred for r in held]) > 0.97
    assert all(0 <= r.score <= 1 for r in out)


def test_lang_is_no_input_of_a_prediction(spark):
    prepare(spark)
    docs = spark.read.parquet(f"{SF01}/documents.parquet").limit(300)
    from pyspark.sql import functions as F
    a = {r.doc_id: r.lang_pred for r in L.predict_languages(docs).collect() if r.held_out}
    other = docs.withColumn("lang", F.when(L.held_out(F.col("doc_id")), F.lit("xx")).otherwise(F.col("lang")))
    assert a == {r.doc_id: r.lang_pred for r in L.predict_languages(other).collect() if r.held_out}


def test_edge_cases(spark):
    prepare(spark)
    base = spark.read.parquet(f"{SF01}/documents.parquet").select("doc_id", "text", "lang").limit(400)
    odd = [(90_001, None, "en"), (90_002, "", "en"), (90_003, "123 !!", None), (90_004, "ЖЖЩЪ " * 3, None),
           (None, "the and of that", None), (None, "the and of that", None), (90_006, "the and of " * 100_000, None)]
    docs = base.unionByName(spark.createDataFrame(odd, "doc_id long, text string, lang string"))
    docs = docs.selectExpr("doc_id", "text", "lang", "1 AS score", "'q' AS LANG", "'w' AS words")
    out = {r.doc_id: r for r in L.predict_languages(docs).collect() if r.doc_id is None or r.doc_id > 90_000}
    assert [out[i].lang_pred for i in (90_001, 90_002, 90_003)] == ["und"] * 3 and out[90_001].score == 0
    # letters, but no known n-gram: the usual language, with score 0
    assert out[90_004].lang_pred == "en" and out[90_004].score == 0
    assert out[None].lang_pred == "en" and out[90_006].lang_pred == "en" and not out[None].held_out
    kept = L.drop_unidentified(docs)
    assert kept.columns == docs.columns
    ids = [r[0] for r in kept.collect()]
    assert ids.count(None) == 2 and not {90_001, 90_002, 90_003} & set(ids) and 90_004 in ids and len(ids) >= 403


def test_nothing_to_learn_and_empty_table(spark):
    prepare(spark)
    docs = spark.createDataFrame([(1, "text", None)], "doc_id long, text string, lang string")
    assert [r.lang_pred for r in L.predict_languages(docs).collect()] == ["und"]
    empty = docs.filter("false")
    assert L.predict_languages(empty).count() == 0 and L.drop_unidentified(empty).count() == 0
