"""Typed documents with a presence column against the same documents as VARIANT."""

import json

import pytest
from pyspark.sql import functions as F

from docweave.functions.documents import as_documents, typed_from_documents
from docweave.functions.paths import has_field
from docweave.functions.presence import presence_of
from docweave.operators import reshape as R
from docweave.sources.envelope import parse_documents, to_envelope

SCHEMA = "id bigint, a struct<b: struct<c: bigint, d: string>, e: array<variant>>, x string, y double"
TEXTS = ['{"id":1}', '{"id":2,"a":null,"x":null}', '{"id":3,"a":{},"y":2.5}', '{"id":4,"a":{"b":null,"e":null}}',
         '{"id":5,"a":{"b":{"c":null},"e":[{"k":null},1,{}]},"x":"t"}', '{"id":6,"a":{"b":{"c":7,"d":"s"}},"y":null}',
         '{"id":7,"a":{"b":{}},"x":""}', '{"id":null}', "{}"]
PATHS = ["id", "a", "a.b", "a.b.c", "a.b.d", "a.e", "x", "y"]


@pytest.fixture(scope="module")
def both(spark):
    docs = parse_documents(spark.createDataFrame([("e", t) for t in TEXTS], "entity string, map string")).drop("map")
    return docs, typed_from_documents(docs, schema=SCHEMA, presence=True)


def _texts(df, doc="doc"):
    return sorted(json.dumps(json.loads(r[0]), sort_keys=True) for r in df.select(F.to_json(doc)).collect())


def test_presence_equals_variant(both):
    docs, typed = both
    want = docs.select(*[has_field(docs, p, "doc").alias(p) for p in PATHS]).collect()
    assert typed.select(*[has_field(typed, p).alias(p) for p in PATHS]).collect() == want
    assert typed.select(has_field(typed, "no.such")).distinct().collect()[0][0] is False


def test_documents_and_envelopes_come_back_as_they_were(both):
    docs, typed = both
    assert _texts(as_documents(typed)) == sorted(json.dumps(json.loads(t), sort_keys=True) for t in TEXTS)
    a = sorted(map(tuple, to_envelope(typed).collect()))
    assert a == sorted(map(tuple, to_envelope(docs, doc="doc").collect()))


@pytest.mark.parametrize("edit", [
    lambda df, **k: R.add_field(df, "z", F.lit(1).cast("bigint"), **k),
    lambda df, **k: R.add_field(df, "x", F.lit(None).cast("string"), **k),
    lambda df, **k: R.add_field(df, "a.b.c", F.lit(3).cast("bigint"), **k),
    lambda df, **k: R.add_field(df, "a.b", F.struct(F.lit("q").alias("d"), F.lit(None).cast("string").alias("n")), **k),
    lambda df, **k: R.add_field(df, "n.m", F.lit("v"), **k),
    lambda df, **k: R.remove_field(df, "a.b.c", **k),
    lambda df, **k: R.remove_field(df, "a.b", **k),
    lambda df, **k: R.remove_field(df, "y", **k),
    lambda df, **k: R.remove_field(R.remove_field(df, "a.b.c", **k), "a.b.d", **k),
    lambda df, **k: R.rename_field(df, "x", "w", **k),
    lambda df, **k: R.rename_field(df, "x", "y", **k),
    lambda df, **k: R.rename_field(df, "a.b", "q", **k),
    lambda df, **k: R.rename_field(df, "x", "a.b.c", **k),
    lambda df, **k: R.rename_field(df, "nowhere", "a.new", **k),
    lambda df, **k: R.add_field(R.rename_field(R.remove_field(df, "a.e", **k), "a", "g.h", **k), "a.b.c",
                                F.lit(None).cast("bigint"), **k),
])
def test_edits_equal_variant(both, edit):
    docs, typed = both
    assert _texts(as_documents(edit(typed))) == _texts(edit(docs, doc="doc"))


def test_skip_null_keeps_the_bits(spark, both):
    docs, typed = both
    value = F.when(F.col("id") > 3, F.lit("new"))
    got = R.add_field(typed, "x", value, skip_null=True)
    rows = {r.id: (r.x, r.there) for r in got.select("id", "x", has_field(got, "x").alias("there")).collect() if r.id}
    assert rows == {1: (None, False), 2: (None, True), 3: (None, False), **{i: ("new", True) for i in (4, 5, 6, 7)}}


def test_many_fields_take_several_words_and_survive_parquet(spark, tmp_path):
    names = [f"f{i}" for i in range(150)]
    rows = [json.dumps({n: None for i, n in enumerate(names) if i % (k + 2) == 0}) for k in range(5)]
    docs = spark.createDataFrame([(r,) for r in rows], "t string").select(F.parse_json("t").alias("doc"))
    typed = typed_from_documents(docs, schema=", ".join(f"{n} int" for n in names), presence=True)
    typed.write.parquet(str(tmp_path / "t"))
    back = spark.read.parquet(str(tmp_path / "t"))
    assert len(presence_of(back).paths) == 150
    assert _texts(as_documents(back)) == _texts(docs)


def test_whole_document_operators_refuse(both):
    _, typed = both
    for call in (lambda: R.flatten_doc(typed), lambda: R.trim(typed, ["x"]), lambda: R.prune_empty(typed)):
        with pytest.raises(ValueError, match="presence"):
            call()


def test_empty_table(spark):
    docs = spark.createDataFrame([], "t string").select(F.parse_json("t").alias("doc"))
    assert as_documents(typed_from_documents(docs, schema=SCHEMA, presence=True)).count() == 0
