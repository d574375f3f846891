"""User code as a SQL table function gives the rows of flat_map_docs."""

import os

import pytest
from pyspark.sql import functions as F

from docweave.operators.user import flat_map_docs, register_flat_map


@pytest.fixture(scope="module")
def rows(spark):
    return spark.createDataFrame([(1, 2, "a"), (2, 0, "b"), (3, None, None), (9007199254740993, 3, "é\n")],
                                 "id bigint, n int, s string").repartition(3)


def test_same_rows_as_flat_map(spark, rows):
    def _twice(rec):  # code of this file is unknown to the workers unless it is local
        for i in range(rec["n"] or 0):
            yield {"id": rec["id"], "i": i, "s": rec["s"]}

    want = sorted(map(tuple, flat_map_docs(rows, _twice, "id bigint, i int, s string").collect()), key=str)
    register_flat_map(spark, "twice", _twice, "id bigint, i int, s string")
    got = spark.sql("SELECT * FROM twice(TABLE(SELECT * FROM {r}))", r=rows).collect()
    assert sorted(map(tuple, got), key=str) == want
    got = spark.sql("SELECT t.* FROM {r} r, LATERAL twice(id => r.id, n => r.n, s => r.s) t", r=rows).collect()
    assert sorted(map(tuple, got), key=str) == want


def test_columns_of_the_input_and_documents(spark):
    docs = spark.createDataFrame([('{"k": {"l": [1, null]}, "z": null}',)], "t string") \
        .select(F.lit(5).alias("id"), F.parse_json("t").alias("doc"), F.struct(F.lit("x").alias("y")).alias("s"))
    register_flat_map(spark, "shown", lambda r: [{"text": repr(r["doc"]), "y": r["s"]["y"]}], "text string, y string")
    got = spark.sql("SELECT * FROM shown(TABLE(SELECT * FROM {d}))", d=docs).first()
    assert got.text == "{'k': {'l': [1, None]}, 'z': None}" and got.y == "x"
    register_flat_map(spark, "same", lambda r: [r, r])
    plain = docs.select("id", F.lit("q").alias("s"))
    out = spark.sql("SELECT * FROM same(TABLE(SELECT * FROM {d}))", d=plain)
    assert out.columns == ["id", "s"] and [tuple(r) for r in out.collect()] == [(5, "q")] * 2


def test_a_key_has_one_span_in_order(spark, tmp_path):
    folder = str(tmp_path)

    def cleanup(state):
        if state:
            open(os.path.join(folder, f"{state[0]}"), "a").write(f"{len(state)}\n")

    def step(rec, state):
        state.append(rec["k"])
        yield {"k": rec["k"], "v": rec["v"], "n": len(state)}

    register_flat_map(spark, "steps", step, "k bigint, v bigint, n bigint", prepare=list, cleanup=cleanup)
    data = spark.createDataFrame([(k, v) for k in range(5) for v in range(20 * (k + 1))], "k bigint, v bigint")
    out = spark.sql("SELECT * FROM steps(TABLE(SELECT * FROM {d}) PARTITION BY k ORDER BY v DESC)",
                    d=data.repartition(4)).collect()
    assert sorted((r.k, r.v, r.n) for r in out) == sorted(
        (k, v, 20 * (k + 1) - v) for k in range(5) for v in range(20 * (k + 1)))
    assert {k: open(os.path.join(folder, str(k))).read() for k in range(5)} == {
        k: f"{20 * (k + 1)}\n" for k in range(5)}


def test_failures_end_the_job_after_cleanup(spark, tmp_path):
    mark = str(tmp_path / "closed")

    def fail(rec, state):
        raise RuntimeError("user code refused")

    register_flat_map(spark, "fails", fail, "k bigint", prepare=list, cleanup=lambda s: open(mark, "w").close())
    with pytest.raises(Exception, match="user code refused"):
        spark.sql("SELECT * FROM fails(TABLE(SELECT 1 AS k))").collect()
    assert os.path.exists(mark)
    with pytest.raises(Exception, match="by name"):
        spark.sql("SELECT * FROM fails(1, 2)").collect()
    empty = spark.createDataFrame([], "k bigint")
    assert spark.sql("SELECT * FROM fails(TABLE(SELECT * FROM {e}))", e=empty).count() == 0


def test_many_keys_travel_in_batches(spark):
    # of 20,000 keys each row's output once was an Arrow batch of its own
    made = register_flat_map(spark, "numbered", lambda r, seen: [seen.append(1), {**r, "n": len(seen)}][1:],
                             "k bigint, n int", prepare=list)
    from pyspark.util import PythonEvalType
    assert made.evalType == PythonEvalType.SQL_TABLE_UDF
    data = spark.range(40_000).selectExpr("id % 20000 AS k")
    out = spark.sql("SELECT * FROM numbered(TABLE(SELECT * FROM {d}) PARTITION BY k)", d=data)
    assert out.agg(F.count("*"), F.sum("n"), F.countDistinct("k")).first()[:] == (40_000, 60_000, 20_000)


def test_emitted_values_are_fitted_to_their_columns(spark):
    import datetime
    import decimal
    kinds = ("s string, b string, d double, f float, i bigint, a array<double>, m map<string,string>, "
             "t struct<x: double, y: string>, z string, day date, c decimal(5,2), raw binary, at timestamp, ok boolean")
    at = datetime.datetime(2024, 1, 2, 3, 4, 5)

    def emit(rec):
        yield {"s": 5, "b": True, "d": 2, "f": 3, "i": 4.0, "a": [1, None], "m": {1: 2}, "t": {"x": 1, "y": 2},
               "day": at, "c": decimal.Decimal("1.50"), "raw": b"r", "at": at, "ok": False}

    register_flat_map(spark, "typed", emit, kinds)
    row = spark.sql("SELECT * FROM typed(TABLE(SELECT 1 AS k))").first()
    assert tuple(row) == ("5", "true", 2.0, 3.0, 4, [1.0, None], {"1": "2"}, (1.0, "2"), None, at.date(),
                          decimal.Decimal("1.50"), b"r", at, False)
    for value, kind in ((1.5, "bigint"), ("x", "bigint"), (1 << 31, "int"), ("x", "double"), (1, "boolean"),
                        ("x", "array<string>"), (1, "date"), (float("nan"), "int")):
        register_flat_map(spark, "wrong", lambda rec, value=value: [{"v": value}], f"v {kind}")
        with pytest.raises(Exception, match="is no"):
            spark.sql("SELECT * FROM wrong(TABLE(SELECT 1 AS k))").collect()
