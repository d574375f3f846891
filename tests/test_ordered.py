"""Documents print in their own key order, with their own number texts."""

import json
from collections import OrderedDict

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from docweave.functions.ordered import arranged, double_text, flattened, json_text
from docweave.operators.reshape import add_field, flatten_doc, remove_field, rename_field, trim
from docweave.sources.envelope import parse_documents, to_envelope, with_documents

GOLDEN = [
    ('{"b": 1, "a": {"d": 2.0, "c": 100.0}}', '{"b":1,"a":{"d":2.0,"c":100.0}}'),
    ('{"m": [[2.0, 3], [[1e-4]]], "l": [{"z": 2.0, "y": 1E7}]}', '{"m":[[2.0,3],[[1.0E-4]]],"l":[{"z":2.0,"y":1.0E7}]}'),
    ('{"n": 123456789012345678901234567890123456789012345, "k": null}',
     '{"n":123456789012345678901234567890123456789012345,"k":null}'),
    ('{"x": 1, "y": 2, "x": 3}', '{"x":3,"y":2}'),
    ('{"t": "a\\"\\n\\u00e9", "e": {}, "f": [], "b": true}', '{"t":"a\\"\\n\u00e9","e":{},"f":[],"b":true}'),
    ("[1, 2]", "[1,2]"),
    ("{bad", None), (None, None),
    ('{"q":' * 300 + "2.0" + "}" * 300, '{"q":' * 300 + "2.0" + "}" * 300),
]


def test_printed_as_written(spark):
    docs = parse_documents(spark.createDataFrame([(i, t) for i, (t, _) in enumerate(GOLDEN)], "i int, map string"))
    assert docs.count() == len(GOLDEN)
    got = {r.i: r.text for r in docs.select("i", "doc", "map").transform(
        lambda d: to_envelope(d.withColumn("entity", F.col("i").cast("string")), doc="doc", order="map"))
        .select(F.col("entity").cast("int").alias("i"), F.col("map").alias("text")).collect()}
    assert got == {i: want for i, (_, want) in enumerate(GOLDEN)}


def test_operators_keep_the_order(spark):
    text = '{"s": 2.0, "r": {"z": [[1.0]], "y": 5}, "q": "v", "p": 7}'
    env = spark.createDataFrame([("e", text), ("e", "{bad")], "entity string, map string")

    def run(fn):
        out, dead = with_documents(env, fn, keep_order=True)
        assert dead.count() == 1
        return [r.map for r in out.collect()]

    # a moved object keeps its own order and numbers
    assert run(lambda d: rename_field(d, "r", "moved", doc="doc")) == \
        ['{"s":2.0,"q":"v","p":7,"moved":{"z":[[1.0]],"y":5}}']
    assert run(lambda d: remove_field(d, "q", doc="doc")) == ['{"s":2.0,"r":{"z":[[1.0]],"y":5},"p":7}']
    assert run(lambda d: add_field(d, "r.a", F.lit("n"), doc="doc")) == \
        ['{"s":2.0,"r":{"z":[[1.0]],"y":5,"a":"n"},"q":"v","p":7}']
    assert run(lambda d: trim(d, ["s", "r.y", "p"], "allows", doc="doc")) == ['{"s":2.0,"r":{"y":5},"p":7}']
    assert run(lambda d: flatten_doc(d, "_", doc="doc", order="map")) == \
        ['{"s":2.0,"r_z":[[1.0]],"r_y":5,"q":"v","p":7}']


def test_collisions_by_document_order(spark):
    rows = [(1, '{"a_b": 2, "c": 0, "a": {"b": 1}}'), (2, '{"a": {"b": 1}, "c": 0, "a_b": 2}'),
            (3, '{"a": {"b": {}, "c": {"d": [2.0]}}}'), (4, '{"a": {}}')]
    docs = parse_documents(spark.createDataFrame(rows, "i int, map string"))
    out = {r.i: r.map for r in flatten_doc(docs, "_", doc="doc", order="map").select("i", "map").collect()}
    assert out == {1: '{"a_b":1,"c":0}', 2: '{"a_b":2,"c":0}', 3: '{"a_c_d":[2.0]}', 4: "{}"}


def test_doubles_print_as_java():
    for x, want in [(2.0, "2.0"), (-0.0, "-0.0"), (1e7, "1.0E7"), (9999999.5, "9999999.5"), (1e-3, "0.001"),
                    (1.25e-4, "1.25E-4"), (-1.5e300, "-1.5E300"), (12345678.0, "1.2345678E7")]:
        assert double_text(x) == want


values = st.recursive(st.none() | st.booleans() | st.integers(-99, 99) | st.text("abé\"\n", max_size=3),
                      lambda kids: st.lists(kids, max_size=3) | st.dictionaries(st.text("pqr", max_size=2), kids, max_size=4),
                      max_leaves=12)


@settings(max_examples=200, deadline=None)
@given(st.dictionaries(st.text("pqr", max_size=2), values, max_size=4))
def test_arranged_matches_model(value):
    text = json.dumps(value)
    sorted_doc = json.loads(json.dumps(value, sort_keys=True))
    again = arranged(sorted_doc, json.loads(text))
    assert json_text(again) == json.dumps(value, ensure_ascii=False, separators=(",", ":"))
    # flatten: a linked map that is written to leaf by leaf
    model: OrderedDict = OrderedDict()

    def leaves(v, path):
        for k, x in v.items():
            if isinstance(x, dict):
                yield from leaves(x, [*path, k])
            else:
                yield "_".join([*path, k]), x
    for k, x in leaves(value, []):
        model[k] = x
    assert list(flattened(again, "_").items()) == list(model.items())
