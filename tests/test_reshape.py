"""Rename, flatten, trim, add/remove: golden rows in VARIANT and typed mode."""

import json

import pytest
from pyspark.sql import functions as F

from docweave.operators import reshape as R
from docweave.sources.envelope import parse_documents


def _json(df, doc="doc"):
    return json.loads(df.select(F.to_json(doc)).first()[0])


def _docs(spark, *texts):
    return parse_documents(spark.createDataFrame([("e", t) for t in texts],
                                                 "entity string, map string"))


def test_flatten_variant(spark):
    df = _docs(spark, '{"a":{"b":{"c":1},"d":2},"x":null,"e":{},"l":[{"z":1}]}')
    assert _json(R.flatten_doc(df, "_", doc="doc")) == {"a_b_c": 1, "a_d": 2, "x": None,
                                                        "l": [{"z": 1}]}
    df2 = _docs(spark, '{"a":{"b":1},"a_b":2}')
    assert _json(R.flatten_doc(df2, "_", doc="doc")) == {"a_b": 2}


def test_flatten_idempotent_and_depth(spark):
    df = _docs(spark, '{"a":{"b":{"c":{"d":{"e":1}}}},"k":[1,2]}')
    once = R.flatten_doc(df, "-", doc="doc")
    twice = R.flatten_doc(once, "-", doc="doc")
    assert _json(once) == _json(twice) == {"a-b-c-d-e": 1, "k": [1, 2]}
    with pytest.raises(Exception):
        R.flatten_doc(df, "_", doc="doc", max_depth=2).collect()


def test_flatten_separator_rule(spark):
    df = _docs(spark, "{}")
    for bad in (".", "__", ""):
        with pytest.raises(ValueError):
            R.flatten_doc(df, bad, doc="doc")


def test_flatten_typed(typed_d):
    out = R.flatten_doc(typed_d, "_")
    assert out.columns == ["s", "n", "f", "b", "z", "o_x_y", "a", "t"]
    assert out.first()["o_x_y"] == "q"


def test_trim_variant(doc_d):
    assert _json(R.trim(doc_d, ["o.x.y"], doc="doc")) == {"o": {"x": {"y": "q"}}}
    assert _json(R.trim(doc_d, ["o"], doc="doc")) == {}
    deleted = _json(R.trim(doc_d, ["o.x.y"], "delete", doc="doc"))
    assert "o" not in deleted and deleted["s"] == "5" and deleted["z"] is None


def test_trim_typed(typed_d):
    assert R.trim(typed_d, ["o.x.y", "s"]).columns == ["s", "o"]
    assert R.trim(typed_d, ["o"]).columns == []
    assert "o" not in R.trim(typed_d, ["o.x.y"], "delete").columns


def test_trim_allows_delete_disjoint(doc_d):
    fields = ["s", "o.x.y", "a"]
    kept = R.flatten_doc(R.trim(doc_d, fields, doc="doc"), "_", doc="doc")
    gone = R.flatten_doc(R.trim(doc_d, fields, "delete", doc="doc"), "_", doc="doc")
    assert not set(_json(kept)) & set(_json(gone))


def test_rename(doc_d, typed_d):
    out = _json(R.rename_field(doc_d, "s", "k.m", doc="doc"))
    assert "s" not in out and out["k"] == {"m": "5"}
    out = _json(R.rename_field(doc_d, "missing", "k", doc="doc"))
    assert out["k"] is None
    t = R.rename_field(typed_d, "s", "k.m")
    assert "s" not in t.columns and t.select("k.m").first()[0] == "5"
    t = R.rename_field(typed_d, "o.x.y", "top")
    assert t.first()["top"] == "q"


def test_add_remove(doc_d, typed_d):
    out = _json(R.add_field(doc_d, "o.x.w", F.lit(7), doc="doc"))
    assert out["o"]["x"] == {"w": 7, "y": "q"}
    out = _json(R.add_field(doc_d, "new.deep.key", F.lit("v"), doc="doc"))
    assert out["new"] == {"deep": {"key": "v"}}
    out = _json(R.remove_field(doc_d, "o.x.y", doc="doc"))
    assert out["o"] == {"x": {}, "e": {}}
    t = R.add_field(typed_d, "o.x.w", F.lit(1))
    assert t.select("o.x.w", "o.x.y").first() == (1, "q")
    t = R.remove_field(typed_d, "o.x.y")
    assert t.select(F.to_json("o")).first()[0] == '{"x":{}}'


def test_typed_and_variant_agree(spark):
    text = '{"a":{"b":1,"c":{"d":"x"}},"e":2}'
    v = _docs(spark, text)
    t = spark.createDataFrame([((1, ("x",)), 2)], "a struct<b:bigint, c:struct<d:string>>, e bigint")
    vf = _json(R.flatten_doc(v, "_", doc="doc"))
    tf = R.flatten_doc(t, "_").first().asDict()
    assert vf == tf


def test_remove_also_literal(spark):
    df = _docs(spark, '{"a.b":1,"a":{"b":2,"c":3}}')
    assert _json(R.remove_field(df, "a.b", doc="doc")) == {"a.b": 1, "a": {"c": 3}}
    assert _json(R.remove_field(df, "a.b", doc="doc", also_literal=True)) == {"a": {"c": 3}}
    t = spark.createDataFrame([(1, (2, 3))], "`a.b` int, a struct<b:int,c:int>")
    assert R.remove_field(t, "a.b", also_literal=True).columns == ["a"]


def test_read_kafka_message(spark):
    from docweave.sources.envelope import read_kafka
    with pytest.raises(RuntimeError, match="Kafka connector"):
        read_kafka(spark, stream=False, subscribe="t", **{"kafka.bootstrap.servers": "x:1"})


def test_has_field_get_field_set_doc_keep_raw(doc_d, typed_d):
    from docweave.functions.paths import get_field, has_field
    row = doc_d.select(has_field(doc_d, "z", "doc").alias("z"),       # JSON null is present
                       has_field(doc_d, "missing", "doc").alias("m"),
                       has_field(doc_d, "o.x.y", "doc").alias("oxy"),
                       get_field(doc_d, "n", "doc", "int").alias("n"), "map").first()
    assert (row.z, row.m, row.oxy, row.n) == (True, False, True, 5)
    assert row.map.startswith('{"s":"5"')  # raw text kept next to the parsed document
    assert typed_d.select(has_field(typed_d, "no.such")).first()[0] is False
    replaced = R.set_doc(doc_d, F.parse_json(F.lit('{"k":1}')))
    assert _json(replaced) == {"k": 1}


def test_entity_override_on_components(doc_d):
    from docweave.functions.predicates import Cond
    from docweave.operators.filter import filter_docs
    from docweave.operators.enrich import short_code
    outs = [filter_docs(doc_d, [Cond("s", "==", "5")], doc="doc", entity="kept"),
            R.rename_field(doc_d, "s", "k", doc="doc", entity="kept"),
            R.flatten_doc(doc_d, "_", doc="doc", entity="kept"),
            R.trim(doc_d, ["s"], doc="doc", entity="kept"),
            short_code(doc_d, "s", "code", doc="doc", entity="kept")]
    assert [o.select("entity").first()[0] for o in outs] == ["kept"] * 5
    assert R.rename_field(doc_d, "s", "k", doc="doc").select("entity").first()[0] == "e"


def test_documents_round_trip(spark):
    from docweave.functions.documents import as_documents, struct_ddl, typed_from_documents
    df = spark.createDataFrame([("e", 1, ("x", 2.5)), ("e", 2, None)],
                               "entity string, id bigint, o struct<s:string, f:double>")
    docs = as_documents(df)
    assert docs.columns == ["entity", "doc"]
    back = typed_from_documents(docs)
    as_dicts = lambda d: sorted((r.asDict(recursive=True) for r in d.collect()), key=lambda x: x["id"])
    assert as_dicts(back) == as_dicts(df)  # VARIANT keeps object keys sorted: compare by name
    assert struct_ddl("OBJECT<a: DECIMAL(2,1), b: VOID>") == "STRUCT<`a`: DOUBLE, `b`: VARIANT>"
    # names are left alone, whatever they spell; integers beyond 64 bits stay exact
    assert struct_ddl("OBJECT<VOID: BIGINT, `a>VOID``x`: OBJECT<OBJECT: VOID>, big: DECIMAL(20,0)>") == (
        "STRUCT<`VOID`: BIGINT, `a>VOID``x`: STRUCT<`OBJECT`: VARIANT>, `big`: DECIMAL(20,0)>")
    sampled = typed_from_documents(docs, sample_fraction=1.0)
    assert sampled.count() == 2


def _deep(n, leaf, name="k"):
    out = leaf
    for i in reversed(range(n)):
        out = {f"{name}{i}": out}
    return out


def test_any_depth(spark):
    """No cap: deep leaves are kept or dropped as listed, and mixed kinds at a path do no harm."""
    docs = [_deep(12, 1), {"k0": "text"}, {"k0": {"k1": None, "e": _deep(10, {})}, "l": [{"x": {"y": {}}}]}]
    df = _docs(spark, *map(json.dumps, docs))
    deep = ".".join(f"k{i}" for i in range(12))

    def out(d):
        return sorted((json.loads(r[0]) for r in d.select(F.to_json("doc")).collect()), key=str)

    assert out(R.trim(df, [deep, "z"], "allows", doc="doc")) == sorted([docs[0], {}, {}], key=str)
    left = {"k0": {"k1": None}, "l": [{"x": {"y": {}}}]}
    assert out(R.trim(df, [deep], "delete", doc="doc")) == sorted([{}, docs[1], left], key=str)
    assert out(R.prune_empty(df, doc="doc")) == sorted([docs[0], docs[1], left], key=str)
    assert out(R.flatten_doc(df, "_", doc="doc")) == sorted(
        [{deep.replace(".", "_"): 1}, docs[1], {"k0_k1": None, "l": [{"x": {"y": {}}}]}], key=str)


def test_set_and_remove_inside_maps_and_variants(spark):
    df = spark.sql("""SELECT 1 AS id, map('x', 1, 'y', 2) AS m, parse_json('{"k": 1, "o": {"p": 2}}') AS v,
                      map('a', named_struct('b', 1, 'c', 2)) AS ms, named_struct('m', map('q', 'r')) AS s
                      UNION ALL SELECT 2, CAST(NULL AS map<string,int>), NULL, NULL, NULL""")

    def row(d, c, i=1):
        return json.loads(d.filter(f"id = {i}").select(F.to_json(F.struct(c)).alias("j")).first().j).get(c)

    assert row(R.add_field(df, "m.z", 5), "m") == {"x": 1, "y": 2, "z": 5}
    assert row(R.add_field(df, "m.x", 5), "m") == {"y": 2, "x": 5}
    assert row(R.add_field(df, "m.z", 5), "m", 2) == {"z": 5}
    assert row(R.add_field(df, "v.z", 5), "v") == {"k": 1, "o": {"p": 2}, "z": 5}
    assert row(R.add_field(df, "v.o.z", "t"), "v") == {"k": 1, "o": {"p": 2, "z": "t"}}
    assert row(R.add_field(df, "ms.a.c", 9), "ms") == {"a": {"b": 1, "c": 9}}
    assert row(R.add_field(df, "s.m.n", "w"), "s") == {"m": {"q": "r", "n": "w"}}
    assert row(R.remove_field(df, "m.x"), "m") == {"y": 2}
    assert row(R.remove_field(df, "v.k"), "v") == {"o": {"p": 2}}
    assert row(R.remove_field(df, "v.o.p"), "v") == {"k": 1, "o": {}}
    assert row(R.remove_field(df, "ms.a.c"), "ms") == {"a": {"b": 1}}  # emptied: to_json leaves nulls out
    assert row(R.remove_field(df, "m.none"), "m") == {"x": 1, "y": 2}
    moved = R.rename_field(df, "v.k", "m.k2")
    assert row(moved, "m") == {"x": 1, "y": 2, "k2": 1} and row(moved, "v") == {"o": {"p": 2}}


def test_keys_that_differ_in_case_are_different(spark):
    df = spark.sql("SELECT 1 AS value, named_struct('a', 1) AS s")
    out = R.add_field(R.add_field(df, "Value", 2), "s.A", 3)
    assert out.columns == ["value", "s", "Value"]
    assert json.loads(out.select(F.to_json(F.struct("*")).alias("j")).first().j) == {
        "value": 1, "Value": 2, "s": {"a": 1, "A": 3}}
    assert R.remove_field(out, "VALUE").columns == out.columns
    assert R.remove_field(out, "Value").columns == ["value", "s"]


def test_typed_flatten_collision_keeps_the_value_that_is_there(spark):
    df = spark.sql("""SELECT named_struct('b', CAST(NULL AS string)) AS a, '2' AS a_b
                      UNION ALL SELECT named_struct('b', '1'), NULL
                      UNION ALL SELECT named_struct('b', '1'), '2'""")
    assert [r.a_b for r in R.flatten_doc(df).collect()] == ["2", "1", "2"]
    mixed = spark.sql("SELECT named_struct('b', 7) AS a, CAST(NULL AS string) AS a_b")
    assert [r.a_b for r in R.flatten_doc(mixed).collect()] == ["7"]


def test_failed_value_keeps_the_typed_field(spark):
    df = spark.sql("SELECT 'old' AS u, named_struct('w', 'old') AS s")
    none = F.lit(None).cast("string")
    assert R.add_field(df, "u", none, skip_null=True).first().u == "old"
    assert R.add_field(df, "s.w", none, skip_null=True).first().s.w == "old"
    assert R.add_field(df, "u", F.lit("new"), skip_null=True).first().u == "new"


# --- documents of any depth against brute force --------------------------------------

def _some_documents():
    import random
    rnd = random.Random(1)

    def made(depth):
        if depth == 0 or rnd.random() < 0.25:
            return rnd.choice([1, "x", None, [1, {"q": {}}], {}, True])
        return {k: made(depth - 1) for k in rnd.sample("abcdef", rnd.randrange(0, 4))}

    def chain(n):
        out = {"leaf": 1, "e": {}}
        for i in range(n):
            out = {f"k{i % 3}": out, **({"z": {"y": i}} if i % 4 == 0 else {})}
        return out

    wide = {"w": {f"p{i}": {f"q{j}": {"a": {}, "b": i} for j in range(5)} for i in range(40)}}
    return [{"r": made(6), "s": made(5)} for _ in range(40)] + [chain(n) for n in (4, 5, 6, 13, 14, 15, 33)] + [wide]


def _leaves(doc, prefix=()):
    for k, v in doc.items():
        if isinstance(v, dict):
            yield from _leaves(v, (*prefix, k))
        else:
            yield (*prefix, k), v


def _trimmed(doc, keep, prefix=()):
    out = {}
    for k, v in doc.items():
        if isinstance(v, dict):
            inner = _trimmed(v, keep, (*prefix, k))
            if inner:
                out[k] = inner
        elif keep(".".join((*prefix, k))):
            out[k] = v
    return out


def test_documents_of_any_depth(spark):
    import json

    from pyspark.sql import functions as F

    from docweave.operators.reshape import flatten_doc, prune_empty, trim

    docs = _some_documents()
    df = spark.createDataFrame([(i, json.dumps(d)) for i, d in enumerate(docs)], "i int, j string") \
        .select("i", F.parse_json("j").alias("doc"))

    def got(out):
        return [json.loads(r.j) for r in out.select("i", F.to_json("doc").alias("j")).orderBy("i").collect()]

    assert got(flatten_doc(df, "-", doc="doc")) == [{"-".join(p): v for p, v in _leaves(d)} for d in docs]
    some = sorted({".".join(p) for d in docs for p, _ in _leaves(d)})[::2]
    assert got(trim(df, some, "allows", doc="doc")) == [_trimmed(d, set(some).__contains__) for d in docs]
    assert got(trim(df, some, "delete", doc="doc")) == [_trimmed(d, lambda p: p not in some) for d in docs]
    assert got(prune_empty(df, doc="doc")) == [_trimmed(d, lambda p: True) for d in docs]
