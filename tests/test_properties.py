"""Property tests: VARIANT operators against small Python models of the semantics.

Each Hypothesis example is a batch of random documents checked in one Spark job.
"""

import json

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from docweave.functions.predicates import Cond, condition, total
from docweave.operators import reshape as R
from docweave.operators.split import split
from docweave.sources.envelope import parse_documents

KEYS = st.sampled_from(["a", "b", "c", "a_b", "x"])
SCALARS = st.one_of(st.none(), st.booleans(), st.integers(-50, 50),
                    st.sampled_from(["5", "10", "q", "l1\nl2", "", "abc"]))
VALUES = st.recursive(SCALARS, lambda inner: st.one_of(
    st.lists(inner, max_size=3), st.dictionaries(KEYS, inner, max_size=3)), max_leaves=20)


def _wrapped(value, keys):
    for k in keys:
        value = {k: value}
    return value


# some documents are far deeper than a recursive strategy draws by itself
DEEP = st.builds(_wrapped, st.dictionaries(KEYS, VALUES, max_size=3), st.lists(KEYS, min_size=1, max_size=14))
DOCS = st.lists(st.one_of(st.dictionaries(KEYS, VALUES, max_size=4), DEEP), min_size=1, max_size=12)
SETTINGS = settings(max_examples=10, deadline=None,
                    suppress_health_check=[HealthCheck.function_scoped_fixture,
                                           HealthCheck.too_slow])


def _frame(spark, docs):
    rows = [(i, json.dumps(d)) for i, d in enumerate(docs)]
    return parse_documents(spark.createDataFrame(rows, "id int, map string"))


def _results(df):
    return {r.id: json.loads(r.j) for r in df.select("id", F.to_json("doc").alias("j")).collect()}


def _depth(v):
    if isinstance(v, dict):
        return 1 + max([_depth(x) for x in v.values()] or [0])
    return 0


def model_flatten(d, sep):
    out = {}

    def walk(obj, prefix):
        for k in sorted(obj):
            v = obj[k]
            if isinstance(v, dict):
                walk(v, prefix + k + sep)
            else:
                out[prefix + k] = v
    walk(d, "")
    return out


def model_trim(d, fields, allows, prefix=""):
    out = {}
    for k, v in d.items():
        path = prefix + k
        if isinstance(v, dict):
            sub = model_trim(v, fields, allows, path + ".")
            if sub:
                out[k] = sub
        elif (path in fields) == allows:
            out[k] = v
    return out


@SETTINGS
@given(docs=DOCS)
def test_flatten_matches_model(spark, docs):
    got = _results(R.flatten_doc(_frame(spark, docs), "_", doc="doc"))
    assert got == {i: model_flatten(d, "_") for i, d in enumerate(docs)}


@SETTINGS
@given(docs=DOCS, fields=st.lists(st.sampled_from(["a", "b", "a.b", "a.c", "b.a.x", "x.a"]),
                                  max_size=3), allows=st.booleans())
def test_trim_matches_model(spark, docs, fields, allows):
    df = R.trim(_frame(spark, docs), fields, "allows" if allows else "delete", doc="doc")
    assert _results(df) == {i: model_trim(d, set(fields), allows) for i, d in enumerate(docs)}


def _get(d, path):
    cur = d
    for p in path.split("."):
        if not isinstance(cur, dict) or p not in cur:
            return None
        cur = cur[p]
    return cur


def model_cond(d, field, op, value):
    v = _get(d, field)
    if v is None:
        return False
    if op == "==":
        return isinstance(v, str) and v == value
    if op == "!=":
        return not (isinstance(v, str) and v == value)
    if op in ("<", ">"):
        if isinstance(v, bool) or not isinstance(v, (int, str)):
            return False
        try:
            num = float(v)
        except ValueError:
            return False
        return num < float(value) if op == "<" else num > float(value)
    if op == "containsText":
        return isinstance(v, str) and value in v
    if op in ("contains", "notcontains"):
        if isinstance(v, str):
            hit = value in v
        elif isinstance(v, list):
            hit = any(isinstance(e, str) and e == value for e in v)
        else:
            return False
        return hit if op == "contains" else not hit
    raise AssertionError(op)


CONDS = st.tuples(st.sampled_from(["a", "b", "a.b", "x.c"]),
                  st.sampled_from(["==", "!=", "<", ">", "containsText", "contains", "notcontains"]),
                  st.sampled_from(["5", "10", "q", "abc", "l2"]))


@SETTINGS
@given(docs=DOCS, conds=st.lists(CONDS, min_size=1, max_size=4))
def test_conditions_match_model(spark, docs, conds):
    conds = [c for c in conds if not (c[1] in ("<", ">") and not c[2].isdigit())]
    if not conds:
        return
    df = _frame(spark, docs)
    cols = [total(condition(df, Cond(*c), "doc")).alias(f"c{i}") for i, c in enumerate(conds)]
    got = {r.id: [r[f"c{i}"] for i in range(len(conds))] for r in df.select("id", *cols).collect()}
    want = {i: [model_cond(d, *c) for c in conds] for i, d in enumerate(docs)}
    assert got == want


SPLIT_CONDS = st.one_of(
    st.tuples(st.sampled_from(["a", "b", "a.b"]), st.sampled_from(["<", ">=", "<="]),
              st.sampled_from(["5", "10"])),
    st.tuples(st.sampled_from(["a", "b", "a.b"]),
              st.sampled_from(["==", "!=", "containsText", "RegexExpression"]),
              st.sampled_from(["5", "q", "^a", "l1.l2"])))


@SETTINGS
@given(docs=DOCS, cond=SPLIT_CONDS)
def test_split_is_a_partition(spark, docs, cond):
    df = _frame(spark, docs)
    s = split(df, cond[0], cond[1], cond[2], doc="doc")
    yes = {r.id for r in s.yes.collect()}
    no = {r.id for r in s.no.collect()}
    assert yes.isdisjoint(no) and yes | no == set(range(len(docs)))


@SETTINGS
@given(docs=DOCS)
def test_rename_matches_model(spark, docs):
    got = _results(R.rename_field(_frame(spark, docs), "a", "x.moved", doc="doc"))
    want = {}
    for i, d in enumerate(docs):
        m = json.loads(json.dumps(d))
        value = m.pop("a", None)
        if not isinstance(m.get("x"), dict):
            m["x"] = {}
        m["x"]["moved"] = value
        want[i] = m
    assert got == want


EV_CONDS = st.tuples(
    st.sampled_from(["event_type", "value", "user_id", "props.k", "missing.x"]),
    st.sampled_from(["==", "!=", "<", ">=", "containsText", "contains", "notcontains",
                     "matches_field"]),
    st.sampled_from(["purchase", "click", "50", "100.5", "1", "ic"]))


@settings(max_examples=8, deadline=None,
          suppress_health_check=[HealthCheck.function_scoped_fixture, HealthCheck.too_slow])
@given(conds=st.lists(EV_CONDS, min_size=1, max_size=3), match=st.sampled_from(["all", "any"]),
       action=st.sampled_from(["permit", "block"]))
def test_typed_and_variant_filters_agree(spark, conds, match, action):
    from conftest import SF001
    from docweave.operators.filter import filter_docs
    conds = [c for c in conds if not (c[1] in ("<", ">=") and not c[2].replace(".", "").isdigit())]
    if not conds:
        return
    ev = spark.read.parquet(f"{SF001}/events.parquet").select(
        "event_id", "event_type", "value", "user_id", F.from_json("props", "k bigint").alias("props"))
    docs = ev.select("event_id", F.to_variant_object(F.struct(
        "event_type", "value", "user_id", "props")).alias("doc"))
    cs = [Cond(*c) for c in conds]
    typed = filter_docs(ev, cs, action, match).select("event_id")
    dyn = filter_docs(docs, cs, action, match, doc="doc").select("event_id")
    assert typed.exceptAll(dyn).count() == 0 and dyn.exceptAll(typed).count() == 0
