"""Golden rows of the conditions (FIXTURES.md section 2), VARIANT and typed mode."""

import pytest
from pyspark.sql import functions as F

from docweave.functions.predicates import Cond, condition, fields_condition, java_double, total
from docweave.operators.filter import filter_docs
from docweave.operators.split import branch_exists, split, split_exists

GOLDEN = [
    (("s", "==", "5"), True), (("n", "==", "5"), False), (("z", "==", "5"), False),
    (("missing", "==", "5"), False),
    (("s", "!=", "5"), False), (("n", "!=", "5"), True), (("z", "!=", "5"), False),
    (("missing", "!=", "5"), False),
    (("n", "<", "10"), True), (("s", "<", "10"), True), (("f", "<", "2.5"), False),
    (("missing", "<", "10"), False), (("b", "<", "10"), False),
    (("t", "containsText", "l2"), True),
    (("a", "contains", "x"), True), (("a", "contains", "5"), False),
    (("a", "notcontains", "5"), True), (("missing", "notcontains", "5"), False),
    (("n", "contains", "5"), False),
    (("t", "RegexExpression", "l1.l2"), True), (("n", "RegexExpression", "^5$"), True),
    (("o.x.y", "==", "q"), True), (("o.x.nope", "==", "q"), False),
    (("s", "matches_field", "[0-9]"), True),
]


def _eval(df, conds, doc):
    row = df.select(*[total(condition(df, Cond(*c), doc)).alias(f"c{i}")
                      for i, c in enumerate(conds)]).first()
    return list(row)


def test_golden_variant(doc_d):
    got = _eval(doc_d, [c for c, _ in GOLDEN], "doc")
    assert got == [e for _, e in GOLDEN]


def test_golden_typed(typed_d):
    # typed D holds a as array<string>, so "5" is a string element there
    expected = {("a", "contains", "5"): True, ("a", "notcontains", "5"): False}
    conds = [c for c, _ in GOLDEN]
    got = _eval(typed_d, conds, None)
    assert got == [expected.get(c, e) for c, e in GOLDEN]


def test_match_field_is_regex(spark):
    df = spark.createDataFrame([("a.c",)], "p string")
    assert df.select(total(condition(df, Cond("p", "match", "abc")))).first()[0] is True
    assert df.select(total(condition(df, Cond("p", "match", "xabc")))).first()[0] is False
    # a pattern from the data that does not compile is false, unless failing is asked for
    bad = spark.createDataFrame([("x[",), ("a(",), ("x",), (None,)], "p string")
    got = bad.select("p", total(condition(bad, Cond("p", "match", "x"))).alias("ok")).collect()
    assert {r.p: r.ok for r in got} == {"x[": False, "a(": False, "x": True, None: False}
    with pytest.raises(Exception):
        bad.select(condition(bad, Cond("p", "match", "x"), on_error="fail")).collect()


def test_on_error_fail_typed(typed_d):
    with pytest.raises(ValueError):
        condition(typed_d, Cond("n", "contains", "5"), on_error="fail")
    with pytest.raises(ValueError):
        condition(typed_d, Cond("n", "bogus", "5"))


def test_on_error_fail_variant(doc_d):
    with pytest.raises(Exception):
        doc_d.select(condition(doc_d, Cond("n", "contains", "5"), "doc", on_error="fail")).collect()


def test_coerce(doc_d):
    c = condition(doc_d, Cond("n", "==", "5"), "doc", coerce=True)
    assert doc_d.select(total(c)).first()[0] is True


def test_java_double():
    assert java_double(" 1d ") == 1.0
    assert java_double("2.5f") == 2.5
    assert java_double("1e2") == 100.0
    assert java_double("0x1p3") == 8.0
    with pytest.raises(ValueError):
        java_double("abc")


@pytest.mark.parametrize("action,match,expected", [
    ("permit", "all", 1), ("permit", "any", 0), ("block", "all", 0), ("block", "any", 1)])
def test_empty_conditions(doc_d, action, match, expected):
    assert filter_docs(doc_d, [], action, match, doc="doc").count() == expected


def test_filter_dotted_and_forms(doc_d):
    conds = [Cond("o.x.y", "==", "q"), Cond("n", ">", "100")]
    assert filter_docs(doc_d, conds, "permit", "all", doc="doc").count() == 0
    assert filter_docs(doc_d, conds, "permit", "any", doc="doc").count() == 1
    assert filter_docs(doc_d, conds, " Block ", "ALL", doc="doc").count() == 1
    assert filter_docs(doc_d, conds, "block", "any", doc="doc").count() == 0
    assert filter_docs(doc_d, [{"field": "s", "operator": "==", "value": "5"}], doc="doc").count() == 1


def test_two_field_conditions(spark):
    df = spark.createDataFrame([("5", "5", "2", "3", "a.c", "abc")],
                               "s string, s2 string, lo string, hi string, p string, x string")
    one = lambda f1, op, f2: df.select(total(fields_condition(df, f1, op, f2))).first()[0]
    assert one("s", "==", "s2") is True
    assert one("s", "==", "missing") is False
    assert one("s", "!=", "missing") is True
    assert one("lo", "<", "hi") is True
    assert one("p", "RegexExpression", "x") is True
    assert one("missing", "!=", "s") is False


def test_exists(doc_d, spark):
    assert branch_exists(doc_d, "s", "doc").select("branch").first()[0] == "yes"
    for field, yes in [("s", 1), ("z", 0), ("missing", 0), ("o.x", 0)]:
        assert split_exists(doc_d, field, "doc").yes.count() == yes
    assert split_exists(doc_d, "o.x", "doc", nested=True).yes.count() == 1


def test_split_partitions_input(spark):
    df = spark.range(100).selectExpr("id", "CASE WHEN id % 3 = 0 THEN NULL ELSE id END AS v")
    s = split(df, "v", ">", "50", entity="big")
    assert s.yes.count() + s.no.count() == 100
    assert s.yes.join(s.no, "id").count() == 0
    assert {r.entity for r in s.yes.collect()} == {"big"}


def test_split_persisted_once(spark):
    df = spark.range(1000).selectExpr("id", "CASE WHEN id % 4 = 0 THEN NULL ELSE id END AS v")
    a = split(df, "v", "<", "500")
    b = split(df, "v", "<", "500", persist=True)
    assert sorted(r.id for r in a.yes.collect()) == sorted(r.id for r in b.yes.collect())
    assert sorted(r.id for r in a.no.collect()) == sorted(r.id for r in b.no.collect())
    assert b.yes.columns == df.columns


def test_numeric_on_boolean_fail_mode(doc_d, typed_d):
    assert doc_d.select(total(condition(doc_d, Cond("b", "<", "10"), "doc"))).first()[0] is False
    with pytest.raises(Exception):
        doc_d.select(condition(doc_d, Cond("b", "<", "10"), "doc", on_error="fail")).collect()
    with pytest.raises(ValueError):
        condition(typed_d, Cond("b", "<", "10"), on_error="fail")
    # numbers and numeric strings are fine in fail mode
    ok = doc_d.select(condition(doc_d, Cond("s", "<", "10"), "doc", on_error="fail")).first()[0]
    assert ok is True


def test_regex_sees_java_number_text(spark):
    from docweave.sources.envelope import parse_documents
    df = parse_documents(spark.createDataFrame(
        [("e", '{"a":2.0,"b":2.50,"c":5,"d":0.0001,"e":1e2,"f":12345678901234567890}')],
        "entity string, map string"))
    checks = [("a", r"^2\.0$"), ("b", r"^2\.5$"), ("c", r"^5$"), ("d", r"^1\.0E-4$"),
              ("e", r"^100\.0$"), ("f", r"^12345678901234567890$")]
    row = df.select(*[total(condition(df, Cond(f, "RegexExpression", p), "doc")).alias(f)
                      for f, p in checks]).first()
    assert all(row[f] for f, _ in checks), row


def test_total_order_of_doubles(spark):
    import math
    from itertools import product

    values = [-1.5, -0.0, 0.0, 2.0, math.inf, -math.inf, math.nan, None]

    def key(x):  # Double.compareTo
        return (x != x, x if x == x else 0.0, math.copysign(1.0, x) if x == 0 else 0.0)

    test = {"<": lambda a, b: key(a) < key(b), "<=": lambda a, b: key(a) <= key(b),
            ">": lambda a, b: key(a) > key(b), ">=": lambda a, b: key(a) >= key(b)}
    pairs = [(i, a, b) for i, (a, b) in enumerate(product(values, values))]
    df = spark.createDataFrame(pairs, "i int, a double, b double")
    vdf = df.select("i", "a", "b", F.to_variant_object(F.struct("a", "b")).alias("doc"))
    for doc, frame in ((None, df), ("doc", vdf)):
        got = frame.select("i", *[fields_condition(frame, "a", op, "b", doc).alias(op) for op in test]).collect()
        for (_, a, b), row in zip(pairs, sorted(got, key=lambda r: r.i)):
            for op, fn in test.items():
                assert bool(row[op]) == (a is not None and b is not None and fn(a, b)), (doc, a, op, b)
        for text, rhs in (("0", 0.0), ("-0.0", -0.0), ("NaN", math.nan), ("2", 2.0)):
            got = frame.select("i", *[condition(frame, Cond("a", op, text), doc).alias(op) for op in test]).collect()
            for (_, a, _), row in zip(pairs, sorted(got, key=lambda r: r.i)):
                for op, fn in test.items():
                    assert bool(row[op]) == (a is not None and fn(a, rhs)), (doc, a, op, text)
