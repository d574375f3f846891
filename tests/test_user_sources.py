"""User sources that search: conditions reach their partitions and rows."""

import pytest
from pyspark.sql import functions as F

from docweave.sources.custom import read_where, source_from_function


def test_conditions_reach_the_source(spark):
    read = spark.sparkContext.accumulator(0)
    tests = {">": lambda x, v: x > v, ">=": lambda x, v: x >= v, "<": lambda x, v: x < v, "=": lambda x, v: x == v,
             "<=": lambda x, v: x <= v, "in": lambda x, v: x in v}

    def meets(row, wanted):
        return all(row[c] is not None and tests[op](row[c], v) for c, op, v in wanted)

    def partitions(options, wanted):
        low = max([v for c, op, v in wanted if c == "a" and op in (">", ">=")], default=0)
        return [p for p in range(10) if (p + 1) * 100 > low]

    def rows(part, wanted):
        for a in range(part * 100, part * 100 + 100):
            row = {"a": a, "b": None if a % 10 == 0 else a % 7, "c": "x"}
            if meets(row, wanted):
                read.add(1)
                yield row["a"], row["b"], "x"

    source_from_function(spark, "searched", "a bigint, b bigint, c string", partitions, rows, searches=True)
    every = [{"a": a, "b": None if a % 10 == 0 else a % 7, "c": "x"} for a in range(1000)]
    for wanted in ([("a", ">=", 950), ("b", "=", 3)], [("b", "in", [1, 2]), ("c", "=", "x")], [("a", "<", 10)],
                   [("a", ">", 990), ("a", "<=", 995)], [("a", ">", 5000)], [("b", "in", [])], []):
        model = [(r["a"], r["b"]) for r in every if meets(r, wanted)]
        read.value = 0
        out = read_where(spark, "searched", wanted)
        assert sorted((r.a, r.b) for r in out.collect()) == model
        assert read.value == len(model)
    assert spark.read.format("searched").load().count() == 1000
    # one load used twice, with other filters, and two loads in one plan
    low, high = read_where(spark, "searched", [("a", "<", 100)]), read_where(spark, "searched", [("a", ">=", 50)])
    assert low.where("a < 10").join(low.where("a >= 5"), "a").count() == 5
    assert low.where((F.col("a") == 60) | (F.col("b") == 1)).count() == sum(
        r["a"] < 100 and (r["a"] == 60 or r["b"] == 1) for r in every)
    assert low.join(high, "a").count() == 50
    with pytest.raises(ValueError):
        read_where(spark, "searched", [("a", "like", "x")])
