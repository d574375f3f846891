"""Hot keys: a third of all rows on one key.  Results stay whole and exact, and
AQE splits the hot partition of the shuffle joins (no task gets the whole group)."""

import pytest
from pyspark.sql import functions as F

from docweave.operators.enrich import enrich_from_table
from docweave.sources.feeds import new_items

SKEW_CONF = {"spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "64k",
             "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
             "spark.sql.adaptive.advisoryPartitionSizeInBytes": "64k",
             "spark.sql.autoBroadcastJoinThreshold": "-1"}


@pytest.fixture
def skew_spark(spark):
    old = {k: spark.conf.get(k, None) for k in SKEW_CONF}
    for k, v in SKEW_CONF.items():
        spark.conf.set(k, v)
    yield spark
    for k, v in old.items():
        if v is None:
            spark.conf.unset(k)
        else:
            spark.conf.set(k, v)


def _hot_polls(spark, n=240000):
    third = n // 3
    df = spark.range(n).select(
        F.lit("f").alias("feed"),
        F.when(F.col("id") < third, F.lit(3)).otherwise((F.col("id") % 7) + 1).alias("poll"),
        F.when(F.col("id") < third, F.lit("HOT"))
        .otherwise(F.concat(F.lit("i"), (F.col("id") % 3001).cast("string"))).alias("item"),
        F.col("id"))
    extra = spark.createDataFrame([("f", 1, "HOT", -1), ("f", 2, "HOT", -2)],
                                  "feed string, poll long, item string, id long")
    return df.unionByName(extra)


def test_new_items_hot_item(skew_spark):
    df = _hot_polls(skew_spark)
    out = new_items(df, "item", "poll", "feed", max_broadcast_rows=0)
    rows = out.collect()  # through out's own query execution, so its final plan is kept
    plan = out._jdf.queryExecution().executedPlan().toString()
    pdf = df.select("poll", "item").toPandas()
    keys = set(map(tuple, pdf.drop_duplicates().values.tolist()))
    expected = sum(1 for p, i in pdf.values.tolist() if (p - 1, i) not in keys)
    assert len(rows) == expected
    assert sum(1 for r in rows if r.item == "HOT") == 1  # only the first poll's HOT is new
    assert "SortMergeJoin(skew=true)" in plan


def test_enrich_from_table_hot_key(skew_spark):
    n = 240000
    docs = skew_spark.range(n).select(
        "id", F.when(F.col("id") < n // 3, F.lit(0)).otherwise(F.col("id") % 500).alias("k"))
    mapping = skew_spark.range(500).select(F.col("id").alias("k"),
                                           F.concat(F.lit("v"), F.col("id")).alias("v"))
    out = enrich_from_table(docs, mapping, "k", max_broadcast_rows=0)
    got = out.agg(F.count("*").alias("n"), F.count("v").alias("hit")).first()
    assert (got.n, got.hit) == (n, n)
    out.collect()
    assert "skew=true" in out._jdf.queryExecution().executedPlan().toString()
