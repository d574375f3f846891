"""Failed records are counted while the rows pass, in batches and on streams."""

import time

from pyspark.sql import Observation
from pyspark.sql import functions as F

from docweave.functions.observed import FailureListener, observe_documents, observe_quarantined
from docweave.operators.user import flat_map_docs
from docweave.sources.envelope import classify_documents, read_documents

LINES = [['{"a":1}', "{bad", "[1]"], ['{"b":2}', '{"c":3}', "7", "{"]]


def test_batch_counts(spark):
    env = spark.createDataFrame([("e", t) for part in LINES for t in part] + [("e", None)], "entity string, map string")
    seen = Observation()
    out = observe_documents(classify_documents(env), seen)
    assert out.where("status = 'good'").count() == 3
    assert seen.get == {"documents": 8, "good": 3, "malformed": 3, "not_object": 2}
    none = Observation()
    assert observe_documents(classify_documents(env.where("false")), none).count() == 0
    assert none.get == {"documents": 0, "good": 0, "malformed": 0, "not_object": 0}


def test_quarantine_counts(spark):
    def refuse(row):
        if row["id"] % 4 == 0:
            raise ValueError("refused")
        yield {"id": row["id"]}
        yield {"id": -row["id"]}

    seen = Observation()
    out = observe_quarantined(flat_map_docs(spark.range(100), refuse, "id bigint", on_error="quarantine"), seen)
    assert out.where("_error IS NULL").count() == 150
    assert seen.get == {"rows": 175, "quarantined": 25}


def test_stream_counts_per_batch(spark, tmp_path):
    for i, part in enumerate(LINES):
        (tmp_path / f"in{i}").mkdir()
        (tmp_path / f"in{i}" / "part.txt").write_text("\n".join(part))
    reported = []
    listener = FailureListener(lambda *event: reported.append(event))
    spark.streams.addListener(listener)
    try:
        env = (spark.readStream.option("maxFilesPerTrigger", 1).text(str(tmp_path / "in*"))
               .select(F.lit("e").alias("entity"), F.col("value").alias("map")))
        good = observe_documents(classify_documents(env), "records").where("status = 'good'").select("map")
        q = (good.writeStream.format("parquet").queryName("landed").option("checkpointLocation", str(tmp_path / "ck"))
             .trigger(availableNow=True).start(str(tmp_path / "out")))
        q.awaitTermination()
        counts = {p["batchId"]: p["observedMetrics"]["records"] for p in q.recentProgress if p["numInputRows"]}
        assert sorted((c["documents"], c["good"], c["malformed"], c["not_object"]) for c in counts.values()) == \
            [(3, 1, 1, 1), (4, 2, 1, 1)]
        for _ in range(100):  # listeners are told later
            if sum(e[3]["documents"] for e in reported) == 7:
                break
            time.sleep(0.1)
        assert {(e[0], e[2]) for e in reported} == {("landed", "records")}
        assert sum(e[3]["malformed"] for e in reported) == 2
    finally:
        spark.streams.removeListener(listener)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 3
    assert read_documents(spark, str(tmp_path / "in*")).count() == 7
