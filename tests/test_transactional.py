"""The transactional user sink: failed tasks, repeated runs, replayed batches."""

import glob
import json
import os
from collections import Counter

import pytest

from docweave.sinks.transactional import ledger, read_published, register_sink


def published(spark, path):
    return Counter(json.loads(r.value)["id"] for r in read_published(spark, path).collect())


def test_batch_rows_are_published_once(spark, tmp_path):
    path = str(tmp_path / "out")
    register_sink(spark, "lines_once", lambda row, client: json.dumps({**row, "by": client["name"]})
                  if row["id"] % 10 else None, prepare=lambda: {"name": "c"}, cleanup=lambda client: client.clear())
    df = spark.range(200).repartition(5)
    assert published(spark, path) == Counter()
    for _ in range(2):  # the second one is the same run sent again
        df.write.format("lines_once").option("path", path).option("run", "r1").mode("append").save()
    want = Counter(i for i in range(200) if i % 10)
    assert published(spark, path) == want
    assert [(r.entry, r.rows) for r in ledger(spark, path).collect()] == [("run-r1", 180)]
    assert len(glob.glob(f"{path}/parts/*")) == len(ledger(spark, path).first().parts)
    df.write.format("lines_once").option("path", path).mode("append").save()
    assert published(spark, path) == want + want


def test_a_failed_job_publishes_nothing(spark, tmp_path):
    path = str(tmp_path / "out")

    def render(row):
        if row["id"] == 37:
            raise OSError("refused")
        return json.dumps(row)

    register_sink(spark, "lines_fail", render)
    with pytest.raises(Exception, match="refused"):
        spark.range(100).repartition(4).write.format("lines_fail").option("path", path).mode("append").save()
    # what a killed attempt leaves is not read either
    os.makedirs(f"{path}/parts", exist_ok=True)
    with open(f"{path}/parts/left.txt", "w") as f:
        f.write('{"id": 1}\n')
    assert published(spark, path) == Counter()
    spark.range(5).write.format("lines_fail").option("path", path).mode("append").save()
    assert published(spark, path) == Counter(range(5))


def test_a_replayed_batch_is_discarded(spark, tmp_path):
    path, ckpt = str(tmp_path / "out"), str(tmp_path / "ckpt")
    register_sink(spark, "lines_stream", json.dumps)

    def run(n):
        spark.range(n * 10, n * 10 + 10).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema("id bigint").parquet(f"{tmp_path}/in")
        stream.writeStream.format("lines_stream").option("path", path).option("checkpointLocation", ckpt) \
            .trigger(availableNow=True).start().awaitTermination()

    run(0)
    run(1)
    last = max(glob.glob(f"{ckpt}/commits/[0-9]*"), key=lambda p: int(os.path.basename(p)))
    for name in (last, f"{os.path.dirname(last)}/.{os.path.basename(last)}.crc"):
        if os.path.exists(name):
            os.remove(name)  # as if the driver had died between the sink's commit and Spark's own
    run(2)
    assert published(spark, path) == Counter(range(30))
    assert {r.entry for r in ledger(spark, path).collect()} == {f"batch-{i:012}" for i in range(3)}
