"""User sinks whose rows become visible once, batch by batch (K8, K9).

A sink is a Python data source with a batch and a stream writer.  Every task
*stages* its rows: it writes a part file under a name of its own, through user
code that renders a row.  When all tasks are done the driver *publishes* the
parts of the attempts that succeeded, with one ledger entry that is moved into
place as a whole.  What a killed or failed attempt has left is not in any entry,
and a batch that a restarted stream sends again finds its entry and is
discarded.  ``read_published`` reads the parts that entries name.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamWriter, DataSourceWriter, WriterCommitMessage


def register_sink(spark: SparkSession, name: str, render: Callable, prepare: Callable | None = None,
                  cleanup: Callable | None = None) -> None:
    """Register the sink ``name`` for ``df.write.format(name)`` and ``df.writeStream.format(name)``.

    ``render(row)``, or ``render(row, client)`` if there is a ``prepare``, gives
    the text of a row (a dict), without line feeds, or None for no output.
    ``prepare`` and ``cleanup`` run once per task.  Options: ``path``, a folder
    that driver and executors share (a path or URI that pyarrow opens), and
    ``run``, which names a batch write: one that is sent again under the same
    name is discarded.  An error of ``render`` fails the task's attempt; if the
    job fails, nothing of it is published and its parts are removed.
    """

    class Staged(WriterCommitMessage):
        def __init__(self, part: str | None, rows: int):
            self.part, self.rows = part, rows

    class Ledger:
        def __init__(self, options: dict):
            self.path, self.run = options["path"], options.get("run")

        def place(self):
            from pyarrow import fs
            return fs.FileSystem.from_uri(self.path)

        def write(self, rows: Iterator) -> WriterCommitMessage:
            files, root = self.place()
            files.create_dir(f"{root}/parts", recursive=True)
            part, n = f"parts/{uuid.uuid4().hex}.txt", 0
            client = prepare() if prepare else None
            try:
                with files.open_output_stream(f"{root}/{part}") as out:
                    for row in rows:
                        values = row.asDict(recursive=True)
                        text = render(values, client) if prepare else render(values)
                        if text is not None:
                            out.write(text.encode() + b"\n")
                            n += 1
            except BaseException:
                files.delete_file(f"{root}/{part}")
                raise
            finally:
                if cleanup:
                    cleanup(client)
            if not n:
                files.delete_file(f"{root}/{part}")
            return Staged(part if n else None, n)

        def publish(self, entry: str, messages: list) -> None:
            from pyarrow import fs
            files, root = self.place()
            done = f"{root}/ledger/{entry}.json"
            if files.get_file_info(done).type == fs.FileType.File:  # sent again
                return self.discard(messages)
            files.create_dir(f"{root}/ledger", recursive=True)
            files.create_dir(f"{root}/open", recursive=True)
            staged = [m for m in messages if m is not None and m.part]
            made = f"{root}/open/{uuid.uuid4().hex}"
            with files.open_output_stream(made) as out:
                out.write(json.dumps({"entry": entry, "rows": sum(m.rows for m in staged),
                                      "parts": [m.part for m in staged]}).encode())
            files.move(made, done)

        def discard(self, messages: list) -> None:
            files, root = self.place()
            for m in messages:
                if m is not None and m.part:
                    files.delete_file(f"{root}/{m.part}")

    class Writer(Ledger, DataSourceWriter):
        def commit(self, messages):
            self.publish(f"run-{self.run or uuid.uuid4().hex}", messages)

        def abort(self, messages):
            self.discard(messages)

    class StreamWriter(Ledger, DataSourceStreamWriter):
        def commit(self, messages, batchId):
            self.publish(f"batch-{batchId:012}", messages)

        def abort(self, messages, batchId):
            self.discard(messages)

    class Sink(DataSource):
        @classmethod
        def name(cls):
            return name

        def writer(self, schema, overwrite):
            return Writer(self.options)

        def streamWriter(self, schema, overwrite):
            return StreamWriter(self.options)

    spark.dataSource.register(Sink)


def ledger(spark: SparkSession, path: str) -> DataFrame:
    """(entry, rows, parts) of everything that has been published to ``path``."""
    jvm = spark._jvm.org.apache.hadoop.fs
    folder = jvm.Path(f"{path}/ledger")
    if not folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder):
        return spark.createDataFrame([], "entry string, rows bigint, parts array<string>")
    return spark.read.schema("entry string, rows bigint, parts array<string>").json(f"{path}/ledger")


def read_published(spark: SparkSession, path: str) -> DataFrame:
    """(value): the lines of all published parts, each once; staged parts of no entry are not read."""
    parts = ledger(spark, path).selectExpr("explode(parts) AS part")
    if parts.isEmpty():
        return spark.createDataFrame([], "value string")
    lines = spark.read.text(f"{path}/parts").selectExpr(
        "value", "concat('parts/', substring_index(_metadata.file_path, '/', -1)) AS part")
    return lines.join(parts, "part", "left_semi").select("value")
