"""Counts of failed records, taken while the rows pass.

``observe`` adds up its metrics in the tasks that produce the rows, so a job
or a micro-batch reports how many records failed without a second scan.  In a
batch the counts are read from a ``pyspark.sql.Observation`` after the action;
on a stream they are in each progress of the query (``observedMetrics``) and
``FailureListener`` hands them to a function, micro-batch by micro-batch.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

from docweave.operators.user import ERROR_COL


def observe_documents(df: DataFrame, observed: Observation | str, status: str = "status") -> DataFrame:
    """Count the rows of ``classify_documents`` by status as they pass.

    Metrics: ``documents``, ``good``, ``malformed``, ``not_object``.  A stream
    takes a name in place of an ``Observation``.  An empty input counts zeros.
    """
    s = F.col(status)
    return df.observe(observed, F.count("*").alias("documents"), F.count_if(s == "good").alias("good"),
                      F.count_if(s == "malformed").alias("malformed"),
                      F.count_if(s == "not an object").alias("not_object"))


def observe_quarantined(df: DataFrame, observed: Observation | str) -> DataFrame:
    """Count what ``flat_map_docs(on_error="quarantine")`` emits: ``rows`` and, of these, ``quarantined``."""
    return df.observe(observed, F.count("*").alias("rows"), F.count(F.col(ERROR_COL)).alias("quarantined"))


class FailureListener(StreamingQueryListener):
    """Calls ``report(query name, batch id, metrics name, counts)`` for every micro-batch.

    Register it with ``spark.streams.addListener``.  A micro-batch that is run
    again after a failure reports again under the same batch id.
    """

    def __init__(self, report: Callable[[str | None, int, str, dict], None]):
        self._report = report

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        progress = event.progress
        for name, row in progress.observedMetrics.items():
            self._report(progress.name, progress.batchId, name, row.asDict())

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass
