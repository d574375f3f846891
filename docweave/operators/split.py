"""Routing splits: one predicate, two disjoint outputs ``yes`` and ``no``.

``split*`` return both outputs as DataFrames.  Read from a file or a stream
each output would scan the input again, so for a job that uses both either
``persist`` the input, use the ``branch*`` forms (one column ``branch`` with
``'yes'``/``'no'``, one pass), or fan out in ``foreachBatch``
(``docweave.sinks.writers.fan_out``).  A NULL outcome (missing field) routes
to ``no``; ``yes`` and ``no`` always partition the input.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docweave.functions import paths as P
from docweave.functions.predicates import (SPLIT_OPERATORS, exists_condition,
                                           field_condition, fields_condition, total)

BRANCH = "branch"


@dataclass
class Split:
    """Two outputs; ``release()`` lets go of the copy that ``persist=True`` kept."""

    yes: DataFrame
    no: DataFrame
    routed: DataFrame | None = None

    def release(self) -> None:
        if self.routed is not None:
            self.routed.unpersist()
            self.routed = None

    def __getitem__(self, name: str) -> DataFrame:
        if name not in ("yes", "no"):
            raise KeyError(name)
        return getattr(self, name)


def _with_entity(df: DataFrame, entity: str | None) -> DataFrame:
    return df if entity is None else df.withColumn("entity", F.lit(entity))


def _split(df: DataFrame, positive: Column, entity: str | None, persist: bool = False) -> Split:
    if persist and not df.isStreaming:
        # evaluate the predicate once, keep the routed rows, derive both outputs
        routed = df.withColumn("__route", total(positive)).persist()
        yes = routed.where(F.col("__route")).drop("__route")
        no = routed.where(~F.col("__route")).drop("__route")
    else:
        routed = None
        yes = df.where(positive)
        no = df.where(~total(positive))
    return Split(_with_entity(yes, entity), _with_entity(no, entity), routed)


def _branch(df: DataFrame, positive: Column, entity: str | None, name: str) -> DataFrame:
    out = df.withColumn(name, F.when(total(positive), F.lit("yes")).otherwise(F.lit("no")))
    return _with_entity(out, entity)


def split_predicate(df: DataFrame, field: str, operator: str, value: str,
                    doc: str | None = None, coerce: bool = False) -> Column:
    ref = P.resolve(df, field, doc)
    return field_condition(ref, operator, value, coerce=coerce, allowed=SPLIT_OPERATORS)


def split(df: DataFrame, field: str, operator: str, value: str, doc: str | None = None,
          entity: str | None = None, coerce: bool = False, persist: bool = False) -> Split:
    """Route by ``field operator value``.

    ``persist=True`` (batch) evaluates the predicate once on a persisted copy
    that both outputs read, instead of scanning the input twice; call
    ``release()`` on the result when both are done.
    """
    return _split(df, split_predicate(df, field, operator, value, doc, coerce), entity, persist)


def branch(df: DataFrame, field: str, operator: str, value: str, doc: str | None = None,
           entity: str | None = None, coerce: bool = False, name: str = BRANCH) -> DataFrame:
    return _branch(df, split_predicate(df, field, operator, value, doc, coerce), entity, name)


def split_fields(df: DataFrame, field1: str, operator: str, field2: str,
                 doc: str | None = None, entity: str | None = None,
                 coerce: bool = False, persist: bool = False) -> Split:
    """Route by comparing two fields of the same document (CF1-CF6)."""
    return _split(df, fields_condition(df, field1, operator, field2, doc, coerce), entity,
                  persist)


def branch_fields(df: DataFrame, field1: str, operator: str, field2: str,
                  doc: str | None = None, entity: str | None = None,
                  coerce: bool = False, name: str = BRANCH) -> DataFrame:
    return _branch(df, fields_condition(df, field1, operator, field2, doc, coerce),
                   entity, name)


def split_exists(df: DataFrame, field: str, doc: str | None = None,
                 entity: str | None = None, nested: bool = False,
                 persist: bool = False) -> Split:
    """Route by "field present and not null" (E1-E3); a dot is literal unless ``nested``."""
    pred = exists_condition(df, field, doc, nested)
    return _split(df, pred, entity, persist)


def branch_exists(df: DataFrame, field: str, doc: str | None = None,
                  entity: str | None = None, nested: bool = False,
                  name: str = BRANCH) -> DataFrame:
    return _branch(df, exists_condition(df, field, doc, nested), entity, name)
