"""Filter: keep or drop documents by a list of conditions."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docweave.functions.predicates import Cond, all_of, any_of, condition, total


def _as_cond(c) -> Cond:
    if isinstance(c, Cond):
        return c
    if isinstance(c, dict):
        return Cond(str(c["field"]), str(c["operator"]), str(c.get("value", "")))
    field, op, value = c
    return Cond(str(field), str(op), str(value))


def normalise_action(action: str | None) -> bool:
    """True for permit.  Anything but ``block`` (trimmed, any case) permits."""
    return not (action is not None and str(action).strip().lower() == "block")


def normalise_match(match: str | None) -> bool:
    """True for all.  Anything but ``any`` (trimmed, any case) means all."""
    return not (match is not None and str(match).strip().lower() == "any")


def filter_predicate(df: DataFrame, conditions: Iterable, action: str = "permit",
                     match: str = "all", doc: str | None = None, *,
                     coerce: bool = False, on_error: str = "false") -> Column:
    """The row predicate of ``filter_docs``.

    permit+all keeps rows where every condition holds (no condition: keep);
    permit+any keeps rows where one holds (no condition: drop); block is the
    exact complement of permit.  The permit form may be NULL (drops the row,
    and stays pushable to the scan); the block form is two-valued.
    """
    conds = [condition(df, _as_cond(c), doc, coerce=coerce, on_error=on_error)
             for c in conditions]
    combined = all_of(conds) if normalise_match(match) else any_of(conds)
    if normalise_action(action):
        return combined
    return ~total(combined)


def filter_docs(df: DataFrame, conditions: Iterable, action: str = "permit",
                match: str = "all", doc: str | None = None, *,
                coerce: bool = False, on_error: str = "false",
                entity: str | None = None) -> DataFrame:
    """Keep the documents that pass the conditions (a narrow ``where``).

    ``entity`` overrides the record type of the kept documents.
    """
    conds = list(conditions)
    pred = filter_predicate(df, conds, action, match, doc, coerce=coerce, on_error=on_error)
    out = df.where(pred)
    return out if entity is None else out.withColumn("entity", F.lit(entity))
