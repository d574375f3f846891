"""Moving between the two document representations.

* ``as_documents``: typed columns -> one VARIANT document per row.
* ``typed_from_documents``: VARIANT documents -> typed columns, with a given
  schema or one inferred once with ``schema_of_variant_agg``.  Typed columns
  give Parquet pushdown, nested pruning and code generation to everything
  downstream; the price is that a missing key and a JSON null both become
  NULL, unless a presence column goes along (``presence=True``).
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docweave.functions.paths import variant_path
from docweave.functions.presence import NAME, bitmap, document_of, field_paths, presence_of


def as_documents(df: DataFrame, keep: Sequence[str] = ("entity",), doc: str = "doc") -> DataFrame:
    """Pack every column except ``keep`` into a VARIANT object column ``doc``.

    With a presence column missing fields are left out; without one they are null.
    """
    kept = [c for c in keep if c in df.columns]
    if presence_of(df) is not None:
        return df.select(*kept, document_of(df, tuple(kept)).alias(doc))
    body = [F.col(f"`{c}`") for c in df.columns if c not in kept]
    return df.select(*kept, F.to_variant_object(F.struct(*body)).alias(doc))


def struct_ddl(variant_schema: str) -> str:
    """Turn a ``schema_of_variant`` type into a ``variant_get`` target type.

    Objects become structs; decimals become doubles (JSON numbers, and a
    sampled precision may be too narrow), but integers beyond 64 bits stay
    decimals; JSON null becomes VARIANT.  Field names, quoted or plain, stay as
    they are, whatever they spell.
    """
    out: list[str] = []
    # a quoted name, or a plain one before its colon, or a type
    for quoted, name, word, rest in re.findall(
            r"(`(?:[^`]|``)*`\s*:)|([^\s<>,:`()]+\s*:)|([A-Z_]+(?:\(\d+,\s*\d+\))?)|(.)", variant_schema, re.S):
        if quoted or name:
            out.append(quoted or f"`{name.rstrip(': ')}`:")
        elif word == "OBJECT":
            out.append("STRUCT")
        elif word == "VOID":
            out.append("VARIANT")
        elif word.startswith("DECIMAL("):
            digits, scale = (int(x) for x in word[8:-1].split(","))
            out.append(word if scale == 0 and digits > 18 else "DOUBLE")
        else:
            out.append(word or rest)
    return "".join(out)


def variant_schema(df: DataFrame, doc: str = "doc", sample_fraction: float | None = None,
                   seed: int = 42) -> str:
    """Merged schema of the documents (one aggregation; on a sample if asked)."""
    src = df if sample_fraction is None else df.sample(fraction=sample_fraction, seed=seed)
    merged = src.select(F.schema_of_variant_agg(doc)).first()[0]
    if merged is None:
        raise ValueError("no documents to infer a schema from")
    if not merged.startswith("OBJECT<"):
        raise ValueError(f"documents are not all objects: {merged[:80]}")
    return struct_ddl(merged)


def typed_from_documents(df: DataFrame, doc: str = "doc", schema: str | None = None,
                         sample_fraction: float | None = None,
                         keep: Sequence[str] = ("entity",), presence: bool = False) -> DataFrame:
    """Typed columns from VARIANT documents.

    ``presence=True`` adds a presence column, so that ``has_field``,
    ``as_documents`` and ``to_envelope`` tell null fields from missing ones.
    (Objects within arrays have no bits of their own; give their elements the
    type VARIANT to keep the difference there as well.)

    Without ``schema`` it is inferred over all documents, or over a sample.
    With a sampled schema the strict ``variant_get`` is used, so a value that
    does not fit fails the job instead of silently becoming NULL.
    """
    strict = schema is None and sample_fraction is not None
    ddl = schema or variant_schema(df, doc, sample_fraction)
    getter = F.variant_get if strict else F.try_variant_get
    kept = [c for c in keep if c in df.columns]
    typed = getter(F.col(doc), "$", ddl).alias("__typed")
    if not presence:
        return df.select(*kept, typed).select(*kept, "__typed.*")
    # the bits are read off the document, whose fields may not fit their types
    paths = field_paths(df.select(typed).schema["__typed"].dataType)
    tests = [(p, F.try_variant_get(F.col(doc), variant_path(list(p)), "variant").isNotNull()) for p in paths]
    return df.select(*kept, typed, bitmap(tests)).select(*kept, "__typed.*", NAME)
