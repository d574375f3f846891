"""Dotted paths into documents.

A document is either the columns of a DataFrame (typed mode: nested
``StructType`` values) or one ``VARIANT`` column named by ``doc=`` (dynamic
mode).  ``resolve`` turns a dotted path such as ``user.address.city`` into a
``FieldRef``: the value as a Column plus what is known about its JSON kind.

In typed mode the kind is fixed by the schema when the plan is built, so
predicates fold to constants where the type rules of the operators allow.
In VARIANT mode the kind is tested per row with ``schema_of_variant``.

A path that does not exist (or runs through a non-object) is *missing*: its
value is SQL NULL, exactly like a JSON null.  Dots always separate levels;
there is no escape and no array index, as in the operators' path syntax.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docweave.functions.presence import presence_of

STRING = "string"
NUMBER = "number"
BOOLEAN = "boolean"
ARRAY = "array"
OBJECT = "object"
OTHER = "other"
MISSING = "missing"
VARIANT = "variant"

_NUMERIC = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType,
            T.DoubleType, T.DecimalType)


def split_path(path: str) -> list[str]:
    if not isinstance(path, str) or path == "":
        raise ValueError(f"field path must be a non-empty string, got {path!r}")
    return path.split(".")


def kind_of(data_type: T.DataType) -> str:
    if isinstance(data_type, T.StringType):
        return STRING
    if isinstance(data_type, _NUMERIC):
        return NUMBER
    if isinstance(data_type, T.BooleanType):
        return BOOLEAN
    if isinstance(data_type, T.ArrayType):
        return ARRAY
    if isinstance(data_type, (T.StructType, T.MapType)):
        return OBJECT
    if isinstance(data_type, T.VariantType):
        return VARIANT
    return OTHER


@dataclass(frozen=True)
class FieldRef:
    """A resolved path: ``column`` is its value, ``kind`` its JSON kind.

    For VARIANT documents ``column`` is a VARIANT value (SQL NULL when the
    path is missing, a variant null when the document holds JSON null).
    """

    path: str
    column: Column
    kind: str
    data_type: T.DataType | None = None

    @property
    def is_variant(self) -> bool:
        return self.kind == VARIANT

    @property
    def missing(self) -> bool:
        return self.kind == MISSING


def variant_path(parts: list[str]) -> str:
    """JSON path for ``try_variant_get``; bracket form keeps any key literal."""
    out = "$"
    for p in parts:
        if "'" in p:
            raise ValueError(f"key {p!r}: quotes are not allowed in a variant path")
        out += f"['{p}']"
    return out


def _struct_field(st: T.StructType, name: str) -> T.StructField | None:
    for f in st.fields:
        if f.name == name:
            return f
    return None


def resolve_typed(schema: T.StructType, path: str, literal: bool = False) -> FieldRef:
    """Resolve against the DataFrame's own columns.

    ``literal=True`` treats the whole path as one top-level name (a dot is
    part of the key), as the existence test of the reference does.
    """
    parts = [path] if literal else split_path(path)
    top = _struct_field(schema, parts[0])
    if top is None:
        return FieldRef(path, F.lit(None), MISSING, None)
    col = F.col(f"`{parts[0]}`")
    dtype = top.dataType
    for p in parts[1:]:
        if isinstance(dtype, T.StructType):
            f = _struct_field(dtype, p)
            if f is None:
                return FieldRef(path, F.lit(None), MISSING, None)
            col = col.getField(p)
            dtype = f.dataType
        elif isinstance(dtype, T.MapType) and isinstance(dtype.keyType, T.StringType):
            col = F.try_element_at(col, F.lit(p))
            dtype = dtype.valueType
        elif isinstance(dtype, T.VariantType):
            rest = parts[parts.index(p):]
            return FieldRef(path, F.try_variant_get(col, variant_path(rest), "variant"),
                            VARIANT, T.VariantType())
        else:
            return FieldRef(path, F.lit(None), MISSING, None)
    return FieldRef(path, col, kind_of(dtype), dtype)


def resolve_variant(doc: str | Column, path: str, literal: bool = False) -> FieldRef:
    parts = [path] if literal else split_path(path)
    base = F.col(doc) if isinstance(doc, str) else doc
    return FieldRef(path, F.try_variant_get(base, variant_path(parts), "variant"),
                    VARIANT, T.VariantType())


def resolve(df: DataFrame, path: str, doc: str | None = None,
            literal: bool = False) -> FieldRef:
    """Resolve ``path`` in typed mode (``doc=None``) or in the VARIANT ``doc``."""
    if doc is None:
        return resolve_typed(df.schema, path, literal)
    return resolve_variant(doc, path, literal)


# --- per-row kind tests for VARIANT values ---------------------------------

def vtype(v: Column) -> Column:
    return F.schema_of_variant(v)


def v_present(v: Column) -> Column:
    """Path exists and is not JSON null (the reference's ``getField != null``)."""
    return v.isNotNull() & ~F.is_variant_null(v)


def v_is_string(v: Column) -> Column:
    return vtype(v) == F.lit("STRING")


def v_is_array(v: Column) -> Column:
    # reading the elements as VARIANT does not decode them
    return F.try_variant_get(v, "$", "array<variant>").isNotNull()


def v_is_object(v: Column) -> Column:
    # reading an object as an empty struct succeeds without visiting its fields
    return F.try_variant_get(v, "$", "struct<>").isNotNull()


def v_string(v: Column) -> Column:
    return F.try_variant_get(v, "$", "string")


def v_double(v: Column) -> Column:
    return F.try_variant_get(v, "$", "double")


def v_java_text(v: Column) -> Column:
    """Text of a value as the reference prints a decoded JSON value.

    JSON integers print as integers (also beyond a long); any other number
    was a Java ``Double``, whose text Spark's double-to-string cast
    reproduces (``2.0``, ``100.0``, ``1.0E-4``).  Strings print as themselves;
    other kinds as their JSON text.
    """
    t = vtype(v)
    return (F.when(t.rlike(r"^(BIGINT|INT|SMALLINT|TINYINT)$"), v_string(v))
            .when(t.rlike(r"^DECIMAL\((19|[2-9][0-9]|[1-9][0-9]{2}),0\)$"), v_string(v))
            .when(t.rlike(r"^(DECIMAL|DOUBLE|FLOAT)"), v_double(v).cast("string"))
            .otherwise(v_string(v)))


def get_field(df: DataFrame, path: str, doc: str | None = None,
              data_type: str | T.DataType | None = None) -> Column:
    """Value at ``path`` as a Column (P9); VARIANT values cast with ``try_variant_get``."""
    ref = resolve(df, path, doc)
    if ref.is_variant and data_type is not None:
        dt = data_type if isinstance(data_type, str) else data_type.simpleString()
        return F.try_variant_get(ref.column, "$", dt)
    if data_type is not None and not ref.is_variant:
        return ref.column.try_cast(data_type)
    return ref.column


def has_field(df: DataFrame, path: str, doc: str | None = None) -> Column:
    """Presence test in which JSON null counts as present.

    VARIANT mode is exact, and so is typed mode with a presence column
    (``typed_from_documents(presence=True)``).  Without one typed mode cannot
    tell a null value from a missing one: it answers ``IS NOT NULL`` for a
    column that exists and ``false`` for one the schema does not have.
    """
    held = presence_of(df) if doc is None else None
    bit = held.bit(tuple(split_path(path))) if held is not None else None
    if bit is not None:
        return bit
    ref = resolve(df, path, doc)
    if ref.missing:
        return F.lit(False)
    return ref.column.isNotNull()
