"""Widget and message payloads (K2-K5, K7).

Each sink of the reference turns a document into the body of an HTTP post.
Here the bodies are columns: one row per (document, widget) with the typed
values and the JSON ``payload``, ready for ``push_sink`` or for a table.
``to_json`` leaves out null fields, as the reference's serializer does.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docweave.functions import paths as P


@dataclass(frozen=True)
class Widget:
    """One configured bar or box: a label, a widget id and the document field."""

    label: str
    id: str
    field: str


def _widgets(items) -> list[Widget]:
    out = []
    for it in items:
        if isinstance(it, Widget):
            out.append(it)
        elif isinstance(it, dict):
            out.append(Widget(str(it["label"]), str(it["id"]), str(it["field"])))
        else:
            label, wid, field = it
            out.append(Widget(str(label), str(wid), str(field)))
    return out


def _value(df: DataFrame, path: str, doc: str | None, literal: bool = False) -> Column:
    ref = P.resolve(df, path, doc, literal=literal)
    if ref.is_variant:
        return F.when(P.v_present(ref.column), ref.column)
    return ref.column


def _unpivot(df: DataFrame, widgets: list[Widget], doc: str | None,
             keep: Sequence[str]) -> DataFrame:
    keep = [k for k in keep if k in df.columns]
    vals = []
    for w in widgets:
        v = _value(df, w.field, doc, literal=True)  # top-level field, dots literal
        vals.append(F.struct(F.lit(w.id).alias("widget_id"), F.lit(w.label).alias("label"),
                             _as_text(df, v).alias("value"),
                             F.to_json(F.struct(v.alias("value"))).alias("payload")))
    rows = df.select(*[F.col(k) for k in keep], F.explode(F.array(*vals)).alias("__w"))
    return rows.select(*keep, "__w.*")


def _as_text(df: DataFrame, value: Column) -> Column:
    """The value's text (JSON text of objects and arrays); the payload holds the value itself."""
    dtype = df.select(value.alias("v")).schema["v"].dataType
    if isinstance(dtype, T.VariantType):
        return P.v_java_text(value)
    if isinstance(dtype, (T.StructType, T.ArrayType, T.MapType)):
        return F.to_json(value)
    return value.cast("string")


def bars_payload(df: DataFrame, bars, doc: str | None = None,
                 keep: Sequence[str] = ()) -> DataFrame:
    """One row per document and bar: ``(widget_id, label, value, payload)`` (K2).

    The payload holds the field's JSON value as it is: a string, a number, a
    boolean, an object or an array; a null or missing field gives ``{}``.
    ``value`` is its text.  Every configured bar is posted (the reference's "keep five" has no effect).
    """
    return _unpivot(df, _widgets(bars), doc, keep)


def boxes_payload(df: DataFrame, boxes, doc: str | None = None,
                  keep: Sequence[str] = ()) -> DataFrame:
    """As ``bars_payload``; the widget takes three or four boxes (K3)."""
    ws = _widgets(boxes)
    # The box widget takes three or four boxes.
    if not 3 <= len(ws) <= 4:
        raise ValueError("there must be three or four boxes")
    return _unpivot(df, ws, doc, keep)


def map_payload(df: DataFrame, lat: str, lon: str, fields: Sequence[str] = (),
                widget_id: str = "", doc: str | None = None,
                keep: Sequence[str] = ()) -> DataFrame:
    """``{"value": {"latitude", "longitude", <fields>}}`` per document (K4)."""
    keep = [k for k in keep if k in df.columns]
    names = [f.strip() for f in fields]
    parts = [_value(df, lat, doc).alias("latitude"), _value(df, lon, doc).alias("longitude")]
    parts += [_value(df, f, doc).alias(f) for f in names]
    value = F.struct(*parts)
    out = df.select(*[F.col(k) for k in keep], F.lit(widget_id).alias("widget_id"),
                    value.alias("value"))
    return out.withColumn("payload", F.to_json(F.struct(F.col("value"))))


def _epoch_seconds(df: DataFrame, path: str, doc: str | None) -> Column:
    ref = P.resolve(df, path, doc)
    if ref.is_variant:
        return F.when(P.v_present(ref.column), ref.column)
    if isinstance(ref.data_type, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        return F.unix_timestamp(ref.column.cast("timestamp"))
    return ref.column


def _text(df: DataFrame, path: str | None, doc: str | None) -> Column | None:
    if path is None:
        return None
    ref = P.resolve(df, path, doc)
    if ref.missing:
        return None
    if ref.is_variant:
        return F.when(P.v_present(ref.column), P.v_java_text(ref.column))
    return ref.column.cast("string")


def timeline_payload(df: DataFrame, content: str | None = None, title: str | None = None,
                     image: str | None = None, timestamp: str | None = None,
                     widget_id: str = "", doc: str | None = None, now: Column | None = None,
                     keep: Sequence[str] = ()) -> DataFrame:
    """``{"timestamp", "value": {content, title, image}}`` per document (K5).

    ``timestamp`` names a field (epoch seconds; timestamps are converted);
    without it the current UTC epoch second is used (``now`` overrides, for
    tests).  A part is present only when its field exists in the document.
    """
    keep = [k for k in keep if k in df.columns]
    ts = _epoch_seconds(df, timestamp, doc) if timestamp else \
        (now if now is not None else F.unix_timestamp())
    parts = []
    for name, path in (("content", content), ("title", title), ("image", image)):
        t = _text(df, path, doc)
        parts.append((t if t is not None else F.lit(None).cast("string")).alias(name))
    out = df.select(*[F.col(k) for k in keep], F.lit(widget_id).alias("widget_id"),
                    ts.alias("timestamp"), F.struct(*parts).alias("value"))
    return out.withColumn("payload", F.to_json(F.struct("timestamp", "value")))


def message_payload(df: DataFrame, field: str, prefix: str = "", doc: str | None = None,
                    keep: Sequence[str] = ()) -> DataFrame:
    """Status text ``prefix + " " + field`` per document (K7); a null field prints ``null``."""
    keep = [k for k in keep if k in df.columns]
    t = _text(df, field, doc)
    t = F.coalesce(t, F.lit("null")) if t is not None else F.lit("null")
    return df.select(*[F.col(k) for k in keep],
                     F.concat(F.lit(prefix), F.lit(" "), t).alias("message"))
