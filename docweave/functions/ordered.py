"""Documents in their own key order.

A VARIANT value keeps the keys of an object sorted and a number such as
``2.0`` as a decimal without digits behind the point, so neither the order of
a document's keys nor the text of its numbers survives it.  The operators
work on the VARIANT column all the same; what they cannot carry is taken from
the document's text, which stays beside it (``parse_documents(keep_raw=True)``)
and is read again once, when the document is printed:

* keys that the text has come in its order, new keys behind them;
* a number that is the same as in the text prints as the reference prints the
  one of the text (``2.0`` in arrays of arrays, integers of any length);
* an object or array that was moved to another place is found by its content,
  so it keeps the order of its own keys as well.

The order of an object's keys cannot be seen by built-in functions below a
fixed depth, so this is one Arrow UDF per print: narrow, without a depth limit.
"""

from __future__ import annotations

import json
import sys
from collections.abc import Callable, Iterator
from decimal import Decimal

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_ABSENT = object()
_FRAMES = 12_000  # JSON nests at most 1,000 deep


def _integer(digits: str) -> int | float:
    return int(digits) if len(digits) < 4000 else float(digits)


def _parsed(text: str | None):
    try:
        return _ABSENT if text is None else json.loads(text, parse_int=_integer)
    except ValueError:
        return _ABSENT


def double_text(x: float) -> str:
    """A double as Java prints it: ``2.0``, ``1.0E-4``, ``1.0E7``."""
    if x != x or x in (float("inf"), float("-inf")):
        return "NaN" if x != x else "Infinity" if x > 0 else "-Infinity"
    if x == 0 or 1e-3 <= abs(x) < 1e7:
        return repr(x)
    exact = Decimal(repr(x)).normalize()
    first, *rest = exact.as_tuple().digits
    return f"{'-' if x < 0 else ''}{first}.{''.join(map(str, rest)) or '0'}E{exact.adjusted()}"


def _is_number(x) -> bool:
    return isinstance(x, (int, float)) and not isinstance(x, bool)


def _same_number(a, b) -> bool:
    try:
        return a == b or float(a) == float(b)
    except OverflowError:
        return False


def _content(value) -> str:
    """Equal for equal objects and arrays, whatever the order of keys and the text of numbers."""
    def plain(v):
        if isinstance(v, dict):
            return {k: plain(x) for k, x in v.items()}
        if isinstance(v, list):
            return [plain(x) for x in v]
        if _is_number(v):
            try:
                return float(v)
            except OverflowError:
                return v
        return v
    return json.dumps(plain(value), sort_keys=True)


def _containers(value) -> Iterator:
    todo = [value]
    while todo:
        v = todo.pop()
        if isinstance(v, (dict, list)):
            yield v
            todo.extend(v.values() if isinstance(v, dict) else v)


def arranged(value, text):
    """``value`` with the key order and the numbers of ``text`` (both parsed)."""
    places: dict[str, object] = {}

    def moved(v):
        if not places and text is not _ABSENT:
            for c in _containers(text):
                places.setdefault(_content(c), c)
        return places.get(_content(v), _ABSENT)

    def place(v, like):
        if isinstance(v, dict):
            if not isinstance(like, dict) and v:
                like = moved(v)
            known = like if isinstance(like, dict) else {}
            out = {k: place(v[k], known[k]) for k in known if k in v}
            out.update((k, place(x, _ABSENT)) for k, x in v.items() if k not in known)
            return out
        if isinstance(v, list):
            if not isinstance(like, list) and v:
                like = moved(v)
            if isinstance(like, list) and len(like) == len(v):
                return [place(x, y) for x, y in zip(v, like)]
            return [place(x, _ABSENT) for x in v]
        if _is_number(v) and _is_number(like) and _same_number(v, like):
            return like
        return v

    return place(value, text)


def flattened(value: dict, sep: str) -> dict:
    """Leaves by their joined paths.  Of equal keys the last one in the document wins, at the
    place of the first, as in a linked map; an empty object has no leaf."""
    out: dict = {}

    def go(v: dict, prefix: str) -> None:
        for k, x in v.items():
            if isinstance(x, dict):
                go(x, prefix + k + sep)
            else:
                out[prefix + k] = x

    go(value, "")
    return out


def json_text(value) -> str:
    parts: list[str] = []

    def go(v) -> None:
        if isinstance(v, dict):
            before = "{"
            for k, x in v.items():
                parts.append(before + json.dumps(k, ensure_ascii=False) + ":")
                go(x)
                before = ","
            parts.append("}" if v else "{}")
        elif isinstance(v, list):
            before = "["
            for x in v:
                parts.append(before)
                go(x)
                before = ","
            parts.append("]" if v else "[]")
        elif isinstance(v, float):
            parts.append(double_text(v))
        elif _is_number(v):
            parts.append(str(v))
        else:
            parts.append(json.dumps(v, ensure_ascii=False))

    go(value)
    return "".join(parts)


def _each(fn: Callable[[str, str | None], str | None]):
    @F.arrow_udf("string")
    def run(doc: pa.Array, text: pa.Array) -> pa.Array:
        before = sys.getrecursionlimit()
        sys.setrecursionlimit(max(before, _FRAMES))
        try:
            return pa.array([None if d is None else fn(d, t)
                             for d, t in zip(doc.to_pylist(), text.to_pylist())], pa.string())
        finally:
            sys.setrecursionlimit(before)
    return run


def in_text_order(printed: Column, text: Column, flatten: str | None = None) -> Column:
    """JSON text ``printed`` with the key order and number texts of JSON text ``text``.

    NULL stays NULL.  A ``text`` that is NULL, malformed or of another document
    only loses its say: the keys stay in the order of ``printed``.  With a
    separator ``flatten``, nested objects of the result are flattened as well.
    """
    def run(d: str, t: str | None) -> str:
        value = _parsed(d)
        if value is _ABSENT:
            return d
        value = arranged(value, _parsed(t))
        if flatten is not None and isinstance(value, dict):
            value = flattened(value, flatten)
        return json_text(value)
    return _each(run)(printed, text)


def print_in_order(df: DataFrame, printed: Column, text: str, flatten: str | None = None) -> DataFrame:
    """Replace the column ``text`` by ``in_text_order(printed, text)``.

    ``printed`` is made below a one-row ``explode``: Spark does not take a
    Python function out of a projection if nested lambdas are in its arguments.
    """
    made = "__docweave_printed"
    return df.withColumn(made, F.explode(F.array(printed))) \
        .withColumn(text, in_text_order(F.col(made), F.col(f"`{text}`"), flatten)).drop(made)
