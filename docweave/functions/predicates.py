"""Conditions on document fields, built as Catalyst expressions.

Every builder returns the *positive* form of a condition: a boolean Column
that may be NULL when a value is missing.  ``where`` drops NULL rows, so the
positive form is used as is (it stays pushable to the Parquet scan); the
*total* form ``coalesce(positive, false)`` is used for complements and for
branch columns.

Type rules (the reference compares Java objects decoded from JSON):

* ``<  <=  >  >=``  compare as doubles.  Numbers and numeric strings take
  part; booleans, arrays, objects and non-numeric strings give false.
* ``==`` is true only for a JSON *string* equal to the text; the number 5 is
  not "5".  ``!=`` is its negation for a present value, so it is true for any
  present non-string.  ``coerce=True`` compares numerically instead.
* ``match``: the *field* holds a regex that must match the whole text.
  ``matches_field`` is the natural direction (text in the field).
* ``containsText``: substring of a string field.
* ``contains`` / ``notcontains``: substring of a string, or an array holding
  the text as one of its string elements.
* ``RegexExpression`` (split operators): a DOTALL regex *found* anywhere in
  the field's text.
* A missing field or JSON null makes every operator false, ``!=`` and
  ``notcontains`` included.

Where the reference throws on an unsupported type, ``on_error="false"``
(default) gives false; ``on_error="fail"`` raises when the plan is built
(typed mode) or fails the row with ``raise_error`` (VARIANT mode).
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docweave.functions import paths as P

# The operator names accepted by the reference's components.
FILTER_OPERATORS = ("<", "<=", ">", ">=", "==", "!=", "match", "containsText",
                    "contains", "notcontains")
SPLIT_OPERATORS = ("<", "<=", ">", ">=", "==", "!=", "containsText", "RegexExpression")
FIELDS_OPERATORS = ("<", "<=", ">", ">=", "==", "!=", "RegexExpression")
EXTRA_OPERATORS = ("matches_field",)

ON_ERROR = ("false", "fail")

_JAVA_DOUBLE = re.compile(r"^[+-]?(NaN|Infinity|((\d+\.?\d*|\.\d+)([eE][+-]?\d+)?)[fFdD]?)$")


@dataclass(frozen=True)
class Cond:
    """One condition ``field operator value`` (all strings, as configured)."""

    field: str
    operator: str
    value: str = ""


def java_double(text: str) -> float:
    """Parse a literal the way ``Double.parseDouble`` does (blanks, d/f suffix, hex)."""
    s = str(text).strip()
    if _JAVA_DOUBLE.match(s):
        body = s[:-1] if s[-1] in "fFdD" and not s.endswith("NaN") and not s.endswith("Infinity") else s
        if body.lstrip("+-") == "Infinity":
            return -math.inf if body.startswith("-") else math.inf
        return float(body)
    if re.match(r"^[+-]?0[xX]", s):  # hexadecimal float literal, e.g. 0x1p3
        try:
            return float.fromhex(s.rstrip("fFdD"))
        except ValueError:
            pass
    raise ValueError(f"not a number: {text!r}")


def total(positive: Column) -> Column:
    """Two-valued form: NULL counts as false."""
    return F.coalesce(positive, F.lit(False))


def _unsupported(ref: P.FieldRef, op: str, on_error: str) -> Column:
    if on_error == "fail":
        raise ValueError(f"operator {op!r} cannot be applied to {ref.kind} field {ref.path!r}")
    return F.lit(False)


def _v_fail_or_false(cond_ok: Column, ref: P.FieldRef, op: str, on_error: str) -> Column:
    """VARIANT: rows whose type the operator does not accept."""
    if on_error == "fail":
        return F.when(cond_ok | ~P.v_present(ref.column), F.lit(None).cast("boolean")) \
            .otherwise(F.raise_error(F.lit(f"operator {op} cannot be applied to field {ref.path}")))
    return F.lit(False)


# --- numeric ---------------------------------------------------------------

def as_double(ref: P.FieldRef) -> Column | None:
    """Double value of a field for numeric comparison; None if never numeric."""
    if ref.is_variant:
        # numbers and numeric strings cast to double, objects and arrays do not; booleans
        # and times would, but are not numeric
        v = ref.column
        number = P.v_double(v)
        return F.when(number.isNotNull() & ~P.vtype(v).isin(
            "BOOLEAN", "DATE", "TIMESTAMP", "TIMESTAMP_NTZ"), number)
    if ref.kind == P.NUMBER:
        return ref.column if ref.data_type.typeName() == "double" else ref.column.cast("double")
    if ref.kind == P.STRING:
        return ref.column.try_cast("double")
    return None


def _negative_zero(ref: P.FieldRef, number: Column) -> Column | None:
    """Is the field's double ``-0.0``?  None where it never is (whole and decimal numbers)."""
    if not ref.is_variant and ref.kind == P.NUMBER and ref.data_type.typeName() not in ("float", "double"):
        return None
    return (number == F.lit(0.0)) & F.startswith(number.cast("string"), F.lit("-"))


def _compare(left: Column, op: str, right: Column) -> Column:
    return {"<": left < right, "<=": left <= right, ">": left > right, ">=": left >= right}[op]


def _compare_literal(num: Column, op: str, rhs: float, negative: Column | None) -> Column:
    """Total order of doubles against a literal: ``-0.0 < 0.0``, NaN greatest.

    Spark differs for the zeros only.  The plain comparison stays a conjunct of
    its own, so that it is pushed to the scan.
    """
    plain = _compare(num, op, F.lit(rhs))
    if rhs != 0 or negative is None:
        return plain
    zero_is_negative = math.copysign(1.0, rhs) < 0
    if op in ("<", "<="):
        if zero_is_negative == (op == "<"):
            return plain  # no zero is below -0.0, every zero is up to 0.0
        return (num <= F.lit(0.0)) & ((num < F.lit(0.0)) | negative)
    if zero_is_negative == (op == ">="):
        return plain  # every zero is from -0.0 on, none is above 0.0
    return (num >= F.lit(0.0)) & ~negative


def _compare_fields(a: Column, op: str, b: Column, a_negative: Column | None, b_negative: Column | None) -> Column:
    """Total order of two doubles."""
    if op in (">", ">="):
        return _compare_fields(b, "<" if op == ">" else "<=", a, b_negative, a_negative)
    if a_negative is None and b_negative is None:
        return _compare(a, op, b)
    a_neg = F.lit(False) if a_negative is None else a_negative
    b_neg = F.lit(False) if b_negative is None else b_negative
    if op == "<":
        return (a < b) | ((a == b) & a_neg & ~b_neg)
    return (a <= b) & ~((a == b) & b_neg & ~a_neg)


def numeric(ref: P.FieldRef, op: str, value: str | float, on_error: str = "false") -> Column:
    num = as_double(ref)
    if num is None:
        return F.lit(False) if ref.missing else _unsupported(ref, op, on_error)
    rhs = value if isinstance(value, (int, float)) else java_double(value)
    out = _compare_literal(num, op, float(rhs), _negative_zero(ref, num))
    if ref.is_variant and on_error == "fail":
        # a present value that is not a number (boolean, object, "abc") fails the row
        bad = P.v_present(ref.column) & num.isNull()
        out = F.when(bad, F.raise_error(F.lit(f"operator {op}: field {ref.path} is not a number"))
                     .cast("boolean")).otherwise(out)
    return out


# --- string equality -------------------------------------------------------

def _string_value(ref: P.FieldRef) -> Column | None:
    """The field as text when it is a JSON string; None when it never is."""
    if ref.is_variant:
        return F.when(P.v_is_string(ref.column), P.v_string(ref.column))
    if ref.kind == P.STRING:
        return ref.column
    return None


def _present(ref: P.FieldRef) -> Column:
    if ref.missing:
        return F.lit(False)
    if ref.is_variant:
        return P.v_present(ref.column)
    return ref.column.isNotNull()


def equals(ref: P.FieldRef, value: str, coerce: bool = False) -> Column:
    if coerce:
        num = as_double(ref)
        try:
            rhs = java_double(value)
        except ValueError:
            rhs = None
        if num is not None and rhs is not None:
            s = _string_value(ref)
            eq_num = num == F.lit(rhs)
            return eq_num if s is None else (eq_num | (s == F.lit(value)))
    if ref.is_variant:
        # compare the text first; the type test runs only for rows whose text
        # already matches (a number 5 prints as "5" but is not the string "5")
        return (P.v_string(ref.column) == F.lit(str(value))) & P.v_is_string(ref.column)
    s = _string_value(ref)
    if s is None:
        return F.lit(False)
    return s == F.lit(str(value))


def not_equals(ref: P.FieldRef, value: str, coerce: bool = False) -> Column:
    if ref.missing:
        return F.lit(False)
    if not coerce and not ref.is_variant:
        if ref.kind == P.STRING:
            return ref.column != F.lit(str(value))  # NULL (dropped) when missing
        return ref.column.isNotNull()
    return _present(ref) & ~total(equals(ref, value, coerce))


# --- text ------------------------------------------------------------------

def full_match_pattern(pattern: Column) -> Column:
    """Anchor a regex so it must match the whole text (Java ``matches``)."""
    return F.concat(F.lit("\\A(?:"), pattern, F.lit(")\\z"))


def pattern_matches(pattern: Column, text: Column, on_error: str = "false") -> Column:
    """Does a regex that comes from the data match the whole text?

    A bad pattern gives NULL under ``on_error="false"`` and fails the row
    under ``"fail"``.
    """
    if on_error == "fail":
        return F.regexp_like(text, full_match_pattern(pattern))
    found = F.try_reflect(F.lit("java.util.regex.Pattern"), F.lit("matches"), pattern, text)
    return F.when(pattern.isNotNull() & text.isNotNull(), found == F.lit("true"))


def field_is_regex(ref: P.FieldRef, text: str, on_error: str = "false") -> Column:
    """``match``: the field's string is the pattern, ``text`` must match fully."""
    s = _string_value(ref)
    if s is None:
        return F.lit(False) if ref.missing else _unsupported(ref, "match", on_error)
    out = pattern_matches(s, F.lit(text), on_error)
    if ref.is_variant and on_error == "fail":
        out = F.coalesce(out, _v_fail_or_false(P.v_is_string(ref.column), ref, "match", on_error))
    return out


def field_matches(ref: P.FieldRef, pattern: str) -> Column:
    """``matches_field``: the field's string fully matches ``pattern``."""
    s = _string_value(ref)
    if s is None:
        return F.lit(False)
    return s.rlike(f"\\A(?:{pattern})\\z")


def contains_text(ref: P.FieldRef, value: str, on_error: str = "false") -> Column:
    s = _string_value(ref)
    if s is None:
        return F.lit(False) if ref.missing else _unsupported(ref, "containsText", on_error)
    out = F.contains(s, F.lit(value))
    if ref.is_variant and on_error == "fail":
        out = F.coalesce(out, _v_fail_or_false(P.v_is_string(ref.column), ref,
                                               "containsText", on_error))
    return out


def _array_has_string(ref: P.FieldRef, value: str) -> Column | None:
    if ref.is_variant:
        arr = F.try_variant_get(ref.column, "$", "array<variant>")
        return F.exists(arr, lambda e: P.v_is_string(e) & (P.v_string(e) == F.lit(value)))
    if ref.kind == P.ARRAY:
        et = ref.data_type.elementType
        if P.kind_of(et) == P.STRING:
            return F.coalesce(F.array_contains(ref.column, F.lit(value)), F.lit(False))
        if P.kind_of(et) == P.VARIANT:
            return F.exists(ref.column,
                            lambda e: P.v_is_string(e) & (P.v_string(e) == F.lit(value)))
        return F.lit(False)  # no element can be a string
    return None


def contains(ref: P.FieldRef, value: str, negate: bool = False,
             on_error: str = "false") -> Column:
    """``contains`` / ``notcontains`` on a string or an array of strings."""
    op = "notcontains" if negate else "contains"
    if ref.missing:
        return F.lit(False)
    if ref.is_variant:
        v = ref.column
        hit = (F.when(P.v_is_string(v), F.contains(P.v_string(v), F.lit(value)))
               .when(P.v_is_array(v), _array_has_string(ref, value)))
        ok = P.v_is_string(v) | P.v_is_array(v)
        res = (~hit) if negate else hit
        if on_error == "fail":
            return F.when(ok, res).otherwise(_v_fail_or_false(ok, ref, op, on_error))
        return P.v_present(v) & F.coalesce(res, F.lit(False))
    if ref.kind == P.STRING:
        hit = F.contains(ref.column, F.lit(value))
        return ref.column.isNotNull() & ~hit if negate else hit
    arr = _array_has_string(ref, value)
    if arr is None:
        return _unsupported(ref, op, on_error)
    return ref.column.isNotNull() & (~arr if negate else arr)


def regex_find(ref: P.FieldRef, pattern: str) -> Column:
    """``RegexExpression`` of the split: DOTALL find on the field's text."""
    if ref.missing:
        return F.lit(False)
    if ref.is_variant:
        text = F.when(P.v_present(ref.column), P.v_java_text(ref.column))
    elif ref.kind == P.STRING:
        text = ref.column
    else:
        text = ref.column.cast("string")
    return text.rlike("(?s)" + pattern)


# --- dispatch ----------------------------------------------------------------

def _check(op: str, allowed: tuple[str, ...], on_error: str) -> None:
    if op not in allowed:
        raise ValueError(f"unknown operator {op!r}; expected one of {allowed}")
    if on_error not in ON_ERROR:
        raise ValueError(f"on_error must be one of {ON_ERROR}")


def field_condition(ref: P.FieldRef, op: str, value: str, *, coerce: bool = False,
                    on_error: str = "false",
                    allowed: tuple[str, ...] = FILTER_OPERATORS + SPLIT_OPERATORS
                    + EXTRA_OPERATORS) -> Column:
    """Positive form of ``field op value`` for a resolved field."""
    _check(op, allowed, on_error)
    if op in ("<", "<=", ">", ">="):
        return numeric(ref, op, value, on_error)
    if op == "==":
        return equals(ref, value, coerce)
    if op == "!=":
        return not_equals(ref, value, coerce)
    if op == "match":
        return field_is_regex(ref, value, on_error)
    if op == "matches_field":
        return field_matches(ref, value)
    if op == "containsText":
        return contains_text(ref, value, on_error)
    if op == "contains":
        return contains(ref, value, False, on_error)
    if op == "notcontains":
        return contains(ref, value, True, on_error)
    if op == "RegexExpression":
        return regex_find(ref, value)
    raise ValueError(op)


def condition(df: DataFrame, cond: Cond, doc: str | None = None, *,
              coerce: bool = False, on_error: str = "false") -> Column:
    """Positive form of a ``Cond`` against ``df`` (typed or VARIANT ``doc``)."""
    ref = P.resolve(df, cond.field, doc)
    return field_condition(ref, cond.operator, cond.value, coerce=coerce, on_error=on_error)


def all_of(preds: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, preds) if preds else F.lit(True)


def any_of(preds: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, preds) if preds else F.lit(False)


# --- field against field -------------------------------------------------------

def fields_condition(df: DataFrame, field1: str, op: str, field2: str,
                     doc: str | None = None, coerce: bool = False) -> Column:
    """Positive form of ``field1 op field2`` on the same document.

    Numeric operators compare both fields as doubles (a present non-numeric
    value gives false).  ``==`` / ``!=`` compare strings: a present ``field1``
    and a missing or non-string ``field2`` is ``!=``.  ``RegexExpression``:
    the text of ``field1`` is a regex that must match all of ``field2``.
    """
    _check(op, FIELDS_OPERATORS, "false")
    r1 = P.resolve(df, field1, doc)
    r2 = P.resolve(df, field2, doc)
    if r1.missing:
        return F.lit(False)
    if op in ("<", "<=", ">", ">="):
        a, b = as_double(r1), as_double(r2)
        if a is None or b is None:
            return F.lit(False)
        return _compare_fields(a, op, b, _negative_zero(r1, a), _negative_zero(r2, b))
    if op in ("==", "!="):
        s1, s2 = _string_value(r1), _string_value(r2)
        if coerce:
            a, b = as_double(r1), as_double(r2)
            eq = F.lit(False) if (a is None or b is None) else total(a == b)
            if s1 is not None and s2 is not None:
                eq = eq | total(s1 == s2)
        elif s1 is None or s2 is None:
            eq = F.lit(False)
        else:
            eq = total(s1 == s2)
        present = _present(r1)
        return present & eq if op == "==" else present & ~eq
    # RegexExpression
    if r1.is_variant:
        pattern = F.when(P.v_present(r1.column), P.v_string(r1.column))
    else:
        pattern = r1.column if r1.kind == P.STRING else r1.column.cast("string")
    text = _string_value(r2)
    if text is None:
        return F.lit(False)
    return pattern_matches(pattern, text)


def exists_condition(df: DataFrame, field: str, doc: str | None = None,
                     nested: bool = False) -> Column:
    """Top-level field present and not null; ``nested=True`` reads dotted paths."""
    ref = P.resolve(df, field, doc, literal=not nested)
    return total(_present(ref))
