"""Document reshaping: rename, flatten, trim, add / remove / set fields.

Typed mode (``doc=None``) works on the DataFrame's columns: every operator is
one ``select`` / ``withColumn`` computed from the schema when the plan is
built, so Catalyst prunes and fuses it with the scan.  VARIANT mode
(``doc="name"``) edits a ``VARIANT`` column through ``map<string,variant>``
and ``to_variant_object``.  Flatten, trim and prune work at any depth: the
plan holds a number of nested lambdas (``LEVELS`` or ``STEP``), of which a row
runs as many as it has levels, so its work is linear in its entries.  A document
that is deeper becomes its array of leaves (path and value), ``STEP`` levels per
round, and is rebuilt from them level by level.

Semantics kept from the reference:

* rename of a missing field creates the target with null;
* flatten joins keys with a one-character separator (not ``.``); arrays and
  nulls are leaves; empty objects vanish; on a key collision the last wins;
* trim ``allows`` keeps only the listed *leaf* paths (naming a parent keeps
  nothing), ``delete`` drops them; afterwards every empty object is removed,
  bottom-up, and the root may end up ``{}``.

Deviation: flatten names every key by its full path (``a_d`` for
``{"a":{"d":2}}`` also after a nested object); the reference resets the
prefix after the first nested object it meets.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docweave.functions import paths as P
from docweave.functions.ordered import print_in_order
from docweave.functions.presence import after_add, after_remove, after_rename, refuse

VMAP = "map<string,variant>"
#: Levels of objects that a trim goes down in one expression.
LEVELS = 14
#: Levels that one round of the others goes down: every level of nested lambdas costs the analyser time.
STEP = 5
LEAVES = "array<struct<path:array<string>,value:variant>>"


# --- helpers -------------------------------------------------------------------

def _q(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def _field(st: T.StructType, name: str) -> T.StructField | None:
    for f in st.fields:
        if f.name == name:
            return f
    return None


def _null_struct(st: T.StructType) -> Column:
    return F.struct(*[F.lit(None).cast(f.dataType).alias(f.name) for f in st.fields])


def _to_variant(df: DataFrame, value: Column) -> Column:
    dtype = df.select(value.alias("v")).schema["v"].dataType
    if isinstance(dtype, T.VariantType):
        return value
    if isinstance(dtype, (T.StructType, T.MapType, T.ArrayType)):
        return F.to_variant_object(value)
    if isinstance(dtype, T.NullType):
        return F.parse_json(F.lit("null"))
    return value.cast("variant")


def _vmap(v: Column) -> Column:
    """Object as ``map<string,variant>``; NULL when ``v`` is not an object."""
    return F.try_variant_get(v, "$", VMAP)


def _empty_vmap() -> Column:
    return F.create_map().cast(VMAP)


def _json_null() -> Column:
    return F.parse_json(F.lit("null"))


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often ``body`` uses it."""
    return F.transform(F.array(value), body)[0]


def _opens(value: Column, keep_empty: bool) -> Column:
    """Is it an object to go into?  With ``keep_empty`` an empty one is a leaf."""
    return F.size(F.coalesce(_vmap(value), _empty_vmap())) > 0 if keep_empty else P.v_is_object(value)


def v_deeper(v: Column, levels: int) -> Column:
    """Does the object nest objects more than ``levels`` levels deep (itself included)?"""
    if not levels:
        return F.lit(True)
    return F.exists(F.map_values(_vmap(v)), lambda x: P.v_is_object(x) & v_deeper(x, levels - 1))


def _leaves_of(v: Column, prefix: Column, keep_empty: bool, levels: int) -> Column:
    """Leaves of an object; objects ``levels`` levels below count as leaves."""
    def entry(e: Column) -> Column:
        path = F.array_append(prefix, e["key"])
        leaf = F.array(F.struct(path.alias("path"), e["value"].alias("value"))).cast(LEAVES)
        if levels == 1:
            return leaf
        return F.when(_opens(e["value"], keep_empty), _leaves_of(e["value"], path, keep_empty, levels - 1)).otherwise(leaf)

    return F.flatten(F.transform(F.map_entries(_vmap(v)), entry))


def v_leaves(doc: Column, keep_empty: bool = False, step: int = STEP) -> Column:
    """Every leaf of an object as (path, value), at any depth.

    An empty object has none, or is one itself with ``keep_empty``.  Arrays,
    JSON nulls and scalars are leaves.  Rounds of ``step`` levels go on while
    there are objects among the leaves; their number is bounded by the number
    of objects in the document, and a round that finds nothing to open is a
    look at a flag.
    """
    root = F.array().cast("array<string>")
    top = _leaves_of(doc, root, keep_empty, step)

    def state(leaves: Column) -> Column:
        return _let(leaves, lambda x: F.struct(
            F.exists(x, lambda e: _opens(e["value"], keep_empty)).alias("open"), x.alias("leaves")))

    def expand(acc: Column, _: Column) -> Column:
        opened = F.flatten(F.transform(acc["leaves"], lambda e: F.when(
            _opens(e["value"], keep_empty), _leaves_of(e["value"], e["path"], keep_empty, step)
        ).otherwise(F.array(e).cast(LEAVES))))
        return F.when(acc["open"], state(opened)).otherwise(acc)

    objects = F.size(F.split(F.schema_of_variant(doc), "OBJECT<")) - 1
    deep = F.aggregate(F.sequence(F.lit(1), objects), state(top), expand, lambda acc: acc["leaves"])
    return F.when(F.coalesce(v_deeper(doc, step), F.lit(False)), deep).otherwise(top)


def v_rebuild(leaves: Column) -> Column:
    """The object that has these leaves; the deepest objects are built first.

    The leaves of a depth are sorted by path, so that those of one parent stand
    together and are cut out: n log n for n leaves.
    """
    def close(acc: Column, depth: Column) -> Column:
        def parent_of(e: Column) -> Column:
            return F.slice(e["path"], F.lit(1), depth - 1)

        def groups(deep: Column) -> Column:
            places = F.sequence(F.lit(0), F.size(deep) - 1)
            starts = F.filter(places, lambda i: (i == 0) | (parent_of(F.get(deep, i)) != parent_of(F.get(deep, i - 1))))
            return _let(starts, lambda begins: F.zip_with(
                begins, F.array_append(F.slice(begins, F.lit(2), F.size(begins)), F.size(deep)),
                lambda a, b: F.slice(deep, a + 1, b - a)))

        def parent(own: Column) -> Column:
            made = F.map_from_entries(F.transform(own, lambda e: F.struct(
                F.element_at(e["path"], -1).alias("key"), e["value"].alias("value"))))
            return F.struct(parent_of(own[0]).alias("path"), F.to_variant_object(made).alias("value"))

        here = F.filter(acc, lambda e: F.size(e["path"]) == depth)
        in_order = _let(here, lambda deep: F.transform(
            F.array_sort(F.transform(deep, lambda e, i: F.struct(e["path"].alias("path"), i.alias("i")))),
            lambda k: F.get(deep, k["i"])))
        closed = _let(in_order, lambda deep: F.when(F.size(deep) > 0, F.transform(groups(deep), parent))
                      .otherwise(F.array()).cast(LEAVES))
        return F.concat(F.filter(acc, lambda e: F.size(e["path"]) < depth), closed)

    deepest = F.array_max(F.transform(leaves, lambda e: F.size(e["path"])))
    rounds = F.when(deepest > 1, F.sequence(deepest, F.lit(2), F.lit(-1))).otherwise(F.array().cast("array<int>"))
    top = F.aggregate(rounds, leaves, close)
    return F.to_variant_object(F.map_from_entries(F.transform(
        top, lambda e: F.struct(e["path"][0].alias("key"), e["value"].alias("value")))))


def _with_leaves(v: Column, edit: Callable[[Column], Column], levels: int) -> Column:
    """An object with its leaves edited; empty objects stay."""
    def value(x: Column) -> Column:
        if levels == 1:
            return edit(x)
        return F.when(P.v_is_object(x), _with_leaves(x, edit, levels - 1)).otherwise(edit(x))

    return F.to_variant_object(F.transform_values(_vmap(v), lambda _, x: value(x)))


def v_with_doubles(doc: Column) -> Column:
    """The document with numbers such as ``2.0`` as doubles, so that they print as ``2.0``.

    VARIANT keeps them as decimals without digits behind the point, which
    print like integers.  Numbers in objects at any depth and in arrays there
    are seen, not those in arrays of arrays.  Integers of any size stay.
    """
    whole = r"DECIMAL\(([1-9]|1[0-8]), ?0\)"

    def fixed(v: Column) -> Column:
        return F.when(P.vtype(v).rlike("^" + whole), P.v_double(v).cast("variant")).otherwise(v)

    def edited(v: Column) -> Column:
        many = F.try_variant_get(v, "$", "array<variant>")
        return F.when(many.isNotNull(), F.to_variant_object(F.transform(many, fixed))).otherwise(fixed(v))

    def by_leaves(v: Column) -> Column:
        return v_rebuild(F.transform(v_leaves(v, keep_empty=True, step=1), lambda e: F.struct(
            e["path"].alias("path"), edited(e["value"]).alias("value"))).cast(LEAVES))

    rebuilt = F.when(v_deeper(doc, 2), by_leaves(doc)).otherwise(_with_leaves(doc, edited, 2))
    return F.when(P.v_is_object(doc) & P.vtype(doc).rlike(whole), rebuilt).otherwise(doc)


def _check_sep(sep: str) -> str:
    if not isinstance(sep, str) or len(sep) != 1 or sep == ".":
        raise ValueError(f"separator must be one character other than '.', got {sep!r}")
    return sep


# --- set / add (P7, P8, P12) ------------------------------------------------------

def _typed_set(df: DataFrame, col: Column, dtype: T.DataType, rest: list[str], value: Column) -> Column:
    """``col`` with ``value`` at the path ``rest`` inside it; siblings stay, whatever holds them."""
    name = rest[0]
    if isinstance(dtype, T.VariantType):
        return _v_set(col, rest, _to_variant(df, value))
    if isinstance(dtype, T.MapType) and isinstance(dtype.keyType, T.StringType):
        old = F.coalesce(col, F.create_map().cast(dtype))
        if len(rest) > 1:
            new = _typed_set(df, F.try_element_at(old, F.lit(name)), dtype.valueType, rest[1:], value)
        elif isinstance(dtype.valueType, T.VariantType):
            new = _to_variant(df, value)
        else:
            new = value.cast(dtype.valueType)
        kept = F.map_filter(old, lambda k, v: k != F.lit(name))
        return F.map_concat(kept, F.create_map(F.lit(name), new))
    if not isinstance(dtype, T.StructType):
        return _nested(rest, value)  # a value that is no object gives way to one
    base = F.when(col.isNull(), _null_struct(dtype)).otherwise(col) if dtype.fields else col
    f = _field(dtype, name)
    if len(rest) == 1:
        return base.withField(_q(name), value)
    inner = _nested(rest[1:], value) if f is None else \
        _typed_set(df, col.getField(name), f.dataType, rest[1:], value)
    return base.withField(_q(name), inner)


def _nested(parts: list[str], value: Column) -> Column:
    out = value
    for p in reversed(parts):
        out = F.struct(out.alias(p))
    return out


def _v_set(obj: Column, parts: list[str], value_v: Column) -> Column:
    m = F.coalesce(_vmap(obj), _empty_vmap())
    key = parts[0]
    if len(parts) == 1:
        new_val = value_v
    else:
        child = F.try_variant_get(obj, P.variant_path([key]), "variant")
        new_val = _v_set(child, parts[1:], value_v)
    kept = F.map_filter(m, lambda k, v: k != F.lit(key))
    return F.to_variant_object(F.map_concat(kept, F.create_map(F.lit(key), new_val)))


def add_field(df: DataFrame, path: str, value, doc: str | None = None,
              skip_null: bool = False) -> DataFrame:
    """Add or overwrite the field at ``path``; missing parents are created.

    ``skip_null=True`` leaves a document as it was where the value is NULL:
    an existing value stays, and VARIANT documents get no JSON null.
    """
    parts = P.split_path(path)
    value = value if isinstance(value, Column) else F.lit(value)
    if doc is not None:
        edited = _v_set(F.col(doc), parts, _to_variant(df, value))
        if skip_null:
            edited = F.when(value.isNull(), F.col(doc)).otherwise(edited)
        return df.withColumn(doc, edited)
    return after_add(_add_typed(df, path, parts, value, skip_null), parts,
                     value.isNotNull() if skip_null else None)


def _add_typed(df: DataFrame, path: str, parts: list[str], value: Column, skip_null: bool = False) -> DataFrame:
    top = _field(df.schema, parts[0])
    if skip_null:
        old = P.resolve_typed(df.schema, path)
        if not old.missing:
            value = F.coalesce(_to_variant(df, value) if old.is_variant else value, old.column)
    if len(parts) == 1:
        new = value
    elif top is None:
        new = _nested(parts[1:], value)
    else:
        new = _typed_set(df, F.col(_q(parts[0])), top.dataType, parts[1:], value)
    return _put(df, parts[0], new)


def _put(df: DataFrame, name: str, value: Column) -> DataFrame:
    """The column ``name`` replaced or appended; names that differ in case are different."""
    if name not in df.columns:
        return df.select(*[F.col(_q(c)) for c in df.columns], value.alias(name))
    return df.select(*[value.alias(c) if c == name else F.col(_q(c)) for c in df.columns])


def set_doc(df: DataFrame, value: Column, doc: str = "doc") -> DataFrame:
    """Replace the whole document."""
    return df.withColumn(doc, value)


# --- remove (P10) ----------------------------------------------------------------------

def _typed_remove(col: Column, dtype: T.DataType, rest: list[str]) -> Column | None:
    """New value of ``col`` with ``rest`` removed; None when nothing changes."""
    name = rest[0]
    if isinstance(dtype, T.VariantType):
        return _v_remove(col, rest)
    if isinstance(dtype, T.MapType) and isinstance(dtype.keyType, T.StringType):
        if len(rest) == 1:
            return F.map_filter(col, lambda k, v: k != F.lit(name))
        # the values of a map share one type: a struct's field is emptied, not dropped
        if _emptied(F.lit(None), dtype.valueType, rest[1:]) is None:
            return None
        return F.transform_values(col, lambda k, v: F.when(
            k == F.lit(name), _emptied(v, dtype.valueType, rest[1:])).otherwise(v))
    f = _field(dtype, name) if isinstance(dtype, T.StructType) else None
    if f is None:
        return None
    if len(rest) == 1:
        if len(dtype.fields) == 1:  # parent stays, as an empty object
            return F.when(col.isNull(), F.lit(None)).otherwise(F.struct())
        return col.dropFields(_q(name))
    inner = _typed_remove(col.getField(name), f.dataType, rest[1:])
    return None if inner is None else col.withField(_q(name), inner)


def _emptied(col: Column, dtype: T.DataType, rest: list[str]) -> Column | None:
    """As ``_typed_remove``, but a struct keeps its type: the field becomes null."""
    if not isinstance(dtype, T.StructType):
        return _typed_remove(col, dtype, rest)
    f = _field(dtype, rest[0])
    if f is None:
        return None
    inner = F.lit(None).cast(f.dataType) if len(rest) == 1 else \
        _emptied(col.getField(rest[0]), f.dataType, rest[1:])
    return None if inner is None else F.when(col.isNotNull(), col.withField(_q(rest[0]), inner))


def _v_remove(obj: Column, parts: list[str]) -> Column:
    m = _vmap(obj)
    key = parts[0]
    if len(parts) == 1:
        edited = F.map_filter(m, lambda k, v: k != F.lit(key))
    else:
        edited = F.transform_values(
            m, lambda k, v: F.when(k == F.lit(key), _v_remove(v, parts[1:])).otherwise(v))
    return F.when(m.isNull(), obj).otherwise(F.to_variant_object(edited))


def remove_field(df: DataFrame, path: str, doc: str | None = None,
                 also_literal: bool = False) -> DataFrame:
    """Remove the field at ``path``; parents stay, even when they become empty.

    ``also_literal=True`` also drops a top-level key spelled exactly like the
    dotted path (the source and sink flavour of the reference's remove).
    """
    parts = P.split_path(path)
    if also_literal and len(parts) > 1:
        if doc is not None:
            df = df.withColumn(doc, _v_remove(F.col(doc), [path]))
        else:
            df = after_remove(_without(df, path), [path])
    if doc is not None:
        return df.withColumn(doc, _v_remove(F.col(doc), parts))
    return after_remove(_remove_typed(df, parts), parts)


def _remove_typed(df: DataFrame, parts: list[str]) -> DataFrame:
    top = _field(df.schema, parts[0])
    if top is None:
        return df
    if len(parts) == 1:
        return _without(df, parts[0])
    new = _typed_remove(F.col(_q(parts[0])), top.dataType, parts[1:])
    return df if new is None else _put(df, parts[0], new)


def _without(df: DataFrame, name: str) -> DataFrame:
    return df.select(*[F.col(_q(c)) for c in df.columns if c != name]) if name in df.columns else df


# --- rename (P1) -----------------------------------------------------------------------

def _entity(df: DataFrame, entity: str | None) -> DataFrame:
    return df if entity is None else df.withColumn("entity", F.lit(entity))


def rename_field(df: DataFrame, find: str, replace: str, doc: str | None = None,
                 entity: str | None = None) -> DataFrame:
    """Move the value at ``find`` to ``replace`` (both may be dotted paths).

    A missing ``find`` creates ``replace`` with null; an existing ``replace``
    is overwritten.  ``entity`` overrides the record type.
    """
    if entity is not None:
        return _entity(rename_field(df, find, replace, doc), entity)
    if find == replace:
        return df
    if doc is None:
        return after_rename(_rename_typed(df, find, replace), P.split_path(find), P.split_path(replace))
    value = F.coalesce(P.resolve_variant(doc, find).column, _json_null())
    tmp = "__moved_value"
    staged = df.withColumn(tmp, value) \
        .withColumn(doc, _v_remove(F.col(doc), P.split_path(find)))
    return staged.withColumn(doc, _v_set(F.col(doc), P.split_path(replace), F.col(tmp))) \
        .drop(tmp)


def _rename_typed(df: DataFrame, find: str, replace: str) -> DataFrame:
    ref = P.resolve_typed(df.schema, find)
    fparts, rparts = P.split_path(find), P.split_path(replace)
    if len(fparts) == 1 and len(rparts) == 1:
        if ref.missing:
            return _put(df, replace, F.lit(None).cast("string"))
        cols = [c for c in df.columns if c != replace]
        return df.select(*[F.col(_q(c)).alias(replace) if c == find else F.col(_q(c))
                           for c in cols])
    tmp = "__docweave_moved"
    value = F.lit(None).cast("string") if ref.missing else ref.column
    out = _remove_typed(df.withColumn(tmp, value), fparts)
    return _add_typed(out, replace, rparts, F.col(tmp)).drop(tmp)


# --- flatten (P2, P3) -----------------------------------------------------------------

def _typed_leaves(st: T.StructType, prefix: list[str]) -> Iterable[tuple[list[str], T.DataType]]:
    for f in st.fields:
        path = prefix + [f.name]
        if isinstance(f.dataType, T.StructType):
            yield from _typed_leaves(f.dataType, path)
        else:
            yield path, f.dataType


def _path_col(parts: list[str]) -> Column:
    col = F.col(_q(parts[0]))
    for p in parts[1:]:
        col = col.getField(p)
    return col


def flatten_columns(schema: T.StructType, sep: str = "_") -> list[Column]:
    """The ``select`` list that flattens a typed document.

    Paths that give the same key share a column: the last one that has a value
    wins, as in a document, where the others may be absent.  Their texts are
    used if their types differ.
    """
    _check_sep(sep)
    out: dict[str, list[tuple[Column, T.DataType]]] = {}
    for parts, dtype in _typed_leaves(schema, []):
        out.setdefault(sep.join(parts), []).append((_path_col(parts), dtype))
    columns = []
    for name, found in out.items():
        same = len({d.simpleString() for _, d in found}) == 1
        values = [c if same else c.cast("string") for c, _ in reversed(found)]
        columns.append((values[0] if len(values) == 1 else F.coalesce(*values)).alias(name))
    return columns


def flatten_doc(df: DataFrame, sep: str = "_", doc: str | None = None,
                keep: Iterable[str] = (), entity: str | None = None,
                order: str | None = None) -> DataFrame:
    """Flatten nested objects, however deep, into one level joined by ``sep``.

    Typed mode flattens all columns except those in ``keep`` (e.g. ``entity``),
    which pass through unchanged.  ``entity`` overrides the record type.  In
    VARIANT mode the last of colliding keys wins by the session's
    ``spark.sql.mapKeyDedupPolicy`` (``docweave.session.configure`` sets it).

    VARIANT keys are sorted, so there "last" means in key order.  With
    ``order``, the column of the document's text, it means in the document, and
    the column becomes the text of the flat document, in that order.
    """
    _check_sep(sep)
    if order is not None and doc is None:
        raise ValueError("order needs a VARIANT document")
    if entity is not None:
        return _entity(flatten_doc(df, sep, doc, keep, order=order), entity)
    if order is not None:
        printed = F.to_json(v_with_doubles(F.col(doc)))
        return print_in_order(df, printed, order, flatten=sep) \
            .withColumn(doc, F.try_parse_json(F.col(_q(order))))
    if doc is not None:
        flat = F.map_from_entries(F.transform(v_leaves(F.col(doc)), lambda e: F.struct(
            F.array_join(e["path"], sep).alias("key"), e["value"].alias("value"))))
        return df.withColumn(doc, F.when(P.v_is_object(F.col(doc)), F.to_variant_object(flat))
                             .otherwise(F.col(doc)))
    refuse(df, "flatten")
    keep = [k for k in keep if k in df.columns]
    body = T.StructType([f for f in df.schema.fields if f.name not in keep])
    return df.select(*[F.col(_q(k)) for k in keep], *flatten_columns(body, sep))


# --- trim (P4-P6) ---------------------------------------------------------------------

def _typed_rebuild(col: Column | None, st: T.StructType, prefix: list[str],
                   keep: Callable[[str], bool]) -> list[Column]:
    out = []
    for f in st.fields:
        path = prefix + [f.name]
        child = F.col(_q(f.name)) if col is None else col.getField(f.name)
        if isinstance(f.dataType, T.StructType):
            sub = _typed_rebuild(child, f.dataType, path, keep)
            if sub:
                out.append(F.when(child.isNull(), F.lit(None))
                           .otherwise(F.struct(*sub)).alias(f.name))
        elif keep(".".join(path)):
            out.append(child.alias(f.name))
    return out


def _trim_levels(v: Column, prefix: Column, fields: Column, allows: bool, levels: int) -> Column:
    """Trim an object of at most ``levels`` levels, emptied objects removed, one lambda per level."""
    def edit(k: Column, x: Column) -> Column:
        if levels == 1:
            return x
        sub = _trim_levels(x, F.concat(prefix, k, F.lit(".")), fields, allows, levels - 1)
        return F.when(P.v_is_object(x), sub).otherwise(x)

    def keep(k: Column, x: Column) -> Column:
        listed = F.array_contains(fields, F.concat(prefix, k))
        full = F.size(F.coalesce(_vmap(x), _empty_vmap())) > 0
        return F.when(P.v_is_object(x), full).otherwise(listed if allows else ~listed)

    return F.to_variant_object(F.map_filter(F.transform_values(_vmap(v), edit), keep))


def _v_trim(doc: Column, names: list[str], allows: bool) -> Column:
    """Trim an object level by level, or by its leaves if it is deeper than ``LEVELS``."""
    fields = F.array(*[F.lit(n) for n in names]).cast("array<string>")

    def stays(e: Column) -> Column:
        listed = F.array_contains(fields, F.array_join(e["path"], "."))
        return listed if allows else ~listed

    by_leaves = v_rebuild(F.filter(v_leaves(doc), stays))
    return F.when(v_deeper(doc, LEVELS), by_leaves).otherwise(
        _trim_levels(doc, F.lit(""), fields, allows, LEVELS))


def trim(df: DataFrame, fields: Iterable[str], action: str = "allows",
         doc: str | None = None, keep: Iterable[str] = (), entity: str | None = None) -> DataFrame:
    """Keep (``allows``) or drop (``delete``) the listed leaf paths, then prune empty objects.

    ``action`` other than ``delete`` (trimmed, any case) means allows.
    Typed mode passes the ``keep`` columns (e.g. ``entity``) through untouched.
    ``entity`` overrides the record type.
    """
    if entity is not None:
        return _entity(trim(df, fields, action, doc, keep), entity)
    names = [str(f).strip() for f in fields]
    allows = not (action is not None and str(action).strip().lower() == "delete")
    if doc is not None:
        trimmed = _v_trim(F.col(doc), names, allows)
        return df.withColumn(doc, F.when(P.v_is_object(F.col(doc)), trimmed)
                             .otherwise(F.col(doc)))
    refuse(df, "trim")
    listed = set(names)
    rule = (lambda p: p in listed) if allows else (lambda p: p not in listed)
    keep = [k for k in keep if k in df.columns]
    body = T.StructType([f for f in df.schema.fields if f.name not in keep])
    return df.select(*[F.col(_q(k)) for k in keep], *_typed_rebuild(None, body, [], rule))


def prune_empty(df: DataFrame, doc: str | None = None) -> DataFrame:
    """Remove every empty object, bottom-up (P6 on its own)."""
    return trim(df, [], action="delete", doc=doc)


# --- entity (P14) -------------------------------------------------------------------

def set_entity(df: DataFrame, entity: str, column: str = "entity") -> DataFrame:
    return df.withColumn(column, F.lit(entity))
