"""Which fields of a typed document are there.

A typed column is NULL both for a field that holds JSON null and for one the
document does not have.  A *presence column* keeps the difference: a bitmap
(``array<bigint>``, ``BITS`` bits a word) with one bit per field path of the
document, set where the document has the field.  The paths belong to the
column's metadata, so they are known when the plan is built, survive selects,
joins and Parquet files, and a test is one shift of one word.

``typed_from_documents(presence=True)`` makes the column.  ``add_field``,
``remove_field`` and ``rename_field`` keep it up to date, ``has_field`` reads
it, and ``as_documents`` and ``to_envelope`` leave missing fields out.
Everything stays in the JVM, and nothing is shuffled.
"""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

NAME = "__present"
MARK = "docweave.paths"
#: Bits of a word: the sign bit stays free.
BITS = 63

Path = tuple[str, ...]


def _q(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


@dataclass(frozen=True)
class Presence:
    """The presence column ``name``; ``paths[i]`` is the path of bit ``i``, () of a free bit."""

    name: str
    paths: tuple[Path, ...]

    def bit(self, path: Path) -> Column | None:
        """Has the document the field at ``path``?  None for a path without a bit."""
        if path not in self.paths:
            return None
        word, shift = divmod(self.paths.index(path), BITS)
        return F.shiftright(F.col(_q(self.name))[word], shift).bitwiseAND(F.lit(1).cast("bigint")) == 1


def presence_of(df: DataFrame) -> Presence | None:
    """The presence column of ``df``, if it has one."""
    for f in df.schema.fields:
        if MARK in (f.metadata or {}):
            return Presence(f.name, tuple(tuple(p) for p in json.loads(f.metadata[MARK])))
    return None


def field_paths(schema: T.StructType, above: Path = ()) -> list[Path]:
    """Every field of the schema, and of structs in it, parents first."""
    out: list[Path] = []
    for f in schema.fields:
        out.append((*above, f.name))
        if isinstance(f.dataType, T.StructType):
            out += field_paths(f.dataType, (*above, f.name))
    return out


def bitmap(tests: list[tuple[Path, Column]], name: str = NAME) -> Column:
    """The presence column from a test per path (true: the field is there)."""
    words = []
    for start in range(0, max(len(tests), 1), BITS):
        word = F.lit(0).cast("bigint")
        for shift, (_, test) in enumerate(tests[start:start + BITS]):
            word = word.bitwiseOR(F.when(test, F.lit(1 << shift).cast("bigint")).otherwise(F.lit(0).cast("bigint")))
        words.append(word)
    return F.array(*words).alias(name, metadata={MARK: json.dumps([list(p) for p, _ in tests])})


def _replaced(df: DataFrame, held: Presence, tests: list[tuple[Path, Column]]) -> DataFrame:
    return df.select(*[bitmap(tests, c) if c == held.name else F.col(_q(c)) for c in df.columns])


def _with_set(held: Presence, kept: list[tuple[Path, Column]], path: Path) -> list[tuple[Path, Column]]:
    """``kept`` with ``path`` and its parents there."""
    there = [path[:i] for i in range(1, len(path) + 1)]
    return [(p, test) for p, test in kept if p not in there] + [(p, F.lit(True)) for p in there]


def _tests(held: Presence) -> list[tuple[Path, Column]]:
    return [(p, held.bit(p)) for p in held.paths if p]


def after_add(df: DataFrame, path: list[str], set_where: Column | None = None) -> DataFrame:
    """``df``, to which the field at ``path`` was added, with the bits that say so.

    ``set_where``: rows elsewhere keep the bits they had.
    """
    held = presence_of(df)
    if held is None:
        return df
    at = tuple(path)
    below = _struct_below(df.schema, at)
    kept = [(p, t) for p, t in _tests(held) if p[:len(at)] != at]
    new = _with_set(held, kept, at)
    if below is not None:
        value = _column(at)
        new += [(p, value.isNotNull()) for p in field_paths(below, at) if len(p) == len(at) + 1]
        new += [(p, _column(p[:-1]).isNotNull()) for p in field_paths(below, at) if len(p) > len(at) + 1]
    if set_where is not None:
        old = dict(_tests(held))
        new = [(p, F.when(set_where, t).otherwise(old.get(p, F.lit(False)))) for p, t in new]
    return _replaced(df, held, new)


def after_remove(df: DataFrame, path: list[str]) -> DataFrame:
    """``df``, from which the field at ``path`` was removed, with its bits dropped."""
    held = presence_of(df)
    if held is None:
        return df
    at = tuple(path)
    return _replaced(df, held, [(p, t) for p, t in _tests(held) if p[:len(at)] != at])


def after_rename(df: DataFrame, find: list[str], replace: list[str]) -> DataFrame:
    """``df``, whose field at ``find`` was moved to ``replace``, with the bits of both."""
    held = presence_of(df)
    if held is None:
        return df
    old, new = tuple(find), tuple(replace)
    kept: list[tuple[Path, Column]] = []
    moved: list[tuple[Path, Column]] = []
    for p, test in _tests(held):
        if p[:len(old)] == old:
            moved.append(((*new, *p[len(old):]), test))
        else:
            kept.append((p, test))
    kept = [(p, t) for p, t in kept if p[:len(new)] != new] + moved
    return _replaced(df, held, _with_set(held, kept, new))


def refuse(df: DataFrame, operator: str) -> None:
    """Operators that rebuild whole documents work on VARIANT where presence matters."""
    if presence_of(df) is not None:
        raise ValueError(f"{operator} of typed columns cannot keep their presence column: "
                         "use as_documents(df) and doc=, or drop the column first")


def _column(path: Path) -> Column:
    out = F.col(_q(path[0]))
    for p in path[1:]:
        out = out.getField(p)
    return out


def _struct_below(schema: T.StructType, path: Path) -> T.StructType | None:
    kind: T.DataType = schema
    for p in path:
        fields = {f.name: f.dataType for f in kind.fields} if isinstance(kind, T.StructType) else {}
        kind = fields.get(p)
    return kind if isinstance(kind, T.StructType) else None


def document_of(df: DataFrame, skip: tuple[str, ...]) -> Column:
    """The VARIANT document of the typed columns but ``skip``: null fields stay, missing ones are left out."""
    held = presence_of(df)
    json_null = F.parse_json(F.lit("null"))

    def value(col: Column, kind: T.DataType, path: Path) -> Column:
        if isinstance(kind, T.StructType):
            return F.when(col.isNull(), json_null).otherwise(entries(kind, path))
        if isinstance(kind, (T.MapType, T.ArrayType)):
            return F.coalesce(F.to_variant_object(col), json_null)
        return F.coalesce(col if isinstance(kind, T.VariantType) else col.cast("variant"), json_null)

    def entries(kind: T.StructType, above: Path) -> Column:
        rows = []
        for f in kind.fields:
            path = (*above, f.name)
            if not above and f.name in skip:
                continue
            entry = F.struct(F.lit(f.name).alias("key"), value(_column(path), f.dataType, path).alias("value"))
            bit = held.bit(path) if held is not None else None
            rows.append(entry if bit is None else F.when(bit, entry))
        if not rows:
            return F.to_variant_object(F.create_map().cast("map<string,variant>"))
        return F.to_variant_object(F.map_from_entries(F.array_compact(F.array(*rows))))

    skip = (*skip, held.name) if held is not None else skip
    return entries(df.schema, ())
