"""User code over documents.

The reference's user transform sees one document at a time: ``prepare`` once,
``execute`` per document emitting zero or more documents, ``cleanup`` once.
Here it runs inside ``mapInArrow``: Spark partitions the rows, each task calls
``prepare`` once, decodes Arrow batches into dicts (exact integers, ``None``
for null) and calls ``cleanup`` in ``finally``.  Output leaves in batches of at
most ``OUT_ROWS`` rows, however many a document produces.

``map_batches`` is the vectorised form (a pandas DataFrame in, one out), and
``register_flat_map`` gives the same user code to SQL as a table function.
"""

from __future__ import annotations

import datetime
import decimal
import json
import numbers
from collections.abc import Callable, Iterable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

ERROR_COL = "_error"
INPUT_COL = "_input"
ON_ERROR = ("fail", "quarantine", "skip")
OUT_ROWS = 4096


def _schema(schema: str | T.StructType, df: DataFrame) -> T.StructType:
    if isinstance(schema, T.StructType):
        return schema
    return df.sparkSession.createDataFrame([], schema).schema


def _readable(df: DataFrame) -> tuple[DataFrame, list[str]]:
    """VARIANT columns as JSON text, and their names: user code gets them decoded."""
    names = [f.name for f in df.schema.fields if isinstance(f.dataType, T.VariantType)]
    return df.select(*[F.to_json(F.col(f"`{c}`")).alias(c) if c in names else F.col(f"`{c}`")
                       for c in df.columns]), names


def _records(batch: pa.RecordBatch, variants: list[str]) -> Iterator[dict]:
    for rec in batch.to_pylist():
        for name in variants:
            if rec[name] is not None:
                rec[name] = json.loads(rec[name])
        yield rec


def _produced(batches, fn: Callable, state, with_state: bool, on_error: str, variants: list[str],
              pick: Callable[[dict], object], wrap: Callable[[object, dict], dict]) -> Iterator[dict]:
    """The dicts that user code emits; failures are raised, skipped or turned into quarantine rows."""
    for batch in batches:
        for rec in _records(batch, variants):
            try:
                out = fn(pick(rec), state) if with_state else fn(pick(rec))
                made = [wrap(x, rec) for x in out or ()]
            except Exception as exc:  # noqa: BLE001 - user code
                if on_error == "fail":
                    raise
                if on_error == "skip":
                    continue
                made = [{ERROR_COL: f"{type(exc).__name__}: {exc}",
                         INPUT_COL: json.dumps(rec, default=str, ensure_ascii=False)}]
            yield from made


def _batched(rows: Iterator[dict], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    held: list[dict] = []
    for row in rows:
        held.append(row)
        if len(held) >= OUT_ROWS:
            yield pa.RecordBatch.from_pylist(held, schema)
            held = []
    yield pa.RecordBatch.from_pylist(held, schema)


def flat_map_docs(df: DataFrame, fn: Callable[..., Iterable[dict]], schema: str | T.StructType | None = None,
                  prepare: Callable[[], object] | None = None,
                  cleanup: Callable[[object], None] | None = None,
                  on_error: str = "fail", doc: str | None = None) -> DataFrame:
    """Apply ``fn(row_dict[, state]) -> iterable of dicts`` to every row.

    With ``doc``, ``fn`` gets the decoded document of that VARIANT column and
    emits documents; the other columns go along and no schema is needed.
    ``on_error``: ``fail`` stops the job; ``quarantine`` emits one row with
    ``_error`` (the message) and ``_input`` (the failing row as JSON text), the
    other columns null; ``skip`` drops the failing row.
    """
    if on_error not in ON_ERROR:
        raise ValueError(f"on_error must be one of {ON_ERROR}")
    src, variants = _readable(df)
    if doc is not None:
        fields = list(src.schema.fields)  # the document travels as JSON text
    elif schema is None:
        raise ValueError("flat_map_docs needs a schema or doc=")
    else:
        fields = list(_schema(schema, df).fields)
    if on_error == "quarantine":
        fields += [T.StructField(n, T.StringType(), True) for n in (ERROR_COL, INPUT_COL)
                   if n not in [f.name for f in fields]]
    out_schema = T.StructType(fields)
    others = [v for v in variants if v != doc]

    def pick(rec: dict):
        return rec if doc is None else rec[doc]

    def wrap(made, rec: dict) -> dict:
        if doc is None:
            return made
        kept = {k: json.dumps(v) if k in others and v is not None else v for k, v in rec.items()}
        return {**kept, doc: json.dumps(made, ensure_ascii=False)}

    def run(batches):
        arrow = to_arrow_schema(out_schema)
        state = prepare() if prepare else None
        try:
            yield from _batched(_produced(batches, fn, state, prepare is not None, on_error, variants,
                                          pick, wrap), arrow)
        finally:
            if cleanup is not None:
                cleanup(state)

    out = src.mapInArrow(run, out_schema)
    if doc is None:
        return out
    return out.select(*[F.parse_json(F.col(f"`{c}`")).alias(c) if c in variants else F.col(f"`{c}`")
                        for c in out.columns])


def map_batches(df: DataFrame, fn: Callable[[pd.DataFrame], pd.DataFrame],
                schema: str | T.StructType) -> DataFrame:
    """Vectorised user transform: ``fn`` maps each Arrow batch (as pandas) to a frame."""
    def run(batches):
        for pdf in batches:
            yield fn(pdf)
    return df.mapInPandas(run, schema)


def map_field(df: DataFrame, field: str, save_to: str, fn: Callable[[pd.Series], pd.Series],
              return_type: str = "string", doc: str | None = None) -> DataFrame:
    """A 1:1 user function over one field as an Arrow (pandas) UDF.

    ``fn`` maps a pandas Series of field values to a Series of results; the
    result is stored at ``save_to`` (a dotted path; VARIANT ``doc`` allowed).
    """
    from docweave.functions import paths as P
    from docweave.operators.reshape import add_field

    ref = P.resolve(df, field, doc)
    value = P.v_string(ref.column) if ref.is_variant else ref.column
    udf = F.pandas_udf(fn, return_type)
    return add_field(df, save_to, udf(value), doc)


def plain(value):
    """A value as user code gets it: rows as dicts, VARIANT values decoded."""
    if isinstance(value, Row):
        return {k: plain(v) for k, v in zip(value.__fields__, value, strict=True)}
    if isinstance(value, T.VariantVal):
        return value.toPython()
    if isinstance(value, list):
        return [plain(v) for v in value]
    if isinstance(value, dict):
        return {k: plain(v) for k, v in value.items()}
    return value


_BITS = {T.ByteType: 8, T.ShortType: 16, T.IntegerType: 32, T.LongType: 64}
_KINDS = {T.BooleanType: bool, T.DateType: datetime.date, T.TimestampType: datetime.datetime,
          T.TimestampNTZType: datetime.datetime, T.DecimalType: decimal.Decimal, T.BinaryType: (bytes, bytearray)}


def _fitted(kind: T.DataType) -> Callable:
    """What makes an emitted value one of the column's type; a value that is none is an error, not a null."""
    def refuse(value):
        raise TypeError(f"{value!r} is no {kind.simpleString()}")

    if isinstance(kind, T.StringType):
        def fit(v):
            return v if isinstance(v, str) else str(v).lower() if isinstance(v, bool) else str(v)
    elif type(kind) in _BITS:
        end = 1 << (_BITS[type(kind)] - 1)

        def fit(v):
            if type(v) is not int:
                if isinstance(v, bool) or not isinstance(v, numbers.Real) or v != v or v - v or int(v) != v:
                    refuse(v)
                v = int(v)
            return v if -end <= v < end else refuse(v)
    elif isinstance(kind, (T.DoubleType, T.FloatType)):
        def fit(v):
            return refuse(v) if isinstance(v, bool) or not isinstance(v, numbers.Real) else float(v)
    elif isinstance(kind, T.ArrayType):
        of = _fitted(kind.elementType)

        def fit(v):
            return refuse(v) if isinstance(v, (str, bytes, dict)) or not isinstance(v, Iterable) else [of(x) for x in v]
    elif isinstance(kind, T.MapType):
        key, of = _fitted(kind.keyType), _fitted(kind.valueType)

        def fit(v):
            return {key(k): of(x) for k, x in v.items()} if isinstance(v, dict) else refuse(v)
    elif isinstance(kind, T.StructType):
        names, parts = kind.names, [_fitted(f.dataType) for f in kind.fields]

        def fit(v):
            values = [v.get(n) for n in names] if isinstance(v, dict) else v
            if not isinstance(values, (list, tuple)) or len(values) != len(parts):
                refuse(v)
            return tuple(part(x) for part, x in zip(parts, values, strict=True))
    elif type(kind) in _KINDS:
        wanted = _KINDS[type(kind)]

        def fit(v):
            if wanted is datetime.date and isinstance(v, datetime.datetime):
                return v.date()
            return v if isinstance(v, wanted) else refuse(v)
    else:
        def fit(v):
            return v
    return lambda v: None if v is None else fit(v)


def register_flat_map(spark: SparkSession, name: str, fn: Callable[..., Iterable[dict]],
                      schema: str | T.StructType | None = None, prepare: Callable[[], object] | None = None,
                      cleanup: Callable[[object], None] | None = None):
    """User code of ``flat_map_docs`` as the SQL table function ``name`` (a Python UDTF).

    In SQL it takes a table, or named values in a lateral join::

        SELECT * FROM name(TABLE(docs) PARTITION BY source ORDER BY doc_id)
        SELECT d.doc_id, t.* FROM docs d, LATERAL name(doc_id => d.doc_id, text => d.text) t

    ``fn(row_dict[, state])`` emits 0..n dicts.  Without ``schema`` the rows it
    emits have the columns of its input, which ``analyze`` reads when the query
    is planned.  A table with ``PARTITION BY`` hands every key's rows to one
    ``prepare`` .. ``cleanup`` span, in the order of ``ORDER BY``, with one
    state (for user code that needs the rows of a key together: a key is one
    task's then, streamed, never held); without it a span is a task's rows, and
    nothing is shuffled.  ``cleanup`` runs also after a row that failed; the
    failure then ends the job.  Returns the function, for the DataFrame API.
    """
    fixed = schema if schema is None or isinstance(schema, T.StructType) else \
        spark.createDataFrame([], schema).schema
    with_state = prepare is not None
    fits: dict[str, list] = {}  # of the worker

    def columns(args: tuple, named: dict) -> T.StructType:
        if args and (named or len(args) > 1 or not args[0].isTable):
            raise ValueError(f"{name} takes one table, or values by name")
        if fixed is not None:
            return fixed
        return args[0].dataType if args else T.StructType([T.StructField(k, a.dataType) for k, a in named.items()])

    class FlatMap:
        @staticmethod
        def analyze(*args: AnalyzeArgument, **named: AnalyzeArgument) -> AnalyzeResult:
            return AnalyzeResult(columns(args, named))

        def __init__(self, analyzed: AnalyzeResult):
            # of the columns, once per task and not per key
            self.fits = fits.get("of") or fits.setdefault("of", [(f.name, _fitted(f.dataType)) for f in analyzed.schema])
            self.state = prepare() if with_state else None
            self.open = True

        def eval(self, *args, **named):
            row = plain(args[0]) if args else {k: plain(v) for k, v in named.items()}
            try:
                for made in (fn(row, self.state) if with_state else fn(row)) or ():
                    yield tuple(fit(made.get(n)) for n, fit in self.fits)
            except BaseException:
                self.close()
                raise

        def terminate(self):
            self.close()
            return iter(())

        def close(self):
            if self.open and cleanup is not None:
                cleanup(self.state)
            self.open = False

    # rows of a batch travel together; in Arrow each row's output would be a batch of its own
    made = F.udtf(FlatMap, useArrow=False)
    spark.udtf.register(name, made)
    return made
