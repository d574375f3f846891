"""The record envelope ``(entity STRING, map STRING)`` and JSON documents.

Every record between components of the reference is a pair: a record-type
name and one JSON document as text.  Here the text is parsed once after the
scan (``parse_documents``) and printed once at a sink (``to_envelope``); in
between the document is typed columns or one VARIANT column.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docweave.functions import paths as P
from docweave.functions.presence import document_of, presence_of
from docweave.functions.ordered import print_in_order
from docweave.operators.split import Split

ENTITY = "entity"
MAP = "map"
DOC = "doc"


def decode_envelope(df: DataFrame, topic: str = "topic", value: str = "value") -> DataFrame:
    """Message-bus record ``(topic, value BINARY)`` -> envelope.

    Bytes are decoded as UTF-8; invalid sequences become U+FFFD, as a Java
    ``new String(bytes, "UTF-8")`` does.
    """
    return df.select(F.col(topic).cast("string").alias(ENTITY),
                     F.make_valid_utf8(F.col(value).cast("string")).alias(MAP))


def read_kafka(spark: SparkSession, stream: bool = True, **options) -> DataFrame:
    """Read a Kafka topic as envelopes.

    Needs the Kafka connector on the classpath.  ``options`` go to the reader
    (``kafka.bootstrap.servers``, ``subscribe``, ``maxOffsetsPerTrigger``...).
    """
    reader = spark.readStream if stream else spark.read
    try:
        raw = reader.format("kafka").options(**options).load()
    except Exception as exc:  # noqa: BLE001
        if "kafka" in str(exc).lower() and "data source" in str(exc).lower():
            raise RuntimeError("the Kafka connector is not on the classpath: start Spark with "
                               "--packages org.apache.spark:spark-sql-kafka-0-10_2.13:<version>"
                               ) from exc
        raise
    return decode_envelope(raw, "topic", "value")


CORRUPT = "_corrupt_record"


def read_documents(spark: SparkSession, path: str, entity: str = "document",
                   stream: bool = False, schema: str | None = None) -> DataFrame:
    """One JSON document per line of text files.

    Without ``schema``: envelopes ``(entity, map)`` with the raw text (parse
    with ``parse_documents``).  With a DDL ``schema``: typed columns read by
    the JSON reader (pushdown and pruning apply), plus ``_corrupt_record``
    holding the text of lines that do not parse -- nothing is dropped.
    """
    reader = spark.readStream if stream else spark.read
    if schema is None:
        raw = reader.text(path)
        return raw.select(F.lit(entity).alias(ENTITY), F.col("value").alias(MAP))
    typed = (reader.schema(f"{schema}, {CORRUPT} string")
             .option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", CORRUPT)
             .json(path))
    return typed.select(F.lit(entity).alias(ENTITY), "*")


def parse_documents(df: DataFrame, map_col: str = MAP, doc: str = DOC,
                    keep_raw: bool = True) -> DataFrame:
    """Parse the JSON text once into a VARIANT column ``doc``.

    Malformed text gives a NULL ``doc``; use ``split_malformed`` to route it.
    Repeated keys keep the last value when the session sets
    ``spark.sql.variant.allowDuplicateKeys`` (``docweave.session`` does).
    """
    out = df.withColumn(doc, F.try_parse_json(F.col(map_col)))
    return out if keep_raw else out.drop(map_col)


def _is_object(v: Column) -> Column:
    return v.isNotNull() & P.v_is_object(v)


def classify_documents(df: DataFrame, map_col: str = MAP, doc: str = DOC,
                       status: str = "status") -> DataFrame:
    """One pass: parse and label every record ``good``, ``malformed`` or ``not an object``."""
    parsed = df if doc in df.columns else parse_documents(df, map_col, doc)
    d = F.col(doc)
    return parsed.withColumn(status, F.when(d.isNull(), F.lit("malformed"))
                             .when(P.v_is_object(d), F.lit("good"))
                             .otherwise(F.lit("not an object")))


def split_malformed(df: DataFrame, map_col: str = MAP, doc: str = DOC) -> Split:
    """Good documents (JSON objects) and a dead letter for the rest.

    The dead-letter rows keep their original text and get a ``reason``.  Both
    outputs read the input; ``classify_documents`` labels every record in one
    pass when one output with a status column is enough.
    """
    parsed = df if doc in df.columns else parse_documents(df, map_col, doc)
    ok = F.coalesce(_is_object(F.col(doc)), F.lit(False))
    good = parsed.where(ok)
    dead = (parsed.where(~ok)
            .withColumn("reason", F.when(F.col(doc).isNull(), F.lit("malformed"))
                        .otherwise(F.lit("not an object")))
            .drop(doc))
    return Split(good, dead)


def to_envelope(df: DataFrame, entity: str | None = None, doc: str | None = None,
                entity_col: str = ENTITY, order: str | None = None) -> DataFrame:
    """Print each document once as JSON text: ``(entity, map)``.

    A VARIANT document's numbers keep the text the reference prints (``2.0``);
    its keys are sorted, or, with ``order`` (the column of the text it was
    parsed from), in the order they have there, new ones last.
    Typed mode serialises all columns but ``entity`` with nulls kept
    (``ignoreNullFields=false``), like a Java map printed by Jackson.
    """
    if entity is not None:
        ent = F.lit(entity)
    elif entity_col in df.columns:
        ent = F.col(entity_col)
    else:
        ent = F.lit(None).cast("string")
    if doc is not None:
        from docweave.operators.reshape import v_with_doubles
        text = F.to_json(v_with_doubles(F.col(doc)))
        if order is not None:
            return print_in_order(df.select(ent.alias(ENTITY), F.col(order).alias(MAP), F.col(doc)), text, MAP) \
                .select(ENTITY, MAP)
    else:
        if order is not None:
            raise ValueError("order needs a VARIANT document; typed columns print in their order")
        if presence_of(df) is not None:
            from docweave.operators.reshape import v_with_doubles
            return df.select(ent.alias(ENTITY), F.to_json(v_with_doubles(document_of(df, (entity_col,)))).alias(MAP))
        body = [F.col(f"`{c}`") for c in df.columns if c != entity_col]
        text = F.to_json(F.struct(*body), {"ignoreNullFields": "false"})
    return df.select(ent.alias(ENTITY), text.alias(MAP))


def with_documents(df: DataFrame, fn, map_col: str = MAP, doc: str = DOC,
                   dead_letter: bool = True, keep_order: bool = False):
    """Run operators on envelopes: parse ``map`` once, apply ``fn``, print once.

    ``fn`` takes the DataFrame with the VARIANT column ``doc`` (operators are
    called with ``doc=doc``) and returns a DataFrame or a ``Split``; the result
    comes back as ``(entity, map)`` envelopes (a ``Split`` of envelopes), and
    the malformed records with it: ``(result, dead)``.  Only a caller that
    says ``dead_letter=False`` gets the result alone.  With ``keep_order`` the
    text stays beside the document and documents print in their own key order
    (``fn`` must keep the column; ``flatten_doc`` takes it as ``order``).
    """
    parts = split_malformed(df, map_col, doc)
    out = fn(parts.yes if keep_order else parts.yes.drop(map_col))

    def back(d: DataFrame) -> DataFrame:
        return to_envelope(d, doc=doc, order=map_col if keep_order else None)

    result = Split(back(out.yes), back(out.no)) if isinstance(out, Split) else back(out)
    return (result, parts.no) if dead_letter else result


def from_envelope(df: DataFrame, schema: str, map_col: str = MAP,
                  entity_col: str = ENTITY) -> DataFrame:
    """Typed documents from an envelope with a known schema (``from_json``)."""
    parsed = F.from_json(F.col(map_col), schema)
    cols = [F.col(entity_col)] if entity_col in df.columns else []
    return df.select(*cols, parsed.alias("__d")).select(*[c for c in
                                                           ([entity_col] if cols else [])],
                                                         "__d.*")
