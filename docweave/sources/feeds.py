"""Feed snapshots: XML items as documents, and new-item detection.

A feed is polled again and again; each poll returns a snapshot of items.  An
item is *new* in a poll when it was not in the immediately previous poll of
the same feed (duplicates within a poll all pass; an item that leaves and
comes back is new again).  Polls that return no item do not count: the
previous snapshot stays the last poll that had rows.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docweave.functions.sizing import DEFAULT_BROADCAST_ROWS, broadcast_derived
from docweave.session import checkpoint_root

# The record type of feed items, as the reference emits it.
FEED_ENTITY = "rssItem"
SEQ = "poll_seq"


def _names(cols: str | Sequence[str] | None) -> list[str]:
    if cols is None:
        return []
    return [cols] if isinstance(cols, str) else list(cols)


def feed_schema(item_schema: str) -> str:
    """Schema of an ``<rss>`` root for ``from_xml``: ``channel.item`` is the item list."""
    return f"channel struct<item: array<struct<{item_schema}>>>"


# Attributes become plain keys and the text of an element with
# attributes is ``content``, as in the XML-to-JSON conversion the feeds were read with.
XML_OPTIONS = {"attributePrefix": "", "valueTag": "content", "ignoreSurroundingSpaces": "true"}


def parse_feed(df: DataFrame, xml_col: str, item_schema: str | None = None, entity: str = FEED_ENTITY,
               options: dict[str, str] | None = None, keep: Sequence[str] = (), doc: str = "doc") -> DataFrame:
    """One row per ``rss/channel/item`` of each XML snapshot in ``xml_col``.

    ``item_schema`` is a DDL list such as ``"title string, link string"``.
    Without one, every item is a VARIANT document ``doc`` with all its
    elements, as the reference emits it.  A snapshot with a single item gives
    one row.  Columns in ``keep`` are carried next to each item.  A snapshot
    that does not parse, or has no items, gives no row: see
    ``feed_dead_letter``.
    """
    opts = {**XML_OPTIONS, **(options or {})}
    kept = [F.col(k) for k in keep]
    if item_schema is not None:
        parsed = F.from_xml(F.col(xml_col), feed_schema(item_schema), opts)
        items = F.explode(parsed.getField("channel").getField("item")).alias("__item")
        return df.select(*kept, items).select(F.lit(entity).alias("entity"), *keep, "__item.*")
    items = _parsed_feed(xml_col, opts).getField("channel").getField("item")
    return (df.select(*kept, F.explode(items).alias(doc))
            .select(F.lit(entity).alias("entity"), *keep, doc))


_BROKEN = "__broken"


def _parsed_feed(xml_col: str, opts: dict[str, str]) -> Column:
    """The feed with its items as VARIANT documents, and the text if it does not parse."""
    return F.from_xml(F.col(xml_col), f"channel struct<item: array<variant>>, {_BROKEN} string",
                      {**opts, "columnNameOfCorruptRecord": _BROKEN})


def feed_dead_letter(df: DataFrame, xml_col: str, options: dict[str, str] | None = None) -> DataFrame:
    """The snapshots that ``parse_feed`` gets no item from, with a ``reason``.

    ``malformed``: null or no well-formed XML; ``no items``: an empty feed or
    a document that is no feed.  All columns stay.
    """
    parsed = _parsed_feed(xml_col, {**XML_OPTIONS, **(options or {})})
    item = parsed.getField("channel").getField("item")
    reason = (F.when(F.col(xml_col).isNull() | parsed.getField(_BROKEN).isNotNull(), F.lit("malformed"))
              .when(F.coalesce(F.size(item), F.lit(0)) < 1, F.lit("no items")))
    return df.withColumn("reason", reason).where(F.col("reason").isNotNull())


def read_feed(spark: SparkSession, path: str, item_schema: str | None = None,
              stream: bool = False, entity: str = FEED_ENTITY,
              options: dict[str, str] | None = None) -> DataFrame:
    """Read landed feed snapshots (XML files) as one row per ``<item>``.

    Splits by the ``item`` row tag, so a large snapshot is read in parallel.
    Works for batch and, with ``stream=True``, as a file stream (a stream
    needs ``item_schema``); the source path of each row is kept in
    ``source_file``.  Without a schema, batch reads infer one, guessing
    numbers and booleans from the text as the reference's conversion does.
    """
    reader = spark.readStream if stream else spark.read
    opts = {"rowTag": "item", **XML_OPTIONS, **(options or {})}
    reader = reader.format("xml").options(**opts)
    if item_schema is not None:
        reader = reader.schema(item_schema)
    elif stream:
        raise ValueError("a feed stream needs item_schema")
    df = reader.load(path)
    return df.select(F.lit(entity).alias("entity"), "*",
                     F.col("_metadata.file_path").alias("source_file"))


def comparable_keys(df: DataFrame, cols: Sequence[str]) -> tuple[DataFrame, list[str]]:
    """Make item columns usable as join keys.

    A VARIANT (a whole document as the item, as the reference compares whole
    items) cannot be joined on; it is keyed by its JSON text, which is
    canonical because VARIANT objects keep their keys sorted.
    """
    out, names = df, []
    for c in cols:
        if isinstance(df.schema[c].dataType, T.VariantType):
            key = f"__key_{c}"
            out = out.withColumn(key, F.to_json(F.col(c)))
            names.append(key)
        else:
            names.append(c)
    return out, names


def null_safe_on(left: DataFrame, right: DataFrame, pairs: list[tuple[str, str]]) -> Column:
    return reduce(lambda a, b: a & b, [left[l].eqNullSafe(right[r]) for l, r in pairs])


def dense_number(df: DataFrame, order_col: str, out: str,
                 partitions: int | None = None) -> DataFrame:
    """Number the distinct values of ``order_col`` 1, 2, ... without a global window.

    Range-partition by the value, number rows within each partition, then add
    the running count of the partitions before it -- a table of one row per
    partition.  No partition ever holds more than its range.
    """
    n = partitions or df.sparkSession.sparkContext.defaultParallelism
    checkpoint_root(df.sparkSession)
    # fixed by the checkpoint: both uses below see the same ranges
    ranged = (df.repartitionByRange(n, order_col).withColumn("__part", F.spark_partition_id())
              .checkpoint(eager=True))
    local = ranged.withColumn(
        "__local", F.row_number().over(Window.partitionBy("__part").orderBy(order_col)))
    sizes = ranged.groupBy("__part").agg(F.count("*").alias("__size"))
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("__part", F.coalesce(F.sum("__size").over(before), F.lit(0))
                           .alias("__offset"))
    return (local.join(F.broadcast(offsets), "__part")  # one row per partition
            .withColumn(out, (F.col("__offset") + F.col("__local")).cast("bigint"))
            .drop("__part", "__local", "__offset"))


def with_poll_seq(df: DataFrame, poll: str, feed: str | Sequence[str] | None = None,
                  max_broadcast_rows: int = DEFAULT_BROADCAST_ROWS) -> DataFrame:
    """Number the polls of each feed densely (1, 2, ...) in ``poll`` order.

    A row whose poll is NULL belongs to no poll: its number is NULL and every
    row stays.  A NULL feed is a feed of its own.  Only the small table of
    distinct ``(feed, poll)`` pairs is ranked: all of them together by
    ``dense_number`` in the order of feed and poll, and less the number before
    each feed's first poll -- so a feed with most of the polls is no single
    task.  It is materialised once and joined back, by broadcast if it is
    proven small, else by a shuffle join.
    """
    feeds = _names(feed)
    polls = df.where(F.col(poll).isNotNull()).select(*feeds, poll).distinct()
    if feeds:
        numbered = dense_number(polls.withColumn("__order", F.struct(*feeds, poll)), "__order", "__n")
        first = numbered.groupBy(*feeds).agg(F.min("__n").alias("__first"))
        firsts = first.select(*[F.col(f).alias(f"__f{i}") for i, f in enumerate(feeds)], "__first")
        on = null_safe_on(numbered, firsts, [(f, f"__f{i}") for i, f in enumerate(feeds)])
        ranked = numbered.join(firsts, on).select(
            *feeds, poll, (F.col("__n") - F.col("__first") + 1).cast("bigint").alias(SEQ))
    else:
        ranked = dense_number(polls, poll, SEQ)
    keys = feeds + [poll]
    ranked = broadcast_derived(ranked.select(
        *[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)], SEQ), max_broadcast_rows)
    on = null_safe_on(df, ranked, [(k, f"__k{i}") for i, k in enumerate(keys)])
    return df.join(ranked, on, "left").drop(*[f"__k{i}" for i in range(len(keys))])


def new_items(df: DataFrame, item: str | Sequence[str], poll: str,
              feed: str | Sequence[str] | None = None, dense: bool = False,
              max_broadcast_rows: int = DEFAULT_BROADCAST_ROWS) -> DataFrame:
    """Rows whose item was not in the previous poll of the same feed.

    ``item`` names the columns that identify an item (null-safe equality).
    Rows without a poll (NULL) were never polled before: they all stay, with
    a NULL number.
    ``dense=True`` says ``poll`` already numbers each feed's polls 1, 2, ...
    without gaps.  Plan: distinct ``(feed, seq, item)`` keys shifted by one
    poll, then a left anti join of the rows against them -- one shuffle of
    the rows; a hot item is split by AQE's skew handling, and no group is
    ever gathered into one task.
    """
    feeds, items = _names(feed), _names(item)
    if not items:
        raise ValueError("new_items needs at least one item column")
    if df.isStreaming:
        raise ValueError("new_items works on a batch; use docweave.streaming.new_items_stream")
    rows = df.withColumn(SEQ, F.col(poll).cast("bigint")) if dense else \
        with_poll_seq(df, poll, feeds, max_broadcast_rows)
    rows, items = comparable_keys(rows, items)
    key_cols = feeds + items
    prev = (rows.where(F.col(SEQ).isNotNull()).select(*key_cols, SEQ).distinct()
            .select(*[F.col(c).alias(f"__prev_{i}") for i, c in enumerate(key_cols)],
                    (F.col(SEQ) + 1).alias("__prev_seq")))
    pairs = [(c, f"__prev_{i}") for i, c in enumerate(key_cols)] + [(SEQ, "__prev_seq")]
    out = rows.join(prev, null_safe_on(rows, prev, pairs), "left_anti")
    return out.drop(*[c for c in items if c.startswith("__key_")])


def snapshot_diff(current: DataFrame, previous: DataFrame,
                  keys: str | Sequence[str]) -> DataFrame:
    """Rows of ``current`` whose key is not in ``previous`` (two-snapshot form of S4).

    A set difference on keys -- every duplicate in ``current`` is kept -- not
    ``exceptAll`` (a bag difference).
    """
    cur, ks = comparable_keys(current, _names(keys))
    prv, pks = comparable_keys(previous, _names(keys))
    prev = prv.select(*[F.col(c).alias(f"__prev_{i}") for i, c in enumerate(pks)]).distinct()
    pairs = [(c, f"__prev_{i}") for i, c in enumerate(ks)]
    out = cur.join(prev, null_safe_on(cur, prev, pairs), "left_anti")
    return out.drop(*[c for c in ks if c.startswith("__key_")])
