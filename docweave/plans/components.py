"""Components configured by parameter maps (U4), for moving existing topologies over.

``component(kind, params)`` returns a DataFrame -> DataFrame (or ``Split``)
function built from the same parameters an existing topology gives each
component, so a topology translates node by node into a ``Dataflow``:

    flow.transform("only-purchases", component("filter", {
        "action": "permit", "match": "all",
        "conditions": [{"field": "event_type", "operator": "==", "value": "purchase"}]}),
        "events")

Parameter values are strings, as in the configuration files; lists are
Python lists.  ``doc`` selects VARIANT mode for every component.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from docweave.operators.enrich import enrich, short_code
from docweave.operators.filter import filter_docs
from docweave.operators.reshape import flatten_doc, rename_field, trim
from docweave.operators.split import split, split_exists, split_fields
from docweave.sinks.writers import log_sink
from docweave.sources.feeds import parse_feed
from docweave.sources.social import track_keywords
from docweave.sinks.payloads import (bars_payload, boxes_payload, map_payload, message_payload,
                                     timeline_payload)

# The parameter names of each component kind.
PARAMETERS = {
    "filter": ("action", "match", "conditions", "entity"),
    "conditional": ("field", "operator", "value", "entity"),
    "conditional_fields": ("field1", "operator", "field2", "entity"),
    "exists": ("field", "entity"),
    "flatten": ("separator", "entity"),
    "rename": ("find", "replace", "entity"),
    "trim": ("action", "field", "entity"),
    "short_url": ("field", "saveTo", "entity"),
    "bars": ("bars",),
    "boxes": ("bars",),
    "map": ("latField", "lonField", "field", "id"),
    "timeline": ("contentField", "titleField", "imageField", "timestampField", "id"),
    "message": ("fieldToTweet", "customText", "consumerKey", "consumerSecret", "accessToken",
                "accessTokenSecret"),
    "rss": ("url", "frequency"),
    "twitter": ("keywords", "consumerKey", "consumerSecret", "accessToken", "accessTokenSecret"),
    "log": (),
}
# Parameters that go to the client and not into the data.
CREDENTIALS = ("apiKey", "consumerKey", "consumerSecret", "accessToken", "accessTokenSecret")
REQUIRED = {
    "filter": ("conditions",), "conditional": ("field", "operator", "value"),
    "conditional_fields": ("field1", "operator", "field2"), "exists": ("field",),
    "rename": ("find", "replace"), "trim": ("field",), "short_url": ("field", "saveTo"),
    "bars": ("bars",), "boxes": ("bars",), "map": ("latField", "lonField", "id"),
    "timeline": ("id",), "message": ("fieldToTweet",), "rss": ("url",),
}


def _as_list(v) -> list:
    if v is None:
        return []
    return list(v) if isinstance(v, (list, tuple)) else [v]


def credentials(params: dict) -> dict:
    """The credential parameters, for the client factory of a push or a source."""
    return {k: params[k] for k in CREDENTIALS if params.get(k)}


def component(kind: str, params: dict, doc: str | None = None, lookup: Callable | None = None,
              landed: Callable | None = None, path: str | None = None) -> Callable:
    """The transformation of one configured component.

    ``short_url`` uses ``lookup`` (a pandas Series -> Series function, e.g. a
    client of the shortening service) when given, otherwise an offline
    md5-based code.  Source kinds (``rss``, ``twitter``) give a function of the
    session: ``landed(spark, params)`` reads what a collector has landed for
    them (feed snapshots with the column ``xml``; statuses with ``text``),
    which is then parsed or tracked.  ``log`` writes the documents' JSON text
    under ``path``.  Credentials are accepted and left to ``credentials`` and
    the client factory.  Unknown kinds or parameters, and missing required
    parameters, raise ``ValueError`` when the topology is built.
    """
    if kind not in PARAMETERS:
        raise ValueError(f"unknown component {kind!r}; expected one of {sorted(PARAMETERS)}")
    unknown = set(params) - set(PARAMETERS[kind]) - set(CREDENTIALS)
    if unknown:
        raise ValueError(f"{kind}: unknown parameters {sorted(unknown)}")
    missing = [p for p in REQUIRED.get(kind, ()) if params.get(p) in (None, "", [])]
    if missing:
        raise ValueError(f"{kind}: missing parameters {missing}")
    p = params
    ent = p.get("entity")
    if kind == "filter":
        return lambda df: filter_docs(df, p["conditions"], p.get("action"), p.get("match"),
                                      doc=doc, entity=ent)
    if kind == "conditional":
        return lambda df: split(df, p["field"], p["operator"], p["value"], doc=doc, entity=ent)
    if kind == "conditional_fields":
        return lambda df: split_fields(df, p["field1"], p["operator"], p["field2"], doc=doc,
                                       entity=ent)
    if kind == "exists":
        return lambda df: split_exists(df, p["field"], doc=doc, entity=ent)
    if kind == "flatten":
        sep = p.get("separator") or "_"
        return lambda df: flatten_doc(df, sep, doc=doc, keep=["entity"], entity=ent)
    if kind == "rename":
        return lambda df: rename_field(df, p["find"], p["replace"], doc=doc, entity=ent)
    if kind == "trim":
        return lambda df: trim(df, _as_list(p["field"]), p.get("action") or "allows", doc=doc,
                               keep=["entity"], entity=ent)
    if kind == "short_url":
        if lookup is not None:
            return lambda df: enrich(df, p["field"], p["saveTo"], lookup, doc=doc, entity=ent)
        return lambda df: short_code(df, p["field"], p["saveTo"], doc=doc, entity=ent)
    if kind in ("rss", "twitter"):
        if landed is None:
            raise ValueError(f"{kind}: give landed=, a reader of what was collected")
        if kind == "rss":
            return lambda spark: parse_feed(landed(spark, p), "xml", doc=doc or "doc")
        words = [w for v in _as_list(p.get("keywords")) for w in str(v).split(",") if w.strip()]
        return lambda spark: (track_keywords(landed(spark, p), "text", words, doc=doc) if words
                              else landed(spark, p))
    if kind == "log":
        return lambda df: log_sink(df, path, doc=doc)
    if kind == "bars":
        return lambda df: bars_payload(df, p["bars"], doc=doc, keep=["entity"])
    if kind == "boxes":
        return lambda df: boxes_payload(df, p["bars"], doc=doc, keep=["entity"])
    if kind == "map":
        return lambda df: map_payload(df, p["latField"], p["lonField"], _as_list(p.get("field")),
                                      p["id"], doc=doc)
    if kind == "timeline":
        return lambda df: timeline_payload(df, p.get("contentField"), p.get("titleField"),
                                           p.get("imageField"), p.get("timestampField"),
                                           p["id"], doc=doc)
    # message
    return lambda df: message_payload(df, p["fieldToTweet"], p.get("customText") or "", doc=doc)
