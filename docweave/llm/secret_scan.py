"""Secrets: base patterns, told apart by who owns them across the corpus.

Candidates are the values of the base findings and *opaque* strings: runs of
key characters outside base findings that mix letters and digits and look
random.  One pass over the texts finds them; from there on only a 128-bit hash
of each value moves.  Its distinct repositories and owners are counted over all
documents (grouped twice, partially aggregated), and

* a value that ``WIDE_OWNERS`` or more owners have is a widely copied example;
* a value of fewer owners that looks random is live: opaque strings become
  spans of kind ``opaque`` then, and base findings are listed as live;
* other values (words, placeholders, repeated characters) are dummies.

Base spans stay in the result whatever the verdict.
"""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_left
from collections import Counter
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialise, pick

#: Kinds in the order of the results; the last one is the method's own.
KINDS = ("assign", "access", "hex", "opaque")
ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
#: A text without any of these has no assignment.
ASSIGN_WORDS = ("passw", "secret", "token", "apikey", "api_key")
#: Runs of a class, whole: a shorter run fails its check, a longer one is one match.
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{24,}")
OPAQUE = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}")
ASSIGN_LEAST = 6
#: Owners from which on a value is an example that was copied.
WIDE_OWNERS = 3
#: Bits a character that a random-looking value has at least (of opaque strings; others: of 8 or more characters).
OPAQUE_BITS, LIVE_BITS = 3.5, 2.5

_FOUND = ("row bigint, doc_id bigint, owner string, repository string, "
          "spans array<struct<start:int, kind:int, end:int, k1:bigint, k2:bigint, random:boolean>>")
_SPAN = "struct<start:int, kind:int, end:int, owners:bigint, repositories:bigint, verdict:string>"


def entropy(value: str) -> float:
    """Shannon entropy of the characters, in bits."""
    n = len(value)
    return -sum(c / n * math.log2(c / n) for c in Counter(value).values())


def looks_random(value: str, least: float = LIVE_BITS) -> bool:
    digits = sum(c.isdigit() for c in value)
    return len(value) >= 8 and 0 < digits < len(value) and entropy(value) >= least


def secret_spans(text: str) -> list[tuple[int, int, int, str]]:
    """(start, kind, end, value) by start, then kind; ``end`` exclusive, in code points."""
    out = []
    low = text.lower()
    if any(w in low for w in ASSIGN_WORDS):
        out += [(m.start(), 0, m.end(), m[2]) for m in ASSIGN.finditer(text) if len(m[2]) >= ASSIGN_LEAST]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end(), m[0]) for m in ACCESS.finditer(text)]
    out += [(m.start(), 2, m.end(), m[0]) for m in HEX.finditer(text)]
    out.sort()
    starts = [s for s, *_ in out]
    reach = list(accumulate((e for _, _, e, _ in out), max))  # how far the spans so far go
    for m in OPAQUE.finditer(text):
        before = bisect_left(starts, m.end())
        if (not before or reach[before - 1] <= m.start()) and looks_random(m[0], OPAQUE_BITS):
            out.append((m.start(), 3, m.end(), m[0]))
    return sorted(out)


def value_key(value: str) -> tuple[int, int]:
    digest = hashlib.blake2b(value.encode(), digest_size=16).digest()
    return int.from_bytes(digest[:8], "big", signed=True), int.from_bytes(digest[8:], "big", signed=True)


def find_candidates(docs: DataFrame) -> DataFrame:
    """(row, doc_id, owner, repository, spans) of every row of ``docs`` (doc_id, owner, repository, text), stored."""
    def scan(batches):
        for batch in batches:
            spans = []
            for text in batch.column(4).to_pylist():
                found = secret_spans(text) if text else []
                spans.append([(s, kind, e, *value_key(v), looks_random(v)) for s, kind, e, v in found])
            kind = pa.list_(pa.struct([("start", pa.int32()), ("kind", pa.int32()), ("end", pa.int32()),
                                       ("k1", pa.int64()), ("k2", pa.int64()), ("random", pa.bool_())]))
            names = [f.name for f in kind.value_type]
            rows = pa.array([[dict(zip(names, s, strict=True)) for s in found] for found in spans], kind)
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], rows],
                                             names=["row", "doc_id", "owner", "repository", "spans"])

    numbered = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"),
                           *[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("owner", "repository")],
                           F.col("text").cast("string").alias("text"))
    return materialise(numbered.mapInArrow(scan, _FOUND), "secrets-found")


def ownership(found: DataFrame) -> DataFrame:
    """(k1, k2, owners, repositories) of every value: how many distinct ones have it.

    A value that stands in very many documents is one partial row per task and
    (owner, repository) before anything is shuffled.
    """
    key = ["k1", "k2"]
    seen = found.select("owner", "repository", F.explode("spans").alias("s")).select("s.k1", "s.k2", "owner", "repository")
    by_repository = seen.groupBy(*key, "owner", "repository").agg(F.count("*").alias("n"))
    by_owner = by_repository.groupBy(*key, "owner").agg(F.count("*").alias("repositories"))
    return by_owner.groupBy(*key).agg(F.count("*").alias("owners"), F.sum("repositories").alias("repositories"))


def verdict(owners: Column, random: Column) -> Column:
    return F.when(owners >= WIDE_OWNERS, "example").when(random, "live").otherwise("dummy")


def find_secrets(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", owner: str = "source",
                 repository: str | None = None) -> DataFrame:
    """Every row of ``df`` as (doc_id, spans): array of (start, kind, end, owners, repositories, verdict) in order.

    ``kind`` is a place in ``KINDS``.  Candidates of kind ``opaque`` are in the
    result only if they are live.  ``owner`` and ``repository`` name columns;
    repositories of the same name of different owners are different ones, and
    without a column an owner has one repository.  A null owner or repository
    counts as the empty one, a null text as empty (it has no spans); repeated
    rows get equal spans; an empty table gives an empty table.
    """
    picked = {"doc_id": id_col, "text": text_col, "owner": owner} | ({"repository": repository} if repository else {})
    base = pick(df, **picked)
    docs = base if repository else base.withColumn("repository", F.lit(""))
    found = find_candidates(docs.select("doc_id", "owner", "repository", "text"))
    owned = materialise(ownership(found), "secrets-owned")
    with_spans = found.filter("size(spans) > 0")
    each = with_spans.select("row", F.explode("spans").alias("s")).select("row", "s.*")
    judged = (materialise(each, "secrets-places").join(owned, ["k1", "k2"])  # plain sides: a hot value is split
              .withColumn("verdict", verdict(F.col("owners"), F.col("random")))
              .filter((F.col("kind") < 3) | (F.col("verdict") == "live")))
    span = F.struct("start", "kind", "end", "owners", "repositories", "verdict")
    lists = judged.groupBy("row").agg(F.sort_array(F.collect_list(span)).alias("spans"))  # of one document
    none = F.array().cast(f"array<{_SPAN}>")
    some = with_spans.select("row", "doc_id").join(lists, "row", "left").select(
        "doc_id", F.coalesce("spans", none).alias("spans"))
    return found.filter("size(spans) = 0").select("doc_id", none.alias("spans")).unionByName(some)


def written(spans: Column) -> Column:
    """``kind:start:end`` of all spans, joined by commas."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"],
                                                                 s["end"])), ",")


def op11_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The secrets of every document; an owner is a source, its repositories are its languages."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = find_secrets(docs, repository="lang")

    def of(test) -> Column:
        return F.filter("spans", test)

    def kind(k: int):
        return lambda s: s["kind"] == k

    base = of(lambda s: s["kind"] < 3)
    return found.select(
        "doc_id", *[F.size(of(kind(k))).cast("long").alias(f"n_{KINDS[k]}") for k in range(3)],
        F.sha2(written(base), 256).alias("base_sha256"), written(F.col("spans")).alias("spans"),
        written(of(lambda s: s["verdict"] == "live")).alias("live"),
        written(of(lambda s: s["verdict"] == "example")).alias("examples"))
