"""Exact dedup by two-pass Bloom filtering (DataFrame functions only).

Two texts are equal when they are identical after every run of white space
(U+0020, U+0009..U+000D) became one space.  A 64-bit hash of the normalised
text names a 64-bit word of a Bloom filter and three bits in it.

* Pass 1 counts how often each (word, bits) pattern is set.  Only these two
  integers are shuffled, after a partial count in each task, so a text that
  makes up a third of the rows is one row per task.  Patterns set at least
  twice are OR-ed into the second filter, one 64-bit word per row.
* Pass 2 probes the second filter with every row.  A row whose bits are not
  all set occurs once: it passes straight through, without a shuffle.  The
  rest -- the repeated texts and a few false positives -- are written to the
  shared folder and grouped by the SHA-256 of the normalised text, so the
  filter only saves work and never decides equality.

The second filter grows with the number of repeated texts.  It is broadcast
only up to ``max_broadcast_words`` words; beyond that the probe is a shuffle
join on the word and the results stay the same.

Defined results: a null text counts as empty; a null ``id`` sorts after every
other id; among rows with equal text and equal id (repeated rows) exactly one
is kept; an empty table gives an empty table; input columns named like a
result column are replaced by it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Carried, broadcast_within, materialise, pick

RESULTS = ("keep_id", "group_size", "kept", "text_sha256")

#: Words of the second filter that are broadcast at most (about 24 bytes each).
MAX_BROADCAST_WORDS = 2_000_000


def normalised(text: Column) -> Column:
    """Null as empty; each run of U+0020 and U+0009..U+000D as one space."""
    out = F.coalesce(text, F.lit(""))
    for white in "\t\n\x0b\x0c\r":
        out = F.replace(out, F.lit(white), F.lit(" "))
    return F.when(F.contains(out, F.lit("  ")), F.regexp_replace(out, " +", " ")).otherwise(out)


def _word(hashed: Column, n_words: int) -> Column:
    return F.shiftrightunsigned(hashed, 20).bitwiseAND(F.lit(n_words - 1))


def _bits(hashed: Column) -> Column:
    """Three of 64 bits, by bits 0..5, 6..11 and 12..17 of the hash."""
    one = [F.call_function("shiftleft", F.lit(1).cast("long"),
                           F.shiftrightunsigned(hashed, at).bitwiseAND(F.lit(63)).cast("int"))
           for at in (0, 6, 12)]
    return one[0].bitwiseOR(one[1]).bitwiseOR(one[2])


def repeated_filter(hashes: DataFrame, n_words: int) -> DataFrame:
    """(word, mask): the Bloom filter of the hashes that may occur twice (pass 1)."""
    patterns = (hashes.select(_word(F.col("h"), n_words).alias("word"), _bits(F.col("h")).alias("bits"))
                .groupBy("word", "bits").agg(F.count("*").alias("n")))
    return patterns.filter("n >= 2").groupBy("word").agg(F.bit_or("bits").alias("mask"))


def mark_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                    max_broadcast_words: int = MAX_BROADCAST_WORDS) -> DataFrame:
    """Every row of ``docs`` with ``keep_id, group_size, kept, text_sha256``.

    Of equal texts the row with the smallest id is kept.  See the module text
    for nulls, ties and name clashes.
    """
    carried = Carried(docs)
    text, row_id = normalised(carried.col(text_col)), carried.col(id_col)
    hashed = F.xxhash64(text)

    # a power of two of words, about eight rows to a word
    rows = docs.count()
    n_words = 1 << max(10, (rows // 8).bit_length())
    second = materialise(repeated_filter(carried.df.select(hashed.alias("h")), n_words), "dedup-filter")
    second = broadcast_within(second, max_broadcast_words)

    probed = (carried.df.withColumn("h", hashed).withColumn("word", _word(F.col("h"), n_words))
              .join(second, "word", "left")
              .withColumn("again", F.coalesce(F.col("mask").bitwiseAND(_bits(F.col("h"))) == _bits(F.col("h")),
                                              F.lit(False))))
    own = [f"c{i}" for i in range(len(carried.names))]
    sha = F.sha2(text, 256)
    once = probed.filter(~F.col("again")).select(
        *own, row_id.alias("keep_id"), F.lit(1).cast("long").alias("group_size"),
        F.lit(True).alias("kept"), sha.alias("text_sha256"))

    # the tag tells repeated rows apart; it is fixed by writing the table
    maybe = materialise(probed.filter("again").select(
        *own, sha.alias("text_sha256"), F.monotonically_increasing_id().alias("tag")), "dedup-repeated")
    first = F.struct(row_id.isNull().alias("no_id"), row_id.alias("id"), F.col("tag").alias("tag"))
    # stored, so that the join below has two plain sides and a hot group of copies is split
    groups = materialise(maybe.groupBy("text_sha256")
                         .agg(F.min(first).alias("first"), F.count("*").alias("group_size")), "dedup-groups")
    several = maybe.join(groups, "text_sha256").select(
        *own, F.col("first.id").alias("keep_id"), "group_size",
        (F.col("tag") == F.col("first.tag")).alias("kept"), "text_sha256")
    return carried.back(once.unionByName(several), *RESULTS)


def drop_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each group of equal texts, with the columns of ``docs``."""
    carried = Carried(docs)
    inner = carried.df
    marked = mark_duplicates(inner, f"c{carried.names.index(id_col)}", f"c{carried.names.index(text_col)}")
    return marked.filter("kept").drop(*RESULTS).toDF(*carried.names)


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the row that stays for its text."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return mark_duplicates(pick(docs, doc_id="doc_id", text="text")).select(
        "doc_id", "keep_id", "group_size", "kept", "text_sha256")


OP4_SQL = r"""
WITH t AS (
    SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256
    FROM documents
)
SELECT doc_id,
       min(doc_id) OVER (PARTITION BY text_sha256) AS keep_id,
       count(*) OVER (PARTITION BY text_sha256) AS group_size,
       doc_id = min(doc_id) OVER (PARTITION BY text_sha256) AS kept,
       text_sha256
FROM t
"""
