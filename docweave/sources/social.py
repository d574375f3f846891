"""Status-stream sources: keyword tracking and sampling.

The remote status service is not rebuilt; its two ways of selecting statuses
are expressed on any DataFrame of documents (a JSON file landing zone, a Kafka
topic, a table):

* ``track_keywords``: keep documents whose text holds any keyword as a whole
  word, case-insensitive (a multi-word keyword is matched as a phrase).
* ``track_keyword_table``: the same for keywords in a table, thousands or more;
  each text is read once, whatever their number.
* ``sample_stream``: a deterministic hash sample (works on streams and is
  reproducible); ``method="random"`` uses ``DataFrame.sample``.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docweave.functions import paths as P
from docweave.functions.sizing import fits
from docweave.session import checkpoint_root

# The record type of status documents, as the reference emits it.
TWEET_ENTITY = "tweet"
SAMPLE_BUCKETS = 10_000


def _quote(word: str) -> str:
    # escape every non-alphanumeric character: valid in Java regex and RE2
    return "".join(ch if ch.isalnum() or ch == " " else "\\" + ch for ch in word)


def keyword_pattern(keywords: Sequence[str]) -> str:
    words = [k.strip().lower() for k in keywords if k and k.strip()]
    if not words:
        raise ValueError("track_keywords needs at least one keyword; use sample_stream")
    alts = "|".join(_quote(w) for w in words)
    # (?U): a letter of any script is part of a word
    return f"(?U)(^|\\W)({alts})(\\W|$)"


def keyword_match(text: Column, keywords: Sequence[str]) -> Column:
    """Whole-word match of any keyword.  A substring test runs first (cheap,
    code-generated) so the regex only runs on texts that hold a keyword."""
    lowered = F.lower(text)
    words = [k.strip().lower() for k in keywords if k and k.strip()]
    pattern = keyword_pattern(keywords)
    maybe = F.lit(False)
    for w in words:
        maybe = maybe | F.contains(lowered, F.lit(w))
    return maybe & lowered.rlike(pattern)


def track_keywords(df: DataFrame, field: str, keywords: Sequence[str],
                   doc: str | None = None) -> DataFrame:
    ref = P.resolve(df, field, doc)
    text = P.v_string(ref.column) if ref.is_variant else ref.column
    return df.where(keyword_match(text, keywords))


# --- keywords in a table ---------------------------------------------------------------

#: Keyword tables up to these bounds become an automaton in each Python worker; larger ones are joined.
AUTOMATON_ROWS = 200_000
AUTOMATON_BYTES = 16 << 20
#: Bits of the filter that a join's keywords make for the words of the texts, at most (16 MB).
FILTER_BITS = 1 << 27
_WORD = r"(?U)\w"


_BUILT: dict[str, tuple] = {}  # of the worker: the automaton in use


class _Automaton:
    """Aho-Corasick automaton over the keywords; built once per worker from the broadcast list."""

    def __init__(self, words):
        self.words = words  # a broadcast variable
        self.token = uuid.uuid4().hex

    def build(self) -> tuple:
        if self.token not in _BUILT:
            import ahocorasick
            import regex
            trie = ahocorasick.Automaton(ahocorasick.STORE_LENGTH)
            for w in self.words.value:
                trie.add_word(w)
            trie.make_automaton()
            # the word characters of the pattern's (?U)\w
            word = regex.compile(r"[\p{Alphabetic}\p{M}\p{Nd}\p{Pc}\p{Join_Control}]").match
            _BUILT.clear()
            _BUILT[self.token] = trie, word
        return _BUILT[self.token]

    def holds(self, text: str) -> bool:
        trie, word = self.build()
        for end, length in trie.iter(text):  # every keyword that ends there
            begin = end - length + 1
            if (begin == 0 or not word(text[begin - 1])) and (end + 1 == len(text) or not word(text[end + 1])):
                return True
        return False


def _by_automaton(df: DataFrame, text: Column, words: Sequence[str]) -> DataFrame:
    automaton = _Automaton(df.sparkSession.sparkContext.broadcast(list(words)))

    @F.arrow_udf("boolean")
    def holds(texts: pa.Array) -> pa.Array:
        return pa.array([t is not None and automaton.holds(t) for t in texts.to_pylist()], pa.bool_())

    return df.where(holds(F.lower(text)))


def _made_once(words: DataFrame) -> DataFrame:
    """``words`` from the checkpoint folder, so what derives them from the texts runs once.

    Where no folder is shared they stay as they are: a small table needs none.
    """
    try:
        checkpoint_root(words.sparkSession)
    except ValueError:
        return words
    return words.checkpoint()


def _anchors(lowered: Column) -> Column:
    """What a keyword can be looked up by: the words of a text and its other characters, once each.

    A keyword that stands as a whole has each of its words as a whole word of
    the text, and one without a word has its first character there.
    """
    return F.array_distinct(F.concat(F.regexp_extract_all(lowered, F.lit(f"({_WORD}+)")),
                                     F.regexp_extract_all(lowered, F.lit(r"(?U)(\W)"))))


def _may_be_in(keys: DataFrame, anchor: str) -> Callable[[Column], Column]:
    """A test of one hashed bit per anchor: false only for what is not in ``keys[anchor]``.

    The bits are made where the keys are, 32 a key and ``FILTER_BITS`` at most,
    so what passes the driver is bounded.
    """
    bits = min(FILTER_BITS, 1 << max(15, (32 * keys.count()).bit_length()))

    def place(column: Column) -> Column:
        return F.pmod(F.xxhash64(column), F.lit(bits))

    of = place(F.col(anchor)) + 1  # buckets begin with 1
    maps = keys.groupBy(F.bitmap_bucket_number(of)).agg(F.bitmap_construct_agg(F.bitmap_bit_position(of)))
    filled = np.zeros(bits // 8, np.uint8)
    for number, part in maps.collect():
        filled[(number - 1) * 4096:number * 4096] = np.frombuffer(part, np.uint8)
    shared = keys.sparkSession.sparkContext.broadcast(filled)

    @F.arrow_udf("boolean")
    def is_set(places: pa.Array) -> pa.Array:
        at = places.to_numpy(zero_copy_only=False)
        return pa.array((shared.value[at >> 3] >> (at & 7) & 1).astype(bool))

    return lambda column: is_set(place(column))


def _by_join(df: DataFrame, text: Column, words: DataFrame) -> DataFrame:
    """Texts that share an anchor with a keyword are compared with that keyword.

    A keyword's anchor is its longest word.  The rows are checkpointed with a
    number each, so a lost executor gives them the same numbers again.  Only
    numbers and those anchors that a keyword may have are shuffled: a keyword of
    one word is found with its anchor, and for the others a text comes to its
    candidates once, by its number.
    """
    checkpoint_root(df.sparkSession)
    row, low, anchor, word, single = "__row", "__lowered", "__anchor", "__word", "__single"
    own_words = F.regexp_extract_all(F.col(word), F.lit(f"({_WORD}+)"))
    longest = F.array_sort(own_words, lambda a, b: F.length(b) - F.length(a))
    keys = words.select(F.col(word), F.when(F.size(own_words) > 0, F.get(longest, F.lit(0)))
                        .otherwise(F.substring(word, 1, 1)).alias(anchor),
                        F.col(word).rlike(f"^{_WORD}+$").alias(single))
    rows = df.withColumn(row, F.monotonically_increasing_id()).checkpoint()
    lowered = F.lower(text)
    found = rows.select(row, F.explode(_anchors(lowered)).alias(anchor)).where(_may_be_in(keys, anchor)(F.col(anchor)))
    hits = found.join(keys.where(single), anchor, "left_semi").select(row)
    longer = keys.where(~F.col(single))
    if not longer.isEmpty():
        quoted = F.regexp_replace(F.col(word), r"([^\p{L}\p{N} ])", r"\\$1")
        pattern = F.concat(F.lit(r"(?U)(^|\W)("), quoted, F.lit(r")(\W|$)"))
        candidates = found.join(longer, anchor).select(row, word)
        hits = hits.union(candidates.join(rows.select(row, lowered.alias(low)), row)
                          .where(F.regexp_like(F.col(low), pattern)).select(row))
    return rows.join(hits.distinct(), row, "left_semi").drop(row)


def track_keyword_table(df: DataFrame, field: str, keywords: DataFrame, column: str, doc: str | None = None,
                        max_rows: int = AUTOMATON_ROWS, max_bytes: int = AUTOMATON_BYTES) -> DataFrame:
    """``track_keywords`` with the keywords of ``keywords[column]``.

    Keywords are trimmed, lower-cased and used once; null and empty ones count
    for nothing, and without any keyword no document is kept.  A table within
    ``max_rows`` and ``max_bytes`` becomes one Aho-Corasick automaton per
    Python worker (no shuffle, batch and stream); a larger one is joined by
    the words of the texts (batch).  Both give the rows of ``track_keywords``.
    A null text holds no keyword.
    """
    ref = P.resolve(df, field, doc)
    text = P.v_string(ref.column) if ref.is_variant else ref.column
    word = F.lower(F.regexp_replace(F.col(column), r"(?U)^\s+|\s+$", ""))
    words = _made_once(keywords.select(word.alias("__word")).where(F.col("__word") != "").distinct())
    if fits(words, max_rows, max_bytes):
        listed = [r[0] for r in words.collect()]
        return _by_automaton(df, text, listed) if listed else df.where(F.lit(False))
    return _by_join(df, text, words)


def hash_bucket(key: Column, buckets: int = SAMPLE_BUCKETS) -> Column:
    """``conv(first 8 hex digits of md5(key), 16, 10) % buckets``."""
    h = F.conv(F.substring(F.md5(key.cast("string")), 1, 8), 16, 10).cast("bigint")
    return F.pmod(h, F.lit(buckets))


def sample_stream(df: DataFrame, key: str | None, fraction: float, method: str = "hash",
                  seed: int = 42, buckets: int = SAMPLE_BUCKETS) -> DataFrame:
    """Keep about ``fraction`` of the documents."""
    if not 0.0 <= fraction <= 1.0:
        raise ValueError("fraction must be within [0, 1]")
    if method == "random":
        return df.sample(fraction=fraction, seed=seed)
    if key is None:
        raise ValueError("hash sampling needs a key column")
    while fraction > 0 and fraction * buckets < 100 and buckets < 1 << 31:
        buckets *= 10  # finer buckets, so that a small fraction keeps its share
    keep = int(round(fraction * buckets))
    return df.where(hash_bucket(F.col(key), buckets) < F.lit(keep))
