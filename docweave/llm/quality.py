"""Quality rules: base counts per text, and n-gram perplexity bands per language.

The language model is an interpolated modified Kneser-Ney model of byte
5-grams over whole texts, one per language: a text is its words with one space
after each (and ``ORDER`` - 1 before the first), so that n-grams run across the
borders of words and the order of the words counts.

* Spark counts the 5-grams of all documents, equal texts once: each task sorts
  its own and passes on one partial count per n-gram.
* Lower orders use continuation counts (how many different bytes precede an
  n-gram).  Discounts D2, D3+ come from the counts of counts of each order and
  language; sums over a context are windows of at most 256 rows.  What was
  counted once is its own text's evidence, so above order 1 it is discounted
  whole (D1 = 1): it has its backoff probability and needs no entry.
* The model goes into sorted arrays of 64-bit n-gram hashes (per order the
  probability, per context the backoff weight), searched by bisection.  It is
  broadcast up to ``MAX_MODEL`` n-grams.  A larger model stays a table and the
  documents' distinct n-grams are joined with it; the scores are the same.

A text's score is its cross-entropy per byte, the logarithm of its perplexity.
For each language the quartiles of the scores of all documents that pass the
base rules, equal scores counted once, set a lower and an upper edge, each from
the spread on its own side of the median; documents outside are rejected.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import broadcast_within, materialise, mixed, pick, utf8_parts, utf8_rows

ORDER = 5
#: N-grams of all orders that are broadcast at most (16 bytes each).
MAX_MODEL = 6_000_000
#: Groups of equal texts that are broadcast at most (about 40 bytes each).
MAX_COPIED = 1_000_000
#: Distinct n-grams of a language that a task holds before it passes them on.
HELD_GRAMS = 1 << 20
#: N-grams that a task makes at once.
STEP = 1 << 19
#: Distance of a band's edges from the median in interquartile ranges of the language's scores.
BAND_RANGES = 6.0
#: Digits to which scores count as equal, and the slack of the edges: sums in another order differ by less.
SCORE_DIGITS = 9
SLACK = 1e-6
#: Documents without a language are judged among themselves.
NO_LANGUAGE = "und"

WHITE = b" \t\n\x0b\x0c\r"
SYMBOLS = b"#*$%&|<>"
MIN_WORDS = 50


# --- base rules -------------------------------------------------------------

def duplicate_lines(text: bytes) -> int:
    """Lines (split at line feeds) with a word that equal an earlier line."""
    lines = text.split(b"\n")
    if len(set(lines)) == len(lines):
        return 0
    seen, again = set(), 0
    for line in lines:
        if line in seen:
            again += bool(line.split())
        else:
            seen.add(line)
    return again


def repeated_words(numbers: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """For each text the words in 3-word windows that are found twice or more in it.

    ``numbers`` are those of all texts' words in order (equal for equal words),
    ``lengths`` the texts' numbers of words.  All windows are sorted at once.
    """
    ends = np.cumsum(lengths)
    text = np.repeat(np.arange(len(lengths)), lengths)
    begin = np.arange(max(len(numbers) - 2, 0))
    begin = begin[text[:len(begin)] == text[2:]] if len(begin) else begin
    n = numbers.astype(np.uint64)
    windows = mixed(mixed(mixed(n[begin] + (text[begin].astype(np.uint64) << np.uint64(40))) + n[begin + 1]) + n[begin + 2])
    order = np.argsort(windows)
    same = windows[order[1:]] == windows[order[:-1]]
    twice = np.zeros(len(begin), np.bool_)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    inside = np.zeros(len(numbers), np.bool_)
    for shift in range(3):
        inside[begin[twice] + shift] = True
    counted = np.concatenate([np.zeros(1, np.int64), np.cumsum(inside)])
    return counted[ends] - counted[ends - lengths]


def _per_row(flags: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """How many flags are set between the bounds of each row."""
    at = np.flatnonzero(flags)
    return np.diff(np.searchsorted(at, bounds)) if len(at) * 8 < len(flags) else \
        np.diff(np.concatenate([np.zeros(1, np.int64), np.cumsum(flags, dtype=np.int64)])[bounds])


_SOLID = np.array([c not in WHITE for c in range(256)])
_STARTS = np.array([c not in WHITE and c & 0xC0 != 0x80 for c in range(256)])
_SYMBOL = np.array([c in SYMBOLS for c in range(256)])


def byte_counts(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per text: bytes and code points outside white space, and symbols."""
    return tuple(_per_row(kind[data], bounds) for kind in (_SOLID, _STARTS, _SYMBOL))


def base_failed(n_words: Column, n_repeat_words: Column) -> Column:
    return (n_words < MIN_WORDS) | (n_repeat_words * 100 > n_words * 50)


# --- counting ---------------------------------------------------------------

def text_grams(texts: list[list[bytes]]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(n-grams as integers of ``ORDER`` bytes, text of each) of texts given as words, about ``STEP`` at once.

    A text has one n-gram for each byte of a word and for the space after it,
    with the ``ORDER`` - 1 bytes before.  A long text comes in several parts.
    """
    before = ORDER - 1
    parts: list[bytes] = []
    rows: list[int] = []

    def made():
        lengths = np.fromiter(map(len, parts), np.int64, len(parts)) - before
        at = np.arange(lengths.sum()) + np.repeat(before * np.arange(len(parts)), lengths)
        data = np.frombuffer(b"".join(parts), np.uint8)
        gram = np.zeros(len(at), np.uint64)
        for i in range(ORDER):
            gram = gram << np.uint64(8) | data[at + i]
        return gram, np.repeat(np.array(rows, np.int64), lengths)

    size = 0
    for row, words in enumerate(texts):
        if not words:
            continue
        whole = b" " * before + b" ".join(words) + b" "
        for k in range(0, len(whole) - before, STEP):
            parts.append(whole[k:k + STEP + before])
            rows.append(row)
            size += len(parts[-1])
            if size >= STEP:
                yield made()
                parts, rows, size = [], [], 0
    if parts:
        yield made()


def _added(counted: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Sorted n-grams with their counts, from several such pairs."""
    grams = np.concatenate([g for g, _ in counted])
    order = np.argsort(grams, kind="stable")  # runs that are sorted already
    grams = grams[order]
    first = np.flatnonzero(np.diff(grams, prepend=~grams[:1]))
    return grams[first], np.add.reduceat(np.concatenate([n for _, n in counted])[order], first)


def without_copies(docs: DataFrame, max_copied: int = MAX_COPIED) -> DataFrame:
    """``docs`` (doc_id, lang, text) with one document of each group of equal texts of a language.

    Copies are no further evidence: they would make their own text look usual.
    The hashes of all texts are grouped; the groups of two or more, with the
    smallest id of each, are broadcast up to ``max_copied`` groups, and only a
    larger table is joined by a shuffle.  Rows that repeat that id stay, and so
    do those of a group without ids.
    """
    keys = ["lang", "h", "bytes"]
    hashed = docs.withColumn("h", F.xxhash64("text")).withColumn("bytes", F.octet_length("text"))
    copied = materialise(hashed.groupBy(*keys).agg(F.min("doc_id").alias("stays"), F.count("*").alias("n"))
                         .filter("n > 1").drop("n"), "quality-copies")
    joined = hashed.join(broadcast_within(copied, max_copied), keys, "left")
    return joined.filter(F.col("stays").isNull() | F.col("doc_id").eqNullSafe(F.col("stays"))) \
        .select("lang", "text")


def count_grams(docs: DataFrame) -> DataFrame:
    """(lang, gram, n) over the columns lang (no nulls) and text."""

    def run(batches):
        held: dict[str, list] = {}  # of each language: what is added up, then single counts

        def out(lang):
            grams, n = _added(held.pop(lang))
            for k in range(0, len(grams), HELD_GRAMS):
                part = slice(k, k + HELD_GRAMS)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * len(grams[part]), pa.string()), pa.array(grams[part].astype(np.int64)),
                     pa.array(n[part].astype(np.int64))], names=["lang", "gram", "n"])

        for batch in batches:
            texts: dict[str, list] = {}
            for lang, text in zip(batch.column("lang").to_pylist(), utf8_rows(batch.column("text")), strict=True):
                texts.setdefault(lang, []).append(text.split())
            for lang, words in texts.items():
                own = held.setdefault(lang, [])
                for gram, _ in text_grams(words):
                    own.append(np.unique(gram, return_counts=True))
                    if sum(len(g) for g, _ in own[1:]) > max(HELD_GRAMS, len(own[0][0])):
                        own[:] = [_added(own)]
            while sum(len(g) for own in held.values() for g, _ in own) > 6 * HELD_GRAMS:
                yield from out(max(held, key=lambda lang: sum(len(g) for g, _ in held[lang])))
        for lang in sorted(held):
            if held[lang]:
                yield from out(lang)

    parts = docs.select("lang", "text").mapInArrow(run, "lang string, gram long, n long")
    return parts.groupBy("lang", "gram").agg(F.sum("n").alias("n"))


# --- the model --------------------------------------------------------------

def kneser_ney(counts: DataFrame) -> list[DataFrame]:
    """Per order 1..ORDER a stored table (lang, gram, p, context, gamma, own).

    ``gram`` holds the order's bytes, ``context`` all but the last of them;
    ``p`` is the interpolated probability, ``own`` its part from this order, and
    ``gamma`` the context's backoff weight.
    """
    orders = {ORDER: counts.select("lang", "gram", "n")}
    for k in range(ORDER - 1, 0, -1):
        # different bytes before each n-gram; the first byte is cut off
        suffix = F.col("gram").bitwiseAND(F.lit((1 << (8 * k)) - 1))
        orders[k] = materialise(orders[k + 1].groupBy("lang", suffix.alias("gram"))
                                .agg(F.count("*").alias("n")), "kn-counts")
    tables: list[DataFrame] = []
    for k in range(1, ORDER + 1):
        level = orders[k].withColumn("context", F.shiftright("gram", 8))
        kinds = [F.sum(F.when(F.col("n") == i, 1.0).otherwise(0.0)).alias(f"t{i}") for i in range(1, 5)]
        y = F.try_divide(F.col("t1"), F.col("t1") + 2 * F.col("t2"))

        def discount(i: int, y: Column = y) -> Column:
            estimate = i - (i + 1) * F.try_divide(y * F.col(f"t{i + 1}"), F.col(f"t{i}"))
            usual = 0.5 * i if i < 3 else 1.5  # without such counts, or outside the range that makes sense
            return F.when((estimate > 0) & (estimate < i), estimate).otherwise(F.lit(usual))

        # one row per language
        discounts = F.broadcast(level.groupBy("lang").agg(*kinds).select(
            "lang", *[discount(i).alias(f"d{i}") for i in (1, 2, 3)]))
        by = Window.partitionBy("lang", "context")
        taken = F.when(F.col("n") == 1, F.col("d1") if k == 1 else F.lit(1.0)).when(F.col("n") == 2, F.col("d2")).otherwise(F.col("d3"))
        level = (level.join(discounts, "lang").withColumn("taken", F.least(taken, F.col("n").cast("double")))
                 .withColumn("total", F.sum("n").over(by))
                 .withColumn("gamma", F.sum("taken").over(by) / F.col("total"))
                 .withColumn("own", (F.col("n") - F.col("taken")) / F.col("total")))
        if k == 1:
            level = level.withColumn("p", F.col("own") + F.col("gamma") / 256)
        else:
            shorter = tables[-1].select("lang", F.col("gram").alias("suffix"), F.col("p").alias("lower"))
            level = (level.withColumn("suffix", F.col("gram").bitwiseAND(F.lit((1 << (8 * (k - 1))) - 1)))
                     .join(shorter, ["lang", "suffix"])
                     .withColumn("p", F.col("own") + F.col("gamma") * F.col("lower")))
        tables.append(materialise(level.select("lang", "gram", "p", "context", "gamma", "own"), "kn-model"))
    return tables


def gram_hash(gram: np.ndarray, order: int, lang) -> np.ndarray:
    """A bijective hash of an n-gram of up to 5 bytes with its order and language (one, or one for each)."""
    return mixed(gram.astype(np.uint64) | np.uint64(order << 40) | np.uint64(lang) << np.uint64(44))


class HashedModel:
    """Sorted arrays of n-gram hashes with log probabilities, and of contexts with log backoffs."""

    def __init__(self, languages: list[str], grams: tuple[np.ndarray, np.ndarray],
                 contexts: tuple[np.ndarray, np.ndarray]):
        self.number = {lang: i for i, lang in enumerate(languages)}
        self.keys, self.values = self._sorted(*grams)
        self.context_keys, self.gammas = self._sorted(*contexts)

    @staticmethod
    def _sorted(keys, values):
        order = np.argsort(keys)
        return keys[order], values[order]

    @staticmethod
    def _find(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not len(keys):
            return np.zeros(len(wanted), np.int64), np.zeros(len(wanted), np.bool_)
        at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
        return at, keys[at] == wanted

    def log_p(self, gram: np.ndarray, lang: str) -> np.ndarray:
        """Log probability of the last byte given those before it, backing off where unseen."""
        number = self.number.get(lang)
        out = np.full(len(gram), -np.log(256.0))
        if number is None or not len(gram):
            return out
        weight = np.zeros(len(gram))
        todo = np.arange(len(gram))
        for order in range(ORDER, 0, -1):
            part = gram[todo] & np.uint64((1 << (8 * order)) - 1)
            at, found = self._find(self.keys, gram_hash(part, order, number))
            out[todo[found]] = weight[todo[found]] + self.values[at[found]]
            todo, part = todo[~found], part[~found]
            if not len(todo):
                return out
            at, known = self._find(self.context_keys, gram_hash(part >> np.uint64(8), order, number))
            weight[todo[known]] += self.gammas[at[known]]
        out[todo] = weight[todo] - np.log(256.0)
        return out


def entries(table: DataFrame) -> DataFrame:
    """The n-grams whose probability is not that of backing off."""
    return table.filter("own > 0")


def hashed_model(tables: list[DataFrame]) -> HashedModel:
    """Collect the stored tables into sorted arrays (the caller has checked their size)."""
    languages = sorted(r.lang for r in tables[0].select("lang").distinct().collect())
    number = {lang: i for i, lang in enumerate(languages)}

    def hashed(rows: pa.Table, key: str, value: str, order: int) -> tuple[np.ndarray, np.ndarray]:
        code = rows.column("lang").combine_chunks().dictionary_encode()
        lang = np.array([number[x] for x in code.dictionary.to_pylist()], np.int64)[code.indices.to_numpy()]
        return gram_hash(rows.column(key).to_numpy(), order, lang), rows.column(value).to_numpy()

    grams, contexts = [], []
    for order, table in enumerate(tables, 1):
        grams.append(hashed(entries(table).select("lang", "gram", F.log("p").alias("p")).toArrow(),
                            "gram", "p", order))
        # a context without entries backs off at weight 1, as an unknown one does
        contexts.append(hashed(table.filter("gamma < 1").groupBy("lang", "context")
                               .agg(F.log(F.first("gamma")).alias("g")).toArrow(), "context", "g", order))
    return HashedModel(languages, *[tuple(map(np.concatenate, zip(*part, strict=True))) for part in (grams, contexts)])


# --- scoring ----------------------------------------------------------------

def measure(docs: DataFrame, model: HashedModel | None) -> DataFrame:
    """``docs`` (lang, text, others) without text: the base counts, and the score if a model is given.

    The score is the cross-entropy in nats per byte (a word's bytes and one
    for the space after it); null for texts without words.
    """
    kept = [f.name for f in docs.schema.fields if f.name != "text"]
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    schema = T.StructType([*[docs.schema[c] for c in kept], *[T.StructField(n, T.LongType()) for n in names],
                           T.StructField("score", T.DoubleType())])
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        known = shared.value
        for batch in batches:
            data, bounds = utf8_parts(batch.column("text"))
            texts = list(utf8_rows(batch.column("text")))
            words = [text.split() for text in texts]
            n_words = np.fromiter(map(len, words), np.int64, len(words))
            each = list(chain.from_iterable(words))
            number = {w: i for i, w in enumerate(dict.fromkeys(each))}
            n_repeat = repeated_words(np.fromiter(map(number.__getitem__, each), np.int64, len(each)), n_words)
            total = np.zeros(len(texts))
            langs = np.array(batch.column("lang").to_pylist(), object)
            for lang in dict.fromkeys(langs.tolist()) if known is not None else ():
                rows = np.flatnonzero(langs == lang)
                for gram, text in text_grams([words[r] for r in rows.tolist()]):
                    values, where = np.unique(gram, return_inverse=True)
                    total[rows] += np.bincount(text, known.log_p(values, lang)[where], minlength=len(rows))
            solid, chars, symbols = byte_counts(data, bounds)
            lines = np.fromiter(map(duplicate_lines, texts), np.int64, len(texts))
            score = -total / np.maximum(solid + n_words, 1)
            none = (n_words == 0) | (known is None)
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(c) for c in kept],
                 *[pa.array(c.astype(np.int64)) for c in (n_words, chars, symbols, lines, n_repeat)],
                 pa.array(score, pa.float64(), mask=none)], names=schema.names)

    return docs.mapInArrow(run, schema)


def score_by_join(docs: DataFrame, top: DataFrame) -> DataFrame:
    """(row, score) of ``docs`` (row, lang, text) by a join with the highest order's table.

    Every n-gram of the documents is in the table, since all documents were
    counted, so no backoff is needed.  One row per document and distinct n-gram.
    """

    def run(batches):
        for batch in batches:
            ids = batch.column("row").to_numpy()
            langs = batch.column("lang").to_pylist()
            for gram, text in text_grams([text.split() for text in utf8_rows(batch.column("text"))]):
                values, n = np.unique(gram | text.astype(np.uint64) << np.uint64(8 * ORDER), return_counts=True)
                text = (values >> np.uint64(8 * ORDER)).astype(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids[text]), pa.array([langs[t] for t in text.tolist()], pa.string()),
                     pa.array((values & np.uint64((1 << 8 * ORDER) - 1)).astype(np.int64)), pa.array(n.astype(np.int64))],
                    names=["row", "lang", "gram", "n"])

    grams = docs.select("row", "lang", "text").mapInArrow(run, "row long, lang string, gram long, n long")
    return (grams.join(top.select("lang", "gram", F.log("p").alias("log_p")), ["lang", "gram"])
            .groupBy("row").agg((-F.sum(F.col("n") * F.col("log_p")) / F.sum("n")).alias("score")))


def score_bands(scored: DataFrame) -> DataFrame:
    """(lang, low, high) from the columns lang and score.

    An edge lies ``BAND_RANGES`` interquartile ranges from the median; on a side
    with the longer half of the range, so many times twice that half.  Copies
    of a text have one score, which counts once, so that they do not narrow it.
    """
    different = scored.select("lang", F.round("score", SCORE_DIGITS).alias("score")).distinct()
    quartiles = different.groupBy("lang").agg(F.percentile_approx("score", [0.25, 0.5, 0.75], 10_000).alias("q"))
    q1, q2, q3 = (F.col("q")[i] for i in range(3))
    below = BAND_RANGES * F.greatest(q3 - q1, 2 * (q2 - q1)) + SLACK
    above = BAND_RANGES * F.greatest(q3 - q1, 2 * (q3 - q2)) + SLACK
    return quartiles.select("lang", (q2 - below).alias("low"), (q2 + above).alias("high"))


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
          max_model: int = MAX_MODEL) -> DataFrame:
    """Every row of ``docs`` with its counts, score, bands and verdict.

    Columns ``doc_id, lang, n_words, word_chars, n_symbols, n_dup_lines,
    n_repeat_words, score, low, high, base_failed, kept``.  A null text has no
    words and fails the base rules; a null language is the language ``und``;
    repeated rows get equal results; an empty table gives an empty table.
    """
    base = pick(docs, doc_id=id_col, lang=lang_col, text=text_col)
    base = base.withColumn("lang", F.coalesce(F.col("lang").cast("string"), F.lit(NO_LANGUAGE)))
    tables = kneser_ney(materialise(count_grams(without_copies(base)), "kn-counts"))
    if sum(entries(t).count() for t in tables) <= max_model:
        measured = materialise(measure(base, hashed_model(tables)), "quality-scores")
    else:
        rows = materialise(base.withColumn("row", F.monotonically_increasing_id()), "quality-rows")
        scores = score_by_join(rows, tables[-1])
        measured = materialise(measure(rows, None).drop("score").join(scores, "row", "left").drop("row"),
                               "quality-scores")
    failed = base_failed(F.col("n_words"), F.col("n_repeat_words"))
    bands = score_bands(measured.filter(~failed))
    out = measured.join(F.broadcast(bands), "lang", "left").withColumn("base_failed", failed)
    within = F.coalesce(F.col("score").between(F.col("low"), F.col("high")), F.lit(False))
    return out.withColumn("kept", ~F.col("base_failed") & within).select(
        "doc_id", "lang", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        "score", "low", "high", "base_failed", "kept")


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its base counts and whether it is kept."""
    return judge(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("lang")
