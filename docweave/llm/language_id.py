"""Language ID by language-bitmask n-gram filters.

Training counts the byte n-grams of all labelled texts per language in Spark.
An n-gram belongs to a language if its rate there is at least ``MIN_RATE`` and
at least ``MIN_SHARE`` of its rate in the language that uses it most; by the
first condition a language has at most 1 / MIN_RATE n-grams, so the filter has
a proven size bound that does not grow with the corpus.

The n-grams go into a bit-sliced Bloom filter: slot s of the table is a bit
mask of languages, bit l of all slots being the Bloom filter of language l.
One probe of ``PROBES`` slots, ANDed, returns *all* languages that contain an
n-gram.  For a text, a popcount per language over its n-grams gives the number
of hits; a language without the n-gram still hits with its filter's
false-positive rate f, so the estimate is (hits - n f) / (n (1 - f)), at least
zero.  The language with the largest estimate wins (ties: the first name in
order; no hits at all: the language with most training text); the score is that
estimate, a share of the text's n-grams.

N-grams are taken from the text's UTF-8 bytes with ASCII letters in lower
case, within words (a space is put on either side); bytes that are neither
ASCII letters nor part of a multi-byte character separate words.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialise, mixed, pick, utf8_parts

#: Bytes of an n-gram.
N = 4
MIN_RATE = 2e-5
MIN_SHARE = 0.25
PROBES = 3
#: Slots of the table for each n-gram of the language that has most.
SLOTS_PER_GRAM = 16
UNKNOWN = "und"
#: Distinct (language, n-gram) pairs that a training task holds before it passes them on.
HELD = 1 << 19

_LETTER = regex.compile(r"\p{L}")
_SPACE = 0x20


def _folded(data: np.ndarray) -> np.ndarray:
    """Lower-case ASCII letters and bytes of multi-byte characters; all others as a space."""
    table = np.full(256, _SPACE, np.uint8)
    table[128:] = np.arange(128, 256)
    table[97:123] = np.arange(97, 123)
    table[65:91] = np.arange(97, 123)
    return table[data]


def grams_of(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(n-grams as integers, row of each) of the texts that lie between ``bounds``.

    A text is treated as if a space stood before and after it; an n-gram may
    begin or end with a space but has none inside.
    """
    n_rows = len(bounds) - 1
    lengths = np.diff(bounds)
    padded = np.full(len(data) + 2 * n_rows, _SPACE, np.uint8)
    starts = bounds[:-1] + 2 * np.arange(n_rows) + 1
    place = np.repeat(starts - bounds[:-1], lengths) + np.arange(len(data))
    padded[place] = _folded(data)
    if len(padded) < N:
        return np.zeros(0, np.uint32), np.zeros(0, np.int64)
    wide = padded.astype(np.uint32)
    gram = wide[:len(padded) - N + 1].copy()
    space = padded == _SPACE
    inside = np.zeros(len(gram), np.bool_)
    for i in range(1, N):
        gram <<= np.uint32(8)
        gram |= wide[i:i + len(gram)]
        if i < N - 1:
            inside |= space[i:i + len(gram)]
    # a gram over two texts has their two spaces inside, unless it begins or ends there
    keep = np.flatnonzero(~inside)
    row = np.repeat(np.arange(n_rows), lengths + 2)[keep]
    return gram[keep], row


def count_grams(labelled: DataFrame) -> DataFrame:
    """(lang, gram, n) over all rows of ``labelled`` (columns lang, text; no null lang)."""

    def run(batches):
        names: list[str] = []
        codes: dict[str, int] = {}
        keys, counts, held = [], [], 0

        def merged():
            values, where = np.unique(np.concatenate(keys), return_inverse=True)
            return values, np.bincount(where, np.concatenate(counts)).astype(np.int64)

        def out(values, n):
            return pa.RecordBatch.from_arrays(
                [pa.array(names, pa.string()).take(pa.array((values >> np.uint64(32)).astype(np.int64))),
                 pa.array((values & np.uint64(0xFFFFFFFF)).astype(np.int64)), pa.array(n)],
                names=["lang", "gram", "n"])

        for batch in batches:
            if not batch.num_rows:
                continue
            code = np.empty(batch.num_rows, np.uint64)
            for i, lang in enumerate(batch.column("lang").to_pylist()):
                if lang not in codes:
                    codes[lang] = len(names)
                    names.append(lang)
                code[i] = codes[lang]
            gram, row = grams_of(*utf8_parts(batch.column("text")))
            values, n = np.unique(gram.astype(np.uint64) | (code[row] << np.uint64(32)), return_counts=True)
            keys.append(values)
            counts.append(n)
            held += len(values)
            if held > HELD:
                values, n = merged()
                if len(values) > HELD // 2:
                    yield out(values, n)
                    keys, counts, held = [], [], 0
                else:
                    keys, counts, held = [values], [n], len(values)
        if keys:
            yield out(*merged())

    parts = labelled.mapInArrow(run, "lang string, gram long, n long")
    return parts.groupBy("lang", "gram").agg(F.sum("n").alias("n"))


@dataclass
class LanguageFilter:
    """The bit-sliced Bloom filter: ``table[w][slot]`` holds 64 languages per word w."""

    languages: list[str]
    table: np.ndarray
    false_rate: np.ndarray
    usual: int = 0

    def masks(self, gram: np.ndarray) -> np.ndarray:
        """(words, n-grams): the languages that contain each n-gram."""
        out = None
        for slot in _slots(gram, self.table.shape[1]):
            found = self.table[:, slot]
            out = found if out is None else out & found
        return out

    def estimates(self, data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """(texts, languages): the corrected share of n-grams that are in the language."""
        n_rows = len(bounds) - 1
        gram, row = grams_of(data, bounds)
        total = np.bincount(row, minlength=n_rows).astype(float)
        out = np.zeros((n_rows, len(self.languages)))
        if not len(gram) or not self.languages:
            return out
        masks = self.masks(gram)
        for i in range(len(self.languages)):
            bit = (masks[i // 64] >> self.table.dtype.type(i % 64)) & self.table.dtype.type(1)
            hits = np.bincount(row, bit, minlength=n_rows)
            f = self.false_rate[i]
            out[:, i] = np.maximum(0, hits - f * total) / np.maximum(1, total) / max(1e-9, 1 - f)
        return np.minimum(out, 1)


def _slots(gram: np.ndarray, n_slots: int):
    """The slots that an n-gram probes: two halves of a 64-bit hash, doubly hashed."""
    hashed = mixed(gram.astype(np.uint64))
    a, b = hashed >> np.uint64(32), hashed & np.uint64(0xFFFFFFFF) | np.uint64(1)
    for i in range(PROBES):
        yield ((a + np.uint64(i) * b) & np.uint64(n_slots - 1)).astype(np.int64)


def build_filter(members: list[tuple[str, int]]) -> LanguageFilter:
    """The filter of (language, n-gram) pairs."""
    languages = sorted({lang for lang, _ in members})
    number = {lang: i for i, lang in enumerate(languages)}
    code = np.array([number[lang] for lang, _ in members], np.int64)
    gram = np.array([g for _, g in members], np.uint64)
    most = int(np.bincount(code).max()) if len(code) else 1
    n_slots = 1 << max(10, (SLOTS_PER_GRAM * most - 1).bit_length())
    kind = np.uint8 if len(languages) <= 8 else np.uint64
    table = np.zeros((max(1, -(-len(languages) // 64)), n_slots), kind)
    for slot in _slots(gram, n_slots):
        for i in range(len(languages)):
            table[i // 64, slot[code == i]] |= kind(1 << (i % 64))
    filled = [float(((table[i // 64] >> kind(i % 64)) & kind(1)).mean()) for i in range(len(languages))]
    return LanguageFilter(languages, table, np.array(filled) ** PROBES)


def learn(docs: DataFrame) -> LanguageFilter:
    """Learn from the columns text and lang of ``docs``; null langs and texts teach nothing."""
    counted = materialise(count_grams(docs.filter("lang IS NOT NULL AND text IS NOT NULL")
                                      .select("lang", "text")), "language-grams")
    totals = counted.groupBy("lang").agg(F.sum("n").alias("total"))
    rated = (counted.join(F.broadcast(totals), "lang")  # one row per language
             .withColumn("rate", F.col("n") / F.col("total")).filter(F.col("rate") >= MIN_RATE))
    best = rated.groupBy("gram").agg(F.max("rate").alias("best"))
    chosen = rated.join(best, "gram").filter(F.col("rate") >= MIN_SHARE * F.col("best")).select("lang", "gram")
    # at most 1 / MIN_RATE rows per language, whatever the size of the corpus
    model = build_filter([(r.lang, r.gram) for r in chosen.toLocalIterator()])
    most = totals.orderBy(F.desc("total"), "lang").first()
    if most is not None and most.lang in model.languages:
        model.usual = model.languages.index(most.lang)
    return model


def identify(docs: DataFrame, text: str, model: LanguageFilter) -> DataFrame:
    """``docs`` without ``text``, with lang_pred and score.

    A text that is null or has no letters gets ``und`` with score 0, and so
    does every text if no language was learned.
    """
    from pyspark.sql import types as T

    kept = [f.name for f in docs.schema.fields if f.name != text]
    schema = T.StructType([*[docs.schema[k] for k in kept],
                           T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        known = shared.value
        names = [*known.languages, UNKNOWN]
        for batch in batches:
            if not batch.num_rows:
                continue
            column = batch.column(text)
            estimates = known.estimates(*utf8_parts(column))
            lettered = np.array([t is not None and _LETTER.search(t) is not None
                                 for t in column.to_pylist()], np.bool_)
            score = estimates.max(axis=1) if known.languages else np.zeros(batch.num_rows)
            best = estimates.argmax(axis=1) if known.languages else np.zeros(batch.num_rows, np.int64)
            best = np.where(score > 0, best, known.usual)
            sure = lettered & bool(known.languages)
            best = np.where(sure, best, len(known.languages))
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(k) for k in kept], pa.array(names, pa.string()).take(pa.array(best)),
                 pa.array(np.where(sure, score, 0.0))], names=[*kept, "lang_pred", "score"])

    return docs.mapInArrow(run, schema)


def held_out(doc_id):
    """Is crc32 of the id as text divisible by 5?  (A null id is never held out.)"""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(False))


def predict_languages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                      lang_col: str = "lang") -> DataFrame:
    """``doc_id, held_out, lang_pred, score`` for every row of ``docs``.

    Learns from text and lang of the rows that are not held out; predicts from
    the text alone.  Without a labelled row every prediction is ``und``.
    Repeated rows give repeated rows; an empty table an empty table.
    """
    base = pick(docs, doc_id=id_col, text=text_col, lang=lang_col)
    model = learn(base.filter(~held_out(F.col("doc_id"))))
    return identify(base.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text"), "text", model)


def drop_unidentified(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id",
                      lang_col: str = "lang") -> DataFrame:
    """The rows of ``docs`` whose text has a language.

    Rejected are null texts and texts without letters, and every text if no
    language was learned.  A text with letters but without a known n-gram
    stays: ``identify`` gives it a language too.
    """
    from .common import Carried

    carried = Carried(docs)
    base = pick(docs, doc_id=id_col, text=text_col, lang=lang_col)
    model = learn(base.filter(~held_out(F.col("doc_id"))))
    seen = identify(carried.df.withColumn("words", carried.col(text_col)), "words", model)
    learned = (F.col("score") > 0) | (F.col("lang_pred") != UNKNOWN)  # a label may be "und" itself
    return seen.filter(learned).drop("lang_pred", "score").toDF(*carried.names)


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The predicted language of every document."""
    return predict_languages(spark.read.parquet(f"{sf_dir}/documents.parquet"))
