"""Soft-membership mixing: document rates whose expected domain token totals match target weights.

1. A classifier learns domains from a labelled table.  Word counts per domain
   of one half of the labelled sample give log-odds per (hashed) word; a
   softmax regression on the other half turns a text's mean and largest
   log-odds into posteriors, so rare words of the first half are not trusted
   more than they deserve.  The sample is bounded by ``MAX_LABELLED`` rows, the
   only bound in here; the model's size depends on the number of domains alone.
2. Every document gets posteriors p over the domains and its token count t.
3. Rates r >= 0 minimise
   sum_k (sum_d r t p_k / N - T_k)^2 / 2 + RIDGE sum_d t (r - 1)^2 / 2N,
   N being all tokens and T the target shares.  Projected gradient with
   momentum, preconditioned by t / N: one step is
   r <- max(0, r - step (p . g + RIDGE (r - 1))), where the residuals g are one
   number per domain, summed up by Spark over all documents in each step.  A
   rate is thus a function of the document's posteriors and of the residuals
   so far, which are all that the driver keeps.
4. A rate becomes floor(r) copies and one more with probability r - floor(r),
   by a hash of the id: the same documents are chosen in every run.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Carried, materialise, mixed, pick, utf8_parts

#: Labelled rows that the classifier is fitted on at most (those with the smallest hashes of the id).
MAX_LABELLED = 20_000
BUCKETS = 1 << 15
#: Weight of the background in the word rates, as a number of words.
SMOOTHING = 10.0
RIDGE = 1e-3
#: Features besides two per domain: shares of signs and of capitals, length, one.
EXTRA = 4
STEPS = 40
TOLERANCE = 1e-4

_BASE = 0x9E3779B97F4A7C15 | 1
_MASK = (1 << 64) - 1


#: A-Z as a-z; 0 for white space and control characters, 1 for word bytes, 2 for other signs.
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_KIND = np.full(256, 2, np.uint8)
_KIND[:33] = 0
_KIND[48:58] = _KIND[97:123] = _KIND[128:] = 1


def words_of(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash, row) of every word of the texts between ``bounds``.

    A word is a run of letters, digits and multi-byte characters (A-Z as a-z),
    or a run of other characters that are not white space.
    """
    n_rows = len(bounds) - 1
    lengths = np.diff(bounds)
    padded = np.full(len(data) + n_rows + 1, 0x20, np.uint8)  # a space before each text and at the end
    padded[np.arange(len(data)) + np.repeat(np.arange(n_rows) + 1, lengths)] = data
    padded = _LOWER[padded]
    kind = _KIND[padded]
    cuts = np.flatnonzero(np.diff(kind)) + 1  # the first and the last byte are spaces
    run = kind[cuts[:-1]] > 0 if len(cuts) else np.zeros(0, np.bool_)
    begin, end = cuts[:-1][run], cuts[1:][run]
    # polynomial hashes modulo 2^64 from one running sum
    n = len(padded)
    inverse = np.full(n, pow(_BASE, -1, 1 << 64), np.uint64)
    inverse[:1] = 1
    powers = np.multiply.accumulate(inverse)
    sums = np.concatenate([[np.uint64(0)], np.cumsum((padded.astype(np.uint64) + np.uint64(1)) * powers)])
    lift = np.full(n, _BASE & _MASK, np.uint64)
    lift[:1] = 1
    hashed = mixed((sums[end] - sums[begin]) * np.multiply.accumulate(lift)[begin])
    row = np.searchsorted(bounds[:-1] + np.arange(n_rows) + 1, begin, side="right") - 1
    return hashed, row


@dataclass
class DomainModel:
    """Log-odds of hashed words by domain, and a softmax regression on top."""

    domains: list[str]
    odds: np.ndarray  # (domains, buckets)
    weights: np.ndarray = field(default_factory=lambda: np.zeros((0, 0)))

    def features(self, column) -> tuple[np.ndarray, np.ndarray]:
        """((texts, features), tokens of each text)."""
        data, bounds = utf8_parts(column)
        n_rows, k = len(bounds) - 1, len(self.domains)
        hashed, row = words_of(data, bounds)
        bucket = (hashed & np.uint64(BUCKETS - 1)).astype(np.int64)
        tokens = np.bincount(row, minlength=n_rows)
        out = np.zeros((n_rows, 2 * k + EXTRA))
        out[:, -1] = 1
        out[:, -2] = np.log1p(tokens) / 10
        owner = np.repeat(np.arange(n_rows), np.diff(bounds))
        size = np.maximum(1, np.diff(bounds))
        out[:, -3] = np.bincount(owner[(data >= 65) & (data < 91)], minlength=n_rows) / size
        out[:, -4] = np.bincount(owner[_KIND[_LOWER[data]] == 2], minlength=n_rows) / size
        some = np.flatnonzero(tokens)
        if len(some):
            first = np.concatenate([[0], np.cumsum(tokens[some])[:-1]])
            for i in range(k):
                odds = self.odds[i, bucket]
                out[some, i] = np.add.reduceat(odds, first) / tokens[some]
                out[some, k + i] = np.maximum.reduceat(odds, first)
        return out, tokens

    def posteriors(self, features: np.ndarray) -> np.ndarray:
        z = features @ self.weights
        z -= z.max(axis=1, keepdims=True)
        p = np.exp(z)
        return p / p.sum(axis=1, keepdims=True)


def fit_softmax(features: np.ndarray, label: np.ndarray, n_classes: int, steps: int = 60) -> np.ndarray:
    """Weights of a ridge-penalised softmax regression (Newton steps with Boehning's fixed Hessian bound)."""
    n, d = features.shape
    weights = np.zeros((d, n_classes))
    if not n:
        return weights
    truth = np.eye(n_classes)[label]
    hessian = 0.5 * features.T @ features / n + 1e-4 * np.eye(d)
    for _ in range(steps * 5):
        z = features @ weights
        p = np.exp(z - z.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        weights -= np.linalg.solve(hessian, features.T @ (p - truth) / n + 1e-4 * weights)
    return weights


def learn_domains(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED) -> DomainModel:
    """Fit on ``docs`` (id, text) joined with ``labels`` (id, domain).

    An id that is labelled more than once takes its smallest domain; null ids,
    texts and domains teach nothing.
    """
    sample = (labels.filter("id IS NOT NULL AND domain IS NOT NULL").groupBy("id").agg(F.min("domain").alias("domain"))
              .orderBy(F.xxhash64("id"), "id").limit(max_labelled))
    sample = materialise(sample.withColumn("odd", F.xxhash64(F.lit("half"), "id") % 2 == 0), "mix-labels")
    chosen = materialise(docs.filter("text IS NOT NULL")
                         .join(F.broadcast(sample), "id").select("domain", "odd", "text"), "mix-sample")
    domains = sorted(r.domain for r in sample.select("domain").distinct().collect())
    number = {d: i for i, d in enumerate(domains)}
    model = DomainModel(domains, np.zeros((len(domains), BUCKETS)))
    if not domains:
        return model

    def count(batches):
        totals = np.zeros(len(domains) * BUCKETS, np.int64)
        for batch in batches:
            hashed, row = words_of(*utf8_parts(batch.column("text")))
            code = np.array([number[d] for d in batch.column("domain").to_pylist()], np.int64)
            if len(row):
                totals += np.bincount(code[row] * BUCKETS + (hashed & np.uint64(BUCKETS - 1)).astype(np.int64),
                                      minlength=len(totals))
        at = np.flatnonzero(totals)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(totals[at])], names=["cell", "n"])

    cells = (chosen.filter("odd").select("domain", "text").mapInArrow(count, "cell long, n long")
             .groupBy("cell").agg(F.sum("n").alias("n")))  # at most domains x buckets rows
    counts = np.zeros(len(domains) * BUCKETS)
    for r in cells.toLocalIterator():
        counts[r.cell] = r.n
    counts = counts.reshape(len(domains), BUCKETS)
    background = (counts.sum(axis=0) + 0.5) / (counts.sum() + 0.5 * BUCKETS)
    rates = (counts + SMOOTHING * background) / (counts.sum(axis=1, keepdims=True) + SMOOTHING)
    # a word is trusted by how often it was seen: seldom seen words stay near zero
    seen = counts.sum(axis=0)
    model.odds = np.log(rates / background) * (seen / (seen + SMOOTHING))

    def describe(batches):
        for batch in batches:
            features, _ = model.features(batch.column("text"))
            yield pa.RecordBatch.from_arrays(
                [batch.column("domain"), pa.array(list(features), pa.list_(pa.float64()))], names=["domain", "f"])

    # at most ``max_labelled`` rows of a few numbers
    rows = chosen.filter("not odd").select("domain", "text").mapInArrow(
        describe, "domain string, f array<double>").collect()
    model.weights = fit_softmax(np.array([r.f for r in rows]).reshape(len(rows), 2 * len(domains) + EXTRA),
                                np.array([number[r.domain] for r in rows], np.int64), len(domains))
    return model


@dataclass
class Rates:
    """The steps taken so far; replaying them gives the rates for any posteriors."""

    start: np.ndarray
    step: float
    residuals: list[np.ndarray] = field(default_factory=list)

    def of(self, p: np.ndarray) -> np.ndarray:
        return self._run(p)[0]

    def _run(self, p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(rates, the point at which the next gradient is taken)."""
        rate = np.maximum(0, 1 - p @ self.start)
        point, momentum = rate, 1.0
        for g in self.residuals:
            new = np.maximum(0, point - self.step * (p @ g + RIDGE * (point - 1)))
            after = (1 + np.sqrt(1 + 4 * momentum * momentum)) / 2
            point = new + (momentum - 1) / after * (new - rate)
            rate, momentum = new, after
        return rate, point


def _sums(table: DataFrame, width: int, row) -> np.ndarray:
    """Sum over all rows of the vectors ``row(p, tokens)`` gives, one partial sum per task."""

    def add(batches):
        total = np.zeros(width)
        for batch in batches:
            p = np.array(batch.column("p").flatten()).reshape(batch.num_rows, -1)
            total += row(p, batch.column("tokens").to_numpy())
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(width)), pa.array(total)], names=["i", "x"])

    out = np.zeros(width)
    for r in table.mapInArrow(add, "i long, x double").groupBy("i").agg(F.sum("x").alias("x")).collect():
        out[r.i] = r.x
    return out


def fit_rates(table: DataFrame, targets: np.ndarray, budget: float = 1.0) -> Rates:
    """Projected gradient over ``table`` (p, tokens; stored); ``targets`` are shares that sum to one."""
    k = len(targets)
    first = _sums(table, k * k + k + 1, lambda p, t: np.concatenate(
        [(p * t[:, None]).T.dot(p).ravel(), (p * t[:, None]).sum(axis=0), [t.sum()]]))
    n = max(first[-1], 1.0)
    gram, share = first[:k * k].reshape(k, k) / n, first[k * k:-1] / n
    goal = targets * budget
    # begin where the gradient without the constraint vanishes
    start = np.linalg.solve(gram + RIDGE * np.eye(k), share - goal)
    rates = Rates(start, 1 / (float(np.linalg.eigvalsh(gram).max()) + RIDGE))
    last = np.inf
    for _ in range(STEPS):
        def both(p, t, so_far=rates):
            rate, point = so_far._run(p)
            return np.concatenate([((rate * t)[:, None] * p).sum(axis=0), ((point * t)[:, None] * p).sum(axis=0)])
        sums = _sums(table, 2 * k, both) / n
        off = float(np.abs(sums[:k] - goal).max())
        if off < TOLERANCE or abs(last - off) < TOLERANCE / 100:
            break
        last = off
        rates = Rates(rates.start, rates.step, [*rates.residuals, sums[k:] - goal])
    return rates


def _with_posteriors(docs: DataFrame, text: str, model: DomainModel, rates: Rates | None = None,
                     keep_text: bool = False) -> DataFrame:
    """``docs`` with tokens, p and, given ``rates``, rate."""
    kept = [f.name for f in docs.schema.fields if f.name != text or keep_text]
    schema = T.StructType([*[docs.schema[c] for c in kept], T.StructField("tokens", T.LongType()),
                           T.StructField("p", T.ArrayType(T.DoubleType())),
                           *([T.StructField("rate", T.DoubleType())] if rates else [])])
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            features, tokens = shared.value.features(batch.column(text))
            p = shared.value.posteriors(features)
            columns = [*[batch.column(c) for c in kept], pa.array(tokens.astype(np.int64)),
                       pa.ListArray.from_arrays(pa.array(np.arange(len(p) + 1) * p.shape[1], pa.int32()),
                                                pa.array(p.ravel()))]
            if rates:
                columns.append(pa.array(rates.of(p)))
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return docs.mapInArrow(run, schema)


def copies_of(rate, row_id):
    """floor(rate), and one more if the hash of the id falls below the rest."""
    share = F.pmod(F.xxhash64(F.lit("copies"), row_id), F.lit(1 << 30)) / F.lit(float(1 << 30))
    return (F.floor(rate) + F.when(share < rate - F.floor(rate), 1).otherwise(0)).cast("long")


def _checked(targets: dict[str, float], domains: list[str]) -> np.ndarray:
    weights = np.array([float(targets.get(d, 0.0)) for d in domains])
    if (weights < 0).any() or not weights.sum() > 0:
        raise ValueError(f"targets {targets} need positive weight on one of the domains {domains}")
    return weights / weights.sum()


def mix(docs: DataFrame, labels: DataFrame, targets: dict[str, float], id_col: str = "doc_id",
        text_col: str = "text", budget: float = 1.0) -> DataFrame:
    """``doc_id, tokens, posteriors (map by domain), rate, copies`` for every row of ``docs``.

    ``labels`` has the columns id and domain; ``budget`` is the wanted total
    as a multiple of the input's tokens.  A null text counts as empty: no
    tokens, posteriors by length alone.  Without labels every rate is 1.
    Repeated rows get equal results; an empty table gives an empty table.
    """
    base = pick(docs, id=id_col, text=text_col)
    model = learn_domains(base, labels)
    if not model.domains:
        return base.select(F.col("id").alias("doc_id"), F.lit(0).cast("long").alias("tokens"),
                           F.lit(None).cast("map<string,double>").alias("posteriors"),
                           F.lit(1.0).alias("rate"), F.lit(1).cast("long").alias("copies"))
    table = materialise(_with_posteriors(base, "text", model), "mix-posteriors")
    rates = fit_rates(table, _checked(targets, model.domains), budget)

    def apply(batches):
        for batch in batches:
            p = np.array(batch.column("p").flatten()).reshape(batch.num_rows, -1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(rates.of(p))],
                                             names=[*batch.schema.names, "rate"])

    rated = table.mapInArrow(apply, T.StructType([*table.schema.fields, T.StructField("rate", T.DoubleType())]))
    names = F.array(*[F.lit(d) for d in model.domains])
    return rated.select(F.col("id").alias("doc_id"), "tokens", F.map_from_arrays(names, "p").alias("posteriors"),
                        "rate", copies_of(F.col("rate"), F.col("id")).alias("copies"))


def mixed_corpus(docs: DataFrame, labels: DataFrame, targets: dict[str, float], id_col: str = "doc_id",
                 text_col: str = "text", budget: float = 1.0) -> DataFrame:
    """The rows of ``docs``, each as often as its copies say."""
    carried = Carried(docs)
    own = [f"c{i}" for i in range(len(carried.names))]
    base = pick(docs, id=id_col, text=text_col)
    model = learn_domains(base, labels)
    if not model.domains:
        return docs
    table = materialise(_with_posteriors(base, "text", model), "mix-posteriors")
    rates = fit_rates(table, _checked(targets, model.domains), budget)
    text = f"c{carried.names.index(text_col)}"
    rated = _with_posteriors(carried.df, text, model, rates, keep_text=True)
    copies = copies_of(F.col("rate"), carried.col(id_col))
    return (rated.withColumn("copy", F.explode(F.array_repeat(F.lit(1), copies.cast("int"))))
            .select(*own).toDF(*carried.names))


#: Target shares of tokens by domain of the labelled table.
TARGETS = {"good": 0.88, "poor": 0.09, "toxic": 0.03}


def labelled_domains(labels: DataFrame) -> DataFrame:
    """(id, domain) of the table ``labels``: toxic, else good or poor by quality."""
    base = pick(labels, id="doc_id", quality="quality", toxic="toxic")
    return base.select("id", F.when(F.col("toxic") == 1, "toxic").when(F.col("quality") == 1, "good")
                       .when(F.col("quality") == 0, "poor").alias("domain"))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its domain posteriors, its rate and its copies."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = labelled_domains(spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return mix(docs, labels, TARGETS)
