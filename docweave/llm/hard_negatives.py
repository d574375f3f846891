"""Hard negatives: threshold joins of query vectors with all vectors, by L2AP's bounds.

Anchors come in blocks of ``BLOCK`` that are broadcast; every task joins one
with its own vectors, tile by tile:

* Dimensions are ordered by the anchors' energy.  A vector's *index* holds its
  leading dimensions only: it ends where, for every anchor ``a``, the norm of
  what is left of the vector times that of ``a`` is below the anchor's
  threshold, so that no pair can reach it by the rest alone.
* Vectors of a tile are ordered by the length of their index, which makes the
  posting lists of a run of dimensions one leading slice.  Partial scores are
  accumulated run by run; a pair whose partial score plus the product of the
  remaining norms is below the threshold is pruned.
* The exact scores of the survivors include the dimensions that were left out.

Thresholds start high and are lowered, one Spark job each time, for those
anchors whose windows are not filled.  All vectors at or above a threshold are
found, so a filled window is final; the last threshold is the window's lower
end.  A task passes on at most as many rows per window as the window takes.

Components are whole numbers.  Scores are exact: below 2^53 in doubles, beyond
as Python integers, which are cut to 64 bits at the end.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialise, pick

#: Anchors of one broadcast; 64 dimensions make 8 MB.
BLOCK = 16_384
#: Anchors and vectors of a tile whose scores are held at once.
TILE_ANCHORS, TILE_ROWS = 256, 4096
#: Dimensions whose partial scores are added at a time.
RUN = 16
#: Thresholds for positives, as parts of the norms' product; then no threshold.
POSITIVE_STEPS = (0.7, 0.4)
#: Thresholds for negatives, as parts of the window that are searched from above; then all of it.
NEGATIVE_STEPS = (0.2, 0.6)
#: Sums of whole numbers up to here are exact in doubles.
EXACT = 2.0 ** 52
POSITIVES, NEGATIVES = 5, 3
#: A negative's score is between these parts (in hundredths) of the positive's.
LOW, HIGH = 50, 95

_VECTORS = "id bigint, label bigint, v array<double>"
_FOUND = "anchor bigint, slot int, id bigint, score bigint"


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """Rows of a list column as doubles; shorter vectors end in zeros, longer ones widen the matrix."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    sizes = np.diff(column.offsets.to_numpy()).astype(np.int64)
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    out = np.zeros((len(sizes), max(width, int(sizes.max(initial=0)))))
    row = np.repeat(np.arange(len(sizes)), sizes)
    at = np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    out[row, at] = flat
    return out


def _suffix_norms(m: np.ndarray) -> np.ndarray:
    """Column j: the norm of the components from j on; one more column of zeros."""
    squares = np.cumsum((m * m)[:, ::-1], axis=1)[:, ::-1]
    return np.sqrt(np.concatenate([squares, np.zeros((len(m), 1))], axis=1)) * (1 + 1e-12)


def threshold_pairs(a: np.ndarray, x: np.ndarray, least: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All (row of a, row of x, score) with score >= least[row of a]; scores are whole."""
    width = max(a.shape[1], x.shape[1])
    a = np.pad(a, ((0, 0), (0, width - a.shape[1])))
    x = np.pad(x, ((0, 0), (0, width - x.shape[1])))
    order = np.argsort(-(a * a).sum(axis=0), kind="stable")
    a, x = a[:, order], x[:, order]
    rest_a, rest_x = _suffix_norms(a), _suffix_norms(x)
    slack = 1 + 1e-9
    # the norm from which on a vector's rest could reach some anchor's threshold
    with np.errstate(divide="ignore", invalid="ignore"):
        reach = np.where(rest_a > 0, least[:, None] / (rest_a * slack), np.where(least > 0, np.inf, -np.inf)[:, None])
    indexed = (rest_x >= reach.min(axis=0, initial=np.inf)[None, :]).sum(axis=1)  # monotone: a leading run of dimensions
    indexed = np.minimum(indexed, width)
    by_length = np.argsort(-indexed, kind="stable")
    x, rest_x, indexed = x[by_length], rest_x[by_length], indexed[by_length]
    known = int(np.searchsorted(-indexed, 0, side="left"))  # vectors without an index reach no threshold
    if least.min(initial=np.inf) <= 0:
        known = len(x)
    partial = np.zeros((len(a), known))
    alive_a = np.arange(len(a))
    for at in range(0, width, RUN):
        posted = int(np.searchsorted(-indexed[:known], -at, side="left"))
        if not posted or not len(alive_a):
            break
        end = min(at + RUN, width)
        partial[alive_a, :posted] += a[alive_a, at:end] @ x[:posted, at:end].T
        best = (partial[alive_a, :posted] + rest_a[alive_a, end, None] * rest_x[None, :posted, end] * slack).max(axis=1)
        if posted == known:
            alive_a = alive_a[best >= least[alive_a]]
    # dimensions that were added: whole runs up to the index's end
    added = np.minimum(-(-indexed[:known] // RUN) * RUN, width)
    left = rest_a[alive_a][:, added] * rest_x[np.arange(known), added][None, :] * slack
    i, j = np.nonzero(partial[alive_a] + left >= least[alive_a, None])
    i = alive_a[i]
    score = partial[i, j]
    short = np.nonzero(added[j] < width)[0]
    for at in range(0, width, RUN):
        mine = short[added[j[short]] <= at]
        if len(mine):
            score[mine] += np.einsum("ij,ij->i", a[i[mine], at:at + RUN], x[j[mine], at:at + RUN])
    if rest_a[:, 0].max(initial=0) * rest_x[:, 0].max(initial=0) >= EXACT:
        exact = np.empty(len(i), object)
        for n, (p, q) in enumerate(zip(i.tolist(), j.tolist(), strict=True)):
            exact[n] = sum(int(u) * int(w) for u, w in zip(a[p].tolist(), x[q].tolist(), strict=True))
        kept = np.array([s >= t for s, t in zip(exact, least[i].tolist(), strict=True)], bool)
        i, j = i[kept], j[kept]
        score = np.array([max(-(1 << 63), min((1 << 63) - 1, s)) for s in exact[kept]], np.int64)
    else:
        kept = score >= least[i]
        i, j, score = i[kept], j[kept], score[kept].astype(np.int64)
    return i, by_length[j], score


def _first(anchor, slot, ident, score, n: int):
    """The first ``n`` rows of each (anchor, slot): higher scores, then smaller ids."""
    order = np.lexsort((ident, ~score, slot, anchor))
    anchor, slot, ident, score = anchor[order], slot[order], ident[order], score[order]
    new = np.ones(len(anchor), bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (slot[1:] != slot[:-1])
    start = np.maximum.accumulate(np.where(new, np.arange(len(anchor)), 0))
    keep = np.arange(len(anchor)) - start < n
    return anchor[keep], slot[keep], ident[keep], score[keep]


def _search(vectors: DataFrame, shared, same_label: bool, n: int) -> DataFrame:
    """For each window the first ``n`` vectors of every task.

    ``shared`` holds ids, labels and vectors of anchors and, per anchor and slot,
    the least and the greatest score of a window (NaN: no window).
    """
    def join(batches):
        anchors = shared.value
        ids, labels, a, low, high = (anchors[k] for k in ("ids", "labels", "vectors", "low", "high"))
        slots = low.shape[1]
        with np.errstate(invalid="ignore"):
            least = np.nanmin(np.where(np.isnan(low), np.inf, low), axis=1)
        held, kept = [], []

        def tile():
            xid = np.concatenate([h[0] for h in held])
            xlabel = np.concatenate([h[1] for h in held])
            width = max(h[2].shape[1] for h in held)
            x = np.concatenate([np.pad(h[2], ((0, 0), (0, width - h[2].shape[1]))) for h in held])
            held.clear()
            groups = [(np.nonzero(labels == v)[0], np.nonzero(xlabel == v)[0]) for v in np.unique(xlabel).tolist()] \
                if same_label else [(np.arange(len(ids)), np.arange(len(xid)))]
            for mine, rows in groups:
                for at in range(0, len(mine), TILE_ANCHORS):
                    some = mine[at:at + TILE_ANCHORS]
                    i, j, score = threshold_pairs(a[some], x[rows], least[some])
                    i, j = some[i], rows[j]
                    fits = (ids[i] != xid[j]) & ((labels[i] == xlabel[j]) == same_label)
                    i, j, score = i[fits], j[fits], score[fits]
                    for slot in range(slots):
                        within = (score >= low[i, slot]) & (score <= high[i, slot])  # NaN: never
                        found = _first(i[within], np.full(int(within.sum()), slot), xid[j[within]], score[within], n)
                        if len(found[0]):
                            kept.append(found)
            if sum(len(k[0]) for k in kept) > 200_000:
                kept[:] = [_first(*(np.concatenate(c) for c in zip(*kept, strict=True)), n)]

        for batch in batches:
            if batch.num_rows:
                held.append((batch.column(0).to_numpy(), batch.column(1).to_numpy(), matrix(batch.column(2), 1)))
            if sum(len(h[0]) for h in held) >= TILE_ROWS:
                tile()
        if held:
            tile()
        if kept:
            anchor, slot, ident, score = _first(*(np.concatenate(c) for c in zip(*kept, strict=True)), n)
            for at in range(0, len(anchor), 10_000):
                part = slice(at, at + 10_000)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids[anchor[part]]), pa.array(slot[part].astype(np.int32)), pa.array(ident[part]),
                     pa.array(score[part])], names=["anchor", "slot", "id", "score"])

    found = vectors.mapInArrow(join, _FOUND)
    best = Window.partitionBy("anchor", "slot").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= n)


def _filled(vectors: DataFrame, anchors: dict, thresholds, same_label: bool, n: int) -> DataFrame:
    """Windows of one block of anchors, searched with falling thresholds.

    ``thresholds`` lists, per round, the least scores of all windows; the greatest are ``anchors["high"]``.
    """
    spark = vectors.sparkSession
    done = np.isnan(thresholds[-1])
    place = {v: k for k, v in enumerate(anchors["ids"].tolist())}
    parts = []
    for number, low in enumerate(thresholds):
        low = np.where(done, np.nan, low)
        open_ = np.nonzero(~done.all(axis=1))[0]
        if not len(open_):
            break
        shared = spark.sparkContext.broadcast({
            k: v[open_] for k, v in {**anchors, "low": low}.items()})
        found = materialise(_search(vectors, shared, same_label, n), "negatives-found")
        if number == len(thresholds) - 1:
            parts.append(found)
            break
        full = np.zeros(done.shape, bool)
        last = found.filter(F.col("rank") == n).select("anchor", "slot").toArrow()  # one row per window at most
        full[[place[v] for v in last.column("anchor").to_pylist()], last.column("slot").to_numpy()] = True
        fresh = [(anchors["ids"][i].item(), s) for i, s in np.argwhere(full & ~done).tolist()]
        done |= full
        if fresh:
            windows = spark.createDataFrame(fresh, "anchor bigint, slot int")
            parts.append(found.join(F.broadcast(windows), ["anchor", "slot"]))
    if not parts:
        return spark.createDataFrame([], _FOUND + ", rank int")
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def whole_vectors(df: DataFrame, id_col: str, vector_col: str, label_col: str, scale: float) -> DataFrame:
    """(id, label, v) with whole components; rows that cannot take part go; one row per id is left."""
    base = pick(df, id=id_col, raw=vector_col, label=label_col)
    fine = F.forall("raw", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")))
    base = base.filter("id IS NOT NULL AND label IS NOT NULL AND raw IS NOT NULL").filter(fine)
    scaled = F.transform("raw", lambda x: x.cast("double") * F.lit(float(scale)))
    # from 2^53 on every double is whole
    v = F.transform(scaled, lambda y: F.when(F.abs(y) < 2.0 ** 53, F.floor(y).cast("double")).otherwise(y))
    rows = base.select(F.col("id").cast("long").alias("id"), F.col("label").cast("long").alias("label"), v.alias("v"))
    return rows.groupBy("id").agg(F.min(F.struct("label", "v")).alias("row")).select("id", "row.label", "row.v")


def mine_hard_negatives(df: DataFrame, is_anchor, id_col: str = "vec_id", vector_col: str = "embedding",
                        label_col: str = "label", scale: float = 256.0, positives: int = POSITIVES,
                        negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    ``is_anchor`` is a condition on the column ``id``.  An anchor's positives
    are its best ``positives`` other rows of the same label; of the rows of
    other labels whose score is ``low`` to ``high`` hundredths of the
    positive's, the best ``negatives`` are its negatives.  Ties go to the
    smaller id.  Rows with a null id, label or vector, or with a null or
    non-finite component, take no part.  Of several rows with one id the first
    by label, then vector, counts.  Vectors of different lengths are compared
    as if the shorter one ended in zeros.  Anchors without positives, and
    windows without negatives, give no rows; so does an empty table.
    """
    spark = df.sparkSession
    vectors = materialise(whole_vectors(df, id_col, vector_col, label_col, scale), "negatives-vectors")
    chosen = vectors.filter(is_anchor)
    blocks = -(-chosen.count() // BLOCK)
    out = []
    for block in range(blocks):
        # a block by hash has BLOCK anchors give or take a few hundred
        mine = chosen.filter(F.pmod(F.xxhash64("id"), F.lit(blocks)) == block).toArrow()
        order = np.argsort(mine.column("id").to_numpy())
        a = matrix(mine.column("v"), 1)[order]
        anchors = {"ids": mine.column("id").to_numpy()[order], "labels": mine.column("label").to_numpy()[order],
                   "vectors": a, "high": np.full((len(a), 1), np.inf)}
        if not len(a):
            continue
        norm = np.sqrt((a * a).sum(axis=1))[:, None]
        steps = [norm * norm * s for s in POSITIVE_STEPS] + [np.full((len(a), 1), -np.inf)]
        top = materialise(_filled(vectors, anchors, steps, True, positives), "negatives-positives")
        place = {v: k for k, v in enumerate(anchors["ids"].tolist())}
        ceiling, floor = (np.full((len(a), positives), np.nan) for _ in range(2))
        best = top.select("anchor", "rank", "score").toArrow()  # ``positives`` rows an anchor at most
        for anchor, rank, score in zip(*(c.to_pylist() for c in best.columns), strict=True):
            lowest, highest = -(-low * score // 100), high * score // 100
            if lowest <= highest:
                floor[place[anchor], rank - 1], ceiling[place[anchor], rank - 1] = lowest, highest
        anchors["high"] = ceiling
        steps = [ceiling - (ceiling - floor) * s for s in NEGATIVE_STEPS] + [floor]
        found = _filled(vectors, anchors, steps, False, negatives)
        pairs = top.select("anchor", (F.col("rank") - 1).alias("slot"), F.col("id").alias("positive_id"),
                           F.col("score").alias("positive_score"))
        found = found.select("anchor", "slot", "rank", F.col("id").alias("negative_id"),
                             F.col("score").alias("negative_score"))
        out.append(materialise(found.join(pairs, ["anchor", "slot"]).select(
            F.col("anchor").alias("anchor_id"), "positive_id", "rank", "negative_id", "positive_score",
            "negative_score"), "negatives"))
    if not out:
        return spark.createDataFrame([], "anchor_id bigint, positive_id bigint, rank int, negative_id bigint, "
                                         "positive_score bigint, negative_score bigint")
    result = out[0]
    for part in out[1:]:
        result = result.unionByName(part)
    return result


#: Contract of the query: anchors, changed labels.
ANCHOR_STEP, RELABEL_STEP, LABELS = 50, 7, 10


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of every anchor of ``embeddings``."""
    rows = pick(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), vec_id="vec_id", embedding="embedding",
                label="label")
    label = F.when(F.col("vec_id") % RELABEL_STEP == 0, (F.col("label") + 1) % LABELS).otherwise(F.col("label"))
    return mine_hard_negatives(rows.withColumn("label", label), F.col("id") % ANCHOR_STEP == 0)


OP13_SQL = """
WITH v AS (
    SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
           list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e
    FROM embeddings
    WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
      AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
pairs AS (
    SELECT a.vec_id AS anchor_id, r.vec_id, a.label = r.label AS same,
           CAST(list_inner_product(a.e, r.e) AS BIGINT) AS score
    FROM v a JOIN v r ON a.vec_id % 50 = 0 AND a.vec_id <> r.vec_id),
pos AS (
    SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM pairs WHERE same
    QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT anchor_id, positive_id, CAST(row_number() OVER w AS INTEGER) AS rank, n.vec_id AS negative_id,
       positive_score, n.score AS negative_score
FROM pos JOIN pairs n USING (anchor_id)
WHERE NOT n.same AND 50 * positive_score <= 100 * n.score AND 100 * n.score <= 95 * positive_score
WINDOW w AS (PARTITION BY anchor_id, positive_id ORDER BY n.score DESC, n.vec_id)
QUALIFY row_number() OVER w <= 3
"""
