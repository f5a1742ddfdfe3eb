"""Hard negatives of anchors by exact inner products, most of them never worked out in full.

Vectors are integers. An orthogonal rotation (the eigenvectors of their second
moments) moves most of their length into the leading components, and leaves
inner products as they are. So the product of a pair lies within

    product of the leading components +- (residual norm * residual norm + slack)

``slack`` covers what rounding in the rotation and the sums can do. Leading
components are accumulated in steps; after each, pairs whose bounds show that
they can't be among an anchor's best are discarded. Those left are verified by
products of the integers, and only these scores are compared and returned: the
rotation decides what is looked at, not what comes out.

Two passes over the rows: an anchor's best rows of its own label (its
positives), then for each positive the best rows of other labels inside the
window that its score opens. In each pass a task keeps the best so far for each
anchor, whose worst score is the bound for what follows.

Scale: the anchors are a stated query set, taken in blocks of at most
``BLOCK_BYTES`` that are broadcast; the rows stay where they are, and each task
sends on at most k rows for each anchor and window. A label with a third of all
rows is dealt over all tasks like any other. All between is written to the
shared folder, so a lost executor costs its tasks alone.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from bitloom.llm._scratch import Scratch
from bitloom.llm.vector_codes import finite, floored, matrix, width

POSITIVES = 5
NEGATIVES = 3
#: A negative's score is between these hundredths of the positive's.
WINDOW = (50, 95)
SCALE = 256
#: Components are below this in magnitude, and squared lengths below 2^52, so that doubles hold every score.
MAGNITUDE = 1 << 26
LENGTH = 1 << 52
#: Bytes of a broadcast block of anchors: their integers and rotated components.
BLOCK_BYTES = 8 << 20
#: Anchors and rows whose bounds are held at a time, and pairs verified at a time.
ANCHORS, ROWS, PAIRS = 512, 2048, 1 << 16
#: Leading components are accumulated in so many steps, until no more than this share of the pairs is left.
STEPS, FEW = 4, 1 / 64
#: Of the product of two lengths: over a hundred times what rounding can do to a product of rotated vectors of any length below 2^12.
SLACK = 2.0**-28

_NONE = np.iinfo(np.int64).min


def _moments(columns: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((columns, columns))
        for batch in batches:
            x = matrix(batch.column(0), columns).astype(np.float64)
            total += x.T @ x
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(columns, dtype=np.int32)), *(pa.array(total[:, j]) for j in range(columns))], names=["i", *(f"m{j}" for j in range(columns))])

    return run


def rotation(rows: DataFrame, columns: int) -> np.ndarray:
    """Orthogonal matrix whose columns are the directions of the rows' second moments, longest first."""
    kind = T.StructType.fromDDL("i int, " + ", ".join(f"m{j} double" for j in range(columns)))
    sums = rows.select("hn_ints").mapInArrow(_moments(columns), kind).groupBy("i").agg(*(F.sum(f"m{j}") for j in range(columns))).collect()
    moments = np.array([r[1:] for r in sorted(sums)])
    return np.linalg.eigh(moments)[1][:, ::-1].copy()


def _tails(rotated: np.ndarray, cuts: list[int]) -> np.ndarray:
    """Lengths of what follows each cut, one column for each."""
    squares = rotated * rotated
    return np.stack([np.sqrt(squares[:, c:].sum(axis=1)) for c in cuts], axis=1)


def cuts(columns: int) -> list[int]:
    return sorted({max(1, columns * (i + 1) // STEPS) for i in range(STEPS)})


class Anchors:
    """A block of anchors: integers, rotated components, and the windows of scores that are looked for, ``low`` to ``high`` by anchor and window."""

    def __init__(self, keys, labels, ints, turn, low, high):
        self.keys, self.labels, self.ints, self.low, self.high = keys, labels, ints, low, high
        self.rotated = ints.astype(np.float64) @ turn
        self.tails = _tails(self.rotated, cuts(ints.shape[1]))
        self.lengths = np.sqrt((self.rotated**2).sum(axis=1))

    def part(self, which):
        return self.rotated[which], self.tails[which], self.lengths[which]


def survivors(anchors, rows, low: np.ndarray, high: np.ndarray, fits: np.ndarray | None, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (anchor, row) that may be among an anchor's ``k`` best in one of its windows.

    ``anchors`` and ``rows`` are (rotated, tails, lengths). ``low`` and
    ``high`` bound the scores that count, by anchor and window; ``fits`` masks
    pairs that don't.
    """
    (a, a_tails, a_lengths), (r, r_tails, r_lengths) = anchors, rows
    slack = np.outer(a_lengths, r_lengths) * SLACK
    alive = np.ones((len(a), len(r)), bool) if fits is None else fits
    least, most = low.min(axis=1, keepdims=True), high.max(axis=1, keepdims=True)
    product, done = np.zeros((len(a), len(r))), 0
    for step, cut in enumerate(cuts(a.shape[1])):
        product += a[:, done:cut] @ r[:, done:cut].T
        done = cut
        rest = np.outer(a_tails[:, step], r_tails[:, step]) + slack
        alive = alive & (product + rest >= least) & (product - rest <= most)
        if np.count_nonzero(alive) <= alive.size * FEW:
            return np.nonzero(alive)
    # Many are left: what the k best of these rows reach at least is a bound for the others.
    kept = np.zeros_like(alive)
    for w in range(low.shape[1]):
        inside = alive & (product + rest >= low[:, w : w + 1]) & (product - rest <= high[:, w : w + 1])
        if len(r) > k:
            sure = np.where(inside & (product + rest <= high[:, w : w + 1]) & (product - rest >= low[:, w : w + 1]), product - rest, -np.inf)
            reach = np.partition(sure, len(r) - k, axis=1)[:, len(r) - k]
            inside &= product + rest >= reach[:, None]
        kept |= inside
    return np.nonzero(kept)


def _verified(ints_a: np.ndarray, ints_r: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Integer products of pairs."""
    scores = np.empty(len(i), np.int64)
    for at in range(0, len(i), PAIRS):
        part = slice(at, at + PAIRS)
        scores[part] = np.einsum("pc,pc->p", ints_a[i[part]], ints_r[j[part]])
    return scores


class Best:
    """The k best (score, id, known, key) for every slot, higher scores first, then smaller ids, unknown ones last."""

    def __init__(self, slots: int, k: int):
        self.k = k
        self.score = np.full((slots, k), _NONE)
        self.id, self.key = np.zeros((slots, k), np.int64), np.zeros((slots, k), np.int64)
        self.known = np.zeros((slots, k), bool)

    def worst(self, slots) -> np.ndarray:
        """The score that a row has to reach for a place; the least integer while places are free."""
        return self.score[slots, -1]

    def take(self, slot, score, ids, known, key) -> None:
        if not len(slot):
            return
        touched = np.unique(slot)
        old = np.repeat(touched, self.k)
        slot, score = np.concatenate([old, slot]), np.concatenate([self.score[touched].reshape(-1), score])
        ids, known, key = (np.concatenate([own[touched].reshape(-1), new]) for own, new in ((self.id, ids), (self.known, known), (self.key, key)))
        order = np.lexsort((key, ids, ~known, -np.maximum(score, _NONE + 1), slot))
        slot = slot[order]
        starts = np.searchsorted(slot, touched)
        pick = order[(starts[:, None] + np.arange(self.k)).reshape(-1)]
        for own, new in ((self.score, score), (self.id, ids), (self.known, known), (self.key, key)):
            own[touched] = new[pick].reshape(-1, self.k)


def _search(shared, turn: np.ndarray, k: int, same: bool):
    """Best rows of a task for each anchor and window: with the anchor's label, or with another."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchors: Anchors = shared.value
        windows = anchors.low.shape[1]
        best = Best(len(anchors.keys) * windows, k)
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                tile = batch.slice(at, ROWS)
                ints = matrix(tile.column("hn_ints"), anchors.ints.shape[1])
                rotated = ints.astype(np.float64) @ turn
                rows = rotated, _tails(rotated, cuts(ints.shape[1])), np.sqrt((rotated**2).sum(axis=1))
                labels, keys = tile.column("hn_label").to_numpy(zero_copy_only=False), tile.column("hn_key").to_numpy()
                ids, known = tile.column("hn_id").fill_null(0).to_numpy(zero_copy_only=False), tile.column("hn_id").is_valid().to_numpy(zero_copy_only=False)
                groups = [(np.flatnonzero(anchors.labels == x), np.flatnonzero(labels == x)) for x in np.intersect1d(labels, anchors.labels)] if same else [(np.arange(len(anchors.keys)), np.arange(len(keys)))]
                for all_a, r in groups:
                    for start in range(0, len(all_a), ANCHORS):
                        a = all_a[start : start + ANCHORS]
                        slots = a[:, None] * windows + np.arange(windows)
                        low, high = np.maximum(anchors.low[a], best.worst(slots)), anchors.high[a]
                        fits = anchors.keys[a][:, None] != keys[r][None, :] if same else anchors.labels[a][:, None] != labels[r][None, :]
                        i, j = survivors(anchors.part(a), tuple(x[r] for x in rows), low.astype(np.float64), high.astype(np.float64), fits, k)
                        scores = _verified(anchors.ints[a], ints[r], i, j)
                        for w in range(windows):
                            ok = (scores >= low[i, w]) & (scores <= high[i, w])
                            own = r[j[ok]]
                            best.take(slots[i[ok], w], scores[ok], ids[own], known[own], keys[own])
        slot, place = np.nonzero(best.score != _NONE)
        found = best.id[slot, place], best.known[slot, place]
        yield pa.RecordBatch.from_arrays(
            [pa.array(anchors.keys[slot // windows]), pa.array((slot % windows).astype(np.int32)), pa.array(best.score[slot, place]), pa.array(found[0], mask=~found[1]), pa.array(best.key[slot, place])],
            names=["anchor", "window", "score", "id", "key"],
        )

    return run


_FOUND = "anchor bigint, window int, score bigint, id bigint, key bigint"


def _top(found: DataFrame, k: int) -> DataFrame:
    """The k best of each anchor and window over all tasks, each of which sends k at most."""
    order = W.partitionBy("anchor", "window").orderBy(F.desc("score"), F.asc_nulls_last("id"), "key")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _blocks(anchors: DataFrame, columns: int) -> tuple[DataFrame, int]:
    """Anchors with a block number, no block above BLOCK_BYTES."""
    most = max(1, BLOCK_BYTES // (16 * columns + 64))
    number = 1
    while True:
        dealt = anchors.withColumn("hn_block", F.pmod(F.xxhash64("hn_key"), F.lit(number)).cast("int"))
        largest = dealt.groupBy("hn_block").count().agg(F.max("count")).first()[0] or 0
        if largest <= most:
            return dealt, number if largest else 0
        number = max(number + 1, number * largest * 9 // (most * 8))


def mine(items: DataFrame, is_anchor: Column, id_column: str = "vec_id", vector_column: str = "embedding", label_column: str = "label", positives: int = POSITIVES, negatives: int = NEGATIVES, window: tuple[int, int] = WINDOW, scale: int = SCALE) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score: up to ``negatives`` rows of another label for each anchor and positive.

    Vectors become floor(scale * component); a score is an integer inner
    product. An anchor's positives are the ``positives`` best other rows of its
    label; negatives score between ``window`` hundredths of the positive's
    score. Higher scores come first, then smaller ids, null ids last.

    * Rows with a null label, a null vector, or a null or non-finite component take no part.
    * Repeated rows are rows of their own: each repeated anchor has its results, and is an "other row" of its copies.
    * A negative or zero positive score opens an empty window, or one of zero alone.
    * ``is_anchor`` null is no. Ids and labels are integers. Empty tables and tables without anchors give no rows.
    * Vectors of differing lengths, or with a component of 2^26 / ``scale`` or more or a squared length of 2^52, raise.
    * Columns beside the three are read by ``is_anchor`` alone.
    """
    spark, vector = items.sparkSession, F.col(vector_column)
    out = "anchor_id bigint, positive_id bigint, rank int, negative_id bigint, positive_score bigint, negative_score bigint"
    scratch = Scratch(spark, "hard-negatives")
    part = items.where(F.col(label_column).isNotNull() & finite(vector)).select(
        F.col(id_column).cast("long").alias("hn_id"), F.col(label_column).cast("long").alias("hn_label"), floored(vector, scale, MAGNITUDE).alias("hn_ints"), F.coalesce(is_anchor, F.lit(False)).alias("hn_is_anchor"), F.monotonically_increasing_id().alias("hn_key")
    )
    rows = scratch.keep(part, "rows")
    columns = width(rows, "hn_ints")
    anchors, number = _blocks(rows.where("hn_is_anchor"), columns)
    if not columns or not number:
        return spark.createDataFrame([], T.StructType.fromDDL(out))
    longest = rows.agg(F.max(F.aggregate("hn_ints", F.lit(0.0), lambda s, x: s + x.cast("double") * x))).first()[0]
    if longest >= LENGTH:
        raise ValueError("a squared length is not below 2^52")
    turn = rotation(rows, columns)
    mined = []
    for no in range(number):
        table = anchors.where(F.col("hn_block") == no).select("hn_key", "hn_label", "hn_ints", "hn_id").toArrow()
        if not table.num_rows:
            continue
        keys, labels = (table.column(c).to_numpy() for c in ("hn_key", "hn_label"))
        ints = matrix(table.column("hn_ints").combine_chunks(), columns)
        ids = dict(zip(keys.tolist(), table.column("hn_id").to_pylist()))
        everything = np.full((len(keys), 1), _NONE), np.full((len(keys), 1), LENGTH)
        shared = spark.sparkContext.broadcast(Anchors(keys, labels, ints, turn, *everything))
        near = _top(rows.mapInArrow(_search(shared, turn, positives, True), _FOUND), positives)
        near = scratch.keep(near.select("anchor", "rank", "score", "id"), f"positives-{no}")
        shared.unpersist()
        mined.append(_negatives(scratch, rows, near, no, (keys, labels, ints, ids), turn, positives, negatives, window))
    out_rows = mined[0]
    for more in mined[1:]:
        out_rows = out_rows.unionByName(more)
    return out_rows


def _negatives(scratch: Scratch, rows: DataFrame, near: DataFrame, no: int, block, turn, positives: int, negatives: int, window) -> DataFrame:
    """The results of one block of anchors, whose positives stand in ``near``: at most ``positives`` rows for each."""
    keys, labels, ints, ids = block
    place = {k: i for i, k in enumerate(keys.tolist())}
    low, high = np.full((len(keys), positives), LENGTH), np.full((len(keys), positives), -LENGTH)  # windows that are not there hold nothing
    for anchor, rank, score in near.select("anchor", "rank", "score").collect():
        low[place[anchor], rank - 1], high[place[anchor], rank - 1] = -(-window[0] * score // 100), window[1] * score // 100
    shared = rows.sparkSession.sparkContext.broadcast(Anchors(keys, labels, ints, turn, low, high))
    far = _top(rows.mapInArrow(_search(shared, turn, negatives, False), _FOUND), negatives)
    far = scratch.keep(far.select("anchor", (F.col("window") + 1).alias("of"), "rank", "id", "score"), f"negatives-{no}")
    shared.unpersist()
    named = rows.sparkSession.createDataFrame([(k, i) for k, i in ids.items()], "key bigint, anchor_id bigint")
    p = near.select(F.col("anchor").alias("key"), F.col("rank").alias("of"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
    both = p.join(far.withColumnRenamed("anchor", "key"), ["key", "of"]).join(named, "key")
    return both.select("anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


def oracle_sql(every: int, relabel: int, positives: int = POSITIVES, negatives: int = NEGATIVES, window: tuple[int, int] = WINDOW, scale: int = SCALE) -> str:
    """DuckDB SQL of op12: every anchor with every row."""
    return f"""
WITH items AS MATERIALIZED (
  SELECT row_number() OVER () AS rid, vec_id, (CASE WHEN vec_id % {relabel} = 0 THEN (label + 1) % 10 ELSE label END)::BIGINT AS label,
         list_transform(embedding, lambda e: floor({scale} * e::DOUBLE)) AS v FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda e: e IS NULL OR NOT isfinite(e))) = 0),
pairs AS MATERIALIZED (
  SELECT a.rid AS aid, a.vec_id AS anchor_id, b.rid, b.vec_id, a.label = b.label AS same, list_inner_product(a.v, b.v)::BIGINT AS score
  FROM items a, items b WHERE a.vec_id % {every} = 0 AND a.rid <> b.rid),
p AS (SELECT aid, anchor_id, rid AS pid, vec_id AS positive_id, score AS positive_score FROM pairs WHERE same
      QUALIFY row_number() OVER (PARTITION BY aid ORDER BY score DESC, vec_id NULLS LAST) <= {positives})
SELECT p.anchor_id, positive_id, (row_number() OVER (PARTITION BY p.aid, pid ORDER BY score DESC, vec_id NULLS LAST))::INT AS rank, vec_id AS negative_id, positive_score, score AS negative_score
FROM p JOIN pairs n ON n.aid = p.aid AND NOT n.same AND {window[0]} * positive_score <= 100 * score AND 100 * score <= {window[1]} * positive_score
QUALIFY rank <= {negatives}"""
