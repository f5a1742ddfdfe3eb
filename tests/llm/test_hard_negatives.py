"""Mined negatives against SQL over all pairs, a plain loop, and odd tables."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from bitloom.llm import entries, hard_negatives
from tests.llm.helpers import SF, clashing, duck, rows

KIND = "vec_id bigint, embedding array<float>, label int"


def table(spark, made):
    return spark.createDataFrame(made, KIND)


def plain(made, every=10, k=5, n=3, scale=256):
    """Rows of the result by comparing each anchor with every row."""
    kept = [(i, r[0], [int(np.floor(float(np.float32(x)) * scale)) for x in r[1]], r[2]) for i, r in enumerate(made) if r[2] is not None and r[1] is not None and all(x is not None and np.isfinite(x) for x in r[1])]
    out = []

    def order(x):
        return -x[0], x[1] is None, x[1] or 0, x[2]

    for a in kept:
        if a[1] is None or a[1] % every:
            continue
        scored = [(sum(x * y for x, y in zip(a[2], b[2])), b[1], b[0], b[3]) for b in kept if b[0] != a[0]]
        for p in sorted((s for s in scored if s[3] == a[3]), key=order)[:k]:
            window = sorted((s for s in scored if s[3] != a[3] and 50 * p[0] <= 100 * s[0] <= 95 * p[0]), key=order)
            out += [(a[1], s[1], p[1], s[0], p[0], rank) for rank, s in enumerate(window[:n], 1)]
    return sorted(((r[0], r[1], r[3], r[2], r[4], r[5]) for r in out), key=repr)


def mined(df, every=10, **more):
    return rows(hard_negatives.mine(df, F.col("vec_id") % every == 0, **more))


def test_query_equals_all_pairs_in_sql(spark):
    found = rows(entries.op12_hard_negatives(spark, SF))
    assert found == duck(hard_negatives.oracle_sql(50, 7), embeddings=f"{SF}/embeddings.parquet") and found


def clusters(seed, n, width=12, labels=4):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(labels, width)) * 0.3 + 0.5
    return [(int(i), [float(np.float32(x)) for x in centres[i % labels] + rng.normal(size=width) * 0.3], int((i + (i % 5 == 0)) % labels)) for i in range(n)]


def test_clusters_ties_and_repeated_rows(spark):
    made = clusters(3, 300)
    made += made[:40] + made[:10] + [(1000 + i, made[20][1], i % 4) for i in range(30)]
    made += [(None, made[5][1], 1), (None, made[5][1], 2), (2000, None, 1), (2010, [None] * 12, 1), (2020, [float("nan")] * 12, 1), (2030, made[3][1], None)]
    got = mined(clashing(table(spark, made)).repartition(6))
    assert got == plain(made) and len(got) > 300


def test_small_blocks_give_the_same(spark, monkeypatch):
    made = clusters(4, 200)
    monkeypatch.setattr(hard_negatives, "BLOCK_BYTES", 1000)
    assert hard_negatives._blocks(table(spark, made).select(F.col("vec_id").alias("hn_key")), 12)[1] > 40
    assert mined(table(spark, made), every=20) == plain(made, every=20)


def test_tiles_of_any_size_give_the_same(monkeypatch):
    import pyarrow as pa

    made = clusters(8, 400)
    ints = np.array([np.floor(np.array(r[1]) * 256) for r in made]).astype(np.int64)
    labels, keys = np.array([r[2] for r in made]), np.arange(len(made))
    turn = np.linalg.eigh((ints.T @ ints).astype(float))[1][:, ::-1]
    batch = pa.RecordBatch.from_arrays([pa.array(keys), pa.array(labels), pa.array(ints.tolist(), pa.list_(pa.int32())), pa.array(keys)], names=["hn_id", "hn_label", "hn_ints", "hn_key"])

    class Shared:
        value = hard_negatives.Anchors(keys[::9], labels[::9], ints[::9], turn, np.full((45, 2), -(2**50)), np.array([[2**50, 800000]] * 45))

    def found(same):
        return [b.to_pylist() for b in hard_negatives._search(Shared, turn, 4, same)([batch])]

    whole = found(True), found(False)
    for name, value in (("ANCHORS", 3), ("ROWS", 17), ("PAIRS", 5), ("FEW", 0.9)):
        monkeypatch.setattr(hard_negatives, name, value)
        assert (found(True), found(False)) == whole


def test_bounds_discard_pairs_but_no_result():
    """On clustered data most pairs go before all components are looked at, and all of the true best stay."""
    rng = np.random.default_rng(1)
    ints = (rng.normal(size=(2000, 32)) * np.geomspace(300, 1, 32)).astype(np.int64)
    turn = np.linalg.eigh((ints.T @ ints).astype(float))[1][:, ::-1]
    a = hard_negatives.Anchors(np.arange(20), np.zeros(20), ints[:20], turn, np.zeros((20, 1)), np.zeros((20, 1)))
    rotated = ints @ turn
    rest = rotated, hard_negatives._tails(rotated, hard_negatives.cuts(32)), np.sqrt((rotated**2).sum(axis=1))
    scores = ints[:20] @ ints.T
    tenth = np.sort(scores, axis=1)[:, -10]
    i, j = hard_negatives.survivors(a.part(np.arange(20)), rest, tenth[:, None].astype(float), np.full((20, 1), np.inf), None, 10)
    left = np.zeros(scores.shape, bool)
    left[i, j] = True
    assert left[scores >= tenth[:, None]].all() and left.mean() < 0.02


def test_negative_zero_and_missing_positives(spark):
    made = [(0, [-1.0, 0.0], 1), (1, [1.0, 0.0], 1), (2, [0.5, 1.0], 2), (10, [0.0, 1.0], 3), (11, [1.0, 0.0], 3), (12, [1.0, 0.0], 2), (20, [3.0, 3.0], 9)]
    assert mined(table(spark, made)) == plain(made)
    assert mined(table(spark, made), positives=1, negatives=1) == plain(made, k=1, n=1)


def test_one_label_holds_a_third(spark):
    made = [(i, v, 0 if i % 3 == 0 else label) for i, v, label in clusters(9, 240, labels=7)]
    assert mined(table(spark, made)) == plain(made)


def test_no_rows_no_anchors_and_bad_shapes(spark):
    for made in ([], [(1, [1.0], 0)], [(10, None, 0)], [(10, [1.0], None)], [(10, [], 1)]):
        assert hard_negatives.mine(table(spark, made), F.col("vec_id") % 10 == 0).collect() == []
    with pytest.raises(ValueError):
        mined(table(spark, [(10, [1.0], 0), (11, [1.0, 2.0], 0)]))
    with pytest.raises(Exception, match="not below"):
        mined(table(spark, [(10, [1e30], 0)]))
