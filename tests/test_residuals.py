"""The macroblock kernel against the block expressions, and rows that have no residual."""

import numpy as np
from pyspark.sql import functions as F

from bitloom.operators import blocks, residuals
from bitloom.plans import kernel_catalog  # noqa: F401  (it adds to the catalog)
from bitloom.plans.catalog import QUERIES

KIND = "id int, kind string, levels array<int>, qp int, small array<int>, large array<int>"


def test_a_block_is_what_the_expressions_give(spark):
    rng = np.random.default_rng(2)
    rows = [(i, [int(x) for x in rng.integers(-40, 40, 16) * (rng.random(16) < 0.4)], int(rng.integers(0, 52)), [int(x) for x in rng.integers(1, 60, 16)], [int(x) for x in rng.integers(0, 256, 16)]) for i in range(200)]
    rows += [(900, None, 20, [16] * 16, [0] * 16), (901, [1] * 16, None, [16] * 16, [0] * 16), (902, [1] * 15, 20, [16] * 16, [0] * 16), (903, [1] * 16, 20, None, [0] * 16), (904, [1] * 16, 20, [16] * 16, None)]
    df = spark.createDataFrame(rows, "id int, levels array<int>, qp int, weights array<int>, predicted array<int>").repartition(3)
    args = (F.col("levels"), F.col("qp"), F.col("weights"), F.col("predicted"))
    got = {r.id: r.v for r in df.select("id", residuals.block_samples(*args).alias("v")).collect()}
    want = {r.id: r.v for r in df.where("id < 900").select("id", blocks.residual_4x4(*args).alias("v")).collect()}
    assert {k: v for k, v in got.items() if k < 900} == want
    assert all(got[k] is None for k in range(900, 905))


def test_a_level_in_one_block_stays_in_its_place(spark):
    """Coded block 5 of a macroblock lies at row 0, column 12 of samples; DC levels alone give flat blocks."""
    one = [0] * 256
    one[5 * 16] = 8
    apart = [0] * 256
    apart[0] = 16
    rows = [(0, "4x4", one, 28, [16] * 16, [16] * 64), (1, "16x16", apart, 28, [16] * 16, [16] * 64), (2, "8x8", [0] * 128 + [9] + [0] * 127, 36, [16] * 16, [16] * 64)]
    rows += [(3, "other", one, 28, [16] * 16, [16] * 64), (4, "4x4", None, 28, [16] * 16, [16] * 64), (5, "8x8", one, 28, [16] * 16, None), (6, "4x4", one[:9], 28, [16] * 16, [16] * 64), (7, None, one, 28, [16] * 16, [16] * 64)]
    df = spark.createDataFrame(rows, KIND)
    got = {r.id: r.v and np.array(r.v).reshape(16, 16) for r in df.where("id > 2").select("id", residuals.macroblock_residual(*(F.col(c) for c in ("kind", "levels", "qp", "small", "large"))).alias("v")).collect()}
    assert got == {k: None for k in range(3, 8)}
    made = {r.id: np.array(r.v).reshape(16, 16) for r in df.where("id < 3").select("id", residuals.macroblock_residual(*(F.col(c) for c in ("kind", "levels", "qp", "small", "large"))).alias("v")).collect()}
    assert np.argwhere(made[0]).min(axis=0).tolist() == [0, 12] and np.argwhere(made[0]).max(axis=0).tolist() == [3, 15]
    assert len(np.unique(made[1])) == 1 and made[1][0, 0] != 0
    assert np.argwhere(made[2]).min(axis=0).tolist() == [8, 0] and np.argwhere(made[2]).max(axis=0).tolist() == [15, 7]


def test_restored_samples_are_clipped(spark):
    rows = [(bytearray([250, 3, 7]), [10, -9, 1]), (None, [1]), (bytearray([1]), None), (bytearray([1, 2]), [1])]
    got = [r.v for r in spark.createDataFrame(rows, "p binary, r array<int>").select(residuals.restored(F.col("p"), F.col("r")).alias("v")).collect()]
    assert [v and bytes(v) for v in got] == [bytes([255, 0, 8]), None, None, None]


def test_blocks_of_planes_are_told_in_coded_order(spark):
    plane = list(range(256))
    df = spark.createDataFrame([(0, plane, 4, 2), (1, plane, 8, 1), (2, None, 4, 1), (3, plane[:9], 4, 1), (4, plane, None, 1)], "id int, plane array<int>, n int, k int").repartition(1)
    got = {r.id: r.v for r in df.select("id", residuals.block_texts(F.col("plane"), F.col("n"), 16).alias("v")).collect()}
    for no, (n, count) in enumerate(((4, 16), (8, 4))):
        rows = [((b >> 3 << 1 | b >> 1 & 1), (b >> 2 & 1) << 1 | b & 1) for b in range(count)]
        assert got[no] == [",".join(str((r * n + i // n) * 16 + c * n + i % n) for i in range(n * n)) for r, c in rows]
    assert got[2] is got[3] is got[4] is None


def test_rows_of_one_file_are_dealt_to_all_cores(spark):
    for name in ("macroblock_residuals", "scaling_matrices"):
        assert QUERIES[name](spark, "/root/testdata/sf0.001").rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
