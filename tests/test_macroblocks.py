import random

from pyspark.sql import functions as F

from bitloom.operators import intra8
from bitloom.operators import macroblocks as M


def test_run_codes_are_prefix_free():
    for codes in M.RUN_CODES.values():
        assert all(not b.startswith(a) for a in codes for b in codes if a != b)


def code(run, left):
    return "" if left == 0 else M.RUN_CODES[min(left, 7)][run] if run < 7 else "0" * (run - 4) + "1"


def test_blocks_come_back_from_their_runs(spark):
    rng, rows = random.Random(4), []
    for no in range(300):
        levels = [rng.choice([0, 0, rng.randint(-9, 9)]) for _ in range(16)]
        at = [i for i, v in enumerate(levels) if v]
        before = [i - j - 1 for i, j in zip(at, [-1, *at])][::-1]  # the last coefficient first
        left, bits = sum(before), "11"
        zeros = left
        for run in before[:-1]:
            bits += code(run, left)
            left -= run
        rows.append((no, bits, len(at), zeros, [levels[i] for i in at[::-1]], levels))
    table = spark.createDataFrame(rows, "no int, bits string, n int, zeros int, levels array<int>, block array<int>")
    found = table.withColumn("runs", M.runs(F.col("bits"), F.lit(2), F.col("n"), F.col("zeros")))
    found = found.select("no", M.placed_levels(F.col("levels"), F.col("runs"), 16).alias("got"), "block")
    assert found.where(F.col("got") != F.col("block")).count() == 0 and found.where("got is null").count() == 0


def test_cut_codes_and_missing_types(spark):
    one = spark.range(1)
    assert one.select(M.run_of_zeros(F.lit("0000"), F.lit(0), F.lit(9))).first()[0] is None
    assert one.select(M.runs(F.lit("0"), F.lit(0), F.lit(3), F.lit(9))).first()[0] is None
    assert one.select(M.coded_block_pattern(F.lit(48), F.lit(True))).first()[0] is None
    got = M.with_types(spark.createDataFrame([("B", 22), ("B", 23), ("P", None)], "slice string, mb_type int")).collect()
    assert sorted((r["name"] or "") for r in got) == ["", "", "B_8x8"]


def test_every_mode_stays_on_the_edge():
    for mode in intra8.INTRA_8X8:
        if mode != "dc":
            assert len(intra8.places(mode)) == 256
    flat = {mode: set(intra8.places(mode)) for mode in ("down_left", "horizontal_up")}
    assert min(flat["down_left"]) > intra8.CORNER and max(flat["horizontal_up"]) < intra8.CORNER


def test_completeness(spark):
    rows = [("s", 0, 0), ("s", 0, 1), ("s", 1, 0), ("s", 2, 0), ("s", 2, 0), ("s", 3, None)]
    blocks = spark.createDataFrame(rows, "stream_id string, picture_id int, mb_addr int")
    got = {r["picture_id"]: r["verdict"] for r in M.completeness(blocks, F.lit(2)).collect()}
    assert (got[0], got[1], got[2]) == ("complete", "missing", "repeated") and got[3] == "repeated"
    assert M.completeness(blocks.limit(0), F.lit(2)).count() == 0
