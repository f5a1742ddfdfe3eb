"""Counts that are taken while units are read, against a second pass."""

from pyspark.sql import Observation

from bitloom.sources import annexb


def test_counts_equal_a_second_pass(spark):
    contents = [b"\0\0\1\x67A\0\0\1\0\0\1\xe8B\0\0\0\1\x65\0\0\1\x41CD\0\0\1", b"", None, b"no code", b"\0\0\1\x68\0\0\1\x09\xf0"]
    streams = spark.createDataFrame([(i, c and bytearray(c)) for i, c in enumerate(contents)], "stream_id int, content binary")
    split, read = Observation(), Observation()
    rows = annexb.headers(annexb.nal_units(streams, split), read).collect()
    assert split.get == {"streams": 5, "start_codes": 8, "units": len(rows), "empty": 8 - len(rows)}
    plain = annexb.headers(annexb.nal_units(streams)).collect()
    assert rows == plain and len(rows) == 6
    kinds = [r.nal_unit_type for r in plain]
    assert read.get == {"units": 6, "forbidden": sum(r.error is not None for r in plain), "sets": sum(k in (7, 8) for k in kinds), "slices": sum(k in (1, 5) for k in kinds), "bare": sum(not r.rbsp for r in plain)}
    assert read.get["forbidden"] == 1 and read.get["bare"] == 2


def test_no_streams(spark):
    split = Observation()
    assert annexb.nal_units(spark.createDataFrame([], "stream_id int, content binary"), split).collect() == []
    assert split.get == {"streams": 0, "start_codes": 0, "units": 0, "empty": 0}


def test_weighted_sums_of_blocks(spark):
    from pyspark.sql import functions as F

    from bitloom.operators import batches

    rows = [list(range(120)), None, [], [7, 3]]
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "id int, v array<int>").coalesce(1)
    got = [r.s and tuple(r.s) for r in df.select("id", batches.weighted_sums(F.col("v")).alias("s")).orderBy("id").collect()]
    assert got == [(sum(x * ((i + 1) % 97 + 1) for i, x in enumerate(rows[0])), 0, 119), None, (0, None, None), (7 * 2 + 3 * 3, 3, 7)]


def test_predicted_blocks_are_made_once(spark):
    from bitloom.plans import catalog

    plan = catalog.QUERIES["intra16x16_horizontal"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "aggregate(" not in plan and plan.count("run(") == 1


def test_scaling_lists_of_a_batch_are_those_of_single_rows(spark):
    import random

    from pyspark.sql import functions as F

    from bitloom.operators import batches, blocks

    rng = random.Random(3)
    rows = [(0, None), (1, []), (2, [-8] + [1] * 15), (3, [248] * 20), (4, [None, 3, -11, 5]), (5, [2] * 40)]
    rows += [(no, [rng.choice((rng.randint(-128, 127), rng.randint(-9, 3))) for _ in range(rng.randint(0, 20))]) for no in range(6, 400)]
    df = spark.createDataFrame(rows, "id int, deltas array<int>").repartition(2)
    args = F.col("deltas"), blocks.DEFAULT_4X4_INTRA
    got = df.select("id", batches.scaling_list(*args).alias("v")).orderBy("id").collect()
    assert got == df.select("id", blocks.scaling_list(*args).alias("v")).orderBy("id").collect()
