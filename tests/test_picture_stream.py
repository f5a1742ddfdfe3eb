"""Parameter sets and the picture buffer as state of running queries, against the batch jobs."""

import time

import pytest
from pyspark.sql import functions as F

from bitloom.operators import dpb
from bitloom.plans import headers, pcm, stream_catalog
from bitloom.sources import annexb
from bitloom.streaming import pictures

SF = "/root/testdata/sf0.001"


@pytest.fixture
def rocks(spark):
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, pictures.PROVIDER)
    yield spark
    spark.conf.set(name, before)


def feed(spark, folder, rows, kind, size):
    """Rows as files of so many rows each, in order."""
    for at in range(0, len(rows), size):
        spark.createDataFrame(rows[at : at + size], kind).coalesce(1).write.mode("append").parquet(f"{folder}/in")
        time.sleep(0.01)  # files are taken by age


def run(spark, folder, kind, transform):
    source = spark.readStream.schema(kind).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
    query = transform(source).writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.parquet(f"{folder}/out")


def made(n, streams=("a", "b")):
    """Pictures with all marking commands, and the same for the batch job."""
    rows = []
    for s, name in enumerate(streams):
        for i in range(n + s):
            op = i % 7
            commands = [(op, i % 3, i % 2)] if op and i % 2 else None
            idr = i % 23 == 0
            rows.append((name, 10 * i + s, i % 16, (i * 7 + s) % 29, idr, i % 5 > 0 or idr, idr and i % 2 == 1, idr and i % 3 == 1, commands, 4, 16, 3, False))
    return rows


def by_batch(spark, rows):
    df = spark.createDataFrame(rows, pictures.PICTURES)
    from pyspark.sql import Window as W

    along = W.partitionBy("stream_id").orderBy("at")
    df = df.withColumn("idr_period", F.sum(F.col("is_idr").cast("long")).over(along))
    # A period's last row says whether the next one drops what waits.
    df = df.withColumn("no_output", F.coalesce(F.lead("no_output").over(along), F.lit(False)) & F.coalesce(F.lead("is_idr").over(along), F.lit(False)))
    out = dpb.bump_order(df, 4, 16, 3).collect()
    order = {}
    for r in sorted(out, key=lambda r: (r.stream_id, r.idr_period, r.bump_idx)):
        order.setdefault(r.stream_id, []).append((r.idr_period, r.at))
    return order


@pytest.mark.parametrize("size", [3, 17, 1000])
def test_output_order_for_any_batches(rocks, tmp_path, size):
    rows = made(40)
    ends = [(name, None, None, None, None, None, None, None, None, None, None, None, True) for name in "ab"]
    ordered = sorted(rows, key=lambda r: r[1]) + ends
    feed(rocks, tmp_path, ordered, pictures.PICTURES, size)
    got = {}
    for r in run(rocks, tmp_path, pictures.PICTURES, pictures.outputs).orderBy("stream_id", "output_idx").collect():
        got.setdefault(r.stream_id, []).append((r.idr_period, r.at))
        assert r.output_idx == len(got[r.stream_id]) - 1
    assert got == by_batch(rocks, rows)


def test_a_restart_goes_on_from_the_checkpoint(rocks, tmp_path):
    rows = sorted(made(30), key=lambda r: r[1])
    feed(rocks, tmp_path, rows[:25], pictures.PICTURES, 10)
    first = run(rocks, tmp_path, pictures.PICTURES, pictures.outputs).count()
    assert 0 < first < 25
    feed(rocks, tmp_path, rows[25:] + [(n, *[None] * 11, True) for n in "ab"], pictures.PICTURES, 12)
    found = run(rocks, tmp_path, pictures.PICTURES, pictures.outputs).orderBy("stream_id", "output_idx").collect()
    got = {}
    for r in found:
        got.setdefault(r.stream_id, []).append((r.idr_period, r.at))
    assert got == by_batch(rocks, rows)


def test_silence_puts_out_what_waits(rocks, tmp_path):
    rows = [("a", i, i, (8, 2, 4)[i], i == 0, True, False, False, None, 4, 16, 3, False) for i in range(3)]
    feed(rocks, tmp_path, rows, pictures.PICTURES, 3)
    source = rocks.readStream.schema(pictures.PICTURES).parquet(f"{tmp_path}/in")
    query = pictures.outputs(source, silence_ms=200).writeStream.format("memory").queryName("silent").option("checkpointLocation", f"{tmp_path}/checkpoint").start()
    try:
        until = time.time() + 90
        while time.time() < until and rocks.table("silent").count() < 3:
            time.sleep(0.5)
        assert [r.at for r in rocks.table("silent").orderBy("output_idx").collect()] == [1, 2, 0]
    finally:
        query.stop()


def test_slices_get_the_newest_sets(rocks, tmp_path):
    """Sets and slices over micro-batches, as the as-of join gives them for the whole stream."""
    streams = stream_catalog.pcm_streams(rocks, SF)
    units = annexb.headers(annexb.nal_units(streams.limit(3))).withColumnRenamed("nal_idx", "at")
    # Sent twice, the second time with another picture parameter set.
    again = units.withColumn("at", F.col("at") + 1000).withColumn("rbsp", F.when(F.col("nal_unit_type") == 8, F.unhex(F.lit("CE388080"))).otherwise(F.col("rbsp")))
    rows = [tuple(r) for r in units.unionByName(again).orderBy("at", "stream_id").select("stream_id", "at", "nal_ref_idc", "nal_unit_type", "rbsp").collect()]
    rows.insert(0, ("early", 0, 3, 5, rows[-1][4]))
    kind = "stream_id string, at bigint, nal_ref_idc int, nal_unit_type int, rbsp binary"
    feed(rocks, tmp_path, rows, kind, 7)
    got = {(r.stream_id, r.at): (bytes(r.sps_rbsp) if r.sps_rbsp else None, bytes(r.pps_rbsp) if r.pps_rbsp else None) for r in run(rocks, tmp_path, kind, pictures.slices).collect()}
    sets, want = {}, {}
    for stream, at, _, unit, rbsp in rows:
        if unit in (7, 8):
            sets[stream, unit] = bytes(rbsp)
        elif unit in (1, 5):
            want[stream, at] = sets.get((stream, 7)), sets.get((stream, 8))
    assert got == want and got["early", 0] == (None, None) and len({p for _, p in got.values()}) == 3
