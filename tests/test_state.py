import random

from bitloom.operators import dpb
from bitloom.plans import pcm, stream_catalog
from bitloom.streaming import live

SF = "/root/testdata/sf0.001"


def pic(at, frame_num, poc, is_ref=True):
    return dpb.Picture(at, frame_num, poc, is_ref)


def test_output_makes_room():
    b = dpb.Buffer(2, 16, 2)
    assert b.put(pic(1, 1, 2, False)) == [] and b.put(pic(2, 2, 4)) == []
    assert b.put(pic(3, 3, 6)) == [1] and [p.at for p in b.pictures] == [2, 3]


def test_flush_is_by_count():
    b = dpb.Buffer(4, 16, 2)
    for at, poc in ((1, 6), (2, 2), (3, 4)):
        b.put(pic(at, 0, poc, False))
    assert b.flush() == [2, 3, 1]


def test_reset_command():
    b = dpb.Buffer(4, 16, 4)
    b.put(pic(1, 1, 2)), b.put(pic(2, 2, 4))
    new = pic(3, 3, 6)
    assert b.put(new, [(5, 0, 0)]) == [1, 2] and (new.frame_num, new.poc) == (0, 0)


def test_idr_outputs_or_discards():
    for no_output, want in ((False, [1, 2, 3]), (True, [])):
        b = dpb.Buffer(4, 16, 4)
        for i in (1, 2, 3):
            b.put(pic(i, i, 2 * i))
        assert b.put(pic(4, 0, 0), idr=True, no_output=no_output) == want and [p.at for p in b.pictures] == [4]


def test_marking_commands():
    b = dpb.Buffer(8, 16, 4)
    for i in range(4):
        b.put(pic(i, i, 2 * i))
    b.put(pic(4, 4, 8), [(1, 3, 0), (3, 2, 1)])  # unmark 0; 1 becomes long-term 1
    assert {p.at: p.long_term for p in b.pictures if p.is_ref} == {1: 1, 2: None, 3: None, 4: None}
    b.put(pic(5, 5, 10), [(2, 1, 0), (6, 0, 0)])
    assert {p.at: p.long_term for p in b.pictures if p.is_ref} == {2: None, 3: None, 4: None, 5: 0}
    b.put(pic(6, 6, 12), [(4, 0, 0)])
    assert all(p.long_term is None for p in b.pictures if p.is_ref)


def test_bumping_over_a_table(spark):
    rows = [(s, p, 10 * p + i, i % 4, (0, 8, 4, 12, 10)[i], True, None) for s in (1, 2) for p in (1, 2) for i in range(5)]
    df = spark.createDataFrame(rows, "stream_id bigint, idr_period bigint, at bigint, frame_num int, poc int, is_ref boolean, commands array<struct<op:int,a:int,b:int>>")
    got = dpb.bump_order(df, 3, 16, 1).collect()
    assert len(got) == 20
    for s in (1, 2):
        for p in (1, 2):
            order = [r["at"] for r in sorted((r for r in got if (r["stream_id"], r["idr_period"]) == (s, p)), key=lambda r: r["bump_idx"])]
            assert order == [10 * p + i for i in (0, 2, 1, 4, 3)]


def test_chunks_split_like_the_whole():
    rng = random.Random(1)
    for _ in range(200):
        data = bytes(rng.choice([0, 0, 0, 1, 7]) for _ in range(rng.randrange(0, 80)))
        units, rest, started = [], b"", False
        at = 0
        while at < len(data):
            n = rng.randrange(1, 9)
            more, rest, started = live.split_chunk(rest, started, data[at : at + n], False)
            units += more
            at += n
        units += live.split_chunk(rest, started, b"", True)[0]
        assert units == live.split_chunk(b"", False, data, True)[0]


def test_streams_of_chunks(spark, tmp_path):
    streams = stream_catalog.pcm_streams(spark, SF).limit(3).collect()
    rows = [(r["stream_id"], i, bytes(r["content"][a : a + 999]), a + 999 >= len(r["content"])) for r in streams for i, a in enumerate(range(0, len(r["content"]), 999))]
    schema = "stream_id string, seq int, data binary, last boolean"
    for part in range(3):
        spark.createDataFrame([r for r in rows if r[1] // 8 == part or (part == 2 and r[1] >= 16)], schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    run = live.nal_stream(stream).writeStream.format("memory").queryName("units").trigger(availableNow=True).option("checkpointLocation", f"{tmp_path}/c").start()
    run.awaitTermination()
    from bitloom.sources import annexb

    want = {(r["stream_id"], r["nal_idx"], bytes(r["nal"])) for r in annexb.nal_units(spark.createDataFrame(streams)).collect()}
    assert {(r["stream_id"], r["nal_idx"], bytes(r["nal"])) for r in spark.table("units").collect()} == want


def test_decoding_a_stream_of_files(spark, tmp_path):
    streams = stream_catalog.pcm_streams(spark, SF)
    streams.repartition(2).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(streams.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    live.decode_stream(stream, f"{tmp_path}/out", f"{tmp_path}/c").awaitTermination()
    columns = ["stream_id", "frame_idx", "mb", "plane", "least", "most", "total"]
    got = {tuple(r) for r in spark.read.parquet(f"{tmp_path}/out").select(columns).collect()}
    assert got == {tuple(r) for r in pcm.plane_sums(pcm.decode(streams)).select(columns).collect()}


def test_broken_streams_are_told(spark):
    one = stream_catalog.pcm_streams(spark, SF).first()
    cut = bytes(one["content"])
    no_sets = cut[cut.index(b"\x00\x00\x00\x01\x65") :]
    df = spark.createDataFrame([("a", bytearray(no_sets)), ("b", bytearray(cut[:-5])), ("c", None)], "stream_id string, content binary")
    assert {(r["stream_id"], r["error"]) for r in pcm.errors(df).collect()} >= {("a", "no parameter set")}
    frames = {(r["stream_id"], r["frame_idx"]) for r in pcm.decode(df).select("stream_id", "frame_idx").distinct().collect()}
    assert ("b", 0) in frames and all(s == "b" for s, _ in frames)
