"""Streams written by hand: pictures of several slices, what is not decoded, sets that change, resets and output."""

import random

from pyspark.sql import functions as F

from bitloom.functions import bits as B
from bitloom.functions import syntax as X
from bitloom.operators import dpb
from bitloom.plans import headers, kernel_catalog, pcm
from bitloom.plans import sequence as S
from bitloom.sources import annexb

SF = "/root/testdata/sf0.001"


def streams(spark, slices, skipped=2, n=8, stream="a"):
    rows = [(stream, k, bytearray([10 + k] * 256), bytearray([k] * 64), bytearray([200 - k] * 64)) for k in range(n)]
    blocks = spark.createDataFrame(rows, "stream_id string, mb bigint, y binary, u binary, v binary")
    return pcm.encode(blocks, 4, skipped, slices)


def with_units(spark, content, *units):
    made = spark.range(1).select(*(annexb.unit(*u).alias(f"u{i}") for i, u in enumerate(units))).first()
    return spark.createDataFrame([("a", bytearray(content + b"".join(bytes(u) for u in made)))], "stream_id string, content binary")


def parsed(spark, bits, table, given=None):
    return spark.createDataFrame([(bits,)], "b string").select(X.parse(F.col("b"), table, given)).first()[0]


def test_pictures_of_several_slices(spark):
    want = None
    for slices in (1, 2, 3, 8):
        df = streams(spark, slices)
        got = sorted((r["frame_idx"], r["mb"], bytes(r["y"]), bytes(r["u"]), bytes(r["v"])) for r in pcm.decode(df).collect())
        assert len(got) == 24 and pcm.errors(df).count() == 0
        want = want or got
        assert got == want


def test_every_slice_is_decoded_or_told(spark):
    content = bytes(streams(spark, 2).first()["content"])
    intra = B.from_bits(B.trailing(F.concat(pcm._slice(7, F.lit(3), False), B.put_ue(F.lit(0)))))  # no raw macroblock
    whole = B.from_bits(B.trailing(F.concat(pcm._slice(5, F.lit(4), False), B.put_ue(F.lit(8)))))
    half = B.from_bits(B.trailing(F.concat(pcm._slice(5, F.lit(5), False), B.put_ue(F.lit(4)))))
    late = B.from_bits(B.trailing(F.concat(pcm._slice(5, F.lit(5), False, F.lit(5)), B.put_ue(F.lit(3)))))
    df = with_units(spark, content, (3, 1, intra), (3, 1, whole), (3, 1, half), (3, 1, late))
    told = {r["at"]: r["error"] for r in pcm.errors(df).collect()}
    assert told[6].startswith("intra macroblocks") and told[7] == "refers to a picture that is not decoded"
    assert told[8] == "another slice of the picture is not decoded" and told[9] == "slices overlap or leave a gap" and set(told) == {6, 7, 8, 9}
    assert {r["frame_idx"] for r in pcm.decode(df).collect()} == {0, 1, 2}


def test_a_mix_of_raw_and_skipped_slices(spark):
    content = bytes(streams(spark, 1, skipped=1).first()["content"])
    plane = F.unhex(F.lit("07" * 384))
    raw = F.unhex(F.concat(F.hex(B.from_bits(F.concat(pcm._slice(7, F.lit(2), False), B.put_ue(F.lit(25))))), *(F.hex(plane) if i % 2 == 0 else F.lit(pcm.PCM_MARK) for i in range(7)), F.lit("80")))
    rest = B.from_bits(B.trailing(F.concat(pcm._slice(5, F.lit(2), False, F.lit(4)), B.put_ue(F.lit(4)))))
    after = B.from_bits(B.trailing(F.concat(pcm._slice(5, F.lit(3), False), B.put_ue(F.lit(8)))))
    df = with_units(spark, content, (3, 1, raw), (3, 1, rest), (3, 1, after))
    assert pcm.errors(df).collect() == []
    got = {(r["frame_idx"], r["mb"]): bytes(r["y"])[0] for r in pcm.decode(df).collect()}
    assert len(got) == 32
    for frame in (2, 3):
        assert [got[frame, k] for k in range(8)] == [7] * 4 + [14, 15, 16, 17]


def test_a_set_that_cannot_be_used_replaces_the_one_before(spark):
    content = bytes(streams(spark, 1).first()["content"])
    head, slices = content.split(b"\x00\x00\x00\x01\x65")
    broken = spark.range(1).select(annexb.unit(3, 7, F.unhex(F.lit("640028")))).first()[0]  # ends before its id
    named = spark.range(1).select(annexb.unit(3, 7, F.unhex(F.lit("420028DF")))).first()[0]  # id 0, then a length out of range
    for unit, error in ((broken, None), (named, "parameter set not usable")):
        df = spark.createDataFrame([("a", bytearray(head + bytes(unit) + b"\x00\x00\x00\x01\x65" + slices))], "stream_id string, content binary")
        got = {r["error"] for r in headers.slice_headers(annexb.headers(annexb.nal_units(df))).collect()}
        assert got == {error}


def test_long_headers_and_sets(spark):
    """A set of 255 large offsets and a header with more marking commands than there may be."""
    vals = {"profile_idc": 77, "level_idc": 40, "poc_type": 1, "num_ref_frames_in_cycle": 255, "frame_mbs_only": 1, "width_mbs_minus1": 5} | {f"offset_for_ref_frame_{i}": 10**9 + i for i in range(255)}
    given = F.create_map(*(x for k, v in vals.items() for x in (F.lit(k), F.lit(v).cast("long"))))
    bits = spark.range(1).select(X.write(given, X.SPS)).first()[0]
    read = parsed(spark, bits + "1", X.SPS)
    assert len(bits) > 12_000 and read["ok"] and all(read["vals"][k] == v for k, v in vals.items())
    known = dict(kernel_catalog.stream_catalog._SLICE_GIVEN)
    table = X.slice_table("I", False)
    for n, ok in ((32, False), (31, True)):
        values = known | {"slice_type": 7, "adaptive_marking": 1} | {f"mmco_{i}": 4 for i in range(n)}
        given = F.create_map(*(x for k, v in values.items() for x in (F.lit(k), F.lit(v).cast("long"))))
        context = F.create_map(*(x for k, v in known.items() for x in (F.lit(k), F.lit(v).cast("long"))))
        bits = spark.range(1).select(X.write(given, table)).first()[0]
        read = parsed(spark, bits + "0" * 40 + "1", table, context)
        assert read["ok"] == ok and (read["bad"] == "mmco_too_many") != ok


def test_values_out_of_range(spark):
    bits = spark.range(1).select(X.write(F.create_map(F.lit("pps_id"), F.lit(300).cast("long")), X.PPS)).first()[0]
    read = parsed(spark, bits + "1", X.PPS)
    assert not read["ok"] and read["bad"] == "pps_id"


def test_reset_of_counts(spark):
    rows = [(1, 0, 0, 0, 0, True, True, False), (1, 1, 1, 2, 0, True, False, False), (1, 2, 2, 6, -2, True, False, True), (1, 3, 1, 4, 0, True, False, False), (1, 4, 0, 0, 0, True, True, False)]
    df = spark.createDataFrame(rows, "stream_id int, at int, frame_num int, poc_lsb int, delta_poc_bottom int, is_ref boolean, is_idr boolean, resets boolean")
    sets = {"poc_type": 0, "max_lsb": 16, "max_frame_num": 16, "offset_for_non_ref_pic": 0, "offset_for_top_to_bottom": 0, "delta_poc_0": 0, "delta_poc_1": 0}
    df = df.select("*", *(F.lit(v).cast("long").alias(k) for k, v in sets.items()), F.array().cast("array<bigint>").alias("cycle"))
    got = S.picture_order(df).orderBy("at").collect()
    assert [r["poc"] for r in got] == [0, 2, 0, 4, 0] and [r["order_period"] for r in got] == [1, 1, 2, 2, 3]


def plain_bumping(pics, size, max_frame_num, references):
    """The same machine over dictionaries, written apart from the operator."""
    held, out = [], []

    def free(test):
        for p in held:
            if p["ref"] and test(p):
                p["ref"] = False

    for i, pic in enumerate(pics):
        new = dict(pic, ref=pic["is_ref"], wait=True, long=0 if i == 0 and pic["long_term"] else None)
        commands = pic["commands"] or []
        if i and new["ref"] and commands:
            for op, a, b in commands:
                number = new["frame_num"] - a - 1
                short = next((p for p in held if p["ref"] and p["long"] is None and (p["frame_num"] - max_frame_num * (p["frame_num"] > new["frame_num"])) == number), None)
                if op == 1 and short:
                    short["ref"] = False
                elif op == 2:
                    free(lambda p: p["long"] == a)
                elif op == 3 and short:
                    free(lambda p: p["long"] == b and p is not short)
                    short["long"] = b
                elif op == 4:
                    free(lambda p: p["long"] is not None and p["long"] >= a)
                elif op == 5:
                    out += [p["at"] for p in sorted(held, key=lambda p: p["poc"]) if p["wait"]]
                    held.clear()
                    new["frame_num"] = new["poc"] = 0
                elif op == 6:
                    free(lambda p: p["long"] == a)
                    new["long"] = a
        elif i and new["ref"] and sum(p["ref"] for p in held) >= references:
            oldest = next((p for p in held if p["ref"] and p["long"] is None), None)
            if oldest:
                oldest["ref"] = False
        held[:] = [p for p in held if p["wait"] or p["ref"]]
        while len(held) >= size and any(p["wait"] for p in held):
            first = min((p for p in held if p["wait"]), key=lambda p: p["poc"])
            first["wait"] = False
            out.append(first["at"])
            held[:] = [p for p in held if p["wait"] or p["ref"]]
        held.append(new)
    return out + [p["at"] for p in sorted(held, key=lambda p: p["poc"]) if p["wait"]]


def test_bumping_against_a_plain_version(spark):
    rng = random.Random(11)
    pics = [{"at": at, "frame_num": at % 16, "poc": rng.randrange(0, 60), "is_ref": rng.random() < 0.7, "long_term": s % 2 == 0, "commands": [(rng.randrange(1, 7), rng.randrange(3), rng.randrange(3))] if rng.random() < 0.4 else None, "stream_id": f"s{s}", "idr_period": 1} for s in range(6) for at in range(40)]
    kind = "stream_id string, idr_period bigint, at bigint, frame_num int, poc int, is_ref boolean, long_term boolean, commands array<struct<op:int,a:int,b:int>>"
    df = spark.createDataFrame([tuple(p[k] for k in ("stream_id", "idr_period", "at", "frame_num", "poc", "is_ref", "long_term", "commands")) for p in pics], kind)
    got = dpb.bump_order(df, 4, 16, 3).collect()
    for s in range(6):
        order = [r["at"] for r in sorted((r for r in got if r["stream_id"] == f"s{s}"), key=lambda r: r["bump_idx"])]
        assert order == plain_bumping([p for p in pics if p["stream_id"] == f"s{s}"], 4, 16, 3)
    quiet = dpb.bump_order(df.withColumn("no_output", F.lit(True)), 4, 16, 3)
    assert quiet.count() < len(got)
