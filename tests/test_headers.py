import random

import pytest
from pyspark.sql import functions as F

from bitloom.functions import bits as B
from bitloom.functions import syntax as X
from bitloom.operators import batches, blocks, prediction
from bitloom.plans import sequence as S
from bitloom.sources import annexb


def parsed(spark, data, table):
    row = spark.range(1).select(X.parse(B.to_bits(F.unhex(F.lit(data))), table).alias("p")).first()["p"]
    assert row["ok"]
    return row["vals"]


def test_high_profile_set(spark):
    v = parsed(spark, "64000AAC728444268400000004000000CA3C48961180", X.SPS)
    assert (v["profile_idc"], v["level_idc"], v["width_mbs_minus1"], v["height_mbs_minus1"]) == (100, 10, 3, 3)


def test_baseline_set_with_vui(spark):
    v = parsed(spark, "42C0148C8D42124D41818181E1108D40", X.SPS)
    want = dict(profile_idc=66, constraint_set0=1, constraint_set1=1, level_idc=20, log2_max_frame_num_minus4=11, log2_max_poc_lsb_minus4=12, width_mbs_minus1=3, height_mbs_minus1=3, video_format=5, max_dec_frame_buffering=1)
    assert {k: v[k] for k in want} == want


def test_vui_alone(spark):
    v = parsed(spark, "0601AF7BE180", X.VUI)
    assert (v["low_delay_hrd"], v["pic_struct_present"], v["bitstream_restriction"]) == (1, 1, 0)


def test_picture_sets(spark):
    v = parsed(spark, "E8438F132130", X.PPS)
    assert (v["pps_id"], v["sps_id"]) == (0, 0)
    v = parsed(spark, "CE3C80", X.PPS)
    assert (v["cabac"], v["init_qp_minus26"], v["init_qs_minus26"], v["deblock_control"]) == (0, 0, 0, 1)


def test_cut_off_set_is_not_ok(spark):
    assert not spark.range(1).select(X.parse(B.to_bits(F.unhex(F.lit("42C014"))), X.SPS)["ok"]).first()[0]


@pytest.mark.parametrize("code,ue,se", [("1", 0, 0), ("010", 1, 1), ("011", 2, -1), ("00100", 3, 2), ("00101", 4, -2), ("00111", 6, -3), ("0001010", 9, 5), ("000000001" + "0" * 8, 255, 128), ("0" * 32 + "1" + "0" * 32, 2**32 - 1, 2**31)])
def test_exp_golomb(spark, code, ue, se):
    bits = F.lit(code)
    got = spark.range(1).select(B.ue_at(bits, F.lit(0)).alias("c"), B.signed(B.ue_at(bits, F.lit(0))["value"]).alias("se"), B.put_ue(F.lit(ue).cast("long")).alias("put"), B.put_se(F.lit(se).cast("long")).alias("puts")).first()
    assert (got["c"]["value"], got["c"]["size"], got["se"], got["put"], got["puts"]) == (ue, len(code), se, code, code)


def test_units_of_streams(spark):
    cases = {"0000000167 4280": ["674280"], "00000001 67FF 000001 68EE 00000001 65DD": ["67FF", "68EE", "65DD"], "FF 00000001 67": ["67"], "000001 000001 67 0000": ["67"], "": [], "AABB": [], "000001 65000A": ["65000A"], "000001 65000D0A 000001 680085": ["65000D0A", "680085"], "000001 65" + "00" * 200_000 + "02": ["65" + "00" * 200_000 + "02"]}
    rows = [(i, bytearray.fromhex(k.replace(" ", ""))) for i, k in enumerate(cases)] + [(99, None)]
    got = annexb.nal_units(spark.createDataFrame(rows, "stream_id int, content binary")).collect()
    for i, want in enumerate(cases.values()):
        assert [r["nal"].hex().upper() for r in sorted(got, key=lambda r: r["nal_idx"]) if r["stream_id"] == i] == want
    assert all(r["stream_id"] != 99 for r in got)


@pytest.mark.parametrize("raw,plain", [("AA00000000010F00000000", None), ("AA00000000030F00000300", "AA000000000F000000"), ("00030F000003", "00030F0000")])
def test_escapes_are_removed(spark, raw, plain):
    assert spark.range(1).select(F.hex(annexb.unescape(F.unhex(F.lit(raw))))).first()[0] == (plain or raw)


def test_escaping_random_payloads(spark):
    rng = random.Random(0)
    rows = [(bytes(rng.choice([0, 0, 0, 1, 2, 3, 4, 200]) for _ in range(rng.randrange(1, 60))),) for _ in range(300)]
    df = spark.createDataFrame(rows, "d binary").select("d", annexb.escape(F.col("d")).alias("e"))
    for r in df.select("d", "e", annexb.unescape(F.col("e")).alias("back")).collect():
        assert r["back"] == r["d"] and not any(bytes([0, 0, x]) in bytes(r["e"]) for x in (0, 1, 2))


@pytest.mark.parametrize(
    "qp,coefficients,want",
    [
        (6, [192, -5, 3, -6, -4, 5, -3, -8, -3, 0, 3, 3, 1, 6, 0, 0], [58, 63, 51, 59, 53, 64, 57, 66, 62, 63, 60, 64, 59, 52, 63, 68]),
        (12, [96, -2, 1, -3, -2, 3, -2, -4, -1, 0, 1, 1, 0, 3, 0, 0], [57, 65, 51, 57, 53, 64, 57, 65, 62, 62, 59, 63, 59, 53, 64, 69]),
        (18, [48, -1, 0, -1, -1, 1, -1, -2, 0, 0, 0, 0, 0, 1, 0, 0], [55, 66, 54, 58, 54, 62, 58, 63, 61, 59, 61, 62, 60, 55, 65, 67]),
        (30, [12] + [0] * 15, [60] * 16),
    ],
)
def test_scaling_and_transform(spark, qp, coefficients, want):
    c = F.array(*map(F.lit, coefficients))
    assert spark.range(1).select(blocks.inverse_4x4(blocks.dequant_4x4(c, F.lit(qp), F.array_repeat(F.lit(16), 16)))).first()[0] == want


def test_large_transform_and_scaling(spark):
    flat = F.array_repeat(F.lit(16), 64)
    dc = F.array(F.lit(512), *[F.lit(0)] * 63)
    three = F.array_repeat(F.lit(3), 64)
    got = spark.range(1).select(blocks.inverse_8x8(dc), blocks.dequant_8x8(three, F.lit(24), flat)[0], blocks.dequant_8x8(three, F.lit(42), flat)[0]).first()
    assert got[0] == [8] * 64 and got[1] == (3 * 320 + 2) >> 2 and got[2] == 3 * 320 * 2


def test_weighted_samples(spark):
    uni = [((100, 2, 10, 0), 210), ((200, 2, 0, 0), 255), ((10, -1, 0, 0), 0), ((100, 128, 10, 7), 110), ((0, 128, -50, 7), 0)]
    for args, want in uni:
        assert spark.range(1).select(prediction.weighted_uni(*map(F.lit, args))).first()[0] == want
    for (a, b, wa, wb, oa, ob), want in [((100, 200, 32, 32, 0, 0), 150), ((1, 0, 32, 32, 0, 0), 1), ((100, 200, 64, 0, 0, 0), 100), ((100, 100, 32, 32, 20, 10), 115)]:
        assert spark.range(1).select(prediction.weighted_bi(*map(F.lit, (a, b, wa, wb, oa, ob, 5)))).first()[0] == want


def test_interpolation(spark):
    line = [F.lit(100 if i % 2 == 0 else 200) for i in range(6)]
    got = spark.range(1).select(prediction.half_sample(line), prediction.quarter_sample(line), prediction.chroma_sample(*map(F.lit, (100, 164, 100, 100, 1, 0)))).first()
    assert tuple(got) == (150, 125, 108)


def test_counts_of_pictures(spark):
    rows = [(1, i, 1, f, f == 0 and i == 0, True) for i, f in enumerate((0, 15, 0, 1))] + [(1, 4, 1, 2, False, False)]
    df = spark.createDataFrame(rows, "stream_id int, at int, idr_period int, frame_num int, is_idr boolean, is_ref boolean")
    assert [r["poc"] for r in S.poc_type2(df, 16).orderBy("at").collect()] == [0, 30, 32, 34, 35]


def test_list_modification(spark):
    refs = [(1, 4, 8, None), (2, 3, 6, None), (3, 2, 4, None), (4, 0, 0, 0)]
    df = spark.createDataFrame([(refs,)], "refs array<struct<at:int,frame_num:int,poc:int,long_term:int>>")

    def run(ops, active=4):
        o = F.array(*(F.struct(F.lit(op).alias("op"), F.lit(v).alias("v")) for op, v in ops))
        return [r["at"] for r in df.select(S.modify_list(F.col("refs"), o, F.lit(5), 16, F.lit(active)).alias("l")).first()["l"]]

    assert run([(0, 2)]) == [3, 1, 2, 4]  # 5 - 3 = 2
    assert run([(2, 0), (0, 1)]) == [4, 2, 1, 3]  # the long-term entry, then 5 - 2 = 3
    assert run([(0, 0), (1, 0)], 2) == [1, 2]  # a number that is not there changes nothing


def test_batches_agree_with_expressions(spark):
    rng = random.Random(4)
    for size, pairs in ((4, [(blocks.inverse_4x4, batches.inverse_4x4), (blocks.hadamard_4x4, batches.hadamard_4x4)]), (8, [(blocks.inverse_8x8, batches.inverse_8x8)])):
        rows = [([rng.randrange(-2000, 2000) for _ in range(size * size)],) for _ in range(50)] + [(None,)]
        df = spark.createDataFrame(rows, "c array<int>")
        for plain, fast in pairs:
            for r in df.select(plain(F.col("c")).alias("a"), fast(F.col("c")).alias("b"), "c").collect():
                assert r["b"] == (r["a"] if r["c"] is not None else None)


def test_groups_by_explicit_numbers(spark):
    """Type 6: as many numbers of a group as there are macroblocks are passed over, and what follows is read."""
    for groups, width in ((1, 1), (2, 2), (3, 2), (4, 3), (7, 3)):
        vals = {"num_slice_groups_minus1": groups, "slice_group_map_type": 6, "slice_group_count_minus1": 98, "chroma_qp_offset": -3, "constrained_intra": 1}
        given = F.create_map(*(x for k, v in vals.items() for x in (F.lit(k), F.lit(v).cast("long"))))
        bits = spark.range(1).select(X.write(given, X.PPS)).first()[0]
        plain = spark.range(1).select(X.write(F.create_map(*(x for k, v in (vals | {"slice_group_map_type": 1}).items() for x in (F.lit(k), F.lit(v).cast("long")))), X.PPS)).first()[0]
        ids = bits.index("0" * (99 * width))
        assert len(bits) - len(plain) == 99 * width + 13 + 2  # the numbers, their count, and a longer code of the type
        filled = bits[:ids] + "01" * (99 * width // 2) + bits[ids + 99 * width // 2 * 2 :]
        for text in (bits, filled):
            read = spark.createDataFrame([(text + "1",)], "b string").select(X.parse(F.col("b"), X.PPS).alias("p")).first()["p"]
            assert read["ok"] and all(read["vals"][k] == v for k, v in vals.items()) and read["pos"] == len(bits)
            assert X._read(text + "1", X.PPS, {}) == (len(bits), True, None)
        cut = spark.createDataFrame([(bits[: ids + 99 * width - 1],)], "b string").select(X.parse(F.col("b"), X.PPS).alias("p")).first()["p"]
        assert not cut["ok"] and cut["bad"] == "slice_group_ids"
