import json

from pyspark.sql import functions as F

from bitloom.plans import generate, headers, pcm, stream_catalog
from bitloom.sources import annexb, y4m

SF = "/root/testdata/sf0.001"


def test_planes_crops_and_files(spark):
    blocks = pcm.decode(stream_catalog.pcm_streams(spark, SF)).where("stream_id = 'Brand#1/0'")
    width = stream_catalog.WIDTH
    rows = blocks.collect()
    height = 1 + max(r["mb"] for r in rows) // width
    want = {}
    for r in rows:
        for plane, side in (("y", 16), ("u", 8), ("v", 8)):
            image = want.setdefault((r["frame_idx"], plane), [[0] * (side * width) for _ in range(side * height)])
            for i, sample in enumerate(bytes(r[plane])):
                image[r["mb"] // width * side + i // side][r["mb"] % width * side + i % side] = sample
    frames = y4m.planes(blocks, width)
    for r in frames.collect():
        assert (r["width"], r["height"]) == (16 * width, 16 * height)
        for plane in "yuv":
            assert bytes(r[plane]) == bytes(s for line in want[r["frame_idx"], plane] for s in line)
    small = y4m.cropped(frames, 1, 2, 3, 1).orderBy("frame_idx").collect()
    for r in small:
        for plane, unit in (("y", 2), ("u", 1), ("v", 1)):
            image = want[r["frame_idx"], plane]
            assert bytes(r[plane]) == bytes(s for line in image[unit * 3 : len(image) - unit] for s in line[unit : len(line) - 2 * unit])
    content = bytes(y4m.files(frames).first()["content"])
    head = f"YUV4MPEG2 W{16 * width} H{16 * height} F15:1 Ip C420\n".encode()
    n = len({r["frame_idx"] for r in rows})
    assert content.startswith(head) and len(content) == len(head) + n * (6 + 16 * width * 16 * height * 3 // 2)


def test_units_from_json(spark, tmp_path):
    sps = {"profile_idc": 77, "level_idc": 40, "log2_max_frame_num_minus4": 2, "log2_max_poc_lsb_minus4": 4, "max_num_ref_frames": 4, "width_mbs_minus1": 3, "height_mbs_minus1": 1, "frame_mbs_only": 1}
    pps = {"pps_id": 3, "cabac": 1, "weighted_bipred_idc": 1, "deblock_control": 1, "num_ref_l0_default_minus1": 1}
    idr = {"slice_type": 7, "pps_id": 3, "idr_pic_id": 5, "qp_delta": -3, "deblock_idc": 1}
    p = {"slice_type": 5, "pps_id": 3, "frame_num": 9, "poc_lsb": 200, "override": 1, "num_ref_l0_minus1": 2, "l0_modified": 1, "l0_op_0": 1, "l0_v_0": 4, "l0_op_1": 3, "cabac_init_idc": 2, "alpha_div2": -2, "beta_div2": 3}
    b = {"slice_type": 6, "pps_id": 3, "frame_num": 10, "poc_lsb": 7, "direct_spatial": 1, "luma_log2_denominator": 3, "luma_weight_l0_1_flag": 1, "luma_weight_l0_1": -100, "luma_offset_l0_1": 7, "qp_delta": 11, "deblock_idc": 2}
    units = [(3, 7, sps), (3, 8, pps), (3, 5, idr), (2, 1, p), (0, 1, b)]
    config = [{"stream_id": "s", "nal_idx": i, "nal_ref_idc": r, "nal_unit_type": t, "values": v, "data": "10110"} for i, (r, t, v) in enumerate(units)]
    config.append({"stream_id": "s", "nal_idx": 9, "nal_ref_idc": 0, "nal_unit_type": 6, "raw_hex": "0000010203"})
    (tmp_path / "c.json").write_text(json.dumps(config))
    streams = generate.generate(generate.read_config(spark, f"file://{tmp_path}/c.json"))
    read = annexb.headers(annexb.nal_units(streams))
    assert [(r["nal_ref_idc"], r["nal_unit_type"]) for r in read.orderBy("nal_idx").collect()] == [(r, t) for r, t, _ in units] + [(0, 6)]
    assert bytes(read.where("nal_unit_type = 6").first()["rbsp"]) == bytes.fromhex("0000010203")
    slices = headers.slice_headers(read).orderBy("at").withColumn("rest", F.col("data_at")).collect()
    assert [r["error"] for r in slices] == [None] * 3
    for row, (_, _, values) in zip(slices, units[2:]):
        assert {k: row["header"].get(k) for k in values} == values
        assert row["sps"]["width_mbs_minus1"] == 3 and row["pps"]["pps_id"] == 3


UNITS = "stream_id string, nal_idx int, nal_ref_idc int, nal_unit_type int, `values` map<string,bigint>, data string, raw_hex string"
SPS = {"profile_idc": 77, "level_idc": 40, "log2_max_frame_num_minus4": 2, "log2_max_poc_lsb_minus4": 4, "width_mbs_minus1": 3, "height_mbs_minus1": 1, "frame_mbs_only": 1}


def test_units_are_written_by_one_function_and_looked_up_by_slim_rows(spark):
    """Hundreds of values of a header are shuffled once, and go to one Python worker of a task, once"""
    plan = generate.generate(spark.createDataFrame([], UNITS))._jdf.queryExecution().sparkPlan().toString()
    assert plan.count("ArrowEvalPython") == 1
    windows = [line for line in plan.split("\n") if " Window " in line or "-Window " in line]
    assert len(windows) == 2 and not any("values" in line for line in windows)


def test_values_that_were_read_can_be_written(spark):
    """A header that is read also has what its sets say, and marks"""
    units = [("s", 0, 3, 7, SPS, None, None), ("s", 1, 3, 8, {"cabac": 1, "weighted_pred": 1, "num_ref_l0_default_minus1": 1}, None, None)]
    units.append(("s", 2, 2, 1, {"slice_type": 5, "frame_num": 9, "poc_lsb": 200, "luma_weight_l0_1_flag": 1, "luma_weight_l0_1": -100, "cabac_init_idc": 2}, "1011001", None))
    first = generate.generate(spark.createDataFrame(units, UNITS)).first()["content"]
    header = headers.slice_headers(annexb.headers(annexb.nal_units(spark.createDataFrame([("s", first)], "stream_id string, content binary")))).first()["header"]
    assert header["cabac"] == 1 and header["poc_type"] == 0 and header["luma_weight_l0_1"] == -100
    units[2] = (*units[2][:4], header, *units[2][5:])
    assert generate.generate(spark.createDataFrame(units, UNITS)).first()["content"] == first


def test_odd_units(spark):
    """A stream without a name, units at one place, sets that come too late, null values, types and data"""
    slice_ = {"slice_type": 5, "frame_num": 9, "poc_lsb": 200}
    units = [(None, 0, 3, 7, SPS, None, None), (None, 1, 3, 8, {"pps_id": None, "cabac": None}, None, None), (None, 2, 2, 1, slice_, "1" * 9, None), (None, 2, 2, 1, slice_, None, None)]
    units += [("late", 0, 2, 1, slice_, "1", None), ("late", 1, 3, 7, SPS, "1", None), ("late", 2, 3, 8, None, None, None), ("late", 3, 2, 1, slice_ | {"slice_type": 3}, "1", None), ("late", 4, 2, 5, {"slice_type": 7, "frame_num": None}, "0" * 40, None)]
    units += [("late", 5, 0, 6, {}, None, None), ("late", 6, None, 1, slice_, None, None), ("late", 7, 0, None, slice_, None, None), ("late", 8, 0, 9, None, None, "F0"), ("late", 9, 2, 1, {"slice_type": None}, None, None)]
    streams = generate.generate(spark.createDataFrame(units, UNITS).repartition(3))
    got = {(r["stream_id"], r["nal_idx"]): (r["nal_unit_type"], bytes(r["rbsp"])) for r in annexb.headers(annexb.nal_units(streams)).collect()}
    assert {k: kind for k, (kind, _) in got.items()} == {(None, 0): 7, (None, 1): 8, (None, 2): 1, (None, 3): 1, ("late", 0): 7, ("late", 1): 8, ("late", 2): 5, ("late", 3): 9}
    head = "1" + "00110" + "1" + "001001" + "11001000" + "0" + "0" + "0" + "1"
    closed = lambda bits: int((bits + "1").ljust(-(-(len(bits) + 1) // 8) * 8, "0"), 2).to_bytes(len(bits) // 8 + 1)
    assert {got[None, 2][1], got[None, 3][1]} == {closed(head), closed(head + "1" * 9)}
    assert got["late", 2][1] == closed("1" + "0001000" + "1" + "000000" + "1" + "00000000" + "0" + "0" + "1" + "0" * 40)
    assert got["late", 3][1] == b"\xf0"
