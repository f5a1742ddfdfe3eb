"""Frames written as parts, committed together or not at all."""

import pytest
from pyspark.sql import functions as F

from bitloom.plans import pcm, stream_catalog
from bitloom.sources import y4m, y4m_sink

SF = "/root/testdata/sf0.001"


def frames(spark):
    return y4m.planes(pcm.decode(stream_catalog.pcm_streams(spark, SF)).where("stream_id in ('Brand#1/0', 'Brand#2/0')"), stream_catalog.WIDTH)


def test_parts_together_are_the_file(spark, tmp_path):
    df = frames(spark)
    y4m_sink.write(df, f"file://{tmp_path}/out", 2)
    want = {r.stream_id: bytes(r.content) for r in y4m.files(df).collect()}
    got = {}
    for folder in (tmp_path / "out").glob("stream_id=*"):
        parts = sorted(folder.glob("part-*.y4m"))
        assert len(parts) > 1
        got[folder.name] = b"".join(p.read_bytes() for p in parts)
    assert got == {f"stream_id={k.replace('#', '%23').replace('/', '%2F')}": v for k, v in want.items()}
    assert {p.name for p in (tmp_path / "out").iterdir()} == {*got, "_SUCCESS"}


def test_a_failed_job_leaves_nothing(spark, tmp_path):
    df = frames(spark).withColumn("width", F.when((F.col("stream_id") == "Brand#2/0") & (F.col("frame_idx") > 0), F.raise_error(F.lit("lost"))).otherwise(F.col("width")).cast("int"))
    with pytest.raises(Exception, match="lost"):
        y4m_sink.write(df, f"file://{tmp_path}/out", 1)
    out = tmp_path / "out"
    assert not out.exists() or list(out.iterdir()) == []


def test_no_frames(spark, tmp_path):
    y4m_sink.write(frames(spark).limit(0), f"file://{tmp_path}/out")
    assert [p.name for p in (tmp_path / "out").iterdir()] == ["_SUCCESS"]
