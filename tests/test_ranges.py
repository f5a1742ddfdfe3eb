"""Range scans of Annex B files against the splitter of whole streams, for cuts anywhere."""

import random

import pytest

from bitloom.sources import annexb, ranges


@pytest.fixture
def cut_into(spark):
    """Sets the size of ranges, and sets it back."""
    names = "spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes", "spark.sql.files.minPartitionNum"
    before = [spark.conf.get(n, None) for n in names]

    def cut(size):
        for n, v in zip(names, (str(size), "1", "1")):
            spark.conf.set(n, v)

    yield cut
    for n, v in zip(names, before):
        spark.conf.set(n, v) if v is not None else spark.conf.unset(n)


def whole(spark, files):
    rows = annexb.nal_units(spark.createDataFrame([(k, bytearray(v)) for k, v in files.items()], "stream_id string, content binary")).collect()
    return sorted((r.stream_id, r.nal_idx, bytes(r.nal)) for r in rows)


def scanned(spark, folder):
    return sorted((r.stream_id.rsplit("/", 1)[1], r.nal_idx, bytes(r.nal)) for r in ranges.scan(spark, f"file://{folder}").collect())


def write(folder, files):
    for name, content in files.items():
        (folder / name).write_bytes(content)


def test_cuts_at_every_byte_of_a_start_code(spark, tmp_path, cut_into):
    content = b"\0\0\0\1gABCD" + b"\0\0\1hEF\0\0\0\0\0\1iGHIJ\0\0\1\0\0\1\0\0\0\1jK" + b"\0" * 9 + b"\1kLMNO\0\0"
    write(tmp_path, {"a": content})
    want = whole(spark, {"a": content})
    assert [n for _, _, n in want] == [b"gABCD", b"hEF", b"iGHIJ", b"jK", b"kLMNO"]
    for size in (2, 3):
        cut_into(size)
        assert scanned(spark, tmp_path) == want, size


def test_random_zeros_in_small_ranges(spark, tmp_path, cut_into):
    rng = random.Random(4)
    files = {}
    for i in range(6):
        files[f"f{i}"] = b"".join(rng.choice((b"\0", b"\0\0", b"\1", b"\0\0\1", b"\0\0\0\1", bytes([rng.randrange(256)]) * rng.randrange(1, 9))) for _ in range(rng.randrange(0, 120)))
    files |= {"empty": b"", "none": b"\xff" * 50, "bom": b"\xef\xbb\xbf\0\0\1gX", "zeros": b"\0" * 300, "late": b"garbage" * 30 + b"\0\0\1gY", "one": b"\0\0\1gA\0\1", "ones": b"\0\1x\0\1\0\0\1g\0\1\0\1B\0\1\0\1"}
    write(tmp_path, files)
    want = whole(spark, files)
    for size in (29,):
        cut_into(size)
        assert scanned(spark, tmp_path) == want, size


def test_a_unit_longer_than_many_ranges(spark, tmp_path, cut_into):
    content = b"\0\0\1g" + (b"a\0\0\2" * 90 + b"\5\0\1") * 20 + b"\0\0\0\1h" + bytes(range(2, 256)) * 20 + b"\0\0\1i"
    write(tmp_path, {"long": content})
    cut_into(1024)
    assert scanned(spark, tmp_path) == whole(spark, {"long": content})


def test_written_files_are_read_back(spark, tmp_path, cut_into):
    rng = random.Random(9)
    units = [(f"s{i % 3}", i, bytearray([rng.randrange(1, 128), *(rng.randrange(4, 256) for _ in range(rng.randrange(300))), 128])) for i in range(90)]
    ranges.write(spark.createDataFrame(units, "stream_id string, at int, unit binary"), f"file://{tmp_path}/out")
    found = list((tmp_path / "out").glob("stream_id=*/part-*"))
    assert len(found) == 3
    for file in found:
        name = file.parent.name.split("=")[1]
        content = file.read_bytes()
        assert content.startswith(b"\0\0\0\1") and content == b"".join(b"\0\0\0\1" + bytes(u) for s, _, u in units if s == name) + b"\0\0\0\1"
    cut_into(256)
    got = ranges.scan(spark, f"file://{tmp_path}/out").collect()
    for name in ("s0", "s1", "s2"):
        own = sorted((r.nal_idx, bytes(r.nal)) for r in got if f"stream_id={name}/" in r.stream_id)
        assert [n for _, n in own] == [bytes(u) for s, _, u in units if s == name]


def test_streams_in_parts_are_numbered_through(spark, tmp_path, cut_into):
    """No task has a whole stream, and cuts may fall anywhere in a part."""
    rows = [(s, i, bytearray(b"g" + bytes([65 + i % 26]) * (i % 13) + b"\x01")) for s in "ab" for i in range(200)]
    df = spark.createDataFrame(rows, "stream_id string, at int, unit binary").repartition(5)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "6")
        ranges.write_parts(df, f"file://{tmp_path}/out")
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert all(len(list((tmp_path / "out" / f"stream_id={s}").glob("part-*"))) >= 3 for s in "ab")
    for size in (150,):
        cut_into(size)
        got = sorted((r.stream_id, r.nal_idx, bytes(r.nal)) for r in ranges.scan_parts(spark, f"file://{tmp_path}/out").collect())
        assert got == [(s, i, bytes(u)) for s, i, u in rows], size
