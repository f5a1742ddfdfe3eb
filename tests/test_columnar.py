"""Batches of headers against the row-at-a-time reading of the same tables."""

import random
import tracemalloc

import pyarrow as pa

from bitloom.functions import columnar
from bitloom.functions import syntax as X

MAPS = pa.map_(pa.string(), pa.int64())
KNOWN = {"nal_unit_type": 5, "log2_max_frame_num": 6, "log2_max_poc_lsb": 5, "poc_type": 0, "reads_bottom": 1, "reads_delta_0": 0, "reads_delta_1": 0, "redundant_pic_cnt_present": 0, "marks_refs": 1, "cabac": 1, "deblock_control": 1, "default_l0": 2, "default_l1": 1}


def both(table, rows):
    """rows: (bits, known values)."""
    got = columnar.read(pa.array([t for t, _ in rows], pa.string()), table, pa.array([list(k.items()) for _, k in rows], MAPS), X.RANGES).to_pylist()
    for (text, known), g in zip(rows, got):
        vals = dict(known)
        pos, ok, bad = X._read(text, table, vals)
        assert (g["ok"], g["bad"], dict(g["vals"])) == (ok, bad, vals)
        assert not ok or g["pos"] == pos


def test_random_bits_through_every_table():
    rng = random.Random(3)
    for table in (X.SPS, X.PPS, X.SLICE_START, *X.SLICE_TABLES.values()):
        rows = []
        for _ in range(150):
            one = rng.choice((0.2, 0.5, 0.8, 0.95))
            rows.append(("".join("1" if rng.random() < one else "0" for _ in range(rng.randrange(0, 500))), {k: v for k, v in KNOWN.items() if rng.random() < 0.98}))
        both(table, rows)


def test_written_headers_and_their_prefixes():
    rng = random.Random(5)
    rows = []
    for _ in range(60):
        vals = {e.name: rng.randrange(0, 3) for e in X.SPS if e.kind in ("u", "ue", "se", "scale")} | {"profile_idc": rng.choice((66, 100, 244)), "poc_type": rng.randrange(3), "num_ref_frames_in_cycle": rng.randrange(4)}
        text = X._put(X.SPS, vals)
        rows += [(text + "1", {}), (text[: rng.randrange(len(text))], {})]
    both(X.SPS, rows)


def test_nothing_and_nulls(spark):
    from pyspark.sql import functions as F

    both(X.PPS, [("", {}), ("1", {})])
    df = spark.createDataFrame([("1" * 40, "I"), (None, "I"), ("1" * 40, "none"), ("1" * 40, None)], "bits string, kind string")
    got = [r.p for r in df.select(X.parse(F.col("bits"), X.SLICE_TABLES, None, F.col("kind")).alias("p")).collect()]
    assert got[0] is not None and got[1:] == [None, None, None]


def test_batches_are_written_as_rows_are():
    rng = random.Random(8)
    for table in (X.SPS, X.PPS, X.SLICE_START, *X.SLICE_TABLES.values()):
        rows = []
        for _ in range(80):
            few = rng.choice((0.1, 0.6, 1))
            vals = {e.name: rng.randrange(-3, 4) if e.kind == "se" else rng.choice((0, 1, 2, 7, 300)) if e.kind == "ue" else rng.randrange(2) for e in table if rng.random() < few and e.kind != "fail"}
            rows.append(dict(KNOWN) | {k: v for k, v in vals.items() if k not in KNOWN} | {"profile_idc": rng.choice((66, 100, 244))})
        got = columnar.write(pa.array([list(r.items()) for r in rows], MAPS), table).to_pylist()
        assert got == [X._put(table, r) for r in rows]
    assert columnar.write(pa.array([], MAPS), X.PPS).to_pylist() == []


def test_bytes_are_read_as_their_bits():
    rng = random.Random(9)
    rows = [rng.randbytes(rng.randrange(0, 60)) for _ in range(300)]
    known = pa.array([list(KNOWN.items())] * len(rows), MAPS)
    for table in (X.PPS, X.SLICE_TABLES["Bw"]):
        texts = pa.array(["".join(f"{b:08b}" for b in r) for r in rows], pa.string())
        assert columnar.read(pa.array(rows, pa.binary()), table, known, X.RANGES).equals(columnar.read(texts, table, known, X.RANGES))


def test_a_batch_of_long_payloads_is_read_in_pieces(monkeypatch):
    rows = pa.array(["0" * 7 + "1" * 29_993] * 1_000, pa.string())
    known = pa.array([list(KNOWN.items())] * len(rows), MAPS)
    tracemalloc.start()
    got = columnar.read(rows, X.SLICE_START, known, X.RANGES)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(got) == 1_000 and peak < 200_000_000  # of 30 MB of bits
    monkeypatch.setattr(columnar, "cuts", lambda sizes: [(0, len(sizes))])
    assert got.equals(columnar.read(rows.slice(0, 1_000), X.SLICE_START, known, X.RANGES))


def test_cuts():
    import numpy as np

    assert columnar.cuts(np.array([5, 5, 1, 20, 0, 3]), rows=2, size=10) == [(0, 2), (2, 1), (3, 1), (4, 2)]
    assert columnar.cuts(np.array([], int)) == []


def test_scaling_lists_of_a_batch_are_those_of_single_rows(spark):
    """Absent lists, those of the default (first value 0), cut ones and whole ones"""
    rng, rows = random.Random(5), [(0, None), (1, {})]
    for no in range(2, 60):
        made = {f"list_{i}": rng.randint(0, 1) for i in range(12) if rng.random() < 0.9}
        for i in range(12):
            size = 16 if i < 6 else 64
            for j in range(rng.choice((0, 1, size // 2, size))):
                made[f"list_{i}_{j}"] = rng.randint(0, 255) if rng.random() < 0.1 else rng.randint(1, 255)
        rows.append((no, made))

    def single(row):
        known, lists = dict(row or ()), []
        for i in range(12):
            values = []
            while known.get(f"list_{i}_{len(values)}"):
                values.append(known[f"list_{i}_{len(values)}"])
            lists.append(values + values[-1:] * ((16 if i < 6 else 64) - len(values)) if known.get(f"list_{i}") else None)
        return lists

    df = spark.createDataFrame(rows, "id int, vals map<string,bigint>").repartition(1)
    got = {r.id: r.v for r in df.select("id", X.scaling_lists(df.vals).alias("v")).collect()}
    assert got == {no: single(row) for no, row in rows}


def test_long_headers_are_given_back_piece_by_piece(monkeypatch):
    """A batch of many values is never all there at once"""
    made = []
    monkeypatch.setattr(X.F, "arrow_udf", lambda kind: lambda function: made.append(function) or (lambda *columns: None))
    monkeypatch.setattr(X.F, "lit", lambda value: value)
    X.parse(None, X.SLICE_TABLES, "known", "key")
    X.write(None, X.SLICE_TABLES, "key")
    X.payload(None, X.SLICE_TABLES, "key", "known", "data")
    n = 2 * columnar.ROWS + 1
    maps, keys = pa.array([list(KNOWN.items())] * n, MAPS), pa.array(["P"] * n)
    for function, batch in zip(made, ([pa.array(["1" * 40] * n), maps, keys], [maps, keys], [maps, keys, maps, pa.array(["01"] * n)])):
        pieces = [len(piece) for piece in function(iter([batch, batch]))]
        assert sum(pieces) == 2 * n and max(pieces) <= columnar.ROWS


def test_closed_payloads_are_texts_in_bytes():
    """With bits after them, of any number; what is given goes before own values"""
    rng, rows, after = random.Random(11), [], []
    for _ in range(90):
        rows.append({"slice_type": 5, "frame_num": rng.randrange(64), "poc_lsb": rng.randrange(32), "qp_delta": rng.randrange(-9, 9), "cabac": rng.randrange(2), "default_l0": 9})
        after.append(rng.choice((None, "", "0", "1" * 8, "".join(rng.choice("01") for _ in range(rng.randrange(70))))))
    maps, known = pa.array([list(r.items()) for r in rows], MAPS), pa.array([list(KNOWN.items())] * len(rows), MAPS)
    for first in (0, 7):
        got = columnar.write(maps[first:], X.SLICE_TABLES["Pw"], known[first:], pa.array(after, pa.string())[first:]).to_pylist()
        for row, more, payload in zip(rows[first:], after[first:], got):
            bits = X._put(X.SLICE_TABLES["Pw"], row | KNOWN) + (more or "") + "1"
            assert "".join(f"{b:08b}" for b in payload) == bits + "0" * (-len(bits) % 8)
