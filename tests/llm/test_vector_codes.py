"""Delta-maintained Lloyd against full passes in SQL and a plain loop, and odd tables."""

import numpy as np
import pytest

from bitloom.llm import entries, vector_codes
from tests.llm.helpers import SF, clashing, duck, rows

KIND = "vec_id bigint, embedding array<double>, label int"


def table(spark, made):
    return spark.createDataFrame(made, KIND)


def plain(made, parts, entries_, rounds, scale=4096):
    """Codes, errors and codebooks by full passes in Python integers."""
    kept = sorted((r for r in made if r[1] is not None and all(x is not None and np.isfinite(x) for x in r[1])), key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    ints = [[int(np.floor(x * scale)) for x in r[1]] for r in kept]
    span = len(ints[0]) // parts
    cut = [[v[p * span : (p + 1) * span] for p in range(parts)] for v in ints]
    books = [[list(v[p]) for v in cut[:entries_]] for p in range(parts)]

    def assign():
        return [[min((sum((a - b) ** 2 for a, b in zip(v[p], e)), k) for k, e in enumerate(books[p])) for p in range(parts)] for v in cut]

    for _ in range(rounds):
        got = assign()
        for p in range(parts):
            for k in range(len(books[p])):
                mine = [v[p] for v, g in zip(cut, got) if g[p][1] == k]
                if mine:
                    books[p][k] = [sum(c) // len(mine) for c in zip(*mine)]
    got = assign()
    return [(r[0], bytes(k for _, k in g), sum(d for d, _ in g), r[2]) for r, g in zip(kept, got)], books


def test_query_equals_full_passes_in_sql(spark):
    found = rows(entries.op11_vector_codes(spark, SF))
    assert found == duck(vector_codes.oracle_sql(), embeddings=f"{SF}/embeddings.parquet") and len(found) == 500


def test_odd_rows_against_a_plain_loop(spark):
    rng = np.random.default_rng(5)
    made = [(int(i), [float(x) for x in rng.integers(-3, 4, 4) / 4096 * 5], int(i) % 3 if i % 4 else None) for i in range(60)]
    made += made[:7] * 3 + [(None, [0.5, -0.5, 0.25, 0.0], 1), (100, None, 1), (101, [1.0, None, 0.0, 0.0], 1), (102, [1.0, float("nan"), 0.0, 0.0], 2), (103, [float("inf"), 0.0, 0.0, 0.0], 2)]
    coded, books = vector_codes.compress(clashing(table(spark, made)).repartition(5), parts=2, entries=5, rounds=4)
    want, plain_books = plain(made, 2, 5, 4)
    assert books.tolist() == plain_books
    by_label = {}
    for _, _, error, label in want:
        by_label[label] = by_label.get(label, 0) + error
    assert sorted(((r.vec_id, bytes(r.code), r.error, r.label_error) for r in coded.collect()), key=repr) == sorted(((i, c, e, by_label[label]) for i, c, e, label in want), key=repr)


def test_labels_without_broadcast(spark, monkeypatch):
    made = [(i, [float(i % 5), float(i % 3)], i % 4 if i % 6 else None) for i in range(40)]
    few = rows(vector_codes.compress(table(spark, made), parts=2, entries=3)[0])
    monkeypatch.setattr(vector_codes, "FEW_LABELS", 1)
    assert rows(vector_codes.compress(table(spark, made), parts=2, entries=3)[0]) == few


def test_a_round_shuffles_only_changes(spark):
    """The second of two equal rounds has nothing to add up, so no entry is sent."""
    made = [(i, [float(i % 2), float(i % 2)], 0) for i in range(64)]
    x = np.array([r[1] for r in made]).astype(np.int64)[:, None, :]
    import pyarrow as pa

    codes = [row.tobytes() for row in (x[:, :, 0]).astype(np.uint8)]

    def changes(before):
        batch = pa.RecordBatch.from_arrays([pa.array([v[0].tolist() for v in x], pa.list_(pa.int32())), pa.array(before, pa.binary()), pa.array(codes, pa.binary())], names=["pq_ints", "pq_before", "pq_code"])
        return [r for b in vector_codes._changes(1, 2, 2)([batch]) for r in b.to_pylist()]

    assert changes(codes) == []
    assert {(r["entry"], r["s0"], r["s1"]) for r in changes([None] * 64)} == {(0, 32, 0), (1, 32, 32)}
    moved = [b"\0", *codes[1:]]
    moved[1] = b"\0"
    assert {(r["entry"], r["s0"], r["s1"]) for r in changes(moved)} == {(0, -1, -1), (1, 1, 1)}


def test_few_and_no_rows(spark):
    coded, books = vector_codes.compress(table(spark, [(2, [1.0, 2.0], None)]), parts=2)
    assert books.shape == (2, 1, 1) and [(r.vec_id, bytes(r.code), r.error, r.label_error) for r in coded.collect()] == [(2, b"\0\0", 0, 0)]
    for empty in ([], [(1, None, 3)]):
        coded, books = vector_codes.compress(table(spark, empty), parts=2)
        assert coded.collect() == [] and books.size == 0
        assert vector_codes.digests(coded, books).columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]


def test_unusable_shapes_raise(spark):
    with pytest.raises(ValueError):
        vector_codes.compress(table(spark, [(1, [1.0, 2.0], 0), (2, [1.0], 0)]), parts=1)
    with pytest.raises(ValueError):
        vector_codes.compress(table(spark, [(1, [1.0, 2.0, 3.0], 0)]), parts=2)
    with pytest.raises(Exception, match="not below"):
        vector_codes.compress(table(spark, [(1, [1e9, 2.0], 0)]), parts=2)


def test_decoded_is_near(spark):
    made = [(i, [i / 10, 1 - i / 10], 0) for i in range(20)]
    coded, books = vector_codes.compress(table(spark, made), parts=2, entries=16)
    got = coded.orderBy("vec_id").collect()
    back = vector_codes.decoded(np.array([list(r.code) for r in got], np.uint8), books)
    assert np.abs(back - np.array([m[1] for m in made])).max() < 0.2
