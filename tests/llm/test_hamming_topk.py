import random

import pytest

from bitloom.llm import hamming_topk as h

from .helpers import SF, clashing, duck, rows

CODES = "id bigint, code bigint"


def plain(index, queries, k):
    out = []
    for q, a in {(q, a) for q, a in queries if q is not None and a is not None}:
        near = sorted({((a ^ b) & (1 << 64) - 1).bit_count() * 10**6 + i for i, b in index if i is not None and b is not None})[:k]
        out += [(x // 10**6, x % 10**6, q, n + 1) for n, x in enumerate(near)]
    return sorted(out, key=repr)


def test_tables_match_sql(spark):
    from bitloom.llm.entries import op9_hamming_topk

    assert rows(op9_hamming_topk(spark, SF)) == duck(h.oracle_sql(50), embeddings=f"{SF}/embeddings.parquet")


@pytest.mark.parametrize("segments", [8, 3, None])
def test_ties_repeats_and_hot_codes(spark, segments):
    random.seed(segments)
    hot = random.getrandbits(63)
    index = [(i, hot) for i in range(60)] + [(i, random.getrandbits(63) - (1 << 62)) for i in range(60, 160)] + [(200 + b, hot ^ (1 << b)) for b in range(60)]
    index += [(5, hot), (None, 3), (300, None)]
    queries = [(1, hot), (1, hot), (2, hot ^ 7), (3, -1), (4, None), (None, 5), (6, hot)]
    df, asked = spark.createDataFrame(index, CODES), spark.createDataFrame(queries, CODES)
    for k in (1, 10, 75):
        assert rows(h.top_k(clashing(df), clashing(asked), k, segments)) == plain(index, queries, k)


def test_fewer_rows_than_k_and_empty_tables(spark):
    df, asked = spark.createDataFrame([(1, 0), (2, -1)], CODES), spark.createDataFrame([(9, 1)], CODES)
    assert rows(h.top_k(df, asked)) == [(1, 1, 9, 1), (63, 2, 9, 2)]
    assert rows(h.top_k(df.limit(0), asked)) == rows(h.top_k(df, asked.limit(0))) == []


def test_sign_codes(spark):
    vectors = [([0.5, -1.0, 0.0, 2.0],), ([float("nan")] * 64,), ([1.0] * 64,), (None,), ([None, 1.0],), ([],), ([1.0] * 70,)]
    df = spark.createDataFrame(vectors, "v array<float>")
    assert [r[0] for r in df.select(h.sign_code(df["v"])).collect()] == [9, 0, -1, 0, 2, 0, -1]


def test_masks():
    for ones in range(9):
        assert sorted(h._masks(8, ones).tolist()) == [x for x in range(256) if x.bit_count() == ones]
