import pytest

from bitloom.llm import extendible_shards as e

from .helpers import SF, clashing, docs, duck, rows

COLUMNS = ["doc_id", "n_bytes", "shard_id", "shard_bytes", "oversize"]


@pytest.mark.parametrize("limit", [1, 3_000, 20_000, 1 << 20])
def test_shards_match_sql(spark, limit):
    got = rows(e.shard(spark.read.parquet(f"{SF}/documents.parquet"), limit).select(COLUMNS))
    assert got == duck(e.oracle_sql(limit), documents=f"{SF}/documents.parquet")


def test_repeated_rows_nulls_and_long_texts(spark):
    table = [(7, "same text")] * 40 + [(7, f"other {i}") for i in range(40)] + [(None, "n"), (None, None), (1, ""), (2, "z" * 5000), (3, "é" * 100)]
    df = clashing(docs(spark, table))
    got = e.shard(df, 60).collect()
    assert len(got) == len(table)
    sums = {}
    for r in got:
        assert r["n_bytes"] == len((r["text"] or "").encode())
        sums.setdefault(r["shard_id"], []).append(r)
    for shard in sums.values():
        total = sum(r["n_bytes"] for r in shard)
        assert all(r["shard_bytes"] == total and r["oversize"] == (total > 60) for r in shard)
        assert total <= 60 or len(shard) == 1
    ids = sorted(sums)
    assert not any(b.startswith(a) for a, b in zip(ids, ids[1:]))  # buckets do not nest


def test_empty_table_and_bad_limit(spark):
    assert e.shard(docs(spark, [])).count() == 0
    with pytest.raises(ValueError):
        e.shard(docs(spark, []), 0)


def test_equal_rows_are_numbered_once(spark):
    """Rows equal in id and text part by a number that is given once, whatever the order of the input's tasks."""
    df = docs(spark, [(7, "same text")] * 200 + [(i, "x" * i) for i in range(100)]).repartition(7)
    got = e.shard(df, 100).collect()
    assert len(got) == 300 and all(r["shard_id"] is not None for r in got)
    sums = {}
    for r in got:
        sums[r["shard_id"]] = sums.get(r["shard_id"], 0) + r["n_bytes"]
    assert max(sums.values()) <= 100 and all(r["shard_bytes"] == sums[r["shard_id"]] for r in got)
