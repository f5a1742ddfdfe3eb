import math
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from bitloom.llm import source_mix as m

from .helpers import SF, clashing, docs, rows


def plain_targets(sizes, weights=m.WEIGHTS, share=1.5, cap=2.0):
    """Reshare the excess over and over."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    total, capped = share * sum(sizes.values()), set()
    while True:
        free = [s for s in order if s not in capped]
        left = total - sum(cap * sizes[s] for s in capped)
        want = {s: left * weight[s] / sum(weight[f] for f in free) for s in free}
        over = {s for s in free if want[s] > cap * sizes[s]}
        if not over:
            return {s: cap * sizes[s] if s in capped else want[s] for s in order}
        capped |= over


def size(text):
    import re

    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def taken(mix):
    out = defaultdict(int)
    for r in mix.collect():
        out[r["source"]] += r["mix_size"] * len(r["mix_copies"])
        assert r["mix_size"] == size(r["text"]) and len(r["mix_copies"]) <= 2
    return out


@pytest.mark.parametrize("table", ["sf0.001", "sf0.01"])
def test_targets_and_taken_words(spark, table):
    df = spark.read.parquet(f"/root/testdata/{table}/documents.parquet")
    sizes = defaultdict(int)
    largest = defaultdict(list)
    for r in df.collect():
        sizes[r["source"]] += size(r["text"])
        largest[r["source"]].append(size(r["text"]))
    want = plain_targets(sizes)
    mix = m.mix(df)
    assert {r["source"]: pytest.approx(r["mix_target"]) for r in mix.select("source", "mix_target").distinct().collect()} == want
    assert all(r["mix_source_size"] == sizes[r["source"]] for r in mix.collect())
    off = []
    for source, words in taken(mix).items():
        assert abs(words - want[source]) <= max(largest[source]) / 2
        off.append(abs(words - want[source]) / max(1, want[source]))
    assert sorted(off)[len(off) // 2] < 0.02 and sum(off) / len(off) < 0.05
    again = m.mix(df.repartition(3))
    assert rows(mix) == rows(again)


def test_shards_share_each_source_exactly(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    blocks = m.mix(df, shards=5).select("source", F.explode("mix_copies").alias("c")).groupBy("c.shard").count().collect()
    assert {r["shard"] for r in blocks} <= set(range(5))
    copies = m.mix(df, shards=5).select(F.explode("mix_copies").alias("c"), "doc_id").select("doc_id", "c.epoch")
    assert copies.count() == copies.distinct().count()  # disjoint draws


def test_splitting_tree_keeps_every_quota(spark):
    quotas = spark.createDataFrame([(i, q) for i, q in enumerate([1000, 0, 37, 5, 1, 222])], "_bitloom_no bigint, quota bigint")
    leaves = m._split(quotas, 7, 1, m.Scratch(spark, "test"))
    per_source, per_shard = defaultdict(int), defaultdict(int)
    for r in leaves.collect():
        assert r["quota"] >= 0
        per_source[r["_bitloom_no"]] += r["quota"]
        per_shard[r["shard"]] += r["quota"]
    assert per_source == {i: q for i, q in enumerate([1000, 0, 37, 5, 1, 222])}
    assert sum(per_shard.values()) == 1265 and all(abs(n - 1265 / 7) <= 3 for n in per_shard.values())


def test_hypergeometric_probabilities(spark):
    total, good, drawn, n = 30, 12, 9, 20_000
    unit = (F.col("id") + 0.5) / n
    got = spark.range(n).select(m.hypergeometric(F.lit(float(total)), F.lit(float(good)), F.lit(float(drawn)), unit).alias("k")).groupBy("k").count()
    for r in got.collect():
        k = int(r["k"])
        p = math.comb(good, k) * math.comb(total - good, drawn - k) / math.comb(total, drawn)
        assert abs(r["count"] / n - p) < 2 / n


def test_large_draws_stay_in_range(spark):
    cases = [(1e6, 3e5, 5e5), (10.0, 10.0, 3.0), (10.0, 0.0, 3.0), (5.0, 2.0, 5.0), (0.0, 0.0, 0.0), (1e6, 1.0, 999_999.0)]
    df = spark.createDataFrame(cases, "t double, g double, d double")
    for u in (0.0, 0.3, 1 - 2**-53):
        for r in df.select("t", "g", "d", m.hypergeometric(F.col("t"), F.col("g"), F.col("d"), F.lit(u)).alias("k")).collect():
            assert max(0, r["d"] + r["g"] - r["t"]) <= r["k"] <= min(r["d"], r["g"])


def test_nulls_repeats_and_empty_tables(spark):
    table = [(1, "a b c", "en", None), (1, "a b c", "en", None), (2, None, "en", "s"), (3, "", "en", "s"), (None, "x y", "en", "t"), (4, "one two three four", "en", "t"), (5, "w", "en", "")]
    mix = clashing(docs(spark, table))
    got = m.mix(mix)
    assert got.count() == len(table) and set(mix.columns) - {"mix_size"} <= set(got.columns)
    zero = [r for r in got.collect() if r["source"] == "s"]
    assert all(r["mix_target"] == 0 and r["mix_copies"] == [] for r in zero)
    taken(got)
    assert m.mix(mix.limit(0)).count() == 0


def test_last_epoch_is_filled_from_all_blocks(spark):
    """Long documents are laid aside where they do not fit: the sum is off by less than the smallest document not taken."""
    table = [(i, " ".join(["w"] * n), "en", f"s{s}") for s in range(4) for i, n in enumerate([100_000, *[97 + s] * 1030], 10_000 * s)]
    table += [(None, "three words here", "en", "ties")] * 7 + [(90_000 + i, "w " * n, "en", "ties") for i, n in enumerate((40, 2, 2, 6, 9))]
    df = docs(spark, table).repartition(4)
    left = defaultdict(list)
    got = m.mix(df, share=0.7, cap=0.7).collect()
    took = defaultdict(int)
    for r in got:
        took[r["source"]] += r["mix_size"] * len(r["mix_copies"])
        if not r["mix_copies"]:
            left[r["source"]].append(r["mix_size"] * (7 if r["doc_id"] is None else 1))
    for source, target in {r["source"]: r["mix_target"] for r in got}.items():
        assert abs(took[source] - target) <= min(left[source])
    assert len({len(r["mix_copies"]) for r in got if r["doc_id"] is None}) == 1


def test_shards_are_written(spark, tmp_path):
    df = spark.read.parquet(f"{SF}/documents.parquet")
    path = f"file://{tmp_path}/mix"
    m.write_shards(df, path, shards=4, files_per_shard=2)
    assert rows(spark.read.parquet(path).select("doc_id")) == rows(m.mixed(df, shards=4).select("doc_id"))


def test_splitting_tree_in_groups_of_sources(spark):
    quotas = {i: (i * 37) % 90 for i in range(60)}
    df = spark.createDataFrame(list(quotas.items()), "_bitloom_no bigint, quota bigint")
    per_source, per_shard = defaultdict(int), defaultdict(int)
    for r in m._split(df, 7, 1, m.Scratch(spark, "test"), group=8).collect():
        assert r["quota"] >= 0
        per_source[r["_bitloom_no"]] += r["quota"]
        per_shard[r["shard"]] += r["quota"]
    assert per_source == quotas
    assert all(abs(n - sum(quotas.values()) / 7) <= 3 for n in per_shard.values())


def test_copies_follow_the_tree(spark):
    """Whole blocks go to one shard, the shards' sizes are even, and reading the edges range by range takes no other documents."""
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    mix = m.mix(df, shards=5)
    shards = mix.select(F.explode("mix_copies.shard").alias("s")).groupBy("s").count().collect()
    assert {r["s"] for r in shards} == set(range(5))
    even = sum(r["count"] for r in shards) / 5
    assert all(0.7 * even < r["count"] < 1.3 * even for r in shards)
    assert rows(mix) == rows(m.mix(df, shards=5, edge=1))


def test_the_mix_is_shuffled_within_its_shards(spark):
    df = spark.read.parquet(f"{SF}/documents.parquet")
    want = m.mix(df, shards=2).select("doc_id", F.explode("mix_copies").alias("c")).select("doc_id", "c.*").collect()
    got = [[r["doc_id"] for r in part] for part in m.mixed(df, shards=2, files=3).rdd.glom().collect()]
    assert len(got) == 6
    for i, part in enumerate(got):
        assert part == [r["doc_id"] for r in sorted(want, key=lambda r: r["place"]) if r["shard"] * 3 + r["place"] % 3 == i]
