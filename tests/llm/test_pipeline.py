from collections import Counter

import corpus_pipeline as p
from bitloom.llm import quality_knn
from bitloom.llm._scratch import Scratch

from .helpers import clashing, docs, duck, rows
from .test_simhash_dedup import plain_classes
from .test_source_mix import plain_targets, size

SF = "/root/testdata/sf0.001"


def test_every_stage_against_a_plain_version(spark):
    from bitloom.llm import decontaminate

    scratch = Scratch(spark, "test-pipeline")
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    before = docs
    for no, (name, stage) in enumerate(p.STAGES):
        after = scratch.keep(stage(spark, before, SF), str(no))
        ids_before, ids_after = ([r["doc_id"] for r in df.collect()] for df in (before, after))
        if no == 0:
            scores = {r["doc_id"]: r["predicted"] for r in quality_knn.score_quality(docs, spark.read.parquet(f"{SF}/labels.parquet")).collect()}
            assert sorted(ids_after) == sorted(i for i in ids_before if scores[i])
        elif no == 1:
            classes = plain_classes([(r["doc_id"], r["text"]) for r in before.collect()])
            assert sorted(ids_after) == sorted({c for c, _, _ in classes})
        elif no == 2:
            verdicts = duck(f"SELECT doc_id FROM ({decontaminate.oracle_sql()}) WHERE NOT contaminated", documents=before, benchmark=f"{SF}/benchmark.parquet")
            assert sorted(ids_after) == sorted(i for (i,) in verdicts)
        elif no == 3:
            sizes, taken = Counter(), Counter()
            for r in before.collect():
                sizes[r["source"]] += size(r["text"])
            for r in after.collect():
                taken[r["source"]] += size(r["text"])
            want = plain_targets(sizes)
            assert max(Counter(ids_after).values()) <= 2 and sum(taken.values()) > 0.8 * sum(want.values())
        else:
            assert Counter(ids_after) == Counter(ids_before)
            assert after.select("shard_id", "shard_bytes").distinct().agg({"shard_bytes": "sum"}).first()[0] == sum(len(r["text"].encode()) for r in before.collect())
        if no < len(p.STAGES) - 1:
            assert after.columns == columns
        before = after
    assert rows(p.run(spark, SF)) == rows(before)


def test_stages_on_odd_tables(spark):
    """Nulls in every column, empty and long texts, repeated rows and clashing columns pass through every stage; an empty table stays empty."""
    real = spark.read.parquet(f"{SF}/documents.parquet").limit(30)
    odd = [(None, None, None, None), (10**6, None, "en", "src0"), (10**6 + 1, "", None, None), (10**6 + 2, "word " * 30_000), (5, "another text under a known id", None, None), (10**6 + 3, "one two three"), (10**6 + 3, "one two three"), (None, "one two three")]
    scratch = Scratch(spark, "test-odd")
    both = scratch.keep(clashing(real.unionByName(docs(spark, odd))), "both")
    for no, (name, stage) in enumerate(p.STAGES):
        out = scratch.keep(stage(spark, both, SF), f"{no}")
        assert out.columns[: len(both.columns)] == both.columns if no < 4 else {"shard_id", "shard_bytes"} <= set(out.columns)
        n = out.count()
        assert n == both.count() if no == 4 else 0 < n <= both.count() * (2 if no == 3 else 1), name
        assert stage(spark, both.limit(0), SF).count() == 0, name
    kept = [r["doc_id"] for r in p.near_dedup(spark, both, SF).collect()]
    assert kept.count(10**6 + 3) == 1 and kept.count(None) == 0 and kept.count(10**6) == 1 and 10**6 + 1 not in kept
    left = p.near_dedup(spark, docs(spark, [(5, "first text of an id"), (5, "a second one, quite different"), (6, "first text of an id")]), SF).collect()
    assert sorted((r["doc_id"], r["text"]) for r in left) == [(5, "a second one, quite different"), (5, "first text of an id")]


def test_tables_of_a_run_are_removed(spark):
    from bitloom.llm import _scratch

    before = list(_scratch._made)
    result = p.run(spark, SF)
    made = [s for s in _scratch._made if s not in before]
    assert len(made) == 1 and made[0].tables == [f"stage-{len(p.STAGES) - 1}"]
    assert result.count() > 0
    made[0].remove()
