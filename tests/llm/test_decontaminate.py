import numpy as np
import pytest

from bitloom.llm import decontaminate as d

from .helpers import SF, clashing, docs, duck, rows

ITEMS = "item_id bigint, text string"
LONG = "Alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi"


def planted(spark):
    items = [(1, LONG), (2, "short Item"), (3, None), (4, ""), (5, "--- !!"), (12, "the the the the the the the the the the the the the the"), (7, LONG + " rho"), (7, "short item")]
    words = LONG.split()
    table = [
        (0, None), (1, ""), (2, "short-ITEM"), (3, "a short item, a short, item"), (4, " ".join(words[:13])), (5, " ".join(words[:12])), (6, " ".join(words[2:])),
        (7, "the " * 40), (8, "x " * 500 + LONG), (9, LONG.replace(" ", " ")), (10, "Élan short item"), (10, "Élan short item"), (11, " ".join([*words[:13], *words[:13]])), (12, "the " * 13 + "end"),
    ]
    return docs(spark, table), spark.createDataFrame(items, ITEMS)


def test_planted_cases_match_sql(spark):
    table, items = planted(spark)
    distinct = table.distinct()
    assert rows(d.digests(d.find_windows(clashing(distinct), clashing(items)))) == duck(d.oracle_sql(), documents=distinct, benchmark=items)


def test_blocks_of_items_add_up(spark):
    table, items = planted(spark)
    whole = rows(d.find_windows(table, items))
    assert whole == rows(d.find_windows(table, items, block_bytes=60))
    assert len(whole) == table.count()  # repeated rows stay


def test_tables_match_sql(spark):
    table, items = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "benchmark"))
    found = rows(d.digests(d.find_windows(table, items)))
    assert found == duck(d.oracle_sql(), documents=f"{SF}/documents.parquet", benchmark=f"{SF}/benchmark.parquet")
    assert any(r[0] for r in found) and not all(r[0] for r in found)


def test_empty_tables_and_null_ids(spark):
    table, items = planted(spark)
    assert rows(d.find_windows(table.limit(0), items)) == []
    assert all(r["spans"] == [] and r["item_ids"] == [] for r in d.find_windows(table, items.limit(0)).collect())
    nameless = spark.createDataFrame([(None, "short item")], ITEMS)
    got = d.digests(d.find_windows(docs(spark, [(None, "a short item")]), nameless)).first()
    assert (got["doc_id"], got["n_hit"], got["n_items"], got["contaminated"]) == (None, 2, 0, True)


def test_drop_contaminated_judges_each_row(spark):
    table, items = planted(spark)
    bad = {r["doc_id"] for r in d.digests(d.find_windows(table, items)).where("contaminated").collect()}
    kept = d.drop_contaminated(clashing(table), items)
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(r["doc_id"] for r in table.collect() if r["doc_id"] not in bad)
    assert kept.columns == clashing(table).columns


def test_windows_that_share_their_rarest_word(spark):
    """A word that many windows have as their rarest is a few places to look up, not a list to walk; all are found."""
    import random

    rng = random.Random(5)
    common = [f"w{i}" for i in range(30)]
    items = [(f"i{n}", " ".join([*rng.choices(common, k=6), "rare", *rng.choices(common, k=6)])) for n in range(400)] + [("short", "rare w1"), ("twin", "rare w1"), (None, "only here")]
    table = [(n, " ".join([*rng.choices(common, k=20), text, *rng.choices(common, k=20)])) for n, (_, text) in enumerate(items[:50])] + [(900, "rare " * 50), (901, "w3 rare w1"), (902, "only here")]
    benchmark = spark.createDataFrame(items, "item_id string, text string")
    documents = docs(spark, table)
    named = benchmark.where("item_id is not null")
    assert rows(d.digests(d.find_windows(documents, named))) == duck(d.oracle_sql(), documents=documents, benchmark=named)
    found = {r["doc_id"]: r["item_ids"] for r in d.find_windows(documents, benchmark).collect()}
    assert all(items[n][0] in found[n] for n in range(50)) and found[901] == ["short", "twin"] and found[902] == []
    assert rows(d.find_windows(documents, benchmark, block_bytes=2000)) == rows(d.find_windows(documents, benchmark))


def test_windows_longer_than_sixteen_words(spark):
    """The rarest word of a window may stand at any of its places."""
    words = [f"w{i}" for i in range(40)]
    items = spark.createDataFrame([("a", " ".join(words))], "item_id string, text string")
    for window in (20, 33, 40):
        found = d.find_windows(docs(spark, [(1, " ".join(words)), (2, " ".join(words[:19]) + " w1 w2")]), items, window=window)
        got = {r.doc_id: r.n_hit for r in d.digests(found).collect()}
        assert got == {1: 40, 2: 0}
    with pytest.raises(ValueError):
        d._places(65)


def test_a_window_of_many_items_is_kept_once():
    shared = " ".join(f"s{i}" for i in range(13))
    items = [(f"i{k}", f"{shared} own{k}") for k in range(3000)]
    index = d._Index(items, np.ones(d.BUCKETS, np.int64), 13)
    (n, _, hashes, _, owned, owners) = index.groups[0]
    assert len(owners) == 6000 and len(hashes) == 3001 and np.diff(owned).max() == 3000
    hit, found = index.hits(d.words_of(f"{shared} x " * 200))
    assert len(found) == 3000 and hit.sum() == 13 * 200
