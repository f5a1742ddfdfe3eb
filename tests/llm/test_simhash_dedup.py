import random
import re
from collections import Counter

import numpy as np
import xxhash

from bitloom.llm import simhash_dedup as s

from .helpers import SF, clashing, docs, rows


def plain_fingerprint(text):
    text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hashes = [xxhash.xxh64(x.encode(), 42).intdigest() for x in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_classes(rows_):
    prints = [plain_fingerprint(t) for _, t in rows_]
    root = list(range(len(rows_)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows_)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 3:
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows_):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return sorted(((least.get(find(i)), d, f"{prints[i]:016x}") for i, (d, _) in enumerate(rows_)), key=repr)


def test_anchors_cover_all_pairs():
    rng = np.random.default_rng(0)
    a = rng.integers(0, 2**32, 2000, dtype=np.uint32)
    b = a ^ np.where(rng.random(2000) < 0.2, 0, np.uint32(1) << rng.integers(0, 32, 2000, dtype=np.uint32)).astype(np.uint32)
    (va, ta), (vb, tb) = s.anchors_of(a), s.anchors_of(b)
    assert ((vb == va[:, :1]) & tb).any(axis=1).all()  # b reaches a's home
    assert (np.bitwise_count(va ^ a[:, None])[ta] <= 2).all()
    assert (s._syndrome(va[ta] & np.uint32(0x7FFFFFFF)) == 0).all()
    assert all(len(set(v[t])) == t.sum() for v, t in zip(va, ta))


def test_classes_match_comparing_all(spark):
    random.seed(1)
    base = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    long = " ".join(random.choice("abcdefghij") + str(random.randrange(400)) for _ in range(900))
    near = []
    for i in range(150):  # a large group of near copies
        words = long.split()
        words[random.randrange(len(words))] = f"edit{i}"
        near.append((10_000 + i, " ".join(words)))
    odd = [(20_000, None), (20_001, ""), (20_002, " \t\r\n"), (20_003, "one"), (20_004, "ONE"), (20_005, "one two"), (20_006, "é É"), (20_006, "é É"), (None, "one"), (None, None), (20_007, "x " * 70_000)]
    table = base + near + odd
    assert rows(s.simhash_classes(clashing(docs(spark, table)))) == plain_classes(table)


def test_hot_anchors_are_cut_into_blocks(spark, monkeypatch):
    monkeypatch.setattr(s, "BLOCK", 8)
    random.seed(2)
    centre = random.getrandbits(64)
    prints = {centre}
    while len(prints) < 200:
        x = centre
        for bit in random.sample(range(64), random.randrange(1, 8)):
            x ^= 1 << bit
        prints.add(x)
    signed = [(p - (1 << 64) if p >> 63 else p,) for p in prints]
    df = spark.createDataFrame(signed, "fp bigint")
    scratch = s.Scratch(spark, "test")
    labels = s.components(df.selectExpr("fp as v"), s.links(df, scratch), scratch)
    got = {r["v"]: r["label"] for r in labels.collect()}
    fps = [p for (p,) in signed]
    root = {p: p for p in fps}

    def find(p):
        while root[p] != p:
            p = root[p]
        return p

    for i, p in enumerate(fps):
        for q in fps[:i]:
            if ((p ^ q) & (1 << 64) - 1).bit_count() <= 3:
                a, b = sorted((find(p), find(q)))
                root[b] = a
    assert got == {p: find(p) for p in fps}


def test_components_of_a_long_chain(spark):
    n = 300
    nodes = spark.range(n + 5).selectExpr("id as v")
    order = list(range(n))
    random.Random(3).shuffle(order)
    pairs = spark.createDataFrame(list(zip(order, order[1:])), "a bigint, b bigint")
    labels = s.components(nodes, pairs, s.Scratch(spark, "test"))
    assert {r["v"]: r["label"] for r in labels.collect()} == {i: 0 if i < n else i for i in range(n + 5)}


def test_empty_table(spark):
    assert rows(s.simhash_classes(docs(spark, []))) == []
    assert s.keep_one(docs(spark, [])).count() == 0


def test_keep_one_keeps_one_of_each(spark):
    table = [(1, "a b c d"), (2, "A B C D"), (3, "other words here"), (3, "other words here"), (4, None), (5, ""), (None, "a b c d"), (None, "a b c d")]
    kept = [r["doc_id"] for r in s.keep_one(clashing(docs(spark, table))).collect()]
    assert Counter(kept) == Counter([1, 3, 4])
