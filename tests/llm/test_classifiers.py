import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from bitloom.llm import _ngrams, language_id, quality_knn

from .helpers import clashing, docs, rows

SF = "/root/testdata/sf0.01"


def crc(doc_id):
    return zlib.crc32(str(doc_id).encode())


def test_languages_of_held_out_documents(spark):
    table = spark.read.parquet(f"{SF}/documents.parquet")
    lang = {r["doc_id"]: r["lang"] for r in table.collect()}
    got = language_id.identify(table).collect()
    assert len(got) == len(lang) and all(r["held_out"] == (crc(r["doc_id"]) % 5 == 0) and 0 <= r["score"] <= 1 for r in got)
    held = [r for r in got if r["held_out"]]
    assert sum(r["lang_pred"] == lang[r["doc_id"]] for r in held) >= 0.97 * len(held)


def test_language_edge_cases(spark):
    table = [(i, "the cat and the dog are here", "en") for i in range(20)] + [(i, "der hund und die katze sind hier", "de") for i in range(20, 40)]
    table += [(50, None, "en"), (51, "", None), (52, "123 !?", "de"), (53, "und die katze " * 100_000, None), (54, "and the", None), (54, "and the", None), (None, "the dog", "en")]
    got = {r["doc_id"]: r for r in language_id.identify(clashing(docs(spark, table))).collect()}
    assert [got[i]["lang_pred"] for i in (50, 51, 52, 53, 54)] == ["und", "und", "und", "de", "en"]
    assert got[50]["score"] == 0 and got[None]["held_out"]
    assert rows(language_id.identify(docs(spark, []))) == []
    unlabelled = language_id.identify(docs(spark, [(1, "a text", None)])).first()
    assert (unlabelled["lang_pred"], unlabelled["score"]) == ("und", 0.0)


def test_quality_of_held_out_documents(spark):
    table, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    known = {r["doc_id"]: r["quality"] for r in labels.collect()}
    got = quality_knn.score_quality(table, labels).collect()
    assert len(got) == table.count() and all(r["held_out"] == (crc(r["doc_id"]) % 4 == 2) and 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.7) for r in got)
    held = [r for r in got if r["held_out"] and r["doc_id"] in known]
    assert sum(r["predicted"] == known[r["doc_id"]] for r in held) >= 0.95 * len(held)


def test_quality_edge_cases(spark):
    table, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    odd = [(10**6, None), (10**6 + 1, ""), (10**6 + 2, " \n"), (None, "words here"), (10**6 + 3, "word " * 400_000), (10**6 + 4, "one"), (10**6 + 4, "one")]
    both = clashing(table.unionByName(docs(spark, odd)))
    got = quality_knn.score_quality(both, labels.unionByName(labels.limit(3)).unionByName(spark.createDataFrame([(None, 1, 0), (5, None, 0)], labels.schema))).collect()
    assert len(got) == both.count() and all(0 <= r["score"] <= 1 for r in got)
    score = {r["doc_id"]: r["score"] for r in got}
    assert score[10**6] == score[10**6 + 1] == score[10**6 + 2] == 0.5
    assert score[10**6 + 3] < 0.5  # one word over and over
    assert rows(quality_knn.score_quality(table.limit(0), labels)) == []
    assert {r["score"] for r in quality_knn.score_quality(docs(spark, odd), labels.limit(0)).collect()} == {0.5}
    kept = quality_knn.keep_accepted(both, labels)
    assert kept.columns == both.columns and 0 < kept.count() < both.count()


def test_pieces_do_not_change_features(monkeypatch):
    """Words, n-grams and repeats across the cuts of a long text count as in the whole."""
    rng = random.Random(3)
    texts = ["".join(rng.choice(["the ", "the ", "a", "Bc", "9", "\n", " ", "  ", "é", "wordword", "."]) for _ in range(n)) for n in (1, 5, 99, 100, 101, 700)] + ["x" * 450, " " * 250, "", "ab " * 33 + "a"]
    whole = [quality_knn.features(t) for t in texts]
    counts = [sum(np.bincount(f, minlength=1 << language_id.BITS) for f, _ in language_id._slices([t])) for t in texts]
    for piece in (1, 2, 3, 100):
        monkeypatch.setattr(_ngrams, "PIECE", piece)
        monkeypatch.setattr(language_id, "SLICE", 2 * piece)
        for text, want, count in zip(texts, whole, counts):
            got = quality_knn.features(text)
            assert (got is None) == (want is None) and (want is None or np.array_equal(got, want))
            assert np.array_equal(sum(np.bincount(f, minlength=1 << language_id.BITS) for f, _ in language_id._slices([text])), count)
        together = list(language_id._slices(texts))
        for i, count in enumerate(counts):
            assert np.array_equal(sum(np.bincount(f[o == i], minlength=1 << language_id.BITS) for f, o in together), count)


def hashed(values, bits):
    """The hash of one n-gram, with Python's numbers."""
    odd, most = (0x9E3779B1, 0x85EBCA6B, 0xC2B2AE35, 0x27D4EB2F), 2**32
    h = len(values)
    for i, v in enumerate(values):
        h = (h ^ v) * odd[i % 4] % most
        h ^= h >> 15
    return (h * odd[0] % most) >> (32 - bits)


def grams(text):
    letters = "".join(c if c.isalpha() else " " for c in f" {text.lower()} ")
    s = " " + " ".join(letters.split()) + " " if letters.split() else " "
    for n in (1, 2, 3):
        for i in range(len(s) - n + 1):
            if n > 1 or s[i] != " ":
                yield hashed([ord(c) for c in s[i : i + n]], 15)


def test_languages_against_plain_naive_bayes(spark):
    table = [(r["doc_id"], r["text"], r["lang"]) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    table += [(9001, None, "de"), (9002, "", "fr"), (9003, "12", None), (9004, table[0][1], None), (9004, table[0][1], "en")]
    sums, n_docs = {}, Counter()
    for i, text, lang in table:
        if lang is not None and crc(i) % 5:
            sums.setdefault(lang, Counter()).update(grams(text or ""))
            n_docs[lang] += 1
    for r, (i, text, _) in zip(language_id.identify(docs(spark, table).coalesce(1)).collect(), table):
        own = Counter(grams(text or ""))
        scores = {}
        for lang, known in sums.items():
            total = sum(known.values()) + 0.5 * 2**15
            scores[lang] = math.log(n_docs[lang] / sum(n_docs.values())) + sum(n * math.log((known[g] + 0.5) / total) for g, n in own.items())
        assert r["doc_id"] == i
        if not own:
            assert (r["lang_pred"], r["score"]) == ("und", 0)
            continue
        best = max(sorted(scores), key=scores.get)
        near = sorted(scores.values())[-2:]
        assert r["lang_pred"] == best or near[1] - near[0] < 1e-3
        assert r["score"] == pytest.approx(1 / sum(math.exp(s - scores[best]) for s in scores.values()), abs=2e-3)


def test_blocks_of_languages_add_up(spark):
    table = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    whole, parts = ({(r["doc_id"]): (r["lang_pred"], round(r["score"], 9)) for r in language_id.identify(table, block=n).collect()} for n in (100, 1))
    assert whole == parts


def plain_features(text):
    out = np.zeros(quality_knn.WIDTH)
    shape = [2 if c.isupper() else 1 if c.isalpha() else 4 if c == "\n" else 3 if c.isspace() else 5 if c.isdigit() else ord(c) + 16 for c in text]
    for s in shape:
        out[hashed([s], 10)] += 1
    for three in zip(shape, shape[1:], shape[2:]):
        out[1024 + hashed(three, 10)] += 1
    words = [sum(ord(c) * ((i + 1) * 0x9E3779B1 & 0xFFFFFFFF | 1) for i, c in enumerate(w)) % 2**32 for w in text.split()]
    for w in words:
        out[2048 + hashed([w], 10)] += 1
    if not words:
        return None
    again = sum(w in words[max(0, i - 4) : i] for i, w in enumerate(words))
    out[3072:] = [math.exp(-(((c - again / len(words)) / 0.08) ** 2)) for c in (0.0, 0.08, 0.16, 0.25, 0.4, 0.6, 0.8, 1.0)]
    return out


def test_quality_against_a_plain_vote(spark):
    """Features, cosines and votes in plain loops, over the model's latent space; ties at the kth vote too."""
    table, labels = (spark.read.parquet(f"/root/testdata/sf0.001/{t}.parquet") for t in ("documents", "labels"))
    copies = table.where("doc_id < 40").withColumn("doc_id", F.col("doc_id") + 5000)  # the same texts once more, so that there are ties
    both = table.unionByName(copies)
    known = labels.unionByName(labels.where("doc_id < 40").withColumn("doc_id", F.col("doc_id") + 5000))
    model = quality_knn.fit(both, known)
    fitted = [r for r in known.collect() if crc(r["doc_id"]) % 4 != 2 and r["quality"] is not None]
    assert len(model["labels"]) == len(fitted) and model["labels"].sum() == sum(r["quality"] for r in fitted)

    def latent(text):
        row = plain_features(text)
        if row is None:
            return None
        assert np.allclose(row, quality_knn.features(text), atol=1e-5)
        row = np.log1p(row) * model["rarity"]
        for part, share in ((slice(0, 2048), 1.0), (slice(2048, 3072), 0.25), (slice(3072, None), 0.8)):
            row[part] *= share / max(np.linalg.norm(row[part]), 1e-9)
        row = row @ model["latent"].astype(float)
        return row / np.linalg.norm(row)

    for r in quality_knn.scored(both, known).where("length(text) < 3000").limit(60).collect():
        own = latent(r["text"])
        if own is None:
            continue
        near = sorted(((float(own @ v), float(label)) for v, label in zip(model["vectors"].astype(float), model["labels"])), reverse=True)
        voting = [(max(s, 1e-6) ** 8, label) for s, label in near if s >= near[14][0] - 1e-6]
        assert r["_bitloom_score"] == pytest.approx(sum(w * label for w, label in voting) / sum(w for w, _ in voting), abs=0.02)
