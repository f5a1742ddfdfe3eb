"""Packings against whole-text tokens and brute force: every token once, no sequence too long, as few as can be."""

import itertools
import random
import zlib

import numpy as np
import pytest

from bitloom.llm import entries, sequence_packing, token_counts
from tests.llm.helpers import SF, clashing, docs


def tokens(text, limit=1024):
    """(start, crc32) and length of the pieces of a document, by the library alone."""
    ids = np.array([*token_counts.load(token_counts.tokenizer_path()).encode(text or "", add_special_tokens=False).ids, 2], "<u4")
    first = len(ids) - limit * ((len(ids) - 1) // limit)
    edges = [0, *range(first, len(ids) + 1, limit)]
    return [(a, b - a, zlib.crc32(ids[a:b].tobytes())) for a, b in zip(edges, edges[1:])]


def check(found, texts, limit=1024):
    """Whether the pieces are those of the texts, and each sequence is filled from 0 on without gaps up to its limit. Returns the number of sequences."""
    want = sorted((str(i), p, *t) for i, text in texts for p, t in enumerate(tokens(text, limit)))
    assert sorted((str(r["doc_id"]), r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in found) == want
    by_sequence = {}
    for r in found:
        by_sequence.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for own in by_sequence.values():
        end = 0
        for offset, length in sorted(own):
            assert offset == end
            end += length
        assert end <= limit
    assert sorted(by_sequence) == list(range(len(by_sequence)))
    return len(by_sequence)


def test_query_packs_all_tokens_near_the_bound(spark):
    found = [r.asDict() for r in entries.op13_sequence_packing(spark, SF).collect()]
    texts = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    used, total = check(found, texts), sum(r["length"] for r in found)
    assert used - -(-total // 1024) <= 2  # the least that any packing takes


def test_odd_rows(spark):
    texts = [(1, None), (2, ""), (3, "a"), (3, "a"), (None, "word " * 3000), (5, "<|endoftext|> é世 \U0001f600" * 40), (6, "x" * 60_000), (7, "one two three\n\n four  five " * 4000)]
    texts += [(100 + i, "go " * i) for i in range(60)]
    packed = sequence_packing.pack(clashing(docs(spark, texts)).repartition(7), limit=64)
    check([r.asDict() for r in packed.collect()], texts, 64)
    assert sequence_packing.pack(docs(spark, [])).collect() == []


def test_document_at_the_limit_is_one_piece():
    assert sequence_packing.cut(1024, 1024) == [(0, 1024)]
    assert sequence_packing.cut(1025, 1024) == [(0, 1), (1, 1024)]
    assert sequence_packing.cut(2048, 1024) == [(0, 1024), (1024, 1024)]
    assert sequence_packing.cut(1, 1024) == [(0, 1)]


def test_sequences_hold_the_ids(spark):
    texts = [(i, f"text number {i} " * (i + 1)) for i in range(30)]
    packed = sequence_packing.pack(docs(spark, texts), limit=128, keep_ids=True)
    tokenizer = token_counts.load(token_counts.tokenizer_path())
    whole = {i: [*tokenizer.encode(t, add_special_tokens=False).ids, 2] for i, t in texts}
    seen = {}
    for r in sequence_packing.sequences(packed).collect():
        ids = np.frombuffer(bytes(r.ids), "<u4").tolist()
        assert len(ids) == r.n_tokens <= 128
        for p in r.pieces:
            seen.setdefault(p.doc_id, {})[p.piece] = ids[p.offset : p.offset + p.length]
    assert {i: [x for _, own in sorted(v.items()) for x in own] for i, v in seen.items()} == whole


def test_fullest_combination_by_brute_force():
    rng = random.Random(2)
    for _ in range(200):
        lengths = sorted(rng.sample(range(1, 30), rng.randint(1, 5)), reverse=True)
        counts, room = [rng.randint(1, 4) for _ in lengths], rng.randint(0, 60)
        fitting = [c for c in itertools.product(*(range(n + 1) for n in counts)) if sum(a * b for a, b in zip(c, lengths)) <= room]
        best = max(fitting, key=lambda c: (sum(a * b for a, b in zip(c, lengths)), c))
        assert sequence_packing.fullest(lengths, counts, room) == [(n, c) for n, c in zip(lengths, best) if c]


def test_repeated_steps_equal_one_at_a_time():
    """Taking a combination as often as it lasts is what planning every sequence anew gives."""
    rng = random.Random(7)
    for _ in range(40):
        counts = {n: rng.randint(1, 30) for n in rng.sample(range(1, 101), rng.randint(1, 12))}
        steps, left, single = sequence_packing.plan(counts, 100), dict(counts), []
        while left:
            largest = max(left)
            left[largest] -= 1
            lengths = sorted((k for k, n in left.items() if n and k <= 100 - largest), reverse=True)
            chosen = dict(sequence_packing.fullest(lengths, [left[k] for k in lengths], 100 - largest))
            for k, n in chosen.items():
                left[k] -= n
            chosen[largest] = chosen.get(largest, 0) + 1
            single.append(sorted(chosen.items(), reverse=True))
            left = {k: n for k, n in left.items() if n}
        assert [c for c, times in steps for _ in range(times)] == single


def test_hot_length_and_huge_counts_take_few_steps():
    counts = {n: 10**9 + n for n in range(1, 1025)} | {700: 10**12}
    steps = sequence_packing.plan(counts)
    packed = {}
    for combination, times in steps:
        assert sum(n * c for n, c in combination) <= 1024
        for n, c in combination:
            packed[n] = packed.get(n, 0) + c * times
    assert packed == counts and len(steps) < 4000


def test_never_more_than_first_fit_decreasing():
    rng = random.Random(11)
    for _ in range(30):
        sizes = [rng.randint(1, 100) for _ in range(rng.randint(1, 80))]
        bins = []
        for s in sorted(sizes, reverse=True):
            at = next((i for i, b in enumerate(bins) if b + s <= 100), None)
            if at is None:
                bins.append(s)
            else:
                bins[at] += s
        assert sum(t for _, t in sequence_packing.plan({s: sizes.count(s) for s in set(sizes)}, 100)) <= len(bins)


def test_checked_texts_raise_on_a_difference(monkeypatch):
    encoder = sequence_packing.Encoder(token_counts.tokenizer_path())
    monkeypatch.setattr(sequence_packing, "CHECKED", 1)
    assert encoder("plain text").tolist() == encoder.tokenizer.encode("plain text", add_special_tokens=False).ids

    class Wrong:
        def encode_to_numpy(self, text, allowed_special):
            return [1, 2]

    encoder.fast = Wrong()
    with pytest.raises(ValueError):
        encoder("plain text")
