import random

import pytest

from bitloom.llm import token_counts as t

from .helpers import SF, clashing, docs, rows


@pytest.fixture(scope="module")
def tokenizer():
    return t.load(t.tokenizer_path())


def whole(tokenizer, text):
    return len(tokenizer.encode(text, add_special_tokens=False))


@pytest.mark.parametrize("chunk,overlap", [(200, 80), (300, 100), (1000, 128)])
def test_chunks_count_as_the_whole_does(tokenizer, chunk, overlap):
    random.seed(chunk)
    parts = ["word", " ", "  ", "\n\n", "   \n", "don't", "x'll", "<|endoftext|>", "12345", "éàü", "日本語", "!!!", "$%", "<|endo", "text|>", " ", "🙂", "a" * 90]
    for _ in range(60):
        text = "".join(random.choice(parts) for _ in range(random.randrange(50, 900)))
        assert t.count_long(tokenizer, text, chunk, overlap)[0] == whole(tokenizer, text)


@pytest.mark.parametrize("text", ["a" * 5000, " " * 5000, "x" + "\n" * 3000 + "y", "ab " * 2000, "<|endoftext|>" * 400, "é" * 3000 + " z" * 1000])
def test_overlaps_widen_where_nothing_aligns(tokenizer, text):
    count, widened = t.count_long(tokenizer, text, 300, 70)
    assert count == whole(tokenizer, text)
    if text in ("a" * 5000, " " * 5000):
        assert widened


def test_ranks_count_as_the_library_does(tokenizer):
    random.seed(5)
    fast = t.ranked(tokenizer)
    parts = ["word", " ", " ", "  ", "\n", " \n", "\t", "\r\n", "don't", "'ll", "'S", "<|endoftext|>", "12", "é", "ß", "ñÑ", "ŒŸ", "!!", "$", "<|endo", "text|>"]
    for _ in range(4000):
        text = "".join(random.choice(parts) if random.random() < 0.7 else chr(random.choice([random.randrange(32, 127), random.randrange(0xF8, 0x180)])) for _ in range(random.randrange(0, 60)))
        assert t._PLAIN.fullmatch(text) and fast.encode(text, allowed_special="all") == tokenizer.encode(text, add_special_tokens=False).ids
    assert t.ranked(t.load(t.tokenizer_path("word_bpe_49k.json"))) is None


def test_a_difference_between_the_libraries_ends_the_job(tokenizer):
    import tiktoken

    bytes_only = tiktoken.Encoding("bytes", pat_str=r"[\s\S]", mergeable_ranks={bytes([b]): b for b in range(256)}, special_tokens={})
    assert t._agreed(tokenizer, t.ranked(tokenizer), "some words") == whole(tokenizer, "some words")
    with pytest.raises(ValueError, match="the ranks give 10 tokens"):
        t._agreed(tokenizer, bytes_only, "some words")


def test_table_counts(spark, tokenizer):
    odd = [(1, None), (2, ""), (3, "hi there <|endoftext|> you"), (3, "hi there <|endoftext|> you"), (None, "é"), (5, "word " * 30_000), (6, "z" * 70_000)]
    table = docs(spark, odd).unionByName(spark.read.parquet(f"{SF}/documents.parquet"))
    got = rows(t.over_limit(t.count_tokens(clashing(table))).drop("widenings"))
    want = [(r["doc_id"], len((r["text"] or "").encode()), whole(tokenizer, r["text"] or "")) for r in table.collect()]
    assert got == sorted(((d, b, n, n > 1024) for d, b, n in want), key=repr)
    assert rows(t.count_tokens(table.limit(0))) == []
