"""Benchmark decontamination by a prefix-filtered join with exact verification.

A-Z are lower-cased and words are runs of a-z, 0-9 and anything beyond ASCII.
A window is ``WINDOW`` words in a row of a benchmark item; an item of fewer
words, but not none, is one window. A document word inside any occurrence of a
window is hit.

Join
    A document holds a window only if it holds all its shingles, so of a
    window's shingles, ordered by how rare they are in the corpus, the first is
    a sufficient prefix. Shingles are single words here: the rarest word of
    each window is its prefix token, with its position in the window. A
    document word that is a prefix token proposes a place for a window for
    each position that it has in one (13 at most, however many windows share
    the token). A place is passed over if it would begin before the first word
    or end after the last (the length and position bounds); at all others the
    words are looked up by hash and verified one by one.

Scale
    Rarity is counted in one scan of all documents, for the ``BUCKETS`` hash
    buckets that hold words of the benchmark, added up before the shuffle; a
    shared bucket makes a word look more frequent, never a window be missed.
    Documents are not shuffled. Windows are offsets into an array of word
    numbers, some 20 bytes a word of the benchmark (70 while they are made on
    the driver), and are broadcast in blocks of at most ``BLOCK_BYTES`` of item text. With a larger benchmark the
    documents pass through one block after the other, written to the shared
    folder in between, and carry the words hit so far.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterable, Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from bitloom.llm._scratch import Scratch, schema

WINDOW = 13
#: Item text that one broadcast holds at most.
BLOCK_BYTES = 16 * 1024 * 1024
#: Hash buckets in which words are counted.
BUCKETS = 1 << 22
#: contaminated: at least one word in so many is hit.
ONE_IN = 20

_WORDS = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def words_of(text: str | None) -> list[bytes]:
    """The words of a text, as UTF-8; all separators are ASCII, so splitting bytes splits the text."""
    return text.encode("utf-8", "surrogatepass").translate(_WORDS).split() if text else []


def _buckets(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(crc32, words), dtype=np.uint32, count=len(words)) % np.uint32(BUCKETS)


def _item_buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        own = [_buckets(words_of(text.as_py())) for text in batch.column(0)]
        yield pa.RecordBatch.from_arrays([pa.array(np.unique(np.concatenate(own)), pa.int64())], names=["bucket"])


def _bucket_counts(buckets):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = np.zeros(BUCKETS, dtype=bool)
        known[buckets.value] = True
        counts = np.zeros(BUCKETS, dtype=np.int64)
        for batch in batches:
            for text in batch.column(0):
                at = _buckets(words_of(text.as_py()))
                np.add.at(counts, at[known[at]], 1)
        at = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(counts[at])], names=["bucket", "n"])

    return run


def _places(n: int) -> type:
    """The narrowest type with a bit for each position of a window of ``n`` words."""
    for kind in (np.uint16, np.uint32, np.uint64):
        if n <= np.iinfo(kind).bits:
            return kind
    raise ValueError("windows have at most 64 words")


class _Index:
    """The windows of a block of items.

    ``words`` numbers the block's words and ``text`` holds the items one after
    the other as such numbers. For each length of a window: which positions a
    word has in windows whose rarest it is, as bits, and the windows' hashes,
    sorted, each distinct window once, with its offset in ``text`` and the range of
    its items.
    """

    def __init__(self, items: Iterable[tuple[str, str]], counts: np.ndarray, window: int):
        self.words: dict[bytes, int] = {}
        self.names: list[str] = []
        text, starts, lengths = array("i"), [], []
        for item, said in items:
            own = words_of(said)
            if own:
                starts.append(len(text))
                lengths.append(len(own))
                self.names.append(item)
                text.extend(self.words.setdefault(w, len(self.words)) for w in own)
        self.text = np.frombuffer(text, dtype=np.int32) if text else np.empty(0, dtype=np.int32)
        rarity = np.fromiter((counts[crc32(w) % BUCKETS] for w in self.words), dtype=np.int64, count=len(self.words))
        # Ties between words of one count go to the lower number.
        rank = np.empty(len(rarity), dtype=np.int64)
        rank[np.argsort(rarity, kind="stable")] = np.arange(len(rarity))
        starts, lengths = np.array(starts, dtype=np.int64), np.array(lengths, dtype=np.int64)
        self.groups = []
        for n in np.unique(np.minimum(lengths, window)).tolist():
            own = np.flatnonzero((lengths >= window) if n == window else (lengths == n))
            each = lengths[own] - n + 1
            item = np.repeat(own, each)
            at = np.repeat(starts[own] - np.r_[0, np.cumsum(each)[:-1]], each) + np.arange(each.sum())
            hashes, bits = np.empty(len(at), dtype=np.uint64), np.zeros(len(rarity), dtype=_places(n))
            there = np.empty(len(at), dtype=bool)
            for cut in range(0, len(at), 1 << 16):
                words = self.text[at[cut : cut + (1 << 16), None] + np.arange(n)]
                hashes[cut : cut + len(words)] = _hash(words)
                rarest = rank[words].argmin(axis=1)
                token = words[np.arange(len(words)), rarest]
                there[cut : cut + len(words)] = rarity[token] > 0  # else no document has the window
                np.bitwise_or.at(bits, token, np.left_shift(1, rarest, dtype=bits.dtype, casting="unsafe"))
            order = np.flatnonzero(there)
            order = order[np.argsort(hashes[order], kind="stable")]
            # Equal windows stand next to each other: each is kept once, with the range of its owners.
            hashes, at, first = hashes[order], at[order], np.ones(len(order), dtype=bool)
            first[1:] = hashes[1:] != hashes[:-1]
            same = np.flatnonzero(~first)
            for cut in range(0, len(same), 1 << 16):
                k = same[cut : cut + (1 << 16)]
                first[k] = (self.text[at[k, None] + np.arange(n)] != self.text[at[k - 1, None] + np.arange(n)]).any(axis=1)
            owned = np.append(np.flatnonzero(first), len(order)).astype(np.int32)
            self.groups.append((n, bits, hashes[first], at[first].astype(np.int32), owned, item[order].astype(np.int32)))

    def hits(self, words: list[bytes]) -> tuple[np.ndarray, set[str]]:
        """Whether each word is hit, and the items with occurring windows."""
        hit, items = np.zeros(len(words), dtype=bool), set()
        known = self.words.get
        own = np.fromiter((known(w, -1) for w in words), dtype=np.int32, count=len(words))
        some = np.flatnonzero(own >= 0)
        for n, bits, hashes, offsets, owned, owners in self.groups:
            tokens = bits[own[some]]
            at = some[tokens > 0]
            if not len(at):
                continue
            row, position = np.nonzero((bits[own[at]][:, None] >> np.arange(n, dtype=bits.dtype)) & bits.dtype.type(1))
            start = at[row] - position
            start = np.unique(start[(start >= 0) & (start + n <= len(words))])
            seen = []
            for cut in range(0, len(start), 1 << 16):
                begin = start[cut : cut + (1 << 16)]
                said = own[begin[:, None] + np.arange(n)]
                key = _hash(said)
                low, high = np.searchsorted(hashes, key, "left"), np.searchsorted(hashes, key, "right")
                row = np.repeat(np.arange(len(begin)), high - low)
                if not len(row):
                    continue
                entry = np.arange(len(row)) - np.repeat(np.cumsum(high - low) - high, high - low)
                same = (self.text[offsets[entry][:, None].astype(np.int64) + np.arange(n)] == said[row]).all(axis=1)
                seen.append(np.unique(entry[same]))
                for i in np.unique(begin[row[same]]).tolist():
                    hit[i : i + n] = True
            for window in np.unique(np.concatenate(seen)).tolist() if seen else ():
                items.update(owners[owned[window] : owned[window + 1]].tolist())
        return hit, {self.names[i] for i in items}


_POWERS = np.cumprod(np.full(64, 0x9E3779B97F4A7C15, dtype=np.uint64), dtype=np.uint64)


def _hash(words: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each row of word numbers."""
    return ((words.astype(np.uint64) + np.uint64(1)) * _POWERS[: words.shape[1]]).sum(axis=1, dtype=np.uint64)


_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


def _find(index, carried: bool):
    """[n_words, spans, items,] text and other columns -> the same with what this block of windows adds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = index.value
        for batch in batches:
            n_words, spans, items = [], [], []
            before = zip(batch.column(1), batch.column(2)) if carried else None
            for text in batch.column(3 if carried else 0):
                words = words_of(text.as_py())
                hit, own = known.hits(words)
                if carried:
                    old_spans, old_items = next(before)
                    for span in old_spans.as_py():
                        hit[span["start"] : span["end"]] = True
                    own.update(old_items.as_py())
                edges = np.flatnonzero(np.diff(np.r_[0, hit.view(np.int8), 0]))
                spans.append([{"start": int(a), "end": int(b)} for a, b in zip(edges[::2], edges[1::2])])
                n_words.append(len(words))
                items.append(sorted(own))
            rest = slice(3 if carried else 0, None)
            yield pa.RecordBatch.from_arrays(
                [pa.array(n_words, pa.int64()), pa.array(spans, _SPANS), pa.array(items, pa.list_(pa.string())), *batch.columns[rest]],
                names=["_bitloom_n", "_bitloom_spans", "_bitloom_items", *batch.schema.names[rest]],
            )

    return run


def _found(docs: DataFrame, benchmark: DataFrame, window: int, block_bytes: int) -> DataFrame:
    """``docs`` with _bitloom_n words, _bitloom_spans and _bitloom_items."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "windows")
    items = benchmark.select(F.col("item_id").cast("string").alias("item"), F.col("text").cast("string").alias("text")).where("text is not null").distinct()
    items = scratch.keep(items, "items")
    # Blocks of items by hash, half full on average; one block at a time goes through the driver.
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n_blocks = 1 + 2 * total // block_bytes if total > block_bytes else 1
    buckets = items.select("text").mapInArrow(_item_buckets, "bucket bigint").distinct().toArrow()["bucket"].to_numpy()
    buckets = spark.sparkContext.broadcast(buckets)
    counted = docs.select(F.col("text").cast("string")).mapInArrow(_bucket_counts(buckets), "bucket bigint, n bigint").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros(BUCKETS, dtype=np.int64)
    counts[counted["bucket"].to_numpy()] = counted["n"].to_numpy()
    items = items.withColumn("block", F.pmod(F.xxhash64("item", "text"), F.lit(n_blocks)).cast("int"))

    rows = docs.select(F.col("text").cast("string").alias("_bitloom_text"), *docs.columns)
    added = schema([], "_bitloom_n bigint, _bitloom_spans array<struct<start:bigint,end:bigint>>, _bitloom_items array<string>")
    kind = T.StructType([*added.fields, *rows.schema.fields])
    for block in range(n_blocks):
        own = ((r["item"] or "", r["text"]) for r in items.where(F.col("block") == block).select("item", "text").toLocalIterator())
        index = spark.sparkContext.broadcast(_Index(own, counts, window))
        rows = rows.mapInArrow(_find(index, carried=block > 0), kind)
        if block < n_blocks - 1:  # one block at a time in the workers' memory too
            rows = scratch.keep(rows, f"block-{block}")
            scratch.drop(f"block-{block - 1}")
    return rows.drop("_bitloom_text")


def find_windows(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, n_words, spans of hit words (start, end; end exclusive, apart) and item_ids (as strings, sorted) for every row of ``docs``.

    Null and empty texts, of documents or items, have no words and no windows.
    Items without an item_id, or with an empty one, cannot be named, but their
    windows hit words all the same; items that share an item_id count as one,
    and windows that several items share name them all. Rows come back one by
    one, repeated ones repeated, ids as they are; other columns are ignored.
    With no documents the result is empty, with no items no word is hit.
    """
    found = _found(docs.select("doc_id", "text"), benchmark, window, block_bytes)
    return found.select("doc_id", F.col("_bitloom_n").alias("n_words"), F.col("_bitloom_spans").alias("spans"), F.array_remove("_bitloom_items", "").alias("item_ids"))


def _n_hit(spans: str):
    return F.aggregate(spans, F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])


def digests(found: DataFrame, one_in: int = ONE_IN) -> DataFrame:
    """The contract's columns from the result of ``find_windows``."""
    ids = F.col("item_ids")
    found = found.select("doc_id", "n_words", _n_hit("spans").alias("n_hit"), F.size(ids).cast("long").alias("n_items"), F.sha2(F.array_join(ids, ","), 256).alias("items_sha256"))
    return found.withColumn("contaminated", (F.col("n_hit") > 0) & (one_in * F.col("n_hit") >= F.col("n_words")))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, one_in: int = ONE_IN) -> DataFrame:
    """The rows of ``docs`` that are not contaminated; each row is judged by its own text, where it is read."""
    found = _found(docs, benchmark, WINDOW, BLOCK_BYTES)
    n_hit = _n_hit("_bitloom_spans")
    return found.where((n_hit == 0) | (one_in * n_hit < F.col("_bitloom_n"))).select(*docs.columns)


def oracle_sql(window: int = WINDOW) -> str:
    """The contract's columns for ``documents`` and ``benchmark`` in DuckDB SQL."""
    pattern = "[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"
    lower = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return f"""
WITH d AS (SELECT doc_id, regexp_extract_all({lower.format("coalesce(text, '')")}, '{pattern}') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all({lower.format("coalesce(text, '')")}, '{pattern}') AS w FROM benchmark),
bw AS (
  SELECT DISTINCT item_id, len(w[i:i + least({window}, len(w)) - 1]) AS n, array_to_string(w[i:i + least({window}, len(w)) - 1], ' ') AS g
  FROM (SELECT item_id, w, unnest(range(1, len(w) - least({window}, len(w)) + 2)) AS i FROM b WHERE len(w) > 0)),
dg AS (
  SELECT doc_id, i, n, array_to_string(w[i:i + n - 1], ' ') AS g
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM bw) WHERE len(w) >= n)),
o AS (SELECT doc_id, i, n, item_id FROM dg JOIN bw USING (n, g)),
h AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM o) GROUP BY 1),
t AS (SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS ids FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS s FROM o) GROUP BY 1)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND {ONE_IN} * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN t USING (doc_id)"""
