"""Packing of documents into sequences of a fixed number of tokens by minimum bin slack.

A document is its tokens and one closing token; longer ones than a sequence are
cut, so that only the first piece is shorter than one. Each sequence takes the
largest piece that is left, and with it the fullest combination of lengths that
fits beside it, found by a subset-sum programme whose rows are bitsets: bit s
of row i says whether lengths from the ith on, each as often as it is there,
add up to s. Of equally full combinations it is the one with the larger pieces.
The combination is removed and the next sequence is planned.

All that a plan needs is how many pieces there are of each length: at most as
many numbers as a sequence has tokens, whatever the number of documents. As
removing pieces makes no other combination fuller, the next sequences come out
as the same combination for as long as its pieces last, so it is taken that many
times at once. Each such step leaves some length with fewer pieces than the
combination has of it, which bounds the steps by about twice the number of
lengths.

On Spark: one scan encodes the texts and numbers each task's pieces of each
length; written to the shared folder, so that the numbers stay. The counts by
task and length are added up to the place of each task in its length, and
pieces find their sequence by their number in their length: ranges of it, a few
thousand, belong to the steps of the plan. No texts or tokens are shuffled,
and no group is larger than what one task has of one length.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from bitloom.llm import token_counts
from bitloom.llm._scratch import Scratch, schema

LIMIT = 1024
#: The id that closes a document.
CLOSE = 2
#: Of the texts that are encoded by rank, the share that tokenizers encodes too.
CHECKED = 1 / 64


class Encoder:
    """Token ids of texts as the tokenizer of ``path`` gives them, without special tokens added.

    Texts above a chunk are spliced from overlapping chunks. Plain ones are
    encoded by tiktoken over the ranks in the same file (see ``token_counts``);
    every text whose CRC-32 falls in ``CHECKED`` is encoded by both, and a
    difference ends the job.
    """

    def __init__(self, path: str):
        self.tokenizer = token_counts.load(path)
        self.fast = token_counts.ranked(self.tokenizer)

    def __call__(self, text: str) -> np.ndarray:
        if len(text) > token_counts.CHUNK:
            return np.concatenate([np.array(e.ids[a:b], "<u4") for e, a, b, _ in token_counts.spliced(self.tokenizer, text)])
        if self.fast is None or not token_counts._PLAIN.fullmatch(text):
            return self._whole(text)
        ids = np.asarray(self.fast.encode_to_numpy(text, allowed_special="all")).astype("<u4")
        if zlib.crc32(text.encode()) < CHECKED * 2**32 and not np.array_equal(ids, self._whole(text)):
            raise ValueError(f"the ranks and the library give different tokens for a text of {len(text)} characters")
        return ids

    def _whole(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4")


def cut(tokens: int, limit: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of a document; all but the first have ``limit`` tokens."""
    first = (tokens - 1) % limit + 1
    return [(0, first), *((at, limit) for at in range(first, tokens, limit))]


def _encode(path: str, limit: int, close: int, keep_ids: bool):
    """Rows of all pieces, numbered by length inside the task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, seen = Encoder(path), np.zeros(limit + 1, np.int64)
        for batch in batches:
            which, made = [], {k: [] for k in ("piece", "start", "length", "crc", "number", "ids")}
            for i, value in enumerate(batch.column(1)):
                ids = np.append(encoder(value.as_py() or ""), np.uint32(close)).astype("<u4")
                for piece, (start, length) in enumerate(cut(len(ids), limit)):
                    own = ids[start : start + length].tobytes()
                    which.append(i)
                    for k, v in zip(made, (piece, start, length, zlib.crc32(own), seen[length], own if keep_ids else None)):
                        made[k].append(v)
                    seen[length] += 1
            kinds = (pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(which, pa.int64())), *(pa.array(v, k) for v, k in zip(made.values(), kinds))], names=["doc_id", "piece", "start", "length", "ids_crc32", "sp_number", "ids"])

    return run


def _reach(lengths: list[int], counts: list[int], room: int) -> list[int]:
    """Row i: bitset of the sums up to ``room`` of lengths from the ith on, each at most as often as it is there; the last row is the empty sum's."""
    rows, mask = [1] * (len(lengths) + 1), (1 << room + 1) - 1
    for i in range(len(lengths) - 1, -1, -1):
        sums, left, step = rows[i + 1], min(counts[i], room // lengths[i]), 1
        while left > 0:  # as many copies in powers of two, the last one the rest
            take = min(step, left)
            sums |= (sums << take * lengths[i]) & mask
            left -= take
            step *= 2
        rows[i] = sums
    return rows


def fullest(lengths: list[int], counts: list[int], room: int) -> list[tuple[int, int]]:
    """(length, copies) of the fullest combination of pieces within ``room``, the larger lengths first where several are as full. ``lengths`` fall."""
    rows = _reach(lengths, counts, room)
    total, out = rows[0].bit_length() - 1, []
    for i, length in enumerate(lengths):
        copies = min(counts[i], total // length)
        while not rows[i + 1] >> total - copies * length & 1:
            copies -= 1
        if copies:
            out.append((length, copies))
            total -= copies * length
    return out


def plan(counts: dict[int, int], limit: int = LIMIT) -> list[tuple[list[tuple[int, int]], int]]:
    """(combination, times) of sequences for so many pieces of each length, until none is left."""
    left, out = {k: n for k, n in counts.items() if n}, []
    while left:
        largest = max(left)
        rest = left | {largest: left[largest] - 1}
        lengths = sorted((k for k, n in rest.items() if n and k <= limit - largest), reverse=True)
        combination = dict(fullest(lengths, [rest[k] for k in lengths], limit - largest))
        combination[largest] = combination.get(largest, 0) + 1
        times = min(left[k] // n for k, n in combination.items())
        out.append((sorted(combination.items(), reverse=True), times))
        left = {k: n - times * combination.get(k, 0) for k, n in left.items()}
        left = {k: n for k, n in left.items() if n}
    return out


def ranges(steps: list[tuple[list[tuple[int, int]], int]]) -> dict[int, np.ndarray]:
    """For each length: rows (first number in the length, copies in a sequence, first sequence, offset of the first copy), by first number."""
    used: dict[int, int] = {}
    out: dict[int, list[tuple[int, int, int, int]]] = {}
    sequence = 0
    for combination, times in steps:
        offset = 0
        for length, copies in combination:
            first = used.get(length, 0)
            out.setdefault(length, []).append((first, copies, sequence, offset))
            used[length] = first + times * copies
            offset += length * copies
        sequence += times
    return {k: np.array(v, np.int64) for k, v in out.items()}


def _place(shared):
    """sequence_id and offset of numbered pieces, in place of the number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_length = shared.value
        for batch in batches:
            length, number = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("length", "sp_number"))
            sequence, offset = np.empty_like(number), np.empty_like(number)
            for own in np.unique(length):
                at = np.flatnonzero(length == own)
                table = by_length[int(own)]
                first, copies, base, start = table[np.searchsorted(table[:, 0], number[at], side="right") - 1].T
                beyond = number[at] - first
                sequence[at], offset[at] = base + beyond // copies, start + beyond % copies * own
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], *batch.columns[6:], pa.array(sequence), pa.array(offset)], names=[*(n for n in batch.schema.names if n != "sp_number"), "sequence_id", "offset"])

    return run


def pack(docs: DataFrame, path: str | None = None, limit: int = LIMIT, close: int = CLOSE, keep_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, ids, sequence_id and offset of every piece of every row of ``docs``.

    ``ids`` are the piece's tokens as little-endian unsigned 32-bit numbers if
    ``keep_ids``, else null; ``sequences`` makes sequences of them.
    Sequences are numbered from 0 without gaps, and filled from offset 0 without
    gaps; which of equally long pieces stands where is free.

    * Null texts are empty: one piece of the closing token alone.
    * Repeated rows and null ids are documents of their own. Other columns are not looked at.
    * A document of exactly ``limit`` tokens with the closing one is one piece.
    * An empty table gives no rows.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "sequence-packing")
    kind = schema([docs.schema["doc_id"]], "piece int, start bigint, length bigint, ids_crc32 bigint, sp_number bigint, ids binary")
    pieces = docs.select("doc_id", F.col("text").cast("string")).mapInArrow(_encode(path or token_counts.tokenizer_path(), limit, close, keep_ids), kind)
    pieces = scratch.keep(pieces.withColumn("sp_task", F.spark_partition_id()), "pieces")
    counts = scratch.keep(pieces.groupBy("sp_task", "length").agg(F.count("*").alias("sp_count")), "counts")
    total = {r[0]: r[1] for r in counts.groupBy("length").agg(F.sum("sp_count")).collect()}  # at most ``limit`` rows
    before = W.partitionBy("length").orderBy("sp_task").rowsBetween(W.unboundedPreceding, -1)  # a row for each task
    firsts = counts.select("sp_task", "length", F.coalesce(F.sum("sp_count").over(before), F.lit(0)).alias("sp_first"))
    numbered = pieces.join(firsts, ["sp_task", "length"]).select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("sp_first") + F.col("sp_number")).alias("sp_number"), "ids")
    shared = spark.sparkContext.broadcast(ranges(plan(total, limit)))
    return numbered.mapInArrow(_place(shared), schema([docs.schema["doc_id"]], "piece int, start bigint, length bigint, ids_crc32 bigint, ids binary, sequence_id bigint, offset bigint"))


def sequences(packed: DataFrame) -> DataFrame:
    """sequence_id, n_tokens, ids (bytes) and pieces (offset, length, doc_id, piece) of each sequence of a packing that kept its ids."""
    inside = F.sort_array(F.collect_list(F.struct("offset", "length", "doc_id", "piece", "ids")))  # at most ``limit`` tokens
    rows = packed.groupBy("sequence_id").agg(inside.alias("all"))
    whole = F.aggregate("all", F.lit(b"").cast("binary"), lambda s, p: F.concat(s, p["ids"]))
    return rows.select("sequence_id", F.aggregate("all", F.lit(0).cast("long"), lambda s, p: s + p["length"]).alias("n_tokens"), whole.alias("ids"), F.transform("all", lambda p: p.dropFields("ids")).alias("pieces"))


def digests(packed: DataFrame) -> DataFrame:
    """The contract's columns from the result of ``pack``."""
    return packed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
