"""Transforms of whole Arrow batches of blocks in numpy.

The expressions in ``blocks`` say the same one block at a time; higher-order
functions are interpreted, so for transforms of every block of a picture these
are the faster path. A batch is one reshape of its flat values.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from bitloom.operators import blocks


def _batched(size: int, kernel: Callable[[np.ndarray], np.ndarray]) -> Callable[[Column], Column]:
    """An Arrow function of array<int> columns whose rows hold size * size numbers; null blocks stay null."""

    @F.arrow_udf("array<int>")
    def run(rows: pa.Array) -> pa.Array:
        there = rows.is_valid().to_numpy(zero_copy_only=False)
        values = rows.drop_null().flatten().to_numpy(zero_copy_only=False).astype(np.int32).reshape(-1, size, size)
        offsets = np.r_[0, np.cumsum(there)] * size * size
        out = kernel(values).astype(np.int32).ravel()
        return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(out), mask=pa.array(~there) if not there.all() else None)

    return run


def _line_4(x: np.ndarray) -> np.ndarray:
    """Along the last axis."""
    a, b = x[..., 0] + x[..., 2], x[..., 0] - x[..., 2]
    c, d = (x[..., 1] >> 1) - x[..., 3], x[..., 1] + (x[..., 3] >> 1)
    return np.stack([a + d, b + c, b - c, a - d], axis=-1)


def _line_8(x: np.ndarray) -> np.ndarray:
    even = _line_4(x[..., 0::2])
    x1, x3, x5, x7 = (x[..., i] for i in (1, 3, 5, 7))
    p, q = x5 - x3 - x7 - (x7 >> 1), x1 + x7 - x3 - (x3 >> 1)
    t, s = x7 - x1 + x5 + (x5 >> 1), x3 + x5 + x1 + (x1 >> 1)
    odd = np.stack([s - (p >> 2), (q >> 2) - t, q + (t >> 2), p + (s >> 2)], axis=-1)
    return np.concatenate([even + odd, (even - odd)[..., ::-1]], axis=-1)


def sample_bytes(values: Column) -> Column:
    """array of 0..255 as bytes; null for null."""

    @F.arrow_udf("binary")
    def run(rows: pa.Array) -> pa.Array:
        rows = pa.concat_arrays([rows])
        there = rows.is_valid().to_numpy(zero_copy_only=False)
        lengths = np.where(there, np.diff(rows.offsets.to_numpy()), 0)
        data = rows.drop_null().flatten().to_numpy(zero_copy_only=False).astype(np.uint8).tobytes()
        ends = np.cumsum(lengths)
        return pa.array([data[e - n : e] if ok else None for ok, n, e in zip(there, lengths, ends)], pa.binary())

    return run(values)


def byte_sums(data: Column) -> Column:
    """struct<least, most, total> of a column of bytes; null for null, least and most null where it is empty."""

    @F.arrow_udf("struct<least:bigint,most:bigint,total:bigint>")
    def run(rows: pa.Array) -> pa.Array:
        out = []
        for row in rows:
            v = None if not row.is_valid else np.frombuffer(row.as_buffer(), dtype=np.uint8)
            out.append(None if v is None else {"least": int(v.min()) if len(v) else None, "most": int(v.max()) if len(v) else None, "total": int(v.sum(dtype=np.int64))})
        return pa.array(out, pa.struct([(n, pa.int64()) for n in ("least", "most", "total")]))

    return run(data)


def weighted_sums(values: Column) -> Column:
    """struct<checksum, least, most> of an array<int> column: sums of values times their place from 1, modulo 97, plus 1; null for null, least and most null where it is empty."""

    @F.arrow_udf("struct<checksum:bigint,least:bigint,most:bigint>")
    def run(rows: pa.Array) -> pa.Array:
        there = rows.is_valid().to_numpy(zero_copy_only=False)
        sizes = np.asarray(rows.value_lengths().fill_null(0)).astype(np.int64)
        flat = rows.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
        some = np.flatnonzero(sizes)
        starts = (np.cumsum(sizes) - sizes)[some]
        place = np.arange(len(flat)) - np.repeat(starts, sizes[some])
        made = {"checksum": (np.add, flat * ((place + 1) % 97 + 1), ~there), "least": (np.minimum, flat, sizes == 0), "most": (np.maximum, flat, sizes == 0)}
        columns = []
        for reduce, v, missing in made.values():
            out = np.zeros(len(rows), np.int64)
            if len(some):
                out[some] = reduce.reduceat(v, starts)
            columns.append(pa.array(out, mask=missing))
        return pa.StructArray.from_arrays(columns, list(made), mask=pa.array(~there))

    return run(values)


def scaling_list(deltas: Column, default: list[int]) -> Column:
    """``blocks.scaling_list`` over whole Arrow batches: array<int> of as many values as ``default`` from an array of coded deltas."""
    size = len(default)

    @F.arrow_udf("array<int>")
    def run(rows: pa.Array) -> pa.Array:
        sizes = np.asarray(rows.value_lengths().fill_null(0)).astype(np.int64)
        flat = rows.flatten().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        row = np.repeat(np.arange(len(rows)), sizes)
        place = np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        steps, out = np.zeros((len(rows), size), np.int64), np.zeros((len(rows), size), np.int64)
        steps[row[place < size], place[place < size]] = flat[place < size]
        last, reads = np.full(len(rows), 8), np.ones(len(rows), bool)
        for i in range(size):
            value = np.where(reads, (last + steps[:, i]) % 256, 0)
            reads = value != 0
            last = out[:, i] = np.where(reads, value, last)
        out[(8 + steps[:, 0]) % 256 == 0] = default
        return pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1) * size, pa.int32()), pa.array(out.ravel().astype(np.int32)))

    return run(deltas)


_SIGNS = np.array([[1, 1, 1, 1], [1, 1, -1, -1], [1, -1, -1, 1], [1, -1, 1, -1]], dtype=np.int32)


def _both_ways(line: Callable[[np.ndarray], np.ndarray], values: np.ndarray) -> np.ndarray:
    return np.swapaxes(line(np.swapaxes(line(values), 1, 2)), 1, 2)


def inverse_4x4(block: Column) -> Column:
    return _batched(4, lambda v: (_both_ways(_line_4, v) + 32) >> 6)(block)


def inverse_8x8(block: Column) -> Column:
    return _batched(8, lambda v: (_both_ways(_line_8, v) + 32) >> 6)(block)


def hadamard_4x4(block: Column) -> Column:
    return _batched(4, lambda v: _SIGNS @ v @ _SIGNS)(block)


def dequant(block: Column, qp: Column, weights: list[int], size: int) -> Column:
    """Levels scaled as ``blocks.dequant_4x4`` and ``dequant_8x8`` do it, for one scaling matrix, row by row."""
    norms, place = (blocks.NORM_4X4, blocks.class_4x4) if size == 4 else (blocks.NORM_8X8, blocks.class_8x8)
    scales = np.array([[w * row[place(i)] for i, w in enumerate(weights)] for row in norms], dtype=np.int64)
    shift = 4 if size == 4 else 6

    @F.arrow_udf("array<bigint>")
    def run(rows: pa.Array, qps: pa.Array) -> pa.Array:
        there = rows.is_valid().to_numpy(zero_copy_only=False)
        values = rows.drop_null().flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, size * size)
        q = qps.to_numpy(zero_copy_only=False)[there].astype(np.int64)
        up, down = np.maximum(q // 6 - shift, 0)[:, None], np.maximum(shift - q // 6, 0)[:, None]
        half = np.where(down > 0, 1 << np.maximum(down - 1, 0), 0)
        out = (((values * scales[q % 6]) << up) + half) >> down
        offsets = np.r_[0, np.cumsum(there)] * size * size
        return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(out.ravel()), mask=pa.array(~there) if not there.all() else None)

    return run(block, qp)
