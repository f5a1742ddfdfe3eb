"""The residual of whole macroblocks, from levels to samples, as one numpy kernel over an Arrow batch.

Rows of one kind go through unscanning, scaling and transforms together. DC
levels that are coded apart (16x16 luma, chroma) are transformed and scaled
first, and then stand in their blocks' first places.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

from bitloom.operators import batches, blocks

LUMA, CHROMA = 256, 64
#: Levels of a macroblock by kind: 16 blocks of 16, 4 blocks of 64, or 16 of the DC and 16 blocks of 15.
KINDS = ("4x4", "8x8", "16x16")

_ORDER = {4: np.array(blocks.zigzag(4)), 8: np.array(blocks.zigzag(8))}
_NORMS = {n: np.array([[row[place(i)] for i in range(n * n)] for row in table], np.int64) for n, table, place in ((4, blocks.NORM_4X4, blocks.class_4x4), (8, blocks.NORM_8X8, blocks.class_8x8))}
#: Row and column, in blocks, of the 16 luma blocks in coded order.
_ROW = np.array([b >> 3 << 1 | b >> 1 & 1 for b in range(16)])
_COLUMN = np.array([(b >> 2 & 1) << 1 | b & 1 for b in range(16)])


def _unscanned(levels: np.ndarray, n: int, first: int = 0) -> np.ndarray:
    """Levels in scan order along the last axis, from place ``first`` on, as raster blocks."""
    out = np.zeros((*levels.shape[:-1], n * n), np.int64)
    out[..., _ORDER[n][first:]] = levels
    return out


def _shifted(values: np.ndarray, by: np.ndarray) -> np.ndarray:
    """Values times two to the power of ``by``, rounded where that is negative."""
    by = by.reshape(-1, *[1] * (values.ndim - 1))
    down = np.maximum(-by, 0)
    return ((values << np.maximum(by, 0)) + np.where(down > 0, 1 << np.maximum(down - 1, 0), 0)) >> down


def _scaled(values: np.ndarray, qp: np.ndarray, weights: np.ndarray, n: int) -> np.ndarray:
    scales = weights * _NORMS[n][qp % 6]
    return _shifted(values * scales[:, None, :], qp // 6 - (4 if n == 4 else 6))


def _transformed(values: np.ndarray, n: int) -> np.ndarray:
    """Inverse transform of raster blocks (rows, blocks, n * n) as (rows, blocks, n, n)."""
    line = batches._line_4 if n == 4 else batches._line_8
    return ((batches._both_ways(line, values.reshape(-1, n, n)) + 32) >> 6).reshape(*values.shape[:2], n, n)


def _placed(made: np.ndarray, rows: np.ndarray, columns: np.ndarray) -> np.ndarray:
    """Blocks (rows, blocks, n, n) at their places in a raster macroblock."""
    n, side = made.shape[2], made.shape[2] * (int(rows.max()) + 1)
    out = np.zeros((len(made), side, side), np.int64)
    for b, (r, c) in enumerate(zip(rows, columns)):
        out[:, r * n : r * n + n, c * n : c * n + n] = made[:, b]
    return out.reshape(len(made), -1)


def luma(levels: np.ndarray, kind: str, qp: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Raster residual (rows, 256) of macroblocks of one kind; ``weights`` is the raster scaling matrix of each, of 64 numbers for 8x8."""
    if kind == "8x8":
        made = _transformed(_scaled(_unscanned(levels.reshape(-1, 4, 64), 8), qp, weights, 8), 8)
        return _placed(made, np.array([0, 0, 1, 1]), np.array([0, 1, 0, 1]))
    if kind == "4x4":
        values = _scaled(_unscanned(levels.reshape(-1, 16, 16), 4), qp, weights, 4)
    else:
        dc = batches._SIGNS @ _unscanned(levels[:, :16], 4).reshape(-1, 4, 4) @ batches._SIGNS
        dc = _shifted(dc * (weights[:, 0] * _NORMS[4][qp % 6, 0])[:, None, None], qp // 6 - 6)
        values = _scaled(_unscanned(levels[:, 16:].reshape(-1, 16, 15), 4, 1), qp, weights, 4)
        values[:, :, 0] = dc[:, _ROW, _COLUMN]
    return _placed(_transformed(values, 4), _ROW, _COLUMN)


def chroma(levels: np.ndarray, qp: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Raster residual (rows, 64) of one chroma plane of macroblocks: 4 levels of the DC and 4 blocks of 15."""
    signs = np.array([[1, 1], [1, -1]])
    dc = signs @ levels[:, :4].reshape(-1, 2, 2) @ signs
    dc = (dc * (weights[:, 0] * _NORMS[4][qp % 6, 0] << qp // 6)[:, None, None]) >> 5
    values = _scaled(_unscanned(levels[:, 4:].reshape(-1, 4, 15), 4, 1), qp, weights, 4)
    values[:, :, 0] = dc.reshape(-1, 4)
    return _placed(_transformed(values, 4), np.array([0, 0, 1, 1]), np.array([0, 1, 0, 1]))


def _matrix(values: pa.Array, there: np.ndarray, columns: int) -> np.ndarray:
    return values.filter(pa.array(there)).flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, columns)


def _lists(found: list[tuple[np.ndarray, np.ndarray]], rows: int, size: int) -> pa.Array:
    """A list for each row number that was found, null for the others."""
    there, out = np.zeros(rows, bool), np.zeros((rows, size), np.int32)
    for at, values in found:
        there[at], out[at] = True, values
    offsets = pa.array(np.r_[0, np.cumsum(there)] * size, pa.int32())
    return pa.ListArray.from_arrays(offsets, pa.array(out[there].ravel()), mask=pa.array(~there))


def macroblock_residual(kind: Column, levels: Column, qp: Column, weights_4x4: Column, weights_8x8: Column) -> Column:
    """array<int> of 256 in raster order: the luma residual of a macroblock from its 256 levels in coded order.

    Null for a kind that is none of ``KINDS``, for null levels, quantiser or matrix, and for levels that are not 256.
    """

    @F.arrow_udf("array<int>")
    def run(kinds: pa.Array, rows: pa.Array, qps: pa.Array, small: pa.Array, large: pa.Array) -> pa.Array:
        names = np.array(kinds.to_pylist(), object)
        usable = _usable(rows, qps, LUMA)
        found = []
        for name in KINDS:
            matrix, size = (large, 64) if name == "8x8" else (small, 16)
            at = usable & (names == name) & matrix.is_valid().to_numpy(zero_copy_only=False)
            if at.any():
                found.append((np.flatnonzero(at), luma(_matrix(rows, at, LUMA), name, qps.filter(pa.array(at)).to_numpy(zero_copy_only=False).astype(np.int64), _matrix(matrix, at, size))))
        return _lists(found, len(rows), LUMA)

    return run(kind, levels, qp.cast("int"), weights_4x4, weights_8x8)


def block_texts(plane: Column, n: Column, side: int) -> Column:
    """array<string>: the blocks of ``n`` by ``n``, 4 or 8, of a raster plane of ``side`` by ``side`` in coded order, their numbers joined by commas; null for null and for other sizes."""

    @F.arrow_udf("array<string>")
    def run(planes: pa.Array, sizes: pa.Array) -> pa.Array:
        lengths = planes.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
        numbers = sizes.fill_null(0).to_numpy(zero_copy_only=False)
        order, parts, done = np.full(len(planes), -1), [pa.array([], pa.list_(pa.string()))], 0
        for size in (4, 8):
            at = np.flatnonzero((lengths == side * side) & (numbers == size))
            if len(at):
                count, inner = (side // size) ** 2, np.arange(size * size)
                places = ((_ROW[:count] * size)[:, None] + inner // size) * side + (_COLUMN[:count] * size)[:, None] + inner % size
                values = planes.take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).reshape(-1, side * side)[:, places.ravel()]
                cells = pa.ListArray.from_arrays(pa.array(np.arange(len(at) * count + 1) * size * size, pa.int32()), pa.array(values.ravel()).cast(pa.string()))
                parts.append(pa.ListArray.from_arrays(pa.array(np.arange(len(at) + 1) * count, pa.int32()), pc.binary_join(cells, ",")))
                order[at] = np.arange(done, done + len(at))
                done += len(at)
        return pa.concat_arrays(parts).take(pa.array(order, mask=order < 0))

    return run(plane, n.cast("int"))


def _usable(rows: pa.Array, qps: pa.Array, size: int) -> np.ndarray:
    lengths = rows.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    return (lengths == size) & qps.is_valid().to_numpy(zero_copy_only=False)


def chroma_residual(levels: Column, qp: Column, weights: Column) -> Column:
    """array<int> of 64 in raster order: the residual of a chroma plane from its 64 levels; ``qp`` is the plane's own. Null as in ``macroblock_residual``."""

    @F.arrow_udf("array<int>")
    def run(rows: pa.Array, qps: pa.Array, matrix: pa.Array) -> pa.Array:
        at = _usable(rows, qps, CHROMA) & matrix.is_valid().to_numpy(zero_copy_only=False)
        found = [(np.flatnonzero(at), chroma(_matrix(rows, at, CHROMA), qps.filter(pa.array(at)).to_numpy(zero_copy_only=False).astype(np.int64), _matrix(matrix, at, 16)))] if at.any() else []
        return _lists(found, len(rows), CHROMA)

    return run(levels, qp.cast("int"), weights)


def block_samples(levels: Column, qp: Column, weights: Column, predicted: Column) -> Column:
    """``blocks.residual_4x4`` as a kernel: array<int> of 16 samples from 16 levels in scan order."""

    @F.arrow_udf("array<int>")
    def run(rows: pa.Array, qps: pa.Array, matrix: pa.Array, base: pa.Array) -> pa.Array:
        at = _usable(rows, qps, 16) & matrix.is_valid().to_numpy(zero_copy_only=False) & base.is_valid().to_numpy(zero_copy_only=False)
        if not at.any():
            return _lists([], len(rows), 16)
        q = qps.filter(pa.array(at)).to_numpy(zero_copy_only=False).astype(np.int64)
        made = _transformed(_scaled(_unscanned(_matrix(rows, at, 16)[:, None, :], 4), q, _matrix(matrix, at, 16), 4), 4)
        return _lists([(np.flatnonzero(at), np.clip(made.reshape(-1, 16) + _matrix(base, at, 16), 0, 255))], len(rows), 16)

    return run(levels, qp.cast("int"), weights, predicted)


def restored(predicted: Column, residual: Column) -> Column:
    """Bytes of a macroblock's samples: the prediction (bytes) and the residual added and clipped; null where either is or their sizes differ."""

    @F.arrow_udf("binary")
    def run(base: pa.Array, rest: pa.Array) -> pa.Array:
        out = []
        for one, other in zip(base, rest):
            if not one.is_valid or not other.is_valid or len(one.as_buffer()) != len(other.values):
                out.append(None)
                continue
            out.append(np.clip(np.frombuffer(one.as_buffer(), np.uint8) + other.values.to_numpy(), 0, 255).astype(np.uint8).tobytes())
        return pa.array(out, pa.binary())

    return run(predicted, residual)
