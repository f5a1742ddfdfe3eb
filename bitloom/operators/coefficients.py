"""Levels, zeros and runs of coded blocks over whole Arrow batches: one numpy step for the n-th code of all rows.

``macroblocks.levels``, ``with_zeros`` and ``placed_levels`` and ``codes.runs_to`` say the same one block at a time, by interpreted steps.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from bitloom.functions import columnar
from bitloom.operators import macroblocks as M

#: Zeros before a level's code at most: levels with more of them would not fit 32 bits.
ZEROS = 33
#: Rows that are read at a time.
ROWS = 10_000
#: Bits of a run's code that is not zeros and a one.
_RUN_BITS = 3


def _continuations(codes: list[str], size: int) -> tuple[np.ndarray, np.ndarray]:
    """(number, length) of the code that each number of ``size`` bits begins with; length -1 for none."""
    number, length = np.zeros(1 << size, np.int64), np.full(1 << size, -1)
    for no, code in enumerate(codes):
        first = int(code.ljust(size, "0"), 2)
        at = slice(first, first + (1 << (size - len(code))))
        number[at], length[at] = no, len(code)
    return number, length


def _table(tables: dict[int, list[str]], size: int, rows: int) -> tuple[np.ndarray, np.ndarray]:
    number, length = np.zeros((rows, 1 << size), np.int64), np.full((rows, 1 << size), -1)
    for k, codes in tables.items():
        number[k], length[k] = _continuations(codes, size)
    return number, length


_TOTALS = {size: _table(tables, M.ZERO_BITS, 17) for size, tables in M.ZERO_CODES.items()}
_RUNS = _table(M.RUN_CODES, _RUN_BITS, 8)


class _Reader:
    """Rows of bits that are read together; ``ok`` are those of which all codes were there."""

    def __init__(self, texts: pa.Array, pos: np.ndarray, ok: np.ndarray):
        self.bits, self.pos, self.ok = columnar.Bits(texts), pos.copy(), ok & (pos >= 0)

    def lost(self, rows: np.ndarray) -> None:
        self.ok[rows] = False

    def of(self, wanted: np.ndarray) -> np.ndarray:
        return np.flatnonzero(wanted & self.ok)

    def zeros(self, rows: np.ndarray) -> np.ndarray:
        """Zeros up to the next one bit, -1 if there is none."""
        at = np.minimum(self.bits.start[rows] + self.pos[rows], len(self.bits.data))
        one = self.bits.next_one[at].astype(np.int64)
        return np.where(one < self.bits.start[rows] + self.bits.size[rows], one - at, -1)

    def ahead(self, rows: np.ndarray, n: int) -> np.ndarray:
        """The next ``n`` bits as a number, zeros standing in for those beyond the end."""
        there = np.clip(self.bits.size[rows] - self.pos[rows], 0, n)
        return self.bits.number(rows, self.pos[rows], there) << (n - there)

    def step(self, rows: np.ndarray, n: np.ndarray) -> np.ndarray:
        """Goes on by ``n`` bits; whether they are there."""
        self.pos[rows] += n
        whole = self.pos[rows] <= self.bits.size[rows]
        self.lost(rows[~whole])
        return whole

    def levels(self, n: np.ndarray, ones: np.ndarray) -> np.ndarray:
        """Levels (rows, most) of ``n`` coefficients of which ``ones`` have a sign alone, the last coefficient first."""
        ones = np.maximum(ones, 0)
        out = np.zeros((len(n), int(np.maximum(n, ones)[self.ok].max(initial=0))), np.int64)
        suffix = ((n > 10) & (ones < 3)).astype(np.int64)
        for k in range(out.shape[1]):
            rows = self.of(k < ones)
            if len(rows):
                sign = self.ahead(rows, 1)
                self.step(rows, np.ones(len(rows), np.int64))
                out[rows, k] = 1 - 2 * sign
            rows = self.of((k >= ones) & (k < n))
            if not len(rows):
                continue
            zeros, own = self.zeros(rows), suffix[rows]
            size = np.where((zeros == 14) & (own == 0), 4, np.where(zeros >= 15, zeros - 3, own))
            known = (zeros >= 0) & (zeros <= ZEROS)
            self.lost(rows[~known])
            rows, zeros, own, size = rows[known], zeros[known], own[known], size[known]
            whole = self.step(rows, zeros + 1 + size)
            rows, zeros, own, size = rows[whole], zeros[whole], own[whole], size[whole]
            code = (np.minimum(zeros, 15) << own) + self.bits.number(rows, self.pos[rows] - size, size) + np.where((zeros >= 15) & (own == 0), 15, 0)
            code += np.where(zeros >= 16, (1 << np.maximum(zeros - 3, 0)) - 4096, 0) + np.where((k == ones[rows]) & (ones[rows] < 3), 2, 0)
            level = np.where(code % 2 == 0, (code + 2) >> 1, (-code - 1) >> 1)
            least = np.maximum(own, 1)
            suffix[rows] = least + ((np.abs(level) > 3 << (least - 1)) & (least < 6))
            out[rows, k] = level
        return out

    def total_zeros(self, n: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Zeros before the last coefficient; a block without coefficients or with all of them has no code."""
        out = np.zeros(len(n), np.int64)
        coded = (n > 0) & (n != size)
        for kind, (number, length) in _TOTALS.items():
            rows = self.of(coded & (np.where(size == 15, 16, size) == kind))
            ahead = self.ahead(rows, M.ZERO_BITS)
            at = np.minimum(n[rows], 16)
            out[rows] = number[at, ahead]
            self.lost(rows[length[at, ahead] < 0])
            self.step(rows, np.maximum(length[at, ahead], 0))
        self.lost(np.flatnonzero(n + out > size))
        return out

    def placed(self, levels: np.ndarray, n: np.ndarray, zeros: np.ndarray, most: int) -> np.ndarray:
        """Blocks (rows, most) in scan order: before each level but the first in the block a run of zeros is coded while any are left."""
        out, left = np.zeros((len(n), most), np.int64), zeros.copy()
        for k in range(levels.shape[1]):
            rows = self.of(k < n)
            out[rows, n[rows] - k - 1 + left[rows]] = levels[rows, k]
            rows = self.of((k < n - 1) & (left > 0))
            if not len(rows):
                continue
            kind, ahead, before = np.minimum(left[rows], 7), self.ahead(rows, _RUN_BITS), self.zeros(rows)
            run, length = _RUNS[0][kind, ahead], _RUNS[1][kind, ahead]
            far = (length < 0) & (left[rows] > 6) & (before >= 3)
            run, length = np.where(far, before + 4, run), np.where(far, before + 1, length)
            known = (length >= 0) & (run <= left[rows])
            self.lost(rows[~known])
            self.step(rows[known], length[known])
            left[rows[known]] -= run[known]
        return out


def _numbers(*columns: pa.Array) -> tuple[list[np.ndarray], np.ndarray]:
    """Columns as numbers, and the rows in which none is null."""
    there = np.ones(len(columns[0]), bool)
    for c in columns:
        there &= c.is_valid().to_numpy(zero_copy_only=False)
    return [c.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64) for c in columns], there


def _lists(values: np.ndarray, sizes: np.ndarray, ok: np.ndarray) -> pa.Array:
    """The first numbers of each row as a list, null where it is not ok."""
    sizes = np.where(ok, sizes, 0)
    kept = values[np.arange(values.shape[1]) < sizes[:, None]].astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(sizes)], pa.int32()), pa.array(kept), mask=pa.array(~ok))


def _in_pieces(read, *columns: pa.Array) -> pa.Array:
    sizes = columns[0].cast(pa.binary()).fill_null(b"")
    made = [read(*(c.slice(at, n) for c in columns)) for at, n in columnar.cuts(np.diff(columnar._offsets(sizes)), ROWS)]
    return pa.concat_arrays(made) if made else read(*columns)


def levels(bits: Column, pos: Column, coefficients: Column, ones: Column) -> Column:
    """struct<pos, levels> of a block's levels, the last coefficient first: ``ones`` signs, then codes whose suffix grows with the levels; null if a code is cut off or longer than there may be.

    The signs of ones are bits; a code is zeros, a one and a suffix.
    """

    def read(texts: pa.Array, *numbers: pa.Array) -> pa.Array:
        (at, n, k), there = _numbers(*numbers)
        reader = _Reader(texts, at, there & texts.is_valid().to_numpy(zero_copy_only=False))
        values = reader.levels(n, k)
        lists = _lists(values, np.maximum(n, np.maximum(k, 0)), reader.ok)
        return pa.StructArray.from_arrays([pa.array(reader.pos.astype(np.int32)), lists], ["pos", "levels"], mask=pa.array(~reader.ok))

    @F.arrow_udf("struct<pos:int,levels:array<int>>")
    def run(texts: pa.Array, at: pa.Array, n: pa.Array, k: pa.Array) -> pa.Array:
        return _in_pieces(read, texts, at, n, k)

    return run(bits, pos.cast("int"), coefficients.cast("int"), ones.cast("int"))


def block(bits: Column, pos: Column, size: Column, coefficients: Column, ones: Column, sizes: tuple[int, ...] = (4, 15, 16)) -> Column:
    """struct<block, end> of a block of ``size``, one of ``sizes``, whose token ends at pos: its coefficients in scan order and the position after its codes; null where the bits are no such block or are cut off."""

    def read(texts: pa.Array, *numbers: pa.Array) -> pa.Array:
        (at, size, n, k), there = _numbers(*numbers)
        reader = _Reader(texts, at, there & texts.is_valid().to_numpy(zero_copy_only=False) & np.isin(size, sizes) & (n <= size))
        found = reader.levels(n, k)
        zeros = reader.total_zeros(n, size)
        lists = _lists(reader.placed(found, n, zeros, max(sizes)), size, reader.ok)
        return pa.StructArray.from_arrays([lists, pa.array(reader.pos.astype(np.int32))], ["block", "end"], mask=pa.array(~reader.ok))

    @F.arrow_udf("struct<block:array<int>,end:int>")
    def run(texts: pa.Array, at: pa.Array, size: pa.Array, n: pa.Array, k: pa.Array) -> pa.Array:
        return _in_pieces(read, texts, at, size, n, k)

    return run(bits, *(c.cast("int") for c in (pos, size, coefficients, ones)))
