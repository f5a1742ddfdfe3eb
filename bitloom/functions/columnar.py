"""Header syntax over whole Arrow batches: one step for each element over all rows that have it.

``syntax._read`` says the same one row at a time. Here positions are a column,
values are columns by name with masks of the rows in which they are present, and
an element is read by a few numpy operations on the rows whose conditions hold,
so a header costs some microseconds whatever the number of elements. A batch is
taken in pieces of bounded rows and bits, as an index over its bits and the
columns of all elements take many times its own size.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

#: Leading zeros of an Exp-Golomb code at most.
ZEROS = 32
#: Rows, and bits or values in them, that are read or written at a time.
ROWS, SIZE = 2_000, 4_000_000


def cuts(sizes: np.ndarray, rows: int = ROWS, size: int = SIZE) -> list[tuple[int, int]]:
    """(first, number) of runs of rows: at most so many, and with at most so much in them unless it is one row."""
    out, first, ends = [], 0, np.cumsum(sizes)
    while first < len(sizes):
        before = ends[first - 1] if first else 0
        n = int(np.searchsorted(ends[first : first + rows], before + size, "right"))
        out.append((first, max(n, 1)))
        first += max(n, 1)
    return out


def _offsets(rows: pa.Array) -> np.ndarray:
    """Where each row of an array of texts, bytes or maps begins and ends, of the whole buffer or child."""
    return np.frombuffer(rows.buffers()[1], np.int32, len(rows) + 1, rows.offset * 4).astype(np.int64) if len(rows) else np.zeros(1, np.int64)


def lengths(rows: pa.Array) -> np.ndarray:
    """Characters or bytes of each row; 0 for null."""
    return np.diff(_offsets(rows)) * rows.is_valid().to_numpy(zero_copy_only=False)


class Bits:
    """Strings of 0 and 1, or bytes, one behind the other: where each begins and ends, and where the next one bit is."""

    def __init__(self, texts: pa.Array):
        packed = pa.types.is_binary(texts.type)
        offsets = _offsets(texts)
        first, last = int(offsets[0]), int(offsets[-1])
        data = texts.buffers()[2] if last > first else None
        data = (np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8))[first:last]
        self.data = np.unpackbits(data).astype(bool) if packed else data == ord("1")
        offsets = (offsets - first) * (8 if packed else 1)
        self.start, self.size = offsets[:-1], np.diff(offsets)
        numbers = np.arange(len(self.data), dtype=np.int32)
        places = np.where(self.data, numbers, np.int32(len(self.data)))
        self.next_one = np.append(np.minimum.accumulate(places[::-1])[::-1], np.int32(len(self.data)))
        before = np.maximum.accumulate(np.where(self.data, numbers, np.int32(-1))) if len(self.data) else np.zeros(0, np.int32)
        last = np.where(self.size > 0, before[np.maximum(offsets[1:] - 1, 0)] if len(before) else -1, -1) - self.start
        #: Place of each row's last one bit, -1 if it has none.
        self.stop = np.maximum(last, -1)

    def number(self, rows: np.ndarray, pos: np.ndarray, n: np.ndarray) -> np.ndarray:
        """The ``n`` bits at ``pos`` of rows that have them."""
        most = int(n.max(initial=0))
        step = np.arange(most)
        inside = step < n[:, None]
        at = np.where(inside, (self.start[rows] + pos)[:, None] + step, 0)
        bits = self.data[at] & inside if most else np.zeros((len(rows), 0), bool)
        return (bits.astype(np.int64) << np.maximum(n[:, None] - 1 - step, 0)).sum(axis=1)

    def golomb(self, rows: np.ndarray, pos: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(code numbers, ends, whether the code is whole) of the codes at ``pos``."""
        at = np.minimum(self.start[rows] + pos, len(self.data))
        zeros = np.where(pos < self.size[rows], self.next_one[at] - at, ZEROS + 1)
        end = pos + 2 * zeros + 1
        whole = (zeros <= ZEROS) & (end <= self.size[rows])
        value = np.zeros(len(rows), np.int64)
        good = np.flatnonzero(whole)
        value[good] = self.number(rows[good], pos[good] + zeros[good], zeros[good] + 1) - 1
        return value, end, whole


class Values:
    """Columns by name, each with the rows in which it is present."""

    def __init__(self, n: int):
        self.n = n
        self.columns: dict[str, tuple[np.ndarray, np.ndarray]] = {}

    def put(self, name: str, rows: np.ndarray, values) -> None:
        if name not in self.columns:
            self.columns[name] = np.zeros(self.n, bool), np.zeros(self.n, np.int64)
        there, column = self.columns[name]
        there[rows], column[rows] = True, values

    def within(self, condition: tuple[str, int, int]) -> np.ndarray | None:
        """The rows in which a value is present and in a range; None for none at all."""
        if condition[0] not in self.columns:
            return None
        there, column = self.columns[condition[0]]
        return there & (column >= condition[1]) & (column <= condition[2])

    def as_maps(self) -> pa.MapArray:
        names = list(self.columns)
        there = np.stack([self.columns[k][0] for k in names], axis=1) if names else np.zeros((self.n, 0), bool)
        values = np.stack([self.columns[k][1] for k in names], axis=1) if names else np.zeros((self.n, 0), np.int64)
        keys = pa.array(names, pa.string()).take(pa.array(np.nonzero(there)[1]))
        return pa.MapArray.from_arrays(pa.array(np.r_[0, np.cumsum(there.sum(axis=1))], pa.int32()), keys, pa.array(values[there]))


def given(maps: pa.Array) -> Values:
    """Columns of a map array; null values are left out."""
    out = Values(len(maps))
    offsets = _offsets(maps)
    sizes = np.diff(offsets)
    rows = np.repeat(np.arange(len(maps)), sizes)
    first = int(offsets[0])
    keys, items = maps.keys.slice(first, len(rows)), maps.items.slice(first, len(rows))
    coded = keys.dictionary_encode()
    there, numbers = items.is_valid().to_numpy(zero_copy_only=False) & maps.is_valid().to_numpy(zero_copy_only=False)[rows], coded.indices.to_numpy()
    values = items.fill_null(0).to_numpy(zero_copy_only=False)
    # The entries of each name together, so that each is looked at once.
    by_name = np.flatnonzero(there)
    by_name = by_name[np.argsort(numbers[by_name].astype(np.int16 if len(coded.dictionary) < 2**15 else np.int32), kind="stable")]
    ends = np.cumsum(np.bincount(numbers[by_name], minlength=len(coded.dictionary)))
    for i, name in enumerate(coded.dictionary.to_pylist()):
        at = by_name[ends[i - 1] if i else 0 : ends[i]]
        if len(at):
            out.put(name, rows[at], values[at])
    return out


def read(texts: pa.Array, table: list, known: pa.Array, ranges: dict[str, tuple[int, int]]) -> pa.StructArray:
    """struct<pos, vals, ok, bad> of rows without nulls (texts of 0 and 1, or bytes), as ``syntax._read`` gives them one by one."""
    sizes = np.diff(_offsets(texts)) * (8 if pa.types.is_binary(texts.type) else 1)
    made = [_read(texts.slice(at, n), table, known.slice(at, n), ranges) for at, n in cuts(sizes)]
    return pa.concat_arrays(made) if made else _read(texts, table, known, ranges)


def _read(texts: pa.Array, table: list, known: pa.Array, ranges: dict[str, tuple[int, int]]) -> pa.StructArray:
    n, bits, vals = len(texts), Bits(texts), given(known)
    pos, ok, bad = np.zeros(n, np.int64), np.ones(n, bool), np.full(n, -1, np.int32)
    for no, e in enumerate(table):
        act = ok.copy()
        for condition in (e.when, e.also):
            if condition is not None:
                holds = vals.within(condition)
                act = act & holds if holds is not None else np.zeros(n, bool)
        if e.name in vals.columns:
            act &= ~vals.columns[e.name][0]
        rows = np.flatnonzero(act)
        if not len(rows):
            continue
        at = pos[rows]
        whole, value, end = np.ones(len(rows), bool), np.zeros(len(rows), np.int64), at
        if e.kind in ("v", "scale"):
            whole, length = _column(vals, e.length, rows)
        if e.kind in ("u", "v"):
            size = np.full(len(rows), e.n, np.int64) if e.kind == "u" else length
            whole = whole & (at + size <= bits.size[rows])
            good = np.flatnonzero(whole)
            value[good] = bits.number(rows[good], at[good], size[good])
            end = at + size
        elif e.kind in ("ue", "se", "scale"):
            code, end, there = bits.golomb(rows, at)
            value = code if e.kind == "ue" else np.where(code % 2 == 1, (code + 1) // 2, -(code // 2))
            if e.kind == "scale":
                value = (length + value) % 256
            whole = whole & there
        elif e.kind == "either":
            whole = np.zeros(len(rows), bool)
            for name in reversed(e.length.split()):
                there, found = _column(vals, name, rows)
                value, whole = np.where(there, found, value), whole | there
        elif e.kind == "skip":
            (whole, count), (_, size) = (_column(vals, name, rows) for name in e.length.split())
            end = at + (count + 1) * size
            value, whole = np.ones(len(rows), np.int64), whole & (end <= bits.size[rows])
        elif e.kind == "fail":
            whole = np.zeros(len(rows), bool)
        else:
            value = (bits.stop[rows] > at).astype(np.int64) if e.kind == "more" else np.full(len(rows), e.n or 1, np.int64)
        lost = rows[~whole]
        ok[lost], bad[lost] = False, no
        rows, value, end = rows[whole], value[whole], end[whole]
        pos[rows] = end
        vals.put(e.name, rows, value)
        if e.name in ranges:
            low, high = ranges[e.name]
            out = rows[(value < low) | (value > high)]
            ok[out], bad[out] = False, no
    names = pa.array([e.name for e in table], pa.string()).take(pa.array(bad, mask=bad < 0))
    return pa.StructArray.from_arrays([pa.array(pos.astype(np.int32)), vals.as_maps(), pa.array(ok), names], names=["pos", "vals", "ok", "bad"])


def _column(vals: Values, name: str, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(whether it is present, value) of a column in some rows."""
    if name not in vals.columns:
        return np.zeros(len(rows), bool), np.zeros(len(rows), np.int64)
    there, column = vals.columns[name]
    return there[rows], column[rows]


class _Pieces:
    """Bits to be written: numbers of so many bits, one after the other in each row."""

    def __init__(self, n: int):
        self.size = np.zeros(n, np.int64)
        self.pieces: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []

    def put(self, rows: np.ndarray, value: np.ndarray, n: np.ndarray) -> None:
        self.pieces.append((rows, self.size[rows], value, n))
        self.size[rows] += n

    def _set(self, out: np.ndarray, start: np.ndarray) -> None:
        """Sets the one bits in ``out``, where each row begins at its ``start``."""
        for rows, at, value, n in self.pieces:
            step = np.arange(int(n.max(initial=0)))
            inside = step < n[:, None]
            bit = (value[:, None] >> np.clip(n[:, None] - 1 - step, 0, 63)) & 1
            out[((start[rows] + at)[:, None] + step)[inside]] += bit[inside].astype(np.uint8)

    def as_texts(self) -> pa.Array:
        ends = np.r_[0, np.cumsum(self.size)]
        out = np.full(int(ends[-1]), ord("0"), np.uint8)
        self._set(out, ends)
        return pa.StringArray.from_buffers(len(self.size), pa.py_buffer(ends.astype(np.int32).tobytes()), pa.py_buffer(out.tobytes()))

    def as_payloads(self, after: pa.Array) -> pa.Array:
        """Bytes: each row's bits and those of a text after it, a one and zeros to a whole byte."""
        more = lengths(after)
        stop = self.size + more
        ends = np.r_[0, np.cumsum(stop // 8 + 1)]
        out, start = np.zeros(int(ends[-1]) * 8, np.uint8), ends[:-1] * 8
        self._set(out, start)
        if more.any():
            first, within = np.repeat(_offsets(after)[:-1], more), np.arange(more.sum()) - np.repeat(np.cumsum(more) - more, more)
            out[np.repeat(start + self.size, more) + within] = np.frombuffer(after.buffers()[2], np.uint8)[first + within] == ord("1")
        out[start + stop] = 1
        return pa.Array.from_buffers(pa.binary(), len(self.size), [None, pa.py_buffer(ends.astype(np.int32).tobytes()), pa.py_buffer(np.packbits(out).tobytes())])


def _bit_length(value: np.ndarray) -> np.ndarray:
    """Bits of positive numbers below 2^53."""
    return np.frexp(value.astype(np.float64))[1].astype(np.int64)


def write(maps: pa.Array, table: list, given_maps: pa.Array | None = None, after: pa.Array | None = None) -> pa.Array:
    """The bits of a table's elements with values from maps, as ``syntax._put`` gives them one by one.

    Values of ``given_maps`` go before those of maps. With texts of bits ``after`` them, they are closed payloads in bytes.
    """
    sizes = np.ones(len(maps)) if after is None else lengths(after)
    made = [_write(*(column and column.slice(at, n) for column in (maps, given_maps, after)), table=table) for at, n in cuts(sizes)]
    return pa.concat_arrays([pa.array([], pa.string() if after is None else pa.binary()), *made])


def _write(maps: pa.Array, given_maps: pa.Array | None, after: pa.Array | None, table: list) -> pa.Array:
    n, wanted, names = len(maps), given(maps), {e.name for e in table}
    # What a reader knows: values that no element has, and elements written so far.
    known, pieces = Values(n), _Pieces(n)
    known.columns = {k: v for k, v in wanted.columns.items() if k not in names}
    for name, (there, column) in (given(given_maps).columns if given_maps is not None else {}).items():
        known.put(name, np.flatnonzero(there), column[there])
    for e in table:
        act = np.ones(n, bool)
        for condition in (e.when, e.also):
            if condition is not None:
                holds = known.within(condition)
                act = act & holds if holds is not None else np.zeros(n, bool)
        if e.name in known.columns:
            act &= ~known.columns[e.name][0]
        rows = np.flatnonzero(act)
        if not len(rows):
            continue
        value = np.full(len(rows), (e.n or 1) if e.kind == "one" else 0, np.int64)
        if e.kind == "either":
            for name in reversed(e.length.split()):
                there, found = _column(known, name, rows)
                value = np.where(there, found, value)
        there, own = _column(wanted, e.name, rows)
        value = np.where(there, own, value)
        known.put(e.name, rows, value)
        if e.kind in ("u", "v"):
            size = np.full(len(rows), e.n, np.int64) if e.kind == "u" else _column(known, e.length, rows)[1]
            pieces.put(rows, value, size)
        elif e.kind in ("ue", "se", "scale"):
            if e.kind == "scale":
                value = (value - _column(known, e.length, rows)[1] + 128) % 256 - 128
            code = (value if e.kind == "ue" else np.where(value > 0, 2 * value - 1, -2 * value)) + 1
            pieces.put(rows, code, 2 * _bit_length(code) - 1)
        elif e.kind == "skip":
            (_, count), (_, size) = (_column(known, name, rows) for name in e.length.split())
            pieces.size[rows] += (count + 1) * size
    return pieces.as_texts() if after is None else pieces.as_payloads(after)
