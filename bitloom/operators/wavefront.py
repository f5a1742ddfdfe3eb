"""Motion of whole P and B slices from their references and vector differences.

A vector is predicted from the blocks to the left, above and above to the right
of it, so macroblocks with the same column plus twice the row do not need each
other. All such macroblocks, of all slices of a piece of an Arrow batch, are one step
in numpy; a piece has a bounded number of macroblocks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bitloom.functions.columnar import cuts

#: Macroblocks whose field is held at a time, unless one slice has more: some 2 KB each. Every piece goes through all waves, so small ones cost time.
MACROBLOCKS = 131_072
#: Shapes of parts by number: predicted by the median, halves one above and one beside the other, skipped, spatial direct, and with a motion that is given.
SHAPES = ("median", "16x8", "8x16", "skip", "direct", "given")
_SHAPE = {name: no for no, name in enumerate(SHAPES)}
MOTION = ("ref0", "ref1", "x0", "y0", "x1", "y1")
#: A part: the macroblock's place in the slice, shape, place and size in units of four samples, references (-1: none) and differences (or the motion itself).
PART = "mb:int,shape:int,bx:int,by:int,w:int,h:int," + ",".join(f"{c}:int" for c in MOTION)
_PART = [field.split(":")[0] for field in PART.split(",")]
BLOCKS = "array<struct<" + ",".join(f"{c}:int" for c in MOTION) + ">>"


def part(mb: Column, shape: Column | str, bx=0, by=0, w=4, h=4, ref0=0, ref1=-1, x0=0, y0=0, x1=0, y1=0) -> Column:
    """The struct of one part; a plain skipped macroblock by default but for its shape."""
    shape = F.lit(_SHAPE[shape]) if isinstance(shape, str) else shape
    values = (mb, shape, bx, by, w, h, ref0, ref1, x0, y0, x1, y1)
    return F.struct(*((v if isinstance(v, Column) else F.lit(v)).cast("int").alias(k) for k, v in zip(_PART, values)))


class _Field:
    """The blocks of all slices of a batch, 16 for each macroblock in raster order, as far as they are known."""

    def __init__(self, width: np.ndarray, first: np.ndarray, count: np.ndarray):
        start = np.cumsum(count) - count
        local = np.arange(count.sum()) - np.repeat(start, count)
        width, address = np.repeat(width, count), np.repeat(first, count) + local
        column = address % width
        self.wave = column + 2 * (address // width)
        there = {"left": (1, column > 0), "above": (width, True), "right": (width - 1, column < width - 1), "corner": (width + 1, column > 0)}
        #: Neighbours left, above, above to the right and to the left; -1 where they are not in the slice.
        self.near = {k: np.where((local >= by) & ok, np.arange(len(local)) - by, -1) for k, (by, ok) in there.items()}
        blocks = 16 * len(local)
        self.done = np.zeros(blocks, bool)
        self.refs = np.full((2, blocks), -1, np.int64)
        self.vectors = np.zeros((2, blocks, 2), np.int64)

    def block(self, mb: np.ndarray, bx: np.ndarray, by: np.ndarray) -> np.ndarray:
        """Number of the block at a place relative to a macroblock; -1 where it is not known yet or not in the slice."""
        near = self.near
        upper = np.where(bx < 0, near["corner"][mb], np.where(bx > 3, near["right"][mb], near["above"][mb]))
        same = np.where(bx < 0, near["left"][mb], np.where(bx > 3, -1, mb))
        at = np.where(by < 0, upper, same)
        place = at * 16 + (by & 3) * 4 + (bx & 3)
        return np.where((at >= 0) & self.done[place], place, -1)

    def around(self, mb: np.ndarray, bx: np.ndarray, by: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, ...]:
        """Blocks A, B and C of a part; what is above to the left stands in for C where that is not known."""
        c = self.block(mb, bx + w, by - 1)
        return self.block(mb, bx - 1, by), self.block(mb, bx, by - 1), np.where(c < 0, self.block(mb, bx - 1, by - 1), c)

    def seen(self, part_list: int, places: tuple[np.ndarray, ...]) -> tuple[np.ndarray, np.ndarray]:
        """References (3, n) and vectors (3, n, 2) of these blocks, -1 and 0 where there is none."""
        at = np.stack(places)
        refs = np.where(at >= 0, self.refs[part_list][at], -1)
        return refs, np.where((refs >= 0)[..., None], self.vectors[part_list][at], 0)

    def write(self, mb: np.ndarray, bx: np.ndarray, by: np.ndarray, w: np.ndarray, h: np.ndarray, refs: np.ndarray, vectors: np.ndarray, still: np.ndarray) -> None:
        """Fill the parts' blocks; vectors of reference 0 are 0 in ``still`` (n, 16)."""
        for place in range(16):
            x, y = place & 3, place >> 2
            own = np.flatnonzero((bx <= x) & (x < bx + w) & (by <= y) & (y < by + h))
            at = mb[own] * 16 + place
            for part_list in (0, 1):
                self.refs[part_list][at] = refs[part_list][own]
                rest = still[own, place] & (refs[part_list][own] == 0)
                self.vectors[part_list][at] = np.where(rest[:, None], 0, vectors[part_list][own])
            self.done[at] = True


def _median(refs: np.ndarray, vectors: np.ndarray, places: tuple[np.ndarray, ...], ref: np.ndarray) -> np.ndarray:
    """The vector of the only neighbour with this reference, else the median; A alone where B and C are missing."""
    a, b, c = places
    alone = (a >= 0) & (b < 0) & (c < 0)
    match = refs == ref
    only = match.sum(axis=0) == 1
    chosen = vectors[np.argmax(match, axis=0), np.arange(len(ref))]
    return np.where((alone | ~only)[:, None], np.where(alone[:, None], vectors[0], np.median(vectors, axis=0).astype(np.int64)), chosen)


def _predicted(shape: np.ndarray, bx: np.ndarray, by: np.ndarray, refs: np.ndarray, vectors: np.ndarray, places: tuple[np.ndarray, ...], ref: np.ndarray) -> np.ndarray:
    out = _median(refs, vectors, places, ref)
    # Halves take one neighbour's vector if its reference is theirs: above and left, or left and above to the right.
    for name, first, second, place in (("16x8", 1, 0, by), ("8x16", 0, 2, bx)):
        one = np.where(place == 0, first, second)
        rows = np.arange(len(ref))
        out = np.where(((shape == _SHAPE[name]) & (refs[one, rows] == ref))[:, None], vectors[one, rows], out)
    return out


def _wrapped(vectors: np.ndarray) -> np.ndarray:
    return ((vectors + 32768) & 65535) - 32768


def _fill(field: _Field, parts: dict[str, np.ndarray], still: np.ndarray) -> None:
    """All parts in waves; the n-th parts of a wave's macroblocks go together."""
    mb = parts["mb"]
    order = np.argsort(mb, kind="stable")
    starts = np.flatnonzero(np.r_[True, np.diff(mb[order]) != 0]) if len(mb) else np.zeros(0, np.int64)
    turn = np.empty(len(mb), np.int64)
    turn[order] = np.arange(len(mb)) - np.repeat(starts, np.diff(np.r_[starts, len(mb)]))
    steps = np.lexsort((turn, field.wave[mb]))
    key = field.wave[mb][steps] * 16 + turn[steps]
    for rows in np.split(steps, np.flatnonzero(np.diff(key)) + 1):
        if len(rows):
            _step(field, {k: v[rows] for k, v in parts.items()}, still)


def _step(field: _Field, p: dict[str, np.ndarray], still: np.ndarray) -> None:
    mb, shape, bx, by, w, h = (p[k] for k in _PART[:6])
    direct, skip, given = (shape == _SHAPE[k] for k in ("direct", "skip", "given"))
    # Direct parts look around the whole macroblock.
    seen = (np.where(direct, 0, bx), np.where(direct, 0, by), np.where(direct, 4, w))
    places = field.around(mb, *seen)
    near = [field.seen(part_list, places) for part_list in (0, 1)]
    refs = np.stack([p["ref0"], p["ref1"]])
    refs[0] = np.where(skip, 0, refs[0])
    refs[1] = np.where(skip, -1, refs[1])
    # The smallest reference that is not negative, which is the smallest as an unsigned number.
    least = np.stack([np.min(np.where(r < 0, 1 << 20, r), axis=0) for r, _ in near])
    least = np.where(least == 1 << 20, -1, least)
    nothing = direct & (least < 0).all(axis=0)
    refs = np.where(direct, np.where(nothing, 0, least), refs)
    difference = np.stack([np.stack([p[f"x{i}"], p[f"y{i}"]], axis=1) for i in (0, 1)])
    vectors = np.zeros_like(difference)
    for part_list, (r, v) in enumerate(near):
        guess = _predicted(shape, bx, by, r, v, places, refs[part_list])
        guess = np.where((given | nothing | (refs[part_list] < 0))[:, None], 0, guess)
        vectors[part_list] = _wrapped(guess + np.where((direct | skip | (refs[part_list] < 0))[:, None], 0, difference[part_list]))
    r, v = near[0]
    rests = [(places[i] < 0) | ((r[i] == 0) & (v[i] == 0).all(axis=1)) for i in (0, 1)]
    vectors[0] = np.where((skip & (rests[0] | rests[1]))[:, None], 0, vectors[0])
    field.write(mb, bx, by, w, h, refs, vectors, still[mb] & (direct & ~nothing)[:, None])


def _moved(batch: pa.RecordBatch) -> pa.Array:
    """The array of blocks of each slice of a batch."""

    def flat(name: str) -> tuple[pa.Array, np.ndarray]:
        rows = batch.column(name)
        counts = np.asarray(rows.value_lengths().fill_null(0))
        return rows.flatten(), counts.astype(np.int64)

    intra, count = flat("intra")
    still, _ = flat("still")
    values, per_slice = flat("parts")
    start = np.cumsum(count) - count
    field = _Field(np.asarray(batch.column("width")).astype(np.int64), np.asarray(batch.column("first_mb")).astype(np.int64), count)
    parts = {k: np.asarray(values.field(i)).astype(np.int64) for i, k in enumerate(_PART)}
    parts["mb"] = parts["mb"] + np.repeat(start, per_slice)
    field.done[np.repeat(intra.to_numpy(zero_copy_only=False).astype(bool), 16)] = True
    bits = (np.asarray(still).astype(np.int64)[:, None] >> np.arange(16)) & 1 == 1
    _fill(field, parts, bits)
    used = [np.where(field.done, ref, -1) for ref in field.refs]
    columns = [*used, *(field.vectors[i][:, axis] for i in (0, 1) for axis in (0, 1))]
    blocks = pa.StructArray.from_arrays([pa.array(c.astype(np.int32)) for c in columns], list(MOTION))
    return pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(count) * 16].astype(np.int32)), blocks)


def _runs(keep: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, n in cuts(np.asarray(batch.column("intra").value_lengths().fill_null(0)), max(batch.num_rows, 1), MACROBLOCKS):
                piece = batch.slice(at, n)
                yield pa.RecordBatch.from_arrays([*(piece.column(c) for c in keep), _moved(piece)], [*keep, "blocks"])

    return run


def slice_motion(slices: DataFrame) -> DataFrame:
    """``slices`` with blocks in place of parts: the motion of the 16 blocks of each macroblock, in raster order in it.

    A slice is a row: ``width`` of the picture and ``first_mb`` in macroblocks,
    ``intra`` (array<boolean>, one for each macroblock), ``still`` (array<int>,
    the blocks whose colocated block does not move, a bit each, for spatial
    direct parts) and ``parts`` (array of ``PART``, those of a macroblock in coded
    order). Vectors wrap at 16 bits. Blocks of no part, as of intra macroblocks,
    have references of -1. A slice has at most a picture's macroblocks, so its row
    is bounded; there is no shuffle. Pieces of a batch hold ``MACROBLOCKS`` at most.
    """
    given = ["width", "first_mb", "intra", "still", "parts"]
    keep = [f for f in slices.schema.fields if f.name not in given]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in keep), f"blocks {BLOCKS}"])
    return slices.mapInArrow(_runs([f.name for f in keep]), schema)
