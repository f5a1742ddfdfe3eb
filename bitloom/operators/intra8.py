"""8x8 intra prediction: one edge of samples, smoothed, and nine directions along it.

The edge runs from the lowest sample on the left over the corner to the last
one above: 8, 1 and 16 samples. Every predicted sample but the mean is the
rounded mean of four of them, some taken twice, so a mode is a list of places.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from bitloom.functions.let import let
from bitloom.operators.prediction import INTRA_4X4, mean_dc, tap3

INTRA_8X8 = INTRA_4X4
CORNER, LAST = 8, 24


def edge(top: Column, right: Column, left: Column, corner: Column, has_right: Column) -> Column:
    """The edge from 8 samples above, 8 above to the right (the last one above stands in where they are missing), 8 to the left and the corner."""
    beyond = F.when(has_right, F.slice(right, 1, 8)).otherwise(F.array_repeat(top[7], 8))
    return F.concat(F.reverse(F.slice(left, 1, 8)), F.array(corner), F.slice(top, 1, 8), beyond)


def smoothed(samples: Column, has_corner: Column) -> Column:
    """Each sample with its neighbours, itself in place of one that is missing."""

    def mean(v: Column) -> Column:
        def at(x: Column, i: Column) -> Column:
            before = F.when((i == 0) | ((i == CORNER + 1) & ~v["has_corner"]), x).otherwise(v["e"][F.greatest(i - 1, F.lit(0))])
            after = F.when((i == LAST) | ((i == CORNER - 1) & ~v["has_corner"]), x).otherwise(v["e"][F.least(i + 1, F.lit(LAST))])
            return tap3(before, x, after)

        return F.transform(v["e"], at)

    return let(mean, e=samples, has_corner=has_corner)


def places(mode: str) -> list[int]:
    """Four places on the edge for each sample, row by row."""

    def three(i: int) -> list[int]:
        return [i - 1, i, i, i + 1]

    def two(i: int) -> list[int]:
        return [i, i, i + 1, i + 1]

    def along(x: int, y: int) -> list[int]:
        if mode == "vertical":
            return [CORNER + 1 + x] * 4
        if mode == "horizontal":
            return [CORNER - 1 - y] * 4
        if mode == "down_left":
            return three(CORNER + 2 + x + y)
        if mode == "down_right":
            return three(CORNER + x - y)
        if mode == "vertical_left":
            i = CORNER + 1 + x + y // 2
            return three(i + 1) if y % 2 else two(i)
        if mode == "horizontal_up":
            i = CORNER - 1 - y - x // 2
            return three(i - 1) if x % 2 else two(i - 1)
        # The two steep modes mirror each other: in half steps along one side, beyond the corner along the other.
        side, across, sign = (x, y, 1) if mode == "vertical_right" else (y, x, -1)
        ahead = side - across // 2
        if 2 * side < across:
            return three(CORNER - sign * (across - 2 * side - 1))
        if across % 2:
            return three(CORNER + sign * ahead)
        return two(CORNER + ahead) if sign > 0 else two(CORNER - ahead - 1)

    return [min(max(i, 0), LAST) for y in range(8) for x in range(8) for i in along(x, y)]


def intra_8x8(mode: str, e: Column, has_top: Column | bool = True, has_left: Column | bool = True) -> Column:
    """An 8x8 prediction, row by row, from a smoothed edge. Only dc does without a side."""
    if mode == "dc":
        left, top = (F.aggregate(F.slice(e, at, 8), F.lit(0), lambda s, x: s + x) for at in (1, CORNER + 2))
        return F.array_repeat(mean_dc(top, left, has_top, has_left, 8), 64)

    def filled(v: Column) -> Column:
        def sample(i: Column) -> Column:
            return F.shiftright(sum((v["e"][v["at"][4 * i + k]] for k in range(1, 4)), v["e"][v["at"][4 * i]]) + 2, 2)

        return F.transform(F.sequence(F.lit(0), F.lit(63)), sample)

    return let(filled, e=e, at=F.lit(places(mode)))
