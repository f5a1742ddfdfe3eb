"""Intra and inter prediction kernels on neighbour samples, as projections."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from bitloom.functions.let import clamp, let, total


def tap3(a: Column, b: Column, c: Column) -> Column:
    return F.shiftright(a + 2 * b + c + 2, 2)


def tap2(a: Column, b: Column) -> Column:
    return F.shiftright(a + b + 1, 1)


def mean_dc(top: Column, left: Column, has_top: Column | bool, has_left: Column | bool, n: int) -> Column:
    """The mean of n samples on each edge that is there, given their sums; 128 with neither."""
    has_top, has_left = (h if isinstance(h, Column) else F.lit(h) for h in (has_top, has_left))
    shift = n.bit_length() - 1
    one = F.shiftright(F.when(has_top, top).otherwise(left) + n // 2, shift)
    return F.when(has_top & has_left, F.shiftright(top + left + n, shift + 1)).when(has_top | has_left, one).otherwise(128)


def _edge(top: Column, left: Column, corner: Column):
    """Samples along the edge of a 4x4 block by one index: -1 is the corner, 0..7 above, -2..-5 down the left."""

    def at(i: int) -> Column:
        return corner if i == -1 else top[i] if i >= 0 else left[-2 - i]

    return at


def with_upper_right(top: Column, there: Column) -> Column:
    """The eight samples above a block; where those above and to the right are missing, the fourth stands in for them."""
    return F.when(there, top).otherwise(F.concat(F.slice(top, 1, 4), F.array_repeat(top[3], 4)))


def intra_4x4(mode: str, top: Column, left: Column, corner: Column, has_top: Column | bool = True, has_left: Column | bool = True) -> Column:
    """A 4x4 prediction, row by row. ``top`` has eight samples, ``left`` four; modes by their direction. Only dc does without an edge."""
    e = _edge(top, left, corner)
    places = [(y, x) for y in range(4) for x in range(4)]
    if mode == "vertical":
        return F.array(*(top[x] for _, x in places))
    if mode == "horizontal":
        return F.array(*(left[y] for y, _ in places))
    if mode == "dc":
        return F.array_repeat(mean_dc(total([top[i] for i in range(4)]), total([left[i] for i in range(4)]), has_top, has_left, 4), 16)

    def sample(y: int, x: int) -> Column:
        if mode == "down_left":
            return tap3(top[x + y], top[min(x + y + 1, 7)], top[min(x + y + 2, 7)])
        if mode == "down_right":  # along x - y; the corner is the middle
            i = x - y - 1
            return tap3(e(i - 1), e(i), e(i + 1))
        if mode == "vertical_right":
            z = 2 * x - y
            if z >= 0:
                i = x - (y >> 1)
                return tap2(e(i - 1), e(i)) if z % 2 == 0 else tap3(e(i - 2), e(i - 1), e(i))
            return tap3(left[0], corner, top[0]) if z == -1 else tap3(e(-y - 1), e(-y), e(-y + 1))
        if mode == "horizontal_down":
            z = 2 * y - x
            if z >= 0:
                i = -1 - (y - (x >> 1))  # the left sample above the row
                return tap2(e(i), e(i - 1)) if z % 2 == 0 else tap3(e(i + 1), e(i), e(i - 1))
            return tap3(left[0], corner, top[0]) if z == -1 else tap3(e(x - 1), e(x - 2), e(x - 3))
        if mode == "vertical_left":
            i = x + (y >> 1)
            return tap2(top[i], top[i + 1]) if y % 2 == 0 else tap3(top[i], top[i + 1], top[i + 2])
        if mode == "horizontal_up":
            z = x + 2 * y
            i = y + (x >> 1)
            if z > 5:
                return left[3]
            if z == 5:
                return F.shiftright(left[2] + 3 * left[3] + 2, 2)
            return tap2(left[i], left[i + 1]) if z % 2 == 0 else tap3(left[i], left[i + 1], left[i + 2])
        raise ValueError(mode)

    return F.array(*(sample(y, x) for y, x in places))


INTRA_4X4 = ("vertical", "horizontal", "dc", "down_left", "down_right", "vertical_right", "horizontal_down", "vertical_left", "horizontal_up")


def _plane(top: Column, left: Column, corner: Column, size: int, factor: int, round_: int, shift: int) -> Column:
    half = size // 2

    def gradient(line: Column) -> Column:
        return total([(i + 1) * (line[half + i] - (line[half - 2 - i] if half - 2 - i >= 0 else corner)) for i in range(half)])

    def fill(v: Column) -> Column:
        cells = F.sequence(F.lit(0), F.lit(size * size - 1))
        return F.transform(cells, lambda i: clamp(F.shiftright(v["a"] + v["b"] * (i % size - (half - 1)) + v["c"] * (F.floor(i / size).cast("int") - (half - 1)) + 16, 5), 0, 255))

    b, c = (F.shiftright(factor * gradient(line) + round_, shift) for line in (top, left))
    return let(fill, a=16 * (top[size - 1] + left[size - 1]), b=b, c=c)


def intra_16x16(mode: str, top: Column, left: Column, corner: Column, has_top: Column | bool = True, has_left: Column | bool = True) -> Column:
    """A 16x16 luma prediction from 16 samples above and 16 to the left. Only dc does without an edge."""
    cells = F.sequence(F.lit(0), F.lit(255))
    if mode == "vertical":
        return F.transform(cells, lambda i: top[i % 16])
    if mode == "horizontal":
        return F.transform(cells, lambda i: left[F.floor(i / 16).cast("int")])
    if mode == "dc":
        return F.array_repeat(mean_dc(_sum(top), _sum(left), has_top, has_left, 16), 256)
    return _plane(top, left, corner, 16, 5, 32, 6)


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0), lambda s, x: s + x)


def intra_chroma(mode: str, top: Column, left: Column, corner: Column, has_top: Column | bool = True, has_left: Column | bool = True) -> Column:
    """An 8x8 chroma prediction; dc takes each 4x4 quarter from the edges that it touches, the two off the diagonal from one of them, the other if that is missing."""
    cells = F.sequence(F.lit(0), F.lit(63))
    if mode == "vertical":
        return F.transform(cells, lambda i: top[i % 8])
    if mode == "horizontal":
        return F.transform(cells, lambda i: left[F.floor(i / 8).cast("int")])
    if mode == "plane":
        return _plane(top, left, corner, 8, 34, 32, 6)

    def fill(v: Column) -> Column:
        there, beside = (h if isinstance(h, Column) else F.lit(h) for h in (has_top, has_left))
        both = F.array(mean_dc(v["t0"], v["l0"], there, beside, 4), mean_dc(v["t1"], v["l0"], there, beside & ~there, 4), mean_dc(v["t0"], v["l1"], there & ~beside, beside, 4), mean_dc(v["t1"], v["l1"], there, beside, 4))
        return let(lambda q: F.transform(cells, lambda i: q["q"][(2 * F.floor(i / 32) + F.floor(i % 8 / 4)).cast("int")]), q=both)

    return let(fill, t0=_sum(F.slice(top, 1, 4)), t1=_sum(F.slice(top, 5, 4)), l0=_sum(F.slice(left, 1, 4)), l1=_sum(F.slice(left, 5, 4)))


def six_tap(s: list[Column]) -> Column:
    return s[0] - 5 * s[1] + 20 * s[2] + 20 * s[3] - 5 * s[4] + s[5]


def half_sample(s: list[Column]) -> Column:
    """Half-way sample between the third and fourth of six in a line."""
    return clamp(F.shiftright(six_tap(s) + 16, 5), 0, 255)


def quarter_sample(s: list[Column]) -> Column:
    """Sample a quarter of the way from the third to the fourth of six."""
    return tap2(s[2], half_sample(s))


def centre_sample(grid: list[list[Column]]) -> Column:
    """Half-way sample in both directions from six by six samples."""
    return clamp(F.shiftright(six_tap([six_tap(row) for row in grid]) + 512, 10), 0, 255)


def luma_samples(grid: list[list[Column]]) -> Column:
    """The 16 samples at quarter steps (dx, dy), row by row, between the four middle ones of six by six."""
    g, h, m = grid[2][2], grid[2][3], grid[3][2]

    def column(x: int) -> list[Column]:
        return [row[x] for row in grid]

    def place(v: Column) -> Column:
        a, c, d, k, j = (v[n] for n in ("above", "beside", "below", "right", "centre"))
        rows = [
            [g, tap2(g, a), a, tap2(h, a)],
            [tap2(g, c), tap2(a, c), tap2(a, j), tap2(a, k)],
            [c, tap2(c, j), j, tap2(j, k)],
            [tap2(m, c), tap2(c, d), tap2(j, d), tap2(k, d)],
        ]
        return F.array(*(x for row in rows for x in row))

    return let(place, above=half_sample(grid[2]), below=half_sample(grid[3]), beside=half_sample(column(2)), right=half_sample(column(3)), centre=centre_sample(grid))


def chroma_sample(a: Column, b: Column, c: Column, d: Column, dx: Column, dy: Column) -> Column:
    """Bilinear sample at eighths dx, dy between a, b above and c, d below."""
    return F.shiftright((8 - dx) * (8 - dy) * a + dx * (8 - dy) * b + (8 - dx) * dy * c + dx * dy * d + 32, 6)


def weighted_uni(p: Column, weight: Column, offset: Column, log_denominator: Column) -> Column:
    half = F.pow(F.lit(2), F.greatest(F.lit(0), log_denominator - 1)).cast("int")
    rounded = F.floor((p * weight + half) / (2 * half)).cast("int")
    return clamp(F.when(log_denominator >= 1, rounded).otherwise(p * weight) + offset, 0, 255)


def weighted_bi(a: Column, b: Column, wa: Column, wb: Column, oa: Column, ob: Column, log_denominator: Column) -> Column:
    one = F.pow(F.lit(2), log_denominator).cast("int")
    return clamp(F.floor((a * wa + b * wb + one) / (2 * one)).cast("int") + F.shiftright(oa + ob + 1, 1), 0, 255)


def distance_scale(current: Column, first: Column, second: Column) -> Column:
    """Scale of a motion vector by picture distances, 256 for one; null where both references are equally far."""
    tb, td = clamp(current - first, -128, 127), clamp(second - first, -128, 127)

    def scaled(v: Column) -> Column:
        tx = F.try_divide(16384 + F.floor(F.abs(v["td"]) / 2), v["td"])
        whole = F.when(tx < 0, F.ceil(tx)).otherwise(F.floor(tx)).cast("int")
        return F.when(v["td"] != 0, clamp(F.shiftright(v["tb"] * whole + 32, 6), -1024, 1023))

    return let(scaled, tb=tb, td=td)


def implicit_weights(current: Column, first: Column, second: Column) -> Column:
    """struct<w0, w1> of implicit bi-prediction; 32 and 32 where the distances give none."""

    def weights(v: Column) -> Column:
        w = F.shiftright(v["s"], 2)
        plain = v["s"].isNull() | ~w.between(-64, 128)
        return F.struct(F.when(plain, 32).otherwise(64 - w).alias("w0"), F.when(plain, 32).otherwise(w).alias("w1"))

    return let(weights, s=distance_scale(current, first, second))


def scale_vector(mv: Column, scale: Column) -> Column:
    return F.shiftright(scale * mv + 128, 8)


def wrap16(x: Column) -> Column:
    return F.pmod(x + 32768, F.lit(65536)) - 32768


def median3(a: Column, b: Column, c: Column) -> Column:
    return a + b + c - F.least(a, b, c) - F.greatest(a, b, c)


def predicted_mv(vectors: list[Column], refs: list[Column], own: Column) -> Column:
    """Motion vector prediction from the neighbours A, B, C: the only one with the own reference, else the median; where B and C are missing (null) it is A."""
    a, b, c = vectors
    same = [F.coalesce(r == own, F.lit(False)) for r in refs]
    n = total([s.cast("int") for s in same])
    one = F.when(same[0], a).when(same[1], b).otherwise(c)
    zero = [F.coalesce(v, F.lit(0)) for v in vectors]
    return F.when(refs[1].isNull() & refs[2].isNull() & refs[0].isNotNull(), a).when(n == 1, one).otherwise(median3(*zero))


def part_mv(shape: str, part: Column, vectors: list[Column], refs: list[Column], own: Column) -> Column:
    """Motion vector prediction of a 16x8 or 8x16 part (0 or 1): the neighbour on its side if it has the own reference, else as ``predicted_mv``."""

    def side(i: int) -> tuple[Column, Column]:
        return F.coalesce(refs[i] == own, F.lit(False)), vectors[i]

    (has_a, a), (has_b, b), (has_c, c) = (side(i) for i in range(3))
    plain = predicted_mv(vectors, refs, own)
    if shape == "16x8":
        return F.when((part == 0) & has_b, b).when((part == 1) & has_a, a).otherwise(plain)
    if shape == "8x16":
        return F.when((part == 0) & has_a, a).when((part == 1) & has_c, c).otherwise(plain)
    raise ValueError(shape)


def skip_mv(xs: list[Column], ys: list[Column], refs: list[Column]) -> Column:
    """struct<x, y> of a skipped P macroblock: zero where A or B is missing or rests on reference 0, else the prediction for reference 0."""

    def rests(i: int) -> Column:
        return F.coalesce((refs[i] == 0) & (xs[i] == 0) & (ys[i] == 0), F.lit(False))

    zero = refs[0].isNull() | refs[1].isNull() | rests(0) | rests(1)
    return F.struct(*(F.when(zero, 0).otherwise(predicted_mv(v, refs, F.lit(0))).alias(n) for n, v in (("x", xs), ("y", ys))))


def spatial_reference(refs: list[Column]) -> Column:
    """The smallest of the neighbours' references that is there and not negative, else -1."""
    return F.coalesce(F.array_min(F.filter(F.array(*refs), lambda r: r >= 0)), F.lit(-1))


def spatial_direct(lists: list[tuple[list[Column], list[Column], list[Column]]], rests: Column) -> Column:
    """struct<ref0, x0, y0, ref1, x1, y1> of a spatial direct block.

    ``lists`` has for each list the neighbours' x, y and references (null where
    missing, -1 where the list is not used); ``rests`` says that the colocated
    block is short-term, of reference 0 and moves by at most one. Vectors are
    zero for a list that is not used; with neither, both references are 0.
    """
    found = [spatial_reference(refs) for _, _, refs in lists]

    def fields(v: Column) -> Column:
        neither = (v["r0"] < 0) & (v["r1"] < 0)
        out = []
        for i, (xs, ys, refs) in enumerate(lists):
            own = v[f"r{i}"]
            still = neither | (own < 0) | ((own == 0) & rests)
            out.append(F.when(neither, 0).otherwise(own).alias(f"ref{i}"))
            out += [F.when(still, 0).otherwise(predicted_mv(c, refs, own)).alias(f"{n}{i}") for n, c in (("x", xs), ("y", ys))]
        return F.struct(*out)

    return let(fields, r0=found[0], r1=found[1])


def resting(long_term: Column, ref: Column, x: Column, y: Column) -> Column:
    """Whether a colocated block keeps direct vectors at zero."""
    return ~long_term & (ref == 0) & x.between(-1, 1) & y.between(-1, 1)


def explicit_weight(header: Column, plane: str, list_no: int, ref: Column) -> Column:
    """struct<weight, offset> of a reference from a slice header's table; without an entry one in units of the denominator, and 0."""
    name = F.concat(F.lit(f"l{list_no}_"), ref.cast("string"))
    denominator = header["luma_log2_denominator" if plane == "luma" else "chroma_log2_denominator"]
    weight = F.coalesce(header[F.concat(F.lit(f"{plane}_weight_"), name)], F.pow(F.lit(2), denominator).cast("long"))
    return F.struct(weight.alias("weight"), F.coalesce(header[F.concat(F.lit(f"{plane}_offset_"), name)], F.lit(0).cast("long")).alias("offset"))
