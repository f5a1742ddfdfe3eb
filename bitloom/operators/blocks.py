"""Residual kernels on coefficient blocks: scans, scaling and inverse transforms.

A block is an ``array<int>`` of 4, 16 or 64 numbers, row by row; one row of a
table holds one block, so a kernel is a projection and never shuffles.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from bitloom.functions.let import clamp, let
from bitloom.functions.syntax import scaling_lists


def zigzag(n: int) -> list[int]:
    """Raster places of an n by n block in zig-zag order: along the anti-diagonals, each the other way round."""
    places = [(r, c) for r in range(n) for c in range(n)]
    places.sort(key=lambda p: (p[0] + p[1], p[0] if (p[0] + p[1]) % 2 else p[1]))
    return [r * n + c for r, c in places]


def permute(block: Column, order: list[int]) -> Column:
    """The block's numbers in another order; plain lookups, which are generated code where ``block`` is a column."""
    return F.array(*(block[i] for i in order))


def from_zigzag(levels: Column, n: int = 4) -> Column:
    """Levels in zig-zag order as a raster block."""
    order = zigzag(n)
    return permute(levels, [order.index(i) for i in range(n * n)])


def to_zigzag(block: Column, n: int = 4) -> Column:
    return permute(block, zigzag(n))


# Normalisation by qp % 6 for the three 4x4 and six 8x8 place classes.
NORM_4X4 = [[10, 16, 13], [11, 18, 14], [13, 20, 16], [14, 23, 18], [16, 25, 20], [18, 29, 23]]
NORM_8X8 = [[20, 18, 32, 19, 25, 24], [22, 19, 35, 21, 28, 26], [26, 23, 42, 24, 33, 31], [28, 25, 45, 26, 35, 33], [32, 28, 51, 30, 40, 38], [36, 32, 58, 34, 46, 43]]


def class_4x4(i: int) -> int:
    r, c = divmod(i, 4)
    return 0 if r % 2 == c % 2 == 0 else 1 if r % 2 == c % 2 == 1 else 2


def class_8x8(i: int) -> int:
    r, c = divmod(i, 8)
    if r % 4 == 0 and c % 4 == 0:
        return 0
    if r % 2 == 1 and c % 2 == 1:
        return 1
    if r % 4 == 2 and c % 4 == 2:
        return 2
    if (r % 4 == 0 and c % 2 == 1) or (r % 2 == 1 and c % 4 == 0):
        return 3
    return 4 if (r % 4 == 0 and c % 4 == 2) or (r % 4 == 2 and c % 4 == 0) else 5


def level_scale(qp: Column, weights: Column, n: int = 4) -> Column:
    """array of weight times normalisation for each place; ``weights`` is a raster scaling matrix."""
    table = NORM_4X4 if n == 4 else NORM_8X8
    place = class_4x4 if n == 4 else class_8x8
    norms = F.array(*(F.array(*(F.lit(row[place(i)]) for i in range(n * n))) for row in table))
    return F.zip_with(weights, norms[(qp % 6).cast("int")], lambda w, v: w * v)


def _scaled(block: Column, scales: Column, qp: Column, even: int, shift: int) -> Column:
    """Each number times its scale, shifted by qp / 6 - shift, rounded when to the right; ``even`` is 6 * shift."""
    by = F.floor(qp / 6).cast("int")

    def all_of(v: Column) -> Column:
        def one(c: Column, s: Column) -> Column:
            return F.call_function("shiftright", c.cast("long") * s * v["up"] + v["half"], v["down"])

        return F.zip_with(block, v["scales"], one)

    up = F.pow(F.lit(2), F.greatest(F.lit(0), by - shift)).cast("long")
    down = F.greatest(F.lit(0), shift - by)
    half = F.when(qp >= even, 0).otherwise(F.pow(F.lit(2), F.greatest(F.lit(0), shift - 1 - by)).cast("long"))
    return let(all_of, scales=scales, up=up, down=down, half=half)


def dequant_4x4(block: Column, qp: Column, weights: Column, keep_dc: bool = False) -> Column:
    out = _scaled(block, level_scale(qp, weights), qp, 24, 4)
    return F.concat(F.array(block[0].cast("long")), F.slice(out, 2, 15)) if keep_dc else out


def dequant_8x8(block: Column, qp: Column, weights: Column) -> Column:
    return _scaled(block, level_scale(qp, weights, 8), qp, 36, 6)


def dequant_luma_dc(block: Column, qp: Column, scale: Column) -> Column:
    """The 16 luma DC levels; ``scale`` is the level scale of place 0."""
    return _scaled(block, F.array_repeat(scale, 16), qp, 36, 6)


def dequant_chroma_dc(block: Column, qp: Column, scale: Column) -> Column:
    by = F.pow(F.lit(2), F.floor(qp / 6)).cast("long")
    return F.transform(block, lambda c: F.floor(c.cast("long") * scale * by / 32).cast("long"))


def _rows(block: Column, n: int) -> Column:
    return F.array(*(F.slice(block, r * n + 1, n) for r in range(n)))


def _transposed(rows: Column, n: int) -> Column:
    return F.array(*(F.array(*(rows[r][c] for r in range(n))) for c in range(n)))


def _both_ways(block: Column, n: int, line) -> Column:
    """A one-dimensional transform of the rows, then of the columns. Each step is bound, so it is worked out once."""

    def down(v: Column) -> Column:
        return let(lambda w: F.flatten(_transposed(w["down"], n)), down=F.transform(_transposed(v["across"], n), line))

    return let(lambda u: let(down, across=F.transform(_rows(u["block"], n), line)), block=block)


def _half(x: Column) -> Column:
    return F.shiftright(x, 1)


def _line_4(r: Column) -> Column:
    def join(e: Column) -> Column:
        return F.array(e["a"] + e["d"], e["b"] + e["c"], e["b"] - e["c"], e["a"] - e["d"])

    return let(join, a=r[0] + r[2], b=r[0] - r[2], c=_half(r[1]) - r[3], d=r[1] + _half(r[3]))


def _line_8(r: Column) -> Column:
    def odd(e: Column) -> Column:
        even = {"e0": e["a"] + e["d"], "e1": e["b"] + e["c"], "e2": e["b"] - e["c"], "e3": e["a"] - e["d"]}
        quarter = F.shiftright
        odds = {"o0": e["p"] + quarter(e["s"], 2), "o1": e["q"] + quarter(e["t"], 2), "o2": quarter(e["q"], 2) - e["t"], "o3": e["s"] - quarter(e["p"], 2)}
        return let(lambda x: F.array(x["e0"] + x["o3"], x["e1"] + x["o2"], x["e2"] + x["o1"], x["e3"] + x["o0"], x["e3"] - x["o0"], x["e2"] - x["o1"], x["e1"] - x["o2"], x["e0"] - x["o3"]), **even, **odds)

    return let(
        odd,
        a=r[0] + r[4],
        b=r[0] - r[4],
        c=_half(r[2]) - r[6],
        d=r[2] + _half(r[6]),
        p=r[5] - r[3] - r[7] - _half(r[7]),
        q=r[1] + r[7] - r[3] - _half(r[3]),
        t=r[7] - r[1] + r[5] + _half(r[5]),
        s=r[3] + r[5] + r[1] + _half(r[1]),
    )


def _rounded(block: Column) -> Column:
    return F.transform(block, lambda x: F.shiftright(x + 32, 6))


def inverse_4x4(block: Column) -> Column:
    return _rounded(_both_ways(block, 4, _line_4))


def inverse_8x8(block: Column) -> Column:
    return _rounded(_both_ways(block, 8, _line_8))


def hadamard_4x4(block: Column) -> Column:
    def line(r: Column) -> Column:
        return F.array(r[0] + r[1] + r[2] + r[3], r[0] + r[1] - r[2] - r[3], r[0] - r[1] - r[2] + r[3], r[0] - r[1] + r[2] - r[3])

    return _both_ways(block, 4, line)


def hadamard_2x2(block: Column) -> Column:
    return _both_ways(block, 2, lambda r: F.array(r[0] + r[1], r[0] - r[1]))


def add_residual(prediction: Column, residual: Column) -> Column:
    return F.zip_with(prediction, residual, lambda p, r: clamp(p + r, 0, 255))


# Chroma quantiser for luma-derived indices 30 to 51; below 30 it is the index.
CHROMA_QP = [29, 30, 31, 32, 32, 33, 34, 34, 35, 35, 36, 36, 37, 37, 37, 38, 38, 38, 39, 39, 39, 39]


def chroma_qp(qp: Column, offset: Column) -> Column:
    index = clamp(qp + offset, 0, 51)
    return F.when(index < 30, index).otherwise(F.get(F.array(*map(F.lit, CHROMA_QP)), (index - 30).cast("int")))


# Default scaling lists, in zig-zag order.
DEFAULT_4X4_INTRA = [6, 13, 13, 20, 20, 20, 28, 28, 28, 28, 32, 32, 32, 37, 37, 42]
DEFAULT_4X4_INTER = [10, 14, 14, 20, 20, 20, 24, 24, 24, 24, 27, 27, 27, 30, 30, 34]
# Default 8x8 scaling lists, in zig-zag order.
DEFAULT_8X8_INTRA = [
    6, 10, 10, 13, 11, 13, 16, 16, 16, 16, 18, 18, 18, 18, 18, 23, 23, 23, 23, 23, 23, 25, 25, 25, 25, 25, 25, 25, 27, 27, 27, 27,
    27, 27, 27, 27, 29, 29, 29, 29, 29, 29, 29, 31, 31, 31, 31, 31, 31, 33, 33, 33, 33, 33, 36, 36, 36, 36, 38, 38, 38, 40, 40, 42,
]
DEFAULT_8X8_INTER = [
    9, 13, 13, 15, 13, 15, 17, 17, 17, 17, 19, 19, 19, 19, 19, 21, 21, 21, 21, 21, 21, 22, 22, 22, 22, 22, 22, 22, 24, 24, 24, 24,
    24, 24, 24, 24, 25, 25, 25, 25, 25, 25, 25, 27, 27, 27, 27, 27, 27, 28, 28, 28, 28, 28, 30, 30, 30, 30, 32, 32, 32, 33, 33, 35,
]


def default_list(i: int) -> list[int]:
    """The default of scaling list i: 0 to 2 and the even ones from 6 on are for intra blocks."""
    if i < 6:
        return DEFAULT_4X4_INTRA if i < 3 else DEFAULT_4X4_INTER
    return DEFAULT_8X8_INTRA if i % 2 == 0 else DEFAULT_8X8_INTER


def parsed_lists(vals: Column, n: int = 12) -> list[Column]:
    """The scaling lists of a parameter set read by its syntax table, null where absent.

    A first value of 0 stands for the default list; a later one repeats the value before it to the end.
    """
    lists = scaling_lists(vals)
    out = []
    for i in range(n):
        default = F.array(*map(F.lit, default_list(i))).cast("array<bigint>")
        out.append(F.when(F.size(F.get(lists, F.lit(i))) == 0, default).otherwise(F.get(lists, F.lit(i))))
    return out


def resolve_lists(own: list[Column], fallback: list[Column | None] | None = None) -> list[Column]:
    """Lists with the absent ones filled in: 0, 3, 6 and 7 from ``fallback`` (the sequence's lists; without them the defaults), the others from the one before of their kind."""
    out: list[Column] = []
    for i, mine in enumerate(own):
        if i in (0, 3, 6, 7):
            default = F.array(*map(F.lit, default_list(i))).cast("array<bigint>")
            before = default if fallback is None else F.coalesce(fallback[i], default)
        else:
            before = out[i - 1] if i < 6 else out[i - 2]
        out.append(F.coalesce(mine, before))
    return out


def scaling_list(deltas: Column, default: list[int]) -> Column:
    """A scaling list from its coded deltas: the running value modulo 256; the first 0 repeats the value before it, at the start it stands for the default list."""
    size = len(default)
    start = F.struct(F.lit(8).alias("last"), F.lit(8).alias("next"), F.array().cast("array<int>").alias("out"), F.lit(0).alias("at"))

    def step(s: Column, i: Column) -> Column:
        def put(v: Column) -> Column:
            value = F.when(v["next"] == 0, s["last"]).otherwise(v["next"])
            return F.struct(value.alias("last"), v["next"].alias("next"), F.concat(s["out"], F.array(value)).alias("out"), v["at"].alias("at"))

        read = s["next"] != 0
        delta = F.coalesce(F.get(deltas, s["at"]), F.lit(0))
        return let(put, next=F.when(read, F.pmod(s["last"] + delta, F.lit(256))).otherwise(s["next"]).cast("int"), at=s["at"] + F.when(read, 1).otherwise(0))

    first_is_zero = F.pmod(8 + F.coalesce(F.get(deltas, F.lit(0)), F.lit(0)), F.lit(256)) == 0
    run = F.aggregate(F.sequence(F.lit(0), F.lit(size - 1)), start, step, lambda s: s["out"])
    return F.when(first_is_zero, F.array(*map(F.lit, default))).otherwise(run)


def resolve_4x4(lists: list[Column], fallback_intra: Column, fallback_inter: Column) -> list[Column]:
    """Six 4x4 lists, null where absent: the first of each three falls back to its set's list, the others to the one before."""
    out: list[Column] = []
    for i, own in enumerate(lists):
        before = fallback_intra if i == 0 else fallback_inter if i == 3 else out[i - 1]
        out.append(F.coalesce(own, before))
    return out


def coefficients(block: Column) -> Column:
    """How many numbers of a block are not zero."""
    return F.size(F.filter(block, lambda x: x != 0))


def residual_4x4(levels: Column, qp: Column, weights: Column, predicted: Column) -> Column:
    """Samples of a block from its levels in scan order: unscanned, scaled, transformed, added to the prediction and clipped.

    A block of which only the first level is not zero has one residual everywhere.
    """

    def scaled(v: Column) -> Column:
        def added(w: Column) -> Column:
            flat = F.array_repeat(F.shiftright(w["c"][0] + 32, 6), 16)
            return add_residual(predicted, F.when(coefficients(F.slice(w["c"], 2, 15)) == 0, flat).otherwise(inverse_4x4(w["c"])))

        return let(added, c=dequant_4x4(from_zigzag(v["z"]), qp, weights))

    return let(scaled, z=levels)
