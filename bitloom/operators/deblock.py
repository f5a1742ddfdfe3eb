"""Deblocking kernels: thresholds, boundary strength and the filters of one line across an edge."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from bitloom.functions.let import clamp, let

# Thresholds by index 0 to 51, and clipping by strength 1 to 3 and index.
ALPHA = [0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 4, 4, 5, 6, 7, 8, 9, 10, 12, 13, 15, 17, 20, 22, 25, 28, 32, 36, 40, 45, 50, 56, 63, 71, 80, 90, 101, 113, 127, 144, 162, 182, 203, 226, 255, 255]
BETA = [0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 2, 2, 2, 3, 3, 3, 3, 4, 4, 4, 6, 6, 7, 7, 8, 8, 9, 9, 10, 10, 11, 11, 12, 12, 13, 13, 14, 14, 15, 15, 16, 16, 17, 17, 18, 18]
TC0 = [
    [0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 1, 1, 1, 1, 1, 1, 1, 1, 1, 1, 2, 2, 2, 2, 3, 3, 3, 4, 4, 4, 5, 6, 6, 7, 8, 9, 10, 11, 13],
    [0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 1, 1, 1, 1, 1, 1, 1, 1, 1, 1, 2, 2, 2, 2, 3, 3, 3, 4, 4, 5, 5, 6, 7, 8, 8, 10, 11, 12, 13, 15, 17],
    [0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 1, 1, 1, 1, 1, 1, 1, 1, 1, 1, 2, 2, 2, 2, 3, 3, 3, 4, 4, 4, 5, 6, 6, 7, 8, 9, 10, 11, 13, 14, 16, 18, 20, 23, 25],
]


def _look_up(table: list[int], index: Column) -> Column:
    return F.get(F.array(*map(F.lit, table)), index.cast("int"))


def thresholds(qp_p: Column, qp_q: Column, alpha_offset: Column, beta_offset: Column) -> Column:
    """struct<index_a, alpha, beta> for the two blocks' quantisers and the slice's offsets."""

    def look(v: Column) -> Column:
        return F.struct(v["a"].alias("index_a"), _look_up(ALPHA, v["a"]).alias("alpha"), _look_up(BETA, v["b"]).alias("beta"))

    mean = F.shiftright(qp_p + qp_q + 1, 1)
    return let(look, a=clamp(mean + alpha_offset, 0, 51), b=clamp(mean + beta_offset, 0, 51))


def strength(intra: Column, macroblock_edge: Column, coded: Column, same_refs: Column, dx: Column, dy: Column) -> Column:
    """4 for intra at a macroblock edge, 3 intra, 2 coded coefficients, 1 other references or motion of a whole sample or more, else 0."""
    moved = (F.abs(dx) >= 4) | (F.abs(dy) >= 4)
    return F.when(intra & macroblock_edge, 4).when(intra, 3).when(coded, 2).when(~same_refs | moved, 1).otherwise(0)


def filtered_edge(at_border: Column, control: Column, same_slice: Column) -> Column:
    """Whether an edge is filtered: never at the picture's border, 1 switches off, 2 keeps to the slice; the control is that of the lower or right block's slice."""
    return ~at_border & (control != 1) & ~((control == 2) & ~same_slice)


def luma_line(s: Column, bs: Column, index_a: Column, alpha: Column, beta: Column) -> Column:
    """Eight samples p3 p2 p1 p0 q0 q1 q2 q3 across an edge, filtered for strength ``bs``."""

    def run(v: Column) -> Column:
        p, q = [s[3 - i] for i in range(4)], [s[4 + i] for i in range(4)]
        ap, aq = F.abs(p[2] - p[0]), F.abs(q[2] - q[0])
        on = (bs > 0) & (F.abs(p[0] - q[0]) < alpha) & (F.abs(p[1] - p[0]) < beta) & (F.abs(q[1] - q[0]) < beta)

        def weak(w: Column) -> Column:
            def outer(far: Column, near: Column, limit: Column) -> Column:
                return F.when(limit < beta, near + clamp(F.shiftright(far + F.shiftright(p[0] + q[0] + 1, 1) - 2 * near, 1), -v["tc0"], v["tc0"])).otherwise(near)

            return F.array(p[3], p[2], outer(p[2], p[1], ap), clamp(p[0] + w["delta"], 0, 255), clamp(q[0] - w["delta"], 0, 255), outer(q[2], q[1], aq), q[2], q[3])

        tc = v["tc0"] + (ap < beta).cast("int") + (aq < beta).cast("int")
        delta = clamp(F.shiftright(4 * (q[0] - p[0]) + (p[1] - q[1]) + 4, 3), -tc, tc)

        small = F.abs(p[0] - q[0]) < F.shiftright(alpha, 2) + 2

        def strong(a: list[Column], b: list[Column], near: Column) -> list[Column]:
            """The three samples next to the edge on a's side."""
            deep = near & small
            return [
                F.when(deep, F.shiftright(a[2] + 2 * a[1] + 2 * a[0] + 2 * b[0] + b[1] + 4, 3)).otherwise(F.shiftright(2 * a[1] + a[0] + b[1] + 2, 2)),
                F.when(deep, F.shiftright(a[2] + a[1] + a[0] + b[0] + 2, 2)).otherwise(a[1]),
                F.when(deep, F.shiftright(2 * a[3] + 3 * a[2] + a[1] + a[0] + b[0] + 4, 3)).otherwise(a[2]),
            ]

        left, right = strong(p, q, ap < beta), strong(q, p, aq < beta)
        full = F.array(p[3], left[2], left[1], left[0], right[0], right[1], right[2], q[3])
        return F.when(~on, s).when(bs == 4, full).otherwise(let(weak, delta=delta))

    tc0 = F.coalesce(_look_up(TC0[0] + TC0[1] + TC0[2], (clamp(bs, 1, 3) - 1) * 52 + index_a), F.lit(0))
    return let(run, tc0=tc0)


def chroma_line(s: Column, bs: Column, index_a: Column, alpha: Column, beta: Column) -> Column:
    """Four samples p1 p0 q0 q1 across a chroma edge; only p0 and q0 change."""
    p1, p0, q0, q1 = (s[i] for i in range(4))
    on = (bs > 0) & (F.abs(p0 - q0) < alpha) & (F.abs(p1 - p0) < beta) & (F.abs(q1 - q0) < beta)
    tc = F.coalesce(_look_up(TC0[0] + TC0[1] + TC0[2], (clamp(bs, 1, 3) - 1) * 52 + index_a), F.lit(0)) + 1
    delta = clamp(F.shiftright(4 * (q0 - p0) + (p1 - q1) + 4, 3), -tc, tc)
    weak = F.array(p1, clamp(p0 + delta, 0, 255), clamp(q0 - delta, 0, 255), q1)
    full = F.array(p1, F.shiftright(2 * p1 + p0 + q1 + 2, 2), F.shiftright(2 * q1 + q0 + p1 + 2, 2), q1)
    return F.when(~on, s).when(bs == 4, full).otherwise(weak)
