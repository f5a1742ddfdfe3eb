"""Kernels and comparisons on decoded pictures, and the small numbers that entropy decoding starts from."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bitloom.functions.let import clamp, let


def coefficient_context(a: Column, b: Column) -> Column:
    """Rounded mean of the neighbours' coefficient counts, the one that there is, or 0."""
    return F.coalesce(F.shiftright(a + b + 1, 1), a, b, F.lit(0))


def context_state(m: Column, n: Column, qp: Column) -> Column:
    """struct<state, mps> of an arithmetic decoder's context for slope m, offset n and a quantiser."""

    def split(v: Column) -> Column:
        high = v["s"] > 63
        return F.struct(F.when(high, v["s"] - 64).otherwise(63 - v["s"]).alias("state"), high.alias("mps"))

    return let(split, s=clamp(F.shiftright(m * clamp(qp, 0, 51), 4) + n, 1, 126))


def rgb(y: Column, u: Column, v: Column) -> Column:
    """struct<r, g, b> of a sample in limited range, in single precision, cut to whole numbers."""

    def part(x: Column) -> Column:
        return clamp(x, 0.0, 255.0).cast("int")

    def by(k: float, x: Column) -> Column:
        return F.lit(k).cast("float") * x.cast("float")

    luma = by(1.164383, F.greatest(y - 16, F.lit(0)))
    cb, cr = u - 128, v - 128
    return F.struct(part(luma + by(1.596027, cr)).alias("r"), part(luma - by(0.391762, cb) - by(0.812968, cr)).alias("g"), part(luma + by(2.017232, cb)).alias("b"))


def compare(decoded: DataFrame, expected: DataFrame) -> DataFrame:
    """stream_id, frame_idx, verdict and first_mb of two tables (stream_id, frame_idx, mb, sample).

    verdict is equal, different, or missing where a frame is in one table only;
    first_mb is the first macroblock that differs. Both sides meet by one full
    outer join; a frame is then a sum, not a collection.
    """
    key = ["stream_id", "frame_idx", "mb"]
    both = decoded.select(*key, F.col("sample").alias("a")).join(expected.select(*key, F.col("sample").alias("b")), key, "full")
    sums = both.groupBy("stream_id", "frame_idx").agg(F.count("a").alias("in_a"), F.count("b").alias("in_b"), F.min(F.when(F.col("a") != F.col("b"), F.col("mb"))).alias("first"))
    missing = (F.col("in_a") == 0) | (F.col("in_b") == 0)
    verdict = F.when(missing, "missing").when(F.col("first").isNotNull() | (F.col("in_a") != F.col("in_b")), "different").otherwise("equal")
    return sums.select("stream_id", "frame_idx", verdict.alias("verdict"), F.when(~missing, F.col("first")).alias("first_mb"))


def first_difference(decoded: DataFrame, expected: DataFrame) -> DataFrame:
    """stream_id, frame_idx, plane, y, x, decoded and expected of the first sample of each frame that differs, in the order of planes and rows.

    Both tables have stream_id, frame_idx, plane, y, x and sample. A sample that
    one of them lacks differs. One full outer join; a frame is then a minimum.
    """
    key = ["stream_id", "frame_idx", "plane", "y", "x"]
    both = decoded.select(*key, F.col("sample").alias("decoded")).join(expected.select(*key, F.col("sample").alias("expected")), key, "full")
    other = both.where(~F.col("decoded").eqNullSafe(F.col("expected")))
    return other.groupBy("stream_id", "frame_idx").agg(F.min(F.struct("plane", "y", "x", "decoded", "expected")).alias("first")).select("stream_id", "frame_idx", "first.*")
