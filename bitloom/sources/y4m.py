"""Decoded macroblocks as planes and as YUV4MPEG2 files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Frames a second that a file states.
RATE = "15:1"


def planes(blocks: DataFrame, width_mbs: int) -> DataFrame:
    """(stream_id, frame_idx, mb, y, u, v) -> stream_id, frame_idx, width, height, y, u, v with whole planes, row by row.

    A row of macroblocks is put together first, then a frame from its rows; one
    value holds a frame at most.
    """
    rows = blocks.withColumn("row", F.floor(F.col("mb") / width_mbs))
    hexed = F.struct("mb", *(F.hex(p).alias(p) for p in "yuv"))
    rows = rows.groupBy("stream_id", "frame_idx", "row").agg(F.array_sort(F.collect_list(hexed)).alias("mbs"))

    def lines(plane: str, side: int) -> Column:
        def line(k: Column) -> Column:
            return F.array_join(F.transform("mbs", lambda m: F.substring(m[plane], k * side * 2 + 1, F.lit(side * 2))), "")

        return F.array_join(F.transform(F.sequence(F.lit(0), F.lit(side - 1)), line), "")

    rows = rows.select("stream_id", "frame_idx", F.struct("row", lines("y", 16).alias("y"), lines("u", 8).alias("u"), lines("v", 8).alias("v")).alias("r"))
    frames = rows.groupBy("stream_id", "frame_idx").agg(F.array_sort(F.collect_list("r")).alias("rows"))
    whole = (F.unhex(F.array_join(F.col(f"rows.{p}"), "")).alias(p) for p in "yuv")
    return frames.select("stream_id", "frame_idx", F.lit(16 * width_mbs).alias("width"), (F.size("rows") * 16).alias("height"), *whole)


def cropped(frames: DataFrame, left: int, right: int, top: int, bottom: int) -> DataFrame:
    """``frames`` without units of two samples at each side."""

    def cut(plane: str, unit: int) -> Column:
        wide, high = (F.col("width") / (2 // unit)).cast("int"), (F.col("height") / (2 // unit)).cast("int")
        kept = wide - unit * (left + right)
        lines = F.sequence(F.lit(unit * top), high - unit * bottom - 1)
        return F.unhex(F.array_join(F.transform(lines, lambda k: F.hex(F.substring(F.col(plane), k * wide + unit * left + 1, kept))), ""))

    # The planes first: inside a function of a list, a name stands for the new column if there is one.
    cut_planes = frames.select("*", *(cut(p, 2 if p == "y" else 1).alias(f"new_{p}") for p in "yuv"))
    size = (F.col("width") - 2 * (left + right)).alias("width"), (F.col("height") - 2 * (top + bottom)).alias("height")
    return cut_planes.select("stream_id", "frame_idx", *size, *(F.col(f"new_{p}").alias(p) for p in "yuv"))


def files(frames: DataFrame) -> DataFrame:
    """stream_id and content, a file of all frames of a stream in order. A file is one value, so this is for streams that are one file."""
    one = F.struct("frame_idx", F.hex(F.concat(F.lit(b"FRAME\n"), "y", "u", "v")).alias("hex"))
    streams = frames.groupBy("stream_id", "width", "height").agg(F.array_sort(F.collect_list(one)).alias("frames"))
    head = F.encode(F.format_string(f"YUV4MPEG2 W%d H%d F{RATE} Ip C420\n", "width", "height"), "ISO-8859-1")
    return streams.select("stream_id", F.concat(head, F.unhex(F.array_join(F.col("frames.hex"), ""))).alias("content"))
