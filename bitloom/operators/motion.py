"""Motion across blocks: temporal direct vectors, the motion at a place in the picture, and boundary strengths of whole pictures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from bitloom.functions.let import clamp, let
from bitloom.operators import deblock
from bitloom.operators.macroblocks import list_place
from bitloom.operators.prediction import distance_scale, scale_vector

PICTURE = ["stream_id", "picture_id"]
MOTION = ["ref0", "ref1", "x0", "y0", "x1", "y1"]


def temporal_direct(intra: Column, x: Column, y: Column, ref_count: Column, count: Column, current: Column, list0: Column) -> Column:
    """struct<ref0, x0, y0, x1, y1> of a block in temporal direct mode; its reference of list 1 is 0.

    Of the colocated block it takes whether it is intra, its vector (that of
    list 0, else of list 1) and the order counts of the picture that the vector
    shows and of its own picture; ``current`` is the order count of this picture
    and ``list0`` those of its list 0. An intra block gives zeros. Where the
    colocated picture is as far as its reference, the vector is taken as it is.
    """

    def scaled(v: Column) -> Column:
        def pair(m: Column) -> Column:
            back = [F.when(v["scale"].isNull(), 0).otherwise(clamp(m[a] - own, -32768, 32767)) for a, own in (("x", x), ("y", y))]
            made = {"ref0": list_place(list0, ref_count), "x0": m["x"], "y0": m["y"], "x1": back[0], "y1": back[1]}
            return F.struct(*(F.when(intra, 0).otherwise(c).cast("long").alias(k) for k, c in made.items()))

        return let(pair, **{a: F.when(v["scale"].isNull(), own).otherwise(clamp(scale_vector(own, v["scale"]), -32768, 32767)) for a, own in (("x", x), ("y", y))})

    return let(scaled, scale=distance_scale(current, ref_count, count))


def motion_at(wanted: DataFrame, blocks: DataFrame) -> DataFrame:
    """``wanted`` with the motion of the 4x4 block at the samples (x, y) of its picture.

    ``wanted`` has stream_id, picture_id, slice_id, place (in decoding order), x
    and y; ``blocks`` has stream_id, picture_id, slice_id, place, bx, by, intra,
    ref0, x0 and y0, each block once. The result is null outside the picture or
    the slice and for what is not decoded before; an intra block has reference
    -1 and no motion. One equi-join on picture and block.
    """
    known = {c: F.when(F.col("intra"), -1 if c == "ref0" else 0).otherwise(F.col(c)).alias(c) for c in ("ref0", "x0", "y0")}
    found = blocks.select(*PICTURE, "bx", "by", F.col("slice_id").alias("its_slice"), F.col("place").alias("its_place"), *known.values())
    rows = wanted.withColumns({"bx": F.floor(F.col("x") / 4), "by": F.floor(F.col("y") / 4)})
    rows = rows.join(found, [*PICTURE, "bx", "by"], "left")
    there = (F.col("its_slice") == F.col("slice_id")) & (F.col("its_place") < F.col("place"))
    return rows.withColumns({c: F.when(there, F.col(c)) for c in known}).drop("bx", "by", "its_slice", "its_place")


def same_motion(p: Column, q: Column) -> Column:
    """Whether two blocks show the same pictures less than a whole sample apart, list by list or crosswise. ref0 and ref1 are pictures, null where a list is not used."""

    def alike(a: int, b: int) -> Column:
        near = [F.abs(F.coalesce(p[f"{axis}{a}"], F.lit(0)) - F.coalesce(q[f"{axis}{b}"], F.lit(0))) < 4 for axis in "xy"]
        return p[f"ref{a}"].eqNullSafe(q[f"ref{b}"]) & (p[f"ref{a}"].isNull() | near[0] & near[1])

    return alike(0, 0) & alike(1, 1) | alike(0, 1) & alike(1, 0)


def edge_strengths(blocks: DataFrame) -> DataFrame:
    """stream_id, picture_id, bx, by, left_bs and top_bs of every 4x4 block, null where no block is beside it.

    ``blocks`` has stream_id, picture_id, bx, by, intra, coded and ref0, ref1
    (pictures), x0, y0, x1, y1; ``large``, if there, says that a block's
    macroblock has transforms of 8x8, whose blocks are coded if any of their four
    is and have no edges inside (strength 0). All windows are over the picture,
    which bounds them, so the blocks are shuffled once, to as many tasks as
    ``spark.sql.shuffle.partitions`` says: they shrink well, so tasks merged by
    their size in the shuffle would each sort many times that.
    """
    blocks = blocks.repartition(int(blocks.sparkSession.conf.get("spark.sql.shuffle.partitions")), *PICTURE)
    coded, large = F.col("coded"), F.lit(False)
    if "large" in blocks.columns:
        # The peers of an order, not a smaller partition, which would have a shuffle of its own.
        eight = W.partitionBy(*PICTURE).orderBy(F.floor(F.col("bx") / 2), F.floor(F.col("by") / 2)).rangeBetween(W.currentRow, W.currentRow)
        large = F.coalesce("large", F.lit(False))
        coded = F.when(large, F.max("coded").over(eight)).otherwise(coded)
    own = F.struct("bx", "by", "intra", coded.alias("coded"), large.alias("large"), *MOTION)
    rows = blocks.select(*PICTURE, own.alias("q"))
    row, column = F.col("q.by"), F.col("q.bx")
    over = W.partitionBy(*PICTURE)
    rows = rows.select("*", F.lag("q").over(over.orderBy(row, column)).alias("left"), F.lag("q").over(over.orderBy(column, row)).alias("top"))

    def bs(side: str, along: str, across: str) -> Column:
        q, p = F.col("q"), F.col(side)
        beside = (p[across] == q[across]) & (p[along] == q[along] - 1)
        made = deblock.strength(p["intra"] | q["intra"], q[along] % 4 == 0, p["coded"] | q["coded"], same_motion(p, q), F.lit(0), F.lit(0))
        return F.when(beside, F.when(q["large"] & (q[along] % 2 == 1), 0).otherwise(made)).alias(f"{side}_bs")

    return rows.select(*PICTURE, "q.bx", "q.by", bs("left", "bx", "by"), bs("top", "by", "bx"))
