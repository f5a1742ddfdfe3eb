"""The motion that reference pictures leave behind, and its lookup by later pictures: temporal direct vectors of whole pictures.

A reference index means a place in the lists of the block's own slice, so a
picture's field keeps order counts instead: they hold whatever the lists of a
later picture are. A later slice finds the field through entry 0 of its list 1.
Both steps are equi-joins, on (stream, picture, slice) with slim slice rows and
on (stream, picture, block), and no row is larger than a block. They are merge
joins by hint: blocks that are exploded from slim rows seem as small to Spark as
those, so it would broadcast all of them through the driver.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bitloom.operators import motion

PICTURE = ["stream_id", "picture_id"]
SLICE = [*PICTURE, "slice_id"]


def _used(ref: str) -> Column:
    return F.coalesce(F.col(ref) >= 0, F.lit(False))


def motion_field(blocks: DataFrame, slices: DataFrame) -> DataFrame:
    """stream_id, picture_id, bx, by, intra, x, y, ref_count and count of the blocks of reference pictures.

    ``blocks`` has stream_id, picture_id, slice_id, bx, by, intra and ref0,
    ref1 (places in the lists of the block's slice; null or negative where a
    list is not used), x0, y0, x1, y1. ``slices`` has stream_id, picture_id,
    slice_id, is_ref, poc, and counts0 and counts1: the order counts of its
    lists' entries. A block's vector is that of list 0, else of list 1; a place
    beyond the list means the picture's own count.
    """
    own = slices.where("is_ref").select(*SLICE, "poc", "counts0", "counts1")
    rows = blocks.select(*SLICE, "bx", "by", "intra", "ref0", "ref1", "x0", "y0", "x1", "y1").join(own.hint("merge"), SLICE)
    second = ~_used("ref0") & _used("ref1")
    count = F.when(second, F.try_element_at("counts1", (F.col("ref1") + 1).cast("int"))).when(_used("ref0"), F.try_element_at("counts0", (F.col("ref0") + 1).cast("int"))).otherwise(F.try_element_at("counts0", F.lit(1)))
    chosen = {a: F.coalesce(F.when(second, F.col(f"{a}1")).otherwise(F.col(f"{a}0")), F.lit(0)).alias(a) for a in "xy"}
    return rows.select(*PICTURE, "bx", "by", "intra", *chosen.values(), F.coalesce(count, F.col("poc")).alias("ref_count"), F.col("poc").alias("count"))


def corner(place: Column) -> Column:
    """Along one axis: the block at its macroblock's corner that stands for a block with direct inference by 8x8."""
    return F.floor(place / 4) * 4 + F.floor(place % 4 / 2) * 3


def temporal_vectors(wanted: DataFrame, slices: DataFrame, field: DataFrame, by_8x8: bool = True) -> DataFrame:
    """``wanted`` (stream_id, picture_id, slice_id, bx, by: blocks in direct mode) with mode and ref0, x0, y0, x1, y1; the reference of list 1 is its entry 0.

    ``slices`` has besides the columns of ``motion_field`` first1, the picture
    at entry 0 of list 1. mode is "temporal", or "spatial" with null motion where
    that entry is missing or left no field: not a reference, or not in the
    table. A block that its field doesn't have is taken as intra, and gives zeros.
    """
    own = slices.select(*SLICE, F.col("first1").alias("_shown"), F.col("poc").alias("_poc"), F.col("counts0").alias("_counts"))
    kept = slices.where("is_ref").select("stream_id", F.col("picture_id").alias("_shown"), F.lit(True).alias("_kept")).distinct()
    rows = wanted.join(own.hint("merge"), SLICE, "left").join(kept.hint("merge"), ["stream_id", "_shown"], "left")
    at = {c: corner(F.col(c)) if by_8x8 else F.col(c) for c in ("bx", "by")}
    rows = rows.withColumns({f"_{c}": v.cast("long") for c, v in at.items()})
    found = field.select("stream_id", F.col("picture_id").alias("_shown"), F.col("bx").cast("long").alias("_bx"), F.col("by").cast("long").alias("_by"), *(F.col(c).alias(f"_{c}") for c in ("intra", "x", "y", "ref_count", "count")))
    rows = rows.join(found.hint("merge"), ["stream_id", "_shown", "_bx", "_by"], "left")
    temporal = F.col("_kept").isNotNull()
    made = motion.temporal_direct(F.coalesce("_intra", F.lit(True)), F.col("_x"), F.col("_y"), F.col("_ref_count").cast("long"), F.col("_count").cast("long"), F.col("_poc").cast("long"), F.col("_counts"))
    rows = rows.withColumn("_d", F.when(temporal, made))
    return rows.select(*wanted.columns, F.when(temporal, "temporal").otherwise("spatial").alias("mode"), "_d.*")
