"""Which macroblocks of a picture are there, as packed bit maps: completeness, overlaps and the first gap.

A slice's addresses become words of 60 bits, merged by OR to those of its
picture. Words are numbers, so both aggregations are by hash, where maps of
bytes were sorted with a row for every macroblock; and they are partial before
their shuffle, so what is sent is a word for each 60 addresses and task at most.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bits of a word; below 63, so that a full one plus one is still a number.
BITS = 60
_PICTURE = ["stream_id", "picture_id"]


def first_gap(word: Column) -> Column:
    """Number of the first bit that is not set; ``BITS`` if all are."""
    lowest = F.bitwise_not(word).bitwiseAND(word + 1)  # the lowest zero bit alone
    return F.bit_count(lowest - 1)


def coverage(blocks: DataFrame, sizes: DataFrame) -> DataFrame:
    """stream_id, picture_id, size, covered, overlapping and first_gap of every picture of ``sizes`` (stream_id, picture_id, size).

    ``blocks`` has stream_id, picture_id, slice_id and mb, from 0. covered
    counts addresses below ``size`` that a slice has, overlapping those that
    are in further slices too, once for each; first_gap is the first address
    that none has, null for a complete picture. A repeated row counts once;
    null, negative and too large addresses are left out.
    """
    inside = blocks.join(sizes, _PICTURE).where((F.col("mb") >= 0) & (F.col("mb") < F.col("size")))
    place = F.col("mb").cast("long")
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), (place % BITS).cast("int"))
    inside = inside.select(*_PICTURE, "slice_id", F.floor(place / BITS).alias("no"), bit.alias("bit"))
    slices = inside.groupBy(*_PICTURE, "slice_id", "no").agg(F.bit_or("bit").alias("word"))
    merged = slices.groupBy(*_PICTURE, "no").agg(F.bit_or("word").alias("word"), F.sum(F.bit_count("word")).alias("stood"))
    # A picture has a word for each 60 addresses; the first that is missing or not full has the gap.
    one = F.struct("no", first_gap(F.col("word")).alias("gap"))
    whole = merged.groupBy(*_PICTURE).agg(F.array_sort(F.collect_list(one)).alias("words"), F.sum(F.bit_count("word")).cast("long").alias("covered"), F.sum("stood").alias("stood"))
    reached = F.aggregate("words", F.lit(0).cast("long"), lambda at, w: F.when(at == w["no"] * BITS, at + w["gap"]).otherwise(at))
    rows = sizes.select(*_PICTURE, "size").join(whole, _PICTURE, "left")
    covered = F.coalesce("covered", F.lit(0))
    return rows.select(*_PICTURE, "size", covered.alias("covered"), (F.coalesce("stood", F.lit(0)) - covered).alias("overlapping"), F.when(covered < F.col("size"), F.coalesce(reached, F.lit(0))).alias("first_gap"))
