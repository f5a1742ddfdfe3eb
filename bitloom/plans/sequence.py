"""Order and state along a stream: parameter sets, pictures, counts and references, as window functions.

A stream's rows are ordered by ``at``. Everything that restarts at an IDR
picture is partitioned by (stream_id, idr_period), so a long stream is as many
groups as it has IDR periods; only the numbering of pictures and periods itself
runs along the whole stream, on slim rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from bitloom.functions.let import let


def along(*keys: str, by: str = "at"):
    return W.partitionBy(*keys).orderBy(by)


def earlier(*keys: str, by: str = "at"):
    return along(*keys, by=by).rowsBetween(W.unboundedPreceding, -1)


def so_far(*keys: str, by: str = "at"):
    return along(*keys, by=by).rowsBetween(W.unboundedPreceding, 0)


def newest_by_id(uses: DataFrame, sets: DataFrame, id_: str, value: str) -> DataFrame:
    """``uses`` (stream_id, at, id, ...) with the newest ``value`` of ``sets`` (stream_id, at, id, value) before each; null if there is none.

    Both are put in one sequence for each id, so the as-of lookup is a single
    shuffle and a running last value, whatever the number of versions.
    """
    keep = [c for c in uses.columns if c != value]
    left = uses.select("stream_id", "at", id_, F.struct(*keep).alias("use"), F.lit(None).cast(sets.schema[value].dataType).alias(value))
    right = sets.select("stream_id", "at", id_, F.lit(None).cast(left.schema["use"].dataType).alias("use"), value)
    both = left.unionByName(right).withColumn(value, F.last(value, ignorenulls=True).over(so_far("stream_id", id_)))
    return both.where("use is not null").select("use.*", value)


#: Fields of which a change begins a new picture.
PICTURE_FIELDS = ("frame_num", "pps_id", "nal_ref_idc", "poc_lsb", "delta_poc_bottom", "delta_poc_0", "delta_poc_1", "idr_pic_id", "nal_unit_type")


def pictures(slices: DataFrame, fields: tuple[str, ...] = PICTURE_FIELDS) -> DataFrame:
    """``slices`` with picture_id: it grows where a field differs from the slice before, absent and zero being different.

    A change of nal_ref_idc counts only to or from 0, one of nal_unit_type only
    to or from an IDR slice; ``boundary``, if there, forces a new picture.
    """
    order = along("stream_id")

    def compared(f: str) -> Column:
        if f == "nal_ref_idc":
            return F.col(f) == 0
        return F.col(f) == 5 if f == "nal_unit_type" else F.col(f)

    same = F.lit(True)
    for f in fields:
        value = compared(f)
        same = same & value.eqNullSafe(F.lag(value).over(order))
    new = ~same if "boundary" not in slices.columns else ~same | F.col("boundary")
    flagged = slices.withColumn("_new", F.when(F.lag(F.lit(1)).over(order).isNull(), 0).otherwise(new.cast("int")))
    return flagged.withColumn("picture_id", F.sum("_new").over(so_far("stream_id"))).drop("_new")


def idr_periods(pics: DataFrame) -> DataFrame:
    """``pics`` with idr_period: how many IDR pictures have come, this one included."""
    return pics.withColumn("idr_period", F.sum(F.col("is_idr").cast("long")).over(so_far("stream_id")))


def order_periods(pics: DataFrame) -> DataFrame:
    """``pics`` (is_idr, resets) with idr_period, poc_period and order_period.

    A picture that resets the counts (a marking command 5) is still counted
    from what came before it, and begins the next period of output.
    """
    pics = idr_periods(pics)
    resets = F.col("resets").cast("long")
    before = F.coalesce(F.sum(resets).over(earlier("stream_id")), F.lit(0))
    return pics.withColumn("poc_period", F.col("idr_period") + before).withColumn("order_period", F.col("idr_period") + before + resets)


def reset_lsb(pics: DataFrame) -> Column:
    """The count that stands for the last reference's at the start of a period that a reset began, 0 after an IDR picture."""
    top = F.greatest(F.lit(0), -F.col("delta_poc_bottom"))
    return F.coalesce(F.last(F.when(F.col("resets"), top), ignorenulls=True).over(earlier("stream_id", "idr_period")), F.lit(0))


def poc_type0(pics: DataFrame, max_lsb: int | Column, keys: tuple[str, ...] = ("stream_id", "idr_period"), start: Column | None = None) -> DataFrame:
    """``pics`` with poc from poc_lsb and delta_poc_bottom: the high part moves with each wrap against the last reference, at first against ``start`` (0)."""
    lsb = F.col("poc_lsb")
    start = F.lit(0) if start is None else start
    before = F.coalesce(F.last(F.when(F.col("is_ref"), lsb), ignorenulls=True).over(earlier(*keys)), start)
    max_lsb = max_lsb if isinstance(max_lsb, Column) else F.lit(max_lsb)
    half = F.shiftright(max_lsb, 1)
    wrap = F.when((lsb < before) & (before - lsb >= half), 1).when((lsb > before) & (lsb - before > half), -1).otherwise(0)
    pics = pics.withColumn("_wrap", wrap)
    turns = F.coalesce(F.sum(F.when(F.col("is_ref"), F.col("_wrap"))).over(earlier(*keys)), F.lit(0)) + F.col("_wrap")
    top = turns * max_lsb + lsb
    return pics.withColumn("poc", F.least(top, top + F.col("delta_poc_bottom"))).drop("_wrap")


def frame_num_offset(pics: DataFrame, max_frame_num: int | Column, keys: tuple[str, ...] = ("stream_id", "idr_period")) -> DataFrame:
    """``pics`` with frame_num_offset: max_frame_num for each time that frame_num fell below that of the last reference."""
    before = F.coalesce(F.last(F.when(F.col("is_ref"), F.col("frame_num")), ignorenulls=True).over(earlier(*keys)), F.lit(0))
    pics = pics.withColumn("_wrap", (F.col("frame_num") < before).cast("long"))
    turns = F.coalesce(F.sum(F.when(F.col("is_ref"), F.col("_wrap"))).over(earlier(*keys)), F.lit(0)) + F.col("_wrap")
    return pics.withColumn("frame_num_offset", turns * max_frame_num).drop("_wrap")


def _long_array(values: list[int] | Column) -> Column:
    return values if isinstance(values, Column) else F.array(*(F.lit(v).cast("long") for v in values)).cast("array<bigint>")


def poc_type1(pics: DataFrame, max_frame_num: int | Column, cycle: list[int] | Column, non_ref: int | Column, top_to_bottom: int | Column, keys: tuple[str, ...] = ("stream_id", "idr_period")) -> DataFrame:
    """``pics`` with poc from a cycle of expected offsets, delta_poc_0 and delta_poc_1; what a set gives may be a column."""
    pics = frame_num_offset(pics, max_frame_num, keys).withColumn("_cycle", _long_array(cycle))
    n = F.size("_cycle")
    number = F.when(n > 0, F.col("frame_num_offset") + F.col("frame_num")).otherwise(0).cast("long")
    number = number - (~F.col("is_ref") & (number > 0)).cast("long")

    def sum_to(k: Column) -> Column:
        return F.aggregate(F.slice("_cycle", 1, k.cast("int")), F.lit(0).cast("long"), lambda s, x: s + x)

    whole = F.floor((number - 1) / F.greatest(n, F.lit(1)))
    expected = F.when(number > 0, whole * sum_to(n) + sum_to((number - 1) % F.greatest(n, F.lit(1)) + 1)).otherwise(F.lit(0).cast("long"))
    top = expected + F.when(F.col("is_ref"), 0).otherwise(non_ref) + F.col("delta_poc_0")
    return pics.withColumn("poc", F.least(top, top + top_to_bottom + F.col("delta_poc_1"))).drop("frame_num_offset", "_cycle")


def poc_type2(pics: DataFrame, max_frame_num: int | Column, keys: tuple[str, ...] = ("stream_id", "idr_period")) -> DataFrame:
    """``pics`` with poc in decoding order: twice the running frame number, one less for non-references."""
    pics = frame_num_offset(pics, max_frame_num, keys)
    return pics.withColumn("poc", 2 * (F.col("frame_num_offset") + F.col("frame_num")) - (~F.col("is_ref")).cast("long")).drop("frame_num_offset")


def picture_order(pics: DataFrame) -> DataFrame:
    """``pics`` with idr_period, order_period and poc by each picture's own poc_type and parameter set.

    Columns used besides the counts: resets, poc_type, max_lsb, max_frame_num,
    cycle, offset_for_non_ref_pic and offset_for_top_to_bottom. A picture that
    resets has poc 0. Output goes by order_period, then by poc.
    """
    keys = ("stream_id", "poc_period")
    pics = order_periods(pics)
    pics = poc_type0(pics, F.col("max_lsb"), keys, reset_lsb(pics)).withColumnRenamed("poc", "_poc_0")
    pics = poc_type1(pics, F.col("max_frame_num"), F.col("cycle"), F.col("offset_for_non_ref_pic"), F.col("offset_for_top_to_bottom"), keys).withColumnRenamed("poc", "_poc_1")
    pics = poc_type2(pics, F.col("max_frame_num"), keys)
    poc = F.when(F.col("resets"), F.lit(0).cast("long")).when(F.col("poc_type") == 0, F.col("_poc_0")).when(F.col("poc_type") == 1, F.col("_poc_1")).otherwise(F.col("poc"))
    return pics.withColumn("poc", poc).drop("_poc_0", "_poc_1", "poc_period")


def qp_chain(blocks: DataFrame, start: Column, keys: tuple[str, ...] = ("stream_id",)) -> DataFrame:
    """``blocks`` with qp: the start plus all deltas so far, modulo 52; a PCM block sets it to 0."""
    reset = F.coalesce(F.sum(F.col("is_pcm").cast("long")).over(earlier(*keys)), F.lit(0))
    blocks = blocks.withColumn("_run", reset)
    sums = F.sum(F.when(F.col("is_pcm"), 0).otherwise(F.col("qp_delta"))).over(so_far(*keys, "_run"))
    base = F.when(F.col("_run") == 0, start).otherwise(0)
    return blocks.withColumn("qp", F.when(F.col("is_pcm"), 0).otherwise(F.pmod(base + sums, F.lit(52)))).drop("_run")


def sliding_references(pics: DataFrame, most: int, keys: tuple[str, ...] = ("stream_id", "idr_period")) -> DataFrame:
    """``pics`` with refs: (frame_num, poc) of the last ``most`` references before each, oldest first; for streams without marking commands.

    References are numbered, so the frame of the window is ``most`` rows of
    references whatever lies between them.
    """
    n = F.coalesce(F.sum(F.col("is_ref").cast("long")).over(earlier(*keys)), F.lit(0))
    pics = pics.withColumn("_n", n)
    frame = W.partitionBy(*keys).orderBy("_n").rangeBetween(-most, -1)
    refs = F.collect_list(F.when(F.col("is_ref"), F.struct("at", "frame_num", "poc"))).over(frame)
    return pics.withColumn("refs", F.array_sort(refs)).drop("_n")


def _by(refs: Column, keep: Column | None, *keys) -> Column:
    """``refs`` sorted by keys (all ascending), which are functions of an entry."""
    chosen = refs if keep is None else keep
    return F.transform(F.array_sort(F.transform(chosen, lambda r: F.struct(*(k(r).alias(f"k{i}") for i, k in enumerate(keys)), r.alias("r")))), lambda x: x["r"])


def pic_num(frame_num: Column, current: Column, max_frame_num: int | Column) -> Column:
    return F.when(frame_num > current, frame_num - max_frame_num).otherwise(frame_num)


def list_p(refs: Column, current: Column, max_frame_num: int | Column) -> Column:
    """Initial list of a P picture: short-term entries by falling picture number, then long-term ones by index."""
    short = _by(refs, F.filter(refs, lambda r: r["long_term"].isNull()), lambda r: -pic_num(r["frame_num"], current, max_frame_num))
    return F.concat(short, _by(refs, F.filter(refs, lambda r: r["long_term"].isNotNull()), lambda r: r["long_term"]))


def lists_b(refs: Column, poc: Column) -> tuple[Column, Column]:
    """Initial lists of a B picture: entries before it by falling and after it by rising count, the other way round in list 1; long-term ones last. If both are equal and longer than one, list 1 begins with its first two swapped."""
    short = F.filter(refs, lambda r: r["long_term"].isNull())
    past = _by(refs, F.filter(short, lambda r: r["poc"] <= poc), lambda r: -r["poc"])
    future = _by(refs, F.filter(short, lambda r: r["poc"] > poc), lambda r: r["poc"])
    late = _by(refs, F.filter(refs, lambda r: r["long_term"].isNotNull()), lambda r: r["long_term"])
    l0, l1 = F.concat(past, future, late), F.concat(future, past, late)
    swapped = F.concat(F.array(l1[1], l1[0]), F.slice(l1, 3, F.greatest(F.size(l1), F.lit(1))))
    return l0, F.when((F.size(l1) > 1) & (l0 == l1), swapped).otherwise(l1)


def modify_list(entries: Column, operations: Column, current: Column, max_frame_num: int | Column, active: Column) -> Column:
    """``entries`` after modification commands, cut to ``active``.

    operations: array<struct<op, v>>; 0 and 1 subtract and add v + 1 to the
    predicted picture number, 2 names a long-term index. The entry goes to the
    next place and its later occurrence is dropped; a missing entry leaves the
    list as it is.
    """

    def number(r: Column) -> Column:
        return F.when(r["long_term"].isNull(), pic_num(r["frame_num"], current, max_frame_num))

    def step(s: Column, o: Column) -> Column:
        moved = F.pmod(s["pred"] + F.when(o["op"] == 0, -(o["v"] + 1)).otherwise(o["v"] + 1), F.lit(max_frame_num))
        pred = F.when(o["op"] == 2, s["pred"]).otherwise(moved)
        wanted = F.when(pred > current, pred - max_frame_num).otherwise(pred)

        def place(v: Column) -> Column:
            def is_it(r: Column) -> Column:
                return F.when(o["op"] == 2, r["long_term"].eqNullSafe(o["v"])).otherwise(number(r).eqNullSafe(v["wanted"]))

            found = F.filter(entries, is_it)
            head = F.slice(s["list"], 1, s["at"])
            tail = F.filter(F.slice(s["list"], s["at"] + 1, F.greatest(F.size(s["list"]), F.lit(1))), lambda r: ~is_it(r))
            there = F.size(found) > 0
            return F.struct(F.when(there, F.concat(head, F.slice(found, 1, 1), tail)).otherwise(s["list"]).alias("list"), (s["at"] + there.cast("int")).alias("at"), v["pred"].alias("pred"))

        return let(place, pred=pred, wanted=wanted)

    start = F.struct(F.slice(entries, 1, active).alias("list"), F.lit(0).alias("at"), current.cast("long").alias("pred"))
    return F.slice(F.aggregate(operations, start, step, lambda s: s["list"]), 1, active)


def output_order(pics: DataFrame) -> DataFrame:
    """``pics`` with output_idx, from 0: by IDR period, then by count."""
    return pics.withColumn("output_idx", F.row_number().over(W.partitionBy("stream_id").orderBy("idr_period", "poc")) - 1)


# Bytes of picture memory by level; level 11 with constraint 3 counts as 9, all others as the last.
MEMORY = {9: 152064, 10: 152064, 11: 345600, 12: 912384, 13: 912384, 20: 912384, 21: 1824768, 22: 3110400, 30: 3110400, 31: 6912000, 32: 7864320, 40: 12582912, 41: 12582912, 42: 13369344, 50: 42393600, 51: 70778880}


def dpb_frames(level: Column, constraint3: Column, width_mbs: Column, height_mbs: Column) -> Column:
    """Frames that a decoder keeps at most: the level's memory over a frame's bytes, 16 at most."""
    memory = F.lit(MEMORY[51])
    for name, size in MEMORY.items():
        memory = F.when(level == (9 if name == 9 else name), size).otherwise(memory)
    memory = F.when((level == 11) & constraint3, MEMORY[9]).otherwise(memory)
    return F.least(F.lit(16), F.floor(memory / (width_mbs * height_mbs * 384))).cast("int")


def crop(width_mbs: Column, height_mbs: Column, left: Column, right: Column, top: Column, bottom: Column) -> Column:
    """struct<width, height> shown: the coded size without the cropped units of two samples."""
    return F.struct((width_mbs * 16 - 2 * (left + right)).alias("width"), (height_mbs * 16 - 2 * (top + bottom)).alias("height"))


def neighbours(addr: Column, width: Column, first: Column) -> Column:
    """struct<a, b, c, d>: addresses left, above, above right and above left, null outside the picture or before the slice's first."""

    def there(at: Column, inside: Column) -> Column:
        return F.when(inside & (at >= first), at)

    x = addr % width
    return F.struct(
        there(addr - 1, x > 0).alias("a"),
        there(addr - width, addr >= width).alias("b"),
        there(addr - width + 1, (addr >= width) & (x < width - 1)).alias("c"),
        there(addr - width - 1, (addr >= width) & (x > 0)).alias("d"),
    )
