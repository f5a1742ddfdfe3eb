"""Streams of raw (I_PCM) and skipped macroblocks, written and decoded relationally.

A decoded macroblock is a row; a skipped picture takes its macroblocks from the
picture that it refers to by a join, so nothing but a slice's own bytes is ever
held in one row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from bitloom.functions import bits as B
from bitloom.operators import batches
from bitloom.plans import headers as H
from bitloom.plans import sequence as S
from bitloom.sources import annexb

LUMA, CHROMA = 256, 64
MB_BYTES = LUMA + 2 * CHROMA
#: Code number of the raw macroblock type in an I slice.
PCM_TYPE = 25
#: Types of the units that end a sequence and a stream.
ENDS = (10, 11)
#: That code, 000011010, filled up to whole bytes, in hexadecimal.
PCM_MARK = "0D00"


def _sps(width: Column, height: Column) -> Column:
    """A Baseline set with four-bit frame numbers and counts."""
    head = B.put_u(F.lit(66), 8), B.put_u(F.lit(0), 8), B.put_u(F.lit(40), 8)
    codes = (B.put_ue(F.lit(v)) for v in (0, 0, 0, 0, 1))
    return B.from_bits(B.trailing(F.concat(*head, *codes, F.lit("0"), B.put_ue(width - 1), B.put_ue(height - 1), F.lit("1000"))))


def _pps() -> Column:
    codes = "1" + "1" + "00" + "111" + "0" + "00" + "111" + "100"
    return B.from_bits(B.trailing(F.lit(codes)))


def _slice(kind: int, frame_num: Column, idr: bool, first_mb: Column | None = None) -> Column:
    """Bits of a header with deblocking off; kind 7 is I, 5 is P."""
    count = B.put_u(frame_num * 2, 4)
    start = F.concat(B.put_ue(F.lit(0) if first_mb is None else first_mb), B.put_ue(F.lit(kind)), B.put_ue(F.lit(0)), B.put_u(frame_num, 4))
    end = F.concat(B.put_se(F.lit(0)), B.put_ue(F.lit(1)))
    if idr:
        return F.concat(start, B.put_ue(F.lit(0)), count, F.lit("00"), end)
    # No override and no reordering where there are references, and no marking commands.
    return F.concat(start, count, F.lit("0" if kind % 5 == 2 else "000"), end)


def encode(blocks: DataFrame, width: int, skipped: int, slices: int = 1) -> DataFrame:
    """(stream_id, mb, y, u, v as bytes) -> stream_id, content: an IDR picture of raw macroblocks, then ``skipped`` pictures that repeat it.

    The macroblocks of a stream are numbered from 0 and fill whole rows of
    ``width``. The first picture has up to ``slices`` slices. A stream is one
    value, as it is one file, so streams are to be bounded by what numbers them.
    """
    mark = B.put_ue(F.lit(PCM_TYPE))
    one = F.struct("mb", F.hex(F.concat("y", "u", "v")).alias("hex"))
    pictures = blocks.groupBy("stream_id").agg(F.count("*").alias("n"), F.array_sort(F.collect_list(one)).alias("mbs"))
    each = F.ceil(F.col("n") / slices).cast("int")

    def raw(k: int) -> Column:
        header = F.hex(B.from_bits(F.concat(_slice(7, F.lit(0), True, each * k), mark)))
        part = F.slice("mbs", each * k + 1, each)
        # Each macroblock after the first has its type before its samples.
        data = F.unhex(F.concat(header, F.array_join(F.transform(part, lambda m: m["hex"]), PCM_MARK), F.lit("80")))
        return F.when(each * k < F.col("n"), annexb.unit(3, 5, data)).otherwise(F.unhex(F.lit("")))

    units = [
        annexb.unit(3, 7, _sps(F.lit(width), (F.col("n") / width).cast("int"))),
        annexb.unit(3, 8, _pps()),
        *(raw(k) for k in range(slices)),
        *(annexb.unit(3, 1, B.from_bits(B.trailing(F.concat(_slice(5, F.lit(k), False), B.put_ue(F.col("n")))))) for k in range(1, skipped + 1)),
    ]
    return pictures.select("stream_id", F.concat(*units).alias("content"))


def _slices(streams: DataFrame) -> DataFrame:
    """Slices with what their headers and sets say, the raw or skipped macroblocks n from first_mb on, and error."""
    slices = H.slice_headers(annexb.headers(annexb.nal_units(streams)))
    head, s, p = F.col("header"), F.col("sps"), F.col("pps")
    fields = {k: head[k] for k in ("frame_num", "pps_id", "poc_lsb", "delta_poc_0", "delta_poc_1", "idr_pic_id", "first_mb")}
    counts = {k: F.coalesce(head[k], F.lit(0).cast("long")) for k in ("poc_lsb", "delta_poc_bottom", "delta_poc_0", "delta_poc_1")}
    cycle = F.when(s["num_ref_frames_in_cycle"] > 0, F.transform(F.sequence(F.lit(0).cast("long"), s["num_ref_frames_in_cycle"] - 1), lambda i: s[F.concat(F.lit("offset_for_ref_frame_"), i.cast("string"))]))
    commands = F.map_filter(head, lambda k, v: k.rlike("^mmco_[0-9]+$") & (v == 5))
    at = F.col("data_at")
    code = B.ue_at(B.to_bits(F.substring("rbsp", (at / 8).cast("int") + 1, F.lit(16))), at % 8)
    slices = slices.select(
        "stream_id", "at", "nal_ref_idc", "nal_unit_type", "data_at", "rbsp", "error", *(counts.get(k, v).alias(k) for k, v in fields.items()), counts["delta_poc_bottom"].alias("delta_poc_bottom"),
        (head["slice_type"] % 5 == 2).alias("is_i"), (head["slice_type"] % 5 == 0).alias("is_p"), (F.col("nal_unit_type") == 5).alias("is_idr"), (F.col("nal_ref_idc") > 0).alias("is_ref"), (p["cabac"] == 1).alias("cabac"),
        F.coalesce(F.size(commands) > 0, F.lit(False)).alias("resets"), (head["l0_modified"] == 1).alias("modified"), (p["weighted_pred"] == 1).alias("weighted"),
        ((s["width_mbs_minus1"] + 1) * (s["height_mbs_minus1"] + 1)).alias("size"), s["poc_type"].alias("poc_type"),
        F.pow(F.lit(2), s["log2_max_frame_num_minus4"] + 4).cast("long").alias("max_frame_num"), F.pow(F.lit(2), F.coalesce(s["log2_max_poc_lsb_minus4"], F.lit(0)) + 4).cast("long").alias("max_lsb"),
        F.coalesce(cycle, F.array().cast("array<bigint>")).alias("cycle"), *(F.coalesce(s[k], F.lit(0).cast("long")).alias(k) for k in ("offset_for_non_ref_pic", "offset_for_top_to_bottom")), code.alias("code"),
    )
    step = MB_BYTES + 2
    first = F.ceil((at + 9) / 8).cast("int")
    n = F.floor((F.length("rbsp") - first + 1) / step).cast("int")
    # All types are raw and nothing but the stop bit follows the last sample.
    marks = F.forall(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda k: (k >= n) | (F.hex(F.substring("rbsp", first + k * step - 1, F.lit(2))) == PCM_MARK))
    raw = (F.col("code.value") == PCM_TYPE) & (n > 0) & (F.length("rbsp") == first + n * step - 1) & marks
    skips = B.last_one(B.to_bits(F.substring("rbsp", (at / 8).cast("int") + 1, F.lit(16)))) == at % 8 + F.col("code.size")
    error = (
        F.when(F.col("cabac"), "arithmetic coding is not decoded")
        .when(~F.col("is_i") & ~F.col("is_p"), "B slices are not decoded")
        .when(F.col("is_i"), F.when(~F.coalesce(raw, F.lit(False)), "intra macroblocks other than raw ones are not decoded"))
        .when(F.col("modified") | F.col("weighted"), "reordered or weighted references are not decoded")
        .when(~F.coalesce(skips & (F.length("rbsp") - (at / 8) < 16), F.lit(False)), "inter macroblocks other than skipped ones are not decoded")
    )
    slices = slices.withColumn("error", F.coalesce("error", error)).withColumn("first", first)
    return slices.withColumn("n", F.when(F.col("error").isNull(), F.when(F.col("is_i"), n).otherwise(F.col("code.value"))).cast("long")).drop("code", "data_at", "modified", "weighted", "cabac")


def _pictures(streams: DataFrame) -> DataFrame:
    """Slices whose headers could be read with picture_id, and error of their slice or else of their picture.

    Windows along a stream share one shuffle, with the payloads left in it. Units
    that end a sequence or a stream end the picture before them, whatever follows.
    """
    slices = _slices(streams).where("size is not null and frame_num is not null").withColumn("end", F.lit(0))
    ends = annexb.headers(annexb.nal_units(streams)).where(F.col("nal_unit_type").isin(*ENDS)).select("stream_id", F.col("nal_idx").alias("at"), F.lit(1).alias("end"))
    ended = F.sum("end").over(S.so_far("stream_id"))
    slices = slices.unionByName(ends, allowMissingColumns=True).withColumn("ended", ended).where("end = 0")
    slices = slices.withColumn("boundary", F.coalesce(F.col("ended") > F.lag("ended").over(S.along("stream_id")), F.lit(False)))
    slices = S.pictures(slices).drop("end", "ended", "boundary")
    one = W.partitionBy("stream_id", "picture_id")
    slices = slices.withColumn("before", F.coalesce(F.sum("n").over(one.orderBy("at").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    place = F.when(F.col("first_mb") != F.col("before"), "slices overlap or leave a gap")
    slices = slices.withColumn("error", F.coalesce("error", place))
    broken = F.max(F.col("error").isNotNull()).over(one)
    whole = F.coalesce(F.sum("n").over(one), F.lit(0)) == F.col("size")
    slices = slices.withColumn("own", F.when(broken, "another slice of the picture is not decoded").when(~whole, "picture is not complete")).withColumn("raw", F.min("is_i").over(one) & F.col("own").isNull())
    # A picture with skipped macroblocks needs all references since the last whole one.
    slices = slices.withColumn("_run", F.sum(F.col("raw").cast("int")).over(S.so_far("stream_id")))
    lost = F.max(F.col("own").isNotNull() & F.col("is_ref")).over(W.partitionBy("stream_id", "_run").orderBy("picture_id").rangeBetween(W.unboundedPreceding, -1))
    orphan = ~F.col("raw") & (F.coalesce(lost, F.lit(False)) | (F.col("_run") == 0))
    return slices.withColumn("error", F.coalesce("error", "own", F.when(orphan, "refers to a picture that is not decoded"))).drop("own", "_run", "before")


def decode(streams: DataFrame) -> DataFrame:
    """(stream_id, content) -> stream_id, frame_idx (in output order), mb, y, u, v as bytes.

    Pictures of raw I and wholly skipped P slices, in any number and mix, are
    decoded. ``errors`` has a row for every other slice, and for those of
    pictures that are not complete or refer to one that is not decoded.
    """
    slices = _pictures(streams).where("error is null")
    firsts = slices.withColumn("_rank", F.row_number().over(W.partitionBy("stream_id", "picture_id").orderBy("at"))).where("_rank = 1").drop("rbsp")
    order = S.picture_order(firsts)
    frames = order.select("stream_id", "picture_id", (F.row_number().over(W.partitionBy("stream_id").orderBy("order_period", "poc")) - 1).alias("frame_idx"))

    def block(k: Column) -> Column:
        at = F.col("first") + k * (MB_BYTES + 2) + 1
        return F.struct((F.col("first_mb") + k).alias("mb"), F.substring("rbsp", at, F.lit(LUMA)).alias("y"), F.substring("rbsp", at + LUMA, F.lit(CHROMA)).alias("u"), F.substring("rbsp", at + LUMA + CHROMA, F.lit(CHROMA)).alias("v"))

    numbers = F.sequence(F.lit(0).cast("long"), F.col("n") - 1)
    raw = slices.where(F.col("is_i"))
    blocks = raw.select("stream_id", F.col("picture_id").alias("source"), F.explode(F.transform(numbers, lambda k: block(k.cast("int")))).alias("b")).select("stream_id", "source", "b.*")
    # The picture that a macroblock is copied from: its own if it is raw, else the last reference that has it raw.
    places = slices.where("n > 0").select("stream_id", "picture_id", "is_i", "is_ref", F.explode(numbers).alias("k"), "first_mb").withColumn("mb", F.col("first_mb") + F.col("k"))
    before = F.last(F.when(F.col("is_i") & F.col("is_ref"), F.col("picture_id")), ignorenulls=True).over(S.earlier("stream_id", "mb", by="picture_id"))
    places = places.select("stream_id", "picture_id", "mb", F.when(F.col("is_i"), F.col("picture_id")).otherwise(before).alias("source"))
    return places.join(frames, ["stream_id", "picture_id"]).join(blocks, ["stream_id", "source", "mb"]).select("stream_id", "frame_idx", "mb", "y", "u", "v")


def errors(streams: DataFrame) -> DataFrame:
    """(stream_id, at, error) of every slice that ``decode`` leaves out."""
    headless = _slices(streams).where("size is null or frame_num is null").select("stream_id", "at", F.coalesce("error", F.lit("header cut off")).alias("error"))
    return headless.unionByName(_pictures(streams).where("error is not null").select("stream_id", "at", "error"))


def plane_sums(blocks: DataFrame) -> DataFrame:
    """stream_id, frame_idx, mb, plane with the least, largest and sum of its samples."""
    planes = F.array(*(F.struct(F.lit(p).alias("plane"), batches.byte_sums(F.col(p)).alias("sums")) for p in "yuv"))
    return blocks.select("stream_id", "frame_idx", "mb", F.explode(planes).alias("p")).select("stream_id", "frame_idx", "mb", "p.plane", "p.sums.*")
