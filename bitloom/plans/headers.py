"""Parameter sets and slice headers of byte streams as tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bitloom.functions import syntax as X
from bitloom.plans import sequence as S

def made_once(df: DataFrame, **made: Column) -> DataFrame:
    """``df`` with columns made by a generator, so that filters on them are not pushed below and worked out twice."""
    return df.select("*", F.inline(F.array(F.struct(*(v.alias(k) for k, v in made.items())))))


def _bits(table: list[X.Element]) -> Column:
    """The bytes of a payload that the table's elements can reach."""
    return F.substring("rbsp", 1, X.longest(table))


#: Element of a map that stands for a set which cannot be used.
UNUSABLE = "unusable"


def parameter_sets(units: DataFrame, nal_unit_type: int, elements: list[X.Element], id_: str, name: str) -> DataFrame:
    """(stream_id, at, id, name) of the sets of one kind; name is a map of their elements.

    A set that cannot be read as far as its id is left out. One that is broken
    later is marked as unusable, so that it replaces the one of that id before
    it and slices that refer to it are told apart from those without a set.
    """
    sets = made_once(units.where(F.col("nal_unit_type") == nal_unit_type).withColumnRenamed("nal_idx", "at"), p=X.parse(_bits(elements), elements))
    vals = F.col("p.vals")
    marked = F.when(F.col("p.ok"), vals).otherwise(F.map_concat(F.map_filter(vals, lambda k, v: k.isin(id_, "sps_id")), F.create_map(F.lit(UNUSABLE), F.lit(1).cast("long"))))
    return sets.where(vals[id_].isNotNull()).select("stream_id", "at", vals[id_].alias(id_), marked.alias(name))


def sps(units: DataFrame) -> DataFrame:
    return parameter_sets(units, 7, X.SPS, "sps_id", "sps")


def pps(units: DataFrame) -> DataFrame:
    return parameter_sets(units, 8, X.PPS, "pps_id", "pps")


def _flag(condition: Column) -> Column:
    return F.when(F.coalesce(condition, F.lit(False)), 1).otherwise(0).cast("long")


def slice_context(nal_unit_type: Column, nal_ref_idc: Column, s: Column, p: Column) -> Column:
    """What a slice header's table needs to know of its unit and its parameter sets, as a map."""
    bottom = p["bottom_field_poc"] == 1
    free = (s["poc_type"] == 1) & (s["delta_pic_order_always_zero"] == 0)
    given = {
        "nal_unit_type": nal_unit_type.cast("long"),
        "log2_max_frame_num": s["log2_max_frame_num_minus4"] + 4,
        "log2_max_poc_lsb": F.coalesce(s["log2_max_poc_lsb_minus4"], F.lit(0)) + 4,
        "poc_type": s["poc_type"],
        "reads_bottom": _flag((s["poc_type"] == 0) & bottom),
        "reads_delta_0": _flag(free),
        "reads_delta_1": _flag(free & bottom),
        "redundant_pic_cnt_present": p["redundant_pic_cnt_present"],
        "marks_refs": _flag((nal_unit_type != 5) & (nal_ref_idc > 0)),
        "cabac": p["cabac"],
        "deblock_control": p["deblock_control"],
        "default_l0": p["num_ref_l0_default_minus1"],
        "default_l1": p["num_ref_l1_default_minus1"],
    }
    return F.create_map(*(x for k, v in given.items() for x in (F.lit(k), v)))


def slice_headers(units: DataFrame) -> DataFrame:
    """Slices (stream_id, at, nal_ref_idc, nal_unit_type, rbsp) with sps, pps, header (a map), data_at (bits before the slice data) and error.

    The sets are the newest of their ids before the slice. Frames of I, P and B
    slices are read, with reordering, explicit weights and marking commands;
    others have an error, and so have slices whose sets say what is not supported.
    """
    slices = units.where(F.col("nal_unit_type").isin(1, 5)).withColumnRenamed("nal_idx", "at")
    slices = made_once(slices, first=X.parse(_bits(X.SLICE_START), X.SLICE_START)["vals"]).withColumn("pps_id", F.col("first")["pps_id"])
    slices = S.newest_by_id(slices, pps(units), "pps_id", "pps").withColumn("sps_id", F.col("pps")["sps_id"])
    slices = S.newest_by_id(slices, sps(units), "sps_id", "sps")
    s, p = F.col("sps"), F.col("pps")
    kind = F.get(F.array(*(F.lit(k) for k in "PBI")), (F.col("first")["slice_type"] % 5).cast("int"))
    slices = slices.withColumn("kind", kind)
    kind = F.col("kind")
    weighted = F.when(kind == "P", p["weighted_pred"] == 1).when(kind == "B", p["weighted_bipred_idc"] == 1).otherwise(F.lit(False))
    usable = s.isNotNull() & p.isNotNull() & s[UNUSABLE].isNull() & p[UNUSABLE].isNull()
    key = F.when(usable, F.concat(kind, F.when(weighted, "w").otherwise("")))
    known = slice_context(F.col("nal_unit_type"), F.col("nal_ref_idc"), s, p)
    slices = made_once(slices, h=X.parse(_bits(max(X.SLICE_TABLES.values(), key=X.longest)), X.SLICE_TABLES, known, key))
    error = (
        F.when(F.col("first")["pps_id"].isNull(), "header cut off")
        .when(s.isNull() | p.isNull(), "no parameter set")
        .when(~usable, "parameter set not usable")
        .when(kind.isNull(), "slice type is not supported")
        .when(s["frame_mbs_only"] != 1, "fields are not supported")
        .when(F.coalesce(s["chroma_format_idc"], F.lit(1)) != 1, "chroma format is not supported")
        .when((F.coalesce(s["bit_depth_luma_minus8"], F.lit(0)) != 0) | (F.coalesce(s["bit_depth_chroma_minus8"], F.lit(0)) != 0), "bit depth is not supported")
        .when(s["gaps_allowed"] == 1, "gaps in frame numbers are not supported")
        .when(p["num_slice_groups_minus1"] != 0, "slice groups are not supported")
        .when(p["constrained_intra"] == 1, "constrained intra prediction is not supported")
        .when(F.col("h.bad").rlike("_too_many$"), "more commands or entries than there may be")
        .when(~F.col("h.ok"), F.when(F.col("h.bad").isin(*X.RANGES), F.concat(F.lit("out of range: "), F.col("h.bad"))).otherwise("header cut off"))
        .when(F.col("h.vals")["redundant_pic_cnt"] > 0, "redundant slices are not supported")
    )
    return slices.select("stream_id", "at", "nal_ref_idc", "nal_unit_type", "rbsp", "sps", "pps", F.col("h.vals").alias("header"), F.col("h.pos").alias("data_at"), error.alias("error"))
