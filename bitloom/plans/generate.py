"""Byte streams from rows of syntax values: the writing side of ``headers``."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from bitloom.functions import syntax as X
from bitloom.plans import headers as H
from bitloom.plans import sequence as S
from bitloom.sources import annexb

#: A unit to write: its values by element name, for slices the bits after the header, or a whole payload in hexadecimal.
UNITS = "stream_id string, nal_idx int, nal_ref_idc int, nal_unit_type int, `values` map<string,bigint>, data string, raw_hex string"


def read_config(spark: SparkSession, path: str) -> DataFrame:
    """Units from JSON, one object or one array of objects a file, with the fields of ``UNITS``."""
    return spark.read.schema(UNITS).option("multiLine", True).json(path)


# Elements of parameter sets that a slice header depends on.
_OF_SPS = ("log2_max_frame_num_minus4", "log2_max_poc_lsb_minus4", "poc_type", "delta_pic_order_always_zero")
_OF_PPS = ("sps_id", "cabac", "bottom_field_poc", "num_ref_l0_default_minus1", "num_ref_l1_default_minus1", "weighted_pred", "weighted_bipred_idc", "deblock_control", "redundant_pic_cnt_present")


def _of_slice() -> Column:
    """The table of a slice: of its kind, with weights where the picture set has them; null for none."""
    kind = F.col("slice_type") % 5
    weighted = F.when(kind == 0, F.col("pps")["weighted_pred"] == 1).when(kind == 1, F.col("pps")["weighted_bipred_idc"] == 1).otherwise(F.lit(False))
    return F.when(F.col("sps").isNotNull(), F.concat(F.get(F.array(*(F.lit(k) for k in "PBI")), kind.cast("int")), F.when(weighted, "w").otherwise("")))


def generate(units: DataFrame) -> DataFrame:
    """Rows of ``UNITS`` as streams (stream_id, content).

    A slice takes the lengths of its fields from the newest parameter sets of
    its ids before it, as a reader does. Elements without a value are 0. A
    unit with raw_hex is written as it is; a slice whose sets are missing, or a
    unit of another type without raw_hex, makes a null unit, which is left out.
    """
    rows = units.withColumnRenamed("nal_idx", "at").withColumn("values", F.coalesce("values", F.create_map().cast("map<string,bigint>")))
    vals, in_slice = F.col("values"), F.col("nal_unit_type").isin(1, 5)
    rows = rows.withColumn("pps_id", F.coalesce(vals["pps_id"], F.lit(0))).withColumn("slice_type", vals["slice_type"])
    sps = rows.where("nal_unit_type = 7").select("stream_id", "at", F.coalesce(vals["sps_id"], F.lit(0)).alias("sps_id"), _needed(_OF_SPS).alias("sps"))
    pps = rows.where("nal_unit_type = 8").select("stream_id", "at", "pps_id", _needed(_OF_PPS).alias("pps"))
    # Sets are looked up by slim rows, as the values of a header are hundreds; what comes of them is joined to the values once.
    uses = rows.where(in_slice).select(*_USE).distinct()
    uses = S.newest_by_id(uses, pps, "pps_id", "pps").withColumn("sps_id", F.coalesce(F.col("pps")["sps_id"], F.lit(0)))
    uses = S.newest_by_id(uses, sps, "sps_id", "sps")
    context = H.slice_context(F.col("nal_unit_type"), F.col("nal_ref_idc"), F.col("sps"), F.col("pps"))
    uses = uses.select(*(F.col(c).alias(f"use_{c}") for c in _USE), context.alias("context"), _of_slice().alias("of_slice"))
    same = [F.col(c).eqNullSafe(F.col(f"use_{c}")) for c in _USE]
    rows = rows.join(uses, reduce(Column.__and__, same), "left")
    key = F.when(F.col("nal_unit_type") == 7, "sps").when(F.col("nal_unit_type") == 8, "pps").otherwise(F.col("of_slice"))
    # One function for all tables, as each function gets every row.
    made = X.payload(vals, {"sps": X.SPS, "pps": X.PPS, **X.SLICE_TABLES}, key, F.col("context"), F.when(in_slice, F.col("data")))
    payload = F.when(F.col("raw_hex").isNotNull(), F.unhex("raw_hex")).otherwise(made)
    written = H.made_once(rows, unit=annexb.unit(F.col("nal_ref_idc"), F.col("nal_unit_type"), payload))
    return annexb.streams_of(written.select("stream_id", F.col("at").alias("nal_idx"), "unit").where("unit is not null"))


#: What a slice and those with the same sets and table have in common.
_USE = ("stream_id", "at", "nal_unit_type", "nal_ref_idc", "pps_id", "slice_type")


def _needed(names: tuple[str, ...]) -> Column:
    """Some elements of a set, 0 for those without a value: those a slice header depends on are then never null."""
    keys = F.array(*map(F.lit, names))
    return F.map_from_arrays(keys, F.transform(keys, lambda n: F.coalesce(F.col("values")[n], F.lit(0).cast("long"))))
