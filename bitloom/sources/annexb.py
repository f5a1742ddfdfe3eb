"""Annex B byte streams as tables: splitting, escaping and joining NAL units with built-in expressions.

Bytes are handled as ISO-8859-1 text, one character a byte, so that Spark's
regular expressions work on them. Splitting is a projection with a generator:
it runs where the bytes are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

LATIN = "ISO-8859-1"


def read_streams(spark: SparkSession, path: str) -> DataFrame:
    """stream_id (the path) and content of each file below ``path``."""
    return spark.read.format("binaryFile").load(path).select(F.col("path").alias("stream_id"), "content")


def nal_units(streams: DataFrame, counts: Observation | None = None) -> DataFrame:
    """(stream_id, content) -> stream_id, nal_idx (from 0), nal.

    A start code is two zero bytes or more and a one. What comes before the
    first is dropped, so are zeros at the end of a unit and empty units. A null
    content has no units. Runs of zeros are matched from their first zero only,
    so a long one is read once.

    ``counts`` is filled in the same pass, when the result is first written or
    collected: streams, start_codes, units and empty (start codes without a unit).
    """
    text = F.decode("content", LATIN)
    pieces = F.split(text, r"(?<!\x00)\x00{2,}+\x01")
    units = F.filter(F.transform(F.slice(pieces, 2, F.greatest(F.size(pieces), F.lit(1))), lambda p: F.regexp_replace(p, r"(?<!\x00)\x00++\z", "")), lambda p: p != "")
    if counts is not None:
        streams = streams.select("stream_id", "content", F.coalesce(F.greatest(F.size(pieces) - 1, F.lit(0)), F.lit(0)).alias("codes"), F.coalesce(F.size(units), F.lit(0)).alias("kept"))
        found = F.coalesce(F.sum("codes"), F.lit(0)), F.coalesce(F.sum("kept"), F.lit(0))
        streams = streams.observe(counts, F.count("*").alias("streams"), found[0].alias("start_codes"), found[1].alias("units"), (found[0] - found[1]).alias("empty"))
    return streams.select("stream_id", F.posexplode(units).alias("nal_idx", "unit")).select("stream_id", "nal_idx", F.encode("unit", LATIN).alias("nal"))


def unescape(data: Column) -> Column:
    """A payload without its emulation prevention: a 3 after two zeros goes."""
    return F.encode(F.regexp_replace(F.decode(data, LATIN), r"(\x00\x00)\x03", "$1"), LATIN)


def escape(data: Column) -> Column:
    """A payload with a 3 between two zeros and a byte of at most 3."""
    return F.encode(F.regexp_replace(F.decode(data, LATIN), r"(\x00\x00)(?=[\x00-\x03])", "$1\x03"), LATIN)


def nal_header(first_byte: Column) -> dict[str, Column]:
    return {
        "forbidden": F.shiftright(first_byte, 7).bitwiseAND(1),
        "nal_ref_idc": F.shiftright(first_byte, 5).bitwiseAND(3),
        "nal_unit_type": first_byte.bitwiseAND(31),
    }


# Names of the unit types 0 to 31.
TYPE_NAMES = (
    ["unspecified", "slice", "slice_a", "slice_b", "slice_c", "idr_slice", "sei", "sps", "pps", "delimiter", "end_of_sequence", "end_of_stream", "filler", "sps_extension", "prefix", "subset_sps", "depth_sps"]
    + ["reserved"] * 2
    + ["auxiliary_slice", "extension_slice", "depth_extension_slice"]
    + ["reserved"] * 2
    + ["unspecified"] * 8
)


def type_name(nal_unit_type: Column) -> Column:
    return F.get(F.array(*map(F.lit, TYPE_NAMES)), nal_unit_type.cast("int"))


def byte_at(data: Column, i: int | Column) -> Column:
    """Byte i, from 0, as a number."""
    at = (i if isinstance(i, Column) else F.lit(i)) + 1
    return F.conv(F.hex(F.substring(data, at, F.lit(1))), 16, 10).cast("int")


def headers(units: DataFrame, counts: Observation | None = None) -> DataFrame:
    """nal_units with nal_ref_idc, nal_unit_type and rbsp; units with the forbidden bit set have an error.

    ``counts`` is filled in the same pass: units, forbidden, sets, slices, and bare (units of a header alone).
    """
    fields = nal_header(byte_at(F.col("nal"), 0))
    units = units.select("*", *(v.alias(k) for k, v in fields.items()))
    if counts is not None:
        kind = F.col("nal_unit_type")
        units = units.observe(counts, F.count("*").alias("units"), F.count_if(F.col("forbidden") == 1).alias("forbidden"), F.count_if(kind.isin(7, 8)).alias("sets"), F.count_if(kind.isin(1, 5)).alias("slices"), F.count_if(F.length("nal") == 1).alias("bare"))
    rbsp = unescape(F.substring(F.col("nal"), F.lit(2), F.length("nal")))
    return units.select("stream_id", "nal_idx", "nal_ref_idc", "nal_unit_type", rbsp.alias("rbsp"), F.when(F.col("forbidden") == 1, "forbidden bit set").alias("error"))


def unit(nal_ref_idc: Column | int, nal_unit_type: Column | int, rbsp: Column) -> Column:
    """Start code, header and escaped payload."""
    ref, kind = (v if isinstance(v, Column) else F.lit(v) for v in (nal_ref_idc, nal_unit_type))
    header = F.unhex(F.lpad(F.hex((ref * 32 + kind).cast("long")), 2, "0"))
    return F.concat(F.unhex(F.lit("00000001")), header, escape(rbsp))


def streams_of(units: DataFrame) -> DataFrame:
    """(stream_id, nal_idx, unit) -> stream_id, content: the units of each stream in order. A stream is one value, as it is one file."""
    ordered = F.array_sort(F.collect_list(F.struct("nal_idx", F.hex("unit").alias("hex"))))
    joined = F.array_join(F.transform(ordered, lambda u: u["hex"]), "")
    return units.groupBy("stream_id").agg(F.unhex(joined).alias("content"))
