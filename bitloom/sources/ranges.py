"""Annex B files of any size, read in byte ranges and written by many tasks.

Spark's text source cuts a file into ranges of ``spark.sql.files.maxPartitionBytes``
and finds the records of each by their separator, wherever a cut falls in one:
a task reads its last record to its end beyond the range, and skips the one that
its predecessor reads. The separator here is the end of a start code, a zero and
a one. (All three bytes would not do: a reader that compares byte by byte over
the edge of its buffer takes the first two of three zeros and misses the code.)
Where a record ends in a zero a start code stands, elsewhere the record goes on.

What lies between two start codes of a range is a unit. What comes before the
first and after the last are fragments of units that go over the cut: at most
two a range, written to the shared folder. There the range that each belongs
to is found by a window over one slim row for each range, and the fragments are
put together by (file, range). So no row is larger than a range and a unit, a
file is read by as many tasks as it has ranges, through whatever file system
Spark reads, and of its bytes only fragments are shuffled. The file is read
twice: for the fragments, and for the units between them.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from bitloom.sources import shared

START = "\x00\x00\x01"
SEPARATOR = "\x00\x01"
_MARK = SEPARATOR.encode()
#: Ranges up to this number are broadcast with their units' first numbers; more are joined.
FEW_RANGES = 100_000

HEAD, WHOLE, TAIL = 0, 1, 2
_PARTS = "stream_id string, file_size bigint, cut bigint, kind int, number int, n_bytes bigint, nal binary"


class _Range:
    """The records of one range, put together to units."""

    def __init__(self, key: tuple, out: list):
        self.key, self.out = key, out
        self.held: list[bytes] = []
        self.started, self.number, self.n_bytes = False, 0, 0

    def take(self, record: bytes) -> None:
        self.held.append(record)
        self.n_bytes += len(record) + len(_MARK)
        if record[-1:] != b"\0":
            return
        unit = _MARK.join(self.held)
        if not self.started:
            self.out.append((*self.key, HEAD, -1, 0, unit))
        elif unit.strip(b"\0"):
            self.out.append((*self.key, WHOLE, self.number, 0, unit.rstrip(b"\0")))
            self.number += 1
        self.started, self.held = True, []

    def end(self) -> None:
        rest = b"".join(r + _MARK for r in self.held)
        self.out.append((*self.key, TAIL if self.started else HEAD, self.number, self.n_bytes, rest))


def _parts(kinds: tuple[int, ...]):
    """Units and fragments of a task's ranges, those of ``kinds``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, types = None, (pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.binary())
        out: list[tuple] = []

        def told() -> pa.RecordBatch:
            rows = [r for r in out if r[3] in kinds]
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [()] * len(types), types)], names=[c.split()[0] for c in _PARTS.split(", ")])

        for batch in batches:
            for path, size, cut, record in zip(*(c.to_pylist() for c in batch.columns)):
                if now is None or now.key != (path, size, cut):
                    if now is not None:
                        now.end()
                    now = _Range((path, size, cut), out)
                now.take(record)
            yield told()
        if now is not None:
            now.end()
        yield told()

    return run


def scan(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """stream_id (the file's path), nal_idx (from 0, without gaps) and nal of all units of the files below ``path``.

    A start code is two zero bytes or more and a one. What comes before a
    file's first is dropped, so are zeros at the end of a unit and empty units;
    an empty file has no units. The result is what ``annexb.nal_units`` gives,
    whatever the ranges. Files must not be compressed. Fragments are read when
    this is called, and stay in the shared folder for the result.
    """
    raw = spark.read.option("lineSep", SEPARATOR).text(path)
    at = F.col("_metadata")
    raw = raw.select(at["file_path"].alias("stream_id"), at["file_size"].alias("file_size"), at["file_block_start"].alias("cut"), F.col("value").cast("binary").alias("record"))
    folder = shared.new_folder(spark, "fragments")
    raw.mapInArrow(_parts((HEAD, TAIL)), _PARTS).write.parquet(folder)
    parts = spark.read.schema(_PARTS).parquet(folder)
    along = W.partitionBy("stream_id").orderBy("cut")
    # One row a range: whether it has a start code, and its bytes. A fragment before the range's first code belongs to the last range before that has one.
    slim = parts.groupBy("stream_id", "cut").agg(F.max((F.col("kind") == TAIL).cast("int")).alias("opens"), F.sum("n_bytes").alias("n_bytes"), F.max("file_size").alias("file_size"), F.max("number").alias("whole"))
    opener = F.last(F.when(F.col("opens") == 1, F.col("cut")), ignorenulls=True)
    total = F.sum("n_bytes").over(W.partitionBy("stream_id"))
    slim = slim.select("stream_id", "cut", "opens", "whole", opener.over(along.rowsBetween(W.unboundedPreceding, -1)).alias("before"), (total - F.col("file_size")).isin(2, -1).alias("unmarked"), (F.lead("cut").over(along).isNull()).alias("is_last"))
    known = parts.select("stream_id", "cut", "kind", "nal").join(slim, ["stream_id", "cut"])
    owner = F.when(F.col("kind") == TAIL, F.col("cut")).otherwise(F.col("before"))
    # The last record of a file that doesn't end in a separator was given one. (The source also takes a byte order mark of three bytes off a file's start.)
    own = F.when(F.col("is_last") & F.col("unmarked") & F.col("nal").isNotNull() & ((F.col("kind") == TAIL) | (F.col("opens") == 0)), F.substring("nal", F.lit(1), F.greatest(F.length("nal") - 2, F.lit(0)))).otherwise(F.col("nal"))
    pieces = known.select("stream_id", owner.alias("owner"), F.struct("cut", (F.col("kind") == HEAD).alias("later"), own.alias("nal")).alias("p"), F.when(F.col("kind") == TAIL, F.col("whole")).alias("whole")).where("owner is not null")
    over = pieces.groupBy("stream_id", "owner").agg(F.array_sort(F.collect_list("p")).alias("all"), F.max("whole").alias("whole"))
    joined = F.aggregate("all", F.lit(b"").cast("binary"), lambda s, p: F.concat(s, p["nal"]))
    over = over.select("stream_id", F.col("owner").alias("cut"), "whole", _trimmed(joined).alias("nal"))
    # Numbers: the units of the ranges before, then a range's own in order, the one that goes over its end last.
    n = F.col("whole") + (F.length("nal") > 0).cast("int")
    firsts = over.select("stream_id", "cut", F.coalesce(F.sum(n).over(along.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("first"))
    crossing = over.where(F.length("nal") > 0).join(firsts, ["stream_id", "cut"]).select("stream_id", (F.col("first") + F.col("whole")).alias("nal_idx"), "nal")
    inside = raw.mapInArrow(_parts((WHOLE,)), _PARTS)
    few = parts.limit(2 * FEW_RANGES + 1).count() <= 2 * FEW_RANGES
    inside = inside.join(F.broadcast(firsts) if few else firsts, ["stream_id", "cut"])
    return inside.select("stream_id", (F.col("first") + F.col("number")).alias("nal_idx"), "nal").unionByName(crossing)


def _trimmed(nal):
    """Bytes without the zeros at their end."""
    return F.encode(F.regexp_replace(F.decode(nal, "ISO-8859-1"), r"(?<!\x00)\x00++\z", ""), "ISO-8859-1")


def write(units: DataFrame, path: str, name: str = "stream_id", order: str = "at") -> None:
    """Writes the units (``name``, ``order``, unit with its header, escaped, without start code) as one Annex B file for each value of ``name``, in its folder ``name=value``.

    Each unit has a four-byte start code; one more closes the file, a unit
    without bytes to every reader. Rows are written one by one as they are
    sorted, so a file may be larger than memory. Spark commits the files
    together: a failed job leaves none.
    """
    zero = F.unhex(F.lit("00"))
    lead = units.select(name).distinct().select(name, F.lit(None).cast(units.schema[order].dataType).alias(order), zero.alias("unit"))
    rows = lead.unionByName(units.select(name, order, F.concat("unit", zero).alias("unit")))
    rows = rows.repartition(name).sortWithinPartitions(name, F.col(order).asc_nulls_first())
    rows.select(name, F.col("unit").cast("string").alias("value")).write.partitionBy(name).option("lineSep", START).text(path)


def write_parts(units: DataFrame, path: str, name: str = "stream_id", order: str = "at") -> None:
    """Writes the units as ``write`` does, but each stream as a run of files in its folder, by as many tasks as there are shuffle partitions.

    The tasks have ranges of (``name``, ``order``), so none has a whole stream,
    and the files' part numbers are their order. Each is an Annex B file: units
    have start codes of three bytes, and a zero behind them.
    """
    start = F.unhex(F.lit("000001"))
    parts = int(units.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = units.select(name, order, F.concat(start, "unit").alias("unit"))
    rows = rows.repartitionByRange(parts, F.col(name), F.col(order).asc_nulls_first()).sortWithinPartitions(name, F.col(order).asc_nulls_first())
    rows.select(name, F.col("unit").cast("string").alias("value")).write.partitionBy(name).option("lineSep", "\x00").text(path)


def scan_parts(spark: SparkSession, path: str, name: str = "stream_id") -> DataFrame:
    """stream_id, nal_idx (from 0 over all files of a stream) and nal of what ``write_parts`` wrote: ``scan``, with the units of the parts before counted by a window over one slim row for each file."""
    units = scan(spark, path)
    units = units.select(F.regexp_extract("stream_id", f"{name}=([^/]+)/", 1).alias("stream_id"), F.regexp_extract("stream_id", "/part-([0-9]+)-[^/]*$", 1).cast("int").alias("part"), "nal_idx", "nal")
    sizes = units.groupBy("stream_id", "part").agg(F.count("*").alias("n"))
    before = F.sum("n").over(W.partitionBy("stream_id").orderBy("part").rowsBetween(W.unboundedPreceding, -1))
    firsts = sizes.select("stream_id", "part", F.coalesce(before, F.lit(0)).alias("before"))
    return units.join(F.broadcast(firsts), ["stream_id", "part"]).select("stream_id", (F.col("before") + F.col("nal_idx")).alias("nal_idx"), "nal")
