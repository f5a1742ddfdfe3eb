"""Parameter sets, picture order counts and the picture buffer of byte streams as state of a running query.

Two processors keyed by stream, each with Spark's state variables, so that what a
stream has sent so far lives in the state store and a restart goes on from the
checkpoint:

* ``slices``: a map of the newest parameter sets by kind and id; slices go on with the sets that they refer to;
* ``outputs``: a value with the counters of a stream and a list with its picture buffer; pictures go on in output order,
  as soon as bumping lets them, across micro-batches. What waits at the end goes out with a row that says so,
  or by a timer when a stream has been silent for long enough.

Between them slice headers are read by the same expressions as in a batch job.
Units of a stream must arrive in order over the micro-batches; within one they
are sorted. The state of a stream is bounded: sets by their ids, the buffer by
sixteen pictures.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from bitloom.functions import syntax as X
from bitloom.operators import dpb
from bitloom.plans import headers as H

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

SLICES = "stream_id string, at bigint, nal_ref_idc int, nal_unit_type int, rbsp binary, sps_rbsp binary, pps_rbsp binary"
PICTURES = "stream_id string, at bigint, frame_num bigint, poc bigint, is_idr boolean, is_ref boolean, long_term boolean, no_output boolean, commands array<struct<op:int,a:int,b:int>>, buffer_size int, max_frame_num bigint, max_references int, last boolean"
OUTPUT = "stream_id string, idr_period bigint, at bigint, poc bigint, output_idx bigint"


def _rows(frames: Iterator[pd.DataFrame]) -> pd.DataFrame:
    return pd.concat(list(frames)).sort_values("at", kind="stable")


def _ids(payload: bytes, table: list[X.Element], *names: str) -> list[int] | None:
    """Values of a payload's first elements; None if they can't be read."""
    vals: dict[str, int] = {}
    X._read("".join(f"{b:08b}" for b in payload[:64]), table[: 1 + max(i for i, e in enumerate(table) if e.name in names)], vals)
    return [vals[n] for n in names] if all(n in vals for n in names) else None


class ParameterSets(StatefulProcessor):
    """Units (stream_id, at, nal_ref_idc, nal_unit_type, rbsp) in, slices with their sets out."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.sets = handle.getMapState("sets", "kind int, id int", "rbsp binary")

    def _set(self, kind: int, number: int | None) -> bytes | None:
        if number is None or not self.sets.containsKey((kind, number)):
            return None
        return bytes(self.sets.getValue((kind, number))[0])

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        out = []
        for r in _rows(rows).itertuples(index=False):
            payload = bytes(r.rbsp) if r.rbsp is not None else b""
            if r.nal_unit_type in (7, 8):
                ids = _ids(payload, X.SPS if r.nal_unit_type == 7 else X.PPS, "sps_id" if r.nal_unit_type == 7 else "pps_id")
                if ids:
                    self.sets.updateValue((int(r.nal_unit_type), ids[0]), (payload,))
            elif r.nal_unit_type in (1, 5):
                ids = _ids(payload, X.SLICE_START, "pps_id")
                pps = self._set(8, ids[0] if ids else None)
                ids = _ids(pps, X.PPS, "sps_id") if pps else None
                out.append((key[0], r.at, r.nal_ref_idc, r.nal_unit_type, payload, self._set(7, ids[0] if ids else None), pps))
        yield pd.DataFrame(out, columns=["stream_id", "at", "nal_ref_idc", "nal_unit_type", "rbsp", "sps_rbsp", "pps_rbsp"])

    def close(self) -> None:
        pass


def slices(units: DataFrame) -> DataFrame:
    """A stream of units (stream_id, at, nal_ref_idc, nal_unit_type, rbsp) as a stream of slices with sps_rbsp and pps_rbsp: the newest sets of their ids so far, null where there is none."""
    rows = units.select(F.col("stream_id").cast("string").alias("stream_id"), F.col("at").cast("long").alias("at"), F.col("nal_ref_idc").cast("int").alias("nal_ref_idc"), F.col("nal_unit_type").cast("int").alias("nal_unit_type"), "rbsp")
    return rows.groupBy("stream_id").transformWithStateInPandas(ParameterSets(), SLICES, "append", "none")


class PictureBuffer(StatefulProcessor):
    """Pictures in coding order in, pictures in output order out."""

    def __init__(self, silence_ms: int | None):
        self.silence_ms = silence_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.counters = handle.getValueState("counters", "idr_period bigint, output_idx bigint, size int, max_frame_num bigint, max_references int")
        self.pictures = handle.getListState("pictures", "at bigint, frame_num bigint, poc bigint, is_ref boolean, long_term int, waiting boolean")

    def _load(self) -> tuple[list, dpb.Buffer]:
        period, number, size, most, references = self.counters.get() if self.counters.exists() else (0, 0, 1, 1, 1)
        held = [dpb.Picture(p[0], p[1], p[2], p[3], None if p[4] < 0 else p[4], p[5]) for p in self.pictures.get()] if self.pictures.exists() else []
        return [period, number], dpb.Buffer(size, most, references, held)

    def _store(self, counters: list, buffer: dpb.Buffer) -> None:
        self.counters.update((*map(int, counters), int(buffer.size), int(buffer.max_frame_num), int(buffer.references)))
        if buffer.pictures:
            self.pictures.put([(int(p.at), int(p.frame_num), int(p.poc), bool(p.is_ref), -1 if p.long_term is None else int(p.long_term), bool(p.waiting)) for p in buffer.pictures])
        else:
            self.pictures.clear()

    @staticmethod
    def _told(stream: str, counters: list, put_out: list[tuple[int, int]], period: int) -> list[tuple]:
        rows = [(stream, period, at, poc, counters[1] + i) for i, (at, poc) in enumerate(put_out)]
        counters[1] += len(put_out)
        return rows

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        counters, buffer = self._load()
        out = []
        for r in _rows(rows).itertuples(index=False):
            if r.at is not None and not pd.isna(r.at) and not r.last:
                counts = {p.at: p.poc for p in buffer.pictures}
                before = counters[0]
                if r.is_idr:
                    counters[0] += 1
                    put = buffer.put(dpb.Picture(r.at, r.frame_num, r.poc, bool(r.is_ref)), None, idr=True, no_output=bool(r.no_output), long_term=bool(r.long_term))
                    buffer.size, buffer.max_frame_num, buffer.references = int(r.buffer_size), int(r.max_frame_num), int(r.max_references)
                else:
                    commands = [(c["op"], c["a"], c["b"]) for c in r.commands] if r.commands is not None else []
                    put = buffer.put(dpb.Picture(r.at, r.frame_num, r.poc, bool(r.is_ref)), commands)
                out += self._told(key[0], counters, [(at, counts[at]) for at in put], before)
            else:
                out += self._flush(key[0], counters, buffer)
        if self.silence_ms is not None:
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            if buffer.pictures:
                self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.silence_ms)
        self._store(counters, buffer)
        yield self._frame(out)

    def _flush(self, stream: str, counters: list, buffer: dpb.Buffer) -> list[tuple]:
        counts = {p.at: p.poc for p in buffer.pictures}
        return self._told(stream, counters, [(at, counts[at]) for at in buffer.flush()], counters[0])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        counters, buffer = self._load()
        out = self._flush(key[0], counters, buffer)
        self._store(counters, buffer)
        yield self._frame(out)

    @staticmethod
    def _frame(out: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame(out, columns=["stream_id", "idr_period", "at", "poc", "output_idx"])

    def close(self) -> None:
        pass


def outputs(pictures: DataFrame, silence_ms: int | None = None) -> DataFrame:
    """A stream of pictures in coding order (``PICTURES``) as a stream of pictures in output order (``OUTPUT``).

    An IDR picture brings the size of the buffer, and puts out or, with
    no_output, drops what waits. A row with ``last`` ends its stream for now: all
    that waits goes out, and so it does when nothing has come for
    ``silence_ms``; later pictures then find an empty buffer. Timers keep a
    query running, so with ``silence_ms`` it is not for a trigger that ends by itself. output_idx counts
    a stream's pictures from 0. Pictures before a stream's first IDR picture
    meet a buffer of one.
    """
    return pictures.select(*(c.split()[0] for c in PICTURES.split(", "))).groupBy("stream_id").transformWithStateInPandas(PictureBuffer(silence_ms), OUTPUT, "append", "none" if silence_ms is None else "processingTime")
