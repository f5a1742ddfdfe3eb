"""Structured Streaming over byte streams: splitting chunks with state, and decoding what has arrived."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from bitloom.plans import pcm

UNITS = "stream_id string, nal_idx bigint, nal binary"
#: Unfinished unit, number of the next unit, and whether a start code was seen.
STATE = "rest binary, next bigint, started boolean"


def split_chunk(rest: bytes, started: bool, chunk: bytes, end: bool) -> tuple[list[bytes], bytes, bool]:
    """Units that are complete after ``chunk``, the bytes that are left and whether a start code was seen."""
    data, units = rest + chunk, []
    while True:
        at = data.find(b"\x00\x00\x01")
        if at < 0:
            break
        unit = data[:at].rstrip(b"\x00")
        if started and unit:
            units.append(unit)
        started, data = True, data[at + 3 :]
    if end:
        unit = data.rstrip(b"\x00")
        if started and unit:
            units.append(unit)
        return units, b"", False
    # Before the first start code only what may begin one is kept.
    return units, data if started else data[-2:], started


def _fold(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    rest, number, started = state.get if state.exists else (b"", 0, False)
    rows = pd.concat(list(frames)).sort_values("seq")
    out = []
    for data, last in zip(rows["data"], rows["last"]):
        units, rest, started = split_chunk(bytes(rest), started, bytes(data) if data is not None else b"", bool(last))
        out += units
    state.update((bytes(rest), number + len(out), started))
    yield pd.DataFrame({"stream_id": [key[0]] * len(out), "nal_idx": range(number, number + len(out)), "nal": out})


def nal_stream(chunks: DataFrame) -> DataFrame:
    """A stream of (stream_id, seq, data, last) as a stream of units (stream_id, nal_idx, nal).

    Chunks of a stream must arrive in order over the micro-batches; within one
    they are sorted. The state is the unit that is not complete yet.
    """
    rows = chunks.select(F.col("stream_id").cast("string").alias("stream_id"), "seq", "data", "last")
    return rows.groupBy("stream_id").applyInPandasWithState(_fold, UNITS, STATE, "append", GroupStateTimeout.NoTimeout)


def decode_stream(streams: DataFrame, out: str, checkpoint: str):
    """Decode each micro-batch of whole streams (stream_id, content) and append its plane sums to ``out``; returns the running query.

    A batch is written below its own number, so one that is repeated after a failure replaces itself.
    """

    def write(batch: DataFrame, number: int) -> None:
        pcm.plane_sums(pcm.decode(batch)).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return streams.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
