"""The decoded picture buffer of one IDR period as a small state machine, and its grouped application.

Everything that ordering by count cannot say is here: marking commands,
long-term references and output by bumping with a limited buffer. Periods are
dealt over the tasks and sorted, and one fold runs over all of a task's periods
as their rows come, with a state of at most the buffer's sixteen pictures.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


@dataclass
class Picture:
    at: int
    frame_num: int
    poc: int
    is_ref: bool
    long_term: int | None = None
    waiting: bool = True  # for output


@dataclass
class Buffer:
    """``put`` takes a picture with its marking and tells which pictures (by ``at``) are output before it is stored."""

    size: int
    max_frame_num: int
    references: int
    pictures: list[Picture] = field(default_factory=list)

    def _drop_dead(self) -> None:
        self.pictures = [p for p in self.pictures if p.waiting or p.is_ref]

    def _bump(self) -> int | None:
        waiting = [p for p in self.pictures if p.waiting]
        if not waiting:
            return None
        first = min(waiting, key=lambda p: p.poc)
        first.waiting = False
        self._drop_dead()
        return first.at

    def flush(self) -> list[int]:
        out = [p.at for p in sorted((p for p in self.pictures if p.waiting), key=lambda p: p.poc)]
        self.pictures = []
        return out

    def _short(self, number: int, current: int) -> Picture | None:
        for p in self.pictures:
            if p.is_ref and p.long_term is None and (p.frame_num - self.max_frame_num if p.frame_num > current else p.frame_num) == number:
                return p
        return None

    def _free_long(self, index: int, keep: Picture | None = None) -> None:
        for p in self.pictures:
            if p.is_ref and p.long_term == index and p is not keep:
                p.is_ref, p.long_term = False, None

    def _mark(self, picture: Picture, commands: list[tuple[int, int, int]]) -> list[int]:
        """Marking commands (op, a, b): a is a difference of picture numbers or an index, b the index of op 3."""
        out: list[int] = []
        for op, a, b in commands:
            short = self._short(picture.frame_num - a - 1, picture.frame_num) if op in (1, 3) else None
            if op == 1 and short:
                short.is_ref = False
            elif op == 2:
                self._free_long(a)
            elif op == 3 and short:
                self._free_long(b, short)
                short.long_term = b
            elif op == 4:
                for p in self.pictures:
                    if p.long_term is not None and p.long_term >= a:
                        p.is_ref, p.long_term = False, None
            elif op == 5:
                out += self.flush()
                picture.frame_num = picture.poc = 0
            elif op == 6:
                self._free_long(a)
                picture.long_term = a
        return out

    def _slide(self) -> None:
        marked = [p for p in self.pictures if p.is_ref]
        if len(marked) >= max(1, self.references):
            oldest = next((p for p in marked if p.long_term is None), None)
            if oldest:
                oldest.is_ref = False

    def put(self, picture: Picture, commands: list[tuple[int, int, int]] | None = None, idr: bool = False, no_output: bool = False, long_term: bool = False) -> list[int]:
        out: list[int] = []
        if idr:
            if not no_output:
                out += self.flush()
            self.pictures = []
            picture.long_term = 0 if long_term else None
        elif picture.is_ref and commands:
            out += self._mark(picture, commands)
        elif picture.is_ref:
            self._slide()
        self._drop_dead()
        while len(self.pictures) >= self.size:
            bumped = self._bump()
            if bumped is None:
                break
            out.append(bumped)
        self.pictures.append(picture)
        return out


def bump_order(pics: DataFrame, size: int, max_frame_num: int, references: int) -> DataFrame:
    """(stream_id, idr_period, at, frame_num, poc, is_ref, commands array<struct<op,a,b>>) -> stream_id, idr_period, at, bump_idx: each picture's place in the output of its period.

    The buffer is that of the standard's bumping with ``size`` pictures; a
    stream that needs more reordering than it holds comes out late, as there.
    The first picture of a period is its IDR picture; with a column long_term
    that is true there it is kept as long-term 0. With a column no_output that
    is true at the next period's first picture (given here on the last row of
    a period), what is still waiting is not put out. Ids are of any type.
    """

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, buffer, place, drops, kinds = None, None, 0, False, None

        def told(out: list[tuple]) -> pa.RecordBatch:
            columns = zip(*out) if out else ((), (), (), ())
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["stream_id", "idr_period", "at", "bump_idx"])

        for batch in batches:
            kinds = [*(batch.schema.field(i).type for i in range(3)), pa.int32()]
            out: list[tuple] = []
            for stream, period, at, frame_num, poc, is_ref, commands, long_term, no_output in zip(*(c.to_pylist() for c in batch.columns)):
                first = (stream, period) != key
                if first:
                    if buffer and not drops:
                        out += [(*key, p, place + i) for i, p in enumerate(buffer.flush())]
                    key, buffer, place = (stream, period), Buffer(size, max_frame_num, references), 0
                put = buffer.put(Picture(at, frame_num, poc, bool(is_ref)), [(c["op"], c["a"], c["b"]) for c in commands or ()], idr=first, long_term=long_term)
                out += [(*key, p, place + i) for i, p in enumerate(put)]
                place, drops = place + len(put), no_output
            yield told(out)
        if buffer and not drops:
            yield told([(*key, p, place + i) for i, p in enumerate(buffer.flush())])

    columns = ("stream_id", "idr_period", "at", "frame_num", "poc", "is_ref", "commands")
    flags = (F.coalesce(F.col(c), F.lit(False)).alias(c) if c in pics.columns else F.lit(False).alias(c) for c in ("long_term", "no_output"))
    kind = T.StructType([*(pics.schema[c] for c in ("stream_id", "idr_period", "at")), T.StructField("bump_idx", T.IntegerType())])
    rows = pics.select(*columns, *flags).repartition("stream_id", "idr_period").sortWithinPartitions("stream_id", "idr_period", "at")
    return rows.mapInArrow(fold, kind)
