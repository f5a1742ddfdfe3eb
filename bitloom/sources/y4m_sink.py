"""A sink for frames as YUV4MPEG2 parts, committed together.

Each task writes runs of a stream's frames as parts below a staging folder; the
part with a stream's first frame begins with the file's header, so the parts of
a stream one after the other are its file (``y4m.files``), which never is in one
row or task. The driver moves the parts to their names when all tasks are done, and a job that
fails leaves none. What an attempt wrote that didn't count goes with the staging folder.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import quote

from pyspark.sql import DataFrame
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from bitloom.sources.y4m import RATE

NAME = "y4m_parts"
#: Frames of a part at most.
FRAMES = 256


@dataclass
class Parts(WriterCommitMessage):
    """(staged path, final path) of a task's parts."""

    moves: list[tuple[str, str]]


def _files(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path if "://" in path else f"file://{path}")


class Writer(DataSourceArrowWriter):
    def __init__(self, path: str, frames: int):
        self.path, self.frames = path.rstrip("/"), frames
        self.staging = f"_staging-{uuid.uuid4().hex}"

    def write(self, batches: Iterator) -> Parts:
        files, root = _files(self.path)
        own = f"{root}/{self.staging}/{uuid.uuid4().hex}"
        moves, out, last, written = [], None, None, 0
        try:
            for batch in batches:
                for stream, number, width, height, *planes in zip(*(batch.column(c).to_pylist() for c in ("stream_id", "frame_idx", "width", "height", "y", "u", "v"))):
                    if out is None or last != (stream, number - 1) or written == self.frames:
                        if out is not None:
                            out.close()
                        folder, name = f"stream_id={quote(str(stream), safe='')}", f"part-{number:010d}.y4m"
                        files.create_dir(f"{own}/{folder}")
                        out, written = files.open_output_stream(f"{own}/{folder}/{name}"), 0
                        moves.append((f"{own}/{folder}/{name}", f"{root}/{folder}/{name}"))
                        if number == 0:
                            out.write(f"YUV4MPEG2 W{width} H{height} F{RATE} Ip C420\n".encode())
                    out.write(b"FRAME\n" + b"".join(planes))
                    last, written = (stream, number), written + 1
        finally:
            if out is not None:
                out.close()
        return Parts(moves)

    def commit(self, messages: list[Parts | None]) -> None:
        files, root = _files(self.path)
        for message in messages:
            for staged, final in message.moves if message else ():
                files.create_dir(final.rsplit("/", 1)[0])
                files.move(staged, final)
        files.create_dir(root)
        with files.open_output_stream(f"{root}/_SUCCESS"):
            pass
        self._clear(files, root)

    def abort(self, messages: list[Parts | None]) -> None:
        self._clear(*_files(self.path))

    def _clear(self, files, root: str) -> None:
        from pyarrow import fs

        if files.get_file_info(f"{root}/{self.staging}").type == fs.FileType.Directory:
            files.delete_dir(f"{root}/{self.staging}")


class Y4MParts(DataSource):
    """Frames (stream_id, frame_idx, width, height, y, u, v) to a folder; options path and frames."""

    @classmethod
    def name(cls) -> str:
        return NAME

    def writer(self, schema, overwrite: bool) -> Writer:
        if overwrite:
            raise ValueError("parts are appended; name a new folder")
        return Writer(self.options["path"], int(self.options.get("frames", FRAMES)))


def write(frames: DataFrame, path: str, most: int = FRAMES) -> None:
    """Writes ``frames`` (``y4m.planes``) as parts of at most ``most`` frames in a folder for each stream, ``stream_id=name``.

    Numbers are unique in a stream; a gap begins a new part; frames without a number are left out. An empty table gives no parts.
    """
    frames.sparkSession.dataSource.register(Y4MParts)
    columns = ("stream_id", "frame_idx", "width", "height", "y", "u", "v")
    rows = frames.where("frame_idx is not null").select(*columns).repartitionByRange("stream_id", "frame_idx").sortWithinPartitions("stream_id", "frame_idx")
    rows.write.format(NAME).option("path", path).option("frames", most).mode("append").save()
