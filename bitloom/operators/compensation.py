"""Motion-compensated blocks from given reference pictures, by a join with the tiles that each block's window touches.

Pictures are rows of tiles (16 by 16 samples of luma, 8 by 8 of chroma). A
block's vector, and the samples that its interpolation needs around it, give a
window; with its coordinates clamped to the picture, which is what a vector
beyond the border means, it touches at most nine tiles for each of its two
references. Blocks are exploded to those tiles, slim rows without samples, and
meet them in one equi-join on (stream, picture, tile); a tile that many blocks
show is a key like any other of a join, which Spark splits where it is hot. A block's
tiles are grouped, eighteen at most, and whole Arrow batches of blocks of one
size and one fraction are interpolated and weighted at once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Samples before and after a block that its interpolation needs, and steps of a vector's sample, by the tile's width.
REACH = {16: (2, 3), 8: (0, 1)}
STEPS = {16: 4, 8: 8}
WEIGHTS = ("w0", "w1", "o0", "o1", "log_denominator")
_KEY = ["stream_id", "block_id"]


def _span(start: Column, size: Column, tile: int, edge: Column) -> Column:
    """Numbers of the tiles along one axis that a window from ``start`` on touches, clamped to 0 to ``edge`` - 1."""
    before, after = REACH[tile]

    def inside(v: Column) -> Column:
        return F.floor(F.greatest(F.lit(0), F.least(edge - 1, v)) / tile).cast("int")

    return F.sequence(inside(start - before), inside(start + size - 1 + after))


def _whole(v: Column, tile: int) -> Column:
    return F.floor(v / STEPS[tile]).cast("int")


def compensate(blocks: DataFrame, tiles: DataFrame, tile: int = 16) -> DataFrame:
    """stream_id, block_id, samples (row by row) of every block all of whose tiles are there.

    ``blocks`` has stream_id, block_id (one row each), width and height of the
    picture, x, y, w and h of the block, and for both lists the picture and the
    vector: ref0, x0, y0 and ref1, x1, y1, null where a list is not used. Vectors
    are in quarter samples of luma, or eighths of chroma, whose blocks and
    pictures are then given in chroma samples. With ``WEIGHTS`` (weights,
    offsets, logarithm of the denominator) that are not null a block is
    weighted, else one list is taken as it is and two are averaged.

    ``tiles`` has stream_id, picture_id, tx, ty and samples of ``tile`` by
    ``tile``. A block without a reference, with a null in its place or with a
    tile missing is left out; a repeated tile counts once. Other columns are not looked at.
    """
    weights = [F.col(c).cast("int").alias(c) if c in blocks.columns else F.lit(None).cast("int").alias(c) for c in WEIGHTS]
    lists = F.filter(F.array(*(F.struct(F.lit(i).alias("list"), F.col(f"ref{i}").cast("long").alias("picture_id"), F.col(f"x{i}").cast("int").alias("vx"), F.col(f"y{i}").cast("int").alias("vy")) for i in (0, 1))), lambda r: r["picture_id"].isNotNull())
    place = [F.col(c).cast("int").alias(c) for c in ("width", "height", "x", "y", "w", "h")]
    def across(r: Column) -> Column:
        return _span(F.col("x") + _whole(r["vx"], tile), F.col("w"), tile, F.col("width"))

    def down(r: Column) -> Column:
        return _span(F.col("y") + _whole(r["vy"], tile), F.col("h"), tile, F.col("height"))

    shown = blocks.select("stream_id", "block_id", *place, *weights, lists.alias("lists"))
    shown = shown.withColumn("need", F.aggregate("lists", F.lit(0), lambda n, r: n + F.size(across(r)) * F.size(down(r))))
    shown = shown.withColumn("r", F.explode("lists")).withColumn("tx", F.explode(across(F.col("r")))).withColumn("ty", F.explode(down(F.col("r"))))
    shown = shown.select(*(c for c in shown.columns if c not in ("lists", "r")), "r.*")
    own = tiles.select("stream_id", F.col("picture_id").cast("long").alias("picture_id"), F.col("tx").cast("int").alias("tx"), F.col("ty").cast("int").alias("ty"), F.col("samples").alias("tile")).dropDuplicates(["stream_id", "picture_id", "tx", "ty"])
    met = shown.join(own, ["stream_id", "picture_id", "tx", "ty"])
    fixed = [F.first(c).alias(c) for c in ("width", "height", "x", "y", "w", "h", *WEIGHTS)]
    grouped = met.groupBy(*_KEY).agg(*fixed, F.collect_list(F.struct("list", "vx", "vy", "tx", "ty", "tile")).alias("seen"), F.first("need").alias("need"))
    grouped = grouped.where(F.size("seen") == F.col("need")).drop("need")
    wanted = blocks.schema["stream_id"], blocks.schema["block_id"]
    kind = f"stream_id {wanted[0].dataType.simpleString()}, block_id {wanted[1].dataType.simpleString()}, samples binary"
    return grouped.mapInArrow(_interpolate(tile), kind)


def window(seen: list[dict], width: int, height: int, x: int, y: int, w: int, h: int, tile: int) -> np.ndarray:
    """The samples around a block of one list, from the tiles that it touches."""
    before, after = REACH[tile]
    vx, vy = seen[0]["vx"] // STEPS[tile], seen[0]["vy"] // STEPS[tile]
    columns = np.clip(np.arange(x + vx - before, x + vx + w + after), 0, width - 1)
    rows = np.clip(np.arange(y + vy - before, y + vy + h + after), 0, height - 1)
    tx, ty = columns[0] // tile, rows[0] // tile
    canvas = np.zeros(((rows[-1] // tile - ty + 1) * tile, (columns[-1] // tile - tx + 1) * tile), np.uint8)
    for t in seen:
        top, left = (t["ty"] - ty) * tile, (t["tx"] - tx) * tile
        canvas[top : top + tile, left : left + tile] = np.frombuffer(t["tile"], np.uint8, tile * tile).reshape(tile, tile)
    return canvas[np.ix_(rows - ty * tile, columns - tx * tile)]


def _tap(a: np.ndarray, axis: int) -> np.ndarray:
    n = a.shape[axis] - 5
    s = [a.take(range(i, i + n), axis) for i in range(6)]
    return s[0] + s[5] - 5 * (s[1] + s[4]) + 20 * (s[2] + s[3])


def luma(windows: np.ndarray, fx: int, fy: int) -> np.ndarray:
    """Blocks at a quarter-sample fraction from windows (n, h + 5, w + 5) of whole samples."""
    s = windows.astype(np.int32)
    h, w = s.shape[1] - 5, s.shape[2] - 5

    def half(v: np.ndarray) -> np.ndarray:
        return np.clip((v + 16) >> 5, 0, 255)

    def across(row: int) -> np.ndarray:
        return half(_tap(s[:, 2 + row : 2 + row + h], 2))

    def down(column: int) -> np.ndarray:
        return half(_tap(s[:, :, 2 + column : 2 + column + w], 1))

    def at(row: int, column: int) -> np.ndarray:
        return s[:, 2 + row : 2 + row + h, 2 + column : 2 + column + w]

    if not fx and not fy:
        return at(0, 0)
    centre = np.clip((_tap(_tap(s, 2), 1) + 512) >> 10, 0, 255) if fx == 2 and fy or fy == 2 and fx else None
    if fx == 2 and fy == 2:
        return centre
    # The nearest half or whole samples on either side of the fraction, or the one that it is.
    if not fy:
        pair = [across(0)] + ([at(0, fx // 2)] if fx != 2 else [])
    elif not fx:
        pair = [down(0)] + ([at(fy // 2, 0)] if fy != 2 else [])
    elif fx == 2:
        pair = [centre, across(fy // 2)]
    elif fy == 2:
        pair = [centre, down(fx // 2)]
    else:
        pair = [across(fy // 2), down(fx // 2)]
    return pair[0] if len(pair) == 1 else (pair[0] + pair[1] + 1) >> 1


def chroma(windows: np.ndarray, fx: int, fy: int) -> np.ndarray:
    """Blocks at a fraction in eighths from windows (n, h + 1, w + 1)."""
    s = windows.astype(np.int32)
    top = (8 - fx) * s[:, :-1, :-1] + fx * s[:, :-1, 1:]
    below = (8 - fx) * s[:, 1:, :-1] + fx * s[:, 1:, 1:]
    return ((8 - fy) * top + fy * below + 32) >> 6


def weighted(one: np.ndarray, other: np.ndarray | None, weights: tuple) -> np.ndarray:
    """One or two predictions with weights (w0, w1, o0, o1, logarithm of the denominator), a prediction of list 1 alone having w1 and o1; nulls stand for none."""
    w0, w1, o0, o1, log = weights
    if log is None:
        return one if other is None else (one + other + 1) >> 1
    if other is None:
        return np.clip(((one * w0 + (1 << log >> 1)) >> log) + o0, 0, 255)
    return np.clip(((one * w0 + other * w1 + (1 << log)) >> log + 1) + ((o0 + o1 + 1) >> 1), 0, 255)


def _interpolate(tile: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.to_pylist()
            alike: dict[tuple, list] = {}
            for i, r in enumerate(rows):
                for no in (0, 1):
                    seen = [t for t in r["seen"] if t["list"] == no]
                    if seen:
                        key = r["w"], r["h"], seen[0]["vx"] % STEPS[tile], seen[0]["vy"] % STEPS[tile]
                        alike.setdefault(key, []).append((i, no, window(seen, r["width"], r["height"], r["x"], r["y"], r["w"], r["h"], tile)))
            made: list[dict[int, np.ndarray]] = [{} for _ in rows]
            for (_, _, fx, fy), own in alike.items():
                blocks = (luma if tile == 16 else chroma)(np.stack([x for _, _, x in own]), fx, fy)
                for (i, no, _), block in zip(own, blocks):
                    made[i][no] = block
            out = []
            for r, lists in zip(rows, made):
                w0, w1, o0, o1, log = (r[c] for c in WEIGHTS)
                weights = (w0, w1, o0, o1, log) if 0 in lists else (w1, w0, o1, o0, log)
                one, other = (lists[0], lists.get(1)) if 0 in lists else (lists[1], None)
                out.append(weighted(one, other, weights).astype(np.uint8).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.binary())], names=["stream_id", "block_id", "samples"])

    return run
