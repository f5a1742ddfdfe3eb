"""Registered queries on motion across blocks, boundary strengths, codes of zeros and context increments, with their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from bitloom.operators import bitmaps, colocated, compensation, frames, motion, wavefront
from bitloom.operators import coefficients as K
from bitloom.operators import macroblocks as M
from bitloom.plans.catalog import joined, table
from bitloom.plans import sequence as S
from bitloom.plans import stream_catalog
from bitloom.plans.stream_catalog import query

KEY = "l_orderkey * 8 + l_linenumber AS key"


@query("""SELECT key, (CASE WHEN intra OR r NOT IN (0, 4, 8, 12) THEN 0 ELSE r // 4 END)::BIGINT AS ref0, (CASE WHEN intra THEN 0 ELSE sx END)::BIGINT AS x0, (CASE WHEN intra THEN 0 ELSE sy END)::BIGINT AS y0,
  (CASE WHEN intra OR td = 0 THEN 0 ELSE sx - x END)::BIGINT AS x1, (CASE WHEN intra OR td = 0 THEN 0 ELSE sy - y END)::BIGINT AS y1
FROM (SELECT *, CASE WHEN td = 0 THEN x ELSE floor((scale * x + 128) / 256) END AS sx, CASE WHEN td = 0 THEN y ELSE floor((scale * y + 128) / 256) END AS sy
FROM (SELECT *, greatest(-1024, least(1023, floor((tb * trunc((16384 + abs(td) // 2) / td) + 32) / 64))) AS scale
FROM (SELECT *, greatest(-128, least(127, c - r)) AS td, greatest(-128, least(127, now - r)) AS tb
FROM (SELECT l_orderkey * 8 + l_linenumber AS key, l_orderkey % 6 = 0 AS intra, l_partkey % 201 - 100 AS x, l_suppkey % 101 - 50 AS y, l_suppkey % 9 * 2 AS r, l_linenumber * 3 AS c, l_orderkey % 40 AS now FROM lineitem))))""")
def temporal_direct(spark, sf_dir):
    """References and vectors of blocks in temporal direct mode from their colocated blocks."""
    o, p, s = (F.col(c) for c in ("l_orderkey", "l_partkey", "l_suppkey"))
    list0 = F.array(*(F.lit(n).cast("long") for n in (0, 4, 8, 12)))
    made = motion.temporal_direct(o % 6 == 0, p % 201 - 100, s % 101 - 50, s % 9 * 2, F.col("l_linenumber").cast("long") * 3, o % 40, list0)
    return table(spark, sf_dir, "lineitem").select(F.expr(KEY), made.alias("d")).select("key", "d.*")


# Pictures of 16 by 16 blocks, one for each supplier, with gaps; two slices above each other.
_SQL_BLOCKS = """(SELECT *, "by" // 8 AS slice_id, "by" * 16 + bx AS place, a % 5 = 0 AS intra, a % 7 = 0 AS coded, CASE WHEN a % 4 > 0 THEN a % 2 END AS ref0, CASE WHEN b % 4 = 0 OR a % 4 = 0 THEN b % 2 END AS ref1,
  a % 8 AS x0, b % 8 AS y0, b % 6 AS x1, a % 6 AS y1
  FROM (SELECT l_suppkey AS stream_id, 0 AS picture_id, l_partkey % 16 AS bx, l_orderkey % 16 AS "by", max(l_orderkey) AS a, max(l_partkey) AS b FROM lineitem GROUP BY ALL))"""


def _blocks(spark, sf_dir):
    # Not a constant: that would be left out of the windows' partitions but not of the shuffle's, and the blocks be shuffled again.
    picture = (F.col("l_suppkey") * 0).cast("int").alias("picture_id")
    rows = table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("stream_id"), picture, (F.col("l_partkey") % 16).alias("bx"), (F.col("l_orderkey") % 16).alias("by"))
    rows = rows.agg(F.max("l_orderkey").alias("a"), F.max("l_partkey").alias("b"))
    a, b, by = F.col("a"), F.col("b"), F.col("by")
    refs = {"ref0": F.when(a % 4 > 0, a % 2), "ref1": F.when((b % 4 == 0) | (a % 4 == 0), b % 2)}
    return rows.withColumns({"slice_id": F.floor(by / 8), "place": by * 16 + F.col("bx"), "intra": a % 5 == 0, "coded": a % 7 == 0, **refs, "x0": a % 8, "y0": b % 8, "x1": b % 6, "y1": a % 6})


@query(f"""WITH blocks AS (SELECT * FROM {_SQL_BLOCKS})
SELECT w.stream_id, w.x, w.y, (CASE WHEN n.intra THEN -1 ELSE n.ref0 END)::BIGINT AS ref0, (CASE WHEN n.intra THEN 0 ELSE n.x0 END)::BIGINT AS x0, (CASE WHEN n.intra THEN 0 ELSE n.y0 END)::BIGINT AS y0
FROM (SELECT *, bx * 4 + a % 9 - 4 AS x, "by" * 4 + b % 9 - 4 AS y FROM blocks) w
LEFT JOIN blocks n ON n.stream_id = w.stream_id AND n.bx = floor(w.x / 4) AND n."by" = floor(w.y / 4) AND n.slice_id = w.slice_id AND n.place < w.place""")
def motion_at(spark, sf_dir):
    """The motion at a sample up to a block away, as the neighbours of vector prediction are looked up."""
    blocks = _blocks(spark, sf_dir)
    wanted = blocks.select("stream_id", "picture_id", "slice_id", "place", (F.col("bx") * 4 + F.col("a") % 9 - 4).alias("x"), (F.col("by") * 4 + F.col("b") % 9 - 4).alias("y"))
    return motion.motion_at(wanted, blocks).select("stream_id", "x", "y", "ref0", "x0", "y0")


def _sql_alike(a: int, b: int) -> str:
    return f"(p.ref{a} IS NOT DISTINCT FROM q.ref{b} AND (p.ref{a} IS NULL OR (abs(p.x{a} - q.x{b}) < 4 AND abs(p.y{a} - q.y{b}) < 4)))"


_SQL_BS = f"""CASE WHEN p.stream_id IS NULL THEN NULL WHEN (p.intra OR q.intra) AND q.{{0}} % 4 = 0 THEN 4 WHEN p.intra OR q.intra THEN 3 WHEN p.coded OR q.coded THEN 2
  WHEN ({_sql_alike(0, 0)} AND {_sql_alike(1, 1)}) OR ({_sql_alike(0, 1)} AND {_sql_alike(1, 0)}) THEN 0 ELSE 1 END"""
_SQL_SIDE = f'(SELECT q.stream_id, q.bx, q."by", {_SQL_BS} AS bs FROM blocks q LEFT JOIN blocks p ON p.stream_id = q.stream_id AND {{1}})'


@query(f"""WITH blocks AS (SELECT * FROM {_SQL_BLOCKS})
SELECT l.stream_id, l.bx, l."by", l.bs::BIGINT AS left_bs, t.bs::BIGINT AS top_bs
FROM {_SQL_SIDE.format("bx", 'p.bx = q.bx - 1 AND p."by" = q."by"')} l JOIN {_SQL_SIDE.format('"by"', 'p."by" = q."by" - 1 AND p.bx = q.bx')} t USING (stream_id, bx, "by")""")
def edge_strengths(spark, sf_dir):
    """Boundary strengths of the left and upper edge of every block, from coefficients, pictures and vectors on both sides."""
    made = motion.edge_strengths(_blocks(spark, sf_dir))
    return made.select("stream_id", "bx", "by", F.col("left_bs").cast("long").alias("left_bs"), F.col("top_bs").cast("long").alias("top_bs"))


_SQL_LARGE = _SQL_SIDE.replace("AS bs FROM", "AS raw, q.large FROM")


@query(f"""WITH plain AS (SELECT *, (bx // 4 + "by" // 4 + stream_id) % 2 = 0 AS large FROM {_SQL_BLOCKS}),
eights AS (SELECT stream_id, bx // 2 AS ex, "by" // 2 AS ey, bool_or(coded) AS any_coded FROM plain GROUP BY ALL),
blocks AS (SELECT p.* EXCLUDE (coded), CASE WHEN large THEN any_coded ELSE coded END AS coded FROM plain p JOIN eights e ON e.stream_id = p.stream_id AND ex = bx // 2 AND ey = "by" // 2)
SELECT l.stream_id, l.bx, l."by", (CASE WHEN l.large AND l.bx % 2 = 1 AND l.raw IS NOT NULL THEN 0 ELSE l.raw END)::BIGINT AS left_bs, (CASE WHEN t.large AND t."by" % 2 = 1 AND t.raw IS NOT NULL THEN 0 ELSE t.raw END)::BIGINT AS top_bs
FROM {_SQL_LARGE.format("bx", 'p.bx = q.bx - 1 AND p."by" = q."by"')} l JOIN {_SQL_LARGE.format('"by"', 'p."by" = q."by" - 1 AND p.bx = q.bx')} t USING (stream_id, bx, "by")""")
def edge_strengths_8x8(spark, sf_dir):
    """Boundary strengths where every other macroblock has transforms of 8x8."""
    large = (F.floor(F.col("bx") / 4) + F.floor(F.col("by") / 4) + F.col("stream_id")) % 2 == 0
    made = motion.edge_strengths(_blocks(spark, sf_dir).withColumn("large", large))
    return made.select("stream_id", "bx", "by", F.col("left_bs").cast("long").alias("left_bs"), F.col("top_bs").cast("long").alias("top_bs"))


_SQL_CODES = ", ".join(f"({size}, {n}, '{code}', {zeros})" for size, codes in M.ZERO_CODES.items() for n, row in codes.items() for zeros, code in enumerate(row))
_SQL_BITS = "lpad(bin((l_orderkey * 7919 + l_partkey * 104729 + l_suppkey) % 4096), 12, '0')"


@query(f"""SELECT r.key, CASE WHEN r.n = r.size THEN 0 ELSE c.zeros END::BIGINT AS zeros, CASE WHEN r.n = r.size THEN 0 ELSE length(c.code) END::BIGINT AS length
FROM (SELECT l_orderkey * 8 + l_linenumber AS key, [16, 4, 8][l_linenumber % 3 + 1] AS size, l_suppkey % [16, 4, 8][l_linenumber % 3 + 1] + 1 AS n, substr({_SQL_BITS}, 6 - l_partkey % 5) AS ahead FROM lineitem) r
LEFT JOIN (VALUES {_SQL_CODES}) c(size, n, code, zeros) ON c.size = r.size AND c.n = r.n AND starts_with(r.ahead, c.code)""")
def zero_codes(spark, sf_dir):
    """Totals of zeros read at a place of a bit string; some codes are cut off by its end."""
    bits = F.lpad(F.bin((F.col("l_orderkey") * 7919 + F.col("l_partkey") * 104729 + F.col("l_suppkey")) % 4096), 12, "0")
    size = F.get(F.array(F.lit(16), F.lit(4), F.lit(8)), (F.col("l_linenumber") % 3).cast("int"))
    rows = table(spark, sf_dir, "lineitem").select(F.expr(KEY), size.alias("size"), (F.col("l_suppkey") % size + 1).cast("int").alias("coefficients"), bits.alias("bits"), (5 - F.col("l_partkey") % 5).cast("int").alias("pos"))
    return M.with_zeros(rows).select("key", F.col("total_zeros").cast("long").alias("zeros"), F.col("length").cast("long").alias("length"))


_SQL_BEFORE = "len(list_filter(c[1:i], lambda v: abs(v) {0}))"


@query(f"""SELECT key, array_to_string(list_transform(range(8), lambda i: (CASE WHEN {_SQL_BEFORE.format("> 1")} > 0 THEN 0 ELSE least(4, 1 + {_SQL_BEFORE.format("= 1")}) END)::INT), ',') AS first,
  array_to_string(list_transform(range(8), lambda i: (5 + least(4, {_SQL_BEFORE.format("> 1")}))::INT), ',') AS rest
FROM (SELECT l_orderkey * 8 + l_linenumber AS key, list_transform(range(8), lambda j: CASE WHEN (l_orderkey + j * l_suppkey) % 5 = 0 THEN 3 - j ELSE 1 - l_partkey % 2 * 2 END) AS c FROM lineitem)""")
def level_contexts(spark, sf_dir):
    """Context increments along the levels of a block."""
    levels = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda j: F.when((F.col("l_orderkey") + j * F.col("l_suppkey")) % 5 == 0, 3 - j).otherwise((1 - F.col("l_partkey") % 2 * 2).cast("int")))
    rows = table(spark, sf_dir, "lineitem").select(F.expr(KEY), M.level_increments(levels).alias("m"))
    return rows.select("key", joined(F.col("m.first")).alias("first"), joined(F.col("m.rest")).alias("rest"))


_SQL_BIT = "CASE WHEN ({0} >> {1}) & 1 = 0 THEN {2} ELSE 0 END"


@query(f"""SELECT key, concat_ws(',', {", ".join(f"({_SQL_BIT.format(a, i, 1)}) + ({_SQL_BIT.format(b, j, 2)})" for a, i, b, j in (("l", 1, "t", 2), ("o", 0, "t", 3), ("l", 3, "o", 0), ("o", 2, "o", 1)))}) AS luma,
  concat_ws(',', {", ".join(f"CASE WHEN lc >= {n} THEN 1 ELSE 0 END + CASE WHEN tc >= {n} THEN 2 ELSE 0 END + {4 * n - 4}" for n in (1, 2))}) AS chroma
FROM (SELECT l_orderkey * 8 + l_linenumber AS key, l_orderkey % 16 AS o, CASE WHEN l_partkey % 5 > 0 THEN l_partkey % 16 END AS l, CASE WHEN l_suppkey % 5 > 0 THEN l_suppkey % 16 END AS t,
  CASE WHEN l_partkey % 5 > 0 THEN l_partkey % 3 END AS lc, CASE WHEN l_suppkey % 5 > 0 THEN l_suppkey % 3 END AS tc FROM lineitem)""")
def pattern_contexts(spark, sf_dir):
    """Context increments of coded-block patterns, luma and chroma, with missing neighbours."""
    o, p, s = (F.col(c) for c in ("l_orderkey", "l_partkey", "l_suppkey"))
    luma = M.luma_pattern_increments((o % 16).cast("int"), F.when(p % 5 > 0, p % 16).cast("int"), F.when(s % 5 > 0, s % 16).cast("int"))
    chroma = M.chroma_pattern_increments(F.when(p % 5 > 0, p % 3), F.when(s % 5 > 0, s % 3))
    return table(spark, sf_dir, "lineitem").select(F.expr(KEY), joined(luma).alias("luma"), joined(chroma).alias("chroma"))


@query("""SELECT l_suppkey AS stream_id, l_linenumber AS frame_idx, m.plane AS plane, m.y AS y, m.x AS x, m.a AS decoded, m.b AS expected
FROM (SELECT l_suppkey, l_linenumber, min({'plane': l_partkey % 3, 'y': l_partkey, 'x': l_orderkey, 'a': a, 'b': b}) AS m
FROM (SELECT l_suppkey, l_linenumber, l_partkey, l_orderkey, max(l_quantity)::BIGINT AS a, CASE WHEN l_orderkey % 17 <> 0 THEN max(l_quantity)::BIGINT + (l_orderkey % 13 = 0)::BIGINT END AS b FROM lineitem GROUP BY 1, 2, 3, 4)
WHERE a IS DISTINCT FROM b GROUP BY 1, 2)""")
def first_difference(spark, sf_dir):
    """The first sample of each frame that differs or is missing on one side."""
    key = {"stream_id": "l_suppkey", "frame_idx": "l_linenumber", "plane": "l_partkey % 3", "y": "l_partkey", "x": "l_orderkey"}
    decoded = table(spark, sf_dir, "lineitem").select(*(F.expr(v).alias(k) for k, v in key.items()), F.col("l_quantity").cast("long").alias("sample"))
    expected = decoded.where("x % 17 <> 0").withColumn("sample", F.col("sample") + F.when(F.col("x") % 13 == 0, 1).otherwise(0))
    return frames.first_difference(decoded, expected)


_SQL_WORD = "lpad(bin((l_orderkey * 7919 + l_partkey * 104729 + l_suppkey * 15485863) % 1048576), 20, '0') || lpad(bin(l_partkey % 4096), 12, '0') || repeat('1', 20)"


def _sql_level(rows: str, no: int) -> str:
    """Reads level ``no`` (0 to 2) of rows with bits, ones, pos and suffix: a sign while no < ones, else a code."""
    first = f"(CASE WHEN {no} = ones AND ones < 3 THEN 2 ELSE 0 END)"
    sized = f"""(SELECT *, CASE WHEN {no} < ones THEN 0 WHEN zeros = 14 AND suffix = 0 THEN 4 WHEN zeros >= 15 THEN zeros - 3 ELSE suffix END AS size FROM (SELECT *, instr(substr(bits, pos + 1), '1') - 1 AS zeros FROM {rows}))"""
    value = "list_sum(list_transform(range(size), lambda j: substr(bits, pos + zeros + 2 + j, 1)::INT * 2 ** (size - 1 - j)))"
    code = f"(SELECT *, (least(15, zeros) * 2 ** suffix + coalesce({value}, 0) + CASE WHEN zeros >= 15 AND suffix = 0 THEN 15 ELSE 0 END + CASE WHEN zeros >= 16 THEN 2 ** (zeros - 3) - 4096 ELSE 0 END + {first})::BIGINT AS code FROM {sized})"
    level = f"CASE WHEN {no} < ones THEN 1 - 2 * substr(bits, pos + 1, 1)::INT WHEN code % 2 = 0 THEN (code + 2) / 2 ELSE -(code + 1) / 2 END::BIGINT"
    read = f"(SELECT * EXCLUDE (pos), pos + CASE WHEN {no} < ones THEN 1 ELSE zeros + 1 + size END AS pos, {level} AS v{no} FROM {code})"
    grown = f"CASE WHEN {no} < ones THEN suffix WHEN abs(v{no}) > 3 * 2 ** (greatest(suffix, 1) - 1) THEN greatest(suffix, 1) + 1 ELSE greatest(suffix, 1) END"
    return f"(SELECT * EXCLUDE (suffix, zeros, size, code), {grown} AS suffix FROM {read})"


_SQL_LEVELS = f"(SELECT l_orderkey * 8 + l_linenumber AS key, {_SQL_WORD} AS bits, l_linenumber % 4 AS ones, 0 AS pos, 0 AS suffix FROM lineitem)"
for _no in range(3):
    _SQL_LEVELS = _sql_level(_SQL_LEVELS, _no)


@query(f"SELECT key, CASE WHEN pos <= 52 THEN concat_ws(',', v0, v1, v2) END AS levels, CASE WHEN pos <= 52 THEN pos END::BIGINT AS pos FROM {_SQL_LEVELS}")
def level_codes(spark, sf_dir):
    """Three levels read from the start of bit strings, none to three of them ones."""
    parts = F.lpad(F.bin((F.col("l_orderkey") * 7919 + F.col("l_partkey") * 104729 + F.col("l_suppkey") * 15485863) % 1048576), 20, "0"), F.lpad(F.bin(F.col("l_partkey") % 4096), 12, "0")
    rows = table(spark, sf_dir, "lineitem").select(F.expr(KEY), F.concat(*parts, F.lit("1" * 20)).alias("bits"), (F.col("l_linenumber") % 4).alias("ones"))
    made = rows.select("key", K.levels(F.col("bits"), F.lit(0), F.lit(3), F.col("ones")).alias("m"))
    return made.select("key", joined(F.col("m.levels")).alias("levels"), F.col("m.pos").cast("long").alias("pos"))


# Blocks of seven sizes, one for each order, that show pictures of 128 by 64 samples, a tile for each part by its place among them, whatever their keys; vectors reach beyond all borders.
_SQL_SHOWN = """(SELECT o_orderkey AS block_id, (o_custkey % n)::BIGINT AS ref0, CASE WHEN o_orderkey % 3 = 0 THEN (o_orderkey % n)::BIGINT END AS ref1, (o_orderkey % 8 * 16)::INT AS x, (o_orderkey // 8 % 4 * 16)::INT AS y,
  ([16, 16, 8, 8, 8, 4, 4])[(o_orderkey % 7 + 1)::INT] AS w, ([16, 8, 16, 8, 4, 8, 4])[(o_orderkey % 7 + 1)::INT] AS h,
  (o_custkey % 701 - 350)::INT AS x0, (o_orderkey % 523 - 261)::INT AS y0, (o_custkey % 97 - 48)::INT AS x1, (o_orderkey % 89 - 44)::INT AS y1, o_orderkey % 5 = 0 AS weighs FROM orders, (SELECT count(*) // 32 AS n FROM part))"""
_SQL_GRID = ", ".join(
    f"((ref * 32 + (yy // 16) * 8 + xx // 16 + 1) * (yy % 16 + 3) + xx % 16 * 7 + (yy % 16) * (xx % 16)) % 256 AS g{i}{j}".replace("yy", f"greatest(0, least(63, iy + {i - 2}))").replace("xx", f"greatest(0, least(127, ix + {j - 2}))") for i in range(6) for j in range(6)
)


def _sql_six(v: list[str]) -> str:
    return f"({v[0]} - 5 * {v[1]} + 20 * {v[2]} + 20 * {v[3]} - 5 * {v[4]} + {v[5]})"


_CELLS = [[f"g{i}{j}" for j in range(6)] for i in range(6)]
_SQL_HALVES = ", ".join(
    f"greatest(0, least(255, ({v} + {r}) >> {s})) AS {k}"
    for k, v, r, s in (("b", _sql_six(_CELLS[2]), 16, 5), ("s", _sql_six(_CELLS[3]), 16, 5), ("h", _sql_six([r[2] for r in _CELLS]), 16, 5), ("m", _sql_six([r[3] for r in _CELLS]), 16, 5), ("j", _sql_six([_sql_six(r) for r in _CELLS]), 512, 10))
)
_SQL_PLACES = "[g22, (g22+b+1)>>1, b, (g23+b+1)>>1, (g22+h+1)>>1, (b+h+1)>>1, (b+j+1)>>1, (b+m+1)>>1, h, (h+j+1)>>1, j, (j+m+1)>>1, (g32+h+1)>>1, (h+s+1)>>1, (j+s+1)>>1, (m+s+1)>>1]"


def _numbered(parts: DataFrame) -> DataFrame:
    """number: the parts' places from 0 by ranges of keys, whose counts are one slim row a range."""
    ranged = parts.select("p_partkey", F.coalesce(F.floor(F.col("p_partkey") / 4096), F.lit(-1)).alias("range"))
    counts = ranged.groupBy("range").agg(F.count("*").alias("n"))
    firsts = counts.select("range", (F.sum("n").over(W.orderBy("range")) - F.col("n")).alias("first"))
    place = F.row_number().over(W.partitionBy("range").orderBy("p_partkey"))
    return ranged.select("range", (place - 1).alias("place")).join(firsts, "range").select((F.col("first") + F.col("place")).alias("number"))


@query(f"""WITH blocks AS {_SQL_SHOWN}, lists AS (
  SELECT block_id, 0 AS list, ref0 AS ref, x, y, w, h AS hh, x0 AS vx, y0 AS vy, weighs FROM blocks UNION ALL SELECT block_id, 1, ref1, x, y, w, h, x1, y1, weighs FROM blocks WHERE ref1 IS NOT NULL),
places AS (SELECT block_id, list, ref, i, weighs, (x + i % w + (vx >> 2))::BIGINT AS ix, (y + i // w + (vy >> 2))::BIGINT AS iy, (vy & 3) * 4 + (vx & 3) AS place FROM lists, range(256) t(i) WHERE i < w * hh),
halves AS (SELECT *, {_SQL_HALVES} FROM (SELECT *, {_SQL_GRID} FROM places)),
p AS (SELECT block_id, i, weighs, max(v) FILTER (list = 0) AS a, max(v) FILTER (list = 1) AS b FROM (SELECT *, ({_SQL_PLACES})[place + 1] AS v FROM halves) GROUP BY ALL)
SELECT 'parts' AS stream_id, block_id, md5(string_agg(printf('%02X', (CASE WHEN NOT weighs THEN CASE WHEN b IS NULL THEN a ELSE (a + b + 1) >> 1 END
  WHEN b IS NULL THEN greatest(0, least(255, ((a * 5 + 4) >> 3) - 3)) ELSE greatest(0, least(255, ((a * 5 + b * 4 + 8) >> 4) + 1)) END)::INT), '' ORDER BY i)) AS digest FROM p GROUP BY block_id""")
def motion_blocks(spark, sf_dir):
    """Blocks predicted from one or two reference pictures, a fifth of them weighted."""
    parts = table(spark, sf_dir, "part").select("p_partkey")
    number = F.col("number")
    cells = F.transform(F.sequence(F.lit(0), F.lit(255)), lambda i: F.lpad(F.hex((((number + 1) * (F.floor(i / 16) + 3) + i % 16 * 7 + F.floor(i / 16) * (i % 16)) % 256).cast("long")), 2, "0"))
    tiles = _numbered(parts).select(F.lit("parts").alias("stream_id"), F.floor(number / 32).alias("picture_id"), (number % 8).alias("tx"), F.floor(number % 32 / 8).alias("ty"), F.unhex(F.array_join(cells, "")).alias("samples"))
    n = parts.agg(F.floor(F.count("*") / 32).alias("n"))
    o, c, kind = F.col("o_orderkey"), F.col("o_custkey"), (F.col("o_orderkey") % 7 + 1).cast("int")
    sizes = {k: F.element_at(F.array(*map(F.lit, v)), kind) for k, v in (("w", (16, 16, 8, 8, 8, 4, 4)), ("h", (16, 8, 16, 8, 4, 8, 4)))}
    two, weighs = o % 3 == 0, o % 5 == 0
    blocks = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey").join(F.broadcast(n)).select(
        F.lit("parts").alias("stream_id"), o.alias("block_id"), F.lit(128).alias("width"), F.lit(64).alias("height"), (o % 8 * 16).alias("x"), (F.floor(o / 8) % 4 * 16).alias("y"), *(v.alias(k) for k, v in sizes.items()),
        (c % F.col("n")).alias("ref0"), F.when(two, o % F.col("n")).alias("ref1"), (c % 701 - 350).alias("x0"), (o % 523 - 261).alias("y0"), (c % 97 - 48).alias("x1"), (o % 89 - 44).alias("y1"),
        *(F.when(weighs, v).alias(k) for k, v in (("w0", 5), ("w1", 4), ("o0", -3), ("o1", 4), ("log_denominator", 3))),
    )
    return compensation.compensate(blocks, tiles).select("stream_id", "block_id", F.md5(F.hex("samples").cast("binary")).alias("digest"))


# From slices to vectors: every event is a picture of 16 blocks in two slices, whose second has the lists the other way round; every other picture is in direct mode.
_SQL_FIELD = f"""WITH {stream_catalog._STORES}, l AS (
  SELECT stream_id, at, list(ra ORDER BY CASE WHEN long_term THEN 2 WHEN rpoc <= poc THEN 0 ELSE 1 END, CASE WHEN long_term THEN ra % 16 WHEN rpoc <= poc THEN -rpoc ELSE rpoc END, ra) AS l0,
         list(ra ORDER BY CASE WHEN long_term THEN 2 WHEN rpoc <= poc THEN 1 ELSE 0 END, CASE WHEN long_term THEN ra % 16 WHEN rpoc <= poc THEN -rpoc ELSE rpoc END, ra) AS l1 FROM s GROUP BY 1, 2),
m AS (SELECT stream_id, at, l0, CASE WHEN l0 = l1 AND len(l1) > 1 THEN list_concat([l1[2], l1[1]], l1[3:]) ELSE l1 END AS l1 FROM l),
sl AS (SELECT pe.stream_id, pe.at, pe.is_ref, z.slice_id, pe.at * 7 % 101 AS poc, CASE WHEN z.slice_id = 0 THEN l0 ELSE l1 END AS a, CASE WHEN z.slice_id = 0 THEN l1 ELSE l0 END AS b FROM pe LEFT JOIN m USING (stream_id, at), range(2) z(slice_id)),
bl AS (SELECT sl.*, b.i % 4 AS bx, b.i // 4 AS byy, (at + i) % 5 = 0 AS intra, (at + i) % 4 - 1 AS ref0, (at * 3 + i) % 4 - 1 AS ref1, at * i % 201 - 100 AS x0, (at + 7 * i) % 101 - 50 AS y0, at * i % 151 - 75 AS x1, (at + 11 * i) % 71 - 35 AS y1
       FROM sl JOIN range(16) b(i) ON b.i // 8 = sl.slice_id),
f AS (SELECT stream_id, at AS shown, bx, byy, intra, poc AS count, CASE WHEN ref0 < 0 AND ref1 >= 0 THEN x1 ELSE x0 END AS x, CASE WHEN ref0 < 0 AND ref1 >= 0 THEN y1 ELSE y0 END AS y,
        coalesce((CASE WHEN ref0 < 0 AND ref1 >= 0 THEN b[ref1 + 1] ELSE a[greatest(ref0, 0) + 1] END) * 7 % 101, poc) AS r FROM bl WHERE is_ref),
w AS (SELECT bl.stream_id, bl.at, bl.slice_id, bl.bx, bl.byy, bl.poc AS now, list_transform(coalesce(bl.a, []), lambda e: e * 7 % 101) AS counts, p.is_ref AS kept, coalesce(f.intra, true) AS intra, f.x, f.y, f.r, f.count
      FROM bl LEFT JOIN pe p ON p.stream_id = bl.stream_id AND p.at = bl.b[1] LEFT JOIN f ON f.stream_id = bl.stream_id AND f.shown = bl.b[1] AND f.bx = bl.bx // 2 * 3 AND f.byy = bl.byy // 2 * 3 WHERE bl.at % 2 = 1),
d AS (SELECT *, greatest(-128, least(127, count - r)) AS td, greatest(-128, least(127, now - r)) AS tb FROM w),
e AS (SELECT *, greatest(-1024, least(1023, floor((tb * trunc((16384 + abs(td) // 2) / td) + 32) / 64))) AS scale FROM d),
g AS (SELECT *, CASE WHEN td = 0 THEN x ELSE floor((scale * x + 128) / 256) END AS sx, CASE WHEN td = 0 THEN y ELSE floor((scale * y + 128) / 256) END AS sy FROM e)
SELECT stream_id, at AS picture_id, slice_id, bx, byy AS block_row, CASE WHEN kept THEN 'temporal' ELSE 'spatial' END AS mode, CASE WHEN kept THEN CASE WHEN intra THEN 0 ELSE coalesce(list_position(counts, r), 1) - 1 END END::BIGINT AS ref0,
  CASE WHEN kept THEN CASE WHEN intra THEN 0 ELSE sx END END::BIGINT AS x0, CASE WHEN kept THEN CASE WHEN intra THEN 0 ELSE sy END END::BIGINT AS y0,
  CASE WHEN kept THEN CASE WHEN intra OR td = 0 THEN 0 ELSE sx - x END END::BIGINT AS x1, CASE WHEN kept THEN CASE WHEN intra OR td = 0 THEN 0 ELSE sy - y END END::BIGINT AS y1 FROM g"""


@query(_SQL_FIELD)
def colocated_vectors(spark, sf_dir):
    """From slices and their lists to the vectors of blocks in temporal direct mode, by the motion that reference pictures left."""
    pics = stream_catalog.events(spark, sf_dir).select("stream_id", "at")
    stores = stream_catalog._stores(spark, sf_dir)
    lists = S.lists_b(F.col("refs"), F.col("poc"))
    stores = stores.select("stream_id", "at", "poc", "is_ref", *(x.alias(k) for k, x in zip(("l0", "l1"), lists)))

    def one(number: int, a: str, b: str):
        counts = {k: F.transform(c, lambda r: r["poc"].cast("long")) for k, c in (("counts0", a), ("counts1", b))}
        return F.struct(F.lit(number).cast("long").alias("slice_id"), *(v.alias(k) for k, v in counts.items()), F.get(F.col(b), F.lit(0))["at"].alias("first1"))

    slices = stores.select("stream_id", F.col("at").alias("picture_id"), "poc", "is_ref", F.inline(F.array(one(0, "l0", "l1"), one(1, "l1", "l0"))))
    at, i = F.col("picture_id"), F.col("i")
    blocks = pics.select("stream_id", F.col("at").alias("picture_id"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(15).cast("long"))).alias("i"))
    blocks = blocks.select(
        "stream_id", "picture_id", F.floor(i / 8).alias("slice_id"), (i % 4).alias("bx"), F.floor(i / 4).alias("by"), ((at + i) % 5 == 0).alias("intra"), ((at + i) % 4 - 1).alias("ref0"), ((at * 3 + i) % 4 - 1).alias("ref1"),
        (at * i % 201 - 100).alias("x0"), ((at + 7 * i) % 101 - 50).alias("y0"), (at * i % 151 - 75).alias("x1"), ((at + 11 * i) % 71 - 35).alias("y1"),
    )
    wanted = blocks.where(at % 2 == 1).select("stream_id", "picture_id", "slice_id", "bx", "by")
    return colocated.temporal_vectors(wanted, slices, colocated.motion_field(blocks, slices)).withColumnRenamed("by", "block_row")


# Pictures of 480 macroblocks for each supplier, in three slices, every seventh complete and every tenth of two maps.
_SQL_COVERED = """(SELECT l_suppkey AS picture_id, l_linenumber % 3 AS slice_id, CASE WHEN l_suppkey % 10 = 0 THEN 32500 ELSE 0 END + l_orderkey % 600 - 30 AS mb FROM lineitem
  UNION ALL SELECT l_suppkey, 3, i FROM (SELECT DISTINCT l_suppkey FROM lineitem WHERE l_suppkey % 7 = 0), range(480) t(i))"""
_SQL_SIZE = "CASE WHEN picture_id % 10 = 0 THEN 33000 ELSE 480 END"


@query(f"""WITH b AS (SELECT DISTINCT *, {_SQL_SIZE} AS size FROM {_SQL_COVERED} WHERE mb >= 0 AND mb < {_SQL_SIZE}),
n AS (SELECT picture_id, count(DISTINCT mb) AS covered, count(*) - count(DISTINCT mb) AS overlapping FROM b GROUP BY 1),
g AS (SELECT p.picture_id, min(i) AS first_gap FROM (SELECT DISTINCT picture_id, {_SQL_SIZE} AS size FROM {_SQL_COVERED}) p JOIN range(33000) t(i) ON i < p.size LEFT JOIN (SELECT DISTINCT picture_id, mb FROM b) x ON x.picture_id = p.picture_id AND x.mb = i WHERE x.mb IS NULL GROUP BY 1)
SELECT 'suppliers' AS stream_id, p.picture_id, p.size::BIGINT AS size, coalesce(covered, 0) AS covered, coalesce(overlapping, 0) AS overlapping, first_gap
FROM (SELECT DISTINCT picture_id, {_SQL_SIZE} AS size FROM {_SQL_COVERED}) p LEFT JOIN n USING (picture_id) LEFT JOIN g USING (picture_id)""")
def coverage_bitmaps(spark, sf_dir):
    """Macroblocks of pictures that are there, that overlap, and the first that is missing."""
    lines = table(spark, sf_dir, "lineitem")
    far = F.when(F.col("l_suppkey") % 10 == 0, 32500).otherwise(0)
    some = lines.select(F.col("l_suppkey").alias("picture_id"), (F.col("l_linenumber") % 3).alias("slice_id"), (far + F.col("l_orderkey") % 600 - 30).alias("mb"))
    pictures = some.select("picture_id").distinct()
    whole = pictures.where("picture_id % 7 = 0").select("picture_id", F.lit(3).alias("slice_id"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(479).cast("long"))).alias("mb"))
    blocks = some.unionByName(whole).withColumn("stream_id", F.lit("suppliers"))
    sizes = pictures.select(F.lit("suppliers").alias("stream_id"), "picture_id", F.when(F.col("picture_id") % 10 == 0, 33000).otherwise(480).cast("long").alias("size"))
    return bitmaps.coverage(blocks, sizes)


# Slices that are one row or one column of macroblocks, where a prediction is what comes before it: sums of differences since what has no motion or, down a column, another reference.
_SQL_LINES = """(SELECT *, row_number() OVER (PARTITION BY slice_id ORDER BY o, l, p) - 1 AS mb FROM (
  SELECT l_suppkey AS slice_id, l_orderkey AS o, l_linenumber AS l, l_partkey AS p, l_suppkey % 2 = 1 AS down, CASE l_partkey % 7 WHEN 0 THEN 'intra' WHEN 1 THEN 'skip' WHEN 2 THEN 'halves' WHEN 3 THEN 'halves' ELSE 'whole' END AS kind FROM lineitem))"""


@query(f"""WITH mbs AS {_SQL_LINES}, parts AS (
  SELECT slice_id, mb, 0 AS half, down, kind, CASE kind WHEN 'intra' THEN -1 WHEN 'skip' THEN 0 ELSE o % 2 END AS ref, CASE WHEN kind IN ('intra', 'skip') THEN 0 ELSE p % 41 - 20 END AS dx, CASE WHEN kind IN ('intra', 'skip') THEN 0 ELSE o % 31 - 15 END AS dy FROM mbs
  UNION ALL SELECT slice_id, mb, 1, down, kind, l % 2, l * 3 - 10, p % 13 - 6 FROM mbs WHERE kind = 'halves'),
marked AS (SELECT *, CASE WHEN kind IN ('intra', 'skip') OR (down AND ref <> lag(ref) OVER w) THEN 1 ELSE 0 END AS fresh FROM parts WINDOW w AS (PARTITION BY slice_id ORDER BY mb, half)),
runs AS (SELECT *, sum(fresh) OVER (PARTITION BY slice_id ORDER BY mb, half) AS run FROM marked),
moved AS (SELECT *, sum(dx) OVER w AS x, sum(dy) OVER w AS y FROM runs WINDOW w AS (PARTITION BY slice_id, run ORDER BY mb, half))
SELECT slice_id, mb::INT AS mb, max(CASE WHEN half = 0 THEN ref END)::INT AS ref_first, max(CASE WHEN half = 0 THEN x END)::INT AS x_first, max(CASE WHEN half = 0 THEN y END)::INT AS y_first,
  arg_max(ref, half)::INT AS ref_last, arg_max(x, half)::INT AS x_last, arg_max(y, half)::INT AS y_last FROM moved GROUP BY slice_id, mb""")
def slice_motion(spark, sf_dir):
    o, line, p = F.col("l_orderkey"), F.col("l_linenumber"), F.col("l_partkey")
    kind = F.expr("CASE l_partkey % 7 WHEN 0 THEN 'intra' WHEN 1 THEN 'skip' WHEN 2 THEN 'halves' WHEN 3 THEN 'halves' ELSE 'whole' END")
    one = F.struct(o.alias("o"), line.alias("l"), p.alias("p"), kind.alias("kind"))
    slices = table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("slice_id")).agg(F.array_sort(F.collect_list(one)).alias("mbs"))
    down = F.col("slice_id") % 2 == 1

    def parts(m: Column, i: Column) -> Column:
        first = dict(ref0=m["o"] % 2, x0=m["p"] % 41 - 20, y0=m["o"] % 31 - 15)
        last = dict(ref0=m["l"] % 2, x0=m["l"] * 3 - 10, y0=m["p"] % 13 - 6)
        across = F.array(wavefront.part(i, "8x16", 0, 0, 2, 4, **first), wavefront.part(i, "8x16", 2, 0, 2, 4, **last))
        stacked = F.array(wavefront.part(i, "16x8", 0, 0, 4, 2, **first), wavefront.part(i, "16x8", 0, 2, 4, 2, **last))
        halves = F.when(down, stacked).otherwise(across)
        none = F.array().cast(f"array<struct<{wavefront.PART}>>")
        return F.when(m["kind"] == "intra", none).when(m["kind"] == "skip", F.array(wavefront.part(i, "skip"))).when(m["kind"] == "halves", halves).otherwise(F.array(wavefront.part(i, "median", **first)))

    mbs = F.col("mbs")
    slices = slices.select(
        "slice_id", F.when(down, 1).otherwise(F.size(mbs)).alias("width"), F.lit(0).alias("first_mb"), F.transform(mbs, lambda m: m["kind"] == "intra").alias("intra"),
        F.transform(mbs, lambda m: F.lit(0)).alias("still"), F.flatten(F.transform(mbs, parts)).alias("parts"),
    )
    def ends(i: Column) -> Column:
        both = {"first": F.get("blocks", i * 16), "last": F.get("blocks", i * 16 + 15)}
        return F.struct(i.alias("mb"), *(at[c].alias(f"{c[:-1] if c[-1].isdigit() else c}_{name}") for name, at in both.items() for c in ("ref0", "x0", "y0")))

    # What is kept of a macroblock is taken out before the rows are multiplied, so that no row has a copy of its slice's blocks.
    numbers = F.sequence(F.lit(0), (F.size("blocks") / 16).cast("int") - 1)
    return wavefront.slice_motion(slices).select("slice_id", F.inline(F.transform(numbers, ends)))
