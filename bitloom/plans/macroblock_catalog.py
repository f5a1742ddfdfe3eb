"""Registered queries of macroblock syntax and 8x8 prediction, each with the same result in DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from bitloom.operators import intra8
from bitloom.operators import macroblocks as M
from bitloom.plans.catalog import joined, query, samples, sql_samples, table

KEY = "l_orderkey * 8 + l_linenumber AS key"


# 8x8 prediction: neighbours from the part key, some without the corner or what is above to the right.
def _sql_edge() -> str:
    """List e of the smoothed edge: left from the lowest, corner, above."""
    raw = "list_concat(list_reverse(l[1:8]), [m], t[1:8], CASE WHEN p_partkey % 4 > 0 THEN t[9:16] ELSE list_transform(range(8), lambda i: t[8]) END)"
    before = "CASE WHEN i = 0 OR (i = 9 AND p_partkey % 3 = 0) THEN r[i + 1] ELSE r[i] END"
    after = "CASE WHEN i = 24 OR (i = 7 AND p_partkey % 3 = 0) THEN r[i + 1] ELSE r[i + 2] END"
    return f"(SELECT p_partkey, list_transform(range(25), lambda i: ({before} + 2 * r[i + 1] + {after} + 2) >> 2) AS e FROM (SELECT p_partkey, {raw} AS r FROM {sql_samples(16)}))"


def _sql_intra_8x8(mode: str) -> list[str]:
    """The standard's formulas with p(x, -1) above and p(-1, y) beside."""

    def p(x: int, y: int) -> str:
        return f"e[{10 + x if y < 0 else 8 - y}]"

    def three(a: str, b: str, c: str) -> str:
        return f"({a} + 2 * {b} + {c} + 2) >> 2"

    def two(a: str, b: str) -> str:
        return f"({a} + {b} + 1) >> 1"

    def sample(x: int, y: int) -> str:
        if mode == "vertical":
            return p(x, -1)
        if mode == "horizontal":
            return p(-1, y)
        if mode == "dc":
            return "(list_sum(e[1:8]) + list_sum(e[10:17]) + 8) >> 4"
        if mode == "down_left":
            return f"({p(14, -1)} + 3 * {p(15, -1)} + 2) >> 2" if x == y == 7 else three(p(x + y, -1), p(x + y + 1, -1), p(x + y + 2, -1))
        if mode == "down_right":
            if x > y:
                return three(p(x - y - 2, -1), p(x - y - 1, -1), p(x - y, -1))
            return three(p(0, -1), p(-1, -1), p(-1, 0)) if x == y else three(p(-1, y - x - 2), p(-1, y - x - 1), p(-1, y - x))
        if mode == "vertical_right":
            z, k = 2 * x - y, x - (y >> 1)
            if z < -1:
                return three(p(-1, y - 2 * x - 1), p(-1, y - 2 * x - 2), p(-1, y - 2 * x - 3))
            if z == -1:
                return three(p(-1, 0), p(-1, -1), p(0, -1))
            return two(p(k - 1, -1), p(k, -1)) if z % 2 == 0 else three(p(k - 2, -1), p(k - 1, -1), p(k, -1))
        if mode == "horizontal_down":
            z, k = 2 * y - x, y - (x >> 1)
            if z < -1:
                return three(p(x - 2 * y - 1, -1), p(x - 2 * y - 2, -1), p(x - 2 * y - 3, -1))
            if z == -1:
                return three(p(-1, 0), p(-1, -1), p(0, -1))
            return two(p(-1, k - 1), p(-1, k)) if z % 2 == 0 else three(p(-1, k - 2), p(-1, k - 1), p(-1, k))
        if mode == "vertical_left":
            k = x + (y >> 1)
            return two(p(k, -1), p(k + 1, -1)) if y % 2 == 0 else three(p(k, -1), p(k + 1, -1), p(k + 2, -1))
        z, k = x + 2 * y, y + (x >> 1)
        if z > 13:
            return p(-1, 7)
        if z == 13:
            return f"({p(-1, 6)} + 3 * {p(-1, 7)} + 2) >> 2"
        return two(p(-1, k), p(-1, k + 1)) if z % 2 == 0 else three(p(-1, k), p(-1, k + 1), p(-1, k + 2))

    return [f"({sample(x, y)})::BIGINT" for y in range(8) for x in range(8)]


for _mode in intra8.INTRA_8X8:

    def _run(spark, sf_dir, mode=_mode):
        rows = samples(spark, sf_dir, 16)
        key, top = F.col("p_partkey"), F.col("top")
        edge = intra8.edge(top, F.slice(top, 9, 8), F.col("beside"), F.col("corner"), key % 4 > 0)
        return rows.select("p_partkey", joined(intra8.intra_8x8(mode, intra8.smoothed(edge, key % 3 > 0))).alias("result"))

    query(f"SELECT p_partkey, array_to_string([{', '.join(_sql_intra_8x8(_mode))}], ',') AS result FROM {_sql_edge()}", f"intra8x8_{_mode}")(_run)


# Types, patterns and modes: numbers from the keys of lineitem.
@query(f"""SELECT key, (cbp % 16)::INT AS luma, (cbp >> 4)::INT AS chroma FROM (
  SELECT l_orderkey * 8 + l_linenumber AS key, CASE WHEN l_suppkey % 2 = 0 THEN {M.INTRA_PATTERN}[l_partkey % 48 + 1] ELSE {M.INTER_PATTERN}[l_partkey % 48 + 1] END AS cbp FROM lineitem)""")
def coded_block_pattern(spark, sf_dir):
    pattern = M.coded_block_pattern((F.col("l_partkey") % 48).cast("int"), F.col("l_suppkey") % 2 == 0)
    return table(spark, sf_dir, "lineitem").select(F.expr(KEY), pattern.alias("p")).select("key", "p.luma", "p.chroma")


@query("""SELECT l_orderkey * 8 + l_linenumber AS key, t AS mb_type, CASE WHEN t BETWEEN 1 AND 24 THEN (t - 1) % 4 END::INT AS mode,
  CASE WHEN t BETWEEN 1 AND 4 OR t BETWEEN 13 AND 16 THEN 0 WHEN t BETWEEN 5 AND 8 OR t BETWEEN 17 AND 20 THEN 1 WHEN t BETWEEN 9 AND 12 OR t BETWEEN 21 AND 24 THEN 2 END::INT AS chroma,
  CASE WHEN t BETWEEN 1 AND 12 THEN 0 WHEN t BETWEEN 13 AND 24 THEN 15 END::INT AS luma FROM (SELECT *, (l_partkey % 26)::INT AS t FROM lineitem)""")
def intra16x16_types(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select(F.expr(KEY), (F.col("l_partkey") % 26).cast("int").alias("mb_type"))
    return rows.select("key", "mb_type", M.whole_block_type(F.col("mb_type")).alias("t")).select("key", "mb_type", "t.mode", "t.chroma", "t.luma")


_MODES = "CASE ((t - 4) // 2) {0} END"
_FIRST = "WHEN 0 THEN 'L0' WHEN 1 THEN 'L1' WHEN 2 THEN 'L0' WHEN 3 THEN 'L1' WHEN 4 THEN 'L0' WHEN 5 THEN 'L1' ELSE 'Bi'"
_SECOND = "WHEN 0 THEN 'L0' WHEN 1 THEN 'L1' WHEN 2 THEN 'L1' WHEN 3 THEN 'L0' WHEN 6 THEN 'L0' WHEN 7 THEN 'L1' ELSE 'Bi'"


@query(f"""SELECT key, slice, t AS mb_type,
  CASE WHEN t >= CASE slice WHEN 'P' THEN 5 ELSE 23 END THEN NULL WHEN slice = 'P' THEN [1, 2, 2, 4, 4][t + 1] WHEN t = 0 THEN 0 WHEN t < 4 THEN 1 WHEN t < 22 THEN 2 ELSE 4 END::INT AS parts,
  CASE WHEN slice = 'P' THEN CASE WHEN t < 3 THEN 'L0' END WHEN t = 0 THEN 'Direct' WHEN t < 4 THEN ['L0', 'L1', 'Bi'][t] WHEN t < 22 THEN {_MODES.format(_FIRST)} END AS first,
  CASE WHEN slice = 'P' THEN CASE WHEN t IN (1, 2) THEN 'L0' END WHEN t BETWEEN 4 AND 21 THEN {_MODES.format(_SECOND)} END AS second,
  CASE WHEN slice = 'P' THEN CASE WHEN t < 5 THEN [16, 16, 8, 8, 8][t + 1] END WHEN t < 4 THEN 16 WHEN t < 22 THEN 16 - t % 2 * 8 WHEN t = 22 THEN 8 END::INT AS width,
  CASE WHEN slice = 'P' THEN CASE WHEN t < 5 THEN [16, 8, 16, 8, 8][t + 1] END WHEN t < 4 THEN 16 WHEN t < 22 THEN 8 + t % 2 * 8 WHEN t = 22 THEN 8 END::INT AS height
FROM (SELECT l_orderkey * 8 + l_linenumber AS key, CASE WHEN l_suppkey % 2 = 0 THEN 'P' ELSE 'B' END AS slice, (l_partkey % CASE WHEN l_suppkey % 2 = 0 THEN 6 ELSE 24 END)::INT AS t FROM lineitem)""")
def inter_types(spark, sf_dir):
    p = F.col("l_suppkey") % 2 == 0
    rows = table(spark, sf_dir, "lineitem").select(F.expr(KEY), F.when(p, "P").otherwise("B").alias("slice"), (F.col("l_partkey") % F.when(p, 6).otherwise(24)).cast("int").alias("mb_type"))
    return M.with_types(rows).select("key", "slice", "mb_type", "parts", "first", "second", "width", "height")


@query("SELECT l_orderkey * 8 + l_linenumber AS key, ([0, 4, 0, 4, 8, 12, 8, 12, 0, 4, 0, 4, 8, 12, 8, 12][i])::INT AS x, ([0, 0, 4, 4, 0, 0, 4, 4, 8, 8, 12, 12, 8, 8, 12, 12][i])::INT AS y FROM (SELECT *, l_partkey % 16 + 1 AS i FROM lineitem)")
def block_places(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select(F.expr(KEY), M.block_place((F.col("l_partkey") % 16).cast("int")).alias("b")).select("key", "b.x", "b.y")


@query("""SELECT key, p AS predicted, CASE WHEN key % 2 = 0 THEN p WHEN r < p THEN r ELSE r + 1 END::INT AS mode FROM (
  SELECT l_orderkey * 8 + l_linenumber AS key, (l_suppkey % 8)::INT AS r,
    CASE WHEN l_orderkey % 5 = 0 OR l_partkey % 7 = 0 THEN 2 ELSE least(CASE WHEN l_partkey % 3 = 0 THEN 2 ELSE l_partkey % 9 END, CASE WHEN l_suppkey % 3 = 0 THEN 2 ELSE l_suppkey % 9 END) END::INT AS p FROM lineitem)""")
def intra_mode_prediction(spark, sf_dir):
    o, p, s = (F.col(c) for c in ("l_orderkey", "l_partkey", "l_suppkey"))
    a, b = (F.when(c % 3 > 0, c % 9).cast("int") for c in (p, s))
    rows = table(spark, sf_dir, "lineitem").select(F.expr(KEY), (s % 8).cast("int").alias("r"), M.predicted_mode(a, b, o % 5 > 0, p % 7 > 0).alias("predicted"))
    return rows.select("key", "predicted", M.chosen_mode(F.col("predicted"), F.col("key") % 2 == 0, F.col("r")).alias("mode"))


@query("""SELECT key, CASE WHEN a < 0 AND b < 0 AND c < 0 THEN -1 ELSE least(CASE WHEN a < 0 THEN 99 ELSE a END, CASE WHEN b < 0 THEN 99 ELSE b END, CASE WHEN c < 0 THEN 99 ELSE c END) END::BIGINT AS ref,
  CASE WHEN b = 3 THEN 0 WHEN b = 5 THEN 1 WHEN b = a THEN 3 ELSE 0 END::BIGINT AS place,
  CASE WHEN n IN (0, 3) AND a < 2 THEN 'explicit' WHEN n = 1 AND l = 1 THEN 'explicit' WHEN n = 1 AND l = 2 THEN 'implicit' ELSE 'default' END AS weights
FROM (SELECT l_orderkey * 8 + l_linenumber AS key, l_orderkey % 6 - 2 AS a, l_partkey % 7 - 2 AS b, l_suppkey % 5 - 2 AS c, l_orderkey % 4 AS n, l_linenumber % 3 AS l FROM lineitem)""")
def reference_choice(spark, sf_dir):
    a, b, c = F.col("l_orderkey") % 6 - 2, F.col("l_partkey") % 7 - 2, F.col("l_suppkey") % 5 - 2
    kind = F.get(F.array(*map(F.lit, ("P", "B", "I", "SP"))), (F.col("l_orderkey") % 4).cast("int"))
    place = M.list_place(F.array(F.lit(3).cast("long"), F.lit(5).cast("long"), F.lit(3).cast("long"), a), b)
    rows = table(spark, sf_dir, "lineitem")
    return rows.select(F.expr(KEY), M.least_reference(a, b, c).alias("ref"), place.alias("place"), M.weight_mode(kind, a < 2, F.col("l_linenumber") % 3).alias("weights"))


@query("""SELECT stream_id, picture_id, count(DISTINCT mb)::BIGINT AS present, CASE WHEN count(*) > count(DISTINCT mb) THEN 'repeated' WHEN count(DISTINCT mb) < 3 THEN 'missing' ELSE 'complete' END AS verdict
FROM (SELECT l_suppkey AS stream_id, l_orderkey AS picture_id, l_partkey % 5 AS mb FROM lineitem) GROUP BY 1, 2""")
def picture_completeness(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("stream_id"), F.col("l_orderkey").alias("picture_id"), (F.col("l_partkey") % 5).alias("mb_addr"))
    return M.completeness(rows, F.lit(3))


def _sql_run(bits: str, left: str) -> str:
    """The run by comparing with each code; the codes of long runs are zeros and a one."""
    whens = []
    for zeros, codes in M.RUN_CODES.items():
        cond = f"{left} = {zeros}" if zeros < 7 else f"{left} > 6"
        whens += [f"WHEN {cond} AND starts_with({bits}, '{code}') THEN {run}" for run, code in enumerate(codes)]
    return f"CASE WHEN {left} = 0 THEN 0 {' '.join(whens)} WHEN {left} > 6 AND instr({bits}, '1') > 3 THEN instr({bits}, '1') + 3 END"


_BITS = "lpad(bin((l_orderkey * 7919 + l_partkey * 104729 + l_suppkey) % 4096), 12, '0')"


@query(f"""SELECT l_orderkey * 8 + l_linenumber AS key, ({_sql_run(_BITS, "(l_linenumber * 2 - 2)")})::INT AS run FROM lineitem""")
def run_before_codes(spark, sf_dir):
    bits = F.lpad(F.bin((F.col("l_orderkey") * 7919 + F.col("l_partkey") * 104729 + F.col("l_suppkey")) % 4096), 12, "0")
    rows = table(spark, sf_dir, "lineitem").select(F.expr(KEY), bits.alias("bits"), (F.col("l_linenumber") * 2 - 2).cast("int").alias("left"))
    return rows.select("key", M.run_of_zeros(F.col("bits"), F.lit(0), F.col("left"))["run"].alias("run"))


@query("""SELECT key, array_to_string(list_concat(list_transform(range(z1), lambda i: 0), [c], list_transform(range(z2), lambda i: 0), [b], list_transform(range(z3), lambda i: 0), [a], list_transform(range(13 - z1 - z2 - z3), lambda i: 0)), ',') AS result
FROM (SELECT l_orderkey * 8 + l_linenumber AS key, l_orderkey % 9 - 4 AS a, l_partkey % 9 - 4 AS b, l_suppkey % 9 - 4 AS c, (l_partkey % 4)::INT AS z3, (l_suppkey % 4)::INT AS z2, (l_orderkey % 4)::INT AS z1 FROM lineitem)""")
def coefficient_placement(spark, sf_dir):
    o, p, s = (F.col(c) for c in ("l_orderkey", "l_partkey", "l_suppkey"))
    levels, before = F.array(*((c % 9 - 4).cast("int") for c in (o, p, s))), F.array(*((c % 4).cast("int") for c in (p, s, o)))
    return table(spark, sf_dir, "lineitem").select(F.expr(KEY), joined(M.placed_levels(levels, before, 16)).alias("result"))
