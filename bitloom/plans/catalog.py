"""Registered queries over the driver's tables, each with the same result in DuckDB SQL.

The tables hold no video, so each query derives its input from a table by
integer arithmetic: coefficient blocks from ``lineitem``, pictures from
``events``, geometry from ``part``. A result is integers and joined lists.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from bitloom.functions import bits as B
from bitloom.functions.let import let
from bitloom.operators import batches, blocks, deblock, prediction
from bitloom.plans import sequence as S
from bitloom.plans.headers import made_once
from bitloom.sources import annexb

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None, name: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[name or f.__name__] = f
        if sql is not None:
            SQL[name or f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(rows: DataFrame, key: str) -> DataFrame:
    """``rows`` dealt to a few tasks for every core by a hash of their key: a small file is one task, whatever its rows cost."""
    return rows.repartition(4 * rows.sparkSession.sparkContext.defaultParallelism, key)


def joined(values: Column) -> Column:
    return F.array_join(F.transform(values, lambda v: v.cast("string")), ",")


def sql_list(values) -> str:
    return "[" + ", ".join(map(str, values)) + "]"


# Blocks: one for each row of lineitem.
def lines(spark: SparkSession, sf_dir: str, n: int = 16) -> DataFrame:
    """key, qp and a block c of n numbers from -20 to 20."""
    key = F.col("l_orderkey") * 8 + F.col("l_linenumber")
    rows = table(spark, sf_dir, "lineitem").select(key.alias("key"), F.col("l_quantity").cast("int").alias("qp"))
    return rows.withColumn("c", F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: ((F.col("key") * (7 + i)) % 41 - 20).cast("int")))


def sql_lines(n: int = 16) -> str:
    return f"(SELECT l_orderkey * 8 + l_linenumber AS key, l_quantity::INT AS qp, list_transform(range({n}), lambda i: (((l_orderkey * 8 + l_linenumber) * (7 + i)) % 41 - 20)::INT) AS c FROM lineitem)"


def block_query(name: str, kernel: Callable[[Column, Column], Column], sql: str, n: int = 16) -> None:
    """A query of a kernel on all blocks; ``sql`` is its list from key, qp and c."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return lines(spark, sf_dir, n).select("key", "qp", joined(kernel(F.col("c"), F.col("qp"))).alias("result"))

    QUERIES[name] = run
    SQL[name] = f"SELECT key, qp, array_to_string(list_transform({sql}, lambda v: v::BIGINT), ',') AS result FROM {sql_lines(n)}"


for _n in (4, 8):
    _order = blocks.zigzag(_n)
    block_query(f"zigzag_{_n}x{_n}", lambda c, qp, n=_n: blocks.from_zigzag(c, n), f"list_transform({sql_list([_order.index(i) for i in range(_n * _n)])}, lambda i: c[i + 1])", _n * _n)


def _sql_norm(n: int) -> str:
    norm, place = (blocks.NORM_4X4, blocks.class_4x4) if n == 4 else (blocks.NORM_8X8, blocks.class_8x8)
    return f"{[row for row in norm]}[qp % 6 + 1][{sql_list([place(i) + 1 for i in range(n * n)])}[i + 1]]"


def _sql_scaled(c: str, s: str, even: int, shift: int) -> str:
    return f"CASE WHEN qp >= {even} THEN {c} * {s} * (2 ** (qp // 6 - {shift}))::BIGINT ELSE floor(({c} * {s} + 2 ** ({shift - 1} - qp // 6)) / 2 ** ({shift} - qp // 6))::BIGINT END"


def _flat(n: int) -> Column:
    return F.array_repeat(F.lit(16), n)


block_query("dequant_4x4", lambda c, qp: batches.dequant(c, qp, [16] * 16, 4), f"list_transform(range(16), lambda i: {_sql_scaled('c[i + 1]', f'16 * {_sql_norm(4)}', 24, 4)})")
block_query("dequant_8x8", lambda c, qp: batches.dequant(c, qp, [16] * 64, 8), f"list_transform(range(64), lambda i: {_sql_scaled('c[i + 1]', f'16 * {_sql_norm(8)}', 36, 6)})", 64)
_DC = "(16 * [10, 11, 13, 14, 16, 18][qp % 6 + 1])"
block_query("dequant_dc", lambda c, qp: blocks.dequant_luma_dc(c, qp, blocks.level_scale(qp, _flat(16))[0]), f"list_transform(c, lambda x: {_sql_scaled('x', _DC, 36, 6)})")
block_query("dequant_chroma_dc", lambda c, qp: blocks.dequant_chroma_dc(c, qp, blocks.level_scale(qp, _flat(16))[0]), f"list_transform(c, lambda x: floor(x * {_DC} * 2 ** (qp // 6) / 32)::BIGINT)", 4)
block_query("residual_clip", lambda c, qp: blocks.add_residual(F.transform(c, lambda x: F.pmod(x * 37, F.lit(256))), F.transform(c, lambda x: x * 15)), "list_transform(c, lambda x: greatest(0, least(255, ((x * 37) % 256 + 256) % 256 + x * 15)))")


def _sql_both_ways(n: int, line: Callable[[list[str]], list[str]], last: str = "{0}") -> str:
    """Rows, then columns, with a level of subquery for each step."""
    cells = [(r, c) for r in range(n) for c in range(n)]
    zero = ", ".join(f"c[{r * n + c + 1}] AS x{r}_{c}" for r, c in cells)
    across = ", ".join(f"{e} AS y{r}_{c}" for r in range(n) for c, e in enumerate(line([f"x{r}_{c}" for c in range(n)])))
    down = {(r, c): e for c in range(n) for r, e in enumerate(line([f"y{r}_{c}" for r in range(n)]))}
    out = ", ".join(f"({last.format(down[cell])})::BIGINT" for cell in cells)
    return f"SELECT key, qp, array_to_string([{out}], ',') AS result FROM (SELECT key, qp, {across} FROM (SELECT key, qp, {zero} FROM {sql_lines(n * n)}))"


def _sql_line_4(x: list[str]) -> list[str]:
    a, b, c, d = f"({x[0]} + {x[2]})", f"({x[0]} - {x[2]})", f"(({x[1]} >> 1) - {x[3]})", f"({x[1]} + ({x[3]} >> 1))"
    return [f"{a} + {d}", f"{b} + {c}", f"{b} - {c}", f"{a} - {d}"]


def _sql_line_8(x: list[str]) -> list[str]:
    even = _sql_line_4([x[0], x[2], x[4], x[6]])
    p, q = f"({x[5]} - {x[3]} - {x[7]} - ({x[7]} >> 1))", f"({x[1]} + {x[7]} - {x[3]} - ({x[3]} >> 1))"
    t, s = f"({x[7]} - {x[1]} + {x[5]} + ({x[5]} >> 1))", f"({x[3]} + {x[5]} + {x[1]} + ({x[1]} >> 1))"
    odd = [f"({p} + ({s} >> 2))", f"({q} + ({t} >> 2))", f"(({q} >> 2) - {t})", f"({s} - ({p} >> 2))"]
    return [f"({e}) + {o}" for e, o in zip(even, odd[::-1])] + [f"({e}) - {o}" for e, o in zip(even[::-1], odd)]


def _sql_hadamard(x: list[str]) -> list[str]:
    signs = {2: ["++", "+-"], 4: ["++++", "++--", "+--+", "+-+-"]}[len(x)]
    return ["(" + " ".join(f"{s} {v}" for s, v in zip(row, x)).lstrip("+ ") + ")" for row in signs]


for _name, _kernel, _n, _line, _last in (
    ("idct_4x4", batches.inverse_4x4, 4, _sql_line_4, "({0} + 32) >> 6"),
    ("idct_8x8", batches.inverse_8x8, 8, _sql_line_8, "({0} + 32) >> 6"),
    ("hadamard_4x4", batches.hadamard_4x4, 4, _sql_hadamard, "{0}"),
    ("hadamard_2x2", blocks.hadamard_2x2, 2, _sql_hadamard, "{0}"),
):
    block_query(_name, lambda c, qp, k=_kernel: k(F.transform(c, lambda x: x * 16)), "c", _n * _n)
    SQL[_name] = _sql_both_ways(_n, _line, _last).replace("% 41 - 20)::INT)", "% 41 - 20)::INT * 16)")


@query(f"""SELECT key, qp, o AS chroma_offset, CASE WHEN x < 30 THEN x ELSE {blocks.CHROMA_QP}[x - 29] END::BIGINT AS qp_c
FROM (SELECT key, qp, o, greatest(0, least(51, qp + o)) AS x FROM (SELECT key, qp, (key % 25 - 12)::INT AS o FROM {sql_lines()}))""")
def chroma_qp(spark, sf_dir):
    rows = lines(spark, sf_dir).withColumn("chroma_offset", (F.col("key") % 25 - 12).cast("int"))
    return rows.select("key", "qp", "chroma_offset", blocks.chroma_qp(F.col("qp"), F.col("chroma_offset")).cast("long").alias("qp_c"))


@query(f"""
WITH RECURSIVE d AS (SELECT DISTINCT key, list_transform(c, lambda x: CASE WHEN key % 3 = 0 AND x > 15 THEN -8 ELSE x % 5 END) AS ds FROM {sql_lines()}),
r AS (
  SELECT key, ds, 0 AS i, 8 AS l, 8 AS n, []::INT[] AS out FROM d
  UNION ALL
  SELECT key, ds, i + 1, CASE WHEN nn = 0 THEN l ELSE nn END, nn, list_append(out, CASE WHEN nn = 0 THEN l ELSE nn END)
  FROM (SELECT *, CASE WHEN n = 0 THEN 0 ELSE ((l + ds[i + 1]) % 256 + 256) % 256 END AS nn FROM r WHERE i < 16))
SELECT key, array_to_string(CASE WHEN (8 + ds[1]) % 256 = 0 THEN {blocks.DEFAULT_4X4_INTRA} ELSE out END, ',') AS scaling FROM r WHERE i = 16""")
def scaling_list_decode(spark, sf_dir):
    deltas = F.transform("c", lambda x: F.when((F.col("key") % 3 == 0) & (x > 15), -8).otherwise(x % 5))
    rows = lines(spark, sf_dir).select("key", deltas.alias("deltas")).distinct()
    return rows.select("key", joined(batches.scaling_list(F.col("deltas"), blocks.DEFAULT_4X4_INTRA)).alias("scaling"))


@query("""
SELECT p_partkey, i::INT AS list_no, coalesce(CASE WHEN (p_partkey >> i) & 1 = 1 THEN 100 + i END, CASE WHEN i % 3 > 0 AND (p_partkey >> greatest(0, i - 1)) & 1 = 1 THEN 99 + i END,
  CASE WHEN i % 3 > 1 AND (p_partkey >> greatest(0, i - 2)) & 1 = 1 THEN 98 + i END, CASE WHEN i < 3 THEN 6 ELSE 10 END)::INT AS first_weight
FROM (SELECT p_partkey, unnest(range(6))::INT AS i FROM part)""")
def scaling_fallback(spark, sf_dir):
    own = [F.when(F.shiftright("p_partkey", i).bitwiseAND(1) == 1, F.array(F.lit(100 + i))) for i in range(6)]
    lists = blocks.resolve_4x4(own, F.array(F.lit(6)), F.array(F.lit(10)))
    rows = table(spark, sf_dir, "part").select("p_partkey", F.posexplode(F.array(*lists)).alias("list_no", "weights"))
    return rows.select("p_partkey", "list_no", F.col("weights")[0].alias("first_weight"))


# Prediction: neighbour samples from the part key.
def samples(spark: SparkSession, sf_dir: str, n: int) -> DataFrame:
    def line(seed: int) -> Column:
        return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: ((F.col("p_partkey") * (seed + i) + i * seed) % 256).cast("int"))

    return table(spark, sf_dir, "part").select("p_partkey", line(3).alias("top"), line(5).alias("beside"), (F.col("p_partkey") * 7 % 256).cast("int").alias("corner"))


def sql_samples(n: int) -> str:
    def line(seed: int) -> str:
        return f"list_transform(range({n}), lambda i: ((p_partkey * ({seed} + i) + i * {seed}) % 256)::INT)"

    return f"(SELECT p_partkey, {line(3)} AS t, {line(5)} AS l, (p_partkey * 7 % 256)::INT AS m FROM part)"


def _sql_intra_4x4(mode: str) -> list[str]:
    """From the directions: a sample is filtered at a place on the edge ..., l1, l0, corner, t0, t1, ... in quarter steps."""
    t, l = [f"t[{i + 1}]" for i in range(8)], [f"l[{i + 1}]" for i in range(4)]
    edge = l[::-1] + ["m"] + t  # index 4 is the corner

    def three(i: int) -> str:
        return f"({edge[i - 1]} + 2 * {edge[i]} + {edge[i + 1]} + 2) >> 2"

    def two(i: int) -> str:
        return f"({edge[i]} + {edge[i + 1]} + 1) >> 1"

    out = []
    for y in range(4):
        for x in range(4):
            if mode == "vertical":
                e = t[x]
            elif mode == "horizontal":
                e = l[y]
            elif mode == "dc":
                e = f"({' + '.join(t[:4] + l)} + 4) >> 3"
            elif mode == "down_left":
                e = f"({t[6]} + 3 * {t[7]} + 2) >> 2" if x == y == 3 else three(5 + x + y + 1)
            elif mode == "down_right":
                e = three(4 + x - y)
            elif mode in ("vertical_right", "horizontal_down"):
                # Mirror images: along the main direction in half steps, beyond the corner along the other edge.
                along, across, sign = (x, y, 1) if mode == "vertical_right" else (y, x, -1)
                z = 2 * along - across
                if z == -1:
                    e = three(4)
                elif z < 0:
                    e = three(4 - sign * (across - 1))
                else:
                    i = 4 + sign * (along - across // 2)
                    e = three(i) if z % 2 else two(min(i, i + sign))
            elif mode == "vertical_left":
                i = 5 + x + y // 2
                e = two(i) if y % 2 == 0 else three(i + 1)
            else:
                z = x + 2 * y
                i = y + x // 2
                e = l[3] if z > 5 else f"({l[2]} + 3 * {l[3]} + 2) >> 2" if z == 5 else f"({l[i]} + {l[i + 1]} + 1) >> 1" if z % 2 == 0 else f"({l[i]} + 2 * {l[i + 1]} + {l[i + 2]} + 2) >> 2"
            out.append(f"({e})::BIGINT")
    return out


for _mode in prediction.INTRA_4X4:

    def _run(spark, sf_dir, mode=_mode):
        rows = samples(spark, sf_dir, 8)
        return rows.select("p_partkey", joined(prediction.intra_4x4(mode, F.col("top"), F.col("beside"), F.col("corner"))).alias("result"))

    query(f"SELECT p_partkey, array_to_string([{', '.join(_sql_intra_4x4(_mode))}], ',') AS result FROM {sql_samples(8)}", f"intra4x4_{_mode}")(_run)


def _sql_plane(n: int, factor: int) -> str:
    h = n // 2

    def gradient(v: str) -> str:
        return " + ".join(f"{i + 1} * ({v}[{h + i + 1}] - {'m' if i == h - 1 else f'{v}[{h - 1 - i}]'})" for i in range(h))

    return f"""SELECT p_partkey, list_transform(range({n * n}), lambda i: greatest(0, least(255, (a + b * (i % {n} - {h - 1}) + c * (i // {n} - {h - 1}) + 16) >> 5))) AS v
FROM (SELECT p_partkey, 16 * (t[{n}] + l[{n}]) AS a, ({factor} * ({gradient("t")}) + 32) >> 6 AS b, ({factor} * ({gradient("l")}) + 32) >> 6 AS c FROM {sql_samples(n)})"""


def _sql_big(mode: str, n: int) -> str:
    if mode == "plane":
        inner = _sql_plane(n, 5 if n == 16 else 34)
    else:
        value = {"vertical": f"t[i % {n} + 1]", "horizontal": f"l[i // {n} + 1]", "dc": f"(list_sum(t) + list_sum(l) + 16) >> 5"}[mode]
        if mode == "dc" and n == 8:
            value = """CASE WHEN i % 8 < 4 AND i < 32 THEN (list_sum(t[1:4]) + list_sum(l[1:4]) + 4) >> 3 WHEN i < 32 THEN (list_sum(t[5:8]) + 2) >> 2
              WHEN i % 8 < 4 THEN (list_sum(l[5:8]) + 2) >> 2 ELSE (list_sum(t[5:8]) + list_sum(l[5:8]) + 4) >> 3 END"""
        inner = f"SELECT p_partkey, list_transform(range({n * n}), lambda i: ({value})::BIGINT) AS v FROM {sql_samples(n)}"
    return f"SELECT p_partkey, list_sum(list_transform(v, lambda x, i: x * (i % 97 + 1)))::BIGINT AS checksum, list_min(v)::BIGINT AS least, list_max(v)::BIGINT AS most FROM ({inner})"


for _size, _kernel, _prefix in ((16, prediction.intra_16x16, "intra16x16"), (8, prediction.intra_chroma, "intra_chroma")):
    for _mode in ("vertical", "horizontal", "dc", "plane"):

        def _run(spark, sf_dir, mode=_mode, size=_size, kernel=_kernel):
            # The block is made once and summed by one function: expressions of it would predict it again for each sum.
            rows = made_once(samples(spark, sf_dir, size), v=kernel(mode, F.col("top"), F.col("beside"), F.col("corner")))
            return rows.select("p_partkey", batches.weighted_sums(F.col("v")).alias("s")).select("p_partkey", "s.*")

        query(_sql_big(_mode, _size), f"{_prefix}_{_mode}")(_run)


_TAPS = "({0}[1] - 5 * {0}[2] + 20 * {0}[3] + 20 * {0}[4] - 5 * {0}[5] + {0}[6])"


@query(f"""SELECT p_partkey, h::BIGINT AS half_sample, ((t[3] + h + 1) >> 1)::BIGINT AS quarter_sample, greatest(0, least(255, (
  {" + ".join(f"({w}) * ({' + '.join(f'({v}) * ((t[{j + 1}] + l[{i + 1}]) % 256)' for j, v in enumerate((1, -5, 20, 20, -5, 1)))})" for i, w in enumerate((1, -5, 20, 20, -5, 1)))} + 512) >> 10))::BIGINT AS centre_sample
FROM (SELECT *, greatest(0, least(255, ({_TAPS.format("t")} + 16) >> 5)) AS h FROM {sql_samples(6)})""")
def luma_interpolation(spark, sf_dir):
    t, l = ([F.col(c)[i] for i in range(6)] for c in ("top", "beside"))
    grid = [[(t[j] + l[i]) % 256 for j in range(6)] for i in range(6)]
    made = {"half_sample": prediction.half_sample(t), "quarter_sample": prediction.quarter_sample(t), "centre_sample": prediction.centre_sample(grid)}
    return samples(spark, sf_dir, 6).select("p_partkey", *(v.cast("long").alias(k) for k, v in made.items()))


@query(f"""SELECT p_partkey, (((8 - x) * (8 - y) * t[1] + x * (8 - y) * t[2] + (8 - x) * y * l[1] + x * y * l[2] + 32) >> 6)::BIGINT AS sample
FROM (SELECT *, (p_partkey % 8)::INT AS x, (p_partkey // 8 % 8)::INT AS y FROM {sql_samples(2)})""")
def chroma_bilinear(spark, sf_dir):
    dx, dy = (F.col("p_partkey") % 8).cast("int"), (F.floor(F.col("p_partkey") / 8) % 8).cast("int")
    t, l = F.col("top"), F.col("beside")
    return samples(spark, sf_dir, 2).select("p_partkey", prediction.chroma_sample(t[0], t[1], l[0], l[1], dx, dy).cast("long").alias("sample"))


@query(f"""SELECT p_partkey, greatest(0, least(255, CASE WHEN d >= 1 THEN floor((t[1] * w + 2 ** (d - 1)) / 2 ** d)::INT ELSE t[1] * w END + o))::BIGINT AS uni,
  greatest(0, least(255, floor((t[1] * w + l[1] * (64 - w) + 2 ** d) / 2 ** (d + 1))::INT + ((o + 2 * o + 1) >> 1)))::BIGINT AS bi
FROM (SELECT *, (p_partkey % 8)::INT AS d, (p_partkey % 256 - 128)::INT AS w, (p_partkey % 41 - 20)::INT AS o FROM {sql_samples(1)})""")
def weighted_prediction(spark, sf_dir):
    key = F.col("p_partkey")
    d, w, o = (key % 8).cast("int"), (key % 256 - 128).cast("int"), (key % 41 - 20).cast("int")
    a, b = F.col("top")[0], F.col("beside")[0]
    uni, bi = prediction.weighted_uni(a, w, o, d), prediction.weighted_bi(a, b, w, 64 - w, o, 2 * o, d)
    return samples(spark, sf_dir, 1).select("p_partkey", uni.cast("long").alias("uni"), bi.cast("long").alias("bi"))


_DISTANCES = """(SELECT key, td, tb, CASE WHEN td <> 0 THEN greatest(-1024, least(1023, (tb * ((16384 + abs(td) // 2) // td) + 32) >> 6)) END AS s
FROM (SELECT key, greatest(-128, least(127, b - a))::INT AS td, greatest(-128, least(127, c - a))::INT AS tb
FROM (SELECT l_orderkey * 8 + l_linenumber AS key, l_orderkey % 200 AS a, l_partkey % 200 AS b, l_suppkey % 200 AS c FROM lineitem)))"""


def distances(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("l_orderkey") * 8 + F.col("l_linenumber")
    counts = [(F.col(c) % 200).cast("int").alias(n) for c, n in (("l_suppkey", "current"), ("l_orderkey", "first"), ("l_partkey", "second"))]
    return table(spark, sf_dir, "lineitem").select(key.alias("key"), *counts)


@query(f"SELECT key, CASE WHEN s IS NULL OR (s >> 2) NOT BETWEEN -64 AND 128 THEN 32 ELSE 64 - (s >> 2) END::BIGINT AS w0, CASE WHEN s IS NULL OR (s >> 2) NOT BETWEEN -64 AND 128 THEN 32 ELSE s >> 2 END::BIGINT AS w1 FROM {_DISTANCES}")
def implicit_weights(spark, sf_dir):
    w = prediction.implicit_weights(F.col("current"), F.col("first"), F.col("second"))
    return distances(spark, sf_dir).select("key", w.alias("w")).select("key", F.col("w.w0").cast("long").alias("w0"), F.col("w.w1").cast("long").alias("w1"))


@query(f"SELECT key, ((s * (key % 301 - 150) + 128) >> 8)::BIGINT AS mv FROM {_DISTANCES}")
def temporal_mv_scale(spark, sf_dir):
    mv = prediction.scale_vector((F.col("key") % 301 - 150).cast("int"), prediction.distance_scale(F.col("current"), F.col("first"), F.col("second")))
    return distances(spark, sf_dir).select("key", mv.cast("long").alias("mv"))


@query("""
SELECT key, CASE WHEN n = 1 THEN CASE WHEN ra THEN a WHEN rb THEN b ELSE c END ELSE a + b + c - least(a, b, c) - greatest(a, b, c) END::BIGINT AS mv,
  ((a * 300 + 32768) % 65536 + 65536) % 65536 - 32768 AS wrapped
FROM (SELECT *, ra::INT + rb::INT + rc::INT AS n FROM (
  SELECT l_orderkey * 8 + l_linenumber AS key, l_orderkey % 401 - 200 AS a, l_partkey % 401 - 200 AS b, l_suppkey % 401 - 200 AS c,
         l_orderkey % 3 = 1 AS ra, l_partkey % 3 = 1 AS rb, l_suppkey % 3 = 1 AS rc FROM lineitem))""")
def mv_median(spark, sf_dir):
    names = ("l_orderkey", "l_partkey", "l_suppkey")
    vectors, refs = [F.col(n) % 401 - 200 for n in names], [F.col(n) % 3 for n in names]
    key = F.col("l_orderkey") * 8 + F.col("l_linenumber")
    mv = prediction.predicted_mv(vectors, refs, F.lit(1))
    return table(spark, sf_dir, "lineitem").select(key.alias("key"), mv.alias("mv"), prediction.wrap16(vectors[0] * 300).alias("wrapped"))


# Deblocking.
_EDGE = f"(SELECT key, qp, c, greatest(0, least(51, a)) AS ia, {deblock.ALPHA}[greatest(0, least(51, a)) + 1] AS al, {deblock.BETA}[greatest(0, least(51, b)) + 1] AS be FROM (SELECT *, ((qp + 45 + 1) >> 1) + key % 13 - 6 AS a, ((qp + 45 + 1) >> 1) + key % 11 - 5 AS b FROM {sql_lines(8)}))"


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks of eight samples around 100 with thresholds from their quantisers."""
    rows = lines(spark, sf_dir, 8)
    limits = deblock.thresholds(F.col("qp"), F.lit(45), (F.col("key") % 13 - 6).cast("int"), (F.col("key") % 11 - 5).cast("int"))
    return rows.withColumn("t", limits).withColumn("s", F.transform("c", lambda x: 100 + F.floor(x / 4).cast("int")))


@query(f"SELECT key, qp, ia::BIGINT AS index_a, al::BIGINT AS alpha, be::BIGINT AS beta FROM {_EDGE}")
def deblock_thresholds(spark, sf_dir):
    return edges(spark, sf_dir).select("key", "qp", *(F.col(f"t.{c}").cast("long").alias(c) for c in ("index_a", "alpha", "beta")))


@query("""SELECT l_orderkey * 8 + l_linenumber AS key, CASE WHEN l_linenumber <= 2 AND l_orderkey % 2 = 0 THEN 4 WHEN l_linenumber <= 2 THEN 3 WHEN l_partkey % 3 = 0 THEN 2
  WHEN l_suppkey % 2 = 1 OR abs(l_partkey % 11 - 5) >= 4 OR abs(l_suppkey % 13 - 6) >= 4 THEN 1 ELSE 0 END::BIGINT AS bs,
  (l_orderkey % 7 <> 0 AND l_linenumber % 3 <> 1 AND NOT (l_linenumber % 3 = 2 AND l_partkey % 2 = 0)) AS filtered FROM lineitem""")
def deblock_bs(spark, sf_dir):
    o, p, s, n = (F.col(c) for c in ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"))
    bs = deblock.strength(n <= 2, o % 2 == 0, p % 3 == 0, s % 2 != 1, p % 11 - 5, s % 13 - 6)
    on = deblock.filtered_edge(o % 7 == 0, n % 3, p % 2 != 0)
    return table(spark, sf_dir, "lineitem").select((o * 8 + n).alias("key"), bs.cast("long").alias("bs"), on.alias("filtered"))


_FILTER = f"""(SELECT *, abs(p0 - q0) < al AND abs(p1 - p0) < be AND abs(q1 - q0) < be AS f, abs(p2 - p0) AS ap, abs(q2 - q0) AS aq FROM (
  SELECT *, v[1] AS p3, v[2] AS p2, v[3] AS p1, v[4] AS p0, v[5] AS q0, v[6] AS q1, v[7] AS q2, v[8] AS q3 FROM (
    SELECT *, list_transform(c, lambda x: 100 + floor(x / 4)::INT) AS v FROM {_EDGE})))"""


def _line_query(kernel, bs):
    def run(spark, sf_dir):
        t = F.col("t")
        return edges(spark, sf_dir).select("key", "qp", joined(kernel(F.col("s"), bs(F.col("key")), t["index_a"], t["alpha"], t["beta"])).alias("result"))

    return run


query(f"""SELECT key, qp, array_to_string(list_transform(CASE WHEN NOT f THEN v ELSE [p3,
  CASE WHEN ap < be AND d THEN (2 * p3 + 3 * p2 + p1 + p0 + q0 + 4) >> 3 ELSE p2 END, CASE WHEN ap < be AND d THEN (p2 + p1 + p0 + q0 + 2) >> 2 ELSE p1 END,
  CASE WHEN ap < be AND d THEN (p2 + 2 * p1 + 2 * p0 + 2 * q0 + q1 + 4) >> 3 ELSE (2 * p1 + p0 + q1 + 2) >> 2 END,
  CASE WHEN aq < be AND d THEN (p1 + 2 * p0 + 2 * q0 + 2 * q1 + q2 + 4) >> 3 ELSE (2 * q1 + q0 + p1 + 2) >> 2 END,
  CASE WHEN aq < be AND d THEN (p0 + q0 + q1 + q2 + 2) >> 2 ELSE q1 END, CASE WHEN aq < be AND d THEN (2 * q3 + 3 * q2 + q1 + q0 + p0 + 4) >> 3 ELSE q2 END, q3] END, lambda x: x::BIGINT), ',') AS result
FROM (SELECT *, abs(p0 - q0) < (al >> 2) + 2 AS d FROM {_FILTER})""", "deblock_line_strong")(_line_query(deblock.luma_line, lambda key: F.lit(4)))

_WEAK = f"""(SELECT *, greatest(-tc, least(tc, (4 * (q0 - p0) + (p1 - q1) + 4) >> 3)) AS dl FROM (
  SELECT *, tc0 + {{0}} AS tc FROM (SELECT *, {deblock.TC0}[key % 3 + 1][ia + 1] AS tc0 FROM {_FILTER})))"""
query(f"""SELECT key, qp, array_to_string(list_transform(CASE WHEN NOT f THEN v ELSE [p3, p2,
  CASE WHEN ap < be THEN p1 + greatest(-tc0, least(tc0, (p2 + ((p0 + q0 + 1) >> 1) - 2 * p1) >> 1)) ELSE p1 END, greatest(0, least(255, p0 + dl)), greatest(0, least(255, q0 - dl)),
  CASE WHEN aq < be THEN q1 + greatest(-tc0, least(tc0, (q2 + ((p0 + q0 + 1) >> 1) - 2 * q1) >> 1)) ELSE q1 END, q2, q3] END, lambda x: x::BIGINT), ',') AS result
FROM {_WEAK.format("(ap < be)::INT + (aq < be)::INT")}""", "deblock_line_weak")(_line_query(deblock.luma_line, lambda key: (key % 3 + 1).cast("int")))
query(f"""SELECT key, qp, array_to_string(list_transform(CASE WHEN NOT f THEN [p1, p0, q0, q1] ELSE [p1, greatest(0, least(255, p0 + dl)), greatest(0, least(255, q0 - dl)), q1] END, lambda x: x::BIGINT), ',') AS result
FROM {_WEAK.format("1")}""", "deblock_line_chroma")(_line_query(lambda s, *rest: deblock.chroma_line(F.slice(s, 3, 4), *rest), lambda key: (key % 3 + 1).cast("int")))
