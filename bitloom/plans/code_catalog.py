"""Registered queries of coefficient tokens, whole coded blocks, type trees and unary and Exp-Golomb parts, each with the same result in DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from bitloom.operators import codes as C
from bitloom.operators import macroblocks as M
from bitloom.plans.catalog import joined, query, table

KEY = "l_orderkey * 8 + l_linenumber AS key"
_MIXED = "(l_orderkey * 7919 + l_partkey * 104729 + l_suppkey * 31 + l_linenumber)"

# Fixed values of the SQL: lengths and values of the tokens' codes by least nC and trailing ones, from that number of coefficients on.
_TOKENS = """(VALUES
  (0, 0, [1, 6, 8, 9, 10, 11, 13, 13, 13, 14, 14, 15, 15, 16, 16, 16, 16], [1, 5, 7, 7, 7, 7, 15, 11, 8, 15, 11, 15, 11, 15, 11, 7, 4]),
  (0, 1, [2, 6, 8, 9, 10, 11, 13, 13, 14, 14, 15, 15, 15, 16, 16, 16], [1, 4, 6, 6, 6, 6, 14, 10, 14, 10, 14, 10, 1, 14, 10, 6]),
  (0, 2, [3, 7, 8, 9, 10, 11, 13, 13, 14, 14, 15, 15, 16, 16, 16], [1, 5, 5, 5, 5, 5, 13, 9, 13, 9, 13, 9, 13, 9, 5]),
  (0, 3, [5, 6, 7, 8, 9, 10, 11, 13, 14, 14, 15, 15, 16, 16], [3, 3, 4, 4, 4, 4, 4, 12, 12, 8, 12, 8, 12, 8]),
  (2, 0, [2, 6, 6, 7, 8, 8, 9, 11, 11, 12, 12, 12, 13, 13, 13, 14, 14], [3, 11, 7, 7, 7, 4, 7, 15, 11, 15, 11, 8, 15, 11, 7, 9, 7]),
  (2, 1, [2, 5, 6, 6, 7, 8, 9, 11, 11, 12, 12, 13, 13, 14, 14, 14], [2, 7, 10, 6, 6, 6, 6, 14, 10, 14, 10, 14, 10, 11, 8, 6]),
  (2, 2, [3, 6, 6, 7, 8, 9, 11, 11, 12, 12, 13, 13, 13, 14, 14], [3, 9, 5, 5, 5, 5, 13, 9, 13, 9, 13, 9, 6, 10, 5]),
  (2, 3, [4, 4, 5, 6, 6, 7, 9, 11, 11, 12, 13, 13, 13, 14], [5, 4, 6, 8, 4, 4, 4, 12, 8, 12, 12, 8, 1, 4]),
  (4, 0, [4, 6, 6, 6, 7, 7, 7, 7, 8, 8, 9, 9, 9, 10, 10, 10, 10], [15, 15, 11, 8, 15, 11, 9, 8, 15, 11, 15, 11, 8, 13, 9, 5, 1]),
  (4, 1, [4, 5, 5, 5, 5, 6, 6, 7, 8, 8, 9, 9, 9, 10, 10, 10], [14, 15, 12, 10, 8, 14, 10, 14, 14, 10, 14, 10, 7, 12, 8, 4]),
  (4, 2, [4, 5, 5, 5, 6, 6, 7, 7, 8, 8, 9, 9, 10, 10, 10], [13, 14, 11, 9, 13, 9, 13, 10, 13, 9, 13, 9, 11, 7, 3]),
  (4, 3, [4, 4, 4, 4, 4, 5, 6, 7, 8, 8, 9, 10, 10, 10], [12, 11, 10, 9, 8, 13, 12, 12, 12, 8, 12, 10, 6, 2]),
  (-1, 0, [2, 6, 6, 6, 6], [1, 7, 4, 3, 2]),
  (-1, 1, [1, 6, 7, 8], [1, 6, 3, 3]),
  (-1, 2, [3, 7, 8], [1, 2, 2]),
  (-1, 3, [6, 7], [5, 0])) AS t(least, ones, sizes, vals)"""


def _shifted(width: int) -> str:
    """``width`` bits, of which the key clears up to eight more at the start, so that long codes come up."""
    return f"lpad(bin(({_MIXED} % {1 << width}) >> (l_orderkey % 9)::INT), {width}, '0')"


@query(f"""WITH r AS (SELECT {KEY}, l_partkey % 12 - 1 AS nc, substring({_shifted(20)}, 1, 12 + l_suppkey % 9) AS bits FROM lineitem),
codes AS (SELECT least, ones, ones + i - 1 AS coefficients, sizes[i] AS length, lpad(bin(vals[i]), sizes[i], '0') AS code FROM (SELECT *, unnest(range(1, len(sizes) + 1)) AS i FROM {_TOKENS})),
fixed AS (SELECT 8, t, n, 6, lpad(bin(4 * n + t - 4), 6, '0') FROM range(1, 17) a(n), range(0, 4) b(t) WHERE t <= n UNION ALL SELECT 8, 0, 0, 6, '000011')
SELECT key, nc::INT AS nc, coefficients::INT AS coefficients, c.ones::INT AS ones, length::INT AS length FROM r
LEFT JOIN (SELECT * FROM codes UNION ALL SELECT * FROM fixed) c ON c.least = CASE WHEN nc < 0 THEN -1 WHEN nc < 2 THEN 0 WHEN nc < 4 THEN 2 WHEN nc < 8 THEN 4 ELSE 8 END AND starts_with(bits, code)""")
def coefficient_tokens(spark, sf_dir):
    mixed = F.expr(_MIXED)
    bits = F.lpad(F.bin(F.call_function("shiftright", mixed % (1 << 20), (F.col("l_orderkey") % 9).cast("int"))), 20, "0")
    rows = table(spark, sf_dir, "lineitem").select(F.expr(KEY), (F.col("l_partkey") % 12 - 1).cast("int").alias("nc"), F.substring(bits, F.lit(1), (12 + F.col("l_suppkey") % 9).cast("int")).alias("bits"), F.lit(0).alias("pos"))
    return C.with_tokens(rows).select("key", "nc", "coefficients", "ones", "length")


def _code(table_: dict, key: Column) -> Column:
    return F.try_element_at(F.create_map(*(F.lit(x) for item in table_.items() for x in item)), key)


def _level_code(level: Column, ones: Column) -> Column:
    """Bits of a block's first level after its ones, in blocks of up to ten coefficients."""
    code = F.when(level > 0, 2 * level - 2).otherwise(-2 * level - 1) - F.when(ones < 3, 2).otherwise(0)
    short = F.concat(F.expr("repeat('0', code)"), F.lit("1"))
    escaped = F.concat(F.lit("0" * 14 + "1"), F.lpad(F.bin(F.col("code") - 14), 4, "0"))
    long_ = F.concat(F.lit("0" * 15 + "1"), F.lpad(F.bin(F.col("code") - 30), 12, "0"))
    return code, F.when(F.col("code") < 14, short).when(F.col("code") < 30, escaped).otherwise(long_)


@query(f"""SELECT key, array_to_string(list_concat(list_transform(range(CASE WHEN ones = 0 THEN z ELSE z - r END), lambda i: 0), [level],
  list_transform(range(1, ones), lambda i: CASE WHEN (key >> (ones - i)) % 2 = 1 THEN -1 ELSE 1 END), CASE WHEN ones = 0 THEN [] ELSE list_concat(list_transform(range(r), lambda i: 0), [CASE WHEN key % 2 = 1 THEN -1 ELSE 1 END]) END,
  list_transform(range(15 - ones - z), lambda i: 0)), ',') AS block, total::INT AS left_over
FROM (SELECT *, least(z, l_linenumber % 3) AS r, (key % 3) AS total FROM (SELECT {KEY}, l_linenumber, (l_partkey % 4)::INT AS ones, (CASE WHEN l_orderkey % 3 = 0 THEN -1 ELSE 1 END) * (2 + l_suppkey * 7 % 60) AS level, (l_orderkey % (16 - l_partkey % 4))::INT AS z FROM lineitem))""")
def coded_blocks(spark, sf_dir):
    """Blocks written as tokens, signs, a level, zeros and runs, with up to two bits after them, and read again."""
    ones, z, r, n = (F.col(c) for c in ("ones", "z", "r", "n"))
    rows = table(spark, sf_dir, "lineitem").select(
        F.expr(KEY), "l_linenumber", (F.col("l_partkey") % 4).cast("int").alias("ones"), (F.when(F.col("l_orderkey") % 3 == 0, -1).otherwise(1) * (2 + F.col("l_suppkey") * 7 % 60)).cast("int").alias("level"),
        (F.col("l_orderkey") % (16 - F.col("l_partkey") % 4)).cast("int").alias("z"), (F.col("l_partkey") % 10).cast("int").alias("nc"),
    )
    rows = rows.withColumns({"n": ones + 1, "r": F.least(z, (F.col("l_linenumber") % 3).cast("int"))})
    tokens = {f"{least}:{o}:{o + i}": code for least, by_ones in C.TOKEN_CODES.items() for o, codes in enumerate(by_ones) for i, code in enumerate(codes)}
    class_ = F.when(F.col("nc") < 2, 0).when(F.col("nc") < 4, 2).otherwise(4)
    fixed = F.lpad(F.bin(4 * n - 4 + ones), 6, "0")
    token = F.when(F.col("nc") >= 8, fixed).otherwise(_code(tokens, F.concat_ws(":", class_, ones, n)))
    signs = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(2)), lambda i: F.when(i < ones, (F.call_function("shiftright", F.col("key"), i) % 2).cast("string")).otherwise("")), "")
    code, level = _level_code(F.col("level"), ones)
    zeros = _code({f"{k}:{i}": c for k, codes in M.ZERO_CODES[16].items() for i, c in enumerate(codes)}, F.concat_ws(":", n, z))
    known = {f"{k}:{i}": c for k, codes in M.RUN_CODES.items() for i, c in enumerate(codes)}

    def run(left: Column, zeros_: Column) -> Column:
        return F.when(left > 0, _code(known, F.concat_ws(":", F.least(left, F.lit(7)), zeros_))).otherwise("")

    runs = F.concat(F.when(n > 1, run(z, r)).otherwise(""), *(F.when(n > k, run(z - r, F.lit(0))).otherwise("") for k in (2, 3)))
    more = (F.col("key") % 3).cast("int")
    bits = F.concat(token, signs, level, zeros, runs, F.expr("repeat('1', cast(key % 3 as int))"))
    rows = rows.withColumn("code", code.cast("int")).select("key", "nc", F.lit(16).alias("size"), bits.alias("bits"), F.lit(0).alias("pos"), more.alias("more"))
    return C.read_blocks(rows, (16,)).select("key", joined(F.col("block")).alias("block"), (F.length("bits") - F.col("end")).cast("int").alias("left_over"))


_INTRA_BINS = "['0', '100000', '100001', '100010', '100011', '1001000', '1001001', '1001010', '1001011', '1001100', '1001101', '1001110', '1001111', '101000', '101001', '101010', '101011', '1011000', '1011001', '1011010', '1011011', '1011100', '1011101', '1011110', '1011111', '11']"
_B_BINS = "['0', '100', '101', '110000', '110001', '110010', '110011', '110100', '110101', '110110', '110111', '111110', '1110000', '1110001', '1110010', '1110011', '1110100', '1110101', '1110110', '1110111', '1111000', '1111001', '111111']"
_TREES = f"""(SELECT 'I' AS tree, unnest({_INTRA_BINS}) AS code, unnest(range(26)) AS number UNION ALL SELECT 'P', unnest(['000', '011', '010', '001']), unnest(range(4))
  UNION ALL SELECT 'P', '1' || unnest({_INTRA_BINS}), unnest(range(5, 31)) UNION ALL SELECT 'B', unnest({_B_BINS}), unnest(range(23)) UNION ALL SELECT 'B', '111101' || unnest({_INTRA_BINS}), unnest(range(23, 49))
  UNION ALL SELECT 'P_sub', unnest(['1', '00', '011', '010']), unnest(range(4)) UNION ALL SELECT 'B_sub', unnest(['0', '100', '101', '11000', '11001', '11010', '11011', '111000', '111001', '111010', '111011', '11110', '11111']), unnest(range(13)))"""


@query(f"""SELECT key, r.tree, number::INT AS number, length(code)::INT AS size FROM
  (SELECT {KEY}, ['I', 'P', 'B', 'P_sub', 'B_sub'][l_suppkey % 5 + 1] AS tree, CASE WHEN l_orderkey % 4 = 0 THEN '111101' ELSE '' END || substring(lpad(bin({_MIXED} % 4096), 12, '0'), 1, 1 + l_partkey % 12) AS bins FROM lineitem) r
  LEFT JOIN {_TREES} t ON r.tree = t.tree AND starts_with(bins, code)""")
def type_trees(spark, sf_dir):
    tree = F.get(F.array(*map(F.lit, ("I", "P", "B", "P_sub", "B_sub"))), (F.col("l_suppkey") % 5).cast("int"))
    bins = F.concat(F.when(F.col("l_orderkey") % 4 == 0, "111101").otherwise(""), F.substring(F.lpad(F.bin(F.expr(_MIXED) % 4096), 12, "0"), F.lit(1), (1 + F.col("l_partkey") % 12).cast("int")))
    rows = table(spark, sf_dir, "lineitem").select(F.expr(KEY), tree.alias("tree"), bins.alias("bins"))
    return rows.select("key", "tree", C.walked(F.col("tree"), F.col("bins"), F.lit(0)).alias("t")).select("key", "tree", "t.number", "t.size")


def _sql_parts(k: int, cutoff: int, signed: bool) -> str:
    """The formula: ones up to the cutoff, then ones m, and m + k bits after a zero."""
    short = "ones < {c}".format(c=cutoff)
    tail = f"substring(bins, {cutoff} + m + 2, m + {k})"
    value = f"CASE WHEN {short} THEN ones WHEN m IS NOT NULL AND length({tail}) = m + {k} THEN {cutoff} + (((1 << m) - 1) << {k}) + CASE WHEN m + {k} > 0 THEN ('0b' || lpad({tail}, 30, '0'))::INT ELSE 0 END END"
    size = f"CASE WHEN {short} THEN ones + 1 ELSE {cutoff} + 2 * m + 1 + {k} END"
    rest = "substring(bins, {c} + 1)".format(c=cutoff)
    ones = "CASE WHEN instr(bins, '0') > 0 THEN instr(bins, '0') - 1 ELSE length(bins) + 99 END"
    m = f"CASE WHEN length(bins) >= {cutoff} AND instr({rest}, '0') > 0 THEN instr({rest}, '0') - 1 END"
    inner = f"SELECT key, bins, {value} AS v, {size} AS s FROM (SELECT *, {ones} AS ones, {m} AS m FROM b)"
    if not signed:
        return f"SELECT key, bins, v, CASE WHEN v IS NOT NULL THEN s END AS s FROM ({inner})"
    return f"SELECT key, bins, CASE WHEN v = 0 THEN 0 WHEN substring(bins, s + 1, 1) = '1' THEN -v WHEN substring(bins, s + 1, 1) = '0' THEN v END AS v, CASE WHEN v = 0 THEN s WHEN v IS NOT NULL AND length(bins) > s THEN s + 1 END AS s FROM ({inner})"


@query(f"""WITH b AS (SELECT {KEY}, repeat('1', (l_partkey % 20)::INT) || lpad(bin({_MIXED} % 65536), 16, '0') AS bins FROM lineitem)
SELECT key, d.v::INT AS difference, d.s::INT AS difference_size, l.v::INT AS level, l.s::INT AS level_size FROM ({_sql_parts(3, 9, True)}) d JOIN (SELECT DISTINCT * FROM ({_sql_parts(0, 14, False)})) l USING (key, bins)""")
def unary_exp_golomb_bins(spark, sf_dir):
    bins = F.concat(F.expr("repeat('1', cast(l_partkey % 20 as int))"), F.lpad(F.bin(F.expr(_MIXED) % 65536), 16, "0"))
    rows = table(spark, sf_dir, "lineitem").select(F.expr(KEY), bins.alias("bins"))
    d, level = C.unary_exp_golomb(F.col("bins"), F.lit(0), 3, 9, True), C.unary_exp_golomb(F.col("bins"), F.lit(0), 0, 14, False)
    return rows.select("key", d.alias("d"), level.alias("l")).select("key", F.col("d.value").alias("difference"), F.col("d.size").alias("difference_size"), F.col("l.value").alias("level"), F.col("l.size").alias("level_size"))
