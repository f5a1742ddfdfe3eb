"""Codes of levels, types and differences as data: coefficient tokens, whole blocks, type trees, and codes of unary and Exp-Golomb parts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from bitloom.functions.bits import leading_zeros, u
from bitloom.functions.let import let
from bitloom.operators import coefficients as K
from bitloom.operators import macroblocks as M

# Codes of the number of coefficients (from the number of ones on) by the least nC of their class, -1 for chroma DC, and by trailing ones 0 to 3.
TOKEN_CODES = {
    0: [
        ["1", "000101", "00000111", "000000111", "0000000111", "00000000111", "0000000001111", "0000000001011", "0000000001000", "00000000001111", "00000000001011", "000000000001111", "000000000001011", "0000000000001111", "0000000000001011", "0000000000000111", "0000000000000100"],
        ["01", "000100", "00000110", "000000110", "0000000110", "00000000110", "0000000001110", "0000000001010", "00000000001110", "00000000001010", "000000000001110", "000000000001010", "000000000000001", "0000000000001110", "0000000000001010", "0000000000000110"],
        ["001", "0000101", "00000101", "000000101", "0000000101", "00000000101", "0000000001101", "0000000001001", "00000000001101", "00000000001001", "000000000001101", "000000000001001", "0000000000001101", "0000000000001001", "0000000000000101"],
        ["00011", "000011", "0000100", "00000100", "000000100", "0000000100", "00000000100", "0000000001100", "00000000001100", "00000000001000", "000000000001100", "000000000001000", "0000000000001100", "0000000000001000"],
    ],
    2: [
        ["11", "001011", "000111", "0000111", "00000111", "00000100", "000000111", "00000001111", "00000001011", "000000001111", "000000001011", "000000001000", "0000000001111", "0000000001011", "0000000000111", "00000000001001", "00000000000111"],
        ["10", "00111", "001010", "000110", "0000110", "00000110", "000000110", "00000001110", "00000001010", "000000001110", "000000001010", "0000000001110", "0000000001010", "00000000001011", "00000000001000", "00000000000110"],
        ["011", "001001", "000101", "0000101", "00000101", "000000101", "00000001101", "00000001001", "000000001101", "000000001001", "0000000001101", "0000000001001", "0000000000110", "00000000001010", "00000000000101"],
        ["0101", "0100", "00110", "001000", "000100", "0000100", "000000100", "00000001100", "00000001000", "000000001100", "0000000001100", "0000000001000", "0000000000001", "00000000000100"],
    ],
    4: [
        ["1111", "001111", "001011", "001000", "0001111", "0001011", "0001001", "0001000", "00001111", "00001011", "000001111", "000001011", "000001000", "0000001101", "0000001001", "0000000101", "0000000001"],
        ["1110", "01111", "01100", "01010", "01000", "001110", "001010", "0001110", "00001110", "00001010", "000001110", "000001010", "000000111", "0000001100", "0000001000", "0000000100"],
        ["1101", "01110", "01011", "01001", "001101", "001001", "0001101", "0001010", "00001101", "00001001", "000001101", "000001001", "0000001011", "0000000111", "0000000011"],
        ["1100", "1011", "1010", "1001", "1000", "01101", "001100", "0001100", "00001100", "00001000", "000001100", "0000001010", "0000000110", "0000000010"],
    ],
    -1: [
        ["01", "000111", "000100", "000011", "000010"],
        ["1", "000110", "0000011", "00000011"],
        ["001", "0000010", "00000010"],
        ["000101", "0000000"],
    ],
}
#: A code is zeros, a one and at most this many bits.
TOKEN_REST = 3
#: Length of the codes from nC = 8 on, which are numbers.
FIXED = 6
#: The chroma DC code without a one.
ALL_ZEROS = 7


def token_codes(spark: SparkSession) -> DataFrame:
    """(class, zeros, rest, coefficients, ones, length): what the leading zeros of a code and the three bits after its first one stand for; at most 480 rows."""
    rows = []
    for least, table in TOKEN_CODES.items():
        for ones, codes in enumerate(table):
            for more, code in enumerate(codes):
                zeros, _, rest = code.partition("1")
                free = TOKEN_REST - len(rest)
                rows += [(least, len(zeros), f"{rest}{n:0{free}b}" if free else rest, ones + more, ones, len(code)) for n in range(1 << free)]
    return spark.createDataFrame(rows, "class int, zeros int, rest string, coefficients int, ones int, length int")


def with_tokens(rows: DataFrame) -> DataFrame:
    """``rows`` (nc, bits, pos) with coefficients, ones and length of the token at pos; null for no code and one that is cut off.

    nc is the mean of the neighbours' counts, -1 for chroma DC. An equi-join with
    a table of fixed size: the class, the leading zeros and three bits tell a code.
    """
    nc, bits, pos = F.col("nc"), F.col("bits"), F.col("pos")
    left = F.length(bits) - pos
    zeros = F.coalesce(leading_zeros(bits, pos), left)
    zeros = F.when((nc < 0) & (left >= ALL_ZEROS), F.least(zeros, F.lit(ALL_ZEROS))).otherwise(zeros)
    rest = F.rpad(F.substring(bits, pos + F.col("zeros") + 2, F.lit(TOKEN_REST)), TOKEN_REST, "0")
    class_ = F.when(nc < 0, -1).when(nc < 2, 0).when(nc < 4, 2).when(nc < 8, 4)
    keyed = rows.withColumns({"class": class_, "zeros": zeros.cast("int")}).withColumn("rest", rest)
    found = keyed.join(F.broadcast(token_codes(rows.sparkSession)), ["class", "zeros", "rest"], "left")

    def fixed(v: Column) -> Column:
        n, ones = F.shiftright(v["code"], 2) + 1, v["code"] % 4
        made = F.when(v["code"] == 3, F.struct(F.lit(0).alias("coefficients"), F.lit(0).alias("ones"), F.lit(FIXED).alias("length")))
        return made.when((ones <= n) & v["code"].isNotNull(), F.struct(n.alias("coefficients"), ones.alias("ones"), F.lit(FIXED).alias("length")))

    number = let(fixed, code=u(bits, pos, F.lit(FIXED)).cast("int"))
    looked = F.when(F.col("length") <= left, F.struct("coefficients", "ones", "length"))
    token = F.when(nc >= 8, number).otherwise(looked)
    return found.withColumn("token", token).drop("class", "zeros", "rest", "coefficients", "ones", "length").select("*", "token.*").drop("token")


def read_blocks(rows: DataFrame, sizes: tuple[int, ...] = (4, 15, 16)) -> DataFrame:
    """``rows`` (nc, size, bits, pos) with block, the coefficients in scan order, and end, the position after them; null where the bits are no such block or are cut off.

    ``size`` is one of ``sizes``. A token is found by a join with a table of
    fixed size; the levels, the total of zeros and the runs before each are read
    by one kernel.
    """
    keep = rows.columns
    start = with_tokens(rows)
    made = K.block(F.col("bits"), F.col("pos") + F.col("length"), F.col("size"), F.col("coefficients"), F.col("ones"), sizes)
    return start.withColumn("made", made).select(*keep, "made.block", "made.end")


def runs_to(bits: Column, pos: Column, coefficients: Column, zeros: Column) -> Column:
    """struct<pos, runs>: the zeros before each coefficient, the last coefficient first, and the position after their codes; null if one is cut off."""

    def step(state: Column, i: Column) -> Column:
        def read(v: Column) -> Column:
            run = F.when(i == coefficients, state["left"]).otherwise(v["c"]["run"])
            size = F.when(i == coefficients, 0).otherwise(v["c"]["size"])
            return F.struct((state["pos"] + size).cast("int").alias("pos"), (state["left"] - run).cast("int").alias("left"), F.concat(state["runs"], F.array(run.cast("int"))).alias("runs"))

        return let(read, c=M.run_of_zeros(bits, state["pos"], state["left"]))

    none = F.array().cast("array<int>")
    start = F.struct(pos.cast("int").alias("pos"), zeros.cast("int").alias("left"), none.alias("runs"))
    done = F.aggregate(F.when(coefficients > 0, F.sequence(F.lit(1), coefficients.cast("int"))).otherwise(none.cast("array<int>")), start, step)
    return let(lambda v: F.when(v["d"]["left"] >= 0, F.struct(v["d"]["pos"].alias("pos"), v["d"]["runs"].alias("runs"))), d=done)


# Bins of the macroblock types of P and B slices and of the sub-macroblock types by number; INTRA goes before the bins of an intra type.
P_BINS = ["000", "011", "010", "001"]
B_BINS = ["0", "100", "101", "110000", "110001", "110010", "110011", "110100", "110101", "110110", "110111", "111110", "1110000", "1110001", "1110010", "1110011", "1110100", "1110101", "1110110", "1110111", "1111000", "1111001", "111111"]
P_SUB_BINS = ["1", "00", "011", "010"]
B_SUB_BINS = ["0", "100", "101", "11000", "11001", "11010", "11011", "111000", "111001", "111010", "111011", "11110", "11111"]
INTRA = {"P": "1", "B": "111101"}


def intra_bins() -> list[str]:
    """Bins of the intra types: 4x4, the 16x16 types by luma, chroma and mode, and raw, the only one whose second bin is 1."""
    chroma = ["0", "10", "11"]
    return ["0", *(f"10{luma}{c}{mode:02b}" for luma in (0, 1) for c in chroma for mode in range(4)), "11"]


def type_bins() -> dict[str, dict[str, int]]:
    """Bins of each tree and the number that they stand for; intra types of P and B slices follow their own, from 5 and 23 on."""
    trees = {"I": intra_bins(), "P": P_BINS, "B": B_BINS, "P_sub": P_SUB_BINS, "B_sub": B_SUB_BINS}
    made = {name: {bins: no for no, bins in enumerate(codes)} for name, codes in trees.items()}
    for name, first in (("P", 5), ("B", 23)):
        made[name] |= {INTRA[name] + bins: first + no for no, bins in enumerate(intra_bins())}
    return made


def tree_nodes() -> list[tuple[str, str, str, int | None]]:
    """(tree, node, bit, number): every edge of the trees, a node being the bins before it; the number is null for edges to inner nodes."""
    edges = {}
    for tree, codes in type_bins().items():
        for bins, number in codes.items():
            for i in range(len(bins)):
                edges[tree, bins[:i], bins[i]] = number if i == len(bins) - 1 else None
    return [(*edge, number) for edge, number in sorted(edges.items())]


def walked(tree: Column, bins: Column, pos: Column) -> Column:
    """struct<number, size> of the type whose bins are at pos in this tree; null if they are cut off.

    One step an edge: the node's name and the next bin are looked up among the edges, of which there is a fixed number.
    """
    longest = max(len(b) for codes in type_bins().values() for b in codes)
    edges = [(f"{t}:{node}{bit}", number) for t, node, bit, number in tree_nodes()]
    known = F.create_map(*(x for k, number in edges for x in (F.lit(k), F.lit(-1 if number is None else number))))

    def step(state: Column, i: Column) -> Column:
        def take(v: Column) -> Column:
            there = F.struct(v["node"].alias("node"), F.try_element_at(known, v["node"]).alias("number"), (i + 1).alias("size"))
            return F.when((state["number"] == -1) & (pos + i < F.length(bins)), there).otherwise(state)

        return let(take, node=F.concat(state["node"], F.substring(bins, pos + i + 1, F.lit(1))))

    start = F.struct(F.concat(tree, F.lit(":")).alias("node"), F.lit(-1).alias("number"), F.lit(0).alias("size"))
    end = F.aggregate(F.sequence(F.lit(0), F.lit(longest - 1)), start, step)
    return let(lambda v: F.when(v["e"]["number"] >= 0, F.struct(v["e"]["number"].alias("number"), v["e"]["size"].alias("size"))), e=end)


def _ones(bins: Column, pos: Column) -> Column:
    """Ones from pos to the next zero; null if there is none."""
    at = F.position(F.lit("0"), bins, pos + 1)
    return F.when(at > 0, at - 1 - pos)


def truncated_unary(bins: Column, pos: Column, largest: int) -> Column:
    """struct<value, size>: ones up to a zero, or ``largest`` of them without one; null if it is cut off."""

    def made(v: Column) -> Column:
        n, left = v["n"], F.length(bins) - pos
        short = F.when(n < largest, F.struct(n.alias("value"), (n + 1).alias("size")))
        full = F.coalesce(n >= largest, left >= largest)
        return F.coalesce(short, F.when(full, F.struct(F.lit(largest).alias("value"), F.lit(largest).alias("size"))))

    return let(made, n=_ones(bins, pos).cast("int"))


def exp_golomb_k(bins: Column, pos: Column, k: int) -> Column:
    """struct<value, size> of the Exp-Golomb code of order k in bins: ones up to a zero, and a bit more than k for each of them; null if it is cut off."""

    def made(v: Column) -> Column:
        n = v["n"]
        tail = u(bins, pos + n + 1, n + k)
        value = (F.call_function("shiftleft", F.lit(1), n) - 1) * (1 << k) + tail
        return F.when(tail.isNotNull(), F.struct(value.cast("int").alias("value"), (2 * n + 1 + k).alias("size")))

    return let(made, n=_ones(bins, pos).cast("int"))


def unary_exp_golomb(bins: Column, pos: Column, k: int, cutoff: int, signed: bool) -> Column:
    """struct<value, size>: a unary part up to ``cutoff``, beyond it an Exp-Golomb part of order k, and a sign if there is one and the value is not 0; null if it is cut off.

    Vector differences have k 3, cutoff 9 and a sign, levels less one k 0, cutoff 14 and none.
    """

    def rest(v: Column) -> Column:
        p = v["p"]
        plain = F.struct(p["value"].cast("int").alias("value"), p["size"].cast("int").alias("size"))
        both = let(lambda w: F.when(w["s"].isNotNull(), F.struct((p["value"] + w["s"]["value"]).cast("int").alias("value"), (p["size"] + w["s"]["size"]).cast("int").alias("size"))), s=exp_golomb_k(bins, pos + p["size"], k))
        return F.when(p["value"] < cutoff, plain).when(p["value"] == cutoff, both)

    def sign(v: Column) -> Column:
        m = v["m"]
        bit = u(bins, pos + m["size"], F.lit(1))
        with_sign = F.when(bit.isNotNull(), F.struct(F.when(bit == 1, -m["value"]).otherwise(m["value"]).alias("value"), (m["size"] + 1).alias("size")))
        return F.when(m["value"] == 0, m).otherwise(with_sign)

    size = let(rest, p=truncated_unary(bins, pos, cutoff))
    return let(sign, m=size) if signed else size
