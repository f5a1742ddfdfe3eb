"""Macroblock syntax as data: type properties, coded-block patterns, predicted modes and references, runs of zeros."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from bitloom.functions.bits import leading_zeros
from bitloom.functions.let import let

# The coded block pattern of each code number, for intra and for inter macroblocks.
INTRA_PATTERN = [47, 31, 15, 0, 23, 27, 29, 30, 7, 11, 13, 14, 39, 43, 45, 46, 16, 3, 5, 10, 12, 19, 21, 26, 28, 35, 37, 42, 44, 1, 2, 4, 8, 17, 18, 20, 24, 6, 9, 22, 25, 32, 33, 34, 36, 40, 38, 41]
INTER_PATTERN = [0, 16, 1, 2, 4, 8, 32, 3, 5, 10, 12, 15, 47, 7, 11, 13, 14, 6, 9, 31, 35, 37, 42, 44, 33, 34, 36, 40, 39, 43, 45, 46, 17, 18, 20, 24, 19, 21, 26, 28, 23, 27, 29, 30, 22, 25, 38, 41]
# Names of the macroblock types of P and B slices by number.
P_TYPES = ["P_L0_16x16", "P_L0_L0_16x8", "P_L0_L0_8x16", "P_8x8", "P_8x8ref0"]
B_TYPES = [
    "B_Direct_16x16", "B_L0_16x16", "B_L1_16x16", "B_Bi_16x16", "B_L0_L0_16x8", "B_L0_L0_8x16", "B_L1_L1_16x8", "B_L1_L1_8x16", "B_L0_L1_16x8", "B_L0_L1_8x16", "B_L1_L0_16x8", "B_L1_L0_8x16",
    "B_L0_Bi_16x8", "B_L0_Bi_8x16", "B_L1_Bi_16x8", "B_L1_Bi_8x16", "B_Bi_L0_16x8", "B_Bi_L0_8x16", "B_Bi_L1_16x8", "B_Bi_L1_8x16", "B_Bi_Bi_16x8", "B_Bi_Bi_8x16", "B_8x8",
]
# Codes of the run of zeros 0, 1, 2, ... by how many zeros are left, 7 standing for more than 6.
RUN_CODES = {
    1: ["1", "0"],
    2: ["1", "01", "00"],
    3: ["11", "10", "01", "00"],
    4: ["11", "10", "01", "001", "000"],
    5: ["11", "10", "011", "010", "001", "000"],
    6: ["11", "000", "001", "011", "010", "101", "100"],
    7: ["111", "110", "101", "100", "011", "010", "001"],
}
# Codes of the total of zeros 0, 1, 2, ... by the number of coefficients, for blocks of 15 or 16 and for the chroma DC blocks of 4 and of 8.
ZERO_CODES = {
    16: {
        1: ["1", "011", "010", "0011", "0010", "00011", "00010", "000011", "000010", "0000011", "0000010", "00000011", "00000010", "000000011", "000000010", "000000001"],
        2: ["111", "110", "101", "100", "011", "0101", "0100", "0011", "0010", "00011", "00010", "000011", "000010", "000001", "000000"],
        3: ["0101", "111", "110", "101", "0100", "0011", "100", "011", "0010", "00011", "00010", "000001", "00001", "000000"],
        4: ["00011", "111", "0101", "0100", "110", "101", "100", "0011", "011", "0010", "00010", "00001", "00000"],
        5: ["0101", "0100", "0011", "111", "110", "101", "100", "011", "0010", "00001", "0001", "00000"],
        6: ["000001", "00001", "111", "110", "101", "100", "011", "010", "0001", "001", "000000"],
        7: ["000001", "00001", "101", "100", "011", "11", "010", "0001", "001", "000000"],
        8: ["000001", "0001", "00001", "011", "11", "10", "010", "001", "000000"],
        9: ["000001", "000000", "0001", "11", "10", "001", "01", "00001"],
        10: ["00001", "00000", "001", "11", "10", "01", "0001"],
        11: ["0000", "0001", "001", "010", "1", "011"],
        12: ["0000", "0001", "01", "1", "001"],
        13: ["000", "001", "1", "01"],
        14: ["00", "01", "1"],
        15: ["0", "1"],
    },
    4: {1: ["1", "01", "001", "000"], 2: ["1", "01", "00"], 3: ["1", "0"]},
    8: {
        1: ["1", "010", "011", "0010", "0011", "0001", "00001", "00000"],
        2: ["000", "01", "001", "100", "101", "110", "111"],
        3: ["000", "001", "01", "10", "110", "111"],
        4: ["110", "00", "01", "10", "111"],
        5: ["00", "01", "10", "11"],
        6: ["00", "01", "1"],
        7: ["0", "1"],
    },
}
ZERO_BITS = 9
DC = 2


def coded_block_pattern(code: Column, intra: Column) -> Column:
    """struct<luma, chroma> of a code number; null beyond the table."""
    value = F.when(intra, F.get(F.lit(INTRA_PATTERN), code)).otherwise(F.get(F.lit(INTER_PATTERN), code))
    return let(lambda v: F.when(v["p"].isNotNull(), F.struct((v["p"] % 16).alias("luma"), F.shiftright(v["p"], 4).alias("chroma"))), p=value)


def whole_block_type(mb_type: Column) -> Column:
    """struct<mode, chroma, luma> that the 16x16 intra types 1 to 24 stand for; null for the others."""
    n = mb_type - 1
    made = F.struct((n % 4).alias("mode"), (F.floor(n / 4) % 3).cast("int").alias("chroma"), F.when(n < 12, 0).otherwise(15).alias("luma"))
    return F.when(mb_type.between(1, 24), made)


def types(spark: SparkSession) -> DataFrame:
    """(slice, mb_type, name, parts, first, second, width, height) of the inter types, read off their names; 28 rows."""
    rows = []
    for kind, names in (("P", P_TYPES), ("B", B_TYPES)):
        for no, name in enumerate(names):
            *modes, size = name.split("_")[1:]
            width, height = (int(x) for x in size.removesuffix("ref0").split("x"))
            parts = 0 if modes == ["Direct"] else 256 // (width * height)
            rows.append((kind, no, name, parts, modes[0] if modes else None, modes[1] if len(modes) > 1 else None, width, height))
    return spark.createDataFrame(rows, "slice string, mb_type int, name string, parts int, first string, second string, width int, height int")


def with_types(blocks: DataFrame) -> DataFrame:
    """``blocks`` with the properties of their (slice, mb_type), null for types that there are not; the table of types has a fixed size."""
    return blocks.join(F.broadcast(types(blocks.sparkSession)), ["slice", "mb_type"], "left")


def block_place(index: Column) -> Column:
    """struct<x, y> of the 4x4 block with this number: its bits are x, y, x, y from the lowest."""

    def bit(n: int) -> Column:
        return F.shiftright(index, n).bitwiseAND(1)

    return F.struct((4 * bit(0) + 8 * bit(2)).alias("x"), (4 * bit(1) + 8 * bit(3)).alias("y"))


def predicted_mode(a: Column, b: Column, has_a: Column, has_b: Column) -> Column:
    """The smaller mode of two neighbours; one without a mode of its own counts as the mean, and so do both where one is missing."""
    return F.when(has_a & has_b, F.least(F.coalesce(a, F.lit(DC)), F.coalesce(b, F.lit(DC)))).otherwise(DC)


def chosen_mode(predicted: Column, same: Column, rest: Column) -> Column:
    """The mode from the flag that the prediction holds, else from the number among the other eight."""
    return F.when(same, predicted).when(rest < predicted, rest).otherwise(rest + 1)


def least_reference(*refs: Column) -> Column:
    """The smallest reference that is not negative, -1 if there is none."""
    return F.coalesce(F.array_min(F.filter(F.array(*refs), lambda r: r >= 0)), F.lit(-1))


def list_place(counts: Column, count: Column) -> Column:
    """Place of the first entry with an order count, 0 if there is none."""
    return F.coalesce(F.nullif(F.array_position(counts, count), F.lit(0).cast("long")) - 1, F.lit(0).cast("long"))


def weight_mode(slice_kind: Column, weighted_p: Column, weighted_b: Column) -> Column:
    p = F.when(slice_kind.isin("P", "SP") & weighted_p, "explicit")
    return F.coalesce(p, F.when((slice_kind == "B") & (weighted_b == 1), "explicit").when((slice_kind == "B") & (weighted_b == 2), "implicit"), F.lit("default"))


def completeness(blocks: DataFrame, size: Column) -> DataFrame:
    """(stream_id, picture_id, present, verdict) of pictures from their macroblocks (mb_addr): complete, missing or repeated."""
    sums = blocks.groupBy("stream_id", "picture_id").agg(F.count("*").alias("rows"), F.count_distinct("mb_addr").alias("present"), F.max(size).alias("size"))
    verdict = F.when(F.col("rows") > F.col("present"), "repeated").when(F.col("present") < F.col("size"), "missing").otherwise("complete")
    return sums.select("stream_id", "picture_id", "present", verdict.alias("verdict"))


def run_of_zeros(bits: Column, pos: Column, left: Column) -> Column:
    """struct<run, size> of the code at pos with ``left`` zeros left; run 0 of size 0 if none is, null for a code that is cut off."""
    codes = {f"{zeros}:{code}": (run, len(code)) for zeros, row in RUN_CODES.items() for run, code in enumerate(row)}
    known = F.create_map(*(x for k, (run, size) in codes.items() for x in (F.lit(k), F.struct(F.lit(run).alias("run"), F.lit(size).alias("size")))))

    def look(v: Column) -> Column:
        pieces = [F.concat(v["class"], F.lit(":"), F.substring(bits, pos + 1, F.lit(n))) for n in (1, 2, 3)]
        long_ = F.when((left > 6) & (v["zeros"] >= 3), F.struct((v["zeros"] + 4).cast("int").alias("run"), (v["zeros"] + 1).cast("int").alias("size")))
        return F.coalesce(*(F.try_element_at(known, p) for p in pieces), long_)

    none = F.struct(F.lit(0).alias("run"), F.lit(0).alias("size"))
    return F.when(left == 0, none).otherwise(let(look, zeros=leading_zeros(bits, pos), **{"class": F.least(left, F.lit(7)).cast("string")}))


def runs(bits: Column, pos: Column, coefficients: Column, zeros: Column) -> Column:
    """array of the zeros before each coefficient, the last coefficient first; null if a code is cut off."""

    def step(state: Column, i: Column) -> Column:
        def read(v: Column) -> Column:
            run = F.when(i == coefficients, state["left"]).otherwise(v["c"]["run"])
            size = F.when(i == coefficients, 0).otherwise(v["c"]["size"])
            return F.struct((state["pos"] + size).alias("pos"), (state["left"] - run).alias("left"), F.concat(state["runs"], F.array(run)).alias("runs"))

        return let(read, c=run_of_zeros(bits, state["pos"], state["left"]))

    start = F.struct(pos.cast("int").alias("pos"), zeros.cast("int").alias("left"), F.array().cast("array<int>").alias("runs"))
    done = F.aggregate(F.sequence(F.lit(1), coefficients.cast("int")), start, step, lambda s: F.when(s["pos"].isNotNull() & (s["left"] >= 0), s["runs"]))
    return F.when(coefficients > 0, done).otherwise(F.array().cast("array<int>"))


def levels(bits: Column, pos: Column, coefficients: Column, ones: Column) -> Column:
    """struct<pos, levels> of a block's levels, the last coefficient first: ``ones`` signs, then codes whose suffix grows with the levels; null if a code is cut off.

    The signs of ones are bits; a code is zeros, a one and a suffix.
    """

    def power(n: Column) -> Column:
        return F.call_function("shiftleft", F.lit(1), n)

    def step(state: Column, i: Column) -> Column:
        def sized(v: Column) -> Column:
            size = F.when((v["zeros"] == 14) & (state["suffix"] == 0), 4).when(v["zeros"] >= 15, v["zeros"] - 3).otherwise(state["suffix"])
            return let(lambda w: coded(v["zeros"], w["size"]), size=size.cast("int"))

        def coded(zeros: Column, size: Column) -> Column:
            at = state["pos"] + zeros + 1
            suffix = F.when(size == 0, 0).when(at + size <= F.length(bits), F.conv(F.substring(bits, at + 1, size), 2, 10).cast("int"))
            code = F.least(F.lit(15), zeros) * power(state["suffix"]) + suffix + F.when((zeros >= 15) & (state["suffix"] == 0), 15).otherwise(0)
            code = code + F.when(zeros >= 16, power(zeros - 3) - 4096).otherwise(0) + F.when((i == 1) & (ones < 3), 2).otherwise(0)
            return let(lambda w: kept(at + size, w["code"]), code=code)

        def kept(after: Column, code: Column) -> Column:
            level = F.when(code % 2 == 0, F.shiftright(code + 2, 1)).otherwise(F.shiftright(-code - 1, 1))
            least = F.greatest(state["suffix"], F.lit(1))
            grown = F.when((F.abs(level) > 3 * power(least - 1)) & (least < 6), least + 1).otherwise(least)
            return F.struct(after.cast("int").alias("pos"), grown.cast("int").alias("suffix"), F.concat(state["levels"], F.array(level.cast("int"))).alias("levels"))

        return let(sized, zeros=leading_zeros(bits, state["pos"]).cast("int"))

    signs = F.transform(F.sequence(F.lit(1), ones.cast("int")), lambda i: F.when(F.substring(bits, pos + i, F.lit(1)) == "1", -1).otherwise(1))
    none = F.array().cast("array<int>")
    suffix = F.when((coefficients > 10) & (ones < 3), 1).otherwise(0)
    start = F.struct((pos + ones).cast("int").alias("pos"), suffix.alias("suffix"), F.when(ones > 0, signs).otherwise(none).alias("levels"))
    left = (coefficients - ones).cast("int")
    read = F.aggregate(F.when(left > 0, F.sequence(F.lit(1), left)).otherwise(none), start, step)
    whole = read["pos"].isNotNull() & (read["pos"] <= F.length(bits))
    return let(lambda v: F.when(v["r"]["whole"], v["r"]["made"]), r=F.struct(whole.alias("whole"), F.struct(read["pos"].alias("pos"), read["levels"].alias("levels")).alias("made")))


def placed_levels(levels: Column, before: Column, size: int) -> Column:
    """A block of ``size`` in scan order from its levels and the zeros before each, both the last coefficient first."""

    def put(block: Column, pair: Column) -> Column:
        return F.concat(block, F.array_repeat(F.lit(0), pair["zeros"]), F.array(pair["level"]))

    pairs = F.reverse(F.arrays_zip(levels.alias("level"), before.alias("zeros")))
    block = F.aggregate(pairs, F.array().cast("array<int>"), put)
    return let(lambda v: F.concat(v["b"], F.array_repeat(F.lit(0), size - F.size(v["b"]))), b=block)


# Names of the types of 8x8 sub-macroblocks of P and B slices by number.
P_SUB_TYPES = ["L0_8x8", "L0_8x4", "L0_4x8", "L0_4x4"]
B_SUB_TYPES = ["Direct_4x4", "L0_8x8", "L1_8x8", "Bi_8x8", "L0_8x4", "L0_4x8", "L1_8x4", "L1_4x8", "Bi_8x4", "Bi_4x8", "L0_4x4", "L1_4x4", "Bi_4x4"]


def sub_types(spark: SparkSession) -> DataFrame:
    """(slice, sub_type, name, parts, mode, width, height) of the sub-macroblock types; 17 rows."""
    rows = []
    for kind, names in (("P", P_SUB_TYPES), ("B", B_SUB_TYPES)):
        for no, name in enumerate(names):
            mode, size = name.split("_")
            width, height = map(int, size.split("x"))
            rows.append((kind, no, name, 64 // (width * height), mode, width, height))
    return spark.createDataFrame(rows, "slice string, sub_type int, name string, parts int, mode string, width int, height int")


def with_sub_types(rows: DataFrame) -> DataFrame:
    """``rows`` with the properties of their (slice, sub_type), null for types that there are not; the table of types has a fixed size."""
    return rows.join(F.broadcast(sub_types(rows.sparkSession)), ["slice", "sub_type"], "left")


def flag_increment(a: Column, b: Column) -> Column:
    """Context increment of a flag: for how many neighbours it holds; a missing one (null) does not count."""
    return F.coalesce(a, F.lit(False)).cast("int") + F.coalesce(b, F.lit(False)).cast("int")


def reference_increment(a: Column, b: Column) -> Column:
    """Context increment of a reference number: 1 if A's is above 0, and 2 if B's is."""
    return F.when(a > 0, 1).otherwise(0) + F.when(b > 0, 2).otherwise(0)


def vector_increment(a: Column, b: Column) -> Column:
    """Context increment of a vector difference from the sizes of the neighbours' (null: 0)."""
    size = F.coalesce(F.abs(a), F.lit(0)) + F.coalesce(F.abs(b), F.lit(0))
    return F.when(size < 3, 0).when(size > 32, 2).otherwise(1)


def corner_block(x: Column, y: Column) -> Column:
    """Raster number of the 4x4 block at the macroblock's corner that stands for the one at (x, y) with direct inference by 8x8."""
    return F.shiftright(x, 1) * 3 + F.shiftright(y, 1) * 12


def colocated_reference(ref0: Column, ref1: Column) -> Column:
    """A colocated block's reference: that of list 0, else of list 1, null where neither is used."""
    return F.when(ref0 >= 0, ref0).when(ref1 >= 0, ref1)


def slice_quantisers(pps: Column, qp_delta: Column) -> Column:
    """struct<slice_qp, cb, cr>: a slice's first quantiser and the offsets of the chroma planes; Cr's is Cb's where the set has none of its own."""
    cb = pps["chroma_qp_offset"]
    return F.struct((26 + pps["init_qp_minus26"] + qp_delta).alias("slice_qp"), cb.alias("cb"), F.coalesce(pps["second_chroma_qp_offset"], cb).alias("cr"))


def zero_codes(spark: SparkSession) -> DataFrame:
    """(size, coefficients, ahead, total_zeros, length): what each of the next ``ZERO_BITS`` bits begins with; at most 12,800 rows."""
    rows = [(size, n, code, zeros, len(code)) for size, table in ZERO_CODES.items() for n, codes in table.items() for zeros, code in enumerate(codes)]
    codes = spark.createDataFrame(rows, "size int, coefficients int, code string, total_zeros int, length int")
    rest = F.explode(F.sequence(F.lit(0), F.pow(F.lit(2), ZERO_BITS - F.col("length")).cast("int") - 1))
    first = F.conv(F.rpad("code", ZERO_BITS, "0"), 2, 10).cast("int")
    return codes.select("*", rest.alias("rest")).select("size", "coefficients", F.lpad(F.bin(first + F.col("rest")), ZERO_BITS, "0").alias("ahead"), "total_zeros", "length")


def with_zeros(rows: DataFrame) -> DataFrame:
    """``rows`` (size, coefficients, bits, pos) with total_zeros and its code's length, null for no code, one that is cut off, or no coefficients; full blocks have no code and no zeros.

    An equi-join with the table of all continuations, whose size is fixed.
    """
    left = F.length("bits") - F.col("pos")
    ahead = F.rpad(F.substring(F.col("bits"), F.col("pos") + 1, F.lit(ZERO_BITS)), ZERO_BITS, "0")
    found = rows.withColumn("ahead", ahead).join(F.broadcast(zero_codes(rows.sparkSession)), ["size", "coefficients", "ahead"], "left")
    full, whole = F.col("coefficients") == F.col("size"), F.col("length") <= left
    return found.withColumns({c: F.when(full, 0).when(whole, F.col(c)) for c in ("total_zeros", "length")}).drop("ahead")


def level_increments(levels: Column, limit: int = 4) -> Column:
    """array<struct<first, rest>>: context increments of the first and the further bins of each level's size, the last coefficient first; ``limit`` is 3 for chroma DC."""

    def step(state: Column, level: Column) -> Column:
        first = F.when(state["more"] > 0, 0).otherwise(F.least(F.lit(4), 1 + state["ones"]))
        made = F.struct(first.alias("first"), (5 + F.least(F.lit(limit), state["more"])).alias("rest"))
        one, more = (F.abs(level) == 1).cast("int"), (F.abs(level) > 1).cast("int")
        return F.struct((state["more"] + more).alias("more"), (state["ones"] + one).alias("ones"), F.concat(state["made"], F.array(made)).alias("made"))

    start = F.struct(F.lit(0).alias("more"), F.lit(0).alias("ones"), F.array().cast("array<struct<first:int,rest:int>>").alias("made"))
    return F.aggregate(levels, start, step, lambda s: s["made"])


def luma_pattern_increments(own: Column, left: Column, above: Column) -> Column:
    """Context increments of the four luma bits of a coded-block pattern: 1 for a left and 2 for an upper 8x8 block that is there and not coded.

    ``left`` and ``above`` are the neighbours' luma patterns: 0 for skipped
    ones, 15 for raw ones, null for missing ones. ``own`` is the pattern itself,
    of which each bit sees the ones before it.
    """

    def missed(pattern: Column, bit: int) -> Column:
        return F.when(F.shiftright(pattern, bit).bitwiseAND(1) == 0, 1).otherwise(0)

    sides = [(missed(left, 1), missed(above, 2)), (missed(own, 0), missed(above, 3)), (missed(left, 3), missed(own, 0)), (missed(own, 2), missed(own, 1))]
    return F.array(*(a + 2 * b for a, b in sides))


def chroma_pattern_increments(left: Column, above: Column) -> Column:
    """Context increments of the two chroma bins from the neighbours' chroma patterns: 0 for skipped, 2 for raw, null for missing ones."""

    def at_least(n: int) -> Column:
        return F.when(left >= n, 1).otherwise(0) + F.when(above >= n, 2).otherwise(0)

    return F.array(at_least(1), at_least(2) + 4)
