import random

import pytest
from pyspark.sql import functions as F

from bitloom.operators import codes as C
from bitloom.operators import macroblocks as M


def token_code(nc, n, ones):
    if nc >= 8:
        return f"{3 if n == 0 else 4 * n - 4 + ones:06b}"
    return C.TOKEN_CODES[-1 if nc < 0 else 0 if nc < 2 else 2 if nc < 4 else 4][ones][n - ones]


def test_tokens_are_prefix_codes_and_are_read_back(spark):
    assert [sum(map(len, t)) for t in C.TOKEN_CODES.values()] == [62, 62, 62, 14]
    rows = []
    for nc in (-1, 0, 1, 2, 3, 4, 7, 8, 16):
        for n in range(5 if nc < 0 else 17):
            for ones in range(min(n, 3) + 1):
                code = token_code(nc, n, ones)
                rows += [(nc, "1" * 3 + code + after, 3, n, ones, len(code)) for after in ("", "0", "1", "0110")]
                rows.append((nc, "1" * 3 + code[:-1], 3, None, None, None))
    df = spark.createDataFrame(rows, "nc int, bits string, pos int, want_n int, want_ones int, want_length int")
    got = C.with_tokens(df).collect()
    assert len(got) == len(rows)
    for r in got:
        assert (r["coefficients"], r["ones"], r["length"]) == (r["want_n"], r["want_ones"], r["want_length"]), r
    for codes in ([c for row in t for c in row] for t in C.TOKEN_CODES.values()):
        ordered = sorted(codes)
        assert not any(b.startswith(a) for a, b in zip(ordered, ordered[1:]))


@pytest.mark.parametrize("nc,bits", [(8, "000010"), (8, "000111"), (0, "0" * 16), (0, ""), (-1, "000000"), (None, "1"), (0, None)])
def test_bits_that_are_no_token(spark, nc, bits):
    r = C.with_tokens(spark.createDataFrame([(nc, bits, 0)], "nc int, bits string, pos int")).first()
    assert (r["coefficients"], r["ones"], r["length"]) == (None, None, None)


def written(block, nc):
    """Bits of a block, by the rules as they are stated for a writer."""
    at = [i for i, c in enumerate(block) if c][::-1]
    values, n = [block[i] for i in at], len(at)
    ones = 0
    while ones < min(3, n) and abs(values[ones]) == 1:
        ones += 1
    out = token_code(nc, n, ones) + "".join("1" if v < 0 else "0" for v in values[:ones])
    suffix = int(n > 10 and ones < 3)
    for i, v in enumerate(values[ones:]):
        code = (2 * v - 2 if v > 0 else -2 * v - 1) - (2 if i == 0 and ones < 3 else 0)
        if suffix == 0 and code < 14:
            out += "0" * code + "1"
        elif suffix == 0 and code < 30:
            out += "0" * 14 + "1" + f"{code - 14:04b}"
        elif suffix > 0 and code < 15 << suffix:
            out += "0" * (code >> suffix) + "1" + f"{code % (1 << suffix):0{suffix}b}"
        else:
            code -= 15 << suffix if suffix else 30
            prefix = 15
            while code >= (1 << prefix - 3) + ((1 << prefix - 3) - 4096 if prefix > 15 else 0):
                prefix += 1
            out += "0" * prefix + "1" + f"{code - ((1 << prefix - 3) - 4096 if prefix > 15 else 0):0{prefix - 3}b}"
        if suffix == 0:
            suffix = 1
        if abs(v) > 3 << suffix - 1 and suffix < 6:
            suffix += 1
    left = at[0] + 1 - n if n else 0
    if 0 < n < len(block):
        out += M.ZERO_CODES[4 if len(block) == 4 else 16][n][left]
    for a, b in zip(at, at[1:]):
        run = a - b - 1
        if left:
            out += M.RUN_CODES[min(left, 7)][run] if left < 7 or run < 7 else "0" * (run - 4) + "1"
        left -= run
    return out


def random_block(rng, size):
    n = rng.choice([0, 1, 2, 3, size // 2, size - 1, size])
    block = [0] * size
    for i in rng.sample(range(size), min(n, size)):
        block[i] = rng.choice([1, -1, 1, -1, 2, -3, 7, 15, -16, 40, 200, -2063, 9000])
    return block


def test_blocks_are_read_back(spark):
    rng = random.Random(9)
    rows = []
    for size in (4, 15, 16):
        for i in range(250):
            nc = -1 if size == 4 else rng.choice([0, 1, 2, 3, 5, 8])
            block, before, after = random_block(rng, size), "01" * rng.randrange(3), rng.choice(["", "1", "0110"])
            bits = written(block, nc)
            rows.append((nc, size, before + bits + after, len(before), block, len(before) + len(bits)))
            if bits[:-1] and i % 5 == 0:
                rows.append((nc, size, before + bits[:-1], len(before), None, None))
    df = spark.createDataFrame(rows, "nc int, size int, bits string, pos int, want array<int>, want_end int")
    got = C.read_blocks(df).collect()
    assert len(got) == len(rows) and df.columns == [c for c in C.read_blocks(df).columns if c not in ("block", "end")]
    for r in got:
        assert (r["block"], r["end"]) == (r["want"], r["want_end"]), r


def test_more_coefficients_than_fit(spark):
    df = spark.createDataFrame([(0, 15, token_code(0, 16, 3) + "000" + "1" * 40, 0), (8, 4, "001000" + "1" * 40, 0)], "nc int, size int, bits string, pos int")
    assert [(r["block"], r["end"]) for r in C.read_blocks(df).collect() if r["size"] == 15] == [(None, None)]


def test_trees_are_complete_and_every_type_is_read_back(spark):
    rows = [(tree, bins, number, "11" + bins + after) for tree, codes in C.type_bins().items() for bins, number in codes.items() for after in ("", "0", "1")]
    df = spark.createDataFrame(rows, "tree string, code string, number int, bins string")
    for r in df.select("*", C.walked(F.col("tree"), F.col("bins"), F.lit(2)).alias("t"), C.walked(F.col("tree"), F.expr("substring(bins, 1, length(code) + 1)"), F.lit(2)).alias("cut")).collect():
        assert tuple(r["t"]) == (r["number"], len(r["code"])) and r["cut"] is None, r
    for tree in C.type_bins():
        inner = {node for t, node, _, _ in C.tree_nodes() if t == tree}
        both = {node for node in inner if all(any(e[:3] == (tree, node, b) for e in C.tree_nodes()) for b in "01")}
        assert inner - both == set(), tree


def written_number(value, k, cutoff, signed):
    """Bins of a number, by the rules as they are stated for a writer."""
    size = abs(value)
    if size < cutoff:
        out = "1" * size + "0"
    else:
        out, rest, order = "1" * cutoff, size - cutoff, k
        while rest >= 1 << order:
            out, rest, order = out + "1", rest - (1 << order), order + 1
        out += "0" + (f"{rest:0{order}b}" if order else "")
    return out + (("1" if value < 0 else "0") if signed and value else "")


@pytest.mark.parametrize("k,cutoff,signed", [(3, 9, True), (0, 14, False)])
def test_numbers_are_read_back(spark, k, cutoff, signed):
    values = [v for n in [*range(40), 255, 4095, 65535, 2**20] for v in ([n, -n] if signed else [n])]
    rows = [(v, written_number(v, k, cutoff, signed), after) for v in values for after in ("", "1", "00")]
    df = spark.createDataFrame(rows, "value int, bins string, after string")
    bins = F.concat(F.lit("10"), "bins", "after")
    got = df.select("*", C.unary_exp_golomb(bins, F.lit(2), k, cutoff, signed).alias("n"), C.unary_exp_golomb(F.concat(F.lit("10"), F.expr("substring(bins, 1, length(bins) - 1)")), F.lit(2), k, cutoff, signed).alias("cut")).collect()
    for r in got:
        assert tuple(r["n"]) == (r["value"], len(r["bins"])), r
        assert r["cut"] is None, r
