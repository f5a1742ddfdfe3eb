import random

from pyspark.sql import functions as F

from bitloom.operators import bitmaps, frames, motion
from bitloom.operators import coefficients as K
from bitloom.operators import macroblocks as M

BLOCK = "stream_id string, picture_id int, bx int, by int, intra boolean, coded boolean, ref0 int, ref1 int, x0 int, y0 int, x1 int, y1 int"


def test_zero_codes_are_prefix_free_and_all_but_one_word_is_used():
    for size, table in M.ZERO_CODES.items():
        assert sorted(table) == list(range(1, size if size < 16 else 16))
        for n, codes in table.items():
            assert len(codes) == size - n + 1 and len(set(codes)) == len(codes)
            assert not any(b.startswith(a) for a in codes for b in codes if a != b)
            # Only the longest word of the first table, all zeros, is no code.
            assert sum(2.0 ** -len(c) for c in codes) == (1 - 2.0**-9 if (size, n) == (16, 1) else 1)


def test_every_zero_code_is_read_back_and_not_when_it_is_cut_off(spark):
    rows = [(size, n, f"101{code}{tail}"[: 3 + len(code) + len(tail) - cut], 3, zeros, len(code), cut) for size, t in M.ZERO_CODES.items() for n, codes in t.items() for zeros, code in enumerate(codes) for tail, cut in (("", 0), ("0110", 0), ("", 1))]
    table = spark.createDataFrame(rows, "size int, coefficients int, bits string, pos int, want int, want_length int, cut int")
    for r in M.with_zeros(table).collect():
        # What is left of a code that is cut off begins no other code's whole word.
        assert (r["total_zeros"], r["length"]) == ((r["want"], r["want_length"]) if r["cut"] == 0 else (None, None))
    full = spark.createDataFrame([(16, 16, "1", 1), (4, 4, "", 0), (16, 0, "1", 0)], "size int, coefficients int, bits string, pos int")
    assert [r["total_zeros"] for r in M.with_zeros(full).orderBy("coefficients").collect()] == [None, 0, 0]


def test_strengths_of_two_references_crosswise(spark):
    def pair(p, q):
        return [("s", 0, 3, 0, *p), ("s", 0, 4, 0, *q)]

    plain = (False, False)
    cases = {
        0: [((*plain, 7, 9, 1, 1, 5, 5), (*plain, 9, 7, 4, 5, 2, 2)), ((*plain, 7, None, 0, 0, 0, 0), (*plain, None, 7, 0, 0, 3, 0)), ((*plain, 7, 7, 0, 0, 8, 8), (*plain, 7, 7, 8, 8, 0, 0))],
        1: [((*plain, 7, 7, 0, 0, 8, 8), (*plain, 7, 7, 0, 0, 0, 0)), ((*plain, 7, None, 0, 0, 0, 0), (*plain, 7, None, 0, -4, 0, 0)), ((*plain, 7, None, 0, 0, 0, 0), (*plain, 7, 9, 0, 0, 0, 0))],
        2: [((False, True, 7, None, 0, 0, 0, 0), (*plain, 7, None, 0, 0, 0, 0))],
        4: [((*plain, 7, None, 0, 0, 0, 0), (True, False, None, None, 0, 0, 0, 0))],
    }
    for want, pairs in cases.items():
        for p, q in pairs:
            got = {r["bx"]: (r["left_bs"], r["top_bs"]) for r in motion.edge_strengths(spark.createDataFrame(pair(p, q), BLOCK)).collect()}
            assert got == {3: (None, None), 4: (want, None)}
    inner = [("s", 0, 1, 1, True, False, None, None, 0, 0, 0, 0), ("s", 0, 1, 2, *plain, 1, None, 0, 0, 0, 0), ("s", 0, 3, 2, *plain, 1, None, 0, 0, 0, 0)]
    got = {(r["bx"], r["by"]): (r["left_bs"], r["top_bs"]) for r in motion.edge_strengths(spark.createDataFrame(inner, BLOCK)).collect()}
    assert got == {(1, 1): (None, None), (1, 2): (None, 3), (3, 2): (None, None)}
    assert motion.edge_strengths(spark.createDataFrame([], BLOCK)).count() == 0


def test_temporal_direct_half_way(spark):
    rows = [(False, 8, -8, 0, 4, 2), (False, 8, -8, 4, 4, 2), (True, 8, 8, 0, 4, 2), (False, 30000, 0, 0, 1, 100)]
    table = spark.createDataFrame(rows, "intra boolean, x int, y int, r int, c int, now int")
    made = motion.temporal_direct(*(F.col(c) for c in table.columns), F.array(F.lit(4), F.lit(0)))
    got = [tuple(r["d"]) for r in table.select(made.alias("d")).collect()]
    # Half the distance halves the vector; none leaves it; vectors stay in 16 bits.
    assert got == [(1, 4, -4, -4, 4), (0, 8, -8, 0, 0), (0, 0, 0, 0, 0), (1, 32767, 0, 2767, 0)]


def test_motion_of_what_is_not_decoded_yet(spark):
    blocks = spark.createDataFrame([("s", 0, 0, 0, 0, 0, False, 2, 5, 6), ("s", 0, 0, 1, 1, 0, True, 3, 5, 6), ("s", 0, 0, 2, 2, 0, False, 1, 7, 8), ("s", 0, 1, 9, 3, 0, False, 1, 7, 8)], "stream_id string, picture_id int, slice_id int, place int, bx int, by int, intra boolean, ref0 int, x0 int, y0 int")
    wanted = spark.createDataFrame([("s", 0, 0, 2, x, 1) for x in (-1, 3, 4, 8, 12, 16)], "stream_id string, picture_id int, slice_id int, place int, x int, y int")
    got = {r["x"]: (r["ref0"], r["x0"], r["y0"]) for r in motion.motion_at(wanted, blocks).collect()}
    none = (None, None, None)
    assert got == {-1: none, 3: (2, 5, 6), 4: (-1, 0, 0), 8: none, 12: none, 16: none}


def test_first_difference_with_missing_samples(spark):
    kind = "stream_id string, frame_idx int, plane int, y int, x int, sample int"
    one = spark.createDataFrame([("s", 0, p, y, x, 1) for p in (0, 1) for y in (0, 1) for x in (0, 1)] + [("s", 1, 0, 0, 0, 1)], kind)
    other = one.where("not (frame_idx = 0 and plane = 1 and y = 0 and x = 1)").withColumn("sample", F.when((F.col("plane") == 1) & (F.col("y") == 1), 2).otherwise(F.col("sample")))
    assert [tuple(r) for r in frames.first_difference(one, other).collect()] == [("s", 0, 1, 0, 1, 1, None)]
    assert frames.first_difference(one, one).count() == 0


def level_bits(levels, ones):
    """Codes by looking for the shortest prefix that can hold each level."""
    out = "".join("01"[v < 0] for v in levels[:ones])
    suffix = int(len(levels) > 10 and ones < 3)
    for no, level in enumerate(levels[ones:]):
        code = (2 * level - 2 if level > 0 else -2 * level - 1) - (2 if no == 0 and ones < 3 else 0)
        for zeros in range(26):
            size = 4 if zeros == 14 and suffix == 0 else zeros - 3 if zeros >= 15 else suffix
            base = (min(15, zeros) << suffix) + (15 if zeros >= 15 and suffix == 0 else 0) + ((1 << zeros - 3) - 4096 if zeros >= 16 else 0)
            if base <= code < base + (1 << size):
                break
        out += "0" * zeros + "1" + (f"{code - base:0{size}b}" if size else "")
        suffix = max(suffix, 1)
        suffix += abs(level) > 3 << suffix - 1 and suffix < 6
    return out


def test_levels_come_back(spark):
    rng, rows = random.Random(8), []
    for no in range(400):
        ones, n = rng.randint(0, 3), rng.randint(1, 16)
        ones = min(ones, n)
        size = rng.choice([2, 9, 40, 3000, 40000])
        levels = [rng.choice([-1, 1]) for _ in range(ones)] + [rng.choice([-1, 1]) * rng.randint(1, size) for _ in range(n - ones)]
        if ones < 3 and n > ones and abs(levels[ones]) == 1:
            levels[ones] *= 2  # it would be one of the ones
        bits = level_bits(levels, ones)
        rows += [(no, "10" + bits + "011", 2, n, ones, levels), (1000 + no, "10" + bits[:-1], 2, n, ones, None)]
    table = spark.createDataFrame(rows, "no int, bits string, pos int, n int, ones int, want array<int>")
    made = table.select("*", M.levels(F.col("bits"), F.col("pos"), F.col("n"), F.col("ones")).alias("m"))
    for r in made.collect():
        assert (r["m"] and (r["m"]["levels"], r["m"]["pos"])) == (r["want"] and (r["want"], len(r["bits"]) - 3))
    empty = table.limit(1).select(M.levels(F.col("bits"), F.col("pos"), F.lit(0), F.lit(0)).alias("m")).first()["m"]
    assert (empty["pos"], empty["levels"]) == (2, [])


def test_levels_of_a_batch_are_those_of_single_blocks(spark):
    """Whole codes and cut ones of random bits, with long runs of zeros, nulls and texts without bits."""
    rng, rows = random.Random(11), [(-1, None, 0, 3, 1), (-2, "", 0, 0, 0), (-3, "1" * 20, None, 2, 0), (-4, "1" * 20, 30, 2, 0)]
    for no in range(3000):
        bits = "".join("0" * rng.choice((0, 1, 3, 14, 15, 16)) + "1" + f"{rng.getrandbits(30):030b}"[: rng.randint(0, 12)] + "1" for _ in range(rng.randint(1, 12)))
        rows.append((no, bits, rng.randint(0, 4), rng.randint(0, 16), rng.randint(0, 3)))
    table = spark.createDataFrame(rows, "no int, bits string, pos int, n int, ones int").repartition(2)
    args = tuple(F.col(c) for c in ("bits", "pos", "n", "ones"))
    got = {r.no: r.m for r in table.select("no", K.levels(*args).alias("m")).collect()}
    want = {r.no: r.m for r in table.select("no", M.levels(*args).alias("m")).collect()}
    assert {k: v for k, v in got.items() if v != want[k]} == {}
    long = spark.createDataFrame([("0" * 40 + "1" * 60, 0, 1, 0)], "bits string, pos int, n int, ones int")
    assert long.select(K.levels(*args).alias("m")).first().m is None
    assert sum(v is not None for v in got.values()) > 500 and sum(v is None for v in got.values()) > 500


def test_maps_of_addresses_are_aggregated_by_hash(spark, capsys):
    """Edges of words, repeated rows, overlaps, an empty picture, and addresses that are left out."""
    given = {1: (130, {(0, a) for a in range(130)}), 2: (121, {(0, a) for a in range(60)} | {(1, a) for a in range(59, 119)}), 3: (60, set()), 4: (33_000, {(0, 0), (1, 32_999), (2, 59), (2, 60)}), 5: (61, {(0, a) for a in range(1, 61)})}
    blocks = [("s", p, s, a) for p, (_, found) in given.items() for s, a in found] * 2 + [("s", 3, 0, None), ("s", 3, 0, -1), ("s", 3, 0, 60)]
    df = spark.createDataFrame(blocks, "stream_id string, picture_id long, slice_id int, mb long").repartition(3)
    sizes = spark.createDataFrame([("s", p, size) for p, (size, _) in given.items()], "stream_id string, picture_id long, size long")
    made = bitmaps.coverage(df, sizes)
    for r in made.collect():
        size, found = given[r.picture_id]
        there = {a for _, a in found}
        assert (r.covered, r.overlapping, r.first_gap) == (len(there), len(found) - len(there), next((a for a in range(size) if a not in there), None)), r
    capsys.readouterr()
    made.explain()
    assert "SortAggregate" not in capsys.readouterr().out


def test_pictures_are_dealt_to_a_set_number_of_tasks(spark):
    """Whatever they take in the shuffle: tasks that are merged by that sort many times as much."""
    rows = [(i, 0, x, y, False, False, 0, None, 0, 0, 0, 0) for i in range(30) for x in range(4) for y in range(4)]
    df = spark.createDataFrame(rows, "stream_id int, picture_id int, bx int, by int, intra boolean, coded boolean, ref0 int, ref1 int, x0 int, y0 int, x1 int, y1 int")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "7")
        assert motion.edge_strengths(df).rdd.getNumPartitions() == 7
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
