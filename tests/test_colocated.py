"""Fields of motion and their lookup: small tables with every way to miss."""

from bitloom.operators import colocated as C

BLOCKS = "stream_id string, picture_id long, slice_id long, bx int, by int, intra boolean, ref0 int, ref1 int, x0 int, y0 int, x1 int, y1 int"
SLICES = "stream_id string, picture_id long, slice_id long, is_ref boolean, poc long, counts0 array<long>, counts1 array<long>, first1 long"


def field(spark):
    blocks = [
        ("s", 1, 0, 0, 0, False, 0, 1, 4, -8, 9, 9), ("s", 1, 0, 3, 0, False, -1, 1, 4, 4, 12, -6), ("s", 1, 1, 0, 3, True, None, None, None, None, None, None), ("s", 1, 1, 3, 3, False, 5, None, 2, 2, None, None),
        ("s", 2, 0, 0, 0, False, 0, None, 1, 1, None, None),
    ]
    slices = [("s", 1, 0, True, 8, [0, 2], [16, 4], 9), ("s", 1, 1, True, 8, [16], [0], 9), ("s", 2, 0, False, 6, [0], [8], 1), ("s", 3, 0, True, 4, [2, 4, 0], [8], 1), ("s", 3, 1, True, 4, [0], [], None), ("s", 4, 0, False, 5, [0], [6], 2), ("s", 5, 0, False, 5, [0], [9], 77)]
    return spark.createDataFrame(blocks, BLOCKS), spark.createDataFrame(slices, SLICES)


def test_a_field_keeps_the_counts_of_its_references(spark):
    got = {(r.bx, r.by): (r.intra, r.x, r.y, r.ref_count, r["count"]) for r in C.motion_field(*field(spark)).where("picture_id = 1").collect()}
    assert got == {(0, 0): (False, 4, -8, 0, 8), (3, 0): (False, 12, -6, 4, 8), (0, 3): (True, 0, 0, 16, 8), (3, 3): (False, 2, 2, 8, 8)}
    assert C.motion_field(*field(spark)).where("picture_id = 2").count() == 0  # not a reference


def test_blocks_look_at_the_corner_or_at_their_own_place(spark):
    blocks, slices = field(spark)
    wanted = [("s", 3, 0, x, y) for x in (0, 1, 2, 3) for y in (0, 3)] + [("s", 3, 1, 0, 0), ("s", 4, 0, 0, 0), ("s", 5, 0, 0, 0), ("s", 3, 0, 8, 8), ("t", 3, 0, 0, 0)]
    df = spark.createDataFrame(wanted, "stream_id string, picture_id long, slice_id long, bx int, by int")
    got = {tuple(r)[:5]: tuple(r)[5:] for r in C.temporal_vectors(df, slices, C.motion_field(blocks, slices)).collect()}
    # Half-way between counts 0 and 8 the vector is halved; count 0 is at place 2 of the slice's list.
    assert got["s", 3, 0, 0, 0] == got["s", 3, 0, 1, 0] == ("temporal", 2, 2, -4, -2, 4)
    assert got["s", 3, 0, 2, 0] == got["s", 3, 0, 3, 0] == ("temporal", 1, 0, 0, -12, 6)
    assert got["s", 3, 0, 0, 3] == ("temporal", 0, 0, 0, 0, 0)  # intra
    assert got["s", 3, 0, 3, 3] == ("temporal", 0, 2, 2, 0, 0)  # as far as its reference: taken as it is
    assert got["s", 3, 0, 8, 8] == ("temporal", 0, 0, 0, 0, 0)  # not in the field
    for missing in (("s", 3, 1, 0, 0), ("s", 4, 0, 0, 0), ("s", 5, 0, 0, 0), ("t", 3, 0, 0, 0)):
        assert got[missing] == ("spatial", None, None, None, None, None)
    own = {tuple(r)[:5]: tuple(r)[5:] for r in C.temporal_vectors(df, slices, C.motion_field(blocks, slices), by_8x8=False).collect()}
    assert own["s", 3, 0, 0, 0] == got["s", 3, 0, 0, 0] and own["s", 3, 0, 1, 0] == ("temporal", 0, 0, 0, 0, 0)


def test_blocks_do_not_pass_through_the_driver(spark):
    from bitloom.plans import motion_catalog

    plan = motion_catalog.colocated_vectors(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan
