"""Motion-compensated blocks against a plain loop over whole pictures."""

import numpy as np

from bitloom.operators import compensation as C

BLOCKS = "stream_id string, block_id long, width int, height int, x int, y int, w int, h int, ref0 long, x0 int, y0 int, ref1 long, x1 int, y1 int, w0 int, w1 int, o0 int, o1 int, log_denominator int"


def tap(v):
    return v[0] - 5 * v[1] + 20 * v[2] + 20 * v[3] - 5 * v[4] + v[5]


def clip(v):
    return max(0, min(255, int(v)))


def luma_at(picture, qx, qy):
    """One sample at quarter places, by the standard's letters."""
    h, w = picture.shape
    x, y, fx, fy = qx >> 2, qy >> 2, qx & 3, qy & 3
    g = [[int(picture[min(max(y + i, 0), h - 1), min(max(x + j, 0), w - 1)]) for j in range(-2, 4)] for i in range(-2, 4)]
    rows, columns = [tap(r) for r in g], [tap([r[j] for r in g]) for j in range(6)]
    b, s, v, m = clip((rows[2] + 16) >> 5), clip((rows[3] + 16) >> 5), clip((columns[2] + 16) >> 5), clip((columns[3] + 16) >> 5)
    j = clip((tap(rows) + 512) >> 10)
    full, right, below = g[2][2], g[2][3], g[3][2]
    table = {(0, 0): [full], (1, 0): [full, b], (2, 0): [b], (3, 0): [b, right], (0, 1): [full, v], (0, 2): [v], (0, 3): [v, below], (1, 1): [b, v], (2, 1): [b, j], (3, 1): [b, m], (1, 2): [v, j], (2, 2): [j], (3, 2): [j, m], (1, 3): [v, s], (2, 3): [j, s], (3, 3): [s, m]}
    pair = table[fx, fy]
    return pair[0] if len(pair) == 1 else (pair[0] + pair[1] + 1) >> 1


def chroma_at(picture, ex, ey):
    h, w = picture.shape
    x, y, fx, fy = ex >> 3, ey >> 3, ex & 7, ey & 7
    a, b, c, d = (int(picture[min(max(y + i, 0), h - 1), min(max(x + j, 0), w - 1)]) for i in (0, 1) for j in (0, 1))
    return ((8 - fx) * (8 - fy) * a + fx * (8 - fy) * b + (8 - fx) * fy * c + fx * fy * d + 32) >> 6


def tiles_of(stream, picture_id, picture, tile):
    h, w = picture.shape
    return [(stream, picture_id, x, y, bytearray(picture[y * tile : y * tile + tile, x * tile : x * tile + tile].tobytes())) for y in range(h // tile) for x in range(w // tile)]


def check(spark, tile, at, step):
    rng = np.random.default_rng(tile)
    width, height = 5 * tile, 3 * tile
    pictures = {(s, p): rng.integers(0, 256, (height, width)).astype(np.uint8) for s in "ab" for p in (0, 1)}
    rows, want = [], {}
    for n in range(160):
        stream, w, h = "ab"[n % 2], *((tile, tile), (tile // 2, tile), (tile // 4, tile // 4))[n % 3]
        x, y = int(rng.integers(0, width // 4 - w // 4 + 1) * 4), int(rng.integers(0, height // 4 - h // 4 + 1) * 4)
        far = 40 * step if n % 4 else 3 * step
        v = [int(t) for t in rng.integers(-far * 2, far * 2, 4)]
        refs = [None if n % 5 == 1 else n % 2, n % 3 % 2 if n % 5 in (1, 2) else None]
        weights = (5, -4, 3, 7, n % 3) if n % 7 == 0 else (None,) * 5
        rows.append((stream, n, width, height, x, y, w, h, refs[0], v[0], v[1], refs[1], v[2], v[3], *weights))
        made = []
        for no in (0, 1):
            if refs[no] is not None:
                picture = pictures[stream, refs[no]]
                made.append((no, [at(picture, (x + j) * step + v[2 * no], (y + i) * step + v[2 * no + 1]) for i in range(h) for j in range(w)]))
        w0, w1, o0, o1, log = weights
        if log is None:
            out = made[0][1] if len(made) == 1 else [(a + b + 1) >> 1 for a, b in zip(made[0][1], made[1][1])]
        elif len(made) == 1:
            weight, offset = ((w0, o0), (w1, o1))[made[0][0]]
            out = [clip(((a * weight + (2 ** (log - 1) if log else 0)) >> log) + offset) for a in made[0][1]]
        else:
            out = [clip(((a * w0 + b * w1 + 2**log) >> (log + 1)) + ((o0 + o1 + 1) >> 1)) for a, b in zip(made[0][1], made[1][1])]
        want[stream, n] = bytes(out)
    tiles = [t for (s, p), picture in pictures.items() for t in tiles_of(s, p, picture, tile)]
    rows += [("a", 900, width, height, 0, 0, 4, 4, 7, 0, 0, *[None] * 8), ("a", 901, width, height, 0, 0, 4, 4, None, None, None, None, *[None] * 7), (None, 902, width, height, 0, 0, 4, 4, 0, 0, 0, *[None] * 8)]
    table = spark.createDataFrame(tiles + tiles[:3], "stream_id string, picture_id int, tx int, ty int, samples binary")
    got = C.compensate(spark.createDataFrame(rows, BLOCKS), table, tile).collect()
    assert {(r.stream_id, r.block_id): bytes(r.samples) for r in got} == want
    # Without one tile the blocks that show it are left out, and only they.
    less = {(r.stream_id, r.block_id): bytes(r.samples) for r in C.compensate(spark.createDataFrame(rows, BLOCKS), table.where("not (stream_id = 'a' and picture_id = 0 and tx = 4 and ty = 0)"), tile).collect()}
    assert 0 < len(less) < len(want) and all(want[k] == v for k, v in less.items())


def test_luma_blocks_of_one_and_two_references(spark):
    check(spark, 16, luma_at, 4)


def test_chroma_blocks(spark):
    check(spark, 8, chroma_at, 8)


def test_no_blocks_and_no_tiles(spark):
    none = spark.createDataFrame([], "stream_id string, picture_id int, tx int, ty int, samples binary")
    assert C.compensate(spark.createDataFrame([], BLOCKS), none).collect() == []


def test_pictures_of_parts_whose_keys_have_gaps(spark, tmp_path):
    import duckdb

    from bitloom.plans import catalog, motion_catalog

    con = duckdb.connect()
    con.execute(f"COPY (SELECT (i * 3000 + 17)::BIGINT AS p_partkey FROM range(64) t(i)) TO '{tmp_path}/part.parquet'")
    con.execute(f"COPY (SELECT (i * 5 + 2)::BIGINT AS o_orderkey, (i * 7)::BIGINT AS o_custkey FROM range(40) t(i)) TO '{tmp_path}/orders.parquet'")
    for name in ("part", "orders"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet'")
    want = sorted(con.execute(f"SELECT block_id, digest FROM ({catalog.SQL['motion_blocks']})").fetchall())
    got = sorted(tuple(r) for r in motion_catalog.motion_blocks(spark, str(tmp_path)).select("block_id", "digest").collect())
    assert len(want) == 40 and got == want
