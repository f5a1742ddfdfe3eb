import random

import pyarrow as pa
from pyspark.sql import functions as F

from bitloom.operators import wavefront as V

SHAPE = {n: i for i, n in enumerate(V.SHAPES)}
SUBS = [[(0, 0, 2, 2)], [(0, 0, 2, 1), (0, 1, 2, 1)], [(0, 0, 1, 2), (1, 0, 1, 2)], [(0, 0, 1, 1), (1, 0, 1, 1), (0, 1, 1, 1), (1, 1, 1, 1)]]


def raster(width, first, intra, still, parts):
    """Motion of a slice by going through its macroblocks in coded order, one part at a time."""
    known = {}  # (column, row) of a 4x4 block of the picture -> ((ref0, vector0), (ref1, vector1))
    none = ((-1, (0, 0)), (-1, (0, 0)))
    for n, is_intra in enumerate(intra):
        left, top = (first + n) % width * 4, (first + n) // width * 4

        def look(x, y):
            return known.get((x, y)) if 0 <= x < width * 4 else None

        def predict(part_list, ref, x, y, w, shape):
            a, b, c = look(x - 1, y), look(x, y - 1), look(x + w, y - 1)
            c = look(x - 1, y - 1) if c is None else c
            if b is None and c is None and a is not None:
                b = c = a
            (ra, va), (rb, vb), (rc, vc) = ((none if k is None else k)[part_list] for k in (a, b, c))
            halves = {"16x8": ((ra, va) if y > top else (rb, vb)), "8x16": ((rc, vc) if x > left else (ra, va))}
            # A half's own neighbour is looked at before the others stand in for missing ones.
            if shape in halves:
                one = {"16x8": look(x - 1, y) if y > top else look(x, y - 1), "8x16": (look(x + w, y - 1) or look(x - 1, y - 1)) if x > left else look(x - 1, y)}[shape]
                if one is not None and one[part_list][0] == ref:
                    return one[part_list][1]
            same = [v for r, v in ((ra, va), (rb, vb), (rc, vc)) if r == ref]
            if len(same) == 1:
                return same[0]
            return tuple(sorted(k)[1] for k in zip(va, vb, vc))

        if is_intra:
            for i in range(16):
                known[left + i % 4, top + i // 4] = none
            continue
        around = {}
        for _, shape, bx, by, w, h, *given in [p for p in parts if p[0] == n]:
            name = V.SHAPES[shape]
            refs, moves = list(given[:2]), [tuple(given[2:4]), tuple(given[4:6])]
            if name == "direct" and not around:
                for i in (0, 1):
                    c = look(left + 4, top - 1)
                    c = look(left - 1, top - 1) if c is None else c
                    near = [k[i][0] for k in (look(left - 1, top), look(left, top - 1), c) if k is not None]
                    around[i] = min([r for r in near if r >= 0], default=-1)
                around["moves"] = [predict(i, around[i], left, top, 4, name) if around[i] >= 0 else (0, 0) for i in (0, 1)]
            made = []
            for i in (0, 1):
                if name == "direct":
                    made.append((around[i], around["moves"][i]) if max(around[0], around[1]) >= 0 else (0, (0, 0)))
                elif name == "skip":
                    a, b = look(left - 1, top), look(left, top - 1)
                    rest = any(k is None or k[0] == (0, (0, 0)) for k in (a, b))
                    made.append(((0, (0, 0)) if rest else (0, predict(0, 0, left, top, 4, name))) if i == 0 else (-1, (0, 0)))
                elif refs[i] < 0:
                    made.append((-1, (0, 0)))
                else:
                    guess = (0, 0) if name == "given" else predict(i, refs[i], left + bx, top + by, w, name)
                    made.append((refs[i], tuple((g + d + 32768) % 65536 - 32768 for g, d in zip(guess, moves[i]))))
            for x in range(bx, bx + w):
                for y in range(by, by + h):
                    own = list(made)
                    if name == "direct" and max(around[0], around[1]) >= 0 and still[n] >> (4 * y + x) & 1:
                        own = [(r, (0, 0)) if r == 0 else (r, v) for r, v in own]
                    known[left + x, top + y] = tuple(own)
    out = []
    for n in range(len(intra)):
        left, top = (first + n) % width * 4, (first + n) // width * 4
        for i in range(16):
            (r0, v0), (r1, v1) = known.get((left + i % 4, top + i // 4), none)
            out.append((r0, r1, *v0, *v1))
    return out


def random_slice(rng):
    width, n = rng.randrange(1, 8), rng.randrange(1, 30)
    bipredicted, far = rng.random() < 0.5, rng.choice([2, 8, 40000])
    intra, parts = [], []

    def moved(n, shape, bx, by, w, h):
        refs = rng.choice([(0, -1), (-1, 0), (1, 0), (0, 1), (1, -1)]) if bipredicted else (rng.choice([0, 0, 0, 1, 2]), -1)
        return (n, SHAPE[shape], bx, by, w, h, *refs, *(rng.randrange(-far, far + 1) for _ in range(4)))

    for i in range(n):
        kind = rng.choice(["intra", "skip", "16x16", "16x8", "8x16", "8x8", "8x8", "given"] + ["direct"] * 2 * bipredicted)
        intra.append(kind == "intra")
        if kind in ("skip", "direct"):
            parts.append((i, SHAPE[kind], 0, 0, 4, 4, 0, -1, 5, 5, 5, 5))
        elif kind in ("16x16", "given"):
            parts.append(moved(i, "median" if kind == "16x16" else kind, 0, 0, 4, 4))
        elif kind == "16x8":
            parts += [moved(i, kind, 0, y, 4, 2) for y in (0, 2)]
        elif kind == "8x16":
            parts += [moved(i, kind, x, 0, 2, 4) for x in (0, 2)]
        elif kind == "8x8":
            for q in range(4):
                x, y = q % 2 * 2, q // 2 * 2
                if bipredicted and rng.random() < 0.4:
                    parts.append((i, SHAPE["direct"], x, y, 2, 2, 0, -1, 0, 0, 0, 0))
                else:
                    refs = moved(i, "median", 0, 0, 0, 0)[6:8]
                    parts += [(*moved(i, "median", x + a, y + b, w, h)[:6], *refs, *moved(i, "median", 0, 0, 0, 0)[8:]) for a, b, w, h in rng.choice(SUBS)]
    return width, rng.randrange(0, 20), intra, [rng.randrange(1 << 16) for _ in range(n)], parts


def slices(spark, rows):
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], f"id int, width int, first_mb int, intra array<boolean>, still array<int>, parts array<struct<{V.PART}>>")


def test_waves_agree_with_coded_order(spark):
    rng = random.Random(11)
    rows = [random_slice(rng) for _ in range(400)]
    got = V.slice_motion(slices(spark, rows).repartition(3)).collect()
    assert len(got) == len(rows)
    for r in got:
        assert [tuple(b) for b in r["blocks"]] == raster(*rows[r["id"]]), rows[r["id"]]


def test_empty_slices_and_no_slices(spark):
    rows = [(4, 0, [], [], []), (4, 2, [True], [0], []), (3, 0, [False], [0], [(0, SHAPE["skip"], 0, 0, 4, 4, 0, -1, 0, 0, 0, 0)])]
    got = {r["id"]: [tuple(b) for b in r["blocks"]] for r in V.slice_motion(slices(spark, rows)).collect()}
    assert got == {0: [], 1: [(-1, -1, 0, 0, 0, 0)] * 16, 2: [(0, -1, 0, 0, 0, 0)] * 16}
    assert V.slice_motion(slices(spark, rows).where("id < 0")).collect() == []


def test_a_batch_of_many_slices_is_taken_in_pieces(spark, monkeypatch):
    n = F.lit(0)
    rows = spark.range(40, numPartitions=1).select(
        "id", F.lit(5).alias("width"), n.alias("first_mb"), F.array_repeat(F.lit(False), 10).alias("intra"), F.array_repeat(n, 10).alias("still"),
        F.transform(F.sequence(n, F.lit(9)), lambda i: V.part(i, "median", x0=F.col("id") - i, y0=i)).alias("parts"),
    )
    whole = sorted(V.slice_motion(rows).collect())
    batch = pa.RecordBatch.from_pylist([r.asDict(recursive=True) for r in rows.collect()], pa.schema([
        ("id", pa.int64()), ("width", pa.int32()), ("first_mb", pa.int32()), ("intra", pa.list_(pa.bool_())), ("still", pa.list_(pa.int32())),
        ("parts", pa.list_(pa.struct([(f.split(":")[0], pa.int32()) for f in V.PART.split(",")]))),
    ]))
    sizes = []
    moved = V._moved
    monkeypatch.setattr(V, "_moved", lambda piece: sizes.append(piece.num_rows) or moved(piece))
    monkeypatch.setattr(V, "MACROBLOCKS", 30)
    made = [r for piece in V._runs(["id"])([batch]) for r in piece.to_pylist()]
    assert sizes == [3] * 13 + [1]
    assert made == [r.asDict(recursive=True) for r in whole]
