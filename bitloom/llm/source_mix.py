"""Mixing sources to target weights with a hypergeometric splitting tree, in DataFrame operations only.

Targets
    A document's size is its words. Sources in code-point order, null last, get
    the weights in turn and share ``share`` times all words; a target stops at
    ``cap`` times its source's words, and the excess goes to the others by
    weight until none is above.

Blocks
    The documents of a source are parted by the bit length of their size, its
    strata, and dealt to the blocks of a stratum by hash; blocks and the
    documents in a block are permuted by hash. A source's mix is whole epochs,
    all its blocks, and then a part of one more epoch: of each stratum the
    first blocks in permuted order, about as large a part of each.

The last epoch
    Strata are gone through from the longest documents to the shortest. Each
    takes the number of whole blocks that comes nearest to its part of the room
    left, so that what one stratum is off is made up by the next, never more
    than the room and never so few that the shorter documents could not fill
    it. A second turn takes further whole blocks as long as they fit, a third
    the first documents of the block at each stratum's edge, and last comes the
    one document whose size is nearest to the room, if that brings the sum
    nearer. In the end the room is below the size of every document not taken.

Splitting tree
    The drawn block slots of all sources are dealt to ``shards`` output shards.
    A node of the tree holds an exact quota of slots for each source; its left
    child gets as many as it has shards, drawn without replacement: source by
    source a hypergeometric draw from what is left. Sources come in groups of
    about ``GROUP``: a node's slots are drawn for its groups first, then in
    each group, in rows of their own, for its sources. The leaves' quotas cut
    each source's slots into disjoint ranges. Within a shard rows are ordered
    by hash. All draws are hashes of the seed, so reruns agree.

Scale
    Documents are read twice and not shuffled; a table of (source, size, hash)
    is read a fixed number of times, whatever the skew. One aggregation finds
    the words of each stratum, one those of each block, map-side first. There
    are at most ``BLOCKS`` blocks besides one for each stratum, a source has at
    most as many strata as its longest document's size has bits, and a hot
    source is many blocks. So what is planned on is bounded by BLOCKS and the
    number of sources: it is handled in one task and broadcast where strata are
    counted at no more than ``PLAN_BYTES``, and shuffled otherwise. A block at
    an edge with more than ``EDGE`` places is cut into ranges of places, and
    the one at the edge again.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from bitloom.llm._scratch import Scratch

WEIGHTS = (5.0, 2.0, 1.0)
SHARE = 1.5
CAP = 2.0
SHARDS = 16
SEED = 42
#: Blocks of all strata together, but for one more of each stratum.
BLOCKS = 4096
#: Sources that one row of the splitting tree draws for, on average.
GROUP = 256
#: Places of a block at an edge that are gone through one by one; more are cut into ranges first.
EDGE = 4096
#: Plans estimated above this are not handled in one task or broadcast.
PLAN_BYTES = 64 * 1024 * 1024
#: Tasks and files of a shard.
FILES = 8
GRAIN = 1e-6


def words(text: Column) -> Column:
    r"""Number of `[^\x20\x09-\x0D]+` in a text; null has 0."""
    return F.coalesce(F.regexp_count(text.cast("string"), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def _unit(*parts: Column) -> Column:
    """A number in [0, 1) that depends on the parts alone."""
    return F.shiftrightunsigned(F.xxhash64(*parts), 11).cast("double") / float(1 << 53)


def targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """(source, source_size) with a target for each source.

    Water filling: a source is capped if its cap over its weight is below the
    level that the rest would share, so the sources are ranked by that ratio
    and the capped ones are a prefix. There is a row for each source, not for
    each document; the rank of sources is Spark's global sort of those rows.
    """
    order = W.orderBy(F.col("source").isNull(), F.col("source").cast("binary"))
    weight = F.element_at(F.array(*(F.lit(float(w)) for w in weights)), ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int"))
    ranked = sizes.withColumn("weight", weight).withColumn("most", F.col("source_size") * cap)
    by_ratio = W.orderBy(F.col("most") / F.col("weight"), F.col("source").isNull(), F.col("source").cast("binary"))
    before = by_ratio.rowsBetween(W.unboundedPreceding, -1)
    everything = W.partitionBy()
    ranked = ranked.withColumn("all", F.sum("source_size").over(everything) * share).withColumn("weights", F.sum("weight").over(everything))
    left = F.col("all") - F.coalesce(F.sum("most").over(before), F.lit(0.0))
    level = left / (F.col("weights") - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
    ranked = ranked.withColumn("level", level).withColumn("open", F.col("level") * F.col("weight") <= F.col("most"))
    # The level at the first source that is not capped holds for all after it.
    final = F.min(F.when(F.col("open"), F.struct(F.col("most") / F.col("weight"), F.col("source").isNull(), F.col("source").cast("binary"), F.col("level")))).over(everything)
    target = F.least(F.col("most"), F.coalesce(final["level"] * F.col("weight"), F.col("most")))
    return ranked.select("source", "source_size", "weight", target.alias("target"))


def _let(make, **values: Column) -> Column:
    """``make`` applied to values that are worked out once, wherever it uses them."""
    return F.transform(F.array(F.struct(*(v.alias(k) for k, v in values.items()))), make)[0]


def hypergeometric(total: Column, good: Column, drawn: Column, unit: Column) -> Column:
    """How many of ``drawn`` out of ``total`` are among the ``good``, by inversion at ``unit`` in [0, 1). All doubles holding whole numbers.

    Probabilities are followed outwards from the mode, where they are largest,
    over all counts within 12 deviations (and 12 more) of it; what lies beyond
    weighs less than the grain of ``unit``.
    """

    def ratio(v: Column, k: Column) -> Column:
        """The probability of k + 1 over that of k."""
        return ((v["good"] - k) * (v["drawn"] - k)) / ((k + 1) * (v["total"] - v["good"] - v["drawn"] + k + 1))

    def steps(n: Column) -> Column:
        return F.when(n >= 1, F.sequence(F.lit(1).cast("long"), n.cast("long"))).otherwise(F.array().cast("array<bigint>"))

    def walk(v: Column, up: bool, start: Column, seek: Column | None = None) -> Column:
        """Sum of the weights on one side of the mode, whose weight is 1; with ``seek`` the count at which the sum passes it."""
        sign = 1 if up else -1

        def step(state: Column, i: Column) -> Column:
            k = v["mode"] + sign * i.cast("double")
            w = state["w"] * ratio(v, k - 1) if up else state["w"] / ratio(v, k)
            new = F.struct(w.alias("w"), (state["sum"] + w).alias("sum"))
            return new if seek is None else F.struct(new["w"].alias("w"), new["sum"].alias("sum"), F.coalesce(state["k"], F.when(seek < new["sum"], k)).alias("k"))

        first = [F.lit(1.0).alias("w"), start.alias("sum"), *([] if seek is None else [F.lit(None).cast("double").alias("k")])]
        return F.aggregate(steps(v["last"] - v["mode"] if up else v["mode"] - v["first"]), F.struct(*first), step, lambda s: s["sum" if seek is None else "k"])

    def draw(v: Column) -> Column:
        # Counts in the order mode, mode + 1, ..., last, mode - 1, ..., first; the first whose running sum passes the goal.
        def found(x: Column) -> Column:
            return F.when(x["goal"] < 1, v["mode"]).otherwise(F.coalesce(walk(v, True, F.lit(1.0), x["goal"]), walk(v, False, 1 + x["above"], x["goal"]), v["mode"]))

        def weighed(x: Column) -> Column:
            return _let(found, above=x["above"], goal=v["unit"] * (1 + x["above"] + x["below"]))

        return _let(weighed, above=walk(v, True, F.lit(0.0)), below=walk(v, False, F.lit(0.0)))

    def bounded(v: Column) -> Column:
        same = {k: v[k] for k in ("total", "good", "drawn", "unit", "mode")}
        return _let(draw, first=F.greatest(v["low"], v["mode"] - v["reach"]), last=F.least(v["high"], v["mode"] + v["reach"]), **same)

    low, high = F.greatest(F.lit(0.0), drawn + good - total), F.least(drawn, good)
    mode = F.least(high, F.greatest(low, F.floor((drawn + 1) * (good + 1) / (total + 2)).cast("double")))
    share = good / F.greatest(total, F.lit(1.0))
    reach = F.ceil(12 + 12 * F.sqrt(F.greatest(F.lit(0.0), drawn * share * (1 - share)))).cast("double")
    return _let(bounded, total=total, good=good, drawn=drawn, unit=unit, low=low, high=high, mode=mode, reach=reach)


def _deal(quotas: Column, total: Column, slots: Column, unit) -> Column:
    """How many of ``slots`` each entry (k, quota) of an array gets, out of ``total``; unit(k) is its draw."""

    def draw(state: Column, x: Column) -> Column:
        took = hypergeometric(state["total"], x["quota"], state["slots"], unit(x["k"]))
        return _let(lambda t: F.struct((state["total"] - x["quota"]).alias("total"), (state["slots"] - t["k"]).alias("slots"), F.concat(state["out"], F.array(t["k"])).alias("out")), k=took)

    start = F.struct(total.alias("total"), slots.alias("slots"), F.array().cast("array<double>").alias("out"))
    return F.aggregate(quotas, start, draw, lambda s: s["out"])


def _sum(array: Column | str) -> Column:
    return F.aggregate(array, F.lit(0.0), lambda s, x: s + x["quota"])


def _leaves(quotas: str, shards: int, slots, unit) -> Column:
    """The leaves (lo, hi, q) of the tree over an array (k, quota), q being their parts of it.

    slots(node) says how many slots the left child of a node (lo, mid, hi, q, total) gets, unit(node, k) is the draw of an entry there.
    """

    def struct(lo: Column, hi: Column, q: Column) -> Column:
        return F.struct(lo.alias("lo"), hi.alias("hi"), q.alias("q"))

    def part(v: Column) -> Column:
        left = F.zip_with(v["q"], v["left"], lambda x, t: F.struct(x["k"].alias("k"), t.alias("quota")))
        right = F.zip_with(v["q"], v["left"], lambda x, t: F.struct(x["k"].alias("k"), (x["quota"] - t).alias("quota")))
        return F.array(struct(v["lo"], v["mid"], left), struct(v["mid"], v["hi"], right))

    def draw(v: Column) -> Column:
        same = {k: v[k] for k in ("lo", "mid", "hi", "q")}
        return _let(part, left=_deal(v["q"], v["total"], F.least(v["total"], slots(v)), lambda k: unit(v, k)), **same)

    def children(node: Column) -> Column:
        middle = F.floor((node["lo"] + node["hi"] + 1) / 2).cast("int")
        return F.when(node["hi"] - node["lo"] > 1, _let(draw, lo=node["lo"], hi=node["hi"], mid=middle, q=node["q"], total=_sum(node["q"]))).otherwise(F.array(node))

    top = F.array(struct(F.lit(0), F.lit(shards), F.col(quotas)))
    levels = F.sequence(F.lit(1), F.lit((shards - 1).bit_length())) if shards > 1 else F.array().cast("array<int>")
    return F.aggregate(levels, top, lambda nodes, _: F.flatten(F.transform(nodes, children)))


def _split(quotas: DataFrame, shards: int, seed: int, scratch: Scratch, group: int = GROUP) -> DataFrame:
    """(_bitloom_no, quota) -> (_bitloom_no, shard, quota): the tree's leaves.

    With several groups the tree is drawn for the groups' sums first. Then each
    group, a row of about ``group`` sources, knows its slots in every node.
    """
    groups = 1 + (quotas.count() - 1) // group
    entry = F.struct(F.col("_bitloom_no").alias("k"), F.col("quota").cast("double").alias("quota"))
    rows = quotas.groupBy(F.pmod(F.xxhash64("_bitloom_no"), F.lit(groups)).alias("g")).agg(F.array_sort(F.collect_list(entry)).alias("q"))

    def even(v: Column) -> Column:
        """A part of the slots by shards, rounded at random so that no shard is favoured."""
        share = (v["mid"] - v["lo"]) / (v["hi"] - v["lo"])
        return F.floor(v["total"] * share + _unit(F.lit(seed), F.lit("slots"), v["lo"], v["hi"])).cast("double")

    def given(v: Column) -> Column:
        return F.aggregate(F.slice("slots", v["lo"] + 1, v["mid"] - v["lo"]), F.lit(0.0), lambda s, x: s + x)

    slots = even
    if groups > 1:
        rows = scratch.keep(rows, "groups")
        sums = rows.select(F.col("g").cast("long").alias("k"), _sum("q").alias("quota")).groupBy().agg(F.array_sort(F.collect_list(F.struct("k", "quota"))).alias("sums"))
        leaves = sums.select(F.explode(_leaves("sums", shards, even, lambda v, k: _unit(F.lit(seed), F.lit("group"), v["lo"], v["hi"], k))).alias("n"))
        leaves = leaves.select(F.col("n.lo").alias("shard"), F.explode("n.q").alias("x")).groupBy(F.col("x.k").alias("g")).agg(F.array_sort(F.collect_list(F.struct("shard", "x.quota"))).alias("l"))
        leaves = scratch.keep(leaves.select("g", F.col("l.quota").alias("slots")), "group-slots")
        rows, slots = rows.join(leaves, "g"), given
    nodes = rows.select(F.explode(_leaves("q", shards, slots, lambda v, k: _unit(F.lit(seed), v["lo"], v["hi"], k))).alias("n"))
    return nodes.select(F.col("n.lo").alias("shard"), F.explode("n.q").alias("x")).select(F.col("x.k").alias("_bitloom_no"), "shard", F.col("x.quota").cast("long").alias("quota"))


def _whole_blocks(strata: str) -> Column:
    """(room, took) after the first two turns; strata holds (down, words of the blocks in order) from the longest documents to the shortest.

    Columns left and source_size are the source's.
    """

    def nearest(v: Column) -> Column:
        """The number of blocks and their words that serve the goal best."""

        def step(s: Column, w: Column) -> Column:
            def better(x: Column) -> Column:
                ok = (x["sum"] <= v["room"] + GRAIN) & ((x["short"] < s["short"]) | ((x["short"] == s["short"]) & (x["off"] < s["off"])))
                return F.struct(x["sum"].alias("sum"), x["n"].alias("n"), *(F.when(ok, x[a]).otherwise(s[b]).alias(b) for a, b in (("n", "took"), ("sum", "words"), ("short", "short"), ("off", "off"))))

            total = s["sum"] + w
            return _let(better, sum=total, n=s["n"] + 1, short=F.greatest(F.lit(0.0), v["least"] - total), off=F.abs(v["goal"] - total))

        zero, none = F.lit(0.0), F.lit(0)
        start = F.struct(zero.alias("sum"), none.alias("n"), none.alias("took"), zero.alias("words"), F.greatest(zero, v["least"]).alias("short"), F.abs(v["goal"]).alias("off"))
        return F.aggregate(v["blocks"], start, step, lambda s: F.struct(s["took"].alias("took"), s["words"].alias("words")))

    def first(state: Column, x: Column) -> Column:
        below = state["below"] - F.aggregate(x["words"], F.lit(0.0), lambda s, w: s + w)
        goal = state["room"] - F.col("left") / F.col("source_size") * below
        best = _let(nearest, blocks=x["words"], room=state["room"], goal=goal, least=state["room"] - below)
        return _let(lambda b: F.struct((state["room"] - b["b"]["words"]).alias("room"), b["below"].alias("below"), F.concat(state["took"], F.array(b["b"]["took"])).alias("took")), b=best, below=below)

    def further(state: Column, x: Column) -> Column:
        def step(s: Column, w: Column) -> Column:
            fits = s["open"] & (s["sum"] + w <= state["room"] + GRAIN)
            return F.struct(fits.alias("open"), F.when(fits, s["sum"] + w).otherwise(s["sum"]).alias("sum"), F.when(fits, s["n"] + 1).otherwise(s["n"]).alias("n"))

        rest = F.slice(x["words"], x["took"] + 1, F.greatest(F.lit(0), F.size(x["words"]) - x["took"]))
        more = F.aggregate(rest, F.struct(F.lit(True).alias("open"), F.lit(0.0).alias("sum"), x["took"].alias("n")), step)
        return _let(lambda m: F.struct((state["room"] - m["m"]["sum"]).alias("room"), F.concat(state["took"], F.array(m["m"]["n"])).alias("took")), m=more)

    no_ints = F.array().cast("array<int>")
    start = F.struct(F.col("left").alias("room"), F.col("source_size").cast("double").alias("below"), no_ints.alias("took"))

    def second(v: Column) -> Column:
        pairs = F.zip_with(F.col(strata), v["s"]["took"], lambda x, t: F.struct(x["words"].alias("words"), t.alias("took")))
        return F.aggregate(pairs, F.struct(v["s"]["room"].alias("room"), no_ints.alias("took")), further)

    return _let(second, s=F.aggregate(strata, start, first))


def _edges(strata: str) -> Column:
    """(room, out) after a turn over the cells (at, mass, rows) at the edge of each stratum, in order; out: the last place taken and the cells passed over.

    A cell of several rows in one place that does not fit is passed over; any
    other cell that does not fit ends its stratum's turn and is named in stop.
    """

    def stratum(state: Column, x: Column) -> Column:
        def step(s: Column, c: Column) -> Column:
            fits = c["mass"] <= s["room"] + GRAIN
            on = s["stop"].isNull()
            return F.struct(
                F.when(on & fits, s["room"] - c["mass"]).otherwise(s["room"]).alias("room"), F.when(on & fits, c["at"]).otherwise(s["last"]).alias("last"),
                F.when(on & ~fits & ~c["tied"], c["at"]).otherwise(s["stop"]).alias("stop"), F.when(on & ~fits & c["tied"], F.concat(s["apart"], F.array(c["at"]))).otherwise(s["apart"]).alias("apart"),
            )

        nothing = F.lit(None).cast("long")
        start = F.struct(state["room"].alias("room"), nothing.alias("last"), nothing.alias("stop"), F.array().cast("array<bigint>").alias("apart"))
        cut = lambda r: F.struct(x["class"].alias("class"), r["r"]["last"].alias("last"), r["r"]["stop"].alias("stop"), r["r"]["apart"].alias("apart"))
        return _let(lambda r: F.struct(r["r"]["room"].alias("room"), F.concat(state["out"], F.array(cut(r))).alias("out")), r=F.aggregate(x["cells"], start, step))

    out = F.array().cast("array<struct<class:int,last:bigint,stop:bigint,apart:array<bigint>>>")
    return F.aggregate(strata, F.struct(F.col("room").alias("room"), out.alias("out")), stratum)


def _edge_cuts(cells: DataFrame, rooms: DataFrame, one) -> DataFrame:
    """(_bitloom_no, room, out) from cells (_bitloom_no, class, at, mass, tied) and the rooms of their sources."""
    strata = one(cells).groupBy("_bitloom_no", "class").agg(F.array_sort(F.collect_list(F.struct("at", F.col("mass").cast("double").alias("mass"), "tied"))).alias("cells"))
    per = strata.groupBy("_bitloom_no").agg(F.array_sort(F.collect_list(F.struct((-F.col("class")).alias("down"), "class", "cells"))).alias("strata"))
    return per.join(one(rooms), "_bitloom_no").select("_bitloom_no", _edges("strata").alias("e")).select("_bitloom_no", "e.*")


def mix(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, cap: float = CAP, shards: int = SHARDS, seed: int = SEED, edge: int = EDGE) -> DataFrame:
    """``docs`` with mix_size, mix_source_size, mix_target and mix_copies.

    mix_copies lists what the mix takes of the row, none, one or more whole
    copies: (epoch, shard, place), where place orders a shard. No row is taken
    more than ceil(cap) times. A null text has size 0; a null source is a
    source of its own, ordered last. The rows of a source without words have
    target 0 and no copies. Rows repeated under one doc_id are dealt by id and
    text; rows equal in both share one place in the permutation and are taken
    together. Input columns with the names of the added ones are replaced; an
    empty table stays empty.
    """
    docs = docs.drop("mix_size", "mix_source_size", "mix_target", "mix_copies")
    scratch = Scratch(docs.sparkSession, "mix")
    key = F.xxhash64(F.lit(seed), F.col("doc_id"), F.xxhash64(F.col("text").cast("string")))
    slim = scratch.keep(docs.select(F.col("source").cast("string").alias("source"), words(F.col("text")).alias("size"), key.alias("key")), "sizes")

    # Sources, their strata and blocks. Class -1 holds what has no words.
    sums = scratch.keep(slim.groupBy("source", _class("size").alias("class")).agg(F.sum("size").alias("words")), "sums")
    n, n_bytes = sums.agg(F.count("*"), F.sum(F.octet_length("source"))).first()
    small = n * 1024 + (n_bytes or 0) <= PLAN_BYTES
    one = (lambda df: df.coalesce(1)) if small else (lambda df: df)
    hint = F.broadcast if small else (lambda df: df)
    aims = targets(one(sums).groupBy("source").agg(F.sum("words").alias("source_size")), weights, share, cap)
    epochs = F.floor(F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0) + 1e-12)
    block_words = F.greatest(F.lit(1), F.ceil(F.sum("source_size").over(W.partitionBy()) / BLOCKS))
    aims = aims.withColumn("epochs", epochs).withColumn("left", F.greatest(F.lit(0.0), F.col("target") - F.col("epochs") * F.col("source_size"))).withColumn("block_words", block_words)
    strata = one(sums).join(aims.withColumnRenamed("source", "own"), F.col("source").eqNullSafe(F.col("own")))
    no = F.xxhash64(F.lit(seed), F.coalesce("source", F.lit("")), F.col("source").isNull()).alias("_bitloom_no")
    n_blocks = F.greatest(F.lit(1), F.ceil(F.col("words") / F.col("block_words"))).cast("int").alias("n_blocks")
    strata = scratch.keep(strata.select("source", "class", no, n_blocks, "source_size", "target", "epochs", "left"), "strata")
    lookup = hint(strata.select(F.col("source").alias("_bitloom_source"), F.col("class").alias("_bitloom_class"), "_bitloom_no", F.col("n_blocks").alias("_bitloom_n_blocks"), F.col("source_size").alias("mix_source_size"), F.col("target").alias("mix_target")))

    def dealt(df: DataFrame, source: str, size: str, key: str) -> DataFrame:
        df = df.join(lookup, F.col(source).cast("string").eqNullSafe(F.col("_bitloom_source")) & (_class(size) == F.col("_bitloom_class")), "left").drop("_bitloom_source")
        return df.withColumn("_bitloom_block", F.pmod(F.col(key), F.col("_bitloom_n_blocks")).cast("int")).withColumn("_bitloom_place", F.xxhash64(F.lit(seed + 1), F.col(key)))

    slim = dealt(slim.where("size > 0"), "source", "size", "key").select("_bitloom_no", F.col("_bitloom_class").alias("class"), F.col("_bitloom_block").alias("block"), F.col("_bitloom_place").alias("place"), "size")
    blocks = scratch.keep(slim.groupBy("_bitloom_no", "class", "block").agg(F.sum("size").alias("words")), "block-words")
    turn = F.xxhash64(F.lit(seed + 2), "_bitloom_no", "class", "block")
    order = (F.row_number().over(W.partitionBy("_bitloom_no", "class").orderBy(turn, "block")) - 1).alias("order")
    among = (F.row_number().over(W.partitionBy("_bitloom_no").orderBy(turn, "class", "block")) - 1).alias("among")
    blocks = scratch.keep(one(blocks).select("*", order, among, F.count("*").over(W.partitionBy("_bitloom_no")).alias("n")), "blocks")
    aims = one(strata).where("source_size > 0").groupBy("_bitloom_no").agg(*(F.first(c).alias(c) for c in ("epochs", "left", "source_size")))

    # The last epoch: whole blocks of each stratum.
    arrays = one(blocks).groupBy("_bitloom_no", "class").agg(F.array_sort(F.collect_list(F.struct("order", F.col("words").cast("double").alias("words")))).alias("b"))
    arrays = arrays.groupBy("_bitloom_no").agg(F.array_sort(F.collect_list(F.struct((-F.col("class")).alias("down"), F.col("b.words").alias("words")))).alias("strata"))
    took = arrays.join(aims, "_bitloom_no").select("_bitloom_no", F.transform("strata", lambda x: x["down"]).alias("down"), _whole_blocks("strata").alias("t"))
    took = took.select("_bitloom_no", F.col("t.room").alias("room"), F.explode(F.arrays_zip("down", F.col("t.took").alias("took"))).alias("x"))
    took = scratch.keep(took.select("_bitloom_no", "room", (-F.col("x.down")).alias("class"), F.col("x.took").alias("whole")), "whole")

    # Documents of the block at the edge of each stratum, places in order; long edges range by range.
    at_edge = one(blocks).join(one(took), ["_bitloom_no", "class"]).where(F.col("order") == F.col("whole")).select("_bitloom_no", "class", "block", F.floor(F.col("room") + GRAIN).alias("limit"))
    edges = slim.join(hint(at_edge), ["_bitloom_no", "class", "block"]).where(F.col("size") <= F.col("limit"))
    edges = scratch.keep(edges.groupBy("_bitloom_no", "class", "place").agg(F.sum("size").alias("mass"), (F.count("*") > 1).alias("tied")), "edges")
    rooms = one(took).groupBy("_bitloom_no").agg(F.first("room").alias("room"))
    cuts, bits = [], 0
    while bits < 60 and (edges.groupBy("_bitloom_no", "class").count().agg(F.max("count")).first()[0] or 0) > edge:
        bits += 12
        ranges = edges.groupBy("_bitloom_no", "class", F.shiftright("place", 64 - bits).alias("at")).agg(F.sum("mass").alias("mass"), F.lit(False).alias("tied"))
        ranges = scratch.keep(ranges, f"range-words-{bits}")
        found = scratch.keep(_edge_cuts(ranges, rooms, one), f"ranges-{bits}")
        rooms = _rooms(rooms, found, one)
        out = found.select("_bitloom_no", F.explode("out").alias("o")).select("_bitloom_no", "o.*")
        cuts.append(out.select("_bitloom_no", "class", (F.shiftleft(F.col("last") + 1, 64 - bits) - 1).alias("cut"), "apart"))
        # The next turn looks into the range that did not fit.
        edges = edges.join(hint(out.where("stop is not null").select("_bitloom_no", "class", "stop")), ["_bitloom_no", "class"])
        edges = scratch.keep(edges.where(F.shiftright("place", 64 - bits) == F.col("stop")).drop("stop"), f"edges-{bits}")
    found = scratch.keep(_edge_cuts(edges.withColumnRenamed("place", "at"), rooms, one), "cuts")
    rooms = _rooms(rooms, found, one)
    cuts.append(found.select("_bitloom_no", F.explode("out").alias("o")).select("_bitloom_no", "o.class", F.col("o.last").alias("cut"), "o.apart"))
    cuts = reduce(DataFrame.union, (one(c) for c in cuts))
    cuts = one(cuts).groupBy("_bitloom_no", "class").agg(F.max("cut").alias("cut"), F.flatten(F.collect_list("apart")).alias("apart"))
    edge_rules = one(at_edge).join(one(cuts), ["_bitloom_no", "class"], "left").select("_bitloom_no", "class", "limit", "cut", "apart")
    plan = one(blocks).drop("words").join(one(took).drop("room"), ["_bitloom_no", "class"]).join(one(rooms), "_bitloom_no").join(one(aims), "_bitloom_no").join(one(edge_rules), ["_bitloom_no", "class"], "left")
    plan = scratch.keep(plan.drop("left", "source_size"), "rules")

    # The one document that comes nearest to the room left.
    rest = slim.join(hint(plan.where(F.col("room") >= 0.5).drop("among", "n", "epochs")), ["_bitloom_no", "class", "block"]).where((F.col("size") < 2 * F.col("room")) & ~_in_last_epoch(F.col("place"), F.col("size")))
    rest = rest.groupBy("_bitloom_no", "class", "block", "place", "room").agg(F.sum("size").alias("mass")).withColumn("off", F.abs(F.col("mass") - F.col("room"))).where("off < room")
    nearest = scratch.keep(rest.groupBy("_bitloom_no").agg(F.min(F.struct("off", "class", "block", "place")).alias("near")), "nearest")

    # Slots: for each source its whole epochs, then the blocks of which the last epoch takes something.
    plan = one(plan).join(one(nearest), "_bitloom_no", "left")
    extra = F.when((F.col("near.class") == F.col("class")) & (F.col("near.block") == F.col("block")), F.col("near.place"))
    part = (F.col("order") < F.col("whole")) | ((F.col("order") == F.col("whole")) & F.col("cut").isNotNull()) | extra.isNotNull()
    plan = plan.withColumn("extra", extra).withColumn("part", F.coalesce(part, F.lit(False)))
    plan = plan.withColumn("rank", F.row_number().over(W.partitionBy("_bitloom_no").orderBy(~F.col("part"), "among"))).drop("near")
    plan = scratch.keep(plan, "slots")
    quotas = one(plan).groupBy("_bitloom_no").agg((F.first("epochs") * F.first("n") + F.count_if("part")).cast("long").alias("quota"))
    leaves = one(_split(quotas, shards, seed, scratch)).groupBy("_bitloom_no").agg(F.array_sort(F.collect_list(F.struct("shard", "quota"))).alias("leaves"))
    ends = F.transform("leaves", lambda _, i: F.aggregate(F.slice("leaves", 1, i + 1), F.lit(0).cast("long"), lambda s, x: s + x["quota"]))
    plan = one(plan).join(one(leaves.select("_bitloom_no", ends.alias("ends"))), "_bitloom_no")

    def slot(epoch: Column, number: Column, part: bool) -> Column:
        return F.struct(epoch.alias("epoch"), F.size(F.filter("ends", lambda e: e <= number)).alias("shard"), F.lit(part).alias("part"))

    epochs = F.when(F.col("epochs") > 0, F.sequence(F.lit(0).cast("long"), F.col("epochs").cast("long") - 1)).otherwise(F.array().cast("array<bigint>"))
    whole_slots = F.transform(epochs, lambda e: slot(e, e * F.col("n") + F.col("among") - 1, False))
    last_slot = F.when(F.col("part"), F.array(slot(F.col("epochs").cast("long"), F.col("epochs") * F.col("n") + F.col("rank") - 1, True))).otherwise(F.array().cast("array<struct<epoch:bigint,shard:int,part:boolean>>"))
    names = {"class": "_bitloom_class", "block": "_bitloom_block", **{c: f"_bitloom_{c}" for c in ("order", "whole", "limit", "cut", "apart", "extra")}}
    plan = scratch.keep(plan.select("_bitloom_no", *(F.col(a).alias(b) for a, b in names.items()), F.concat(whole_slots, last_slot).alias("_bitloom_slots")), "plan")

    out = docs.select("*", words(F.col("text")).alias("mix_size"), key.alias("_bitloom_key"))
    out = dealt(out, "source", "mix_size", "_bitloom_key").join(hint(plan), ["_bitloom_no", "_bitloom_class", "_bitloom_block"], "left")
    fits = _in_last_epoch(F.col("_bitloom_place"), F.col("mix_size"), "_bitloom_") | F.coalesce(F.col("_bitloom_place") == F.col("_bitloom_extra"), F.lit(False))
    taken = F.filter("_bitloom_slots", lambda s: (F.col("mix_size") > 0) & (~s["part"] | fits))
    copies = F.transform(taken, lambda s: F.struct(s["epoch"].alias("epoch"), s["shard"].alias("shard"), F.xxhash64(F.lit(seed + 3), s["epoch"], F.col("_bitloom_key")).alias("place")))
    empty = F.array().cast("array<struct<epoch:bigint,shard:int,place:bigint>>")
    out = out.select(*docs.columns, "mix_size", "mix_source_size", "mix_target", F.coalesce(copies, empty).alias("mix_copies"))
    scratch.drop_all_but("strata", "plan")
    return out


def _in_last_epoch(place: Column, size: Column, prefix: str = "") -> Column:
    """Whether the last epoch takes what has this place and size, but for the nearest document."""
    order, whole, limit, cut, apart = (F.col(prefix + c) for c in ("order", "whole", "limit", "cut", "apart"))
    at_edge = (order == whole) & (size <= limit) & (place <= cut) & ~F.array_contains(apart, place)
    return F.coalesce((order < whole) | at_edge, F.lit(False))


def _class(size: str) -> Column:
    """Bits of a size, less one; -1 for size 0."""
    return F.when(F.col(size) > 0, F.length(F.bin(size)) - 1).otherwise(-1)


def _rooms(rooms: DataFrame, found: DataFrame, one) -> DataFrame:
    """The rooms of the sources after a turn, which leaves out those without an edge."""
    new = one(found).select("_bitloom_no", F.col("room").alias("new"))
    return one(rooms).join(new, "_bitloom_no", "left").select("_bitloom_no", F.coalesce("new", "room").alias("room"))


def _mixed(docs: DataFrame, shards: int, files: int, how: dict) -> DataFrame:
    """The columns of ``docs`` with _bitloom_shard, a row for each copy, each partition's rows in the order of their places.

    A shard is spread over ``files`` tasks by place, so none gathers a whole shard.
    """
    rows = mix(docs, shards=shards, **how).select(*docs.columns, F.explode("mix_copies").alias("_bitloom_copy"))
    rows = rows.select(*docs.columns, F.col("_bitloom_copy.shard").alias("_bitloom_shard"), F.col("_bitloom_copy.place").alias("_bitloom_place"))
    part = F.col("_bitloom_shard") * files + F.pmod("_bitloom_place", F.lit(files)).cast("int")
    return rows.repartitionById(shards * files, part).sortWithinPartitions("_bitloom_place")


def mixed(docs: DataFrame, shards: int = SHARDS, files: int = FILES, **how) -> DataFrame:
    """The mix itself, with the columns of ``docs``: each row as often as it is taken, dealt to the shards and shuffled within each."""
    return _mixed(docs, shards, files, how).select(*docs.columns)


def write_shards(docs: DataFrame, path: str, shards: int = SHARDS, files_per_shard: int = FILES, **how) -> None:
    """Write the mix below ``path``, one folder for each shard, rows in the order of their place within a file."""
    rows = _mixed(docs, shards, files_per_shard, how).withColumnRenamed("_bitloom_shard", "shard").withColumnRenamed("_bitloom_place", "place")
    rows.write.partitionBy("shard").parquet(path)
