"""Exact top-k search over binary codes by incremental multi-index hashing.

A code is the signs of a vector's components. It is cut into segments of at most
as many bits as the logarithm of the number of rows, so that a segment value
has a row or some: a probe that is shuffled costs more than a row verified in
place. An index row stands under each of its segment values. In round r the
values at exactly r bits from a query's segments are looked up, and every row
found there is verified by its full Hamming distance. After round r all codes
within ``segments * (r + 1) - 1`` bits have been seen, so a query is finished as
soon as its kth verified distance is no larger; the others go on to round r + 1.

Scale: equal query codes are one search. Of equal index codes only the k rows
with the smallest ids can be in any answer, so the others are cut by a rank
that Spark limits before its shuffle. A candidate is taken only under the first
of its nearest segments, so it is verified once, and goes on only if it is no
farther than the kth so far. Everything is a join on (segment, value): nothing
is compared with all rows. A round r makes at most C(width, r) probes for each
open query and segment, 2^width over all rounds, about as many as there are
rows; only a query whose kth neighbour is half the code away gets that far. A
hot (segment, value) is a plain equi-join, whose skewed side Spark splits.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import ceil, comb, log2

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from bitloom.llm._scratch import Scratch

K = 10
BITS = 64


def sign_code(vector: Column, bits: int = BITS) -> Column:
    """The signs of the first ``bits`` (at most 64) components as a bigint; bit i is 1 where component i is above 0. Missing, null and NaN components count as 0."""
    out = F.lit(0).cast("long")
    for i in range(bits):
        value = F.try_element_at(vector, F.lit(i + 1))
        weight = (1 << i) - ((1 << 64) if i == 63 else 0)
        out = out.bitwiseOR(F.when((value > 0) & ~F.isnan(value), F.lit(weight).cast("long")).otherwise(F.lit(0).cast("long")))
    return out


def _cuts(bits: int, segments: int) -> list[tuple[int, int]]:
    """(first bit, width) of segments of nearly equal width."""
    ends = [bits * i // segments for i in range(segments + 1)]
    return [(a, b - a) for a, b in zip(ends, ends[1:])]


def top_k(index: DataFrame, queries: DataFrame, k: int = K, segments: int | None = None, bits: int = BITS) -> DataFrame:
    """The k rows of ``index`` nearest to each row of ``queries``; both hold (id, code bigint).

    Returns query_id, rank (from 1), id, distance: by distance, then by id. A
    row that is also a query finds itself. Rows with a null id or code are in
    no answer and get none; a query repeated under one id is answered once, an
    index row repeated under one id and code counts once. With fewer than k
    index rows the answers have all of them; an empty table gives an empty
    result. Other columns are ignored.
    """
    scratch = Scratch(index.sparkSession, "topk")

    def segment(code: str, at: int) -> Column:
        start, width = cuts[at]
        return F.shiftrightunsigned(code, start).bitwiseAND(F.lit((1 << width) - 1).cast("long"))

    def under_segments(df: DataFrame) -> DataFrame:
        cells = F.array(*(F.struct(F.lit(i).alias("seg"), segment("code", i).alias("val")) for i in range(segments)))
        return df.select("*", F.explode(cells).alias("cell")).select(*df.columns, "cell.seg", "cell.val")

    rows = index.select("id", "code").where("id is not null and code is not null").distinct()
    rows = rows.withColumn("nth", F.row_number().over(W.partitionBy("code").orderBy("id"))).where(F.col("nth") <= k).drop("nth")
    rows = scratch.keep(rows, "rows")
    asked = scratch.keep(queries.select(F.col("id").alias("query_id"), "code").where("query_id is not null and code is not null").distinct(), "queries")
    n_rows = rows.count()
    there = min(n_rows, k)
    if segments is None:
        segments = max(2, min(8, ceil(bits / max(1.0, log2(max(1, n_rows))))))
    cuts = _cuts(bits, segments)
    indexed = under_segments(rows.withColumnRenamed("id", "row_id"))

    # Codes asked for that are not finished, with their kth distance so far.
    open_ = scratch.keep(asked.select(F.col("code").alias("q")).distinct().withColumn("worst", F.lit(bits)), "open-0")
    best = done = None
    for radius in range(max(width for _, width in cuts) + 1):
        probes = open_.mapInArrow(_probes(cuts, radius), "q bigint, worst int, seg int, val bigint")
        # A planner that takes the probes for as small as the queries would broadcast them.
        found = probes.hint("merge").join(indexed, ["seg", "val"]).withColumn("x", F.col("q").bitwiseXOR(F.col("code")))
        near = [F.bit_count(segment("x", i)) for i in range(segments)]
        first = F.lit(False)
        for i in range(segments):
            others = [(n > radius) if j < i else (n >= radius) for j, n in enumerate(near) if j != i]
            mine = (F.col("seg") == i) & (near[i] == radius)
            for other in others:
                mine = mine & other
            first = first | mine
        found = found.where(first & (F.bit_count("x") <= F.col("worst"))).select("q", F.col("row_id").alias("id"), F.bit_count("x").alias("distance"))
        if best is not None:
            found = found.unionByName(best)
        ranked = found.withColumn("rank", F.row_number().over(W.partitionBy("q").orderBy("distance", "id"))).where(F.col("rank") <= k)
        ranked = scratch.keep(ranked, f"ranked-{radius}")
        seen = segments * (radius + 1) - 1
        state = ranked.groupBy("q").agg(F.count("*").alias("n"), F.max("distance").alias("now"))
        state = open_.join(state, "q", "left").select("q", F.when(F.col("n") >= k, F.col("now")).otherwise(F.lit(bits)).alias("worst"), F.coalesce((F.col("n") >= there) & (F.col("now") <= seen), F.lit(False)).alias("sure"))
        state = scratch.keep(state, f"state-{radius}")
        sure = state.where("sure").select("q")
        complete = ranked.join(sure, "q", "left_semi")
        done = complete if done is None else done.unionByName(complete)
        best = ranked.join(sure, "q", "left_anti").select("q", "id", "distance")
        open_ = state.where("not sure").select("q", "worst")
        if open_.isEmpty():
            break
    return asked.join(done, asked["code"] == done["q"]).select("query_id", "rank", "id", "distance")


def _masks(bits: int, ones: int) -> np.ndarray:
    """All values of ``bits`` bits with exactly ``ones`` ones."""
    places = np.array(list(combinations(range(bits), ones)), dtype=np.int64).reshape(comb(bits, ones), ones)
    return (np.int64(1) << places).sum(axis=1)


def _probes(cuts: list[tuple[int, int]], radius: int):
    """(q, worst) -> (q, worst, seg, val) for all segment values at exactly ``radius`` bits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        masks = {width: _masks(width, radius) for _, width in cuts}
        for batch in batches:
            codes, worst = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            codes = codes.astype(np.int64)
            step = max(1, 200_000 // max(1, *(len(m) for m in masks.values())))
            for at in range(0, len(codes), step):
                some, bound = codes[at : at + step], worst[at : at + step].astype(np.int32)
                for seg, (start, width) in enumerate(cuts):
                    flips = masks[width]
                    own = (some.view(np.uint64) >> np.uint64(start)).astype(np.int64) & ((1 << width) - 1)
                    values = (own[:, None] ^ flips[None, :]).ravel()
                    columns = [np.repeat(some, len(flips)), np.repeat(bound, len(flips)), np.full(len(values), seg, dtype=np.int32), values]
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["q", "worst", "seg", "val"])

    return run


def oracle_sql(every: int, k: int = K) -> str:
    """Top k of ``embeddings`` for each vec_id divisible by ``every`` by comparing all, in DuckDB SQL."""
    half = "list_sum(list_transform(embedding[{0}:{1}], lambda x, i: CASE WHEN x > 0 AND NOT isnan(x) THEN 1::BIGINT << (i - 1) ELSE 0 END))::BIGINT"
    return f"""
WITH c AS (SELECT vec_id, {half.format(1, 32)} AS lo, {half.format(33, 64)} AS hi FROM embeddings),
p AS (
  SELECT q.vec_id AS query_id, c.vec_id, (bit_count(xor(q.lo, c.lo)) + bit_count(xor(q.hi, c.hi)))::INT AS distance
  FROM c AS q, c WHERE q.vec_id % {every} = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id)::INT AS rank FROM p)
SELECT query_id, rank, vec_id, distance FROM r WHERE rank <= {k}"""
