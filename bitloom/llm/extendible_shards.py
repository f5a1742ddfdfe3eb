"""Byte-bounded shards by extendible hashing, in DataFrame operations only.

A row's key is an endless string of hash bits: 60 bits of the MD5 of its
doc_id, then 60 of the MD5 of its text, then 60 of a salt for rows that are
equal in both. The directory starts at one common depth, the least with which
an even split would fit. A bucket above the byte limit, and no other, splits on
its next bit, until every shard fits or holds a single row.

Sizes are added up per cell of ``STEP`` bits below the current depth, map-side
first, so a round shuffles a row per cell and task, not per document, and only
rows of buckets that are still too large enter the next round. A round's
directory has an entry for each prefix of the depth that its deepest bucket
needs, most often two or four for each shard. An entry takes some 400 bytes at
most; it is broadcast only after a count against ``BROADCAST_ROWS`` and joined
by shuffle otherwise.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bitloom.llm._scratch import Scratch

LIMIT = 64 * 1024 * 1024
#: Bits that a round can split on.
STEP = 8
LEVEL_BITS = 60
#: Salts: rows equal in id and text are told apart by 60 more bits.
LEVELS = 3
BROADCAST_ROWS = 100_000
SALT = "_bitloom_salt"


def _sixty(text: Column) -> Column:
    """The first 60 bits of an MD5 as a bigint."""
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long")


def _hash(level: int) -> Column:
    if level == 0:
        return _sixty(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))
    if level == 1:
        return _sixty(F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary"))
    return _sixty(F.col(SALT).cast("string").cast("binary"))


def _bits(hash_: Column, start: int, n: int) -> Column:
    """n bits of a 60-bit hash from bit ``start`` (0: the highest), as a string of 0 and 1."""
    value = F.shiftright(hash_, LEVEL_BITS - start - n).bitwiseAND(F.lit((1 << n) - 1).cast("long"))
    return F.lpad(F.bin(value), n, "0") if n else F.lit("")


def n_bytes(text: Column) -> Column:
    return F.coalesce(F.octet_length(text.cast("string")), F.lit(0)).cast("long")


def shard(docs: DataFrame, limit: int = LIMIT) -> DataFrame:
    """``docs`` with n_bytes (UTF-8 bytes of text), shard_id (the bits of its bucket), shard_bytes and oversize.

    Every shard holds at most ``limit`` bytes, but for a single document above
    the limit, which is a shard of its own with oversize true. shard_id is the
    shortest prefix of the row's key bits, of at least the starting depth, with
    which its bucket fits; with one shard it is the empty string. A null text
    has 0 bytes; a null doc_id hashes as an empty string. Rows repeated under
    one doc_id part by text, then by position in the input. Input columns with
    the names of the added ones are replaced; an empty table stays empty.
    """
    if limit < 1:
        raise ValueError("the limit must be positive")
    docs = docs.drop("n_bytes", "shard_id", "shard_bytes", "oversize")
    columns = docs.columns
    scratch = Scratch(docs.sparkSession, "shards")
    pending = scratch.keep(docs.select(_hash(0).alias(_key(0)), n_bytes(F.col("text")).alias("n_bytes")), "sizes")
    total = pending.agg(F.sum("n_bytes")).first()[0] or 0
    start = max(0, math.ceil(math.log2(max(1, total / limit))))

    rounds, path_bits, open_ = [], 0, None
    while True:
        step = start + STEP // 2 if not rounds else STEP
        step = min(step, LEVEL_BITS - path_bits % LEVEL_BITS)
        cells = pending.select(_path(path_bits).alias("path"), _bits(F.col(_key(path_bits // LEVEL_BITS)), path_bits % LEVEL_BITS, step).alias("cell"), "n_bytes")
        cells = scratch.keep(cells.groupBy("path", "cell").agg(F.sum("n_bytes").alias("bytes"), F.count("*").alias("rows")), f"cells-{path_bits}")
        # The bytes of every prefix of a cell; a cell's shard is its shortest prefix that fits.
        prefixes = cells.select("*", F.explode(F.sequence(F.lit(0 if rounds else start), F.lit(step))).alias("depth")).withColumn("prefix", F.expr("substring(cell, 1, depth)"))
        sums = prefixes.groupBy("path", "depth", "prefix").agg(F.sum("bytes").alias("shard_bytes"), F.sum("rows").alias("rows"))
        end = path_bits + step == LEVELS * LEVEL_BITS
        fits = sums.where((F.col("shard_bytes") <= limit) | (F.col("rows") == 1) | (F.lit(end) & (F.col("depth") == step)))
        fits = prefixes.select("path", "cell", "depth", "prefix").join(fits, ["path", "depth", "prefix"])
        chosen = fits.groupBy("path", "cell").agg(F.min(F.struct("depth", "prefix", "shard_bytes")).alias("s"))
        placed = scratch.keep(cells.select("path", "cell").join(chosen, ["path", "cell"], "left"), f"placed-{path_bits}")
        depth = placed.agg(F.max("s.depth")).first()[0] or 0
        entries = placed.where("s is not null").select(F.concat("path", F.substring("cell", 1, depth)).alias("entry"), F.concat("path", "s.prefix").alias("shard_id"), F.col("s.shard_bytes").alias("shard_bytes"))
        rounds.append((path_bits + depth, scratch.keep(entries.distinct(), f"entries-{path_bits}")))
        path_bits += step
        open_ = placed.where("s is null").select(F.concat("path", "cell").alias("_bitloom_path"))
        if open_.isEmpty():
            break
        if path_bits % LEVEL_BITS:
            pending = pending.withColumn("_bitloom_path", _path(path_bits)).join(_small(open_), "_bitloom_path", "left_semi").drop("_bitloom_path")
        else:  # the rows that are still together are hashed again
            level = path_bits // LEVEL_BITS
            open_ = scratch.keep(open_, f"open-{level}")
            rows = _open(docs, level, open_)
            if level == LEVELS - 1:
                # Equal rows are numbered once, in a table that every later step and any retry reads.
                rows = scratch.keep(rows.withColumn(SALT, F.monotonically_increasing_id()), "salted")
                docs = _open(docs, level, open_, "left_anti").withColumn(SALT, F.lit(None).cast("long")).unionByName(rows)
            pending = rows.select(*(_hash(i).alias(_key(i)) for i in range(level + 1)), n_bytes(F.col("text")).alias("n_bytes"))
        pending = scratch.keep(pending, f"pending-{path_bits}")

    levels = -(-path_bits // LEVEL_BITS)
    out = docs.select("*", *(_hash(i).alias(_key(i)) for i in range(levels)), n_bytes(F.col("text")).alias("n_bytes"))
    found_id, found_bytes = F.lit(None).cast("string"), F.lit(None).cast("long")
    for no, (depth, entries) in enumerate(rounds):
        entry, shard_id, shard_bytes = (f"_bitloom_{x}{no}" for x in "esb")
        out = out.withColumn(entry, _path(depth)).join(_small(entries.toDF(entry, shard_id, shard_bytes)), entry, "left")
        found_id, found_bytes = F.coalesce(found_id, shard_id), F.coalesce(found_bytes, shard_bytes)
    scratch.drop(*(t for t in scratch.tables if t.split("-")[0] not in ("salted", "open", "entries")))
    return out.select(*columns, "n_bytes", found_id.alias("shard_id"), found_bytes.alias("shard_bytes"), (found_bytes > limit).alias("oversize"))


def _open(docs: DataFrame, level: int, open_: DataFrame, how: str = "left_semi") -> DataFrame:
    """Rows whose first ``level`` hashes are open paths, or with left_anti all others."""
    hashes = [_hash(i).alias(_key(i)) for i in range(level)]
    return docs.select("*", *hashes).withColumn("_bitloom_path", _path(level * LEVEL_BITS)).join(_small(open_), "_bitloom_path", how).select(*docs.columns)


def _key(level: int) -> str:
    return f"_bitloom_h{level}"


def _path(n: int) -> Column:
    """The first n key bits, from the hash columns."""
    parts = [_bits(F.col(_key(i)), 0, min(LEVEL_BITS, n - i * LEVEL_BITS)) for i in range(-(-n // LEVEL_BITS))]
    return F.concat(*parts) if parts else F.lit("")


def _small(df: DataFrame) -> DataFrame:
    """Marked for broadcast if a count shows that it is small."""
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df


def oracle_sql(limit: int = LIMIT) -> str:
    """The same shards of distinct doc_ids, none of which needs more than 40 bits, in DuckDB SQL."""
    return f"""
WITH d AS (
  SELECT doc_id, coalesce(octet_length(encode(text)), 0)::BIGINT AS n_bytes,
         ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT AS h
  FROM documents),
s AS (SELECT greatest(0, ceil(log2(greatest(1, sum(n_bytes) / {limit}.0)))) AS g FROM d),
p AS (
  SELECT doc_id, n_bytes, depth, substr(lpad(h::BIT::VARCHAR, 64, '0'), 5, depth::INT) AS prefix
  FROM d, s, (SELECT unnest(range(0, 41)) AS depth) WHERE depth >= g),
b AS (SELECT depth, prefix, sum(n_bytes) AS shard_bytes, count(*) AS n FROM p GROUP BY 1, 2),
f AS (
  SELECT p.doc_id, p.n_bytes, arg_min(p.prefix, p.depth) AS shard_id, arg_min(b.shard_bytes, p.depth)::BIGINT AS shard_bytes
  FROM p JOIN b USING (depth, prefix) WHERE b.shard_bytes <= {limit} OR b.n = 1 GROUP BY 1, 2)
SELECT doc_id, n_bytes, shard_id, shard_bytes, shard_bytes > {limit} AS oversize FROM f"""
