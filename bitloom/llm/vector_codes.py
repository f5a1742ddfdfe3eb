"""Product codes of vectors, their codebooks fitted by a Lloyd iteration that is kept up by changes.

Vectors become integers and are cut into parts; each part position has a
codebook of integer entries. A round assigns every part to its nearest entry
and moves each entry to the floored mean of its parts. Between rounds two things
are kept: a table in the shared folder with each row's assignments of this round
and the one before, and the running integer sum and count of every entry. A
round's shuffle holds the contributions of changed parts alone, minus at the
entry that they leave and plus at the one that they join, added up in each task
first: at most parts times entries rows a task. Entries, sums and counts are
parts times entries times the part's width, whatever the number of rows; that
is all the driver sees.

Sums are integers, so the result doesn't depend on how rows are partitioned,
or on a task run again.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from bitloom.llm._scratch import Scratch

PARTS = 8
ENTRIES = 16
ROUNDS = 6
SCALE = 4096
#: Components are below this in magnitude, so that a vector's squared distance fits 64 bits and a row of the table 32 bits a component.
MAGNITUDE = 1 << 27
#: Rows whose distances to all entries are held at a time.
TILE = 1024
#: Labels up to this number are broadcast with their errors; more are joined, rows of a label dealt over SALTS.
FEW_LABELS = 10_000
SALTS = 32


def finite(vector: Column) -> Column:
    """Whether a vector is there and all its components are there and finite."""
    sound = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")))
    return F.coalesce(vector.isNotNull() & sound, F.lit(False))


def floored(vector: Column, scale: int, below: int) -> Column:
    """floor(scale * x) of the components, in double; a component of ``below`` or more in magnitude is an error."""
    whole = F.transform(vector, lambda x: F.floor(x.cast("double") * F.lit(float(scale))))
    fits = F.forall(vector, lambda x: F.abs(x.cast("double")) * F.lit(float(scale)) < F.lit(float(below)))
    return F.when(fits, whole.cast("array<int>")).otherwise(F.raise_error(F.lit(f"a component times {scale} is not below {below}")).cast("array<int>"))


def width(rows: DataFrame, vector: str) -> int:
    """Components of every vector, 0 for no rows; vectors of differing lengths are an error."""
    least, most = rows.agg(F.min(F.size(vector)), F.max(F.size(vector))).first()
    if least != most:
        raise ValueError(f"vectors have {least} to {most} components")
    return most or 0


def matrix(column: pa.Array, columns: int) -> np.ndarray:
    """Rows of an Arrow list column, all of ``columns`` values, as int64."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(column), columns)


def nearest(x: np.ndarray, books: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of the nearest entry, the lowest of ties, and its squared distance, for rows of parts."""
    codes, errors = np.empty(x.shape[:2], np.uint8), np.empty(x.shape[:2], np.int64)
    for at in range(0, len(x), TILE):
        apart = x[at : at + TILE, :, None, :] - books[None]
        distance = np.einsum("npke,npke->npk", apart, apart)
        codes[at : at + TILE] = np.argmin(distance, axis=2)
        errors[at : at + TILE] = distance.min(axis=2)
    return codes, errors


def _bytes(codes: np.ndarray) -> pa.Array:
    return pa.array([row.tobytes() for row in codes], pa.binary())


def _assign(books: np.ndarray):
    """Rows with the assignments of this round in ``pq_code``, those of the last one in ``pq_before`` and the squared distance."""
    parts, _, span = books.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes, errors = nearest(matrix(batch.column("pq_ints"), parts * span).reshape(-1, parts, span), books)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-3], batch.column("pq_code"), _bytes(codes), pa.array(errors.sum(axis=1))], names=batch.schema.names)

    return run


def _changes(parts: int, entries: int, span: int):
    """For each task: how the count and the sum of each entry change, by the parts whose assignment did."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        change = np.zeros((parts, entries, 1 + span), np.int64)
        for batch in batches:
            x = matrix(batch.column("pq_ints"), parts * span).reshape(-1, parts, span)
            now = np.frombuffer(b"".join(batch.column("pq_code").to_pylist()), np.uint8).reshape(-1, parts)
            had = np.array([b is not None for b in batch.column("pq_before").to_pylist()], bool)
            before = now.copy()
            if had.any():
                before[had] = np.frombuffer(b"".join(b for b in batch.column("pq_before").to_pylist() if b is not None), np.uint8).reshape(-1, parts)
            for sign, codes, moved in ((1, now, (now != before) | ~had[:, None]), (-1, before, (now != before) & had[:, None])):
                row, part = np.nonzero(moved)
                entry = codes[row, part]
                np.add.at(change, (part, entry, 0), sign)
                np.add.at(change[:, :, 1:], (part, entry), sign * x[row, part])
        part, entry = np.nonzero(change.any(axis=2))
        yield pa.RecordBatch.from_arrays([pa.array(part.astype(np.int32)), pa.array(entry.astype(np.int32)), *(pa.array(change[part, entry, i]) for i in range(1 + span))], names=["part", "entry", *(f"s{i}" for i in range(1 + span))])

    return run


def fit(kept: DataFrame, scratch: Scratch, parts: int, entries: int, rounds: int, columns: int) -> tuple[np.ndarray, DataFrame]:
    """(codebooks, rows assigned to them) of a table of ``kept`` rows."""
    span = columns // parts
    first = kept.orderBy(F.col("pq_id").asc_nulls_last(), "pq_ints").select("pq_ints").limit(entries).collect()
    books = np.array([r[0] for r in first], np.int64).reshape(len(first), parts, span).transpose(1, 0, 2).copy()
    totals = np.zeros((*books.shape[:2], 1 + span), np.int64)
    sums = [F.sum(f"s{i}") for i in range(1 + span)]
    kind = T.StructType.fromDDL("part int, entry int, " + ", ".join(f"s{i} bigint" for i in range(1 + span)))
    state = kept
    for no in range(rounds + 1):
        last, state = state, scratch.keep(state.mapInArrow(_assign(books), state.schema), f"round-{no}")
        if last is not kept:
            scratch.drop(f"round-{no - 1}")
        if no == rounds:
            break
        changed = state.select("pq_ints", "pq_before", "pq_code").mapInArrow(_changes(parts, books.shape[1], span), kind).groupBy("part", "entry").agg(*sums).collect()
        if not changed:  # so entries, and with them all further rounds, stay as they are
            break
        for part, entry, *change in changed:
            totals[part, entry] += np.array(change, np.int64)
        used = totals[:, :, 0] > 0
        books[used] = totals[used][:, 1:] // totals[used][:, :1]
    return books, state


def with_label_errors(coded: DataFrame, scratch: Scratch) -> DataFrame:
    """The rows with ``pq_label_error``: the errors of all rows of the same label added up, nulls being one label."""
    totals = scratch.keep(coded.groupBy("pq_label").agg(F.sum("pq_error").alias("pq_label_error")), "label-errors").withColumnRenamed("pq_label", "pq_of")
    if totals.count() <= FEW_LABELS:
        return coded.join(F.broadcast(totals), F.col("pq_label").eqNullSafe(F.col("pq_of")), "left").drop("pq_of")
    totals = totals.withColumn("pq_salt_of", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salted = coded.withColumn("pq_salt", F.pmod(F.xxhash64("pq_id", "pq_ints"), F.lit(SALTS)).cast("int"))
    return salted.join(totals, F.col("pq_label").eqNullSafe(F.col("pq_of")) & (F.col("pq_salt") == F.col("pq_salt_of")), "left").drop("pq_of", "pq_salt", "pq_salt_of")


def compress(
    vectors: DataFrame, id_column: str = "vec_id", vector_column: str = "embedding", label_column: str = "label", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE
) -> tuple[DataFrame, np.ndarray]:
    """(coded rows, codebooks): ``id_column``, code (binary, a byte for each part), error, label_error of every usable row; integer codebooks by (part, entry, position).

    * Rows whose vector is null or has a null or non-finite component are left out, before and after.
    * Codebooks start as the parts of the ``entries`` rows with the smallest id, null ids last, equal ids by their integers; fewer rows make fewer entries.
    * Ties between entries go to the lower index; an entry without parts stays as it is. Repeated rows count as often as they stand.
    * Vectors of differing lengths, of a length that ``parts`` doesn't divide, or with a component of 2^27 / ``scale`` or more raise.
    * An empty table, or one without usable rows, gives no rows and empty codebooks. Other columns are not looked at.
    """
    if not 0 < entries <= 256:
        raise ValueError("a code is one byte")
    vector = F.col(vector_column)
    usable = vectors.where(finite(vector)).select(
        F.col(id_column).alias("pq_id"), F.col(label_column).alias("pq_label"), floored(vector, scale, MAGNITUDE).alias("pq_ints"), F.lit(None).cast("binary").alias("pq_before"), F.lit(None).cast("binary").alias("pq_code"), F.lit(0).cast("long").alias("pq_error")
    )
    scratch = Scratch(vectors.sparkSession, "vector-codes")
    kept = scratch.keep(usable, "kept")
    columns = width(kept, "pq_ints")
    if columns % parts:
        raise ValueError(f"{columns} components can't be cut into {parts} equal parts")
    if not columns:
        coded, books = kept, np.zeros((parts, 0, 0), np.int64)
    else:
        books, coded = fit(kept, scratch, parts, entries, rounds, columns)
        scratch.drop("kept")
    told = with_label_errors(coded, scratch)
    return told.select(F.col("pq_id").alias(id_column), F.col("pq_code").alias("code"), F.col("pq_error").alias("error"), F.col("pq_label_error").alias("label_error")), books


def decoded(codes: np.ndarray, books: np.ndarray, scale: int = SCALE) -> np.ndarray:
    """The vectors that rows of codes stand for."""
    return np.concatenate([books[p][codes[:, p]] for p in range(len(books))], axis=1) / scale


def digests(coded: DataFrame, books: np.ndarray) -> DataFrame:
    """The contract's columns from the result of ``compress``."""
    digest = hashlib.sha256(",".join(map(str, books.reshape(-1).tolist())).encode()).hexdigest()
    return coded.select("vec_id", F.lower(F.hex("code")).alias("code"), "error", "label_error", F.lit(digest).alias("codebooks_sha256"))


def oracle_sql(parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE, span: int = 8) -> str:
    """DuckDB SQL of op11, every round a full pass."""
    cells = range(1, span + 1)
    apart = " + ".join(f"(a.x[{i}] - b.x[{i}]) * (a.x[{i}] - b.x[{i}])" for i in cells)
    means = ", ".join(f"(sum(x[{i}]) // count(*) - CASE WHEN sum(x[{i}]) % count(*) < 0 THEN 1 ELSE 0 END)::BIGINT" for i in cells)
    steps = []
    for no in range(rounds + 1):
        steps.append(
            f"""near{no} AS MATERIALIZED (
  SELECT rid, p, x, arg_min(k, d * 256 + k) AS k, min(d) AS d FROM (SELECT a.rid, a.p, a.x, b.k, {apart} AS d FROM parts a JOIN book{no} b USING (p)) GROUP BY rid, p, x)"""
        )
        if no < rounds:
            steps.append(
                f"""book{no + 1} AS MATERIALIZED (
  SELECT b.p, b.k, coalesce(m.x, b.x) AS x FROM book{no} b LEFT JOIN (SELECT p, k, [{means}] AS x FROM near{no} GROUP BY p, k) m USING (p, k))"""
            )
    return f"""
WITH kept AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY vec_id) AS rid, vec_id, label, list_transform(embedding, lambda e: floor({scale} * e::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda e: e IS NULL OR NOT isfinite(e))) = 0),
parts AS MATERIALIZED (SELECT rid, p, v[{span} * p + 1 : {span} * p + {span}] AS x FROM kept, range({parts}) t(p)),
book0 AS MATERIALIZED (SELECT p, rid - 1 AS k, x FROM parts WHERE rid <= {entries}),
{", ".join(steps)},
coded AS (SELECT rid, string_agg(printf('%02x', k::INT), '' ORDER BY p) AS code, sum(d)::BIGINT AS error FROM near{rounds} GROUP BY rid),
books AS (SELECT coalesce(sha256(string_agg(array_to_string(x, ','), ',' ORDER BY p, k)), sha256('')) AS h FROM book{rounds})
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, (SELECT h FROM books) AS codebooks_sha256 FROM kept JOIN coded USING (rid)"""
