"""Bit-level reads and writes on strings of 0 and 1, as Catalyst expressions.

Bytes become such a string once for each header; a header is short, and slice
data is never turned into bits. Positions count from 0.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from bitloom.functions.let import let


def to_bits(data: Column) -> Column:
    """Bytes as a string of 0 and 1, most significant bit first."""
    out = F.translate(F.hex(data), "0123456789ABCDEF", "abcdefghijklmnop")
    for value in range(16):  # a letter for each hexadecimal digit, so that a replacement is not replaced again
        out = F.replace(out, F.lit(chr(ord("a") + value)), F.lit(f"{value:04b}"))
    return out


def from_bits(bits: Column) -> Column:
    """A string of 0 and 1 as bytes; a last partial byte is filled with zeros."""

    def whole(v: Column) -> Column:
        n = F.ceil(F.length(v["bits"]) / 8).cast("int")
        return let(lambda w: F.when(n > 0, coded(w["padded"], n)).otherwise(F.unhex(F.lit(""))), padded=F.rpad(v["bits"], n * 8, F.lit("0")))

    def coded(padded: Column, n: Column) -> Column:
        return F.unhex(F.array_join(F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.lpad(F.conv(F.substring(padded, i * 8 + 1, F.lit(8)), 2, 16), 2, "0")), ""))

    return let(whole, bits=bits)


def packed(bits: Column) -> Column:
    """``from_bits`` over whole Arrow batches, for long strings: a place in a string is found from its start, a byte here in one step."""

    @F.arrow_udf("binary")
    def run(rows: pa.Array) -> pa.Array:
        texts = (np.frombuffer(r.as_buffer(), np.uint8) if r.is_valid else None for r in rows)
        return pa.array([None if t is None else np.packbits(t == ord("1")).tobytes() for t in texts], pa.binary())

    return run(bits)


def u(bits: Column, pos: Column, n: Column) -> Column:
    """Unsigned number of n bits (at most 63) at pos; 0 for n = 0, null beyond the end."""
    piece = F.substring(bits, pos + 1, n)
    return F.when(n == 0, F.lit(0).cast("long")).when(F.length(piece) == n, F.conv(piece, 2, 10).cast("long"))


def leading_zeros(bits: Column, pos: Column) -> Column:
    """Zeros from pos to the next one bit; null if there is none."""
    at = F.position(F.lit("1"), bits, pos + 1)
    return F.when(at > 0, at - 1 - pos)


def ue_at(bits: Column, pos: Column) -> Column:
    """struct<value, size> of the unsigned Exp-Golomb code at pos; null if it is cut off."""
    return let(lambda v: F.struct((u(bits, pos + v["z"], v["z"] + 1) - 1).alias("value"), (2 * v["z"] + 1).alias("size")), z=leading_zeros(bits, pos))


def signed(k: Column) -> Column:
    """Signed value of an unsigned Exp-Golomb code number: 1, -1, 2, -2, ..."""
    return F.when(k % 2 == 1, F.shiftright(k, 1) + 1).otherwise(-F.shiftright(k, 1))


def unsigned(v: Column) -> Column:
    """Code number of a signed value."""
    return F.when(v > 0, 2 * v - 1).otherwise(-2 * v)


def put_u(value: Column, n: int) -> Column:
    return F.lpad(F.bin(value), n, "0") if n else F.lit("")


def put_ue(value: Column) -> Column:
    return let(lambda v: F.concat(F.repeat(F.lit("0"), F.length(v["b"]) - 1), v["b"]), b=F.bin(value + 1))


def put_se(value: Column) -> Column:
    return put_ue(unsigned(value))


def put_te(value: Column, largest: Column) -> Column:
    return F.when(largest > 1, put_ue(value)).otherwise(F.when(value == 0, "1").otherwise("0"))


def te_at(bits: Column, pos: Column, largest: Column) -> Column:
    """Truncated Exp-Golomb: one inverted bit if the largest value is 1."""
    return F.when(largest > 1, ue_at(bits, pos)["value"]).otherwise(1 - u(bits, pos, F.lit(1)))


def trailing(bits: Column) -> Column:
    """The string closed by a one bit and zeros to a whole byte."""
    return let(lambda v: F.rpad(v["b"], (F.ceil(F.length(v["b"]) / 8) * 8).cast("int"), F.lit("0")), b=F.concat(bits, F.lit("1")))


def is_aligned(pos: Column) -> Column:
    """Whether a position is at the start of a byte."""
    return pos % 8 == 0


def aligned(pos: Column) -> Column:
    """The position itself if it is at the start of a byte, else the next that is."""
    return ((pos + 7) / 8).cast("int") * 8


def peek_16(bits: Column, pos: Column) -> Column:
    """The 16 bits at pos as a number, zeros standing in for those beyond the end."""
    return u(F.rpad(F.substring(bits, pos + 1, F.lit(16)), 16, F.lit("0")), F.lit(0), F.lit(16))


def hex_to_bytes(text: Column) -> Column:
    """Hexadecimal digits, spaces apart, as bytes; null if their number is odd or there is anything else."""
    digits = F.regexp_replace(text, r"\s+", "")
    return F.when(F.length(digits) % 2 == 0, F.unhex(digits))


def last_one(bits: Column) -> Column:
    """Position of the last one bit, the stop bit of a payload; -1 if there is none."""
    return F.length(F.rtrim(bits, F.lit("0"))) - 1
