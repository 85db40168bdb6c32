"""Rows of 2, 4 or 8-bit codes packed into BINARY with a half-precision scale and bias.

A packed row is the codes, the first in the lowest bits of the first byte, then the
scale and the bias as IEEE half-precision numbers, low byte first. Everything is
column expressions, with 32-bit rounding where the layout's definition has it; a task
that holds packed rows as an Arrow array reads them with NumPy.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

BITS = (2, 4, 8)
HALF_MAX = 0x7C00


def _power(e: Column) -> Column:
    return F.pow(F.lit(2.0), e.cast("double"))


def half_bits(x: Column) -> Column:
    """The half-precision number nearest to ``x`` (ties to even) as its 16 bits; too
    large numbers are infinite. NaN is 0x7E00."""
    x = x.cast("double")
    a = F.abs(x)
    near = F.floor(F.log2(F.when(a > 0, F.least(a, F.lit(1e30))).otherwise(1.0)))
    e = near + F.when(a >= _power(near + 1), 1).when(a < _power(near), -1).otherwise(0)  # a logarithm may miss by one
    e = F.greatest(e, F.lit(-14))
    bits = F.least((e + 15) * 1024 + F.rint(a / _power(e - 10)) - 1024, F.lit(HALF_MAX))
    return F.when(F.isnan(x), 0x7E00).otherwise(F.when(a == 0, 0).otherwise(bits) + F.when(x < 0, 0x8000).otherwise(0)).cast("int")


def half_value(bits: Column) -> Column:
    """The number that 16 bits are."""
    e, m = F.shiftright(bits, 10).bitwiseAND(F.lit(31)), bits.bitwiseAND(F.lit(1023))
    size = F.when(e == 0, m * _power(F.lit(-24))).when(e == 31, F.when(m == 0, F.lit(float("inf"))).otherwise(F.lit(float("nan")))).otherwise((m + 1024) * _power(e - 25))
    return F.when(bits >= 0x8000, -size).otherwise(size)


def _hex(n: Column, digits: int) -> Column:
    return F.lpad(F.hex(n.cast("long")), digits, "0")


def _half_hex(bits: Column) -> Column:
    h = _hex(bits, 4)
    return F.concat(F.substring(h, 3, 2), F.substring(h, 1, 2))


def scale_and_bias(vec: Column, bits: int) -> Column:
    """struct(scale, bias) as bits of half-precision numbers: the bias is the least
    element, the scale the range above it over the largest code. A row of equal
    elements, and one whose scale is 0 or has no inverse, has scale 1."""
    bias = half_bits(F.array_min(vec))
    return F.transform(F.array(bias), lambda b: F.struct(_scale(vec, b, bits).alias("scale"), b.alias("bias")))[0]


def _scale(vec: Column, bias: Column, bits: int) -> Column:
    width = F.array_max(vec).cast("float") - half_value(bias).cast("float")
    scale = half_bits(F.when(width == 0, F.lit(1.0)).otherwise((width.cast("double") / float(2**bits - 1)).cast("float")))
    one = half_bits(F.lit(1.0))
    # half numbers under 2^-128 do not exist, so that every scale but 0 has an inverse
    return F.when(scale == 0, one).otherwise(scale)


def packed(vec: Column, bits: int) -> Column:
    """An array of numbers as a packed row; a null or empty array is null."""
    if bits not in BITS:
        raise ValueError(f"{bits} bits cannot be packed")
    per, most = 8 // bits, 2**bits - 1

    def row(s: Column) -> Column:
        bias, scale = half_value(s["bias"]).cast("float"), half_value(s["scale"])
        inverse = (F.lit(1.0) / scale).cast("float")
        codes = F.transform(vec, lambda x: F.least(F.greatest(F.rint(((x.cast("float") - bias) * inverse).cast("double")), F.lit(0.0)), F.lit(float(most))).cast("int"))
        body = F.transform(F.array(codes), lambda c: F.array_join(F.transform(F.sequence(F.lit(0), F.ceil(F.size(c) / per).cast("int") - 1),
                           lambda i: _hex(sum((F.coalesce(F.get(c, i * per + j), F.lit(0)) * (1 << (j * bits)) for j in range(per)), F.lit(0)), 2)), ""))[0]
        return F.unhex(F.concat(body, _half_hex(s["scale"]), _half_hex(s["bias"])))

    return F.when(F.size(vec) > 0, F.transform(F.array(scale_and_bias(vec, bits)), row)[0])


def words(row: Column, dim: int, bits: int) -> Column:
    """A packed row of ``dim`` codes as numbers of four bytes, by which it is read: the
    codes, then scale and bias as the last. All places are known, so nothing is looked for."""
    body = (dim * bits + 7) // 8
    return F.array(*[F.conv(F.hex(F.substring(row, at + 1, 4)), 16, 10).cast("long") for at in (*range(0, body, 4), body)])


def codes(read: Column, dim: int, bits: int) -> Column:
    """The ``dim`` codes of a packed row, from its :func:`words`, as integers."""
    def code(i: int) -> Column:
        byte, at = divmod(i * bits, 8)
        return F.shiftright(F.get(read, F.lit(byte // 4)), (3 - byte % 4) * 8 + at).bitwiseAND(F.lit(2**bits - 1))

    return F.array(*[code(i) for i in range(dim)])


def row_scale(read: Column) -> Column:
    last = F.element_at(read, -1)
    return half_value((F.shiftright(last, 24) + F.shiftright(last, 16).bitwiseAND(F.lit(255)) * 256).cast("int"))


def row_bias(read: Column) -> Column:
    last = F.element_at(read, -1)
    return half_value((F.shiftright(last, 8).bitwiseAND(F.lit(255)) + last.bitwiseAND(F.lit(255)) * 256).cast("int"))


def unpacked(row: Column, dim: int, bits: int) -> Column:
    """The numbers of a packed row."""
    read = F.transform(F.array(words(row, dim, bits)), lambda w: F.struct(codes(w, dim, bits).alias("c"), row_scale(w).alias("s"), row_bias(w).alias("b")))
    return F.when(row.isNotNull(), F.transform(read, lambda p: F.transform(p["c"], lambda c: c * p["s"] + p["b"]))[0])


def decoded(rows: pa.Array, dim: int, bits: int) -> np.ndarray:
    """:func:`unpacked` over an Arrow array of packed rows, none of which is null."""
    body, at = (dim * bits + 7) // 8, np.arange(dim) * bits
    raw = np.frombuffer(b"".join(rows.to_pylist()), dtype=np.uint8).reshape(len(rows), body + 4)
    scale, bias = np.ascontiguousarray(raw[:, body:]).view("<f2").astype(np.float64).T
    return (raw[:, at // 8] >> (at % 8).astype(np.uint8) & np.uint8(2**bits - 1)) * scale[:, None] + bias[:, None]
