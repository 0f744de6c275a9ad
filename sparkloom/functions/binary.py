"""Numbers, bits and checksums of binary columns, and a few functions on arrays, as built-in expressions."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, functions as F


def uint_be(b: Column) -> Column:
    """Big-endian unsigned number of up to 7 bytes."""
    return F.conv(F.hex(b), 16, 10).cast("bigint")


def uint_le(b: Column) -> Column:
    """Little-endian unsigned number of up to 7 bytes."""
    return uint_be(reverse_bytes(b))


def reverse_bytes(b: Column) -> Column:
    h = F.hex(b)
    return F.unhex(F.array_join(F.transform(F.reverse(F.sequence(F.lit(1), F.length(h), F.lit(2))), lambda i: F.substr(h, i, F.lit(2))), ""))


def int_be(b: Column) -> Column:
    """Big-endian two's complement."""
    n = F.octet_length(b)
    u = uint_be(b)
    return F.when(u >= F.pow(F.lit(2), 8 * n - 1).cast("bigint"), u - F.pow(F.lit(2), 8 * n).cast("bigint")).otherwise(u)


def pack_be(n: Column, size: int) -> Column:
    return F.unhex(F.lpad(F.hex(n.cast("bigint")), 2 * size, "0"))


def pack_le(n: Column, size: int) -> Column:
    return reverse_bytes(pack_be(n, size))


def byte_array(b: Column) -> Column:
    """The bytes as numbers."""
    h = F.hex(b)
    return F.when(F.octet_length(b) == 0, F.array().cast("array<bigint>")).otherwise(F.transform(F.sequence(F.lit(1), F.length(h), F.lit(2)), lambda i: F.conv(F.substr(h, i, F.lit(2)), 16, 10).cast("bigint")))


def bits(b: Column) -> Column:
    """All bits, the least significant of each byte first."""
    return F.flatten(F.transform(byte_array(b), lambda x: F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: F.call_function("shiftright", x, i).bitwiseAND(F.lit(1)).cast("int"))))


def checksum_part(b: Column, offset: Column) -> Column:
    """What bytes that stand at an offset add to the checksum of the whole: parts of a file can be summed apart, in any order and cut
    anywhere, and :func:`checksum_total` of the parts is the file's checksum."""
    scaled = F.transform(byte_array(b), lambda x, i: x * F.call_function("shiftleft", F.lit(1).cast("bigint"), (8 * (3 - (F.pmod(offset, F.lit(4)) + i) % 4)).cast("int")))
    return F.aggregate(scaled, F.lit(0).cast("bigint"), lambda a, x: (a + x) % F.lit(2**32))


def checksum_total(parts: Column) -> Column:
    """An aggregate: the checksum of parts, or the checksum of checksums."""
    return F.coalesce(F.sum(parts), F.lit(0)) % F.lit(2**32)


def checksum32(b: Column) -> Column:
    """Sum of big-endian 32-bit words modulo 2**32; the last word is filled up with zeros."""
    return checksum_part(b, F.lit(0))


def round_up(n: Column, multiple: int) -> Column:
    return F.ceil(n / multiple) * multiple


def power_below(n: Column) -> tuple[Column, Column, Column]:
    """The largest power of two not above n, its exponent, and what n has beyond it."""
    e = (F.length(F.bin(n.cast("bigint"))) - 1).cast("int")
    p = F.call_function("shiftleft", F.lit(1).cast("bigint"), e)
    return p, e, n - p


def antiderivative(coefficients: Column) -> Column:
    """Coefficients (from the constant on) of a polynomial's antiderivative without its constant."""
    return F.concat(F.array(F.lit(0.0)), F.transform(coefficients, lambda x, i: x / (i + 1)))


def delta_decode(values: Column) -> Column:
    """Running sums of an array of whole numbers; from a NULL on the sums are NULL.  Built-in functions would copy the sums so far
    for every element, so this is one pass over the flat values of each Arrow batch."""

    @F.arrow_udf("array<bigint>")
    def run(a: pa.Array) -> pa.Array:
        n = pc.fill_null(pc.list_value_length(a), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        edge = np.concatenate([[0], np.cumsum(n)])
        flat = a.flatten()
        gone = np.cumsum(flat.is_null().to_numpy(zero_copy_only=False))
        sums = np.concatenate([[0], np.cumsum(pc.fill_null(flat, 0).to_numpy(zero_copy_only=False).astype(np.int64))])
        before = np.concatenate([[0], gone])[edge[:-1]]
        out = pa.array(sums[1:] - np.repeat(sums[edge[:-1]], n), pa.int64(), mask=gone > np.repeat(before, n))
        return pa.ListArray.from_arrays(pa.array(edge.astype(np.int32)), out, mask=a.is_null())

    return run(values)


def run_length_decode(pairs: Column) -> Column:
    """An array of (value, count) written out."""
    return F.flatten(F.transform(pairs, lambda p: F.array_repeat(p["value"], p["count"].cast("int"))))


def delta_mod(k: Column, delta: Column) -> Column:
    """(k + delta) modulo 65536."""
    return F.pmod(k + delta, F.lit(65536))
