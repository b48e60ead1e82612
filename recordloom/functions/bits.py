"""Integer and bit functions as Column expressions: they stay inside whole-stage code generation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def zigzag(v: Column) -> Column:
    """Signed 64-bit to non-negative: 0, -1, 1, -2 become 0, 1, 2, 3. The two's complement pattern is the unsigned one."""
    return F.shiftleft(v, 1).bitwiseXOR(F.shiftright(v, 63))


def unzigzag(u: Column) -> Column:
    return F.shiftrightunsigned(u, 1).bitwiseXOR(-u.bitwiseAND(F.lit(1).cast("long")))


def bit_length(u: Column) -> Column:
    """Bits of a 64-bit pattern, 1 for zero."""
    return F.length(F.bin(u))


def varint_length(u: Column) -> Column:
    """Bytes of the pattern in 7-bit groups, 1 to 10."""
    return F.ceil(bit_length(u) / 7).cast("int")


def varint_hex(u: Column) -> Column:
    """7-bit groups, least first, with a continuation bit in all but the last, as hex; a negative number is null."""
    last = varint_length(u) - 1
    parts = F.transform(F.sequence(F.lit(0), last), lambda i: F.lpad(F.hex(F.call_function("shiftrightunsigned", u, i * 7).bitwiseAND(F.lit(127).cast("long")) + F.when(i < last, 128).otherwise(0)), 2, "0"))
    return F.when(u >= 0, F.array_join(parts, ""))


def varint_from_hex(h: Column) -> Column:
    """The number that varint_hex() wrote."""
    n = (F.length(h) / 2).cast("int")
    byte = lambda i: F.conv(F.substring(h, i * 2 + 1, F.lit(2)), 16, 10).cast("long")
    return F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0).cast("long"), lambda a, i: a + F.call_function("shiftleft", byte(i).bitwiseAND(F.lit(127).cast("long")), i * 7))


def fixed(v: Column, scale: int, bits: int) -> Column:
    """rint(v * scale) held within a signed integer of so many bits; half-even, as everywhere in the format."""
    top = 1 << (bits - 1)
    return F.greatest(F.lit(-float(top)), F.least(F.lit(float(top - 1)), F.rint(v * scale))).cast("long")


def little_endian_hex(v: Column, size: int) -> Column:
    """The low bytes of an integer, least first, as hex."""
    h = F.right(F.lpad(F.hex(v), 16, "0"), F.lit(2 * size))
    return F.concat(*(F.substring(h, 2 * i - 1, 2) for i in range(size, 0, -1)))


def from_little_endian_hex(h: Column, size: int) -> Column:
    """The signed integer that little_endian_hex() wrote."""
    u = F.conv(F.concat(*(F.substring(h, 2 * i - 1, 2) for i in range(size, 0, -1))), 16, 10).cast("decimal(20,0)")
    half = F.lit(1 << (8 * size - 1)).cast("decimal(20,0)")
    return F.when(u >= half, u - F.lit(1 << (8 * size)).cast("decimal(21,0)")).otherwise(u).cast("long")


def is_small_delta(d: Column) -> Column:
    return d.between(-8, 7)


def small_delta_token(d: Column) -> Column:
    """One byte 0xC3..0xD2 for -8..7, else null."""
    return F.when(is_small_delta(d), d + 8 + 0xC3)


def small_delta_of(token: Column) -> Column:
    return F.when(token.between(0xC3, 0xD2), token - 0xC3 - 8)


def dictionary_slot(token: Column) -> Column:
    """Slot of a dictionary reference: its low six bits."""
    return token.bitwiseAND(F.lit(0x3F))


def token_kind(token: Column) -> Column:
    """What a first byte refers to."""
    return F.when(token < 0x40, "field").when(token < 0x80, "string").when(token < 0xC0, "mac").when(token.between(0xC3, 0xD2), "small_delta").otherwise("other")


def delta_kind(d: Column) -> Column:
    """Token that a delta takes; the first value of a sequence has none."""
    return F.when(d.isNull(), "first").when(d == 0, "zero").when(d == 1, "plus_one").when(d == -1, "minus_one").when(is_small_delta(d), "small").when(d.between(-64, 63), "medium").otherwise("large")


def delta_bytes(d: Column) -> Column:
    """Bytes of that token and its payload; a first value is written like a large one."""
    kind = delta_kind(d)
    return F.when(kind.isin("zero", "plus_one", "minus_one", "small"), 1).when(kind == "medium", 2).otherwise(1 + varint_length(zigzag(d)))


def rice_parameter(top: Column) -> Column:
    """k for the size of the largest delta: its bit length less 2, within 0 to 7; 2 if all are zero."""
    return F.when(top == 0, 2).otherwise(F.greatest(F.lit(0), F.least(F.lit(7), bit_length(top) - 2)))


def rice_bits(u: Column, k: Column) -> Column:
    """Bits of one Rice code: the quotient in unary, a one, and k low bits."""
    return F.call_function("shiftrightunsigned", u, k) + 1 + k


def rice_code(u: Column, k: Column) -> Column:
    """The code as text of zeros and ones."""
    q = F.call_function("shiftrightunsigned", u, k)
    low = F.lpad(F.bin(u - F.call_function("shiftleft", q, k)), k, "0")
    return F.concat(F.repeat(F.lit("0"), q.cast("int")), F.lit("1"), F.when(k > 0, low).otherwise(""))


def byte_width(values: Column) -> Column:
    """Bits that each byte of an array needs at least: 1 if all are at most 1, 2 if all are at most 3, else 8."""
    top = F.array_max(values)
    return F.when(top <= 1, 1).when(top <= 3, 2).otherwise(8)


def packed_hex(values: Column, width: Column) -> Column:
    """An array of bytes with so many bits for each, the lowest first, as hex; no element gives the empty text."""
    per = F.floor(F.lit(8) / width).cast("int")
    count = F.ceil(F.size(values) / per).cast("int")

    def byte(i: Column) -> Column:
        parts = F.transform(F.slice(values, i * per + 1, per), lambda v, j: v.cast("int") * F.pow(F.lit(2), j * width).cast("int"))
        return F.lpad(F.hex(F.aggregate(parts, F.lit(0), lambda a, x: a + x)), 2, "0")

    return F.when(F.size(values) == 0, "").otherwise(F.array_join(F.transform(F.sequence(F.lit(0), count - 1), byte), ""))
