"""Little-endian integer and byte-field reads on BINARY columns (D4 ``borsh_columns``).

All reads are plain Column expressions (JVM side, whole-stage codegen); an
out-of-range read yields NULL instead of raising.  Offsets are 0-based byte
offsets, given as int or Column.

Never ``reverse()`` a BINARY: Spark reverses it as UTF-8 characters.  Byte
order is flipped on the bytes read as ISO-8859-1, one character each.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x) -> Column:
    return x if isinstance(x, Column) else F.lit(x)


def has_bytes(data: Column, offset, width: int) -> Column:
    """True when ``width`` bytes are available at ``offset``."""
    return (_c(offset) >= 0) & (F.octet_length(data) - _c(offset) >= width)


def bytes_at(data: Column, offset, width) -> Column:
    """``width`` raw bytes at ``offset`` (NULL if out of range)."""
    w = width if isinstance(width, int) else None
    ok = has_bytes(data, offset, w) if w is not None else (
        (_c(offset) >= 0) & (F.octet_length(data) - _c(offset) >= _c(width)))
    return F.when(ok, F.substring(data, _c(offset) + 1, _c(width)))


def hex_at(data: Column, offset, width) -> Column:
    """Lower-case hex of ``width`` bytes at ``offset``."""
    return F.lower(F.hex(bytes_at(data, offset, width)))


def flip_bytes(b: Column) -> Column:
    """The bytes in reverse order."""
    return F.encode(F.reverse(F.decode(b, "ISO-8859-1")), "ISO-8859-1")


def flip_hex(h: Column) -> Column:
    """Reverse the byte order of a hex string of whole bytes (``'0102'`` → ``'0201'``, in upper case); NULL gives ``''``."""
    return F.coalesce(F.hex(flip_bytes(F.unhex(h))), F.lit(""))


def le_hex(data: Column, offset, width: int) -> Column:
    """Big-endian hex text of a little-endian unsigned field (for conv / comparison)."""
    return F.coalesce(F.hex(flip_bytes(bytes_at(data, offset, width))), F.lit(""))


def u_le(data: Column, offset, width: int) -> Column:
    """Unsigned little-endian integer of ``width`` bytes as DECIMAL(38,0).

    Widths 1–8 are exact via ``conv``; 9–16 combine two halves.  A value of
    39 digits is no DECIMAL(38,0) and gives NULL: ``u_le_text`` has every value
    of every width, and ``u_le_too_wide`` tells NULL for that reason apart.
    """
    if width <= 8:
        return F.conv(le_hex(data, offset, width), 16, 10).cast("decimal(38,0)")
    if width <= 16:
        lo = F.conv(le_hex(data, offset, 8), 16, 10).cast("decimal(38,0)")
        hi = F.conv(le_hex(data, _c(offset) + 8, width - 8), 16, 10).cast("decimal(38,0)")
        return F.try_add(F.try_multiply(hi, F.lit("18446744073709551616").cast("decimal(38,0)")), lo)
    raise ValueError("widths above 16 bytes: use u_le_text")


LIMB = 8                                  # most decimal digits a limb holds


def _limb_digits(words: int) -> int:
    """Digits of a limb, so that ``words`` products of a limb and 32 bits, and a carry, add up to less than 2^63."""
    return max(d for d in range(1, LIMB + 1) if (words + 1) << 32 < 2 ** 63 // 10 ** d)


def u_le_text(data: Column, offset, width: int) -> Column:
    """Unsigned little-endian integer of any width as exact decimal text (u128, u256).

    The number is the sum of its 32-bit words times powers of 2^32.  The
    powers' decimal limbs are constants, so each limb of the result is a sum
    of products that fits a BIGINT, and one carry runs through the limbs.
    """
    words = -(-width // 4)
    digits = _limb_digits(words)
    big = 10 ** digits
    limbs = -(-len(str(256 ** width - 1)) // digits)
    hex_ = F.lpad(le_hex(data, offset, width), 8 * words, "0")

    def word(h: Column, i: int) -> Column:
        return F.conv(F.substring(h, 8 * (words - 1 - i) + 1, 8), 16, 10).cast("bigint")

    def sums(w: Column) -> Column:
        at = [[(1 << 32 * i) // big ** j % big for i in range(words)] for j in range(limbs)]
        return F.array(*[sum((w[i] * F.lit(c).cast("bigint") for i, c in enumerate(cs) if c), F.lit(0).cast("bigint")) for cs in at])

    def push(state: Column, limb: Column) -> Column:
        t = limb + state["carry"]
        return F.struct(F.call_function("div", t, F.lit(big).cast("bigint")).alias("carry"),
                        F.concat(F.lpad((t % big).cast("string"), digits, "0"), state["text"]).alias("text"))

    # One-element arrays bind the hex text and its words once.
    bound = F.transform(F.transform(F.array(hex_), lambda h: F.array(*[word(h, i) for i in range(words)])), sums)
    first = F.struct(F.lit(0).cast("bigint").alias("carry"), F.lit("").alias("text"))
    text = F.aggregate(F.get(bound, 0), first, push, lambda state: F.regexp_replace(state["text"], "^0+(?=.)", ""))
    return F.when(has_bytes(data, offset, width), text)


def u_le_too_wide(data: Column, offset, width: int) -> Column:
    """Whether the field is there but has more than 38 digits."""
    least = f"{10 ** 38:0{2 * width}X}"                  # texts of equal length compare as their numbers
    there = has_bytes(data, offset, width)
    wide = le_hex(data, offset, width) >= least if len(least) <= 2 * width else F.lit(False)
    return F.when(there.isNotNull(), there & wide)


def u_le_hex(data: Column, offset, width: int) -> Column:
    """Unsigned little-endian integer of any width as big-endian hex text (u256)."""
    return F.lower(le_hex(data, offset, width))


def u_le_long(data: Column, offset, width: int) -> Column:
    """Unsigned little-endian integer of up to 7 bytes (or 8 below 2^63) as BIGINT."""
    return F.conv(le_hex(data, offset, width), 16, 10).try_cast("bigint")


def le_bytes_hex(value: int, width: int) -> str:
    """Python-side: little-endian hex text of a constant (for literal patterns)."""
    return value.to_bytes(width, "little").hex()


def le_hex_of(value: Column, width: int) -> Column:
    """Column-side: little-endian hex text of a non-negative integer column."""
    be = F.lpad(F.lower(F.hex(value.cast("bigint"))), 2 * width, "0")
    return flip_hex(be)


def opt_present(data: Column, offset) -> Column:
    """Borsh ``Option`` tag at ``offset``: TRUE (Some), FALSE (None), NULL (out of range)."""
    return F.when(has_bytes(data, offset, 1), hex_at(data, offset, 1) != "00")


def boolean_at(data: Column, offset) -> Column:
    """Borsh ``bool`` (any non-zero byte is true)."""
    return opt_present(data, offset)


def string_at(data: Column, offset) -> Column:
    """Borsh ``String``: u32 length + UTF-8 bytes (NULL if truncated)."""
    n = u_le_long(data, offset, 4)
    return F.when(n.isNotNull(), F.decode(bytes_at(data, _c(offset) + 4, n), "UTF-8"))


def vec_u8_hex(data: Column, offset) -> Column:
    """Borsh ``Vec<u8>``: u32 length + bytes, as lower hex (NULL if truncated)."""
    n = u_le_long(data, offset, 4)
    return F.when(n.isNotNull(), F.lower(F.hex(bytes_at(data, _c(offset) + 4, n))))
