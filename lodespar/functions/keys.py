"""Keys, bounds and the workloads' scalar functions, as column expressions."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F

# The syllables of last names and the range constants of the order-entry workload.
SYLLABLES = ("BAR", "OUGHT", "ABLE", "PRI", "PRES", "ESE", "ANTI", "CALLY", "ATION", "EING")
NURAND_C = {255: 150, 1023: 987, 8191: 5987}
WRAP = Decimal(2**64)


def half_open(key: Column, low=None, high=None) -> Column:
    """low <= key < high; None is unbounded."""
    fits = F.lit(True)
    if low is not None:
        fits = fits & (key >= low)
    return fits & (key < high) if high is not None else fits


def big_endian(value: Column) -> Column:
    """A non-negative whole number as 8 bytes whose order is the number's."""
    return F.unhex(F.lpad(F.hex(value.cast("long")), 16, "0"))


def packed(*parts: tuple[Column, int]) -> Column:
    """Non-negative parts, each with its width in bits, most significant first, in one long; each must fit its width."""
    out = F.lit(0).cast("long")
    for value, bits in parts:
        out = F.shiftleft(out, bits).bitwiseOR(value.cast("long"))
    return out


def nurand(a: int, low: int, high: int, first: Column, second: Column, c: int | None = None) -> Column:
    """((first | second) + C) % (high - low + 1) + low, where first is drawn from 0..a and second from low..high."""
    c = NURAND_C[a] if c is None else c
    return (first.bitwiseOR(second) + c) % (high - low + 1) + low


def last_name(number: Column) -> Column:
    """Three syllables for the digits of 0..999."""
    table = F.array(*map(F.lit, SYLLABLES))
    digit = lambda d: F.element_at(table, (F.floor(number / d) % 10 + 1).cast("int"))
    return F.concat(digit(100), digit(10), digit(1))


def stock_after(quantity: Column, ordered: Column) -> Column:
    """The order-entry stock rule: strictly more than ten above the order, else 91 are added."""
    return F.when(quantity > ordered + 10, quantity - ordered).otherwise(quantity - ordered + 91)


def brand_generic(first: Column, second: Column, mark: str = "ORIGINAL") -> Column:
    return F.when(F.contains(first, F.lit(mark)) & F.contains(second, F.lit(mark)), "B").otherwise("G")


def bad_credit(note: Column, data: Column, size: int = 500) -> Column:
    return F.left(F.concat(note, data), F.lit(size))


def wrapping_sum(value: Column) -> Column:
    """An order-insensitive checksum: the sum of whole numbers modulo 2**64, as decimal(20,0)."""
    total = F.sum(value.cast("decimal(38,0)"))
    return F.pmod(total, F.lit(WRAP)).cast("decimal(20,0)")


def money(value: Column) -> Column:
    """A sum of amounts that doesn't depend on the rows' order."""
    return F.sum(value.cast("decimal(18,2)")).cast("double")
