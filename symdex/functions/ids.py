"""Symbol ids and byte codecs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def symbol_id(name: Column) -> Column:
    """First 16 hex digits of the MD5 of a documentation id, without the ``#`` of constructors."""
    return F.substring(F.md5(F.replace(name, F.lit("#ctor"), F.lit("ctor"))), 1, 16)


def local_id(parent: Column, name: Column) -> Column:
    """Id of a parameter or local."""
    return symbol_id(F.concat(parent, F.lit(":"), name))


def _reversed_bytes(h: Column) -> Column:
    return F.array_join(F.transform(F.sequence(F.lit(15), F.lit(1), F.lit(-2)), lambda i: F.substring(h, i, F.lit(2))), "")


def hex_to_number(h: Column) -> Column:
    """Little-endian value of 16 hex digits as DECIMAL(20, 0); null for anything else."""
    return F.when(h.rlike("^[0-9A-Fa-f]{16}$"), F.conv(_reversed_bytes(h), 16, 10).cast("decimal(20,0)"))


def number_to_hex(n: Column) -> Column:
    return _reversed_bytes(F.lower(F.lpad(F.conv(n.cast("string"), 10, 16), 16, "0")))


def bytes_to_hex(b: Column) -> Column:
    return F.lower(F.hex(b))


def hex_to_bytes(h: Column) -> Column:
    return F.unhex(h)


def varint(n: Column) -> Column:
    """7 bits a byte, lowest first, the high bit set on all but the last; n is taken as unsigned 32 bits."""
    n = n.cast("long").bitwiseAND(F.lit(0xFFFFFFFF))

    def byte(i: int) -> Column:
        group, rest = F.shiftright(n, 7 * i).bitwiseAND(F.lit(0x7F)), F.shiftright(n, 7 * i + 7)
        return F.when(F.lit(i == 0) | (F.shiftright(n, 7 * i) > 0), F.lpad(F.hex(group + F.when(rest > 0, 128).otherwise(0)), 2, "0")).otherwise(F.lit(""))

    return F.unhex(F.concat(*(byte(i) for i in range(5))))


def varint_value(b: Column) -> Column:
    """The number that the bytes hold; they are read up to the first without the high bit."""
    h = F.hex(b)
    at = lambda i: F.conv(F.substring(h, 2 * i + 1, 2), 16, 10).cast("long")
    total, going = F.lit(0).cast("long"), F.lit(True)
    for i in range(5):
        value = F.coalesce(at(i), F.lit(0).cast("long"))
        total = total + F.when(going, F.shiftleft(value.bitwiseAND(F.lit(0x7F)), 7 * i)).otherwise(F.lit(0).cast("long"))
        going = going & (value >= 128)
    return total
