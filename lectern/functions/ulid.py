"""Sortable ids: 48 bits of time and 80 of chance in base 32."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ALPHABET = "0123456789ABCDEFGHJKMNPQRSTVWXYZ"


def encode_time(ms: Column) -> Column:
    """The ten characters of a time in milliseconds."""
    places = F.sequence(F.lit(9), F.lit(0), F.lit(-1))
    return F.array_join(F.transform(places, lambda i: F.substring(F.lit(ALPHABET), (F.call_function("shiftright", ms, i * 5) % 32 + 1).cast("int"), F.lit(1))), "")


def time_of(ulid: Column) -> Column:
    """Milliseconds of an id, null when it is none."""
    s = F.upper(ulid)
    digits = F.transform(F.sequence(F.lit(1), F.lit(10)), lambda i: (F.instr(F.lit(ALPHABET), F.substring(s, i, F.lit(1))) - 1).cast("bigint"))
    return F.when(is_ulid(s), F.aggregate(digits, F.lit(0).cast("bigint"), lambda a, d: a * 32 + d))


def is_ulid(text: Column) -> Column:
    return F.upper(text).rlike(f"^[0-7][{ALPHABET}]{{25}}$")


def new_ulid(at: Column) -> Column:
    """A fresh id for a timestamp; its chance part comes from a random UUID."""
    digits = F.transform(F.sequence(F.lit(1), F.lit(16)), lambda i: F.conv(F.substring(F.replace(F.uuid(), F.lit("-"), F.lit("")), i * 2, F.lit(2)), 16, 10).cast("int") % 32)
    chance = F.transform(digits, lambda d: F.substring(F.lit(ALPHABET), d + 1, F.lit(1)))
    return F.concat(encode_time(F.unix_millis(at)), F.array_join(chance, ""))
