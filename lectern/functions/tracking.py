"""Parcel numbers by carrier."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Shapes of parcel numbers, most telling first.
SHAPES = (("ups", r"^1Z[0-9A-Z]{16}$"), ("postal", r"^[A-Z]{2}\d{9}[A-Z]{2}$"), ("amazon", r"^TB[A-Z]\d{12}$"), ("dhl", r"^JJD\d{11,18}$"), ("correos", r"^P[A-Z][0-9A-Z]{20,21}$"), ("fedex", r"^\d{12}$|^\d{15}$"), ("dpd", r"^\d{14}$"))


def postal_check_ok(code: Column) -> Column:
    """The check digit of a postal (S10) number."""
    digits = F.transform(F.sequence(F.lit(3), F.lit(10)), lambda i: F.coalesce(F.substring(code, i, F.lit(1)).try_cast("int"), F.lit(0)))
    weights = F.array(*[F.lit(w) for w in (8, 6, 4, 2, 3, 5, 9, 7)])
    total = F.aggregate(F.zip_with(digits, weights, lambda a, b: a * b), F.lit(0), lambda a, x: a + x)
    check = 11 - total % 11
    check = F.when(check == 10, 0).when(check == 11, 5).otherwise(check)
    return check == F.substring(code, 11, 1).try_cast("int")


def classify(code: Column) -> Column:
    """The carrier of a number by its shape, '' if none fits."""
    s = F.upper(F.regexp_replace(code, r"[\s-]", ""))
    out = None
    for name, shape in SHAPES:
        out = F.when(s.rlike(shape), name) if out is None else out.when(s.rlike(shape), name)
    return out.otherwise("")
