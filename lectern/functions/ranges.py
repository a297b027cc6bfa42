"""Page ranges: "1-3, 7" to numbers and back."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def parse(text: Column) -> Column:
    """Numbers of a range text, ascending and distinct; parts that are none are skipped."""
    parts = F.filter(F.transform(F.split(text, "[,;]"), lambda p: F.trim(p)), lambda p: p.rlike(r"^\d+(\s*-\s*\d+)?$"))

    def numbers(p: Column) -> Column:
        a = F.regexp_extract(p, r"^(\d+)", 1).try_cast("int")
        b = F.coalesce(F.regexp_extract(p, r"-\s*(\d+)$", 1).try_cast("int"), a)
        return F.sequence(F.least(a, b), F.greatest(a, b))

    return F.array_sort(F.array_distinct(F.flatten(F.transform(parts, numbers))))


def describe(numbers: Column) -> Column:
    """Ascending distinct numbers as text, neighbours joined to ranges."""
    starts = F.filter(numbers, lambda n: ~F.array_contains(numbers, n - 1))
    ends = F.filter(numbers, lambda n: ~F.array_contains(numbers, n + 1))
    shown = F.zip_with(starts, ends, lambda a, b: F.when(a == b, a.cast("string")).otherwise(F.concat(a.cast("string"), F.lit("-"), b.cast("string"))))
    return F.array_join(shown, ", ")
