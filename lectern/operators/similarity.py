"""Fingerprints and similarities as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import text as tx

# Legal forms that don't tell companies apart.
LEGAL_FORMS = ("sl", "sa", "ltd", "inc", "gmbh", "co")


def normal_text(text: Column) -> Column:
    """Lower case, numbers as #, white space squeezed: what stays when a page is only re-rendered."""
    return tx.squeeze(F.regexp_replace(F.lower(text), "[0-9]+", "#"))


def fingerprint(text: Column) -> Column:
    return F.sha2(normal_text(text), 256)


def gradient_hash(values: Column, bits: int) -> Column:
    """Bit i is set where value i exceeds value i + 1 (a difference hash)."""
    places = F.sequence(F.lit(0), F.lit(bits - 1))
    return F.aggregate(
        places, F.lit(0).cast("bigint"), lambda acc, i: acc + F.when(F.get(values, i) > F.get(values, i + 1), F.pow(F.lit(2.0), i).cast("bigint")).otherwise(F.lit(0).cast("bigint"))
    )


def name_similarity(a: Column, b: Column) -> Column:
    """Word overlap of two names; an initial counts half a word it begins."""
    x = F.array_distinct(F.regexp_extract_all(tx.fold(a), F.lit("[a-z0-9]+"), F.lit(0)))
    y = F.array_distinct(F.regexp_extract_all(tx.fold(b), F.lit("[a-z0-9]+"), F.lit(0)))
    rest_x, rest_y = F.array_except(x, y), F.array_except(y, x)
    initials = F.size(F.filter(rest_x, lambda w: (F.length(w) == 1) & F.exists(rest_y, lambda v: F.startswith(v, w))))
    hits = F.size(F.array_intersect(x, y)) + 0.5 * initials
    union = F.size(F.array_union(x, y))
    return F.when((F.size(x) == 0) | (F.size(y) == 0), 0.0).otherwise(F.round(F.least(F.lit(1.0), hits / union), 4))


def merchant_tokens(name: Column) -> Column:
    words = F.regexp_extract_all(tx.fold(name), F.lit("[a-z0-9]+"), F.lit(0))
    return F.array_distinct(F.filter(words, lambda w: ~w.isin(*LEGAL_FORMS)))
