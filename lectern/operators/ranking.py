"""Orders and selections beyond a plain sort."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def natural_key(text: Column) -> Column:
    """Sorts numbers inside names by value: digits are padded."""
    parts = F.regexp_extract_all(F.lower(text), F.lit(r"[0-9]+|[^0-9]+"), F.lit(0))
    return F.array_join(F.transform(parts, lambda p: F.when(p.rlike("^[0-9]"), F.lpad(p, 20, "0")).otherwise(p)), "")


def natural_order(names: DataFrame, name: str) -> DataFrame:
    """``place`` of each distinct name (a list of collections: small by nature)."""
    return names.withColumn("place", F.row_number().over(Window.orderBy(natural_key(F.col(name)), name)).cast("bigint"))


def resurfaced(rows: DataFrame, key: str, age: Column, favorite: Column, marks: Column, affinity: Column, n: int, least_age: int = 2) -> DataFrame:
    """The ``n`` best unread rows: min(age, 120) + 40 for a favourite + 10 a mark + min(20, affinity)."""
    score = F.least(age, F.lit(120)) + F.when(favorite, 40).otherwise(0) + 10 * marks + F.least(affinity, F.lit(20))
    return rows.where(age >= least_age).select(key, score.cast("bigint").alias("score")).orderBy(F.desc("score"), key).limit(n)


def thinned(rows: DataFrame, key: str, order: str, n: int) -> DataFrame:
    """About ``n`` evenly spread rows of each key, its first always."""
    w = Window.partitionBy(key).orderBy(order)
    numbered = rows.withColumns({"_i": F.row_number().over(w) - 1, "_n": F.count("*").over(Window.partitionBy(key))})
    step = lambda i: F.floor(i * n / F.col("_n"))
    return numbered.where((F.col("_n") <= n) | (step(F.col("_i")) != step(F.col("_i") - 1))).drop("_i", "_n")


def best_plan(items: list[tuple[int, int, bool]], budget: int, most: int) -> list[int]:
    """Ids of at most ``most`` (id, minutes, favourite) items within ``budget``:
    the fullest budget first, then more favourites, then fewer items, then lower
    ids. Exact, by dynamic programming over (items, minutes)."""
    best: dict[tuple[int, int], tuple[int, tuple[int, ...]]] = {(0, 0): (0, ())}
    for ident, minutes, favorite in sorted(items):
        for (count, used), (liked, chosen) in sorted(best.items(), reverse=True):
            if count == most or used + minutes > budget:
                continue
            at, new = (count + 1, used + minutes), (liked + favorite, (*chosen, ident))
            old = best.get(at)
            if old is None or (-new[0], new[1]) < (-old[0], old[1]):
                best[at] = new
    (_, _), (_, chosen) = min(best.items(), key=lambda x: (-x[0][1], -x[1][0], x[0][0], x[1][1]))
    return list(chosen)


def reading_plan(rows: DataFrame, key: str, ident: str, minutes: str, favorite: str, budget: int, most: int) -> DataFrame:
    """(key, place, ident, minutes) of each key's plan. Items that don't fit are
    gone before; of items of equal length and kind only the ``most`` lowest ids
    can be in a best plan, so a group brings at most 2 * most * budget items."""
    w = Window.partitionBy(key, minutes, favorite).orderBy(ident)
    useful = rows.where((F.col(minutes) > 0) & (F.col(minutes) <= budget)).withColumn("_k", F.row_number().over(w)).where(F.col("_k") <= most)

    def pick(group: pd.DataFrame) -> pd.DataFrame:
        length = dict(zip(group[ident], group[minutes]))
        chosen = best_plan([(int(i), int(m), bool(f)) for i, m, f in zip(group[ident], group[minutes], group[favorite])], budget, most)
        return pd.DataFrame({key: group[key].iloc[0], "place": range(1, len(chosen) + 1), ident: chosen, minutes: [length[i] for i in chosen]}, columns=[key, "place", ident, minutes])

    types = dict(rows.dtypes)
    return useful.drop("_k").groupBy(key).applyInPandas(pick, f"{key} {types[key]}, place bigint, {ident} {types[ident]}, {minutes} {types[minutes]}")
