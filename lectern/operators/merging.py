"""Merging new rows into state: upserts, replacements, actions, budgets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The newest row of each key. ``max_by`` combines map-side, where a ranking
    window would move every row."""
    rest = [c for c in rows.columns if c not in keys]
    best = rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_r"))
    return best.select(*keys, "_r.*").select(*rows.columns)


def upsert(state: DataFrame, new: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """State after the new rows: the newest row of each key wins."""
    return latest(state.unionByName(new), keys, order)


def insert_or_ignore(state: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    return state.unionByName(new.join(state, keys, "left_anti").select(*state.columns))


def replace_groups(state: DataFrame, fresh: DataFrame, replaced: DataFrame, key: str) -> DataFrame:
    """State with all rows of the ``replaced`` keys exchanged for the fresh ones."""
    return state.join(replaced, key, "left_anti").select(*state.columns).unionByName(fresh)


def merge_patch(config: Column, patch: Column) -> Column:
    """A string map with the patch's non-null values on top."""
    given = F.map_filter(patch, lambda k, v: v.isNotNull())
    kept = F.map_filter(config, lambda k, v: ~F.map_contains_key(given, k))
    return F.map_concat(kept, given)


def with_override(name: str, edited: Column, given: Column, auto: Column) -> Column:
    """The user's value where the field was edited, else the automatic one."""
    return F.when(F.array_contains(edited, name), given).otherwise(auto)


def deadline_actions(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """What becomes of each incoming deadline; a dismissal by the user stands."""
    j = new.join(old, key, "left")
    action = F.when(F.col("old_day").isNull(), "created").when(F.col("dismissed"), "kept_user_dismissed").when(F.col("old_day") != F.col("new_day"), "rescheduled").otherwise("updated")
    return j.select(key, action.alias("action"))


def draft_actions(existing: DataFrame, drafts: DataFrame, key: str, value: str) -> DataFrame:
    """create, delete, update or keep for each key of either side."""
    a, b = existing.select(key, F.col(value).alias("_a")), drafts.select(key, F.col(value).alias("_b"))
    j = a.withColumn("_x", F.lit(1)).join(b.withColumn("_y", F.lit(1)), key, "full")
    action = F.when(F.col("_x").isNull(), "create").when(F.col("_y").isNull(), "delete").when(~F.col("_a").eqNullSafe(F.col("_b")), "update").otherwise("keep")
    return j.select(key, action.alias("action"))


def json_leaves(rows: DataFrame, key: str, text: str) -> DataFrame:
    """(key, path, value) of the top-level members of a JSON object; broken text gives none."""
    return rows.select(key, F.explode(F.from_json(text, "map<string,string>")).alias("path", "value"))


def within_budget(rows: DataFrame, keys: list[str], order: list[Column], size: str, budget: int) -> DataFrame:
    """The rows of each key that fit a running budget."""
    used = F.sum(size).over(Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("_used", used).where(F.col("_used") <= budget).drop("_used")


def undo_blocked(entries: DataFrame, session: str, order: str, objects: str) -> DataFrame:
    """Whether a later entry of the session touches one of the entry's objects:
    the last touch of each object is one aggregate, so entries are never paired."""
    touched = entries.select(session, order, F.explode(objects).alias("_o"))
    last = touched.groupBy(session, "_o").agg(F.max(order).alias("_last"))
    blocked = touched.join(last, [session, "_o"]).groupBy(session, order).agg(F.bool_or(F.col("_last") > F.col(order)).alias("blocked"))
    return entries.select(session, order).join(blocked, [session, order], "left").select(session, order, F.coalesce("blocked", F.lit(False)).alias("blocked"))
