"""Finite automata over ordered rows, one long key included.

The step of a row is a table: the state after it for each state before it. Tables
compose, and composing is associative, so a key's rows need not be read by one
task: rows are dealt by range of (key, order), each range composes the tables of
its rows, the few keys that reach over several ranges chain the ranges' tables, and
every range then knows the state in which it begins. Inside a range the states are
a segmented prefix scan in log2(n) rounds of array lookups.

Defined results: a null key is a key; rows should be told apart by their order,
equal ones of a key are taken in any order; a null symbol leaves the state as it
is; an empty table has no rows.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..storage import materialise


def scan(steps: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Tables ``steps`` (n x states) composed from the last row of ``first`` (a
    mask) up to each row, in order."""
    done, start = steps.copy(), np.maximum.accumulate(np.where(first, np.arange(len(steps)), 0))
    reach = 1
    while reach < len(steps):
        at = np.flatnonzero(np.arange(len(steps)) - reach >= start)
        if not len(at):
            break
        done[at] = np.take_along_axis(done[at], done[at - reach], axis=1)  # the earlier table first
        reach *= 2
    return done


def _heads(keys: np.ndarray) -> np.ndarray:
    return np.concatenate([[True], keys[1:] != keys[:-1]]) if len(keys) else np.empty(0, dtype=bool)


def folded(rows: DataFrame, key: str, order: Sequence[str], symbol: Column, machine: Sequence[Sequence[int]], begin: int = 0) -> DataFrame:
    """``rows`` with ``before`` and ``after``, the states around each row's symbol;
    ``machine[symbol][state]`` is the next state."""
    tables, states = np.array(machine, dtype=np.int32), len(machine[0])
    same = np.arange(states, dtype=np.int32)
    named = rows.withColumn("_symbol", F.coalesce(symbol.cast("int"), F.lit(-1))).withColumn("_key", F.coalesce(F.xxhash64(key, F.col(key).isNull()), F.lit(0)))
    ordered = named.repartitionByRange("_key", key, *order).sortWithinPartitions("_key", key, *order)
    ordered = materialise(ordered.withColumn("_at", F.monotonically_increasing_id()).withColumn("_range", F.shiftright("_at", 33)), "automaton_rows")

    def steps(symbols: np.ndarray) -> np.ndarray:
        return np.where(symbols[:, None] < 0, same, tables[np.maximum(symbols, 0)]) if len(tables) else np.tile(same, (len(symbols), 1))

    def composed(batch: pa.Table) -> pa.Table:
        """(range, key, table) of one range."""
        batch = batch.sort_by("_at")
        keys = batch["_key"].to_numpy()
        heads = _heads(keys)
        done = scan(steps(batch["_symbol"].to_numpy()), heads)
        last = np.append(np.flatnonzero(heads)[1:] - 1, len(keys) - 1)
        return pa.table({"_range": batch["_range"].take(pa.array(last)), "_key": pa.array(keys[last]), "_table": pa.array(done[last].tolist(), pa.list_(pa.int32()))})

    narrow = ordered.select("_range", "_at", "_key", "_symbol")
    parts = materialise(narrow.groupBy("_range").applyInArrow(composed, "_range bigint, _key bigint, _table array<int>"), "automaton_ranges")
    # a key in one range begins there; those of several are two a border at most
    several = parts.groupBy("_key").agg(F.array_sort(F.collect_list(F.struct("_range", "_table"))).alias("held")).where(F.size("held") > 1)
    chain = F.aggregate(F.slice("held", F.lit(1), F.col("i")), F.lit(begin), lambda state, x: F.get(x["_table"], state))
    entries = several.select("_key", "held", F.explode(F.sequence(F.lit(1), F.size("held") - 1)).alias("i")).select("_key", F.get("held", F.col("i"))["_range"].alias("_range"), chain.alias("_entry"))

    def replayed(batch: pa.Table) -> pa.Table:
        batch = batch.sort_by("_at")
        keys, symbols, entry = batch["_key"].to_numpy(), batch["_symbol"].to_numpy(), batch["_entry"].to_numpy()
        heads = _heads(keys)
        after = np.take_along_axis(scan(steps(symbols), heads), entry[:, None], axis=1)[:, 0]
        before = np.where(heads, entry, np.concatenate([[0], after[:-1]]))
        return batch.drop_columns(["_range", "_at", "_key", "_symbol", "_entry"]).append_column("before", pa.array(before.astype(np.int32))).append_column("after", pa.array(after.astype(np.int32)))

    begun = ordered.join(F.broadcast(materialise(entries, "automaton_entries")), ["_range", "_key"], "left").withColumn("_entry", F.coalesce("_entry", F.lit(begin)))
    schema = ", ".join(f"`{c}` {t}" for c, t in rows.dtypes)
    return begun.groupBy("_range").applyInArrow(replayed, f"{schema}, before int, after int")
