"""States in time and in order against plain Python."""

import datetime as dt
import random

from lectern.streaming import live


def brute_live(rows, until):
    out, held = [], {}
    expiries = []
    for ms, event, user, kind, value in sorted(rows, key=lambda r: (r[0], r[1])):
        last = held.get(user)
        age = None if last is None else ms - last[0]
        if age is not None and age < live.TTL * 1000:
            out.append((user, ms, event, "cached", last[1]))
        elif kind != "error":
            expiries.append((user, ms + live.TTL * 1000, None, "expired", None))
            if last is not None and age > live.MOST_STALE * 1000:
                expiries.append((user, last[0] + live.MOST_STALE * 1000 + 1, None, "gone", None))
            held[user] = (ms, value)
            out.append((user, ms, event, "fresh", value))
        elif age is not None and age <= live.MOST_STALE * 1000:
            out.append((user, ms, event, "stale", last[1]))
        else:
            out.append((user, ms, event, "failed", None))
    expiries += [(user, last[0] + live.MOST_STALE * 1000 + 1, None, "gone", None) for user, last in held.items()]
    return sorted(map(str, out + [e for e in expiries if e[1] <= until]))


def test_answers_do_not_depend_on_batches(spark, tmp_path):
    rng = random.Random(4)
    start, rows = dt.datetime(2024, 1, 1), []
    for i in range(400):
        start += dt.timedelta(minutes=rng.choice([1, 5, 20, 70, 200]))
        rows.append((i, start, rng.choice([1, 1, 1, 2, 3, None]), rng.choice(["error", "error", "view"]), float(i)))
    rows.append((401, start + dt.timedelta(days=2), 9, "view", 1.0))
    schema = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double"
    ms = lambda t: int((t - dt.datetime(1970, 1, 1)).total_seconds() * 1000)
    expected = brute_live([(ms(t), e, u, k, v) for e, t, u, k, v in rows], ms(rows[-1][1]) - 600_000)
    for parts in (1, 7):
        base = tmp_path / str(parts)
        cuts = [rows[len(rows) * i // parts : len(rows) * (i + 1) // parts] for i in range(parts)]
        for i, cut in enumerate(cuts):
            spark.createDataFrame(cut, schema).coalesce(1).write.mode("append").parquet(str(base / "in" / f"p={i}"))
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(base / "in" / "p=*"))
        query = live.live_answers(stream).writeStream.format("parquet").option("checkpointLocation", str(base / "c")).trigger(availableNow=True).start(str(base / "out"))
        query.awaitTermination()
        found = spark.read.parquet(str(base / "out")).select("user_id", "ms", "event_id", "said", "value").collect()
        assert sorted(str(tuple(r)) for r in found) == expected
        numbers = query.lastProgress.stateOperators[0].numRowsTotal
        assert numbers == 3  # the answer of the last key and its two timers: the others have left


def test_a_key_asks_little_of_its_state():
    """calls of the state store do not grow with the answers of a key."""
    from types import SimpleNamespace

    calls, timers = [], set()

    class Value:
        held = None

        def get(self):
            calls.append("get")
            return self.held

        def update(self, x):
            calls.append("update")
            self.held = x

        def clear(self):
            calls.append("clear")
            self.held = None

    handle = SimpleNamespace(getValueState=lambda *a: Value(), getMapState=lambda *a: None, registerTimer=lambda at: calls.append("set") or timers.add(at), deleteTimer=lambda at: calls.append("unset") or timers.remove(at))
    answers = live.LiveAnswers()
    answers.init(handle)
    rows = [{"ms": i * 5_000_000, "event_id": i, "ok": True, "value": float(i)} for i in range(1000)]
    assert [r["said"] for r in answers.handleInputRows((1,), iter(rows), None)] == ["fresh"] * 1000
    assert timers == {live.TTL * 1000} and len(calls) <= 8
    timers.clear()
    fired = list(answers.handleExpiredTimer((1,), SimpleNamespace(getCurrentWatermarkInMs=lambda: 10**10), None))
    assert len(fired) == 1001 and not timers and len(calls) <= 16 and answers._last.held is None


def test_automaton_over_one_long_key(spark):
    import numpy as np
    from pyspark.sql import functions as F

    from lectern.operators import automaton
    from lectern.plans.states import QUESTION_RUN

    rng = random.Random(6)
    rows = [(1, i, rng.choice([0, 1, 2, 2, 3, None])) for i in range(3000)] + [(rng.choice([None, 2, 3, 4]), 5000 + i, rng.choice([0, 3, 3])) for i in range(300)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "k bigint, o bigint, s int").repartition(3)
    turning = [[(s * 5 + x) % 7 for s in range(7)] for x in range(4)]  # no state absorbs: every row counts
    for machine in (QUESTION_RUN, turning):
        state, expected = {}, set()
        for k, o, s in sorted(rows, key=lambda r: r[1]):
            before = state.get(k, 0)
            state[k] = before if s is None else machine[s][before]
            expected.add((k, o, s, before, state[k]))
        found = automaton.folded(df, "k", ["o"], F.col("s"), machine)
        assert {tuple(r) for r in found.collect()} == expected
        assert automaton.folded(df.limit(0), "k", ["o"], F.col("s"), machine).collect() == []
    steps = np.array([[rng.randrange(3) for _ in range(3)] for _ in range(50)])
    first = np.array([i in (0, 1, 17, 49) for i in range(50)])
    table = None
    for i, done in enumerate(automaton.scan(steps, first)):
        table = steps[i] if first[i] else steps[i][table]
        assert done.tolist() == table.tolist()


def test_refused_folders(spark):
    from pyspark.sql import functions as F

    from lectern.operators import paths

    cases = {
        "": "empty", None: "empty", "  ": "empty", "a/b": "relative", "./a": "relative", "C:a": "relative", "/": "root", "/a/..": "root", "/../..": "root", "C:\\": "root", "c:": "root", "/etc": "system", "/ETC/x": "system",
        "/etcetera": "", "C:\\Windows \\x": "system", "C:/Program Files/a": "system", "/home": "home", "/home/me": "home", "/home/me/docs": "", "C:\\Users\\me\\docs": "", "C:\\Users\\me": "home", "/srv/.git/x": "hidden", "/srv/.github": "",
        "D:\\a\\AppData\\b": "hidden", "/data": "own data", "/data/app": "own data", "/data/app/db": "own data", "/data/app/out": "", "/data/app/out/x": "", "/data/application": "", "'/data/app/out'": "", '"/etc"': "system", "/data/app/out/../db": "own data",
    }
    df = spark.createDataFrame(list(enumerate(cases)), "i int, p string")
    found = {r["p"]: r["r"] for r in df.select("p", paths.refused(F.col("p"), "/data/app", ("out",)).alias("r")).collect()}
    assert found == cases
    pairs = [("/a/b", "/a", True), ("/a", "/a/", True), ("/ab", "/a", False), ("/a/../b", "/a", False), ("C:\\A\\b", "c:/a", True), ("/A/b", "/a", False), ("c:/a", "/a", False)]
    df = spark.createDataFrame([(i, *p) for i, p in enumerate(pairs)], "i int, a string, b string, said boolean")
    assert df.where(paths.is_inside(F.col("a"), F.col("b")) != F.col("said")).collect() == []
