"""State that lives in time and in order (inventory section O)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import automaton, paths, windows
from ..streaming import jobs, live
from .registry import query


@query(
    "o17_live_answers",
    f"""WITH RECURSIVE e AS (
      SELECT user_id, event_id, epoch_us(ts) // 1000 AS ms, event_type <> 'error' AS ok, value, row_number() OVER (PARTITION BY user_id ORDER BY epoch_us(ts) // 1000, event_id) AS k FROM events
    ), f AS (
      SELECT user_id, 0::BIGINT AS k, NULL::BIGINT AS event_id, NULL::BIGINT AS ms, NULL::VARCHAR AS said, NULL::DOUBLE AS value, NULL::BIGINT AS held, NULL::DOUBLE AS held_value FROM e GROUP BY user_id
      UNION ALL
      SELECT user_id, k, event_id, ms, said, CASE said WHEN 'fresh' THEN own WHEN 'failed' THEN NULL ELSE held_value END, CASE WHEN said = 'fresh' THEN ms ELSE held END, CASE WHEN said = 'fresh' THEN own ELSE held_value END
      FROM (SELECT f.user_id, e.k, e.event_id, e.ms, e.value AS own, f.held, f.held_value,
              CASE WHEN e.ms - f.held < {live.TTL * 1000} THEN 'cached' WHEN e.ok THEN 'fresh' WHEN e.ms - f.held <= {live.MOST_STALE * 1000} THEN 'stale' ELSE 'failed' END AS said
            FROM f JOIN e ON e.user_id = f.user_id AND e.k = f.k + 1)
    ), g AS (
      SELECT user_id, ms, lead(ms) OVER (PARTITION BY user_id ORDER BY k) AS next FROM f WHERE said = 'fresh'
    ), t AS (
      SELECT user_id, ms + {live.TTL * 1000} AS ms, 'expired' AS said FROM g
      UNION ALL SELECT user_id, ms + {live.MOST_STALE * 1000 + 1}, 'gone' FROM g WHERE next IS NULL OR next - ms > {live.MOST_STALE * 1000}
    )
    SELECT user_id, ms, event_id, said, value FROM f WHERE k > 0
    UNION ALL SELECT user_id, ms, NULL, said, NULL FROM t WHERE ms <= (SELECT epoch_us(max(ts)) // 1000 - 600000 FROM events)""",
)
def live_answers(t):
    return jobs.run_once(t.events, live.live_answers, "append")


#: Question keys: three failures in a row stop the run. Symbols: the model answered,
#: had nothing to ask, the text was too short to ask, the model failed.
ANSWERED, NOTHING, SHORT, FAILED = range(4)
STOPPED = 3
QUESTION_RUN = [[0, 0, 0, 3], [0, 0, 0, 3], [0, 1, 2, 3], [1, 2, 3, 3]]

_SYMBOL = "CASE event_type WHEN 'error' THEN 3 WHEN 'view' THEN 2 WHEN 'click' THEN 1 ELSE 0 END"


@query(
    "o18_question_states",
    f"""WITH RECURSIVE e AS (SELECT user_id, event_id, {_SYMBOL} AS symbol, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k FROM events),
    f AS (
      SELECT user_id, 0::BIGINT AS k, NULL::BIGINT AS event_id, 0 AS symbol, 0 AS before, 0 AS after FROM e GROUP BY user_id
      UNION ALL
      SELECT f.user_id, e.k, e.event_id, e.symbol, f.after, CASE WHEN f.after = 3 THEN 3 WHEN e.symbol = 3 THEN f.after + 1 WHEN e.symbol = 2 THEN f.after ELSE 0 END FROM f JOIN e ON e.user_id = f.user_id AND e.k = f.k + 1
    )
    SELECT event_id, user_id, CASE WHEN before = 3 OR symbol = 3 THEN 'unavailable' WHEN symbol = 0 THEN 'ok' ELSE 'empty' END AS state, after = 3 AS stopped FROM f WHERE k > 0""",
)
def question_states(t):
    rows = t.events.select("event_id", "user_id", "event_type")
    symbol = F.when(F.col("event_type") == "error", FAILED).when(F.col("event_type") == "view", SHORT).when(F.col("event_type") == "click", NOTHING).otherwise(ANSWERED)
    run = automaton.folded(rows, "user_id", ["event_id"], symbol, QUESTION_RUN)
    state = F.when((F.col("before") == STOPPED) | (symbol == FAILED), "unavailable").when(symbol == ANSWERED, "ok").otherwise("empty")
    return run.select("event_id", "user_id", state.alias("state"), (F.col("after") == STOPPED).alias("stopped"))


@query(
    "o19_polite_starts",
    """WITH RECURSIVE e AS (SELECT user_id, event_id, epoch_us(ts) // 1000000 AS came, row_number() OVER (PARTITION BY user_id ORDER BY epoch_us(ts) // 1000000, event_id) AS i FROM events),
    s AS (SELECT user_id, event_id, i, came AS starts FROM e WHERE i = 1 UNION ALL SELECT e.user_id, e.event_id, e.i, greatest(e.came, s.starts + 90000) FROM s JOIN e ON e.user_id = s.user_id AND e.i = s.i + 1)
    SELECT event_id, user_id, CAST(starts AS BIGINT) AS starts FROM s""",
)
def polite_starts(t):
    """When the requests of a host may start, 25 hours apart."""
    at = F.unix_timestamp(F.col("ts").cast("timestamp"))
    return windows.spaced(t.events.select("event_id", "user_id", "ts"), "user_id", at, "event_id", 90_000.0).select("event_id", "user_id", F.col("starts").cast("bigint").alias("starts"))


@query(
    "r32_refused_folders",
    r"""WITH p AS (SELECT page_id, regexp_extract(url, '^https?://([^/?#]*)', 1) AS host FROM pages)
    SELECT page_id, ['', 'system', 'home', 'hidden', 'relative', 'own data', '', 'system'][page_id % 8 + 1] AS reason FROM p""",
)
def refused_folders(t):
    host = F.regexp_extract("url", r"^https?://([^/?#]*)", 1)
    shapes = [("/srv/x/../", ""), ("/etc/", ""), ("C:\\Users\\", ""), ("/srv/", "/.ssh/keys"), ("", "/pages"), ("/srv/lectern/", "/db"), ("'/srv/lectern/exports/", "'"), ("c:/x/../Windows./", "")]
    made = F.element_at(F.array(*[F.concat(F.lit(a), host, F.lit(b)) for a, b in shapes]), (F.col("page_id") % 8 + 1).cast("int"))
    return t.pages.select("page_id", paths.refused(made, "/srv/lectern", ("exports",)).alias("reason"))
