"""Dates and calendars (inventory section I)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import times
from ..operators import calendar as cal
from .registry import query

_YEARS = (1995, 2002)
_HOLIDAYS = """WITH RECURSIVE y AS (SELECT unnest(range(1995, 2003)) AS y), e1 AS (SELECT y, y % 19 AS a, y // 100 AS b, y % 100 AS c FROM y),
e2 AS (SELECT *, (19 * a + b - b // 4 - (b - (b + 8) // 25 + 1) // 3 + 15) % 30 AS h FROM e1), e3 AS (SELECT *, (32 + 2 * (b % 4) + 2 * (c // 4) - h - c % 4) % 7 AS k FROM e2),
e4 AS (SELECT y, h + k - 7 * ((a + 11 * h + 22 * k) // 451) + 114 AS n FROM e3), easter AS (SELECT y, make_date(y, n // 31, n % 31 + 1) AS d FROM e4),
fixed AS (SELECT CAST(y || '-' || md AS DATE) AS d, md FROM y, (SELECT unnest(['01-01', '01-06', '05-01', '08-15', '10-12', '11-01', '12-06', '12-08', '12-25', '05-02']) AS md)),
off AS (SELECT CASE WHEN dayofweek(d) = 0 AND md IN ('01-01', '01-06', '12-06', '12-08', '12-25') THEN CAST(d + INTERVAL 1 DAY AS DATE) ELSE d END AS day FROM fixed
  UNION SELECT CAST(d - INTERVAL 2 DAY AS DATE) FROM easter UNION SELECT CAST(d - INTERVAL 3 DAY AS DATE) FROM easter),
days AS (SELECT CAST(unnest(generate_series(DATE '1995-01-01', DATE '2002-12-31', INTERVAL 1 DAY)) AS DATE) AS day),
cal AS (SELECT day, dayofweek(day) NOT IN (0, 6) AND day NOT IN (SELECT day FROM off) AS working FROM days),
num AS (SELECT day, working, CAST(sum(working::INT) OVER (ORDER BY day) AS BIGINT) AS number, min(CASE WHEN working THEN day END) OVER (ORDER BY day ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS next_working FROM cal)
"""


def _calendar(t):
    return cal.calendar(t.spark, *_YEARS, "ES-MD")


def _day(t):
    return t.orders.select("o_orderkey", F.to_date("o_orderdate").alias("day"))


@query("i1_add_months", "SELECT o_orderkey, CAST(CAST(o_orderdate AS DATE) + to_months(CAST(o_orderkey % 25 AS INT) - 12) AS DATE) AS day FROM orders")
def add_months(t):
    return t.orders.select("o_orderkey", F.add_months(F.to_date("o_orderdate"), (F.col("o_orderkey") % 25 - 12).cast("int")).alias("day"))


@query(
    "i2_day_arithmetic",
    """SELECT o_orderkey, CAST(d + INTERVAL 45 DAY AS DATE) AS later, date_diff('day', d, DATE '1998-01-01') AS days, CAST(d + to_days(CAST((8 - isodow(d)) AS INT)) AS DATE) AS monday FROM (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS d FROM orders)""",
)
def day_arithmetic(t):
    d = F.to_date("o_orderdate")
    return t.orders.select("o_orderkey", F.date_add(d, 45).alias("later"), F.datediff(F.lit("1998-01-01").cast("date"), d).cast("bigint").alias("days"), F.next_day(d, "Mon").alias("monday"))


@query("i3_iso_day", "SELECT event_id, CASE WHEN event_id % 3 = 0 THEN NULL ELSE CAST(ts AS DATE) END AS day FROM events")
def iso_day(t):
    raw = F.when(F.col("event_id") % 3 == 0, F.lit("2024-13-45 bad")).otherwise(F.concat(F.date_format("ts", "yyyy-MM-dd"), F.lit("T10:00")))
    return t.events.select("event_id", times.parse_iso(raw).alias("day"))


@query("i4_find_dates", "SELECT o_orderkey, CAST(o_orderdate AS DATE) AS day, 'due' AS role FROM orders")
def find_dates(t):
    from ..operators.extraction import find_dates as run

    shapes = ("yyyy-MM-dd", "d/M/yyyy", "d MMMM yyyy", "MMMM d, yyyy")
    written = F.array(*[F.date_format("day", s) for s in shapes])
    text = F.concat(F.lit("Thank you.\nDue date: "), F.element_at(written, (F.col("o_orderkey") % 4 + 1).cast("int")), F.lit(", or 99/99/2024"))
    return run(_day(t).select("o_orderkey", text.alias("text")), "o_orderkey", "text").select("o_orderkey", "day", "role")


@query(
    "i6_resolved_year",
    """WITH b AS (SELECT o_orderkey, month(o_orderdate) AS m, least(day(o_orderdate), 28) AS d FROM orders), c AS (SELECT o_orderkey, make_date(unnest([1997, 1998, 1999]), m, d) AS day FROM b)
    SELECT o_orderkey, min_by(day, (abs(date_diff('day', DATE '1998-05-20', day)), day)) AS day FROM c GROUP BY o_orderkey""",
)
def resolved_year(t):
    m, d = F.month("o_orderdate"), F.least(F.day("o_orderdate"), F.lit(28))
    return t.orders.select("o_orderkey", times.nearest_year(m, d, F.lit("1998-05-20").cast("date")).alias("day"))


@query("i7_month_number", "SELECT o_orderkey, CAST(month(o_orderdate) AS BIGINT) AS month FROM orders")
def month_number(t):
    return t.orders.select("o_orderkey", times.month_number(F.date_format("o_orderdate", "MMMM")).cast("bigint").alias("month"))


@query("i9_holidays", _HOLIDAYS + "SELECT o_orderkey, CAST(o_orderdate AS DATE) IN (SELECT day FROM off) AS holiday FROM orders")
def holidays(t):
    """Which orders came on a holiday."""
    off = cal.holidays(t.spark, *_YEARS, "ES-MD").withColumn("holiday", F.lit(True))
    return _day(t).join(F.broadcast(off), "day", "left").select("o_orderkey", F.coalesce("holiday", F.lit(False)).alias("holiday"))  # some twenty rows a year


@query("i9_calendar", _HOLIDAYS + "SELECT o_orderkey, working, number, next_working FROM orders JOIN num ON day = CAST(o_orderdate AS DATE)")
def calendar(t):
    """What the calendar says of every order's day."""
    return _day(t).join(F.broadcast(_calendar(t)), "day").select("o_orderkey", "working", "number", "next_working")


@query(
    "i10_add_working_days",
    _HOLIDAYS + """SELECT o_orderkey, CASE WHEN k = 0 THEN n.day ELSE m.day END AS due FROM (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS d, o_orderkey % 31 AS k FROM orders) o
    JOIN num n ON n.day = o.d LEFT JOIN num m ON m.working AND m.number = n.number + o.k""",
)
def add_working_days(t):
    return cal.add_working_days(_day(t), "day", F.col("o_orderkey") % 31, _calendar(t), "due").select("o_orderkey", "due")


@query("i11_next_working_day", _HOLIDAYS + "SELECT o_orderkey, next_working AS day FROM orders JOIN num ON num.day = CAST(o_orderdate AS DATE)")
def next_working_day(t):
    table = _calendar(t).select("day", "next_working")
    return _day(t).join(F.broadcast(table), "day").select("o_orderkey", F.col("next_working").alias("day"))


@query(
    "i12_working_days_between",
    _HOLIDAYS + """SELECT o_orderkey, CAST((b.number - b.working::INT) - (a.number - a.working::INT) AS BIGINT) AS days FROM orders JOIN num a ON a.day = CAST(o_orderdate AS DATE) JOIN num b ON b.day = DATE '1998-06-15'""",
)
def working_days_between(t):
    rows = _day(t).withColumn("end", F.lit("1998-06-15").cast("date"))
    return cal.working_days_between(rows, "day", "end", _calendar(t), "days").select("o_orderkey", "days")


@query(
    "i13_delivery_day",
    _HOLIDAYS + """SELECT o_orderkey, working OR (dayofweek(day) = 6 AND o_orderkey % 2 = 0) AS delivers FROM orders JOIN num ON num.day = CAST(o_orderdate AS DATE)""",
)
def delivery_day(t):
    carrier = F.when(F.col("o_orderkey") % 2 == 0, "amazon").otherwise("seur")
    joined = _day(t).join(F.broadcast(_calendar(t)), "day")
    return joined.select("o_orderkey", cal.delivers(F.col("day"), carrier, F.col("working")).alias("delivers"))


@query("i14_to_utc", "SELECT event_id, date_trunc('second', ts) AS at FROM events")
def to_utc(t):
    text = F.when(F.col("event_id") % 2 == 0, F.date_format("ts", "EEE, d MMM yyyy HH:mm:ss '+0000'")).otherwise(F.date_format("ts", "yyyy-MM-dd HH:mm:ss"))
    return t.events.select("event_id", times.to_utc(text).cast("timestamp_ntz").alias("at"))


@query(
    "i15_admin_deadline",
    _HOLIDAYS + """SELECT o_orderkey, next_working AS due FROM (SELECT o_orderkey, CAST(CAST(o_orderdate AS DATE) + INTERVAL 1 MONTH AS DATE) AS d FROM orders) JOIN num ON num.day = d""",
)
def admin_deadline(t):
    rows = _day(t).select("o_orderkey", F.add_months("day", 1).alias("day"))
    return rows.join(F.broadcast(_calendar(t).select("day", F.col("next_working").alias("due"))), "day").select("o_orderkey", "due")


@query(
    "i16_term_ends",
    """SELECT o_orderkey, CAST(d + INTERVAL 1 YEAR - INTERVAL 1 MONTH AS DATE) AS cancel_by, CAST(d + INTERVAL 36 MONTH AS DATE) AS warranty_end, CAST(d + INTERVAL 20 DAY AS DATE) AS discount_until FROM (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS d FROM orders)""",
)
def term_ends(t):
    d = F.to_date("o_orderdate")
    return t.orders.select("o_orderkey", F.add_months(F.add_months(d, 12), -1).alias("cancel_by"), F.add_months(d, 36).alias("warranty_end"), F.date_add(d, 20).alias("discount_until"))


@query(
    "i17_fiscal_year",
    r"""WITH y AS (SELECT doc_id, list_distinct(regexp_extract_all(text, '\b(?:19|20)\d\d\b')) AS y FROM documents) SELECT doc_id, CASE WHEN len(y) = 1 THEN CAST(y[1] AS BIGINT) ELSE 2024 END AS year FROM y""",
)
def fiscal_year(t):
    years = F.array_distinct(F.regexp_extract_all("text", F.lit(r"\b(?:19|20)\d\d\b"), F.lit(0)))
    return t.documents.select("doc_id", F.when(F.size(years) == 1, F.get(years, F.lit(0)).cast("bigint")).otherwise(F.lit(2024).cast("bigint")).alias("year"))


@query("i18_quiet_hours", "SELECT event_id, hour(ts) * 60 + minute(ts) >= 1320 OR hour(ts) * 60 + minute(ts) < 480 AS quiet FROM events")
def quiet_hours(t):
    minute = F.hour("ts") * 60 + F.minute("ts")
    return t.events.select("event_id", times.quiet(minute, 1320, 480).alias("quiet"))


@query("i19_chapter_target", "SELECT conv_id, CAST(greatest(60, least(600, round(n * 40.0 / 8))) AS DOUBLE) AS target FROM (SELECT conv_id, count(*) AS n FROM conversations GROUP BY conv_id)")
def chapter_target(t):
    n = t.conversations.groupBy("conv_id").agg(F.count("*").alias("n"))
    return n.select("conv_id", F.greatest(F.lit(60.0), F.least(F.lit(600.0), F.round(F.col("n") * 40.0 / 8))).alias("target"))


@query("i20_formatted_dates", "SELECT o_orderkey, strftime(o_orderdate, '%d/%m/%Y') AS day, strftime(o_orderdate, '%Y-%m-%d %H:%M') AS stamp FROM orders")
def formatted_dates(t):
    return t.orders.select("o_orderkey", F.date_format("o_orderdate", "dd/MM/yyyy").alias("day"), F.date_format("o_orderdate", "yyyy-MM-dd HH:mm").alias("stamp"))


@query("i21_agenda_window", "SELECT event_id, event_type AS kind, date_diff('day', DATE '2024-01-10', CAST(ts AS DATE)) AS days_left FROM events WHERE CAST(ts AS DATE) BETWEEN DATE '2024-01-10' AND DATE '2024-01-17'")
def agenda_window(t):
    day = F.to_date("ts")
    rows = t.events.where(day.between(F.lit("2024-01-10").cast("date"), F.lit("2024-01-17").cast("date")))
    return rows.select("event_id", F.col("event_type").alias("kind"), F.datediff(day, F.lit("2024-01-10").cast("date")).cast("bigint").alias("days_left"))


@query(
    "i22_count_working_days",
    _HOLIDAYS + """SELECT o_orderkey, CAST(greatest(b.number - a.number, 0) AS BIGINT) AS days FROM orders JOIN num a ON a.day = CAST(o_orderdate AS DATE) JOIN num b ON b.day = DATE '1998-06-15'""",
)
def count_working_days(t):
    rows = _day(t).select("o_orderkey", F.date_add("day", 1).alias("day"), F.lit("1998-06-16").cast("date").alias("end"))
    return cal.working_days_between(rows, "day", "end", _calendar(t), "days").select("o_orderkey", F.greatest("days", F.lit(0).cast("bigint")).alias("days"))
