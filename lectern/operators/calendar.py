"""Working-day calendars as a dimension table.

A calendar is a table of days with a running number of working days, so adding
or counting working days is a join on that number. It grows with years and
regions, not with data: a century of days for one region is 36 525 rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# Public holidays of Spain and of six regions, with the days that
# move to Monday when they fall on a Sunday, and carriers that deliver on Saturdays.
NATIONAL_FIXED = ("01-01", "01-06", "05-01", "08-15", "10-12", "11-01", "12-06", "12-08", "12-25")
NATIONAL_EASTER = (-2,)
REGIONS = {
    "ES": ((), ()),
    "ES-MD": (("05-02",), (-3,)),
    "ES-CT": (("06-24", "09-11", "12-26"), (1,)),
    "ES-AN": (("02-28",), (-3,)),
    "ES-VC": (("03-19", "06-24", "10-09"), (1,)),
    "ES-GA": (("05-17", "07-25"), (-3,)),
    "ES-PV": (("07-25",), (-3, 1)),
}
MOVE_SUNDAY = ("01-01", "01-06", "12-06", "12-08", "12-25")
NO_MOVE = ("ES-CT",)
SATURDAY_CARRIERS = ("amazon", "inpost", "paack", "postnl", "royalmail", "deutschepost", "laposte")


def easter(year: Column) -> Column:
    """Easter Sunday, by the usual whole-number method."""
    div = lambda x, n: F.floor(x / n)
    a, b, c = year % 19, div(year, 100), year % 100
    h = (19 * a + b - div(b, 4) - div(b - div(b + 8, 25) + 1, 3) + 15) % 30
    k = (32 + 2 * (b % 4) + 2 * div(c, 4) - h - c % 4) % 7
    n = h + k - 7 * div(a + 11 * h + 22 * k, 451) + 114
    return F.make_date(year.cast("int"), div(n, 31).cast("int"), (n % 31 + 1).cast("int"))


def holidays(spark: SparkSession, first_year: int, last_year: int, region: str = "ES") -> DataFrame:
    """Distinct holidays (day) of some years."""
    fixed, moveable = REGIONS[region]
    years = spark.range(first_year, last_year + 1).select(F.col("id").alias("year"))
    moves = () if region in NO_MOVE else MOVE_SUNDAY
    on = years.select("year", F.explode(F.array(*map(F.lit, (*NATIONAL_FIXED, *fixed)))).alias("md")).select("md", F.to_date(F.concat(F.col("year").cast("string"), F.lit("-"), "md")).alias("d"))
    moved = F.when((F.dayofweek("d") == 1) & F.col("md").isin(*moves), F.date_add("d", 1)).otherwise(F.col("d"))
    offsets = F.explode(F.array(*map(F.lit, (*NATIONAL_EASTER, *moveable))))
    from_easter = years.select(easter(F.col("year")).alias("e"), offsets.alias("o")).select(F.date_add("e", F.col("o")).alias("day"))
    return on.select(moved.alias("day")).unionByName(from_easter).distinct()


def calendar(spark: SparkSession, first_year: int, last_year: int, region: str = "ES") -> DataFrame:
    """(day, working, number, next_working): ``number`` counts the working days up
    to and including the day; ``next_working`` is the day itself or the next one."""
    start, stop = f"{first_year}-01-01", f"{last_year}-12-31"
    days = spark.range(1).select(F.explode(F.sequence(F.lit(start).cast("date"), F.lit(stop).cast("date"))).alias("day"))
    off = holidays(spark, first_year, last_year, region).withColumn("off", F.lit(True))
    marked = days.join(F.broadcast(off), "day", "left")  # some twenty rows a year
    working = ~F.dayofweek("day").isin(1, 7) & F.col("off").isNull()
    w = Window.orderBy("day")  # one region's days
    table = marked.select("day", working.alias("working"))
    return table.withColumns(
        {
            "number": F.sum(F.col("working").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)).cast("bigint"),
            "next_working": F.min(F.when(F.col("working"), F.col("day"))).over(w.rowsBetween(0, Window.unboundedFollowing)),
        }
    )


def add_working_days(rows: DataFrame, day: str, n: Column, table: DataFrame, name: str) -> DataFrame:
    """``name``: the n-th working day after (before, when negative) ``day``; the day itself for 0."""
    here = table.select(F.col("day").alias("_d"), F.col("number").alias("_n"), F.col("working").alias("_w"))
    there = table.where("working").select(F.col("number").alias("_t"), F.col("day").alias("_to"))
    steps = rows.withColumn("_k", n)
    at = steps.join(F.broadcast(here), F.col(day) == F.col("_d"), "left")  # a calendar: some hundred rows a year
    # going back from a day off, the working days before it start at its own number
    target = F.when(F.col("_k") >= 0, F.col("_n") + F.col("_k")).otherwise(F.col("_n") + F.col("_k") + F.when(F.col("_w"), 0).otherwise(1))
    found = at.withColumn("_target", target).join(F.broadcast(there), F.col("_target") == F.col("_t"), "left")
    return found.withColumn(name, F.when(F.col("_k") == 0, F.col(day)).otherwise(F.col("_to"))).drop("_k", "_d", "_n", "_w", "_target", "_t", "_to")


def working_days_between(rows: DataFrame, start: str, end: str, table: DataFrame, name: str) -> DataFrame:
    """Working days in [start, end), negative when the end comes first."""
    before = table.select("day", (F.col("number") - F.col("working").cast("int")).alias("_b"))
    a = before.withColumnsRenamed({"day": "_da", "_b": "_a"})
    joined = rows.join(F.broadcast(a), F.col(start) == F.col("_da"), "left").join(F.broadcast(before.withColumnRenamed("day", "_db")), F.col(end) == F.col("_db"), "left")
    return joined.withColumn(name, (F.col("_b") - F.col("_a")).cast("bigint")).drop("_da", "_a", "_db", "_b")


def delivers(day: Column, carrier: Column, working: Column) -> Column:
    """Working days, and Saturdays for carriers that drive then."""
    return working | ((F.dayofweek(day) == 7) & F.lower(carrier).isin(*SATURDAY_CARRIERS))
