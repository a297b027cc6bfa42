"""Clocks and dates as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def clock(seconds: Column) -> Column:
    """m:ss, or h:mm:ss from an hour on."""
    s = seconds.cast("bigint")
    two = lambda n: F.lpad(n.cast("string"), 2, "0")
    hours, minutes = F.floor(s / 3600), F.floor(s % 3600 / 60)
    head = F.when(hours > 0, F.concat(hours.cast("string"), F.lit(":"), two(minutes))).otherwise(minutes.cast("string"))
    return F.concat(head, F.lit(":"), two(s % 60))


def parse_clock(text: Column) -> Column:
    """Seconds of s, m:ss or h:mm:ss; null for anything else."""
    parts = F.transform(F.split(text, ":"), lambda p: p.try_cast("bigint"))
    total = F.aggregate(parts, F.lit(0).cast("bigint"), lambda a, p: a * 60 + p)
    return F.when(text.rlike(r"^\d+(:[0-5]?\d){0,2}$"), total)


def quiet(minute: Column, start: int, stop: int) -> Column:
    """Whether a minute of the day lies in [start, stop), a span that may pass midnight."""
    return (minute >= start) & (minute < stop) if start <= stop else (minute >= start) | (minute < stop)


def rolled_forward(day: Column, months: int, today: Column) -> Column:
    """The first day after ``today`` in steps of ``months``, each step clamped from
    the one before (31 Jan, 29 Feb, 29 Mar)."""
    steps = F.sequence(F.lit(1), F.greatest(F.ceil(F.months_between(today, day) / months).cast("int") + 2, F.lit(1)))
    return F.when(day > today, day).otherwise(F.aggregate(steps, day, lambda d, i: F.when(d > today, d).otherwise(F.add_months(d, months))))


def nearest_year(month: Column, number: Column, today: Column) -> Column:
    """The date of that month and day nearest to today among last, this and next year."""
    days = F.array(*[F.try_to_date(F.concat_ws("-", (F.year(today) + k).cast("string"), month.cast("string"), number.cast("string")), "y-M-d") for k in (-1, 0, 1)])
    ranked = F.array_sort(F.transform(F.filter(days, lambda d: d.isNotNull()), lambda d: F.struct(F.abs(F.datediff(d, today)).alias("gap"), d.alias("d"))))
    return F.get(ranked, F.lit(0))["d"]


def parse_iso(text: Column) -> Column:
    """The date of an ISO day at the start of a text, null if there is none."""
    return F.regexp_extract(text, r"^(\d{4}-\d{2}-\d{2})", 1).try_cast("date")


# Month names by their first letters in English, Spanish and French.
MONTHS = {name: i for names in ("jan feb mar apr may jun jul aug sep oct nov dec", "ene feb mar abr may jun jul ago sep oct nov dic", "jan fev mar avr mai jun jul aou sep oct nov dec") for i, name in enumerate(names.split(), 1)}


def month_number(name: Column) -> Column:
    """1 to 12 of a month name in one of three languages, null if unknown."""
    from .text import fold

    table = F.create_map(*[F.lit(x) for pair in MONTHS.items() for x in pair])
    folded = fold(name)
    special = F.when(folded.startswith("juil"), 7).when(folded.startswith("juin"), 6)
    return F.coalesce(special, F.try_element_at(table, F.left(folded, F.lit(3))))


def to_utc(text: Column) -> Column:
    """A timestamp from RFC 822 or ISO text."""
    bare = F.regexp_replace(F.regexp_replace(text, r"^[A-Za-z]{3}, *", ""), r" (GMT|UTC?|Z)$", " +0000")
    return F.coalesce(F.try_to_timestamp(bare, F.lit("d MMM yyyy HH:mm:ss xx")), F.try_to_timestamp(text))


# Spoken days and numbers in Spanish and English, folded.
WEEKDAYS = {"lunes": 1, "monday": 1, "martes": 2, "tuesday": 2, "miercoles": 3, "wednesday": 3, "jueves": 4, "thursday": 4, "viernes": 5, "friday": 5, "sabado": 6, "saturday": 6, "domingo": 7, "sunday": 7}
SPOKEN_NUMBERS = {"un": 1, "una": 1, "one": 1, "a": 1, "dos": 2, "two": 2, "tres": 3, "three": 3, "cuatro": 4, "four": 4, "cinco": 5, "five": 5, "seis": 6, "six": 6, "diez": 10, "ten": 10, "quince": 15}


def spoken(text: Column, today: Column) -> Column:
    """The day that a phrase means: today, tomorrow, in n days, weeks or months, a
    weekday (the next one), the end of the month; null if none."""
    from .text import fold

    s = fold(text)
    lookup = lambda table, word: F.try_element_at(F.create_map(*[F.lit(x) for pair in table.items() for x in pair]), word)
    count = r"\b(?:en|dentro de|in)\s+(\d+|[a-z]+)\s+(dia|day|semana|week|mes|month)"
    word = F.regexp_extract(s, count, 1)
    n = F.coalesce(word.try_cast("int"), lookup(SPOKEN_NUMBERS, word))
    unit = F.regexp_extract(s, count, 2)
    later = F.when(unit.isin("dia", "day"), F.date_add(today, n)).when(unit.isin("semana", "week"), F.date_add(today, n * 7)).when(unit.isin("mes", "month"), F.add_months(today, n))
    weekday = lookup(WEEKDAYS, F.regexp_extract(s, r"\b(" + "|".join(WEEKDAYS) + r")\b", 1))
    ahead = F.pmod(weekday - 1 - F.weekday(today), F.lit(7))
    return (
        F.when(s.rlike(r"pasado manana|day after tomorrow"), F.date_add(today, 2))
        .when(s.rlike(r"\bmanana\b|tomorrow"), F.date_add(today, 1))
        .when(s.rlike(r"\bhoy\b|\btoday\b"), today)
        .when(n.isNotNull() & (unit != ""), later)
        .when(s.rlike(r"fin de mes|end of the month"), F.last_day(today))
        .when(weekday.isNotNull(), F.date_add(today, F.when(ahead == 0, 7).otherwise(ahead).cast("int")))
    )


# Seconds of the units that an age is said in, folded; a month has 30 days, a year 365.
AGE_UNITS = {
    1: "s sec secs second seconds seg segundo segundos",
    60: "m min mins minute minutes minuto minutos",
    3600: "h hr hrs hour hours hora horas",
    86400: "d day days dia dias",
    604800: "w week weeks semana semanas",
    2592000: "mo month months mes meses",
    31536000: "y year years ano anos",
}


def since(text: Column, now: Column) -> Column:
    """The moment (without a time zone, UTC) from which a phrase counts: epoch
    seconds, an ISO date or time, an age ("2h", "hace 3 dias", "1.5 weeks ago"), "last
    hour", or a named day, week or month. ``now`` is a timestamp without a time zone;
    null where the phrase can't be read."""
    from .text import fold

    s = F.regexp_replace(F.trim(fold(text)), r"\s+", " ")
    seconds = F.create_map(*[F.lit(x) for n, words in AGE_UNITS.items() for word in words.split() for x in (word, n)])
    back = lambda n: now - F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), n.cast("decimal(18,6)"))
    age = r"^(?:(?:hace|last) )?(\d+(?:[.,]\d+)?) ?([a-z]+)(?: ago)?$"
    count = F.translate(F.regexp_extract(s, age, 1), ",", ".").try_cast("double")
    unit = F.try_element_at(seconds, F.regexp_extract(s, age, 2))
    last = F.try_element_at(seconds, F.regexp_extract(s, r"^(?:(?:la|el|the) )?(?:ultim[ao]|last|past) ([a-z]+)$", 1))
    iso = r"^(\d{4}-\d\d-\d\d(?:[t ][\d:.]+)?)(z|[+-]\d\d:?\d\d)?$"
    zone = F.regexp_extract(s, iso, 2)
    minutes = F.substring(zone, 2, 2).try_cast("int") * 60 + F.right(zone, F.lit(2)).try_cast("int")
    east = F.when(zone.isin("", "z"), 0).when(zone.startswith("-"), -minutes).otherwise(minutes)
    written = F.upper(F.regexp_extract(s, iso, 1)).try_cast("timestamp_ntz") - F.make_dt_interval(F.lit(0), F.lit(0), east)
    epoch = F.lit("1970-01-01").cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), s.try_cast("decimal(18,6)"))
    day = F.to_date(now)
    at = lambda d, hours=0: d.cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), F.lit(hours))
    return (
        F.when(s.rlike(r"^\d{9,}(\.\d+)?$"), epoch)
        .when(s.rlike(iso), written)
        .when(s.isin("hoy", "today"), at(day))
        .when(s.isin("ayer", "yesterday"), at(F.date_sub(day, 1)))
        .when(s.isin("esta manana", "this morning"), at(day, 6))
        .when(s.isin("esta semana", "this week"), at(F.trunc(day, "week")))
        .when(s.isin("este mes", "this month"), at(F.trunc(day, "month")))
        .when(s.isin("la semana pasada", "last week"), back(F.lit(604800)))
        .when(s.isin("el mes pasado", "last month"), back(F.lit(2592000)))
        .when(last.isNotNull(), back(last))
        .when(unit.isNotNull(), back(count * unit))
    )
