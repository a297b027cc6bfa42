"""Amounts as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def decimal_mark(text: Column) -> Column:
    """Aggregate: the mark that more values of a column use before their last one or two digits."""
    comma = F.count_if(text.rlike(r",\d{1,2}$"))
    return F.when(comma >= F.count_if(text.rlike(r"\.\d{1,2}$")), ",").otherwise(".")


def parse_amount(text: Column, mark: str | None = None) -> Column:
    """A decimal(18,4) from an amount as written, null when it is none.

    Currency signs and spaces go; a minus, or parentheses, negate. With both marks
    present the last one is decimal; a mark that stands alone once is decimal
    unless three digits follow, one that repeats groups thousands. ``mark`` fixes
    the decimal mark instead.
    """
    bare = F.regexp_replace(text, r"(?i)€|\$|£|eur(os?)?|usd|gbp|[\s   ]", "")
    negative = bare.rlike(r"^-|-$|^\(.*\)$")
    s = F.regexp_replace(bare, r"[()+-]", "")
    good = s.rlike(r"^\d[\d.,']*$")
    s = F.replace(s, F.lit("'"), F.lit(""))
    as_comma = F.replace(F.replace(s, F.lit("."), F.lit("")), F.lit(","), F.lit("."))
    as_point = F.replace(s, F.lit(","), F.lit(""))
    if mark:
        plain = as_comma if mark == "," else as_point
    else:
        last_comma, last_point = F.length(s) - F.instr(F.reverse(s), ","), F.length(s) - F.instr(F.reverse(s), ".")
        commas, points = F.regexp_count(s, F.lit(",")), F.regexp_count(s, F.lit(r"\."))
        plain = (
            F.when((commas > 0) & (points > 0), F.when(last_comma > last_point, as_comma).otherwise(as_point))
            .when(commas > 1, as_point)
            .when(points > 1, as_comma)
            .when((commas == 1) & s.rlike(r",\d{3}$"), as_point)
            .when(commas == 1, as_comma)
            .when((points == 1) & s.rlike(r"^\d{1,3}\.\d{3}$"), as_comma)
            .otherwise(s)
        )
    value = F.when(good, plain.try_cast("decimal(18,4)"))
    return F.when(negative, -value).otherwise(value)


def to_cents(amount: Column) -> Column:
    """Whole cents, half away from zero."""
    return F.round(amount.cast("decimal(18,6)") * 100, 0).cast("bigint")


# How currencies are written.
CURRENCIES = {
    "EUR": ("€", "eur", "euro", "euros"),
    "USD": ("us$", "$", "usd", "dolar", "dolares", "dólar", "dólares", "dollar", "dollars"),
    "GBP": ("£", "gbp"),
    "CHF": ("chf", "sfr"),
    "SEK": ("sek",),
    "DKK": ("dkk",),
    "NOK": ("nok",),
    "PLN": ("pln", "zł"),
    "CZK": ("czk", "kč"),
    "JPY": ("jpy", "¥"),
    "MXN": ("mxn", "mx$"),
    "CAD": ("cad", "ca$", "c$"),
    "AUD": ("aud", "au$", "a$"),
    "BRL": ("brl", "r$"),
    "CNY": ("cny", "rmb"),
    "INR": ("inr", "₹"),
}


def currency_of(text: Column) -> Column:
    """The code of a currency as written, '' if unknown."""
    table = F.create_map(*[F.lit(x) for code, names in CURRENCIES.items() for name in names for x in (name, code)])
    return F.coalesce(F.try_element_at(table, F.lower(F.trim(text))), F.lit(""))


def format_money(amount: Column, lang: str = "es", symbol: str = "€") -> Column:
    """1.234,50 € in Spanish, 1 234,50 € in French, €1,234.50 in English."""
    plain = F.format_number(amount, 2)
    if lang == "en":
        return F.concat(F.lit(symbol), plain)
    return F.concat(F.translate(plain, ",.", ".," if lang == "es" else " ,"), F.lit(f" {symbol}"))
