"""Identifiers with check digits, addresses, phones: Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Check letters of Spanish ids, IBAN lengths, dialling codes.
DNI_LETTERS = "TRWAGMYFPDXBNJZSQVHLCKE"
CIF_LETTERS = "JABCDEFGHI"
IBAN_LENGTHS = {"ES": 24, "FR": 27, "DE": 22, "IT": 27, "PT": 25, "GB": 22, "NL": 18, "BE": 16, "IE": 22, "CH": 21, "AT": 20, "LU": 20}
DIAL_CODES = {"ES": "34", "FR": "33", "PT": "351", "IT": "39", "DE": "49", "GB": "44", "UK": "44", "US": "1", "MX": "52", "AR": "54", "NL": "31", "BE": "32", "IE": "353", "CH": "41"}


def _digits(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[ \-.]", "")


def _chars(text: Column) -> Column:
    return F.transform(F.sequence(F.lit(1), F.greatest(F.length(text), F.lit(1))), lambda i: F.substring(text, i, F.lit(1)))


def _number(char: Column) -> Column:
    return F.coalesce(char.try_cast("int"), F.lit(0))


def luhn_ok(text: Column, least: int = 12, most: int = 19) -> Column:
    s = _digits(text)
    return s.rlike(rf"^[0-9]{{{least},{most}}}$") & F.call_function("luhn_check", s)


def ean_ok(text: Column) -> Column:
    """GTIN of 8, 12, 13 or 14 digits."""
    s = _digits(text)
    body = _chars(F.reverse(F.left(s, F.greatest(F.length(s) - 1, F.lit(0)))))
    total = F.aggregate(F.transform(body, lambda c, i: _number(c) * F.when(i % 2 == 0, 3).otherwise(1)), F.lit(0), lambda a, x: a + x)
    return s.rlike(r"^([0-9]{8}|[0-9]{12,14})$") & ((10 - total % 10) % 10 == _number(F.right(s, F.lit(1))))


def isbn_ok(text: Column) -> Column:
    s = F.upper(_digits(text))
    total = F.aggregate(F.transform(_chars(s), lambda c, i: (10 - i) * F.when(c == "X", 10).otherwise(_number(c))), F.lit(0), lambda a, x: a + x)
    return (s.rlike("^97[89][0-9]{10}$") & ean_ok(s)) | (s.rlike("^[0-9]{9}[0-9X]$") & (total % 11 == 0))


def iban_ok(text: Column) -> Column:
    s = F.upper(_digits(text))
    moved = F.concat(F.substring(s, 5, 100), F.left(s, F.lit(4)))
    value = lambda c: F.when(c.rlike("[0-9]"), _number(c)).otherwise(F.ascii(c) - 55)
    rest = F.aggregate(_chars(moved), F.lit(0), lambda a, c: F.when(value(c) > 9, (a * 100 + value(c)) % 97).otherwise((a * 10 + value(c)) % 97))
    want = F.element_at(F.create_map(*[F.lit(x) for pair in IBAN_LENGTHS.items() for x in pair]), F.left(s, F.lit(2)))
    fits = F.when(want.isNotNull(), F.length(s) == want).otherwise(F.length(s).between(15, 34))
    return s.rlike("^[A-Z]{2}[0-9]{2}[A-Z0-9]+$") & fits & (rest == 1)


def _letter(number: Column) -> Column:
    return F.substring(F.lit(DNI_LETTERS), (number % 23 + 1).cast("int"), F.lit(1))


def dni_ok(text: Column) -> Column:
    s = F.upper(_digits(text))
    return s.rlike("^[0-9]{7,8}[A-Z]$") & (_letter(F.regexp_extract(s, "^([0-9]+)", 1).try_cast("int")) == F.right(s, F.lit(1)))


def nie_ok(text: Column) -> Column:
    s = F.upper(_digits(text))
    number = (F.instr(F.lit("XYZ"), F.left(s, F.lit(1))) - 1) * 10_000_000 + F.substring(s, 2, 7).try_cast("int")
    return s.rlike("^[XYZ][0-9]{7}[A-Z]$") & (_letter(number) == F.right(s, F.lit(1)))


def cif_ok(text: Column) -> Column:
    s = F.upper(_digits(text))
    twice = lambda d: F.floor(d * 2 / 10) + d * 2 % 10
    digits = F.transform(_chars(F.substring(s, 2, 7)), lambda c, i: F.when(i % 2 == 0, twice(_number(c))).otherwise(_number(c)).cast("int"))
    digit = ((10 - F.aggregate(digits, F.lit(0), lambda a, x: a + x) % 10) % 10).cast("int")
    letter, control, kind = F.substring(F.lit(CIF_LETTERS), digit + 1, F.lit(1)), F.right(s, F.lit(1)), F.left(s, F.lit(1))
    as_digit, as_letter = control == digit.cast("string"), control == letter
    good = F.when(kind.isin(*"PQRSNW"), as_letter).when(kind.isin(*"ABEH"), as_digit).otherwise(as_digit | as_letter)
    return s.rlike("^[ABCDEFGHJNPQRSUVW][0-9]{7}[0-9A-J]$") & good


def nif_ok(text: Column) -> Column:
    s = F.upper(_digits(text))
    special = s.rlike("^[KLM][0-9]{7}[A-Z]$") & (_letter(F.substring(s, 2, 7).try_cast("int")) == F.right(s, F.lit(1)))
    return dni_ok(s) | nie_ok(s) | cif_ok(s) | special


def normalize_email(text: Column) -> Column:
    """Lower case, display name and +tag dropped, Gmail dots ignored; '' if none."""
    inner = F.regexp_extract(text, "<([^<>]+)>", 1)
    s = F.lower(F.trim(F.when(inner != "", inner).otherwise(F.coalesce(text, F.lit("")))))
    s = F.regexp_replace(s, "^mailto:", "")
    domain = F.regexp_replace(F.regexp_extract(s, "@(.*)$", 1), r"^\.+|\.+$", "")
    local = F.regexp_replace(F.regexp_extract(s, "^([^@]*)@", 1), r"\+.*$", "")
    gmail = domain.isin("gmail.com", "googlemail.com")
    local, domain = F.when(gmail, F.replace(local, F.lit("."), F.lit(""))).otherwise(local), F.when(gmail, "gmail.com").otherwise(domain)
    return F.when((F.regexp_count(s, F.lit("@")) == 1) & (local != "") & domain.contains("."), F.concat(local, F.lit("@"), domain)).otherwise("")


def normalize_phone(text: Column, region: str = "ES") -> Column:
    """+ and digits; a national number gets the region's code; '' when too short."""
    s = F.trim(F.coalesce(text, F.lit("")))
    digits = F.regexp_replace(s, "[^0-9]", "")
    wide = s.startswith("+") | s.startswith("00")
    digits = F.when(s.startswith("00"), F.substring(digits, 3, 40)).otherwise(digits)
    code = DIAL_CODES.get(region.upper(), "")
    national = digits if not code else F.concat(F.lit("+" + code), digits if code == "39" else F.regexp_replace(digits, "^0+", ""))
    if code == "34":
        national = F.when((F.length(digits) == 11) & digits.startswith("34"), F.concat(F.lit("+"), digits)).otherwise(national)
    return F.when(F.length(digits) < 6, "").when(wide, F.concat(F.lit("+"), digits)).otherwise(national)


def domain_of(text: Column) -> Column:
    """Host of a URL or domain of an address, lower case, no www."""
    from .urls import site_of

    s = F.trim(F.coalesce(text, F.lit("")))
    return F.when(s.contains("@") & ~s.contains("://"), F.lower(F.regexp_extract(s, "@([^@>]+)>?$", 1))).otherwise(site_of(s))


ASIN = r"/(?:dp|gp/product|gp/aw/d|product-reviews|exec/obidos/asin)/([A-Za-z0-9]{10})(?:[^A-Za-z0-9]|$)"


def asin(text: Column) -> Column:
    """The first product number of a shop link, else a bare one; '' if none."""
    found = F.upper(F.regexp_extract(text, ASIN, 1))
    return F.when(found != "", found).otherwise(F.regexp_extract(text, r"(?:^|[^A-Za-z0-9])(B0[A-Z0-9]{8})(?:[^A-Za-z0-9]|$)", 1))


def eans(text: Column) -> Column:
    """Distinct digit runs with a valid GS1 check digit."""
    runs = F.regexp_extract_all(text, F.lit("[0-9]+"), F.lit(0))
    return F.array_distinct(F.filter(runs, ean_ok))
