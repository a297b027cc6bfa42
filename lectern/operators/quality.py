"""Cleaning and quality of texts and pages."""

from __future__ import annotations

import unicodedata

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..functions import text as tx
from .grouping import repeated_values
from .slices import slices

# Phrases of pages that hide their text, and words of menus.
BLOCK_PHRASES = ("enable javascript", "captcha", "access denied", "verify you are human", "just a moment", "acceso denegado", "activa javascript", "not a robot", "checking your browser", "unusual traffic")
NAV_WORDS = tuple(
    """inicio home menú menu categorías categorias buscar búsqueda busqueda login registro registrarse cuenta
carrito cesta pedidos favoritos wishlist ayuda contacto contáctanos contactanos envíos envios devoluciones
cookies privacidad aviso legal términos terminos condiciones política politica mapa sitio newsletter suscríbete
suscribete síguenos siguenos facebook instagram twitter youtube tiktok pinterest whatsapp idioma país pais
ofertas novedades outlet tiendas blog trabaja sobre nosotros empresa prensa afiliados sign account cart search
help shipping returns terms privacy careers stores""".split()
)


def chrome_ratio(text: Column) -> Column:
    """Share of words in lines of at most four words with a menu word; 1 for no words."""
    nav = F.array(*map(F.lit, NAV_WORDS))
    lines = F.transform(F.split(F.lower(text), "\n"), lambda x: F.regexp_extract_all(x, F.lit(r"\p{L}+"), F.lit(0)))
    total = F.aggregate(lines, F.lit(0), lambda a, w: a + F.size(w))
    menu = F.aggregate(F.filter(lines, lambda w: (F.size(w) <= 4) & F.arrays_overlap(w, nav)), F.lit(0), lambda a, w: a + F.size(w))
    return F.when(total > 0, menu / total).otherwise(F.lit(1.0))


def quality(text: Column, least_words: int = 40) -> Column:
    """'' for a usable text, else what is wrong with it."""
    words = tx.word_count(text)
    head = F.lower(F.substring(text, 1, 800))
    blocked = F.lit(False)
    for p in BLOCK_PHRASES:
        blocked = blocked | head.contains(p)
    lines = tx.lines(text)
    short = F.size(F.filter(lines, lambda x: tx.word_count(x) <= 3))
    menu = (F.size(lines) > 0) & (short / F.size(lines) > 0.85) & (words < 400)
    return F.when((words < 150) & blocked, "blocked page").when(words < least_words, "too short").when(menu | (chrome_ratio(text) >= 0.6), "mostly navigation").otherwise("")


# Units of time, and shapes of what changes on a page without its
# content changing: time stamps, ages and times left, times of day, tokens of
# sessions; and beginnings of lines that say nothing else.
UNITS = "(?:segundos?|segs?|minutos?|mins?|horas?|hrs?|h|d[ií]as?|semanas?|meses|seconds?|secs?|minutes?|hours?|days?|weeks?|months?)"
VOLATILE = (
    r"\b\d{4}-\d{2}-\d{2}[t ]\d{2}:\d{2}(?::\d{2})?(?:[.,]\d+)?(?:z|[+-]\d{2}:?\d{2})?(?!\d)",
    rf"\b(?:hace|quedan?|faltan?)\s+\d+\s+{UNITS}\b|\b\d+\s+{UNITS}\s+(?:ago|left|remaining)\b|\b(?:just now|justo ahora|ahora mismo|hace un momento)\b",
    r"\b\d{1,2}:\d{2}(?::\d{2})?(?:\s?[ap]\.?m\.?)?(?!\d)",
    r"\b[0-9a-f]{16,}\b",
)
VOLATILE_LINE = r"^(?:©|\(c\)|copyright\b|hoy es\b|actualizado hace\b|updated\s+\d+\s+\w+\s+ago\b|last updated:?\s*(?:just now|\d+\s+\w+\s+ago)\b)"
#: Characters that take no place.
UNSEEN = "\u200b\u200c\ufeff"
#: Where a line ends.
LINE_END = "\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]"


@F.arrow_udf(StringType())
def _composed(texts: pa.Array) -> pa.Array:
    """Compatibility forms composed and case folded, a part of a batch at a time; the
    JVM has no expression for either."""
    made = [pa.array([None if t is None else unicodedata.normalize("NFKC", t).casefold() for t in part.column(0).to_pylist()], pa.string()) for part in slices(pa.record_batch({"text": texts}))]
    return pa.concat_arrays(made) if made else pa.array([], pa.string())


def _compatible(text: Column) -> Column:
    """What has no compatibility forms stays on the JVM."""
    own = F.length(text) == F.octet_length(text)  # ASCII
    return F.coalesce(_composed(F.when(~own, text)), F.lower(text))


def normal_lines(text: Column) -> Column:
    """Lines without what changes by itself; a null text has none."""

    def tidy(line: Column) -> Column:
        for shape in VOLATILE:
            line = F.regexp_replace(line, f"(?i){shape}", " ")
        return _one_space(line)

    lines = F.transform(F.split(_compatible(F.coalesce(text, F.lit(""))), LINE_END), lambda x: _one_space(F.translate(x, UNSEEN, "")))
    kept = F.filter(lines, lambda x: (x != "") & ~x.rlike(f"(?i){VOLATILE_LINE}"))
    return F.filter(F.transform(kept, tidy), lambda x: x != "")


def _one_space(line: Column) -> Column:
    return F.trim(F.regexp_replace(line, r"(?U)\s+", " "))


def normalise_for_hash(text: Column) -> Column:
    """``normal_lines`` as one text."""
    return F.array_join(normal_lines(text), "\n")


def content_hash(text: Column) -> Column:
    return F.sha2(normalise_for_hash(text), 256)


def without_repeated_lines(rows: DataFrame, group: str, unit: str, text: str, part: float = 0.5, longest: int = 160) -> DataFrame:
    """(group, unit, text) without the lines that stand on over ``part`` of a
    group's units (three at least)."""
    lines = rows.select(group, unit, F.posexplode(F.split(text, "\n")).alias("_i", "_line")).withColumn("_key", tx.line_key(F.col("_line")))
    short = lines.where((F.length("_key") > 0) & (F.length(F.trim("_line")) <= longest))
    often = repeated_values(short, group, unit, "_key", 3, part).select(group, "_key")
    kept = lines.join(often, [group, "_key"], "left_anti")
    gathered = kept.groupBy(group, unit).agg(F.array_sort(F.collect_list(F.struct("_i", "_line"))).alias("_l"))
    joined = rows.select(group, unit).join(gathered, [group, unit], "left")
    return joined.select(group, unit, F.coalesce(F.array_join(F.transform("_l", lambda x: x["_line"]), "\n"), F.lit("")).alias(text))


def block_reason(status: Column, text: Column) -> Column:
    """Why a fetched page has no content, '' if nothing says so."""
    s = F.lower(F.substring(text, 1, 3000))
    return (
        F.when(status == 429, "rate limited")
        .when(s.rlike("captcha|not a robot|verify you are human"), "captcha")
        .when(s.rlike("checking your browser|just a moment|unusual traffic"), "challenge")
        .when(s.rlike("enable javascript|activa javascript"), "javascript")
        .when(status.isin(401, 407), "login")
        .when(status.isin(403, 451) | s.rlike("access denied|acceso denegado"), "denied")
        .when(status.isin(404, 410), "gone")
        .when(status >= 500, "server error")
        .when(status >= 400, "refused")
        .otherwise("")
    )


def page_usable(text: Column) -> Column:
    """'' for a page with a usable text layer, else the reason it has none."""
    useful = tx.useful_chars(text)
    odd = F.length(F.regexp_replace(text, r"[\p{L}\p{N}\p{P}\p{S}\p{Z}\s]", ""))
    words = F.size(F.regexp_extract_all(text, F.lit(r"\p{L}{2,}"), F.lit(0)))
    return F.when(useful == 0, "empty").when(useful < 20, "too little text").when(odd > 0.1 * F.length(text), "garbage").when(words * 12 < useful, "no words").otherwise("")


def allowed(path: Column, rules: Column) -> Column:
    """Whether robots rules (array of struct<allow, path>) let a path be read: the
    longest matching rule decides, allow wins ties, no match allows."""

    def matches(rule: Column) -> Column:
        shape = F.regexp_replace(F.regexp_replace(rule, r"([.+?(){}\[\]^|\\])", r"\\$1"), r"\*", ".*")
        return F.concat(F.lit("^"), shape)

    fitting = F.filter(rules, lambda r: (F.length(r["path"]) > 0) & F.regexp_like(path, matches(r["path"])))
    best = F.array_max(F.transform(fitting, lambda r: F.struct(F.length(r["path"]).alias("n"), r["allow"].alias("a"))))
    return F.coalesce(best["a"], F.lit(True))
