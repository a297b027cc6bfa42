"""Text as Column expressions: folding, tokens, cleaning. All run on the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Accented Latin letters and their base letters, one to one, so
# that offsets in folded text point into the original.
ACCENTED = "áàâäãåéèêëíìîïóòôöõúùûüçñýÿ"
PLAIN = "aaaaaaeeeeiiiiooooouuuucnyy"

# Words too common to search for, folded.
STOPWORDS = tuple(
    "a al ante con de del desde el en entre es esta este la las lo los mas no o para pero por que se sin sobre su sus un una y the an and are as at be but by for from has have in is it its not of on or that this to was were will with".split()
)

TOKEN = r"[\p{L}\p{N}]+"
EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"
SPACE = r"[ \t\n\r\f\x0b]"


def fold(text: Column) -> Column:
    """Lower case without accents, one character for one."""
    return F.translate(F.lower(text), ACCENTED, PLAIN)


def tokens(text: Column) -> Column:
    """Folded runs of letters and digits."""
    return F.regexp_extract_all(fold(text), F.lit(TOKEN), F.lit(0))


def content_tokens(text: Column, least: int = 1) -> Column:
    """Tokens without stop words and words shorter than ``least``."""
    stop = F.array(*map(F.lit, STOPWORDS))
    return F.filter(tokens(text), lambda t: ~F.array_contains(stop, t) & (F.length(t) >= least))


def stem(word: Column) -> Column:
    """Light plural stem: a long word loses -es, a shorter one -s."""
    return (
        F.when((F.length(word) > 5) & word.endswith("es"), F.left(word, F.length(word) - 2))
        .when((F.length(word) > 4) & word.endswith("s"), F.left(word, F.length(word) - 1))
        .otherwise(word)
    )


def word_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(r"[^ \t\n\r\f\x0b]+"))


def useful_chars(text: Column) -> Column:
    """Letters and digits."""
    return F.length(F.regexp_replace(text, r"[^\p{L}\p{N}]", ""))


def squeeze(text: Column) -> Column:
    """White space runs as one space, ends trimmed."""
    return F.trim(F.regexp_replace(text, SPACE + "+", " "))


def slug(text: Column, most: int = 80) -> Column:
    """Folded ASCII words joined by hyphens, cut at a hyphen when one is near."""
    ascii_only = F.regexp_replace(F.replace(fold(text), F.lit("ß"), F.lit("ss")), r"[^a-z0-9]+", "-")
    whole = F.regexp_replace(ascii_only, "^-+|-+$", "")
    head = F.substring(whole, 1, most)
    shorter = F.regexp_replace(head, "-[^-]*$", "")
    cut = F.when(F.substring(whole, most + 1, 1) == "-", head).when(F.length(shorter) >= most // 2, shorter).otherwise(head)
    return F.when(F.length(whole) <= most, whole).otherwise(F.regexp_replace(cut, "^-+|-+$", ""))


def clamp(text: Column, most: int, ellipsis: str = "…") -> Column:
    """At most ``most`` characters, cut at a word end when one is in the last two fifths."""
    s = squeeze(text)
    room = most - len(ellipsis)
    cut = F.substring(s, 1, room)
    word = F.regexp_replace(cut, " [^ ]*$", "")
    best = F.when(cut.contains(" ") & (F.length(word) >= F.lit(0.6) * F.length(cut)), word).otherwise(cut)
    return F.when(F.length(s) <= most, s).otherwise(F.concat(F.regexp_replace(best, "[ ,;:.-]+$", ""), F.lit(ellipsis)))


def clean(text: Column, dehyphenate: bool = True) -> Column:
    """Line ends, invisible characters, exotic spaces, hyphenation and blank lines tidied."""
    s = F.regexp_replace(text, r"\r\n?", "\n")
    s = F.regexp_replace(s, "[\\x{0}­​‌‍⁠﻿]", "")
    s = F.regexp_replace(s, "[ \t   -   　]+", " ")
    if dehyphenate:
        s = F.regexp_replace(s, r"(\p{L})-\n(\p{Ll})", "$1$2")
    s = F.regexp_replace(s, " *\n *", "\n")
    s = F.regexp_replace(s, "\n{3,}", "\n\n")
    return F.regexp_replace(s, r"^[ \n]+|[ \n]+$", "")


def lines(text: Column) -> Column:
    """Non-blank lines."""
    return F.filter(F.split(text, "\n"), lambda x: F.length(F.trim(x)) > 0)


def unstack(text: Column) -> Column:
    """Join text that has a word a line: 20 lines or more, over 60 % of them one
    word, and a median length of 14 characters at most."""
    rows = lines(text)
    n = F.size(rows)
    single = F.size(F.filter(rows, lambda x: ~F.trim(x).contains(" ")))
    lengths = F.array_sort(F.transform(rows, lambda x: F.length(x)))
    median = F.element_at(lengths, F.floor(n / 2).cast("int") + 1)
    stacked = (n >= 20) & (single / n > 0.6) & (F.when(n > 0, median) <= 14)
    return F.when(stacked, F.trim(F.regexp_replace(text, SPACE + "*\n+" + SPACE + "*", " "))).otherwise(text)


def line_key(line: Column) -> Column:
    """A line's identity across pages: trimmed, lower case, numbers as #."""
    return F.regexp_replace(F.lower(F.trim(line)), "[0-9]+", "#")


def excerpt(text: Column, most: int = 280) -> Column:
    """The first line of 80 characters or more with sentence punctuation, else the start."""
    good = F.filter(F.transform(F.split(text, "\n"), lambda x: F.trim(x)), lambda x: (F.length(x) >= 80) & x.rlike("[.!?…]"))
    return clamp(F.coalesce(F.get(good, F.lit(0)), text), most)


def mask_emails(text: Column) -> Column:
    return F.regexp_replace(text, EMAIL, "<EMAIL>")


def jaccard(a: Column, b: Column) -> Column:
    """Overlap of two arrays as sets; 0 when both are empty."""
    union = F.size(F.array_union(a, b))
    return F.when(union > 0, F.size(F.array_intersect(a, b)) / union).otherwise(F.lit(0.0))


def trigrams(text: Column) -> Column:
    """Distinct three-character pieces of the squeezed folded text."""
    s = squeeze(fold(text))
    starts = F.sequence(F.lit(1), F.greatest(F.length(s) - 2, F.lit(1)))
    return F.array_distinct(F.transform(starts, lambda i: F.substring(s, i, F.lit(3))))
