"""Citation texts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words of a citation by language.
WORDS = {"en": {"page": "p. ", "line": "line ", "turn": "turn ", "slide": "slide ", "chapter": "chapter "}, "es": {"page": "pág. ", "line": "línea ", "turn": "turno ", "slide": "diapositiva ", "chapter": "capítulo "}}


def cite(kind: Column, title: Column, *, page: Column | None = None, section: Column | None = None, line: Column | None = None, turn: Column | None = None, site: Column | None = None, date: Column | None = None, lang: str = "en") -> Column:
    """Title and what locates the passage, as far as known; empty parts are left out."""
    words = WORDS[lang]

    def numbered(word: str, value: Column | None) -> Column:
        return F.lit(None).cast("string") if value is None else F.when(value.isNotNull(), F.concat(F.lit(words[word]), value.cast("string")))

    def plain(value: Column | None) -> Column:
        return F.lit(None).cast("string") if value is None else F.when(F.length(value.cast("string")) > 0, value.cast("string"))

    where = F.when(kind == "pptx", numbered("slide", page)).when(kind == "epub", numbered("chapter", page)).otherwise(numbered("page", page))
    return F.concat_ws(", ", title, plain(site), plain(section), where, numbered("line", line), numbered("turn", turn), plain(date))
