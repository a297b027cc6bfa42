"""Scripts of SQL as statements, and statements with bound values.

A scanner of one regular expression walks a script by whole lexemes: quoted strings
and names, comments of both kinds (nested ones too), dollar-quoted texts, single
characters. A ``;`` that is a lexeme of its own ends a statement; anywhere else it is
part of one. Values never become text of a statement: they are bound by
``spark.sql(args=...)``, and names are checked or quoted.

Defined results: a script without SQL has no statements; comments before a statement
belong to it, alone they are none; what stands behind the last ``;`` is a statement;
a quote or comment that is not closed goes on to the end, and ``complete`` says so;
a null script is empty.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

_LEXEME = re.compile(
    r"(?P<line>--[^\n]*)|(?P<open>/\*)"
    r"|(?P<quoted>'(?:[^'\\]|\\.|'')*(?:'|\Z)|\"(?:[^\"\\]|\\.|\"\")*(?:\"|\Z)|`(?:[^`]|``)*(?:`|\Z))"
    r"|(?P<dollar>\$(?P<tag>\w*)\$.*?(?:\$(?P=tag)\$|\Z))"
    r"|(?P<space>\s+)|(?P<word>\w+)|(?P<mark>.)",
    re.S,
)
_CLOSED = re.compile(r"'(?:[^'\\]|\\.|'')*'|\"(?:[^\"\\]|\\.|\"\")*\"|`(?:[^`]|``)*`", re.S)
_COMMENT_MARK = re.compile(r"/\*|\*/")
_NAME = re.compile(r"[A-Za-z_][A-Za-z0-9_]*")
#: First words of statements that only read.
READING = ("select", "with", "values", "table", "from", "describe", "show", "explain")


def lexemes(script: str | None) -> Iterator[tuple[str, str]]:
    """(kind, text) of all lexemes: comment, quoted, dollar, space, word, mark."""
    script, at = script or "", 0
    while at < len(script):
        m = _LEXEME.match(script, at)
        kind, end = m.lastgroup, m.end()
        if kind == "open":
            depth = 1
            while depth and (mark := _COMMENT_MARK.search(script, end)):
                depth, end = depth + (1 if mark[0] == "/*" else -1), mark.end()
            end = end if not depth else len(script)
        kind = {"line": "comment", "open": "comment", "tag": "dollar"}.get(kind, kind)
        yield kind, script[at:end]
        at = end


def statements(script: str | None) -> list[str]:
    """The statements of a script, trimmed, without their ``;``."""
    found, held, said = [], [], False
    for kind, text in [*lexemes(script), ("mark", ";")]:
        if kind == "mark" and text == ";":
            if said:
                found.append("".join(held).strip())
            held, said = [], False
            continue
        held.append(text)
        said = said or kind not in ("comment", "space")
    return found


def complete(script: str | None) -> bool:
    """Whether all quotes and comments of a script are closed."""
    for kind, text in lexemes(script):
        if kind == "quoted" and not _CLOSED.fullmatch(text):
            return False
        if kind == "comment" and text.startswith("/*") and text.count("/*") > text.count("*/"):
            return False
        if kind == "dollar" and (tag := re.match(r"\$\w*\$", text)[0]) and (len(text) < 2 * len(tag) or not text.endswith(tag)):
            return False
    return True


def first_word(statement: str) -> str:
    return next((text.lower() for kind, text in lexemes(statement) if kind == "word"), "")


def name(text: str) -> str:
    """``text`` if it is a plain name; an error otherwise."""
    if not _NAME.fullmatch(text or ""):
        raise ValueError(f"not a plain name: {text!r}")
    return text


def quoted_name(text: str) -> str:
    """Any name, between back ticks."""
    return "`" + text.replace("`", "``") + "`"


def ask(spark: SparkSession, statement: str, values: dict | None = None, **tables: DataFrame) -> DataFrame:
    """The rows of one reading statement: values bound by name (``:day``), tables
    given by ``{name}``."""
    if not complete(statement):
        raise ValueError("a quote or comment is not closed")
    found = statements(statement)
    if len(found) != 1:
        raise ValueError(f"one statement is asked at a time, not {len(found)}")
    if first_word(found[0]) not in READING:
        raise ValueError(f"a statement that only reads is asked, not {first_word(found[0]) or found[0][:20]!r}")
    views = {n: name(n) for n in tables}
    for n, frame in tables.items():
        frame.createOrReplaceTempView(n)
    return spark.sql(found[0].format(**views) if tables else found[0], args=values or {})
