"""HTML and Markdown snippets as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The named references that a plain text needs, & last.
NAMED = (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"), ("&nbsp;", " "), ("&amp;", "&"))


def decode_entities(text: Column, named: tuple = NAMED) -> Column:
    for name, char in named:
        text = F.replace(text, F.lit(name), F.lit(char))
    return text


def strip_tags(html: Column) -> Column:
    bare = F.regexp_replace(html, r"(?is)<(script|style|noscript)[^>]*>.*?</\1>|<!--.*?-->", " ")
    return F.regexp_replace(bare, "(?s)<[^>]*>", " ")


def title(html: Column, named: tuple = NAMED, squeezed: bool = True) -> Column:
    """The first title element, with its ``named`` references decoded."""
    text = decode_entities(F.regexp_extract(html, "(?is)<title[^>]*>(.*?)</title>", 1), named)
    return F.trim(F.regexp_replace(text, r"[ \t\n\r\f\x0b]+", " ") if squeezed else text)


def language(html: Column, strict: bool = False) -> Column:
    """The language that a page names; ``strict``: in small letters and double quotes."""
    return F.lower(F.regexp_extract(html, '<html[^>]*lang="([a-z-]+)' if strict else "(?i)<html[^>]*lang=[\"']?([a-zA-Z-]+)", 1))


def markdown_to_text(text: Column) -> Column:
    """Fences, images, links, emphasis, headings, quotes and list marks removed."""
    s = F.regexp_replace(text, r"(?m)^```.*$", "")
    s = F.regexp_replace(s, r"!\[([^\]]*)\]\([^)]*\)", "$1")
    s = F.regexp_replace(s, r"\[([^\]]*)\]\([^)]*\)", "$1")
    s = F.regexp_replace(s, r"(?m)^ {0,3}(#{1,6}|>|[-*+]|\d+\.)[ \t]+", "")
    s = F.regexp_replace(s, r"(\*\*|__|`)", "")
    return F.trim(F.regexp_replace(s, r"\n{3,}", "\n\n"))
