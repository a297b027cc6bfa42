"""Folders as tables: scans with globs, kinds by extension and by content."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Kinds by extension.
KINDS = {
    "pdf": "pdf", "docx": "docx", "pptx": "pptx", "xlsx": "xlsx", "odt": "odt", "epub": "epub", "rtf": "rtf", "eml": "eml", "md": "md", "markdown": "md", "txt": "txt", "text": "txt", "log": "txt",
    "html": "html", "htm": "html", "xhtml": "html", "csv": "csv", "tsv": "csv", "json": "txt", "xml": "txt", "srt": "subs", "vtt": "subs", "ics": "ics",
}
CODE = ("py", "js", "ts", "java", "scala", "go", "rs", "c", "cpp", "h", "sql", "sh")
#: Kinds by the first bytes in hexadecimal.
MAGIC = (("pdf", "25504446"), ("zip", "504B0304"), ("image", "89504E47"), ("image", "FFD8FF"), ("image", "47494638"), ("rtf", "7B5C727466"), ("ole", "D0CF11E0"), ("gzip", "1F8B"), ("sqlite", "53514C69746520666F726D6174"), ("parquet", "50415231"))


#: Where Windows-1252 differs from Latin-1: the code points and their characters.
_DEFINED = [b for b in range(128, 160) if bytes([b]).decode("cp1252", "ignore")]
CP1252 = "".join(map(chr, _DEFINED)), bytes(_DEFINED).decode("cp1252")


def glob_regex(pattern: str) -> str:
    """A case-insensitive regular expression of a glob: ``**/`` any folders, ``**``
    anything, ``*`` and ``?`` inside a name."""
    out, i = "", 0
    while i < len(pattern):
        if pattern.startswith("**/", i):
            out, i = out + "(?:.*/)?", i + 3
        elif pattern.startswith("**", i):
            out, i = out + ".*", i + 2
        else:
            c = pattern[i]
            out, i = out + {"*": "[^/]*", "?": "[^/]"}.get(c, re.escape(c)), i + 1
    return f"(?i)^{out}$"


def accepts(path: Column, include: list[str], exclude: list[str]) -> Column:
    """Whether a relative path is wanted: an exclude wins, no include takes all."""
    any_of = lambda globs: path.rlike("|".join(glob_regex(g) for g in globs))
    wanted = any_of(include) if include else F.lit(True)
    return wanted & ~any_of(exclude) if exclude else wanted


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"[^/]\.([A-Za-z0-9]{1,8})$", 1))


def kind_of(path: Column, code: bool = False) -> Column:
    """The kind that an extension names, '' for none; code counts when asked for."""
    table = F.create_map(*[F.lit(x) for pair in (KINDS | ({e: "code" for e in CODE} if code else {})).items() for x in pair])
    return F.coalesce(F.try_element_at(table, extension(path)), F.lit(""))


def sniffed(path: Column, content: Column) -> Column:
    """The kind of a file by its first bytes, which beat its name."""
    head = F.hex(F.substring(content, 1, 16))
    out = None
    for kind, magic in MAGIC:
        found = head.startswith(magic)
        value = F.when(F.lit(kind == "zip") & extension(path).isin("docx", "pptx", "xlsx", "odt", "epub"), extension(path)).otherwise(kind)
        out = F.when(found, value) if out is None else out.when(found, value)
    text = F.decode(F.substring(content, 1, 1000), "ISO-8859-1")
    html = F.lower(text).rlike(r"^\s*(<!doctype html|<html)")
    marked = head.startswith("FFFE") | head.startswith("FEFF")  # UTF-16 or UTF-32, whose zero bytes are text
    return out.when(html, "html").when(kind_of(path) != "", kind_of(path)).when(~marked & (F.instr(text, "\x00") > 0), "binary").otherwise("txt")


def decoded(content: Column) -> Column:
    """Text of bytes: UTF-8 if valid (its mark dropped), UTF-16 by its mark, else Windows-1252."""
    head = F.hex(F.substring(content, 1, 2))
    utf8 = F.regexp_replace(F.decode(content, "UTF-8"), "^﻿", "")
    valid = F.call_function("is_valid_utf8", content.cast("string"))
    western = F.translate(F.decode(content, "ISO-8859-1"), *CP1252)
    return F.when(head.isin("FFFE", "FEFF"), F.decode(content, "UTF-16")).when(valid, utf8).otherwise(western)


def scan(spark: SparkSession, folder: str, include: list[str] = [], exclude: list[str] = []) -> DataFrame:  # noqa: B006
    """(path, rel, size, modified, content, kind) of the wanted files below a folder.
    Names and kinds are filtered before any content is read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    root = folder.split("://")[-1].rstrip("/")
    rel = F.regexp_replace(F.col("path"), f"^.*{re.escape(root)}/", "")
    kinds = files.select("path", rel.alias("rel"), F.col("length").alias("size"), F.col("modificationTime").alias("modified"), "content")
    return kinds.where(accepts(F.col("rel"), include, exclude) & (kind_of(F.col("rel")) != "")).withColumn("kind", kind_of(F.col("rel")))


def watch(spark: SparkSession, folder: str, most: int = 200) -> DataFrame:
    """The files of a folder as a stream, at most ``most`` a trigger; what was seen
    is the stream's checkpoint."""
    return spark.readStream.format("binaryFile").option("recursiveFileLookup", "true").option("maxFilesPerTrigger", most).load(folder)


def stored(rows: DataFrame, content: str, extension: str) -> DataFrame:
    """(sha, path, bytes, refs) of a store by content: one row a distinct content, at
    a path that its hash gives. Only hashes and sizes are shuffled."""
    put = rows.where(F.col(content).isNotNull()).select(F.sha2(content, 256).alias("sha"), F.octet_length(content).cast("bigint").alias("bytes"))
    path = F.concat(F.substring("sha", 1, 2), F.lit("/"), F.col("sha"), F.lit(f".{extension}"))
    return put.groupBy("sha").agg(F.max("bytes").alias("bytes"), F.count("*").alias("refs")).select("sha", path.alias("path"), "bytes", "refs")
