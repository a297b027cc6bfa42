"""Terms and the prefixes that they begin with, by an equi-join.

A prefix of n characters can only meet the first n characters of a term. Terms are
made distinct first, cut once for each length that the prefixes have (a handful),
and met by equality, so no pair of a term and a prefix is formed that does not
match, neither side is sent to all tasks, and a prefix with many terms costs what it
has. Null and empty prefixes begin nothing; repeated ones count once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Different lengths of prefixes.
LENGTHS = 64


def _asked(prefixes: DataFrame, prefix: str) -> tuple[DataFrame, list[int]]:
    """The distinct prefixes, and their lengths."""
    asked = prefixes.select(F.col(prefix).alias("prefix")).where("prefix <> ''").distinct()
    sizes = sorted(r[0] for r in asked.select(F.length("prefix")).distinct().limit(LENGTHS + 1).collect())
    if len(sizes) > LENGTHS:
        raise ValueError(f"prefixes have {LENGTHS} lengths at most")
    return asked, sizes


def counted(rows: DataFrame, words: Column, prefixes: DataFrame, prefix: str) -> DataFrame:
    """(prefix, rows, occurrences): in how many rows a word begins so, and how many
    words. Words are cut inside their row, and met before they are shuffled where
    Spark may broadcast the prefixes; what is shuffled is a count a prefix and task."""
    asked, sizes = _asked(prefixes, prefix)
    head = lambda n: F.transform(F.filter("_w", lambda w: F.length(w) >= n), lambda w: F.substring(w, 1, n))
    cuts = [head(n) for n in sizes]
    cut = rows.select(words.alias("_w")).select((F.concat(*cuts) if cuts else F.array().cast("array<string>")).alias("_c"))
    each = lambda c, name: cut.select(F.explode(c).alias("prefix")).join(asked, "prefix").groupBy("prefix").agg(F.count("*").alias(name))
    return each(F.array_distinct("_c"), "rows").join(each(F.col("_c"), "occurrences"), "prefix")


def beginning_with(terms: DataFrame, term: str, prefixes: DataFrame, prefix: str) -> DataFrame:
    """(prefix, term), one row each, of the distinct terms that begin so."""
    asked, sizes = _asked(prefixes, prefix)
    words = terms.select(F.col(term).alias("term")).where("term is not null").distinct()
    cuts = F.filter(F.array(*map(F.lit, sizes)).cast("array<int>"), lambda n: n <= F.length("term"))
    begins = words.select("term", F.explode(F.transform(cuts, lambda n: F.substring("term", F.lit(1), n))).alias("prefix"))
    return begins.join(asked, "prefix").select("prefix", "term")
