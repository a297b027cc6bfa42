"""Lines, paragraphs and outlines from placed text runs, by windows over a page.

Runs of one height are a line; lines whose distance exceeds the usual one of their
file begin a paragraph; lines that are larger than what most of a file is set in
head a part. Usual distance and size are medians and modes of a file. A file is read
in one task, so its runs are dealt by file once, and every window over a page or a
file works where they lie: nothing is read twice or joined. Defined results: runs
without text are left out; a file of one line has one paragraph and no outline; what
is level one is the largest size, within a tenth; files without a key are one file.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Heights (of a line's size) within which runs share it, distances (of the usual
#: one) that part paragraphs, sizes (of the usual one) that head.
SAME_LINE, APART, LARGER, LEVEL = 0.4, 1.4, 1.15, 0.9
#: Characters of a heading at most.
LONGEST = 120


def lines(runs: DataFrame, key: str) -> DataFrame:
    """(key, page, line, y, size, text) of runs (key, page, run, x, y, size, text)."""
    w = Window.partitionBy(key, "page").orderBy(F.desc("y"), "x", "run")
    said = runs.where(F.trim("text") != "").repartition(F.col(key))
    starts = F.coalesce((F.lag("y").over(w) - F.col("y") > SAME_LINE * F.col("size")), F.lit(True)).cast("int")
    marked = said.withColumn("_starts", starts)
    numbered = marked.withColumn("line", F.sum("_starts").over(w))
    part = F.struct("x", "run", "text", "y", "size")
    grouped = numbered.groupBy(key, "page", "line").agg(F.array_sort(F.collect_list(part)).alias("_p"))
    return grouped.select(key, "page", "line", F.array_max(F.transform("_p", lambda p: p["y"])).alias("y"), F.array_max(F.transform("_p", lambda p: p["size"])).alias("size"), F.array_join(F.transform("_p", lambda p: p["text"]), " ").alias("text"))


def paragraphs(found: DataFrame, key: str) -> DataFrame:
    """(key, page, paragraph, text) of ``lines``."""
    w = Window.partitionBy(key, "page").orderBy("line")
    before = F.lag("size").over(w)
    gaps = found.select(key, "page", "line", "text", (F.lag("y").over(w) - F.col("y")).alias("_gap"), (F.abs(F.col("size") - before) > 0.1 * before).alias("_resized"))
    usual = F.percentile_approx(F.when(F.col("_gap") > 0, F.col("_gap")), 0.5).over(Window.partitionBy(key))
    starts = F.col("_gap").isNull() | (F.col("_gap") > APART * F.col("_usual")) | F.col("_resized")
    numbered = gaps.withColumn("_usual", usual).withColumn("_starts", starts.cast("int")).withColumn("paragraph", F.sum("_starts").over(w))
    grouped = numbered.groupBy(key, "page", "paragraph").agg(F.array_sort(F.collect_list(F.struct("line", "text"))).alias("_l"))
    return grouped.select(key, "page", "paragraph", F.array_join(F.transform("_l", lambda x: x["text"]), "\n").alias("text"))


def outline(found: DataFrame, key: str) -> DataFrame:
    """(key, page, line, level, title) of the lines that head a part."""
    weighed = found.withColumn("_n", F.sum(F.length("text")).over(Window.partitionBy(key, "size")))
    of_file = Window.partitionBy(key)
    told = weighed.withColumns({"_usual": F.max_by("size", F.struct("_n", -F.col("size"))).over(of_file), "_largest": F.max("size").over(of_file)})
    larger = told.where((F.col("size") >= LARGER * F.col("_usual")) & (F.length("text") <= LONGEST))
    return larger.select(key, "page", "line", F.when(F.col("size") >= LEVEL * F.col("_largest"), 1).otherwise(2).alias("level"), F.trim("text").alias("title"))
