"""Mixing sources to target weights, on DataFrames only.

Source token shares p are exponentiated (temperature mixing): weight = p^a / sum
p^a. The exponent is bisected (``SECTIONS`` trial values a pass, one aggregate
each) to the largest value whose normalised entropy reaches a target, or to the
smallest whose most repeated source stays within a repetition limit.

A source's share of the token budget is taken as block permutations: whole
passes over the source, then blocks (4096 a source, by a hash of the id) in
hashed order until the budget ends inside one block, of which documents follow
in hashed order while they fit. The plan is one row a source with three
thresholds, so no prefix sum runs over a source's documents, hot or not: only
block totals and the one boundary block of a source are put in order. Whether a
document is taken is then an expression over its own columns and its source's
row, which is broadcast only when the sources' count and bytes are below a
bound; otherwise large sources are joined apart, so that none is one task's.

Defined results: tokens are white-space separated words; a null or empty text has
none; very long texts count whole; a null source is the source ''; sources
without tokens take no budget and keep each row once; a null id hashes as '';
rows with one id, and rows of equal hash, go together; an empty table stays
empty; extra columns pass through, whatever their names.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import fresh, join_groups, materialise

WORD = r"[^\x20\x09-\x0D]+"
SECTIONS = 16
PASSES = 8
#: The exponent is sought between 0 (equal weights) and this.
STEEPEST = 4.0
#: Weights are rounded to so many decimals before the budget is dealt out.
DECIMALS = 6
SEED = "mix"
#: Bounds of a plan that is broadcast.
PLAN_ROWS, PLAN_BYTES = 50_000, 8 << 20


def n_tokens() -> Column:
    return F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("bigint")


def _source() -> Column:
    return F.coalesce(F.col("source").cast("string"), F.lit(""))


def _place(seed: str) -> Column:
    """A document's place in its source: hex digits, the first three its block."""
    return F.md5(F.concat(F.lit(f"{seed}|"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))


def _turn(seed: str, source: Column, block: Column) -> Column:
    """A block's place in the permutation of its source."""
    return F.md5(F.concat_ws("|", F.lit(seed), source, block))


def exponent(shares: DataFrame, entropy: float | None, repetition: float | None) -> float:
    """The mixing exponent for ``shares`` (p > 0, summing to 1)."""

    def seek(measure: Column, holds, low: float, high: float, first: bool) -> float:
        """The edge of ``holds`` in [low, high]: it holds from the edge on
        (``first``) or up to it."""
        for _ in range(PASSES):
            width = (high - low) / SECTIONS
            tries = F.explode(F.array(*[F.lit(low + i * width) for i in range(1, SECTIONS)])).alias("a")
            powers = shares.select("p", tries).withColumn("q", F.pow("p", "a"))
            rows = {r["a"]: r["m"] for r in powers.groupBy("a").agg(measure.alias("m")).collect()}
            good = [a for a in sorted(rows) if holds(rows[a])]
            if first:
                high = good[0] if good else high
                low = high - width
            else:
                low = good[-1] if good else low
                high = low + width
        return high if first else low

    found = 1.0
    if entropy is not None:
        # H = ln Z - sum q ln q / Z, over ln(number of sources)
        z = F.sum("q")
        measure = (F.log(z) - F.sum(F.col("q") * F.log("q")) / z) / F.greatest(F.log(F.count("*").cast("double")), F.lit(1e-12))
        found = seek(measure, lambda h: h >= entropy, 0.0, STEEPEST, first=False)
    if repetition is not None:
        # passes are in proportion to q / p; the most repeated against the least
        ratio = F.max(F.col("q") / F.col("p")) / F.min(F.col("q") / F.col("p"))
        least = seek(ratio, lambda r: r <= repetition, 0.0, 1.0, first=True)
        found = least if entropy is None else max(found, least)
    return found


def plan(docs: DataFrame, entropy: float | None = None, repetition: float | None = None, budget: int | None = None, cover: bool = False, seed: str = SEED) -> tuple[DataFrame, DataFrame]:
    """(rows without texts, one row a source). ``budget``: tokens to take, all of
    the corpus by default; ``cover``: the least that takes every source whole."""
    slim = materialise(docs.select("doc_id", _source().alias("s"), n_tokens().alias("n_tokens"), _place(seed).alias("h")), "mix_rows")
    sources = materialise(slim.groupBy("s").agg(F.sum("n_tokens").alias("t")), "mix_sources")
    total = sources.agg(F.coalesce(F.sum("t"), F.lit(0))).first()[0]
    some = sources.where("t > 0").withColumn("p", F.col("t") / F.lit(float(max(total, 1))))
    a = exponent(some.select("p"), entropy, repetition)
    z, most = some.agg(F.sum(F.pow("p", F.lit(a))), F.max(F.col("t") / F.pow("p", F.lit(a)))).first()
    weight = F.round(F.pow("p", F.lit(a)) / F.lit(z or 1.0), DECIMALS)
    tokens = math.ceil(most * z) if cover and z else total if budget is None else budget
    quota = F.floor(F.lit(float(tokens)) * weight).cast("bigint")
    if cover:
        quota = F.greatest(quota, F.col("t"))
    dealt = some.select("s", weight.alias("weight"), F.floor(quota / F.col("t")).cast("bigint").alias("passes"), (quota % F.col("t")).alias("rest"))
    dealt = materialise(dealt, "mix_quotas")

    blocks = slim.groupBy("s", F.substring("h", 1, 3).alias("block")).agg(F.sum("n_tokens").alias("n"))
    blocks = blocks.join(dealt.where("rest > 0").select("s", "rest"), "s").withColumn("turn", _turn(seed, F.col("s"), F.col("block")))
    upto = F.sum("n").over(Window.partitionBy("s").orderBy("turn").rowsBetween(Window.unboundedPreceding, 0))
    cut = blocks.withColumn("upto", upto).where("upto > rest and upto - n <= rest").select("s", "block", "turn", (F.col("rest") - F.col("upto") + F.col("n")).alias("room"))
    cut = materialise(cut, "mix_cuts")
    edge = slim.withColumn("block", F.substring("h", 1, 3)).join(cut, ["s", "block"])
    peers = F.sum("n_tokens").over(Window.partitionBy("s").orderBy("h").rangeBetween(Window.unboundedPreceding, 0))
    last = edge.withColumn("upto", peers).where("upto <= room").groupBy("s").agg(F.max("h").alias("last"))
    out = sources.select("s", F.col("t").alias("tokens")).join(dealt, "s", "left").join(cut.select("s", "block", "turn"), "s", "left").join(last, "s", "left")
    out = out.select(
        "s",
        F.col("tokens").alias("size"),
        F.coalesce("weight", F.lit(0.0)).alias("weight"),
        F.coalesce("passes", F.lit(1).cast("bigint")).alias("passes"),
        F.col("block").alias("cut_block"),
        F.col("turn").alias("cut_turn"),
        F.col("last").alias("cut_place"),
    )
    return slim, materialise(out, "mix_plan")


def _small(plan_rows: DataFrame) -> bool:
    rows, size = plan_rows.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("s")), F.lit(0))).first()
    return rows <= PLAN_ROWS and size <= PLAN_BYTES


def _copies(seed: str, source: Column, place: Column, prefix: str = "") -> Column:
    block = F.substring(place, 1, 3)
    turn, last = F.col(f"{prefix}cut_turn"), F.col(f"{prefix}cut_place")
    more = (_turn(seed, source, block) < turn) | ((block == F.col(f"{prefix}cut_block")) & (place <= last))
    return F.col(f"{prefix}passes") + F.when(more, 1).otherwise(0)


def decisions(docs: DataFrame, seed: str = SEED, **target) -> DataFrame:
    """doc_id, source, n_tokens, weight (of the source), copies of every row."""
    slim, rows = plan(docs, seed=seed, **target)
    joined = slim.join(F.broadcast(rows), "s") if _small(rows) else join_groups(slim, rows, "s", "size", "h")
    return joined.select("doc_id", F.col("s").alias("source"), "n_tokens", "weight", _copies(seed, F.col("s"), F.col("h")).alias("copies"))


def mixed(docs: DataFrame, seed: str = SEED, **target) -> DataFrame:
    """``docs`` with each row as often as the mix takes it; columns stay as they are."""
    _, rows = plan(docs, seed=seed, **target)
    small = _small(rows)
    head = fresh("__mix_", docs)  # no column of ``docs`` begins so
    rows = rows.select(*[F.col(c).alias(f"{head}{c}") for c in rows.columns])
    own = docs.withColumns({f"{head}source": _source(), f"{head}place": _place(seed)})
    if small:
        joined = own.join(F.broadcast(rows), F.col(f"{head}source") == F.col(f"{head}s"))
    else:
        joined = join_groups(own, rows.withColumnRenamed(f"{head}s", f"{head}source"), f"{head}source", f"{head}size", f"{head}place")
    copies = _copies(seed, F.col(f"{head}source"), F.col(f"{head}place"), head)
    taken = joined.withColumn(f"{head}copies", copies).where(F.col(f"{head}copies") > 0)
    return taken.withColumn(f"{head}copy", F.explode(F.sequence(F.lit(1).cast("bigint"), f"{head}copies"))).select(*docs.columns)


#: Targets of the registered query.
ENTROPY, REPETITION = 0.96, 4.0

ORACLE_SQL = rf"""
WITH RECURSIVE d AS (
  SELECT doc_id, coalesce(source, '') AS s, CAST(len(regexp_extract_all(coalesce(text, ''), '{WORD}')) AS BIGINT) AS n,
         md5('{SEED}|' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h
  FROM documents
), src AS (
  SELECT s, t, CAST(t AS DOUBLE) / sum(t) OVER () AS p FROM (SELECT s, sum(n) AS t FROM d GROUP BY s) WHERE t > 0
), e AS (
  SELECT 0 AS k, 0.0::DOUBLE AS low, {STEEPEST}::DOUBLE AS high
  UNION ALL
  SELECT k + 1, CASE WHEN h >= {ENTROPY} THEN mid ELSE low END, CASE WHEN h >= {ENTROPY} THEN high ELSE mid END
  FROM (SELECT k, low, high, (low + high) / 2 AS mid,
               (ln(sum(pow(p, (low + high) / 2))) - sum(pow(p, (low + high) / 2) * ln(pow(p, (low + high) / 2))) / sum(pow(p, (low + high) / 2))) / greatest(ln(count(*)), 1e-12) AS h
        FROM e, src WHERE k < 34 GROUP BY k, low, high)
), r AS (
  SELECT 0 AS k, 0.0::DOUBLE AS low, 1.0::DOUBLE AS high
  UNION ALL
  SELECT k + 1, CASE WHEN m <= {REPETITION} THEN low ELSE mid END, CASE WHEN m <= {REPETITION} THEN mid ELSE high END
  FROM (SELECT k, low, high, (low + high) / 2 AS mid, max(pow(p, (low + high) / 2 - 1)) / min(pow(p, (low + high) / 2 - 1)) AS m
        FROM r, src WHERE k < 32 GROUP BY k, low, high)
), a AS (
  SELECT greatest((SELECT low FROM e ORDER BY k DESC LIMIT 1), (SELECT high FROM r ORDER BY k DESC LIMIT 1)) AS a
), q AS (
  SELECT s, t, w, CAST(floor((SELECT CAST(sum(t) AS DOUBLE) FROM src) * w) AS BIGINT) AS quota
  FROM (SELECT s, t, round(pow(p, a) / (SELECT sum(pow(p, a)) FROM src, a), {DECIMALS}) AS w FROM src, a)
), c AS (
  SELECT s, block, n, quota % t AS rest, sum(n) OVER (PARTITION BY s ORDER BY md5('{SEED}|' || s || '|' || block)) AS upto
  FROM (SELECT s, h[1:3] AS block, sum(n) AS n FROM d GROUP BY ALL) JOIN q USING (s)
), x AS (
  SELECT d.doc_id, d.s, d.n, c.upto, c.rest, c.n AS size,
         sum(d.n) OVER (PARTITION BY d.s, c.block ORDER BY d.h RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS own
  FROM d LEFT JOIN c ON d.s = c.s AND d.h[1:3] = c.block
)
SELECT doc_id, x.s AS source, x.n AS n_tokens, coalesce(w, 0.0) AS weight,
       CAST(CASE WHEN w IS NULL THEN 1 ELSE quota // t + CASE WHEN rest > 0 AND (upto <= rest OR (upto - size <= rest AND upto - size + own <= rest)) THEN 1 ELSE 0 END END AS BIGINT) AS copies
FROM x LEFT JOIN q USING (s)
"""
