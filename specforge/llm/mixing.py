"""Mixing sources to target weights.

Words are summed for each source, a repetition rate follows from the source's target, and every document is taken
floor(rate) times plus one hash-seeded Bernoulli copy with probability rate - floor(rate). Everything is DataFrame
expressions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import aside, documents, fits, n_words, settle, text_of

#: No source is taken more than so many times.
MOST = 3
#: Sources whose facts are broadcast at most; beyond it they are joined by a shuffle, whose hot keys Spark splits.
BROADCAST_SOURCES = 50_000
#: What the draw of the extra copies is seeded with.
SEED = "mix"


def _digest() -> Column:
    """Tells apart the texts of rows without an id."""
    return F.when(F.col("doc_id").isNull(), F.md5(text_of().cast("binary")))


def uniform(seed: str) -> Column:
    """In [0, 1), from the document's id alone, or from its text where it has none: 52 bits of a digest."""
    key = F.md5(F.concat(F.lit(f"{seed} "), F.coalesce(F.col("doc_id").cast("string"), F.col("digest"))).cast("binary"))
    return F.conv(F.substring(key, 1, 13), 16, 10).cast("long") / F.lit(float(2**52))


def targets(sizes: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: int = MOST) -> DataFrame:
    """source, source_size, target and rate from one row for each source (source, source_size).

    By code point, a null source last, the sources weigh as `weights` says, over and over. A source gets at most `most`
    times its size; what is over goes to the others by weight, until none is above. That ends where a level L has
    target = min(most * size, L * weight). In order of the ratio most * size / weight, sources of one ratio taken
    together, L is what the ratios before leave, for each weight of the rest; the first L that is not above its own
    ratio holds. The windows run over one row for each source, or ratio.
    """
    order = Window.orderBy(F.col("source").isNull(), F.encode("source", "utf-8"))
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1).cast("int"))
    weighed = sizes.withColumn("weight", weight.cast("double")).withColumn("cap", F.col("source_size") * F.lit(float(most)))
    steps = weighed.groupBy((F.col("cap") / F.col("weight")).alias("ratio")).agg(*(F.sum(c).alias(c) for c in ("cap", "weight", "source_size")))
    by_ratio = Window.orderBy("ratio")
    before, behind = by_ratio.rowsBetween(Window.unboundedPreceding, -1), by_ratio.rowsBetween(0, Window.unboundedFollowing)
    left = F.sum("source_size").over(Window.partitionBy()) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    levels = steps.select("ratio", (left / F.sum("weight").over(behind)).alias("level")).filter("level <= ratio")
    level = levels.agg(F.min_by("level", "ratio")).first()[0]  # one number
    return weighed.withColumn("target", F.col("cap") if level is None else F.least("cap", F.lit(level) * F.col("weight"))).select(
        "source",
        "source_size",
        "target",
        F.when(F.col("source_size") > 0, F.least(F.col("target") / F.col("source_size"), F.lit(float(most)))).otherwise(0.0).alias("rate"),
    )


def _by_source(rows: DataFrame, facts: DataFrame, small: bool) -> DataFrame:
    facts = facts.withColumnRenamed("source", "_source")
    on = F.col("source").eqNullSafe(F.col("_source"))
    return rows.join(F.broadcast(facts) if small else facts, on).drop("_source")


def plan(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: int = MOST, seed: str = SEED) -> DataFrame:
    """doc_id, digest, source, size, source_size, target, copies: one row for each input row.

    A null text has no words. A document without words is taken as often as its rate says, and adds none. Rows that
    repeat an id draw alike. An empty table gives an empty result; other columns are not read.
    """
    rows = settle(
        docs.select(
            F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), n_words(text_of()).alias("size"), _digest().alias("digest")
        )
    )
    rated = settle(targets(settle(rows.groupBy("source").agg(F.sum("size").alias("source_size"))), weights, most))
    extra = uniform(seed) < F.col("rate") - F.floor("rate")
    return (
        _by_source(rows, rated, fits(rated, BROADCAST_SOURCES))
        .withColumn("copies", (F.floor("rate") + extra.cast("int")).cast("int"))
        .select("doc_id", "digest", "source", "size", "source_size", "target", "copies")
    )


def mix(docs: DataFrame, **options) -> DataFrame:
    """The mixture: every document as many times as the plan takes it, with the columns of the input. Rows of one id,
    source and text draw alike; rows that repeat an id in several sources are taken at the rate of each."""
    did, origin, digest, copies, copy = aside(docs.columns, "did", "origin", "digest", "copies", "copy")
    taken = plan(docs, **options).groupBy("doc_id", "source", "digest").agg(F.max("copies").alias(copies)).filter(F.col(copies) > 0)
    taken = taken.withColumnsRenamed({"doc_id": f"{did}_", "source": f"{origin}_", "digest": f"{digest}_"})
    keyed = docs.withColumns({did: F.col("doc_id").cast("long"), origin: F.col("source").cast("string"), digest: _digest()})
    same = lambda c: F.col(c).eqNullSafe(F.col(f"{c}_"))
    return (
        keyed.join(taken, same(did) & same(origin) & same(digest))
        .withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(copies))))
        .select(*docs.columns)
    )


def op4_mixing(spark, sf_dir):
    return plan(documents(spark, sf_dir)).select(
        "doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken")
    )


OP4_SQL = rf"""
WITH sized AS (
  SELECT doc_id, source, text, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS size FROM documents),
weighed AS (
  SELECT *, source_size * {MOST}.0 AS cap FROM (
    SELECT source, sum(size)::double AS source_size,
           ((row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 + 1)::double AS weight
    FROM sized GROUP BY source)),
steps AS (
  SELECT cap / weight AS ratio, sum(cap) AS cap, sum(weight) AS weight, sum(source_size) AS source_size FROM weighed GROUP BY 1),
levels AS (
  SELECT ratio, (sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY ratio ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
           / sum(weight) OVER (ORDER BY ratio ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM steps),
found AS (SELECT min_by(level, ratio) AS level FROM levels WHERE level <= ratio),
rated AS (
  SELECT source, source_size, least(cap, level * weight) AS target,
         CASE WHEN source_size > 0 THEN least(least(cap, level * weight) / source_size, {MOST}.0) ELSE 0 END AS rate
  FROM weighed, found)
SELECT doc_id, size::bigint AS size, source_size::bigint AS source_size, target,
       (size * (floor(rate) + (('0x' || substr(md5('{SEED} ' || coalesce(doc_id::varchar, md5(coalesce(text, '')))), 1, 13))::bigint
         / 4503599627370496.0 < rate - floor(rate))::int))::bigint AS taken
FROM sized JOIN rated ON sized.source IS NOT DISTINCT FROM rated.source
"""
