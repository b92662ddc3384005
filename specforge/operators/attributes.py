"""Attributes in names (diameter, length, standard), and searches for items whose attribute is close to the one asked."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.similarity_join import first_rows
from .search import POOL, _best

# Units of length in millimetres.
MILLIMETRES = {"мм": 1, "mm": 1, "см": 10, "cm": 10, "м": 1000, "m": 1000}
_NUMBER = r"(\d{1,9}(?:[.,]\d{1,4})?)"
_UNIT = "|".join(sorted(MILLIMETRES, key=len, reverse=True))
_ENDS = rf"(?:\s?({_UNIT}))?(?![\p{{L}}\d])"
# How diameters, lengths and standards are written, in lower case.
DIAMETER = rf"(?<![\p{{L}}\d])(?:d|д|ø|⌀|диаметр)\s?=?\s?{_NUMBER}(?:\s?({_UNIT})(?!\p{{L}}))?"
LENGTH = rf"(?:(?<=\d)[xх×*]|(?<![\p{{L}}\d])(?:l|длина)\s?=?\s?){_NUMBER}{_ENDS}"
STANDARD = r"(?<![\p{L}\d])(гост|ост|ту|din|iso|en)\s?(?:р\s)?(\d{1,9}(?:[.\-]\d{1,9})*)"


def _lengths(name: Column, pattern: str, kind: str) -> Column:
    """Each value that the pattern finds, in millimetres."""
    numbers = F.regexp_extract_all(name, F.lit(pattern), F.lit(1))
    units = F.regexp_extract_all(name, F.lit(pattern), F.lit(2))
    factors = F.create_map(*(F.lit(x) for pair in MILLIMETRES.items() for x in pair))
    value = lambda n, u: F.round(F.replace(n, F.lit(","), F.lit(".")).cast("double") * F.coalesce(factors[u], F.lit(1)), 4)
    return F.zip_with(numbers, units, lambda n, u: F.struct(F.lit(kind).alias("kind"), value(n, u).alias("value"), F.lit(None).cast("string").alias("text")))


def attributes(rows: DataFrame, name: str = "name") -> DataFrame:
    """The rows with kind, value (millimetres, of a diameter or a length) and text (of a standard), one for each different
    attribute in their name; rows without any, or without a name, are left out. A number without a unit is in millimetres."""
    low = F.lower(name)
    kinds, numbers = (F.regexp_extract_all(low, F.lit(STANDARD), F.lit(i)) for i in (1, 2))
    standards = F.zip_with(kinds, numbers, lambda k, n: F.struct(F.lit("standard").alias("kind"), F.lit(None).cast("double").alias("value"), F.concat(k, F.lit(" "), n).alias("text")))
    found = F.array_distinct(F.concat(_lengths(low, DIAMETER, "diameter"), _lengths(low, LENGTH, "length"), standards))
    return rows.filter(F.col(name).isNotNull()).select("*", F.explode(found).alias("_a")).select(*rows.columns, "_a.kind", "_a.value", "_a.text")


def band_join(left: DataFrame, right: DataFrame, tolerance: float) -> DataFrame:
    """kind, left_value, right_value and distance of each pair of different values (kind, value) of the two sides that are
    at most `tolerance` (above 0) apart, borders included, up to rounding at the ninth place.

    Values fall into intervals a little wider than the tolerance, for what floating point does to borders, so close ones
    lie in the same or neighbouring intervals: an equality join. Values are made distinct first, so a value that a third of all rows hold is one row.
    """
    if tolerance <= 0:
        raise ValueError("the tolerance must be above 0")
    values = lambda df, c: df.filter("value is not null and not isnan(value)").select("kind", F.col("value").alias(c)).distinct()
    at = lambda c: F.floor(F.col(c) / (tolerance * 1.001 + 1e-9))
    near = values(left, "left_value").withColumn("cell", F.explode(F.array(*(at("left_value") + i for i in (-1, 0, 1)))))
    pairs = near.join(values(right, "right_value").withColumn("cell", at("right_value")), ["kind", "cell"])
    distance = F.round(F.abs(F.col("left_value") - F.col("right_value")), 9)
    return pairs.withColumn("distance", distance).filter(F.col("distance") <= tolerance).select("kind", "left_value", "right_value", "distance")


def near_attributes(asked: DataFrame, items: DataFrame, tolerance: float, pool: int = POOL) -> DataFrame:
    """asked: kind, value. For each different one the `pool` items (item_id, name) with the closest value of that kind:
    kind, value, item_id, distance; of equally close items the first by name, then id, and each once."""
    held = attributes(items.select("item_id", "name")).filter("value is not null")
    close = band_join(asked, held, tolerance)
    key = lambda v: F.struct("kind", F.col(v).alias("value"))
    hits = close.select(key("left_value").alias("query"), key("right_value").alias("key"), (-F.col("distance")).alias("score"))
    # an item with several values near the one asked counts by its closest: pools are as many times wider as values can be
    most = held.groupBy("item_id", "kind").agg(F.count(F.lit(1)).alias("n")).agg(F.coalesce(F.max("n"), F.lit(1))).first()[0]
    best = _best(hits, held.withColumn("a", F.struct("kind", "value")), "a", pool * most)
    once = best.groupBy("query", "item_id").agg(F.max("score").alias("score")).join(items.select("item_id", "name"), "item_id")
    first = first_rows(once, ["query"], [F.desc("score"), F.col("name"), F.col("item_id")], pool)
    return first.select("query.kind", "query.value", "item_id", (-F.col("score")).alias("distance"))
