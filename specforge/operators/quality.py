"""Checks of what must hold in stored tables; each returns the rows that break the rule."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _twice(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows")).filter("rows > 1")


def repeated_codes(items: DataFrame) -> DataFrame:
    return _twice(items.filter("is_active and code_1c is not null"), ["source_id", "code_1c"])


def repeated_articles(items: DataFrame) -> DataFrame:
    open_ = items.filter("is_active and code_1c is null and article_normalized is not null")
    return _twice(open_.withColumn("brand", F.lower(F.coalesce("manufacturer", F.lit("")))), ["source_id", "article_normalized", "brand"])


def repeated_skus(items: DataFrame) -> DataFrame:
    return _twice(items.filter("is_active and supplier_sku is not null"), ["source_id", "supplier_sku"])


def bad_prefixes(suppliers: DataFrame) -> DataFrame:
    """Prefixes of another form than three capitals or digits, or used by several suppliers."""
    given = suppliers.filter("prefix is not null")
    used = given.groupBy("prefix").agg(F.count(F.lit(1)).alias("suppliers"))
    return used.filter((F.col("suppliers") > 1) | ~F.col("prefix").rlike("^[A-Z0-9]{3}$"))


def repeated_lines(spec_items: DataFrame) -> DataFrame:
    return _twice(spec_items, ["spec_id", "line_number"])


def repeated_verifications(verifications: DataFrame) -> DataFrame:
    return _twice(verifications, ["spec_item_id"])


def orphans(rows: DataFrame, column: str, parents: DataFrame, parent_column: str) -> DataFrame:
    """Values of a column that no parent row has, with how many rows refer to them."""
    ids = parents.select(F.col(parent_column).alias(column)).distinct()
    return rows.filter(F.col(column).isNotNull()).join(ids, column, "left_anti").groupBy(column).agg(F.count(F.lit(1)).alias("rows"))
