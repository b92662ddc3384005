"""Supplier transformations: settings of a supplier applied to the rows of its price list."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T

SETTINGS = "vat_rate decimal(5,2), default_unit string, default_currency string, brand_regex string, forced_manufacturer string"


def load_settings(suppliers: DataFrame) -> DataFrame:
    """Settings columns from JSON texts (supplier_id, settings); broken or missing ones change nothing."""
    parsed = F.from_json(F.coalesce("settings", F.lit("{}")), SETTINGS)
    return suppliers.select("supplier_id", parsed.alias("s")).select("supplier_id", "s.*")


def is_noop(settings: DataFrame) -> DataFrame:
    named = [c for c in settings.columns if c in ("vat_rate", "default_unit", "brand_regex", "forced_manufacturer")]
    return settings.withColumn("is_noop", F.coalesce(*(F.col(c).cast("string") for c in named)).isNull())


def apply(rows: DataFrame, settings: DataFrame) -> DataFrame:
    """rows: supplier_id, name, manufacturer, price, unit, currency. The brand is taken from the name by the supplier's
    pattern (two groups: name, brand) where there is none; VAT is taken off, rounded half to even; empty units and
    currencies get defaults; a forced manufacturer replaces any other."""
    joined = rows.join(settings, "supplier_id", "left")
    pattern = F.concat(F.lit("^(?:"), F.coalesce("brand_regex", F.lit("(?!)()()")), F.lit(")"))
    head, brand = (T.clean_string(F.call_function("regexp_extract", F.col("name"), pattern, F.lit(i))) for i in (1, 2))
    found = T.null_if_empty(F.coalesce("manufacturer", F.lit(""))).isNull() & head.isNotNull() & brand.isNotNull()
    factor = (F.lit(1).cast("decimal(9,4)") + F.col("vat_rate") / 100).cast("decimal(9,4)")
    net = F.bround(F.col("price").cast("decimal(18,4)") / factor, 4).cast("decimal(18,4)")
    return joined.select(
        *[c for c in rows.columns if c not in ("name", "manufacturer", "price", "unit", "currency")],
        F.when(found, head).otherwise(F.col("name")).alias("name"),
        F.coalesce("forced_manufacturer", F.when(found, brand).otherwise(F.col("manufacturer"))).alias("manufacturer"),
        F.when(F.col("vat_rate").isNotNull(), net).otherwise(F.col("price").cast("decimal(18,4)")).alias("price"),
        F.coalesce(T.null_if_empty(F.col("unit")), F.col("default_unit")).alias("unit"),
        F.coalesce(T.null_if_empty(F.col("currency")), F.col("default_currency")).alias("currency"),
    )


def import_settings(wanted: DataFrame, suppliers: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Settings given by supplier name (name, prefix): what applies to which supplier, and the unknown names."""
    known = suppliers.select("supplier_id", "name")
    return wanted.join(known, "name"), wanted.join(known, "name", "left_anti").select("name")


def force_manufacturer(items: DataFrame, settings: DataFrame) -> DataFrame:
    """Stored active items of suppliers with a forced manufacturer get it."""
    forced = settings.filter("forced_manufacturer is not null").select(F.col("supplier_id").alias("source_id"), "forced_manufacturer")
    joined = items.join(forced, "source_id", "left")
    new = F.when(F.col("is_active") & F.col("forced_manufacturer").isNotNull(), F.col("forced_manufacturer")).otherwise(F.col("manufacturer"))
    return joined.withColumns({"manufacturer": new, "manufacturer_normalized": T.normalize_label(new)}).select(*items.columns)
