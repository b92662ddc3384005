"""Extensions: what changed between two price lists, key figures, and what could not be found."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def price_list_changes(old: DataFrame, new: DataFrame) -> DataFrame:
    """source_id, key and change of two snapshots (source_id, key, name, price): new, gone, price, renamed or same."""
    a = old.select("source_id", "key", F.col("name").alias("old_name"), F.col("price").alias("old_price"))
    b = new.select("source_id", "key", F.col("name").alias("new_name"), F.col("price").alias("new_price"))
    both = a.join(b, ["source_id", "key"], "full")
    change = (
        F.when(F.col("old_name").isNull(), "new").when(F.col("new_name").isNull(), "gone")
        .when(~F.col("old_price").eqNullSafe(F.col("new_price")), "price").when(F.col("old_name") != F.col("new_name"), "renamed").otherwise("same")
    )
    return both.withColumn("change", change)


def key_figures(states: DataFrame, items: DataFrame) -> DataFrame:
    """Share of lines that can be confirmed automatically, of those decided otherwise, and of catalog cards that price
    lists cover (by article)."""
    lines = states.agg(
        F.round(F.count_if(F.col("band") == "high") / F.count(F.lit(1)), 6).alias("auto_confirm_rate"),
        F.round(F.count_if((F.col("band") == "high") & (F.col("decision") != "confirmed")) / F.greatest(F.count_if((F.col("band") == "high") & F.col("decision").isNotNull()), F.lit(1)), 6).alias("false_auto_confirm_rate"),
    )
    active = items.filter("is_active and article_normalized is not null")
    offered = active.filter("source_id != 'catalog'").select("article_normalized").distinct().withColumn("offered", F.lit(1))
    cards = active.filter("source_id = 'catalog'").join(offered, "article_normalized", "left")
    return lines.join(cards.agg(F.round(F.count("offered") / F.greatest(F.count(F.lit(1)), F.lit(1)), 6).alias("catalog_coverage")))


def unfound_names(spec_items: DataFrame, states: DataFrame, top: int = 20) -> DataFrame:
    """Names of lines without a good candidate, most frequent first."""
    missing = states.filter("band in ('low', 'no_candidate')").select("spec_item_id")
    counted = spec_items.join(missing, "spec_item_id", "left_semi").groupBy("name_raw").agg(F.count(F.lit(1)).alias("lines"))
    return counted.orderBy(F.desc("lines"), "name_raw").limit(top)


def possible_analogs(candidates: DataFrame, low: float = 0.3, high: float = 0.5) -> DataFrame:
    """Candidates between the bands, shown as possible analogs."""
    return candidates.filter((F.col("confidence") >= low) & (F.col("confidence") < high))
