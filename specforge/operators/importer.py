"""Imports of catalogs and price lists: validate, drop repeats, merge with stored items, retire, number, link."""

from __future__ import annotations

from datetime import UTC, datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..plans.similarity_join import first_rows
from ..plans.storage import numbered, settled

REPLACE, MERGE = "replace", "merge"


def identity_key(code: Column, article: Column, brand: Column) -> Column:
    """What makes a row the same product: its code, else article and brand, else article; null without any."""
    return (
        F.when(code.isNotNull(), F.concat(F.lit("C|"), code))
        .when(article.isNotNull(), F.concat(F.lit("A|"), article, F.lit("|"), F.coalesce(brand, F.lit(""))))
    )


def incoming_key(rows: DataFrame) -> DataFrame:
    """Add key to raw rows (code_1c, article_raw, manufacturer)."""
    key = identity_key(T.clean_string(F.col("code_1c")), T.normalize_article(F.col("article_raw")), T.normalize_label(F.col("manufacturer")))
    return rows.withColumn("key", key)


def stored_key(items: DataFrame) -> DataFrame:
    """Add key to stored items, from their normalised columns."""
    return items.withColumn("key", identity_key(F.col("code_1c"), F.col("article_normalized"), F.col("manufacturer_normalized")))


def validate(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows with a name, and errors (source_id, line_number, error) for the others."""
    named = T.clean_string(F.col("name")).isNotNull()
    return rows.filter(named), rows.filter(~named).select("source_id", "line_number", F.lit("name is empty").alias("error"))


def drop_repeats(rows: DataFrame) -> DataFrame:
    """The first line of each key of a source; rows without a key all stay."""
    keyed = incoming_key(rows)
    with_key = first_rows(keyed.filter("key is not null"), ["source_id", "key"], [F.col("line_number")], 1)
    return with_key.unionByName(keyed.filter("key is null"))


def repeats(rows: DataFrame) -> DataFrame:
    """source_id, key, first line and other lines of keys that occur more than once."""
    lines = F.sort_array(F.collect_list("line_number"))
    found = incoming_key(rows).filter("key is not null").groupBy("source_id", "key").agg(lines.alias("lines")).filter(F.size("lines") > 1)
    return found.select("source_id", "key", F.col("lines")[0].alias("first_line"), F.slice("lines", 2, F.size("lines")).alias("other_lines"))


#: Sources of an import, one short name each, that are broadcast.
FEW_SOURCES = 200_000
VALUES = ["article_raw", "code_1c", "name", "manufacturer", "price", "unit"]


def upsert(stored: DataFrame, rows: DataFrame, mode: str = REPLACE, at: datetime | None = None) -> DataFrame:
    """The item store after an import of `rows` (source_id, line_number and VALUES), with `change`: inserted, updated,
    deactivated or kept.

    A row updates the stored item of its source with its key, which keeps its id; an inactive one is found too when
    replacing (active ones first), and becomes active. When replacing, active items of an imported source that no row
    touched are deactivated. Rows without a key are inserted each time. Normalised columns follow the new values. Other
    columns keep what is stored. at: the time of the import, by default now; inserted rows get it as created_at where
    the store has that column, and their ids depend on it, so that no import makes an id again.
    """
    at = at or datetime.now(UTC)
    items, fresh = stored_key(stored).withColumn("known", F.lit(True)), drop_repeats(rows)
    new = fresh.select(F.col("source_id").alias("new_source"), F.col("key").alias("new_key"), "line_number", *(F.col(c).alias(f"new_{c}") for c in VALUES), F.lit(True).alias("came"))
    # rows and items move once, to their keys; those without a key stay where they are
    first = F.row_number().over(Window.partitionBy("source_id", "key").orderBy(F.desc("is_active"), "item_id")) == 1
    keyed = items.filter("key is not null").withColumn("target", first if mode == REPLACE else first & F.col("is_active"))
    with_key = new.filter("new_key is not null")
    both = keyed.join(with_key, (F.col("source_id") == F.col("new_source")) & (F.col("key") == F.col("new_key")) & F.col("target"), "full")
    both = both.unionByName(items.filter("key is null"), allowMissingColumns=True).unionByName(new.filter("new_key is null"), allowMissingColumns=True)
    touched = settled(rows.select("source_id").distinct()).withColumn("imported", F.lit(True))
    touched = F.broadcast(touched) if touched.limit(FEW_SOURCES + 1).count() <= FEW_SOURCES else touched
    both = both.join(touched, "source_id", "left")
    inserted, updated = F.col("known").isNull(), F.col("known") & F.col("came")
    retire = F.col("is_active") & F.col("imported") if mode == REPLACE else F.lit(False)
    change = F.when(inserted, "inserted").when(updated, "updated").when(retire, "deactivated").otherwise("kept")
    made = F.sha2(F.concat_ws("|", "new_source", F.coalesce("new_key", F.lit("")), F.col("line_number").cast("string"), F.lit(at.isoformat())).cast("binary"), 256)
    value = lambda c: F.when(inserted, F.col(f"new_{c}")).when(updated, F.coalesce(f"new_{c}", c)).otherwise(F.col(c))
    facts = {c: value(c) for c in VALUES} | {
        "item_id": F.when(inserted, F.substring(made, 1, 32)).otherwise(F.col("item_id")),
        "source_id": F.when(inserted, F.col("new_source")).otherwise(F.col("source_id")),
        "is_active": F.when(F.col("change").isin("inserted", "updated"), True).when(F.col("change") == "deactivated", False).otherwise(F.col("is_active")),
    }
    if "created_at" in stored.columns:
        facts["created_at"] = F.when(inserted, F.lit(at).cast(stored.schema["created_at"].dataType)).otherwise(F.col("created_at"))
    wanted = [*stored.columns, "change"]
    out = both.withColumn("change", change).withColumns(facts).select(*wanted)
    normal = {"article_normalized": T.normalize_article(F.col("article_raw")), "name_normalized": T.normalize_name(F.col("name")), "manufacturer_normalized": T.normalize_label(F.col("manufacturer"))}
    return out.withColumns(normal).select(*wanted)


def report(changed: DataFrame, rows: DataFrame) -> DataFrame:
    """Counters of an import for each source."""
    read = rows.groupBy("source_id").agg(F.count(F.lit(1)).alias("rows_read"), F.count_if(T.clean_string(F.col("name")).isNull()).alias("errors"))
    done = changed.groupBy("source_id").agg(*(F.count_if(F.col("change") == c).alias(c) for c in ("inserted", "updated", "deactivated")))
    return read.join(done, "source_id", "left").fillna(0)


def assign_sku(items: DataFrame, suppliers: DataFrame) -> DataFrame:
    """Give items of suppliers with a prefix a number <prefix>-NNNNNN where they have none: that of another item of the
    source with the same key (an active one first, then the smallest), else the next ones behind the highest of that
    prefix in order of created_at, article, id. Only items that get a new number are sorted, all sources together, so a
    large source is numbered by many tasks."""
    prefixes = suppliers.filter("prefix is not null").select(F.col("supplier_id").alias("source_id"), "prefix")
    keyed = stored_key(items).join(prefixes, "source_id", "left")
    reserved = first_rows(keyed.filter("supplier_sku is not null and key is not null"), ["source_id", "key"], [F.desc("is_active"), F.col("supplier_sku")], 1)
    reserved = reserved.select("source_id", "key", F.col("supplier_sku").alias("reserved"))
    own = F.startswith("supplier_sku", F.concat("prefix", F.lit("-")))
    number = F.when(own, F.regexp_extract("supplier_sku", r"-(\d+)$", 1).try_cast("long"))
    highest = keyed.groupBy("source_id").agg(F.coalesce(F.max(number), F.lit(0)).alias("highest"))
    joined = keyed.join(reserved, ["source_id", "key"], "left").join(highest, "source_id")
    by_age = [F.col("created_at"), F.col("article_raw"), F.col("item_id")]
    need = F.col("supplier_sku").isNull() & F.col("prefix").isNotNull() & F.col("is_active")
    state = F.when(need & F.col("reserved").isNotNull(), 1).when(need, 2).otherwise(0)
    joined = joined.withColumn("state", state)
    open_ = keyed.filter(need).join(reserved, ["source_id", "key"], "left_anti")
    new = numbered(open_.select("source_id", "created_at", "article_raw", "item_id"), [F.col("source_id"), *by_age])
    first = new.groupBy("source_id").agg(F.min("place").alias("first"))
    nth = new.join(first, "source_id").select("item_id", (F.col("place") - F.col("first") + 1).alias("nth"))
    joined = joined.join(nth, "item_id", "left")
    made = F.format_string("%s-%06d", F.col("prefix"), F.col("highest") + F.col("nth"))
    sku = F.when(F.col("state") == 1, F.col("reserved")).when(F.col("state") == 2, made).otherwise(F.col("supplier_sku"))
    return joined.withColumn("supplier_sku", sku).select(*items.columns)


def _one_card(cards: DataFrame, keys: list[str]) -> DataFrame:
    """The card each key leads to: of several the oldest, then the smallest id."""
    known = cards.filter(" and ".join(f"{k} is not null" for k in keys))
    return first_rows(known, keys, [F.col("created_at"), F.col("item_id")], 1).select(*keys, F.col("item_id").alias("card"))


def _with_card(items: DataFrame, cards: DataFrame, keys: list[str]) -> DataFrame:
    """Items with the card of their keys. Most items lack a code: a hash of the keys, or of the id where one is missing,
    is a second join key, so that items without keys don't meet in one task."""
    whole = F.concat(*keys)  # null if a key is
    spread = cards.withColumn("spread", F.xxhash64(*keys))
    return items.withColumn("spread", F.when(whole.isNull(), F.xxhash64("item_id")).otherwise(F.xxhash64(*keys))).join(spread, [*keys, "spread"], "left").drop("spread")


def link_to_catalog(items: DataFrame) -> DataFrame:
    """Link active price-list items to active catalog cards: by code, else by article and brand, else by article. Links
    set by hand stay, and automatic ones that lead nowhere any more are cleared."""
    cards = items.filter("source_id = 'catalog' and is_active").select("item_id", "created_at", "code_1c", "article_normalized", "manufacturer_normalized")
    by_code = _one_card(cards, ["code_1c"]).withColumnRenamed("card", "by_code")
    by_both = _one_card(cards, ["article_normalized", "manufacturer_normalized"]).withColumnRenamed("card", "by_both")
    by_article = _one_card(cards, ["article_normalized"]).withColumnRenamed("card", "by_article")
    joined = _with_card(_with_card(_with_card(items, by_code, ["code_1c"]), by_both, ["article_normalized", "manufacturer_normalized"]), by_article, ["article_normalized"])
    card = F.coalesce("by_code", "by_both", "by_article")
    open_ = (F.col("source_id") != "catalog") & F.col("is_active") & ~F.col("catalog_link_source").eqNullSafe(F.lit("manual"))
    return joined.withColumns(
        {
            "linked_catalog_item_id": F.when(open_, card).otherwise(F.col("linked_catalog_item_id")),
            "catalog_link_source": F.when(open_, F.when(card.isNotNull(), "auto")).otherwise(F.col("catalog_link_source")),
        }
    ).select(*items.columns)


def import_price_lists(stored: DataFrame, rows: DataFrame, suppliers: DataFrame, at: datetime | None = None) -> tuple[DataFrame, DataFrame]:
    """The item store after the price lists in `rows` replaced those of their sources, with numbers and links to the
    catalog, and the counters of each source. The store's columns stay as they are; it must have those of stored items."""
    named, _ = validate(rows)
    changed = settled(upsert(stored, named, REPLACE, at))
    store = link_to_catalog(settled(assign_sku(changed.drop("change"), suppliers)))
    return store.select(*stored.columns), report(changed, rows)


def set_links(items: DataFrame, overrides: DataFrame) -> DataFrame:
    """Links set by hand (item_id, card_id; a null card locks the item as having none); a target must be a catalog card."""
    cards = items.filter("source_id = 'catalog'").select(F.col("item_id").alias("card_id"))
    valid = overrides.filter("card_id is null").unionByName(overrides.join(cards, "card_id", "left_semi").select(*overrides.columns))
    joined = items.join(valid.withColumn("by_hand", F.lit(True)), "item_id", "left")
    return joined.withColumns(
        {
            "linked_catalog_item_id": F.when(F.col("by_hand"), F.col("card_id")).otherwise(F.col("linked_catalog_item_id")),
            "catalog_link_source": F.when(F.col("by_hand"), "manual").otherwise(F.col("catalog_link_source")),
        }
    ).select(*items.columns)


def reset_links(items: DataFrame, ids: DataFrame) -> DataFrame:
    """Give links set by hand (item_id) back to the automatic rule."""
    joined = items.join(ids.select("item_id").distinct().withColumn("reset", F.lit(True)), "item_id", "left")
    cleared = joined.withColumns({c: F.when(F.col("reset").isNull(), F.col(c)) for c in ("linked_catalog_item_id", "catalog_link_source")})
    return link_to_catalog(cleared.select(*items.columns))


def purge(items: DataFrame, candidates: DataFrame, verifications: DataFrame) -> DataFrame:
    """Items without the inactive ones that no candidate and no verification refers to."""
    used = candidates.select("item_id").union(verifications.select(F.col("chosen_item_id").alias("item_id"))).distinct()
    gone = items.filter("not is_active").join(used, "item_id", "left_anti").select("item_id")
    return items.join(gone, "item_id", "left_anti")


def synced_sources(sources: DataFrame, imports: DataFrame) -> DataFrame:
    """Sources after imports (source_id, source_type, source_name, at): last_synced_at set, unknown ones created."""
    last = imports.groupBy("source_id").agg(F.max("at").alias("last_synced_at"), F.max_by("source_type", "at").alias("t"), F.max_by("source_name", "at").alias("n"))
    both = sources.join(last, "source_id", "full")
    return both.select(
        "source_id", F.coalesce("source_type", "t").alias("source_type"), F.coalesce("source_name", "n").alias("source_name"),
        F.coalesce("status", F.lit("active")).alias("status"), "last_synced_at",
    )


def client_ids(specifications: DataFrame) -> tuple[DataFrame, DataFrame]:
    """A directory of the distinct client names of specifications (client_name), and the specifications with the ids."""
    name = T.clean_string(F.col("client_name"))
    directory = specifications.select(name.alias("client_name")).filter("client_name is not null").distinct()
    directory = directory.select(F.substring(F.sha2(F.col("client_name").cast("binary"), 256), 1, 16).alias("client_id"), "client_name")
    return directory, specifications.withColumn("client_name", name).join(directory, "client_name", "left")
