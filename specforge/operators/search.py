"""Search operators in bulk: every query of a table against every item. Each returns (query, item_id, score) with at
most `pool` items for each query, best first; ties go by name and item_id."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import similarity as S
from ..functions import text as T
from ..plans.similarity_join import SetIndex, containment_join, digit_substring_join, first_rows, set_similarity_join
from ..plans.storage import settled

POOL = 20
ARTICLE_SIMILARITY, NAME_SIMILARITY = 0.4, 0.3
#: Similarities that names are searched for first, highest first: a query whose pool is full at one of them is done.
NAME_LEVELS = (0.6,)


@dataclass(frozen=True)
class SourceFilter:
    types: tuple[str, ...] = ()
    source_ids: tuple[str, ...] = ()
    only_active: bool = True


def searchable(items: DataFrame, sources: DataFrame, wanted: SourceFilter = SourceFilter()) -> DataFrame:
    """Items with the columns of their source, restricted as asked; inactive items and sources are left out."""
    joined = items.join(sources, "source_id")
    if wanted.only_active:
        joined = joined.filter(F.col("is_active") & (F.col("status") == "active"))
    if wanted.types:
        joined = joined.filter(F.col("source_type").isin(*wanted.types))
    if wanted.source_ids:
        joined = joined.filter(F.col("source_id").isin(*wanted.source_ids))
    return joined


def _counted(items: DataFrame, column: str, pool: int) -> DataFrame:
    """key and n: how many items hold each value of a column, up to `pool`."""
    counts = items.filter(F.col(column).isNotNull()).groupBy(F.col(column).alias("key")).agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("n", F.least("n", F.lit(pool)))


def _best(hits: DataFrame, items: DataFrame, column: str, pool: int) -> DataFrame:
    """Hits (query, key, score) on distinct values of an item column -> items. Values are taken best first until they
    hold `pool` items, so a query never expands into more items than it keeps by much. How far that goes follows from how
    many items each score of a query has, which is summed before it is shuffled."""
    ordered = items.filter(F.col(column).isNotNull()).select(F.col(column).alias("key"), "item_id", "name")
    few = first_rows(ordered, ["key"], [F.col("name"), F.col("item_id")], pool)
    hits = settled(hits.join(_counted(items, column, pool), "key"))
    scores = hits.groupBy("query", "score").agg(F.sum("n").alias("n"))
    better = F.coalesce(F.sum("n").over(Window.partitionBy("query").orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    least = scores.withColumn("better", better).filter(F.col("better") < pool).groupBy("query").agg(F.min("score").alias("least"))
    taken = hits.join(least, "query").filter(F.col("score") >= F.col("least")).join(few, "key")
    return first_rows(taken, ["query"], [F.desc("score"), F.col("name"), F.col("item_id")], pool).select("query", "item_id", "score")


def exact_article(queries: DataFrame, items: DataFrame, pool: int = POOL) -> DataFrame:
    """queries: query (a normalised article)."""
    ordered = items.filter(F.col("article_normalized").isNotNull())
    few = first_rows(ordered, ["article_normalized"], [F.col("source_type"), F.col("name"), F.col("item_id")], pool)
    return queries.join(few, queries["query"] == few["article_normalized"]).select("query", "item_id", F.lit(1.0).alias("score"))


def _distinct_sets(df: DataFrame, column: str, members: Column) -> DataFrame:
    return df.filter(F.col(column).isNotNull()).select(F.col(column).alias("id")).distinct().withColumn("members", members)


def fuzzy_article(queries: DataFrame, items: DataFrame, threshold: float = ARTICLE_SIMILARITY, pool: int = POOL) -> DataFrame:
    """queries: query (a normalised article)."""
    left = _distinct_sets(queries, "query", S.trigrams(F.col("id")))
    right = _distinct_sets(items, "article_normalized", S.trigrams(F.col("id")))
    hits = set_similarity_join(left, right, threshold).select(F.col("left_id").alias("query"), F.col("right_id").alias("key"), "score")
    return _best(hits, items, "article_normalized", pool)


def _name_sets(queries: DataFrame, items: DataFrame) -> tuple[DataFrame, DataFrame]:
    """id, members (trigrams) and stems of the distinct queries and names."""
    return tuple(
        settled(_distinct_sets(df, column, S.trigrams(F.col("id"))).withColumn("stems", S.stems(F.col("id")))) for df, column in ((queries, "query"), (items, "name_normalized"))
    )


def _all_name_hits(left: DataFrame, right: DataFrame, index: SetIndex, threshold: float) -> DataFrame:
    alike = settled(set_similarity_join(left.select("id", "members"), index, threshold).select("left_id", "right_id", "score"))
    held = settled(containment_join(left.select("id", F.col("stems").alias("members")), right.select("id", F.col("stems").alias("members"))))
    facts = lambda df, k: df.select(F.col("id").alias(f"{k}_id"), F.col("stems").alias(f"{k}_stems"), F.col("members").alias(f"{k}_grams"))
    held = held.join(facts(left, "left"), "left_id").join(facts(right, "right"), "right_id")
    rank = S.text_rank(F.col("left_stems"), F.col("right_stems"))
    held = held.select("left_id", "right_id", F.greatest(rank, S.jaccard(F.col("left_grams"), F.col("right_grams"))).alias("score"))
    both = alike.unionByName(held).groupBy("left_id", "right_id").agg(F.max("score").alias("score"))
    return both.select(F.col("left_id").alias("query"), F.col("right_id").alias("key"), "score")


def lexical_hits(queries: DataFrame, items: DataFrame, threshold: float = NAME_SIMILARITY) -> DataFrame:
    """(query, key, score) over distinct names: all stems of the query present, or alike by trigrams; the score is the
    larger of the similarity and the rank of the stems."""
    left, right = _name_sets(queries, items)
    return _all_name_hits(left, right, SetIndex(right.select("id", "members")), threshold)


def lexical_name(queries: DataFrame, items: DataFrame, threshold: float = NAME_SIMILARITY, pool: int = POOL, levels: tuple[float, ...] = NAME_LEVELS) -> DataFrame:
    """queries: query (a normalised name).

    The threshold of a query rises with what it has found: names are searched for at high similarities first, where few
    meet, and a query with `pool` items at one of these levels needs nothing below. (The rank of stems is under 0.1, so it
    lifts no hit over a level.) Only the others are looked up at the threshold itself.
    """
    left, right = _name_sets(queries, items)
    index, counted, found = SetIndex(right.select("id", "members")), settled(_counted(items, "name_normalized", pool)), []
    for level in levels:
        alike = settled(set_similarity_join(left.select("id", "members"), index, level))
        full = settled(alike.join(counted, alike["right_id"] == counted["key"]).groupBy(F.col("left_id").alias("id")).agg(F.sum("n").alias("n")).filter(F.col("n") >= pool).select("id"))
        done = alike.join(full, alike["left_id"] == full["id"], "left_semi")
        found.append(done.select(F.col("left_id").alias("query"), F.col("right_id").alias("key"), "score"))
        left = settled(left.join(full, "id", "left_anti"))
    hits = _all_name_hits(left, right, index, threshold)
    for more in found:
        hits = hits.unionByName(more)
    return _best(hits, items, "name_normalized", pool)


def code_in_name(queries: DataFrame, items: DataFrame, pool: int = POOL) -> DataFrame:
    """queries: query (a run of at least five digits)."""
    names = items.select(F.col("name_normalized").alias("name")).filter("name is not null").distinct()
    hits = digit_substring_join(queries.select(F.col("query").alias("token")).distinct(), names)
    return _best(hits.select(F.col("token").alias("query"), F.col("name").alias("key"), F.lit(1.0).alias("score")), items, "name_normalized", pool)


def known_manufacturers(items: DataFrame) -> DataFrame:
    return items.select(F.col("manufacturer_normalized").alias("brand")).filter("brand != ''").distinct()


def linked_cards(items: DataFrame) -> DataFrame:
    """item_id of supplier items and the active catalog card each is linked to."""
    cards = items.filter(F.col("is_active")).select(F.col("item_id").alias("card_id"))
    linked = items.select("item_id", F.col("linked_catalog_item_id").alias("card_id")).filter("card_id is not null")
    return linked.join(cards, "card_id").select("item_id", "card_id")


def _name_parts(rows: DataFrame, sizes: tuple[int, ...]) -> DataFrame:
    """The rows with each distinct part of their name of these lengths."""
    cut = lambda k: F.transform(F.sequence(F.lit(1), F.length("name") - (k - 1)), lambda i: F.substring("name", i, F.lit(k)))
    none = F.array().cast("array<string>")
    parts = F.flatten(F.array(*(F.when(F.length("name") >= k, cut(k)).otherwise(none) for k in sizes)))
    return rows.select("*", F.explode(F.array_distinct(parts)).alias("part"))


def _inside(typed: DataFrame, items: DataFrame, limit: int) -> DataFrame:
    """query and item_id of items with the typed text inside their name. Texts of three characters or more meet names by
    their first three; a shorter one is a part of a name itself, and as most names hold it, only the first `limit` items
    of each part are kept, before they are dealt out."""
    lowered = items.select("item_id", "source_type", F.col("name").alias("shown"), F.lower("name").alias("name"))
    long = typed.filter(F.length("text") >= 3).select("query", "text", F.substring("text", 1, 3).alias("part"))
    names = _name_parts(lowered.select("name").distinct(), (3,))
    found = long.join(names, "part").filter(F.contains("name", "text")).select("query", "name").join(lowered, "name")
    short = typed.filter(F.length("text") < 3)
    asked = short.select(F.col("text").alias("part")).distinct()
    parts = _name_parts(lowered, (1, 2)).join(F.broadcast(asked) if asked.limit(1000).count() < 1000 else asked, "part", "left_semi")
    first = first_rows(parts, ["part"], [F.col("source_type"), F.col("shown"), F.col("item_id")], limit)
    held = short.join(first, short["text"] == first["part"])
    return found.select("query", "item_id").union(held.select("query", "item_id"))


def manual_search(queries: DataFrame, items: DataFrame, limit: int = POOL) -> DataFrame:
    """Typed searches (query): items with that code, SKU or article, or with the text inside the name; exact ones first,
    then catalog cards, then by name. Returns query, item_id, place."""
    typed = queries.select("query", T.clean_string(F.col("query")).alias("q")).filter("q is not null").distinct()
    typed = typed.withColumns({"a": T.manual_article(F.col("q")), "text": F.lower("q")})
    ids = [
        typed.join(items, typed["q"] == items["code_1c"]).select("query", "item_id"),
        typed.join(items, typed["q"] == items["supplier_sku"]).select("query", "item_id"),
        typed.join(items, typed["a"] == items["article_normalized"]).select("query", "item_id"),
        _inside(typed, items, limit),
    ]
    found = ids[0].union(ids[1]).union(ids[2]).union(ids[3]).distinct().join(items, "item_id").join(typed, "query")
    same = lambda c, x: F.coalesce(F.col(c) == F.col(x), F.lit(False)).desc()
    order = [same("code_1c", "q"), same("supplier_sku", "q"), same("article_normalized", "a"), F.col("source_type"), F.col("name"), F.col("item_id")]
    place = F.row_number().over(Window.partitionBy("query").orderBy(*order))
    return found.withColumn("place", place).filter(F.col("place") <= limit).select("query", "item_id", "place")
