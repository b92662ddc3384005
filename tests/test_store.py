"""The versioned store: batches taken once through failures, writers in each other's way, numbering by ranges."""

import pytest
from pyspark.sql import functions as F

from specforge.operators import importer as I
from specforge.plans.storage import numbered
from specforge.sources import tables as D
from specforge.streaming import jobs
from specforge.streaming.store import ItemStore

ROWS = "source_id string, line_number long, article_raw string, code_1c string, name string, manufacturer string, price decimal(18,4), unit string"
SMALL = "source_id string, item_id string, n long"


def put(spark, *rows):
    return lambda _: spark.createDataFrame(rows, SMALL)


def rows_of(df):
    return sorted(tuple(r[c] for c in ("source_id", "item_id", "n")) for r in df.collect())


def test_a_batch_is_taken_once_and_touches_its_sources_only(spark, tmp_path):
    store = ItemStore(spark, str(tmp_path / "s"), SMALL)
    assert store.version == 0 and rows_of(store.items()) == []
    assert store.update("f", 0, ["a", "b/ ="], put(spark, ("a", "1", 1), ("b/ =", "2", 2), ("other", "9", 9)))
    assert store.update("f", 1, ["a"], lambda old: old.withColumn("n", F.col("n") + 10))
    assert not store.update("f", 1, ["a"], put(spark)) and not store.update("f", 0, ["a"], put(spark))
    assert store.update("g", 0, ["c"], lambda old: old.withColumn("source_id", F.lit("c")), beside=["a"])
    want = [("a", "1", 11), ("b/ =", "2", 2), ("c", "1", 11)]
    assert rows_of(store.items()) == want and rows_of(store.items(["c", "none"])) == want[2:]
    assert rows_of(store.items(version=1)) == [("a", "1", 1), ("b/ =", "2", 2)]
    store.compact()
    again = ItemStore(spark, str(tmp_path / "s"), SMALL)
    assert rows_of(again.items()) == want and again.taken("f", 1) and again.taken("g", 0) and not again.taken("f", 2)
    assert again.update("f", 2, ["a"], put(spark)) and rows_of(again.items()) == want[1:]


def test_a_writer_that_comes_second_works_on_what_the_first_left(spark, tmp_path):
    one, two = (ItemStore(spark, str(tmp_path / "s"), SMALL) for _ in range(2))
    one.update("f", 0, ["a"], put(spark, ("a", "1", 1)))
    seen = []

    def slow(old):
        seen.append(rows_of(old))
        if len(seen) == 1:
            two.update("g", 0, ["a"], lambda x: x.withColumn("n", F.col("n") * 5))
        return old.withColumn("n", F.col("n") + 1)

    assert one.update("f", 1, ["a"], slow)
    assert seen == [[("a", "1", 1)], [("a", "1", 5)]] and rows_of(one.items()) == [("a", "1", 6)] and one.version == 3


class Killed(Exception):
    pass


@pytest.mark.parametrize("when", ["before", "after"])
def test_feed_killed_and_started_again(spark, tmp_path, monkeypatch, when):
    """The job dies in its second batch, before the version is there or behind it; a restart goes on as if it had not."""
    schema = D.stored_items(spark, "/root/testdata/sf0.001").schema
    for price, article in ((1, "A-1"), (2, "A-1"), (3, "B-2")):
        rows = spark.createDataFrame([("S1", 1, article, None, "thing", None, None, None)], ROWS).withColumn("price", F.lit(price).cast("decimal(18,4)"))
        rows.coalesce(1).write.mode("append").parquet(str(tmp_path / "feed"))
    suppliers = spark.createDataFrame([("S1", "ABC")], "supplier_id string, prefix string")
    store, published = ItemStore(spark, str(tmp_path / "s"), schema), ItemStore._publish

    def dying(self, version, entry):
        if version == 2 and when == "before":
            raise Killed
        done = published(self, version, entry)
        if version == 2:
            raise Killed
        return done

    def run():
        jobs.store_price_lists(spark, str(tmp_path / "feed"), ROWS, str(tmp_path / "p"), store, suppliers).awaitTermination()

    monkeypatch.setattr(ItemStore, "_publish", dying)
    with pytest.raises(Exception, match="Killed"):
        run()
    assert store.version == (1 if when == "before" else 2)
    monkeypatch.setattr(ItemStore, "_publish", published)
    run()
    run()
    got = sorted((r["article_raw"], float(r["price"]), r["is_active"], r["supplier_sku"]) for r in store.items().collect())
    assert got == [("A-1", 2.0, False, "ABC-000001"), ("B-2", 3.0, True, "ABC-000002")] and store.version == 3


def test_numbers_are_consecutive_over_ranges(spark):
    df = spark.range(1000).withColumn("k", F.col("id") * 7 % 1000).withColumn("source", F.when(F.col("id") % 3 == 0, "a").otherwise("b")).repartition(5)
    got = numbered(df, [F.col("source"), F.col("k")]).orderBy("source", "k").collect()
    assert [r["place"] for r in got] == list(range(1000))
    assert numbered(df.limit(0), [F.col("k")]).collect() == []


def test_links_without_keys_are_null(spark):
    stored = D.stored_items(spark, "/root/testdata/sf0.001")
    bare = stored.withColumns({c: F.lit(None).cast("string") for c in ("code_1c", "article_normalized", "manufacturer_normalized")})
    linked = I.link_to_catalog(bare)
    assert linked.count() == stored.count() and linked.filter("catalog_link_source = 'auto' and is_active").count() == 0
