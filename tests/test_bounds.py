"""What bounds the driver's memory, disk and time: sizes of plans, moves of rows, files."""

from specforge.operators import matching as M
from specforge.operators import search as E
from specforge.sources import tables as D


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_channels_are_no_single_plan(spark, data):
    queries = M.match_inputs(D.spec_items(spark, data).limit(40)).drop("spec_item_id").dropDuplicates(["qid"])
    pooled = E.searchable(D.stored_items(spark, data), D.sources(spark, data)).select(*M.POOLED)
    assert "Window" not in plan(M.all_hits(queries.cache(), pooled.cache()))


def test_an_import_moves_items_once(spark, data):
    from specforge.operators import importer as I

    joins = [x for x in plan(I.upsert(D.stored_items(spark, data), D.new_price_lists(spark, data))).split("\n") if "Join FullOuter" in x or "Join LeftSemi" in x or "Join LeftAnti" in x]
    assert len(joins) == 1


def test_store_has_no_folder_for_each_source(spark, tmp_path):
    from specforge.streaming.store import ItemStore

    store = ItemStore(spark, str(tmp_path / "store"), "item_id string, source_id string")
    made = spark.range(900).selectExpr("cast(id as string) AS item_id", "concat('S', id % 300) AS source_id")
    names = [f"S{n}" for n in range(300)]
    assert store.update("f", 0, names, lambda _: made) and store.items().count() == 900
    assert len(list((tmp_path / "store/data").rglob("*.parquet"))) <= 20
    assert store.update("f", 1, names[:150], lambda items: items.limit(0)) and store.items().count() == 450
    assert store.items(["S200", "S10"]).count() == 3


def test_rounds_of_units_leave_nothing_behind(spark):
    import os
    from urllib.parse import urlparse

    from specforge.operators import units as U
    from specforge.plans.storage import shared_path

    folder = os.path.dirname(urlparse(shared_path(spark)).path)
    before = set(os.listdir(folder)) if os.path.isdir(folder) else set()
    chain = spark.createDataFrame([(f"u{n}", f"u{n + 1}", 2.0) for n in range(40)], "unit string, other string, factor double")
    closed = {r["unit"]: r for r in U.unit_closure(chain).collect()}
    assert len(closed) == 41 and {r["canonical"] for r in closed.values()} == {"u0"} and closed["u1"]["factor"] == 0.5
    assert len(set(os.listdir(folder)) - before) <= 2
