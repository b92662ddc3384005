"""Scores written as arithmetic, the cascade, ranks, promotion, evaluation and import rules."""

import pytest
from pyspark.sql import functions as F

from specforge.operators import gold as G
from specforge.operators import importer as I
from specforge.operators import matching as M
from specforge.operators import review as R
from specforge.operators import search as E
from specforge.operators import transform
from specforge.plans.storage import settled
from specforge.sources import tables as D
from specforge.sources.tables import prepared

CATALOG = [
    ("SCR-T25-080-BR", "Саморез Т25х80 ART112 латунный", "TORVALD"), ("SCR-T25-100-BR", "Саморез Т25х100 ART112 латунный", "TORVALD"), ("SCR-T30-060", "Саморез Т30х60 ART112", "TORVALD"),
    ("CLP-D16", "Хомут Д16 ART207 латунный", "TORVALD"), ("RNG-D22", "Кольцо упорное Д22 ART330", "TORVALD"), ("HOOK-4-25", "Крючок потолочный 4х25", "HAKEN"),
    (None, "Насос поршневой НП20-7715020-01", "РИТМ"),
]
ITEM = "item_id string, source_id string, article_raw string, code_1c string, name string, manufacturer string, price decimal(18,4), unit string, is_active boolean, linked_catalog_item_id string"
LINE = "spec_item_id long, article_raw string, name_raw string, attributes_raw string, manufacturer_raw string, unit_raw string"


@pytest.fixture(scope="module")
def store(spark):
    rows = [(f"c{i}", "catalog", a, f"K-{i}", n, m, None, "шт", True, None) for i, (a, n, m) in enumerate(CATALOG)]
    rows += [("p0", "S1", "SCR.T25.080.BR", None, "Саморез Т25х80 (от поставщика)", None, None, "шт", True, "c3"), ("p1", "S2", "CLP-D16", None, "paused source", None, None, None, True, None)]
    items = prepared(spark.createDataFrame(rows, ITEM))
    sources = spark.createDataFrame(
        [("catalog", "company_catalog", "catalog", "active"), ("S1", "supplier_pricelist", "one", "active"), ("S2", "supplier_pricelist", "two", "paused")],
        "source_id string, source_type string, source_name string, status string",
    )
    return items, sources


@pytest.fixture(scope="module")
def found(spark, store):
    lines = [
        (1, "scr-t25-080-br", "Саморез", None, "Torvald", "шт"), (2, "SCR-T25-08O-BR", "что-то", None, None, None), (3, None, "Саморез Т30х60 ART112", None, None, "шт"),
        (4, None, "3л Н2-7715020-60 РИТМ", None, None, None), (5, None, None, None, None, None), (6, None, "совсем другое qqq", None, None, None),
    ]
    rows = M.match(spark.createDataFrame(lines, LINE), *store).collect()
    return {(r["spec_item_id"], r["source_type"], r["rank"]): r for r in rows}


def test_exact_article_stops_the_cascade(found):
    first = found[1, "company_catalog", 1]
    assert first["item_id"] == "c0" and float(first["confidence"]) == 1.0 and first["match_type"] == "exact_article"
    assert found[1, "supplier_pricelist", 1]["item_id"] == "p0" and float(found[1, "supplier_pricelist", 1]["confidence"]) == 0.97
    assert first["human_readable"] == "Артикул совпал точно, совпал бренд, совпала единица измерения"


def test_linked_card_is_promoted(found):
    second = found[1, "company_catalog", 2]
    assert second["item_id"] == "c3" and second["match_type"] == "hybrid" and float(second["confidence"]) == 0.97


def test_fuzzy_article_and_name(found):
    assert found[2, "company_catalog", 1]["item_id"] == "c0" and found[2, "company_catalog", 1]["match_type"] == "fuzzy_article"
    name = found[3, "company_catalog", 1]
    assert name["item_id"] == "c2" and float(name["confidence"]) == 1.0  # 1.0 lexical + 0.05 unit, capped


def test_code_inside_the_name(found):
    hit = found[4, "company_catalog", 1]
    assert hit["item_id"] == "c6" and hit["explanation"]["extracted_code_match"] == "in_name" and hit["explanation"]["brand_match"]


def test_nothing_to_search_for(found):
    assert not [k for k in found if k[0] in (5, 6)]


@pytest.mark.parametrize(
    "channels, article, brand, want",
    [
        ({"fuzzy": 0.8}, "A", None, 0.40), ({"lexical": 0.7}, None, None, 0.70), ({"fuzzy": 0.8, "lexical": 0.7}, "A", None, 0.75), ({"fuzzy": 0.8}, "A", "torvald", 0.50),
        ({"exact": 1.0}, "A", None, 0.95), ({"lexical": 0.4, "code_exact": 1.0}, None, None, 0.65), ({"lexical": 0.5, "code_fuzzy": 0.8}, None, None, 0.596),
        ({"lexical": 0.5, "code_name": 1.0}, None, None, 0.68),
    ],
)
def test_scores(spark, store, channels, article, brand, want):
    hits = spark.createDataFrame([("q", "c0", c, s, "X") for c, s in channels.items()], "qid string, item_id string, channel string, score double, code string")
    queries = spark.createDataFrame([("q", article, None)], "qid string, article string, unit string")
    brands = spark.createDataFrame([("q", brand)], "qid string, brand string")
    items = store[0].join(store[1], "source_id")
    assert float(M.score(M.merge_hits(hits), queries, brands, items).first()["confidence"]) == pytest.approx(want)


def test_segments_add_up(spark):
    lines = spark.createDataFrame([(i, 1, i) for i in range(1, 7)], "spec_item_id long, spec_id long, line_number int")
    c = [(1, "c1", "company_catalog", 0.95, 1), (2, "c1", "company_catalog", 0.6, 1), (3, "c1", "company_catalog", 0.2, 1), (4, "p1", "supplier_pricelist", 0.9, 1), (4, "p2", "supplier_pricelist", 0.99, 2)]
    candidates = spark.createDataFrame(c, "spec_item_id long, item_id string, source_type string, confidence double, rank int").withColumn("confidence", F.col("confidence").cast("decimal(5,4)"))
    done = spark.createDataFrame([(1, "confirmed", "c1"), (2, "rejected", None)], "spec_item_id long, decision string, chosen_item_id string")
    states = R.line_states(lines, candidates, done)
    n = R.counters(states).first()
    assert n["high"] + n["medium"] + n["low"] + n["no_candidate"] == n["total"] == 6 and n["not_found"] == n["low"] + n["no_candidate"] == 3
    assert {s: R.segment(states, s).count() for s in R.SEGMENTS} == {"all": 6, "pending": 4, "confirmed": 1, "rejected": 1, "forwarded": 0, "high": 2, "mid": 1, "low": 1, "no_candidate": 2}
    assert {r["spec_item_id"] for r in R.auto_confirm(candidates, done).collect()} == {4}


def test_evaluation(spark, store):
    gold = [(1, "x", "найдено", "SCR-T25-080-BR", None), (2, "x", "аналог", None, "K-1"), (3, "x", "найдено", "WRONG", None), (4, "x", "не найдено", None, None), (5, "x", "сомнительно", None, None)]
    gold = spark.createDataFrame(gold, "gold_id long, name string, label_status string, expected_article string, expected_code_1c string")
    candidates = spark.createDataFrame([(1, "c0", 1), (2, "c1", 1), (3, "c2", 1)], "spec_item_id long, item_id string, rank int")
    m = G.metrics(G.first_hit_ranks(gold, candidates, store[0])).first()
    assert (m["total"], m["skipped"], m["applicable"], m["not_found"], m["not_found_right"]) == (5, 1, 3, 1, 1)
    assert m["recall_at_k"] == m["precision_at_1"] == m["mrr"] == pytest.approx(2 / 3, abs=1e-6)


def test_replace_import_is_stable(spark):
    stored = prepared(spark.createDataFrame([(f"i{k}", "S1", None, f"K-{k}", f"old {k}", None, None, "шт", True, None) for k in range(1, 6)], ITEM))
    lines = [("S1", k, None, f"K-{k}", f"new {k}", None, None, "шт") for k in (1, 2, 3, 4, 6)]
    rows = spark.createDataFrame(lines, "source_id string, line_number long, article_raw string, code_1c string, name string, manufacturer string, price decimal(18,4), unit string")
    after = I.upsert(stored, rows)
    got = {r["code_1c"]: (r["item_id"], r["change"], r["is_active"], r["name"]) for r in after.collect()}
    assert got["K-1"] == ("i1", "updated", True, "new 1") and got["K-5"] == ("i5", "deactivated", False, "old 5") and got["K-6"][1] == "inserted"
    again = I.upsert(after.drop("change"), rows)
    assert {r["code_1c"]: r["item_id"] for r in again.collect()} == {c: x[0] for c, x in got.items()}
    assert again.filter("change = 'inserted'").count() == 0


def test_transformations(spark):
    rows = spark.createDataFrame([("S1", "Саморез Т25 // Orla", None, 120.0, "", None), ("S2", "Хомут", "X", 110.0, "кг", "EUR")], "supplier_id string, name string, manufacturer string, price double, unit string, currency string")
    texts = [("S1", r'{"vat_rate": 20, "default_unit": "шт", "brand_regex": "(.+?)\\s*//\\s*(\\S+)", "default_currency": "RUB"}'), ("S2", "{broken")]
    settings = transform.load_settings(spark.createDataFrame(texts, "supplier_id string, settings string"))
    got = {r["supplier_id"]: (r["name"], r["manufacturer"], float(r["price"]), r["unit"], r["currency"]) for r in transform.apply(rows, settings).collect()}
    assert got == {"S1": ("Саморез Т25", "Orla", 100.0, "шт", "RUB"), "S2": ("Хомут", "X", 110.0, "кг", "EUR")}


def test_imports_never_make_an_id_twice(spark):
    stored = prepared(spark.createDataFrame([("i1", "S1", None, "K-1", "old", None, None, "шт", True, None)], ITEM)).withColumn("created_at", F.timestamp_seconds(F.lit(0)))
    rows = spark.createDataFrame([("S1", 1, None, None, "no key", None, None, "шт")], "source_id string, line_number long, article_raw string, code_1c string, name string, manufacturer string, price decimal(18,4), unit string")
    once = I.upsert(stored, rows)
    twice = I.upsert(once.drop("change"), rows).collect()
    assert len({r["item_id"] for r in twice}) == len(twice) == 3
    assert all(r["created_at"] is not None for r in twice)


def test_numbers_follow_the_own_prefix(spark):
    schema = ITEM + ", created_at timestamp, supplier_sku string"
    rows = [("i1", "S1", "A1", None, "n", None, None, None, True, None, None, "ABC-000007"), ("i2", "S1", "A2", None, "n", None, None, None, True, None, None, "OTHER-000900"), ("i3", "S1", "A3", None, "n", None, None, None, True, None, None, None)]
    suppliers = spark.createDataFrame([("S1", "ABC")], "supplier_id string, prefix string")
    got = {r["item_id"]: r["supplier_sku"] for r in I.assign_sku(prepared(spark.createDataFrame(rows, schema)), suppliers).collect()}
    assert got == {"i1": "ABC-000007", "i2": "OTHER-000900", "i3": "ABC-000008"}


def test_only_reached_lines_are_matched_again(spark, data):
    """Of the lines, those that an import can reach are few; the others keep candidates that a full match would give."""
    lines, items, sources = D.spec_items(spark, data), settled(D.stored_items(spark, data)), D.sources(spark, data)
    key = F.split_part(F.expr("substring(item_id, 2)"), F.lit("-"), F.lit(1)).cast("long")
    other = settled(items.withColumn("name_normalized", F.when(key == 40, F.concat("name_normalized", F.lit(" new"))).otherwise(F.col("name_normalized"))))
    queries = settled(M.match_inputs(lines).drop("spec_item_id").dropDuplicates(["qid"]))
    pool = lambda df: settled(E.searchable(df, sources).select(*M.POOLED, "linked_catalog_item_id"))
    old, new = pool(items), pool(other)
    assert 0 < M.affected_queries(queries, old, new).count() < 0.2 * queries.count()
    assert M.affected_queries(queries, old, old).isEmpty()


def test_levels_change_no_search(spark):
    """Queries with many, few and no names at the high level; crowds of equal scores; one word that most names hold."""
    kinds = ["болт", "гайка м8", "шайба", "винт оцинкованный", "bolt", "m8 washer"]
    names = [f"{kinds[i % 6]} {'стальной' if i % 3 else 'латунный'} {i % 17}" for i in range(300)]
    items = spark.createDataFrame([(f"i{i}", n, n.lower()) for i, n in enumerate(names)], "item_id string, name string, name_normalized string")
    asked = spark.createDataFrame([(q,) for q in [*names[:12], "болт", "bolt", "болт стальной 999", "нечто", "гайка"]], "query string")
    found = lambda levels, pool: sorted(map(tuple, E.lexical_name(asked, items, pool=pool, levels=levels).collect()))
    for pool in (3, 20):
        assert found((), pool) == found((0.8, 0.5), pool)
    assert len(found((0.8, 0.5), 3)) > 40
