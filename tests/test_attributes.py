"""Attributes in names, and the band join against all pairs."""

import random

import pytest
from pyspark.sql import functions as F

from specforge.operators import attributes as A


def test_attributes_of_names(spark):
    names = [
        "Болт Д16х80 ГОСТ 7798-70", "Pipe d = 16,5 мм L=2 м", "Труба ø 3см длина 1.25m DIN 912, din 912", "Кабель 16х80 мм", "PID16 модель7х", "Гайка ГОСТ Р 5915", None, "", "d", "x80", "Д" + "9" * 30,
        "Ось Д7 Д7 Д8 " + "слово " * 20_000,
    ]
    rows = spark.createDataFrame(list(enumerate(names)), "id long, name string")
    got = {}
    for r in A.attributes(rows).collect():
        got.setdefault(r["id"], set()).add((r["kind"], r["text"] if r["value"] is None else r["value"]))
    assert got == {
        0: {("diameter", 16.0), ("length", 80.0), ("standard", "гост 7798-70")},
        1: {("diameter", 16.5), ("length", 2000.0)},
        2: {("diameter", 30.0), ("length", 1250.0), ("standard", "din 912")},
        3: {("length", 80.0)},
        5: {("standard", "гост 5915")},
        10: {("diameter", 999999999.0)},
        11: {("diameter", 7.0), ("diameter", 8.0)},
    }


@pytest.mark.parametrize("tolerance", [0.1, 2.5])
def test_band_join_equals_all_pairs(spark, tolerance):
    r = random.Random(4)
    made = lambda n: [(r.choice("ab"), r.choice([None, 0.0, 0.3, float("nan"), round(r.uniform(-3, 3), 1)])) for _ in range(n)]
    left, right = made(150), made(150) + [("a", 0.3)] * 300
    frame = lambda x: spark.createDataFrame(x, "kind string, value double")
    got = sorted(tuple(x) for x in A.band_join(frame(left), frame(right), tolerance).collect())
    want = {(k, v, w, round(abs(v - w), 9)) for k, v in left for j, w in right if k == j and None not in (v, w) and v == v and w == w and round(abs(v - w), 9) <= tolerance}
    assert got == sorted(want) and len(got) > 20
    with pytest.raises(ValueError):
        A.band_join(frame(left), frame(right), 0)


def test_closest_items_in_order(spark):
    items = spark.createDataFrame([("i1", "b Д10"), ("i2", "a Д10"), ("i3", "c Д11 Д12"), ("i4", "d Д19"), ("i5", None)], "item_id string, name string")
    asked = spark.createDataFrame([("diameter", 11.0), ("diameter", 50.0), ("length", 11.0), ("diameter", None)], "kind string, value double")
    got = A.near_attributes(asked, items, 2.0, 3).orderBy("distance", F.desc("item_id")).collect()
    assert [(r["value"], r["item_id"], r["distance"]) for r in got] == [(11.0, "i3", 0.0), (11.0, "i2", 1.0), (11.0, "i1", 1.0)]
    assert A.near_attributes(asked, items.limit(0), 2.0).collect() == []
