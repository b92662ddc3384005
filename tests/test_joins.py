"""The joins that are no equality lose no pair and add none."""

import itertools
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from specforge.functions import similarity as S
from specforge.operators import search as E
from specforge.plans import similarity_join
from specforge.plans.similarity_join import containment_join, digit_substring_join, set_similarity_join
from specforge.sources import tables as D


def table(spark, sets):
    return spark.createDataFrame([(i, sorted(s)) for i, s in enumerate(sets)], "id long, members array<string>")


@pytest.mark.parametrize("common", [0, 5, 512])
def test_set_similarity_join_equals_all_pairs(spark, monkeypatch, common):
    monkeypatch.setattr(similarity_join, "COMMON", common)
    r = random.Random(7)
    left, right = ([{r.choice("abcdefghijklmnop") for _ in range(r.randint(0, 9))} for _ in range(60)] for _ in range(2))
    for t in (0.3, 0.5, 0.8):
        want = {(i, j): len(a & b) / len(a | b) for (i, a), (j, b) in itertools.product(enumerate(left), enumerate(right)) if a | b and len(a & b) / len(a | b) >= t}
        got = {(x["left_id"], x["right_id"]): x["score"] for x in set_similarity_join(table(spark, left), table(spark, right), t).collect()}
        assert got == want


@settings(max_examples=4, deadline=None)
@given(st.lists(st.frozensets(st.sampled_from("abcde"), max_size=4), min_size=1, max_size=8), st.lists(st.frozensets(st.sampled_from("abcde"), max_size=5), min_size=1, max_size=8))
def test_containment_join(spark, left, right):
    want = {(i, j) for (i, a), (j, b) in itertools.product(enumerate(left), enumerate(right)) if a and a <= b}
    assert {(x[0], x[1]) for x in containment_join(table(spark, left), table(spark, right)).collect()} == want


def test_digit_substrings(spark):
    tokens, names = ["12345", "7715020", "99999"], ["хомут 4512345", "нп20-7715020-01", "x 1234 5", "7715020 12345"]
    got = digit_substring_join(spark.createDataFrame([(t,) for t in tokens], "token string"), spark.createDataFrame([(n,) for n in names], "name string"))
    assert {tuple(x) for x in got.collect()} == {(t, n) for t in tokens for n in names if t in n}


def test_searches_equal_all_pairs(spark, data):
    """On the smallest tables: names and articles that pass the thresholds, by brute force."""
    pooled = E.searchable(D.items(spark, data), D.sources(spark, data)).filter("source_type = 'company_catalog'")
    pooled = spark.createDataFrame(pooled.toPandas().astype(object).where(lambda x: x.notna(), None).iloc[:60], pooled.schema)
    lines = D.spec_items(spark, data).limit(80)
    names = lines.select(F.lower("name_raw").alias("query")).distinct()
    hits = {(x["query"], x["key"]): round(x["score"], 6) for x in E.lexical_hits(names, pooled).collect()}
    pairs = names.crossJoin(pooled.select(F.col("name_normalized").alias("key")).distinct())  # brute force on a small fixture
    q, k = S.stems(F.col("query")), S.stems(F.col("key"))
    held = (F.size(q) > 0) & (F.size(F.array_except(q, k)) == 0)
    sim = S.similarity(F.col("query"), F.col("key"))
    score = F.greatest(sim, F.when(held, S.text_rank(q, k)).otherwise(0.0))
    want = {(x["query"], x["key"]): round(x["score"], 6) for x in pairs.withColumn("score", score).filter(held | (sim >= 0.3)).collect()}
    assert hits == want
