"""Registered queries against their SQL, on the smallest tables."""

import decimal

import duckdb
import pytest

import __spark_entry__ as entry
from specforge.plans import queries as core

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
CHECKED = ["b4_denoise_name", "b5_article_candidates", "b13_stems", "c2_vat_removal", "d7_upsert_replace", "d9_assign_sku", "d10_link_to_catalog", "d10_link_by_code", "p2_price_list_feed", "r5_unit_closure", "r5_canonical_quantities", "r8_synonym_pairs", "r6_attributes", "r6_near_attributes", "r4_decision_windows", "r4_unfound_by_day", "r4_work_sessions", "g13_card_labels", "e3_lexical_name", "e4_code_in_name", "e8_manual_search", "e9_semantic_search", "e10_hybrid_search", "a1_delimited", "f13_match", "f17_rematch_import", "h1_gold_headers", "h2_gold_rows",
           "f1_brands", "f2_exact_lines", "g1_current_decisions", "g10_counters", "h5_metrics", "a11_rows", "a18_export", "r1_price_list_changes", "p3_decision_stream"]


def canonical(frame):
    def one(v):
        if v is None or v != v:
            return None
        if isinstance(v, decimal.Decimal | float):
            return round(float(v), 6) + 0.0
        return v

    frame = frame[sorted(frame.columns)]
    return sorted((tuple(one(v) for v in row) for row in frame.astype(object).itertuples(index=False)), key=repr)


@pytest.mark.parametrize("name", CHECKED)
def test_query_equals_sql(spark, data, name):
    db = duckdb.connect()
    for t in TABLES:
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{data}/{t}.parquet'")
    got, want = core.QUERIES[name](spark, data).toPandas(), db.execute(core.SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert canonical(got) == canonical(want)


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
