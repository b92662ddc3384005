"""Queries against their SQL on tables whose keys have more than six digits, as large tables have."""

import duckdb
import pytest

from specforge.plans import queries as core
from tests.test_queries import canonical

SHIFTED = {"part": ["p_partkey"], "lineitem": ["l_partkey"]}


@pytest.fixture(scope="module")
def large_keys(data, tmp_path_factory):
    folder = tmp_path_factory.mktemp("large_keys")
    db = duckdb.connect()
    for t in ("part", "lineitem", "supplier"):
        moved = ", ".join(f"({k} + 999900)::bigint AS {k}" for k in SHIFTED.get(t, []))
        db.execute(f"COPY (SELECT * {f'REPLACE ({moved})' if moved else ''} FROM '{data}/{t}.parquet') TO '{folder}/{t}.parquet' (FORMAT parquet)")
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    db.execute(f"CREATE VIEW events AS SELECT * FROM '{data}/events.parquet'")
    for t in ("orders", "customer"):
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{data}/{t}.parquet'")
    return str(folder), db


@pytest.mark.parametrize("name", ["d9_assign_sku", "d13_backfill_sku"])
def test_numbers_of_large_keys_equal_sql(spark, large_keys, name):
    folder, db = large_keys
    got, want = core.QUERIES[name](spark, folder).toPandas(), db.execute(core.SQL[name]).df()
    assert canonical(got) == canonical(want)
