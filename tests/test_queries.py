"""Queries against their SQL on the smallest tables."""

import duckdb
import pytest

import __spark_entry__ as entry
from rangeloom.queries import QUERIES, SQL

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents pages".split()
SOME = (
    "merge_windows overlap_join_binned enclosing_scope snap_range capped_steps files_covered parse_diff_files fallback_nodes expand_to_block validated_steps playback_states coerce_range "
    "prompt_texts quoted_paths browser_rows status_lines coverage_notes request_bodies origin_lists chunk_texts"
).split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", SOME)
def test_query(spark, duck, name):
    got = QUERIES[name](spark, SF)
    wanted = duck.execute(SQL[name])
    columns = [c[0] for c in wanted.description]
    assert sorted(got.columns) == sorted(columns)
    rows = sorted(map(tuple, got.select(*columns).collect()), key=repr)
    assert rows == sorted(wanted.fetchall(), key=repr)


def test_entry(spark):
    assert set(entry.oracle_sql()) <= set(entry.queries()) and set(SQL) <= set(QUERIES)
    assert entry.entry(spark).limit(1).count() == 1
