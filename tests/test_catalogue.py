"""Registered engine queries against DuckDB over the smallest tables."""

import glob
import os

import pytest

from stratalog.plans.catalogue import ORACLE, QUERIES

DATA = "/root/testdata/sf0.001"
#: Those without a row by design.
EMPTY = {"out_of_range_const", "global_agg_empty"}
SOME = ["self_equal", "closure", "anti", "having", "circumscribe_final", "self_support", "derivation", "float_const", "string_const", "remainder_const", "scan_project", "ordered_wildcard", "out_of_range_const", "ground", "exists_clause", "multi_key", "triangle", "cross", "semi", "sum_group", "user_agg", "array_agg", "global_agg_empty", "clique", "turn_chain", "callback_flat", "incr_delta"]


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables")
@pytest.mark.parametrize("name", SOME)
def test_query(spark, name):
    import duckdb

    con = duckdb.connect()
    for p in glob.glob(f"{DATA}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM read_parquet('{p}')")
    want = con.sql(ORACLE[name])
    got = QUERIES[name](spark, DATA)
    assert sorted(got.columns) == sorted(want.columns)
    assert bool(got.take(1)) == (name not in EMPTY)
    order = [want.columns.index(c) for c in got.columns]
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(repr(tuple(r[k] for k in order)) for r in want.fetchall())


def test_joins_on_keys_shuffle_once(spark):
    """Rows of a declared key aren't deduplicated before a join, and keys are joined by plain equality."""
    for name, most in (("join3", 1), ("multi_key", 2)):
        plan = QUERIES[name](spark, DATA)._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange hashpartitioning") <= most and "IsNotNull(o_custkey)" in plan, plan
        # A join by null-safe equality has coalesced keys; nations, which are no key and may be null, are joined so in multi_key.
        assert name == "multi_key" or "coalesce(" not in plan, plan


def test_entry_imports():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
