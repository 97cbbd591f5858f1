"""Every registered query of the core against its SQL twin on the smallest driver tables."""

import datetime
import os

import duckdb
import pytest

from pagemill.plans import catalog

DATA = "/root/testdata/sf0.001"
NO_TWIN = {"cooldown_machine", "chunk_rows", "near_dup_greedy", "page_extract", "page_links_scoped", "bandwidth_pauses", "robots_allowed", "training_export"}


def plain(x):
    if isinstance(x, float):
        return round(x, 6)
    if isinstance(x, datetime.datetime):
        return x.replace(tzinfo=None)
    return x


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in os.listdir(DATA):
        con.execute(f"create view {name.split('.')[0]} as select * from '{DATA}/{name}'")
    return con


def test_each_query_has_a_twin_or_is_named():
    assert set(catalog.queries()) - set(catalog.oracle_sql()) == NO_TWIN


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query_matches_sql(spark, duck, name):
    df = catalog.queries()[name](spark, DATA)
    columns = sorted(df.columns)
    got = sorted(repr([plain(r[c]) for c in columns]) for r in df.collect())
    result = duck.execute(catalog.oracle_sql()[name])
    names = [c[0] for c in result.description]
    assert sorted(names) == columns
    assert got == sorted(repr([plain(r[names.index(c)]) for c in columns]) for r in result.fetchall())


@pytest.mark.parametrize("name", sorted(NO_TWIN))
def test_query_runs(spark, name):
    catalog.queries()[name](spark, DATA).collect()
