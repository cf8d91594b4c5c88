"""Queries against SQL where SQL can say them, and against brute force on the smallest tables."""

import itertools

import pytest
from helpers import DATA, same_as_sql

from parchmill.llm import catalog
from parchmill.llm.words import words

SQL, QUERIES = catalog.oracle_sql(), catalog.queries()


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, duck, name):
    same_as_sql(spark, duck, QUERIES[name], SQL[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_query_runs(spark, name):
    rows = QUERIES[name](spark, DATA).collect()
    assert rows and len(set(rows)) == len(rows)


def test_near_duplicates_equal_brute_force(spark):
    rows = {(r.chunk_id, r.text) for r in spark.read.parquet(f"{DATA}/chunks.parquet").select("chunk_id", "text").collect() if r.text}
    sets = {}
    for key, text in rows:
        w = words(text)
        if len(w) >= 40:
            sets[key] = {tuple(w[i : i + 3]) for i in range(len(w) - 2)}
    expected = {(a, b) for a, b in itertools.combinations(sorted(sets), 2) if len(sets[a] & sets[b]) >= 0.6 * len(sets[a] | sets[b])}
    assert {tuple(r) for r in QUERIES["p2_found"](spark, DATA).collect()} == expected


def test_links_and_pairs_agree(spark):
    rows = QUERIES["p2_links"](spark, DATA).collect()
    assert len({r.chunk_id for r in rows}) == len(rows)
