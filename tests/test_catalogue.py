"""Each catalogued query against its SQL in DuckDB."""

import os

import duckdb
import pytest

from codestrata.plans import catalogue

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf_dir):
    connection = duckdb.connect()
    for name in TABLES:
        path = f"{sf_dir}/{name}.parquet"
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    return connection


def test_every_query_has_sql():
    assert set(catalogue.QUERIES) == set(catalogue.ORACLE_SQL)


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query_equals_sql(spark, duck, sf_dir, name):
    found = catalogue.QUERIES[name](spark, sf_dir)
    columns = sorted(found.columns)
    result = duck.execute(catalogue.ORACLE_SQL[name])
    there = [d[0] for d in result.description]
    assert sorted(there) == columns
    expected = sorted(repr(tuple(row[there.index(c)] for c in columns)) for row in result.fetchall())
    assert sorted(repr(tuple(row[c] for c in columns)) for row in found.collect()) == expected


def test_entry_module(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_outlines_prompts_and_bodies_grow_with_the_input(spark, sf_dir):
    customers = spark.read.parquet(f"{sf_dir}/customer.parquet").count()
    lines = [x for r in catalogue.QUERIES["q36_customer_outline"](spark, sf_dir).collect() for x in r.outline.split("\n") if x.startswith("  - ")]
    prompts = catalogue.QUERIES["q37_packed_prompts"](spark, sf_dir).collect()
    assert len(lines) == customers
    assert sorted(x for r in prompts for x in r.prompt.split("\n") if x.startswith("  - ")) == sorted(lines)
    assert max(r.tokens for r in prompts) < 250
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    bodies = catalogue.QUERIES["q38_requested_bodies"](spark, sf_dir).collect()
    assert bodies and all(r.body == texts[r.doc_id] for r in bodies)
