"""Every registered query against its SQL on the smallest tables."""

from collections import Counter

import duckdb
import pytest

from graphlens.plans import registry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
KINDS = {"bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "double": "DOUBLE", "boolean": "BOOLEAN"}


@pytest.fixture(scope="module")
def duck(sf_dir):
    found = duckdb.connect()
    for t in TABLES:
        found.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return found


def plain(rows):
    return Counter(tuple("~" if x is None else f"{x:.6f}" if isinstance(x, float) else str(x) for x in r) for r in rows)


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query(name, spark, duck, sf_dir):
    df = registry.queries()[name](spark, sf_dir)
    columns = sorted(df.columns)
    rows = [tuple(r) for r in df.select(*columns).collect()]
    if sql := registry.oracle_sql().get(name):
        relation = duck.sql(sql)
        assert sorted(relation.columns) == columns
        kinds = dict(zip(relation.columns, map(str, relation.types), strict=True))
        assert all(kinds[c] == KINDS[k] for c, k in df.dtypes if k in KINDS)
        assert plain(rows) == plain(relation.project(", ".join(f'"{c}"' for c in columns)).fetchall())
    else:
        assert rows


def test_entry(spark):
    import __spark_entry__ as entry

    assert set(registry.queries()) <= set(entry.queries()) and entry.entry(spark).count() > 0
