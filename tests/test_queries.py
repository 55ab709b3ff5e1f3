"""Every query with SQL against DuckDB, on a small copy of the tables made here."""

import os

import pytest

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def rows(columns, data):
    def plain(v):
        return round(v, 6) if isinstance(v, float) else tuple(map(plain, v)) if isinstance(v, (list, tuple)) else v

    order = sorted(range(len(columns)), key=columns.__getitem__)
    return sorted(columns), sorted((tuple(plain(r[k]) for k in order) for r in data), key=repr)


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
def test_catalogue_equals_sql(spark):
    import duckdb

    from vacancia.plans.catalogue import QUERIES, SQL

    con = duckdb.connect()
    for f in os.listdir(DATA):
        con.sql(f"CREATE VIEW {f[:-8]} AS SELECT * FROM '{DATA}/{f}'")
    wrong = []
    for name, f in QUERIES.items():
        df = f(spark, DATA)
        got = rows(df.columns, map(tuple, df.collect()))
        if name in SQL:
            rel = con.sql(SQL[name])
            if got != rows(list(rel.columns), rel.fetchall()):
                wrong.append(name)
    assert not wrong
