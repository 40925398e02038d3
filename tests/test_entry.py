"""Every catalogue query against its SQL on the smallest tables."""

import duckdb
import pytest

from logtide.plans import catalogue

SF = "/root/testdata/sf0.001"


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])

    def text(x):
        return "null" if x is None else f"{x:.9g}" if isinstance(x, float) else str(x)

    return sorted(columns), sorted(tuple(text(r[i]) for i in order) for r in data)


@pytest.fixture(scope="session")
def duck():
    con = duckdb.connect()
    con.execute(f"create view events as select * from '{SF}/events.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(catalogue.ORACLE_SQL))
def test_query(spark, duck, name):
    df = catalogue.QUERIES[name](spark, SF)
    cur = duck.execute(catalogue.ORACLE_SQL[name])
    expected = rows([c[0] for c in cur.description], cur.fetchall())
    assert rows(df.columns, [tuple(r) for r in df.collect()]) == expected


def test_ring_query(spark):
    from logtide.operators.delivery import Ring

    got = {r["position"] for r in catalogue.QUERIES["follow_dedup_ring"](spark, SF).collect()}
    log = [(r["position"], f"user-{r['user_id']}") for r in catalogue.log(spark, SF).orderBy("position").collect()]
    ring = Ring(64)
    assert got == {p for p, x in log if ring.first_sight(x)}


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).columns == ["entity_type", "key", "composite_key", "value", "position"]
    assert set(entry.oracle_sql()) <= set(entry.queries())
