import duckdb
import pytest

from thalassa.plans import catalog

DIR = "/root/testdata/sf0.001"
TABLES = "customer supplier part orders lineitem events embeddings".split()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{DIR}/{t}.parquet'")
    return c


def plain(rows, at):
    return sorted((tuple(r[i] for i in at) for r in rows), key=lambda r: tuple((v is None, str(v)) for v in r))


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_same_rows_as_sql(spark, con, name):
    got, want = catalog.QUERIES[name](spark, DIR), con.sql(catalog.ORACLES[name])
    cols = sorted(got.columns)
    assert cols == sorted(want.columns)
    a, b = plain(got.collect(), [got.columns.index(c) for c in cols]), plain(want.fetchall(), [want.columns.index(c) for c in cols])
    assert len(a) == len(b)
    for x, y in zip(a, b):
        for u, v in zip(x, y):
            assert u == (pytest.approx(v, rel=1e-6, abs=2e-6, nan_ok=True) if isinstance(v, float) else v)


def test_time_conversions_at_half_seconds(spark, con, tmp_path):
    """A day number as double tells ten microseconds apart; seconds are rounded and days cut off before that."""
    at = ", ".join(f"({i}, TIMESTAMP '2024-01-{i % 28 + 1:02d} {i % 24:02d}:{i % 60:02d}:{i % 60:02d}' + to_microseconds({us}))" for i, us in enumerate(x for x in (499_996, 499_999, 500_000, 500_001, 500_004) for _ in range(20)))
    con.execute(f"COPY (SELECT i::BIGINT AS event_id, t AS ts, i::BIGINT AS user_id FROM (VALUES {at}, (1000, TIMESTAMP '2024-01-05 23:59:59.999999'), (1001, TIMESTAMP '2024-01-05 00:00:00')) v(i, t)) TO '{tmp_path}/events.parquet' (FORMAT parquet)")
    got = catalog.QUERIES["time_conversions"](spark, str(tmp_path))
    own = duckdb.connect()
    own.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet'")
    want = own.execute(catalog.ORACLES["time_conversions"])
    at = [c[0] for c in want.description]
    assert sorted(tuple(r[c] for c in at) for r in got.collect()) == sorted(want.fetchall())
