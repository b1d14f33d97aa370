"""Every query that has SQL against DuckDB over the same tables."""

import math

import duckdb
import pandas as pd
import pytest

from pyspark.sql import functions as F

from arrayloom.operators import planning as P
from arrayloom.operators import reads as R
from arrayloom.queries import ORACLE_SQL, QUERIES, hours

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def rows(frame):
    names = sorted(frame.columns)

    def plain(x):
        if x is None or x is pd.NA or isinstance(x, float) and math.isnan(x):
            return None
        return round(float(x), 6) if isinstance(x, (int, float)) and not isinstance(x, bool) else x

    return names, sorted((tuple(plain(x) for x in r) for r in frame[names].astype(object).itertuples(index=False)), key=str)


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_against_sql(spark, sf_dir, duck, name):
    got, want = QUERIES[name](spark, sf_dir).toPandas(), duck.execute(ORACLE_SQL[name]).df()
    assert rows(got) == rows(want)
    assert len(got)


def test_budgeted_ranges(spark, sf_dir):
    """Against one file's ranges after the other, over the table; a few cases of the rule."""

    def plain(ranges, tolerance, budget, grid, size):
        out = []
        for begin, end in sorted(ranges):
            begin, end = begin // grid * grid, min(end, size)
            last = out[-1] if out else None
            if last and begin - last[1] <= tolerance and (max(end, last[1]) - last[0] <= budget or end <= last[1]):
                out[-1] = (last[0], max(end, last[1]), last[2] + 1)
            else:
                out.append((begin, end, 1))
        return out

    assert plain([(0, 10), (12, 20), (15, 40), (85, 99)], 2, 25, 1, 90) == [(0, 20, 2), (15, 40, 1), (85, 90, 1)]
    rows = hours(spark, sf_dir).selectExpr("user_id as key", "micros as begin", "micros + 1800000000 as end").collect()
    by_key = {}
    for r in rows:
        by_key.setdefault(r.key, []).append((r.begin, r.end))
    want = sorted((k, *x) for k, some in by_key.items() for x in plain(some, 7_200_000_000, 36_000_000_000, 1_000_000, 1 << 62))
    got = QUERIES["range_merge_budgeted"](spark, sf_dir)
    assert sorted(map(tuple, got.collect())) == want and dict(got.dtypes)["key"] == "bigint"
    cases = spark.createDataFrame([("a", 0, 10), ("a", 12, 20), ("a", 15, 40), ("a", 85, 99), ("b", 0, 50), ("b", 10, 30)], "key string, begin long, end long")
    assert sorted(map(tuple, P.budgeted_ranges(cases, 2, 25, 1, 90).collect())) == [("a", 0, 20, 2), ("a", 15, 40, 1), ("a", 85, 90, 1), ("b", 0, 50, 2)]
    assert P.budgeted_ranges(cases.where("false"), 2, 25).count() == 0


def test_sanitizers(spark):
    good = spark.createDataFrame([(0, 4, 10, 0, 5)], "y_off long, y_len long, y_size long, y_at long, y_room long")
    bad = good.withColumn("y_off", F.lit(8).cast("long"))
    assert R.sanitize(good, ["y"]).count() == 1 and R.sanitize(bad, ["y"], R.clip).first().y_len == 2
    with pytest.raises(Exception, match="outside"):
        R.sanitize(bad, ["y"]).collect()
    with pytest.raises(ValueError):
        R.sanitize(good, ["y", "x"])
    with pytest.raises(ValueError):
        R.sanitize(good, ["y"], lambda df, axes: df.drop("y_at"))
    assert R.sanitize(bad, ["y"], lambda df, axes: df.where("y_off < 5")).count() == 0


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_whole_tables(spark):
    """The queries over whole tables read every row, where a table has more than the small one."""
    folder = "/root/testdata/sf0.1"
    con = duckdb.connect()
    for t in ("embeddings", "orders"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    got = {n: QUERIES[n](spark, folder).toPandas() for n in ("read_batch", "subset_rows", "scratch_overlay", "chunk_fill")}
    for n, frame in got.items():
        want, names = con.execute(ORACLE_SQL[n]).df(), sorted(frame.columns)
        assert names == sorted(want.columns) and sorted(frame[names].itertuples(index=False, name=None)) == sorted(want[names].itertuples(index=False, name=None))
    images, orders = (con.execute(f"SELECT count(*) FROM {t}").fetchone()[0] for t in ("embeddings", "orders"))
    assert images > 512 and len(set(got["read_batch"].idx)) == images and len(got["read_batch"]) == orders
    assert len(set(got["subset_rows"].o_orderkey)) > 0.6 * orders and sorted(got["subset_rows"].pos) == list(range(orders))
    assert len(set(got["scratch_overlay"].idx)) == images and got["scratch_overlay"].cached.sum() == -(-images // 3)
    assert (got["chunk_fill"].v == -7).sum() == len(got["chunk_fill"]) - images >= 16
