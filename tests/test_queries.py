"""Every query with SQL gives the rows of its SQL, on the smallest tables."""

import math
import os

import pytest

from sparkloom import plans

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    for f in os.listdir(SF):
        con.sql(f"create view {f.removesuffix('.parquet')} as select * from '{SF}/{f}'")
    return con


def clean(v):
    if isinstance(v, float):
        return "NaN" if math.isnan(v) else v + 0.0
    return v


@pytest.mark.parametrize("name", sorted(plans.QUERIES))
def test_query(spark, duck, name):
    df = plans.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = [[clean(v) for v in r] for r in df.select(*columns).collect()]
    if name not in plans.SQL:
        assert got
        return
    rel = duck.sql(plans.SQL[name])
    assert sorted(rel.columns) == columns
    order = [rel.columns.index(c) for c in columns]
    want = [[clean(r[k]) for k in order] for r in rel.fetchall()] if not hasattr(rel, "limit") else [[clean(r[k]) for k in order] for r in rel.limit(1 << 40).fetchall()]
    assert sorted(map(repr, got)) == sorted(map(repr, want))


#: Queries over the 64-bit lane.
LANE64 = [
    "nd_abs_int64",
    "nd_add_int32_int64",
    "nd_add_int64_int64",
    "nd_div_int64",
    "nd_less",
    "nd_mul_int32_int64",
    "nd_mul_int64_int64",
    "nd_neg_int64",
    "nd_pow_int64",
    "nd_sub_int32_int64",
    "nd_sub_int64_int64",
    "nd_sum_int64",
]


@pytest.mark.parametrize("name", LANE64)
def test_keys_over_the_whole_64_bit_lane(spark, tmp_path, name):
    """Part keys of larger tables, at which the lane's product alone leaves 64 bits; in DuckDB it is taken in 128."""
    import duckdb

    con = duckdb.connect()
    con.sql(f"copy (select unnest([0, 1, 9999, 10000, 11529, 11530, 19999, 20000, 31530, 1199999])::bigint as p_partkey, 7::int as p_size) to '{tmp_path}/part.parquet' (format parquet)")
    con.sql(f"create view part as select * from '{tmp_path}/part.parquet'")
    want = con.sql(plans.SQL[name].replace("(i % 20000) * 800000000000003", "(i % 20000)::HUGEINT * 800000000000003"))
    got = plans.QUERIES[name](spark, str(tmp_path)).select(*want.columns).collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want.fetchall()))


def test_entry_points(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0 and set(e.oracle_sql()) <= set(e.queries())
