"""Every registered query against its SQL, on the smallest data; and plans that must keep their shape."""

import glob
import os

import pytest

SF = "/root/testdata/sf0.001"
duckdb = pytest.importorskip("duckdb")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")

from tidemark import adapters, plans  # noqa: E402
from tidemark.operators import factors  # noqa: E402


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        c.sql(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    return c


def text(v):
    if v is None or v != v:
        return "~"
    if isinstance(v, float):
        return f"{v + 0.0:.8g}"
    return str(v).removesuffix(" 00:00:00")


@pytest.mark.parametrize("name", sorted(plans.QUERIES))
def test_query(spark, duck, name):
    df = plans.QUERIES[name](spark, SF)
    got = sorted(tuple(text(v) for v in r) for r in df.collect())
    if name in plans.ORACLE:
        want = duck.sql(f"SELECT {', '.join(df.columns)} FROM ({plans.ORACLE[name]})").fetchall()
        assert got == sorted(tuple(text(v) for v in r) for r in want)
    else:
        assert len(set(df.columns)) == len(df.columns)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_scans_are_pruned(spark):
    p = plan(adapters.daily_bars(spark, SF).where("symbol = '000001'").select("symbol", "close"))
    schema = p.split("ReadSchema: struct<", 1)[1].split(">", 1)[0]
    assert "l_tax" not in schema and "l_returnflag" not in schema
    o = adapters.table(spark, SF, "orders").where("o_orderstatus = 'F'").select("o_orderkey")
    assert "PushedFilters: [IsNotNull(o_orderstatus), EqualTo(o_orderstatus,F)]" in plan(o)


def test_the_grid_occurs_once_for_any_number_of_factors(spark):
    from tidemark.plans import factors as pf

    one, four = (plan(factors.standardise(pf.price_factors(spark, SF), names, ["session"])) for names in (pf.NAMES[:1], pf.NAMES))
    assert one.count("Generate") == four.count("Generate") == 1 and one.count("Exchange") == four.count("Exchange")
    b = plan(adapters.bars(spark, SF).where("session >= '2000-01-01'").select("symbol", "close"))
    assert "GreaterThanOrEqual(session" in b and "volume" not in b.split("ReadSchema: struct<", 1)[1].split(">", 1)[0]


def test_no_cartesian_products(spark):
    b = adapters.bars(spark, SF)
    assert "CartesianProduct" not in plan(factors.price_factors(b, adapters.adjustments(b)))


@pytest.mark.parametrize("name", ["t2_minute_breadth", "t4_unique_events", "t7_state_machine", "t9_idempotent_sink"])
def test_streams_read_a_folder_of_unordered_files(spark, duck, tmp_path, name):
    spark.read.parquet(f"{SF}/events.parquet").repartition(20, "event_id").write.parquet(f"{tmp_path}/events.parquet")
    df = plans.QUERIES[name](spark, str(tmp_path))
    want = duck.sql(f"SELECT {', '.join(df.columns)} FROM ({plans.ORACLE[name]})").fetchall()
    assert sorted(tuple(text(v) for v in r) for r in df.collect()) == sorted(tuple(text(v) for v in r) for r in want)
