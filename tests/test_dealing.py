"""Records of large tables are joined without ordering the lines and dealt into shares of bounded size."""

from pyspark.sql import functions as F

from quaystone.operators import coverage as C
from quaystone.plans.registry import QUERIES
from quaystone.sources import trade as R
from tests.test_one_pass import ROWS, plan


def large(monkeypatch):
    monkeypatch.setattr(R, "SENT", 0)
    monkeypatch.setattr(R, "DEALT", 500)


def test_lines_of_large_tables_are_not_ordered(spark, sf, monkeypatch):
    small = R.records(spark, sf)
    assert plan(small).count("BroadcastHashJoin") == 4
    large(monkeypatch)
    n = -(-R.sizes(spark, sf)["lineitem"] // 500)
    out = R.records(spark, sf)
    assert "SortMergeJoin" not in plan(out) and plan(out).count("ShuffledHashJoin") == 4
    assert all(f"{n}), REPARTITION_BY_NUM" in line for line in plan(out).splitlines() if "Exchange hashpartitioning(l_" in line)
    assert out.columns == small.columns and out.exceptAll(small).count() == 0 == small.exceptAll(out).count()


def test_views_of_large_tables_order_nothing(spark, sf, monkeypatch):
    small = QUERIES["o_view_stock"](spark, sf)
    large(monkeypatch)
    out = QUERIES["o_view_stock"](spark, sf)
    assert "Sort" not in plan(out)
    assert sorted(out.collect()) == sorted(small.collect())


def test_totals_of_large_tables_are_the_same(spark, sf, monkeypatch):
    key = lambda df: sorted(map(str, df.collect()))
    names = ("c_coverage", "o_opportunities")
    small = [key(QUERIES[n](spark, sf)) for n in names]
    large(monkeypatch)
    assert [key(QUERIES[n](spark, sf)) for n in names] == small


def test_parts_are_dealt_into_given_partitions(spark):
    rows = spark.createDataFrame([], ROWS)
    signals = rows.withColumns({c: F.lit(True) for c in ("approved", "received", "no_customer", "no_party")}).withColumns({c: F.lit(1.0) for c in ("demand", "stock", "excess")})
    for out in (C.coverage(rows, 7), C.opportunity_groups(signals, partitions=7)):
        assert plan(out).count("Exchange hashpartitioning") == 1 and ", 7), REPARTITION_BY_NUM" in plan(out)


def test_parts_of_large_tables_are_dealt_by_size(spark, sf, monkeypatch):
    large(monkeypatch)
    n = R.partitions(spark, sf)
    for name in ("c_coverage_totals", "o_filtered", "o_top_opportunities"):
        assert any("Exchange hashpartitioning(part#" in line and f", {n}), REPARTITION_BY_NUM" in line for line in plan(QUERIES[name](spark, sf)).splitlines())
