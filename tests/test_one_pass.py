"""Bags, coverage and column profiles read the records once and deal them out no more than they need."""

import pytest
from pyspark.sql import functions as F

from quaystone.functions.scalars import normalize_mpn, settled
from quaystone.operators import bags as B
from quaystone.operators import coverage as C
from quaystone.operators import structure as K
from quaystone.plans.registry import QUERIES
from quaystone.sources import trade as R
from quaystone.sources import twofile as F2

ROWS = "id long, upload_batch_id long, created_at timestamp, part string, is_stock boolean, is_need boolean, stock_qty double, need_qty double, customer string, supplier string, maker string"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_layouts_are_those_of_the_records(spark, sf):
    keys = [F.map_keys("raw_data").alias("a"), F.map_keys("normalized_data").alias("b")]
    met = {(r.category, tuple(r.a), tuple(r.b)) for r in R.bags(spark, sf).select("category", *keys).distinct().collect()}
    assert met and met <= {(r.category, tuple(r.a), tuple(r.b)) for r in R.layouts(spark, sf).select("category", *keys).collect()}


def test_known_layouts_need_no_look_at_the_rows(spark):
    def unread(v):
        raise AssertionError("a row was read")

    known = spark.createDataFrame([({"Qty": None}, {"mpn": None})], "raw_data map<string,string>, normalized_data map<string,string>")
    rows = spark.range(1).select("id", F.create_map(F.lit("Qty"), F.udf(unread)("id")).alias("raw_data"), F.create_map(F.lit("mpn"), F.lit("x")).alias("normalized_data"))
    out = B.located(rows, {"mpn": B.Field(["MPN"])}, layouts=known)
    own = rows.withColumn("raw_data", F.create_map(F.lit("Qty"), F.lit("5")))
    assert [r.v for r in B.located(own, {"mpn": B.Field(["MPN"])}, layouts=known).select(B.value("mpn").alias("v")).collect()] == ["x"]
    assert "places" in out.columns
    other = own.withColumn("raw_data", F.create_map(F.lit("Stock"), F.lit("5")))
    with pytest.raises(Exception, match="a layout that is not among"):
        B.located(other, {"mpn": B.Field(["MPN"])}, layouts=known).select(B.value("mpn")).collect()


def test_a_parts_rows_are_dealt_out_once(spark):
    rows = spark.createDataFrame([], ROWS)
    assert plan(C.coverage(rows)).count("Exchange hashpartitioning") == 1
    signals = rows.withColumns({c: F.lit(True) for c in ("approved", "received", "no_customer", "no_party")}).withColumns({c: F.lit(1.0) for c in ("demand", "stock", "excess")})
    assert plan(C.opportunity_groups(signals)).count("Exchange hashpartitioning") == 1


def test_column_profile_reads_records_once(spark, sf):
    assert plan(QUERIES["o_column_profile"](spark, sf)).count("lineitem.parquet") == 1


def test_names_alone_make_the_same_profile(spark, sf):
    assert sorted(K.column_profile(R.bag_names(spark, sf)).collect()) == sorted(K.column_profile(R.bags(spark, sf)).collect())


def test_rows_stay_where_they_lie_below_headers(spark, monkeypatch):
    cells = [("demand.csv", "A", 0, ["Mfg Part No", "Required Qty"])] + [("demand.csv", "A", i, [f"X-{i}", str(i)]) for i in range(1, 40)] + [("demand.csv", "A", 40, ["QTY", "MPN", "Open Qty"]), ("demand.csv", "A", 41, ["", "x-41", "7"])]
    df = spark.createDataFrame(cells, "file string, sheet string, row_index int, cells array<string>")
    few = F2.canonical_rows(df, "demand")
    assert "SortMergeJoin" not in plan(few) and "hashpartitioning" not in plan(few)
    monkeypatch.setattr(F2, "HEADERS", 1)
    many = F2.canonical_rows(df, "demand")
    assert sorted(few.collect()) == sorted(many.collect()) and few.count() == 40


def test_columns_are_worked_out_below_the_generator(spark):
    out = plan(settled(spark.range(3), "id", normalize_mpn(F.col("id").cast("string")).alias("part")).filter("part is not null"))
    generate = next(line for line in out.splitlines() if "Generate " in line)
    assert "regexp_replace" not in generate and "regexp_replace" in out


def test_rows_carry_numbers_of_places(spark):
    known = spark.createDataFrame([({"Approved": None, "Qty": None}, {"AVL": None})], "raw_data map<string,string>, normalized_data map<string,string>")
    values = ["Infinity", " -inf", "-Infinity", "NaN", "nan", "-1", " +0.0 ", "-.5", ".0", "1d", "-1d", "0x", "Yes", "open", "no", "none", "Not Approved", "nil", "\t0", " ", "", None]
    rows = spark.createDataFrame([({"Approved": v, "Qty": "1"}, {"AVL": v}) for v in values], "raw_data map<string,string>, normalized_data map<string,string>")
    out = B.located(rows, {"approved": B.Field(B.APPROVED)}, layouts=known)
    assert {f.dataType.simpleString() for f in out.schema["places"].dataType.fields} == {"array<int>"}
    shown = out.select(F.size(B.shown("approved")).alias("n"), B.value("approved").alias("v")).collect()
    assert sorted((r.n, r.v) for r in shown if r.v is not None) == sorted((2, v) for v in values if v and v.strip(" "))
    c = F.col("c")
    plain = F.coalesce(~F.lower(F.trim(c)).isin("", "false", "no", "n", "0", "none", "null", "not approved") & ~F.coalesce(c.try_cast("double") <= 0, F.lit(False)), F.lit(False))
    df = spark.createDataFrame([(v,) for v in values], "c string")
    assert df.filter(plain != B.says_yes(c)).count() == 0
