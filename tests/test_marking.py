"""Rows of an import that say the same are marked in one pass over the records, whatever their places."""

from pyspark.sql import functions as F

from quaystone.operators import imports as I
from quaystone.operators import windows as D
from quaystone.plans.registry import QUERIES
from quaystone.sources import trade as R
from tests.test_one_pass import plan

ROWS = "file string, sheet string, row_index int, customer string, supplier string, supplier_name string, mpn string, mpn_quoted string, po string, qty double, req_qty double, gp_rate double, issues array<struct<type:string,severity:string,column:string>>"


def table(spark, rows):
    """Rows of (file, row_index, mpn, types of issues) by one customer and supplier."""
    levels = {"missing_mpn": "high", "technical_error": "critical", "missing_margin": "low"}
    return spark.createDataFrame([(f, "S", i, "Ann", "S1", None, m, None, "PO1", 5.0, None, 0.1, [(t, levels[t], None) for t in types]) for f, i, m, types in rows], ROWS)


def test_imports_are_marked_in_one_pass(spark, sf):
    seen = plan(QUERIES["i_marked_imports"](spark, sf))
    assert seen.count("lineitem.parquet") == 1 and seen.count("Window [") == 1 and seen.count("Sort [") == 1


def test_large_imports_are_dealt_by_size_with_the_same_result(spark, sf, monkeypatch):
    small = sorted(map(str, QUERIES["i_marked_imports"](spark, sf).collect()))
    monkeypatch.setattr(R, "SENT", 0)
    monkeypatch.setattr(R, "DEALT", 500)
    out, n = QUERIES["i_marked_imports"](spark, sf), R.partitions(spark, sf)
    assert any("Exchange hashpartitioning(upload_batch_id#" in line and "__key#" in line and f", {n}), REPARTITION_BY_NUM" in line for line in plan(out).splitlines())
    assert sorted(map(str, out.collect())) == small


def test_rows_at_one_place_are_not_multiplied(spark):
    rows = table(spark, [("a", 1, "m", []), ("a", 1, "m", []), ("a", 1, "m", []), (None, 1, "m", []), (None, None, "m", [])])
    out = I.marked(rows)
    assert sorted((r.file or "-", [i.type for i in r.issues]) for r in out.collect()) == [("-", ["duplicate_record"])] * 2 + [("a", ["duplicate_record"])] * 2 + [("a", ["duplicate_record"] * 2)]
    assert {r.file: (r.total_rows, r.warnings) for r in I.summary(out).collect()} == {"a": (3, 4), None: (2, 2)}


def test_the_summary_needs_no_marked_rows(spark):
    hot = [("a", i, "m", ["missing_margin"] if i % 3 else []) for i in range(2, 40)] + [("a", 1, "M", ["technical_error"])]
    rows = table(spark, [*hot, ("a", 50, "n", ["missing_mpn"]), ("b", 1, "m", []), ("b", 2, "k", ["technical_error", "missing_margin"]), ("b", 2, "K", []), ("b", 3, "K", []), (None, 1, "k", [])]).withColumn("po", F.when(F.col("mpn") != "n", F.col("po")))
    for admit in (None, I.admitted(partial=False), I.admitted(partial=False, as_warnings=False)):
        want = I.summary(I.marked(rows), admit=admit)
        for partitions in (None, 7):
            got = I.marked_summary(rows, admit=admit, partitions=partitions)
            assert got.dtypes == want.dtypes and sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    a = I.marked_summary(rows).filter("file = 'a'").first()
    assert (a.total_rows, a.invalid, a.with_issues, a.technical_errors) == (40, 1, 40, 1) and a.warnings == 38 + 38 + sum(i % 3 > 0 for i in range(2, 40)) + 1
    penalties = 60 + sum(10 + 3 * (i % 3 > 0) for i in range(2, 40)) + 20
    assert a.workbook_score == int(100 - 100 * penalties / (60 * 40) + 0.5) and a.worker_score == 0


def test_rows_without_a_key_are_not_one_task(spark):
    rows = spark.range(400).selectExpr("'a' as file", "cast(null as string) as k", "id")
    out = D.repeats(rows, "file", "k", ("id",), 8)
    assert out.columns == ["file", "k", "id", "repeats"]
    assert out.select(F.spark_partition_id().alias("p")).distinct().count() == 8
    assert out.agg(F.sum("repeats"), F.count("*")).first()[:] == (0, 400)
