import datetime
import os
import zipfile

import pytest
from pyspark.sql import functions as F

from quaystone.operators import finder as X
from quaystone.sources import sheets, workbooks


@pytest.fixture
def xlsx(spark):
    workbooks.register(spark)
    return spark


def test_round_trip(xlsx, tmp_path):
    rows = [(i, f"<p&{i}> \"q\" ñ", i / 4, i % 2 == 0, datetime.date(2024, 1, 1 + i % 28), None if i % 3 else ["a", "b"]) for i in range(40)]
    df = xlsx.createDataFrame(rows, "id long, name string, share double, ok boolean, day date, tags array<string>").repartition(3)
    df.write.format("xlsx").option("sheet", "Sales & more").option("widths", "10,24").option("wrapped", "name").option("percents", "share").mode("overwrite").save(f"file://{tmp_path}/out")
    files = sorted((tmp_path / "out").iterdir())
    assert len(files) == 3 and all(f.name.startswith("part-") for f in files)
    back = xlsx.read.format("xlsx").load(f"file://{tmp_path}/out")
    assert back.rdd.getNumPartitions() == 3
    got = {r.cells[0]: r.cells for r in back.filter("row_index > 1").collect()}
    assert got["0"] == ["0", '<p&0> "q" ñ', "0.0", "TRUE", "2024-01-01", "a; b"] and got["7"] == ["7", '<p&7> "q" ñ', "1.75", "FALSE", "2024-01-08"]
    assert len(got) == 40 and {tuple(r.cells) for r in back.filter("row_index = 1").collect()} == {("id", "name", "share", "ok", "day", "tags")}
    with zipfile.ZipFile(files[0]) as z:
        text = z.read("xl/worksheets/sheet1.xml").decode()
        assert 'state="frozen"' in text and '<autoFilter ref="A1:F' in text and '<col min="2" max="2" width="24.0"' in text and 'name="Sales &amp; more"' in z.read("xl/workbook.xml").decode()
    df.limit(2).coalesce(1).write.format("xlsx").mode("overwrite").save(f"file://{tmp_path}/out")
    assert len(list((tmp_path / "out").iterdir())) == 1
    df.limit(2).coalesce(1).write.format("xlsx").mode("append").save(f"file://{tmp_path}/out")
    assert xlsx.read.format("xlsx").load(f"file://{tmp_path}/out").filter("row_index > 1").count() == 4


def test_full_sheets_go_on_and_sheets_are_partitions(xlsx, tmp_path):
    xlsx.range(25).coalesce(1).write.format("xlsx").option("sheetRows", "11").mode("overwrite").save(f"file://{tmp_path}/w")
    back = xlsx.read.format("xlsx").load(f"file://{tmp_path}/w/*.xlsx")
    assert back.rdd.getNumPartitions() == 3
    assert [(r.sheet, r.n) for r in back.groupBy("sheet").agg(F.count("*").alias("n")).orderBy("sheet").collect()] == [("Sheet1", 11), ("Sheet1 (2)", 11), ("Sheet1 (3)", 6)]
    assert sorted(int(r.cells[0]) for r in back.filter("row_index > 1").collect()) == list(range(25))
    plain = sheets.read_xlsx(xlsx, f"file://{tmp_path}/w/*.xlsx")
    key = lambda r: (r.sheet, r.row_index, r.cells)
    assert sorted(map(key, plain.collect())) == sorted(map(key, back.collect()))


def test_nothing_to_read_or_write(xlsx, tmp_path):
    xlsx.range(0).write.format("xlsx").mode("overwrite").save(f"file://{tmp_path}/none")
    assert [r.cells for r in xlsx.read.format("xlsx").load(f"file://{tmp_path}/none").collect()] == [["id"]]
    os.mkdir(tmp_path / "empty")
    assert xlsx.read.format("xlsx").load(f"file://{tmp_path}/empty").count() == 0


def test_a_failing_task_leaves_nothing(xlsx, tmp_path):
    bad = xlsx.range(10).repartition(2).select(F.when(F.col("id") == 7, F.raise_error(F.lit("no"))).otherwise(F.col("id").cast("string")).alias("id"))
    with pytest.raises(Exception):
        bad.write.format("xlsx").mode("overwrite").save(f"file://{tmp_path}/bad")
    assert not list((tmp_path / "bad").glob("**/*.xlsx"))


def test_export_of_results(xlsx, tmp_path):
    demand = xlsx.createDataFrame([("P-1", "P1", "Acme", "ST", "2024-01-01", "EA", 5.0, 1), ("P-2", "P2", None, None, None, None, 3.0, 2)], "part string, review string, customer string, maker string, date string, unit string, qty double, source_row int")
    supply = xlsx.createDataFrame([("P-1", "P1", "ST", "EA", 4.0, 1)], "part string, review string, maker string, unit string, qty double, source_row int")
    found = X.match(*(df.withColumns({"customer": F.lit("Acme") if "customer" not in df.columns else F.col("customer"), "invalid": F.lit(False), "negative": F.lit(False)}) for df in (demand, supply)))
    rows = X.export_rows(found, "need.xlsx / S1", "stock.xlsx / S1")
    assert len(rows.columns) == 19
    got = {r[1]: tuple(r) for r in rows.collect()}
    assert got["P-1"][:6] == ("Partial sale", "P-1", "Yes", "Yes", "No", "ST") and got["P-1"][7:12] == (5.0, 4.0, 4.0, 1.0, 80.0) and got["P-1"][14:16] == ("need.xlsx / S1", "stock.xlsx / S1")
    assert got["P-2"][0] == "Sourcing needed" and got["P-2"][15] == "" and got["P-2"][17] == "Contact supplier"
    workbooks.write_results(rows.coalesce(1), f"file://{tmp_path}/x")
    assert xlsx.read.format("xlsx").load(f"file://{tmp_path}/x").filter("row_index > 1").count() == 2
