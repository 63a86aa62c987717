import io
import json
import zipfile

from pyspark.sql import functions as F

from quaystone.operators import imports
from quaystone.sources import layout, sheets
from quaystone.streaming import ingest, rate


def test_layout():
    rows = [["ACME corp", None], [None, "report"], ["Customer", "MPN", "Qty", "Unit Price", "Ship_Date?", "Qty"], ["x", "y", "1", "2", "3", "4"]]
    assert layout.find_header(rows)[0] == 2
    assert layout.unique_names(["a", "", None, "a"]) == ["a", "column_2", "column_3", "a_2"]
    assert layout.plain(" Año_de-Venta (1)") == "ano de venta 1"
    fields = layout.map_fields(["Customer", "MPN", "Qty", "Unit Price", "Lead Time (wks)"])
    assert fields == {"customer": 0, "mpn": 1, "qty": 2, "price": 3, "lead_time_weeks": 4}
    assert layout.category(["Cost", "Price", "GP rate"], {"cost": 0, "price": 1, "gp_rate": 2})[0] == "Sales Margin"
    assert layout.category(["foo"], {})[0] == "Generic"
    assert layout.chosen_category("Quotation", "x") == "RFQ" and layout.chosen_category("Auto Detect", "x") == "x"


CSV = '﻿Company report,,\r\n\r\nCustomer,MPN,Qty,GP rate,Earliest shipping date\r\n"Acme, Inc",ab-1,"1,200",45%,2024-03-01\r\n=cmd(),x 2,abc,250,soon\r\nShort,#REF!\r\n,,\r\nLong,zz,-5,0.5,45352,extra,cells\r\n'


def check(records):
    got = {r.mpn or r.customer: r for r in records.collect()}
    assert got["ab-1"].customer == "Acme, Inc" and got["ab-1"].qty == 1200 and got["ab-1"].gp_rate == 0.45 and not got["ab-1"].has_errors
    assert str(got["ab-1"].earliest_shipping_date) == str(got["zz"].earliest_shipping_date) == "2024-03-01" and got["zz"].qty == -5
    assert got["x 2"].customer == "'=cmd()" and [(i.type, i.column) for i in got["x 2"].issues] == [("invalid_number", "qty"), ("margin_out_of_range", "gp_rate"), ("invalid_date", "earliest_shipping_date")]
    assert [i.type for i in got["Short"].issues] == ["formula_error"] and got["Short"].qty is None
    assert len(got) == 4 and "acme, inc" in got["ab-1"].searchable_text


def test_csv(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes(CSV.encode())
    cells = sheets.read_csv(spark, f"file://{tmp_path}/a.csv")
    (sheet,) = sheets.profile(cells).collect()
    assert sheet["header_row"] == 2 and sheet["sheet"] == "CSV"
    check(sheets.ingest(cells))


def test_files_of_different_layout_in_one_scan(spark, tmp_path):
    (tmp_path / "a.csv").write_text("Customer,MPN,Qty\nAnn,,5\nBob,b-1,6\n")
    (tmp_path / "b.csv").write_text("note\nQty,Clean MPN,Part Number,Customer\n7,c-9,,Cy\n")
    got = {r.customer: (r.mpn, r.qty, r.row_index, r.raw_data) for r in sheets.ingest(sheets.read_csv(spark, f"file://{tmp_path}/*.csv")).collect()}
    assert got["Ann"][:3] == (None, 5.0, 2) and got["Bob"][:3] == ("b-1", 6.0, 3)
    assert got["Cy"] == ("c-9", 7.0, 3, {"Qty": "7", "Clean MPN": "c-9", "Part Number": None, "Customer": "Cy"})


def test_marking_after_ingest(spark, tmp_path):
    """Rows that say the same gain issues within their file; counters, status and scores follow."""
    same = "Ann,b-1,PO1,5,2\n"
    (tmp_path / "a.csv").write_text("Customer,MPN,PO,Qty,Price\n" + same + "Ann,B-1,po1,5.0,3\nBob,c,,1,1\n" + same + "Ann,b-1,,,\nAnn,b-1,,,\n")
    (tmp_path / "b.csv").write_text("Customer,MPN,PO,Qty,Price\n" + same)
    rows = imports.marked(sheets.ingest(sheets.read_csv(spark, f"file://{tmp_path}/*.csv")))
    got = {(r.file[-5], r.row_index): [i.type for i in r.issues] for r in rows.collect()}
    assert got == {("a", 2): ["duplicate_record"] * 2, ("a", 3): ["duplicate_record"], ("a", 4): [], ("a", 5): ["duplicate_record"], ("a", 6): [], ("a", 7): [], ("b", 2): []}
    (a, b) = imports.summary(rows).orderBy("file").collect()
    assert (a.total_rows, a.imported, a.with_issues, a.warnings, a.status, a.workbook_score, a.worker_score) == (6, 6, 3, 4, "completed_with_warnings", 89, 50.0)
    assert (b.total_rows, b.status, b.workbook_score, b.worker_score) == (1, "completed", 100, 100.0)


def test_csv_of_any_width(spark, tmp_path):
    wide = [f"v{i}" for i in range(150)]
    wide[3], wide[149] = "a, b\nc", 'last "q", end'
    quoted = ",".join('"' + c.replace('"', '""') + '"' if set(c) & set('",\n') else c for c in wide)
    (tmp_path / "w.csv").write_text(f'Customer,MPN\n{quoted}\nx"y,z"' + ",k" * 170 + "\nshort\n")
    (tmp_path / "one.csv").write_text("a\nb\n")
    got = {r.row_index: r.cells for r in sheets.read_csv(spark, f"file://{tmp_path}/w.csv").collect()}
    assert got[2] == wide and len(got[3]) == 172 and got[4] == ["short"] and got[1] == ["Customer", "MPN"]
    assert [r.cells for r in sheets.read_csv(spark, f"file://{tmp_path}/one.csv").collect()] == [["a"], ["b"]]


def workbook(path):
    rows = [["Customer", "MPN", "Qty", "GP rate", "Earliest shipping date"], ["Acme, Inc", "ab-1", "1,200", "45%", "2024-03-01"], ["=cmd()", "x 2", "abc", "250", "soon"], ["Short", "#REF!"], [], ["Long", "zz", "-5", "0.5", "45352"]]
    cell = lambda r, c, v: f'<c r="{chr(65 + c)}{r}" t="inlineStr"><is><t>{v}</t></is></c>' if not v.lstrip("-").isdigit() else f'<c r="{chr(65 + c)}{r}"><f>1+1</f><v>{v}</v></c>'
    data = "".join(f'<row r="{i}">{"".join(cell(i, c, v) for c, v in enumerate(row))}</row>' for i, row in enumerate(rows, 3))
    main = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook xmlns="{main}" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets><sheet name="S1" sheetId="1" r:id="rId1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships><Relationship Id="rId1" Target="worksheets/sheet1.xml"/></Relationships>')
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet xmlns="{main}"><sheetData>{data}</sheetData></worksheet>')


def test_xlsx(spark, tmp_path):
    workbook(tmp_path / "b.xlsx")
    cells = sheets.read_xlsx(spark, f"file://{tmp_path}/b.xlsx")
    (sheet,) = sheets.profile(cells).collect()
    assert sheet["header_row"] == 3 and sheet["sheet"] == "S1"
    check(sheets.ingest(cells))
    assert sheets.valid_signature((tmp_path / "b.xlsx").read_bytes(), "b.xlsx") and not sheets.valid_signature(b"a\0b", "a.csv")
    assert sheets.valid_upload("a.exe", "text/csv", 0) == ["extension", "size"]


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, 'a "q"'), (2, None)], "upload_batch_id int, x string")
    path = f"file://{tmp_path}/out"
    sheets.replace_batch(df, path)
    sheets.replace_batch(df.filter("upload_batch_id = 1").withColumn("x", F.lit("new")), path)
    assert {(r.upload_batch_id, r.x) for r in spark.read.parquet(path).collect()} == {(1, "new"), (2, None)}
    sheets.write_csv(df.coalesce(1), f"file://{tmp_path}/csv")
    (part,) = (tmp_path / "csv").glob("*.csv")
    assert part.read_bytes().startswith(b'"upload_batch_id","x"\r\n"1","a ""q"""\r\n')
    sheets.write_csv(df.coalesce(1), f"file://{tmp_path}/bom", bom=True)
    (part,) = (tmp_path / "bom").glob("*.txt")
    assert part.read_bytes() == '\ufeff"upload_batch_id","x"\r\n"1","a ""q"""\r\n"2",""\r\n'.encode()
    old = spark.createDataFrame([(1, "a", 10), (2, "b", 20)], "id int, x string, created_at int")
    new = spark.createDataFrame([(2, "B", 99), (3, "c", 30)], "id int, x string, created_at int")
    assert sorted(map(tuple, sheets.upsert(old, new, "id").collect())) == [(1, "a", 10), (2, "B", 20), (3, "c", 30)]
    (tmp_path / "s.json").write_text(json.dumps({"records": [{"a": 1}, {"a": 2}], "uploads": []}))
    assert sheets.read_json_store(spark, f"file://{tmp_path}/s.json", "records").count() == 2
    sheets.write_json_store({"records": df, "uploads": df.limit(1)}, f"file://{tmp_path}/store")
    assert sorted(map(tuple, sheets.read_json_store(spark, f"file://{tmp_path}/store", "records").select("upload_batch_id", "x").collect())) == [(1, 'a "q"'), (2, None)]
    assert sheets.read_json_store(spark, f"file://{tmp_path}/store", "uploads").count() == 1
    assert sheets.ingest_key("a", "b") != sheets.ingest_key("ab") and len(sheets.ingest_key("a")) == 64


def test_folder_stream(spark, tmp_path):
    src, seen = tmp_path / "in", []
    src.mkdir()
    (src / "1.csv").write_text("a,b\n1,x\n2,y\n")
    handle = lambda df, _: seen.extend(r.a for r in df.collect())
    run = lambda: ingest.watch(spark, f"file://{src}", f"file://{tmp_path}/cp", handle, "a int, b string").awaitTermination()
    run()
    (src / "2.csv").write_text("a,b\n3,z\n")
    run()
    assert sorted(seen) == [1, 2, 3]


#: Seconds of one key's requests and what a limit of two in ten seconds lets through.
TIMES = [0, 1, 2, 9, 10, 11, 12, 25]
LET = [True, True, False, False, True, True, False, True]


def test_rate_limits(spark, tmp_path):
    rows = [(k, i, t) for k in ("a", "b") for i, t in enumerate(TIMES)] + [(None, 9, 1), ("c", 5, None)]
    df = spark.createDataFrame(rows, "key string, id int, t int").select("key", "id", F.timestamp_seconds(F.col("t") + 1_700_000_000).alias("ts"))
    want = {(k, i): a for k in ("a", "b") for i, a in enumerate(LET)}
    assert {(r.key, r.id): r.allowed for r in rate.batch_limit(df, 10, 2).collect()} == want
    df.write.parquet(f"file://{tmp_path}/ev")
    stream = spark.readStream.schema(df.schema).parquet(f"file://{tmp_path}/ev")
    q = rate.stream_limit(stream, 10, 2).writeStream.format("memory").queryName("limited").trigger(availableNow=True).option("checkpointLocation", f"file://{tmp_path}/cp").start()
    assert q.awaitTermination(60)
    assert {(r.key, r.id): r.allowed for r in spark.table("limited").collect()} == want


def test_stream_limit_carries_state_and_orders_frames(spark, tmp_path):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 3)  # a key's rows come in several frames
    try:
        part = lambda ids: spark.createDataFrame([("a", i, TIMES[i]) for i in ids], "key string, id int, t int").select("key", "id", F.timestamp_seconds(F.col("t") + 1_700_000_000).alias("ts")).coalesce(1)
        for n, ids in enumerate(([4, 3, 2, 1, 0], [7, 6, 5])):
            part(ids).write.mode("append").parquet(f"file://{tmp_path}/ev")
            stream = spark.readStream.schema(part([0]).schema).parquet(f"file://{tmp_path}/ev")
            q = rate.stream_limit(stream, 10, 2).writeStream.format("parquet").option("path", f"file://{tmp_path}/out").trigger(availableNow=True).option("checkpointLocation", f"file://{tmp_path}/cp").start()
            assert q.awaitTermination(60)
        got = {r.id: r.allowed for r in spark.read.parquet(f"file://{tmp_path}/out").collect()}
        assert [got[i] for i in range(8)] == LET
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_limit_with_block(spark):
    times = [0, 1, 2, 3, 14, 21, 22, 23, 24, 50]  # two in ten seconds, then twenty seconds of nothing
    df = spark.createDataFrame([("a", i, t) for i, t in enumerate(times)], "key string, id int, t int").select("key", "id", F.timestamp_seconds(F.col("t") + 1_700_000_000).alias("ts"))
    got = {r.id: r.allowed for r in rate.batch_limit(df, 10, 2, block=20).collect()}
    assert [got[i] for i in range(10)] == [True, True, False, False, False, False, True, True, False, True]


def test_stream_limit_with_block_in_any_triggers(spark, tmp_path):
    """Cut into triggers anywhere, a stream decides as the batch does."""
    times = [0, 1, 2, 3, 14, 21, 22, 23, 24, 50]
    df = spark.createDataFrame([("a", i, t) for i, t in enumerate(times)], "key string, id int, t int").select("key", "id", F.timestamp_seconds(F.col("t") + 1_700_000_000).alias("ts"))
    want = {r.id: r.allowed for r in rate.batch_limit(df, 10, 2, block=20).collect()}
    for n, cuts in enumerate(([5], [3, 6])):
        bounds = [0, *cuts, 10]
        for a, b in zip(bounds, bounds[1:]):
            df.filter((F.col("id") >= a) & (F.col("id") < b)).coalesce(1).write.mode("append").parquet(f"file://{tmp_path}/ev{n}")
            stream = spark.readStream.schema(df.schema).parquet(f"file://{tmp_path}/ev{n}")
            q = rate.stream_limit(stream, 10, 2, block=20).writeStream.format("parquet").option("path", f"file://{tmp_path}/out{n}").trigger(availableNow=True).option("checkpointLocation", f"file://{tmp_path}/cp{n}").start()
            assert q.awaitTermination(60)
        assert {r.id: r.allowed for r in spark.read.parquet(f"file://{tmp_path}/out{n}").collect()} == want


def test_tumbling_batch_equals_stream(spark, sf, tmp_path):
    events = spark.read.parquet(f"{sf}/events.parquet")
    batch = {tuple(r) for r in rate.tumbling(events).selectExpr("start", "event_type", "n").collect()}
    events.write.parquet(f"file://{tmp_path}/ev")
    stream = spark.readStream.schema(events.schema).parquet(f"file://{tmp_path}/ev")
    q = rate.tumbling(stream).writeStream.outputMode("complete").format("memory").queryName("tumbled").trigger(availableNow=True).option("checkpointLocation", f"file://{tmp_path}/cp").start()
    q.awaitTermination()
    assert {tuple(r) for r in spark.sql("select start, event_type, n from tumbled").collect()} == batch
