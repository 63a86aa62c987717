from pyspark.sql import functions as F

from quaystone.operators import structure as K

HEADS = {
    "inventario": ["Manufacturer", "P/N", "On Hand", "Unit Cost"],
    "pricing": ["Selling Price", "Quantity"],
    "pricing/logistica": ["PriceBook 2024", "Lead Time (wks)"],
    "logistica": ["Warehouse", "Ref"],
    "cotizacion": ["Customer", "Supplier", "Unit price"],
    "cotizacion/logistica": ["USD Extended Price", "Brand"],
    "compras/ventas": ["P.O.", "Purchase Order"],
    "general": ["Column one", "two"],
}
SHEETS = "upload_batch_id string, headers array<string>, total_rows long"
BAGS = "upload_batch_id string, raw_data map<string,string>, normalized_data map<string,string>"
UPLOADS = "upload_batch_id string, detected_category string, selected_category string"


def test_all_templates(spark):
    sheets = spark.createDataFrame([(k, h, 3) for k, h in HEADS.items()], SHEETS)
    uploads = spark.createDataFrame([(k, None, None) for k in HEADS] + [("by category", "Inventario general", None), ("by choice", None, "RFQ"), ("nothing", None, None)], UPLOADS)
    found = K.templates(K.column_profile(spark.createDataFrame([], BAGS), sheets), uploads).collect()
    got = {r.upload_batch_id: r.detected_template for r in found}
    assert got == {**{k: k for k in HEADS}, "by category": "inventario", "by choice": "cotizacion", "nothing": "general"}
    sure = {r.upload_batch_id: r.confidence for r in found}
    assert sure["nothing"] == 0.35 and sure["general"] == 0.5 and sure["inventario"] == 0.78


def test_columns_of_bags(spark):
    rows = [
        ("a", {"Código": "1", "Qty": None, "QTY": "2"}, {"mpn": "x"}), ("a", {"codigo": "2", "x" * 121: "", " ": "y"}, None), ("a", None, {"supplier": "s"}),
        ("b", None, {"mpn": "x", "Supplier": "s", "other": "o"}), ("b", {}, {"mpn": "z", "cliente": "c"}),
    ]
    out = K.column_profile(spark.createDataFrame(rows, BAGS))
    got = {(r.upload_batch_id, r.source, r.name): (r.normalized_name, r.field, r.type, r.occurrences, round(r.presence, 3)) for r in out.collect()}
    assert got == {
        ("a", "raw_data", "Código"): ("codigo", None, "unknown", 2, 0.667),
        ("a", "raw_data", "QTY"): ("qty", "cantidad", "number", 2, 0.667),
        ("b", "normalized_data", "mpn"): ("mpn", "mpn", "text", 2, 1.0),
        ("b", "normalized_data", "cliente"): ("cliente", "cliente", "text", 1, 0.5),
    }
    assert [r.meaning for r in out.filter("normalized_name = 'codigo'").collect()] == ["columna Código"]


def test_order_of_fields(spark):
    names = {"Global Supplier Name": "proveedor", "Manufacturer Part Number": "mpn", "Manufacturer quoted": "fabricante", "GP rate": "gp_rate", "Gross Profit": "gp", "delivery_point": "facility", "Remarks!": "notas", "Ship date": "fecha", "Total cost": "costo", "Ref": None}
    df = spark.createDataFrame([(n,) for n in names], "n string")
    got = {r.n: r.f for r in df.select("n", K.field_of(K.plain_text(F.col("n")), K.plain_name(F.col("n"))).alias("f")).collect()}
    assert got == names | {"GP rate": "gp_rate"}
