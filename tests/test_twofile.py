import pytest

from quaystone.sources import twofile as F2


def test_headers_and_columns():
    assert F2.header_score(["MPN", "Stock QTY", "MFG", ""]) == (4 * 3 + 3 + 8, True)
    assert F2.header_score(["X-1", "12", "Acme"]) == (3, False)
    assert F2.header_score(["MPN", "mpn", "qty"])[0] == 4 * 3 + 3 + 8 - 1
    m = F2.column_map(["Item", "Mfg Part No.", "Open QTY", "Unit Price", "UOM", "Need Date"], "demand")
    assert (m["mpn"], m["quantity"], m["unit"], m["date"], m["maker"]) == (1, 2, 4, 5, 1)
    assert F2.column_map(["MPN", "Notes"], "stock") is None and F2.column_map(["MPN", "Notes"], "sales_history")["quantity"] is None and F2.column_map(["MPN"], "ignore") is None


@pytest.mark.parametrize("headers, want", [(["unit price", "unit"], 1), (["um"], 0), (["unit of measure"], 0), (["unit cost"], None), (["units"], None), (["g p unit", "unit"], 1)])
def test_unit_columns(headers, want):
    assert F2.unit_column(headers) == want


@pytest.mark.parametrize(
    "file, sheets, headers, want",
    [
        ("stock.xlsx", ["Inventory"], ["MPN", "MFG", "Stock QTY"], ("stock", 27)),
        ("ACME excess list.xlsx", ["Sheet1"], ["MPN", "Maker", "Quantity"], ("excess", 24)),
        ("list.xlsx", ["Sheet1"], ["MPN", "Maker", "Quantity"], ("unknown", 6)),
        ("plan.xlsx", ["Planned"], ["MPN", "Required Qty", "RequiredDate"], ("demand", 20)),
        ("offer.xlsx", ["a", "b", "c"], ["MFR", "Brand", "QTY", "Description"], ("supplier_offer", 21)),
        ("rcpt.csv", ["CSV"], ["Mfg Partno", "RCPT Qty", "Global Supplier Name", "Global Customer Name"], ("received_history", 27)),
        ("sales.xlsx", ["2024"], ["Sales Person", "Item", "Unit Price", "Unit Cost"], ("sales_history", 20)),
        ("aging.xlsx", ["Aging"], ["Customer", "Open Balance", "Due Date", "Credit Limit"], ("financial", 30)),
        ("x.csv", ["CSV"], [], ("unknown", 0)),
    ],
)
def test_roles(file, sheets, headers, want):
    assert F2.classify(file, sheets, [F2.word(h) for h in headers]) == want


def test_compatibility():
    assert F2.compatibility("demand", "stock") == ("demand_stock", None) and F2.compatibility("sales_history", "demand") == ("demand_sales_history", None)
    assert F2.compatibility("demand", "demand") == ("two_demand_files", "stock") and F2.compatibility("stock", "excess") == ("requires_demand", "demand")
    assert F2.compatibility("received_history", "sales_history") == ("two_history_files", "demand") and F2.compatibility("financial", "unknown") == ("unsupported_pair", "demand")
    assert F2.compatibility("demand", "financial") == ("unsupported_pair", "stock") and F2.compatibility(None, "demand") == ("unknown_role", None) and F2.compatibility("ignore", "demand") == ("ignored_file", "demand")


def test_rows_under_repeated_headers(spark):
    rows = [(0, ["before", "1"]), (1, ["MPN", "Stock QTY", "MFG", "UOM"]), (2, ["a 1", "(5)", "TI", "ea"]), (3, ["b", "x", None]), (4, ["", "7"]), (5, ["On Hand", "MPN"]), (6, ["1,200", "c"]), (7, ["0", "d", "e", "f"])]
    cells = spark.createDataFrame([("f.csv", "CSV", i, c) for i, c in rows], "file string, sheet string, row_index int, cells array<string>")
    got = [(r.source_row, r.part, r.qty, r.maker, r.unit, r.invalid, r.negative) for r in F2.canonical_rows(cells, "stock").orderBy("source_row").collect()]
    assert got == [(2, "A1", -5.0, "TI", "EA", True, True), (3, "B", None, None, None, True, False), (6, "C", 1200.0, None, None, False, False), (7, "D", 0.0, None, None, True, False)]
    r = F2.profile(cells).first()
    assert (r.sheets, r.rows, r.role) == (["CSV"], 8, "stock")
    assert F2.canonical_rows(cells.limit(0), "stock").count() == 0
