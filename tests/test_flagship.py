"""The golden two-file sets from files to results: read in splits, profiled, put in one shape, matched."""

import pytest
from pyspark.sql import functions as F

from quaystone.operators import finder as X
from quaystone.sources import twofile
from quaystone.sources.csvsplits import read_csv

#: Of each set: the role of the second file, its name, header and how a row of it is written.
FILES = {
    1: ("stock", "stock on hand.csv", "MPN,Stock Qty,MFG,UOM", "{part},{q},{maker},{unit}"),
    2: ("stock", "inventory.csv", 'Manufacturer Part Number,"On Hand\nQty",MFG,UOM', '" {part}","{q}",{maker},{unit}'),
    3: ("excess", "customer excess.csv", "MPN,Excess Qty,Maker,UOM", "{part},{q},{maker},{unit}"),
    4: ("supplier_offer", "offers.csv", "MFR,Qty,Brand,Description,UOM", "{part},{q},{maker},some part,{unit}"),
    5: ("received_history", "receipts.csv", "Mfg Partno,RCPT Qty,MFG,Global Supplier Name,Global Customer Name,UOM", "{part},{q},{maker},Sup,Cus,{unit}"),
}
# (set, part, required, in supply, result, allocated, shortage, coverage, exact part, usable, exact quantity, warnings)
GOLDEN = [
    (1, "EXACT-QTY-001", [100], [100], [("full_sale", 100, 0, 100, True, True, True, [])]),
    (1, "FULL-COVER-002", [60], [100], [("full_sale", 60, 0, 100, True, True, False, [])]),
    (1, "PARTIAL-003", [100], [40], [("partial_sale", 40, 60, 40, True, True, False, [])]),
    (1, "SOURCING-004", [75], [], [("sourcing_needed", 0, 75, 0, False, False, False, ["missing_unit"])]),
    (1, "STOCK-ONLY-005", [], [55], "supply only"),
    (1, "0007-QA-006", [25], [25], [("full_sale", 25, 0, 100, True, True, True, [])]),
    (1, "ALPHA-7B-007", [20], [30], [("full_sale", 20, 0, 100, True, True, False, [])]),
    (1, "DUP-DEMAND-008", [70, 60], [100], [("full_sale", 70, 0, 100, True, True, False, []), ("partial_sale", 30, 30, 50, True, True, False, [])]),
    (1, "DUP-STOCK-009", [50], [20, 30], [("full_sale", 50, 0, 100, True, True, True, [])]),
    (1, "MFG-CONFLICT-010", [10], [10], [("review_required", 0, 10, 0, True, False, False, ["manufacturer_conflict"])]),
    (1, "NEGATIVE-011", [20], [-5], [("sourcing_needed", 0, 20, 0, True, False, False, ["negative_available_quantity", "invalid_available_quantity"])]),
    (1, "NO-UNIT-012", [12], [12], [("full_sale", 12, 0, 100, True, True, True, ["missing_unit"])]),
    (1, "WITH-UNIT-013", [13], [13], [("full_sale", 13, 0, 100, True, True, True, [])]),
    (2, "CDI-FULL-001", [30], [40], [("full_sale", 30, 0, 100, True, True, False, [])]),
    (2, "CDI-PARTIAL-002", [50], [20], [("partial_sale", 20, 30, 40, True, True, False, [])]),
    (2, "CDI-SOURCE-003", [10], [], [("sourcing_needed", 0, 10, 0, False, False, False, ["missing_unit"])]),
    (2, "CDI-STOCK-004", [], [12], "supply only"),
    (3, "NLE-FULL-001", [40], [40], [("excess_resale", 40, 0, 100, True, True, True, [])]),
    (3, "NLE-PARTIAL-002", [80], [30], [("excess_resale", 30, 50, 37.5, True, True, False, [])]),
    (3, "NLE-SOURCE-003", [15], [], [("sourcing_needed", 0, 15, 0, False, False, False, ["missing_unit"])]),
    (3, "NLE-SUPPLY-004", [], [25], "supply only"),
    (4, "RFQ-OFFER-001", [25], [25], [("supplier_offer_match", 25, 0, 100, True, True, True, [])]),
    (4, "RFQ-OFFER-PART-002", [50], [20], [("supplier_offer_match", 20, 30, 40, True, True, False, [])]),
    (4, "RFQ-SOURCE-003", [10], [], [("sourcing_needed", 0, 10, 0, False, False, False, ["missing_unit"])]),
    (4, "RFQ-OFFERONLY-004", [], [15], "supply only"),
    (5, "HIST-MATCH-001", [10], [5], [("historical_signal", None, None, None, True, False, False, ["historical_not_current_stock"])]),
    (5, "HIST-NOMATCH-002", [15], [], []),
    (5, "HIST-ONLY-003", [], [5], []),
]


def written(folder, number):
    role, name, head, line = FILES[number]
    maker = lambda part, side: {"demand": "Acme", "supply": "Zenith"}[side] if "CONFLICT" in part else "Maker"
    unit = lambda part: "" if "NO-UNIT" in part else "ea"
    mine = [c for c in GOLDEN if c[0] == number]
    demand = [f'{part},"{q:,}",{maker(part, "demand")},customer {i},{unit(part)},2024-0{i + 1}-15' for _, part, d, _, _ in mine for i, q in enumerate(d)]
    supply = [line.format(part=part.lower(), q=q, maker=maker(part, "supply"), unit=unit(part)) for _, part, _, s, _ in mine for q in s]
    (folder / "planned demand.csv").write_text("Planned demand,,\n\n" + "\n".join(["Mfg Part No,Required Qty,MFG,Customer,Unit,Required Date", *demand, ",,,,,"]))
    (folder / name).write_text("﻿" + "\n".join([head, *supply]) + "\n")
    return role, name


@pytest.mark.parametrize("number", sorted(FILES))
def test_from_files_to_results(spark, tmp_path, number):
    role, name = written(tmp_path, number)
    cells = read_csv(spark, f"file://{tmp_path}/*.csv")
    roles = {r.file.rsplit("/", 1)[1].replace("%20", " "): r.role for r in twofile.profile(cells).collect()}
    assert roles == {"planned demand.csv": "demand", name: role}
    of = lambda n: cells.filter(F.col("file").contains(n.replace(" ", "%20")))
    demand, supply = twofile.canonical_rows(of("planned demand.csv"), "demand"), twofile.canonical_rows(of(name), role)
    got = {}
    for r in X.match(demand, supply, role=role).orderBy("part", "date").collect():
        got.setdefault(r.part, []).append((r.kind, r.allocated, r.shortage, r.coverage, r.exact_part, r.usable, r.exact_quantity, r.warnings))
    assert got == {p: e for n, p, _, _, e in GOLDEN if n == number and e and e != "supply only"}
    if role != "received_history":
        assert {r.part: r.supply for r in X.supply_only(demand, supply).collect()} == {p: sum(s) for n, p, _, s, e in GOLDEN if n == number and e == "supply only"}
