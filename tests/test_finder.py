import random

import pytest
from pyspark.sql import functions as F

from quaystone.operators import finder as X

DEMAND = "mpn string, q double, mfg string, who string, due date, uom string, source_row int"
SUPPLY = "mpn string, q double, mfg string, uom string, source_row int"

# (role, part, demands, supplies, expected): quantities and flags of the golden two-file cases
CASES = [
    ("stock", "EXACT-QTY-001", [100], [100], [("full_sale", 100, 0, 100, True, True, True, [])]),
    ("stock", "FULL-COVER-002", [60], [100], [("full_sale", 60, 0, 100, True, True, False, [])]),
    ("stock", "PARTIAL-003", [100], [40], [("partial_sale", 40, 60, 40, True, True, False, [])]),
    ("stock", "SOURCING-004", [75], [], [("sourcing_needed", 0, 75, 0, False, False, False, ["missing_unit"])]),
    ("stock", "0007-QA-006", [25], [25], [("full_sale", 25, 0, 100, True, True, True, [])]),
    ("stock", "ALPHA-7B-007", [20], [30], [("full_sale", 20, 0, 100, True, True, False, [])]),
    ("stock", "DUP-DEMAND-008", [70, 60], [100], [("full_sale", 70, 0, 100, True, True, False, []), ("partial_sale", 30, 30, 50, True, True, False, [])]),
    ("stock", "DUP-STOCK-009", [50], [20, 30], [("full_sale", 50, 0, 100, True, True, True, [])]),
    ("stock", "NEGATIVE-011", [20], [-5], [("sourcing_needed", 0, 20, 0, True, False, False, ["negative_available_quantity", "invalid_available_quantity"])]),
    ("excess", "NLE-FULL-001", [40], [40], [("excess_resale", 40, 0, 100, True, True, True, [])]),
    ("excess", "NLE-PARTIAL-002", [80], [30], [("excess_resale", 30, 50, 37.5, True, True, False, [])]),
    ("excess", "NLE-SOURCE-003", [15], [], [("sourcing_needed", 0, 15, 0, False, False, False, ["missing_unit"])]),
    ("supplier_offer", "RFQ-OFFER-001", [25], [25], [("supplier_offer_match", 25, 0, 100, True, True, True, [])]),
    ("supplier_offer", "RFQ-OFFER-PART-002", [50], [20], [("supplier_offer_match", 20, 30, 40, True, True, False, [])]),
    ("received_history", "HIST-MATCH-001", [10], [5], [("historical_signal", None, None, None, True, False, False, ["historical_not_current_stock"])]),
    ("received_history", "HIST-NOMATCH-002", [15], [], []),
    ("received_history", "HIST-ONLY-003", [], [5], []),
]


def sides(spark, demand, supply):
    d = X.canonical(spark.createDataFrame(demand, DEMAND), "mpn", F.col("q"), "mfg", customer="who", date="due", unit="uom")
    s = X.canonical(spark.createDataFrame(supply, SUPPLY), "mpn", F.col("q"), "mfg", unit="uom")
    return d, s


@pytest.mark.parametrize("role", sorted({c[0] for c in CASES}))
def test_golden_cases(spark, role):
    demand = [(p, float(q), "Maker", f"customer {i}", None, "EA", i) for r, p, d, _, _ in CASES if r == role for i, q in enumerate(d)]
    supply = [(f" {p.lower()}", float(q), "MAKER inc", "EA", i) for r, p, _, s, _ in CASES if r == role for i, q in enumerate(s)]
    got = {}
    for r in X.match(*sides(spark, demand, supply), role=role).orderBy("part", "first_row").collect():
        got.setdefault(r.part, []).append((r.kind, r.allocated, r.shortage, r.coverage, r.exact_part, r.usable, r.exact_quantity, r.warnings))
    assert got == {p: e for r, p, _, _, e in CASES if r == role and e}


def test_review_units_and_only_supply(spark):
    demand = [("MFG-CONFLICT-010", 10.0, "Acme", "a", None, "EA", 1), ("UNIT-1", 5.0, None, "a", None, "EA", 2), ("NO-UNIT-012", 12.0, None, "a", None, None, 3), ("AB-1", 3.0, None, "a", None, "EA", 4)]
    supply = [("MFG-CONFLICT-010", 10.0, "Zenith", "EA", 1), ("UNIT-1", 5.0, None, "BOX", 2), ("NO-UNIT-012", 12.0, None, "EA", 3), ("STOCK-ONLY-005", 55.0, None, "EA", 4), ("A.B1", 7.0, None, "EA", 5)]
    d, s = sides(spark, demand, supply)
    got = {r.part: (r.kind, r.action, r.allocated, r.warnings) for r in X.match(d, s).collect()}
    assert got["MFG-CONFLICT-010"] == ("review_required", "review_manufacturer", 0.0, ["manufacturer_conflict"])
    assert got["UNIT-1"] == ("review_required", "review_quantity", 0.0, ["incompatible_unit"])
    assert got["NO-UNIT-012"] == ("full_sale", "offer_full_quantity", 12.0, ["missing_unit"])
    assert {r.part for r in X.supply_only(d, s).collect()} == {"STOCK-ONLY-005", "A.B1"}
    assert [(r.part, r.supply_part) for r in X.possible_matches(d, s).collect()] == [("AB-1", "A.B1")]


def test_allocation_equals_a_greedy_loop(spark):
    r = random.Random(4)
    demand = [(f"P{r.randrange(40)}", float(r.randrange(0, 30)), None, f"c{r.randrange(5)}", None, "EA", i) for i in range(400)]
    supply = [(f"P{r.randrange(50)}", float(r.randrange(-5, 60)), None, "EA", i) for i in range(120)]
    left = {}
    for p, q, *_ in supply:
        left[p] = left.get(p, 0) + max(q, 0)
    groups = {}
    for p, q, _, who, *_, row in demand:
        g = groups.setdefault((p, who), [0, row])
        g[0] += q
    want = {}
    for (p, who), (q, row) in sorted(groups.items(), key=lambda g: (g[0][0], g[1][1])):
        take = min(q, left.get(p, 0))
        left[p] = left.get(p, 0) - take
        want[p, who] = take
    out = X.match(*sides(spark, demand, supply))
    assert {(x.part, x.customer): x.allocated for x in out.collect()} == want
    again = X.match(*[s.repartition(3, F.rand(1)) for s in sides(spark, demand, supply)])
    assert sorted(map(str, again.collect())) == sorted(map(str, out.collect()))
