import random
import re
import unicodedata

import pytest
from pyspark.sql import functions as F

from quaystone.operators import bags as B

FIELDS = {"part": B.Field(B.PART), "need": B.Field(B.NEED_QTY, 0), "own": B.Field(["req_qty", "qty"], 1), "approved": B.Field([*B.APPROVED, *B.STATUS], placed=True), "customer": B.Field(B.CUSTOMER)}


def plain(key):
    folded = "".join(c for c in unicodedata.normalize("NFD", key) if not unicodedata.combining(c))
    return re.sub("[^a-zA-Z0-9]", "", folded).lower()


def expected(bags, field):
    """(first value, values shown) of one row, by walking its cells."""
    cells = [{}, {}]  # of equal names the last counts, in the place where it stands
    for b, bag in enumerate(bags):
        for i, (k, v) in enumerate(bag or []):
            cells[b].pop(plain(k), None)
            cells[b][plain(k)] = (i, v)
    filled = [{k: v for k, (_, v) in c.items() if v is not None and v.strip(" ")} for c in cells]
    seen = [0, 1] if field.bag is None else [field.bag]
    order = [(b, n) for b in seen for n in (B.names(field.aliases) if not field.placed else sorted((set(B.names(field.aliases)) & set(cells[b])), key=lambda n, b=b: cells[b][n][0]))]
    first = next((filled[b][n] for b, n in order if n in filled[b]), None)
    return first, [filled[b][n] for b, n in order if n in filled[b] and not (b == 1 and n in filled[0])]


@pytest.mark.parametrize("limit", [10_000, 3])
def test_values_by_layout(spark, monkeypatch, limit):
    """Few layouts, which are sent to all tasks, and many, which are joined."""
    monkeypatch.setattr(B, "LAYOUTS", limit)
    rng = random.Random(limit)
    keys = ["MPN", "mpn", "M.P.N", "Item", "SKU", "Quantity", "qty", "QTY", "Req Qty", "Approved", "AVL", "Status", "ESTADO", "Cliente", "Clíente", "Customer", "BPName", "x", "", "Ñ"]
    shapes = [(rng.sample(keys, rng.randrange(7)), rng.sample(keys, rng.randrange(7))) for _ in range(12)]
    rows = []
    for i in range(300):
        bags = [[(k, rng.choice(["v", "w", " ", "", None, "Yes", "3,100"])) for k in shape] for shape in rng.choice(shapes)]
        rows.append((i, *[b if rng.random() < 0.9 else None for b in bags]))
    schema = "id int, a array<struct<key:string,value:string>>, b array<struct<key:string,value:string>>"
    df = spark.createDataFrame(rows, schema).select("id", F.map_from_entries("a").alias("m"), F.map_from_entries("b").alias("n"))
    out = B.located(df, FIELDS, ("m", "n")).select("id", *[B.value(f).alias(f) for f in FIELDS], *[B.shown(f).alias(f"all_{f}") for f in FIELDS]).collect()
    assert len(out) == 300
    for r in out:
        for name, field in FIELDS.items():
            assert (r[name], r[f"all_{name}"]) == expected(rows[r.id][1:], field), (rows[r.id], name)
