"""Names in maps are judged as columns' names are, once a row."""

import pytest
from pyspark.sql import functions as F

from quaystone.operators import filters

NAMES = [n for group in filters.SENSITIVE_NAMES.values() for n in group] + [*filters.SAFE_NAMES, "Precio Unit Price", "Comisión neta", "Vendor Price", "Client Amount", "suppliercost", "price of client", "customer revenue", "Notes", "qty", "MPN", "", "PO #"]


@pytest.mark.parametrize("role", ["admin", "manager", "employee"])
def test_names_in_maps_as_columns(spark, role):
    df = spark.createDataFrame([(n,) for n in NAMES], "n string").withColumn("hidden", filters.hidden_key(F.col("n"), role))
    assert [(r.n, r.hidden) for r in df.collect()] == [(n, filters.hidden(n, role)) for n in NAMES]


def test_a_map_is_cleaned_once(spark):
    df = spark.createDataFrame([(1, {"Unit Price": "5", "qty": "2"})], "id int, raw map<string,string>")
    out = filters.redact(df, "manager").select("id", F.explode("raw").alias("name", "value"))
    assert {(r.name, r.value) for r in out.collect()} == {("Unit Price", None), ("qty", "2")}
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("transform_values(") == 1 and plan.count("regexp_replace(") == 1
