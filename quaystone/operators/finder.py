"""Demand of one file matched to the supply of another.

Rows are grouped, joined by part number, and supply is given out by a running
sum over each part's demand, which equals handing it out one row after another.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import contains_text, normalize_mpn, review_key

SUPPLY_ROLES = ("stock", "excess", "supplier_offer", "received_history", "sales_history")
HISTORY_ROLES = ("received_history", "sales_history")
#: Names under which manufacturers are also known (fixed values).
MAKER_ALIASES = {
    "TI": "TEXASINSTRUMENTS", "TEXAS INSTRUMENTS": "TEXASINSTRUMENTS", "ST": "STMICROELECTRONICS", "STM": "STMICROELECTRONICS", "ST MICRO": "STMICROELECTRONICS",
    "SAMSUNG": "SAMSUNG", "MICRON": "MICRON", "KINGSTON": "KINGSTON",
}


def clean_maker(c: Column) -> Column:
    """A manufacturer's name for comparison: a known alias, else letters and digits only; null if nothing is left."""
    text = F.upper(F.trim(F.regexp_replace(c, r"\s+", " ")))
    known = F.create_map(*[F.lit(x) for kv in MAKER_ALIASES.items() for x in kv])
    return F.nullif(F.coalesce(known[text], F.regexp_replace(text, "[^A-Z0-9]", "")), F.lit(""))


def canonical(df: DataFrame, mpn: str, qty: Column, maker: str, customer: str | None = None, date: str | None = None, unit: str | None = None, row: str = "source_row") -> DataFrame:
    """Rows of a file with part identity, quantity and flags."""
    text = lambda c: F.lit(None).cast("string") if c is None else F.trim(F.regexp_replace(F.col(c), r"\s+", " "))
    out = df.select(
        normalize_mpn(F.col(mpn)).alias("part"), review_key(F.col(mpn)).alias("review"), F.col(mpn).alias("display"), text(maker).alias("maker"), text(customer).alias("customer"),
        (F.lit(None).cast("string") if date is None else F.date_format(date, "yyyy-MM-dd")).alias("date"), (F.lit(None).cast("string") if unit is None else F.nullif(F.upper(F.trim(F.col(unit))), F.lit(""))).alias("unit"), qty.cast("double").alias("qty"), F.col(row).alias("source_row"),
    )
    return out.filter("part is not null").withColumn("invalid", F.col("qty").isNull() | (F.col("qty") <= 0)).withColumn("negative", F.coalesce(F.col("qty") < 0, F.lit(False)))


def group_demand(rows: DataFrame) -> DataFrame:
    return rows.groupBy("part", "customer", "date", "unit").agg(
        F.sum(F.when(F.col("qty") > 0, F.col("qty")).otherwise(0.0)).alias("required"), F.min("source_row").alias("first_row"), F.min("maker").alias("maker"), F.min("review").alias("review"), F.count("*").alias("demand_rows")
    )


def group_supply(rows: DataFrame) -> DataFrame:
    makers = F.array_sort(F.collect_set(clean_maker(F.col("maker"))))
    return rows.groupBy("part").agg(
        F.sum(F.when(F.col("qty") > 0, F.col("qty")).otherwise(0.0)).alias("supply"), makers.alias("makers"), F.array_sort(F.collect_set("unit")).alias("units"), F.min("review").alias("supply_review"), F.min("source_row").alias("supply_row"),
        F.max("invalid").alias("supply_invalid"), F.max("negative").alias("supply_negative"), F.max(F.col("unit").isNull()).alias("unit_missing"),
    )


def match(demand_rows: DataFrame, supply_rows: DataFrame, role: str = "stock") -> DataFrame:
    """Results of demand against supply: what each demand gets, what is short, and what to do.

    Demand of a part is served by date (none last), then first row.  Demand in
    review takes nothing.  History of past receipts is a signal only.
    """
    demand, supply = group_demand(demand_rows), group_supply(supply_rows)
    how = "inner" if role in HISTORY_ROLES else "left"
    j = demand.join(supply, "part", how)
    maker = clean_maker(F.col("maker"))
    agrees = lambda m: (m == maker) | m.contains(maker) | maker.contains(m)
    conflict = F.coalesce(maker.isNotNull() & (F.size("makers") > 0) & ~F.exists("makers", agrees), F.lit(False))
    unit_bad = F.coalesce(F.col("unit").isNotNull() & (F.size("units") > 0) & ~F.array_contains("units", F.col("unit")), F.lit(False))
    review = F.when(conflict, "manufacturer").when(unit_bad, "unit").when(F.col("required") <= 0, "quantity")
    j = j.withColumn("review_reason", review)
    order = Window.partitionBy("part").orderBy(F.asc_nulls_last("date"), "first_row", F.asc_nulls_last("customer"), F.asc_nulls_last("unit"))
    eligible = F.when(F.col("review_reason").isNull(), F.col("required")).otherwise(0.0)
    taken = F.coalesce(F.sum(eligible).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    total = F.coalesce("supply", F.lit(0.0))
    j = j.withColumn("before", F.greatest(total - taken, F.lit(0.0)))
    history = F.lit(role in HISTORY_ROLES)
    j = j.withColumn("allocated", F.when(history, None).otherwise(F.least(eligible, F.col("before"))))
    full = F.col("allocated") >= F.col("required")
    kind = (
        F.when(F.col("review_reason").isNotNull(), "review_required").when(history, "historical_signal").when(F.col("allocated") <= 0, "sourcing_needed")
        .when(F.lit(role == "excess"), "excess_resale").when(F.lit(role == "supplier_offer"), "supplier_offer_match").when(full, "full_sale").otherwise("partial_sale")
    )
    action = (
        F.when(F.col("review_reason") == "manufacturer", "review_manufacturer").when(F.col("review_reason").isNotNull(), "review_quantity").when(history, "upload_current_stock").when(F.col("allocated") <= 0, "contact_supplier")
        .when(F.lit(role == "excess"), F.when(full, "offer_full_quantity").otherwise("source_remaining_quantity"))
        .when(F.lit(role == "supplier_offer"), F.when(full, "contact_supplier").otherwise("source_remaining_quantity")).when(full, "offer_full_quantity").otherwise("offer_available_quantity")
    )
    warnings = F.filter(F.array(
        F.when(F.col("review_reason") == "manufacturer", "manufacturer_conflict"), F.when(F.col("review_reason") == "unit", "incompatible_unit"), F.when(F.coalesce("supply_negative", F.lit(False)), "negative_available_quantity"),
        F.when(F.coalesce("supply_invalid", F.lit(False)), "invalid_available_quantity"), F.when(F.col("unit").isNull() | F.coalesce("unit_missing", F.lit(True)), "missing_unit"), F.when(history, "historical_not_current_stock"),
        F.when(F.coalesce(F.size("makers"), F.lit(0)) > 1, "multiple_manufacturers"),
    ), lambda x: x.isNotNull())
    live = ~history & F.col("review_reason").isNull()
    return j.select(
        "part", "customer", "maker", "date", "unit", "first_row", F.when(~history, F.col("required")).alias("required"), F.when(~history, F.coalesce("supply", F.lit(0.0))).alias("supply"), "before", "allocated",
        F.when(~history, F.col("required") - F.col("allocated")).alias("shortage"), F.when(~history & (F.col("required") > 0), F.round(100 * F.col("allocated") / F.col("required"), 2)).alias("coverage"), kind.alias("kind"), action.alias("action"),
        F.col("supply").isNotNull().alias("exact_part"), (live & (F.col("before") > 0) & (F.col("required") > 0)).alias("usable"), (live & (F.col("before") == F.col("required")) & (F.col("required") > 0)).alias("exact_quantity"), warnings.alias("warnings"),
    )


def supply_only(demand_rows: DataFrame, supply_rows: DataFrame) -> DataFrame:
    """Parts in supply that nobody asks for."""
    return group_supply(supply_rows).filter("supply > 0").join(demand_rows.select("part").distinct(), "part", "left_anti").select("part", "supply", F.size("makers").alias("makers"))


def possible_matches(demand_rows: DataFrame, supply_rows: DataFrame) -> DataFrame:
    """Pairs of different part numbers that agree without signs, where the demand has no exact supply."""
    d, s = demand_rows.select("part", "review").distinct(), supply_rows.select(F.col("part").alias("supply_part"), "review").distinct()
    open_ = d.join(supply_rows.select("part").distinct(), "part", "left_anti").filter("review is not null")
    return open_.join(s, "review").filter("part <> supply_part").select("part", "supply_part", "review").distinct()


#: Kinds of results, as the summary counts them.
KINDS = ("full_sale", "partial_sale", "sourcing_needed", "excess_resale", "supplier_offer_match", "supply_without_demand", "historical_signal", "review_required")


def summary(results: DataFrame) -> DataFrame:
    n = lambda k: F.count_if(F.col("kind") == k).alias(k)
    return results.agg(F.count("*").alias("results"), *[n(k) for k in ("full_sale", "partial_sale", "sourcing_needed", "review_required")], F.sum("allocated").alias("allocated"), F.sum("shortage").alias("shortage"), F.countDistinct(F.when(F.col("usable"), F.col("part"))).alias("usable_parts"), F.count_if("exact_quantity").alias("exact_quantity"))


def full_summary(demand_rows: DataFrame, supply_rows: DataFrame, role: str = "stock") -> DataFrame:
    """All counters of a comparison, with parts that only one side has and rows that couldn't be used."""
    history = role in HISTORY_ROLES
    results = match(demand_rows, supply_rows, role).select("part", "kind", "usable", "exact_quantity")
    if not history:
        results = results.unionByName(supply_only(demand_rows, supply_rows).select("part", F.lit("supply_without_demand").alias("kind"), F.lit(False).alias("usable"), F.lit(False).alias("exact_quantity")))
    parts = demand_rows.select("part", F.lit(1).alias("side")).unionByName(supply_rows.select("part", F.lit(2).alias("side"))).groupBy("part").agg(F.min("side").alias("lo"), F.max("side").alias("hi"))
    found = results.agg(*[F.count_if(F.col("kind") == k).alias(k) for k in KINDS], F.countDistinct(F.when(F.col("usable"), F.col("part"))).alias("usable_parts"), F.count_if("exact_quantity").alias("exact_quantity"))
    both = parts.agg(F.count("*").alias("analyzed_parts"), F.count_if(F.col("lo") < F.col("hi")).alias("exact_parts"))
    bad = demand_rows.select("invalid").unionByName(supply_rows.select("invalid")).agg(F.count_if("invalid").alias("invalid_quantity_rows"))
    near = possible_matches(demand_rows, supply_rows).agg(F.count("*").alias("possible_matches"))
    return found.crossJoin(both).crossJoin(bad).crossJoin(near)  # one row each


def filter_results(results: DataFrame, text: str = "", maker: str = "", context: str = "", kind: str | None = None, shortage: bool = False, usable: bool = False, exact: bool = False) -> DataFrame:
    """Results that fit a form: part number, manufacturer and customer contain the texts; flags narrow further."""
    out = results
    if text.strip():
        out = out.filter(F.col("part").contains(normalize_mpn(F.lit(text))))
    for column, wanted in (("maker", maker), ("customer", context)):
        if wanted.strip():
            out = out.filter(contains_text(F.col(column), wanted.strip()))
    if kind is not None:
        out = out.filter(F.col("kind") == kind)
    return out.filter((F.col("shortage") > 0) if shortage else F.lit(True)).filter(F.col("usable") if usable else F.lit(True)).filter(F.col("exact_part") if exact else F.lit(True))


def without_old_units(results: DataFrame, version: str, current: str) -> DataFrame:
    """Results of an earlier version don't show units: it didn't read them safely."""
    return results if version == current else results.withColumn("unit", F.lit(None).cast("string"))


#: Columns of an export, in order.
EXPORT = (
    "Type", "MPN", "Exact MPN match", "Usable availability", "Exact quantity", "Manufacturer", "Customer", "Required", "Available", "Allocated", "Shortage", "Coverage", "Required date", "Unit",
    "Demand source", "Supply source", "Reason", "Action", "Warnings",
)
#: Why a result is of its kind, but for those in review.
REASONS = {
    "full_sale": "full_coverage", "partial_sale": "partial_coverage", "sourcing_needed": "no_available_supply", "excess_resale": "excess_covers_demand", "supplier_offer_match": "supplier_offer_available",
    "supply_without_demand": "supply_has_no_demand", "historical_signal": "historical_match_only",
}


def reason(results: DataFrame) -> Column:
    """The code of why each of ``match``'s results is what it is."""
    told = F.when(F.array_contains("warnings", "manufacturer_conflict"), "manufacturer_conflict").when(F.array_contains("warnings", "incompatible_unit"), "incompatible_unit").otherwise("invalid_quantity")
    return F.when(F.col("kind") == "review_required", told).otherwise(F.create_map(*[F.lit(x) for kv in REASONS.items() for x in kv])[F.col("kind")])


def export_rows(results: DataFrame, demand_source: str, supply_source: str, labels: dict[str, str] | None = None) -> DataFrame:
    """Results as people read them, in the nineteen columns of ``EXPORT``.

    ``labels`` names codes (and yes and no) in another language; a code without a label is its own words.
    """
    table = F.create_map(*[F.lit(x) for kv in (labels or {}).items() for x in kv]).cast("map<string,string>")
    words = lambda c: F.concat(F.upper(F.substring(c, 1, 1)), F.replace(F.substring(c, 2, 99), F.lit("_"), F.lit(" ")))
    label = lambda c: F.coalesce(F.try_element_at(table, c), words(c))
    yes = lambda c: label(F.when(F.col(c), "yes").otherwise("no"))
    columns = [
        label(F.col("kind")), F.col("part"), yes("exact_part"), yes("usable"), yes("exact_quantity"), F.coalesce("maker", F.lit("")), F.coalesce("customer", F.lit("")), F.col("required"), F.col("supply"), F.col("allocated"), F.col("shortage"),
        F.col("coverage"), F.coalesce("date", F.lit("")), F.coalesce("unit", F.lit("")), F.lit(demand_source), F.when(F.col("exact_part"), supply_source).otherwise(""), label(reason(results)), label(F.col("action")),
        F.array_join(F.transform("warnings", label), "; "),
    ]
    return results.select(*[c.alias(n) for c, n in zip(columns, EXPORT)])
