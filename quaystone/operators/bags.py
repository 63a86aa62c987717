"""Records as they came: values by many names in bags of raw and normalised cells, and what a row says by them.

``df`` has the record's columns and two maps of text, ``raw_data`` and
``normalized_data``, and ``template``, what kind of file it is from.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import NUMBER, first_text, fold_accents, normalize_mpn, settled

# Names of each thing, in order of priority.
PART = ["MPN", "Item", "Mfg Partno", "Mfg Part No", "Part Number", "Manufacturer Part Number", "MFR Part Number", "MFG Part Number", "SKU", "mpn_quoted"]
DEMAND_QTY = ["Required Qty", "Required Quantity", "Demand Qty", "Demand Quantity", "Quantity", "QTY", "Requi", "Plan", "req_qty", "Open Qty", "Needed Qty"]
DEMAND_CONTEXT = ["RequiredDate", "Need Date", "Demand Date", "StartDate", "LeadTime", "Customer", "Global Customer Name", "cliente"]
CUSTOMER_STRICT = ["Global Customer Name", "Customer", "customerName", "client", "cliente"]
CUSTOMER = [*CUSTOMER_STRICT, "BPName", "BusinessPartnerID"]
STOCK_QTY = ["STOCK QTY", "stock", "on_hand", "available qty", "available quantity", "available", "inventory qty", "inventory quantity"]
EXCESS_QTY = ["Excess Qty", "Excess Quantity", "Available Excess", "Customer Excess", "Surplus Qty", "Surplus Quantity", "Overstock Qty", "Overstock Quantity"]
EXCESS_SIGNAL = ["Excess", "Excess Qty", "Surplus", "Overstock", "Available Excess", "Customer Excess"]
APPROVED = ["Approved", "Approved Part", "AVL", "AML", "SourceControl", "SourceControlDesc", "Customer Approved", "Approved Vendor", "Approved Manufacturer", "Source Controlled"]
RECEIVED_QTY = ["RCPT Qty", "RCPT Qty_2", "Received Qty", "Received Quantity", "Receipt Qty", "Receipt Quantity", "received", "receipt"]
SUPPLIER = ["Global Supplier Name", "Supplier", "supplierName", "vendor", "proveedor"]
MAKER = ["MFG", "ManuName", "Global Manufacturer Name", "Manufacturer", "fabricante", "clean_mfg"]
STATUS = ["status", "state", "estado"]
# Fixed values of the coverage of needs by stock.
NEED_QTY = ["Quantity", "qty", "req_qty", "required qty", "request qty", "delivery qto", "RCPT Qty", "RCPT Qty_2", "receipt qty"]
NEED_CONTEXT = ["Global Customer Name", "customer", "client", "BPName", "BusinessPartnerID", "RequiredDate", "StartDate", "earliest_shipping_date", "LeadTime", "InTransitLT", "lead_time_weeks", "transit_time_weeks", *STATUS]
PRICE_CONTEXT = ["PriceBook", "GlobalPrice", "ContractGlobalPrice", "USD Extended Price", "USD Extended Price_2"]
COVER_STOCK_QTY = ["STOCK QTY", "on_hand", "available qty", "available quantity"]


#: Layouts beyond this many are joined by a shuffle instead of being sent to all tasks.
LAYOUTS = 10_000


#: How all text begins that a cast to double reads, by a digit, a point, or as infinity or NaN.
NUMERAL = r"^[\x00-\x20]*[+-]?[\d.iInN]"


def plain_key(c: Column) -> Column:
    return F.lower(F.regexp_replace(fold_accents(c), "[^a-zA-Z0-9]", ""))


def names(aliases: list[str]) -> list[str]:
    return list(dict.fromkeys("".join(c for c in a.lower() if c.isalnum()) for a in aliases))


class Field(NamedTuple):
    """What goes by any of some names, in one bag or in both; ``placed`` takes values in the order of cells, not of names."""

    aliases: list[str]
    bag: int | None = None
    placed: bool = False


def _last(keys: str, name: Column) -> Column:
    """Where a name stands in an array, the last time; -1 if nowhere."""
    return F.when(F.array_contains(keys, name), F.size(keys) - F.array_position(F.reverse(keys), name)).otherwise(-1).cast("int")


def resolve(layouts: DataFrame, fields: dict[str, Field]) -> DataFrame:
    """Layouts (``keys0``, ``keys1``: the keys of both bags) with ``places``: where in a row's values each field's are.

    A field has two arrays, since rows carry them: by its name the values'
    numbers in both bags together and, as ``<name>_over``, in the second bag
    that of the first's value by the same name, which hides it (else -1).
    Of a bag's names that become equal when plain, the last counts.
    """
    plain = layouts.select("keys0", "keys1", *[F.transform(f"keys{b}", plain_key).alias(f"plain{b}") for b in (0, 1)])

    def own(field: Field) -> Column:
        wanted = F.array(*[F.lit(n) for n in names(field.aliases)])
        first = F.transform(wanted, lambda n: F.struct(_last("plain0", n).alias("at"), F.lit(-1).alias("over")))
        second = F.transform(wanted, lambda n: F.struct((_last("plain1", n) + F.when(_last("plain1", n) >= 0, F.size("plain0")).otherwise(0)).cast("int").alias("at"), _last("plain0", n).alias("over")))
        places = F.filter({0: first, 1: second}.get(field.bag, F.concat(first, second)), lambda p: p["at"] >= 0)
        return F.array_sort(places) if field.placed else places

    found = plain.select("keys0", "keys1", *[own(f).alias(n) for n, f in fields.items()])
    return found.select("keys0", "keys1", F.struct(*[c for n in fields for c in (F.col(f"{n}.at").alias(n), F.col(f"{n}.over").alias(f"{n}_over"))]).alias("places"))


def located(df: DataFrame, fields: dict[str, Field], bags: tuple[str, str] = ("raw_data", "normalized_data"), layouts: DataFrame | None = None) -> DataFrame:
    """``df`` with ``held`` (all values of its bags) and ``places`` instead of the bags.

    Names are resolved once per layout, which is a distinct pair of key arrays;
    rows only look up numbers.  Layouts are as many as there are kinds of
    sheets: up to ``LAYOUTS`` are sent to all tasks, more are joined by their keys.
    Where they are known beforehand, ``layouts`` has bags of each and ``df`` is
    read once, not twice; a row of another layout is an error then.
    """
    none = F.array().cast("array<string>")
    keys = [F.coalesce(F.map_keys(b), none).alias(f"keys{i}") for i, b in enumerate(bags)]
    held = F.concat(*[F.coalesce(F.map_values(b), none) for b in bags])
    kinds = (df if layouts is None else layouts).select(*keys).distinct()
    known = kinds.limit(LAYOUTS + 1).collect()
    if len(known) <= LAYOUTS:
        places = F.broadcast(resolve(df.sparkSession.createDataFrame(known, kinds.schema), fields))
    else:
        places = resolve(kinds, fields)
    out = df.select(*[c for c in df.columns if c not in bags], *keys, held.alias("held")).join(places, ["keys0", "keys1"], "inner" if layouts is None else "left").drop("keys0", "keys1")
    return out if layouts is None else out.withColumn("places", F.when(F.col("places").isNull(), F.raise_error("bags of a layout that is not among the given ones")).otherwise(F.col("places")))


def cell(at: Column) -> Column:
    """The value with a number among those held; null if blank."""
    v = F.get(F.col("held"), at)
    return F.when(F.trim(v) != "", v)


def value(field: str) -> Column:
    """A field's first value: bag by bag, name by name."""
    p = F.col(f"places.{field}")
    more = F.when(F.size(p) > 2, F.get(F.filter(F.transform(p, cell), lambda v: v.isNotNull()), F.lit(0)))
    return F.coalesce(*[cell(F.get(p, F.lit(i))) for i in (0, 1)], more)


def number(field: str) -> Column:
    c = F.trim(F.translate(value(field), ",", ""))
    return F.when(c.rlike(NUMBER), c.try_cast("double"))


def shown(field: str) -> Column:
    """A field's values, but for those that the first bag's value by the same name hides."""
    over = lambda i: F.get(F.col(f"places.{field}_over"), i)
    seen = F.filter(F.col(f"places.{field}"), lambda at, i: cell(at).isNotNull() & ((over(i) < 0) | cell(over(i)).isNull()))
    return F.transform(seen, cell)


def joined(field: str) -> Column:
    return F.lower(F.array_join(shown(field), " "))


def says_yes(c: Column) -> Column:
    """Whether a cell means yes: neither blank nor a no, none or zero."""
    # What can't begin a number isn't cast: a failing cast costs an exception a row.
    zero = F.when(c.rlike(NUMERAL), F.coalesce(c.try_cast("double") <= 0, F.lit(False))).otherwise(False)
    return F.coalesce(~F.lower(F.trim(c)).isin("", "false", "no", "n", "0", "none", "null", "not approved") & ~zero, F.lit(False))


def template_of(records: DataFrame, uploads: DataFrame, profiles: DataFrame) -> DataFrame:
    """``records`` with ``template``: the profile's (upload_batch_id, detected_template), else the upload's category, else the record's."""
    u = uploads.select(F.col("id").alias("upload_batch_id"), "detected_category")
    p = profiles.select("upload_batch_id", "detected_template")
    out = records.join(u, "upload_batch_id", "left").join(p, "upload_batch_id", "left")
    return out.withColumn("template", F.lower(F.coalesce("detected_template", "detected_category", "category", F.lit("")))).drop("detected_category", "detected_template")


COVER_FIELDS = {
    "part": Field(PART), "stock": Field(COVER_STOCK_QTY, 0), "on_hand": Field(["on_hand"], 1), "need": Field(NEED_QTY, 0), "own_need": Field(["req_qty", "qty"], 1),
    "context": Field([*NEED_CONTEXT, *PRICE_CONTEXT], 0), "customer": Field(CUSTOMER), "supplier": Field(SUPPLIER), "maker": Field(MAKER),
}


def stock_and_needs(df: DataFrame, layouts: DataFrame | None = None) -> DataFrame:
    """Each record's part, whether it is stock, a need or both, and its quantities; records that are neither are left out."""
    t, has = F.col("template"), lambda f: value(f).isNotNull()
    stock = t.contains("inventario") | has("stock") | has("on_hand")
    need = ~t.contains("inventario") & (has("need") | has("own_need")) & (has("context") | t.rlike("pricing|logistica|cotizacion"))
    out = settled(
        located(df, COVER_FIELDS, layouts=layouts), "id", "upload_batch_id", "created_at",
        normalize_mpn(F.coalesce(value("part"), F.col("mpn"), F.col("mpn_quoted"))).alias("part"), stock.alias("is_stock"), need.alias("is_need"),
        F.when(stock, F.coalesce(number("stock"), number("on_hand"), F.col("on_hand"))).alias("stock_qty"),
        F.when(need, F.coalesce(number("need"), number("own_need"), F.col("req_qty"), F.col("qty"))).alias("need_qty"),
        first_text(value("customer"), F.col("customer"), F.col("client")).alias("customer"), first_text(value("supplier"), F.col("supplier_name"), F.col("supplier")).alias("supplier"),
        first_text(value("maker"), F.col("manufacturer"), F.col("clean_mfg")).alias("maker"),
    )
    return out.filter("is_stock or is_need").filter("part is not null")


SIGNAL_FIELDS = {
    "part": Field(PART), "stock": Field(STOCK_QTY), "need": Field(DEMAND_QTY), "excess": Field(EXCESS_QTY), "received": Field(RECEIVED_QTY), "context": Field(DEMAND_CONTEXT), "says_excess": Field(EXCESS_SIGNAL),
    "excess_text": Field([*EXCESS_SIGNAL, *STATUS], placed=True), "required": Field([a for a in DEMAND_QTY if a.lower() not in ("quantity", "qty")]), "approved": Field(APPROVED), "approved_text": Field([*APPROVED, *STATUS], placed=True),
    "customer": Field(CUSTOMER), "strict_customer": Field(CUSTOMER_STRICT), "supplier": Field(SUPPLIER), "maker": Field(MAKER),
}


def signals(df: DataFrame, layouts: DataFrame | None = None) -> DataFrame:
    """What each record says of its part: demand, stock, excess, receipts and approval, with quantities, parties and what is missing.

    A value in the raw bag hides the same name's in the normalized one.
    """
    t, has = F.col("template"), lambda f: value(f).isNotNull()
    own = settled(
        located(df, SIGNAL_FIELDS, layouts=layouts), "id", "upload_batch_id", "created_at", normalize_mpn(F.coalesce(value("part"), F.col("mpn"), F.col("mpn_quoted"))).alias("part"),
        F.coalesce(number("stock"), F.col("on_hand")).alias("stock_qty"), F.coalesce(number("need"), F.col("req_qty"), F.col("qty")).alias("need_qty"),
        number("excess").alias("told_excess"), number("received").alias("received_qty"), t.alias("template"),
        (has("context") | t.rlike("pricing|logistica|logistics|cotizacion|quotation|rfq|demand|need|planned")).alias("asked"),
        (has("stock") | F.col("on_hand").isNotNull() | t.rlike("inventario|inventory|stock")).alias("kept"),
        (has("says_excess") | F.concat_ws(" ", t, joined("excess_text")).rlike(r"\b(excess|surplus|overstock)\b")).alias("is_excess"),
        has("required").alias("says_required"),
        (F.exists(shown("approved"), says_yes) | joined("approved_text").rlike(r"\b(approved|avl|aml|source\s*controlled?|sourcecontrol)\b")).alias("approved"),
        value("customer").alias("any_customer"), value("strict_customer").alias("strict_customer"), first_text(F.col("customer"), F.col("client")).alias("own_customer"),
        first_text(value("supplier"), F.col("supplier_name"), F.col("supplier")).alias("supplier"), first_text(value("maker"), F.col("manufacturer"), F.col("clean_mfg")).alias("maker"),
    )
    demand = F.coalesce((F.col("need_qty") > 0) & ~F.col("template").rlike("inventario|inventory") & (F.col("says_required") | F.col("asked") | ~F.col("kept")), F.lit(False))
    stock = F.coalesce((F.col("stock_qty") > 0) & F.col("kept"), F.lit(False))
    zero = F.lit(0.0)
    out = settled(
        own.filter("part is not null"), "id", "upload_batch_id", "created_at", "part", demand.alias("is_demand"), stock.alias("is_stock"), "is_excess", "approved", F.coalesce(F.col("received_qty") > 0, F.lit(False)).alias("received"),
        F.when(demand, F.col("need_qty")).alias("demand"), F.when(stock, F.col("stock_qty")).alias("stock"), F.when(F.col("is_excess"), F.greatest(F.coalesce("told_excess", "stock_qty"), zero)).alias("excess"),
        first_text(F.when(F.col("asked"), F.col("any_customer")).otherwise(F.col("strict_customer")), F.col("own_customer")).alias("customer"), "supplier", "maker",
    )
    return out.withColumn("no_customer", F.col("is_demand") & F.col("customer").isNull()).withColumn("no_party", (F.col("is_stock") | F.col("is_excess")) & F.col("supplier").isNull() & F.col("maker").isNull())


#: Which signals each view of them shows.
VIEWS = {"demand": "is_demand", "stock": "is_stock", "excess": "is_excess and excess > 0", "approved": "approved", "received": "received"}


def view(found: DataFrame, name: str) -> DataFrame:
    return found.filter(VIEWS[name])
