"""What a file is by its columns: a profile of each column and the template they add up to.

Names are counted where they lie and resolved once for each upload and name, so
wide bags never travel.  Every record counts, not a sample.
"""

from __future__ import annotations

import operator
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType

from ..functions.scalars import fold_accents

# What each field's columns are called; a name that contains one is the field's, in this order.
FIELD_ALIASES = {
    "mpn": ["mpn", "part number", "part no", "part no.", "pn", "p/n", "manufacturer part number", "mfr part number", "mfg part number", "item number", "component", "clean mpn"],
    "proveedor": ["supplier", "vendor", "supplier name", "global supplier name"],
    "fabricante": ["manufacturer", "manufacturer quoted", "mfg", "brand", "clean mfg"],
    "cliente": ["customer", "cliente", "client", "client id", "client code", "global customer name"],
    "cantidad": ["qty", "quantity", "qtty", "stock qty", "delivery qto", "req qty", "request qty", "rcpt qty", "receipt qty", "on hand", "stock"],
    "precio": ["price", "unit price", "selling price", "best price", "offered price", "best price offered", "pricebook", "usd extended price", "extended price"],
    "costo": ["cost", "unit cost", "product cost"],
    "fecha": ["date", "shipping date", "earliest shipping date", "date code", "created date", "receipt date"],
    "estado": ["status", "state", "estado"],
    "region": ["region", "geo", "area"],
    "facility": ["facility", "plant", "site", "warehouse", "location"],
    "notas": ["notes", "note", "comments", "comment", "remark", "remarks"],
    "gp": ["gp", "gross profit"],
    "gp_rate": ["gp rate", "gross profit rate", "margin rate"],
    "po": ["po", "purchase order", "sales order", "order"],
}
# Fields of normalized names, which come before all others.
NORMALIZED_FIELDS = {
    "mpn": "mpn", "mpn_quoted": "mpn", "supplier": "proveedor", "supplier_name": "proveedor", "manufacturer": "fabricante", "clean_mfg": "fabricante", "customer": "cliente", "client": "cliente",
    "qty": "cantidad", "req_qty": "cantidad", "on_hand": "cantidad", "price": "precio", "total_price": "precio", "best_price_offered": "precio", "cost": "costo", "earliest_shipping_date": "fecha", "date_code": "fecha",
    "shipping_point_country": "region", "delivery_point": "facility", "comments": "notas", "gp": "gp", "gp_rate": "gp_rate", "po": "po",
}
# What a field's columns mean and hold.
MEANINGS = {
    "mpn": "numero de parte o MPN", "proveedor": "proveedor", "fabricante": "fabricante o marca", "cliente": "cliente", "cantidad": "cantidad", "precio": "precio de venta u oferta", "costo": "costo unitario", "fecha": "fecha",
    "estado": "estado del registro", "region": "region", "facility": "facility, planta o ubicacion", "notas": "notas o comentarios", "gp": "gross profit", "gp_rate": "porcentaje de margen", "po": "orden de compra o venta",
}
TYPES = {"cantidad": "number", "precio": "number", "costo": "number", "gp": "number", "gp_rate": "number", "fecha": "date", "estado": "status", "notas": "notes"}
#: Longer names aren't columns.
LONGEST = 120


def plain_text(c: Column) -> Column:
    """Accents folded, signs but ``.`` and ``/`` to spaces, spaces collapsed, lower case."""
    return F.lower(F.trim(F.regexp_replace(F.regexp_replace(fold_accents(c), r"[^\p{L}\p{N}\s./]", " "), r"\s+", " ")))


def plain_name(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(plain_text(c), r"[./\s]+", "_"), "^_+|_+$", "")


def _looked_up(table: dict[str, str], c: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for pair in table.items() for x in pair]), c)


def field_of(text: Column, name: Column) -> Column:
    """The field of a column by its plain text and name; null if it is none's."""
    by_alias = reduce(lambda rest, kv: F.when(reduce(operator.or_, [text.contains(a) for a in kv[1]]), kv[0]).otherwise(rest), reversed(FIELD_ALIASES.items()), F.lit(None).cast("string"))
    return F.coalesce(_looked_up(NORMALIZED_FIELDS, name), by_alias)


def column_profile(records: DataFrame, sheets: DataFrame | None = None, by: str = "upload_batch_id") -> DataFrame:
    """(``by``, source, name, normalized_name, field, type, meaning, occurrences, presence) of each column.

    ``records`` has two bags, ``raw_data`` and ``normalized_data``, or the arrays
    of their names; ``sheets`` has (``by``, headers, total_rows).  Names that become equal are one column
    of a source, called by the least of them.  Normalized names count only
    where an upload has no others.
    """
    names = lambda bag: F.col(bag) if isinstance(records.schema[bag].dataType, ArrayType) else F.map_keys(bag)
    said = lambda bag: F.transform(F.coalesce(names(bag), F.array().cast("array<string>")), lambda k: F.struct(F.lit(bag).alias("source"), k.alias("key")))
    # A row without a source stands for each record: records and names are counted in one pass, by upload and layout before names are told apart.
    none = F.array(F.struct(F.lit("").alias("source"), F.lit("").alias("key")))
    own = records.select(by, F.concat(none, said("raw_data"), said("normalized_data")).alias("all")).groupBy(by, "all").agg(F.count("*").alias("n"))
    own = own.select(by, F.explode("all").alias("x"), "n").select(by, "x.source", "x.key", "n")
    if sheets is not None:
        head = sheets.select(by, F.lit("sheet").alias("source"), F.explode("headers").alias("key"), F.greatest(F.coalesce("total_rows", F.lit(1)), F.lit(1)).alias("n"))
        own = own.unionByName(head)
    own = own.groupBy(by, "source", "key").agg(F.sum("n").alias("n"))
    bare = F.col("source") == ""
    normalized = plain_name(F.col("key")).isin(*NORMALIZED_FIELDS) & (F.col("key") == plain_name(F.col("key"))) | F.col("key").isin(*FIELD_ALIASES)
    own = own.filter(bare | (F.col("source") != "normalized_data") | normalized).withColumn("key", F.trim("key")).filter(bare | (F.col("key") != "") & (F.char_length("key") <= LONGEST))
    named = own.withColumns({"text": plain_text(F.col("key")), "normalized_name": plain_name(F.col("key"))})
    each = named.groupBy(by, "source", "normalized_name").agg(F.min(F.struct("key", "text")).alias("first"), F.sum("n").alias("occurrences"))
    its = Window.partitionBy(by)
    others, records_of = F.max(~bare & (F.col("source") != "normalized_data")).over(its), F.max(F.when(bare, F.col("occurrences"))).over(its)
    kept = each.withColumns({"others": others, "records": records_of}).filter(~bare & ((F.col("source") != "normalized_data") | ~F.col("others")))
    name, field = F.col("first.key"), F.col("field")
    out = kept.withColumn("field", field_of(F.col("first.text"), F.col("normalized_name")))
    kind = F.when(field.isNotNull(), F.coalesce(_looked_up(TYPES, field), F.lit("text"))).when(F.lower(name).rlike("id|code|number|mpn|po"), "text").otherwise("unknown")
    return out.select(
        by, "source", name.alias("name"), "normalized_name", "field", kind.alias("type"), F.coalesce(_looked_up(MEANINGS, field), F.concat(F.lit("columna "), name)).alias("meaning"),
        "occurrences", F.least(F.lit(1.0), F.col("occurrences") / F.greatest(F.coalesce("records", F.lit(1)), F.lit(1))).alias("presence"),
    )


def templates(columns: DataFrame, uploads: DataFrame, by: str = "upload_batch_id") -> DataFrame:
    """(``by``, column_count, mappings, detected_template, confidence) of each of ``uploads`` (``by``, detected_category, selected_category).

    ``columns`` are those of ``column_profile``.  The first rule that fits gives the template.
    """
    first = columns.filter("field is not null").groupBy(by, "field").agg(F.min(F.struct("source", "name")).alias("c"))
    mapped = first.groupBy(by).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("field", F.col("c.name").alias("name"))))).alias("mappings"))
    words = columns.groupBy(by).agg(F.count("*").alias("column_count"), F.array_sort(F.collect_list(F.struct("source", "name", "normalized_name"))).alias("all"))
    said = F.array_join(F.transform("all", lambda c: F.concat_ws(" ", c["name"], c["normalized_name"])), " ")
    own = uploads.join(words, by, "left").join(mapped, by, "left").withColumn("text", plain_text(F.concat_ws(" ", "detected_category", "selected_category", said)))
    own = own.withColumn("mappings", F.coalesce("mappings", F.create_map().cast("map<string,string>")))
    has, is_ = F.col("text").rlike, lambda f: F.map_contains_key("mappings", F.lit(f))
    # Words that tell of templates.
    template = (
        F.when((is_("fabricante") | has(r"\bmfg\b|manufacturer|brand")) & is_("mpn") & (has("stock qty|stock|on hand|inventory") | is_("cantidad")) & (has("unit cost") | is_("costo")), "inventario")
        .when(has("global customer name|global supplier name|rcpt qty|receipt qty|usd extended price"), "cotizacion/logistica")
        .when(has("pricebook") & (has("lead ?time") | is_("estado")), "pricing/logistica")
        .when((is_("precio") | is_("costo") | is_("gp_rate") | is_("gp")) & is_("cantidad"), "pricing")
        .when(has("shipping|delivery|transit|lead ?time|facility|warehouse|rcpt|receipt") | is_("facility"), "logistica")
        .when(has("rfq|quote|quotation|cotizacion") | (is_("cliente") & is_("proveedor") & is_("precio")), "cotizacion")
        .when(is_("po") | has("purchase order|sales order|order"), "compras/ventas")
        .when(has("inventory|inventario"), "inventario")
        .otherwise("general")
    )
    count = F.coalesce("column_count", F.lit(0))
    sure = F.round(F.least(F.lit(0.95), F.greatest(F.lit(0.2), 0.35 + F.size("mappings") * 0.07 + F.when(count > 0, 0.15).otherwise(0.0))), 4)
    return own.select(by, count.alias("column_count"), "mappings", template.alias("detected_template"), sure.alias("confidence"))
