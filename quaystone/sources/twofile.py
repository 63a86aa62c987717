"""The front half of the two-file finder: what a file is, where its headers are, and its rows in one shape.

Header rows may repeat inside a sheet, each valid until the next.  Only rows
that hold a word of a part-number column are looked at as headers; the others
meet the header above them by an interval join, so a sheet is never one task.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import NUMBER, normalize_header, normalize_mpn, parse_date, review_key, settled
from .layout import plain

PROFILE_ROWS = 40
#: Header rows beyond this many are joined by a shuffle instead of being sent to all tasks.
HEADERS = 10_000
HISTORY = ("received_history", "sales_history")
# Header words of each column.
PRIMARY_MPN = ["mpn", "manufacturer part number", "mfr part number", "mfg part number", "mfg partno"]
MPN = [*PRIMARY_MPN, "mfr", "mfr number"]
OFFER_MPN = ["mfr", "mfr number", "mfg partno"]
RECEIVED_MPN = ["mfg partno"]
MAKER = ["mfg", "manufacturer", "maker", "brand", "manuname", "global manufacturer name"]
CUSTOMER = ["global customer name", "customer", "client", "customer name", "requi"]
SUPPLIER = ["global supplier name", "supplier", "supplier name", "vendor", "bpname"]
DATE = ["requireddate", "required date", "need date", "startdate", "start date"]
UNIT = ["uom", "unit of measure", "unit", "um"]
QUANTITY = {
    "demand": ["quantity", "required qty", "required quantity", "demand qty", "demand quantity", "req qty", "needed qty", "open qty"],
    "stock": ["stock qty", "on hand", "on hand qty", "available qty", "available quantity", "inventory qty"],
    "excess": ["quantity", "excess qty", "excess quantity", "surplus qty", "available excess"],
    "supplier_offer": ["qty", "quantity", "max qty", "on hand", "on hand qty", "available qty"],
    "received_history": ["rcpt qty", "received qty", "receipt qty"],
    "sales_history": [],
}
OTHER_TERMS = ["item", "item number", "source control", "sourcecontrol", "open balance", "credit limit", "due date", "sales person", "unit price", "unit cost", "gp", "g p", "description", "pdl"]
# Words that no unit column may have.
MONEY_WORDS = frozenset("cost cogs price amount amt value currency margin gp profit usd eur".split())
MONEY_PARTS = ("unitcost", "costperunit", "unitprice", "priceperunit", "priceunit", "gprate", "grossprofit", "grossmargin", "netprofit")
ALL_QUANTITIES = sorted({q for names in QUANTITY.values() for q in names})
TERMS = sorted({*MPN, *OFFER_MPN, *RECEIVED_MPN, *MAKER, *CUSTOMER, *SUPPLIER, *DATE, *ALL_QUANTITIES, *OTHER_TERMS})


def word(cell: str | None) -> str:
    """A header cell in plain form, ``no`` written out as number."""
    return " ".join("number" if w == "no" else w for w in plain(cell).split())


def any_has(headers: list[str], names) -> bool:
    return any(n in h for h in headers for n in names)


def find_column(headers: list[str], names: list[str]) -> int | None:
    """The first column of exactly such a name, else the first that contains one."""
    exact = next((i for i, h in enumerate(headers) if h in names), None)
    return exact if exact is not None else next((i for i, h in enumerate(headers) if any(n in h for n in names)), None)


def unit_column(headers: list[str]) -> int | None:
    """The first column that is a unit of measure by its exact name and has nothing of money in it."""
    money = lambda h: any(w in MONEY_WORDS for w in h.split()) or "g p" in h or any(p in h.replace(" ", "") for p in MONEY_PARTS)
    return next((i for i, h in enumerate(headers) if h in UNIT and not money(h)), None)


def header_score(cells: list[str | None]) -> tuple[int, bool]:
    """(score, whether it is a header) of a row."""
    headers = [w for c in cells if (w := word(c))]
    known = sum(any(t in h for t in TERMS) or unit_column([h]) == 0 for h in headers)
    both = any_has(headers, MPN) and any_has(headers, ALL_QUANTITIES)
    return 4 * known + min(len(headers), 24) + 8 * both - (len(headers) - len(set(headers))), known >= 2 or both


COLUMNS = ("mpn", "quantity", "maker", "customer", "supplier", "date", "unit")


def column_map(cells: list[str | None], role: str) -> dict[str, int | None] | None:
    """Where a header row has each thing; None if it lacks a part number or (but for histories) a quantity."""
    if role == "ignore":
        return None
    headers = [word(c) for c in cells]
    out = {"mpn": find_column(headers, MPN), "quantity": find_column(headers, QUANTITY[role]), "maker": find_column(headers, MAKER), "customer": find_column(headers, CUSTOMER), "supplier": find_column(headers, SUPPLIER), "date": find_column(headers, DATE), "unit": unit_column(headers)}
    return None if out["mpn"] is None or (out["quantity"] is None and role not in HISTORY) else out


def classify(file: str, sheets: list[str], headers: list[str]) -> tuple[str, int]:
    """(role, points) of a file by its name, its sheets' names and all its header cells in plain form."""
    names, file = [word(s) for s in sheets], word(file)
    has = lambda *terms: any_has(headers, terms)
    count = lambda *terms: sum(has(t) for t in terms)
    named = lambda pattern: any(re.search(pattern, n) for n in names)
    excess = has(*PRIMARY_MPN) and has("maker") and has(*QUANTITY["excess"])
    offer = has(*OFFER_MPN) and has(*QUANTITY["supplier_offer"])
    # Points, words and patterns; in the last ones ``\b`` bounds only the outer words, as it must.
    evidence = [
        ("stock", 18, has(*PRIMARY_MPN) and has(*QUANTITY["stock"])), ("stock", 6, has("mfg") and has(*QUANTITY["stock"])), ("stock", 3, named(r"\bstock|inventory\b")),
        ("excess", 24 if re.search(r"\bexcess|surplus|overstock\b", file) else 6, excess),
        ("demand", 16, has(*DATE) and has(*QUANTITY["demand"]) and has(*PRIMARY_MPN)), ("demand", 10, count("sourcecontrol", "source control", "bpname", "requi", "startdate") >= 3), ("demand", 4, named(r"\bplanned|demand|requirements?\b")),
        ("supplier_offer", 16, offer and count("brand", "pdl", "list", "description", "price") >= 2), ("supplier_offer", 5, offer and len(sheets) >= 3),
        ("received_history", 20, has(*RECEIVED_MPN) and has(*QUANTITY["received_history"])), ("received_history", 7, count("global supplier name", "global customer name", "usd extended price") >= 2),
        ("sales_history", 20, has("sales person") and has("item") and count("unit price", "unit cost", "sales", "cost", "g p") >= 2), ("sales_history", 4, headers.count("sales person") >= 2),
        ("financial", 24, has("open balance") and count("customer", "credit limit", "due date", "invoice", "total") >= 2), ("financial", 6, named(r"\baging|financial|receivable\b")),
    ]
    points: dict[str, int] = {}
    for kind, n, holds in evidence:
        points[kind] = points.get(kind, 0) + n * bool(holds)
    (kind, best), (_, second) = sorted(points.items(), key=lambda p: -p[1])[:2]
    return ("unknown" if best < 10 or best - second < 3 else kind), best


def compatibility(one: str | None, two: str | None) -> tuple[str, str | None]:
    """(what two files are to each other or why they don't fit, the role that is missing)."""
    if not one or not two:
        return "unknown_role", None
    if "ignore" in (one, two):
        return "ignored_file", "demand" if one == "ignore" else None
    if one == two == "demand":
        return "two_demand_files", "stock"
    if one in HISTORY and two in HISTORY:
        return "two_history_files", "demand"
    if "demand" not in (one, two):
        return ("requires_demand" if {one, two} & {"stock", "excess", "supplier_offer"} else "unsupported_pair"), "demand"
    other = two if one == "demand" else one
    return (f"demand_{other}", None) if other in QUANTITY else ("unsupported_pair", "stock")


_LIKELY = "|".join(MPN)
#: Letters that every part-number column's name has, whatever signs are between them, or letters beyond ASCII, which may become these.
_MAYBE = r"(?i)m[^a-z0-9]*(p[^a-z0-9]*n|f[^a-z0-9]*[rg]|a[^a-z0-9]*n[^a-z0-9]*u)|[^\x00-\x7F]"


def _likely(cells: str) -> Column:
    """Whether a row holds a word of a part-number column; only rows with its letters are brought to plain form for that."""
    text = F.concat_ws(" ", cells)
    return text.rlike(_MAYBE) & F.regexp_replace(normalize_header(text), r"\bno\b", "number").rlike(_LIKELY)


def headers(cells: DataFrame, role: str) -> DataFrame:
    """(file, sheet, row_index, until, score, columns): the header rows, each with the row of the next one."""
    kind = "score int, " + ", ".join(f"{c} int" for c in COLUMNS)

    @F.arrow_udf(kind)
    def read(rows: pa.Array) -> pa.Array:
        found = []
        for row in rows.to_pylist():
            score, sure = header_score(row)
            columns = column_map(row, role) if sure else None
            found.append({"score": score, **columns} if columns else None)
        return pa.array(found, pa.struct([("score", pa.int32()), *[(c, pa.int32()) for c in COLUMNS]]))

    likely = cells.filter(_likely("cells"))
    out = likely.select("file", "sheet", "row_index", read("cells").alias("columns")).filter("columns is not null")
    return out.withColumn("until", F.lead("row_index").over(Window.partitionBy("file", "sheet").orderBy("row_index")))


def _name(path: str) -> Column:
    """A file's name; paths that Spark gives have spaces and signs written as codes."""
    last = F.substring_index(path, "/", -1)
    return F.coalesce(F.try_url_decode(F.replace(last, F.lit("+"), F.lit("%2B"))), last)


def profile(cells: DataFrame) -> DataFrame:
    """(file, sheets, rows, role, points): what each file is, by the header rows among the first ones of each sheet."""
    counts = cells.groupBy("file", "sheet").agg(F.count("*").alias("rows"))
    first = F.row_number().over(Window.partitionBy("file", "sheet").orderBy("row_index"))
    top = cells.withColumn("place", first).filter(F.col("place") <= PROFILE_ROWS)  # at most PROFILE_ROWS a sheet go on

    @F.arrow_udf("boolean")
    def is_header(rows: pa.Array) -> pa.Array:
        return pa.array([header_score(r)[1] for r in rows.to_pylist()], pa.bool_())

    found = top.filter(is_header("cells")).groupBy("file").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("sheet", "row_index", "cells"))), lambda r: r["cells"])).alias("headers"))
    files = counts.groupBy("file").agg(F.array_sort(F.collect_set("sheet")).alias("sheets"), F.sum("rows").alias("rows")).join(found, "file", "left")

    @F.arrow_udf("role string, points int")
    def judge(file: pa.Array, sheets: pa.Array, headers: pa.Array) -> pa.Array:
        rows = zip(file.to_pylist(), sheets.to_pylist(), headers.to_pylist())
        return pa.array([dict(zip(("role", "points"), classify(f, s, [w for h in hs or [] if (w := word(h))]))) for f, s, hs in rows], pa.struct([("role", pa.string()), ("points", pa.int32())]))

    return files.select("file", "sheets", "rows", judge(_name("file"), "sheets", "headers").alias("k")).select("file", "sheets", "rows", "k.role", "k.points")


def parse_quantity(c: Column) -> Column:
    """A number from text: no commas or spaces, and brackets mean minus."""
    bare = F.regexp_replace(F.regexp_replace(F.regexp_replace(c, r"\s", ""), r"^\((.*)\)$", "-$1"), ",", "")
    return F.when(bare.rlike(NUMBER), bare.try_cast("double"))


def canonical_rows(cells: DataFrame, role: str) -> DataFrame:
    """Rows below their headers in the shape that the matcher takes; rows before any header and without a part number are left out.

    Up to ``HEADERS`` header rows are sent to all tasks, so that rows stay where they lie; more are joined by file and sheet.
    """
    found = headers(cells, role).select(F.col("file").alias("hf"), F.col("sheet").alias("hs"), F.col("row_index").alias("after"), "until", "columns")
    known = found.limit(HEADERS + 1).collect()
    h = F.broadcast(cells.sparkSession.createDataFrame(known, found.schema)) if len(known) <= HEADERS else found
    inside = (cells["file"] == h["hf"]) & (cells["sheet"] == h["hs"]) & (cells["row_index"] > h["after"]) & (h["until"].isNull() | (cells["row_index"] < h["until"]))
    at = lambda name: F.get("cells", F.col(f"columns.{name}"))
    text = lambda name: F.nullif(F.trim(F.regexp_replace(at(name), r"\s+", " ")), F.lit(""))
    qty = parse_quantity(at("quantity"))
    rows = settled(
        cells.join(h, inside), "file", "sheet", F.col("row_index").alias("source_row"), normalize_mpn(at("mpn")).alias("part"), review_key(at("mpn")).alias("review"), F.trim(at("mpn")).alias("display"), text("maker").alias("maker"),
        text("customer").alias("customer"), text("supplier").alias("supplier"), F.date_format(parse_date(text("date")), "yyyy-MM-dd").alias("date"), F.upper(text("unit")).alias("unit"), qty.alias("qty"),
    )
    history = F.lit(role in HISTORY)
    out = rows.filter("part is not null").withColumn("invalid", ~history & (F.col("qty").isNull() | (F.col("qty") <= 0))).withColumn("negative", ~history & F.coalesce(F.col("qty") < 0, F.lit(False)))
    return out


def parse_counts(cells: DataFrame, role: str) -> DataFrame:
    """Per file: canonical rows, and those whose quantity is no number or negative."""
    return canonical_rows(cells, role).groupBy("file").agg(F.count("*").alias("canonical_rows"), F.count_if(F.col("qty").isNull()).alias("unread_quantities"), F.count_if("negative").alias("negative_quantities"))
