"""Predicates, visibility, redaction and search over records and logs."""

from __future__ import annotations

import operator
import re
from functools import reduce
from itertools import groupby

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scalars import ACCENTED, PLAIN, contains_text, fold_accents, mask_email, settled

OPERATORS = {"eq": operator.eq, "gt": operator.gt, "gte": operator.ge, "lt": operator.lt, "lte": operator.le}

# Names of each sensitive group, without case and signs.
SENSITIVE_NAMES = {
    "pricing": ["price", "unitprice", "sellingprice", "saleprice", "quotedprice", "targetprice", "totalprice", "bestprice", "bestpriceoffered", "pricebook", "globalprice", "contractglobalprice", "usdextendedprice", "usdextendedprice2", "potentialamountusd", "amount", "revenue"],
    "cost": ["cost", "unitcost", "productcost", "suppliercost", "buycost", "buyprice", "targettovendor", "cogs"],
    "gp": ["gp", "gprate", "grossprofit", "grossprofitrate", "grossmargin", "margin", "marginrate", "commission", "comision", "netprofit"],
    "supplier": ["supplier", "suppliername", "globalsuppliername", "vendor", "vendorname", "manufacturer", "manufacturername", "globalmanufacturername", "mfg", "mfr", "manuname", "manucode", "cleanmfg"],
    "customer": ["customer", "customername", "globalcustomername", "client", "clientname", "endcustomer", "bpname", "businesspartnerid"],
    "po": ["po", "purchaseorder", "purchaseordernumber"],
    "notes": ["notes", "note", "internalnotes", "internalnote", "comments", "comment", "remarks", "memo"],
}
# What further names belong to each.
SENSITIVE_PATTERNS = {
    "pricing": r"(price|pricebook|globalprice|contractglobalprice|usdextendedprice|revenue|amount)$",
    "cost": r"(cost|cogs|buyprice|targettovendor)$",
    "gp": r"^(gp|gprate)$|grossprofit|grossmargin|marginrate|commission|comision|netprofit",
    "supplier": r"supplier|vendor|manufacturer|manuname|manucode|cleanmfg|^mfg$|^mfr$",
    "customer": r"customer|client|endcustomer|bpname|businesspartnerid",
    "po": r"^(po|purchaseorder|purchaseordernumber)$",
    "notes": r"internalnote|internalnotes|^notes?$|^comments?$|remarks|memo",
}
#: Names that are no secret though a pattern says so (fixed values).
SAFE_NAMES = ("accountclients", "accountclientid", "accountclientname")
#: The groups that each role may see; an admin sees all.
VISIBLE = {"admin": tuple(SENSITIVE_NAMES), "manager": ("supplier", "customer")}


def both(conditions: list[Column]) -> Column:
    return reduce(operator.and_, conditions, F.lit(True))


def either(conditions: list[Column]) -> Column:
    return reduce(operator.or_, conditions, F.lit(False))


def compare(column: str, op: str, value: float) -> Column:
    return OPERATORS[op](F.col(column), value)


def sensitive_group(name: str) -> str | None:
    """The group that a field's name belongs to, or None."""
    key = re.sub("[^a-zA-Z0-9]", "", name.translate(str.maketrans(ACCENTED, PLAIN))).lower()
    if key in SAFE_NAMES:
        return None
    exact = (g for g, names in SENSITIVE_NAMES.items() if key in names)
    return next(exact, None) or next((g for g, pattern in SENSITIVE_PATTERNS.items() if re.search(pattern, key)), None)


def hidden(name: str, role: str) -> bool:
    """Whether a role may not see a field of this name."""
    group = sensitive_group(name)
    return group is not None and group not in VISIBLE.get(role, ())


def hidden_key(key: Column, role: str) -> Column:
    """The same for names that are data; a name is brought to plain form once, and groups that a role sees alike are looked for together."""
    seen = VISIBLE.get(role, ())
    group = {n: g for g, names in reversed(SENSITIVE_NAMES.items()) for n in names}
    secret, shown = ([n for n, g in group.items() if (g in seen) is is_seen] for is_seen in (False, True))

    def judged(name: Column) -> Column:
        out = F.when(name.isin(*SAFE_NAMES, *shown), False).when(name.isin(*secret), True)
        for is_seen, groups in groupby(SENSITIVE_PATTERNS, key=lambda g: g in seen):
            out = out.when(name.rlike("|".join(SENSITIVE_PATTERNS[g] for g in groups)), not is_seen)
        return out.otherwise(False)

    return F.get(F.transform(F.array(F.lower(F.regexp_replace(fold_accents(key), "[^a-zA-Z0-9]", ""))), judged), F.lit(0))


#: Texts of a filter form and the columns that may contain them.
CONTAINED = {
    "supplier": ("supplier", "supplier_name"), "mpn": ("mpn", "mpn_quoted"), "manufacturer": ("manufacturer", "clean_mfg"), "customer": ("customer",), "po": ("po",), "description": ("description",), "line_id": ("line_id",),
    "country": ("shipping_point_country",),
}
#: Fields that must be equal, and ranges.
EQUAL = ("category", "has_errors", "uploaded_by", "upload_batch_id", "status", "department", "region")
RANGES = ("gp_rate", "cost", "price", "qty", "total_price", "gp", "commission", "moq", "spq", "on_hand", "lead_time_weeks", "transit_time_weeks", "target_to_vendor", "best_price_offered", "potential_amount_usd")


def record_conditions(filters: dict, role: str = "admin") -> list[Column]:
    """Conditions for a filter form; those on columns the role can't see are left out.

    Texts are contained (over pairs of columns), ``query`` is searched for in
    ``searchable_text`` (all its words must occur), numbers are ranges ``(low,
    high)`` with None for open, dates are an inclusive range of days.  A field
    that no form has is an error.
    """
    out = []
    for name, value in filters.items():
        if name not in (*CONTAINED, *EQUAL, *RANGES, "created", "query"):
            raise ValueError(f"unknown filter: {name}")
        if value is None or all(hidden(c, role) for c in CONTAINED.get(name, (name,))):
            continue
        if name in CONTAINED:
            out.append(either([contains_text(F.col(c), value) for c in CONTAINED[name]]))
        elif name == "query":
            out.append(has_words(F.col("searchable_text"), [[w] for w in value.split()]))
        elif name in EQUAL:
            out.append(F.col(name) == value)
        elif name == "created":
            low, high = value
            out += [F.col("created_at") >= F.lit(low).cast("timestamp")] * (low is not None) + [F.col("created_at") < F.date_add(F.lit(high).cast("date"), 1).cast("timestamp")] * (high is not None)
        else:
            column = F.coalesce("qty", "req_qty") if name == "qty" else F.col(name)
            low, high = value
            out += [column >= low] * (low is not None) + [column <= high] * (high is not None)
    return out


def filter_records(df: DataFrame, filters: dict, role: str = "admin") -> DataFrame:
    return df.filter(both(record_conditions(filters, role)))


def low_margin(df: DataFrame, threshold: float = 0.15) -> DataFrame:
    return df.filter(F.col("gp_rate") < min(1.0, max(0.0, threshold)))


def has_words(text: Column, groups: list[list[str]], without: list[str] = ()) -> Column:
    """Whether a text has a term of every group and none of ``without``; a term of several words is a phrase."""
    words = F.split(F.lower(text), r"[^\p{L}\p{N}]+")
    spaced = F.concat(F.lit(" "), F.array_join(words, " "), F.lit(" "))
    hit = lambda term: spaced.contains(f" {term.lower()} ") if " " in term else F.array_contains(words, term.lower())
    return both([either([hit(t) for t in g]) for g in groups] + [~hit(t) for t in without])


def text_search(df: DataFrame, text: Column, groups: list[list[str]], without: list[str] = ()) -> DataFrame:
    return df.filter(has_words(text, groups, without))


def visible(df: DataFrame, owner: str, profiles: DataFrame, me) -> DataFrame:
    """Rows a user may read: an admin all, an owner their own, a manager those of their department or region.

    The people that the user may see are found in the profiles (a semi join), so
    row filters need no lookup of each row's owner.
    """
    own = profiles.filter(F.col("id") == me).select(F.col("role").alias("my_role"), F.col("department").alias("my_department"), F.col("region").alias("my_region"))
    seen = profiles.crossJoin(F.broadcast(own)).filter((F.col("my_role") == "admin") | (F.col("id") == me) | ((F.col("my_role") == "manager") & ((F.col("department") == F.col("my_department")) | (F.col("region") == F.col("my_region")))))
    return df.join(seen.select(F.col("id").alias(owner)), owner, "left_semi")


def redact(df: DataFrame, role: str) -> DataFrame:
    """Fields that a role can't see become null: columns, fields of structs and values of maps, at any depth.

    Names are compared without case, signs and accents (``Unit Price`` is ``unitprice``).
    Nested values are cleaned once a row, whatever is asked of them later.
    """

    def clean(c: Column, kind) -> Column:
        if isinstance(kind, T.StructType):
            fields = [(F.lit(None).cast(f.dataType) if hidden(f.name, role) else clean(c[f.name], f.dataType)).alias(f.name) for f in kind]
            return F.when(c.isNotNull(), F.struct(*fields))
        if isinstance(kind, T.ArrayType):
            return F.transform(c, lambda x: clean(x, kind.elementType))
        if isinstance(kind, T.MapType):
            return F.transform_values(c, lambda k, v: F.when(~hidden_key(k.cast("string"), role), clean(v, kind.valueType)))
        return c

    nested = any(isinstance(f.dataType, (T.StructType, T.ArrayType, T.MapType)) for f in df.schema)
    columns = [(F.lit(None).cast(f.dataType) if hidden(f.name, role) else clean(F.col(f"`{f.name}`"), f.dataType)).alias(f.name) for f in df.schema]
    return settled(df, *columns) if nested else df.select(*columns)


def forbidden_columns(df: DataFrame) -> list[str]:
    """Financial columns in a result that must have none."""
    return [c for c in df.columns if any(w in c.lower() for w in ("price", "cost", "margin", "profit", "gp_rate", "commission"))]


def filter_logs(
    logs: DataFrame, level: str | None = None, action: str | None = None, user=None, route: str | None = None, since: str | None = None, until: str | None = None,
    module: str | None = None, trace: str | None = None, upload=None, email: str | None = None, query: str | None = None,
) -> DataFrame:
    """Log rows that fit a form: fields that are equal, texts contained, ``query`` in the action or the message, a user by id or by a part of the address."""
    out = []
    for name, value in (("level", level), ("user_id", user), ("module", module), ("trace_id", trace), ("upload_batch_id", upload)):
        out += [F.col(name) == value] * (value is not None)
    for name, value in (("action", action), ("route", route), ("user_email", email)):
        out += [contains_text(F.col(name), value)] if value else []
    out += [contains_text(F.col("action"), query) | contains_text(F.col("message"), query)] if query else []
    out += [F.col("created_at") >= F.lit(since).cast("timestamp")] * (since is not None) + [F.col("created_at") < F.lit(until).cast("timestamp")] * (until is not None)
    return logs.filter(both(out))


#: Words of keys whose values are secrets (fixed values).
SECRET_KEYS = r"(?i)(password|pass|token|access_token|refresh_token|authorization|cookie|service_role|secret|api[_-]?key|jwt)"


def sanitize(df: DataFrame, column: str, text: int = 500, depth: int = 4, items: int = 20, keys: int = 60) -> DataFrame:
    """``df`` with a nested log value made fit to keep: secrets out, addresses masked, long texts, lists and objects cut.

    Works on structs, arrays and maps of any shape; what lies deeper than
    ``depth`` becomes ``<max-depth>`` where it is text and null elsewhere.
    """
    address = r"^[^\s@]+@[^\s@]+\.[^\s@]+$"

    def clean(c: Column, kind, level: int) -> Column:
        if level > depth:
            return F.when(c.isNotNull(), "<max-depth>") if isinstance(kind, T.StringType) else F.lit(None).cast(kind)
        if isinstance(kind, T.StringType):
            cut = F.when(F.char_length(c) > text, F.concat(F.substring(c, 1, text), F.lit("...<truncated>"))).otherwise(c)
            return F.when(cut.rlike(address), mask_email(cut)).otherwise(cut)
        if isinstance(kind, T.ArrayType):
            return F.transform(F.slice(c, 1, items), lambda x: clean(x, kind.elementType, level + 1))
        if isinstance(kind, T.StructType):
            return F.when(c.isNotNull(), F.struct(*[named(f.name, c[f.name], f.dataType, level).alias(f.name) for f in kind.fields[:keys]]))
        if isinstance(kind, T.MapType):
            some = F.map_from_entries(F.slice(F.map_entries(c), 1, keys))
            shown = lambda k, v: clean(v, kind.valueType, level + 1)
            gone = lambda what: F.lit(what if isinstance(kind.valueType, T.StringType) else None).cast(kind.valueType)
            return F.transform_values(some, lambda k, v: F.when(k.rlike(SECRET_KEYS), gone("<redacted>")).when(k.isin("raw_data", "rawData"), gone("<raw-data-redacted>")).otherwise(shown(k, v)))
        return c

    def named(name: str, c: Column, kind, level: int) -> Column:
        gone = "<redacted>" if re.search(SECRET_KEYS, name) else "<raw-data-redacted>" if name in ("raw_data", "rawData") else None
        if gone:
            return F.lit(gone if isinstance(kind, T.StringType) else None).cast(kind)
        return clean(c, kind, level + 1)

    return df.withColumn(column, clean(F.col(column), df.schema[column].dataType, 0))
