"""Column functions for trade records: cleaning, parsing, part numbers, redaction."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Latin letters with marks and what they fold to (fixed values).
ACCENTED = "áàâäãåāéèêëēíìîïīóòôöõōúùûüūñçýÿÁÀÂÄÃÅĀÉÈÊËĒÍÌÎÏĪÓÒÔÖÕŌÚÙÛÜŪÑÇÝ"
PLAIN = "aaaaaaaeeeeeiiiiioooooouuuuuncyyAAAAAAAEEEEEIIIIIOOOOOOUUUUUNCY"

NUMBER = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"
#: Date formats tried in turn.
DATE_FORMATS = ("yyyy-MM-dd", "yyyy/MM/dd", "dd/MM/yyyy", "dd-MM-yyyy", "dd.MM.yyyy", "MMM d, yyyy", "d MMM yyyy")


def settled(df: DataFrame, *columns: Column | str) -> DataFrame:
    """``df.select(*columns)``, each column worked out once a row.

    A one-element generator stands between: conditions on these columns aren't
    pushed below it, where they would work out costly expressions again.
    """
    rows = df.select(*columns)
    return rows.select(F.inline(F.array(F.struct(*[F.col(f"`{c}`") for c in rows.columns]))))


def fold_accents(c: Column) -> Column:
    return F.translate(c, ACCENTED, PLAIN)


def normalize_header(c: Column) -> Column:
    """Accents folded, ``_`` and ``-`` to spaces, other signs dropped, spaces collapsed, lower case."""
    c = F.regexp_replace(fold_accents(F.coalesce(c, F.lit(""))), "[_-]+", " ")
    return F.lower(F.trim(F.regexp_replace(F.regexp_replace(c, r"[^A-Za-z0-9\s]", ""), r"\s+", " ")))


def snake_case(c: Column) -> Column:
    return F.regexp_replace(normalize_header(c), " ", "_")


def sanitize_scalar(c: Column) -> Column:
    """Trimmed text, blank to null, and a quote before what a spreadsheet would run as a formula."""
    c = F.trim(F.regexp_replace(c, "\u0000", ""))
    return F.when(c == "", None).when(c.rlike(r"^[=+\-@]"), F.concat(F.lit("'"), c)).otherwise(c)


def parse_number(c: Column) -> Column:
    """A double from text with thousands commas, a currency sign or a percent; null if it is none."""
    bare = F.regexp_replace(c, r"[%,$\s]", "")
    value = F.when(bare.rlike(NUMBER), bare.try_cast("double"))
    return F.when(c.contains("%") & (value > 1), value / 100).otherwise(value)


def gp_rate(c: Column) -> Column:
    """A margin as a fraction: up to 1 as it is, up to 100 as percent, else null."""
    x = F.abs(c)
    return F.when(x <= 1, c).when(x <= 100, c / 100)


def gp_rate_warns(c: Column) -> Column:
    return F.coalesce(F.abs(c) > 100, F.lit(False))


def parse_date(c: Column) -> Column:
    """A date from text: a spreadsheet serial between 25569 and 80000, or one of ``DATE_FORMATS``."""
    serial = F.when(c.rlike(r"^\d{5}(\.\d+)?$"), c.try_cast("double"))
    day = F.when((serial > 25569) & (serial < 80000), F.date_add(F.lit("1970-01-01").cast("date"), (F.floor(serial) - 25569).cast("int")))
    return F.coalesce(day, *[F.to_date(F.try_to_timestamp(c, F.lit(f))) for f in DATE_FORMATS])


def normalize_mpn(c: Column) -> Column:
    """White space dropped, upper case; thousands separators go only where the whole is a grouped number."""
    c = F.upper(F.regexp_replace(c, r"\s+", ""))
    c = F.when(c.rlike(r"^\d{1,3}([,.]\d{3})+$"), F.regexp_replace(c, "[,.]", "")).otherwise(c)
    return F.nullif(c, F.lit(""))


def review_key(c: Column) -> Column:
    """A part number without any signs."""
    return F.nullif(F.regexp_replace(normalize_mpn(c), "[^A-Z0-9]", ""), F.lit(""))


def first_text(*cols: Column) -> Column:
    """The first that is not blank."""
    return F.coalesce(*[F.nullif(F.trim(c), F.lit("")) for c in cols])


def round_half_up(c: Column, digits: int = 0) -> Column:
    """Rounding with halves towards plus infinity."""
    scale = float(10**digits)
    return F.floor(c * scale + 0.5) / scale


def redact_diagnostic(c: Column) -> Column:
    """E-mail addresses, amounts, phone numbers and long numbers out of a message."""
    c = F.regexp_replace(c, r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}", "[email]")
    c = F.regexp_replace(c, r"\$\s?\d[\d,]*(\.\d+)?", "[amount]")
    c = F.regexp_replace(c, r"\+?\d[\d ()-]{7,}\d", "[phone]")
    return F.regexp_replace(c, r"\d{8,}", "[number]")


def mask_email(c: Column) -> Column:
    """The first two letters and the domain of an address; what is none stays."""
    parts = F.split(c, "@", 3)
    name, domain = F.get(parts, F.lit(0)), F.get(parts, F.lit(1))
    return F.when((name != "") & (F.coalesce(domain, F.lit("")) != ""), F.concat(F.substring(name, 1, 2), F.lit("***@"), domain)).otherwise(c)


def contains_text(c: Column, text: str) -> Column:
    """Case-insensitive containment of user text, with no wildcards."""
    return F.coalesce(F.lower(c).contains(text.lower()), F.lit(False))
