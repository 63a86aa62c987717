"""One form searched over records, uploads, errors and people, and suggestions while typing.

The form's fields become conditions on columns; nothing parses sentences here.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from datetime import date

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import contains_text
from ..operators.filters import both, compare, either


@dataclass
class Form:
    """``numbers``: column -> (operator, value); lead time is in days; ``until`` is included."""

    mpn: str = ""
    customer: str = ""
    supplier: str = ""
    po: str = ""
    country: str = ""
    employee: str = ""
    error: str = ""
    category: str | None = None
    has_errors: bool = False
    missing_mpn: bool = False
    since: date | None = None
    until: date | None = None
    numbers: dict[str, tuple[str, float]] = field(default_factory=dict)

    def span(self) -> list[Column]:
        low = [F.col("created_at") >= F.lit(self.since).cast("timestamp")] * (self.since is not None)
        return low + [F.col("created_at") < F.date_add(F.lit(self.until), 1).cast("timestamp")] * (self.until is not None)


def _in_any(text: str, *columns: str) -> list[Column]:
    return [either([contains_text(F.col(c), text) for c in columns])] * bool(text)


def _number(name: str, op: str, value: float) -> Column:
    return compare("lead_time_weeks", op, round(value / 7, 3)) if name == "lead_time_days" else compare(name, op, value)


def people(profiles: DataFrame, form: Form) -> DataFrame:
    return profiles.filter(both(_in_any(form.employee, "full_name", "email"))) if form.employee else profiles.limit(0)


def records(df: DataFrame, profiles: DataFrame, form: Form) -> DataFrame:
    """Active records that fit; an employee that nobody is finds nothing."""
    found = _in_any(form.mpn, "mpn", "mpn_quoted") + _in_any(form.customer, "customer", "client") + _in_any(form.supplier, "supplier", "supplier_name") + _in_any(form.po, "po") + _in_any(form.country, "shipping_point_country")
    found += [F.col("category") == form.category] * (form.category is not None) + [F.col("has_errors")] * form.has_errors + [F.col("mpn").isNull()] * form.missing_mpn
    out = df.filter(both(found + form.span() + [_number(k, *v) for k, v in form.numbers.items() if k != "upload_errors"]))
    return out.join(people(profiles, form).select(F.col("id").alias("uploaded_by")), "uploaded_by", "left_semi") if form.employee else out


def uploads(df: DataFrame, profiles: DataFrame, form: Form) -> DataFrame:
    found = form.span() + [F.col("detected_category") == form.category] * (form.category is not None) + [compare("error_count", *v) for k, v in form.numbers.items() if k == "upload_errors"]
    out = df.filter(both(found))
    return out.join(people(profiles, form).select(F.col("id").alias("uploaded_by")), "uploaded_by", "left_semi") if form.employee else out


def errors(df: DataFrame, form: Form) -> DataFrame:
    return df.filter(both(form.span() + _in_any(form.error, "type", "column")))


def everywhere(form: Form, active: DataFrame, sent: DataFrame, issues: DataFrame, profiles: DataFrame) -> DataFrame:
    """(entity, id, created_at) of all that fits the form in any of the four tables."""
    tagged = lambda df, name: df.select(F.lit(name).alias("entity"), F.col("id").cast("string").alias("id"), "created_at")
    staff = people(profiles, form).withColumn("created_at", F.lit(None).cast("timestamp"))
    return tagged(records(active, profiles, form), "record").unionByName(tagged(uploads(sent, profiles, form), "upload")).unionByName(tagged(errors(issues, form), "error")).unionByName(tagged(staff, "person"))


def suggestions(df: DataFrame, typed: str, columns: dict[str, str], each: int) -> DataFrame:
    """(kind, suggestion, position): distinct values that contain what was typed, a few of each kind."""
    rows = df.select(F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.trim(c).alias("value")) for k, c in columns.items()])).alias("x")).select("x.*").filter(contains_text(F.col("value"), typed))
    return _few(rows, each)


def all_suggestions(typed: str, active: DataFrame, sent: DataFrame, profiles: DataFrame, each: int = 6, few: int = 5) -> DataFrame:
    """The groups of a search box: parts, customers, suppliers, orders, categories, countries, files, people, departments."""
    own = suggestions(active, typed, {"mpn": "mpn", "customer": "customer", "supplier": "supplier", "po": "po", "category": "category", "description": "description"}, each)
    files = suggestions(sent, typed, {"file": "original_file_name"}, few)
    staff = suggestions(profiles, typed, {"person": "full_name", "department": "department"}, few)
    return own.unionByName(files).unionByName(staff)


def _few(rows: DataFrame, each: int) -> DataFrame:
    one = rows.groupBy("kind", F.lower("value").alias("key")).agg(F.min("value").alias("suggestion"))
    w = Window.partitionBy("kind").orderBy("key")
    return one.withColumn("position", F.row_number().over(w)).filter(F.col("position") <= each).select("kind", "suggestion", "position")
