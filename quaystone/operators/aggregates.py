"""Grouped business metrics."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import first_text, normalize_mpn, round_half_up

UNSPECIFIED = "Unspecified"
MISSING = "Missing MPN"


def group_count(df: DataFrame, value: Column, empty: str = UNSPECIFIED, top: int | None = None) -> DataFrame:
    """(label, n, percent) by trimmed label; percents are of all rows; most first, ties by label."""
    counts = df.groupBy(F.coalesce(first_text(value.cast("string")), F.lit(empty)).alias("label")).agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n").alias("total"))
    out = counts.crossJoin(F.broadcast(total)).select("label", "n", round_half_up(100.0 * F.col("n") / F.col("total")).cast("long").alias("percent"))
    return out.orderBy(F.desc("n"), "label").limit(top) if top else out


def money_sum(c: Column) -> Column:
    """The sum in whole cents, so that it doesn't depend on the order of rows."""
    return F.sum(F.round(F.coalesce(c, F.lit(0.0)) * 100).cast("long")) / 100


def mean_nonzero(c: Column, digits: int = 4) -> Column:
    """The mean of what is neither null nor zero; 0 if there is nothing."""
    return F.round(F.coalesce(F.avg(F.nullif(c, F.lit(0.0))), F.lit(0.0)), digits)


def mpn_groups(df: DataFrame, top: int = 10) -> DataFrame:
    """Counts by part number (quoted where missing), with the missing ones last and without percent, then the top."""
    mpn = first_text(F.col("mpn"), F.col("mpn_quoted"))
    named = group_count(df.filter(mpn.isNotNull()), mpn, top=top).withColumn("place", F.lit(0))
    missing = df.filter(mpn.isNull()).agg(F.count("*").alias("n")).filter("n > 0").select(F.lit(MISSING).alias("label"), "n", F.lit(None).cast("long").alias("percent"), F.lit(1).alias("place"))
    return named.unionByName(missing).orderBy("place", F.desc("n"), "label").limit(top + 1).drop("place")


def incomplete() -> Column:
    """A record that lacks a party, a part, a quantity or a price."""
    pairs = (("customer", "client"), ("supplier", "supplier_name"), ("mpn", "mpn_quoted"), ("qty", "req_qty"), ("price", "total_price"))
    return reduce(lambda a, b: a | b, [first_text(*[F.col(c).cast("string") for c in p]).isNull() for p in pairs])


def platform_totals(active: DataFrame, uploads: DataFrame, profiles: DataFrame) -> DataFrame:
    """One row of the totals of a dashboard."""
    a = active.agg(
        F.count("*").alias("total_records"),
        F.countDistinct(F.coalesce("category", F.lit("Generic"))).alias("categories_detected"),
        money_sum(F.col("qty")).alias("total_qty"),
        money_sum(F.col("potential_amount_usd")).alias("total_potential_usd"),
        money_sum(F.col("total_price")).alias("total_price"),
        money_sum(F.col("gp")).alias("gross_profit"),
        mean_nonzero(F.col("gp_rate")).alias("average_gp_rate"),
        money_sum(F.col("commission")).alias("commission_total"),
        F.count_if("has_errors").alias("records_with_errors"),
        F.count_if(incomplete()).alias("incomplete_records"),
        F.count_if(first_text(F.col("mpn"), F.col("mpn_quoted")).isNull()).alias("records_missing_mpn"),
    )
    u = uploads.agg(F.count_if(F.col("archived_at").isNull()).alias("total_uploads"), F.max("created_at").alias("last_upload"))
    p = profiles.agg(F.count_if("is_active").alias("active_employees"))
    return a.crossJoin(u).crossJoin(p)


def breakdowns(active: DataFrame, profiles: DataFrame, top: int = 10) -> DataFrame:
    """Counts over several dimensions in one pass: (dimension, label, n, percent, position) of each one's top.

    Rows are counted once by all dimensions together (partial sums before the
    shuffle), and only these counts are spread over the dimensions.
    """
    people = F.broadcast(profiles.select(F.col("id").alias("uploaded_by"), F.col("full_name").alias("uploader"), "department", "role", "region"))
    own = active.join(people, "uploaded_by", "left").select(
        "category", "uploader", "department", "role", "region", first_text(F.col("mpn"), F.col("mpn_quoted")).alias("mpn"),
        first_text(F.col("customer"), F.col("client")).alias("customer"), first_text(F.col("supplier"), F.col("supplier_name")).alias("supplier"), F.date_format("created_at", "yyyy-MM-dd").alias("day"),
    )
    each = own.select(F.explode(F.array(*[F.struct(F.lit(c).alias("dimension"), F.coalesce(first_text(F.col(c)), F.lit(UNSPECIFIED)).alias("label")) for c in own.columns])).alias("x"))
    staff = profiles.filter("is_active").groupBy(F.lit("active_department").alias("dimension"), F.coalesce(first_text(F.col("department")), F.lit(UNSPECIFIED)).alias("label")).agg(F.count("*").alias("n"))
    counts = each.groupBy("x.dimension", "x.label").agg(F.count("*").alias("n")).unionByName(staff)
    totals = counts.groupBy("dimension").agg(F.sum("n").alias("total"))
    w = Window.partitionBy("dimension").orderBy(F.desc("n"), "label")
    ranked = counts.withColumn("position", F.row_number().over(w)).filter(F.col("position") <= top)
    return ranked.join(F.broadcast(totals), "dimension").select("dimension", "label", "n", round_half_up(100.0 * F.col("n") / F.col("total")).cast("long").alias("percent"), "position")


def category_modules(active: DataFrame) -> DataFrame:
    """One row of figures for each category's module."""
    has = lambda *c: first_text(*[F.col(x) for x in c])
    return active.groupBy(F.coalesce("category", F.lit("Generic")).alias("module")).agg(
        F.count("*").alias("records"), money_sum(F.col("qty")).alias("qty"), money_sum(F.col("total_price")).alias("total_price"), money_sum(F.col("gp")).alias("gp"),
        mean_nonzero(F.col("gp_rate")).alias("gp_rate"), mean_nonzero(F.col("lead_time_weeks"), 2).alias("lead_time"), F.count_if("has_errors").alias("with_errors"),
        F.countDistinct(F.coalesce(has("mpn_quoted"), F.lit(UNSPECIFIED))).alias("quoted_labels"), F.countDistinct(has("supplier", "supplier_name")).alias("suppliers"), F.countDistinct(has("customer", "client")).alias("customers"),
    )


def module_groups(active: DataFrame, own: dict[str, dict[str, Column]], top: int = 8) -> DataFrame:
    """(module, list, label, n, percent, position): the most frequent labels of each category's lists.

    Every module lists customers, suppliers and part numbers; ``own`` adds
    lists to some.  Records without a part number come last, without percent.
    Labels are counted before any shuffle and ranked by a limit within each
    task; totals are one row a list.
    """
    label = lambda *c: F.coalesce(first_text(*[F.col(x) for x in c]), F.lit(UNSPECIFIED))
    module, item = F.coalesce("category", F.lit("Generic")), lambda name, c: F.struct(F.lit(name).alias("list"), c.alias("label"))
    items = [item("customer", label("customer", "client")), item("supplier", label("supplier_name", "supplier")), item("mpn", F.coalesce(first_text(F.col("mpn"), F.col("mpn_quoted")), F.lit(MISSING)))]
    items += [F.when(module == m, item(name, F.coalesce(first_text(c.cast("string")), F.lit(UNSPECIFIED)))) for m, lists in own.items() for name, c in lists.items()]
    each = active.select(module.alias("module"), F.explode(F.filter(F.array(*items), lambda x: x.isNotNull())).alias("x"))
    counts = each.groupBy("module", "x.list", "x.label").agg(F.count("*").alias("n")).withColumn("missing", (F.col("list") == "mpn") & (F.col("label") == MISSING))
    totals = counts.filter("not missing").groupBy("module", "list").agg(F.sum("n").alias("total"))
    place = F.row_number().over(Window.partitionBy("module", "list").orderBy("missing", F.desc("n"), "label"))
    ranked = counts.withColumn("position", place).filter(F.col("position") <= top)
    percent = F.when(~F.col("missing"), round_half_up(100.0 * F.col("n") / F.col("total")).cast("long"))
    return ranked.join(F.broadcast(totals), ["module", "list"], "left").select("module", "list", "label", "n", percent.alias("percent"), "position")


def activity_directory(profiles: DataFrame, uploads: DataFrame, active: DataFrame) -> DataFrame:
    """Per employee: uploads, active records and the last upload; both sides are summed before the join."""
    u = uploads.groupBy("uploaded_by").agg(F.count("*").alias("uploads"), F.max("created_at").alias("last_upload"))
    r = active.groupBy("uploaded_by").agg(F.count("*").alias("records"))
    out = profiles.join(u, profiles["id"] == u["uploaded_by"], "left").drop("uploaded_by").join(r, profiles["id"] == r["uploaded_by"], "left")
    return out.select("id", "full_name", "role", "department", F.coalesce("uploads", F.lit(0)).alias("uploads"), F.coalesce("records", F.lit(0)).alias("records"), "last_upload")


def client_metrics(active: DataFrame) -> DataFrame:
    """Per client account: files, distinct part numbers, demand and stock lines."""
    name = first_text(F.col("customer"), F.col("client"))
    return active.filter(name.isNotNull()).groupBy(name.alias("client")).agg(
        F.countDistinct("upload_batch_id").alias("files"), F.countDistinct(normalize_mpn(first_text(F.col("mpn"), F.col("mpn_quoted")))).alias("part_numbers"),
        F.count_if(F.coalesce("req_qty", "qty") > 0).alias("demand_lines"), F.count_if(F.col("on_hand") > 0).alias("stock_lines"),
    )


def issues(df: DataFrame) -> DataFrame:
    """Adds ``issues``: what is wrong with a record, as (type, severity, column)."""
    issue = lambda when, kind, severity, column: F.when(when, F.struct(F.lit(kind).alias("type"), F.lit(severity).alias("severity"), F.lit(column).alias("column")))
    all_ = F.array(
        issue(first_text(F.col("mpn"), F.col("mpn_quoted")).isNull(), "missing_mpn", "high", "mpn"),
        issue(F.col("qty").isNull() & F.col("req_qty").isNull(), "missing_quantity", "medium", "qty"),
        issue(F.col("price").isNull(), "missing_price", "medium", "price"),
        issue(F.col("gp_rate").isNull(), "missing_margin", "low", "gp_rate"),
        issue(F.col("has_errors"), "technical_error", "critical", "row"),
    )
    return df.withColumn("issues", F.filter(all_, lambda x: x.isNotNull()))


def issue_rollup(with_issues: DataFrame) -> DataFrame:
    """Issues by type and severity, with the first row that has each."""
    return with_issues.select("row_index", "id", F.explode("issues").alias("i")).groupBy("i.type", "i.severity").agg(F.count("*").alias("n"), F.min("row_index").alias("first_row"), F.countDistinct("id").alias("records"))


def weight() -> Column:
    """The penalties of a row's ``issues`` by severity."""
    weigh = lambda a, i: a + F.when(i["severity"] == "critical", 30).when(i["severity"] == "high", 20).when(i["severity"] == "medium", 10).otherwise(3)
    return F.aggregate("issues", F.lit(0), weigh)


def scores(weight: Column, flawed: Column) -> list[Column]:
    """Two scores of a group: 100 less mean penalties (60 at most a row), and the share of rows without any issue."""
    n = F.count("*")
    return [
        round_half_up(100 - 100.0 * F.sum(F.least(F.lit(60), weight)) / (60 * n)).cast("long").alias("workbook_score"),
        (round_half_up(1000.0 * (n - F.count_if(flawed)) / n) / 10).alias("worker_score"),
    ]


def quality_scores(with_issues: DataFrame, by: str) -> DataFrame:
    """The ``scores`` of each group by the rows' issues."""
    return with_issues.groupBy(by).agg(F.count("*").alias("records"), *scores(weight(), F.size("issues") > 0))


def created_on(df: DataFrame, day: str) -> DataFrame:
    """How many records were created on a day (UTC)."""
    return df.agg(F.count_if(F.to_date("created_at") == F.lit(day).cast("date")).alias("records_uploaded_today"))


def assistant_usage(logs: DataFrame, action: str, since: str) -> DataFrame:
    """Calls of a module since a time: all, failed, and the mean of positive durations, rounded."""
    own = logs.filter((F.col("action") == action) & (F.col("created_at") >= F.lit(since).cast("timestamp")))
    took = F.avg(F.when(F.col("duration_ms") > 0, F.col("duration_ms")))
    return own.agg(F.count("*").alias("total"), F.count_if(F.col("level").isin("error", "fatal")).alias("failures"), F.coalesce(round_half_up(took), F.lit(0.0)).cast("long").alias("mean_ms"))


def top_labels(df: DataFrame, by: str, columns: dict[str, Column], top: int = 5) -> DataFrame:
    """(by, list, label, n, percent, position): for every module, the most frequent labels of each of its lists, in one pass."""
    each = df.select(by, F.explode(F.array(*[F.struct(F.lit(k).alias("list"), F.coalesce(first_text(c.cast("string")), F.lit(UNSPECIFIED)).alias("label")) for k, c in columns.items()])).alias("x"))
    counts = each.groupBy(by, "x.list", "x.label").agg(F.count("*").alias("n"))
    w = Window.partitionBy(by, "list")
    ranked = counts.withColumn("total", F.sum("n").over(w)).withColumn("position", F.row_number().over(w.orderBy(F.desc("n"), "label"))).filter(F.col("position") <= top)
    return ranked.select(by, "list", "label", "n", round_half_up(100.0 * F.col("n") / F.col("total")).cast("long").alias("percent"), "position")


def legacy_modules(df: DataFrame, by: str) -> DataFrame:
    """One row of figures a module of the older analytics: counts, sums, means without zeros, and counts by words."""
    says = lambda c, words: F.count_if(F.coalesce(F.lower(F.col(c)).rlike(words), F.lit(False)))
    return df.groupBy(by).agg(
        F.count("*").alias("records"), money_sum(F.col("quantity")).alias("quantity"), mean_nonzero(F.col("unit_cost"), 2).alias("average_unit_cost"), mean_nonzero(F.col("margin"), 2).alias("average_margin"),
        money_sum(F.col("total_sale")).alias("total_sale"), money_sum(F.col("commission")).alias("commission"), says("customs", "pending").alias("customs_pending"), says("authenticity", "suspicious|fail|counterfeit").alias("suspicious"),
    )
