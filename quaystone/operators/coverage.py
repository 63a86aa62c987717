"""Stock against needs, and the sales opportunities that follow."""

from __future__ import annotations

import operator
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from ..functions.scalars import contains_text, normalize_mpn


def status(required: Column, stock: Column) -> Column:
    needs = F.coalesce(required > 0, F.lit(False))
    has = F.coalesce(stock > 0, F.lit(False))
    return F.when(~needs & has, "overstock").when(~needs, "unknown").when(~has, "no_stock").when(stock < required, "partial_stock").when(stock > required, "overstock").otherwise("in_stock")


def dealt(partitions: int | None) -> list[int]:
    return [] if partitions is None else [partitions]


def coverage(rows: DataFrame, partitions: int | None = None) -> DataFrame:
    """Per part number: what is needed, what is in stock, and how they compare.

    ``rows`` are those of ``bags.stock_and_needs``.  Needs and stock are sums
    of what is not negative, null where no row has a quantity.  Attributes are
    the newest row's that has them (of equally new ones the greatest name).
    Rows are dealt into so many ``partitions``; without, into as many as Spark sees fit.
    """
    amount = lambda when, c: F.sum(F.when(F.col(when) & F.col(c).isNotNull(), F.greatest(c, F.lit(0.0))))
    # First by part and upload, without a distinct count of uploads, which would copy every row. Both steps find a part's rows in one partition, so they are dealt out and ordered once.
    each = rows.repartition(*dealt(partitions), "part").groupBy("part", "upload_batch_id").agg(amount("is_need", "need_qty").alias("required"), amount("is_stock", "stock_qty").alias("stock"), F.count("*").alias("rows"), *[F.max(F.when(F.col(c).isNotNull(), F.struct("created_at", c))).alias(c) for c in ("customer", "supplier", "maker")])
    g = each.groupBy("part").agg(F.sum("required").alias("required"), F.sum("stock").alias("stock"), *[F.max(c)[c].alias(c) for c in ("customer", "supplier", "maker")], F.count("*").alias("sources"), F.sum("rows").alias("rows"))
    shortage = F.when(F.col("required").isNotNull(), F.greatest(F.col("required") - F.coalesce("stock", F.lit(0.0)), F.lit(0.0)))
    return g.withColumn("status", status(F.col("required"), F.col("stock"))).withColumn("shortage", shortage)


def coverage_totals(cov: DataFrame) -> DataFrame:
    count = lambda s: F.count_if(F.col("status") == s).alias(s)
    return cov.agg(F.count("*").alias("parts"), *[count(s) for s in ("in_stock", "partial_stock", "no_stock", "overstock", "unknown")], F.sum("required").alias("required"), F.sum("stock").alias("stock"), F.sum("shortage").alias("shortage"))


def coverage_filter(cov: DataFrame, text: str = "", statuses: list[str] | None = None, party: str = "") -> DataFrame:
    out = cov
    if text:
        out = out.filter(F.col("part").contains("".join(text.split()).upper()))
    if statuses:
        out = out.filter(F.col("status").isin(statuses))
    if party:
        out = out.filter((F.lower("supplier") == party.lower()) | (F.lower("maker") == party.lower()))
    return out


def opportunity_groups(signals: DataFrame, by: tuple[str, ...] = (), partitions: int | None = None) -> DataFrame:
    """The signals of every record (``bags.signals``) summed by part number, within the columns ``by``.

    Names are the newest record's that has one.  Flags: missing customer,
    missing supplier or manufacturer, approved, received, several manufacturers.
    ``partitions`` is as in ``coverage``.
    """
    zero = F.lit(0.0)
    named = lambda c: F.max(F.when(F.col(c).isNotNull(), F.struct("created_at", c))).alias(c)
    # Both steps find a part's rows in one partition, so they are dealt out and ordered once.
    each = signals.repartition(*dealt(partitions), *by, "part").groupBy(*by, "part", "upload_batch_id").agg(
        *[F.sum(c).alias(c) for c in ("demand", "stock", "excess")], *[F.max(c).alias(c) for c in ("approved", "received", "no_customer", "no_party")], *[named(c) for c in ("customer", "supplier", "maker")], F.min("maker").alias("least"), F.max("maker").alias("most"),
    )
    g = each.groupBy(*by, "part").agg(
        *[F.coalesce(F.sum(c), zero).alias(c) for c in ("demand", "stock", "excess")], *[F.max(c).alias(c) for c in ("approved", "received", "no_customer", "no_party")], *[F.max(c)[c].alias(c) for c in ("customer", "supplier", "maker")],
        F.coalesce(F.min("least") < F.max("most"), F.lit(False)).alias("mixed_makers"), F.count("*").alias("sources"),
    )
    flags = sum((F.col(c).cast("int") for c in ("no_customer", "no_party", "approved", "received", "mixed_makers")), F.lit(0))
    return g.withColumn("flags", flags)


def opportunities(signals: DataFrame, by: tuple[str, ...] = (), partitions: int | None = None) -> DataFrame:
    """One row for each kind of opportunity of each part (within the columns ``by``), scored and labelled."""
    g = opportunity_groups(signals, by, partitions)
    d, s, e = F.col("demand"), F.col("stock"), F.col("excess")
    kinds = F.array(
        F.when((d > 0) & (s >= d), "immediate_sale").when((d > 0) & (s > 0), "partial_sale").when((d > 0) & (e <= 0), "sourcing_needed"),
        F.when((d > 0) & (e > 0), "excess_resale"),
        F.when((d <= 0) & ((s > 0) | (e > 0)), "stock_without_demand"),
    )
    out = g.withColumn("kind", F.explode(F.filter(kinds, lambda x: x.isNotNull())))
    left = F.greatest(d - s - F.when(F.col("kind") == "excess_resale", e).otherwise(0.0), F.lit(0.0))
    out = out.withColumn("shortage", F.nullif(F.when(d > 0, left), F.lit(0.0)))
    points = lambda when, n: F.when(when, n).otherwise(0)
    score = (
        F.lit(40) + points(d > 0, 10) + points((s > 0) | (e > 0), 10) + points(F.col("shortage") > 0, 5) + points(F.col("customer").isNotNull(), 10)
        + points(F.col("supplier").isNotNull() | F.col("maker").isNotNull(), 5) + points(F.col("approved"), 10) + points(F.col("received"), 5) + points(F.col("sources") > 1, 5) - F.least(F.col("flags") * 5, F.lit(20))
    )
    out = out.withColumn("score", F.greatest(F.lit(0), F.least(F.lit(100), score)))
    label = F.when(F.col("score") >= 75, "high").when(F.col("score") >= 50, "medium").otherwise("low")
    return out.select(*by, "part", "kind", F.nullif("demand", F.lit(0.0)).alias("demand"), F.nullif("stock", F.lit(0.0)).alias("stock"), F.nullif("excess", F.lit(0.0)).alias("excess"), "shortage", "customer", "supplier", "maker", "mixed_makers", "sources", "flags", "score", label.alias("confidence"))


def opportunity_totals(opp: DataFrame) -> DataFrame:
    return opp.groupBy("kind").agg(F.count("*").alias("n"), F.sum("demand").alias("demand"), F.sum("shortage").alias("shortage"), F.count_if(F.col("confidence") == "high").alias("high"))


def top_order() -> list[Column]:
    kind = F.array_position(F.array(*[F.lit(k) for k in ("immediate_sale", "partial_sale", "excess_resale", "sourcing_needed", "stock_without_demand")]), F.col("kind"))
    return [kind, F.desc_nulls_last("demand"), F.desc_nulls_last("shortage"), F.col("part")]


def top_opportunities(opp: DataFrame, n: int = 50) -> DataFrame:
    return opp.orderBy(*top_order()).limit(n)


def opportunity_filter(opp: DataFrame, part: str = "", mpn: str = "", customer: str = "", supplier: str = "", maker: str = "", kind: str | None = None) -> DataFrame:
    """Opportunities that fit a form; the same text as supplier and manufacturer means either."""
    has = lambda c, text: contains_text(F.col(c), text.strip())
    fits = [F.col("part").contains(normalize_mpn(F.lit(part)))] * bool(part) + [F.col("part") == normalize_mpn(F.lit(mpn))] * bool(mpn) + [has("customer", customer)] * bool(customer)
    if supplier and supplier == maker:
        fits.append(has("supplier", supplier) | has("maker", maker))
    else:
        fits += [has("supplier", supplier)] * bool(supplier) + [has("maker", maker)] * bool(maker)
    fits += [F.col("kind") == kind] * (kind is not None)
    return opp.filter(reduce(operator.and_, fits, F.lit(True)))


def confidence_totals(opp: DataFrame, size: int | None = None) -> DataFrame:
    """How many opportunities of each confidence; with ``size``, of the first page of that many, and whether there are more.

    A page and the count of all come from one run: rows are counted as they
    pass on their way to the page, which is all that comes to the driver.
    """
    if size is None:
        count = lambda label: F.count_if(F.col("confidence") == label).alias(label)
        return opp.agg(F.count("*").alias("evaluated"), count("high"), count("medium"), count("low"), F.count("*").alias("total")).withColumn("truncated", F.lit(False))
    rows, total = page(opp, top_order(), size)
    labels = [r.confidence for r in rows.collect()]
    found = (len(labels), *[labels.count(k) for k in ("high", "medium", "low")], total, total > len(labels))
    return opp.sparkSession.createDataFrame([found], "evaluated long, high long, medium long, low long, total long, truncated boolean")


def page(df: DataFrame, order: list[Column], size: int, offset: int = 0) -> tuple[DataFrame, int]:
    """Rows ``offset`` to ``offset + size`` of an order and the number of all, in one run over ``df``."""
    seen = Observation()
    rows = df.observe(seen, F.count(F.lit(1)).alias("n")).orderBy(*order).limit(offset + size).toArrow()
    return df.sparkSession.createDataFrame(rows.slice(offset)) if len(rows) > offset else df.sparkSession.createDataFrame([], df.schema), seen.get["n"]


def client_opportunities(signals: DataFrame, assignments: DataFrame, partitions: int | None = None) -> DataFrame:
    """Per client account: opportunities, those of high confidence, and their parts, over the uploads that ``assignments`` (client, upload_batch_id) gives it.

    An upload may be several clients'; parts are summed by client in the same
    two steps as without, so a large client is no single group before that.
    """
    own = signals.join(assignments.select("client", "upload_batch_id").distinct(), "upload_batch_id")
    found = opportunities(own, ("client",), partitions)
    return found.groupBy("client").agg(F.count("*").alias("opportunities"), F.count_if(F.col("confidence") == "high").alias("high_confidence"), F.countDistinct("part").alias("parts"))


def account_clients(opp_sources: DataFrame, assignments: DataFrame) -> DataFrame:
    """(part, clients): the accounts that the uploads behind each part are assigned to."""
    return opp_sources.join(assignments, "upload_batch_id").groupBy("part").agg(F.array_sort(F.collect_set("client")).alias("clients"))


def structure_profile(df: DataFrame, columns: list[str], by: str) -> DataFrame:
    """Per group and column: how often it is filled, distinct values, whether they are numbers, and the share filled."""
    each = df.select(by, F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in columns])).alias("x"))
    filled = F.nullif(F.trim(F.col("x.value")), F.lit(""))
    return each.groupBy(by, F.col("x.column").alias("column")).agg(
        F.count("*").alias("rows"), F.count(filled).alias("filled"), F.countDistinct(filled).alias("distinct_values"),
        F.when(F.count(filled) == 0, "empty").when(F.count_if(filled.rlike(r"^-?\d+(\.\d+)?([eE][+-]?\d+)?$")) == F.count(filled), "number").otherwise("text").alias("kind"),
        F.round(F.count(filled) / F.count("*"), 4).alias("presence"),
    )


def newest_uploads(uploads: DataFrame, n: int) -> DataFrame:
    """The ``n`` uploads that a view starts from, newest first."""
    return uploads.orderBy(F.desc_nulls_last("created_at"), "id").limit(n)
