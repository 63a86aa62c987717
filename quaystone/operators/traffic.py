"""Traffic analytics over log events, and alert rules."""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import round_half_up


def range_of(preset: str, today: date) -> tuple[date, date]:
    """First and last day of a preset (seven days where it is unknown)."""
    if preset == "today":
        return today, today
    if preset == "yesterday":
        return today - timedelta(days=1), today - timedelta(days=1)
    return today - timedelta(days=29 if preset == "30d" else 6), today


def is_error() -> Column:
    return F.coalesce((F.col("status_code") >= 400) | F.col("level").isin("error", "fatal", "security"), F.lit(False))


def visitor() -> Column:
    return F.coalesce(F.col("user_id").cast("string"), F.col("ip"))


def per_user(logs: DataFrame, uploads: DataFrame) -> DataFrame:
    u = uploads.groupBy(F.col("uploaded_by").alias("user_id")).agg(F.count("*").alias("uploads"))
    own = logs.filter("user_id is not null").groupBy("user_id").agg(F.count("*").alias("events"), F.countDistinct("route").alias("routes"), F.count_if(is_error()).alias("errors"), F.max("created_at").alias("last_activity"))
    return own.join(u, "user_id", "left").withColumn("uploads", F.coalesce("uploads", F.lit(0)))


def per_route(logs: DataFrame) -> DataFrame:
    mean = round_half_up(F.avg(F.when(F.col("duration_ms") > 0, F.col("duration_ms")))).cast("long")
    return logs.groupBy("route").agg(F.count("*").alias("visits"), F.countDistinct("user_id").alias("users"), F.coalesce(mean, F.lit(0)).alias("mean_ms"), F.count_if(is_error()).alias("errors"))


def per_ip(logs: DataFrame) -> DataFrame:
    key = F.coalesce("ip", F.concat(F.lit("user:"), F.col("user_id").cast("string")), F.lit("anonymous"))
    return logs.groupBy(key.alias("address")).agg(F.count("*").alias("events"), F.min("created_at").alias("first_seen"), F.max("created_at").alias("last_seen"), F.countDistinct("route").alias("routes"), F.max_by("user_agent", F.struct("created_at", "id")).alias("agent"))


def buckets(logs: DataFrame, unit: str) -> DataFrame:
    """Page views in tumbling buckets of an hour or a day."""
    return logs.filter("is_page_view").groupBy(F.date_trunc(unit, "created_at").alias("bucket")).agg(F.count("*").alias("views"), F.countDistinct(visitor()).alias("visitors"))


def totals(logs: DataFrame) -> DataFrame:
    code = F.col("status_code")
    return logs.agg(
        F.count("*").alias("events"), F.count_if("is_page_view").alias("page_views"), F.countDistinct(visitor()).alias("visitors"), F.count_if(is_error()).alias("errors"), F.count_if((code >= 400) & (code < 500)).alias("client_errors"),
        F.count_if(code >= 500).alias("server_errors"), F.count_if(code < 400).alias("successes"), F.coalesce(F.round(F.avg(F.when(F.col("duration_ms") > 0, F.col("duration_ms"))), 2), F.lit(0.0)).alias("mean_ms"), F.count_if(F.col("duration_ms") > 1500).alias("slow"),
    )


def recent_errors(logs: DataFrame, n: int = 20) -> DataFrame:
    return logs.filter(is_error()).orderBy(F.desc("created_at"), F.desc("id")).limit(n)


def error_rollup(logs: DataFrame) -> DataFrame:
    return logs.groupBy("level").agg(F.count("*").alias("n"), F.countDistinct("route").alias("routes"), F.count_if(F.col("duration_ms") > 1500).alias("slow"), F.min("created_at").alias("first_seen"))


def retained(logs: DataFrame, cutoff: str, always: list[str]) -> DataFrame:
    """What a clean-up keeps: newer than the cutoff, or of an action that is kept for good."""
    return logs.filter((F.col("created_at") >= F.lit(cutoff).cast("timestamp")) | F.col("action").isin(always))


#: How long the finder keeps its jobs and their files.
FINDER_JOBS, FINDER_FILES = "14 days", "72 hours"


def expired(df: DataFrame, kept: str, now: str) -> DataFrame:
    """Rows that were made so long before ``now`` that they go."""
    return df.filter(F.col("created_at") + F.expr(f"interval {kept}") <= F.lit(now).cast("timestamp"))


def alerts(events: DataFrame, rules: DataFrame) -> DataFrame:
    """(event, rule, recipient) for each rule that fires: enabled, of the event's type, its condition met.

    ``rules``: rule_id, event_type, enabled, condition, threshold, recipients.
    A condition that ends in ``_gt`` or ``_lt`` compares so, any other asks for
    equality; without condition or threshold a rule always fires.  A threshold
    of ``gp_rate_lt`` over 1 is a percentage.  The rules are few and set by
    hand; the join is by type, so what it makes is bounded by rules per type.
    An event without the value that a condition asks for doesn't fire.
    """
    c, value = F.col("condition"), F.col("value")
    limit = F.when((c == "gp_rate_lt") & (F.col("threshold") > 1), F.col("threshold") / 100).otherwise(F.col("threshold"))
    met = F.when(c.isNull() | limit.isNull(), True).when(c.endswith("_gt"), value > limit).when(c.endswith("_lt"), value < limit).otherwise(value == limit)
    hit = events.join(rules.filter("enabled"), events["action"] == rules["event_type"]).filter(met)
    to = F.when(F.size("recipients") > 0, F.col("recipients")).otherwise(F.array(F.lit("no-recipient")))
    return hit.select("id", "rule_id", F.explode(to).alias("recipient"))


def event_union(page_views: DataFrame, system: DataFrame) -> DataFrame:
    """Both logs as one, tagged with where an event is from; columns of one only are null in the other."""
    tag = lambda df, name: df.withColumn("source", F.lit(name))
    return tag(page_views, "page_view").unionByName(tag(system, "system"), allowMissingColumns=True)
