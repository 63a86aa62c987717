"""Part numbers: lookup, suggestions, offers compared and ranked, price history."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import first_text, normalize_mpn, round_half_up, settled


def lookup(df: DataFrame, asked: DataFrame) -> DataFrame:
    """Records of the asked part numbers (``asked``: mpn); only where none has it, those that quote it."""
    want = asked.select(normalize_mpn(F.col("mpn")).alias("part")).filter("part is not null").distinct()
    exact = df.withColumn("part", normalize_mpn(F.col("mpn"))).join(want, "part")
    rest = want.join(exact.select("part").distinct(), "part", "left_anti")
    quoted = df.withColumn("part", normalize_mpn(F.col("mpn_quoted"))).join(rest, "part")
    return exact.withColumn("matched", F.lit("mpn")).unionByName(quoted.withColumn("matched", F.lit("mpn_quoted")))


def suggest(df: DataFrame, prefix: str, top: int = 12) -> DataFrame:
    """Part numbers that begin with what was typed (three letters at least): exact ones first, then by number."""
    typed = "".join(prefix.split()).upper()
    if len(typed) < 3:
        return df.limit(0).select(F.col("mpn").alias("part"))
    part = normalize_mpn(F.col("mpn"))
    return df.select(part.alias("part")).filter(F.col("part").startswith(typed)).groupBy("part").agg(F.count("*").alias("records")).orderBy(F.col("part") != typed, "part").limit(top)


def _scored(df: DataFrame) -> DataFrame:
    """Every part's suppliers with their best values and score; one aggregate by part and supplier, then one window by part."""
    part = normalize_mpn(first_text(F.col("mpn"), F.col("mpn_quoted")))
    supplier = F.coalesce(first_text(F.col("supplier_name"), F.col("supplier")), F.lit("Unknown supplier"))
    own = settled(df, part.alias("part"), supplier.alias("supplier"), "price", "lead_time_weeks", F.coalesce("on_hand", "qty", F.lit(0.0)).alias("q"), "gp_rate", "has_errors").filter("part is not null")
    s = own.groupBy("part", "supplier").agg(
        F.min("price").alias("price"), F.max("price").alias("dearest"), F.min("lead_time_weeks").alias("lead"), F.max("q").alias("quantity"), F.avg("gp_rate").alias("gp"),
        F.min(F.coalesce("has_errors", F.lit(False))).alias("dirty"), F.count("*").alias("offers"),
    )
    w = Window.partitionBy("part")
    s = s.withColumn("best", F.min("price").over(w)).withColumn("fast", F.min("lead").over(w)).withColumn("most", F.max("quantity").over(w))
    zero = F.lit(0.0)
    price = F.when(F.col("price").isNull(), zero).when(F.col("price") <= F.col("best"), F.lit(45.0)).otherwise(F.greatest(zero, 35 - 35 * (F.col("price") - F.col("best")) / F.greatest(F.col("best"), F.lit(1.0))))
    lead = F.when(F.col("lead").isNull(), zero).when(F.col("lead") <= F.col("fast"), F.lit(20.0)).otherwise(F.greatest(zero, 15 - (F.col("lead") - F.col("fast"))))
    amount = F.when(F.col("most") > 0, F.least(F.lit(20.0), 20 * F.col("quantity") / F.col("most"))).otherwise(zero)
    margin = F.least(F.lit(10.0), F.greatest(zero, 20 * F.coalesce("gp", zero)))
    clean = F.when(F.col("dirty"), zero).otherwise(F.lit(5.0))
    scored = s.withColumn("score", round_half_up(price + lead + amount + margin + clean, 2))
    rank = Window.partitionBy("part").orderBy(F.desc("score"), F.asc_nulls_last("price"), "supplier")
    return scored.withColumn("position", F.row_number().over(rank))


def supplier_ranking(df: DataFrame) -> DataFrame:
    """Every part's suppliers scored: price 45, lead time 20, quantity 20, margin 10, clean data 5.

    A supplier counts with its best offer: lowest price, fastest lead, highest
    quantity; data is clean if any of its offers has no errors.
    """
    return _scored(df).select("part", "supplier", "offers", "price", "lead", "quantity", F.round(F.round("gp", 10), 4).alias("average_gp"), "score", "position")


def offer_summary(df: DataFrame) -> DataFrame:
    """Per part: best and worst price, fastest lead, greatest quantity, who is best ranked and what they are best at.

    Made from the ranking's rows, which already lie by part: records are aggregated once.
    """
    top = F.col("position") == 1
    first = lambda c: F.max(F.when(top, c))
    best_at = F.array_join(F.array_compact(F.array(F.when(F.col("price") <= F.col("best"), "price"), F.when(F.col("lead") <= F.col("fast"), "lead"), F.when((F.col("quantity") >= F.col("most")) & (F.col("most") > 0), "quantity"))), ",")
    return _scored(df).groupBy("part").agg(
        F.sum("offers").alias("offers"), F.min("price").alias("best_price"), F.max("dearest").alias("worst_price"), F.min("lead").alias("fastest_lead"), F.max("quantity").alias("most_quantity"),
        first(F.col("supplier")).alias("recommended"), first(F.col("score")).alias("score"), first(best_at).alias("best_at"),
    )


def lookup_candidates(asked: DataFrame) -> DataFrame:
    """(mpn, candidate, place): the ways a part number may be stored: as typed, normalised, and long numbers with grouped digits."""
    part = normalize_mpn(F.col("mpn"))
    grouped = lambda sign: F.when(part.rlike("^[0-9]{4,}$"), F.regexp_replace(part, r"\B(?=(\d{3})+$)", sign))
    ways = F.array_distinct(F.array_compact(F.array(F.nullif(F.trim("mpn"), F.lit("")), part, grouped(","), grouped("."))))
    return asked.select("mpn").distinct().select("mpn", F.posexplode(ways).alias("place", "candidate"))


def plain_ranking(df: DataFrame) -> DataFrame:
    """Every part's suppliers for roles that see no prices: offers, highest quantity and fastest lead, by name."""
    part = normalize_mpn(first_text(F.col("mpn"), F.col("mpn_quoted")))
    supplier = F.coalesce(first_text(F.col("supplier_name"), F.col("supplier")), F.lit("Unknown supplier"))
    own = settled(df, part.alias("part"), supplier.alias("supplier"), F.coalesce("on_hand", "qty").alias("q"), "lead_time_weeks").filter("part is not null")
    s = own.groupBy("part", "supplier").agg(F.count("*").alias("offers"), F.max("q").alias("quantity"), F.min("lead_time_weeks").alias("lead"))
    return s.withColumn("position", F.row_number().over(Window.partitionBy("part").orderBy(F.lower("supplier"), "supplier")))


def ranking_for(df: DataFrame, role: str) -> DataFrame:
    """What a role may see of the ranking: an admin all, a manager the plain one, others no suppliers at all."""
    if role == "admin":
        return supplier_ranking(df)
    plain = plain_ranking(df)
    return plain if role == "manager" else plain.limit(0)


def summary_for(df: DataFrame, role: str) -> DataFrame:
    """The summary without prices, recommendation and score for roles that don't see prices."""
    out = offer_summary(df)
    if role == "admin":
        return out
    return out.withColumns({c: F.lit(None).cast(out.schema[c].dataType) for c in ("best_price", "worst_price", "recommended", "score", "best_at")})


def price_history(df: DataFrame, uploads: DataFrame) -> DataFrame:
    """Prices of each part over time: the upload's date, else the record's."""
    u = uploads.select(F.col("id").alias("upload_batch_id"), F.col("created_at").alias("uploaded_at"))
    out = df.filter("price is not null").withColumn("part", normalize_mpn(first_text(F.col("mpn"), F.col("mpn_quoted")))).filter("part is not null").join(u, "upload_batch_id", "left")
    return out.groupBy("part", F.date_format(F.coalesce("uploaded_at", "created_at"), "yyyy-MM-dd").alias("day")).agg(F.min("price").alias("low"), F.max("price").alias("high"), F.count("*").alias("n"))
