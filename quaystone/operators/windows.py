"""Duplicates, latest rows, paging and timelines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .coverage import dealt


def content_hash(*bags: str) -> Column:
    """md5 of bags that doesn't depend on the order of their keys."""
    return F.md5(F.to_json(F.struct(*[F.array_sort(F.map_entries(b)).alias(f"b{i}") for i, b in enumerate(bags)]), {"ignoreNullFields": "false"}))


def duplicates(df: DataFrame, keys: list[str], order: list[Column], id_: str = "id") -> DataFrame:
    """(``keys``, id, copies, keeper, position): rows with an equal key, the first by ``order`` being kept.

    Only keys that occur more than once (counted before any shuffle of rows)
    reach the windows.
    """
    again = df.groupBy(*keys).agg(F.count("*").alias("copies")).filter("copies > 1")
    same = None
    for k in keys:
        c = F.col(f"l.{k}").eqNullSafe(F.col(f"r.{k}"))
        same = c if same is None else same & c
    rows = df.alias("l").join(again.alias("r"), same).select("l.*", "r.copies")
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("keeper", F.first(id_).over(w)).withColumn("position", F.row_number().over(w))


def cleanup_plan(dups: DataFrame, keys: list[str]) -> DataFrame:
    """Per duplicate group: how many to remove and how sure that is."""
    n = F.max("copies")
    return dups.groupBy(*keys).agg((n - 1).alias("removable"), F.max("keeper").alias("keeper"), F.when(n > 10, "low").when(n > 3, "medium").otherwise("high").alias("confidence"))


def cleanup_summary(active: DataFrame, dups: DataFrame, declared: DataFrame, by: str = "upload_batch_id") -> DataFrame:
    """Per upload: what a clean-up of exact duplicates would leave, and how safe it is.

    ``dups`` are those of ``duplicates``; ``declared`` has (``by``, counters...),
    of which the greatest is what should be left.
    """
    counters = [c for c in declared.columns if c != by]
    expected = declared.select(by, F.coalesce(F.greatest(*counters) if len(counters) > 1 else F.col(counters[0]), F.lit(0)).alias("expected"))
    d = dups.groupBy(by).agg(F.count_if(F.col("position") > 1).alias("to_archive"), F.max("copies").alias("largest"))
    n = active.groupBy(by).agg(F.count("*").alias("active")).join(d, by, "left").join(expected, by, "left").na.fill(0, ["to_archive", "largest", "expected"])
    left = F.col("active") - F.col("to_archive")
    some, large, huge, off = F.col("to_archive") > 0, F.col("largest") > 3, F.col("largest") > 10, F.col("residual") != 0
    out = n.withColumn("remaining", left).withColumn("residual", left - F.col("expected"))
    confidence = F.when(~some, "high").when(huge, "low").when(large, "medium").otherwise("high")
    risk = F.when(huge, "high").when(large | off, "medium").otherwise("low")
    return out.select(by, "active", "to_archive", "largest", "expected", "remaining", "residual", off.alias("mismatch"), confidence.alias("confidence"), (some & ~huge).alias("safe"), risk.alias("risk"))


def business_key() -> Column:
    """Customer, supplier, part, order and quantity of a row as one text in lower case; null where there are fewer than three.

    Supplier, part and quantity fall back to the supplier's name, the quoted
    part and the requested quantity; blanks and a quantity of zero are no part.
    """
    qty = F.coalesce("qty", "req_qty")
    number = F.when(qty == F.floor(qty), F.floor(qty).cast("string")).otherwise(qty.cast("string"))
    parts = F.filter(F.array("customer", F.coalesce("supplier", "supplier_name"), F.coalesce("mpn", "mpn_quoted"), "po", F.when(qty != 0, number)), lambda x: x.isNotNull() & (x != ""))
    key = F.lower(F.array_join(parts, "|"))
    return F.when(F.size(F.split(key, r"\|")) >= 3, key)


def business_key_duplicates(df: DataFrame, id_: str = "id", order: tuple[str, ...] = ("created_at",)) -> DataFrame:
    """Rows of an equal ``business_key``: issues each gains.

    The first by ``order`` gains an issue for each of the others, which gain one.
    Rows are counted by a 64-bit hash of the key before any is shuffled, and
    only those with a repeated hash meet by their key.
    """
    keyed = df.select(id_, *[c for c in order if c != id_], business_key().alias("key")).withColumn("hash", F.when(F.col("key").isNotNull(), F.xxhash64("key")))
    again = keyed.groupBy("hash").agg(F.count("hash").alias("n")).filter("n > 1").select("hash")
    rows = keyed.join(again, "hash")
    w = Window.partitionBy("key")
    out = rows.withColumn("copies", F.count("*").over(w)).withColumn("place", F.row_number().over(w.orderBy(*order, id_))).filter("copies > 1")
    return out.select(id_, "key", "copies", F.when(F.col("place") == 1, F.col("copies") - 1).otherwise(F.lit(1)).alias("issues"))


def repeats(df: DataFrame, within: str, key: str, place: tuple[str | Column, ...], partitions: int | None = None) -> DataFrame:
    """Adds ``repeats``: how many issues a row gains for the others of the same ``within`` and ``key``.

    The first by ``place`` gains one for each of the others, which gain one; a
    row without a key gains none.  Rows are read, dealt out and ordered once,
    into so many ``partitions`` (without, into as many as Spark sees fit), so
    ``df`` should have no more columns than are needed.
    """
    # Rows without a key are dealt by their place, so they aren't all in one task.
    alone = F.when(F.col(key).isNull(), F.xxhash64(*place))
    keyed = df.withColumn("__alone", alone).repartition(*dealt(partitions), within, key, "__alone")
    w = Window.partitionBy(within, key, "__alone").orderBy(*place)
    copies = F.count("*").over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    gained = F.when(F.row_number().over(w) == 1, copies - 1).otherwise(F.lit(1))
    return keyed.withColumn("repeats", F.when(F.col(key).isNull(), F.lit(0)).otherwise(gained)).drop("__alone")


def archive(df: DataFrame, doomed: DataFrame, id_: str, at: Column) -> DataFrame:
    """``archived_at`` set on the rows of ``doomed``; what was archived stays as it was."""
    marks = doomed.select(F.col(id_).alias("__id")).distinct().withColumn("__hit", F.lit(True))
    out = df.join(marks, df[id_] == marks["__id"], "left")
    return out.withColumn("archived_at", F.when(F.col("archived_at").isNull() & F.col("__hit"), at).otherwise(F.col("archived_at"))).drop("__id", "__hit")


def restore(df: DataFrame, ids: DataFrame, id_: str) -> DataFrame:
    """The opposite of ``archive``."""
    marks = ids.select(F.col(id_).alias("__id")).distinct().withColumn("__hit", F.lit(True))
    out = df.join(marks, df[id_] == marks["__id"], "left")
    return out.withColumn("archived_at", F.when(F.col("__hit"), None).otherwise(F.col("archived_at"))).drop("__id", "__hit")


def latest_per_group(df: DataFrame, group: list[str], order: list[str]) -> DataFrame:
    """The greatest row of each group by ``order``, as an aggregate (partial before the shuffle)."""
    rest = [c for c in df.columns if c not in group and c not in order]
    top = df.groupBy(*group).agg(F.max(F.struct(*order, *rest)).alias("__top"))
    return top.select(*group, "__top.*").select(*df.columns)


def first_by_key(df: DataFrame, key: Column, order: list[str]) -> DataFrame:
    """One row a key: the least by ``order``."""
    rest = [c for c in df.columns if c not in order]
    return df.groupBy(key.alias("__key")).agg(F.min(F.struct(*order, *rest)).alias("__top")).select("__top.*").select(*df.columns)


def page(df: DataFrame, order: list[Column], number: int, size: int, most: int = 200) -> DataFrame:
    """Page ``number`` (from 1) of an ordered result; sizes are clamped to 1..``most``."""
    size = max(1, min(most, size))
    return df.orderBy(*order).offset((max(1, number) - 1) * size).limit(size)


def timeline(sources: dict[str, DataFrame]) -> DataFrame:
    """Rows of several tables tagged with where they are from."""
    out = None
    for name, df in sources.items():
        df = df.withColumn("source", F.lit(name))
        out = df if out is None else out.unionByName(df, allowMissingColumns=True)
    return out
