"""Merkle manifest of a table: a tree of digests per group of rows, a tree over the groups, and a proof per row.

H is the lowercase hex SHA-256 of its inputs, concatenated (digests as hex
text).  A row's leaf is H of its fields, each ``-`` if null, else its UTF-8 byte
count, ``:`` and its value.  Each group's leaves ascend by id; every two
consecutive nodes, and a last one alone, become their H until one is left.
The groups' roots, ordered by group (null first, bytewise), likewise give the
root.

Nodes carry nested intervals: node i of level l covers the leaf ranks
[i * 2**l, (i + 1) * 2**l), cut at the number of leaves, so a node's interval
holds those of all below it.  Levels go in bands of ``BAND``.  Within a band,
nodes and members (the nodes below the band) with the same ranks but for the
last ``base + BAND`` bits are one bucket of at most 2**BAND members; an
equi-join on group and bucket with containment of the member's rank in the
node's interval attaches its ancestors in the band.  The ancestor's interval
without the child's that holds the rank is the sibling's.  Ancestors of upper
bands are attached once to the band's 2**BAND times fewer members and handed
down by the same buckets, so a leaf meets one join for them all, and no group,
however large, is in one task: ranks come from ranges of (group, id) whose rows
are numbered where they lie and whose counts, a row a range, are summed up.

Edge cases: rows of equal id are in order of their leaves, and rows equal in
all fields have leaves of their own; a null id comes first; a group of one row
is its leaf; an empty table has no rows and no root; other columns are ignored,
names are given by the caller.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import partitions, quoted, written

#: Levels of a band; a bucket has at most 2**BAND members.
BAND = 6


def hashed(*parts: Column) -> Column:
    return F.sha2(F.concat(*parts).cast("binary"), 256)


def leaf(fields: list[Column]) -> Column:
    """A row's digest."""
    texts = [f.cast("string") for f in fields]
    return hashed(*[F.when(t.isNull(), "-").otherwise(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t)) for t in texts])


def ranked(rows: DataFrame, order: list[str]) -> DataFrame:
    """``rows`` with their ``rank`` among those of their ``tree`` in ``order``, ``n`` of the tree and its ``height``."""
    dealt = rows.repartitionByRange(partitions(rows.sparkSession), "tree", *order).sortWithinPartitions("tree", *order)
    place = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))  # within its partition
    placed = written(dealt.withColumns({"part": F.spark_partition_id(), "place": place}), "placed")
    each = placed.groupBy("tree", "part").agg(F.min("place").alias("first"), F.count("*").alias("rows"))
    own = Window.partitionBy("tree")
    starts = each.select("tree", "part", (F.sum("rows").over(own.orderBy("part")) - F.col("rows") - F.col("first")).alias("shift"), F.sum("rows").over(own).alias("n"))
    starts = written(starts, "starts")
    height = F.when(F.col("n") > 1, F.length(F.bin(F.col("n") - 1))).otherwise(0)
    return written(placed.join(starts, ["tree", "part"]).withColumns({"rank": F.col("place") + F.col("shift"), "height": height}).drop("part", "place", "shift"), "ranked")


def _blocks(rows: DataFrame, base: int) -> DataFrame:
    """Per bucket of members (tree, n, height, rank, digest; of level ``base``): digests of each level of the band, lists of at most 2**BAND."""
    pairs = lambda held: F.transform(F.sequence(F.lit(0), F.floor((F.size(held) - 1) / 2).cast("int")), lambda i: hashed(F.get(held, 2 * i), F.coalesce(F.get(held, 2 * i + 1), F.lit(""))))
    own = rows.groupBy("tree", "n", "height", F.shiftright("rank", BAND).alias("bucket")).agg(F.transform(F.sort_array(F.collect_list(F.struct("rank", "digest"))), lambda x: x["digest"]).alias("own"))
    up = F.sequence(F.lit(1), F.least(F.lit(BAND), F.col("height") - base))
    return own.select("tree", "n", "height", "bucket", F.aggregate(up, F.array("own"), lambda held, _: F.concat(held, F.array(pairs(F.element_at(held, -1))))).alias("levels"))


def _nodes(blocks: DataFrame, base: int) -> DataFrame:
    """(tree, n, height, bucket, level, low, middle, high, left, right, digest): a node, its interval and its children's."""
    each = F.transform(F.sequence(F.lit(1), F.size("levels") - 1), lambda k: F.struct(k.alias("up"), F.get("levels", k).alias("own"), F.get("levels", k - 1).alias("below")))
    level = blocks.select("tree", "n", "height", "bucket", F.explode(each).alias("l")).select("tree", "n", "height", "bucket", "l.up", "l.below", F.posexplode("l.own").alias("i", "digest"))
    wide = lambda k: F.expr(f"shiftleft(1L, {base} + up - {k})")
    at = level.withColumn("low", (F.expr(f"shiftleft(bucket, {BAND} - up)") + F.col("i")) * wide(0))
    return at.select(
        "tree", "n", "height", "bucket", (F.col("up") + base).alias("level"), "low", (F.col("low") + wide(1)).alias("middle"), F.least(F.col("low") + wide(0), F.col("n")).alias("high"),
        F.get("below", 2 * F.col("i")).alias("left"), F.get("below", 2 * F.col("i") + 1).alias("right"), "digest",
    )


def forest(leaves: DataFrame) -> tuple[list[tuple[int, DataFrame, DataFrame]], DataFrame]:
    """Of ``leaves`` (tree, rank, n, height, digest and others): (base, members, nodes) per band, and (tree, digest) of the roots."""
    bands, rows = [], leaves
    roots = leaves.filter("height = 0").select("tree", "digest")
    for base in range(0, leaves.agg(F.max("height")).first()[0] or 0, BAND):
        members = rows.filter(F.col("height") > base)
        blocks = written(_blocks(members, base), "band")
        nodes = _nodes(blocks, base)
        bands.append((base, members, nodes))
        roots = roots.unionByName(nodes.filter("level = height").select("tree", "digest"))
        rows = blocks.filter(F.col("height") > base + BAND).select("tree", "n", "height", F.col("bucket").alias("rank"), F.get(F.get("levels", F.lit(BAND)), F.lit(0)).alias("digest"))
    return bands, written(roots, "roots")


#: A step of a proof: what is hashed before and after what is known, from a level on.
STEP = "array<struct<level:int,before:string,after:string>>"


def paths(leaves: DataFrame, bands: list[tuple[int, DataFrame, DataFrame]], tops: DataFrame, carry: list[str]) -> DataFrame:
    """(``carry``, subroot, path): each leaf's steps up its tree, then those that ``tops`` (tree, subroot, path) has of its tree."""
    above = None
    for base, members, nodes in reversed(bands):
        names = carry if base == 0 else []
        point = F.col("m.rank") * F.lit(1 << base)
        inside = (F.col("m.tree") == F.col("o.tree")) & (F.shiftright("m.rank", BAND) == F.col("o.bucket")) & (F.col("o.low") <= point) & (point < F.col("o.high"))
        met = members.select("tree", "height", "rank", *names).alias("m").join(nodes.select("tree", "bucket", "level", "low", "middle", "high", "left", "right").alias("o"), inside)
        right = point >= F.col("o.middle")
        step = F.struct(F.col("o.level").cast("int").alias("level"), F.when(right, F.col("o.left")).otherwise("").alias("before"), F.when(right, "").otherwise(F.coalesce("o.right", F.lit(""))).alias("after"))
        own = met.groupBy("m.tree", "m.height", "m.rank").agg(*[F.first(quoted(c)).alias(c) for c in names], F.sort_array(F.collect_list(step)).cast(STEP).alias("steps"))
        # A tree's highest band has at most 2**BAND members, so this join has no large key.
        joined = own.filter(F.col("height") <= base + BAND).join(tops, "tree")
        if above is not None:
            higher = above.select("tree", F.col("rank").alias("bucket"), "subroot", "path")
            lower = own.filter(F.col("height") > base + BAND).withColumn("bucket", F.shiftright("rank", BAND)).join(higher, ["tree", "bucket"]).drop("bucket")
            joined = joined.unionByName(lower)
        above = joined.select("tree", "rank", *names, "subroot", F.concat("steps", "path").alias("path"))
        if base:
            above = written(above, "above")
    single = leaves.filter("height = 0").join(tops, "tree").select(*carry, "subroot", "path")
    return single if above is None else single.unionByName(above.select(*carry, "subroot", "path"))


def manifest(docs: DataFrame, key: str = "doc_id", group: str = "lang", fields: tuple[str, ...] = ("doc_id", "source", "lang", "n_chars", "text"), altered: dict[str, Column] | None = None) -> DataFrame:
    """(key, leaf, subroot, root, path, presented, folded_root, verified) per row.

    ``altered`` has columns that stand in for those of their names in what is
    presented for proof; ``folded_root`` is the root that the presented row
    gives with the stored row's siblings.
    """
    column = lambda c: F.col(quoted(c))
    stored, shown = leaf([column(c) for c in fields]), leaf([(altered or {}).get(c, column(c)) for c in fields])
    # Null comes before any text, which is why others begin with a sign.
    tree = F.coalesce(F.concat(F.lit("="), column(group).cast("string")), F.lit(""))
    kept = "presented" if altered else "digest"
    leaves = written(docs.select(tree.alias("tree"), column(key).alias("key"), stored.alias("digest"), *[shown.alias("presented")] * bool(altered)), "leaves")
    leaves = ranked(leaves, ["key", "digest"])
    bands, roots = forest(leaves)
    upper = ranked(roots.select(F.lit("").alias("tree"), F.col("tree").alias("own"), "digest"), ["own"])
    top_bands, top = forest(upper)
    none = upper.select("tree").distinct().select("tree", F.lit(None).cast("string").alias("subroot"), F.array().cast(STEP).alias("path"))
    tops = written(paths(upper, top_bands, none, ["own", "digest"]).select(F.col("own").alias("tree"), F.col("digest").alias("subroot"), "path"), "tops")
    found = top.first()
    out = paths(leaves, bands, tops, list(dict.fromkeys(["key", "digest", kept])))
    folded = F.aggregate("path", F.col(kept), lambda held, s: hashed(s["before"], held, s["after"]))
    root = F.lit(found.digest if found else None).cast("string")
    rows = out.select(F.col("key").alias(key), F.col("digest").alias("leaf"), "subroot", root.alias("root"), "path", F.col(kept).alias("presented"), folded.alias("folded_root"))
    return rows.withColumn("verified", F.col("folded_root") == F.col("root"))


def proof_digest(path: Column) -> Column:
    """H of a proof's siblings, from leaf to root."""
    return hashed(F.array_join(F.transform(path, lambda s: F.concat(s["before"], s["after"])), ""))
