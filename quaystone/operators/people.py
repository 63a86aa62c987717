"""People, conversations and what they may see."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import contains_text


def directory(profiles: DataFrame, text: str = "", active_only: bool = True, most: int = 500) -> DataFrame:
    """People whose name, mail, role, department or region has the text, by name; a listing of ``most`` at most."""
    out = profiles.filter("is_active") if active_only else profiles
    if text.strip():
        out = out.filter(reduce(or_, [contains_text(F.col(c), text.strip()) for c in ("full_name", "email", "role", "department", "region")]))
    return out.orderBy(F.lower("full_name"), "id").limit(most)


def visible_conversations(conversations: DataFrame, members: DataFrame, me) -> DataFrame:
    """Conversations that a person is a member of (``members``: conv_id, user_id)."""
    return conversations.join(members.filter(F.col("user_id") == me).select("conv_id"), "conv_id", "left_semi")


def direct_conversations(members: DataFrame) -> DataFrame:
    """(one, two, conv_id): for every pair of people, their first conversation without others.

    Members are counted first, so only conversations of two are joined with themselves.
    """
    pairs = members.select("conv_id", "user_id").distinct().groupBy("conv_id").agg(F.count("*").alias("n"), F.min("user_id").alias("one"), F.max("user_id").alias("two")).filter("n = 2")
    return pairs.groupBy("one", "two").agg(F.min("conv_id").alias("conv_id"))
