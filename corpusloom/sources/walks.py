"""Recorded pages that name the next one by a token, walked source by source under a budget, and resumed where a walk stopped.

A walk is no loop over pages: jumps of one, two, four ... pages are made by joining the links with themselves, so a budget of n
pages takes about log2(n) joins on (source, token) for all sources together.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import settled

#: The token of a source's first page.
FIRST = ""
POINTS = "source string, at string"


def start_points(pages: DataFrame, points: DataFrame | None = None) -> DataFrame:
    """(source, at) where the next walk begins: where the last one stopped, or at the first page; a source that is through (at is null) has none."""
    sources = pages.select(F.col("source").cast("string").alias("source")).where("source IS NOT NULL").distinct()
    if points is None:
        return sources.withColumn("at", F.lit(FIRST))
    known = points.select(F.col("source").alias("known"), "at")
    return sources.join(known, F.col("source") == F.col("known"), "left").where("known IS NULL OR at IS NOT NULL").select("source", F.when(F.col("known").isNull(), FIRST).otherwise(F.col("at")).alias("at"))


def walk(pages: DataFrame, budget: int, points: DataFrame | None = None) -> DataFrame:
    """The next ``budget`` pages of each source in order: all columns of ``pages`` and ``step`` from 0.

    pages: source, token (null: the first page), next_token (null or blank: the last page). A page that was walked is not
    walked again, so a token that leads back ends the walk; of two recordings of a page any counts. A token that was not
    recorded ends it too, and stays the point to go on from.
    """
    if budget < 1:
        raise ValueError("a budget is at least one page")
    token = F.coalesce(F.col("token").cast("string"), F.lit(FIRST))
    links = settled(pages.where("source IS NOT NULL").select(F.col("source").cast("string").alias("source"), token.alias("at"), F.nullif(F.col("next_token").cast("string"), F.lit("")).alias("to")).groupBy("source", "at").agg(F.min("to").alias("to")))
    jump = links.where("to IS NOT NULL")
    reached = start_points(pages, points).withColumn("step", F.lit(0))
    size = 1
    while True:
        leap = jump.select(F.col("source").alias("s"), F.col("at").alias("a"), "to")
        on = reached.join(leap, (F.col("source") == F.col("s")) & (F.col("at") == F.col("a"))).select("source", F.col("to").alias("at"), (F.col("step") + size).alias("step"))
        reached = settled(reached.unionByName(on).where(F.col("step") < budget).groupBy("source", "at").agg(F.min("step").alias("step")))
        size *= 2
        if size >= budget:
            break
        jump = settled(jump.alias("x").join(leap.alias("y"), (F.col("x.source") == F.col("y.s")) & (F.col("x.to") == F.col("y.a"))).select("x.source", "x.at", "y.to"))
    once = pages.withColumn("step_at", token).dropDuplicates(["source", "step_at"])
    place = reached.select(F.col("source").alias("s"), F.col("at").alias("a"), "step")
    return once.join(place, (F.col("source").cast("string") == F.col("s")) & (F.col("step_at") == F.col("a"))).drop("s", "a", "step_at")


def next_points(walked: DataFrame, points: DataFrame | None = None) -> DataFrame:
    """(source, at): where each source's next walk begins, from what was walked; null once a source is through. Sources without a walk keep their point."""
    got = walked.groupBy(F.col("source").cast("string").alias("source")).agg(F.max_by(F.nullif(F.col("next_token").cast("string"), F.lit("")), "step").alias("at"))
    return got if points is None else got.unionByName(points.join(got.select("source"), "source", "left_anti").select("source", "at"))
