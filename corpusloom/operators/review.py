"""Append-only review: human rows win by precedence and nothing is overwritten."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import free_names


def effective(model: DataFrame, human: DataFrame, key: str = "doc_id", order: str = "decision_id") -> DataFrame:
    """Each model row, replaced by the human row of smallest id where there is one; ``decided_by`` tells which."""
    cols = [c for c in model.columns if c != key]
    best = human.groupBy(key).agg(F.min_by(F.struct(*cols), order).alias("h"))
    got = model.join(best, key, "left")
    return got.select(key, *[F.when(F.col("h").isNotNull(), F.col(f"h.{c}")).otherwise(F.col(c)).alias(c) for c in cols], F.when(F.col("h").isNotNull(), "human").otherwise("model").alias("decided_by"))


def disagreements(inputs: DataFrame, approved: DataFrame, fields: list[str], key: str = "doc_id") -> DataFrame:
    """Rows of both sides whose fields differ; null equals null."""
    r = approved.select(key, *[F.col(f).alias(f"approved_{f}") for f in fields])
    same = F.lit(True)
    for f in fields:
        same = same & F.col(f).eqNullSafe(F.col(f"approved_{f}"))
    return inputs.select(key, *fields).join(r, key).where(~same)


def append_new(existing: DataFrame, incoming: DataFrame, key: str) -> DataFrame:
    """Existing rows and those incoming rows whose id is new."""
    return existing.unionByName(incoming.join(existing, key, "left_anti"))


def upsert(kept: DataFrame, fresh: DataFrame, key: str) -> DataFrame:
    """Fresh rows replace kept ones of the same id."""
    return kept.join(fresh, key, "left_anti").unionByName(fresh)


def replace_stages(events: DataFrame, new: DataFrame, stages: list[str]) -> DataFrame:
    return events.where(~F.col("stage").isin(*stages)).unionByName(new)


def resolve(items: DataFrame, item_id: str, resolver: str, decision: str, at: Column) -> DataFrame:
    """The queue with a resolved copy of an open item added; the open row stays."""
    done = items.where((F.col("item_id") == item_id) & (F.col("state") == "open")).limit(1)
    return items.unionByName(done.withColumns({"state": F.lit("resolved"), "resolver": F.lit(resolver), "researcher_decision": F.lit(decision), "resolved_at": at}))


def same_members(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows that only one side has; empty if the sets are equal."""
    return a.exceptAll(b).withColumn("side", F.lit("left")).unionByName(b.exceptAll(a).withColumn("side", F.lit("right")))


def current_cases(cases: DataFrame) -> DataFrame:
    """One row per case: a valid human one, else any that is not human, else whatever there is; the latest of those."""
    human = F.col("extractor_type") == "human"
    pool = F.when(human & (F.col("validation_state") == "valid"), 0).when(~human, 1).otherwise(2)
    w = Window.partitionBy("case_id").orderBy(pool, F.desc("extracted_at"), F.desc("extraction_fingerprint"))
    (place,) = free_names(cases, "_place")
    return cases.withColumn(place, F.row_number().over(w)).where(F.col(place) == 1).drop(place)


def parent_context(items: DataFrame, splits: DataFrame) -> DataFrame:
    """(doc_id, parent_doc_id, outcome) of each reply: resolved, withheld (parent is held out) or missing.

    items: doc_id, source_item_id, parent_thread_id; the parent of smallest doc_id counts.
    """
    parents = items.groupBy(F.col("source_item_id").alias("parent_thread_id")).agg(F.min("doc_id").alias("parent_doc_id"))
    got = items.where("parent_thread_id is not null").join(parents, "parent_thread_id", "left").join(splits.select(F.col("doc_id").alias("parent_doc_id"), "split"), "parent_doc_id", "left")
    outcome = F.when(F.col("parent_doc_id").isNull(), "missing").when(F.col("split") == "holdout", "withheld").otherwise("resolved")
    return got.select("doc_id", F.when(outcome == "resolved", F.col("parent_doc_id")).alias("parent_doc_id"), outcome.alias("outcome"))


def cross_split_families(items: DataFrame, splits: DataFrame) -> DataFrame:
    """(thread, n_splits, n_members) of threads whose parent and replies lie in two splits or more."""
    members = items.select(F.coalesce("parent_thread_id", "source_item_id").alias("thread"), "doc_id").join(splits, "doc_id")
    return members.groupBy("thread").agg(F.count_distinct("split").alias("n_splits"), F.count("*").alias("n_members")).where("n_splits >= 2")


def merge_sheet(fresh: DataFrame, prior: DataFrame, key: str, human: list[str]) -> DataFrame:
    """Generated columns of the fresh sheet, human columns of the prior one; rows that only the prior has stay."""
    f, p = fresh.alias("f"), prior.alias("p")
    got = f.join(p, key, "full_outer")
    cols = [c for c in fresh.columns if c != key]
    return got.select(key, *[(F.coalesce(F.col(f"p.{c}"), F.col(f"f.{c}")) if c in human else F.coalesce(F.col(f"f.{c}"), F.col(f"p.{c}"))).alias(c) for c in cols])


def cross_check(primary: DataFrame, other: DataFrame, key: str, cols: list[str]) -> DataFrame:
    """(column, kind, n): missing rows either way and differing cells."""
    a = primary.select(key, F.lit(1).alias("_a"), *[F.col(c).cast("string").alias(f"a_{c}") for c in cols])
    b = other.select(key, F.lit(1).alias("_b"), *[F.col(c).cast("string").alias(f"b_{c}") for c in cols])
    both = F.col("_a").isNotNull() & F.col("_b").isNotNull()
    marks = [F.when(F.col("_a").isNull(), F.struct(F.lit("*").alias("column"), F.lit("missing_in_primary").alias("kind"))), F.when(F.col("_b").isNull(), F.struct(F.lit("*").alias("column"), F.lit("missing_in_other").alias("kind")))]
    marks += [F.when(both & ~F.col(f"a_{c}").eqNullSafe(F.col(f"b_{c}")), F.struct(F.lit(c).alias("column"), F.lit("different").alias("kind"))) for c in cols]
    return a.join(b, key, "full_outer").select(F.explode(F.array_compact(F.array(*marks))).alias("x")).groupBy("x.column", "x.kind").agg(F.count("*").alias("n"))


def assign_clusters(cases: DataFrame, clusters: DataFrame) -> DataFrame:
    """(case_id, cluster_id): from the ids listed by a cluster, else ``uncertain``. clusters: cluster_id, case_ids."""
    listed = clusters.select("cluster_id", F.explode("case_ids").alias("case_id")).groupBy("case_id").agg(F.min("cluster_id").alias("cluster_id"))
    return cases.select("case_id").join(listed, "case_id", "left").withColumn("cluster_id", F.coalesce("cluster_id", F.lit("uncertain")))
