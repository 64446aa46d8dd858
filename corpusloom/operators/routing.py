"""Prefilter: rules that route a text, never on one keyword alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text

# Exclusion phrases by reason, and what shows that someone looks for a photo.
EXCLUSIONS = {
    "storage_backup_or_sync": ("backup failed", "not backing up", "backup not working", "waiting to backup", "not syncing", "sync failed", "sync error", "upload stuck", "storage full", "storage is full", "out of storage", "not enough storage", "buy more storage", "upgrade storage"),
    "deletion_or_corruption": ("accidentally deleted", "permanently deleted", "cannot restore", "can't restore", "photos corrupted", "file is corrupted", "corrupted files"),
    "billing_or_subscription": ("charged my", "payment failed", "cancel my subscription", "subscription charge", "billing problem"),
    "account_access": ("can't sign in", "cannot sign in", "cannot log in", "account locked", "locked out", "password reset"),
}
RETRIEVAL = (
    "can't find", "cannot find", "cant find", "couldn't find", "could not find", "can't locate", "cannot locate", "looking for", "don't remember", "do not remember", "can't remember",
    "cannot remember", "cant remember", "forgot the", "forgotten", "no idea what", "what to search", "what to type", "somewhere in my", "somewhere in", "ask photos", "face grouping",
    "didn't recognize", "did not recognize", "nothing comes up", "no results", "missing photo", "missing photos", "lost photo", "lost the photo", "used to have",
)
PHOTO_WORDS = ("photo", "photos", "picture", "pictures", "video", "videos", "album", "image", "images")
SEARCH_WORDS = ("search", "searching", "searched")


def signals(norm: Column, exclusions=EXCLUSIONS) -> Column:
    """Exclusion phrases in a text, as (phrase, reason)."""
    rules = F.array(*[F.struct(F.lit(p).alias("phrase"), F.lit(r).alias("reason")) for r, ps in exclusions.items() for p in ps])
    return F.filter(rules, lambda s: F.contains(norm, s["phrase"]))


def wants_retrieval(norm: Column, phrases=RETRIEVAL, search=SEARCH_WORDS, photo=PHOTO_WORDS) -> Column:
    padded = F.concat(F.lit(" "), norm, F.lit(" "))
    any_of = lambda col, ws: F.exists(F.array(*map(F.lit, ws)), lambda w: F.contains(col, w))
    return any_of(norm, phrases) | (any_of(padded, [f" {w} " for w in search]) & any_of(padded, [f" {w} " for w in photo]))


def primary_reason(hits: Column) -> Column:
    """The most frequent reason, ties by name."""
    reasons = F.transform(hits, lambda h: h["reason"])
    ranked = F.transform(F.array_distinct(reasons), lambda r: F.struct((-F.size(F.filter(reasons, lambda x: x == r))).alias("n"), r.alias("reason")))
    return F.array_min(ranked)["reason"]


def prefilter(docs: DataFrame, canonical: DataFrame | None = None, exclusions=EXCLUSIONS, retrieval=RETRIEVAL, norm: str = "normalized_text") -> DataFrame:
    """(doc_id, route, passed, candidate_scope_class, n_signals, reason_labels, drop_reason_code, canonical_doc_id)."""
    n = text.collapse(F.lower(F.col(norm)))
    d = docs.select("doc_id", signals(n, exclusions).alias("hits"), wants_retrieval(n, retrieval).alias("retrieval"))
    none = F.lit(None).cast(docs.schema["doc_id"].dataType).alias("canonical_doc_id")
    d = d.select("*", none) if canonical is None else d.join(canonical.select("doc_id", "canonical_doc_id"), "doc_id", "left")
    skipped, many = F.col("canonical_doc_id").isNotNull(), F.size("hits")
    excluded = ~skipped & ~F.col("retrieval") & (many >= 2)
    labels = (
        F.when(skipped, F.array(F.lit("non_canonical_duplicate")))
        .when(F.col("retrieval") & (many > 0), F.array(F.lit("mixed_retrieval_and_exclusion")))
        .when(excluded, F.array_sort(F.array_distinct(F.transform("hits", lambda h: h["reason"]))))
        .when(many == 1, F.array(F.lit("single_signal_retained")))
        .otherwise(F.array(F.lit("retained_for_recall")))
    )
    return d.select(
        "doc_id",
        F.when(skipped, "skipped_non_canonical").when(excluded, "obvious_exclusion_candidate").otherwise("classify").alias("route"),
        (~skipped & ~excluded).alias("passed"),
        F.when(excluded, "out_of_scope").alias("candidate_scope_class"),
        F.when(skipped, 0).otherwise(many).alias("n_signals"),
        labels.alias("reason_labels"),
        F.when(excluded, primary_reason(F.col("hits"))).alias("drop_reason_code"),
        "canonical_doc_id",
    )


def route_counts(routed: DataFrame) -> DataFrame:
    return routed.groupBy("route").agg(F.count("*").alias("n_docs"), F.count_if("passed").alias("n_passed"))


def contradicts(hint: Column, scope: Column) -> Column:
    return hint.isNotNull() & (hint != scope)
