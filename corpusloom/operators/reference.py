"""Reviewed reference records and stored snapshots: counts by dimension, groups, sources, and envelopes of collected posts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import ids, urls
from ..session import free_names

# What a sheet says where nothing was stated.
UNSTATED = ("", "unknown", "not stated", "none", "n/a")


def stated_items(value: Column) -> Column:
    """Lower-case items of a cell or array, without those that state nothing."""
    return F.filter(F.transform(value, lambda v: F.lower(F.trim(v))), lambda v: v.isNotNull() & ~v.isin(*UNSTATED))


def dimension_records(records: DataFrame, dims: list[str], key: str) -> DataFrame:
    """(field, value, key): a row for each value of a record; a record without any has a row of null value."""
    long = records.select(key, F.explode(F.array(*[F.struct(F.lit(d).alias("field"), F.sort_array(F.array_distinct(F.filter(d, lambda v: v.isNotNull() & (v != "")))).alias("values")) for d in dims])).alias("x"))
    return long.select("x.field", F.explode_outer("x.values").alias("value"), key)


def dimension_counts(records: DataFrame, dims: list[str], key: str) -> DataFrame:
    """(field, value, n): records of each value, and with a null value those that state none."""
    return dimension_records(records, dims, key).groupBy("field", "value").agg(F.count("*").alias("n"))


def quote_presence(records: DataFrame, quote: str, title: str, summary: str) -> DataFrame:
    """One row: records with and without quote and summary, and quotes that equal or stand in the saved title."""
    said = lambda c: F.coalesce(F.trim(F.col(c)) != "", F.lit(False))
    same = said(quote) & F.coalesce(F.col(quote) == F.col(title), F.lit(False))
    inside = said(quote) & F.coalesce(F.contains(F.col(title), F.col(quote)), F.lit(False))
    return records.agg(F.count_if(said(quote)).alias("records_with_quote"), F.count_if(~said(quote)).alias("records_without_quote"), F.count_if(same).alias("quotes_equal_to_saved_title"), F.count_if(inside).alias("quotes_within_saved_title"), F.count_if(said(summary)).alias("records_with_summary"), F.count_if(~said(summary)).alias("records_without_summary"))


def scope_comparison(cards: DataFrame, dims: list[str], canonical: DataFrame) -> DataFrame:
    """(scope_class, field, value, n) over valid cards: counts of each value of each array column, and sources by canonical document.

    cards: doc_id, scope_class, source_platform, automatically_valid; canonical: doc_id, canonical_doc_id. A canonical document
    counts once, for the source of its card of smallest id.
    """
    c = cards.where("automatically_valid")
    long = c.select("scope_class", F.explode(F.array(*[F.struct(F.lit(d).alias("field"), F.col(d).alias("values")) for d in dims])).alias("x"))
    values = long.select("scope_class", "x.field", F.explode("x.values").alias("value")).where("value <> ''").groupBy("scope_class", "field", "value").agg(F.count("*").alias("n"))
    named = c.join(canonical.select("doc_id", "canonical_doc_id"), "doc_id", "left").withColumn("whole", F.coalesce("canonical_doc_id", "doc_id"))
    once = named.groupBy("scope_class", "whole").agg(F.min_by(F.coalesce("source_platform", F.lit("unknown")), "doc_id").alias("value"))
    sources = once.groupBy("scope_class", F.lit("source").alias("field"), "value").agg(F.count("*").alias("n"))
    return values.unionByName(sources)


def provisional_groups(cards: DataFrame) -> DataFrame:
    """(label, n): approved cards by asset and outcome. cards: semantically_approved, asset, outcome."""
    label = F.concat(F.lit("provisional: "), F.coalesce("asset", F.lit("unstated asset")), F.lit(" / "), F.coalesce("outcome", F.lit("unstated outcome")))
    return cards.where("semantically_approved").groupBy(label.alias("label")).agg(F.count("*").alias("n"))


def shown_values(value: Column, observation: Column) -> Column:
    """A stored value with its status, as a card shows it: null where nothing is stored."""
    return F.when(F.coalesce(value, F.lit("")) != "", F.concat(value, F.lit(" ("), F.coalesce(F.nullif(observation, F.lit("")), F.lit("stored")), F.lit(")")))


def envelope_documents(items: DataFrame, platform: str) -> DataFrame:
    """Posts of an envelope with their ids, and ``refused``: why a row can't be taken (null: it can).

    items: source_url, raw_text, source_item_id, text_kind, replies_complete. Only original posts in plain text are taken,
    whose item id is that of their URL.
    """
    key, thread = urls.url_key(F.col("source_url")), F.regexp_extract("source_url", r"/thread/(\d+)", 1)
    kind = ~F.coalesce((F.col("text_kind") == "original_post") & ~F.col("replies_complete"), F.lit(False))
    blank = F.coalesce(F.trim("raw_text"), F.lit("")) == ""
    refused = (
        F.when(F.col("source_url").isNull() | F.col("raw_text").isNull(), "missing_field")
        .when(kind, "not_an_original_post")
        .when(blank | F.col("raw_text").rlike(r"</?[A-Za-z][^>]*>"), "not_plain_text")
        .when(~F.col("source_item_id").cast("string").eqNullSafe(F.nullif(thread, F.lit(""))), "item_id_mismatch")
    )
    return items.select("*", key.alias("source_url_key"), ids.doc_id(F.lit(platform), thread, key, F.sha2("raw_text", 256)).alias("doc_id"), F.sha2("raw_text", 256).alias("raw_text_sha256"), refused.alias("refused"))


def import_new(documents: DataFrame, known: DataFrame) -> DataFrame:
    """``documents`` with ``state``: new, present, or changed (known under its URL key with another text, so it must be reviewed)."""
    (had,) = free_names(documents, "_had")
    k = known.groupBy("source_url_key").agg(F.first("raw_text_sha256").alias(had))
    state = F.when(F.col(had).isNull(), "new").when(F.col(had) == F.col("raw_text_sha256"), "present").otherwise("changed")
    return documents.join(k, "source_url_key", "left").withColumn("state", state).drop(had)


def flat_children(payload: Column) -> Column:
    """Children of a listing, or of all listings of a list of them, as JSON texts; what is no listing has none."""
    schema = "array<struct<data:struct<children:array<string>>>>"
    listed = F.when(F.ltrim(payload).startswith("["), payload).otherwise(F.concat(F.lit("["), payload, F.lit("]")))
    return F.flatten(F.filter(F.transform(F.from_json(listed, schema), lambda x: F.coalesce(x["data"]["children"], F.array().cast("array<string>"))), lambda c: F.size(c) > 0))
