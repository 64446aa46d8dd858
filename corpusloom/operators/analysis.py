"""Funnels, cross-tabs, journeys, shares and counts. Null is never zero; undefined rates stay null."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import free_names

CONCENTRATION, ESTABLISHED_DOCS, ESTABLISHED_SOURCES = 0.40, 5, 2
CONFIRMED = ("auto_confirmed", "human_confirmed", "confirmed")


def funnel(events: DataFrame, order: list[str], failed: tuple[str, ...] = ("failed", "unavailable")) -> DataFrame:
    """(step, stage, n_targets, n_failed) for the stages reached, in the given order. ``events``: stage, target_id, status."""
    steps = events.sparkSession.createDataFrame(list(enumerate(order)), "step int, stage string")
    found = events.groupBy("stage").agg(F.count_distinct("target_id").alias("n_targets"), F.count_if(F.col("status").isin(*failed)).alias("n_failed"))
    return found.join(F.broadcast(steps), "stage").select("step", "stage", "n_targets", "n_failed")


def stage_targets(events: DataFrame) -> DataFrame:
    """(stage, target_id), each once: the id lists of a funnel, as rows."""
    return events.select("stage", "target_id").distinct()


def link_state_counts(links: DataFrame) -> DataFrame:
    return links.agg(F.count_if(F.col("review_state").isin(*CONFIRMED)).alias("confirmed"), F.count_if(F.col("review_state") == "pending_review").alias("pending"))


def stage_status_counts(events: DataFrame, wanted: DataFrame | None = None) -> DataFrame:
    rows = events if wanted is None else events.join(wanted.select("target_id").distinct(), "target_id", "left_semi")
    return rows.groupBy("stage", "status").agg(F.count("*").alias("n_events"))


def shown(observation: Column, values: Column) -> Column:
    """The status, or the values of a stated field joined by a comma."""
    stated = F.nullif(F.array_join(F.filter(values, lambda v: F.trim(v) != ""), ", "), F.lit(""))
    return F.when(observation != "stated", observation).otherwise(F.coalesce(stated, observation))


def labels_of(observation: Column, values: Column) -> Column:
    """Values of a stated field; otherwise its status stands for them, so statuses never merge."""
    return F.when(observation != "stated", F.array(observation)).otherwise(values)


def memory_map(cases: DataFrame) -> DataFrame:
    """(cue, item, n_cases): every cue of a case with every forgotten item, over cases whose technical state is ok."""
    ok = cases.where("technical_state = 'ok'")
    return (
        ok.withColumn("cue", F.explode(labels_of(F.col("cues.observation"), F.col("cues.value"))))
        .withColumn("item", F.explode(labels_of(F.col("forgotten.observation"), F.col("forgotten.value"))))
        .groupBy("cue", "item")
        .agg(F.count("*").alias("n_cases"))
    )


def journeys(cases: DataFrame, columns: list[str]) -> DataFrame:
    """A row per ok case with each block shown as text."""
    return cases.where("technical_state = 'ok'").select("case_id", *[shown(F.col(f"{c}.observation"), F.col(f"{c}.value")).alias(c) for c in columns])


def opportunities(cases: DataFrame, scope: str | None = None, threshold: float = CONCENTRATION) -> DataFrame:
    """One row of components for a scope. ``cases``: case_id, doc_id, parent_thread_id, author_hash, source_platform, evidence_tier,
    scope_class, technical_state, severity. Two levels of aggregation: per source, then over sources."""
    tier, state = F.coalesce(F.nullif("evidence_tier", F.lit("")), F.lit("direct_user")), F.coalesce(F.nullif("technical_state", F.lit("")), F.lit("ok"))
    c = cases.select("*", tier.alias("tier"), state.alias("state"), F.coalesce(F.nullif("source_platform", F.lit("")), F.lit("unknown")).alias("src"))
    direct = c.where("state = 'ok' and tier = 'direct_user'")
    chosen = F.lit(True) if scope is None else F.coalesce(F.col("scope_class") == scope, F.lit(False))
    per = direct.groupBy("src").agg(F.count("*").alias("population"), F.count_if(chosen).alias("n"))
    total = F.sum("n").over(Window.partitionBy())  # a row per source
    shares = per.withColumn("share", F.try_divide("n", total)).agg(
        F.count_if(F.col("n") > 0).alias("source_count"),
        F.coalesce(F.avg(F.col("n") / F.col("population")), F.lit(0.0)).alias("source_balanced_mean"),
        F.array_sort(F.collect_list(F.when(F.col("share") > threshold, F.col("src")))).alias("concentration_disclosure"),
    )
    e = direct.where(chosen)
    thread = F.nullif(F.coalesce(F.nullif("parent_thread_id", F.lit("")), F.col("doc_id"), F.lit("")), F.lit(""))
    counts = e.agg(F.count("*").alias("unique_cases"), F.count_distinct(F.coalesce("doc_id", F.lit(""))).alias("unique_documents"), F.count_distinct(thread).alias("unique_threads"), F.count_distinct(F.nullif("author_hash", F.lit(""))).alias("unique_authors"), F.avg("severity").alias("mean_severity"), F.count("severity").alias("severity_denominator"), F.count_if(F.col("severity").isNull()).alias("severity_nulls"))
    out = c.agg(F.count_if(F.col("state") != "ok").alias("excluded_technical_failures"), F.count_if((F.col("state") == "ok") & ~F.col("tier").isin("direct_user", "synthetic_test")).alias("excluded_non_direct"))
    return counts.join(F.broadcast(shares)).join(F.broadcast(out)).withColumn("scope", F.lit(scope or "all_direct"))  # one row each


def shares(df: DataFrame, by: str) -> DataFrame:
    """(by, n, share) with the share over all rows."""
    return df.groupBy(by).agg(F.count("*").alias("n")).withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy()))


def balanced_mean(df: DataFrame, group: str, hit: Column) -> DataFrame:
    """Unweighted mean over groups of the share of rows that hit."""
    return df.groupBy(group).agg(F.avg(hit.cast("int")).alias("share")).agg(F.count("*").alias("n_groups"), F.avg("share").alias("balanced_mean"))


def groupings(cases: DataFrame, fields: list[str], key: str = "case_id") -> DataFrame:
    """(signature, size, key): cases with the same labels, a row for each case; no group's ids stand in one row."""
    signed = cases.select(F.concat_ws("|", *[F.coalesce(F.col(f), F.lit("")) for f in fields]).alias("signature"), key)
    return signed.join(signed.groupBy("signature").agg(F.count("*").alias("size")), "signature").select("signature", "size", key)


def established(df: DataFrame, by: str, doc: str, source: str) -> DataFrame:
    """Groups with enough distinct documents and sources."""
    got = df.groupBy(by).agg(F.count_distinct(doc).alias("n_docs"), F.count_distinct(source).alias("n_sources"))
    return got.withColumn("established", (F.col("n_docs") >= ESTABLISHED_DOCS) & (F.col("n_sources") >= ESTABLISHED_SOURCES))


def comparison(cards: DataFrame, dims: list[str], by: str = "scope", key: str = "pos") -> DataFrame:
    """(by, field, value, n, first): counts of each value of each array column; ``first`` breaks ties as first seen."""
    long = cards.select(by, key, F.explode(F.array(*[F.struct(F.lit(d).alias("field"), F.col(d).alias("values")) for d in dims])).alias("x")).select(by, key, "x.field", F.explode(F.array_distinct("x.values")).alias("value"))
    return long.groupBy(by, "field", "value").agg(F.count("*").alias("n"), F.min(key).alias("first"))


def counters(df: DataFrame, cols: list[str]) -> DataFrame:
    """Independent counts of several columns in one pass."""
    sets = [[c] for c in cols]
    got = df.groupingSets([[F.col(c) for c in s] for s in sets], *[F.col(c) for c in cols]).agg(F.count("*").alias("n"), F.grouping_id().alias("g"))
    name, value = F.lit(None).cast("string"), F.lit(None).cast("string")
    for i, c in enumerate(cols):
        mine = F.col("g") == (2 ** len(cols) - 1) ^ (1 << (len(cols) - 1 - i))
        name, value = F.when(mine, c).otherwise(name), F.when(mine, F.col(c).cast("string")).otherwise(value)
    return got.select(name.alias("counter"), value.alias("value"), "n")


def source_audit(df: DataFrame, by: str, threshold: float = CONCENTRATION) -> DataFrame:
    return shares(df, by).withColumn("over_threshold", F.col("share") > threshold)


def ordered_counts(df: DataFrame, by: str, order: list[str]) -> DataFrame:
    """Counts in a given order of values, zero where there is none."""
    dim = df.sparkSession.createDataFrame(list(enumerate(order)), f"pos int, `{by}` string")
    return dim.join(df.groupBy(by).agg(F.count("*").alias("n")), by, "left").select("pos", by, F.coalesce("n", F.lit(0)).alias("n"))


def crosstab(df: DataFrame, row: str, col: str, values: list[str]) -> DataFrame:
    return df.groupBy(row).pivot(col, values).agg(F.count(F.lit(1))).na.fill(0)


def top_items(df: DataFrame, col: Column, n: int) -> DataFrame:
    """The most frequent items of list texts, without blank and unknown ones; ties by item."""
    from ..functions.text import split_list

    items = df.select(F.explode(split_list(F.lower(col))).alias("item")).where("item <> 'unknown'")
    return items.groupBy("item").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "item").limit(n)


def kpis(df: DataFrame, cat: str, flag: Column) -> DataFrame:
    """Rows, most frequent category (ties by name) and share of flagged rows."""
    mode = df.groupBy(cat).agg(F.count("*").alias("n")).orderBy(F.desc("n"), cat).limit(1).select(F.col(cat).alias("top_category"))
    return df.agg(F.count("*").alias("n"), F.avg(flag.cast("int")).alias("share")).join(F.broadcast(mode))


def options(df: DataFrame, col: str) -> DataFrame:
    return df.select(col).where(F.col(col).isNotNull()).distinct().orderBy(col)


def first_per_key(df: DataFrame, keys: list[str], order: list, last: bool = False) -> DataFrame:
    """The first (or last) row of each key in a total order."""
    cols = [F.col(o) if isinstance(o, str) else o for o in order]
    w = Window.partitionBy(*keys).orderBy(*([c.desc() for c in cols] if last else cols))
    (place,) = free_names(df, "_place")
    return df.withColumn(place, F.row_number().over(w)).where(F.col(place) == 1).drop(place)


def repeated(df: DataFrame, by: str, key: str) -> DataFrame:
    """(by, n, key): a row for each row whose value has two or more; null values repeat nothing."""
    return df.select(by, key).join(df.groupBy(by).agg(F.count("*").alias("n")).where("n >= 2"), by).select(by, "n", key)
