"""Selection, gates and assembly of batches, datasets and reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import excerpt
from ..session import free_names


def provenance_reasons(doc_id: Column, expected_id: Column, raw_hash: Column, expected_hash: Column, url_key: Column, expected_key: Column, tier: Column, allow_synthetic: bool = False) -> Column:
    """What does not fit when ids, hashes and keys are computed again."""
    marks = [F.when(~doc_id.eqNullSafe(expected_id), "doc_id_mismatch"), F.when(~raw_hash.eqNullSafe(expected_hash), "hash_mismatch"), F.when(~url_key.eqNullSafe(expected_key), "url_key_mismatch")]
    if not allow_synthetic:
        marks.append(F.when(tier == "synthetic_test", "synthetic"))
    return F.array_compact(F.array(*marks))


def select_batch(docs: DataFrame, frozen: DataFrame, limit: int, key: str = "doc_id") -> DataFrame:
    """Sound rows (no ``reasons``) that are not frozen, the first ``limit`` by key."""
    return docs.where(F.size("reasons") == 0).join(frozen.select(key).distinct(), key, "left_anti").orderBy(key).limit(limit)


def batch_counts(docs: DataFrame, frozen: DataFrame, limit: int, key: str = "doc_id") -> DataFrame:
    """One row: total, failed provenance, frozen, eligible, taken and held back."""
    f = frozen.select(key).distinct().withColumn("is_frozen", F.lit(True))
    d = docs.join(f, key, "left").withColumn("is_frozen", F.coalesce("is_frozen", F.lit(False)))
    bad = F.size("reasons") > 0
    got = d.agg(F.count("*").alias("total"), F.count_if(bad).alias("failed"), F.count_if(~bad & F.col("is_frozen")).alias("frozen"), F.count_if(~bad & ~F.col("is_frozen")).alias("eligible"))
    return got.withColumn("taken", F.least("eligible", F.lit(limit))).withColumn("held_back", F.col("eligible") - F.col("taken"))


def split_policy(docs: DataFrame, development: DataFrame, holdout: DataFrame, key: str = "doc_id") -> tuple[DataFrame, DataFrame]:
    """(rows that may be used: in development and not held out, one row of counts)."""
    d, h = development.select(key).distinct().withColumn("dev", F.lit(True)), holdout.select(key).distinct().withColumn("held", F.lit(True))
    m = docs.join(d, key, "left").join(h, key, "left").withColumns({"dev": F.coalesce("dev", F.lit(False)), "held": F.coalesce("held", F.lit(False))})
    counts = m.agg(F.count_if("held").alias("withheld"), F.count_if(F.col("held") & F.col("dev")).alias("overlap"), F.count_if(F.col("dev") & ~F.col("held")).alias("used"), F.count_if(~F.col("dev") & ~F.col("held")).alias("unassigned"))
    return m.where("dev and not held").drop("dev", "held"), counts


def first_wins(cards: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Of a case that several datasets hold, the first in their order."""
    w = Window.partitionBy(key).orderBy(*order)
    (place,) = free_names(cards, "_place")
    return cards.withColumn(place, F.row_number().over(w)).where(F.col(place) == 1).drop(place)


def verdict_counts(cards: DataFrame, by: str, verdicts: list[str]) -> DataFrame:
    return cards.groupBy(by).agg(F.count("*").alias("n"), *[F.count_if(F.col("verdict") == v).alias(v) for v in verdicts])


def excluded_count(docs: DataFrame, labels: DataFrame, decisions: DataFrame) -> DataFrame:
    """One row: documents out of scope by label or, without one, by decision; and those with neither."""
    m = docs.select("doc_id").join(labels.select("doc_id", F.col("scope").alias("human")), "doc_id", "left").join(decisions.select("doc_id", F.col("scope").alias("model")), "doc_id", "left")
    scope = F.coalesce("human", "model")
    return m.agg(F.count_if(scope == "out_of_scope").alias("excluded"), F.count_if(scope.isNull()).alias("undecided"))


def summary(docs: DataFrame, links: DataFrame, cases: DataFrame) -> DataFrame:
    """One row: documents, canonical documents, confirmed and pending links, cases by state. links: doc_id, canonical_doc_id, review_state."""
    sure = links.where(F.col("review_state").isin("auto_confirmed", "human_confirmed")).groupBy("doc_id").agg(F.min("canonical_doc_id").alias("canonical_doc_id"))
    d = docs.select("doc_id").join(sure, "doc_id", "left").agg(F.count("*").alias("n_documents"), F.count_distinct(F.coalesce("canonical_doc_id", "doc_id")).alias("n_canonical"))
    n = links.agg(F.count_if(F.col("review_state") != "pending_review").alias("n_confirmed"), F.count_if(F.col("review_state") == "pending_review").alias("n_pending"))
    c = cases.agg(F.count("*").alias("n_cases"), F.count_if(F.col("validation_state") == "valid").alias("n_valid"), F.count_distinct("doc_id").alias("n_case_documents"))
    return d.join(F.broadcast(n)).join(F.broadcast(c))  # one row each


def key_index(records: DataFrame, record: str, keys: list[str]) -> DataFrame:
    """(key, record): each record under each of its keys; the smallest record of a key counts."""
    return records.select(F.explode(F.array_compact(F.array(*keys))).alias("key"), F.col(record).alias("record")).groupBy("key").agg(F.min("record").alias("record"))


def overlaps(cards: DataFrame, card: str, keys: list[str], index: DataFrame) -> DataFrame:
    """(card, record) of cards that share any key with a record; the smallest record counts."""
    long = cards.select(F.col(card).alias("card"), F.explode(F.array_compact(F.array(*keys))).alias("key"))
    return long.join(index, "key").groupBy("card").agg(F.min("record").alias("record"))


def with_external_spans(cases: DataFrame, spans: DataFrame) -> DataFrame:
    """Cases with their own spans and the stored ones of the same owner, each id once, own ones first. Both hold arrays or rows of evidence_id."""
    own = cases.select("case_id", F.posexplode_outer("evidence_ids").alias("pos", "evidence_id")).where("evidence_id is not null").withColumn("rank", F.lit(0))
    more = spans.select(F.col("owner_id").alias("case_id"), F.lit(0).alias("pos"), "evidence_id", F.lit(1).alias("rank"))
    once = own.unionByName(more.join(cases.select("case_id"), "case_id", "left_semi")).groupBy("case_id", "evidence_id").agg(F.min(F.struct("rank", "pos")).alias("at"))
    lists = once.groupBy("case_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("at", "evidence_id"))), lambda x: x["evidence_id"]).alias("evidence_ids"))
    return cases.drop("evidence_ids").join(lists, "case_id", "left").withColumn("evidence_ids", F.coalesce("evidence_ids", F.array().cast("array<string>")))


def review_targets(reviews: DataFrame, docs: DataFrame, aliases: DataFrame | None = None) -> DataFrame:
    """(item_id, doc_id): the document that a review's target names, by any of its parts, or else by an alias (alias, doc_id) of the whole target."""
    parts = reviews.select("item_id", F.explode(F.split("target_id", r"[:#\s]")).alias("doc_id"))
    direct = parts.join(docs.select("doc_id"), "doc_id", "left_semi").groupBy("item_id").agg(F.min("doc_id").alias("doc_id"))
    if aliases is None:
        return direct
    known = aliases.join(docs.select("doc_id"), "doc_id", "left_semi").select(F.col("alias").alias("target_id"), "doc_id")
    named = reviews.join(direct, "item_id", "left_anti").join(known, "target_id").groupBy("item_id").agg(F.min("doc_id").alias("doc_id"))
    return direct.unionByName(named)


def failure_rows(outcomes: DataFrame) -> DataFrame:
    """(target_type, target_id, reason): documents that failed or were blocked, and cases that need review."""
    d = outcomes.where(F.col("state").isin("failed", "blocked")).select(F.lit("document").alias("target_type"), F.col("doc_id").alias("target_id"), F.col("reason").alias("reason"))
    c = outcomes.select(F.explode("cases").alias("c")).where("c.needs_human_review").select(F.lit("case").alias("target_type"), F.col("c.case_id").alias("target_id"), F.lit("needs_human_review").alias("reason"))
    return d.unionByName(c)


def upsert_candidates(existing: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Candidates without those that these outcomes touched, and with those that need review now."""
    now = outcomes.select(F.explode("cases").alias("c")).select("c.case_id", "c.needs_human_review")
    return existing.join(now, "case_id", "left_anti").select("case_id").unionByName(now.where("needs_human_review").select("case_id"))


def required(df: DataFrame, wanted: DataFrame, key: str) -> DataFrame:
    """Rows of ``wanted``; reading fails if one of them is missing in ``df``."""
    (here,) = free_names(df, "_here")
    m = wanted.select(key).distinct().join(df.withColumn(here, F.lit(True)), key, "left")
    return m.where(F.assert_true(F.coalesce(here, F.lit(False)), F.concat(F.lit("missing "), F.col(key).cast("string"))).isNull()).drop(here)


def three_way_scores(df: DataFrame, gold: str, pred: str, classes: list[str], relevant: list[str]) -> DataFrame:
    """One row of counts and rates over classes and the binary view; no prediction is an abstention. Empty rates are 0, to 6 places."""
    g, p = F.col(gold), F.col(pred)
    agg = [F.count("*").alias("n"), F.count_if(p.isNull()).alias("abstained"), F.count_if(g.eqNullSafe(p)).alias("correct")]
    for c in classes:
        agg += [F.count_if((g == c) & (p == c)).alias(f"tp_{c}"), F.count_if(p == c).alias(f"pred_{c}"), F.count_if(g == c).alias(f"gold_{c}")]
    gr, pr = g.isin(*relevant), F.coalesce(p.isin(*relevant), F.lit(False))
    agg += [F.count_if(gr & pr).alias("tp"), F.count_if(~gr & pr).alias("fp"), F.count_if(gr & ~pr).alias("fn")]
    d = df.agg(*agg)
    rate = lambda a, b: F.round(F.coalesce(F.try_divide(a, b), F.lit(0.0)), 6)
    col = F.col
    per = {c: (rate(col(f"tp_{c}"), col(f"pred_{c}")), rate(col(f"tp_{c}"), col(f"gold_{c}"))) for c in classes}
    macro = lambda k: F.round(sum((per[c][k] for c in classes), F.lit(0.0)) / len(classes), 6)
    return d.select("n", "abstained", rate(col("correct"), col("n")).alias("accuracy"), *[x.alias(f"{m}_{c}") for c in classes for x, m in zip(per[c], ("precision", "recall"))], macro(0).alias("macro_precision"), macro(1).alias("macro_recall"), rate(col("tp"), col("tp") + col("fp")).alias("binary_precision"), rate(col("tp"), col("tp") + col("fn")).alias("binary_recall"))


def error_rows(df: DataFrame, gold: str, pred: str, split: str = "dev") -> DataFrame:
    """Mismatches of one split, for reading; other splits stay unseen."""
    return df.where((F.col("split") == split) & ~F.col(gold).eqNullSafe(F.col(pred)))


def import_warnings(docs: DataFrame, expected: int) -> DataFrame:
    """(warning, value, n): aliases used, repeated URLs, and a count that is not the stated one."""
    alias = docs.where("alias is not null").groupBy(F.lit("alias_used").alias("warning"), F.col("alias").alias("value")).agg(F.count("*").alias("n"))
    urls = docs.groupBy(F.lit("repeated_url").alias("warning"), F.col("url").alias("value")).agg(F.count("*").alias("n")).where("n > 1 and value is not null")
    kept = docs.agg(F.count("*").alias("n")).where(F.col("n") != expected).select(F.lit("kept_count").alias("warning"), F.lit(str(expected)).alias("value"), "n")
    return alias.unionByName(urls).unionByName(kept)


def fold_outcomes(batches: DataFrame) -> DataFrame:
    """(lot, id, succeeded, failed): the ids of several sub-batches, a row each, with the sums of their counters."""
    sums = batches.agg(F.sum("succeeded").alias("succeeded"), F.sum("failed").alias("failed"))
    return batches.select("lot", F.explode("ids").alias("id")).join(F.broadcast(sums))  # one row


def pair_sheet(pairs: DataFrame, docs: DataFrame, size: int = 160) -> DataFrame:
    """A review sheet of pairs (a, b) with an excerpt of each side and empty columns for a person's decision. docs: doc_id, text."""
    x = docs.select("doc_id", excerpt(F.coalesce("text", F.lit("")), size).alias("excerpt"))
    left, right = (x.select(F.col("doc_id").alias(k), F.col("excerpt").alias(f"{k}_excerpt")) for k in ("a", "b"))
    return pairs.join(left, "a").join(right, "b").withColumns({"decision": F.lit(""), "note": F.lit("")})


def label_sheet(routed: DataFrame, docs: DataFrame, size: int = 160) -> DataFrame:
    """A row of the label sheet for each routed document: excerpt, route, its reasons joined by a bar, and an empty label."""
    x = docs.select("doc_id", excerpt(F.coalesce("text", F.lit("")), size).alias("excerpt"))
    return routed.join(x, "doc_id").select("doc_id", "excerpt", "route", F.array_join("reason_labels", "|").alias("reasons"), F.lit("").alias("label"))


def with_pending(valid: DataFrame, pending: DataFrame, spans: DataFrame) -> DataFrame:
    """Valid cases and pending candidates with their evidence ids, sorted; of a case that is both, the valid row. valid, pending: case_id, doc_id; spans: owner_id, evidence_id."""
    both = valid.select("case_id", "doc_id", F.lit("valid").alias("state")).unionByName(pending.join(valid, "case_id", "left_anti").select("case_id", "doc_id", F.lit("pending").alias("state")))
    ids = spans.groupBy(F.col("owner_id").alias("case_id")).agg(F.sort_array(F.collect_set("evidence_id")).alias("evidence_ids"))
    return both.join(ids, "case_id", "left").withColumn("evidence_ids", F.coalesce("evidence_ids", F.array().cast("array<string>")))


def evidence_union(cases: DataFrame, decisions: DataFrame) -> DataFrame:
    """(evidence_id, doc_id, owner_type): spans of cases and decisions, each id once, a case's first. Both: evidence_id, doc_id."""
    rows = cases.select("evidence_id", "doc_id", F.lit("case").alias("owner_type")).unionByName(decisions.select("evidence_id", "doc_id", F.lit("decision").alias("owner_type")))
    return rows.groupBy("evidence_id").agg(F.min(F.struct("owner_type", "doc_id")).alias("x")).select("evidence_id", "x.doc_id", "x.owner_type")


def attach_relevance(rows: DataFrame, decisions: DataFrame) -> DataFrame:
    """Reviews or attempts with their document's scope; null where no decision of state ok stands. decisions: doc_id, scope_class, technical_state, unique by document."""
    ok = decisions.where("technical_state = 'ok'").select("doc_id", "scope_class")
    return rows.join(ok, "doc_id", "left").withColumn("is_relevant", F.col("scope_class").isin("core", "adjacent"))


def run_totals(outcomes: DataFrame) -> DataFrame:
    """One row: attempts, calls, cache hits and misses, valid cases and failed candidates of a run. outcomes: state, blocked, from_cache, n_valid."""
    tried = ~F.col("blocked")
    return outcomes.agg(F.count("*").alias("candidates"), F.count_if("blocked").alias("blocked"), F.count_if(tried).alias("attempted"), F.count_if(tried & F.col("from_cache")).alias("cache_hits"), F.count_if(tried & ~F.col("from_cache")).alias("cache_misses"), F.coalesce(F.sum(F.when(tried, F.col("n_valid"))), F.lit(0)).alias("valid_cases"), F.count_if(tried & (F.col("state") != "ok")).alias("failed_candidates"))


def complete_or_raise(rows: DataFrame, required: list[str], key: str) -> DataFrame:
    """``rows`` for a gold file; reading fails at a row that lacks one of the required values."""
    missing = F.array_compact(F.array(*[F.when(F.col(c).isNull() | (F.col(c).cast("string") == ""), F.lit(c)) for c in required]))
    return rows.where(F.assert_true(F.size(missing) == 0, F.concat(F.col(key).cast("string"), F.lit(" lacks "), F.array_join(missing, ", "))).isNull())
