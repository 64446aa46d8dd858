"""Tables of what an extraction run made of each document, and rows that a person's decision makes of the model's."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import ids
from ..session import free_names
from .evidence import ladder


def span_rows(outcomes: DataFrame) -> DataFrame:
    """Every evidence span of every result, a row each. outcomes: doc_id, results (array of case_id, spans)."""
    return outcomes.select("doc_id", F.explode("results").alias("r")).select("doc_id", "r.case_id", F.inline("r.spans"))


def verdict_rows(outcomes: DataFrame) -> DataFrame:
    """What each span claimed and where it came to stand: the ladder over every span, with the offsets as received beside the final ones.

    outcomes: doc_id, raw_text, results (array of case_id, spans: field_name, quote, start, stop).
    """
    long = outcomes.select("doc_id", "raw_text", F.explode("results").alias("r")).select("doc_id", "raw_text", "r.case_id", F.inline("r.spans"))
    got = ladder(long.withColumn("redaction_spans", F.expr("cast(array() as array<struct<start:int,stop:int>>)")))
    repaired = F.col("rung").isin("unique", "nearest", "whitespace")
    return got.select("doc_id", "case_id", "field_name", (F.col("validation_state") == "valid").alias("ok"), "offset_state", "validation_state", "quote", F.col("final_start").alias("start_char"), F.col("final_stop").alias("end_char"), F.col("start").alias("candidate_start_char"), F.col("stop").alias("candidate_end_char"), repaired.alias("repair_applied"))


RELEVANT = ("core", "adjacent")


def skip_cause(scope: Column, technical_state: Column, validation_state: Column) -> Column:
    """Why a blocked document was skipped: a sound decision that it is out of scope, or a decision that does not stand."""
    sound = (technical_state == "ok") & (validation_state == "valid") & F.coalesce(~scope.isin(*RELEVANT), F.lit(True))
    return F.when(sound, "out_of_scope").otherwise("relevance_not_accepted")


def input_rows(outcomes: DataFrame) -> DataFrame:
    """A row per document: its decision, eligibility and state, and the cause where it was blocked.

    outcomes: doc_id, decision_id, decided_by, scope_class, technical_state, validation_state, eligible, blocked, state.
    """
    cause = F.when(F.col("blocked"), skip_cause(F.col("scope_class"), F.col("technical_state"), F.col("validation_state")))
    return outcomes.select("doc_id", "decision_id", "decided_by", "scope_class", "eligible", F.col("state").alias("technical_state"), cause.alias("skip_cause"))


def resolved_inputs(docs: DataFrame, decisions: DataFrame, human: DataFrame) -> DataFrame:
    """Documents with the decision that counts, and whether they may be extracted.

    decisions: doc_id, decision_id, scope_class, technical_state, validation_state; human has the same columns, and of a
    document's human rows the valid one of smallest id counts, else the model's. A document without a model decision has no
    row. Eligible: the decision that counts is valid, of state ok and relevant.
    """
    sound = F.coalesce((F.col("technical_state") == "ok") & (F.col("validation_state") == "valid"), F.lit(False))
    what = F.struct("decision_id", "scope_class", sound.alias("sound"))
    best = human.where(sound).groupBy("doc_id").agg(F.min_by(what, "decision_id").alias("h"))
    got = docs.select("doc_id").join(decisions.select("doc_id", what.alias("m")), "doc_id").join(best, "doc_id", "left")
    pick = F.coalesce("h", "m")
    eligible = pick["sound"] & F.coalesce(pick["scope_class"].isin(*RELEVANT), F.lit(False))
    return got.select("doc_id", pick["decision_id"].alias("decision_id"), pick["scope_class"].alias("scope_class"), F.when(F.col("h").isNotNull(), "human").otherwise("model").alias("decided_by"), eligible.alias("eligible"))


def human_decisions(overrides: DataFrame, texts: DataFrame) -> DataFrame:
    """A decision row for each override, its quote sought in the document's text.

    overrides: override_id, doc_id, scope_class, reason_code, rationale, quote, supports_decision; texts: doc_id, text,
    content_hash. A quote that stands nowhere, at several places, or does not support the decision leaves it pending.
    An override of an unknown document has no row.
    """
    c = F.col
    d = overrides.join(texts, "doc_id").withColumns({"start": F.lit(None).cast("int"), "stop": F.lit(None).cast("int"), "redaction_spans": F.expr("cast(array() as array<struct<start:int,stop:int>>)")})
    got = ladder(d, "text")
    accepted = (c("validation_state") == "valid") & c("supports_decision")
    return got.select(
        ids.short_id(F.lit("human-relevance-decision"), c("override_id")).alias("decision_id"),
        "doc_id",
        "scope_class",
        "reason_code",
        F.col("rationale").alias("reason_summary"),
        F.lit("human").alias("decided_by"),
        ids.fingerprint(F.lit("human-relevance"), c("doc_id"), c("scope_class"), c("reason_code"), c("content_hash"), c("quote")).alias("decision_fingerprint"),
        c("final_start").alias("start_char"),
        c("final_stop").alias("end_char"),
        F.when(accepted, "valid").otherwise("pending").alias("validation_state"),
        (~accepted).alias("needs_human_review"),
    )


def human_cases(model: DataFrame, overrides: DataFrame, texts: DataFrame, schema_version: str) -> DataFrame:
    """A human copy of each model case that an override addresses; the model's row stays as it is.

    model: case_id, doc_id, prompt_version; overrides: target_id, doc_id, evidence_quote; texts: doc_id, text, content_hash.
    A quote must stand once in the text; without one the case is accepted. An override of another document addresses nothing.
    """
    c = F.col
    d = model.join(overrides.withColumnRenamed("target_id", "case_id"), ["case_id", "doc_id"]).join(texts, "doc_id")
    n = F.size(F.split(c("text"), F.concat(F.lit(r"\Q"), F.replace(c("evidence_quote"), F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E")), -1)) - 1
    accepted = c("evidence_quote").isNull() | ((c("evidence_quote") != "") & (n == 1))
    print_ = ids.fingerprint(F.lit("human"), c("prompt_version"), F.lit(schema_version), c("content_hash"))
    return d.select("case_id", "doc_id", F.lit("human").alias("extractor_type"), print_.alias("extraction_fingerprint"), F.coalesce(~accepted, F.lit(True)).alias("needs_human_review"), F.when(accepted, "valid").otherwise("pending").alias("validation_state"))


def spans_per_case(spans: DataFrame, cases: DataFrame, states: tuple = ("valid",)) -> DataFrame:
    """(case_id, n_spans, fields): spans of the cases given, in the states given. spans: owner_id, field_name, validation_state."""
    kept = spans.where(F.col("validation_state").isin(*states)).join(cases.select(F.col("case_id").alias("owner_id")), "owner_id", "left_semi")
    return kept.groupBy(F.col("owner_id").alias("case_id")).agg(F.count("*").alias("n_spans"), F.sort_array(F.collect_set("field_name")).alias("fields"))


def strict_join(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Inner join of rows that must pair one to one; a key without its pair, or twice on a side, ends the job."""
    a = left.groupBy(key).agg(F.count("*").alias("_l"))
    b = right.groupBy(key).agg(F.count("*").alias("_r"))
    odd = a.join(b, key, "full").where("_l is null or _r is null or _l > 1 or _r > 1").select(F.col(key).cast("string")).first()
    if odd:
        raise ValueError(f"{key} {odd[0]} does not pair one to one")
    return left.join(right, key)


def merged_quotes(first: Column, second: Column) -> Column:
    """Quotes of two lists in order, each once, without blank ones; a null list is empty."""
    none = F.array().cast("array<string>")
    return F.array_distinct(F.filter(F.concat(F.coalesce(first, none), F.coalesce(second, none)), lambda q: F.coalesce(F.trim(q) != "", F.lit(False))))


def union_first(*sources: DataFrame, key: str, order: str) -> DataFrame:
    """Rows of several sources; of a key that several hold, the one of the first source, and in it the first by ``order``."""
    marked, (place,) = None, free_names(sources[0], "_source")
    for i, s in enumerate(sources):
        part = s.withColumn(place, F.lit(i))
        marked = part if marked is None else marked.unionByName(part)
    cols = sources[0].columns
    return marked.groupBy(key).agg(F.min_by(F.struct(*cols), F.struct(place, order)).alias("x")).select("x.*")


def ledger_after(ledger: DataFrame, release: DataFrame) -> DataFrame:
    """Reservations after a run: those it released free their amount, those it names with a cost are spent. release: reservation_id, spent (null: unused)."""
    (named,) = free_names(ledger, "_named")
    got = ledger.join(release.withColumn(named, F.lit(True)), "reservation_id", "left")
    open_ = (F.col("state") == "reserved") & F.coalesce(named, F.lit(False))
    state = F.when(open_ & F.col("spent").isNull(), "released").when(open_, "spent").otherwise(F.col("state"))
    return got.withColumn("amount", F.when(open_ & F.col("spent").isNotNull(), F.least("spent", "amount")).otherwise(F.col("amount"))).withColumn("state", state).select(*ledger.columns)


def stored_totals(collected: DataFrame) -> DataFrame:
    """(thread_id, n_known, complete_total): items known of each thread, and the largest reply total of its complete collections. collected: thread_id, item_id, reply_total, complete."""
    return collected.groupBy("thread_id").agg(F.count_distinct("item_id").alias("n_known"), F.max(F.when(F.col("complete"), F.col("reply_total"))).alias("complete_total"))
