"""Evaluation of a saved run: coverage proved while reading, one report, one ledger of all failures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import free_names

#: Classes that count as relevant, and what a failure is called. Fixed values, in order.
RELEVANT = ("core", "adjacent")
CATEGORIES = (
    "prefilter_false_drop", "relevance_false_positive", "relevance_false_negative", "scope_boundary_disagreement", "provider_schema_rejection",
    "evidence_span_rejection", "unmatched_gold_case", "unmatched_model_case", "accepted_empty_extraction", "other_extraction_failure",
)


def covered(wanted: DataFrame, saved: DataFrame, key: str) -> DataFrame:
    """``wanted`` joined to ``saved``; reading fails at a key that only one side has, or that a side has twice.

    Both anti-joins are one full outer join, so the proof costs no job of its own and can't be left out. Null keys fail.
    """
    here, there, times, others = free_names(wanted.join(saved.drop(key).limit(0)), "_here", "_there", "_times", "_others")
    left = wanted.withColumn(here, F.lit(True))
    right = saved.withColumn(there, F.lit(True))
    # Repeats are looked for on each side by an aggregation on the key that the join shuffles by anyway.
    twice = lambda df, n: df.join(df.groupBy(key).agg(F.count("*").alias(n)), key, "left")
    met = twice(left, times).join(twice(right, others), key, "full_outer")
    shown = F.coalesce(F.col(key).cast("string"), F.lit("null"))
    wrong = (
        F.when(F.col(key).isNull(), "a null id")
        .when(F.col(there).isNull(), F.concat(F.lit("missing in the saved run: "), shown))
        .when(F.col(here).isNull(), F.concat(F.lit("surplus in the saved run: "), shown))
        .when((F.col(times) > 1) | (F.col(others) > 1), F.concat(F.lit("twice: "), shown))
    )
    return met.where(F.assert_true(wrong.isNull(), wrong).isNull()).drop(here, there, times, others)


def judged(gold: DataFrame, predictions: DataFrame) -> DataFrame:
    """Gold documents with what a run said of them; those without an ok prediction stay, with ``excluded``.

    gold: doc_id, scope_class, should_pass; predictions: doc_id, technical_state, passed, scope_class. A document that the
    prefilter dropped counts as predicted not relevant.
    """
    p = predictions.select("doc_id", F.col("technical_state").alias("state"), F.coalesce("passed", F.lit(False)).alias("passed"), F.col("scope_class").alias("found"))
    m = gold.join(p, "doc_id", "left")
    is_ = F.coalesce(F.col("scope_class").isin(*RELEVANT), F.lit(False))
    said = F.coalesce(F.col("passed") & F.col("found").isin(*RELEVANT), F.lit(False))
    return m.select("doc_id", "scope_class", "found", "should_pass", F.coalesce("passed", F.lit(False)).alias("passed"), is_.alias("is_relevant"), said.alias("said_relevant"), (~F.coalesce(F.col("state") == "ok", F.lit(False))).alias("excluded"), F.col("state").isNotNull().alias("predicted"))


def _tagged(key: Column, conditions: dict[str, Column]) -> list[Column]:
    kinds = F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(False)), k) for k, c in conditions.items()]))
    return [F.explode(kinds).alias("category"), key.cast("string").alias("target")]


def failures(gold: DataFrame, predictions: DataFrame, events: DataFrame, gold_cases: DataFrame, cases: DataFrame, matches: DataFrame) -> DataFrame:
    """(category, target): the failures of a run in ten categories, each relation read once.

    events: target_id, stage, status, reason_code, case_count, skip_cause, error_code, output_state; gold_cases: gold_id;
    cases: case_id; matches: gold_id, case_id. A boundary shows both classes beside the id.
    """
    m = judged(gold, predictions).where(~F.col("excluded"))
    boundary = F.col("is_relevant") & F.col("said_relevant") & (F.col("scope_class") != F.col("found"))
    shown = F.when(boundary, F.format_string("%s: gold %s, predicted %s", F.col("doc_id").cast("string"), "scope_class", "found")).otherwise(F.col("doc_id").cast("string"))
    of_documents = m.select(*_tagged(F.col("doc_id"), {CATEGORIES[0]: F.col("should_pass") & ~F.col("passed"), CATEGORIES[1]: F.col("said_relevant") & ~F.col("is_relevant"), CATEGORIES[2]: F.col("is_relevant") & ~F.col("said_relevant")}))
    of_boundaries = m.where(boundary).select(F.lit(CATEGORIES[3]).alias("category"), shown.alias("target"))

    e = events.where("(stage IS NULL OR stage = 'extract') AND NOT coalesce(status = 'skipped', false) AND NOT coalesce(skip_cause = 'out_of_scope', false)")
    failed = F.coalesce(F.col("status") == "failed", F.lit(False))
    schema = failed & F.coalesce((F.col("error_code") == "json_validate_failed") | (F.col("output_state") == "invalid"), (F.col("error_code") == "json_validate_failed"), (F.col("output_state") == "invalid"), F.lit(False))
    proof = failed & ~schema & F.coalesce(F.col("reason_code") == "evidence_validation_failed", F.lit(False))
    of_events = e.select(*_tagged(F.col("target_id"), {CATEGORIES[4]: schema, CATEGORIES[5]: proof, CATEGORIES[8]: (F.col("status") == "succeeded") & (F.col("case_count") == 0), CATEGORIES[9]: failed & ~schema & ~proof}))

    def left_over(rows: DataFrame, key: str, category: str) -> DataFrame:
        return rows.select(key).join(matches.select(key), key, "left_anti").select(F.lit(category).alias("category"), F.col(key).cast("string").alias("target"))

    both = left_over(gold_cases, "gold_id", CATEGORIES[6]).unionByName(left_over(cases, "case_id", CATEGORIES[7]))
    return of_documents.unionByName(of_boundaries).unionByName(of_events).unionByName(both)


def ledger(found: DataFrame) -> DataFrame:
    """(position, category, n): every category in order, those without a failure with 0; a category that is not known fails."""
    named = found.sparkSession.createDataFrame(list(enumerate(CATEGORIES, 1)), "position int, category string")  # ten rows
    counts = found.where(F.assert_true(F.col("category").isin(*CATEGORIES), F.concat(F.lit("not a category: "), F.coalesce("category", F.lit("null")))).isNull()).groupBy("category").agg(F.count("*").alias("n"))
    return named.join(counts, "category", "left").select("position", "category", F.coalesce("n", F.lit(0)).alias("n"))


def report(gold: DataFrame, predictions: DataFrame, gold_cases: DataFrame, cases: DataFrame, matches: DataFrame, spans: DataFrame, thresholds: dict[str, float] | None = None) -> DataFrame:
    """(metric, value, passed): the report of a split. Rates without a denominator are null, and a null rate passes nothing.

    Documents, cases and spans are read once each. gold_cases and cases with doc_id, so that only those of the split's
    documents count; spans: valid.
    """
    thresholds = thresholds or {"prefilter_recall": 0.90, "precision": 0.85, "recall": 0.80}
    m = judged(gold, predictions)
    live = ~F.col("excluded")
    n = lambda c, name: F.count_if(F.coalesce(c, F.lit(False))).alias(name)
    docs = m.agg(F.count("*").alias("documents"), n(F.col("predicted"), "predicted_documents"), n(F.col("predicted") & F.col("excluded"), "excluded_technical_failures"), n(live & F.col("is_relevant") & F.col("said_relevant"), "tp"), n(live & ~F.col("is_relevant") & F.col("said_relevant"), "fp"),
                 n(live & F.col("is_relevant") & ~F.col("said_relevant"), "fn"), n(live & F.col("should_pass"), "should_pass"), n(live & F.col("should_pass") & F.col("passed"), "passed"))
    ids = gold.select("doc_id")
    rows = gold_cases.join(ids, "doc_id", "left_semi").select(F.lit("g").alias("side"), F.col("gold_id").alias("id")).unionByName(cases.join(ids, "doc_id", "left_semi").select(F.lit("m").alias("side"), F.col("case_id").alias("id")))
    hit = matches.select(F.lit("g").alias("side"), F.col("gold_id").alias("id")).unionByName(matches.select(F.lit("m").alias("side"), F.col("case_id").alias("id"))).distinct().withColumn("hit", F.lit(True))
    pairs = rows.join(hit, ["side", "id"], "left").agg(n(F.col("side") == "g", "gold_cases"), n(F.col("side") == "m", "model_cases"), n((F.col("side") == "g") & F.col("hit"), "matched_gold_cases"), n((F.col("side") == "m") & F.col("hit"), "matched_model_cases"))
    proofs = spans.agg(F.count("*").alias("spans"), n(F.col("valid"), "valid_spans"))
    one = docs.join(F.broadcast(pairs)).join(F.broadcast(proofs))  # one row each
    rate = lambda a, b: F.try_divide(F.col(a), F.col(b) if isinstance(b, str) else b)
    values = {c: F.col(c) for c in ("documents", "predicted_documents", "excluded_technical_failures", "gold_cases", "model_cases", "matched_gold_cases", "matched_model_cases")}
    values |= {
        "prefilter_recall": rate("passed", "should_pass"),
        "precision": rate("tp", F.col("tp") + F.col("fp")),
        "recall": rate("tp", F.col("tp") + F.col("fn")),
        "f1": F.try_divide(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn")),
        "prediction_coverage": rate("predicted_documents", "documents"),
        "gold_case_coverage": rate("matched_gold_cases", "gold_cases"),
        "span_validation_rate": rate("valid_spans", "spans"),
    }
    cells = F.array(*[F.struct(F.lit(k).alias("metric"), v.cast("double").alias("value"), F.lit(thresholds.get(k)).cast("double").alias("least")) for k, v in values.items()])
    return one.select(F.explode(cells).alias("x")).select("x.metric", "x.value", F.when(F.col("x.least").isNotNull(), F.coalesce(F.col("x.value") >= F.col("x.least"), F.lit(False))).alias("passed"))


def scoped_rows(assignments: DataFrame, labels: DataFrame, decisions: DataFrame, split: str) -> DataFrame:
    """(doc_id, gold, pred, gold_reason, pred_reason) of a split's documents; a document without a label, and a decision about none of the split or its label sheet, fail.

    assignments: doc_id, split; labels: doc_id, scope, reason; decisions: doc_id, state, scope, reason. A decision that is
    not ok is an abstention.
    """
    known = labels.select("doc_id", F.col("scope").alias("gold"), F.col("reason").alias("gold_reason"))
    said = decisions.select("doc_id", F.lit(True).alias("decided"), F.when(F.col("state") == "ok", F.col("scope")).alias("pred"), F.when(F.col("state") == "ok", F.col("reason")).alias("pred_reason"))
    m = assignments.select("doc_id", "split").join(known.withColumn("labelled", F.lit(True)), "doc_id", "full_outer").join(said, "doc_id", "full_outer")
    wrong = F.when(F.col("decided") & F.col("labelled").isNull(), "a decision about an unknown document: ").when((F.col("split") == split) & F.col("labelled").isNull(), "no label: ")
    # One condition: a filter by split of its own would be applied first and hide what is wrong.
    kept = F.when(wrong.isNotNull(), F.raise_error(F.concat(wrong, F.coalesce(F.col("doc_id").cast("string"), F.lit("null")))).cast("boolean")).otherwise(F.col("split") == split)
    return m.where(kept).select("doc_id", "gold", "pred", "gold_reason", "pred_reason")


def agreement_summary(rows: DataFrame) -> DataFrame:
    """One row: documents, those whose scope and whose reason agree, abstentions; every row stays in the denominator."""
    same = lambda a, b: F.count_if(F.col(a).eqNullSafe(F.col(b)) & F.col(a).isNotNull())
    return rows.agg(F.count("*").alias("documents"), same("gold", "pred").alias("scope_agreement"), same("gold_reason", "pred_reason").alias("reason_agreement"), F.count_if(F.col("pred").isNull()).alias("abstained"))
