"""Public cards of cases against the standard for an automated comparison. Nothing here approves a case."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CORE, ADJACENT = "core_incomplete_recall", "adjacent_known_item_retrieval"
# Verdicts, and how scope and asset map onto the reviewed reference.
ELIGIBLE, FLAGGED, FAILED, OVERLAP, UNVERIFIABLE = "eligible", "flagged", "failed_or_incomplete", "excluded_reference_overlap", "unverifiable"
REVIEWED = {CORE: "retrieval_problem", ADJACENT: "retrieval_problem", "out_of_scope": "not_retrieval_problem"}
PHOTO_TYPES = {"screenshot": "screenshot"}
UNKNOWN = "unknown"


def _blank(c: Column) -> Column:
    return F.coalesce(c, F.lit("")) == ""


def card_checks() -> dict[str, Column]:
    """The rules of eligibility by name, true where a card keeps to them.

    Columns: kind, automatically_valid, model_scope_class, excerpt, excerpt_start_char, evidence_spans (array of
    field_name, quote, excerpt_start_char, excerpt_end_char, document_start_char), rejected_model_text (array),
    assigned_values (map), findings (array of field, risk), problem_summary, source_url, reference_record_id. Null
    arrays and maps are empty, null texts blank.
    """
    spans, findings = F.col("evidence_spans"), F.col("findings")
    excerpt, origin = F.coalesce("excerpt", F.lit("")), F.coalesce("excerpt_start_char", F.lit(0))
    some, shown = F.coalesce(F.size(spans) > 0, F.lit(False)), excerpt != ""
    inside = lambda s: F.coalesce((s["excerpt_start_char"] >= 0) & (s["excerpt_end_char"] > s["excerpt_start_char"]) & (s["excerpt_end_char"] <= F.length(excerpt)), F.lit(False))
    fits = lambda s: inside(s) & (F.substring(excerpt, s["excerpt_start_char"] + 1, s["excerpt_end_char"] - s["excerpt_start_char"]) == F.coalesce(s["quote"], F.lit(""))) & F.coalesce(s["document_start_char"] - origin == s["excerpt_start_char"], F.lit(True))
    whole = lambda s: ~inside(s) | (~_blank(s["quote"]) & F.contains(excerpt, F.coalesce(s["quote"], F.lit(""))))
    quoted = lambda f: F.coalesce(F.exists(spans, lambda s: s["field_name"] == f), F.lit(False))
    objected = lambda f: F.coalesce(F.exists(findings, lambda x: x["field"] == f), F.lit(False))
    risk = lambda r: F.coalesce(F.exists(findings, lambda x: x["risk"] == r), F.lit(False))
    stated = lambda f: ~_blank(F.col("assigned_values")[f])
    own = lambda f: quoted(f) & ~objected(f)
    impact = (~stated("impact_signals") & ~stated("severity")) | ((~stated("impact_signals") | own("impact_signals")) & (~stated("severity") | own("severity")) & ~risk("unsupported_impact"))
    return {
        "is_extraction_case": F.coalesce(F.col("kind") == "case", F.lit(False)),
        "automatically_valid": F.coalesce("automatically_valid", F.lit(False)),
        "scope_core_or_adjacent": F.coalesce(F.col("model_scope_class").isin(CORE, ADJACENT), F.lit(False)),
        "source_context_present": shown,
        "evidence_present": some,
        "offsets_valid": some & shown & F.coalesce(F.forall(spans, fits), F.lit(False)),
        "quotes_continuous_in_source": some & shown & F.coalesce(F.forall(spans, whole), F.lit(False)),
        "no_rejected_model_text": F.coalesce(F.size("rejected_model_text") == 0, F.lit(True)),
        "retrieval_trigger_supported": ~stated("retrieval_trigger") | own("retrieval_trigger"),
        "impact_or_severity_supported": impact,
        "summary_supported": _blank(F.col("problem_summary")) | (own("problem_summary") & ~risk("incomplete_summary")),
        "no_recorded_finding": F.coalesce(F.size(findings) == 0, F.lit(True)),
        "source_link_present": ~_blank(F.col("source_url")),
        "not_a_reviewed_reference_record": F.col("reference_record_id").isNull(),
    }


def assess_cards(cards: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """``cards`` (or the columns ``keep``) with ``checks`` (map), ``failed`` (names of rules broken), ``verdict`` and the mapped reference values.

    A card that a reference record overlaps is excluded, whatever else holds; then one that is no valid case has
    failed, one without source context cannot be verified, and one that breaks any other rule is flagged. Offsets and
    quotes are judged, and count as broken, only where there are spans and an excerpt to hold them against.
    """
    checks = card_checks()
    judged = F.coalesce(F.size("evidence_spans") > 0, F.lit(False)) & (F.coalesce("excerpt", F.lit("")) != "")
    broken = {k: ~c & (judged if k in ("offsets_valid", "quotes_continuous_in_source") else F.lit(True)) for k, c in checks.items()}
    failed = F.array_compact(F.array(*[F.when(b, k) for k, b in broken.items()]))
    verdict = (
        F.when(~checks["not_a_reviewed_reference_record"], OVERLAP)
        .when(~checks["is_extraction_case"] | ~checks["automatically_valid"], FAILED)
        .when(~checks["source_context_present"], UNVERIFIABLE)
        .when(F.size(failed) > 0, FLAGGED)
        .otherwise(ELIGIBLE)
    )
    scope, asset = F.col("model_scope_class"), F.coalesce(F.col("assigned_values")["target_asset_type"], F.lit(""))
    reviewed = F.coalesce(*[F.when(scope == k, v) for k, v in REVIEWED.items()], F.lit(UNKNOWN))
    photo = F.when(asset == "", "not stated").otherwise(F.coalesce(*[F.when(asset == k, v) for k, v in PHOTO_TYPES.items()], F.lit("not mapped")))
    return cards.select(*(keep or cards.columns), F.create_map(*[x for k, c in checks.items() for x in (F.lit(k), c)]).alias("checks"), failed.alias("failed"), verdict.alias("verdict"), reviewed.alias("reviewed_relevance_equivalent"), photo.alias("photo_type_equivalent"))


def assessment_identity(reference_version: Column, relevance_prompt: Column, extraction_prompt: Column, schema_version: Column, model: Column, case_id: Column, dataset_version: Column) -> Column:
    """SHA-256 of what an assessment rests on, as JSON with its keys in order."""
    parts = dict(case_id=case_id, dataset_version=dataset_version, extraction_prompt=extraction_prompt, model=model, reference_version=reference_version, relevance_prompt=relevance_prompt, schema_version=schema_version)
    return F.sha2(F.to_json(F.struct(*[v.alias(k) for k, v in parts.items()])), 256)


def automated_comparison(assessed: DataFrame) -> DataFrame:
    """(dimension, value, n) over eligible cards: scope bucket, reviewed relevance and photo type, the known values with zeros too."""
    e = assessed.where(F.col("verdict") == ELIGIBLE)
    known = [("scope", CORE), ("scope", ADJACENT)] + [("reviewed_relevance_equivalent", v) for v in ("retrieval_problem", "not_retrieval_problem", UNKNOWN)]
    rows = F.array(*[F.struct(F.lit(d).alias("dimension"), F.col(c).alias("value")) for d, c in (("scope", "model_scope_class"), ("reviewed_relevance_equivalent", "reviewed_relevance_equivalent"), ("photo_type_equivalent", "photo_type_equivalent"))])
    found = e.select(F.explode(rows).alias("r")).groupBy("r.dimension", "r.value").agg(F.count("*").alias("n"))
    zero = assessed.sparkSession.createDataFrame(known, "dimension string, value string")
    return found.join(zero, ["dimension", "value"], "full").select("dimension", "value", F.coalesce("n", F.lit(0)).alias("n"))


def verdict_totals(assessed: DataFrame, reference_records: int) -> DataFrame:
    """One row: cards assessed, valid, and of each verdict."""
    return assessed.agg(F.lit(reference_records).alias("human_reviewed_records"), F.count("*").alias("cases_assessed"), F.count_if("automatically_valid").alias("automatically_valid_cases"), *[F.count_if(F.col("verdict") == v).alias(n) for n, v in (("eligible_cases", ELIGIBLE), ("flagged_cases", FLAGGED), ("unverifiable_cases", UNVERIFIABLE), ("failed_or_incomplete_cases", FAILED), ("reference_overlap_excluded", OVERLAP))])
