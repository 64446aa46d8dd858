"""Views over the stored relations; each is one temporary view."""

from __future__ import annotations

from pyspark.sql import SparkSession

CONFIRMED = "('auto_confirmed', 'human_confirmed', 'confirmed')"
VIEWS = {
    "v_stage_status": "SELECT target_id, stage, max_by(status, struct(attempt, occurred_at, event_id)) AS status FROM stage_events GROUP BY target_id, stage",
    "v_funnel": "SELECT stage, count(DISTINCT target_id) AS n_targets, count_if(status IN ('failed', 'unavailable')) AS n_failed FROM stage_events GROUP BY stage",
    "v_confirmed_duplicates": f"SELECT * FROM duplicate_links WHERE review_state IN {CONFIRMED}",
    "v_duplicates_pending": "SELECT * FROM duplicate_links WHERE review_state = 'pending_review'",
    "v_canonical_documents": "SELECT d.* FROM documents_collected d LEFT ANTI JOIN v_confirmed_duplicates l ON d.doc_id = l.doc_id",
    "v_current_relevance": "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY decided_by <> 'human', decided_at DESC, decision_id) AS rn FROM relevance_decisions) WHERE rn = 1",
    "v_relevance_unavailable": "SELECT * FROM v_current_relevance WHERE technical_state <> 'ok'",
    "v_current_cases": "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY CASE WHEN extractor_type = 'human' AND validation_state = 'valid' THEN 0 WHEN extractor_type <> 'human' THEN 1 ELSE 2 END, extracted_at DESC, extraction_fingerprint DESC) AS rn FROM retrieval_cases) WHERE rn = 1",
    "v_valid_cases": "SELECT * FROM v_current_cases WHERE validation_state = 'valid'",
    "v_prevalence_core_direct": "SELECT c.* FROM v_valid_cases c JOIN documents_collected d ON c.doc_id = d.doc_id WHERE c.scope_class = 'core' AND d.evidence_tier = 'direct_user'",
    "v_prevalence_core_adjacent": "SELECT c.* FROM v_valid_cases c JOIN documents_collected d ON c.doc_id = d.doc_id WHERE c.scope_class IN ('core', 'adjacent') AND d.evidence_tier = 'direct_user'",
    "v_contextual_cases": "SELECT c.* FROM v_valid_cases c JOIN documents_collected d ON c.doc_id = d.doc_id WHERE d.evidence_tier <> 'direct_user'",
    "v_case_clusters": "SELECT c.case_id, a.cluster_id, a.confidence FROM v_valid_cases c JOIN cluster_assignments a ON c.case_id = a.case_id",
    "v_source_weights": "SELECT source_platform, count(*) AS n, count(*) / sum(count(*)) OVER () AS share FROM v_canonical_documents GROUP BY source_platform",
}


def create_views(spark: SparkSession) -> list[str]:
    """Create the views whose relations are registered in the session; returns their names."""
    made = []
    for name, sql in VIEWS.items():
        try:
            spark.sql(sql).createOrReplaceTempView(name)
            made.append(name)
        except Exception as error:
            if "TABLE_OR_VIEW_NOT_FOUND" not in str(error):
                raise
    return made
