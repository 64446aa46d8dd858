"""Queries of card assessment, gold evaluation and extraction outcomes, with the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import cards, evaluation, outcomes
from .cases import duck, rel
from .registry import query

# -- cards ------------------------------------------------------------------------------------------

def _cards(t) -> DataFrame:
    """A card per document with at least 60 characters or none shown: what is wrong with it follows from its id."""
    x, k = F.col("text"), F.col("doc_id")
    span = lambda f, a, b, shift=0: F.struct(F.lit(f).alias("field_name"), F.substring(x, a + 1, b - a).alias("quote"), F.lit(a + shift).alias("excerpt_start_char"), F.lit(b + shift).alias("excerpt_end_char"), F.lit(a + 100).alias("document_start_char"))
    none = F.array().cast("array<struct<field_name:string,quote:string,excerpt_start_char:int,excerpt_end_char:int,document_start_char:int>>")
    spans = F.when(k % 19 == 0, none).when(k % 7 == 0, F.array(span("problem_summary", 5, 15, 1))).otherwise(F.array(span("problem_summary", 5, 15), span("retrieval_trigger", 20, 30)))
    finding = F.struct(F.lit("severity").alias("field"), F.lit("unsupported_impact").alias("risk"))
    return t("documents").select(
        "doc_id",
        F.when(k % 17 == 0, "attempt").otherwise("case").alias("kind"),
        (k % 13 != 0).alias("automatically_valid"),
        F.when(k % 5 == 0, "out_of_scope").when(k % 2 == 0, cards.CORE).otherwise(cards.ADJACENT).alias("model_scope_class"),
        F.when(k % 23 != 0, F.substring(x, 1, 60)).alias("excerpt"),
        F.lit(100).alias("excerpt_start_char"),
        spans.alias("evidence_spans"),
        F.when(k % 29 == 0, F.array(F.lit("made up"))).otherwise(F.array().cast("array<string>")).alias("rejected_model_text"),
        F.create_map(F.lit("retrieval_trigger"), F.when(k % 3 == 0, "t"), F.lit("severity"), F.when(k % 31 == 0, "3"), F.lit("target_asset_type"), F.when(k % 4 == 0, "screenshot").when(k % 4 == 1, "album")).alias("assigned_values"),
        F.when(k % 37 == 0, F.array(finding)).otherwise(F.array().cast("array<struct<field:string,risk:string>>")).alias("findings"),
        F.when(k % 11 == 0, "").otherwise("a summary").alias("problem_summary"),
        F.when(k % 41 != 0, "https://s.example/x").alias("source_url"),
        F.when(k % 43 == 0, "r1").alias("reference_record_id"),
    )


_ASSESSED = f"""a AS (SELECT doc_id, text, doc_id % 17 <> 0 AS is_case, doc_id % 13 <> 0 AS automatically_valid, CASE WHEN doc_id % 5 = 0 THEN 'out_of_scope' WHEN doc_id % 2 = 0 THEN '{cards.CORE}' ELSE '{cards.ADJACENT}' END AS scope, doc_id % 19 <> 0 AS cited, doc_id % 23 <> 0 AND coalesce(text, '') <> '' AS shown, coalesce(CASE WHEN doc_id % 23 <> 0 THEN substr(text, 1, 60) END, '') AS ex, doc_id % 19 <> 0 AND doc_id % 7 <> 0 AS trigger FROM documents),
b AS (SELECT *, CASE WHEN trigger THEN length(ex) >= 30 WHEN cited THEN length(ex) >= 16 AND substr(ex, 7, 10) = coalesce(substr(text, 6, 10), '') AND false ELSE true END AS fit FROM a),
w AS (SELECT *, CASE WHEN trigger THEN (length(ex) < 15 OR contains(ex, substr(text, 6, 10))) AND (length(ex) < 30 OR contains(ex, substr(text, 21, 10))) WHEN cited THEN length(ex) < 16 OR contains(ex, substr(text, 6, 10)) ELSE true END AS whole FROM b),
c AS (SELECT *, list_filter([CASE WHEN NOT is_case THEN 'is_extraction_case' END, CASE WHEN NOT automatically_valid THEN 'automatically_valid' END, CASE WHEN scope = 'out_of_scope' THEN 'scope_core_or_adjacent' END, CASE WHEN NOT shown THEN 'source_context_present' END, CASE WHEN NOT cited THEN 'evidence_present' END, CASE WHEN cited AND shown AND NOT fit THEN 'offsets_valid' END, CASE WHEN cited AND shown AND NOT whole THEN 'quotes_continuous_in_source' END, CASE WHEN doc_id % 29 = 0 THEN 'no_rejected_model_text' END, CASE WHEN doc_id % 3 = 0 AND NOT trigger THEN 'retrieval_trigger_supported' END, CASE WHEN doc_id % 31 = 0 THEN 'impact_or_severity_supported' END, CASE WHEN doc_id % 11 <> 0 AND NOT cited THEN 'summary_supported' END, CASE WHEN doc_id % 37 = 0 THEN 'no_recorded_finding' END, CASE WHEN doc_id % 41 = 0 THEN 'source_link_present' END, CASE WHEN doc_id % 43 = 0 THEN 'not_a_reviewed_reference_record' END], lambda x: x IS NOT NULL) AS failed FROM w),
v AS (SELECT *, CASE WHEN doc_id % 43 = 0 THEN 'excluded_reference_overlap' WHEN NOT is_case OR NOT automatically_valid THEN 'failed_or_incomplete' WHEN NOT shown THEN 'unverifiable' WHEN len(failed) > 0 THEN 'flagged' ELSE 'eligible' END AS verdict, CASE WHEN scope = 'out_of_scope' THEN 'not_retrieval_problem' ELSE 'retrieval_problem' END AS reviewed_relevance_equivalent, CASE doc_id % 4 WHEN 0 THEN 'screenshot' WHEN 1 THEN 'not mapped' ELSE 'not stated' END AS photo_type_equivalent FROM c)"""


@query(f"WITH {_ASSESSED} SELECT doc_id, array_to_string(failed, ',') AS failed, verdict, reviewed_relevance_equivalent, photo_type_equivalent FROM v")
def card_assessments(t):
    """All rules of eligibility over a card per document."""
    return cards.assess_cards(_cards(t), ["doc_id"]).select("doc_id", F.array_join("failed", ",").alias("failed"), "verdict", "reviewed_relevance_equivalent", "photo_type_equivalent")


@query(f"WITH {_ASSESSED} SELECT 7 AS human_reviewed_records, count(*) AS cases_assessed, count_if(automatically_valid) AS automatically_valid_cases, count_if(verdict = 'eligible') AS eligible_cases, count_if(verdict = 'flagged') AS flagged_cases, count_if(verdict = 'unverifiable') AS unverifiable_cases, count_if(verdict = 'failed_or_incomplete') AS failed_or_incomplete_cases, count_if(verdict = 'excluded_reference_overlap') AS reference_overlap_excluded FROM v")
def card_totals(t):
    return cards.verdict_totals(cards.assess_cards(_cards(t)), 7)


@query(f"""WITH {_ASSESSED}, e AS (SELECT * FROM v WHERE verdict = 'eligible'), n AS (SELECT 'scope' AS dimension, scope AS value, count(*) AS n FROM e GROUP BY scope UNION ALL SELECT 'reviewed_relevance_equivalent', reviewed_relevance_equivalent, count(*) FROM e GROUP BY 2 UNION ALL SELECT 'photo_type_equivalent', photo_type_equivalent, count(*) FROM e GROUP BY 2),
k AS (SELECT * FROM (VALUES ('scope', '{cards.CORE}'), ('scope', '{cards.ADJACENT}'), ('reviewed_relevance_equivalent', 'retrieval_problem'), ('reviewed_relevance_equivalent', 'not_retrieval_problem'), ('reviewed_relevance_equivalent', 'unknown')) z(dimension, value))
SELECT coalesce(n.dimension, k.dimension) AS dimension, coalesce(n.value, k.value) AS value, coalesce(n, 0) AS n FROM n FULL JOIN k ON n.dimension = k.dimension AND n.value = k.value""")
def automated_comparison(t):
    return cards.automated_comparison(cards.assess_cards(_cards(t)))


@query("""SELECT o_orderkey, sha256('{"case_id":"' || o_orderkey || '","dataset_version":"d/r","extraction_prompt":"x1","model":"m","reference_version":"v1","relevance_prompt":"' || o_orderstatus || '","schema_version":"s"}') AS identity FROM orders""")
def assessment_identities(t):
    l = F.lit
    return t("orders").select("o_orderkey", cards.assessment_identity(l("v1"), F.col("o_orderstatus"), l("x1"), l("s"), l("m"), F.col("o_orderkey").cast("string"), l("d/r")).alias("identity"))


# -- gold evaluation --------------------------------------------------------------------------------

GOLD = "SELECT o_orderkey AS doc_id, CASE o_orderstatus WHEN 'F' THEN 'core' WHEN 'O' THEN 'adjacent' ELSE 'out_of_scope' END AS scope_class, o_orderkey % 3 <> 0 AS should_pass FROM {orders}"
PREDICTED = "SELECT o_orderkey AS doc_id, CASE WHEN o_orderkey % 7 = 0 THEN 'provider_failed' ELSE 'ok' END AS technical_state, o_orderkey % 4 <> 0 AS passed, CASE o_custkey % 3 WHEN 0 THEN 'core' WHEN 1 THEN 'adjacent' ELSE 'out_of_scope' END AS scope_class FROM {orders} WHERE o_orderkey % 11 <> 0"


@query(f"{duck(g=GOLD, p=PREDICTED)} SELECT count_if(passed) AS hits, count(*) AS total, count_if(passed) / count(*) AS recall FROM g JOIN p USING (doc_id) WHERE should_pass AND technical_state = 'ok'")
def prefilter_recall(t):
    return evaluation.prefilter_recall(rel(t, GOLD), rel(t, PREDICTED))


@query(f"""{duck(g=GOLD, p=PREDICTED)}, m AS (SELECT g.doc_id, g.scope_class AS gold, should_pass, passed, p.scope_class AS pred, g.scope_class IN ('core', 'adjacent') AS is_, passed AND p.scope_class IN ('core', 'adjacent') AS said FROM g JOIN p USING (doc_id) WHERE technical_state = 'ok')
SELECT 'prefilter_drop' AS category, doc_id FROM m WHERE should_pass AND NOT passed UNION ALL SELECT 'relevance_false_positive', doc_id FROM m WHERE said AND NOT is_ UNION ALL SELECT 'relevance_false_negative', doc_id FROM m WHERE is_ AND NOT said UNION ALL SELECT 'scope_boundary', doc_id FROM m WHERE is_ AND said AND gold <> pred""")
def document_failures(t):
    return evaluation.document_failures(rel(t, GOLD), rel(t, PREDICTED))


EXTRACTED = "SELECT event_id AS target_id, CASE event_id % 5 WHEN 0 THEN 'classify' WHEN 1 THEN CAST(NULL AS STRING) ELSE 'extract' END AS stage, CASE WHEN value < 60 THEN 'failed' WHEN value < 90 THEN 'skipped' ELSE 'succeeded' END AS status, CASE WHEN user_id % 2 = 0 THEN 'evidence_validation_failed' END AS reason_code, CAST(user_id % 3 AS INT) AS case_count, CASE WHEN user_id % 13 = 0 THEN 'out_of_scope' END AS skip_cause, CASE WHEN user_id % 5 = 0 THEN 'json_validate_failed' END AS error_code, CASE WHEN user_id % 7 = 0 THEN 'invalid' END AS output_state FROM {events}"


@query(f"""{duck(x=EXTRACTED)}, e AS (SELECT *, coalesce(error_code = 'json_validate_failed', false) OR coalesce(output_state = 'invalid', false) AS bad FROM x WHERE coalesce(stage, 'extract') = 'extract' AND status <> 'skipped' AND skip_cause IS NULL)
SELECT CASE WHEN status = 'succeeded' THEN 'empty_extraction' WHEN bad THEN 'schema_rejected' WHEN reason_code IS NOT NULL THEN 'evidence_failed' ELSE 'other_failure' END AS category, target_id FROM e WHERE status = 'failed' OR case_count = 0""")
def extraction_failures(t):
    return evaluation.extraction_failures(rel(t, EXTRACTED))


@query("""
WITH v AS (SELECT 'asset' AS field, [o_orderstatus] AS pred, CASE WHEN o_orderkey % 2 = 0 THEN [CASE WHEN o_orderkey % 4 = 0 THEN o_orderstatus ELSE 'X' END] END AS gold, false AS multi, o_custkey % 5 <> 0 AS ok FROM orders
UNION ALL SELECT 'cues', CASE WHEN o_orderkey % 6 = 0 THEN [] ELSE [o_orderstatus, o_orderpriority] END, CASE WHEN o_orderkey % 3 <> 1 THEN [o_orderstatus, CASE WHEN o_orderkey % 3 = 0 THEN o_orderpriority ELSE 'Y' END, 'more'] END, true, o_custkey % 7 <> 0 FROM orders
UNION ALL SELECT 'query', ['q'], NULL, false, true FROM orders),
s AS (SELECT field, NOT ok OR gold IS NOT NULL AS scored, NOT ok OR (gold IS NOT NULL AND CASE WHEN multi THEN NOT list_has_all(gold, pred) ELSE pred <> gold END) AS bad FROM v WHERE len(pred) > 0),
g AS (SELECT field, count_if(scored AND bad) AS unsupported, count_if(scored) AS total FROM s GROUP BY field UNION ALL SELECT 'overall', count_if(scored AND bad), count_if(scored) FROM s)
SELECT field, unsupported, total, unsupported / nullif(total, 0) AS rate FROM g""")
def unsupported_inference(t):
    k, c, s, p = F.col("o_orderkey"), F.col("o_custkey"), F.col("o_orderstatus"), F.col("o_orderpriority")
    row = lambda f, pred, gold, multi, ok: F.struct(F.lit(f).alias("field"), pred.alias("predicted"), gold.alias("gold"), F.lit(multi).alias("multi"), ok.alias("supported"))
    asset = row("asset", F.array(s), F.when(k % 2 == 0, F.array(F.when(k % 4 == 0, s).otherwise("X"))), False, c % 5 != 0)
    cues = row("cues", F.when(k % 6 == 0, F.array().cast("array<string>")).otherwise(F.array(s, p)), F.when(k % 3 != 1, F.array(s, F.when(k % 3 == 0, p).otherwise("Y"), F.lit("more"))), True, c % 7 != 0)
    query_ = row("query", F.array(F.lit("q")), F.lit(None).cast("array<string>"), False, F.lit(True))
    return evaluation.unsupported_inference(t("orders").select(F.explode(F.array(asset, cues, query_)).alias("r")).select("r.*"))


LABELS = "SELECT DISTINCT l_orderkey AS doc_id, l_linenumber AS pos, CASE l_linenumber % 4 WHEN 0 THEN '' WHEN 1 THEN 'ann' ELSE 'bob' END AS labeler, CASE WHEN l_orderkey % 2 = l_linenumber % 2 THEN 'core' ELSE 'adjacent' END AS scope FROM {lineitem}"


@query(f"""{duck(l=LABELS)}, p AS (SELECT a.scope AS a, b.scope AS b FROM l a JOIN l b ON a.doc_id = b.doc_id AND a.pos < b.pos AND a.labeler <> b.labeler AND a.labeler <> '' AND b.labeler <> ''),
tot AS (SELECT count(*) AS n, avg(CASE WHEN a = b THEN 1.0 ELSE 0.0 END) AS agreement FROM p), ch AS (SELECT coalesce(sum(pa * pb), 0) AS e FROM (SELECT a AS v, count(*) / (SELECT count(*) FROM p) AS pa FROM p GROUP BY a) JOIN (SELECT b AS v, count(*) / (SELECT count(*) FROM p) AS pb FROM p GROUP BY b) USING (v))
SELECT n, agreement, e AS expected, (agreement - e) / (1 - e) AS kappa FROM tot, ch""")
def labeler_agreement(t):
    """Agreement of every two labelers of a document, before their labels were settled."""
    return evaluation.kappa(evaluation.labeler_pairs(rel(t, LABELS)), "left_scope", "right_scope")


@query("SELECT 2 * count(*) AS n_quotes, count_if(NOT contains(text, substr(text, 9, 12)) OR substr(text, 9, 12) = '') + count_if(NOT contains(text, 'the of')) AS failures FROM documents WHERE text IS NOT NULL")
def gold_quote_failures(t):
    d = t("documents")
    gold = d.select("doc_id", F.array(F.coalesce(F.substring("text", 9, 12), F.lit("q")), F.lit("the of")).alias("quotes"))
    return evaluation.gold_quote_failures(gold, d.select("doc_id", "text"))


@query("SELECT (SELECT count(*) FROM orders) AS gold_cases, (SELECT count(*) FROM customer) AS model_cases, count(*) AS matched_cases, (SELECT count(*) FROM orders) - count(*) AS unmatched_gold_cases, (SELECT count(*) FROM customer) - count(*) AS unmatched_model_cases, count(*) / (SELECT count(*) FROM orders) AS gold_case_coverage FROM orders JOIN customer ON c_custkey = o_orderkey")
def gold_coverage(t):
    o, c = t("orders").select(F.col("o_orderkey").alias("k")), t("customer").select(F.col("c_custkey").alias("k"))
    return evaluation.coverage(o, c, o.join(c, "k"))


@query("SELECT o_orderkey AS k, o_orderstatus AS s FROM orders WHERE o_orderkey NOT IN (SELECT c_custkey FROM customer)")
def unmatched_gold(t):
    return evaluation.unmatched(t("orders").select(F.col("o_orderkey").alias("k"), F.col("o_orderstatus").alias("s")), t("customer").select(F.col("c_custkey").alias("k")), "k")


# -- outcomes of extraction -------------------------------------------------------------------------

OUTCOME = "SELECT CAST(o_orderkey AS STRING) AS doc_id, 'd' || CAST(o_orderkey AS STRING) AS decision_id, CASE WHEN o_custkey % 3 = 0 THEN 'human' ELSE 'model' END AS decided_by, CASE o_orderstatus WHEN 'F' THEN 'core' WHEN 'O' THEN 'adjacent' ELSE 'out_of_scope' END AS scope_class, CASE WHEN o_orderkey % 5 = 0 THEN 'timeout' ELSE 'ok' END AS technical_state, CASE WHEN o_orderkey % 3 = 0 THEN 'pending' ELSE 'valid' END AS validation_state, o_orderstatus <> 'P' AS eligible, o_orderstatus = 'P' OR o_orderkey % 3 = 0 AS blocked, o_orderpriority AS state FROM {orders}"


@query(f"{duck(o=OUTCOME)} SELECT doc_id, decision_id, decided_by, scope_class, eligible, state AS technical_state, CASE WHEN NOT blocked THEN NULL WHEN technical_state = 'ok' AND validation_state = 'valid' AND scope_class = 'out_of_scope' THEN 'out_of_scope' ELSE 'relevance_not_accepted' END AS skip_cause FROM o")
def input_rows(t):
    return outcomes.input_rows(rel(t, OUTCOME))


@query(f"""{duck(o=OUTCOME)}, h AS (SELECT doc_id, min(decision_id) AS id FROM (SELECT doc_id, 'h1' AS decision_id, validation_state AS v, technical_state AS s FROM o WHERE decided_by = 'human' UNION ALL SELECT doc_id, 'h2', 'valid', 'ok' FROM o WHERE decided_by = 'human' AND eligible) WHERE v = 'valid' AND s = 'ok' GROUP BY doc_id)
SELECT o.doc_id, coalesce(h.id, o.decision_id) AS decision_id, CASE WHEN h.id IS NULL THEN scope_class ELSE 'adjacent' END AS scope_class, CASE WHEN h.id IS NULL THEN 'model' ELSE 'human' END AS decided_by, h.id IS NOT NULL OR (technical_state = 'ok' AND validation_state = 'valid' AND scope_class <> 'out_of_scope') AS eligible FROM o LEFT JOIN h USING (doc_id)""")
def extraction_inputs(t):
    """The human decision that is valid and of smallest id counts, else the model's."""
    o = rel(t, OUTCOME)
    cols = ["doc_id", "decision_id", "scope_class", "technical_state", "validation_state"]
    human = o.where("decided_by = 'human'")
    one = human.withColumns({"decision_id": F.lit("h1"), "scope_class": F.lit("adjacent")}).select(cols)
    two = human.where("eligible").withColumns({"decision_id": F.lit("h2"), "scope_class": F.lit("adjacent"), "technical_state": F.lit("ok"), "validation_state": F.lit("valid")}).select(cols)
    return outcomes.resolved_inputs(o.select("doc_id"), o.select(cols), one.union(two))


def _results(t) -> DataFrame:
    """Two results a document, whose spans claim right, shifted, missing and impossible places."""
    x, k = F.col("text"), F.col("doc_id")
    at = lambda f, q, a, b: F.struct(F.lit(f).alias("field_name"), q.alias("quote"), a.cast("int").alias("start"), b.cast("int").alias("stop"))
    n = lambda v: F.lit(v)
    first = F.struct(F.concat(k.cast("string"), F.lit("#1")).alias("case_id"), F.array(at("a", F.substring(x, 9, 12), n(8), n(20)), at("b", F.substring(x, 9, 12), n(11), n(23))).alias("spans"))
    second = F.struct(F.concat(k.cast("string"), F.lit("#2")).alias("case_id"), F.array(at("c", F.substring(x, 9, 12), n(None), n(None)), at("d", F.lit("\x01 nowhere"), n(3), n(9))).alias("spans"))
    return t("documents").select("doc_id", x.alias("raw_text"), F.array(first, second).alias("results"))


@query("""
WITH q AS (SELECT doc_id, text, substr(text, 9, 12) AS quote FROM documents), h AS (SELECT *, CASE WHEN coalesce(quote, '') = '' THEN [] ELSE list_filter(range(0, length(text) - length(quote) + 1), lambda i: substr(text, i + 1, length(quote)) = quote) END AS hits FROM q),
n AS (SELECT *, CASE WHEN len(hits) > 0 THEN list_sort(list_transform(hits, lambda x: {'d': abs(x - 11), 'p': x}))[1].p END AS near, quote <> '' AND substr(text, 12, 12) = quote AS moved FROM h),
r AS (SELECT doc_id, '#1' AS c, 'a' AS field_name, quote, 8 AS s, 20 AS e, CASE WHEN quote <> '' THEN 'exact' ELSE 'not_found' END AS rung, CASE WHEN quote <> '' THEN 8 END AS f, CASE WHEN quote <> '' THEN 20 END AS g FROM n
UNION ALL SELECT doc_id, '#1', 'b', quote, 11, 23, CASE WHEN moved THEN 'exact' WHEN len(hits) = 1 THEN 'unique' WHEN len(hits) > 1 THEN 'nearest' ELSE 'not_found' END, CASE WHEN moved THEN 11 ELSE near END, CASE WHEN moved THEN 23 ELSE near + length(quote) END FROM n
UNION ALL SELECT doc_id, '#2', 'c', quote, NULL, NULL, CASE WHEN len(hits) = 1 THEN 'unique' WHEN len(hits) > 1 THEN 'ambiguous' ELSE 'not_found' END, CASE WHEN len(hits) = 1 THEN hits[1] END, CASE WHEN len(hits) = 1 THEN hits[1] + length(quote) END FROM n
UNION ALL SELECT doc_id, '#2', 'd', chr(1) || ' nowhere', 3, 9, 'not_found', NULL, NULL FROM n)
SELECT doc_id, doc_id || c AS case_id, field_name, f IS NOT NULL AS ok, CASE rung WHEN 'exact' THEN 'supplied_exact' WHEN 'unique' THEN 'repaired_unique' WHEN 'nearest' THEN 'repaired_nearest' WHEN 'ambiguous' THEN 'ambiguous_tied' ELSE 'missing_unresolved' END AS offset_state, CASE WHEN f IS NULL THEN 'rejected' ELSE 'valid' END AS validation_state, quote, CAST(f AS INTEGER) AS start_char, CAST(g AS INTEGER) AS end_char, s AS candidate_start_char, e AS candidate_end_char, rung IN ('unique', 'nearest') AS repair_applied FROM r""")
def verdict_rows(t):
    """What spans claimed against where they came to stand, over whole texts, short and empty ones too."""
    return outcomes.verdict_rows(_results(t))


@query("SELECT doc_id, doc_id || r AS case_id, f AS field_name FROM documents, (VALUES ('#1', 'a'), ('#1', 'b'), ('#2', 'c'), ('#2', 'd')) v(r, f)")
def span_rows(t):
    return outcomes.span_rows(_results(t)).select("doc_id", "case_id", "field_name")


@query("""
WITH q AS (SELECT doc_id, text, CASE WHEN doc_id % 3 = 0 THEN 'nowhere at all' ELSE substr(text, 9, 30) END AS quote FROM documents WHERE length(text) >= 60), h AS (SELECT *, list_filter(range(0, length(text) - length(quote) + 1), lambda i: substr(text, i + 1, length(quote)) = quote) AS hits FROM q), a AS (SELECT *, len(hits) = 1 AND doc_id % 2 = 0 AS ok FROM h)
SELECT substr(sha1('human-relevance-decision|ov' || doc_id), 1, 12) AS decision_id, doc_id, 'core' AS scope_class, 'r' AS reason_code, 'because' AS reason_summary, 'human' AS decided_by, substr(sha1('human-relevance|' || doc_id || '|core|r|' || sha256(text) || '|' || quote), 1, 10) AS decision_fingerprint, CAST(CASE WHEN len(hits) = 1 THEN hits[1] END AS INTEGER) AS start_char, CAST(CASE WHEN len(hits) = 1 THEN hits[1] + length(quote) END AS INTEGER) AS end_char, CASE WHEN ok THEN 'valid' ELSE 'pending' END AS validation_state, NOT ok AS needs_human_review FROM a""")
def human_decisions(t):
    d = t("documents").where("length(text) >= 60")
    over = d.select(F.concat(F.lit("ov"), F.col("doc_id").cast("string")).alias("override_id"), "doc_id", F.lit("core").alias("scope_class"), F.lit("r").alias("reason_code"), F.lit("because").alias("rationale"), F.when(F.col("doc_id") % 3 == 0, "nowhere at all").otherwise(F.substring("text", 9, 30)).alias("quote"), (F.col("doc_id") % 2 == 0).alias("supports_decision"))
    return outcomes.human_decisions(over, d.select("doc_id", "text", F.sha2("text", 256).alias("content_hash")))


@query("""
WITH q AS (SELECT doc_id, text, CASE doc_id % 4 WHEN 0 THEN NULL WHEN 1 THEN 'nowhere at all' ELSE substr(text, 9, 30) END AS quote FROM documents WHERE length(text) >= 60), a AS (SELECT *, quote IS NULL OR len(string_split(text, quote)) = 2 AS ok FROM q)
SELECT 'c' || doc_id AS case_id, doc_id, 'human' AS extractor_type, substr(sha1('human|p1|s1|' || sha256(text)), 1, 10) AS extraction_fingerprint, NOT ok AS needs_human_review, CASE WHEN ok THEN 'valid' ELSE 'pending' END AS validation_state FROM a""")
def human_cases(t):
    d = t("documents").where("length(text) >= 60")
    case = F.concat(F.lit("c"), F.col("doc_id").cast("string"))
    over = d.select(case.alias("target_id"), "doc_id", F.when(F.col("doc_id") % 4 == 0, None).when(F.col("doc_id") % 4 == 1, "nowhere at all").otherwise(F.substring("text", 9, 30)).alias("evidence_quote"))
    return outcomes.human_cases(d.select(case.alias("case_id"), "doc_id", F.lit("p1").alias("prompt_version")), over, d.select("doc_id", "text", F.sha2("text", 256).alias("content_hash")), "s1")


OWNED = "SELECT CAST(l_orderkey AS STRING) AS owner_id, 'f' || CAST(l_linenumber % 3 AS STRING) AS field_name, CASE l_returnflag WHEN 'R' THEN 'rejected' ELSE 'valid' END AS validation_state FROM {lineitem}"


@query(f"{duck(s=OWNED)} SELECT owner_id AS case_id, count(*) AS n_spans, list_sort(list(DISTINCT field_name)) AS fields FROM s WHERE validation_state = 'valid' AND CAST(owner_id AS BIGINT) IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F') GROUP BY owner_id")
def case_spans(t):
    return outcomes.spans_per_case(rel(t, OWNED), t("orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").cast("string").alias("case_id")))


@query("SELECT o_orderkey AS k, o_orderstatus AS s, o_orderpriority AS p FROM orders")
def strict_pairs(t):
    o = t("orders")
    return outcomes.strict_join(o.select(F.col("o_orderkey").alias("k"), F.col("o_orderstatus").alias("s")), o.select(F.col("o_orderkey").alias("k"), F.col("o_orderpriority").alias("p")), "k")


@query("SELECT c_custkey, list_filter(CASE WHEN c_custkey % 2 = 0 THEN [c_name, c_mktsegment] ELSE ['x', c_name, c_mktsegment] END, lambda x: x IS NOT NULL) AS quotes FROM customer")
def merged_quotes(t):
    n, m = F.col("c_name"), F.col("c_mktsegment")
    first = F.when(F.col("c_custkey") % 2 == 0, F.array(n, F.lit(" "), n)).otherwise(F.array(F.lit("x"), F.lit(None).cast("string")))
    return t("customer").select("c_custkey", outcomes.merged_quotes(first, F.array(n, m, F.lit("")) ).alias("quotes"))


@query("SELECT k, CASE WHEN k % 2 = 0 THEN 'a' WHEN k % 3 = 0 THEN 'b' ELSE 'c' END AS v FROM (SELECT c_custkey AS k FROM customer)")
def united_sources(t):
    """Three sources of overlapping rows; of a key the first source's row stays."""
    c = t("customer").select(F.col("c_custkey").alias("k"))
    return outcomes.union_first(c.where("k % 2 = 0").withColumn("v", F.lit("a")), c.where("k % 3 = 0").withColumn("v", F.lit("b")), c.withColumn("v", F.lit("c")), key="k", order="v")


RESERVED = "SELECT o_orderkey AS reservation_id, CASE o_orderstatus WHEN 'F' THEN 'reserved' WHEN 'O' THEN 'spent' ELSE 'released' END AS state, CAST(10 AS BIGINT) AS amount FROM {orders}"


@query(f"{duck(r=RESERVED)} SELECT reservation_id, CASE WHEN state = 'reserved' AND reservation_id % 2 = 0 THEN CASE WHEN reservation_id % 4 = 0 THEN 'spent' ELSE 'released' END ELSE state END AS state, CASE WHEN state = 'reserved' AND reservation_id % 4 = 0 THEN least(reservation_id % 15, 10) ELSE amount END AS amount FROM r")
def reconciled_ledger(t):
    r = rel(t, RESERVED)
    return outcomes.ledger_after(r, r.where("reservation_id % 2 = 0").select("reservation_id", F.when(F.col("reservation_id") % 4 == 0, F.col("reservation_id") % 15).alias("spent")))


@query("SELECT user_id AS thread_id, count(DISTINCT event_id) AS n_known, max(CASE WHEN event_type = 'view' THEN CAST(floor(value) AS INTEGER) END) AS complete_total FROM events GROUP BY user_id")
def known_threads(t):
    e = t("events").select(F.col("user_id").alias("thread_id"), F.col("event_id").alias("item_id"), F.floor("value").cast("int").alias("reply_total"), (F.col("event_type") == "view").alias("complete"))
    return outcomes.stored_totals(e)
