"""Queries of saved runs held against gold, with the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import assembly, evaluation, evidence, saved_run
from .cases import duck, rel
from .registry import query

GOLD = "SELECT doc_id, CASE WHEN quality = 1 AND doc_id % 3 = 0 THEN 'adjacent' WHEN quality = 1 THEN 'core' ELSE 'out_of_scope' END AS scope_class, doc_id % 4 <> 0 AS should_pass FROM {labels}"
SAID = "SELECT doc_id, CASE WHEN doc_id % 11 = 0 THEN 'provider_failed' ELSE 'ok' END AS technical_state, CASE WHEN doc_id % 13 <> 1 THEN doc_id % 5 <> 0 END AS passed, CASE WHEN length(text) % 7 = 0 THEN 'out_of_scope' WHEN doc_id % 2 = 0 THEN 'core' ELSE 'adjacent' END AS scope_class FROM {documents} WHERE doc_id % 17 <> 0"
EVENTS = """SELECT event_id AS target_id, CASE WHEN event_id % 5 = 0 THEN 'normalize' WHEN event_id % 2 = 0 THEN 'extract' END AS stage, CASE event_id % 3 WHEN 0 THEN 'failed' WHEN 1 THEN 'succeeded' ELSE 'skipped' END AS status, CASE WHEN event_id % 4 = 0 THEN 'evidence_validation_failed' END AS reason_code, CAST(event_id % 6 AS INT) AS case_count,
 CASE WHEN event_id % 19 = 0 THEN 'out_of_scope' END AS skip_cause, CASE WHEN event_id % 7 = 0 THEN 'json_validate_failed' END AS error_code, CASE WHEN event_id % 9 = 0 THEN 'invalid' WHEN event_id % 9 = 3 THEN 'valid' END AS output_state FROM {events}"""
GOLD_CASES = "SELECT o_orderkey AS gold_id, o_custkey AS doc_id FROM {orders} WHERE o_orderkey % 2 = 0"
CASES = "SELECT o_orderkey AS case_id, o_custkey AS doc_id FROM {orders} WHERE o_orderkey % 3 = 0"
MATCHES = "SELECT o_orderkey AS gold_id, o_orderkey AS case_id FROM {orders} WHERE o_orderkey % 12 = 0"
SPANS = "SELECT l_quantity > 5 AS valid FROM {lineitem}"
ALL = dict(gold=GOLD, said=SAID, events_=EVENTS, gold_cases=GOLD_CASES, cases=CASES, matches=MATCHES)

_JUDGED = """j AS (SELECT g.doc_id, g.scope_class, should_pass, s.scope_class AS found, technical_state, coalesce(passed, false) AS passed, g.scope_class IN ('core', 'adjacent') AS is_, coalesce(passed AND s.scope_class IN ('core', 'adjacent'), false) AS said_ FROM gold g LEFT JOIN said s USING (doc_id)),
k AS (SELECT * FROM j WHERE technical_state = 'ok'),
e AS (SELECT *, status = 'failed' AS failed, status = 'failed' AND (coalesce(error_code = 'json_validate_failed', false) OR coalesce(output_state = 'invalid', false)) AS schema_ FROM events_ WHERE (stage IS NULL OR stage = 'extract') AND status <> 'skipped' AND coalesce(skip_cause, '') <> 'out_of_scope'),
f AS (SELECT 'prefilter_false_drop' AS category, doc_id::VARCHAR AS target FROM k WHERE should_pass AND NOT passed UNION ALL SELECT 'relevance_false_positive', doc_id::VARCHAR FROM k WHERE said_ AND NOT is_ UNION ALL SELECT 'relevance_false_negative', doc_id::VARCHAR FROM k WHERE is_ AND NOT said_
 UNION ALL SELECT 'scope_boundary_disagreement', doc_id || ': gold ' || scope_class || ', predicted ' || found FROM k WHERE is_ AND said_ AND scope_class <> found UNION ALL SELECT 'provider_schema_rejection', target_id::VARCHAR FROM e WHERE schema_ UNION ALL SELECT 'evidence_span_rejection', target_id::VARCHAR FROM e WHERE failed AND NOT schema_ AND reason_code = 'evidence_validation_failed'
 UNION ALL SELECT 'accepted_empty_extraction', target_id::VARCHAR FROM e WHERE status = 'succeeded' AND case_count = 0 UNION ALL SELECT 'other_extraction_failure', target_id::VARCHAR FROM e WHERE failed AND NOT schema_ AND reason_code IS DISTINCT FROM 'evidence_validation_failed'
 UNION ALL SELECT 'unmatched_gold_case', gold_id::VARCHAR FROM gold_cases WHERE gold_id NOT IN (SELECT gold_id FROM matches) UNION ALL SELECT 'unmatched_model_case', case_id::VARCHAR FROM cases WHERE case_id NOT IN (SELECT case_id FROM matches))"""


def _failures(t):
    return saved_run.failures(*(rel(t, sql) for sql in ALL.values()))


@query(f"{duck(**ALL)}, {_JUDGED} SELECT category, target FROM f")
def run_failures(t):
    """Every failure of a run, in ten categories."""
    return _failures(t)


@query(f"{duck(**ALL)}, {_JUDGED}, c AS (SELECT i + 1 AS position, name FROM (SELECT unnest(range(0, 10)) AS i, unnest({list(saved_run.CATEGORIES)}) AS name)) SELECT position::INTEGER AS position, name AS category, (SELECT count(*) FROM f WHERE f.category = name) AS n FROM c")
def run_ledger(t):
    return saved_run.ledger(_failures(t))


_METRICS = """o AS (SELECT count(*) AS documents, count(technical_state) AS predicted, count_if(technical_state <> 'ok') AS excluded FROM j),
c AS (SELECT count_if(is_ AND said_) AS tp, count_if(NOT is_ AND said_) AS fp, count_if(is_ AND NOT said_) AS fn, count_if(should_pass) AS s, count_if(should_pass AND passed) AS p FROM k),
h AS (SELECT (SELECT count(*) FROM gold_cases WHERE doc_id IN (SELECT doc_id FROM gold)) AS g, (SELECT count(*) FROM cases WHERE doc_id IN (SELECT doc_id FROM gold)) AS m, (SELECT count(*) FROM gold_cases WHERE doc_id IN (SELECT doc_id FROM gold) AND gold_id IN (SELECT gold_id FROM matches)) AS gm, (SELECT count(*) FROM cases WHERE doc_id IN (SELECT doc_id FROM gold) AND case_id IN (SELECT case_id FROM matches)) AS mm),
v AS (SELECT count(*) AS n, count_if(valid) AS good FROM spans),
r AS (SELECT 'documents' AS metric, documents::DOUBLE AS value FROM o UNION ALL SELECT 'predicted_documents', predicted FROM o UNION ALL SELECT 'excluded_technical_failures', excluded FROM o UNION ALL SELECT 'gold_cases', g FROM h UNION ALL SELECT 'model_cases', m FROM h UNION ALL SELECT 'matched_gold_cases', gm FROM h UNION ALL SELECT 'matched_model_cases', mm FROM h
 UNION ALL SELECT 'prefilter_recall', p / nullif(s, 0) FROM c UNION ALL SELECT 'precision', tp / nullif(tp + fp, 0) FROM c UNION ALL SELECT 'recall', tp / nullif(tp + fn, 0) FROM c UNION ALL SELECT 'f1', 2 * tp / nullif(2 * tp + fp + fn, 0) FROM c UNION ALL SELECT 'prediction_coverage', predicted / nullif(documents, 0) FROM o UNION ALL SELECT 'gold_case_coverage', gm / nullif(g, 0) FROM h UNION ALL SELECT 'span_validation_rate', good / nullif(n, 0) FROM v)"""


@query(f"{duck(**ALL, spans=SPANS)}, {_JUDGED}, {_METRICS} SELECT metric, value, CASE metric WHEN 'prefilter_recall' THEN coalesce(value >= 0.9, false) WHEN 'precision' THEN coalesce(value >= 0.85, false) WHEN 'recall' THEN coalesce(value >= 0.8, false) END AS passed FROM r")
def gold_report(t):
    """All counts and rates of a split with their gates."""
    gold, said, _, gold_cases, cases, matches = (rel(t, sql) for sql in ALL.values())
    return saved_run.report(gold, said, gold_cases, cases, matches, rel(t, SPANS))


SHEET = "SELECT doc_id, CASE WHEN quality = 1 AND doc_id % 3 = 0 THEN 'adjacent' WHEN quality = 1 THEN 'core' ELSE 'out_of_scope' END AS scope, CONCAT('r', CAST(toxic AS STRING)) AS reason FROM {labels}"
DEALT = "SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'holdout' ELSE 'development' END AS split FROM {labels}"
DECIDED = "SELECT doc_id, CASE WHEN doc_id % 11 = 0 THEN 'provider_failed' ELSE 'ok' END AS state, CASE WHEN doc_id % 5 = 0 THEN 'core' WHEN doc_id % 5 = 1 THEN 'adjacent' ELSE 'out_of_scope' END AS scope, CASE WHEN doc_id % 2 = 0 THEN 'r0' ELSE 'r1' END AS reason FROM {labels} WHERE doc_id % 7 <> 0"
_SCOPED = "s AS (SELECT doc_id, l.scope AS gold, l.reason AS gold_reason, CASE WHEN state = 'ok' THEN d.scope END AS pred, CASE WHEN state = 'ok' THEN d.reason END AS pred_reason FROM dealt JOIN sheet l USING (doc_id) LEFT JOIN decided d USING (doc_id) WHERE split = 'development')"


def _scoped(t):
    return saved_run.scoped_rows(rel(t, DEALT), rel(t, SHEET), rel(t, DECIDED), "development")


@query(f"""{duck(sheet=SHEET, dealt=DEALT, decided=DECIDED)}, {_SCOPED}, c AS (SELECT count(*) AS n, count_if(pred IS NULL) AS abstained, count_if(gold = pred) AS correct, {', '.join(f"count_if(gold = '{c}' AND pred = '{c}') AS tp_{c}, count_if(pred = '{c}') AS p_{c}, count_if(gold = '{c}') AS g_{c}" for c in ('core', 'adjacent', 'out_of_scope'))},
 count_if(gold <> 'out_of_scope' AND coalesce(pred <> 'out_of_scope', false)) AS tp, count_if(gold = 'out_of_scope' AND coalesce(pred <> 'out_of_scope', false)) AS fp, count_if(gold <> 'out_of_scope' AND NOT coalesce(pred <> 'out_of_scope', false)) AS fn FROM s),
x AS (SELECT *, {', '.join(f"round(coalesce(tp_{c} / nullif(p_{c}, 0), 0), 6) AS precision_{c}, round(coalesce(tp_{c} / nullif(g_{c}, 0), 0), 6) AS recall_{c}" for c in ('core', 'adjacent', 'out_of_scope'))} FROM c)
SELECT n, abstained, round(coalesce(correct / nullif(n, 0), 0), 6) AS accuracy, {', '.join(f"precision_{c}, recall_{c}" for c in ('core', 'adjacent', 'out_of_scope'))}, round((precision_core + precision_adjacent + precision_out_of_scope) / 3, 6) AS macro_precision, round((recall_core + recall_adjacent + recall_out_of_scope) / 3, 6) AS macro_recall,
 round(coalesce(tp / nullif(tp + fp, 0), 0), 6) AS binary_precision, round(coalesce(tp / nullif(tp + fn, 0), 0), 6) AS binary_recall FROM x""")
def scoped_scores(t):
    """Three-way scores of one split, its coverage proved while reading."""
    return assembly.three_way_scores(_scoped(t), "gold", "pred", ["core", "adjacent", "out_of_scope"], ["core", "adjacent"])


@query(f"{duck(sheet=SHEET, dealt=DEALT, decided=DECIDED)}, {_SCOPED} SELECT count(*) AS documents, count_if(gold = pred) AS scope_agreement, count_if(gold_reason = pred_reason) AS reason_agreement, count_if(pred IS NULL) AS abstained FROM s")
def agreement_summary(t):
    return saved_run.agreement_summary(_scoped(t))


@query("SELECT o_orderkey AS k, o_orderstatus AS s, o_totalprice AS price FROM orders")
def covered_run(t):
    """Orders joined to what the lines say of them: each order must be there once on both sides."""
    saved = t("lineitem").select(F.col("l_orderkey").alias("k")).union(t("orders").select("o_orderkey")).groupBy("k").agg(F.count("*").alias("n"))
    return saved_run.covered(t("orders").select(F.col("o_orderkey").alias("k"), F.col("o_orderstatus").alias("s")), saved.join(t("orders").select(F.col("o_orderkey").alias("k"), F.col("o_totalprice").alias("price")), "k").drop("n"), "k")


# -- the ladder of quotes ---------------------------------------------------------------------------

_SAYS = "CONCAT('Order ', CAST(o_orderkey AS STRING), ' was', {nl}, '  sent by ', o_orderpriority, '. Order again.')"
_STARTS = "instr(x, 'sent by') - 1"


@query(f"""WITH x AS (SELECT o_orderkey AS k, {_SAYS.format(nl='chr(10)')} AS x FROM orders), s AS (SELECT k, x, k % 8 AS c, {_STARTS} AS p, instr(x, 'was') - 1 AS was, instr(x, 'Order again') - 1 AS again FROM x),
r AS (SELECT *, CASE c WHEN 2 THEN CASE WHEN k % 16 = 2 THEN 0 ELSE again END WHEN 4 THEN was WHEN 7 THEN was WHEN 3 THEN NULL WHEN 5 THEN NULL ELSE p END AS final_start FROM s),
e AS (SELECT *, CASE WHEN c IN (4, 7) THEN p + 7 WHEN c = 2 THEN final_start + 5 WHEN c IN (0, 1, 6) THEN p + 7 END AS final_stop, CASE c WHEN 0 THEN 'supplied_exact' WHEN 1 THEN 'repaired_unique' WHEN 2 THEN 'repaired_nearest' WHEN 3 THEN 'ambiguous_tied' WHEN 4 THEN 'repaired_whitespace' WHEN 5 THEN 'missing_unresolved' WHEN 6 THEN 'supplied_exact' ELSE 'repaired_whitespace' END AS offset_state FROM r),
q AS (SELECT *, CASE WHEN final_start IS NOT NULL THEN substr(x, final_start + 1, final_stop - final_start) WHEN c = 3 THEN 'Order' ELSE 'not there' END AS final_quote FROM e)
SELECT k, final_start::INTEGER AS final_start, final_stop::INTEGER AS final_stop, final_quote, offset_state, CASE WHEN c IN (3, 5) THEN 'rejected' WHEN c IN (6, 7) THEN 'rejected_redacted' ELSE 'valid' END AS validation_state,
 EVID AS evidence_id FROM q""".replace("EVID", "substr(sha1(concat_ws('|', k::VARCHAR, 'trigger', final_start::VARCHAR, final_stop::VARCHAR, sha1(final_quote))), 1, 12)"))
def offset_states(t):
    """Quotes that reach every rung, two of them over masked text; repaired ones have the text's own words and a new id."""
    k, x = F.col("k"), F.col("x")
    rows = rel(t, f"SELECT o_orderkey AS k, {_SAYS.format(nl='char(10)')} AS x FROM {{orders}}")
    at, c = F.instr(x, "sent by") - 1, k % 8
    quote = F.when(c.isin(0, 1, 6), "sent by").when(c.isin(2, 3), "Order").when(c.isin(4, 7), "was sent by").otherwise("not there")
    start = F.when(c.isin(0, 6), at).when(c == 1, at + 3).when(k % 16 == 2, 3).when(c == 2, 1000)
    masked = F.when(c.isin(6, 7), F.array(F.struct((at + 2).alias("start"), (at + 4).alias("stop")))).otherwise(F.array().cast("array<struct<start:int,stop:int>>"))
    spans = rows.select("k", x.alias("raw_text"), quote.alias("quote"), start.cast("int").alias("start"), (start + F.length(quote)).cast("int").alias("stop"), masked.alias("redaction_spans"), F.lit("trigger").alias("field"))
    return evidence.settled_spans(evidence.ladder(spans), "k", "field").select("k", "final_start", "final_stop", "final_quote", "offset_state", "validation_state", "evidence_id")


@query("SELECT doc_id::VARCHAR AS doc_id, 'core' AS seat FROM (SELECT p_partkey AS doc_id FROM part WHERE p_partkey % 3 = 0 AND p_partkey % 5 <> 0 AND p_partkey NOT IN (1, 2, 3) ORDER BY p_partkey::VARCHAR LIMIT 40) UNION ALL SELECT doc_id::VARCHAR, 'adjacent' FROM (SELECT p_partkey AS doc_id FROM part WHERE p_partkey % 3 <> 0 AND p_partkey % 5 <> 0 AND p_partkey NOT IN (1, 2, 3) ORDER BY p_partkey::VARCHAR LIMIT 28) UNION ALL SELECT unnest(['1', '2']), 'adjacent'")
def pilot_seats(t):
    """Forty core and thirty adjacent seats, two of them given by name; the numbers are the operator's."""
    k = F.col("p_partkey")
    scope = F.when(k % 3 == 0, evaluation.CORE).otherwise(evaluation.ADJACENT)
    rows = t("part").select(k.cast("string").alias("doc_id"), (k % 5 != 0).alias("eligible"), scope.alias("scope_class"), F.lit("human").alias("decided_by"), F.lit("valid").alias("validation_state"))
    return evaluation.pilot_seats(rows, t("part").select(k.cast("string").alias("doc_id"), scope.alias("scope_class")), ["1", "2"], ["3"], 40, 30)
