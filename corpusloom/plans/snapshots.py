"""Queries of reviewed reference records and stored snapshots, with the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import assembly, evidence, extraction, reference
from .cases import _ROUTED, _routed
from ..streaming import incremental
from .registry import query

_DIMS = ["priority", "state"]


def _records(t):
    """Orders as reviewed records: a cell of items for two dimensions, some of them unstated."""
    k = F.col("o_orderkey")
    return t("orders").select(k.alias("record"), reference.stated_items(F.array(F.when(k % 5 == 0, " Unknown ").otherwise(F.col("o_orderpriority")))).alias("priority"), reference.stated_items(F.array(F.col("o_orderstatus"), F.when(k % 2 == 0, " Twice"), F.when(k % 2 == 0, "twice"))).alias("state"))


_LONG = "l AS (SELECT 'priority' AS field, CASE WHEN o_orderkey % 5 <> 0 THEN lower(o_orderpriority) END AS value, o_orderkey AS record FROM orders UNION ALL SELECT 'state', lower(o_orderstatus), o_orderkey FROM orders UNION ALL SELECT 'state', 'twice', o_orderkey FROM orders WHERE o_orderkey % 2 = 0)"


@query(f"WITH {_LONG} SELECT * FROM l")
def reference_records(t):
    return reference.dimension_records(_records(t), _DIMS, "record")


@query(f"WITH {_LONG} SELECT field, value, count(*) AS n FROM l GROUP BY field, value")
def reference_dimensions(t):
    return reference.dimension_counts(_records(t), _DIMS, "record")


@query("WITH r AS (SELECT CASE WHEN c_custkey % 4 = 0 THEN ' ' WHEN c_custkey % 4 = 1 THEN c_name WHEN c_custkey % 4 = 2 THEN 'Customer' END AS q, c_name AS t, CASE WHEN c_custkey % 3 = 0 THEN c_mktsegment END AS s FROM customer) SELECT count_if(coalesce(trim(q), '') <> '') AS records_with_quote, count_if(coalesce(trim(q), '') = '') AS records_without_quote, count_if(coalesce(trim(q), '') <> '' AND q = t) AS quotes_equal_to_saved_title, count_if(coalesce(trim(q), '') <> '' AND contains(t, q)) AS quotes_within_saved_title, count_if(s IS NOT NULL) AS records_with_summary, count_if(s IS NULL) AS records_without_summary FROM r")
def quote_presence(t):
    k = F.col("c_custkey")
    r = t("customer").select(F.when(k % 4 == 0, " ").when(k % 4 == 1, F.col("c_name")).when(k % 4 == 2, "Customer").alias("q"), F.col("c_name").alias("t"), F.when(k % 3 == 0, F.col("c_mktsegment")).alias("s"))
    return reference.quote_presence(r, "q", "t", "s")


@query("""
WITH c AS (SELECT o_orderkey AS doc_id, o_orderstatus AS scope_class, CASE WHEN o_custkey % 9 <> 0 THEN o_orderpriority END AS source, CASE WHEN o_orderkey % 3 = 0 THEN o_orderkey - 3 ELSE o_orderkey END AS whole, o_orderpriority AS p, o_custkey FROM orders WHERE o_orderkey % 7 <> 0),
s AS (SELECT scope_class, whole, min_by(coalesce(source, 'unknown'), doc_id) AS value FROM c GROUP BY scope_class, whole)
SELECT scope_class, 'cues' AS field, v AS value, count(*) AS n FROM (SELECT scope_class, unnest([p, 'c' || o_custkey % 3]) AS v FROM c) GROUP BY ALL UNION ALL SELECT scope_class, 'outcome', p, count(*) FROM c WHERE o_custkey % 2 = 0 GROUP BY ALL UNION ALL SELECT scope_class, 'source', value, count(*) FROM s GROUP BY ALL""")
def scope_comparison(t):
    """Two dimensions by scope, and sources counted once for each canonical document."""
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    cards = t("orders").select(k.alias("doc_id"), F.col("o_orderstatus").alias("scope_class"), F.when(c % 9 != 0, F.col("o_orderpriority")).alias("source_platform"), (k % 7 != 0).alias("automatically_valid"), F.array(F.col("o_orderpriority"), F.concat(F.lit("c"), (c % 3).cast("string"))).alias("cues"), F.when(c % 2 == 0, F.array("o_orderpriority")).alias("outcome"))
    canonical = t("orders").where("o_orderkey % 3 = 0").select(k.alias("doc_id"), (k - 3).alias("canonical_doc_id"))
    return reference.scope_comparison(cards, ["cues", "outcome"], canonical)


@query("SELECT 'provisional: ' || coalesce(CASE WHEN o_orderkey % 3 <> 0 THEN o_orderstatus END, 'unstated asset') || ' / ' || coalesce(CASE WHEN o_orderkey % 4 <> 0 THEN o_orderpriority END, 'unstated outcome') AS label, count(*) AS n FROM orders WHERE o_custkey % 2 = 0 GROUP BY ALL")
def provisional_groups(t):
    k = F.col("o_orderkey")
    return reference.provisional_groups(t("orders").select((F.col("o_custkey") % 2 == 0).alias("semantically_approved"), F.when(k % 3 != 0, F.col("o_orderstatus")).alias("asset"), F.when(k % 4 != 0, F.col("o_orderpriority")).alias("outcome")))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 3 <> 0 THEN o_orderpriority || ' (' || CASE WHEN o_orderkey % 2 = 0 THEN o_orderstatus ELSE 'stored' END || ')' END AS shown FROM orders")
def card_values(t):
    k = F.col("o_orderkey")
    return t("orders").select("o_orderkey", reference.shown_values(F.when(k % 3 == 1, F.col("o_orderpriority")).when(k % 3 == 2, F.col("o_orderpriority")).otherwise(""), F.when(k % 2 == 0, F.col("o_orderstatus")).otherwise("")).alias("shown"))


_ITEMS = """i AS (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 13 = 0 THEN NULL ELSE 'https://s.example/thread/' || o_custkey || '?utm_source=x' END AS url, CASE o_orderkey % 11 WHEN 0 THEN 'some <b>markup</b>' WHEN 1 THEN '  ' ELSE 'text of ' || o_custkey || CASE WHEN o_orderkey % 2 = 0 THEN ' changed' ELSE '' END END AS body, CASE WHEN o_orderkey % 7 = 0 THEN 'reply' ELSE 'original_post' END AS kind, CASE WHEN o_orderkey % 5 = 0 THEN 'other' ELSE CAST(o_custkey AS VARCHAR) END AS item FROM orders)"""


@query(f"""WITH {_ITEMS}, r AS (SELECT *, CASE WHEN url IS NULL THEN 'missing_field' WHEN kind <> 'original_post' THEN 'not_an_original_post' WHEN trim(body) = '' OR body LIKE '%<b>%' THEN 'not_plain_text' WHEN item = 'other' THEN 'item_id_mismatch' END AS refused FROM i)
SELECT k, refused, CASE WHEN url IS NOT NULL THEN 'forum-' || substr(sha1('forum|' || regexp_extract(url, '/thread/([0-9]+)', 1)), 1, 12) WHEN body IS NOT NULL THEN 'forum-' || substr(sha1('forum|' || sha1('|anon||' || sha256(body))), 1, 12) END AS doc_id, CASE WHEN c_custkey IS NULL THEN 'new' WHEN body = 'text of ' || c_custkey THEN 'present' ELSE 'changed' END AS state FROM r LEFT JOIN customer ON 'https://s.example/thread/' || c_custkey || '?utm_source=x' = url AND c_custkey % 2 = 0""")
def imported_posts(t):
    """Posts of an envelope: taken or refused and why, and new, present or changed against what is stored."""
    k, c = F.col("o_orderkey"), F.col("o_custkey").cast("string")
    url = lambda x: F.concat(F.lit("https://s.example/thread/"), x, F.lit("?utm_source=x"))
    body = F.when(k % 11 == 0, "some <b>markup</b>").when(k % 11 == 1, "  ").otherwise(F.concat(F.lit("text of "), c, F.when(k % 2 == 0, " changed").otherwise("")))
    items = t("orders").select(k.alias("k"), F.when(k % 13 != 0, url(c)).alias("source_url"), body.alias("raw_text"), F.when(k % 5 == 0, "other").otherwise(c).alias("source_item_id"), F.when(k % 7 == 0, "reply").otherwise("original_post").alias("text_kind"), F.lit(False).alias("replies_complete"))
    n = F.col("c_custkey").cast("string")
    stored = t("customer").where("c_custkey % 2 = 0").select(F.concat(F.lit("https://s.example/thread/"), n).alias("source_url_key"), F.sha2(F.concat(F.lit("text of "), n), 256).alias("raw_text_sha256"))
    got = reference.import_new(reference.envelope_documents(items, "forum"), stored)
    return got.select("k", "refused", "doc_id", "state")


@query("SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN 2 WHEN 1 THEN 3 ELSE 0 END AS n, CASE WHEN c_custkey % 4 IN (0, 1) THEN '{\"kind\":\"t1\",\"id\":' || c_custkey || '}' END AS first_child FROM customer")
def nested_listings(t):
    """Children of a listing, of a list of listings, and of what is none."""
    k = F.col("c_custkey").cast("string")
    child = F.concat(F.lit('{"kind":"t1","id":'), k, F.lit("}"))
    one = F.concat(F.lit('{"data":{"children":['), child, F.lit(',{"id":0}]}}'))
    payload = F.when(F.col("c_custkey") % 4 == 0, one).when(F.col("c_custkey") % 4 == 1, F.concat(F.lit(" ["), one, F.lit(',{"data":{}},{"data":{"children":[{"x":[1]}]}}]'))).when(F.col("c_custkey") % 4 == 2, '{"error":1}').otherwise("[]")
    got = t("customer").select("c_custkey", reference.flat_children(payload).alias("c"))
    return got.select("c_custkey", F.size("c").alias("n"), F.get("c", F.lit(0)).alias("first_child"))


_EXCERPT = r"substr(trim(regexp_replace(coalesce({}.text, ''), '[\s\x0b\x{{85}}\p{{Z}}]+', ' ', 'g')), 1, 160)"


@query(f"SELECT x.doc_id AS a, y.doc_id AS b, {_EXCERPT.format('x')} AS a_excerpt, {_EXCERPT.format('y')} AS b_excerpt, '' AS decision, '' AS note FROM documents x JOIN documents y ON y.doc_id = x.doc_id + 1")
def pair_sheet(t):
    """Each document beside its neighbour by id, for review."""
    d = t("documents")
    return assembly.pair_sheet(d.select(F.col("doc_id").alias("a"), (F.col("doc_id") + 1).alias("b")), d)


@query(f"WITH {_ROUTED} SELECT r.doc_id, {_EXCERPT.format('c')} AS excerpt, route, replace(labels, ',', '|') AS reasons, '' AS label FROM routed r JOIN conversations c ON c.conv_id || '-' || c.turn = r.doc_id")
def label_sheet(t):
    return assembly.label_sheet(_routed(t), t("conversations").select(F.concat_ws("-", "conv_id", "turn").alias("doc_id"), "text"))


@query("WITH v AS (SELECT o_orderkey AS case_id, o_custkey AS doc_id, CASE WHEN o_orderstatus = 'F' THEN 'valid' ELSE 'pending' END AS state FROM orders WHERE o_orderstatus = 'F' OR o_orderkey % 2 = 0), e AS (SELECT l_orderkey AS case_id, list_sort(list(DISTINCT 'e' || l_suppkey)) AS ids FROM lineitem GROUP BY l_orderkey) SELECT v.case_id, doc_id, state, coalesce(ids, []) AS evidence_ids FROM v LEFT JOIN e USING (case_id)")
def valid_and_pending(t):
    o = t("orders").select(F.col("o_orderkey").alias("case_id"), F.col("o_custkey").alias("doc_id"), "o_orderstatus")
    spans = t("lineitem").select(F.col("l_orderkey").alias("owner_id"), F.concat(F.lit("e"), F.col("l_suppkey").cast("string")).alias("evidence_id"))
    return assembly.with_pending(o.where("o_orderstatus = 'F'"), o.where("case_id % 2 = 0"), spans)


@query("SELECT e AS evidence_id, min_by(doc_id, (kind, doc_id)) AS doc_id, min(kind) AS owner_type FROM (SELECT 'e' || l_partkey AS e, l_orderkey AS doc_id, 'case' AS kind FROM lineitem UNION ALL SELECT 'e' || o_custkey, o_orderkey, 'decision' FROM orders) GROUP BY e")
def evidence_union(t):
    e = lambda c: F.concat(F.lit("e"), F.col(c).cast("string")).alias("evidence_id")
    return assembly.evidence_union(t("lineitem").select(e("l_partkey"), F.col("l_orderkey").alias("doc_id")), t("orders").select(e("o_custkey"), F.col("o_orderkey").alias("doc_id")))


@query("SELECT l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey AS item, CASE WHEN o_orderkey % 5 <> 0 THEN CASE o_orderstatus WHEN 'F' THEN 'core' WHEN 'O' THEN 'adjacent' ELSE 'out_of_scope' END END AS scope_class, CASE WHEN o_orderkey % 5 <> 0 THEN o_orderstatus IN ('F', 'O') END AS is_relevant FROM lineitem LEFT JOIN orders ON o_orderkey = l_orderkey")
def attached_relevance(t):
    scope = F.when(F.col("o_orderstatus") == "F", "core").when(F.col("o_orderstatus") == "O", "adjacent").otherwise("out_of_scope")
    decisions = t("orders").select(F.col("o_orderkey").alias("doc_id"), scope.alias("scope_class"), F.when(F.col("o_orderkey") % 5 == 0, "timeout").otherwise("ok").alias("technical_state"))
    rows = t("lineitem").select(F.col("l_orderkey").alias("doc_id"), F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("item"))
    return assembly.attach_relevance(rows, decisions).select("item", "scope_class", "is_relevant")


@query("SELECT count(*) AS candidates, count_if(b) AS blocked, count_if(NOT b) AS attempted, count_if(NOT b AND c) AS cache_hits, count_if(NOT b AND NOT c) AS cache_misses, sum(CASE WHEN NOT b THEN v ELSE 0 END) AS valid_cases, count_if(NOT b AND s <> 'ok') AS failed_candidates FROM (SELECT o_orderkey % 4 = 0 AS b, o_custkey % 3 = 0 AS c, o_orderkey % 3 AS v, CASE WHEN o_orderstatus = 'P' THEN 'timeout' ELSE 'ok' END AS s FROM orders)")
def run_totals(t):
    k = F.col("o_orderkey")
    return assembly.run_totals(t("orders").select((k % 4 == 0).alias("blocked"), (F.col("o_custkey") % 3 == 0).alias("from_cache"), (k % 3).alias("n_valid"), F.when(F.col("o_orderstatus") == "P", "timeout").otherwise("ok").alias("state")))


@query("SELECT o_orderkey, o_orderstatus FROM orders")
def complete_gold(t):
    """Rows of a gold file, each complete; a test shows that one that is not ends the job."""
    return assembly.complete_or_raise(t("orders").select("o_orderkey", "o_orderstatus"), ["o_orderstatus"], "o_orderkey")


@query("SELECT id, waited, row_number() OVER (ORDER BY NOT waited, id) <= 50 AS taken FROM (SELECT c_custkey AS id, c_custkey % 7 = 0 AS waited FROM customer WHERE c_custkey % 7 = 0 OR c_custkey % 2 = 0)")
def scheduled_batches(t):
    """The next 50 items, those that wait first, and what is carried over; that number is the operator's."""
    c = t("customer").select(F.col("c_custkey").alias("id"))
    return incremental.scheduled_batch(c.where("id % 7 = 0"), c.where("id % 2 = 0"), ["id"])


@query("SELECT o_orderkey || 'r' AS item_id, CASE WHEN o_orderkey % 3 <> 2 THEN o_orderkey END AS doc_id FROM orders WHERE o_orderkey % 3 <> 2")
def aliased_reviews(t):
    """Reviews whose target names a document, or an alias of one."""
    k = F.col("o_orderkey").cast("string")
    o = t("orders")
    reviews = o.select(F.concat(k, F.lit("r")).alias("item_id"), F.when(F.col("o_orderkey") % 3 == 0, F.concat(k, F.lit("#c01"))).otherwise(F.concat(F.lit("alias-"), k)).alias("target_id"))
    aliases = o.where("o_orderkey % 3 = 1").select(F.concat(F.lit("alias-"), k).alias("alias"), k.alias("doc_id"))
    return assembly.review_targets(reviews, o.select(k.alias("doc_id")), aliases).select("item_id", F.col("doc_id").cast("long").alias("doc_id"))


@query("""SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN '{"a": ' || c_custkey || '}' WHEN 1 THEN '{"a": [' || c_custkey || ', 2]}' END AS fixed FROM customer""")
def repaired_answers(t):
    """Model answers with fences, curly quotes and trailing commas; what still does not parse is null."""
    k = F.col("c_custkey").cast("string")
    raw = F.when(F.col("c_custkey") % 3 == 0, F.concat(F.lit('```json\n{"a": '), k, F.lit("}\n```"))).when(F.col("c_custkey") % 3 == 1, F.concat(F.lit("{\u201ca\u201d: ["), k, F.lit(", 2,],}"))).otherwise("{broken")
    return t("customer").select("c_custkey", extraction.repaired(raw).alias("fixed"))


@query("SELECT l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey AS case_id, array_to_string(list_filter([CASE WHEN l_linenumber = 2 THEN 'other_document' END, CASE WHEN l_returnflag <> o_orderstatus THEN 'other_scope' END, CASE WHEN o_custkey % 3 = 0 THEN 'decision_not_valid' END], lambda x: x IS NOT NULL), ',') AS errors FROM lineitem JOIN orders ON o_orderkey = l_orderkey")
def scope_inheritance(t):
    """Cases against the decision that they take their scope from."""
    both = t("lineitem").join(t("orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    state = F.when(F.col("o_custkey") % 3 == 0, "pending").otherwise("valid")
    errors = evidence.inheritance_errors(F.col("l_orderkey"), F.col("l_returnflag"), F.when(F.col("l_linenumber") == 2, -1).otherwise(F.col("o_orderkey")), F.col("o_orderstatus"), state)
    return both.select(F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("case_id"), F.array_join(errors, ",").alias("errors"))


@query("SELECT o_orderkey AS case_id, unnest(['e' || o_custkey, 'x']) AS evidence_id FROM orders WHERE o_orderstatus = 'F'")
def analysis_evidence(t):
    """Evidence of the valid records alone, each through the gate."""
    k = F.col("o_orderkey")
    rows = t("orders").select(k.alias("case_id"), F.when(F.col("o_orderstatus") == "F", "valid").otherwise("pending").alias("validation_state"), F.array(F.concat(F.lit("e"), F.col("o_custkey").cast("string")), F.lit("x")).alias("evidence_ids"), F.when(F.col("o_orderstatus") != "F", F.array(F.lit("no evidence"))).otherwise(F.array().cast("array<string>")).alias("errors"))
    return evidence.gate_for_analysis(evidence.valid_only(rows), "case_id", F.col("errors"))


@query("SELECT doc_id, length(text) // 2 AS start FROM documents WHERE text IS NOT NULL")
def exact_spans(t):
    """Quotes from the middle of each text, held to their places."""
    at = F.floor(F.length("text") / 2).cast("int")
    d = t("documents").where("text is not null").select("doc_id", "text", at.alias("start"), F.least(at + 7, F.length("text")).alias("stop"))
    d = d.withColumn("quote", F.expr("substring(text, start + 1, stop - start)"))
    return evidence.exact_spans(d).select("doc_id", F.col("start").cast("long").alias("start"))


@query("SELECT DISTINCT user_id AS doc_id, props FROM events a WHERE event_id % 2 = 1 AND user_id % 5 <> 0 AND event_type <> 'error' AND NOT EXISTS (SELECT 1 FROM events b WHERE b.event_id % 2 = 0 AND b.user_id = a.user_id AND b.props = a.props)")
def new_items(t):
    """Arrivals that are new in this form, of no frozen document, and not blank."""
    e = t("events").select("event_id", F.col("user_id").alias("doc_id"), "props", F.when(F.col("event_type") != "error", F.col("event_type")).otherwise(" ").alias("text"))
    got = incremental.eligible_new(e.where("event_id % 2 = 1"), e.where("event_id % 2 = 0"), e.where("doc_id % 5 = 0"), ["doc_id", "props"])
    return got.select("doc_id", "props")
