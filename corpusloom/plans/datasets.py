"""Queries of assembled datasets and of posts read from saved pages, with the SQL that gives the same rows."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F
from pyspark.sql import Window

from ..operators import dataset
from ..session import scratch_folder, settled
from ..sources import datasets as folders
from ..sources import posts, walks
from ..streaming import threads
from .registry import query


def _scratch(t, name: str) -> str:
    """A new folder for what a query writes and reads back."""
    return f"{scratch_folder(t('region').sparkSession)}/{name}-{uuid.uuid4().hex}"


# -- a dataset of eleven relations ------------------------------------------------------------------


def _relations(t) -> dict:
    """Relations that follow from documents and labels; every rule of the cards meets rows that fit and rows that don't."""
    k, x = F.col("k"), F.col("x")
    b = t("documents").select(F.col("doc_id").alias("k"), F.col("doc_id").cast("string").alias("doc_id"), F.coalesce("text", F.lit("")).alias("x"), "source")
    two = b.select("*", F.explode(F.array(F.lit(0), F.lit(1))).alias("i"))
    case = lambda i: F.concat(F.lit("c"), "doc_id", F.lit("-"), F.lit(i).cast("string") if isinstance(i, int) else i.cast("string"))

    def span(field, start, quote):
        return F.struct(F.lit(field).alias("field"), F.lit(start).alias("start"), (F.lit(start) + F.length(quote)).alias("stop"), quote.alias("quote"))

    start, cut = F.lit(5) + F.col("i") * 10, F.substring(x, F.lit(6) + F.col("i") * 10, F.lit(12))
    quote = F.when((k % 9 == 0) & (F.col("i") == 1), "altered").otherwise(cut)
    labels = t("labels").select(F.col("doc_id").alias("k"), F.col("doc_id").cast("string").alias("doc_id"), "quality", "toxic")
    return {
        "documents": b.select("doc_id", F.col("source").alias("source_platform"), F.when(k % 2 == 0, "post").otherwise("comment").alias("source_type"), F.concat(F.lit("n"), (k % 5).cast("string")).alias("source_name"), F.concat(F.lit("https://s.example/"), "doc_id").alias("source_url"),
                              F.when(k % 3 == 0, F.concat(F.lit("https://c.example/"), "doc_id")).alias("canonical_url"), F.when(k % 4 != 0, F.concat(F.lit("a"), (k % 97).cast("string"))).alias("author_key"), (k % 10 < 8).alias("development"), (k % 10 == 9).alias("holdout")),
        "audits": b.where(k % 12 != 0).select("doc_id", x.alias("audit")),
        "links": b.where((k % 8 == 0) & (k > 0)).select("doc_id", (k - 8).cast("string").alias("canonical_doc_id"), F.when(k % 24 == 0, "pending_review").otherwise("auto_confirmed").alias("review_state")),
        "labels": labels.select("doc_id", F.when(F.col("quality") == 1, "core").otherwise("out_of_scope").alias("human_scope"), F.concat(F.lit("r"), F.col("toxic").cast("string")).alias("human_reason")),
        "relevance": b.where(k % 2 == 0).select("doc_id", F.when(k % 6 == 0, "out_of_scope").otherwise("adjacent").alias("scope_class"), F.lit("q").alias("reason_code"), F.when(k % 10 == 4, "provider_failed").otherwise("ok").alias("technical_state"), F.when(k % 4 == 0, "valid").otherwise("invalid").alias("validation_state"),
                                                F.array(span("relevance", 3, F.when(k % 14 == 0, "made up").otherwise(F.substring(x, 4, 20)))).alias("evidence")),
        "reviews": labels.where("toxic = 1").select("doc_id", F.when(k % 2 == 0, case(0)).alias("case_id"), F.when(k % 3 == 0, "closed").otherwise("open").alias("state")),
        "inputs": b.where(k % 3 != 2).select("doc_id", F.when(k % 7 == 0, "provider_failed").otherwise("ok").alias("technical_state"), F.lit("core").alias("scope_class")),
        "failures": b.where(k % 21 == 0).select("doc_id", F.lit("timeout").alias("diagnostic")),
        "candidates": b.where(k % 7 == 0).select("doc_id", case(0).alias("case_id"), F.lit("candidate").alias("problem_summary"), F.array(span("trigger", 10, F.substring(x, 11, 25)), span("severity", 0, F.lit("n\x01pe"))).alias("evidence")),
        "cases": two.where(k % 3 == 0).select("doc_id", case(F.col("i")).alias("case_id"), F.when((k + F.col("i")) % 5 == 0, "invalid").otherwise("valid").alias("validation_state"), F.lit("core").alias("scope_class"), F.concat(F.lit("sum "), "doc_id").alias("problem_summary")),
        "spans": two.where(k % 3 == 0).select("doc_id", case(F.col("i")).alias("case_id"), F.lit("problem_summary").alias("field"), start.alias("start"), (start + F.length(quote)).alias("stop"), quote.alias("quote"), F.when(k % 15 == 0, "rejected").otherwise("valid").alias("state")),
        "corrections": b.where((k % 3 == 0) & (k % 5 < 3)).select("doc_id", case(0).alias("case_id"), F.when(k % 2 == 0, "semantic_approval").otherwise("severity").alias("field")),
        "findings": b.where(k % 33 == 0).select("doc_id", F.lit(None).cast("string").alias("case_id"), F.lit("x").alias("code")).union(b.where(k % 27 == 0).select("doc_id", case(0), F.lit("y"))),
    }


_DATA = r"""b AS (SELECT doc_id AS k, doc_id::VARCHAR AS d, coalesce(text, '') AS x, source, doc_id % 10 < 8 AS used FROM documents),
l AS (SELECT doc_id AS k, CASE WHEN quality = 1 THEN 'core' ELSE 'out_of_scope' END AS human, 'r' || toxic AS reason, toxic = 1 AND doc_id % 3 <> 0 AS opened FROM labels),
raw AS (
  SELECT k, i, 'cases' AS rel, 'c' || d || '-' || i AS own, CASE WHEN k % 15 = 0 THEN [] ELSE [{'field': 'problem_summary', 'start': 5 + i * 10, 'quote': CASE WHEN k % 9 = 0 AND i = 1 THEN 'altered' ELSE substr(x, 6 + i * 10, 12) END}] END AS claimed, '' AS state, (k + i) % 5 <> 0 AS fits, 'core' AS scope, 'sum ' || d AS summary FROM b, range(0, 2) r(i) WHERE k % 3 = 0
  UNION ALL SELECT k, 0, 'inputs', CASE WHEN k % 7 = 0 THEN 'c' || d || '-0' END, CASE WHEN k % 7 = 0 THEN [{'field': 'trigger', 'start': 10, 'quote': substr(x, 11, 25)}, {'field': 'severity', 'start': 0, 'quote': 'n' || chr(1) || 'pe'}] ELSE [] END, CASE WHEN k % 7 = 0 THEN 'provider_failed' ELSE 'ok' END, false, 'core', CASE WHEN k % 7 = 0 THEN 'candidate' ELSE '' END FROM b WHERE k % 3 <> 2 AND NOT (k % 3 = 0 AND k % 7 <> 0)
  UNION ALL SELECT k, 0, 'relevance', NULL, [{'field': 'relevance', 'start': 3, 'quote': CASE WHEN k % 14 = 0 THEN 'made up' ELSE substr(x, 4, 20) END}], CASE WHEN k % 10 = 4 THEN 'provider_failed' ELSE 'ok' END, k % 4 = 0, CASE WHEN k % 6 = 0 THEN 'out_of_scope' ELSE 'adjacent' END, '' FROM b WHERE k % 2 = 0),
a AS (SELECT raw.*, d, source, human, reason, coalesce(opened, false) AS opened, CASE WHEN k % 12 <> 0 THEN x ELSE '' END AS t FROM raw JOIN b USING (k) LEFT JOIN l USING (k) WHERE used),
g AS (SELECT *, list_sort(list_filter(claimed, lambda s: s.quote <> '' AND substr(t, s.start + 1, length(s.quote)) = s.quote)) AS good FROM a),
w AS (SELECT *, greatest(0, coalesce(list_min(list_transform(good, lambda s: s.start)), 0) - 160) AS o, least(length(t), coalesce(list_max(list_transform(good, lambda s: s.start + length(s.quote))), 0) + 160) AS e, len(good) > 0 AS located,
  CASE WHEN rel = 'relevance' THEN 'relevance' WHEN rel = 'cases' AND fits AND len(good) > 0 THEN 'case' ELSE 'attempt' END AS card,
  (k % 33 = 0)::INT + (k % 27 = 0 AND coalesce(own = 'c' || d || '-0', false))::INT AS n_findings, k % 3 = 0 AND k % 5 < 3 AND k % 2 = 0 AND coalesce(own = 'c' || d || '-0', false) AS noted FROM g),
c AS (SELECT *, noted AND (card <> 'case' OR n_findings = 0) AS approved, opened AND (k % 2 <> 0 OR coalesce(own = 'c' || d || '-0', false)) AS in_review FROM w)"""


@query(rf"""WITH {_DATA} SELECT 'd1' AS dataset_id, 'run1' AS run_id, card, CASE WHEN card = 'attempt' THEN CASE WHEN rel = 'cases' THEN 'stored_case_without_matching_span' WHEN state = 'ok' THEN 'empty_response' ELSE 'failed' END END AS kind, d AS doc_id, own AS case_id,
  CASE WHEN k % 8 = 0 AND k > 0 AND k % 24 <> 0 THEN (k - 8)::VARCHAR ELSE d END AS canonical_doc_id, state AS technical_state, coalesce(source, '') AS source_platform, CASE WHEN k % 2 = 0 THEN 'post' ELSE 'comment' END AS source_type, 'n' || k % 5 AS source_name, 'https://s.example/' || d AS source_url,
  CASE WHEN k % 3 = 0 THEN 'https://c.example/' || d ELSE 'https://s.example/' || d END AS canonical_url, CASE WHEN k % 4 <> 0 THEN 'a' || k % 97 END AS author_key, CASE WHEN located THEN substr(t, o + 1, e - o) ELSE substr(t, 1, 480) END AS excerpt, (CASE WHEN located THEN o ELSE 0 END)::INT AS excerpt_start,
  CASE WHEN located THEN 'validated_span_window' ELSE 'capped_audit_not_a_validated_window' END AS excerpt_kind, array_to_string(list_transform(good, lambda s: concat(s.field, ':', s.start - o, ':', s.start + length(s.quote) - o, ':', s.quote)), '|') AS spans,
  CASE WHEN card = 'attempt' THEN array_to_string(list_sort(list_distinct(list_transform(list_filter(claimed, lambda s: NOT list_contains(good, s)), lambda s: s.quote))), '|') ELSE '' END AS rejected, coalesce(human, '') AS human_relevance_label, coalesce(reason, '') AS human_reason_code, scope AS model_scope_class,
  CASE WHEN rel <> 'relevance' AND k % 2 = 0 THEN CASE WHEN k % 6 = 0 THEN 'out_of_scope' ELSE 'adjacent' END ELSE '' END AS model_relevance_scope, summary AS problem_summary, CASE WHEN rel = 'inputs' AND k % 21 = 0 THEN 'timeout' ELSE '' END AS diagnostic, n_findings, CASE WHEN rel = 'relevance' THEN fits ELSE card = 'case' END AS automatically_valid,
  approved AS semantically_approved, approved AND card = 'case' AS enters_conclusions, CASE WHEN rel = 'relevance' THEN 'relevance decision only' WHEN approved THEN 'approved' WHEN in_review THEN 'in_review' WHEN n_findings > 0 THEN 'has_findings' WHEN card = 'case' THEN 'valid' ELSE 'unverified' END AS review_status FROM c""")
def dataset_cards(t):
    """Cards of cases, attempts and relevance decisions of one dataset, its relations dealt once."""
    got = dataset.cards(dataset.assembled(_relations(t)), "d1", "run1")
    spans = F.array_join(F.transform("spans", lambda s: F.concat_ws(":", s["field"], s["start"].cast("string"), s["stop"].cast("string"), s["quote"])), "|")
    return got.withColumns({"spans": spans, "rejected": F.array_join("rejected", "|")})


@query(rf"""WITH {_DATA}, m AS (SELECT *, coalesce(human, CASE WHEN k % 2 = 0 THEN CASE WHEN k % 6 = 0 THEN 'out_of_scope' ELSE 'adjacent' END END) AS scope FROM b LEFT JOIN l USING (k)) SELECT
  (SELECT count_if(used) FROM m) AS documents, (SELECT count_if(k % 10 = 9) FROM m) AS withheld_documents, (SELECT count_if(k % 10 = 8) FROM m) AS outside_policy_documents, (SELECT count_if(used AND human IS NOT NULL) FROM m) AS human_labeled_documents, (SELECT count_if(used AND human = 'out_of_scope') FROM m) AS human_labeled_out_of_scope,
  (SELECT count_if(used AND scope = 'out_of_scope') FROM m) AS excluded_documents, (SELECT count_if(used AND scope IS NULL) FROM m) AS undecided_documents, (SELECT count_if(used AND k % 7 = 0 AND (k % 3 <> 2 OR k % 21 = 0)) FROM m) AS failed_documents, (SELECT count_if(used AND k % 3 = 0) FROM m) AS documents_with_case,
  (SELECT count_if(used AND k % 8 = 0 AND k % 24 <> 0) FROM m) AS confirmed_duplicate_links, (SELECT count_if(used AND k > 0 AND k % 24 = 0) FROM m) AS pending_duplicate_links, (SELECT count_if(rel = 'relevance') FROM c) AS model_relevance_attempts, (SELECT count_if(rel = 'relevance' AND state = 'ok' AND c.scope = 'out_of_scope') FROM c) AS model_relevance_out_of_scope,
  (SELECT count_if(used AND k % 3 <> 2) FROM m) AS extraction_attempts, (SELECT count_if(used AND k % 3 <> 2 AND k % 7 <> 0) FROM m) AS successful_attempts, (SELECT count_if(used AND k % 3 <> 2 AND k % 7 = 0) FROM m) AS failed_attempts, (SELECT count_if(rel = 'inputs' AND state = 'ok') FROM c) AS empty_responses,
  (SELECT count_if(used AND k % 21 = 0) FROM m) AS extraction_failures, (SELECT count_if(rel = 'cases') FROM c) AS stored_cases, (SELECT count_if(card = 'case') FROM c) AS automatically_valid_cases, (SELECT count_if(rel = 'cases' AND card <> 'case') FROM c) AS cases_without_matching_span, (SELECT count_if(card = 'case' AND approved) FROM c) AS semantically_approved_cases,
  (SELECT count_if(used AND opened) FROM m) AS unresolved_review_items, (SELECT count_if(used AND k % 33 = 0) + count_if(used AND k % 27 = 0) FROM m) AS recorded_findings, (SELECT count_if(used AND k % 3 = 0 AND k % 5 < 3) FROM m) AS corrections,
  (SELECT count(DISTINCT CASE WHEN k % 8 = 0 AND k % 24 <> 0 THEN (k - 8)::VARCHAR ELSE d END) FROM m WHERE used) AS analysis_documents""")
def dataset_totals(t):
    """All counts of the dataset and of its snapshot, from one pass."""
    return dataset.dataset_counts(dataset.assembled(_relations(t)))


@query(rf"WITH {_DATA} SELECT 'extraction_by_state' AS name, CASE WHEN k % 7 = 0 THEN 'provider_failed' ELSE 'ok' END AS value, count(*) AS n FROM b WHERE used AND k % 3 <> 2 GROUP BY ALL UNION ALL SELECT 'model_relevance_by_scope', scope, count(*) FROM c WHERE rel = 'relevance' AND state = 'ok' GROUP BY ALL")
def dataset_states(t):
    return dataset.state_counts(dataset.assembled(_relations(t)))


# -- posts of saved pages ---------------------------------------------------------------------------


@query(r"""SELECT page_id, CASE WHEN k IN (0, 1) THEN 'T ' || page_id WHEN k = 4 THEN 'V ' || page_id END AS title, CASE WHEN k IN (0, 1, 4) THEN said END AS body_text, CASE WHEN k = 0 THEN 'Ann "A"' WHEN k = 4 THEN 'Zoë' END AS author_name,
  CASE WHEN k = 0 THEN '2024-01-02T03:04:05Z' WHEN k = 4 THEN strftime(make_timestamp((1700000000123 + page_id * 86400001) * 1000), '%Y-%m-%dT%H:%M:%S.%gZ') END AS published_at, CASE WHEN k IN (0, 1) THEN 'QAPage.mainEntity.text' WHEN k = 4 THEN 'thread_view[1][12]' END AS text_path,
  CASE WHEN k = 2 THEN 'ambiguous_original_post' WHEN k IN (3, 7) THEN 'no_verified_plain_original_post' WHEN k IN (5, 8) THEN 'thread_identity_mismatch' WHEN k = 6 THEN 'unsupported_thread_bootstrap' END AS failure FROM (SELECT page_id, page_id % 9 AS k, 'It''s "said" at \ ' || url || chr(10) || 'twice; 5 < 6.' AS said FROM pages)""")
def original_posts(t):
    """Every page with a question as structured data or as the forum's start value put before it, some of them unusable."""
    k, n = F.col("page_id") % 9, F.col("page_id").cast("string")
    said = F.concat(F.lit("It's \"said\" at \\ "), "url", F.lit("\ntwice; 5 < 6."))
    at = F.concat(F.lit("https://support.google.com/photos/thread/"), F.when(k == 8, F.concat(n, F.lit("1"))).otherwise(n), F.lit("/x?hl=en"))
    main = F.to_json(F.struct(F.lit("Question").alias("@type"), F.concat(F.lit("T "), n).alias("name"), F.when(k == 3, F.concat(said, F.lit(" <b>bold</b>"))).otherwise(said).alias("text"), F.when(k == 0, F.struct(F.lit('Ann "A"').alias("name"))).alias("author"), F.when(k == 1, "2024-01-02").otherwise("2024-01-02T03:04:05Z").alias("datePublished"), at.alias("url")))
    page = F.concat(F.lit('{"@type":["WebPage","QAPage"],"mainEntity":'), main, F.lit("}"))
    ld = lambda x: F.concat(F.lit('<script type="application/ld+json">'), x, F.lit("</script>"))
    nested = F.concat(F.lit('[{"headline":"no"},[{"@graph":['), page, F.lit("]}]]"))
    text = F.to_json(F.array(said))  # as JSON inside the literal
    view = F.concat(F.lit("[null,[[\""), n, F.lit('",'), (F.lit(1700000000123456) + F.col("page_id") * 86400001000).cast("string"), F.lit('],0,0,0,0,0,"u",0,"V '), n, F.lit('",0,0,0,'), F.substring(text, F.lit(2), F.length(text) - 2), F.lit(',0],null,[["Zo\\u00eb"],0,"u"]]'))
    view = F.when(k == 6, F.concat(F.lit('[1,[["'), n, F.lit('",2]]]'))).otherwise(view)
    literal = F.replace(F.replace(F.replace(view, F.lit("\\"), F.lit("\\\\")), F.lit("'"), F.lit("\\'")), F.lit('"'), F.lit("\\x22"))
    head = F.concat(F.lit("<html data-page-type='SUPPORT_FORUM_THREAD'><link rel='canonical' href='https://support.google.com/photos/thread/"), F.when(k == 5, F.concat(n, F.lit("7"))).otherwise(n), F.lit("'><script>var thread_view = '"), literal, F.lit("';</script>"))
    given = F.when(k.isin(0, 3, 8), ld(page)).when(k == 1, F.concat(ld(F.lit("{broken")), ld(nested))).when(k == 2, F.concat(ld(page), ld(page))).when(k.isin(4, 5, 6), head).otherwise("")
    got = posts.original_post(t("pages").select("page_id", n.alias("thread"), F.concat(given, F.coalesce("html", F.lit(""))).alias("html")), item="thread")
    return got.drop("thread", "html")


# -- pages, threads and folders ---------------------------------------------------------------------


@query("SELECT source, token, CASE WHEN i < 3 THEN 1 WHEN i < 8 THEN 2 ELSE 3 END AS run, (CASE WHEN i < 3 THEN i WHEN i < 8 THEN i - 3 ELSE i - 8 END)::INTEGER AS step FROM (SELECT conv_id::VARCHAR AS source, turn::VARCHAR AS token, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS i FROM conversations) WHERE i < 108")
def walked_pages(t):
    """Turns as pages that name the next one: walked three pages a source, then five, then a hundred, each from where the last stopped."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    pages = t("conversations").select(F.col("conv_id").cast("string").alias("source"), F.when(F.lag("turn").over(w).isNotNull(), F.col("turn").cast("string")).alias("token"), F.lead("turn").over(w).cast("string").alias("next_token"), F.col("turn").cast("string").alias("shown"))
    pages, points, out = settled(pages), None, None
    for run, budget in enumerate((3, 5, 100), 1):
        got = settled(walks.walk(pages, budget, points))
        part = got.select("source", F.col("shown").alias("token"), F.lit(run).alias("run"), "step")
        out = part if out is None else out.unionByName(part)
        points = settled(walks.next_points(got, points))
    return out


@query("WITH i AS (SELECT DISTINCT conv_id, turn FROM conversations), n AS (SELECT conv_id, count(*) FILTER (WHERE turn > 0) AS n FROM i GROUP BY conv_id) SELECT conv_id::VARCHAR AS thread_id, turn::VARCHAR AS comment_id, CASE WHEN turn = 0 THEN 'comment' ELSE 'reply' END AS source_type, conv_id % 6 AS n_replies_stated, true AS complete FROM i JOIN n USING (conv_id) WHERE n >= conv_id % 6")
def held_threads(t):
    """Conversations as threads that arrive as a stream; those whose stated replies have all come are handed on."""
    stream = t("conversations").sparkSession.readStream.schema(t("conversations").schema).parquet(f"{t.folder}/conversations.parque[t]")  # a pattern, as the table may be one file
    items = stream.select(F.col("conv_id").cast("string").alias("thread_id"), F.col("turn").cast("string").alias("comment_id"), F.when(F.col("turn") == 0, "comment").otherwise("reply").alias("source_type"), F.col("role").alias("author"), F.col("text").alias("raw_text"), F.lit(None).cast("timestamp").alias("published_at"), (F.col("conv_id") % 6).alias("n_replies_stated"))
    out = _scratch(t, "threads")
    threads.hand_on(items, f"{out}/rows", f"{out}/state")
    return t("conversations").sparkSession.read.schema(threads.OUT).parquet(f"{out}/rows").select("thread_id", "comment_id", "source_type", "n_replies_stated", "complete")


@query("SELECT o_orderkey AS k, o_totalprice AS price, 'status O' AS dataset_id FROM orders WHERE o_orderstatus = 'O'")
def one_dataset(t):
    """Orders written as a folder per status and read back, one dataset of them."""
    o, root = t("orders"), _scratch(t, "datasets")
    name = F.concat(F.lit("status "), "o_orderstatus").alias("dataset_id")
    folders.export_datasets({"cases": o.select(F.col("o_orderkey").alias("k"), F.col("o_totalprice").alias("price"), name)}, o.select(name).distinct().withColumns({"run_id": F.lit("r"), "description": F.lit("")}), root)
    return folders.load_dataset(o.sparkSession, root, "cases", "status O")
