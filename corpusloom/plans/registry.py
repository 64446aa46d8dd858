"""Every query by name, with the SQL that gives the same rows.

The driver's tables stand for the operators' relations: ``documents`` for posts (source is the platform),
``events`` for stage events, ``conversations`` for threads, ``pages`` for URLs, ``labels`` for gold labels
(their prediction is a text rule), ``orders`` and the other star tables for cases, cards and counts.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import ids, text, urls
from ..operators import analysis, assembly, dedupe, evaluation, evidence, extraction, retrieval, review, routing
from ..sources import privacy, writers
from ..session import ship, spread
from ..streaming import incremental

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query under its function's name; ``t`` reads a table of the folder, which is ``t.folder``."""

    def add(f):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            ship(spark)

            def table(name: str) -> DataFrame:
                df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
                return spread(df) if name in ("documents", "pages") else df  # texts go through Python and regular expressions

            table.folder = sf_dir
            return f(table)

        run.__name__, run.__doc__ = f.__name__, f.__doc__
        QUERIES[f.__name__] = run
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


# -- SQL shared by several queries ------------------------------------------------------------------

_NORM = r"trim(regexp_replace(lower(coalesce(text, '')), '[\s\x0b\x{85}\p{Z}]+', ' ', 'g'))"
_HASHED = r"trim(regexp_replace(regexp_replace(regexp_replace(lower(coalesce(text, '')), 'https?://\S+|www\.\S+', ' ', 'g'), '\p{P}', ' ', 'g'), '[\s\x0b\x{85}\p{Z}]+', ' ', 'g'))"
_DERIVED = f"d AS (SELECT doc_id, source, {_NORM} AS norm, sha256({_HASHED}) AS content_hash FROM documents), dt AS (SELECT *, CASE WHEN norm = '' THEN 0 ELSE len(string_split(norm, ' ')) END AS n_tokens FROM d)"
_BITS = " + ".join(f"CASE WHEN 2 * sum((h >> {b}) & 1) > count(*) THEN CAST({1 << b} AS UBIGINT) ELSE 0 END" for b in range(64))
_SIMHASH = f"""{_DERIVED},
sh AS (SELECT doc_id, CAST('0x' || substr(sha1(array_to_string(w[i:i + 2], ' ')), 1, 16) AS UBIGINT) AS h FROM (SELECT doc_id, string_split(norm, ' ') AS w, unnest(range(1, greatest(1, n_tokens - 2) + 1)) AS i FROM dt WHERE n_tokens > 0)),
sb AS (SELECT doc_id, {_BITS} AS simhash FROM sh GROUP BY doc_id),
p AS (SELECT dt.*, coalesce(simhash, 0) AS simhash FROM dt LEFT JOIN sb USING (doc_id))"""
_LINKS = f"""{_SIMHASH},
stars AS (SELECT b.doc_id AS doc_id, a.doc_id AS canonical_doc_id, false AS quoted FROM (SELECT content_hash, min(doc_id) AS doc_id FROM p GROUP BY content_hash) a JOIN p b ON a.content_hash = b.content_hash AND a.doc_id < b.doc_id),
one AS (SELECT * FROM p WHERE doc_id IN (SELECT min(doc_id) FROM p GROUP BY norm)),
cls AS (SELECT simhash, min(doc_id) AS rep FROM one GROUP BY simhash),
near AS (SELECT a.doc_id AS l, b.doc_id AS r, false AS quoted FROM one a JOIN one b ON a.doc_id < b.doc_id AND a.content_hash <> b.content_hash AND bit_count(xor(a.simhash, b.simhash)) <= 6 JOIN cls ca ON ca.simhash = a.simhash JOIN cls cb ON cb.simhash = b.simhash WHERE a.doc_id = ca.rep AND (b.doc_id = cb.rep OR a.simhash = b.simhash)),
g AS (SELECT doc_id, n_tokens, content_hash, i, array_to_string(w[i:i + 7], ' ') AS g FROM (SELECT doc_id, n_tokens, content_hash, string_split(norm, ' ') AS w, unnest(range(1, n_tokens - 6)) AS i FROM one WHERE n_tokens >= 8)),
m AS (SELECT a.doc_id AS l, b.doc_id AS r, a.i AS i, a.i - b.i AS diag, least(a.n_tokens, b.n_tokens) AS shorter FROM g a JOIN g b ON a.g = b.g AND a.doc_id < b.doc_id AND a.n_tokens <> b.n_tokens AND a.content_hash <> b.content_hash),
isl AS (SELECT *, i - row_number() OVER (PARTITION BY l, r, diag ORDER BY i) AS island FROM m),
runs AS (SELECT l, r, any_value(shorter) AS shorter, max(c) + 7 AS run FROM (SELECT l, r, diag, island, any_value(shorter) AS shorter, count(*) AS c FROM isl GROUP BY l, r, diag, island) GROUP BY l, r),
quotes AS (SELECT l, r, true AS quoted FROM runs WHERE run * 2 >= shorter),
pairs AS (SELECT doc_id, canonical_doc_id, quoted, 'content_hash' AS method FROM stars UNION ALL SELECT r, l, bool_or(quoted), 'simhash' FROM (SELECT * FROM near UNION ALL SELECT * FROM quotes) GROUP BY l, r),
j AS (SELECT pairs.*, a.source AS ls, b.source AS rs, a.n_tokens AS ln, b.n_tokens AS rn, a.content_hash = b.content_hash AS eq, CAST(bit_count(xor(a.simhash, b.simhash)) AS INTEGER) AS distance FROM pairs JOIN p a ON a.doc_id = canonical_doc_id JOIN p b ON b.doc_id = pairs.doc_id),
k AS (SELECT doc_id, canonical_doc_id, method, distance,
 CASE WHEN quoted AND NOT eq THEN 'quoted_repeat' WHEN ls <> rs THEN 'cross_post' WHEN eq THEN 'exact_text' ELSE 'near' END AS duplicate_kind,
 CASE WHEN quoted THEN 'quoted_repeat_ambiguous' WHEN ln < 25 OR rn < 25 THEN 'short_text_below_dedupe_minimum' WHEN ls <> rs THEN 'low_confidence' WHEN NOT eq AND distance BETWEEN 4 AND 6 THEN 'near_duplicate_in_review_band' END AS reason FROM j),
links AS (SELECT *, substr(sha1(doc_id || '|' || canonical_doc_id || '|' || method), 1, 12) AS link_id, CASE WHEN reason IS NULL THEN 'auto_confirmed' ELSE 'pending_review' END AS review_state FROM k)"""


def _links(t, confirmed_only: bool = False) -> DataFrame:
    return dedupe.detect_links(dedupe.prepared(t("documents")), confirmed_only)


# -- text, ids, URLs --------------------------------------------------------------------------------


@query(f"WITH {_DERIVED} SELECT doc_id, norm AS normalized_text, content_hash, n_tokens AS token_count FROM dt")
def normalize_documents(t):
    n = F.coalesce("text", F.lit(""))
    return t("documents").select("doc_id", text.normalized(n).alias("normalized_text"), text.content_hash(n).alias("content_hash")).withColumn("token_count", text.token_count(F.col("normalized_text")))


@query(f"WITH {_SIMHASH} SELECT doc_id, lower(printf('%016x', simhash)) AS simhash FROM p")
def simhash_documents(t):
    return t("documents").select("doc_id", text.hex64(text.simhash(text.normalized(F.coalesce("text", F.lit(""))))).alias("simhash"))


@query()
def redact_documents(t):
    """Masked texts; look-behind patterns have no counterpart in the SQL engine, tests hold them against brute force."""
    d = t("documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    d = d.withColumn("spans", text.pii_spans(F.col("text")))
    return d.select("doc_id", F.size("spans").alias("n_spans"), F.sha2(text.masked(F.col("text"), F.col("spans")), 256).alias("audit_sha256"), F.length(text.masked(F.col("text"), F.col("spans"))).alias("n_chars"))


@query(r"SELECT doc_id, len(regexp_extract_all(coalesce(text, ''), '[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,}')) AS n_emails FROM documents WHERE regexp_matches(text, '[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,}')")
def email_counts(t):
    d = t("documents").select("doc_id", F.size(text.matches(F.coalesce("text", F.lit("")), text.PII[0][1], "email")).cast("long").alias("n_emails"))
    return d.where("n_emails > 0")


@query("SELECT doc_id, substr(sha1(coalesce(source, '') || '|' || coalesce(CAST(doc_id AS VARCHAR), '') || '|' || coalesce(lang, '')), 1, 12) AS short_id, sha256(text) AS raw_text_sha256, substr(sha1(doc_id || '|' || lang), 1, 10) AS fingerprint, doc_id || '#c' || lpad(CAST(doc_id % 90 AS VARCHAR), 2, '0') AS case_id FROM documents")
def content_ids(t):
    return t("documents").select("doc_id", ids.short_id(F.col("source"), F.col("doc_id"), F.col("lang")).alias("short_id"), text.raw_hash(F.col("text")).alias("raw_text_sha256"), ids.fingerprint(F.col("doc_id"), F.col("lang")).alias("fingerprint"), ids.ordered_case_id(F.col("doc_id").cast("string"), F.col("doc_id") % 90).alias("case_id"))


@query(r"""
WITH u AS (SELECT page_id, trim(url) AS url FROM pages),
x AS (SELECT page_id, lower(regexp_extract(url, '^([A-Za-z]+)://', 1)) AS scheme, lower(regexp_extract(url, '^[A-Za-z]+://([^/?#]*)', 1)) AS host, regexp_extract(url, '^[A-Za-z]+://[^/?#]*([^?#]*)', 1) AS path, regexp_extract(url, '\?([^#]*)', 1) AS q FROM u),
k AS (SELECT *, array_to_string(list_sort(list_filter(string_split(q, '&'), lambda p: p <> '' AND lower(string_split(p, '=')[1]) NOT IN ('utm_source','utm_medium','utm_campaign','utm_term','utm_content','utm_name','utm_id','fbclid','gclid','dclid','msclkid','igshid','mc_cid','mc_eid','ref','ref_src','ref_url','referrer','source','share_id','usp','sca_esv','_branch_match_id'))), '&') AS kept, CASE WHEN len(path) > 1 THEN regexp_replace(path, '/+$', '') ELSE path END AS short FROM x)
SELECT page_id, scheme || '://' || host || short || CASE WHEN kept <> '' THEN '?' || kept ELSE '' END AS url_key, scheme || '://' || regexp_replace(host, '^www\.', '') || short || CASE WHEN kept <> '' THEN '?' || kept ELSE '' END AS canonical_url FROM k""")
def url_keys(t):
    return t("pages").select("page_id", urls.url_key(F.col("url")).alias("url_key"), urls.canonical_url(F.col("url")).alias("canonical_url"))


_WHOLE = "CASE WHEN o_totalprice = floor(o_totalprice) THEN CAST(CAST(o_totalprice AS BIGINT) AS VARCHAR) ELSE CAST(o_totalprice AS VARCHAR) END"


@query(f"""
WITH r AS (SELECT sha256('{{"o_custkey":' || o_custkey || ',"o_orderdate":"' || strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S.000') || '","o_orderkey":' || o_orderkey || ',"o_orderpriority":"' || o_orderpriority || '","o_orderstatus":"' || o_orderstatus || '","o_totalprice":' || {_WHOLE} || '}}') AS h FROM orders),
a AS (SELECT h, h || '*' || count(*) AS v FROM r GROUP BY h), b AS (SELECT substr(h, 1, 6) AS h, substr(h, 1, 6) || '=' || sha256(string_agg(v, ',' ORDER BY v)) AS v FROM a GROUP BY substr(h, 1, 6)), c AS (SELECT substr(h, 1, 3) AS h, substr(h, 1, 3) || '=' || sha256(string_agg(v, ',' ORDER BY v)) AS v FROM b GROUP BY substr(h, 1, 3))
SELECT sha256(string_agg(v, ',' ORDER BY v)) AS artifact_hash FROM c""")
def artifact_hash_orders(t):
    """Order-free hash of a whole table; a test shows that order and volatile columns do not matter."""
    return ids.artifact_hash(t("orders"), "o_orderkey")


@query("SELECT o_orderkey, sha256('{\"custkey\":' || o_custkey || ',\"priority\":\"' || o_orderpriority || '\",\"status\":\"' || o_orderstatus || '\"}') AS cache_key FROM orders")
def cache_keys(t):
    o = t("orders").select("o_orderkey", F.col("o_custkey").alias("custkey"), F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("priority"))
    return o.select("o_orderkey", ids.cache_key(o.drop("o_orderkey")).alias("cache_key"))


@query("SELECT o_orderkey, CAST((CAST(o_orderkey - least(greatest(o_custkey, 0), o_orderkey) AS DECIMAL(18,0)) * 0.15 + CAST(least(greatest(o_custkey, 0), o_orderkey) AS DECIMAL(18,0)) * 0.075 + CAST(o_custkey AS DECIMAL(18,0)) * 0.75) / 1000000 AS DOUBLE) AS usd, least(2.0, 0.2 * pow(2.0, o_orderkey % 6)) AS wait_s FROM orders")
def price_and_wait(t):
    return t("orders").select("o_orderkey", ids.list_price(F.col("o_orderkey"), F.col("o_custkey"), F.col("o_custkey"), "0.15", "0.075", "0.75").cast("double").alias("usd"), ids.retry_wait(F.col("o_orderkey") % 6).alias("wait_s"))


# -- duplicates -------------------------------------------------------------------------------------


@query(f"WITH {_LINKS} SELECT link_id, doc_id, canonical_doc_id, duplicate_kind, method, (64 - distance) / 64.0 AS similarity, distance, reason AS review_reason_code, review_state FROM links")
def dedupe_links(t):
    return _links(t).withColumn("similarity", F.col("similarity").cast("double"))


@query(f"WITH {_LINKS} SELECT duplicate_kind, review_state, count(*) AS n_links, count(*) FILTER (WHERE distance BETWEEN 4 AND 6) AS n_in_band FROM links GROUP BY ALL")
def dedupe_links_summary(t):
    return dedupe.link_counts(_links(t))


@query(f"WITH {_DERIVED} SELECT d.doc_id, k.doc_id AS canonical_doc_id FROM d JOIN (SELECT content_hash, min(doc_id) AS doc_id FROM d GROUP BY content_hash HAVING count(*) > 1) k ON d.content_hash = k.content_hash AND d.doc_id <> k.doc_id")
def exact_duplicate_stars(t):
    d = t("documents").select("doc_id", text.content_hash(F.coalesce("text", F.lit(""))).alias("content_hash"))
    k = d.groupBy("content_hash").agg(F.min("doc_id").alias("canonical_doc_id"), F.count("*").alias("n")).where("n > 1")
    return d.join(k, "content_hash").where("doc_id <> canonical_doc_id").select("doc_id", "canonical_doc_id")


@query(f"WITH {_SIMHASH}, cls AS (SELECT simhash, min(doc_id) AS rep FROM p GROUP BY simhash) SELECT a.rep AS a, b.rep AS b, CAST(bit_count(xor(a.simhash, b.simhash)) AS INTEGER) AS distance FROM cls a JOIN cls b ON a.rep < b.rep AND bit_count(xor(a.simhash, b.simhash)) <= 6 UNION ALL SELECT rep, doc_id, 0 FROM p JOIN cls USING (simhash) WHERE doc_id > rep")
def hamming_pairs(t):
    """Pairs of documents that stand for a fingerprint; the others of it are paired with that one (distance 0)."""
    d = t("documents").select("doc_id", text.simhash(text.normalized(F.coalesce("text", F.lit("")))).alias("simhash"))
    return dedupe.hamming_pairs(d, "doc_id")


@query(f"WITH {_LINKS} SELECT doc_id, max_by(canonical_doc_id, link_id) AS canonical_doc_id FROM links WHERE review_state = 'auto_confirmed' GROUP BY doc_id")
def canonical_documents(t):
    return dedupe.canonical_map(_links(t, confirmed_only=True))


@query(f"WITH {_LINKS} SELECT d.doc_id, count(e.doc_id) AS n_links FROM documents d LEFT JOIN (SELECT doc_id FROM links UNION ALL SELECT canonical_doc_id FROM links) e ON d.doc_id = e.doc_id GROUP BY d.doc_id")
def links_per_document(t):
    return dedupe.links_per_document(t("documents"), _links(t))


@query(f"WITH {_LINKS} SELECT substr(sha1('review|' || link_id || '|' || reason), 1, 12) AS item_id, 'duplicate_link' AS target_type, link_id AS target_id, reason AS reason_code, CASE WHEN reason IN ('near_duplicate_in_review_band', 'quoted_repeat_ambiguous') THEN 1 WHEN reason IN ('different_authors_identical_text', 'short_text_below_dedupe_minimum') THEN 2 ELSE 3 END AS priority, 'open' AS state FROM links WHERE review_state = 'pending_review'")
def review_queue(t):
    return dedupe.open_items(_links(t))


# -- routing and events -----------------------------------------------------------------------------

_RULES = {"common_words": ("the of", "of the", "and the"), "toxic_words": ("idiot", "stupid"), "contact": ("@mail", "+1 (")}
_WANTED = ("for the", "to the")


@query("""
WITH n AS (SELECT doc_id, trim(regexp_replace(lower(coalesce(text, '')), '\\s+', ' ', 'g')) AS t FROM documents),
h AS (SELECT doc_id, t, list_filter([{'p': 'the of', 'r': 'common_words'}, {'p': 'of the', 'r': 'common_words'}, {'p': 'and the', 'r': 'common_words'}, {'p': 'idiot', 'r': 'toxic_words'}, {'p': 'stupid', 'r': 'toxic_words'}, {'p': '@mail', 'r': 'contact'}, {'p': '+1 (', 'r': 'contact'}], lambda s: contains(t, s.p)) AS hits, contains(t, 'for the') OR contains(t, 'to the') OR false AS wanted FROM n),
x AS (SELECT *, len(hits) >= 2 AND NOT wanted AS excluded FROM h),
r AS (SELECT doc_id, min_by(r, (-c, r)) AS reason FROM (SELECT doc_id, u.r AS r, count(*) AS c FROM (SELECT doc_id, unnest(hits) AS u FROM x) GROUP BY doc_id, u.r) GROUP BY doc_id)
SELECT x.doc_id, CASE WHEN excluded THEN 'obvious_exclusion_candidate' ELSE 'classify' END AS route, NOT excluded AS passed, CASE WHEN excluded THEN 'out_of_scope' END AS candidate_scope_class, CAST(len(hits) AS INTEGER) AS n_signals, CASE WHEN excluded THEN reason END AS drop_reason_code FROM x LEFT JOIN r USING (doc_id)""")
def prefilter_routes(t):
    """The routing operator with rules that occur in the driver's invented prose."""
    d = t("documents").select("doc_id", F.coalesce("text", F.lit("")).alias("normalized_text"))
    return routing.prefilter(d, None, _RULES, _WANTED).drop("reason_labels", "canonical_doc_id")


@query("""
SELECT CAST(s.step AS INTEGER) AS step, e.event_type AS stage, count(DISTINCT user_id) AS n_targets, count(*) FILTER (WHERE value < 20) AS n_failed
FROM events e JOIN (VALUES (0, 'view'), (1, 'click'), (2, 'signup'), (3, 'purchase')) s(step, stage) ON s.stage = e.event_type GROUP BY s.step, e.event_type""")
def stage_funnel(t):
    e = t("events").select(F.col("event_type").alias("stage"), F.col("user_id").alias("target_id"), F.when(F.col("value") < 20, "failed").otherwise("done").alias("status"))
    return analysis.funnel(e, ["view", "click", "signup", "purchase"])


@query("SELECT event_type AS stage, CASE WHEN value < 20 THEN 'failed' ELSE 'done' END AS status, count(*) AS n_events FROM events WHERE user_id IN (SELECT user_id FROM events WHERE event_type = 'signup') GROUP BY ALL")
def stage_status_counts(t):
    """Over the users that signed up."""
    e = t("events").select(F.col("event_type").alias("stage"), F.col("user_id").alias("target_id"), F.when(F.col("value") < 20, "failed").otherwise("done").alias("status"))
    return analysis.stage_status_counts(e, e.where("stage = 'signup'"))


@query("SELECT user_id, event_type AS stage, max_by(CAST(event_id AS VARCHAR), (ts, event_id)) AS last_event FROM events GROUP BY ALL")
def latest_stage_status(t):
    return t("events").groupBy("user_id", F.col("event_type").alias("stage")).agg(F.max_by(F.col("event_id").cast("string"), F.struct("ts", "event_id")).alias("last_event"))


@query("SELECT date_trunc('hour', ts) AS window_start, event_type AS stage, count(*) AS n FROM events GROUP BY ALL")
def windowed_funnel(t):
    """Extension, as a batch; the same function runs on a stream."""
    return incremental.windowed_funnel(t("events"), "ts", F.col("event_type"))


@query("SELECT event_type, json_extract_string(props, '$.k') AS k, count(*) AS n FROM events GROUP BY ALL HAVING count(*) >= 2")
def event_details(t):
    return t("events").groupBy("event_type", F.from_json("props", "k string")["k"].alias("k")).agg(F.count("*").alias("n")).where("n >= 2")


@query("SELECT user_id, count(*) AS n FROM (SELECT DISTINCT user_id, event_type, sha256(props) AS h FROM events WHERE event_id % 2 = 1) a WHERE NOT EXISTS (SELECT 1 FROM events b WHERE b.event_id % 2 = 0 AND b.user_id = a.user_id AND b.event_type = a.event_type AND sha256(b.props) = a.h) GROUP BY user_id")
def unseen_items(t):
    """Even events stand for what was seen, odd ones for what arrives."""
    e = t("events").select("event_id", "user_id", "event_type", F.sha2("props", 256).alias("h"))
    return incremental.unseen(e.where("event_id % 2 = 1"), e.where("event_id % 2 = 0"), ["user_id", "event_type", "h"]).groupBy("user_id").agg(F.count("*").alias("n"))


@query("SELECT event_id, CAST(CASE WHEN rn <= 20 THEN 1 WHEN rn <= 40 THEN 2 ELSE 3 END AS INTEGER) AS lot FROM (SELECT event_id, row_number() OVER (ORDER BY event_id) AS rn FROM events) WHERE rn <= 50")
def batch_lots(t):
    """A scheduled batch holds 50 items; that limit is the operator's."""
    return incremental.lots(t("events").select("event_id"), ["event_id"])


# -- analysis ---------------------------------------------------------------------------------------


def _cases(t) -> DataFrame:
    """Orders as cases: customer is the author, clerk-free priority the source, status the scope."""
    o = t("orders")
    return o.select(F.col("o_orderkey").cast("string").alias("case_id"), F.col("o_custkey").cast("string").alias("doc_id"), F.when(F.col("o_orderkey") % 5 == 0, None).otherwise((F.col("o_custkey") % 50).cast("string")).alias("parent_thread_id"), F.when(F.col("o_orderkey") % 7 == 0, None).otherwise((F.col("o_custkey") % 100).cast("string")).alias("author_hash"), F.col("o_orderpriority").alias("source_platform"), F.when(F.col("o_orderkey") % 11 == 0, "contextual").when(F.col("o_orderkey") % 13 == 0, "").otherwise("direct_user").alias("evidence_tier"), F.col("o_orderstatus").alias("scope_class"), F.when(F.col("o_orderkey") % 17 == 0, "failed").otherwise("ok").alias("technical_state"), F.when(F.col("o_orderkey") % 3 == 0, None).otherwise(F.col("o_orderkey") % 5 + 1).alias("severity"))


@query("""
WITH c AS (SELECT CAST(o_orderkey AS VARCHAR) AS case_id, CAST(o_custkey AS VARCHAR) AS doc_id, CASE WHEN o_orderkey % 5 <> 0 THEN CAST(o_custkey % 50 AS VARCHAR) END AS thread, CASE WHEN o_orderkey % 7 <> 0 THEN CAST(o_custkey % 100 AS VARCHAR) END AS author, o_orderpriority AS src, CASE WHEN o_orderkey % 11 = 0 THEN 'contextual' ELSE 'direct_user' END AS tier, o_orderstatus AS scope, o_orderkey % 17 <> 0 AS ok, CASE WHEN o_orderkey % 3 <> 0 THEN o_orderkey % 5 + 1 END AS severity FROM orders),
direct AS (SELECT * FROM c WHERE ok AND tier = 'direct_user'), e AS (SELECT * FROM direct WHERE scope = 'F'),
per AS (SELECT src, count(*) AS population, count(*) FILTER (WHERE scope = 'F') AS n FROM direct GROUP BY src)
SELECT 'F' AS scope, (SELECT count(*) FROM e) AS unique_cases, (SELECT count(DISTINCT doc_id) FROM e) AS unique_documents, (SELECT count(DISTINCT coalesce(thread, doc_id)) FROM e) AS unique_threads, (SELECT count(DISTINCT author) FROM e) AS unique_authors, (SELECT avg(severity) FROM e) AS mean_severity, (SELECT count(severity) FROM e) AS severity_denominator, (SELECT count(*) FROM e WHERE severity IS NULL) AS severity_nulls,
 (SELECT count(*) FROM per WHERE n > 0) AS source_count, (SELECT avg(n / population) FROM per) AS source_balanced_mean, (SELECT coalesce(list_sort(list(src)), []) FROM per WHERE n / (SELECT sum(n) FROM per) > 0.4) AS concentration_disclosure, (SELECT count(*) FROM c WHERE NOT ok) AS excluded_technical_failures, (SELECT count(*) FROM c WHERE ok AND tier <> 'direct_user') AS excluded_non_direct""")
def opportunities(t):
    return analysis.opportunities(_cases(t), "F")


def _map_cases(t) -> DataFrame:
    o = t("orders")
    block = lambda stated, *vs: F.struct(F.when(stated, "stated").otherwise("not_stated").alias("observation"), F.array(*vs).alias("value"))
    state = F.when(F.col("o_orderkey") % 10 == 0, "failed").otherwise("ok").alias("technical_state")
    return o.select(F.col("o_orderkey").alias("case_id"), state, block(F.col("o_orderkey") % 4 != 0, F.col("o_orderpriority"), F.col("o_orderstatus")).alias("cues"), block(F.col("o_orderkey") % 6 != 0, F.col("o_orderstatus")).alias("forgotten"))


@query("SELECT cue, item, count(*) AS n_cases FROM (SELECT unnest(cues) AS cue, item FROM (SELECT CASE WHEN o_orderkey % 4 <> 0 THEN [o_orderpriority, o_orderstatus] ELSE ['not_stated'] END AS cues, CASE WHEN o_orderkey % 6 <> 0 THEN o_orderstatus ELSE 'not_stated' END AS item FROM orders WHERE o_orderkey % 10 <> 0)) GROUP BY ALL")
def memory_map(t):
    return analysis.memory_map(_map_cases(t))


@query("SELECT o_orderkey AS case_id, CASE WHEN o_orderkey % 4 <> 0 THEN o_orderpriority || ', ' || o_orderstatus ELSE 'not_stated' END AS cues, CASE WHEN o_orderkey % 6 <> 0 THEN o_orderstatus ELSE 'not_stated' END AS forgotten FROM orders WHERE o_orderkey % 10 <> 0")
def journeys(t):
    return analysis.journeys(_map_cases(t), ["cues", "forgotten"])


@query("SELECT coalesce(p_brand, '') || '|' || coalesce(p_type, '') AS signature, count(*) OVER (PARTITION BY coalesce(p_brand, '') || '|' || coalesce(p_type, '')) AS size, p_partkey FROM part")
def case_groupings(t):
    return analysis.groupings(t("part"), ["p_brand", "p_type"], "p_partkey")


@query("SELECT l_returnflag, count(DISTINCT l_orderkey) AS n_docs, count(DISTINCT l_suppkey) AS n_sources, count(DISTINCT l_orderkey) >= 5 AND count(DISTINCT l_suppkey) >= 2 AS established FROM lineitem GROUP BY ALL")
def established_groups(t):
    return analysis.established(t("lineitem"), "l_returnflag", "l_orderkey", "l_suppkey")


@query("""
WITH c AS (SELECT o_orderstatus AS scope, o_orderkey AS pos, [o_orderpriority] AS priority, [CASE WHEN o_totalprice > 100000 THEN 'large' ELSE 'small' END] AS size FROM orders)
SELECT scope, field, value, count(*) AS n, min(pos) AS first FROM (SELECT scope, pos, 'priority' AS field, unnest(priority) AS value FROM c UNION ALL SELECT scope, pos, 'size', unnest(size) FROM c) GROUP BY ALL""")
def case_comparison(t):
    c = t("orders").select(F.col("o_orderstatus").alias("scope"), F.col("o_orderkey").alias("pos"), F.array("o_orderpriority").alias("priority"), F.array(F.when(F.col("o_totalprice") > 100000, "large").otherwise("small")).alias("size"))
    return analysis.comparison(c, ["priority", "size"])


@query("SELECT 'source' AS counter, source AS value, count(*) AS n FROM documents GROUP BY source UNION ALL SELECT 'lang', lang, count(*) FROM documents GROUP BY lang")
def collection_counters(t):
    return analysis.counters(t("documents"), ["source", "lang"])


@query("SELECT source, count(*) AS n, count(*) / (SELECT count(*) FROM documents) AS share, count(*) / (SELECT count(*) FROM documents) > 0.4 AS over_threshold FROM documents GROUP BY source")
def source_audit(t):
    return analysis.source_audit(t("documents"), "source")


@query("SELECT CAST(pos AS INTEGER) AS pos, s.v AS event_type, count(e.event_id) AS n FROM (VALUES (0, 'view'), (1, 'click'), (2, 'share'), (3, 'purchase')) s(pos, v) LEFT JOIN events e ON e.event_type = s.v GROUP BY ALL")
def ordered_counts(t):
    return analysis.ordered_counts(t("events"), "event_type", ["view", "click", "share", "purchase"])


@query("SELECT l_returnflag, count(*) FILTER (WHERE l_linestatus = 'O') AS O, count(*) FILTER (WHERE l_linestatus = 'F') AS F FROM lineitem GROUP BY l_returnflag")
def crosstab(t):
    return analysis.crosstab(t("lineitem"), "l_returnflag", "l_linestatus", ["O", "F"])


@query("SELECT item, count(*) AS n FROM (SELECT trim(unnest(string_split(lower(replace(p_type, ' ', ';')), ';'))) AS item FROM part) WHERE item NOT IN ('', 'unknown') GROUP BY item ORDER BY n DESC, item LIMIT 5")
def top_items(t):
    """A top-5 report; the limit is the operator's."""
    return analysis.top_items(t("part"), F.replace("p_type", F.lit(" "), F.lit(";")), 5)


@query("SELECT count(*) AS n, avg(CASE WHEN c_acctbal > 0 THEN 1 ELSE 0 END) AS share, (SELECT c_mktsegment FROM customer GROUP BY c_mktsegment ORDER BY count(*) DESC, c_mktsegment LIMIT 1) AS top_category FROM customer")
def insight_kpis(t):
    return analysis.kpis(t("customer"), "c_mktsegment", F.col("c_acctbal") > 0)


@query("SELECT DISTINCT c_mktsegment FROM customer WHERE c_mktsegment IS NOT NULL")
def filter_options(t):
    return analysis.options(t("customer"), "c_mktsegment")


@query("SELECT conv_id, turn, role FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS rn FROM conversations) WHERE rn = 1")
def first_per_thread(t):
    return analysis.first_per_key(t("conversations"), ["conv_id"], ["turn", "role", "text"]).select("conv_id", "turn", "role")


@query("SELECT host, n, page_id FROM (SELECT regexp_extract(url, '^https?://([^/?#]*)', 1) AS host, page_id, count(*) OVER (PARTITION BY regexp_extract(url, '^https?://([^/?#]*)', 1)) AS n FROM pages) WHERE n >= 2")
def repeated_urls(t):
    """Pages that share a host, as URLs repeat in no table of the driver."""
    return analysis.repeated(t("pages").select(F.regexp_extract("url", "^https?://([^/?#]*)", 1).alias("host"), "page_id"), "host", "page_id")


@query("SELECT count(*) AS n_groups, avg(share) AS balanced_mean FROM (SELECT source, avg(CASE WHEN lang = 'en' THEN 1 ELSE 0 END) AS share FROM documents GROUP BY source)")
def source_balanced_share(t):
    return analysis.balanced_mean(t("documents"), "source", F.col("lang") == "en")


# -- retrieval --------------------------------------------------------------------------------------

_QUESTION = "how the license and the apache version of the software license"
_STOP = ", ".join(f"'{w}'" for w in retrieval.STOP_WORDS)


@query(f"""
WITH r AS (SELECT doc_id AS key, source, list_filter(regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+'), lambda w: w NOT IN ({_STOP})) AS t FROM documents WHERE coalesce(lang, '') = 'en'),
q AS (SELECT w AS term, count(*) AS times FROM (SELECT unnest(regexp_extract_all('{_QUESTION}', '[a-z0-9]+')) AS w) WHERE w NOT IN ({_STOP}) GROUP BY w),
s AS (SELECT count(*) AS n, avg(len(t)) AS avgdl FROM r),
tf AS (SELECT key, source, len, term, count(*) AS tf FROM (SELECT key, source, len(t) AS len, unnest(t) AS term FROM r) GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM tf JOIN q USING (term) GROUP BY term),
sc AS (SELECT key, source, round(sum(times * ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len / avgdl))), 9) AS score FROM tf JOIN q USING (term) JOIN df USING (term), s GROUP BY key, source),
rk AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY score DESC, key) AS rn FROM sc WHERE score >= 0.15)
SELECT key, source, score FROM rk WHERE rn <= 3 ORDER BY score DESC, key LIMIT 10""")
def bm25_search(t):
    """Ten best with at most three per source; the limits are the operator's."""
    return retrieval.search(_QUESTION, t("documents"), "doc_id", "source", "text", {"lang": "en"})


@query("SELECT c_custkey FROM customer WHERE coalesce(c_mktsegment, '') = 'BUILDING' AND c_acctbal > 0")
def card_filter(t):
    return retrieval.filter_cards(t("customer").where("c_acctbal > 0"), c_mktsegment="BUILDING", c_name="All").select("c_custkey")


@query("SELECT doc_id FROM documents WHERE contains(lower(text), 'apache') AND contains(lower(text), 'license,')")
def contains_all_words(t):
    return t("documents").where(retrieval.contains_all(F.coalesce("text", F.lit("")), "an apache license, in")).select("doc_id")


@query("SELECT c_custkey, [CAST(c_custkey AS VARCHAR)] AS accepted, CASE WHEN c_custkey % 2 = 0 THEN ['x9'] ELSE [] END AS rejected FROM customer")
def citation_check(t):
    k = F.col("c_custkey").cast("string")
    answer = F.concat(F.lit("see ["), k, F.lit("] and ["), k, F.lit("]"), F.when(F.col("c_custkey") % 2 == 0, " or [x9]").otherwise(""))
    return t("customer").select("c_custkey", retrieval.citations(answer, F.array(k, F.lit("other"))).alias("c")).select("c_custkey", "c.accepted", "c.rejected")


@query("SELECT c_custkey, n_name, c_acctbal FROM (SELECT c_custkey, n_name, c_acctbal, row_number() OVER (PARTITION BY n_name ORDER BY c_acctbal DESC, c_custkey) AS rn FROM customer JOIN nation ON c_nationkey = n_nationkey) WHERE rn <= 3")
def top_per_source(t):
    from pyspark.sql import Window

    c = t("customer").join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    w = Window.partitionBy("n_name").orderBy(F.desc("c_acctbal"), "c_custkey")
    return c.withColumn("rn", F.row_number().over(w)).where("rn <= 3").select("c_custkey", "n_name", "c_acctbal")


# -- evidence and export ----------------------------------------------------------------------------


def _quotes(t) -> DataFrame:
    """From each document a quote of 32 characters from its first third on; claimed offsets are right, shifted or missing. Short, empty and null texts take part."""
    at = F.floor(F.length("text") / 3).cast("int")
    d = t("documents").select("doc_id", F.col("text").alias("raw_text"), F.substring("text", at + 1, F.lit(32)).alias("quote"), (at + F.when(F.col("doc_id") % 3 == 0, 0).when(F.col("doc_id") % 3 == 1, 5)).alias("start"))
    return d.withColumn("stop", F.col("start") + F.length("quote"))


_QUOTED = "q AS (SELECT doc_id, text, substr(text, length(text) // 3 + 1, 32) AS quote, CASE doc_id % 3 WHEN 0 THEN length(text) // 3 WHEN 1 THEN length(text) // 3 + 5 END AS start FROM documents)"


@query(f"""
WITH {_QUOTED}, h AS (SELECT *, coalesce(quote <> '' AND substr(text, start + 1, length(quote)) = quote, false) AS exact, CASE WHEN quote <> '' THEN list_filter(range(0, length(text) - length(quote) + 1), lambda i: substr(text, i + 1, length(quote)) = quote) ELSE [] END AS hits FROM q)
SELECT doc_id, CASE WHEN exact THEN 'exact' WHEN len(hits) = 0 THEN 'not_found' WHEN len(hits) = 1 THEN 'unique' WHEN start IS NOT NULL THEN 'nearest' ELSE 'ambiguous' END AS rung, CAST(CASE WHEN exact THEN start WHEN len(hits) = 1 THEN hits[1] WHEN start IS NOT NULL THEN list_sort(list_transform(hits, lambda x: {{'d': abs(x - start), 'at': x}}))[1].at END AS INTEGER) AS final_start FROM h""")
def evidence_ladder(t):
    q = _quotes(t).withColumn("redaction_spans", F.expr("cast(array() as array<struct<start:int,stop:int>>)"))
    return evidence.ladder(q).select("doc_id", "rung", "final_start")


@query(f"WITH {_QUOTED} SELECT count(*) AS n, count(*) FILTER (WHERE NOT coalesce(substr(text, start + 1, length(quote)) = quote, false)) AS failures FROM q")
def verbatim_failures(t):
    return evidence.verbatim_failures(_quotes(t).withColumn("text", F.col("raw_text")).withColumn("validation_state", F.lit("valid")))


@query("WITH q AS (SELECT doc_id, text, length(text) // 3 AS s, length(text) // 3 + length(substr(text, length(text) // 3 + 1, 32)) AS e FROM documents) SELECT doc_id, substr(text, greatest(0, s - 160) + 1, least(length(text), e + 160) - greatest(0, s - 160)) AS excerpt, CAST(s - greatest(0, s - 160) AS INTEGER) AS first_start FROM q")
def export_cards(t):
    """The text around a quote from within each document, with the quote's place in it."""
    q = _quotes(t)
    at = F.floor(F.length("raw_text") / 3).cast("int")
    got = extraction.cards(q.select("doc_id", F.col("raw_text").alias("raw_text_audit")), q.select("doc_id", at.alias("start"), (at + F.length("quote")).alias("stop"), "quote"))
    return got.select("doc_id", "excerpt", F.get("spans", F.lit(0))["start"].alias("first_start"))


_PHONE = r"(^|[^\p{Nd}])(\+\p{Nd}{1,3}[\s\x0b\x{85}\p{Z}.\-]?)?(\(\p{Nd}{3}\)|\p{Nd}{3})[\s\x0b\x{85}\p{Z}.\-]\p{Nd}{3}[\s\x0b\x{85}\p{Z}.\-]\p{Nd}{4}($|[^\p{Nd}])"


@query(rf"""
WITH x AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS w, source FROM documents),
v AS (SELECT doc_id, '$.parts[' || (i - 1) || '].line' AS path, w[i] AS v FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM x) UNION ALL SELECT doc_id, '$.more.free.list[0].said', array_to_string(w, ' ') FROM x WHERE doc_id % 4 = 0 UNION ALL SELECT doc_id, '$.props.note', source || ' sk-ant-1' FROM x WHERE doc_id % 50 = 1),
k AS (SELECT doc_id, '$.props.api_key' AS path FROM x WHERE doc_id % 30 = 0 UNION ALL SELECT doc_id, '$.more.free.prompt' FROM x WHERE doc_id % 4 = 0 AND doc_id % 5 = 0 UNION ALL SELECT doc_id, '$.meta.author_name' FROM x)
SELECT path, kind, count(*) AS n FROM (SELECT DISTINCT doc_id, path, 'email' AS kind FROM v WHERE regexp_matches(v, '[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{{2,}}') UNION ALL SELECT DISTINCT doc_id, path, 'phone' FROM v WHERE regexp_matches(v, '{_PHONE}')
  UNION ALL SELECT DISTINCT doc_id, path, m FROM v, (VALUES ('sk-ant-'), ('AIza'), ('GROQ_API_KEY'), ('YOUTUBE_API_KEY'), ('ANTHROPIC_API_KEY'), ('AUTHOR_SALT')) s(m) WHERE contains(v, m) UNION ALL SELECT doc_id, path, 'forbidden_key' FROM k) GROUP BY ALL""")
def leak_scan(t):
    """Findings by path in lines of a list, values of a map, fields of a struct and free JSON in one."""
    k, x = F.col("doc_id"), F.coalesce("text", F.lit(""))
    free = F.when(k % 4 == 0, F.parse_json(F.to_json(F.struct(F.array(F.struct(F.replace(x, F.lit("\n"), F.lit(" ")).alias("said"))).alias("list"), F.when(k % 5 == 0, 1).alias("prompt")))))
    props = F.map_filter(F.create_map(F.lit("api_key"), F.when(k % 30 == 0, ""), F.lit("note"), F.when(k % 50 == 1, F.concat("source", F.lit(" sk-ant-1")))), lambda _, v: v.isNotNull())
    return privacy.leak_findings(t("documents").select(F.transform(F.split(x, "\n", -1), lambda s: F.struct(s.alias("line"))).alias("parts"), props.alias("props"), F.struct(F.lit(None).cast("string").alias("author_name")).alias("meta"), F.struct(free.alias("free")).alias("more")))


# A look-around of one character is that character or the text's edge; Java's \s has \x0b too.
@query(r"""
SELECT 'text' AS "column", kind, count(*) AS n FROM documents JOIN (VALUES
('email', '[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,}'),
('phone', '(^|[^\p{Nd}])(\+\p{Nd}{1,3}[\s\x0b\x{85}\p{Z}.\-]?)?(\(\p{Nd}{3}\)|\p{Nd}{3})[\s\x0b\x{85}\p{Z}.\-]\p{Nd}{3}[\s\x0b\x{85}\p{Z}.\-]\p{Nd}{4}($|[^\p{Nd}])'),
('secret', '(?i)\b(api[_-]?key|secret|password|token)[\s\x0b]*[=:][\s\x0b]*[^\s\x0b]')) k(kind, pattern) ON regexp_matches(text, pattern) GROUP BY kind""")
def leak_scan_kinds(t):
    """Documents that still show an e-mail address, a phone number or a secret, by kind."""
    return writers.leaking_rows(t("documents").select("text"))


@query("SELECT case_id, 'status' AS dimension, o_orderstatus AS value FROM (SELECT o_orderkey AS case_id, * FROM orders) UNION ALL SELECT o_orderkey, 'priority', o_orderpriority FROM orders")
def label_rows(t):
    lab = lambda c: F.array(F.struct(F.col(c).alias("value"), F.lit(None).cast("string").alias("detail"), F.lit("e").alias("evidence_id")))
    o = t("orders").select(F.col("o_orderkey").alias("case_id"), lab("o_orderstatus").alias("status"), lab("o_orderpriority").alias("priority"))
    return extraction.label_rows(o, ["status", "priority"]).select("case_id", "dimension", "value")


@query("SELECT sha256(text) AS cache_key, 'provider_unavailable' AS technical_state FROM benchmark")
def null_provider_calls(t):
    return extraction.call_model(t("benchmark"), F.col("text")).select("cache_key", "technical_state")


# -- evaluation -------------------------------------------------------------------------------------

_PRED = "regexp_matches(text, 'idiot|stupid|moron')"


def _scored(t) -> DataFrame:
    d = t("documents").select("doc_id", "lang", F.col("text").rlike("idiot|stupid|moron").alias("pred"))
    return t("labels").join(d, "doc_id").select("doc_id", "lang", (F.col("toxic") == 1).alias("gold"), F.when(F.col("doc_id") % 9 != 0, F.col("pred")).alias("pred"), (F.col("quality") == 1).alias("quality"))


_SCORED = f"s AS (SELECT doc_id, lang, toxic = 1 AS gold, CASE WHEN doc_id % 9 <> 0 THEN {_PRED} END AS pred, quality = 1 AS quality FROM labels JOIN documents USING (doc_id))"


@query(f"WITH {_SCORED}, c AS (SELECT count(*) FILTER (WHERE gold AND pred) AS tp, count(*) FILTER (WHERE NOT gold AND pred) AS fp, count(*) FILTER (WHERE gold AND NOT pred) AS fn, count(*) FILTER (WHERE pred IS NULL) AS excluded FROM s) SELECT *, tp / nullif(tp + fp, 0) AS precision, tp / nullif(tp + fn, 0) AS recall, CASE WHEN tp + fp > 0 AND tp + fn > 0 THEN 2 * tp / nullif(2 * tp + fp + fn, 0) END AS f1 FROM c")
def relevance_counts(t):
    return evaluation.binary_counts(_scored(t), F.col("gold"), F.col("pred"))


@query(f"WITH {_SCORED} SELECT gold, pred, count(*) AS n FROM s GROUP BY ALL")
def confusion_matrix(t):
    return evaluation.confusion(_scored(t), "gold", "pred")


@query(f"""WITH {_SCORED}, x AS (SELECT gold AS a, quality AS b FROM s), tot AS (SELECT count(*) AS n, avg(CASE WHEN a = b THEN 1.0 ELSE 0.0 END) AS agreement FROM x),
ch AS (SELECT sum(pa * pb) AS e FROM (SELECT a AS v, count(*) / (SELECT count(*) FROM x) AS pa FROM x GROUP BY a) JOIN (SELECT b AS v, count(*) / (SELECT count(*) FROM x) AS pb FROM x GROUP BY b) USING (v))
SELECT n, agreement, e AS expected, (agreement - e) / (1 - e) AS kappa FROM tot, ch""")
def cohen_kappa(t):
    return evaluation.kappa(_scored(t), "gold", "quality")


@query(f"WITH {_SCORED} SELECT 'pred' AS field, count(gold) AS n, avg(CASE WHEN gold IS NOT DISTINCT FROM pred THEN 1 ELSE 0 END) AS accuracy FROM s")
def scalar_accuracy(t):
    return evaluation.scalar_accuracy(_scored(t).select(F.col("gold").alias("gold_pred"), F.col("pred").alias("pred_pred")), ["pred"])


@query("""
WITH x AS (SELECT list_distinct([o_orderstatus, o_orderpriority]) AS g, CASE WHEN o_orderkey % 3 = 0 THEN [o_orderstatus, 'F'] ELSE [o_orderpriority] END AS p FROM orders),
l AS (SELECT unnest(list_distinct(list_concat(g, p))) AS label, g, p FROM x),
per AS (SELECT label, count(*) FILTER (WHERE list_contains(g, label) AND list_contains(p, label)) AS tp, count(*) FILTER (WHERE NOT list_contains(g, label)) AS fp, count(*) FILTER (WHERE NOT list_contains(p, label)) AS fn FROM l GROUP BY label),
r AS (SELECT *, tp / nullif(tp + fp, 0) AS pr, tp / nullif(tp + fn, 0) AS re, CASE WHEN tp + fp > 0 AND tp + fn > 0 THEN 2 * tp / (2 * tp + fp + fn) END AS f FROM per)
SELECT sum(tp) / sum(tp + fp) AS micro_precision, sum(tp) / sum(tp + fn) AS micro_recall, 2 * sum(tp) / sum(2 * tp + fp + fn) AS micro_f1, avg(pr) AS macro_precision, avg(re) AS macro_recall, avg(f) AS macro_f1 FROM r""")
def multilabel_scores(t):
    o = t("orders").select(F.array("o_orderstatus", "o_orderpriority").alias("g"), F.when(F.col("o_orderkey") % 3 == 0, F.array(F.col("o_orderstatus"), F.lit("F"))).otherwise(F.array("o_orderpriority")).alias("p"))
    return evaluation.multilabel(o, "g", "p")


@query("SELECT doc_id, source, lang, CASE WHEN rn <= n * 2 // 5 THEN 'dev' ELSE 'holdout' END AS split FROM (SELECT doc_id, source, lang, row_number() OVER (PARTITION BY source, lang ORDER BY sha256('gold-v1|' || doc_id), doc_id) AS rn, count(*) OVER (PARTITION BY source, lang) AS n FROM documents)")
def gold_split(t):
    return evaluation.gold_split(t("documents"), "doc_id", ["source", "lang"])


@query("SELECT c_custkey, c_mktsegment, CASE WHEN list_contains(list_transform(range(0, least(10, n)), lambda i: i * n // least(10, n)), rn) THEN 'holdout' ELSE 'dev' END AS split FROM (SELECT c_custkey, c_mktsegment, row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_custkey) - 1 AS rn, count(*) OVER (PARTITION BY c_mktsegment) AS n FROM customer)")
def even_split(t):
    return evaluation.even_split(t("customer"), "c_custkey", ["c_mktsegment"], 10)


@query("SELECT c_custkey, c_mktsegment, CAST(rn AS INTEGER) AS rn FROM (SELECT c_custkey, c_mktsegment, row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_custkey) AS rn FROM customer) WHERE rn <= 2")
def smoke_ids(t):
    """Two ids per class; the limit is the operator's."""
    return evaluation.first_per_class(t("customer"), "c_custkey", "c_mktsegment")


@query("SELECT category, coalesce(n, 0) AS n FROM (VALUES ('negative'), ('large'), ('none')) c(category) LEFT JOIN (SELECT category, count(*) AS n FROM (SELECT c_custkey, 'negative' AS category FROM customer WHERE c_acctbal < 0 UNION ALL SELECT c_custkey, 'large' FROM customer WHERE c_acctbal > 9000) GROUP BY category) USING (category)")
def failure_ledger(t):
    return evaluation.failure_ledger(t("customer"), {"negative": F.col("c_acctbal") < 0, "large": F.col("c_acctbal") > 9000, "none": F.lit(False)}, "c_custkey")


@query(f"WITH {_SCORED}, g AS (SELECT * FROM (VALUES ('prefilter_recall', 0.9), ('precision', 0.85), ('recall', 0.8)) v(gate, threshold)), r AS (SELECT avg(CASE WHEN pred IS NOT NULL THEN 1.0 ELSE 0.0 END) FILTER (WHERE gold) AS prefilter_recall, count_if(gold AND pred) / nullif(count_if(pred), 0) AS precision, count_if(gold AND pred) / nullif(count_if(gold AND NOT coalesce(pred, true)) + count_if(gold AND pred), 0) AS recall FROM s), x AS (SELECT gate, CASE gate WHEN 'prefilter_recall' THEN prefilter_recall WHEN 'precision' THEN precision ELSE recall END AS value, CAST(threshold AS DOUBLE) AS threshold FROM g, r) SELECT gate, value, threshold, value >= threshold AS passed FROM x")
def quality_gates(t):
    """Measured rates against their thresholds; texts without a prediction stand for those that the prefilter dropped."""
    s = _scored(t)
    counts = evaluation.binary_counts(s, F.col("gold"), F.col("pred")).select("precision", "recall")
    passed = s.where("gold").agg(F.avg(F.col("pred").isNotNull().cast("int")).alias("prefilter_recall"))
    report = passed.join(F.broadcast(counts))  # one row each
    return evaluation.gates(report).withColumn("threshold", F.col("threshold").cast("double"))


# -- review, precedence, sets -----------------------------------------------------------------------


@query("SELECT o_orderkey AS doc_id, CASE WHEN o_orderkey % 4 = 0 THEN 'human' ELSE o_orderstatus END AS scope, CASE WHEN o_orderkey % 4 = 0 THEN 'human' ELSE 'model' END AS decided_by FROM orders")
def effective_decisions(t):
    m = t("orders").select(F.col("o_orderkey").alias("doc_id"), F.col("o_orderkey").cast("string").alias("decision_id"), F.col("o_orderstatus").alias("scope"))
    h = m.where("doc_id % 4 = 0").select("doc_id", F.explode(F.array(F.lit("h1"), F.lit("h2"))).alias("decision_id")).withColumn("scope", F.when(F.col("decision_id") == "h1", "human").otherwise("later"))
    return review.effective(m, h).select("doc_id", "scope", "decided_by")


@query("SELECT o_orderkey AS case_id, max(l_linenumber) AS line FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY o_orderkey")
def current_cases(t):
    c = t("lineitem").select(F.col("l_orderkey").alias("case_id"), F.lit("model").alias("extractor_type"), F.lit("valid").alias("validation_state"), F.col("l_linenumber").alias("extracted_at"), F.col("l_suppkey").alias("extraction_fingerprint"))
    return review.current_cases(c).select("case_id", F.col("extracted_at").alias("line"))


@query("SELECT c_custkey, c_acctbal FROM customer WHERE c_custkey % 2 = 1 UNION ALL SELECT c_custkey, c_acctbal + 1 FROM customer WHERE c_custkey % 2 = 0")
def upsert_rows(t):
    c = t("customer").select("c_custkey", "c_acctbal")
    return review.upsert(c, c.where("c_custkey % 2 = 0").withColumn("c_acctbal", F.col("c_acctbal") + 1), "c_custkey")


@query("SELECT c_custkey, c_name FROM customer")
def append_new_rows(t):
    c = t("customer").select("c_custkey", "c_name")
    return review.append_new(c.where("c_custkey % 3 <> 0"), c.where("c_custkey % 2 = 0 or c_custkey % 3 = 0"), "c_custkey")


@query("WITH m AS (SELECT conv_id AS thread, CASE WHEN turn % 2 = 0 THEN 'dev' ELSE 'holdout' END AS split FROM conversations) SELECT thread, count(DISTINCT split) AS n_splits, count(*) AS n_members FROM m GROUP BY thread HAVING count(DISTINCT split) >= 2")
def cross_split_families(t):
    c = t("conversations").select(F.format_string("%d-%d", "conv_id", "turn").alias("doc_id"), F.when(F.col("turn") == 0, F.col("conv_id")).alias("source_item_id"), F.when(F.col("turn") > 0, F.col("conv_id")).alias("parent_thread_id"), (F.col("turn") % 2).alias("odd"))
    splits = c.select("doc_id", F.when(F.col("odd") == 0, "dev").otherwise("holdout").alias("split")).distinct()
    return review.cross_split_families(c, splits)


@query("SELECT column, kind, n FROM (SELECT '*' AS column, 'missing_in_other' AS kind, count(*) AS n FROM customer WHERE c_custkey % 10 = 0 UNION ALL SELECT 'c_acctbal', 'different', count(*) FROM customer WHERE c_custkey % 10 <> 0 AND c_custkey % 7 = 0) WHERE n > 0".replace("column", '"column"'))
def snapshot_cross_check(t):
    a = t("customer").select("c_custkey", "c_name", "c_acctbal")
    b = a.where("c_custkey % 10 <> 0").withColumn("c_acctbal", F.when(F.col("c_custkey") % 7 == 0, F.col("c_acctbal") + 1).otherwise(F.col("c_acctbal")))
    return review.cross_check(a, b, "c_custkey", ["c_name", "c_acctbal"])


@query("SELECT o_orderkey AS case_id, CASE WHEN o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R') THEN 'R' ELSE 'uncertain' END AS cluster_id FROM orders")
def cluster_assignment(t):
    k = t("lineitem").where("l_returnflag = 'R'").groupBy("l_orderkey").agg(F.first("l_returnflag").alias("cluster_id")).select("cluster_id", F.array("l_orderkey").alias("case_ids"))
    return review.assign_clusters(t("orders").select(F.col("o_orderkey").alias("case_id")), k)


# -- batches, datasets, reports ---------------------------------------------------------------------


def _sound(t) -> DataFrame:
    return t("customer").select(F.col("c_custkey").alias("doc_id"), F.when(F.col("c_acctbal") < 0, F.array(F.lit("hash_mismatch"))).otherwise(F.array().cast("array<string>")).alias("reasons"))


@query("SELECT count(*) AS total, count(*) FILTER (WHERE c_acctbal < 0) AS failed, count(*) FILTER (WHERE c_acctbal >= 0 AND c_custkey % 4 = 0) AS frozen, count(*) FILTER (WHERE c_acctbal >= 0 AND c_custkey % 4 <> 0) AS eligible, least(count(*) FILTER (WHERE c_acctbal >= 0 AND c_custkey % 4 <> 0), 50) AS taken, count(*) FILTER (WHERE c_acctbal >= 0 AND c_custkey % 4 <> 0) - least(count(*) FILTER (WHERE c_acctbal >= 0 AND c_custkey % 4 <> 0), 50) AS held_back FROM customer")
def batch_plan(t):
    d = _sound(t)
    return assembly.batch_counts(d, d.where("doc_id % 4 = 0"), 50)


@query("SELECT count(*) FILTER (WHERE c_custkey % 5 = 0) AS withheld, count(*) FILTER (WHERE c_custkey % 5 = 0 AND c_custkey % 2 = 0) AS overlap, count(*) FILTER (WHERE c_custkey % 5 <> 0 AND c_custkey % 2 = 0) AS used, count(*) FILTER (WHERE c_custkey % 5 <> 0 AND c_custkey % 2 <> 0) AS unassigned FROM customer")
def split_policy_counts(t):
    d = _sound(t)
    return assembly.split_policy(d, d.where("doc_id % 2 = 0"), d.where("doc_id % 5 = 0"))[1]


@query("SELECT o_orderstatus, count(*) AS n, count(*) FILTER (WHERE o_totalprice > 100000) AS eligible, count(*) FILTER (WHERE o_totalprice <= 100000) AS ineligible FROM orders GROUP BY ALL")
def verdict_counts(t):
    verdict, reasons = extraction.assess({"too_small": F.col("o_totalprice") <= 100000})
    return assembly.verdict_counts(t("orders").select("o_orderstatus", verdict.alias("verdict"), reasons.alias("reasons")), "o_orderstatus", ["eligible", "ineligible"])


@query("SELECT count(*) FILTER (WHERE coalesce(CASE WHEN o_orderkey % 3 = 0 THEN 'out_of_scope' END, CASE WHEN o_orderkey % 2 = 0 THEN 'core' END) = 'out_of_scope') AS excluded, count(*) FILTER (WHERE o_orderkey % 3 <> 0 AND o_orderkey % 2 <> 0) AS undecided FROM orders")
def excluded_documents(t):
    o = t("orders").select(F.col("o_orderkey").alias("doc_id"))
    return assembly.excluded_count(o, o.where("doc_id % 3 = 0").withColumn("scope", F.lit("out_of_scope")), o.where("doc_id % 2 = 0").withColumn("scope", F.lit("core")))


@query(f"WITH {_LINKS}, sure AS (SELECT doc_id, min(canonical_doc_id) AS c FROM links WHERE review_state = 'auto_confirmed' GROUP BY doc_id) SELECT (SELECT count(*) FROM documents) AS n_documents, (SELECT count(DISTINCT coalesce(c, d.doc_id)) FROM documents d LEFT JOIN sure ON d.doc_id = sure.doc_id) AS n_canonical, (SELECT count(*) FROM links WHERE review_state <> 'pending_review') AS n_confirmed, (SELECT count(*) FROM links WHERE review_state = 'pending_review') AS n_pending, (SELECT count(*) FROM labels) AS n_cases, (SELECT count(*) FROM labels WHERE quality = 1) AS n_valid, (SELECT count(DISTINCT doc_id) FROM labels) AS n_case_documents")
def dataset_summary(t):
    cases = t("labels").select("doc_id", F.when(F.col("quality") == 1, "valid").otherwise("invalid").alias("validation_state"))
    return assembly.summary(t("documents"), _links(t), cases)


@query("SELECT o_orderkey AS card, min(c_custkey) AS record FROM orders JOIN customer ON c_custkey = o_custkey OR c_custkey = o_orderkey GROUP BY o_orderkey")
def reference_overlap(t):
    index = assembly.key_index(t("customer"), "c_custkey", ["c_custkey"])
    return assembly.overlaps(t("orders"), "o_orderkey", ["o_custkey", "o_orderkey"], index)


@query("""
WITH s AS (SELECT l_returnflag AS g, CASE WHEN l_orderkey % 7 = 0 THEN NULL WHEN l_linestatus = 'O' THEN 'N' ELSE 'R' END AS p FROM lineitem),
c AS (SELECT count(*) AS n, count(*) FILTER (WHERE p IS NULL) AS abstained, count(*) FILTER (WHERE g IS NOT DISTINCT FROM p) AS correct,
 count(*) FILTER (WHERE g = 'N' AND p = 'N') AS tn, count(*) FILTER (WHERE p = 'N') AS pn, count(*) FILTER (WHERE g = 'N') AS gn, count(*) FILTER (WHERE g = 'R' AND p = 'R') AS tr, count(*) FILTER (WHERE p = 'R') AS pr, count(*) FILTER (WHERE g = 'R') AS gr, count(*) FILTER (WHERE g = 'A') AS ga FROM s)
SELECT n, abstained, round(correct / n, 6) AS accuracy, round(tn / pn, 6) AS precision_N, round(tn / gn, 6) AS recall_N, round(tr / pr, 6) AS precision_R, round(tr / gr, 6) AS recall_R, 0.0 AS precision_A, 0.0 AS recall_A, round((round(tn / pn, 6) + round(tr / pr, 6)) / 3, 6) AS macro_precision, round((round(tn / gn, 6) + round(tr / gr, 6)) / 3, 6) AS macro_recall, round(tr / pr, 6) AS binary_precision, round(tr / gr, 6) AS binary_recall FROM c""")
def three_way_scores(t):
    p = F.when(F.col("l_orderkey") % 7 == 0, None).when(F.col("l_linestatus") == "O", "N").otherwise("R")
    return assembly.three_way_scores(t("lineitem").select(F.col("l_returnflag").alias("g"), p.alias("p")), "g", "p", ["N", "R", "A"], ["R"])


@query("SELECT 'repeated_url' AS warning, url AS value, count(*) AS n FROM pages GROUP BY url HAVING count(*) > 1 UNION ALL SELECT 'kept_count', '-1', count(*) FROM pages")
def import_warnings(t):
    return assembly.import_warnings(t("pages").select("url", F.lit(None).cast("string").alias("alias")), -1)


@query("SELECT CAST(CASE WHEN rn <= 20 THEN 1 WHEN rn <= 40 THEN 2 ELSE 3 END AS INTEGER) AS lot, event_id AS id, count(*) OVER () AS succeeded, 3 AS failed FROM (SELECT event_id, row_number() OVER (ORDER BY event_id) AS rn FROM events) WHERE rn <= 50")
def fold_batches(t):
    """A scheduled batch holds 50 items; that limit is the operator's."""
    b = incremental.lots(t("events").select("event_id"), ["event_id"]).groupBy("lot").agg(F.count("*").alias("succeeded"), F.lit(1).alias("failed"), F.sort_array(F.collect_list("event_id")).alias("ids"))
    return assembly.fold_outcomes(b)
