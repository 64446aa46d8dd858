"""Queries over relations of cases, gold labels, reviews, outcomes and events, with the SQL that gives the same rows.

Relations are written once, in SQL that both engines read, over the driver's tables: orders stand for documents and
cases, lineitem for spans and decisions, events for stage events, conversations for threads.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import ids, text, urls
from ..operators import assembly, dedupe, evaluation, evidence, extraction, retrieval, review, routing
from ..sources import readers
from ..streaming import incremental
from .registry import query
from .views import VIEWS


def rel(t, sql: str) -> DataFrame:
    """A relation from its SQL; ``{name}`` stands for a table of the driver."""
    names = {n for n in ("customer", "documents", "events", "lineitem", "orders", "pages", "part", "conversations", "labels", "benchmark", "supplier", "nation") if "{" + n + "}" in sql}
    tables = {n: t(n) for n in names}
    return next(iter(tables.values())).sparkSession.sql(sql, **tables)


def duck(**relations: str) -> str:
    """The same relations as common table expressions."""
    names = {n: n for n in ("customer", "documents", "events", "lineitem", "orders", "pages", "part", "conversations", "labels", "benchmark", "supplier", "nation")}
    return "WITH " + ", ".join(f"{k} AS ({v.format(**names)})" for k, v in relations.items())


# -- ids, URLs, spans -------------------------------------------------------------------------------

DOCS = "SELECT CAST(o_orderkey AS STRING) AS doc_id, o_orderpriority AS platform, CASE WHEN o_orderkey % 3 = 0 THEN 'it' || CAST(o_custkey AS STRING) ELSE '' END AS item, CASE WHEN o_orderkey % 3 <> 2 THEN 'https://s.example/' || CAST(o_custkey AS STRING) END AS url_key, o_orderstatus AS name, CASE WHEN o_orderkey % 2 = 0 THEN 'a' || CAST(o_custkey AS STRING) END AS author, CAST(o_orderkey AS STRING) || ' text' AS body FROM {orders}"


@query(f"{duck(d=DOCS)} SELECT doc_id AS k, platform || '-' || substr(sha1(platform || '|' || CASE WHEN item <> '' THEN item WHEN url_key IS NOT NULL THEN url_key ELSE sha1(name || '|' || coalesce(author, 'anon') || '||' || sha256(body)) END), 1, 12) AS doc_id FROM d")
def document_ids(t):
    c = F.col
    return rel(t, DOCS).select(c("doc_id").alias("k"), ids.doc_id(c("platform"), c("item"), c("url_key"), text.raw_hash(c("body")), c("name"), c("author")).alias("doc_id"))


SPANS = "SELECT CAST(l_orderkey AS STRING) AS owner_id, CAST(l_linenumber AS INT) AS pos, l_returnflag || l_linestatus AS quote, CAST(l_partkey % 40 AS INT) AS start, CASE WHEN l_suppkey % 4 <> 0 THEN CAST(l_partkey % 40 + CAST(l_quantity AS INT) AS INT) END AS stop, CASE l_returnflag WHEN 'A' THEN 'ambiguous' WHEN 'N' THEN 'valid' ELSE 'rejected' END AS validation_state, CAST(l_partkey % 5 AS STRING) AS field_name, CAST(l_suppkey AS STRING) AS supp FROM {lineitem}"


@query(f"{duck(s=SPANS)} SELECT owner_id, pos, supp, owner_id || '#u' || substr(sha1(quote || supp), 1, 8) AS case_id, substr(sha1(owner_id || '|' || field_name || '|' || CASE WHEN stop IS NULL THEN '' ELSE start || '|' || stop || '|' END || sha1(quote)), 1, 12) AS evidence_id, substr(sha1('run1|extract|' || owner_id || '|' || pos || '|' || validation_state), 1, 12) AS event_id FROM s")
def record_ids(t):
    c = F.col
    return rel(t, SPANS).select("owner_id", "pos", "supp", ids.unordered_case_id(c("owner_id"), F.concat("quote", "supp")).alias("case_id"), ids.evidence_id(c("owner_id"), c("field_name"), c("quote"), c("start"), c("stop")).alias("evidence_id"), ids.event_id(F.lit("run1"), F.lit("extract"), c("owner_id"), c("pos"), c("validation_state")).alias("event_id"))


LINKS = "SELECT c_custkey AS k, CASE c_custkey % 8 WHEN 0 THEN ' HTTPS://WWW.Site.Example/a/b//?z=1&utm_source=q&b=x%20y&a=q/b&c#frag' WHEN 1 THEN 'https://youtu.be/vid' || CAST(c_custkey AS STRING) || 'xx?t=5&utm_x=1' WHEN 2 THEN 'http://m.youtube.com/shorts/id' || CAST(c_custkey AS STRING) || 'yy/' WHEN 3 THEN 'https://old.reddit.com/r/p/comments/' || CAST(c_custkey AS STRING) || 'ab/t/?ref=x' WHEN 4 THEN 'example.com/a?x=1&y' WHEN 5 THEN 'https://s.example/?q=%zz+1&Q=~*' WHEN 6 THEN 'https://www.youtube.com/watch?v=v' || CAST(c_custkey AS STRING) || 'abcdef&lc=Ug' ELSE 'https://x.example' END AS url FROM {customer}"


@query(f"""{duck(u=LINKS)} SELECT k,
CASE k % 8 WHEN 0 THEN 'https://www.site.example/a/b?a=q%2Fb&b=x+y&c=&z=1' WHEN 1 THEN 'https://youtu.be/vid' || k || 'xx?t=5&utm_x=1' WHEN 2 THEN 'http://m.youtube.com/shorts/id' || k || 'yy' WHEN 3 THEN 'https://old.reddit.com/r/p/comments/' || k || 'ab/t' WHEN 4 THEN 'example.com/a?x=1&y=' WHEN 5 THEN 'https://s.example/?Q=~%2A&q=%25zz+1' WHEN 6 THEN 'https://www.youtube.com/watch?lc=Ug&v=v' || k || 'abcdef' ELSE 'https://x.example' END AS url_key,
CASE k % 8 WHEN 0 THEN 'https://site.example/a/b?a=q%2Fb&b=x+y&c=&z=1' WHEN 1 THEN 'https://youtube.com/watch?t=5&v=vid' || k || 'xx' WHEN 2 THEN 'http://youtube.com/watch?v=id' || k || 'yy' WHEN 3 THEN 'https://reddit.com/r/p/comments/' || k || 'ab/t' WHEN 4 THEN 'https:example.com/a?x=1&y=' WHEN 5 THEN 'https://s.example/?Q=~%2A&q=%25zz+1' WHEN 6 THEN 'https://youtube.com/watch?lc=Ug&v=v' || k || 'abcdef' ELSE 'https://x.example' END AS canonical_url,
CASE k % 8 WHEN 1 THEN 'vid' || k || 'xx' WHEN 2 THEN 'id' || k || 'yy' WHEN 6 THEN 'v' || k || 'abcdef' END AS video_id, CASE WHEN k % 8 = 3 THEN k || 'ab' END AS thread_id, k % 8 = 3 AS forum FROM u WHERE CASE k % 8 WHEN 1 THEN length('vid' || k || 'xx') >= 6 WHEN 2 THEN length('id' || k || 'yy') >= 6 ELSE true END""")
def url_forms(t):
    """Every rule of the two URL forms; ids too short for a video are left to the tests."""
    u = F.col("url")
    got = rel(t, LINKS).select("k", urls.url_key(u).alias("url_key"), urls.canonical_url(u).alias("canonical_url"), urls.video_id(u).alias("video_id"), urls.thread_id(u).alias("thread_id"), urls.is_forum_link(u).alias("forum"))
    return got.where(~F.col("k").bitwiseAND(7).isin(1, 2) | F.col("video_id").isNotNull())


@query(f"""{duck(s=SPANS)}, o AS (SELECT owner_id, start, stop, coalesce(max(stop) OVER (PARTITION BY owner_id ORDER BY start, stop ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) < start, true) AS new FROM s WHERE stop IS NOT NULL),
i AS (SELECT *, sum(CASE WHEN new THEN 1 ELSE 0 END) OVER (PARTITION BY owner_id ORDER BY start, stop ROWS UNBOUNDED PRECEDING) AS island FROM o)
SELECT owner_id, min(start) AS start, max(stop) AS stop FROM i GROUP BY owner_id, island""")
def merged_spans(t):
    s = rel(t, SPANS).where("stop is not null").groupBy("owner_id").agg(F.collect_list(F.struct("start", "stop")).alias("spans"))
    return s.select("owner_id", F.inline(text.merged(F.col("spans"))))


@query("SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN [2, 7, 10, 14] WHEN doc_id % 3 = 1 THEN [2, 9] ELSE [] END AS edges FROM documents WHERE length(text) >= 20")
def highlights(t):
    """Spans that still match their quote, merged; two apart, two that overlap, or one that no longer fits."""
    x = F.col("text")
    part = lambda a, b: F.struct(F.lit(a).alias("start"), F.lit(b).alias("stop"), F.substring(x, a + 1, b - a).alias("quote"))
    wrong = F.struct(F.lit(0).alias("start"), F.lit(4).alias("stop"), F.lit("\x01").alias("quote"))
    spans = F.when(F.col("doc_id") % 3 == 0, F.array(part(10, 14), wrong, part(2, 7))).when(F.col("doc_id") % 3 == 1, F.array(part(2, 7), part(5, 9))).otherwise(F.array(wrong))
    return t("documents").where("length(text) >= 20").select("doc_id", F.flatten(F.transform(text.highlighted(x, spans), lambda s: F.array(s["start"], s["stop"]))).alias("edges"))


@query("SELECT c_custkey, CASE WHEN c_custkey % 10 <> 0 AND c_custkey % 2 = 0 THEN ['a', 'b' || c_custkey] ELSE [] END AS panel FROM customer")
def evidence_panels(t):
    """What an answer cites; one that cites something it was not shown has no panel."""
    k = F.col("c_custkey").cast("string")
    answer = F.concat(F.lit("so [b"), k, F.lit("] and [a], [a]"), F.when(F.col("c_custkey") % 5 == 0, " not [zz]").otherwise(""))
    shown = F.when(F.col("c_custkey") % 2 == 0, F.array(F.lit("a"), F.concat(F.lit("b"), k))).otherwise(F.array(F.lit("c"), F.lit("a")))
    return t("customer").select("c_custkey", retrieval.evidence_panel(answer, shown).alias("panel"))


@query("SELECT doc_id, substr(trim(regexp_replace(coalesce(text, ''), '[\\s\\x0b\\x{85}\\p{Z}]+', ' ', 'g')), 1, 160) AS excerpt, CASE WHEN contains(coalesce(text, ''), 'the of') THEN [] ELSE ['the of'] END AS broken FROM documents")
def excerpts(t):
    x = F.coalesce("text", F.lit(""))
    return t("documents").select("doc_id", text.excerpt(x).alias("excerpt"), evidence.noncontinuous(x, F.array(F.lit("the of"), F.lit("the of"))).alias("broken"))


@query("SELECT c_custkey, replace(replace(c_name, 'Customer', '[name]'), '#0', '[name]') AS report, CASE WHEN c_custkey % 3 = 0 THEN 'b' WHEN c_custkey % 3 = 1 THEN 'a' END AS code FROM customer")
def scrubbed_reports(t):
    """Author names hidden in a report, and the first review code by priority."""
    codes = F.when(F.col("c_custkey") % 3 == 0, F.array(F.lit("z"), F.lit("b"))).when(F.col("c_custkey") % 3 == 1, F.array(F.lit("b"), F.lit("a"))).otherwise(F.array(F.lit("z")))
    return t("customer").select("c_custkey", text.scrubbed(F.col("c_name"), F.array(F.lit("Customer"), F.lit("#0"))).alias("report"), evidence.first_code(codes, ["a", "b"]).alias("code"))


# -- routing ----------------------------------------------------------------------------------------

_PHRASES = [(p, r) for r, ps in routing.EXCLUSIONS.items() for p in ps] + [(p, "") for p in routing.RETRIEVAL]
_SAY = "'" + "|".join(p.replace("'", "''") for p, _ in _PHRASES) + "'"
_HITS = ", ".join("{'p': '%s', 'r': '%s'}" % (p.replace("'", "''"), r) for p, r in _PHRASES if r)
_ANY = " OR ".join("contains(n, '%s')" % p.replace("'", "''") for p in routing.RETRIEVAL)
_WORD = lambda ws: " OR ".join(f"contains(' ' || n || ' ', ' {w} ')" for w in ws)
_ROUTED = f"""m AS (SELECT conv_id || '-' || turn AS doc_id, conv_id, turn, lower(trim(regexp_replace(coalesce(text, '') || ' ' || string_split({_SAY}, '|')[(conv_id * 7 + turn) % {len(_PHRASES)} + 1] || ' and ' || string_split({_SAY}, '|')[(conv_id + turn * 5) % {len(_PHRASES)} + 1] || CASE WHEN conv_id % 5 = 0 THEN ' i searched a photo' ELSE '' END, '[\\s\\x0b\\x{{85}}\\p{{Z}}]+', ' ', 'g'))) AS n FROM conversations),
h AS (SELECT *, list_filter([{_HITS}], lambda s: contains(n, s.p)) AS hits, {_ANY} OR (({_WORD(routing.SEARCH_WORDS)}) AND ({_WORD(routing.PHOTO_WORDS)})) AS wanted, CASE WHEN turn > 0 AND conv_id % 4 = 0 THEN conv_id || '-0' END AS canonical_doc_id FROM m),
x AS (SELECT *, canonical_doc_id IS NULL AND len(hits) >= 2 AND NOT wanted AS excluded FROM h),
r AS (SELECT doc_id, min_by(r, (-c, r)) AS reason, string_agg(DISTINCT r, ',' ORDER BY r) AS reasons FROM (SELECT doc_id, u.r AS r, count(*) AS c FROM (SELECT doc_id, unnest(hits) AS u FROM x) GROUP BY doc_id, u.r) GROUP BY doc_id),
routed AS (SELECT x.doc_id, CASE WHEN canonical_doc_id IS NOT NULL THEN 'skipped_non_canonical' WHEN excluded THEN 'obvious_exclusion_candidate' ELSE 'classify' END AS route, canonical_doc_id IS NULL AND NOT excluded AS passed, CASE WHEN excluded THEN 'out_of_scope' END AS candidate_scope_class, CAST(CASE WHEN canonical_doc_id IS NULL THEN len(hits) ELSE 0 END AS INTEGER) AS n_signals,
 CASE WHEN canonical_doc_id IS NOT NULL THEN 'non_canonical_duplicate' WHEN wanted AND len(hits) > 0 THEN 'mixed_retrieval_and_exclusion' WHEN excluded THEN reasons WHEN len(hits) = 1 THEN 'single_signal_retained' ELSE 'retained_for_recall' END AS labels, CASE WHEN excluded THEN reason END AS drop_reason_code, canonical_doc_id FROM x LEFT JOIN r USING (doc_id))"""


def _routed(t) -> DataFrame:
    """Turns with two phrases of the operator's own lists put at their end; some turns are copies of their thread's first."""
    say = F.array(*[F.lit(p) for p, _ in _PHRASES])
    c, n = t("conversations"), len(_PHRASES)
    at = lambda k: F.element_at(say, (k % n + 1).cast("int"))
    key = F.concat_ws("-", "conv_id", "turn")
    words = F.concat(F.coalesce("text", F.lit("")), F.lit(" "), at(F.col("conv_id") * 7 + F.col("turn")), F.lit(" and "), at(F.col("conv_id") + F.col("turn") * 5), F.when(F.col("conv_id") % 5 == 0, " i searched a photo").otherwise(""))
    canonical = c.where("turn > 0 and conv_id % 4 = 0").select(key.alias("doc_id"), F.concat(F.col("conv_id").cast("string"), F.lit("-0")).alias("canonical_doc_id")).distinct()
    return routing.prefilter(c.select(key.alias("doc_id"), text.collapse(words).alias("normalized_text")), canonical)


@query(f"WITH {_ROUTED} SELECT * FROM routed")
def prefilter_rules(t):
    return _routed(t).withColumn("labels", F.array_join("reason_labels", ",")).drop("reason_labels")


@query(f"WITH {_ROUTED} SELECT route, count(*) AS n_docs, count_if(passed) AS n_passed FROM routed GROUP BY route")
def route_counts(t):
    return routing.route_counts(_routed(t))


# -- duplicates -------------------------------------------------------------------------------------

ITEMS = "SELECT o_orderkey AS doc_id, CASE WHEN o_orderkey % 4 = 0 THEN 'it' || CAST(o_custkey AS STRING) WHEN o_orderkey % 4 = 1 THEN '' END AS source_item_id, CASE WHEN o_orderkey % 4 <> 3 THEN 'https://s.example/it' || CAST(o_custkey AS STRING) ELSE 'https://s.example/none' END AS canonical_url FROM {orders}"


@query(f"{duck(i=ITEMS)}, j AS (SELECT doc_id, nullif(source_item_id, '') AS item, canonical_url AS url FROM i), r AS (SELECT item, min(doc_id) AS rep FROM j WHERE item IS NOT NULL GROUP BY item), h AS (SELECT url, item, min(doc_id) AS rep FROM j WHERE contains(url, item) GROUP BY url, item) SELECT rep AS l_doc_id, doc_id AS r_doc_id FROM j JOIN r USING (item) WHERE doc_id <> rep UNION SELECT least(rep, doc_id), greatest(rep, doc_id) FROM j JOIN h ON j.url = h.url WHERE j.item IS NULL")
def same_source_links(t):
    return dedupe.same_source_pairs(rel(t, ITEMS))


@query("WITH p AS (SELECT p_partkey AS doc_id, CAST(p_size AS BIGINT) * 65537 AS h FROM part), k AS (SELECT h, min(doc_id) AS rep FROM p GROUP BY h), q AS (SELECT a.rep AS a, b.rep AS b, CAST(bit_count(xor(a.h, b.h)) AS INTEGER) AS distance FROM k a JOIN k b ON a.rep < b.rep UNION ALL SELECT rep, doc_id, 0 FROM p JOIN k USING (h) WHERE doc_id > rep), far AS (SELECT *, true AS control FROM q WHERE distance > 6 ORDER BY distance, a, b LIMIT 10) SELECT a, b, distance, control, CASE WHEN control THEN 'nearest_negative_control' WHEN distance <= 3 THEN 'automatic_band' ELSE 'review_band' END AS selection_reason, CASE WHEN distance = 0 AND b % 2 = 0 THEN CASE WHEN b % 3 = 0 THEN 'auto_confirmed' ELSE 'human_confirmed' END ELSE 'none' END AS action FROM (SELECT *, false AS control FROM q WHERE distance <= 6 UNION ALL SELECT * FROM far)")
def calibration(t):
    """All pairs in the band and the ten nearest beyond it (that number is the operator's), with the first link of each pair."""
    k = F.col("p_partkey")
    prints = t("part").select(k.alias("doc_id"), (F.col("p_size").cast("long") * 65537).alias("simhash"))
    reps = prints.groupBy("simhash").agg(F.min("doc_id").alias("canonical_doc_id"))
    pairs = prints.join(reps, "simhash").where("doc_id <> canonical_doc_id AND doc_id % 2 = 0").select("doc_id", "canonical_doc_id")
    later = pairs.select("doc_id", "canonical_doc_id", F.concat(F.lit("b"), F.col("doc_id").cast("string")).alias("link_id"), F.lit("human_confirmed").alias("review_state"))
    earlier = pairs.where("doc_id % 3 = 0").select(F.col("canonical_doc_id").alias("doc_id"), F.col("doc_id").alias("canonical_doc_id"), F.concat(F.lit("a"), F.col("doc_id").cast("string")).alias("link_id"), F.lit("auto_confirmed").alias("review_state"))
    return dedupe.calibration_rows(prints, later.union(earlier))


# -- evidence ---------------------------------------------------------------------------------------


@query(f"{duck(s=SPANS)}, l AS (SELECT owner_id, quote AS evidence_id, pos, validation_state, CASE validation_state WHEN 'rejected' THEN 0 WHEN 'ambiguous' THEN 1 ELSE 2 END AS level FROM s) SELECT owner_id, evidence_id, min(pos) AS pos, min_by(validation_state, (level, pos)) AS validation_state FROM l GROUP BY ALL")
def deduped_spans(t):
    return evidence.dedupe_spans(rel(t, SPANS).withColumnRenamed("quote", "evidence_id"), {"rejected": 0, "ambiguous": 1, "valid": 2})


CASES = "SELECT l_orderkey AS doc_id, l_linenumber AS line, CASE WHEN l_suppkey % 4 <> 0 THEN CAST(l_quantity AS INT) END AS start, CAST(l_quantity AS INT) + 5 AS stop, l_returnflag AS quote, CAST(l_orderkey AS STRING) || '-' || CAST(l_linenumber AS STRING) || '-' || CAST(l_partkey AS STRING) || '-' || CAST(l_suppkey AS STRING) AS payload FROM {lineitem}"


@query(f"{duck(c=CASES)} SELECT payload, CASE WHEN start IS NOT NULL THEN CAST(row_number() OVER (PARTITION BY doc_id, start IS NOT NULL ORDER BY start, stop, sha1(quote), sha1(payload)) AS INTEGER) END AS ordinal, CASE WHEN start IS NOT NULL THEN doc_id || '#c' || printf('%02d', row_number() OVER (PARTITION BY doc_id, start IS NOT NULL ORDER BY start, stop, sha1(quote), sha1(payload))) ELSE doc_id || '#u' || substr(sha1(payload), 1, 8) END AS case_id FROM c")
def case_ordinals(t):
    return evidence.case_ordinals(rel(t, CASES)).select("payload", "ordinal", "case_id")


@query(f"{duck(s=SPANS)} SELECT count(*) AS n, count_if(validation_state = 'valid') / count(*) AS rate FROM s")
def span_validation_rate(t):
    return evaluation.span_validation_rate(rel(t, SPANS))


@query("SELECT doc_id, CASE WHEN text IS NULL THEN NULL WHEN strpos(text, '@') > 0 AND regexp_matches(text, '[A-Za-z0-9._%+\\-]+@[A-Za-z0-9.\\-]+\\.[A-Za-z]{2,}') THEN true ELSE false END AS meets FROM documents")
def redaction_overlap(t):
    """Whether a quote of the whole text meets masked e-mail addresses."""
    x = F.col("text")
    mails = text.matches(x, text.PII[0][1], "email")
    return t("documents").select("doc_id", F.when(x.isNotNull(), F.exists(mails, lambda r: (r["start"] < F.length(x)) & (r["stop"] > 0))).alias("meets"))


# -- gold -------------------------------------------------------------------------------------------


@query("""
WITH g AS (SELECT doc_id, text, 'g' || i AS gold_id, substr(text, 9 * i, 12) AS q1, CASE WHEN i = 2 THEN substr(text, 3, 6) ELSE 'absent quote' END AS q2 FROM documents, (VALUES (1), (2)) v(i) WHERE length(text) >= 60),
c AS (SELECT doc_id, 'c' || j AS case_id, 10 * j AS s, 10 * j + 9 AS e FROM documents, (VALUES (1), (2)) v(j) WHERE length(text) >= 60),
q AS (SELECT doc_id, text, gold_id, unnest(list_distinct([q1, q2])) AS quote FROM g),
o AS (SELECT DISTINCT doc_id, gold_id, quote, p - 1 AS s1 FROM (SELECT *, unnest(range(1, length(text) - length(quote) + 2)) AS p FROM q) WHERE substr(text, p, length(quote)) = quote),
hit AS (SELECT DISTINCT o.doc_id, gold_id, case_id, quote FROM o JOIN c ON o.doc_id = c.doc_id AND s1 < e AND s < s1 + length(quote))
SELECT doc_id, gold_id, case_id, count(*) AS score FROM hit GROUP BY ALL""")
def gold_overlaps(t):
    """Quotes of gold cases against spans of found ones, by every occurrence in the text."""
    d, x = t("documents").where("length(text) >= 60"), F.col("text")
    gold = d.select("doc_id", F.explode(F.array(F.struct(F.lit("g1").alias("gold_id"), F.array(F.substring(x, 9, 12), F.lit("absent quote")).alias("quotes")), F.struct(F.lit("g2").alias("gold_id"), F.array(F.substring(x, 18, 12), F.substring(x, 3, 6)).alias("quotes")))).alias("g")).select("doc_id", "g.*")
    span = lambda j: F.array(F.struct(F.lit("a span").alias("quote"), F.lit(10 * j).alias("start"), F.lit(10 * j + 9).alias("stop")))
    cases = d.select("doc_id", F.explode(F.array(F.struct(F.lit("c1").alias("case_id"), span(1).alias("spans")), F.struct(F.lit("c2").alias("case_id"), span(2).alias("spans")))).alias("c")).select("doc_id", "c.*")
    return evaluation.overlap_scores(gold, cases, d.select("doc_id", "text"))


SCORES = "SELECT CAST(l_orderkey AS STRING) AS doc_id, 'g' || CAST(l_partkey % 2 AS STRING) AS gold_id, 'c' || CAST(l_suppkey % 2 AS STRING) AS case_id, CAST(max(l_linenumber) AS BIGINT) AS score FROM {lineitem} GROUP BY l_orderkey, l_partkey % 2, l_suppkey % 2"


@query(f"""{duck(s=SCORES)}, f AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, gold_id, case_id) AS rn FROM s) WHERE rn = 1)
SELECT doc_id, gold_id, case_id, score FROM f UNION ALL SELECT s.doc_id, s.gold_id, s.case_id, s.score FROM s JOIN f ON s.doc_id = f.doc_id AND s.gold_id <> f.gold_id AND s.case_id <> f.case_id""")
def gold_matches(t):
    """One-to-one matches, the best first; of two by two, what is left after the best is the second."""
    return evaluation.greedy_matches(rel(t, SCORES))


@query("SELECT o_orderkey AS doc_id, CAST(o_custkey % 4 AS BIGINT) AS expected_case_count, coalesce(n, 0) AS n FROM orders LEFT JOIN (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY l_orderkey) ON l_orderkey = o_orderkey WHERE coalesce(n, 0) <> o_custkey % 4")
def case_count_mismatches(t):
    return evaluation.reconcile_counts(t("orders").select(F.col("o_orderkey").alias("doc_id"), (F.col("o_custkey") % 4).alias("expected_case_count")), t("lineitem").select(F.col("l_orderkey").alias("doc_id")))


PRED = "SELECT o_orderkey AS doc_id, o_orderstatus AS gold, CASE WHEN o_orderkey % 5 = 0 THEN NULL WHEN o_orderkey % 3 = 0 THEN 'F' ELSE o_orderstatus END AS pred, CASE WHEN o_custkey % 2 = 0 THEN 'dev' ELSE 'holdout' END AS split FROM {orders}"


@query(f"{duck(p=PRED)} SELECT * FROM p WHERE split = 'dev' AND gold IS DISTINCT FROM pred")
def error_rows(t):
    return assembly.error_rows(rel(t, PRED), "gold", "pred")


# -- review and sets --------------------------------------------------------------------------------


@query(f"{duck(p=PRED)} SELECT doc_id, pred AS scope, gold AS approved_scope FROM p WHERE doc_id % 2 = 0 AND gold IS DISTINCT FROM pred")
def label_disagreements(t):
    p = rel(t, PRED)
    return review.disagreements(p.select("doc_id", F.col("pred").alias("scope")), p.where("doc_id % 2 = 0").select("doc_id", F.col("gold").alias("scope")), ["scope"])


TURNS = "SELECT CAST(conv_id AS STRING) || '-' || CAST(turn AS STRING) AS doc_id, CASE WHEN turn = 0 AND conv_id % 5 <> 0 THEN 't' || CAST(conv_id AS STRING) END AS source_item_id, CASE WHEN turn > 0 THEN 't' || CAST(conv_id AS STRING) END AS parent_thread_id, CASE WHEN conv_id % 3 = 0 THEN 'holdout' ELSE 'dev' END AS split FROM {conversations}"


@query(f"{duck(c=TURNS)}, p AS (SELECT source_item_id, min(doc_id) AS parent, min(split) AS split FROM c WHERE source_item_id IS NOT NULL GROUP BY source_item_id) SELECT c.doc_id, CASE WHEN p.split = 'dev' THEN parent END AS parent_doc_id, CASE WHEN parent IS NULL THEN 'missing' WHEN p.split = 'holdout' THEN 'withheld' ELSE 'resolved' END AS outcome FROM c LEFT JOIN p ON p.source_item_id = c.parent_thread_id WHERE c.parent_thread_id IS NOT NULL")
def parent_contexts(t):
    c = rel(t, TURNS)
    return review.parent_context(c.drop("split"), c.select("doc_id", "split").distinct())


@query("SELECT c_custkey, CASE WHEN c_custkey % 3 <> 0 THEN c_name ELSE 'old' END AS generated, CASE WHEN c_custkey % 2 = 0 THEN 'note ' || c_custkey WHEN c_custkey % 3 <> 0 THEN c_mktsegment END AS human FROM customer WHERE c_custkey % 3 <> 0 OR c_custkey % 2 = 0")
def merged_sheets(t):
    c = t("customer")
    fresh = c.where("c_custkey % 3 <> 0").select("c_custkey", F.col("c_name").alias("generated"), F.col("c_mktsegment").alias("human"))
    prior = c.where("c_custkey % 2 = 0").select("c_custkey", F.lit("old").alias("generated"), F.concat(F.lit("note "), F.col("c_custkey").cast("string")).alias("human"))
    return review.merge_sheet(fresh, prior, "c_custkey", ["human"])


QUEUE = "SELECT CAST(c_custkey AS STRING) AS item_id, CASE WHEN c_custkey % 2 = 0 THEN 'open' ELSE 'resolved' END AS state, CAST(NULL AS STRING) AS resolver, CAST(NULL AS STRING) AS researcher_decision, CAST(NULL AS TIMESTAMP) AS resolved_at FROM {customer}"


@query(f"{duck(q=QUEUE)} SELECT * FROM q UNION ALL SELECT item_id, 'resolved', 'me', 'keep', TIMESTAMP '2024-01-02 00:00:00' FROM q WHERE item_id = '4' AND state = 'open'")
def resolved_queue(t):
    return review.resolve(rel(t, QUEUE), "4", "me", "keep", F.lit("2024-01-02").cast("timestamp"))


@query("SELECT event_id, event_type AS stage, value FROM events WHERE event_type NOT IN ('click', 'view') UNION ALL SELECT event_id, event_type, value + 1 FROM events WHERE event_type IN ('click', 'view') AND event_id % 2 = 0")
def replaced_stages(t):
    e = t("events").select("event_id", F.col("event_type").alias("stage"), "value")
    return review.replace_stages(e, e.where("stage in ('click', 'view') and event_id % 2 = 0").withColumn("value", F.col("value") + 1), ["click", "view"])


@query("SELECT c_custkey AS id, 'left' AS side FROM customer WHERE c_custkey % 3 = 0 AND c_custkey % 2 <> 0 UNION ALL SELECT c_custkey, 'right' FROM customer WHERE c_custkey % 2 = 0 AND c_custkey % 3 <> 0")
def set_differences(t):
    c = t("customer").select(F.col("c_custkey").alias("id"))
    return review.same_members(c.where("id % 3 = 0"), c.where("id % 2 = 0"))


@query("SELECT o_orderkey AS case_id, CASE WHEN o_orderkey % 3 = 0 AND o_custkey % 2 = 0 THEN 'human' WHEN o_orderkey % 3 = 1 THEN 'human' ELSE 'model' END AS extractor_type, CASE WHEN o_orderkey % 3 = 0 AND o_custkey % 2 = 0 THEN 9 WHEN o_orderkey % 3 = 1 THEN 7 ELSE 2 END AS extracted_at FROM orders")
def case_precedence(t):
    """A valid human row wins, an invalid one does not, and one that stands alone is all there is."""
    human = F.struct(F.lit("human").alias("extractor_type"), F.when(F.col("o_custkey") % 2 == 0, "valid").otherwise("invalid").alias("validation_state"), F.lit(9).alias("extracted_at"))
    model = lambda at: F.struct(F.lit("model").alias("extractor_type"), F.lit("valid").alias("validation_state"), F.lit(at).alias("extracted_at"))
    alone = F.struct(F.lit("human").alias("extractor_type"), F.lit("invalid").alias("validation_state"), F.lit(7).alias("extracted_at"))
    rows = F.when(F.col("o_orderkey") % 3 == 0, F.array(human, model(1), model(2))).when(F.col("o_orderkey") % 3 == 1, F.array(alone)).otherwise(F.array(model(2), model(1)))
    c = t("orders").select(F.col("o_orderkey").alias("case_id"), F.explode(rows).alias("r")).select("case_id", "r.*").withColumn("extraction_fingerprint", F.lit("f"))
    return review.current_cases(c).select("case_id", "extractor_type", "extracted_at")


# -- batches and assembly ---------------------------------------------------------------------------


@query("SELECT c_custkey, list_filter([CASE WHEN c_custkey % 5 = 0 THEN 'doc_id_mismatch' END, CASE WHEN c_custkey % 3 = 0 THEN 'hash_mismatch' END, CASE WHEN c_custkey % 7 = 0 THEN 'url_key_mismatch' END, CASE WHEN c_custkey % 2 = 0 THEN 'synthetic' END], lambda x: x IS NOT NULL) AS reasons FROM customer")
def provenance_reasons(t):
    k, s = F.col("c_custkey"), F.col("c_name")
    off = lambda m: F.when(k % m != 0, s)
    return t("customer").select("c_custkey", assembly.provenance_reasons(s, off(5), s, off(3), s, off(7), F.when(k % 2 == 0, "synthetic_test").otherwise("direct_user")).alias("reasons"))


@query("SELECT l_orderkey AS case_id, min(l_linenumber) AS dataset FROM lineitem GROUP BY l_orderkey")
def first_dataset_wins(t):
    return assembly.first_wins(t("lineitem").select(F.col("l_orderkey").alias("case_id"), F.col("l_linenumber").alias("dataset")).distinct(), "case_id", ["dataset"])


@query("WITH c AS (SELECT o_orderkey AS case_id, ['e' || o_custkey, 'e1'] AS own FROM orders), x AS (SELECT case_id, e, min(place) AS place FROM (SELECT case_id, unnest(own) AS e, unnest([0, 1]) AS place FROM c UNION ALL SELECT l_orderkey, 'e' || l_suppkey, 100 FROM lineitem WHERE l_orderkey IN (SELECT case_id FROM c)) GROUP BY case_id, e) SELECT case_id, list(e ORDER BY place, e) AS evidence_ids FROM x GROUP BY case_id")
def cases_with_spans(t):
    e = lambda c: F.concat(F.lit("e"), F.col(c).cast("string"))
    cases = t("orders").select(F.col("o_orderkey").alias("case_id"), F.array(e("o_custkey"), F.lit("e1")).alias("evidence_ids"))
    return assembly.with_external_spans(cases, t("lineitem").select(F.col("l_orderkey").alias("owner_id"), e("l_suppkey").alias("evidence_id")))


@query("SELECT l_orderkey || ':' || l_linenumber || ':' || l_partkey || ':' || l_suppkey AS item_id, CAST(o_orderkey AS VARCHAR) AS doc_id FROM lineitem JOIN orders ON o_orderkey = l_orderkey GROUP BY ALL")
def review_targets(t):
    """The document named in a review's target (``doc#case``)."""
    l = t("lineitem")
    reviews = l.select(F.concat_ws(":", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("item_id"), F.concat(F.col("l_orderkey").cast("string"), F.lit("#c0"), F.col("l_linenumber").cast("string")).alias("target_id"))
    return assembly.review_targets(reviews, t("orders").select(F.col("o_orderkey").cast("string").alias("doc_id")))


def _outcomes(t) -> DataFrame:
    """A document per order with its lines as cases; a state from the order's status."""
    cases = t("lineitem").groupBy("l_orderkey").agg(F.collect_list(F.struct(F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("case_id"), (F.col("l_returnflag") == "R").alias("needs_human_review"))).alias("cases"))
    state = F.when(F.col("o_orderstatus") == "F", "ok").when(F.col("o_orderstatus") == "O", "failed").otherwise("blocked")
    o = t("orders").select(F.col("o_orderkey").cast("string").alias("doc_id"), state.alias("state"), F.col("o_orderpriority").alias("reason"), "o_orderkey")
    return o.join(cases, F.col("o_orderkey") == F.col("l_orderkey"), "left").withColumn("cases", F.coalesce("cases", F.array().cast("array<struct<case_id:string,needs_human_review:boolean>>"))).select("doc_id", "state", "reason", "cases")


@query("SELECT 'document' AS target_type, CAST(o_orderkey AS VARCHAR) AS target_id, o_orderpriority AS reason FROM orders WHERE o_orderstatus <> 'F' UNION ALL SELECT 'case', l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey, 'needs_human_review' FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE l_returnflag = 'R'")
def failure_rows(t):
    return assembly.failure_rows(_outcomes(t))


@query("SELECT 'kept' || c_custkey AS case_id FROM customer UNION ALL SELECT l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE l_returnflag = 'R'")
def candidate_cases(t):
    touched = _outcomes(t).select(F.explode("cases").alias("c")).select("c.case_id")
    existing = t("customer").select(F.concat(F.lit("kept"), F.col("c_custkey").cast("string")).alias("case_id")).unionByName(touched)
    return assembly.upsert_candidates(existing, _outcomes(t))


@query("SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN 'approved' WHEN c_custkey % 3 = 0 THEN 'in_review' WHEN c_custkey % 5 = 0 THEN 'has_findings' WHEN c_acctbal > 0 THEN 'valid' ELSE 'unverified' END AS status, CASE c_custkey % 4 WHEN 0 THEN 'succeeded' WHEN 1 THEN 'unavailable' WHEN 2 THEN 'skipped' ELSE 'failed' END AS stage_status FROM customer")
def card_states(t):
    k = F.col("c_custkey")
    outcome = F.when(k % 4 == 0, "completed").when(k % 4 == 1, "rate_limited").when(k % 4 == 2, "unchanged").otherwise("odd")
    return t("customer").select("c_custkey", extraction.card_status(F.col("c_acctbal") > 0, k % 2 == 0, (k % 5 == 0).cast("int"), (k % 3 == 0).cast("int")).alias("status"), extraction.outcome_status(outcome).alias("stage_status"))


@query("SELECT substr(sha1('r1|prefilter|' || o_orderkey || '|1|' || CASE WHEN o_orderstatus = 'F' THEN 'succeeded' ELSE 'skipped' END), 1, 12) AS event_id, 'document' AS target_type, CAST(o_orderkey AS VARCHAR) AS target_id, 'prefilter' AS stage, CASE WHEN o_orderstatus = 'F' THEN 'succeeded' ELSE 'skipped' END AS status, o_orderpriority AS reason_code, o_orderdate AS occurred_at FROM orders")
def stage_events(t):
    o = t("orders").withColumnRenamed("o_orderkey", "doc_id")
    return extraction.stage_events(o, "r1", "prefilter", F.when(F.col("o_orderstatus") == "F", "succeeded").otherwise("skipped"), F.col("o_orderpriority"), F.col("o_orderdate"))


@query("""
WITH d AS (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 7 = 0 THEN 'provider_failed' WHEN o_orderkey % 5 = 0 THEN 'document_mismatch' WHEN o_orderkey % 3 = 0 THEN 'evidence_failed' ELSE 'ok' END AS technical_state, CASE o_orderstatus WHEN 'F' THEN 'core' WHEN 'O' THEN 'adjacent' ELSE 'out_of_scope' END AS scope, o_orderkey % 10 / 10.0 AS conf FROM orders)
SELECT k, technical_state, CASE WHEN technical_state = 'ok' THEN scope END AS scope_class, CASE WHEN technical_state = 'ok' THEN scope IN ('core', 'adjacent') END AS is_relevant, technical_state <> 'ok' OR conf < 0.7 AS needs_human_review FROM d""")
def relevance_decisions(t):
    k = F.col("o_orderkey")
    scope = F.when(F.col("o_orderstatus") == "F", "core").when(F.col("o_orderstatus") == "O", "adjacent").otherwise("out_of_scope")
    return t("orders").select(k.alias("k"), *extraction.decision(k % 7 != 0, k % 5 != 0, F.when(k % 3 == 0, 0).otherwise(2), scope, k % 10 / 10))


@query("SELECT o_orderkey, map_from_entries(list_filter([{'k': 'asset', 'v': CASE WHEN o_orderkey % 2 = 0 THEN o_orderstatus END}, {'k': 'cue', 'v': CASE WHEN o_orderkey % 3 = 0 THEN o_orderpriority END}], lambda x: x.v IS NOT NULL))['asset'] AS asset, CAST((CASE WHEN o_orderkey % 2 = 0 THEN 1 ELSE 0 END) + (CASE WHEN o_orderkey % 3 = 0 THEN 1 ELSE 0 END) AS INTEGER) AS n FROM orders")
def assigned_values(t):
    k = F.col("o_orderkey")
    return t("orders").select("o_orderkey", extraction.assigned({"asset": F.when(k % 2 == 0, F.col("o_orderstatus")), "cue": F.when(k % 3 == 0, F.col("o_orderpriority"))}).alias("m")).select("o_orderkey", F.col("m")["asset"].alias("asset"), F.size("m").alias("n"))


# -- imported rows ----------------------------------------------------------------------------------

ROWS = "SELECT o_orderkey AS row, CASE WHEN o_orderkey % 9 <> 0 THEN o_orderkey - o_orderkey % 4 % 2 * (o_orderkey % 3) END AS id, CASE WHEN o_orderkey % 2 = 0 THEN o_custkey * 3 END AS parent FROM {orders}"


@query(f"""{duck(r=ROWS)}, n AS (SELECT *, count(*) OVER (PARTITION BY id) AS n FROM r), c AS (SELECT *, list_filter([CASE WHEN id IS NULL THEN 'missing_id' END, CASE WHEN id IS NOT NULL AND n > 1 THEN 'duplicate_id' END], lambda x: x IS NOT NULL) AS own FROM n),
p AS (SELECT id, bool_and(len(own) = 0) AS clean FROM c WHERE id IS NOT NULL GROUP BY id)
SELECT row, array_to_string(list_concat(own, CASE WHEN parent IS NOT NULL AND p.id IS NULL THEN ['orphan_parent'] WHEN parent IS NOT NULL AND NOT clean THEN ['parent_rejected'] ELSE [] END), ',') AS reasons FROM c LEFT JOIN p ON p.id = c.parent""")
def import_refusals(t):
    return readers.checked_rows(rel(t, ROWS), "id", "parent").select("row", F.array_join("reasons", ",").alias("reasons"))


CELLS = "SELECT c_custkey AS k, CASE c_custkey % 5 WHEN 0 THEN '2024-03-01' WHEN 1 THEN '01/02/2023' WHEN 2 THEN '2024-03-01 10:20:30' WHEN 3 THEN 'soon' END AS d, CASE c_custkey % 4 WHEN 0 THEN ' 5 ' WHEN 1 THEN '0' WHEN 2 THEN '3.5' ELSE 'x' END AS r, CASE c_custkey % 3 WHEN 0 THEN ' Direct ' WHEN 1 THEN 'dm' ELSE 'other' END AS e FROM {customer}"


@query(f"{duck(c=CELLS)} SELECT k, CASE k % 5 WHEN 0 THEN TIMESTAMP '2024-03-01' WHEN 1 THEN TIMESTAMP '2023-02-01' WHEN 2 THEN TIMESTAMP '2024-03-01 10:20:30' END AS day, CASE k % 4 WHEN 0 THEN 5.0 WHEN 2 THEN 3.5 END AS rating, CASE k % 3 WHEN 0 THEN 'direct' WHEN 1 THEN 'message' END AS kind FROM c")
def sheet_cells(t):
    return rel(t, CELLS).select("k", readers.date_cell(F.col("d")).alias("day"), readers.rating_cell(F.trim("r")).alias("rating"), readers.enum_cell(F.col("e"), ["direct", "message"], {"dm": "message"}).alias("kind"))


# -- state of runs ----------------------------------------------------------------------------------

LEDGER = "SELECT CASE WHEN o_orderkey % 2 = 0 THEN '2024-01-01' ELSE '2024-01-02' END AS day, CASE WHEN o_custkey % 2 = 0 THEN 'model' ELSE 'collect' END AS kind, CASE o_orderstatus WHEN 'F' THEN 'reserved' WHEN 'O' THEN 'spent' ELSE 'released' END AS state, 1 AS amount FROM {orders}"


@query(f"{duck(l=LEDGER)}, u AS (SELECT count(*) AS used FROM l WHERE day = '2024-01-01' AND kind = 'model' AND state <> 'released') SELECT used, 300 - used AS left, used + 20 <= 300 AS granted FROM u".replace(" AS left", ' AS "left"'))
def budget_left(t):
    return incremental.reserve(rel(t, LEDGER), "2024-01-01", "model", 300, 20)


@query("SELECT DISTINCT user_id AS target_id FROM events WHERE event_type = 'view' AND value >= 20")
def done_targets(t):
    log = t("events").select(F.col("event_type").alias("run_id"), F.col("user_id").alias("target_id"), F.when(F.col("value") < 20, "failed").otherwise("succeeded").alias("status"))
    return incremental.succeeded(log, "view")


# -- the fourteen views -----------------------------------------------------------------------------

RELATIONS = {
    "stage_events": "SELECT CAST(user_id AS STRING) AS target_id, event_type AS stage, CASE WHEN value < 20 THEN 'failed' WHEN value < 40 THEN 'unavailable' ELSE 'succeeded' END AS status, CAST(event_id % 3 AS INT) AS attempt, ts AS occurred_at, event_id FROM {events}",
    "duplicate_links": "SELECT o_orderkey AS link_id, o_orderkey AS doc_id, o_custkey AS canonical_doc_id, CASE o_orderkey % 5 WHEN 0 THEN 'auto_confirmed' WHEN 1 THEN 'human_confirmed' WHEN 2 THEN 'pending_review' ELSE 'rejected' END AS review_state FROM {orders} WHERE o_orderkey % 2 = 0",
    "documents_collected": "SELECT o_orderkey AS doc_id, o_orderpriority AS source_platform, CASE WHEN o_custkey % 4 = 0 THEN 'contextual' ELSE 'direct_user' END AS evidence_tier FROM {orders}",
    "relevance_decisions": "SELECT DISTINCT l_orderkey AS doc_id, 'd' || CAST(l_orderkey AS STRING) || '-' || CAST(l_linenumber AS STRING) AS decision_id, CASE WHEN l_linenumber = 2 THEN 'human' ELSE 'model' END AS decided_by, l_linenumber AS decided_at, CASE WHEN l_linenumber % 3 = 0 THEN 'provider_failed' ELSE 'ok' END AS technical_state FROM {lineitem}",
    "retrieval_cases": "SELECT DISTINCT l_orderkey AS case_id, l_orderkey AS doc_id, CASE WHEN l_linenumber % 3 = 0 THEN 'human' ELSE 'model' END AS extractor_type, CASE WHEN l_linenumber % 2 = 0 THEN 'valid' ELSE 'pending' END AS validation_state, l_linenumber AS extracted_at, 'f' || CAST(l_linenumber AS STRING) AS extraction_fingerprint, CASE l_orderkey % 3 WHEN 0 THEN 'core' WHEN 1 THEN 'adjacent' ELSE 'out_of_scope' END AS scope_class FROM {lineitem}",
    "cluster_assignments": "SELECT o_orderkey AS case_id, 'k' || CAST(o_custkey % 7 AS STRING) AS cluster_id, 0.5 AS confidence FROM {orders} WHERE o_orderkey % 2 = 0",
}


def _view_sql(name: str) -> str:
    """A view in the other engine's words."""
    return VIEWS[name].replace("struct(attempt, occurred_at, event_id)", "(attempt, occurred_at, event_id)").replace("LEFT ANTI JOIN", "ANTI JOIN")


def _add_view(name: str) -> None:
    def view(t):
        spark = t("orders").sparkSession
        made = {n: rel(t, sql) for n, sql in RELATIONS.items()}
        for v, sql in VIEWS.items():  # each over the relations and the views before it
            words = sql
            for n in sorted(made, key=len, reverse=True):
                words = words.replace(f" {n}", " {" + n + "}")
            used = {n: df for n, df in made.items() if "{" + n + "}" in words}
            made[v] = spark.sql(words, **used)
            if v == name:
                break
        return made[name]

    view.__name__, view.__doc__ = name, f"The view {name} over relations made of the driver's tables."
    before = list(VIEWS)[: list(VIEWS).index(name)]
    query(duck(**RELATIONS) + "".join(f", {v} AS ({_view_sql(v)})" for v in [*before, name]) + f" SELECT * FROM {name}")(view)


for _name in VIEWS:
    _add_view(_name)
