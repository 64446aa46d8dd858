"""Audit of how five filters interact, over the lattice of filters already applied.

A document fails some subset of the filters, and that subset decides all it does in any order. Documents are counted
by part, failed subset and labels; each count goes to the 80 edges (filters already applied, next filter) of the
lattice, and the edges are joined to the 600 steps of the 120 orders, which are its paths from nothing to everything.

What grows with the table stays small: a row without its text per document, one aggregation by text digest, and a join
on digest and id, so that a text of any number of copies is no hot key.
"""

from __future__ import annotations

from itertools import combinations, permutations
from math import factorial

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import read_table, spread, stored

FILTERS = "ABCDE"
MIN_WORDS, MIN_DISTINCT_PERCENT, MAX_UPPER_PERCENT, SYMBOLS = 200, 50, 2, "[#$%&*|]"
#: What stands between two words.
GAP = r"[\x20\x09-\x0D]+"
#: Rows without an id are dealt over so many keys of the label join, which none of them meets.
NULL_LOTS = 1024

_BIT = {f: 1 << i for i, f in enumerate(FILTERS)}
#: (filters already applied, next filter, orders through it): the 80 edges of the lattice.
EDGES = [(sum(_BIT[x] for x in s), _BIT[f], factorial(k) * factorial(len(FILTERS) - 1 - k)) for f in FILTERS for k in range(len(FILTERS)) for s in combinations([x for x in FILTERS if x != f], k)]
#: (filter_order, step, filters already applied, next filter): the 600 steps of all orders.
STEPS = [("".join(p), i + 1, sum(_BIT[x] for x in p[:i]), _BIT[f]) for p in permutations(FILTERS) for i, f in enumerate(p)]


def text_failures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """(doc_id, part, digest, failed, n): rows of one id, part and text, counted; failed has the bits of A to D."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"), text.alias("t"))
    rows = rows.select("doc_id", "part", "t", F.filter(F.split("t", GAP), lambda w: w != "").alias("w"))
    n_words, distinct = F.size("w"), F.size(F.array_distinct("w"))
    upper = F.length("t") - F.length(F.regexp_replace("t", "[A-Z]", ""))
    fails = {
        "A": n_words < MIN_WORDS,
        "B": distinct.cast("long") * 100 < n_words.cast("long") * MIN_DISTINCT_PERCENT,
        "C": upper.cast("long") * 100 > F.length("t").cast("long") * MAX_UPPER_PERCENT,
        "D": F.col("t").rlike(SYMBOLS),
    }
    failed = sum((F.when(c, _BIT[f]).otherwise(0) for f, c in fails.items()), F.lit(0))
    return rows.select("doc_id", "part", F.sha2("t", 256).alias("digest"), failed.alias("failed")).groupBy("doc_id", "part", "digest", "failed").agg(F.count("*").alias("n"))


def failure_counts(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """(part, failed, n, n_good, n_toxic): documents of each part by the subset of filters that they fail."""
    rows = text_failures(docs, id_col, text_col, part_col)
    marks = labels.where(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    marks = marks.select(F.col("doc_id").alias("label_id"), F.lit(0).alias("label_lot"), "good", "toxic")
    # An id that is null meets no label; such rows are spread, as an outer join would put them all into one task.
    lot = F.when(F.col("doc_id").isNull(), F.pmod(F.xxhash64("digest", "part"), F.lit(NULL_LOTS)).cast("int") + 1).otherwise(0)
    rows = rows.withColumn("lot", lot)
    rows = rows.join(marks, (F.coalesce(F.col("doc_id"), F.lit(0)) == F.col("label_id")) & (F.col("lot") == F.col("label_lot")), "left")
    rows = stored(rows.select("doc_id", "part", "digest", "failed", "n", F.coalesce("good", F.lit(0)).alias("good"), F.coalesce("toxic", F.lit(0)).alias("toxic")), "audit-rows")
    firsts = rows.groupBy("digest").agg(F.min("doc_id").alias("first_id")).where("first_id IS NOT NULL").withColumnRenamed("digest", "first_digest")
    met = rows.join(firsts, (F.col("digest") == F.col("first_digest")) & (F.col("doc_id") == F.col("first_id")), "left")
    copy = F.col("doc_id").isNotNull() & F.col("first_id").isNull()
    failed = F.col("failed") + F.when(copy, _BIT["E"]).otherwise(0)
    return met.groupBy("part", failed.alias("failed")).agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("good")).alias("n_good"), F.sum(F.col("n") * F.col("toxic")).alias("n_toxic"))


def lattice_edges(counts: DataFrame) -> DataFrame:
    """(part, applied, next, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley): 80 rows per part."""
    edges = F.array(*[F.struct(F.lit(a).alias("applied"), F.lit(f).alias("next"), F.lit(w).cast("long").alias("orders")) for a, f, w in EDGES])
    rows = counts.withColumn("e", F.explode(edges)).select("part", "failed", "n", "n_good", "n_toxic", "e.*")
    fails = F.col("failed").bitwiseAND(F.col("next")) != 0
    gone = F.col("failed").bitwiseAND(F.col("applied")) != 0

    def total(when, what="n"):
        return F.sum(F.when(when, F.col(what)).otherwise(F.lit(0).cast("long")))

    found = rows.groupBy("part", "applied", "next", "orders").agg(
        total(~gone & ~fails).alias("kept"),
        total(~gone & fails).alias("removed"),
        total(gone & fails).alias("redundant"),
        total(F.col("failed") == F.col("next")).alias("unique_fails"),
        total(~gone & fails, "n_good").alias("good_lost"),
        total(~gone & fails, "n_toxic").alias("toxic_lost"),
    )
    shares = found.groupBy(F.col("part").alias("share_part"), F.col("next").alias("share_next")).agg(F.sum(F.col("removed") * F.col("orders")).alias("shapley"))
    return found.join(shares, (F.col("part") == F.col("share_part")) & (F.col("next") == F.col("share_next"))).drop("orders", "share_part", "share_next")


def interaction_audit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """600 rows per part: part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley.

    Null text is the empty text, which fails A only, and E as a copy; a null part is the empty string and one with it.
    A row without an id is no copy, makes none and has no label. Repeated rows of one id and text are documents each, none
    a copy of the other. A document is good or toxic if any of its label rows says 1; other values and nulls say nothing.
    Texts are judged whole, of any length. An empty table gives no rows; other columns play no part.
    """
    edges = lattice_edges(failure_counts(docs, labels, id_col, text_col, part_col))
    steps = docs.sparkSession.createDataFrame(STEPS, "filter_order string, step int, at int, take int")  # 600 rows
    met = edges.join(F.broadcast(steps), (F.col("applied") == F.col("at")) & (F.col("next") == F.col("take")))
    return met.select("part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def op13_filter_audit(spark, sf_dir: str) -> DataFrame:
    return interaction_audit(spread(read_table(spark, sf_dir, "documents")), read_table(spark, sf_dir, "labels"))


# Each order is walked for itself; no lattice is used.
OP13_SQL = r"""
WITH w AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
d AS (SELECT doc_id, part, len(w) < 200 AS a, 100 * len(list_distinct(w)) < 50 * len(w) AS b, 100 * (length(t) - length(regexp_replace(t, '[A-Z]', '', 'g'))) > 2 * length(t) AS c,
  regexp_matches(t, '[#$%&*|]') AS d, coalesce(doc_id > min(doc_id) OVER (PARTITION BY t), false) AS e FROM w),
l AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
m AS (SELECT part, concat(CASE WHEN a THEN 'A' ELSE '' END, CASE WHEN b THEN 'B' ELSE '' END, CASE WHEN c THEN 'C' ELSE '' END, CASE WHEN d THEN 'D' ELSE '' END, CASE WHEN e THEN 'E' ELSE '' END) AS failed,
  count(*) AS n, count(*) FILTER (WHERE good) AS g, count(*) FILTER (WHERE toxic) AS x FROM d LEFT JOIN l USING (doc_id) GROUP BY ALL),
f(f) AS (VALUES ('A'), ('B'), ('C'), ('D'), ('E')),
o AS (SELECT concat(p.f, q.f, r.f, s.f, t.f) AS filter_order FROM f p, f q, f r, f s, f t WHERE len(list_distinct([p.f, q.f, r.f, s.f, t.f])) = 5),
s AS (SELECT filter_order, step::INTEGER AS step, filter_order[step] AS f, filter_order[:step - 1] AS before FROM o, range(1, 6) r(step)),
k AS (SELECT m.*, s.*, contains(failed, f) AS hit, before <> '' AND regexp_matches(failed, '[' || before || '_]') AS gone FROM m, s),
r AS (SELECT part, filter_order, step, f, coalesce(sum(n) FILTER (WHERE NOT hit AND NOT gone), 0) AS kept, coalesce(sum(n) FILTER (WHERE hit AND NOT gone), 0) AS removed, coalesce(sum(n) FILTER (WHERE hit AND gone), 0) AS redundant,
  coalesce(sum(n) FILTER (WHERE failed = f), 0) AS unique_fails, coalesce(sum(g) FILTER (WHERE hit AND NOT gone), 0) AS good_lost, coalesce(sum(x) FILTER (WHERE hit AND NOT gone), 0) AS toxic_lost FROM k GROUP BY ALL)
SELECT part, filter_order, step, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant, unique_fails::BIGINT AS unique_fails, good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost,
  (sum(removed) OVER (PARTITION BY part, f))::BIGINT AS shapley FROM r"""
