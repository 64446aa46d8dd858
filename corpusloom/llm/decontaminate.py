"""Benchmark decontamination over a positional inverted index, with DataFrame functions only.

1. Windows: consecutive item words (13, or the whole item if shorter), distinct by their text.
2. Every document word that occurs in a window is counted over all documents. A window with a word that
   no document has is gone; of each other window the rarest words become its anchors.
3. The index stores postings (term, document, position) of the anchors, and one record per document.
4. The postings of a window's rarest anchor give starts; they are intersected with the offset-adjusted
   postings of the next rarest anchor. What is left is compared word for word with the text.

The index is written to the shared folder, so each later step can be repeated when executors are lost.
Texts move only for documents that still hold a candidate. Terms and candidate ids are broadcast only
after they were counted and found few; otherwise the same joins are shuffled.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import checked_broadcast, free_names, read_table, spread, stored, text_key, words

WINDOW, SHARE, SLOP = 13, 20, 5


@dataclass(frozen=True)
class Index:
    """Stored postings and what was asked: all tables have the document's key (doc_id, tkey)."""

    windows: DataFrame  # item_id, phrase, len
    anchors: DataFrame  # phrase, len, off1, term1, off2, term2
    postings: DataFrame  # doc_id, tkey, term, pos
    documents: DataFrame  # doc_id, tkey, n_words; a row for each input row


def item_windows(items: DataFrame, window: int = WINDOW, item_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(item_id, phrase, len): a row for each item and distinct window; items without id or words have none."""
    w = F.col("w")
    return (
        items.select(F.col(item_col).alias("item_id"), words(F.col(text_col)).alias("w"))
        .where(F.col("item_id").isNotNull() & (F.size(w) > 0))
        .withColumn("s", F.explode(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(w) - window + 1))))
        .select("item_id", F.array_join(F.slice(w, F.col("s"), window), " ").alias("phrase"), F.least(F.lit(window), F.size(w)).alias("len"))
        .distinct()
    )


def build_index(docs: DataFrame, items: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text", **item_names) -> Index:
    """Postings of the rarest words of all windows over all of ``docs``."""
    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    windows = stored(item_windows(items, window, **item_names), "windows")
    phrases = windows.select("phrase", "len").distinct()
    terms = phrases.select("phrase", "len", F.posexplode(F.split("phrase", " ")).alias("off", "term"))
    vocabulary = stored(terms.select("term").distinct(), "vocabulary")
    counts = texts.select(F.explode(words(F.col("text"))).alias("term")).join(checked_broadcast(vocabulary, vocabulary.count()), "term").groupBy("term").agg(F.count("*").alias("n"))
    ranked = terms.join(stored(counts, "term-counts"), "term").groupBy("phrase", "len").agg(F.sort_array(F.collect_list(F.struct("n", "off", "term"))).alias("a"))
    anchors = stored(
        ranked.where(F.size("a") == F.col("len")).select("phrase", "len", F.col("a")[0]["off"].alias("off1"), F.col("a")[0]["term"].alias("term1"), F.get("a", F.lit(1))["off"].alias("off2"), F.get("a", F.lit(1))["term"].alias("term2")),
        "anchors",
    )
    wanted = stored(anchors.select(F.explode(F.array_compact(F.array("term1", "term2"))).alias("term")).distinct(), "anchor-terms")
    # A first entry without a term stands for the document itself and holds its number of words.
    found = words(F.col("text"))
    entries = texts.select("doc_id", text_key(F.col("text")).alias("tkey"), found.alias("w")).select("doc_id", "tkey", F.size("w").alias("n"), F.posexplode(F.concat(F.array(F.lit("")), F.col("w"))).alias("p", "term"))
    marked = wanted.union(wanted.sparkSession.createDataFrame([("",)], "term string"))
    store = stored(
        entries.join(checked_broadcast(marked, wanted.count()), "term").select("term", "doc_id", "tkey", F.when(F.col("term") == "", F.col("n")).otherwise(F.col("p") - 1).cast("int").alias("pos")),
        "postings",
    )
    documents = store.where("term = ''").select("doc_id", "tkey", F.col("pos").cast("long").alias("n_words"))
    return Index(windows, anchors, store.where("term <> ''"), documents)


def phrase_matches(docs: DataFrame, index: Index, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, tkey, start, len, phrase): every place of every window, each once."""
    few = index.anchors.count()
    rare = index.postings.withColumnRenamed("term", "term1").join(checked_broadcast(index.anchors, few), "term1").withColumn("start", F.col("pos") - F.col("off1")).where("start >= 0").drop("pos", "term1", "off1")
    second = index.postings.select("doc_id", "tkey", F.col("term").alias("term2"), "pos").distinct()
    a, b = rare.alias("a"), second.alias("b")
    met = a.join(b, F.col("a.doc_id").eqNullSafe(F.col("b.doc_id")) & (F.col("a.tkey") == F.col("b.tkey")) & (F.col("a.term2") == F.col("b.term2")) & (F.col("a.start") + F.col("a.off2") == F.col("b.pos"))).select("a.doc_id", "a.tkey", "a.start", "a.len", "a.phrase")
    alone = rare.where("term2 is null").select("doc_id", "tkey", "start", "len", "phrase")
    candidates = stored(met.union(alone).distinct(), "candidates")
    ids = stored(candidates.select(F.col("doc_id").alias("c_id"), F.col("tkey").alias("c_key")).distinct(), "candidate-ids")
    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).withColumn("tkey", text_key(F.col("text")))
    held = texts.join(checked_broadcast(ids, ids.count()), F.col("doc_id").eqNullSafe(F.col("c_id")) & (F.col("tkey") == F.col("c_key")), "left_semi")
    once = held.groupBy("doc_id", "tkey").agg(F.first("text").alias("text")).select("doc_id", "tkey", words(F.col("text")).alias("w"))
    lists = candidates.groupBy("doc_id", "tkey").agg(F.collect_list(F.struct("start", "len", "phrase")).alias("c"))
    a, b = once.alias("a"), lists.alias("b")
    joined = a.join(b, F.col("a.doc_id").eqNullSafe(F.col("b.doc_id")) & (F.col("a.tkey") == F.col("b.tkey"))).select("a.doc_id", "a.tkey", "w", "c")
    right = F.filter("c", lambda x: F.array_join(F.slice(F.col("w"), x["start"] + 1, x["len"]), " ") == x["phrase"])
    return joined.select("doc_id", "tkey", F.inline(right))


def _near_phrases(index: Index, slop: int) -> DataFrame:
    """(doc_id, tkey, phrase) of the windows that are near in a document, each once."""
    first = index.postings.withColumnRenamed("term", "term1").join(index.anchors.where("term2 is not null"), "term1").select("doc_id", "tkey", "phrase", "term2", F.col("pos").alias("p1"), (F.col("off2") - F.col("off1")).alias("gap"))
    width = F.lit(2 * slop + 1)
    first = first.withColumn("cell", F.explode(F.array_distinct(F.array(*[F.floor((F.col("p1") + F.col("gap") + d * slop) / width) for d in (-1, 1)]))))
    second = index.postings.select(F.col("doc_id").alias("d2"), F.col("tkey").alias("k2"), F.col("term").alias("t2"), F.col("pos").alias("p2"), F.floor(F.col("pos") / width).alias("c2")).distinct()
    near = first.join(second, F.col("doc_id").eqNullSafe(F.col("d2")) & (F.col("tkey") == F.col("k2")) & (F.col("term2") == F.col("t2")) & (F.col("cell") == F.col("c2")) & (F.abs(F.col("p2") - F.col("p1") - F.col("gap")) <= slop))
    return near.select("doc_id", "tkey", "phrase").distinct()


def proximity_matches(index: Index, slop: int = SLOP) -> DataFrame:
    """(doc_id, item_id, n_near): windows whose two rarest words stand in a document no more than ``slop`` words nearer
    or farther apart than in the window, in either order.

    Windows of one word, and windows with a word that no document has, are near nothing. Documents without a
    match, null and empty ones too, have no row; repeated rows and places count once; no index, no rows.
    """
    return _near_phrases(index, slop).join(index.windows, "phrase").groupBy("doc_id", "item_id").agg(F.count_distinct("phrase").alias("n_near"))


def contamination(docs: DataFrame, items: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text", index: Index | None = None, **item_names) -> DataFrame:
    """(doc_id, tkey, n_words, n_hit, n_items, items_sha256, contaminated), a row for each row of ``docs``.

    A word is hit inside any place of a window; contaminated: some word is hit and at least one in 20.
    Null and empty texts have no words and are clean. Repeated rows each come back; rows that share an id
    but not the text are judged apart. Items without id or words match nothing. Empty tables are fine, and
    other columns play no part.
    """
    index = index or build_index(docs, items, window, id_col, text_col, **item_names)
    hits = stored(phrase_matches(docs, index, id_col, text_col), "matches")
    key = ["doc_id", "tkey"]
    spans = hits.groupBy(*key, "start").agg((F.col("start") + F.max("len")).alias("stop"))
    before = Window.partitionBy(*key).orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    fresh = F.greatest(F.lit(0), F.col("stop") - F.greatest(F.col("start"), F.coalesce(F.max("stop").over(before), F.lit(0))))
    covered = spans.withColumn("fresh", fresh).groupBy(*key).agg(F.sum("fresh").cast("long").alias("n_hit"))
    named = hits.select(*key, "phrase").distinct().join(index.windows.select("phrase", F.col("item_id").cast("string").alias("item")), "phrase").groupBy(*key).agg(F.sort_array(F.collect_set("item")).alias("items"))
    found = covered.join(named, covered.doc_id.eqNullSafe(named.doc_id) & (covered.tkey == named.tkey)).select(covered.doc_id.alias("f_id"), covered.tkey.alias("f_key"), "n_hit", "items")
    all_docs = index.documents
    n_hit, listed = F.coalesce("n_hit", F.lit(0).cast("long")), F.coalesce("items", F.array().cast("array<string>"))
    return all_docs.join(found, all_docs.doc_id.eqNullSafe(F.col("f_id")) & (all_docs.tkey == F.col("f_key")), "left").select(
        "doc_id",
        "tkey",
        "n_words",
        n_hit.alias("n_hit"),
        F.size(listed).cast("long").alias("n_items"),
        F.sha2(F.array_join(listed, ","), 256).alias("items_sha256"),
        ((n_hit > 0) & (n_hit * SHARE >= F.col("n_words"))).alias("contaminated"),
    )


def keep_uncontaminated(docs: DataFrame, items: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows of ``docs`` that are not contaminated, with all their columns.

    Null and empty texts stay; rows that share an id but not the text are judged apart; repeated rows all stay
    or all go. An empty table gives no rows, and items without id or words take nothing away.
    """
    id_, key = free_names(docs, "_bad_id", "_bad_key")
    bad = stored(contamination(docs, items, window, id_col, text_col).where("contaminated").select(F.col("doc_id").alias(id_), F.col("tkey").alias(key)).distinct(), "contaminated")
    return docs.join(checked_broadcast(bad, bad.count()), F.col(id_col).eqNullSafe(F.col(id_)) & (text_key(F.col(text_col)) == F.col(key)), "left_anti")


def op9_decontaminate(spark, sf_dir: str) -> DataFrame:
    """Contamination of every document, and ``n_near``: items of which some window is near in it (``proximity_matches``)."""
    docs, items = spread(read_table(spark, sf_dir, "documents")), read_table(spark, sf_dir, "benchmark")
    index = build_index(docs, items)
    found = contamination(docs, items, index=index)
    near = _near_phrases(index, SLOP).join(index.windows, "phrase").groupBy(F.col("doc_id").alias("near_id"), F.col("tkey").alias("near_key")).agg(F.count_distinct("item_id").alias("n_near"))
    both = found.join(near, found.doc_id.eqNullSafe(F.col("near_id")) & (found.tkey == F.col("near_key")), "left")
    return both.withColumn("n_near", F.coalesce("n_near", F.lit(0).cast("long"))).drop("tkey", "near_id", "near_key")


OP9_SQL = r"""
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents),
i AS (SELECT item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM benchmark),
iw AS (SELECT DISTINCT item_id, array_to_string(w[s:s + 12], ' ') AS phrase, least(13, len(w)) AS n FROM (SELECT item_id, w, unnest(range(1, greatest(1, len(w) - 12) + 1)) AS s FROM i WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM iw),
dw AS (SELECT doc_id, s, n, array_to_string(w[s:s + n - 1], ' ') AS phrase FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS s FROM d, sizes WHERE len(w) >= n)),
hit AS (SELECT dw.doc_id, dw.s, dw.n, iw.item_id FROM dw JOIN iw ON dw.phrase = iw.phrase),
pos AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + n)) AS p FROM hit) GROUP BY doc_id),
wt AS (SELECT phrase, n, off, string_split(phrase, ' ')[off + 1] AS term FROM (SELECT DISTINCT phrase, n, unnest(range(0, n)) AS off FROM iw)),
dt AS (SELECT doc_id, unnest(w) AS term, unnest(range(0, len(w))) AS p FROM d),
tc AS (SELECT term, count(*) AS c FROM dt WHERE term IN (SELECT term FROM wt) GROUP BY term),
an AS (SELECT phrase, list({'c': c, 'off': off, 'term': term} ORDER BY c, off, term) AS a FROM wt JOIN tc USING (term) GROUP BY phrase, n HAVING count(*) = n AND n > 1),
nr AS (SELECT DISTINCT x.doc_id, phrase FROM an JOIN dt x ON x.term = a[1].term JOIN dt y ON y.doc_id = x.doc_id AND y.term = a[2].term WHERE abs(y.p - x.p - (a[2].off - a[1].off)) <= 5),
nn AS (SELECT doc_id, count(DISTINCT item_id) AS n_near FROM nr JOIN iw USING (phrase) GROUP BY doc_id),
its AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hit) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(d.w) AS contaminated, coalesce(n_near, 0) AS n_near
FROM d LEFT JOIN pos USING (doc_id) LEFT JOIN its USING (doc_id) LEFT JOIN nn USING (doc_id)
"""
