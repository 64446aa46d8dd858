"""BM25 search with a floor, a cap per source and deterministic ties; citations; filters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

K1, B, MIN_SCORE, TOP_K, PER_SOURCE = 1.5, 0.75, 0.15, 10, 3
# Words that questions hold and records are not ranked by.
STOP_WORDS = ("a", "an", "the", "of", "to", "in", "on", "for", "and", "or", "how", "do", "does", "people", "with", "from", "is", "are", "what", "me")
CITATION = r"\[([A-Za-z0-9_#.:-]+)\]"


def terms(text: Column) -> Column:
    return F.filter(F.regexp_extract_all(F.lower(text), F.lit("([a-z0-9]+)"), F.lit(1)), lambda w: ~w.isin(*STOP_WORDS))


def passes(df: DataFrame, filters: dict[str, str]) -> DataFrame:
    """Rows that equal every filter; a missing value is empty."""
    for c, v in filters.items():
        df = df.where(F.coalesce(F.col(c), F.lit("")) == v)
    return df


def filter_cards(df: DataFrame, wildcard: str = "All", **wanted: str) -> DataFrame:
    return passes(df, {c: v for c, v in wanted.items() if v != wildcard})


def contains_all(text: Column, question: str) -> Column:
    """Every word of more than two characters of a question is in the text."""
    ws = [w for w in question.lower().split() if len(w) > 2]
    return F.forall(F.array(*map(F.lit, ws)), lambda w: F.contains(F.lower(text), w)) if ws else F.lit(False)


def search(question: str, records: DataFrame, key: str, source: str, text: str, filters: dict[str, str] | None = None, min_score: float = MIN_SCORE, top_k: int = TOP_K, per_source: int = PER_SOURCE) -> DataFrame:
    """(key, source, score), the best first. Filters come first: they define the pool for frequencies and lengths.

    A question word counts as often as it occurs. Nothing is returned if the best score is below the floor.
    Only question words leave the tokenizer, so what is shuffled follows the matches, not the corpus.
    """
    asked = [w for w in __import__("re").findall("[a-z0-9]+", question.lower()) if w not in STOP_WORDS]
    pool = passes(records, filters or {}).select(F.col(key).alias("key"), F.col(source).alias("source"), terms(F.col(text)).alias("t"))
    pool = pool.select("key", "source", F.size("t").alias("len"), F.filter("t", lambda w: w.isin(*asked) if asked else F.lit(False)).alias("hits"))
    size = pool.agg(F.count("*").alias("n"), F.avg("len").alias("avgdl"))
    tf = pool.select("key", "source", "len", F.explode("hits").alias("term")).groupBy("key", "source", "len", "term").agg(F.count("*").alias("tf"))
    weight = records.sparkSession.createDataFrame([(w, asked.count(w)) for w in sorted(set(asked))], "term string, times int")
    df = tf.groupBy("term").agg(F.count("*").alias("df")).join(F.broadcast(weight), "term")  # a row per question word
    x = tf.join(F.broadcast(df), "term").join(F.broadcast(size))  # one row
    idf = F.ln(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = F.col("times") * idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("len") / F.col("avgdl")))
    scored = x.groupBy("key", "source").agg(F.round(F.sum(part), 9).alias("score")).where(F.col("score") >= min_score)
    w = Window.partitionBy("source").orderBy(F.desc("score"), "key")
    best = scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= per_source)
    return best.orderBy(F.desc("score"), "key").limit(top_k).select("key", "source", "score")


def citations(answer: Column, retrieved: Column) -> Column:
    """(accepted, rejected) citations of an answer, each once in order."""
    cited = F.array_distinct(F.regexp_extract_all(answer, F.lit(CITATION), F.lit(1)))
    return F.struct(F.filter(cited, lambda c: F.array_contains(retrieved, c)).alias("accepted"), F.filter(cited, lambda c: ~F.array_contains(retrieved, c)).alias("rejected"))


def evidence_panel(answer: Column, retrieved: Column) -> Column:
    """Retrieved ids that are cited; none if any citation is not retrieved."""
    c = citations(answer, retrieved)
    return F.when(F.size(c["rejected"]) > 0, F.array().cast("array<string>")).otherwise(F.array_intersect(retrieved, c["accepted"]))
