"""Scores against gold labels, agreement, splits. Undefined rates are null (``zero=True``: 0)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import occurrences
from ..session import ranked

GATES = {"prefilter_recall": 0.90, "precision": 0.85, "recall": 0.80}


def rates(tp: Column, fp: Column, fn: Column, zero: bool = False) -> list[Column]:
    p, r, f = F.try_divide(tp, tp + fp), F.try_divide(tp, tp + fn), F.try_divide(2 * tp, 2 * tp + fp + fn)
    f = F.when(p.isNotNull() & r.isNotNull(), f)
    fix = lambda c: F.round(F.coalesce(c, F.lit(0.0)), 6) if zero else c
    return [fix(p).alias("precision"), fix(r).alias("recall"), fix(f).alias("f1")]


def binary_counts(df: DataFrame, gold: Column, pred: Column, by: list[str] | None = None) -> DataFrame:
    """tp, fp, fn, excluded (no prediction) and rates."""
    g, p = F.coalesce(gold, F.lit(False)), pred
    agg = [F.count_if(g & p).alias("tp"), F.count_if(~g & p).alias("fp"), F.count_if(g & ~p).alias("fn"), F.count_if(p.isNull()).alias("excluded")]
    got = df.groupBy(*(by or [])).agg(*agg)
    return got.select(*(by or []), "tp", "fp", "fn", "excluded", *rates(F.col("tp"), F.col("fp"), F.col("fn")))


def scalar_accuracy(df: DataFrame, fields: list[str]) -> DataFrame:
    """(field, n, accuracy) of columns gold_x against pred_x where gold is there."""
    rows = df.select(F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f"gold_{f}").cast("string").alias("g"), F.col(f"pred_{f}").cast("string").alias("p")) for f in fields])).alias("x")).select("x.*")
    return rows.groupBy("field").agg(F.count("g").alias("n"), F.avg(F.when(F.col("g").isNotNull(), F.col("g").eqNullSafe(F.col("p")).cast("int"))).alias("accuracy"))


def multilabel(df: DataFrame, gold: str, pred: str) -> DataFrame:
    """Micro and macro precision, recall and F1 over label sets; macro averages the defined rates of each label."""
    labels = df.select(F.explode(F.array_union(gold, pred)).alias("label"), gold, pred)
    g, p = F.array_contains(gold, F.col("label")), F.array_contains(pred, F.col("label"))
    per = labels.groupBy("label").agg(F.count_if(g & p).alias("tp"), F.count_if(~g & p).alias("fp"), F.count_if(g & ~p).alias("fn"))
    per = per.select("*", *rates(F.col("tp"), F.col("fp"), F.col("fn")))
    tot = per.agg(F.sum("tp").alias("tp"), F.sum("fp").alias("fp"), F.sum("fn").alias("fn"), F.avg("precision").alias("macro_precision"), F.avg("recall").alias("macro_recall"), F.avg("f1").alias("macro_f1"))
    micro = rates(F.col("tp"), F.col("fp"), F.col("fn"))
    return tot.select(*[c.alias(f"micro_{n}") for c, n in zip(micro, ("precision", "recall", "f1"))], "macro_precision", "macro_recall", "macro_f1")


def confusion(df: DataFrame, gold: str, pred: str) -> DataFrame:
    return df.groupBy(gold, pred).agg(F.count("*").alias("n"))


def kappa(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """(n, agreement, expected, kappa) of two labelers; kappa is 1 where chance alone would agree."""
    counts = pairs.groupBy(a, b).agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n").alias("total"), F.sum(F.when(F.col(a) == F.col(b), F.col("n")).otherwise(0)).alias("same"))
    left = counts.groupBy(F.col(a).alias("label")).agg(F.sum("n").alias("na"))
    right = counts.groupBy(F.col(b).alias("label")).agg(F.sum("n").alias("nb"))
    both = left.join(right, "label").agg(F.sum(F.col("na").cast("double") * F.col("nb")).alias("dot"))
    x = total.join(F.broadcast(both)).where("total > 0")
    raw, chance = F.col("same") / F.col("total"), F.coalesce(F.col("dot"), F.lit(0.0)) / (F.col("total").cast("double") * F.col("total"))
    return x.select(F.col("total").alias("n"), raw.alias("agreement"), chance.alias("expected"), F.when(chance >= 1, 1.0).otherwise((raw - chance) / (1 - chance)).alias("kappa"))


def gates(report: DataFrame, thresholds=GATES) -> DataFrame:
    """(gate, value, threshold, passed) of a one-row report; a null value neither passes nor fails."""
    rows = F.array(*[F.struct(F.lit(k).alias("gate"), F.col(k).cast("double").alias("value"), F.lit(v).alias("threshold")) for k, v in thresholds.items()])
    return report.select(F.explode(rows).alias("x")).select("x.*").withColumn("passed", F.col("value") >= F.col("threshold"))


def gold_split(df: DataFrame, key: str, strata: list[str], seed: str = "gold-v1") -> DataFrame:
    """(key, strata, split): the first two fifths of each stratum, in the order of a seeded hash, are dev."""
    order = F.sha2(F.concat_ws("|", F.lit(seed), F.col(key).cast("string")), 256)
    got = ranked(df.select(key, *strata), strata, [order, F.col(key)])
    return got.select(key, *strata, F.when(F.col("rn") <= F.floor(F.col("n") * 2 / 5), "dev").otherwise("holdout").alias("split"))


def even_split(df: DataFrame, key: str, strata: list[str], holdout: int) -> DataFrame:
    """Of each stratum in key order, evenly spaced rows (index i*n/h) are held out."""
    got = ranked(df.select(key, *strata), strata, [F.col(key)])
    h, n = F.least(F.lit(holdout), F.col("n")), F.col("n")
    picked = F.array_contains(F.transform(F.sequence(F.lit(0).cast("long"), h - 1), lambda i: F.floor(i * n / h)), F.col("rn") - 1)
    return got.select(key, *strata, F.when(picked, "holdout").otherwise("dev").alias("split"))


# The pilot's seats.
CORE, ADJACENT = "core_incomplete_recall", "adjacent_known_item_retrieval"


def pilot_seats(inputs: DataFrame, approved: DataFrame, required: list[str], excluded: list[str], core_seats: int = 2, adjacent_seats: int = 3) -> DataFrame:
    """(doc_id, seat): who sits in a pilot. Core seats go to the first documents whose class two sources agree on; of the
    adjacent ones ``required`` documents have theirs, and the first others take the rest.

    inputs: doc_id, eligible, scope_class, decided_by, validation_state; approved: doc_id, scope_class. Reading fails where a
    named document is missing, a required one is no agreeing adjacent decision that a person made and that is valid, or seats
    stay empty. Each class needs a sort for its few first ids only, and no row comes to the driver.
    """
    spark = inputs.sparkSession
    named = F.broadcast(spark.createDataFrame([(d, "required") for d in required] + [(d, "excluded") for d in excluded], "named string, part string"))
    agreed = approved.select(F.col("doc_id").alias("approved_id"), F.col("scope_class").alias("approved_class"))
    all_ = inputs.join(agreed, (F.col("doc_id") == F.col("approved_id")) & (F.col("scope_class") == F.col("approved_class")), "left").withColumn("agrees", F.col("eligible") & F.col("approved_id").isNotNull())
    here = named.join(all_, F.col("named") == F.col("doc_id"), "left")  # as many rows as names
    wrong = (
        F.when(F.col("doc_id").isNull(), F.concat("named", F.lit(" is missing")))
        .when(F.col("part") == "excluded", None)
        .when(~F.coalesce(F.col("agrees") & (F.col("scope_class") == ADJACENT), F.lit(False)), F.concat("named", F.lit(" is not an agreeing adjacent decision")))
        .when(~F.coalesce((F.col("decided_by") == "human") & (F.col("validation_state") == "valid"), F.lit(False)), F.concat("named", F.lit(" is not a validated human decision")))
    )
    kept = F.when(wrong.isNotNull(), F.raise_error(wrong).cast("boolean")).otherwise(F.col("part") == "required")
    seated = here.where(kept).select("named", F.lit("adjacent").alias("seat"))
    free = all_.join(named, F.col("doc_id") == F.col("named"), "left_anti").where("agrees")
    first = lambda kind, seat, n: free.where(F.col("scope_class") == kind).select("doc_id", F.lit(seat).alias("seat")).orderBy("doc_id").limit(n)
    seats = first(CORE, "core", core_seats).union(first(ADJACENT, "adjacent", max(0, adjacent_seats - len(required)))).union(seated)
    want = spark.createDataFrame([("core", core_seats), ("adjacent", max(adjacent_seats, len(required)))], "seat string, seats int")
    taken = seats.groupBy("seat").agg(F.sort_array(F.collect_list("doc_id")).alias("ids"))  # as many ids as seats
    full = F.coalesce(F.size("ids") == F.col("seats"), F.col("seats") == 0)
    said = F.format_string("%s seats are %d; the pilot needs %d", "seat", F.greatest(F.lit(0), F.coalesce(F.size("ids"), F.lit(0))), "seats")
    whole = F.broadcast(want).join(taken, "seat", "left").where(F.assert_true(full, said).isNull())
    return whole.select(F.explode("ids").alias("doc_id"), "seat")


def first_per_class(df: DataFrame, key: str, label: str, n: int = 2) -> DataFrame:
    return df.withColumn("rn", F.row_number().over(Window.partitionBy(label).orderBy(key))).where(F.col("rn") <= n).select(key, label, "rn")


def greedy_matches(scores: DataFrame) -> DataFrame:
    """(doc_id, gold_id, case_id, score): one-to-one within a document, the best score first, ties by ids. Groups are one document's cases."""
    # Scores are positive, so their negatives sort the best first. One column pass per document: a Python call for each costs too much.
    pair = F.struct((-F.col("score")).cast("long").alias("less"), F.col("gold_id").cast("string").alias("gold_id"), F.col("case_id").cast("string").alias("case_id"))
    lots = scores.where("score > 0").groupBy(F.col("doc_id").cast("string").alias("doc_id")).agg(F.array_sort(F.collect_list(pair)).alias("pairs"))
    taken = lambda acc, p: F.exists(acc, lambda m: m["gold_id"].eqNullSafe(p["gold_id"]) | m["case_id"].eqNullSafe(p["case_id"]))
    none = F.array().cast("array<struct<less:bigint,gold_id:string,case_id:string>>")
    best = F.aggregate("pairs", none, lambda acc, p: F.when(taken(acc, p), acc).otherwise(F.concat(acc, F.array(p))))
    return lots.select("doc_id", F.explode(best).alias("m")).select("doc_id", "m.gold_id", "m.case_id", (-F.col("m.less")).alias("score"))


def overlap_scores(gold: DataFrame, cases: DataFrame, texts: DataFrame) -> DataFrame:
    """(doc_id, gold_id, case_id, score): gold quotes that equal a span's quote, or of which some occurrence overlaps a span.

    gold: doc_id, gold_id, quotes; cases: doc_id, case_id, spans (quote, start, stop; offsets may be null); texts:
    doc_id, text. A document without text is matched by equal quotes alone.
    """
    quotes = gold.select("doc_id", "gold_id", F.explode(F.array_distinct("quotes")).alias("quote"))
    spans = cases.select("doc_id", "case_id", F.explode("spans").alias("x")).select("doc_id", "case_id", F.col("x.quote").alias("span_quote"), F.col("x.start").alias("s2"), F.col("x.stop").alias("e2"))
    equal = quotes.join(spans.withColumnRenamed("span_quote", "quote"), ["doc_id", "quote"]).select("doc_id", "gold_id", "case_id", "quote")
    at = quotes.join(texts, "doc_id").select("doc_id", "gold_id", "quote", F.explode(occurrences(F.col("text"), F.col("quote"))).alias("s1"), F.length("quote").alias("len"))
    over = at.join(spans, "doc_id").where((F.col("s1") < F.col("e2")) & (F.col("s2") < F.col("s1") + F.col("len"))).select("doc_id", "gold_id", "case_id", "quote")
    return equal.union(over).groupBy("doc_id", "gold_id", "case_id").agg(F.count_distinct("quote").alias("score"))


def span_validation_rate(spans: DataFrame) -> DataFrame:
    return spans.agg(F.count("*").alias("n"), F.try_divide(F.count_if(F.col("validation_state") == "valid"), F.count("*")).alias("rate"))


def reconcile_counts(docs: DataFrame, cases: DataFrame) -> DataFrame:
    """Documents whose number of cases is not the expected one; zero is expected too."""
    n = cases.groupBy("doc_id").agg(F.count("*").alias("n"))
    return docs.join(n, "doc_id", "left").withColumn("n", F.coalesce("n", F.lit(0))).where("n <> expected_case_count")


def failure_ledger(df: DataFrame, categories: dict[str, Column], key: str) -> DataFrame:
    """(category, n): every category, also those without rows. ``failure_ids`` has the ids."""
    names = df.sparkSession.createDataFrame([(c,) for c in categories], "category string")
    found = failure_ids(df, categories, key).groupBy("category").agg(F.count("*").alias("n"))
    return names.join(found, "category", "left").withColumn("n", F.coalesce("n", F.lit(0)))


def failure_ids(df: DataFrame, categories: dict[str, Column], key: str) -> DataFrame:
    """(category, key): a row for each failure."""
    return df.select(F.explode(F.array_compact(F.array(*[F.when(c, k) for k, c in categories.items()]))).alias("category"), key)


def prefilter_recall(gold: DataFrame, predictions: DataFrame) -> DataFrame:
    """One row (hits, total, recall) over gold documents that should pass and have a prediction of state ok. gold: doc_id, should_pass; predictions: doc_id, technical_state, passed."""
    m = gold.where("should_pass").join(predictions.where("technical_state = 'ok'"), "doc_id")
    return m.agg(F.count_if("passed").alias("hits"), F.count("*").alias("total")).withColumn("recall", F.try_divide("hits", "total"))


def unsupported_inference(values: DataFrame) -> DataFrame:
    """(field, unsupported, total, rate): the share of non-empty predicted values that no valid span supports or that gold contradicts.

    values: field, predicted (array), gold (array; null: the field has no reference), multi (several labels), supported. A
    supported value without a reference is not scored: its field has a null rate if nothing else of it is. Only labels beyond
    the gold ones contradict a field of several labels; a missing one does not. The row ``overall`` sums all fields.
    """
    said = values.where(F.coalesce(F.size(F.filter("predicted", lambda v: v.isNotNull() & (v != ""))) > 0, F.lit(False)))
    wrong = F.when(F.col("multi"), F.size(F.array_except("predicted", "gold")) > 0).otherwise(~F.col("predicted").eqNullSafe(F.col("gold")))
    scored = ~F.col("supported") | F.col("gold").isNotNull()
    bad = ~F.col("supported") | F.coalesce(wrong, F.lit(False))
    got = said.select("field", scored.alias("scored"), (scored & bad).alias("bad"))
    agg = [F.count_if("bad").alias("unsupported"), F.count_if("scored").alias("total")]
    both = got.groupBy("field").agg(*agg).unionByName(got.agg(*agg).withColumn("field", F.lit("overall")))
    return both.select("field", "unsupported", "total", F.try_divide("unsupported", "total").alias("rate"))


def labeler_pairs(labels: DataFrame) -> DataFrame:
    """(doc_id, left_scope, right_scope) of two labelers of a document. labels: doc_id, pos, labeler, scope; blank ones do not count."""
    good = labels.where("labeler <> '' and scope <> ''")
    a, b = (good.select("doc_id", *[F.col(c).alias(f"{side}_{c}") for c in ("pos", "labeler", "scope")]) for side in ("left", "right"))
    return a.join(b, "doc_id").where("left_pos < right_pos and left_labeler <> right_labeler").select("doc_id", "left_scope", "right_scope")


def gold_quote_failures(gold: DataFrame, texts: DataFrame) -> DataFrame:
    """One row (n_quotes, failures): gold quotes that do not stand in their document's text; documents without text are left out. gold: doc_id, quotes."""
    q = gold.select("doc_id", F.explode("quotes").alias("quote")).join(texts.where("text is not null"), "doc_id")
    return q.agg(F.count("*").alias("n_quotes"), F.count_if(~F.contains("text", "quote") | (F.col("quote") == "")).alias("failures"))


# Categories of what went wrong with a document, in order.
DOCUMENT_FAILURES = ("prefilter_drop", "relevance_false_positive", "relevance_false_negative", "scope_boundary")
EXTRACTION_FAILURES = ("schema_rejected", "evidence_failed", "empty_extraction", "other_failure")


def document_failures(gold: DataFrame, predictions: DataFrame, relevant: tuple = ("core", "adjacent")) -> DataFrame:
    """(category, doc_id) of judged documents. gold: doc_id, scope_class, should_pass; predictions: doc_id, technical_state, passed, scope_class."""
    p = predictions.where("technical_state = 'ok'").select("doc_id", F.coalesce("passed", F.lit(False)).alias("passed"), F.col("scope_class").alias("found"))
    m = gold.join(p, "doc_id")
    is_, said = F.coalesce(F.col("scope_class").isin(*relevant), F.lit(False)), F.col("passed") & F.coalesce(F.col("found").isin(*relevant), F.lit(False))
    return failure_ids(m, {"prefilter_drop": F.col("should_pass") & ~F.col("passed"), "relevance_false_positive": said & ~is_, "relevance_false_negative": is_ & ~said, "scope_boundary": is_ & said & (F.col("scope_class") != F.col("found"))}, "doc_id")


def extraction_failures(events: DataFrame) -> DataFrame:
    """(category, target_id) of extraction events. events: target_id, stage, status, reason_code, case_count, skip_cause, error_code, output_state; skipped ones do not count."""
    e = events.where("(stage is null or stage = 'extract') and not coalesce(status = 'skipped', false) and not coalesce(skip_cause = 'out_of_scope', false)")
    empty, failed = F.coalesce((F.col("status") == "succeeded") & (F.col("case_count") == 0), F.lit(False)), F.coalesce(F.col("status") == "failed", F.lit(False))
    schema = failed & F.coalesce((F.col("error_code") == "json_validate_failed"), F.lit(False)) | failed & F.coalesce(F.col("output_state") == "invalid", F.lit(False))
    proof = failed & ~schema & F.coalesce(F.col("reason_code") == "evidence_validation_failed", F.lit(False))
    return failure_ids(e, {"schema_rejected": schema, "evidence_failed": proof, "empty_extraction": empty, "other_failure": failed & ~schema & ~proof}, "target_id")


def unmatched(cases: DataFrame, matches: DataFrame, key: str) -> DataFrame:
    """Cases that no match names."""
    return cases.join(matches.select(key).distinct(), key, "left_anti")


def coverage(gold: DataFrame, found: DataFrame, matches: DataFrame) -> DataFrame:
    """One row: gold and found cases, matched ones, those left over on each side, and the share of gold cases matched."""
    n = lambda df, name: df.agg(F.count("*").alias(name))
    got = n(gold, "gold_cases").join(F.broadcast(n(found, "model_cases"))).join(F.broadcast(n(matches, "matched_cases")))  # one row each
    return got.select("gold_cases", "model_cases", "matched_cases", (F.col("gold_cases") - F.col("matched_cases")).alias("unmatched_gold_cases"), (F.col("model_cases") - F.col("matched_cases")).alias("unmatched_model_cases"), F.try_divide("matched_cases", "gold_cases").alias("gold_case_coverage"))
