"""Quotes against source text: a ladder of checks that never invents a position."""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import ids
from ..functions import text as tx

_RANGE = T.StructType([T.StructField("start", T.IntegerType()), T.StructField("stop", T.IntegerType())])
_BLANKS = np.array([c for c in range(0x3001) if chr(c).isspace()], np.uint32)


def collapsed(text: str) -> tuple[str, np.ndarray]:
    """``text`` with each run of white space as one blank, and the place in ``text`` of each of its characters."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    blank = np.isin(codes, _BLANKS)
    kept = np.flatnonzero(~blank | ~np.concatenate(([False], blank[:-1])))
    return np.where(blank, np.uint32(32), codes)[kept].tobytes().decode("utf-32-le", "surrogatepass"), kept


@F.pandas_udf(_RANGE)
def spaced_match(text: pd.Series, quote: pd.Series, hint: pd.Series) -> pd.DataFrame:
    """The match of a quote whose white space differs, nearest to the hint; offsets address the original text. Null text: none.

    A text is collapsed once for all its quotes in a batch; places are read from its index.
    """
    out, held = [], (None, ("", np.zeros(0, int)))
    for t, q, h in zip(text, quote, hint):
        needle = " ".join((q or "").split())
        if t is None or not needle:
            out.append((None, None))
            continue
        if held[0] != t:
            held = (t, collapsed(t))
        flat, place = held[1]
        found, at = [], flat.find(needle)
        while at >= 0:
            found.append(at)
            at = flat.find(needle, at + 1)
        spans = [(int(place[f]), int(place[f + len(needle) - 1]) + 1) for f in found]
        known = None if pd.isna(h) else int(h)
        if len(spans) == 1 or (spans and known is not None):
            out.append(min(spans, key=lambda x: (abs(x[0] - known), x[0])) if known is not None else spans[0])
        else:
            out.append((None, None))
    return pd.DataFrame(out, columns=["start", "stop"]).astype("Int32")


# How a span's offsets were arrived at, by rung.
OFFSET_STATES = {"exact": "supplied_exact", "unique": "repaired_unique", "nearest": "repaired_nearest", "whitespace": "repaired_whitespace", "ambiguous": "ambiguous_tied", "not_found": "missing_unresolved"}


def ladder(spans: DataFrame, text: str = "raw_text", redactions: str = "redaction_spans") -> DataFrame:
    """``spans`` (quote, start, stop and the text) with final_start, final_stop, rung, offset_state and validation_state.

    Rungs: exact offsets; the only occurrence; the occurrence nearest to the offset given (ties: the first);
    the same with white space differences. A quote without a place, or one that meets masked text, is rejected.
    """
    t, q = F.col(text), F.col("quote")
    exact = F.col("start").isNotNull() & (F.substring(t, F.col("start") + 1, F.col("stop") - F.col("start")) == q) & (F.length(q) > 0)
    d = spans.withColumn("hits", F.when(F.coalesce(exact, F.lit(False)), F.array().cast("array<int>")).otherwise(tx.occurrences(t, q))).withColumn("exact", F.coalesce(exact, F.lit(False)))
    nearest = F.array_min(F.transform("hits", lambda h: F.struct(F.abs(h - F.col("start")).alias("d"), h.alias("at"))))["at"]
    lost = ~F.col("exact") & (F.size("hits") == 0)
    d = d.withColumn("loose", spaced_match(F.when(lost, t), q, F.col("start")))  # other texts are sent as null
    rung = (
        F.when(F.col("exact"), "exact")
        .when(F.size("hits") == 1, "unique")
        .when((F.size("hits") > 1) & F.col("start").isNotNull(), "nearest")
        .when(F.size("hits") > 1, "ambiguous")
        .when(F.col("loose.start").isNotNull(), "whitespace")
        .otherwise("not_found")
    )
    d = d.withColumn("rung", rung)
    at = F.when(rung == "exact", F.col("start")).when(rung == "unique", F.get("hits", F.lit(0))).when(rung == "nearest", nearest).when(rung == "whitespace", F.col("loose.start"))
    stop = F.when(rung == "exact", F.col("stop")).when(rung == "whitespace", F.col("loose.stop")).otherwise(at + F.length(q))
    d = d.withColumn("final_start", at).withColumn("final_stop", stop)
    hidden = F.coalesce(F.exists(redactions, lambda r: (F.col("final_start") < r["stop"]) & (r["start"] < F.col("final_stop"))), F.lit(False))
    state = F.when(F.col("final_start").isNull(), "rejected").when(hidden, "rejected_redacted").otherwise("valid")
    named = F.coalesce(*[F.when(F.col("rung") == k, v) for k, v in OFFSET_STATES.items()])
    return d.withColumns({"offset_state": named, "validation_state": state}).drop("hits", "exact", "loose")


def settled_spans(checked: DataFrame, owner: str, field: str, text: str = "raw_text") -> DataFrame:
    """``ladder``'s rows with final_quote, the text's own words at the final place, and the evidence_id made anew from them.

    A span without a place keeps its quote as claimed, and its id is made without offsets.
    """
    quote = F.when(F.col("final_start").isNotNull(), F.substring(F.col(text), F.col("final_start") + 1, F.col("final_stop") - F.col("final_start"))).otherwise(F.col("quote"))
    made = checked.withColumn("final_quote", quote)
    return made.withColumn("evidence_id", ids.evidence_id(F.col(owner).cast("string"), F.col(field), F.col("final_quote"), F.col("final_start"), F.col("final_stop")))


def dedupe_spans(spans: DataFrame, trust: dict[str, int]) -> DataFrame:
    """One row per evidence id: the least trusted state, at the place first seen. spans: owner_id, evidence_id, pos, validation_state."""
    level = F.coalesce(*[F.when(F.col("validation_state") == k, v) for k, v in trust.items()], F.lit(-1))
    return spans.withColumn("level", level).groupBy("owner_id", "evidence_id").agg(F.min("pos").alias("pos"), F.min_by("validation_state", F.struct("level", "pos")).alias("validation_state"))


def case_ordinals(cases: DataFrame) -> DataFrame:
    """Ordered ids of resolved cases by place, quote and payload; unresolved ones get an id from their payload."""
    resolved = F.col("start").isNotNull()
    w = Window.partitionBy("doc_id", resolved).orderBy("start", "stop", F.sha1("quote"), F.sha1("payload"))
    n = F.row_number().over(w)
    return cases.select("*", F.when(resolved, n).alias("ordinal"), F.when(resolved, ids.ordered_case_id(F.col("doc_id").cast("string"), n)).otherwise(ids.unordered_case_id(F.col("doc_id").cast("string"), F.col("payload"))).alias("case_id"))


def noncontinuous(audit: Column, quotes: Column) -> Column:
    return F.array_distinct(F.filter(quotes, lambda q: ~F.contains(audit, q)))


def verbatim_failures(spans: DataFrame) -> DataFrame:
    """Number of spans that are not verbatim, not valid or without offsets. spans: text, quote, start, stop, validation_state."""
    good = (F.substring("text", F.col("start") + 1, F.col("stop") - F.col("start")) == F.col("quote")) & (F.col("validation_state") == "valid")
    return spans.agg(F.count("*").alias("n"), F.count_if(~F.coalesce(good, F.lit(False))).alias("failures"))


def first_code(codes: Column, priority: list[str]) -> Column:
    """The code of highest priority that is there."""
    return F.try_element_at(F.filter(F.array(*map(F.lit, priority)), lambda p: F.array_contains(codes, p)), F.lit(1))


# By observation, whether a value and evidence must be there (True), must not (False) or may (None).
STATUS_GATE = {"stated": (True, True), "explicitly_none": (False, True), "uncertain": (None, True), "not_stated": (False, False), "not_applicable": (False, False)}


def gate_errors(records: DataFrame, required: list[str]) -> Column:
    """Every (field, error) of a record: its spans first, then each required field against the gate of its status.

    Columns owner_id, x_observation, x_value (text or array) and spans (owner_id, field_name, validation_state).
    A span of no required field, of another owner or not valid is an error; only valid spans of the record count
    as evidence. An optional technical_state other than ok exempts the record.
    """
    spans = F.coalesce("spans", F.array().cast(records.schema["spans"].dataType))
    known = lambda s: F.coalesce(s["field_name"].isin(required), F.lit(False))
    own = lambda s: s["owner_id"].eqNullSafe(F.col("owner_id"))
    valid = lambda s: s["validation_state"].eqNullSafe(F.lit("valid"))
    error = lambda field, name: F.struct(field.alias("field"), F.lit(name).alias("error"))
    of_span = lambda s: F.when(~known(s), error(s["field_name"], "unknown_field")).when(~own(s), error(s["field_name"], "wrong_owner")).when(~valid(s), error(s["field_name"], "unusable_span"))
    found = []
    for f in sorted(required):
        value, status = F.col(f"{f}_value"), F.col(f"{f}_observation")
        empty = value.isNull() | (F.size(value) == 0 if isinstance(records.schema[f"{f}_value"].dataType, T.ArrayType) else value.cast("string") == "")
        mine = F.filter(spans, lambda s: own(s) & s["field_name"].eqNullSafe(F.lit(f)))
        is_ = lambda i, want: status.isin([k for k, rule in STATUS_GATE.items() if rule[i] is want])
        found += [
            F.when(~F.coalesce(status.isin(list(STATUS_GATE)), F.lit(False)), error(F.lit(f), "unknown_status")),
            F.when(is_(1, True) & ~F.exists(mine, valid), error(F.lit(f), "missing_evidence")),
            F.when(is_(1, False) & (F.size(mine) > 0), error(F.lit(f), "forbidden_evidence")),
            F.when(is_(0, True) & empty, error(F.lit(f), "missing_value")),
            F.when(is_(0, False) & ~empty, error(F.lit(f), "forbidden_value")),
        ]
    errors = F.array_compact(F.concat(F.transform(spans, of_span), F.array(*found)))
    if "technical_state" not in records.columns:
        return errors
    return F.when(F.col("technical_state") == "ok", errors).otherwise(F.array().cast("array<struct<field:string,error:string>>"))


#: Quotation marks that a query may stand in, opening and closing.
QUOTES = ('""', "''", "\u201c\u201d", "\u2018\u2019", "``")


def _delimited(value: Column, text: Column) -> Column:
    """Where a query stands in quotes, or alone on a line that names it a query (in any case), as an array of (start, stop)."""
    size = F.length(value)
    at = lambda hits, off: F.transform(hits, lambda h: F.struct((h + off).alias("start"), (h + off + size).alias("stop")))
    quoted = [at(tx.occurrences(text, F.concat(F.lit(x[0]), value, F.lit(x[1]))), 1) for x in QUOTES]
    low_text, low_value = F.lower(text), F.lower(value)
    same = (F.length(low_text) == F.length(text)) & (F.length(low_value) == size)  # lower case that moves no place
    hits = F.when(same, tx.occurrences(low_text, low_value)).otherwise(tx.occurrences(text, value))

    def alone(h):
        before = F.substring(text, F.lit(1), h).rlike(r"(?i)(?:\A|\n)\s*(?:query|search query|search term)\s*:\s*\z")
        return before & F.substring(text, h + size + 1, F.length(text)).rlike(r"\A[^\S\n]*(?:\n|\z)")

    return F.when((value != "") & text.isNotNull(), F.concat(*quoted, at(F.filter(hits, alone), 0)))


def exact_query_supported(value: Column, spans: Column, text: Column) -> Column:
    """Whether a valid span of exact_query covers the delimited query. spans: field_name, validation_state, start, stop."""
    covers = lambda s, at: (s["field_name"] == "exact_query") & (s["validation_state"] == "valid") & (s["start"] <= at["start"]) & (s["stop"] >= at["stop"])
    return F.coalesce(F.exists(_delimited(value, text), lambda at: F.exists(spans, lambda s: F.coalesce(covers(s, at), F.lit(False)))), F.lit(False))


def inheritance_errors(doc_id: Column, scope: Column, decision_doc: Column, decision_scope: Column, decision_state: Column) -> Column:
    """Why a case may not inherit its scope from a decision: it is about another document, says otherwise, or is not valid. Empty: it may."""
    marks = [F.when(~doc_id.eqNullSafe(decision_doc), "other_document"), F.when(~scope.eqNullSafe(decision_scope), "other_scope"), F.when(~decision_state.eqNullSafe(F.lit("valid")), "decision_not_valid")]
    return F.array_compact(F.array(*marks))


def valid_only(records: DataFrame) -> DataFrame:
    """Records that may be analysed: those stored as valid, whatever their review flag says."""
    return records.where("validation_state = 'valid'")


def gate_for_analysis(records: DataFrame, key: str, errors: Column) -> DataFrame:
    """Evidence of ``records`` (key, evidence_ids), a row for each span; reading fails at a record with an error, so no caller gets by the gate."""
    sound = F.assert_true(F.size(errors) == 0, F.concat(F.col(key).cast("string"), F.lit(": "), F.array_join(errors.cast("array<string>"), ", ")))
    return records.where(sound.isNull()).select(key, F.explode("evidence_ids").alias("evidence_id"))


def exact_spans(spans: DataFrame) -> DataFrame:
    """``spans`` (text, quote, start, stop); reading fails at one whose quote does not stand at its place."""
    exact = F.coalesce(F.substring("text", F.col("start") + 1, F.col("stop") - F.col("start")) == F.col("quote"), F.lit(False))
    return spans.where(F.assert_true(exact, F.concat(F.lit("not at its place: "), F.coalesce("quote", F.lit("")))).isNull())
