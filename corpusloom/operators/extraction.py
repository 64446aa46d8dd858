"""Long tables of cases, cards for export and calls of an external model (none by default)."""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import ids, text


def label_rows(cases: DataFrame, dims: list[str]) -> DataFrame:
    """(case_id, dimension, value, detail, evidence_id): a row per label of each array column."""
    long = cases.select("case_id", F.explode(F.array(*[F.struct(F.lit(d).alias("dimension"), F.col(d).alias("labels")) for d in dims])).alias("x"))
    return long.select("case_id", "x.dimension", F.explode("x.labels").alias("l")).select("case_id", "dimension", "l.value", "l.detail", "l.evidence_id")


def assigned(case: dict[str, Column]) -> Column:
    """Map of the fields that have a value."""
    pairs = F.array(*[F.struct(F.lit(k).alias("k"), v.cast("string").alias("v")) for k, v in case.items()])
    return F.map_from_entries(F.filter(pairs, lambda p: p["v"].isNotNull()))


def cards(documents: DataFrame, spans: DataFrame, canonical: DataFrame | None = None) -> DataFrame:
    """A card per document: excerpt around its spans, spans rebased to it, rejected quotes. spans: doc_id, start, stop, quote."""
    per = spans.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("start", "stop", "quote"))).alias("spans"))
    d = documents.join(per, "doc_id", "left").withColumn("spans", F.coalesce("spans", F.expr("cast(array() as array<struct<start:int,stop:int,quote:string>>)")))
    t = F.col("raw_text_audit")
    good = F.filter("spans", lambda s: F.substring(t, s["start"] + 1, s["stop"] - s["start"]) == s["quote"])
    d = d.withColumn("good", good).withColumn("rejected", F.transform(F.array_except("spans", "good"), lambda s: s["quote"]))
    d = d.withColumn("w", text.window(t, F.transform("good", lambda s: s["start"]), F.transform("good", lambda s: s["stop"])))
    rebased = F.transform("good", lambda s: F.struct((s["start"] - F.col("w.offset")).alias("start"), (s["stop"] - F.col("w.offset")).alias("stop"), s["quote"].alias("quote")))
    out = d.select("doc_id", F.col("w.text").alias("excerpt"), rebased.alias("spans"), "rejected")
    return out if canonical is None else out.join(canonical, "doc_id", "left")


def card_status(valid: Column, approved: Column, n_findings: Column, n_open: Column) -> Column:
    return F.when(approved, "approved").when(n_open > 0, "in_review").when(n_findings > 0, "has_findings").when(valid, "valid").otherwise("unverified")


def assess(rules: dict[str, Column]) -> tuple[Column, Column]:
    """(verdict, reasons) from rules that hold against a card."""
    reasons = F.array_compact(F.array(*[F.when(c, k) for k, c in rules.items()]))
    return F.when(F.size(reasons) == 0, "eligible").otherwise("ineligible"), reasons


def stage_events(rows: DataFrame, run: str, stage: str, status: Column, reason: Column, at: Column) -> DataFrame:
    key = F.col("doc_id").cast("string")
    return rows.select(ids.event_id(F.lit(run), F.lit(stage), key, F.lit(1), status).alias("event_id"), F.lit("document").alias("target_type"), key.alias("target_id"), F.lit(stage).alias("stage"), status.alias("status"), reason.alias("reason_code"), at.alias("occurred_at"))


def outcome_status(outcome: Column) -> Column:
    return F.when(outcome == "completed", "succeeded").when(outcome.isin("rate_limited", "unavailable"), "unavailable").when(outcome.isin("skipped", "unchanged"), "skipped").otherwise("failed")


def no_provider(prompts: list[str]) -> list[tuple[str | None, str]]:
    """(response, state) of each prompt: no model is there."""
    return [(None, "provider_unavailable") for _ in prompts]


def call_model(df: DataFrame, prompt: Column, provider: Callable[[list[str]], list[tuple[str | None, str]]] = no_provider) -> DataFrame:
    """(cache_key, prompt, response, technical_state); give only the misses of a cache to it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = provider(b.column(1).to_pylist())
            yield pa.record_batch([b.column(0), b.column(1), pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.string())], names=["cache_key", "prompt", "response", "technical_state"])

    return df.select(F.sha2(prompt, 256).alias("cache_key"), prompt.alias("prompt")).mapInArrow(run, "cache_key string, prompt string, response string, technical_state string")


def decision(ok: Column, doc_matches: Column, n_valid: Column, scope: Column, confidence: Column, cutoff: float = 0.7) -> list[Column]:
    """technical_state, scope_class, is_relevant and needs_human_review of a parsed answer; a failure is never a finding."""
    state = F.when(~ok, "provider_failed").when(~doc_matches, "document_mismatch").when(n_valid == 0, "evidence_failed").otherwise("ok")
    kept = F.when(state == "ok", scope)
    return [state.alias("technical_state"), kept.alias("scope_class"), kept.isin("core", "adjacent").alias("is_relevant"), ((state != "ok") | F.coalesce(confidence < cutoff, F.lit(True))).alias("needs_human_review")]



@F.pandas_udf(T.StringType())
def repaired(raw: pd.Series) -> pd.Series:
    """``repaired_json`` as a column, for answers that do not parse as they are."""
    return raw.map(repaired_json)


def repaired_json(raw: str | None) -> str | None:
    """JSON text without fences, curly quotes and trailing commas; null if it still does not parse."""
    if raw is None:
        return None
    for t in (raw, re.sub(r",\s*([}\]])", r"\1", re.sub(r"^\s*```(?:json)?\s*|\s*```\s*$", "", raw).translate({0x201C: '"', 0x201D: '"'}))):
        try:
            return json.dumps(json.loads(t), sort_keys=True)
        except ValueError:
            continue
    return None
