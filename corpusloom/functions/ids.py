"""Content-derived ids, canonical JSON and order-free hashes."""

from __future__ import annotations

import hmac

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def joined(*parts: Column) -> Column:
    """Parts with a bar between; null is empty, so positions stay."""
    return F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts])


def short_id(*parts: Column, length: int = 12) -> Column:
    return F.substring(F.sha1(joined(*parts)), 1, length)


def doc_id(platform: Column, item: Column, url_key: Column, raw_hash: Column, name: Column | None = None, author: Column | None = None, published: Column | None = None) -> Column:
    """Platform and id by the first natural key there is: item id, URL key, or name, author, date and text hash; null without one."""
    blank = lambda c: F.nullif(F.lit(None).cast("string") if c is None else c, F.lit(""))
    by_text = short_id(blank(name), F.coalesce(blank(author), F.lit("anon")), F.coalesce(blank(published), F.lit("")), raw_hash, length=40)
    key = F.coalesce(blank(item), blank(url_key), F.when(blank(raw_hash).isNotNull(), by_text))
    return F.when(key.isNotNull(), F.concat(platform, F.lit("-"), short_id(platform, key)))


def ordered_case_id(doc: Column, n: Column) -> Column:
    return F.concat(doc, F.format_string("#c%02d", n))


def unordered_case_id(doc: Column, payload: Column) -> Column:
    return F.concat(doc, F.lit("#u"), F.substring(F.sha1(payload), 1, 8))


def evidence_id(owner: Column, field: Column, quote: Column, start: Column, stop: Column) -> Column:
    """Offsets take part only if both are there."""
    both, said = start.isNotNull() & stop.isNotNull(), F.sha1(quote)
    return F.when(both, short_id(owner, field, start, stop, said)).otherwise(short_id(owner, field, said))


def link_id(doc: Column, canonical: Column, method: Column) -> Column:
    return short_id(doc, canonical, method)


def event_id(run: Column, stage: Column, target: Column, attempt: Column, status: Column) -> Column:
    return short_id(run, stage, target, attempt, status)


def fingerprint(*parts: Column) -> Column:
    return short_id(*parts, length=10)


def sorted_struct(df: DataFrame, drop: tuple = ()) -> Column:
    return F.struct(*[F.col(c) for c in sorted(df.columns) if c not in drop])


# Fields that differ between two runs over the same data.
VOLATILE = ("created_at", "run_id", "decided_at", "derived_at", "recorded_at", "duration_ms", "duration_s", "elapsed_ms", "latency_ms", "prompt_tokens", "completion_tokens", "input_tokens", "output_tokens", "total_tokens", "tokens_used", "request_count", "api_call_count", "cost_usd", "cost_estimate_usd", "hostname", "pid", "process_id", "local_path", "absolute_path", "output_path", "cwd", "cache_hit", "cache_status", "from_cache")


def _json_value(df: DataFrame, name: str) -> Column:
    """A column as JSON: null is said, and a number without a fraction has none."""
    c, kind = F.col(name), df.schema[name].dataType
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        whole = (c == F.floor(c)) & (F.abs(c) < 1e15)
        return F.coalesce(F.when(whole, c.cast("long").cast("string")).otherwise(c.cast("string")), F.lit("null"))
    listed = F.to_json(F.array(c), {"ignoreNullFields": "false"})
    return F.substring(listed, F.lit(2), F.length(listed) - 2)


def canonical_json(df: DataFrame, volatile: tuple = VOLATILE) -> Column:
    """A row as JSON with keys in order and without volatile ones. Nulls stay; 1.0 and 1 are alike."""
    parts = [F.concat(F.lit(f'"{c}":'), _json_value(df, c)) for c in sorted(df.columns) if c not in volatile]
    return F.concat(F.lit("{"), F.concat_ws(",", *parts), F.lit("}"))


def cache_key(df: DataFrame) -> Column:
    return F.sha2(F.to_json(sorted_struct(df)), 256)


def artifact_hash(df: DataFrame, key: str, levels: tuple = (6, 3, 0)) -> DataFrame:
    """One hash of all rows, whatever their order and wherever they lie.

    Row hashes, each with its number of rows, are hashed in order by their first digits, those hashes by fewer
    digits, and so on to the root. The tree has the same shape on every cluster, and no node has more children than
    one part in 16 ** 6 of the rows or 4,096. An empty table has the hash of nothing. ``key`` names the row's id.
    """
    level = df.select(F.sha2(canonical_json(df), 256).alias("h")).groupBy("h").agg(F.count("*").cast("string").alias("n")).select("h", F.concat_ws("*", "h", "n").alias("v"))
    for digits in levels:
        level = level.groupBy(F.substring("h", 1, digits).alias("h")).agg(F.sha2(F.array_join(F.sort_array(F.collect_list("v")), ","), 256).alias("v")).select("h", F.concat_ws("=", "h", "v").alias("v"), F.col("v").alias("root"))
    return level.agg(F.coalesce(F.max("root"), F.sha2(F.lit(""), 256)).alias("artifact_hash"))


def author_hash(salt: str):
    """HMAC-SHA256 of platform and name under a salt, 16 hex digits; blank names have none."""

    @F.pandas_udf(T.StringType())
    def one(platform: pd.Series, name: pd.Series) -> pd.Series:
        return pd.Series([None if not n or not n.strip() else hmac.new(salt.encode(), f"{p}|{n.strip()}".encode(), "sha256").hexdigest()[:16] for p, n in zip(platform, name)], dtype=object)

    return one


def list_price(tokens_in: Column, cached: Column, tokens_out: Column, price_in: str, price_cached: str, price_out: str) -> Column:
    """Estimated price per million tokens, in exact decimals; cached input is part of the input."""
    d = lambda x: F.lit(x).cast("decimal(10,4)")
    hit = F.least(F.greatest(cached, F.lit(0)), tokens_in)
    n = lambda c: c.cast("decimal(15,0)")
    return (n(tokens_in - hit) * d(price_in) + n(hit) * d(price_cached) + n(tokens_out) * d(price_out)) * F.lit("0.000001").cast("decimal(7,6)")


def retry_wait(attempt: Column) -> Column:
    return F.least(F.lit(2.0), 0.2 * F.pow(F.lit(2.0), attempt))


def next_slot(now: Column, zone: str, hours: tuple[int, ...]) -> Column:
    """The next of the daily hours of a time zone after ``now``, in UTC."""
    day = F.date_trunc("day", F.from_utc_timestamp(now, zone))
    slots = F.array(*[F.to_utc_timestamp(day + F.make_dt_interval(F.lit(d), F.lit(h)), zone) for d in (0, 1) for h in sorted(hours)])
    return F.array_min(F.filter(slots, lambda s: s > now))
