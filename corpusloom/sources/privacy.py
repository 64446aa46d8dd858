"""What must not leave: a walk over a frame's schema that finds, strips and refuses, at any depth.

The walk happens once, over the schema, and gives one expression; values are never taken apart outside of it. Free JSON is a
variant, whose shape only its rows know: its nodes are listed level by level, and one that goes deeper is a finding itself.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import PII

# Keys and marks that no export may hold, and keys that are dropped from status documents.
FORBIDDEN_KEYS = (
    "raw_text", "raw_text_audit", "author_hash", "author_salt_id", "author_name", "author_name_raw", "provider_diagnostic", "raw_response_ref",
    "validation_errors", "error_message", "gate_errors", "request_identity", "prompt", "human_notes", "credentials", "api_key",
)
SECRET_MARKERS = ("GROQ_API_KEY", "YOUTUBE_API_KEY", "ANTHROPIC_API_KEY", "AUTHOR_SALT", "sk-ant-", "AIza")
SECRET_KEYS = ("api_key", "authorization", "author_salt", "client_secret", "password", "raw_text", "secret", "token")

FINDING = "struct<path:string,kind:string>"
#: Levels of a variant that are looked through.
DEPTH = 12


def _none() -> Column:
    return F.array().cast(f"array<{FINDING}>")


def _one(path: Column, kind: str, when: Column) -> Column:
    return F.when(F.coalesce(when, F.lit(False)), F.array(F.struct(path.alias("path"), F.lit(kind).alias("kind")))).otherwise(_none())


def _in_text(value: Column, path: Column, denied: tuple[str, ...]) -> Column:
    marks = {"email": value.rlike(PII[0][1]), "phone": value.rlike(PII[1][1])} | {m: F.contains(value, F.lit(m)) for m in (*SECRET_MARKERS, *denied) if m}
    kinds = F.array_compact(F.array(*[F.when(c, F.lit("denied" if m in denied else m)) for m, c in marks.items()]))
    return F.transform(F.coalesce(kinds, F.array().cast("array<string>")), lambda k: F.struct(path.alias("path"), k.alias("kind")))


def variant_nodes(value: Column, path: Column, depth: int = DEPTH) -> Column:
    """All nodes of a variant as (path, key, v), parents first; those on level ``depth`` are not opened."""
    node = "struct<path:string,key:string,v:variant>"
    none = F.array().cast(f"array<{node}>")

    def below(n):
        fields = F.map_entries(F.try_variant_get(n["v"], "$", "map<string,variant>"))
        items = F.try_variant_get(n["v"], "$", "array<variant>")
        named = F.transform(fields, lambda e: F.struct(F.concat(n["path"], F.lit("."), e["key"]).alias("path"), e["key"].alias("key"), e["value"].alias("v")))
        placed = F.transform(items, lambda x, i: F.struct(F.concat(n["path"], F.lit("["), i.cast("string"), F.lit("]")).alias("path"), F.lit(None).cast("string").alias("key"), x.alias("v")))
        return F.coalesce(named, placed, none)

    def step(s, _):
        return F.transform(F.array(F.flatten(F.transform(s["last"], below))), lambda new: F.struct(F.concat(s["met"], new).alias("met"), new.alias("last")))[0]

    top = F.when(value.isNotNull(), F.array(F.struct(path.alias("path"), F.lit(None).cast("string").alias("key"), value.alias("v")))).otherwise(none)
    return F.aggregate(F.sequence(F.lit(1), F.lit(depth)), F.struct(top.alias("met"), top.alias("last")), step)["met"]


def _in_variant(value: Column, path: Column, keys: tuple[str, ...], denied: tuple[str, ...], depth: int) -> Column:
    def of_node(n):
        shape = F.schema_of_variant(n["v"])
        text = F.when(shape == "STRING", F.try_variant_get(n["v"], "$", "string"))
        steps = F.size(F.regexp_extract_all(F.substr(n["path"], F.length(path) + 1), F.lit(r"\.|\["), F.lit(0)))
        return F.concat(_one(n["path"], "forbidden_key", n["key"].isin(*keys)), _in_text(text, n["path"], denied), _one(n["path"], "too_deep", (steps >= depth) & shape.rlike("^(ARRAY|OBJECT)")))

    return F.flatten(F.transform(variant_nodes(value, path, depth), of_node))


def _walk(value: Column, kind: T.DataType, path: Column, keys: tuple[str, ...], denied: tuple[str, ...], depth: int) -> Column | None:
    """Findings of a value of a type; None for types that can hold none."""
    if isinstance(kind, T.StringType):
        return _in_text(value, path, denied)
    if isinstance(kind, T.VariantType):
        return _in_variant(value, path, keys, denied, depth)
    if isinstance(kind, T.StructType):
        parts = []
        for f in kind.fields:
            at, v = F.concat(path, F.lit("." + f.name)), value[f.name]
            if f.name in keys:
                parts.append(_one(at, "forbidden_key", value.isNotNull()))
            below = _walk(v, f.dataType, at, keys, denied, depth)
            if below is not None:
                parts.append(below)
        return F.concat(*parts) if parts else None
    if isinstance(kind, T.ArrayType):
        if _walk(value, kind.elementType, path, keys, denied, depth) is None:
            return None
        found = F.transform(value, lambda x, i: _walk(x, kind.elementType, F.concat(path, F.lit("["), i.cast("string"), F.lit("]")), keys, denied, depth))
        return F.coalesce(F.flatten(found), _none())
    if isinstance(kind, T.MapType):

        def of_entry(e):
            at = F.concat(path, F.lit("."), e["key"].cast("string"))
            below = _walk(e["value"], kind.valueType, at, keys, denied, depth)
            own = _one(at, "forbidden_key", e["key"].cast("string").isin(*keys))
            return own if below is None else F.concat(own, below)

        return F.coalesce(F.flatten(F.transform(F.map_entries(value), of_entry)), _none())
    return None


def findings(df: DataFrame, keys: tuple[str, ...] = FORBIDDEN_KEYS, denied: tuple[str, ...] = (), depth: int = DEPTH) -> Column:
    """Each row's findings as an array of (path, kind): forbidden keys, e-mail addresses, phone numbers, marks of secrets.

    Struct fields, map keys and keys of variants count as keys, whatever they hold; texts are looked at wherever they lie.
    ``denied`` are secrets themselves, none of which may stand in any text: kind ``denied``, so that a finding doesn't show it.
    """
    parts = []
    for f in df.schema.fields:
        at = F.lit("$." + f.name)
        if f.name in keys:
            parts.append(_one(at, "forbidden_key", F.lit(True)))
        below = _walk(F.col(f"`{f.name}`"), f.dataType, at, keys, denied, depth)
        if below is not None:
            parts.append(below)
    return F.concat(*parts) if parts else _none()


def leak_findings(df: DataFrame, **options) -> DataFrame:
    """(path, kind, n): rows with each finding."""
    return df.select(F.explode(F.array_distinct(findings(df, **options))).alias("x")).groupBy("x.path", "x.kind").agg(F.count("*").alias("n"))


def guarded(df: DataFrame, **options) -> DataFrame:
    """``df``; whatever reads or writes it fails at a row with a finding, so nothing of that row's task is committed."""
    found = findings(df, **options)
    shown = F.array_join(F.transform(found, lambda x: F.concat(x["path"], F.lit(" "), x["kind"])), ", ")
    return df.where(F.assert_true(F.size(found) == 0, F.concat(F.lit("not allowed in an export: "), shown)).isNull())


def _stripped(value: Column, kind: T.DataType, keys: tuple[str, ...]) -> Column:
    if isinstance(kind, T.VariantType):
        raise ValueError("give a variant a schema before stripping it")
    if isinstance(kind, T.StructType):
        kept = [_stripped(value[f.name], f.dataType, keys).alias(f.name) for f in kind.fields if f.name.lower() not in keys]
        made = F.struct(*kept) if kept else F.struct()
        return F.when(value.isNotNull(), made)
    if isinstance(kind, T.ArrayType):
        return F.transform(value, lambda x: _stripped(x, kind.elementType, keys))
    if isinstance(kind, T.MapType):
        kept = F.map_filter(value, lambda k, v: ~F.lower(k.cast("string")).isin(*keys))
        return F.transform_values(kept, lambda k, v: _stripped(v, kind.valueType, keys))
    return value


def stripped(df: DataFrame, keys: tuple[str, ...] = SECRET_KEYS) -> DataFrame:
    """``df`` without the columns, struct fields and map entries whose name, in any case, is one of ``keys``, at any depth."""
    return df.select(*[_stripped(F.col(f"`{f.name}`"), f.dataType, keys).alias(f.name) for f in df.schema.fields if f.name.lower() not in keys])
