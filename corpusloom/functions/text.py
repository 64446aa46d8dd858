"""Text as columns: normal forms, hashes, masks, tokens, spans. Offsets are 0-based, half-open code points."""

from __future__ import annotations

import hashlib
import unicodedata

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

MASK, EXCERPT = "#", 160
# What counts as personal data, in order of precedence. Digits, spaces and word ends are Unicode's: (?U).
PII = (
    ("email", r"[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,}"),
    ("phone", r"(?U)(?<!\d)(?:\+\d{1,3}[\s.\-]?)?(?:\(\d{3}\)|\d{3})[\s.\-]\d{3}[\s.\-]\d{4}(?!\d)"),
    ("handle", r"(?U)(?<![A-Za-z0-9._%+\-])@[A-Za-z0-9_]{2,30}\b"),
    ("digit_run", r"(?U)(?<!\d)\d{8,}(?!\d)"),
)
SPACES = r"(?U)\s+"


@F.pandas_udf(T.StringType())
def nfkc(s: pd.Series) -> pd.Series:
    return s.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t))


def composed(text: Column) -> Column:
    """NFKC. A condition does not keep rows from a UDF, so texts of ASCII alone are sent there as null."""
    return F.coalesce(nfkc(F.when(text.rlike(r"[^\x00-\x7F]"), text)), text)


def collapse(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, SPACES, " "))


def normalized(text: Column) -> Column:
    """Matching text: NFKC, lower case, white space collapsed."""
    return collapse(F.lower(composed(text)))


def token_count(norm: Column) -> Column:
    return F.when(norm == "", 0).otherwise(F.size(F.split(norm, " ")))


def tokens(norm: Column) -> Column:
    return F.filter(F.split(norm, " "), lambda w: w != "")


def hash_form(text: Column) -> Column:
    """Text for content hashes: also without URLs and punctuation."""
    bare = F.regexp_replace(F.lower(composed(text)), r"https?://\S+|www\.\S+", " ")
    return collapse(F.regexp_replace(bare, r"\p{P}", " "))


def content_hash(text: Column) -> Column:
    return F.sha2(hash_form(text), 256)


def raw_hash(text: Column) -> Column:
    return F.sha2(text, 256)


#: Shingles whose hashes are held at once.
LOT = 1 << 16


def _majority(sizes: list[int], ones: np.ndarray) -> np.ndarray:
    """The bits that over half the shingles have, as unsigned numbers; ``ones`` has a row of 64 counts per text, highest bit first."""
    return np.packbits(2 * ones > np.array(sizes, np.int64)[:, None], axis=1).view(">u8").ravel().astype(np.uint64)


def _ones(raw: list[bytes]) -> np.ndarray:
    return np.unpackbits(np.frombuffer(b"".join(raw), np.uint8).reshape(-1, 8), axis=1)


def simhashes(texts) -> np.ndarray:
    """SimHash of each text, unsigned. A lot of shingles is hashed and counted at a time, whether of many texts or a part of one."""
    sha1, out = hashlib.sha1, np.zeros(len(texts), np.uint64)
    raw, sizes, at = [], [], []

    def flush():
        if raw:
            starts = np.cumsum(sizes) - sizes
            out[at] = _majority(sizes, np.add.reduceat(_ones(raw), starts, axis=0, dtype=np.int64))
        for x in (raw, sizes, at):
            x.clear()

    for k, t in enumerate(texts):
        w = t.split() if t else []
        n = max(1, len(w) - 2) if w else 0
        if len(raw) + n > LOT:
            flush()
        shingle = lambda i: sha1(" ".join(w[i : i + 3]).encode()).digest()[:8]
        if n > LOT:
            ones = sum(_ones([shingle(i) for i in range(lo, min(n, lo + LOT))]).sum(axis=0, dtype=np.int64) for lo in range(0, n, LOT))
            out[k] = _majority([n], ones[None])[0]
        elif n:
            raw += [shingle(i) for i in range(n)]
            sizes.append(n)
            at.append(k)
    flush()
    return out


@F.pandas_udf(T.LongType())
def simhash(norm: pd.Series) -> pd.Series:
    """64-bit SimHash over 3-word shingles (first 8 bytes of SHA-1), a tie gives 0; signed. Null stays null."""
    return pd.Series(simhashes(norm).view(np.int64), index=norm.index, dtype="Int64").mask(norm.isna())


def hex64(bits: Column) -> Column:
    return F.lower(F.lpad(F.hex(bits), 16, "0"))


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def matches(text: Column, pattern: str, kind: str) -> Column:
    """Every match of a pattern as (start, stop, kind)."""
    parts = F.split(text, pattern, -1)
    found = F.regexp_extract_all(text, F.lit(f"({pattern})"), F.lit(1))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,stop:int,kind:string>>").alias("out"))

    def step(acc, i):
        s = acc["at"] + F.length(F.get(parts, i))
        e = s + F.length(F.get(found, i))
        return F.struct(e.alias("at"), F.concat(acc["out"], F.array(F.struct(s.alias("start"), e.alias("stop"), F.lit(kind).alias("kind")))).alias("out"))

    return F.when(F.size(found) > 0, F.aggregate(F.sequence(F.lit(0), F.size(found) - 1), start, step, lambda acc: acc["out"])).otherwise(start["out"])


def pii_spans(text: Column) -> Column:
    """Non-overlapping personal data: the longest wins, then the earliest, then the first kind; in text order."""

    def ranked(rank: int, kind: str, pattern: str) -> Column:
        found = matches(text, pattern, kind)
        return F.transform(found, lambda m: F.struct((m["start"] - m["stop"]).alias("less"), m["start"].alias("start"), F.lit(rank).alias("rank"), m["stop"].alias("stop"), m["kind"].alias("kind")))

    order = F.array_sort(F.concat(*[ranked(r, k, p) for r, (k, p) in enumerate(PII)]))
    none = F.array().cast("array<struct<start:int,stop:int,kind:string>>")

    def pick(acc, m):
        clash = F.exists(acc, lambda x: (x["start"] < m["stop"]) & (m["start"] < x["stop"]))
        return F.when(clash, acc).otherwise(F.concat(acc, F.array(F.struct(m["start"].alias("start"), m["stop"].alias("stop"), m["kind"].alias("kind")))))

    return F.when(text.rlike(r"(?U)@|\d{4}"), F.array_sort(F.aggregate(order, none, pick))).otherwise(none)


def masked(text: Column, spans: Column) -> Column:
    """The text with each span as so many mask signs; its length stays."""
    return F.aggregate(spans, text, lambda t, s: F.concat(F.substring(t, F.lit(1), s["start"]), F.repeat(F.lit(MASK), s["stop"] - s["start"]), F.substring(t, s["stop"] + 1, F.length(t))))


def excerpt(audit: Column, size: int = EXCERPT) -> Column:
    return F.substring(collapse(audit), 1, size)


def occurrences(text: Column, needle: Column) -> Column:
    """0-based starts of every occurrence, overlapping ones too: the text is cut in front of each in one pass."""
    quoted = F.concat(F.lit(r"(?=\Q"), F.replace(needle, F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E)"))
    sizes = F.transform(F.split(text, quoted, -1), lambda p: F.length(p))
    none = F.array().cast("array<int>")
    start = F.struct(F.lit(0).alias("at"), F.when(F.startswith(text, needle), F.array(F.lit(0))).otherwise(none).alias("out"))
    ends = F.aggregate(F.slice(sizes, 1, F.size(sizes) - 1), start, lambda acc, n: F.struct((acc["at"] + n).alias("at"), F.concat(acc["out"], F.array(acc["at"] + n)).alias("out")), lambda acc: acc["out"])
    return F.when((needle != "") & F.contains(text, needle), ends).otherwise(none)


def merged(spans: Column) -> Column:
    """Overlapping or touching spans (start, stop) become one."""
    none = F.array().cast("array<struct<start:int,stop:int>>")

    def step(acc, s):
        last = F.try_element_at(acc, F.lit(-1))
        joined = F.concat(F.slice(acc, 1, F.greatest(F.lit(0), F.size(acc) - 1)), F.array(F.struct(last["start"].alias("start"), F.greatest(last["stop"], s["stop"]).alias("stop"))))
        return F.when((F.size(acc) > 0) & (s["start"] <= last["stop"]), joined).otherwise(F.concat(acc, F.array(F.struct(s["start"].alias("start"), s["stop"].alias("stop")))))

    return F.aggregate(F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].cast("int").alias("start"), s["stop"].cast("int").alias("stop")))), none, step)


def window(audit: Column, starts: Column, stops: Column, around: int = EXCERPT) -> Column:
    """(text, offset): the part of ``audit`` from ``around`` before the first start to as much after the last stop."""
    lo = F.greatest(F.lit(0), F.coalesce(F.array_min(starts), F.lit(0)) - around)
    hi = F.least(F.length(audit), F.coalesce(F.array_max(stops), F.lit(0)) + around)
    return F.struct(F.substring(audit, lo + 1, hi - lo).alias("text"), lo.alias("offset"))


def highlighted(text: Column, spans: Column) -> Column:
    """Spans (start, stop, quote) that still match their quote, merged."""
    return merged(F.filter(spans, lambda s: F.substring(text, s["start"] + 1, s["stop"] - s["start"]) == s["quote"]))


def split_list(value: Column, sign: str = ";") -> Column:
    return F.filter(F.transform(F.split(value, sign), lambda x: F.trim(x)), lambda x: x != "")


def scrubbed(text: Column, names: Column, mask: str = "[name]") -> Column:
    return F.aggregate(names, text, lambda t, n: F.replace(t, n, F.lit(mask)))


def leaks(text: Column) -> Column:
    """Kinds of personal data or secrets that a text still shows."""
    marks = [("email", PII[0][1]), ("phone", PII[1][1]), ("secret", r"(?i)\b(?:api[_-]?key|secret|password|token)\s*[=:]\s*\S+")]
    return F.array_compact(F.array(*[F.when(text.rlike(p), k) for k, p in marks]))
