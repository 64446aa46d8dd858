"""Original posts of saved forum pages, read from what a page states about itself, with columns only.

A page states its question in structured data (JSON-LD); one that doesn't may hold the forum's own start value, a
JavaScript string with JSON in it. Both become variants, and every condition is a predicate over their fields.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Addresses, marks and places of fields in the forum's pages, and the names of refusals.
THREAD_URL = r"\Ahttps://support\.google\.com/photos/thread/([0-9]+)(?:/[^/?#]*)?/?(?:\?[^#]*)?(?:#.*)?\z"
PAGE_TYPE = r"""\bdata-page-type\s*=\s*["']SUPPORT_FORUM_THREAD["']"""
THREAD, AUTHOR, INFO, INFO_ID, INFO_MICROS, AUTHOR_KEY, TITLE, WORDS, LEAST_FIELDS = "$[1]", "$[3]", "$[1][0]", "$[1][0][0]", "$[1][0][1]", "$[1][6]", "$[1][8]", "$[1][12]", 14
AUTHOR_NAME, AUTHOR_ID = "$[3][0][0]", "$[3][2]"
NO_POST, AMBIGUOUS, OTHER_THREAD, UNSUPPORTED = "no_verified_plain_original_post", "ambiguous_original_post", "thread_identity_mismatch", "unsupported_thread_bootstrap"
FROM_QUESTION, FROM_THREAD = "QAPage.mainEntity.text", "thread_view[1][12]"

#: How deep lists and graphs of structured data may lie in one another.
DEPTH = 6
_LINKED_DATA = r"""(?is)<script\b[^>]*type\s*=\s*["']application/ld\+json["'][^>]*>(.*?)</script\s*>"""
_SCRIPT = r"(?is)<script\b([^>]*)>(.*?)</script\s*>"
_START_VALUE = r"(?s)\bvar\s+thread_view\s*=\s*'([^'\\]*+(?:\\.[^'\\]*+)*+)'\s*;"


def thread_of(url: Column) -> Column:
    """The number of the thread that a URL leads to, or null."""
    return F.nullif(F.regexp_extract(url, "(?s)" + THREAD_URL, 1), F.lit(""))


def _every(text: Column, pattern: str, group: int = 1) -> Column:
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(pattern), F.lit(group))


def _string(v: Column, path: str) -> Column:
    """The string at a path; null if there is none or something else."""
    at = F.try_variant_get(v, path, "variant")
    return F.when(F.schema_of_variant(at) == "STRING", F.try_variant_get(at, "$", "string"))


def _list(v: Column, path: str = "$") -> Column:
    return F.coalesce(F.try_variant_get(v, path, "array<variant>"), F.array().cast("array<variant>"))


def _is_plain(text: Column) -> Column:
    return F.coalesce((F.trim(F.regexp_replace(text, r"\s", " ")) != "") & ~text.rlike(r"</?[A-Za-z][^>]*>"), F.lit(False))


def questions(html: Column) -> Column:
    """The main entity of each question page in a page's structured data, as an array of variants."""
    graph = '$["@graph"]'

    def below(n):
        own = F.try_variant_get(n, graph, "variant")
        single = F.when(F.schema_of_variant(own).startswith("OBJECT"), F.array(own)).otherwise(F.array().cast("array<variant>"))
        return F.concat(_list(n), _list(n, graph), single)

    top = F.filter(F.transform(_every(html, _LINKED_DATA), F.try_parse_json), lambda v: v.isNotNull())
    walk = F.aggregate(
        F.sequence(F.lit(1), F.lit(DEPTH)),
        F.struct(top.alias("met"), top.alias("last")),
        lambda s, _: F.transform(F.array(F.flatten(F.transform(s["last"], below))), lambda new: F.struct(F.concat(s["met"], new).alias("met"), new.alias("last")))[0],
    )
    kind = '$["@type"]'
    pages = F.filter(walk["met"], lambda n: F.coalesce(_string(n, kind) == "QAPage", F.array_contains(F.try_variant_get(n, kind, "array<string>"), "QAPage"), F.lit(False)))
    mains = F.transform(pages, lambda n: F.try_variant_get(n, "$.mainEntity", "variant"))
    return F.filter(mains, lambda m: ~F.coalesce(F.schema_of_variant(m).rlike("^(ARRAY|VOID)"), F.lit(True)))


def js_string(literal: Column) -> Column:
    """The value of what stands between the single quotes of a JavaScript string; null if an escape is not known.

    It is respelled as a JSON string: between pairs of backslashes, hexadecimal escapes become Unicode ones, single
    quotes lose and double quotes get their backslash.
    """

    def respelled(x):
        x = F.regexp_replace(x, r"\\x([0-9a-fA-F]{2})", r"\\u00$1")
        x = F.replace(F.replace(F.replace(x, F.lit("\\'"), F.lit("'")), F.lit('\\"'), F.lit('"')), F.lit('"'), F.lit('\\"'))
        return F.replace(x, F.lit("\t"), F.lit("\\t"))

    json = F.array_join(F.transform(F.split(literal, r"\\\\"), respelled), "\\\\")
    return F.try_variant_get(F.try_parse_json(F.concat(F.lit('"'), json, F.lit('"'))), "$", "string")


def start_values(html: Column) -> Column:
    """The literals of the forum's start value in the scripts that a page holds itself."""
    scripts = F.arrays_zip(_every(html, _SCRIPT, 1).alias("given"), _every(html, _SCRIPT, 2).alias("body"))
    own = F.filter(scripts, lambda s: ~s["given"].rlike(r"(?i)\bsrc\s*="))
    return F.flatten(F.transform(own, lambda s: _every(s["body"], _START_VALUE)))


def canonical_threads(html: Column) -> Column:
    """The thread (or null) that each canonical link of a page leads to."""
    links = F.filter(_every(html, r"(?is)<link\b([^>]*)>"), lambda x: x.rlike(r"""(?i)\brel\s*=\s*["']canonical["']"""))
    return F.transform(links, lambda x: thread_of(F.regexp_extract(x, r"""(?i)\bhref\s*=\s*["']([^"']+)["']""", 1)))


def _moment(micros: Column) -> Column:
    """A count of microseconds as a time in UTC, whatever the session's zone; null unless it is a whole number of 14 to 17 digits.

    It stays a whole number throughout: a double would not hold those beyond 2 ** 53 (the year 2255) exactly.
    """
    ms = F.when(micros.rlike("^[0-9]{14,17}$"), F.call_function("div", micros.try_cast("long"), F.lit(1000)))
    day = F.date_add(F.lit("1970-01-01").cast("date"), F.floor(ms / 86_400_000).cast("int")).cast("string")
    at = lambda unit, most: (F.floor(ms / unit) % most).cast("int")
    return F.concat(day, F.format_string("T%02d:%02d:%02d.%03dZ", at(3_600_000, 24), at(60_000, 60), at(1000, 60), at(1, 1000)))


def original_post(pages: DataFrame, html: str = "html", item: str | None = None) -> DataFrame:
    """``pages`` with title, body_text, author_name, published_at and text_path of the original post, or null and the ``failure``.

    The text is that of the only question of the structured data, else that of the page's start value. The visible page
    is never read in its place. ``item`` names a column of thread ids that a page must fit. A null page has no post.
    """
    page = F.col(html)
    known = F.lit(None).cast("string") if item is None else F.col(item).cast("string")
    found = pages.select(*pages.columns, F.struct(questions(page).alias("asked"), start_values(page).alias("literals"), canonical_threads(page).alias("links"), F.coalesce(page.rlike(PAGE_TYPE), F.lit(False)).alias("typed"), known.alias("known")).alias("__post"))

    q = F.get(F.col("__post.asked"), F.lit(0))
    leads = thread_of(_string(q, "$.url"))
    other = F.col("__post.known").isNotNull() & (F.coalesce(_string(q, "$.url"), F.lit("")) != "") & ~F.coalesce(leads == F.col("__post.known"), F.lit(False))
    published = F.coalesce(F.nullif(_string(q, "$.dateCreated"), F.lit("")), _string(q, "$.datePublished"))
    asked = F.struct(
        _string(q, "$.name").alias("title"),
        _string(q, "$.text").alias("body_text"),
        _string(q, "$.author.name").alias("author_name"),
        F.when(published.rlike(r"(Z|[+-][0-9]{2}:[0-9]{2})\z"), published).alias("published_at"),
        F.lit(FROM_QUESTION).alias("text_path"),
        F.when(other, OTHER_THREAD).when(~_is_plain(_string(q, "$.text")), NO_POST).alias("failure"),
    )

    v = F.try_parse_json(js_string(F.get(F.col("__post.literals"), F.lit(0))))
    number = F.coalesce(F.col("__post.known"), F.get(F.col("__post.links"), F.lit(0)))
    same = (F.size("__post.links") == 1) & (F.get(F.col("__post.links"), F.lit(0)) == number)
    same = same & (F.try_variant_get(v, INFO, "array<variant>").isNull() | F.coalesce(F.try_variant_get(v, INFO_ID, "string") == number, F.lit(False)))
    whole = F.col("__post.typed") & (F.size(_list(v, THREAD)) >= LEAST_FIELDS) & F.try_variant_get(v, INFO, "array<variant>").isNotNull()
    whole = whole & (F.coalesce(F.trim(_string(v, TITLE)), F.lit("")) != "") & _is_plain(_string(v, WORDS))
    writer = F.try_variant_get(v, AUTHOR_ID, "string") == F.try_variant_get(v, AUTHOR_KEY, "string")
    started = F.struct(
        _string(v, TITLE).alias("title"),
        _string(v, WORDS).alias("body_text"),
        F.when(writer, _string(v, AUTHOR_NAME)).alias("author_name"),
        _moment(F.try_variant_get(v, INFO_MICROS, "string")).alias("published_at"),
        F.lit(FROM_THREAD).alias("text_path"),
        F.when(v.isNull(), UNSUPPORTED).when(~F.coalesce(same, F.lit(False)), OTHER_THREAD).when(~F.coalesce(whole, F.lit(False)), UNSUPPORTED).alias("failure"),
    )

    n_asked, n_started = F.size("__post.asked"), F.size("__post.literals")
    several = (n_asked > 1) | ((n_asked == 0) & (n_started > 1))
    one = F.when(n_asked == 1, asked).when((n_asked == 0) & (n_started == 1), started)
    got = found.select(*pages.columns, F.when(several, AMBIGUOUS).when(one.isNull(), NO_POST).otherwise(one["failure"]).alias("failure"), one.alias("__one"))
    kept = [F.when(F.col("failure").isNull(), F.col(f"__one.{c}")).alias(c) for c in ("title", "body_text", "author_name", "published_at", "text_path")]
    return got.select(*pages.columns, *kept, "failure")
