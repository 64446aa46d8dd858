"""Scans: JSON lines, CSV, saved feeds and listings, workbooks. Everything is a lazy DataFrame with a stated schema."""

from __future__ import annotations

import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from ..session import free_names, looked_up
from .posts import original_post  # noqa: F401


def exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    found = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(p)
    return found is not None and len(found) > 0


def json_lines(spark: SparkSession, paths: str | list[str], schema: StructType | str, key: str | None = None) -> DataFrame:
    """Rows of the files that exist; without a key they are dropped. No file: an empty frame."""
    found = [p for p in ([paths] if isinstance(paths, str) else paths) if exists(spark, p)]
    df = spark.read.schema(schema).json(found) if found else spark.createDataFrame([], schema)
    return df.where(F.col(key).isNotNull()) if key else df


def wanted(df: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    return df.join(ids.select(key).distinct(), key, "left_semi")


def unique(df: DataFrame, key: str) -> DataFrame:
    """``df``; reading it fails if a key occurs twice."""
    (times,) = free_names(df, "_times")
    n = df.groupBy(key).agg(F.count("*").alias(times))
    return df.join(n, key).where(F.assert_true(F.col(times) == 1, F.format_string("repeated id %s", F.col(key).cast("string"))).isNull()).drop(times)


def csv_exact(spark: SparkSession, path: str, header: list[str]) -> DataFrame:
    """A CSV whose header is exactly ``header``; all columns are text."""
    df = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    if df.columns != header:
        raise ValueError(f"the header is {df.columns}")
    return df


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, line, value): the lines of text files, numbered from 1 in each, however many splits a file is read in.

    A line's number is its place in its split and the lines of the file's splits before; only a count per split is joined.
    """
    raw = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("order"))
    counts = raw.groupBy("file", "block").agg(F.count("*").alias("n"), F.min("order").alias("first"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = counts.select(F.col("file").alias("f"), F.col("block").alias("b"), "first", before.alias("before"))
    # Ids rise by one from line to line of a split, so a line's place in it needs no window over the split.
    return raw.join(starts, (F.col("file") == F.col("f")) & (F.col("block") == F.col("b"))).select("file", (F.col("before") + F.col("order") - F.col("first") + 1).alias("line"), "value")


def url_list(spark: SparkSession, path: str, strict: bool = False) -> DataFrame:
    """(line, url): distinct URLs of a text file, each with its first line; blank lines and comments are left out.

    With ``strict``, reading fails at a line that is no web address, and names it.
    """
    lines = numbered_lines(spark, path).select("line", F.trim(F.regexp_replace("value", r"[\r\t]", " ")).alias("url")).where("url <> '' and url not like '#%'")
    if strict:
        lines = lines.where(F.assert_true(F.col("url").rlike(r"^https?://[^\s/]\S*$"), F.format_string("line %d is no web address: %s", "line", "url")).isNull())
    return lines.groupBy("url").agg(F.min("line").alias("line")).select("line", "url")


# -- saved responses ------------------------------------------------------------------------------

_CHILD = "struct<kind:string,data:struct<id:string,name:string,title:string,selftext:string,body:string,author:string,link_id:string,permalink:string,score:bigint,created_utc:double>>"


def listing_documents(pages: DataFrame, column: str = "body") -> DataFrame:
    """Posts and comments of saved listings (one object or several). Removed and deleted texts are left out."""
    one = f"struct<data:struct<children:array<{_CHILD}>>>"
    text = F.trim(F.col(column))
    lists = F.when(F.startswith(text, F.lit("[")), F.from_json(text, f"array<{one}>")).otherwise(F.array(F.from_json(text, one)))
    d = pages.select(F.explode(F.flatten(F.transform(F.filter(lists, lambda x: x.isNotNull()), lambda x: x["data"]["children"]))).alias("c")).select("c.kind", "c.data.*")
    gone = lambda c: F.when(F.trim(c).isin("", "[removed]", "[deleted]"), None).otherwise(F.trim(c))
    words = F.nullif(F.concat_ws("\n\n", gone(F.col("title")), gone(F.coalesce("selftext", "body"))), F.lit(""))
    author = F.when(F.col("author") != "[deleted]", F.col("author"))
    return d.where(F.col("kind").isin("t1", "t3")).select("id", F.when(F.col("kind") == "t3", "post").otherwise("comment").alias("source_type"), F.regexp_replace("link_id", "^t3_", "").alias("parent_thread_id"), F.col("permalink").alias("url"), author.alias("author"), words.alias("raw_text"), "score", F.timestamp_seconds("created_utc").alias("published_at")).where("raw_text is not null")


def thread_comments(pages: DataFrame, column: str = "body") -> DataFrame:
    """Top comments and their replies of saved comment threads, one row each."""
    snip = "struct<textOriginal:string,authorDisplayName:string,authorChannelId:struct<value:string>,publishedAt:string,likeCount:bigint>"
    one = f"struct<id:string,snippet:{snip}>"
    schema = f"struct<items:array<struct<id:string,snippet:struct<videoId:string,totalReplyCount:bigint,topLevelComment:{one}>,replies:struct<comments:array<{one}>>>>>"
    item = pages.select(F.explode(F.from_json(column, schema)["items"]).alias("i"))
    rows = item.select(F.col("i.id").alias("thread_id"), F.col("i.snippet.videoId").alias("video_id"), F.col("i.snippet.totalReplyCount").alias("total"), F.posexplode(F.concat(F.array("i.snippet.topLevelComment"), F.coalesce("i.replies.comments", F.array()))).alias("pos", "c"))
    blank = lambda c: F.nullif(F.trim(c), F.lit(""))
    zone = F.col("c.snippet.publishedAt").rlike(r"(Z|[+-]\d{2}:?\d{2})$")  # a time without zone is unknown
    return rows.select("thread_id", "video_id", F.col("c.id").alias("comment_id"), F.when(F.col("pos") == 0, "comment").otherwise("reply").alias("source_type"), F.coalesce(blank(F.col("c.snippet.authorChannelId.value")), blank(F.col("c.snippet.authorDisplayName"))).alias("author"), F.col("c.snippet.textOriginal").alias("raw_text"), F.when(zone, F.try_to_timestamp("c.snippet.publishedAt")).alias("published_at"), F.col("total").alias("n_replies_stated"))


def thread_completeness(comments: DataFrame) -> DataFrame:
    """(thread_id, n_replies, n_replies_stated, complete)."""
    n = comments.groupBy("thread_id").agg(F.count_if(F.col("source_type") == "reply").alias("n_replies"), F.max("n_replies_stated").alias("n_replies_stated"))
    return n.withColumn("complete", F.col("n_replies") == F.col("n_replies_stated"))


def store_reviews(pages: DataFrame, column: str = "body") -> DataFrame:
    """Reviews of a saved store feed; a feed of one entry may hold an object instead of a list."""
    label = "struct<label:string>"
    entry = f"struct<id:{label},title:{label},content:{label},`im:rating`:{label},author:struct<name:{label}>,updated:{label}>"
    many, one = F.from_json(column, f"struct<feed:struct<entry:array<{entry}>>>")["feed"]["entry"], F.from_json(column, f"struct<feed:struct<entry:{entry}>>")["feed"]["entry"]
    e = pages.select(F.explode(F.coalesce(many, F.array(one))).alias("e")).where("e.`im:rating` is not null")
    rating = F.col("e.`im:rating`.label").try_cast("double")
    return e.select(F.col("e.id.label").alias("review_id"), F.concat_ws("\n\n", "e.title.label", "e.content.label").alias("raw_text"), F.when(rating.between(1, 5), rating).alias("rating"), F.col("e.author.name.label").alias("author"), F.try_to_timestamp("e.updated.label").alias("published_at"))


def _review_frame(column: str) -> Column:
    """The one frame of the review call among all frames of all lines; null if there is none or more than one.

    An answer whose only frame bears another name is read as before.
    """
    lines = F.transform(F.split(column, "\n"), lambda x: F.try_variant_get(F.try_parse_json(x), "$", "array<variant>"))
    has = lambda f, i, name: F.coalesce(F.try_variant_get(f, f"$[{i}]", "string") == name, F.lit(False))
    frames = F.filter(F.flatten(F.filter(lines, lambda x: x.isNotNull())), lambda f: has(f, 0, "wrb.fr"))
    named = F.filter(frames, lambda f: has(f, 1, "oCPfdb"))
    return F.when(F.size(named) == 1, F.get(named, F.lit(0))).when((F.size(named) == 0) & (F.size(frames) == 1), F.get(frames, F.lit(0)))


def framed_refusals(pages: DataFrame, column: str = "body") -> DataFrame:
    """The saved RPC answers that ``framed_reviews`` takes no review from, with the reason."""
    listed = F.try_variant_get(F.try_parse_json(F.try_variant_get(_review_frame(column), "$[2]", "string")), "$[0]", "array<variant>")
    return pages.where(listed.isNull()).withColumn("failure", F.lit("malformed_page"))


def framed_reviews(pages: DataFrame, column: str = "body") -> DataFrame:
    """(review_id, author, rating, raw_text, page_token) of saved framed RPC answers: the payload is JSON inside JSON."""
    payload = F.try_parse_json(F.try_variant_get(_review_frame(column), "$[2]", "string"))
    p = pages.select(payload.alias("p"))
    rows = p.select(F.try_variant_get("p", "$[1][1]", "string").alias("page_token"), F.explode(F.try_variant_get("p", "$[0]", "array<variant>")).alias("r"))
    get = lambda path, kind: F.try_variant_get("r", path, kind)
    return rows.select(get("$[0]", "string").alias("review_id"), get("$[1][0]", "string").alias("author"), get("$[2]", "int").alias("rating"), get("$[4]", "string").alias("raw_text"), "page_token")


def new_only(df: DataFrame, known: DataFrame, keys: list[str]) -> DataFrame:
    return df.join(known.select(*keys).distinct(), keys, "left_anti")


# -- workbooks ------------------------------------------------------------------------------------


def sheet_names(z: zipfile.ZipFile) -> list[str]:
    ns = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
    return [s.get("name") for s in ElementTree.fromstring(z.read("xl/workbook.xml")).iter(ns + "sheet")]


def sheet_rows(path, sheet: str) -> Iterator[list[str | None]]:
    """Cell texts of a sheet of an XLSX file (a path or a file object), row by row; a row that the file leaves out is empty."""
    ns = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
    rel = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"
    with zipfile.ZipFile(path) as z:
        shared = []
        if "xl/sharedStrings.xml" in z.namelist():
            shared = ["".join(t.text or "" for t in si.iter(ns + "t")) for si in ElementTree.fromstring(z.read("xl/sharedStrings.xml"))]
        targets = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
        ids = {s.get("name"): s.get(rel) for s in ElementTree.fromstring(z.read("xl/workbook.xml")).iter(ns + "sheet")}
        if sheet not in ids:
            raise ValueError(f"no sheet {sheet!r}")
        with z.open("xl/" + targets[ids[sheet]].removeprefix("/xl/")) as f:
            given = 0
            for _, row in ElementTree.iterparse(f):
                if row.tag != ns + "row":
                    continue
                for _ in range(int(row.get("r") or given + 1) - given - 1):
                    given += 1
                    yield []
                given += 1
                cells: dict[int, str | None] = {}
                for c in row.iter(ns + "c"):
                    letters = re.match("[A-Z]+", c.get("r", "A"))[0]
                    col = 0
                    for x in letters:
                        col = col * 26 + ord(x) - 64
                    v, inline = c.find(ns + "v"), c.find(ns + "is")
                    if c.get("t") == "s" and v is not None:
                        cells[col] = shared[int(v.text)]
                    elif inline is not None:
                        cells[col] = "".join(t.text or "" for t in inline.iter(ns + "t"))
                    else:
                        cells[col] = None if v is None else v.text
                yield [cells.get(i) for i in range(1, max(cells, default=0) + 1)]
                row.clear()


class WorkbookSource(DataSource):
    """``spark.read.format("workbook").option("sheet", name).schema(...).load(path)``: the first row is the header; cells are text."""

    @classmethod
    def name(cls):
        return "workbook"

    def schema(self):
        head = next(sheet_rows(self.options["path"], self.options["sheet"]))
        return ", ".join(f"`{h}` string" for h in head if h)

    def reader(self, schema):
        return _WorkbookReader(self.options["path"], self.options["sheet"], [f.name for f in schema.fields])


class _WorkbookReader(DataSourceReader):
    def __init__(self, path, sheet, names):
        self.path, self.sheet, self.names = path, sheet, names

    def partitions(self):
        return [InputPartition(0)]

    def read(self, partition):
        rows = sheet_rows(self.path, self.sheet)
        at = {h: i for i, h in enumerate(next(rows, []))}
        missing = [n for n in self.names if n not in at]
        if missing:
            raise ValueError(f"the sheet lacks {missing}")
        for row in rows:
            if any(c not in (None, "") for c in row):
                yield tuple(row[at[n]] if at[n] < len(row) else None for n in self.names)


# -- cells and rows of imported sheets ------------------------------------------------------------


def enum_cell(value: Column, allowed: list[str], aliases: dict[str, str]) -> Column:
    """The allowed value that a cell means, or null."""
    v = F.lower(F.trim(value))
    named = F.coalesce(*[F.when(v == k, x) for k, x in aliases.items()], v)
    return F.when(named.isin(*allowed), named)


def date_cell(value: Column) -> Column:
    return F.coalesce(*[F.try_to_timestamp(value, F.lit(f)) for f in ("yyyy-MM-dd'T'HH:mm:ssXXX", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd", "dd/MM/yyyy")])


def rating_cell(value: Column) -> Column:
    n = value.try_cast("double")
    return F.when(n.between(1, 5), n)


def checked_rows(df: DataFrame, key: str, parent: str | None = None) -> DataFrame:
    """``df`` with an array ``reasons``: all rows of a repeated id are refused, and rows whose parent is missing or refused."""
    times, above, clean_name = free_names(df, "_times", "_above", "_clean")
    n = df.where(F.col(key).isNotNull()).groupBy(F.col(key).alias(above)).agg(F.count("*").alias(times))
    got = looked_up(df, key, n, above).select(key, *[c for c in df.columns if c != key], times).withColumn("reasons", F.array_compact(F.array(F.when(F.col(key).isNull(), "missing_id"), F.when(F.col(times) > 1, "duplicate_id")))).drop(times)
    if parent:
        clean = got.where(F.col(key).isNotNull()).groupBy(F.col(key).alias(above)).agg(F.min(F.size("reasons") == 0).alias(clean_name))
        got = looked_up(got, parent, clean, above)
        bad = F.when(F.col(parent).isNotNull() & F.col(above).isNull(), "orphan_parent").when(F.col(parent).isNotNull() & ~F.col(clean_name), "parent_rejected")
        got = got.withColumn("reasons", F.concat("reasons", F.array_compact(F.array(bad)))).drop(above, clean_name)
    return got


def clean_insights(df: DataFrame, columns: list[str], flag: str) -> DataFrame:
    """Missing columns added, cells trimmed, the flag parsed; every row stays (``analysis.first_per_key`` keeps the last of a URL)."""
    cells = [F.coalesce(F.trim(F.col(c)), F.lit("")).alias(c) if c in df.columns else F.lit("").alias(c) for c in columns]
    return df.select(*cells).withColumn(flag, F.upper(flag).isin("TRUE", "YES", "1"))
