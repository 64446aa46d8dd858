"""Readers and sinks: tables written and read back, with the SQL of what must come back; and small rules without a query before."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import functions as F

from ..functions import ids
from ..operators import evidence, routing
from ..sources import readers, workbooks, writers
from ..streaming import incremental
from .cases import rel
from .datasets import _scratch
from .registry import query


@query("SELECT o_orderkey AS k, o_custkey AS c, o_orderpriority AS p FROM orders WHERE o_custkey % 3 = 0 AND o_orderkey % 11 <> 0")
def json_lines_wanted(t):
    """Two files of JSON lines and one that is missing; rows without a key are dropped and only wanted ids are kept."""
    o, out = t("orders"), _scratch(t, "lines")
    rows = o.select(F.when(F.col("o_orderkey") % 11 != 0, F.col("o_orderkey")).alias("k"), F.col("o_custkey").alias("c"), F.col("o_orderpriority").alias("p"))
    writers.write_json_lines(rows.where("c % 2 = 0"), f"{out}/even", "k")
    writers.write_json_lines(rows.where("c % 2 = 1"), f"{out}/odd", "k")
    back = readers.json_lines(o.sparkSession, [f"{out}/even", f"{out}/odd", f"{out}/gone"], "k long, c long, p string", "k")
    return readers.wanted(back, t("customer").where("c_custkey % 3 = 0").select(F.col("c_custkey").alias("c")), "c")


@query("SELECT c_custkey AS k, c_name AS name, c_mktsegment AS segment FROM customer")
def json_lines_appended(t):
    """Rows appended in two runs, read as records whose id may stand there once."""
    c, out = t("customer").select(F.col("c_custkey").alias("k"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment")), _scratch(t, "appended")
    writers.append_json_lines(c.where("k % 2 = 0"), out)
    writers.append_json_lines(c.where("k % 2 = 1"), out)
    return readers.unique(readers.json_lines(c.sparkSession, out, "k long, name string, segment string"), "k")


@query("SELECT doc_id::VARCHAR AS doc_id, 'x' || replace(coalesce(text, ''), chr(13), ' ') AS text, coalesce(source, '-') AS source FROM documents")
def csv_sheet(t):
    """Whole texts with quotes, commas and line breaks as a CSV sheet with its exact header."""
    out = _scratch(t, "sheet")
    writers.write_sheet(t("documents").select("doc_id", F.concat(F.lit("x"), F.replace(F.coalesce("text", F.lit("")), F.lit("\r"), F.lit(" "))).alias("text"), F.coalesce("source", F.lit("-")).alias("source")), out, ["doc_id"])
    return readers.csv_exact(t("documents").sparkSession, out, ["doc_id", "text", "source"])


@query("SELECT s_suppkey AS k, s_name AS name FROM supplier WHERE s_suppkey % 5 <> 0")
def snapshot_rows(t):
    """The second of two published versions, through the pointer; publishing it again changes nothing."""
    s, out = t("supplier").select(F.col("s_suppkey").alias("k"), F.col("s_name").alias("name")), _scratch(t, "snapshot")
    writers.publish_snapshot(s, out, "k")
    writers.publish_snapshot(s.where("k % 5 <> 0"), out, "k")
    version, changed = writers.publish_snapshot(s.where("k % 5 <> 0"), out, "k")
    return writers.load_snapshot(s.sparkSession, out, "k long, name string").where(F.lit(not changed and version == writers.current_version(s.sparkSession, out)))


@query("SELECT 'orders' AS name, o_orderkey AS k, o_orderstatus AS v FROM orders UNION ALL SELECT 'suppliers', s_suppkey, s_name FROM supplier")
def dataset_folder(t):
    """A folder per table."""
    o, s, out = t("orders").select(F.col("o_orderkey").alias("k"), F.col("o_orderstatus").alias("v")), t("supplier").select(F.col("s_suppkey").alias("k"), F.col("s_name").alias("v")), _scratch(t, "folder")
    writers.write_dataset({"orders": o, "suppliers": s}, out, {"orders": "k", "suppliers": "k"})
    read = lambda n: readers.json_lines(o.sparkSession, f"{out}/{n}", "k long, v string").select(F.lit(n).alias("name"), "k", "v")
    return read("orders").union(read("suppliers"))


@query("SELECT o_orderkey AS cache_key, o_orderkey % 3 = 1 AS hit, CASE WHEN o_orderkey % 3 = 1 THEN o_orderpriority END AS response FROM orders")
def cache_lookups(t):
    """Hits and misses of a cache; entries without a response are misses."""
    o, out = t("orders"), _scratch(t, "cache")
    key = F.col("o_orderkey").alias("cache_key")
    writers.write_cache(o.where("o_orderkey % 3 = 1").select(key, F.col("o_orderpriority").alias("response")), out, ("none of these",))
    writers.write_cache(o.where("o_orderkey % 3 = 2").select(key, F.lit(None).cast("string").alias("response")), out)
    hits, misses = writers.cached(o.select(key), o.sparkSession.read.parquet(out))
    return hits.select("cache_key", F.lit(True).alias("hit"), "response").union(misses.select("cache_key", F.lit(False), F.lit(None).cast("string")))


@query("SELECT DISTINCT o_custkey AS item, o_orderstatus AS form FROM orders")
def seen_items(t):
    """Two batches and a repeat of the second appended to the index of items: each form of an item once."""
    items, out = t("orders").select(F.col("o_custkey").alias("item"), F.col("o_orderstatus").alias("form"), "o_orderkey"), _scratch(t, "seen")
    process = incremental.append_unseen(out, ["item", "form"])
    for n, part in enumerate(("o_orderkey % 2 = 0", "o_orderkey % 2 = 1", "o_orderkey % 2 = 1")):
        process(items.where(part).select("item", "form"), n)
    return items.sparkSession.read.parquet(out)


@query("""SELECT k, min(s) AS slot FROM (SELECT o_orderkey AS k, o_orderdate::TIMESTAMP + to_hours(o_orderkey::INTEGER % 24) + to_minutes(o_custkey::INTEGER % 60) AS now FROM orders) o, (VALUES (0, 9), (0, 18), (1, 9), (1, 18)) v(d, h), LATERAL (SELECT timezone('UTC', timezone('Europe/Berlin', date_trunc('day', timezone('Europe/Berlin', timezone('UTC', now)))::TIMESTAMP + to_days(d) + to_hours(h))) AS s) WHERE s > now GROUP BY k""")
def next_slots(t):
    """The next of two daily hours in Berlin after each order's time, in UTC."""
    now = F.timestamp_add("MINUTE", F.col("o_custkey") % 60, F.timestamp_add("HOUR", F.col("o_orderkey") % 24, F.col("o_orderdate").cast("timestamp")))
    return t("orders").select(F.col("o_orderkey").alias("k"), ids.next_slot(now, "Europe/Berlin", (18, 9)).alias("slot"))


@query("SELECT o_orderpriority AS scope, count(*) AS n FROM orders WHERE o_orderkey % 4 <> 0 AND (CASE WHEN o_orderkey % 2 = 0 THEN '1-URGENT' ELSE '5-LOW' END) <> o_orderpriority GROUP BY ALL")
def hint_contradictions(t):
    """Orders whose hint says another class than they have; those without a hint contradict nothing."""
    hint = F.when(F.col("o_orderkey") % 4 != 0, F.when(F.col("o_orderkey") % 2 == 0, "1-URGENT").otherwise("5-LOW"))
    return t("orders").where(routing.contradicts(hint, F.col("o_orderpriority"))).groupBy(F.col("o_orderpriority").alias("scope")).agg(F.count("*").alias("n"))


_TYPED = "CASE o_orderkey % 7 WHEN 0 THEN CONCAT('I typed \"', v, '\" there') WHEN 1 THEN CONCAT('I typed ', v, ' there') WHEN 2 THEN CONCAT('First.', {nl}, '  Search Query :  ', upper(v), '  ', {nl}, 'more') WHEN 3 THEN CONCAT('I typed \"', v, '\" there') WHEN 4 THEN CONCAT('I typed \"', v, '\" there') WHEN 5 THEN CONCAT('`', v, '`') ELSE CONCAT('my query: ', v) END"


@query(f"""WITH x AS (SELECT o_orderkey, {_TYPED.format(nl='chr(10)')} AS x, v FROM (SELECT *, 'old photo ' || o_custkey AS v FROM orders)), p AS (SELECT *, instr(lower(x), v) AS p FROM x)
SELECT o_orderkey AS k, (o_orderkey % 7 NOT IN (3, 4)) AND ((substr(x, p - 1, 1) IN ('"', '`') AND substr(x, p - 1, 1) = substr(x, p + length(v), 1)) OR regexp_matches(substr(x, 1, p - 1), '(?i)(^|\\n)\\s*(query|search query|search term)\\s*:\\s*$') AND regexp_matches(substr(x, p + length(v)), '^[ \\t]*(\\n|$)')) AS supported FROM p""")
def exact_queries(t):
    """Whether the query that a case names stands in quotes or on a line of its own, and a valid span covers it."""
    rows = rel(t, f"SELECT o_orderkey AS k, v, {_TYPED.format(nl='char(10)')} AS x FROM (SELECT *, CONCAT('old photo ', CAST(o_custkey AS STRING)) AS v FROM {{orders}})")
    k, start = F.col("k"), F.instr(F.lower("x"), F.col("v")) - 1
    span = F.struct(F.lit("exact_query").alias("field_name"), F.when(k % 7 == 3, "rejected").otherwise("valid").alias("validation_state"), start.alias("start"), (start + F.length("v") - F.when(k % 7 == 4, 1).otherwise(0)).alias("stop"))
    return rows.select("k", evidence.exact_query_supported(F.col("v"), F.array(span), F.col("x")).alias("supported"))


ORDERS = workbooks.Sheet("orders", ("id", "parent", "priority", "price"), ("id",), {"priority": lambda c: readers.enum_cell(c, ["high", "low"], {"1-urgent": "high", "2-high": "high", "5-low": "low"}), "price": lambda c: c.try_cast("double")})


def _books(batches):
    """(path, content) of (path, rows): a workbook is made and handed on before the next one's rows become objects."""
    for batch in batches:
        for i in range(batch.num_rows):
            path, rows = (c[i].as_py() for c in batch.columns)
            book = workbooks.workbook_bytes({"orders": [["price", "id", "parent", "priority"], *[[r["price"], r["id"], r["parent"], r["priority"]] for r in rows]]})
            yield pa.record_batch([pa.array([path], pa.string()), pa.array([book], pa.binary())], names=["path", "content"])


@query("""
WITH o AS (SELECT o_orderkey AS k, o_orderkey // 512 AS file, CASE WHEN o_orderkey % 19 = 0 THEN NULL WHEN o_orderkey % 23 = 0 THEN 'twice' ELSE 'o' || o_orderkey END AS id, CASE WHEN o_orderkey % 6 = 0 THEN 'o' || (o_orderkey - 1) END AS parent, o_orderpriority AS p, o_orderkey % 29 = 0 AS bad FROM orders),
f AS (SELECT *, row_number() OVER (PARTITION BY file ORDER BY k) + 1 AS row, count(*) OVER (PARTITION BY file, id) AS n, lower(p) IN ('1-urgent', '2-high', '5-low') AS known FROM o),
g AS (SELECT *, list_filter([CASE WHEN id IS NULL THEN 'missing id' END, CASE WHEN NOT known THEN 'unreadable priority' END, CASE WHEN bad THEN 'unreadable price' END, CASE WHEN id IS NOT NULL AND n > 1 THEN 'duplicate_id' END], lambda x: x IS NOT NULL) AS own FROM f)
SELECT 'f' || g.file AS path, g.row::INTEGER AS row, g.id, CASE WHEN g.known THEN CASE WHEN lower(g.p) = '5-low' THEN 'low' ELSE 'high' END END AS priority, array_to_string(list_sort(g.own || list_filter([CASE WHEN g.parent IS NOT NULL AND h.id IS NULL THEN 'orphan_parent' WHEN g.parent IS NOT NULL AND len(h.own) > 0 THEN 'parent_rejected' END], lambda x: x IS NOT NULL)), '|') AS reasons
FROM g LEFT JOIN g h ON h.file = g.file AND h.id = g.parent""")
def workbook_import(t):
    """Orders written as workbooks of at most 512 rows and imported again: types, refusals, parents."""
    k = F.col("o_orderkey")
    cell = F.struct(k.alias("k"), F.when(k % 29 == 0, "n/a").otherwise(F.col("o_totalprice").cast("string")).alias("price"), F.when(k % 19 == 0, None).when(k % 23 == 0, "twice").otherwise(F.concat(F.lit("o"), k.cast("string"))).alias("id"), F.when(k % 6 == 0, F.concat(F.lit("o"), (k - 1).cast("string"))).alias("parent"), F.col("o_orderpriority").alias("priority"))
    lots = t("orders").groupBy(F.concat(F.lit("f"), F.floor(k / 512).cast("string")).alias("path")).agg(F.sort_array(F.collect_list(cell)).alias("rows"))  # 512 orders at most
    files = lots.mapInArrow(_books, "path string, content binary")
    got = workbooks.typed_rows(workbooks.workbook_rows(files, [ORDERS]), ORDERS, "id", "parent")
    return got.select("path", "row", "id", "priority", F.array_join(F.array_sort("reasons"), "|").alias("reasons"))
