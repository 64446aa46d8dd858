import json
import re
import zipfile

import duckdb
import pytest
from pyspark.sql import functions as F

from corpusloom.plans import registry, views
from corpusloom.sources import posts, readers, writers
from corpusloom.streaming import incremental


def test_json_lines(spark, tmp_path):
    p = tmp_path / "a.jsonl"
    p.write_text('{"doc_id": "b", "n": 1}\n{"n": 2}\n{"doc_id": "a", "n": 3}\n')
    df = readers.json_lines(spark, [str(p), str(tmp_path / "missing.jsonl")], "doc_id string, n int", "doc_id")
    assert sorted(tuple(r) for r in df.collect()) == [("a", 3), ("b", 1)]
    assert readers.json_lines(spark, str(tmp_path / "none"), "doc_id string").count() == 0
    assert readers.unique(df, "doc_id").count() == 2
    with pytest.raises(Exception, match="repeated id"):
        readers.unique(df.union(df), "doc_id").collect()
    writers.write_json_lines(df, str(tmp_path / "out"), "doc_id")
    assert [json.loads(r.value) for r in spark.read.text(str(tmp_path / "out")).collect()] == [{"doc_id": "a", "n": 3}, {"doc_id": "b", "n": 1}]


def test_csv_and_urls(spark, tmp_path):
    p = tmp_path / "a.csv"
    p.write_text('a,b\n1,"x, ""y"""\n')
    assert tuple(readers.csv_exact(spark, str(p), ["a", "b"]).first()) == ("1", 'x, "y"')
    with pytest.raises(ValueError, match="header"):
        readers.csv_exact(spark, str(p), ["a"])
    q = tmp_path / "urls.txt"
    q.write_text("# list\nhttp://b\n\nhttp://a\nhttp://b\n")
    assert [tuple(r) for r in readers.url_list(spark, str(q)).orderBy("line").collect()] == [(2, "http://b"), (4, "http://a")]


def body(spark, *texts):
    return spark.createDataFrame([(t,) for t in texts], "body string")


def test_listing(spark):
    child = lambda **d: {"kind": d.pop("kind", "t3"), "data": d}
    one = {"data": {"children": [child(id="1", title="T", selftext="Body", author="u", created_utc=1.0), child(id="2", title="Gone", selftext="[removed]", author="[deleted]"), child(id="3", title="[deleted]", selftext="")]}}
    two = {"data": {"children": [child(kind="t1", id="4", body="A reply", link_id="t3_1", author="v"), child(kind="more", id="5")]}}
    got = {r.id: r for r in readers.listing_documents(body(spark, json.dumps([one, two]), json.dumps(one).replace('"1"', '"9"'), "not json")).collect()}
    assert {k: r.raw_text for k, r in got.items() if k in "124"} == {"1": "T\n\nBody", "2": "Gone", "4": "A reply"} and "3" not in got and "5" not in got
    assert got["2"].author is None and got["4"].parent_thread_id == "1" and got["9"].raw_text == "T\n\nBody"


def test_threads_and_reviews(spark):
    snip = lambda t, at="2024-01-02T03:04:05Z": {"textOriginal": t, "authorDisplayName": "n", "authorChannelId": {"value": " "}, "publishedAt": at}
    page = {"items": [{"id": "t", "snippet": {"videoId": "v", "totalReplyCount": 2, "topLevelComment": {"id": "t", "snippet": snip("top")}}, "replies": {"comments": [{"id": "t.1", "snippet": snip("re", "2024-01-02T03:04:05")}]}}]}
    df = readers.thread_comments(body(spark, json.dumps(page)))
    rows = df.orderBy("comment_id").collect()
    assert [(r.source_type, r.raw_text, r.author) for r in rows] == [("comment", "top", "n"), ("reply", "re", "n")]
    assert rows[0].published_at is not None and rows[1].published_at is None  # a time without zone is unknown
    assert tuple(readers.thread_completeness(df).first()) == ("t", 1, 2, False)
    entry = {"id": {"label": "r1"}, "title": {"label": "Good"}, "content": {"label": "App"}, "im:rating": {"label": "5"}, "author": {"name": {"label": "z"}}, "updated": {"label": "2024-01-02T00:00:00Z"}}
    feeds = body(spark, json.dumps({"feed": {"entry": [entry, {"id": {"label": "app"}}]}}), json.dumps({"feed": {"entry": entry | {"im:rating": {"label": "9"}}}}))
    assert [(r.review_id, r.raw_text, r.rating) for r in readers.store_reviews(feeds).orderBy("rating").collect()] == [("r1", "Good\n\nApp", None), ("r1", "Good\n\nApp", 5.0)]
    inner = json.dumps([[["id1", ["Ann"], 4, None, "Nice"]], [None, "tok"]])
    framed = ")]}'\n\n123\n" + json.dumps([["wrb.fr", "x", inner]]) + "\n"
    assert tuple(readers.framed_reviews(body(spark, framed, "junk")).first()) == ("id1", "Ann", 4, "Nice", "tok")


def test_workbook(spark, tmp_path):
    p = tmp_path / "b.xlsx"
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    with zipfile.ZipFile(p, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook {ns} xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets><sheet name="Docs" sheetId="1" r:id="rId1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Target="worksheets/sheet1.xml"/></Relationships>')
        z.writestr("xl/sharedStrings.xml", f"<sst {ns}><si><t>id</t></si><si><t>text</t></si><si><r><t>two </t></r><r><t>runs</t></r></si></sst>")
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet {ns}><sheetData><row><c r="A1" t="s"><v>0</v></c><c r="C1" t="s"><v>1</v></c></row><row><c r="A2"><v>7</v></c><c r="C2" t="s"><v>2</v></c></row><row/><row><c r="C4" t="inlineStr"><is><t>x</t></is></c></row></sheetData></worksheet>')
    spark.dataSource.register(readers.WorkbookSource)
    df = spark.read.format("workbook").option("sheet", "Docs").schema("id string, text string").load(str(p))
    assert [tuple(r) for r in df.collect()] == [("7", "two runs"), (None, "x")]


def test_cells_and_rows(spark):
    df = spark.createDataFrame([("a", None, "YT", "2024-01-02", "4"), ("b", "a", "other", "x", "9"), ("c", "zz", "web", "02/01/2024", "n"), ("d", None, "", None, None), ("d", None, "", None, None), ("e", "d", "", None, None)], "id string, parent string, p string, at string, r string")
    got = {r.id: r for r in readers.checked_rows(df, "id", "parent").collect()}
    assert {k: r.reasons for k, r in got.items()} == {"a": [], "b": [], "c": ["orphan_parent"], "d": ["duplicate_id"], "e": ["parent_rejected"]}
    c = df.select(readers.enum_cell(F.col("p"), ["youtube", "web"], {"yt": "youtube"}), readers.date_cell(F.col("at")).cast("string"), readers.rating_cell(F.col("r"))).collect()
    assert [tuple(x) for x in c[:3]] == [("youtube", "2024-01-02 00:00:00", 4.0), (None, None, None), ("web", "2024-01-02 00:00:00", None)]


def test_snapshots(spark, tmp_path):
    root = str(tmp_path / "snap")
    a = spark.createDataFrame([(1, "x"), (2, "y")], "k int, v string")
    v, changed = writers.publish_snapshot(a, root, "k")
    assert changed and writers.publish_snapshot(a.orderBy(F.desc("k")), root, "k") == (v, False)
    w, changed = writers.publish_snapshot(a.limit(1), root, "k")
    assert changed and w != v and writers.load_snapshot(spark, root, "k int, v string").count() == 1
    assert json.loads(writers.manifest({"a": (a, "k")}))["a"]["rows"] == 2
    assert writers.strip_columns(a.withColumn("api_token", F.lit(1))).columns == ["k", "v"]
    leaky = spark.createDataFrame([("mail a@b.example",), ("password: hunter2",), ("fine",)], "note string")
    assert sorted(tuple(r) for r in writers.leaking_rows(leaky).collect()) == [("note", "email", 1), ("note", "secret", 1)]


def test_stream_resumes_and_repeats_nothing(spark, tmp_path):
    src, target, check = (str(tmp_path / x) for x in ("in", "out", "check"))
    keys = ["p", "i", "h"]
    put = lambda rows: spark.createDataFrame(rows, "p string, i int, h string").write.mode("append").parquet(src)
    go = lambda: incremental.run_available(spark.readStream.schema("p string, i int, h string").parquet(src), check, incremental.append_unseen(target, keys))
    put([("a", 1, "x"), ("a", 1, "x"), ("a", 2, "x")])
    go()
    put([("a", 2, "x"), ("b", 2, "x")])
    go()
    go()
    assert sorted(tuple(r) for r in spark.read.parquet(target).collect()) == [("a", 1, "x"), ("a", 2, "x"), ("b", 2, "x")]


def test_budget(spark):
    led = spark.createDataFrame([("d1", "calls", 60, "held"), ("d1", "calls", 30, "released"), ("d2", "calls", 99, "held")], "day string, kind string, amount int, state string")
    assert tuple(incremental.reserve(led, "d1", "calls", 100, 40).first()) == (60, 40, True)
    assert incremental.reserve(led, "d1", "calls", 100, 41).first().granted is False


def test_views(spark):
    spark.sql("select 't' target_id, 's' stage, 'failed' status, 1 attempt, timestamp'2024-01-01' occurred_at, 'e1' event_id union all select 't', 's', 'succeeded', 2, timestamp'2024-01-01', 'e2'").createOrReplaceTempView("stage_events")
    spark.sql("select 'l' link_id, 'b' doc_id, 'a' canonical_doc_id, 'auto_confirmed' review_state union all select 'm', 'c', 'a', 'pending_review'").createOrReplaceTempView("duplicate_links")
    spark.sql("select * from values ('a', 'p', 'direct_user'), ('b', 'p', 'direct_user'), ('c', 'q', 'direct_user') as t(doc_id, source_platform, evidence_tier)").createOrReplaceTempView("documents_collected")
    spark.sql("select * from values ('k', 'a', 'core', 'model', 'valid', 1, 'f'), ('k', 'a', 'core', 'human', 'valid', 0, 'g'), ('m', 'c', 'adjacent', 'model', 'invalid', 1, 'f') as t(case_id, doc_id, scope_class, extractor_type, validation_state, extracted_at, extraction_fingerprint)").createOrReplaceTempView("retrieval_cases")
    spark.sql("select * from values ('a', 'd1', 'model', 1, 'ok'), ('a', 'd2', 'human', 0, 'failed') as t(doc_id, decision_id, decided_by, decided_at, technical_state)").createOrReplaceTempView("relevance_decisions")
    spark.sql("select 'k' case_id, 'c1' cluster_id, 0.5 confidence").createOrReplaceTempView("cluster_assignments")
    assert set(views.create_views(spark)) == set(views.VIEWS)
    rows = lambda v: [tuple(r) for r in spark.sql(f"select * from {v}").collect()]
    assert rows("v_stage_status") == [("t", "s", "succeeded")]
    assert sorted(r[0] for r in rows("v_canonical_documents")) == ["a", "c"]  # pending links collapse nothing
    assert rows("v_current_relevance")[0][1] == "d2" and len(rows("v_relevance_unavailable")) == 1
    assert [r[3] for r in rows("v_valid_cases")] == ["human"] and len(rows("v_prevalence_core_direct")) == 1
    assert rows("v_case_clusters") == [("k", "c1", rows("v_case_clusters")[0][2])]


def test_leak_scan_reports_every_kind(spark, tmp_path):
    texts = ["mail a@b.example", "call +1 555-123-4567 now", "(555) 123-4567", "9555 123 45678", "1555-123-4567", "5551234567", "API_key = x1", "password:\thunter2 a.b@c.org", "tokens: 3", "token=", None, "", "fine", "555\x0b123\x0b4567 secret: s"]
    spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    brute = {"email": r"[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,}", "phone": r"(?<!\d)(?:\+\d{1,3}[\s.\-]?)?(?:\(\d{3}\)|\d{3})[\s.\-]\d{3}[\s.\-]\d{4}(?!\d)", "secret": r"(?i)\b(?:api[_-]?key|secret|password|token)\s*[=:]\s*\S+"}
    want = {k: sum(bool(re.search(p, t or "", re.A)) for t in texts) for k, p in brute.items()}
    assert min(want.values()) >= 2
    got = registry.QUERIES["leak_scan_kinds"](spark, str(tmp_path)).collect()
    assert sorted((r.column, r.kind, r.n) for r in got) == sorted(("text", k, n) for k, n in want.items())
    sql = registry.SQL["leak_scan_kinds"].replace("FROM documents", f"FROM '{tmp_path}/documents.parquet/*.parquet'")
    assert sorted(duckdb.sql(sql).fetchall()) == sorted(("text", k, n) for k, n in want.items())


def test_review_frame_is_found_anywhere(spark):
    inner = lambda i: json.dumps([[[i, ["Ann"], 4, None, "Nice"], [i + "b", ["Bo"], 5, None, "Good"]], [None, "tok"]])
    other, mine = ["wrb.fr", "zzz", "[[]]"], lambda i: ["wrb.fr", "oCPfdb", inner(i)]
    answers = [")]}'\n\n9\n" + json.dumps([other, mine("a")]), json.dumps([["di", 5], other]) + "\r\n77\r\n" + json.dumps([["e", 1], mine("c")]) + "\n", json.dumps([mine("x"), mine("y")]), json.dumps([other, other]), "junk"]
    df = body(spark, *answers)
    assert sorted(r.review_id for r in readers.framed_reviews(df).collect()) == ["a", "ab", "c", "cb"]
    assert sorted(r.body for r in readers.framed_refusals(df).collect()) == sorted(answers[2:])


def test_original_post(spark):
    ld = lambda d: f'<script type="application/ld+json">{d if isinstance(d, str) else json.dumps(d)}</script>'
    whole = "First paragraph.\n\nSecond one.\n\nThird \U0001f600."
    main = {"@type": "Question", "name": "T", "text": whole, "author": {"name": "Ann"}, "datePublished": "2024-01-02T03:04:05Z", "url": "https://support.google.com/photos/thread/7/x"}
    page = {"@type": ["QAPage"], "mainEntity": main}
    shown = "<h1>H</h1><p>First paragraph.</p><p>Second one.</p>"
    view = [None, [["7", 1700000000123456], 0, 0, 0, 0, 0, "u", 0, "V", 0, 0, 0, whole, 0], None, [["Zoe"], 0, "u"]]

    def thread(v, item=7):
        literal = json.dumps(v).replace("\\", "\\\\").replace("'", "\\'").replace('"', "\\x22")
        return f"<html data-page-type='SUPPORT_FORUM_THREAD'><link rel='canonical' href='https://support.google.com/photos/thread/{item}'><script>var thread_view = '{literal}';</script>{shown}"

    cases = [
        (ld({"headline": "no"}) + ld([{"@graph": [page]}]) + shown, ("T", whole, "Ann", "2024-01-02T03:04:05Z", "QAPage.mainEntity.text", None)),
        (thread(view), ("V", whole, "Zoe", "2023-11-14T22:13:20.123Z", "thread_view[1][12]", None)),
        (thread(view, 8), (None,) * 5 + ("thread_identity_mismatch",)),
        (ld(page).replace("thread/7", "thread/9"), (None,) * 5 + ("thread_identity_mismatch",)),
        (ld(page) + ld(page), (None,) * 5 + ("ambiguous_original_post",)),
        (thread(view) + thread(view), (None,) * 5 + ("ambiguous_original_post",)),
        (thread([1, [["7", 2]]]), (None,) * 5 + ("unsupported_thread_bootstrap",)),
        (ld("{broken") + ld({"articleBody": "A", "headline": "B"}) + shown, (None,) * 5 + ("no_verified_plain_original_post",)),
        (ld(page | {"mainEntity": main | {"text": "<b>x</b>"}}), (None,) * 5 + ("no_verified_plain_original_post",)),
        (None, (None,) * 5 + ("no_verified_plain_original_post",)),
    ]
    df = spark.createDataFrame([(i, h, "7") for i, (h, _) in enumerate(cases)], "id int, html string, item string")
    got = readers.original_post(df, item="item").orderBy("id").collect()
    assert [tuple(r)[3:] for r in got] == [w for _, w in cases]
    assert [r.body_text for r in readers.original_post(df).orderBy("id").limit(4).collect()] == [whole, whole, None, whole]


def test_post_times_are_exact_beyond_doubles(spark):
    """2 ** 53 microseconds end in the year 2255; the queries' pages state later ones from page 84,569 on."""
    cases = {"1700000000123456": "2023-11-14T22:13:20.123Z", "9007199254740993": "2255-06-05T23:47:34.740Z", "68000000000000999": "4124-11-01T00:53:20.000Z", "99999999999999999": "5138-11-16T09:46:39.999Z", "123": None, "123456789012345678": None, "1.7e15": None}
    df = spark.createDataFrame(list(cases.items()), "micros string, want string")
    got = df.select("micros", posts._moment(F.col("micros")).alias("at")).collect()
    assert {r.micros: r.at for r in got} == cases
