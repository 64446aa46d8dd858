"""Assembly in one exchange, and posts of pages that are not as they should be."""

import json
import re

import pytest

from corpusloom.operators import dataset
from corpusloom.sources import posts

SF = "/root/testdata/sf0.001"


def relations(spark):
    from corpusloom.plans import datasets

    return datasets._relations(lambda name: spark.read.parquet(f"{SF}/{name}.parquet"))


def test_one_exchange_by_document(spark):
    rows = dataset.assembled(relations(spark))
    plan = dataset.cards(rows, "d", "r")._jdf.queryExecution().executedPlan().toString()
    assert re.findall(r"Exchange (\w+)\(([^,]*?)#?\d*[,)]", plan) == [("hashpartitioning", "doc_id")]
    assert len(re.findall(r"\bWindow \[|\bWindow\(|\+- Window", plan)) == 1 and "Join" not in plan and "ArrowEval" not in plan


def test_policies_and_gaps(spark):
    docs = spark.createDataFrame([("a", True, False), ("b", False, False), ("c", True, True), (None, True, False)], "doc_id string, development boolean, holdout boolean")
    columns = [c for c in dataset._split(dataset.RELATIONS["documents"]) if c.split(" ")[0] not in docs.columns]
    docs = docs.selectExpr("*", *[f"cast(null as string) as {c.split(' ')[0]}" for c in columns])
    inputs = spark.createDataFrame([("a", "ok", "core"), ("a", "failed", None), ("x", "ok", "core"), (None, "ok", "core"), ("c", "ok", "core")], "doc_id string, technical_state string, scope_class string")
    used = lambda policy: {r.doc_id for r in dataset.assembled({"documents": docs}, policy).where("used").collect()}
    assert (used("development_only"), used("outside_frozen_split"), used("all")) == ({"a"}, {"b"}, {"a", "b"})
    rows = dataset.assembled({"documents": docs, "inputs": inputs})
    got = sorted((r.doc_id, r.card, r.kind, r.excerpt, r.review_status) for r in dataset.cards(rows, "d", "r").collect())
    assert got == [("a", "attempt", "empty_response", "", "unverified"), ("a", "attempt", "failed", "", "unverified")]
    counts = dataset.dataset_counts(rows).first().asDict()
    assert (counts["documents"], counts["withheld_documents"], counts["outside_policy_documents"], counts["extraction_attempts"], counts["analysis_documents"]) == (1, 1, 1, 2, 1)
    empty = dataset.dataset_counts(dataset.assembled({"documents": docs.limit(0)})).first()
    assert set(empty) == {0}
    with pytest.raises(ValueError):
        dataset.tagged({"inputs": inputs})


def test_js_string(spark):
    cases = [("a\\'b", "a'b"), ('say "x"', 'say "x"'), ('\\"q\\"', '"q"'), ("\\x41\\u0042\\n", "AB\n"), ("\\\\x41", "\\x41"), ("\\\\\\x41", "\\A"), ("\\\\\\'", "\\'"), ("\\q", None), ("tab\there", "tab\there"), ("", ""), ("\\\\", "\\"), ("\\ud83d\\ude00", "\U0001f600"), ("x" * 200_000, "x" * 200_000)]
    df = spark.createDataFrame(cases, "a string, want string")
    assert [r[0] for r in df.select(posts.js_string(df.a)).collect()] == [w for _, w in cases]


def test_deep_and_odd_pages(spark):
    page = {"@type": "QAPage", "mainEntity": {"text": "Whole text.", "name": 5, "author": "none", "dateCreated": ""}}
    ld = lambda x: f'<script type="application/ld+json">{json.dumps(x)}</script>'
    deep = page
    for _ in range(3):
        deep = [{"@graph": [deep]}]
    pages = [ld(deep), ld(page | {"mainEntity": []}), ld(page | {"mainEntity": None}), ld([page, page]), "<script>var thread_view = '\\q';</script>", "<script src=x>var thread_view = '[]';</script>", "", None, "<script>var thread_view = '" + "x\\'" * 20_000 + "';</script>"]
    df = spark.createDataFrame(list(enumerate(pages)), "title int, html string")
    got = posts.original_post(df.withColumnRenamed("title", "id")).orderBy("id").collect()
    assert [(r.body_text, r.title, r.author_name, r.published_at) for r in got][:1] == [("Whole text.", None, None, None)]
    assert [r.failure for r in got] == [None, posts.NO_POST, posts.NO_POST, posts.AMBIGUOUS, posts.UNSUPPORTED, posts.NO_POST, posts.NO_POST, posts.NO_POST, posts.UNSUPPORTED]
