import pytest
from pyspark.sql import functions as F

from corpusloom.operators import assembly, evidence, outcomes


def test_provenance_and_batch(spark):
    df = spark.createDataFrame([("a", "h", "k", "direct_user"), ("b", "x", "k", "synthetic_test"), ("c", "h", None, "direct_user"), ("d", "h", "k", "direct_user")], "doc_id string, h string, k string, tier string")
    r = assembly.provenance_reasons(F.col("doc_id"), F.col("doc_id"), F.col("h"), F.lit("h"), F.col("k"), F.lit("k"), F.col("tier"))
    d = df.withColumn("reasons", r)
    assert {x.doc_id: x.reasons for x in d.collect()} == {"a": [], "b": ["hash_mismatch", "synthetic"], "c": ["url_key_mismatch"], "d": []}
    assert [x.doc_id for x in assembly.select_batch(d, d.where("doc_id = 'a'"), 5).collect()] == ["d"]


def test_external_spans_and_targets(spark):
    cases = spark.createDataFrame([("c", ["e2", "e1"]), ("d", [])], "case_id string, evidence_ids array<string>")
    spans = spark.createDataFrame([("c", "e1"), ("c", "e9"), ("zz", "e5")], "owner_id string, evidence_id string")
    assert {r.case_id: r.evidence_ids for r in assembly.with_external_spans(cases, spans).collect()} == {"c": ["e2", "e1", "e9"], "d": []}
    reviews = spark.createDataFrame([("i", "case:doc1#c01"), ("j", "other")], "item_id string, target_id string")
    assert [tuple(r) for r in assembly.review_targets(reviews, spark.createDataFrame([("doc1",)], "doc_id string")).collect()] == [("i", "doc1")]


def test_failures_candidates_and_coverage(spark):
    out = spark.sql("select 'd1' doc_id, 'failed' state, 'rate_limited' reason, cast(array() as array<struct<case_id:string,needs_human_review:boolean>>) cases union all select 'd2', 'ok', null, array(named_struct('case_id', 'k1', 'needs_human_review', true), named_struct('case_id', 'k2', 'needs_human_review', false))")
    assert sorted(tuple(r) for r in assembly.failure_rows(out).collect()) == [("case", "k1", "needs_human_review"), ("document", "d1", "rate_limited")]
    old = spark.createDataFrame([("k2",), ("k7",)], "case_id string")
    assert sorted(r.case_id for r in assembly.upsert_candidates(old, out).collect()) == ["k1", "k7"]
    have = spark.createDataFrame([("a", 1)], "doc_id string, v int")
    assert assembly.required(have, have, "doc_id").count() == 1
    with pytest.raises(Exception, match="missing b"):
        assembly.required(have, spark.createDataFrame([("b",)], "doc_id string"), "doc_id").collect()


def test_first_dataset_wins(spark):
    df = spark.createDataFrame([("k", "ds2", 1), ("k", "ds1", 9), ("m", "ds2", 2)], "case_id string, ds string, pos int")
    assert sorted(tuple(r) for r in assembly.first_wins(df, "case_id", ["ds", "pos"]).collect()) == [("k", "ds1", 9), ("m", "ds2", 2)]


def test_error_rows_hide_the_holdout(spark):
    df = spark.createDataFrame([("dev", "a", "b"), ("dev", "a", "a"), ("holdout", "a", "b"), ("dev", None, "a")], "split string, g string, p string")
    assert assembly.error_rows(df, "g", "p").count() == 2


def test_incomplete_gold_ends_the_job(spark):
    df = spark.createDataFrame([(1, "a"), (2, "")], "k int, v string")
    with pytest.raises(Exception, match="2 lacks v"):
        assembly.complete_or_raise(df, ["v"], "k").collect()
    assert assembly.complete_or_raise(df.where("k = 1"), ["v"], "k").count() == 1


def test_rows_that_do_not_pair_end_the_job(spark):
    a = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    b = spark.createDataFrame([(1, "x"), (1, "y"), (2, "z")], "k int, w string")
    with pytest.raises(ValueError, match="k 1 does not pair"):
        outcomes.strict_join(a, b, "k")
    with pytest.raises(ValueError, match="does not pair"):
        outcomes.strict_join(a, b.where("k = 2"), "k")
    assert outcomes.strict_join(a, b.where("w <> 'y'"), "k").count() == 2


def test_spent_and_released_reservations(spark):
    ledger = spark.createDataFrame([("r1", "reserved", 10), ("r2", "reserved", 10), ("r3", "spent", 4), ("r4", "reserved", 7)], "reservation_id string, state string, amount int")
    release = spark.createDataFrame([("r1", 3), ("r2", None), ("r3", 9)], "reservation_id string, spent int")
    assert sorted(tuple(r) for r in outcomes.ledger_after(ledger, release).collect()) == [("r1", "spent", 3), ("r2", "released", 10), ("r3", "spent", 4), ("r4", "reserved", 7)]


def test_gates_end_the_job(spark):
    rows = spark.createDataFrame([("c1", ["e1", "e2"], []), ("c2", ["e3"], ["bad span"])], "case_id string, evidence_ids array<string>, errors array<string>")
    with pytest.raises(Exception, match="c2: bad span"):
        evidence.gate_for_analysis(rows, "case_id", F.col("errors")).collect()
    assert evidence.gate_for_analysis(rows.where("case_id = 'c1'"), "case_id", F.col("errors")).count() == 2
    spans = spark.createDataFrame([("abc", "bc", 1, 3), ("abc", "x", 0, 1)], "text string, quote string, start int, stop int")
    with pytest.raises(Exception, match="not at its place: x"):
        evidence.exact_spans(spans).collect()
