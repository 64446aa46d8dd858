"""Coverage that must hold, and ledgers that must be whole."""

import pytest

from corpusloom.operators import saved_run as M


def ids(spark, *xs, name="a"):
    return spark.createDataFrame([(x, "v") for x in xs], f"k string, {name} string")


def test_coverage_is_proved_while_reading(spark):
    assert sorted(r.k for r in M.covered(ids(spark, "x", "y"), ids(spark, "y", "x", name="b"), "k").collect()) == ["x", "y"]
    for wanted, saved, said in ((("x", "y"), ("x",), "missing in the saved run: y"), (("x",), ("x", "z"), "surplus in the saved run: z"), (("x",), ("x", "x"), "twice: x"), (("x", "x"), ("x",), "twice: x"), (("x", None), ("x",), "a null id"), (("x",), ("x", None), "a null id")):
        with pytest.raises(Exception, match=said):
            M.covered(ids(spark, *wanted), ids(spark, *saved, name="b"), "k").write.format("noop").mode("overwrite").save()
    assert M.covered(ids(spark).limit(0), ids(spark, name="b").limit(0), "k").count() == 0
    clash = ids(spark, "x", name="_here")
    assert M.covered(clash, ids(spark, "x", name="_times"), "k").columns == ["k", "_here", "_times"]


def test_scoped_rows(spark):
    dealt = spark.createDataFrame([("a", "dev"), ("b", "dev"), ("c", "holdout")], "doc_id string, split string")
    sheet = spark.createDataFrame([("a", "core", "r"), ("b", "core", "r"), ("c", "core", "r"), ("d", "core", "r")], "doc_id string, scope string, reason string")
    said = lambda *rows: spark.createDataFrame(rows, "doc_id string, state string, scope string, reason string")
    got = sorted(map(tuple, M.scoped_rows(dealt, sheet, said(("a", "ok", "core", "q"), ("b", "failed", "core", "r"), ("c", "ok", "core", "r")), "dev").collect()))
    assert got == [("a", "core", "core", "r", "q"), ("b", "core", None, "r", None)]
    with pytest.raises(Exception, match="unknown document: zz"):
        M.scoped_rows(dealt, sheet, said(("zz", "ok", "core", "r")), "dev").collect()
    with pytest.raises(Exception, match="no label: a"):
        M.scoped_rows(dealt, sheet.where("doc_id <> 'a'"), said(("b", "ok", "core", "r")), "dev").collect()


def test_ledger_has_every_category(spark):
    found = spark.createDataFrame([("scope_boundary_disagreement", "a"), ("scope_boundary_disagreement", "b")], "category string, target string")
    got = [tuple(r) for r in M.ledger(found).orderBy("position").collect()]
    assert got == [(i, c, 2 if c == "scope_boundary_disagreement" else 0) for i, c in enumerate(M.CATEGORIES, 1)]
    with pytest.raises(Exception, match="not a category: odd"):
        M.ledger(found.selectExpr("'odd' as category", "target")).collect()


def test_empty_run_measures_nothing(spark):
    gold = spark.createDataFrame([("a", "core", True)], "doc_id string, scope_class string, should_pass boolean")
    none = lambda s: spark.createDataFrame([], s)
    rows = M.report(gold, none("doc_id string, technical_state string, passed boolean, scope_class string"), none("gold_id string, doc_id string"), none("case_id string, doc_id string"), none("gold_id string, case_id string"), none("valid boolean")).collect()
    got = {r.metric: (r.value, r.passed) for r in rows}
    assert got["documents"] == (1.0, None) and got["precision"] == (None, False) and got["span_validation_rate"] == (None, None) and got["prediction_coverage"] == (0.0, None)
