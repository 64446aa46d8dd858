"""Walks over recorded pages, folders of datasets, numbered lines of large files."""

import random

import pytest
from pyspark.sql import functions as F

from corpusloom.sources import datasets, readers, walks

PAGES = "source string, token string, next_token string, body string"


def chain(source, n, end=None):
    return [(source, None if i == 0 else f"t{i}", f"t{i + 1}" if i + 1 < n else end, f"{source}{i}") for i in range(n)]


def test_walks_resume_by_source(spark):
    rows = chain("a", 11) + chain("b", 3) + chain("c", 4, end="lost") + chain("d", 5, end="t2") + chain("e", 1) + [("f", "t7", None, "no first page"), (None, None, None, "x"), ("b", "t1", "t2", "b1")]
    random.Random(1).shuffle(rows)
    pages = spark.createDataFrame(rows, PAGES)
    points, seen = None, []
    for budget in (4, 1, 3, 50, 50):
        got = walks.walk(pages, budget, points)
        seen += [(r.source, r.body) for r in got.orderBy("source", "step").collect()]
        assert got.groupBy("source").agg(F.count("*").alias("n"), F.max("step").alias("s")).where("n > {0} or n <> s + 1".format(budget)).count() == 0
        points = spark.createDataFrame(walks.next_points(got, points).collect(), walks.POINTS)
    at = {r.source: r.at for r in points.collect()}
    # Each page once and in order, but for the cycle of d, which goes on with every walk.
    for s, n in (("a", 11), ("b", 3), ("c", 4), ("e", 1)):
        assert [b for x, b in seen if x == s] == [f"{s}{i}" for i in range(n)], s
    assert [b for x, b in seen if x == "d"][:5] == [f"d{i}" for i in range(5)] and not [b for x, b in seen if x == "f"]
    assert at["a"] is None and at["b"] is None and at["e"] is None and at["c"] == "lost"
    more = spark.createDataFrame([*rows, ("c", "lost", None, "c4")], PAGES)
    assert [r.body for r in walks.walk(more, 9, points).where("source = 'c'").collect()] == ["c4"]  # goes on once the page is there
    with pytest.raises(ValueError):
        walks.walk(pages, 0)


def test_one_dataset_prunes_the_scan(spark, tmp_path):
    root = str(tmp_path)
    df = spark.createDataFrame([(i, f"d {i % 3}/x") for i in range(90)], "k int, dataset_id string")
    index = df.select("dataset_id").distinct().where("dataset_id <> 'd 2/x'").withColumns({"run_id": F.lit("r"), "description": F.lit("")})
    datasets.export_datasets({"cases": df}, index, root)
    one = datasets.load_dataset(spark, root, "cases", "d 1/x")
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(dataset_id" in plan and "d 1/x" in plan.split("PartitionFilters")[1].split("]")[0]
    assert sorted(r.k for r in one.collect()) == list(range(1, 90, 3))
    assert {r.dataset_id for r in datasets.load_dataset(spark, root, "cases").collect()} == {"d 0/x", "d 1/x"}  # what the index doesn't name is not read
    assert {(r.dataset_id, r.listed) for r in datasets.discovered(spark, root, "cases").collect()} == {("d 0/x", True), ("d 1/x", True), ("d 2/x", False)}


def test_lines_of_many_splits(spark, tmp_path):
    lines = [f"https://s.example/{i % 20_000}" if i % 7 else ("# note" if i % 2 else "") for i in range(60_000)]
    (tmp_path / "big.txt").write_text("\n".join(lines), newline="")
    (tmp_path / "crlf.txt").write_text("x\r\n\r\ny\r\n", newline="")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "60000")
    try:
        raw = readers.numbered_lines(spark, str(tmp_path / "big.txt"))
        assert raw.rdd.getNumPartitions() > 8 or spark.read.text(str(tmp_path / "big.txt")).rdd.getNumPartitions() > 8
        assert [(r.line, r.value) for r in raw.orderBy("line").collect()] == list(enumerate(lines, 1))
        first = {}
        for i, u in enumerate(lines, 1):
            if u and not u.startswith("#"):
                first.setdefault(u, i)
        assert {r.url: r.line for r in readers.url_list(spark, str(tmp_path / "big.txt"), strict=True).collect()} == first
        lines[41_234] = "not an address"
        (tmp_path / "bad.txt").write_text("\n".join(lines), newline="")
        with pytest.raises(Exception, match="line 41235 is no web address: not an address"):
            readers.url_list(spark, str(tmp_path / "bad.txt"), strict=True).collect()
        assert sorted((r.line, r.url) for r in readers.url_list(spark, str(tmp_path / "crlf.txt")).collect()) == [(1, "x"), (3, "y")]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
