"""What several runs or a careless export could break: shared budgets, secrets, temporary names."""

import threading
from collections import Counter

import pytest
from pyspark.sql import functions as F

from corpusloom.operators import analysis, assembly, outcomes, reference
from corpusloom.session import free_names, ranked
from corpusloom.sources import privacy, readers, writers
from corpusloom.streaming import ledger


def at_once(n, call):
    """Results of ``n`` threads that start together."""
    gate, out = threading.Barrier(n), [None] * n

    def one(i):
        gate.wait()
        out[i] = call(i)

    threads = [threading.Thread(target=one, args=(i,)) for i in range(n)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    return out


def test_of_two_runs_one_is_refused(spark, tmp_path):
    root = str(tmp_path)
    got = at_once(2, lambda i: ledger.reserve(spark, root, "2024-05-01", "documents", 100, 60, f"run{i}"))
    assert sorted(x is None for x in got) == [False, True]
    assert ledger.reserve(spark, root, "2024-05-02", "documents", 100, 60, "run0") and ledger.reserve(spark, root, "2024-05-01", "requests", 100, 60, "run0")


def test_many_runs_share_a_budget(spark, tmp_path):
    root, day = str(tmp_path), "2024-05-01"
    got = at_once(6, lambda i: ledger.reserve(spark, root, day, "documents", 35, 10, f"run{i}"))
    assert sum(x is not None for x in got) == 3
    first, second, _ = [x for x in got if x]
    assert ledger.settle(spark, root, day, first, None) and not ledger.settle(spark, root, day, first, 4)
    assert ledger.settle(spark, root, day, second, 4) and not ledger.settle(spark, root, day, "nobody", 4)
    held = {r.reservation_id: (r.amount, r.state) for r in ledger.balances(ledger.events(spark, root, day)).collect()}
    assert held[first] == (0, "released") and held[second] == (4, "spent") and sum(a for a, _ in held.values()) == 14
    assert ledger.reserve(spark, root, day, "documents", 35, 21, "late") and ledger.reserve(spark, root, day, "documents", 35, 1, "later") is None
    assert ledger.versions(spark, root, day) == list(range(1, 7)) and not [p for p in (tmp_path / f"day={day}").iterdir() if p.name.startswith(".")]


def test_a_version_is_committed_once(spark, tmp_path):
    event = {"reservation_id": "a", "owner": "o", "kind": "k", "event": "reserved", "amount": 1, "at": 0.0}
    got = at_once(8, lambda i: ledger.commit(spark, str(tmp_path), "2024-05-01", 1, [event]))
    assert got.count(True) == 1 and ledger.events(spark, str(tmp_path), "2024-05-01").count() == 1
    with pytest.raises(ValueError):
        ledger.versions(spark, str(tmp_path), "../other")


NESTED = "id int, meta struct<author_name:string,who:struct<mail:string>>, list array<array<string>>, props map<string,struct<v:string>>, free variant, n array<int>"


def nested(spark):
    rows = [(1, (None, ("a@b.org",)), [["x", "call 555-123-4567"], None], {"prompt": ("x",), "k": ("sk-ant-9",)}, '{"a":[{"api_key":1,"t":"AIzaX"},"b@c.de"]}', [1]), (2, None, None, None, None, None), (3, ("n", None), [], {}, '"plain"', [])]
    df = spark.createDataFrame(rows, NESTED.replace("variant", "string"))
    return df.withColumn("free", F.parse_json("free")).select(*[c.strip().split(" ")[0] for c in "id, meta, list, props, free, n".split(",")])


def test_findings_at_any_depth(spark):
    got = {r.id: {tuple(x) for x in r.f} for r in nested(spark).select("id", privacy.findings(nested(spark), denied=("plain",)).alias("f")).collect()}
    assert got[1] == {("$.meta.author_name", "forbidden_key"), ("$.meta.who.mail", "email"), ("$.list[0][1]", "phone"), ("$.props.prompt", "forbidden_key"), ("$.props.k.v", "sk-ant-"),
                      ("$.free.a[0].api_key", "forbidden_key"), ("$.free.a[0].t", "AIza"), ("$.free.a[1]", "email")}
    assert got[2] == set() and got[3] == {("$.meta.author_name", "forbidden_key"), ("$.free", "denied")}
    deep = spark.createDataFrame([('{"a":' * 6 + '"x@y.org"' + "}" * 6,), ('{"a":{"a":{"a":1}}}',)], "s string").select(F.parse_json("s").alias("v"))
    assert [[tuple(x) for x in r.f] for r in deep.select(privacy.findings(deep, depth=3).alias("f")).collect()] == [[("$.v.a.a.a", "too_deep")], []]
    assert privacy.findings(spark.range(1)) is not None and privacy.leak_findings(spark.range(3)).count() == 0


def test_guarded_writes_nothing(spark, tmp_path):
    df = spark.createDataFrame([(1, "fine"), (2, "the key is S3CRET!")], "id int, response string")
    with pytest.raises(Exception, match=r"\$.response denied"):
        writers.write_cache(df, str(tmp_path / "cache"), denied=("S3CRET!",))
    assert not list((tmp_path / "cache").glob("*.parquet")) if (tmp_path / "cache").exists() else True
    writers.write_cache(df.where("id = 1"), str(tmp_path / "cache"), denied=("S3CRET!", ""))
    assert spark.read.parquet(str(tmp_path / "cache")).count() == 1


def test_stripped(spark):
    df = nested(spark).drop("free").withColumn("Token", F.lit("t")).withColumn("deep", F.array(F.struct(F.lit(1).alias("password"), F.struct(F.lit(2).alias("SECRET"), F.lit(3).alias("kept")).alias("in"))))
    df = df.withColumn("props", F.map_concat(F.coalesce("props", F.create_map().cast("map<string,struct<v:string>>")), F.create_map(F.lit("Api_Key"), F.struct(F.lit("x").alias("v")))))
    got = privacy.stripped(df)
    assert got.schema["deep"].dataType.simpleString() == "array<struct<in:struct<kept:int>>>" and "Token" not in got.columns
    assert [sorted(r.props) for r in got.orderBy("id").collect()] == [["k", "prompt"], [], []]
    with pytest.raises(ValueError):
        privacy.stripped(nested(spark))


def test_names_that_clash(spark):
    """Columns named like the temporary ones pass through, and decide nothing."""
    names = ["_times", "_place", "_here", "_source", "_named", "_had", "_above", "_clean", "_k0", "_part", "_count", "_before", "_p", "_g0"]
    df = spark.createDataFrame([(i % 3 if i < 4 else i, i, f"t{i}") for i in range(6)], "id int, o int, text string").withColumns({n: F.lit(n) for n in names})
    one = df.dropDuplicates(["id"])
    same = lambda r: all(r[n] == n for n in names)
    outs = [
        readers.unique(one, "id"),
        readers.checked_rows(one.withColumn("up", F.lit(None).cast("int")), "id", "up"),
        assembly.first_wins(df, "id", ["o"]),
        assembly.required(one, one.select("id"), "id"),
        outcomes.union_first(df, df, key="id", order="o"),
        ranked(df, ["id"], [F.col("o")]),
    ]
    for out in outs:
        rows = out.collect()
        assert rows and all(map(same, rows)) and set(names) <= set(out.columns)
    assert free_names(df, "_Times", "_new") == ["__Times", "_new"]
    docs = df.selectExpr("*", "text as source_url_key", "text as raw_text_sha256")
    assert all(map(same, reference.import_new(docs, docs.select("source_url_key", "raw_text_sha256")).collect()))


def test_rows_without_key_or_parent_are_dealt_over_all_tasks(spark):
    """Half the rows of a sheet may have no parent; a shuffled join must not bring them to one task."""
    df = spark.range(8000).select(F.when(F.col("id") % 3 != 0, F.col("id")).alias("k"), F.when(F.col("id") % 4 == 0, F.col("id") + 1).alias("up"), F.col("id").alias("row"))
    plain = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.enabled": "false", "spark.sql.shuffle.partitions": "8"}
    before = {k: spark.conf.get(k) for k in plain}
    try:
        for k, v in plain.items():
            spark.conf.set(k, v)
        got = readers.checked_rows(df, "k", "up").withColumn("part", F.spark_partition_id()).collect()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert len(got) == 8000 and max(Counter(r.part for r in got).values()) < 2000
    clean = {i for i in range(8000) if i % 3}
    assert all(r.reasons == ([] if r.row in clean else ["missing_id"]) + (["orphan_parent"] if r.up is not None and r.up not in clean else []) for r in got)
