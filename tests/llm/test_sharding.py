import pytest

from corpusloom.llm import sharding as M


def frame(spark, ids, text="some text "):
    return spark.createDataFrame([(i, text * (i % 7 + 1), None, "x") for i in ids], "doc_id long, text string, run string, _arrival string")


def test_tiers_merge_and_nothing_is_lost(spark, tmp_path):
    store = M.ShardStore(spark, str(tmp_path / "s"), target_bytes=1 << 20, fan_in=3, least_bytes=1 << 10)
    want = []
    for k in range(7):
        ids = list(range(k * 50, k * 50 + 40)) + [k]
        store.append(frame(spark, ids).repartition(2))
        want += ids
    before = store.manifest().count()
    v = store.version()
    old = sorted(r.doc_id for r in store.read(v).collect())
    store.compact()
    runs = store.manifest().collect()
    assert len(runs) < before and sum(r.n_rows for r in runs) == len(want)
    assert sorted(r.doc_id for r in store.read().collect()) == sorted(want) == old
    assert sorted(r.doc_id for r in store.read(v).collect()) == sorted(want)  # the old version can still be read
    tiers = [r.tier for r in runs if r.n_bytes < store.target * r.n_shards * 0.5]
    assert all(tiers.count(t) < 3 for t in tiers)
    store.expire()
    assert len(store.versions()) == 1 and store.read().count() == len(want)


def test_commit_is_taken_once(spark, tmp_path):
    store = M.ShardStore(spark, str(tmp_path / "s"))
    store.append(frame(spark, [1, 2]))
    runs = [tuple(r) for r in store._runs(1)]
    assert store._commit(1, runs) == 2
    with pytest.raises(M.Conflict):
        store._commit(1, runs)


def test_rows_come_back_whole(spark, tmp_path):
    rows = [(1, None, "a", "u"), (1, None, "a", "u"), (None, "", "b", "v"), (2, "y" * 300_000, None, "w"), (3, "É \n", "c", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, run string, _arrival string")
    store = M.shard_documents(df, str(tmp_path / "s"), arrivals=3)
    assert sorted(map(tuple, store.read().select(*df.columns).collect()), key=str) == sorted(rows, key=str)
    empty = M.shard_documents(df.limit(0), str(tmp_path / "e"))
    assert empty.read() is None and empty.version() == 1 or empty.read().count() == 0


def test_two_mergers_of_the_same_runs(spark, tmp_path, monkeypatch):
    """The one that is late removes what it wrote; no row is lost or doubled."""
    one, two = (M.ShardStore(spark, str(tmp_path / "s"), target_bytes=1 << 20, fan_in=3, least_bytes=1 << 10) for _ in range(2))
    for k in range(3):
        one.append(frame(spark, range(k * 10, k * 10 + 10)))
    measured, calls = one._measured, []

    def late(paths):
        if not calls:
            calls.append(two.compact())
        return measured(paths)

    monkeypatch.setattr(one, "_measured", late)
    one.compact()
    assert sorted(r.doc_id for r in one.read().collect()) == list(range(30))
    live = {r.run for v in one.versions() for r in one._runs(v)}
    assert {p.name for p in (tmp_path / "s" / "data").iterdir()} <= {r.split("/")[0] for r in live}
