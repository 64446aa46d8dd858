"""Held threads as a stream, also after a restart, against the table as a whole."""

import json

from corpusloom.streaming import threads


def write(folder, name, rows):
    folder.mkdir(exist_ok=True)
    (folder / name).write_text("".join(json.dumps(r) + "\n" for r in rows))


def item(thread, k, stated, kind="reply"):
    return {"thread_id": thread, "comment_id": f"{thread}.{k}", "source_type": kind if k else "comment", "author": "x", "raw_text": f"text {k}", "published_at": "2024-01-01T00:00:00Z", "n_replies_stated": stated}


def run(spark, folder, out, checkpoint, files=1, hold="1 hour"):
    stream = spark.readStream.schema(threads.ITEMS).option("maxFilesPerTrigger", files).json(str(folder))
    threads.hand_on(stream, str(out), str(checkpoint), hold)
    return sorted((r.thread_id, r.comment_id, r.complete) for r in spark.read.parquet(str(out)).collect())


def test_hold_flush_and_restart(spark, tmp_path):
    pages, out, state = tmp_path / "pages", tmp_path / "out", tmp_path / "state"
    write(pages, "1.json", [item("a", 0, 3), item("a", 1, 3), item("b", 0, 0), {"thread_id": None, "comment_id": "x"}])
    assert run(spark, pages, out, state) == [("b", "b.0", True)]  # a waits
    write(pages, "2.json", [item("a", 1, 3), item("a", 2, 3), item("b", 0, 0), item("a", 3, 3), item("c", 0, 2), item("c", 1, 2)])
    got = run(spark, pages, out, state, hold="0 seconds")  # another run goes on with what was held; repeats are not handed on
    assert [g for g in got if g[0] in "ab"] == [("a", f"a.{k}", True) for k in range(4)] + [("b", "b.0", True)]
    write(pages, "3.json", [item("d", 0, 0)])  # c has waited for longer than its hold
    got = run(spark, pages, out, state)
    assert [g for g in got if g[0] in "cd"] == [("c", "c.0", False), ("c", "c.1", False), ("d", "d.0", True)]
    write(pages, "4.json", [item("c", 2, 2), item("d", 0, 0)])  # late, but now the thread is complete
    got = run(spark, pages, out, state)
    assert [g for g in got if g[0] in "cd"] == [("c", "c.0", False), ("c", "c.1", False), ("c", "c.2", True), ("d", "d.0", True)]


def test_stream_equals_batch(spark, tmp_path):
    rows = [item(f"t{t}", k, 4 if t % 3 else 5) for t in range(20) for k in range(5)]
    for n in range(5):
        write(tmp_path / "pages", f"{n}.json", rows[n::5])
    table = spark.read.schema(threads.ITEMS).json(str(tmp_path / "pages"))
    want = sorted((r.thread_id, r.comment_id, r.complete) for r in threads.batch_threads(table).where("complete").collect())
    assert run(spark, tmp_path / "pages", tmp_path / "out", tmp_path / "state", 2) == want and len(want) == 5 * 13
