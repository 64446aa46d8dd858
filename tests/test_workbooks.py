"""Workbooks written and read back, with each reason for which a row or a file is refused."""

from pyspark.sql import functions as F

from corpusloom.sources import readers, workbooks as M

DOCS = M.Sheet("documents", ("id", "parent", "platform", "rating", "seen", "text"), ("id", "platform", "text"),
               {"platform": lambda c: readers.enum_cell(c, ["web", "store"], {"shop": "store"}), "rating": readers.rating_cell, "seen": readers.date_cell})
LOG = M.Sheet("search_log", ("session", "kept"), ("session",), {"kept": lambda c: c.try_cast("int")})
HEAD = ["text", "id", "parent", "platform", "rating", "seen"]


def book(rows, log=(("s1", "3"),), head=HEAD, names=("documents", "search_log", "notes")):
    return M.workbook_bytes(dict(zip(names, ([head, *rows], [["session", "kept"], *log], [["x"]]))))


GOOD = ["A & <b> text\nof two lines", "a", None, "web", "4", "2024-05-01"]


def typed(spark, *books):
    files = spark.createDataFrame([(f"f{i}", bytearray(b)) for i, b in enumerate(books)], "path string, content binary")
    rows = M.workbook_rows(files, [DOCS, LOG])
    return rows, M.typed_rows(rows, DOCS, "id", "parent"), M.typed_rows(rows, LOG)


def test_every_reason(spark):
    rows = [GOOD, [], ["t", "b", "a", "shop", None, None], ["t", "c", "zz", "web", None, None], ["t", "d", None, "web", "9", None], ["t", "e", "d", "WEB", None, None], ["t", None, None, "web", None, None],
            ["t", "g", None, "fax", None, "soon"], ["t", "h", None, "web", None, None], ["u", "h", None, "web", None, None], ["t", "i", "h", "web", None, None], [None, "j", None, None, None, None], ["", "", None, "", None, None]]
    raw, docs, log = typed(spark, book(rows, (("s1", "3"), (None, "x"))))
    got = {r.row: (r.id, sorted(r.reasons)) for r in docs.collect()}
    assert got == {
        2: ("a", []), 4: ("b", []), 5: ("c", ["orphan_parent"]), 6: ("d", ["unreadable rating"]), 7: ("e", ["parent_rejected"]), 8: (None, ["missing id"]), 9: ("g", ["unreadable platform", "unreadable seen"]),
        10: ("h", ["duplicate_id"]), 11: ("h", ["duplicate_id"]), 12: ("i", ["parent_rejected"]), 13: ("j", ["missing platform", "missing text"]),
    }
    first = docs.where("row = 2").first()
    assert (first.text, first.platform, first.rating, str(first.seen), first.parent) == (GOOD[0], "web", 4.0, "2024-05-01 00:00:00", None) and docs.where("row = 4").first().platform == "store"
    assert sorted((r.row, r.kept, r.reasons) for r in log.collect()) == [(2, 3, []), (3, None, ["missing session", "unreadable kept"])]
    assert sorted(tuple(r)[1:] for r in M.import_report(raw, {"documents": docs, "search_log": log}).collect()) == [("documents", 11, 2, 9), ("search_log", 2, 1, 1)]


def test_files_with_a_wrong_structure(spark):
    books = [book([GOOD]), b"no workbook", b"", book([GOOD], head=HEAD[:-1] + ["other"]), book([GOOD], names=("documents", "log", "notes")), book([GOOD + ["x"]], head=HEAD + ["id"])]
    raw, docs, log = typed(spark, *books)
    assert [(r.path, r.id) for r in docs.collect()] == [("f0", "a")] and [r.path for r in log.collect()] == ["f0"]
    errors = {}
    for r in M.structure_errors(raw).collect():
        errors.setdefault(r.path, set()).add(r.error)
    assert errors["f3"] == {"documents: missing column seen", "documents: unexpected column other"} and errors["f4"] == {"search_log: missing sheet"} and errors["f5"] == {"documents: repeated column id"}
    assert all("not a readable workbook" in e for f in ("f1", "f2") for e in errors[f])


def test_files_through_spark(spark, tmp_path):
    """From a folder, by Spark's own reader; ids of one file say nothing about another's."""
    for i in range(3):
        (tmp_path / f"{i}.xlsx").write_bytes(book([GOOD, ["t", "b", "a", "web", None, None]]))
    files = M.workbook_files(spark, str(tmp_path))
    docs = M.typed_rows(M.workbook_rows(files, [DOCS, LOG]), DOCS, "id", "parent")
    assert docs.where(F.size("reasons") == 0).count() == 6


def test_workbooks_are_made_one_at_a_time():
    import pyarrow as pa

    from corpusloom.plans import roundtrips

    rows = [{"k": 1, "price": "2.5", "id": "o1", "parent": None, "priority": "high"}]
    batch = pa.record_batch([pa.array([f"f{i}" for i in range(5)]), pa.array([rows] * 5)], names=["path", "rows"])
    made = list(roundtrips._books(iter([batch])))
    assert [(b.num_rows, b.column(0)[0].as_py()) for b in made] == [(1, f"f{i}") for i in range(5)]
    assert made[0].column(1)[0].as_py()[:2] == b"PK"
