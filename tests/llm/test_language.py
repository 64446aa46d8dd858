import random
import zlib

import numpy as np

from corpusloom.llm import language as M

WORDS = {"aa": ["thand", "ther", "ing", "whis", "of"], "bb": ["schön", "eine", "ungen", "heit", "zu"], "cc": ["queux", "était", "oir", "les", "ment"]}


def say(rng, lang, n):
    return " ".join("".join(rng.choice(WORDS[lang]) for _ in range(rng.randint(1, 2))) for _ in range(n))


def table(spark, n=240):
    rng = random.Random(6)
    rows = [(i, say(rng, lang, rng.randint(2, 60)), lang, "s", 0.5) for i in range(n) for lang in [rng.choice(sorted(WORDS))]]
    rows += [(1000, None, "aa", "s", 0.1), (1001, "", "bb", "s", 0.1), (1002, "123 !!", "cc", "s", 0.1), (1003, say(rng, "bb", 20000), None, "s", 0.1), (1004, rows[0][1], None, "s", 0.1), (1004, rows[0][1], None, "s", 0.1), (None, "thand", "aa", "s", 0.1)]
    return rows, spark.createDataFrame(rows, "doc_id long, text string, lang string, lang_pred string, score double")


def test_held_out_accuracy_and_edges(spark):
    rows, df = table(spark)
    got = M.identify(df, M.train(df, per_language=40)).collect()
    assert len(got) == len(rows)
    pred = {r.doc_id: (r.lang_pred, r.score) for r in got}
    held = [r for r in rows if r[0] is not None and r[0] < 1000 and zlib.crc32(str(r[0]).encode()) % 3 == 1]
    assert np.mean([pred[r[0]][0] == r[2] for r in held]) > 0.97
    assert [pred[i] for i in (1000, 1001, 1002)] == [("und", 0.0)] * 3
    assert pred[1003][0] == "bb" and pred[1004][0] == rows[0][2] and all(0 <= s <= 1 for _, s in pred.values())
    flags = {r.doc_id: r.h for r in df.select("doc_id", M.held_out(df.doc_id).alias("h")).collect()}
    assert all(flags[r[0]] == (zlib.crc32(str(r[0]).encode()) % 3 == 1) for r in rows if r[0] is not None)


def test_kernel_is_shared_grams():
    m = M.fit(["abc ab", "xyz"], ["p", "q"])

    def grams(t):
        t = f" {t} "
        return {t[i : i + n] for n in M.ORDERS for i in range(len(t) - n + 1)}

    known = grams("abc ab") | grams("xyz")
    for text in ("ab", "abc xy", "zz top"):
        k = m.kernel(m.present([text])[0])[0]
        x = grams(text) & known
        want = [len(x & grams(t)) / np.sqrt(max(1, len(x))) / np.sqrt(len(grams(t))) for t in ("abc ab", "xyz")]
        assert np.allclose(k, want, atol=1e-6)


def test_a_table_that_is_nearly_full_loses_no_gram():
    rng = np.random.default_rng(1)
    grams = np.unique(rng.integers(0, 1 << 60, 900).astype(np.uint64))
    table = M.gram_table(grams, 10)
    wanted = np.concatenate([grams[::-1], rng.integers(0, 1 << 60, 500).astype(np.uint64), grams[:5]])
    at, col = M.find_grams(table, grams, wanted)
    place = {g: i for i, g in enumerate(grams.tolist())}
    assert dict(zip(at.tolist(), col.tolist())) == {i: place[g] for i, g in enumerate(wanted.tolist()) if g in place}
    assert all(len(x) == 0 for x in M.find_grams(M.gram_table(grams[:0]), grams[:0], wanted))


def test_every_language_is_learned(spark):
    """More labels than any fixed number of classes: each gets its share of the rows."""
    names = [f"l{i:03d}" for i in range(90)]
    word = {n: "".join(chr(0x4E00 + 7 * i + k) for k in range(4)) for i, n in enumerate(names)}
    rows = [(k * 90 + i, word[n] * 3, n) for k in range(9) for i, n in enumerate(names)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = M.train(df)
    assert model.langs == names
    got = {r.doc_id: r.lang_pred for r in M.identify(df, model).collect()}
    assert all(got[i] == n for i, _, n in rows)


def test_nystroem_and_ridge_equal_plain_algebra():
    """Features K W^-1/2, one ridge regression per language, and the margins, by their definitions."""
    rng = random.Random(9)
    texts, langs = zip(*[(say(rng, x, rng.randint(3, 30)), x) for x in ["aa", "bb", "cc"] * 12])
    m = M.fit(list(texts), list(langs), landmarks=9)
    by = {n: [t for t, x in zip(texts, langs) if x == n] for n in sorted(set(langs))}
    marks = [by[n][k] for k in range(3) for n in by]

    def grams(t):
        t = " " + "".join(c if c.isalpha() else " " for c in t.lower()) + " "
        return {t[i : i + n] for n in M.ORDERS for i in range(len(t) - n + 1)}

    known = set().union(*map(grams, marks))

    def kernel(a, b):
        x, y = grams(a) & known, grams(b)
        return len(x & y) / np.sqrt(max(1, len(x))) / np.sqrt(len(y))

    w = np.array([[kernel(a, b) for b in marks] for a in marks])
    values, vectors = np.linalg.eigh(w)
    keep = values > 1e-6 * values.max()
    root = vectors[:, keep] @ np.diag(values[keep] ** -0.5)
    x = np.hstack([np.array([[kernel(t, b) for b in marks] for t in texts]) @ root, np.ones((len(texts), 1))])
    y = np.array([[1.0 if a == n else -1.0 for n in by] for a in langs])
    beta = np.linalg.inv(x.T @ x + M.RIDGE * len(x) / x.shape[1] * np.eye(x.shape[1])) @ x.T @ y
    fresh = [say(rng, n, 8) for n in by] + [texts[0]]
    margins = np.hstack([np.array([[kernel(t, b) for b in marks] for t in fresh]) @ root, np.ones((len(fresh), 1))]) @ beta
    got, scores = m.predict(fresh)
    assert got == [list(by)[k] for k in margins.argmax(1)]
    assert np.allclose(scores, np.clip((margins.max(1) + 1) / 2, 0, 1), atol=2e-3)


def test_what_is_kept(spark):
    rows, df = table(spark)
    model = M.train(df)
    more = spark.createDataFrame([(1, "日本語の文章"), (2, "schön eine"), (3, "12 !"), (4, None), (5, "thand of ther"), (5, "thand of ther")], "doc_id long, text string")
    assert sorted(r.doc_id for r in M.keep_identified(more, model).collect()) == [2, 5, 5]  # no landmark has a letter of the first
    assert sorted(r.doc_id for r in M.keep_identified(more, model, languages={"bb"}).collect()) == [2]
    assert sorted(r.doc_id for r in M.keep_identified(more, None).collect()) == [1, 2, 5, 5]  # without a model a letter decides
    assert M.keep_identified(df, model).columns == df.columns and M.keep_identified(df.limit(0), model).count() == 0


def test_training_does_not_depend_on_row_order(spark):
    rows, _ = table(spark, 60)
    rows += [(1, "ther whis of", rows[1][2], "s", 0.0)]
    one, two = (M.train(spark.createDataFrame(r, "doc_id long, text string, lang string, source string, n double").repartition(n)) for r, n in ((rows, 1), (rows[::-1], 6)))
    assert (one.grams == two.grams).all() and (one.weights == two.weights).all()


def test_no_rows(spark):
    _, df = table(spark, 5)
    assert M.train(df.limit(0)) is None
    assert M.identify(df.limit(0), None).count() == 0
    assert {r.lang_pred for r in M.identify(df, None).collect()} == {"und"}


FOREIGN = ["Это русский текст о погоде, он довольно длинный.", "Questo è un testo italiano che parla del tempo e della pioggia.", "To jest polski tekst o pogodzie, dość długi.", "Bu hava durumu hakkında uzun bir Türkçe metindir.", "日本語のテキストは天気についてです。"]


def test_foreign_texts_go_by_the_score(spark):
    """Languages that were not learned, in a known script or not; of the table's own texts almost all stay."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").repartition(8)
    model = M.train(docs)
    planted = spark.createDataFrame([(10**9 + i, t, None, "s", len(t)) for i, t in enumerate(FOREIGN)], docs.schema)
    kept = M.keep_identified(docs.union(planted), model)
    assert kept.where("doc_id >= 1000000000").count() == 0
    assert M.keep_identified(planted, model, min_score=0.0).count() > 0  # the score decides, not a letter
    held = docs.where(M.held_out(docs.doc_id))
    assert M.keep_identified(held, model).count() > 0.985 * held.count()
    assert {r.text for r in kept.where("doc_id < 1000000000").select("text").distinct().collect()} == {r.text for r in M.keep_identified(docs, model).select("text").distinct().collect()}
