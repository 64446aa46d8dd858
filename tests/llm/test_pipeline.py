"""run() against a brute-force version of each stage on a small corpus with planted cases."""

import hashlib
import random
import re

import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from corpusloom.llm import bpe, language, toxicity

from .test_decontaminate import brute as contaminated
from .test_simhash import brute as fingerprint
from .test_simhash import groups

SAY = {"en": ["th", "er", "ing", "ou", "and"], "de": ["sch", "ein", "ung", "ü", "keit"]}


def text(rng, lang, n):
    return " ".join("".join(rng.choice(SAY[lang]) for _ in range(rng.randint(1, 4))) for _ in range(n))


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng, root = random.Random(12), tmp_path_factory.mktemp("corpus")
    rows, labels = [], []
    for i in range(300):
        lang = rng.choice(["en", "de"])
        body, bad = text(rng, lang, rng.randint(30, 300)), i % 6 == 0
        if bad:
            w = body.split()
            w[3], w[9] = "idiot", "scum"
            body = " ".join(w)
        rows.append((i, body, lang, f"s{i % 4}", len(body)))
        labels.append((i, 1, int(bad)))
    items = [(1, text(rng, "en", 40)), (2, text(rng, "en", 9))]
    add = lambda i, t, lang="en": rows.append((i, t, lang, "s0", len(t or "")))
    add(400, None)
    add(401, "")
    add(402, "12 34 !!")
    for k in range(5):
        add(410 + k, rows[7][1])  # copies
    near = rows[8][1].split()
    near[50 % len(near)] = "changed"
    add(420, " ".join(near), rows[8][2])
    add(430, text(rng, "en", 60) + " " + items[0][1])  # contaminated
    add(431, text(rng, "en", 900) + " " + items[1][1])  # holds a passage, too little of it to count
    add(432, text(rng, "en", 60) + " " + " ".join(items[0][1].split()[:12]))  # one word short
    for name, data, ddl in (("documents", rows, "doc_id long, text string, lang string, source string, n_chars long"), ("labels", labels, "doc_id long, quality int, toxic int"), ("benchmark", items, "item_id long, text string")):
        spark.createDataFrame(data, ddl).write.parquet(f"{root}/{name}.parquet")
    return str(root), rows, items


def test_run_equals_brute_force(spark, folder):
    root, rows, items = folder
    docs = spark.read.parquet(f"{root}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language", "toxicity", "near_duplicates", "contamination", "bpe"]
    left = [r for r in rows if r[1] and re.search(r"[^\W\d_]", r[1])]
    assert len(left) == len(rows) - 3
    first = language.keep_identified(docs, language.train(docs))
    assert sorted(tuple(r) for r in first.collect()) == sorted(left) and first.columns == docs.columns
    chain = toxicity.train(first, spark.read.parquet(f"{root}/labels.parquet"))
    p = chain.probabilities([r[1] for r in left])[:, -1]
    assert all((x >= chain.threshold) == ("idiot" in r[1]) for x, r in zip(p, left))
    left = [r for r in left if "idiot" not in r[1]]
    prints = {r[0]: fingerprint(r[1]) for r in left}
    root_of = groups(list(prints.values()))
    best = {}
    for r in left:
        g = root_of[prints[r[0]]]
        best[g] = min(best.get(g, r[0]), r[0])
    left = [r for r in left if best[root_of[prints[r[0]]]] == r[0]]
    assert not {410, 411, 412, 413, 414} & {r[0] for r in left}
    bad = {x[0] for x in contaminated([(r[0], r[1]) for r in left], items) if x[-1]}
    assert bad == {430}
    left = [r for r in left if r[0] not in bad]
    lib = Tokenizer.from_file(bpe.vocabulary_path())
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    ids = {r[0]: lib.encode(r[1], add_special_tokens=False).ids for r in left}
    want = {k: (len(v), sha(",".join(map(str, v))), sha(lib.decode(v, skip_special_tokens=False))) for k, v in ids.items()}
    got = corpus_pipeline.run(spark, root).collect()
    assert len(got) == len(want) and {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in got} == want


def test_no_labels_keep_the_corpus(spark, folder):
    """Without a labelled row there is no model of language or toxicity, and no text goes for want of one."""
    root, _, _ = folder
    docs = spark.createDataFrame([(1, "Some words", None), (2, "日本語", None), (3, "12", None)], "doc_id long, text string, lang string")
    assert sorted(r.doc_id for r in corpus_pipeline.language_stage(spark, docs, root).collect()) == [1, 2]
    assert corpus_pipeline.toxicity_stage(spark, docs, root).count() == 3


def test_stages_keep_columns_nulls_and_repeats(spark, folder):
    root, rows, _ = folder
    odd = [(None, "no id thing", "en", "s", 1, "x"), (7, rows[7][1], "en", "s", 1, "y"), (7, rows[7][1], "en", "s", 1, "y"), (7, "another text of the same id", "en", "s", 1, None), (9, None, None, None, None, None)]
    docs = spark.createDataFrame(odd, "doc_id long, text string, lang string, source string, n_chars long, fp string")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, root)
        assert out.columns == docs.columns
        assert stage(spark, docs.limit(0), root).count() == 0
    kept = corpus_pipeline.near_duplicate_stage(spark, docs, root).collect()
    assert sorted(str(r.text) for r in kept) == sorted(map(str, ["no id thing", rows[7][1], "another text of the same id", None]))
    assert corpus_pipeline.bpe_stage(spark, docs, root).count() == 5
