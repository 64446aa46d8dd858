import glob
import os
import random
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from corpusloom.llm import token_store as M
from corpusloom.llm import words

PATH = M.vocabulary_path()
LIB = Tokenizer.from_file(PATH)


def rows():
    rng = random.Random(4)
    say = lambda n: " ".join("".join(rng.choice(["th", "ea", "ou", "é"]) for _ in range(rng.randint(1, 5))) for _ in range(n))
    long = say(9000)
    return [(5, None), (1, ""), (9, "a  b \n c"), (2, "  <|endoftext|> x"), (3, long), (8, long), (8, long), (8, "other"), (7, long[:20000] + " changed " + long[20000:]), (None, "no id"), (6, "x" * 40_000)]


def test_round_trip(spark, tmp_path):
    data = rows()
    df = spark.createDataFrame([(a, b, "k", b"d") for a, b in data], "doc_id long, text string, kind string, data binary")
    root = str(tmp_path / "store")
    M.write_store(df, root, PATH)
    got = M.read_store(spark, root).collect()
    ids = [(d, [*LIB.encode(t or "", add_special_tokens=False).ids, 2]) for d, t in data]
    assert sorted([(r.doc_id, r.n_tokens, r.ids_crc32) for r in got], key=str) == sorted([(d, len(x), zlib.crc32(np.array(x, "<u4").tobytes())) for d, x in ids], key=str)
    at = 0
    for r in sorted(got, key=lambda r: r.start):
        assert r.start == at
        at += r.n_tokens
    order = [r.doc_id for r in sorted(got, key=lambda r: r.start)]
    assert order == sorted(order, key=lambda d: -1 if d is None else d)
    assert dict((r.doc_id, r.ids) for r in M.read_ids(spark, root, [3, 7]).collect()) == {d: x for d, x in ids if d in (3, 7)}
    chunks = spark.read.parquet(f"{root}/objects").where("kind = 'chunk'")
    assert chunks.count() == chunks.select("key").distinct().count()
    assert chunks.agg({"n": "sum"}).first()[0] < 0.6 * at  # copies are stored once
    manifest = spark.read.parquet(f"{root}/manifest").where("part is not null").orderBy("part").collect()
    assert sum(m.n_docs for m in manifest) == len(data) and sum(m.n_tokens for m in manifest) == at
    for m in manifest:
        docs = spark.read.parquet(f"{root}/recipes").where(f"kind = 'recipe' and part = {m.part}").orderBy("seq").collect()
        assert M.merkle([M.recipe_key(d.doc_id, bytes(d.root)) for d in docs]) == bytes(m.root)


def test_damage_is_found(spark, tmp_path):
    root = str(tmp_path / "store")
    M.write_store(spark.createDataFrame([(1, "some words here")], "doc_id long, text string"), root, PATH)
    (file,) = glob.glob(f"{root}/objects/kind=chunk/*.parquet")
    t = pq.read_table(file)
    bad = M.zstandard.ZstdCompressor().compress(np.array([1, 2, 3, 4][: t["n"][0].as_py()], "<u2").tobytes())
    os.remove(os.path.join(os.path.dirname(file), f".{os.path.basename(file)}.crc"))
    pq.write_table(t.set_column(t.schema.get_field_index("data"), "data", [[bad]]), file)
    with pytest.raises(Exception, match="damaged"):
        M.read_store(spark, root).collect()


def change(files, edit):
    """Rewrite the Parquet files that ``edit`` changes."""
    done = 0
    for file in sorted(files):
        t = pq.ParquetFile(file).read()
        new = edit(t)
        if new is not None:
            crc = os.path.join(os.path.dirname(file), f".{os.path.basename(file)}.crc")
            if os.path.exists(crc):
                os.remove(crc)
            pq.write_table(new, file)
            done += 1
    assert done


def swapped(t, *names):
    """The first two rows with the values of some columns exchanged."""
    if len(t) < 2:
        return None
    order = pa.array([1, 0, *range(2, len(t))])
    for n in names:
        t = t.set_column(t.schema.get_field_index(n), n, t[n].take(order))
    return t


FAULTS = {
    "a recipe is missing": ("recipes/kind=recipe", lambda t: t.slice(1)),
    "a recipe is added": ("recipes/kind=recipe", lambda t: pa.concat_tables([t, t.slice(0, 1)])),
    "two documents are swapped": ("recipes/kind=recipe", lambda t: swapped(t, "doc_id")),
    "two recipes change place": ("recipes/kind=recipe", lambda t: swapped(t, "seq")),
    "a start is wrong": ("recipes/kind=recipe", lambda t: t.set_column(t.schema.get_field_index("before"), "before", pa.array([x + 1 for x in t["before"].to_pylist()]))),
    "the part's root is wrong": ("manifest", lambda t: swapped(t, "root")),
    "a part is missing": ("manifest", lambda t: t.slice(1)),
    "the seal is missing": ("manifest", lambda t: t.filter(t["part"].is_valid())),
}


@pytest.mark.parametrize("fault", FAULTS)
def test_the_manifest_tells(spark, tmp_path, fault):
    root = str(tmp_path / "store")
    M.write_store(spark.createDataFrame([(i, f"text {i % 5} of some") for i in range(12)], "doc_id long, text string"), root, PATH)
    assert M.read_store(spark, root).count() == 12
    folder, edit = FAULTS[fault]
    change(glob.glob(f"{root}/{folder}/*.parquet"), edit)
    with pytest.raises(ValueError, match="damaged|does not fit|should stand"):
        M.read_store(spark, root)
    with pytest.raises(ValueError, match="damaged|does not fit|should stand"):
        M.read_ids(spark, root, [1])


def test_a_lost_file_of_recipes_is_found(spark, tmp_path):
    root = str(tmp_path / "store")
    M.write_store(spark.createDataFrame([(i, "t" * i) for i in range(9)], "doc_id long, text string"), root, PATH)
    os.remove(glob.glob(f"{root}/recipes/kind=recipe/*.parquet")[0])
    with pytest.raises(ValueError, match="does not fit"):
        M.read_store(spark, root)


def test_empty_table(spark, tmp_path):
    M.write_store(spark.createDataFrame([], "doc_id long, text string"), str(tmp_path / "s"), PATH)
    assert M.read_store(spark, str(tmp_path / "s")).count() == 0


def chunks_of(ids, least=M.LEAST, mean=M.MEAN, most=M.MOST):
    return np.split(ids, M.cut_points(M.marks_of(ids, mean).tolist(), 0, len(ids), least, most)[:-1])


def test_chunks_survive_an_edit():
    rng = np.random.default_rng(1)
    ids = rng.integers(0, 50_000, 60_000).astype(np.uint16)
    one = chunks_of(ids)
    two = chunks_of(np.insert(ids, 20_000, [7, 7, 7]))
    same = {c.tobytes() for c in one} & {c.tobytes() for c in two}
    assert len(same) >= len(one) - 3
    assert all(M.LEAST <= len(c) <= M.MOST for c in one[:-1]) and 20 < len(one) < 100
    assert len(chunks_of(np.zeros(100_000, np.uint16))) == 7  # a run of one id ends at the most


def test_chunks_of_a_document_do_not_depend_on_the_one_before():
    rng = np.random.default_rng(2)
    a, b = (rng.integers(0, 300, n).astype(np.uint16) for n in (700, 9000))
    flow = np.concatenate([a, b])
    marks = [m for m in M.marks_of(flow, 64).tolist() if m > len(a)]
    together = M.cut_points(marks, len(a), len(flow), 16, 400)
    assert [e - len(a) for e in together] == M.cut_points(M.marks_of(b, 64).tolist(), 0, len(b), 16, 400)


def test_streamed_merkle_root():
    for n in range(20):
        hs = [bytes([i]) * 32 for i in range(n)]
        s = M.MerkleStream()
        for h in hs:
            s.add(h)
        assert s.root() == M.merkle(hs)


def same(texts, path=PATH, lib=LIB):
    ids, bounds = M.encode_texts(pa.array(texts, pa.string()), path)
    for k, t in enumerate(texts):
        assert ids[bounds[k] : bounds[k + 1]].tolist() == lib.encode(t or "", add_special_tokens=False).ids, t


def test_encoding_equals_the_library():
    same(["", None, " lead", "two  spaces", "end ", "tab \t x", "nb \u00a0x", "a <|endoftext|>b", "  <|endoftext|>", "plain words here, and more.\nNew line", "x\n y", "\u2003 em", "日本 語", "'s", "don't 's '' 'll"] + [t for _, t in rows()])
    ids, bounds = M.encode_texts(pa.array([], pa.string()), PATH)
    assert len(ids) == 0 and bounds.tolist() == [0]
    ids, bounds = M.encode_texts(pa.array([None, ""], pa.string()), PATH)
    assert len(ids) == 0 and bounds.tolist() == [0, 0, 0]


ALPHABET = st.one_of(st.sampled_from(" \n\t'srevldmTHEtheng0123,.|<>é日½\u00a0\u3000\u0301\u0085\x1c"), st.characters(exclude_categories=["Cs"]))


@settings(max_examples=300, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(alphabet=ALPHABET, max_size=40), st.just("x<|endoftext|> y")), max_size=6))
def test_any_texts_equal_the_library(texts):
    same(texts)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet=ALPHABET, max_size=30), min_size=1, max_size=6))
def test_words_equal_the_library(texts):
    from tokenizers.pre_tokenizers import ByteLevel

    found = words.cut(pa.array(texts, pa.string()), [])
    for k, t in enumerate(texts):
        assert [found.keys[i] for i in found.at[found.bounds[k] : found.bounds[k + 1]]] == [t[a:b].encode() for _, (a, b) in ByteLevel(add_prefix_space=False).pre_tokenize_str(t)]


def test_words_of_a_slice():
    column = pa.array(["drop this", "keep 日本 it's", None, "", "the end "], pa.string()).slice(1)
    found = words.cut(column, [])
    assert [[found.keys[i] for i in found.at[a:b]] for a, b in zip(found.bounds, found.bounds[1:])] == [[b"keep", " 日本".encode(), b" it", b"'s"], [], [], [b"the", b" end", b" "]]


def test_the_table_of_words_starts_anew(monkeypatch):
    monkeypatch.setattr(M, "KEPT_WORDS", 3)
    M._library.cache_clear()
    same(["one two three four five one two", "five four three two one"] * 3)
    lib = M._library(PATH)
    assert len(lib.table.young) <= 8 and len(lib.table.old) <= 8
    M._library.cache_clear()


def test_a_file_of_another_type_goes_to_the_library_whole(tmp_path):
    from tokenizers import Tokenizer, models, pre_tokenizers

    tok = Tokenizer(models.WordLevel({"[UNK]": 0, "a": 1, "b": 2, "c,": 3}, unk_token="[UNK]"))
    tok.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
    path = str(tmp_path / "words.json")
    tok.save(path)
    assert not M._library(path).byte_level
    same(["a b  c, d", None, "", " a"], path, tok)


def test_recipes_do_not_depend_on_row_order(spark):
    """A task that runs again may meet its rows in another order; reducers then hold keys of either run."""
    data = [(d, t) for d, t in rows() if len(t or "") < 100] + [(None, "no id"), (-1, "a"), (4, "a")]

    def recipes(order):
        df = spark.createDataFrame(order, "doc_id long, text string").coalesce(1)
        made = df.mapInArrow(M._cutter(PATH, 2, (M.LEAST, M.MEAN, M.MOST)), M._STORE_DDL).where("kind = 'recipe'")
        return sorted(((bytes(r.key), r.doc_id, bytes(r.data)) for r in made.collect()), key=str)

    first, again = recipes(data), recipes(data[::-1])
    half = [r for r in first if r[0][-1] % 2] + [r for r in again if not r[0][-1] % 2]
    assert first == again == sorted(half, key=str)
    assert len({k for k, _, _ in first}) == len({(d, r) for _, d, r in first}) == len(set(data))


def test_lost_rows_are_found(spark, tmp_path, monkeypatch):
    df = spark.createDataFrame([(1, "a"), (2, "b"), (2, "b")], "doc_id long, text string")
    M.write_store(df, str(tmp_path / "whole"), PATH)
    assert M.read_store(spark, str(tmp_path / "whole")).count() == 3
    cutter = M._cutter

    def losing(*a):
        def run(batches):
            for b in cutter(*a)(batches):
                yield b.filter(pa.array([not (k == "recipe" and d == 1) for k, d in zip(b["kind"].to_pylist(), b["doc_id"].to_pylist())]))

        return run

    monkeypatch.setattr(M, "_cutter", losing)
    with pytest.raises(RuntimeError, match="3 rows were given, and the store has 2 recipes"):
        M.write_store(df, str(tmp_path / "less"), PATH)
