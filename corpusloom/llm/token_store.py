"""Token ids in a content-addressed store.

Layout below a root folder:
  objects/kind=chunk   key (sha256 of the ids as little-endian unsigned 32-bit), n, width, data (zstd of ids of
                       ``width`` bytes): each distinct chunk once
  objects/kind=recipe  recipes as the encoder sent them, before they are put in order
  recipes/kind=recipe  per document, ascending by doc_id within a part and over the parts: part, seq, doc_id,
                       before (tokens of the part before it), n_tokens, hashes, root
  recipes/kind=part    per part: its documents, tokens and Merkle root, written by the task that wrote its recipes
  manifest/            parts in order with the first position of each, and a last row that seals them all

A rolling hash over the last 16 ids cuts each document's id stream, so an edit changes the chunks around it
and no others. A document's root is the Merkle root of its chunk hashes; a part's that of its documents' ids
and roots; the seal's that of the parts. Reading back checks each level: parts against the seal, recipes
against their part (so one that is missing, added, changed or moved is found), chunks against their hash.
It decompresses each stored chunk once and combines chunk checksums along the recipes (the CRC of a
concatenation follows from the CRCs and lengths of its pieces), so ids of copies are neither moved nor read
again.
"""

from __future__ import annotations

import hashlib
import json
import zlib
from array import array
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import byte_letters, vocabulary_path
from .common import read_table, scratch_path, ship, spread
from .words import Table, cut, id_flow, portions

END_ID = 2
#: Ids of a chunk: at least, on average above that, at most.
LEAST, MEAN, MOST = 256, 1024, 16_384
#: Ids that a rolling hash reaches back.
REACH = 16
#: Words whose ids a worker keeps in each of two generations.
KEPT_WORDS = 250_000
_POLY = 0xEDB88320
_LETTERS = dict(enumerate(byte_letters()))


def _byte_level(tok) -> bool:
    """Whether the library cuts words by the byte-level pattern alone and then calls its BPE model."""
    spec = json.loads(tok.to_str())
    cut_by, model = spec["pre_tokenizer"] or {}, spec["model"]
    plain = not any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix"))
    return spec["normalizer"] is None and cut_by.get("type") == "ByteLevel" and not cut_by.get("add_prefix_space") and cut_by.get("use_regex", True) and model["type"] == "BPE" and plain


class _Library:
    """The library's tokenizer of a file, and the ids of the words it met."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tok = tok = Tokenizer.from_file(path)
        tok.no_truncation()
        tok.no_padding()
        self.kind = np.dtype("<u2" if tok.get_vocab_size() <= 1 << 16 else "<u4")
        self.added = [t.content for t in tok.get_added_tokens_decoder().values()]
        self.byte_level = _byte_level(tok)
        self.table = Table(KEPT_WORDS)

    def whole(self, text: str) -> bytes:
        return np.array(self.tok.encode(text, add_special_tokens=False).ids, self.kind).tobytes()

    def words(self, found: list[bytes]) -> list[bytes]:
        """Ids of each word by the library's model."""
        model, code = self.tok.model.tokenize, "H" if self.kind.itemsize == 2 else "I"
        letters = (w.decode().replace(" ", "\u0120") if w.isascii() and w.lstrip().isalpha() else w.decode("latin-1").translate(_LETTERS) for w in found)
        return [array(code, [t.id for t in model(x)]).tobytes() for x in letters]


@lru_cache(maxsize=2)
def _library(path: str) -> _Library:
    return _Library(path)


def encode_texts(column: pa.Array, path: str) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all whole texts of an Arrow column one after the other, and where each text's begin (and the end).

    Of a byte-level file, each distinct word goes to the library's model; a text with an added token, and each
    text where the file is of another type, goes to the library whole. Null is empty.
    """
    lib = _library(path)
    if not lib.byte_level:
        raw = [lib.whole(t or "") for t in column.to_pylist()]
        ends = np.cumsum([0, *map(len, raw)]) // lib.kind.itemsize
        return np.frombuffer(b"".join(raw), lib.kind), ends
    found = cut(column, lib.added)
    texts = {k: found.keys[k].decode() for k in found.whole}
    for k in texts:
        found.keys[k] = b" "
    raw = lib.table.look_up(found.keys, lib.words)
    for k, text in texts.items():
        raw[k] = lib.whole(text)
    return id_flow(found, raw, lib.kind)


def marks_of(ids: np.ndarray, mean: int = MEAN) -> np.ndarray:
    """Positions after which a chunk may end: a rolling hash of the REACH ids up to there says so."""
    h = (ids.astype(np.uint32) + np.uint32(1)) * np.uint32(0x9E3779B1)
    h ^= h >> np.uint32(15)
    factor, step = 0x85EBCA6B, 1
    while step < REACH:
        h[step:] += h[:-step] * np.uint32(factor)
        factor, step = factor * factor & 0xFFFFFFFF, 2 * step
    return np.flatnonzero((h >> np.uint32(8)) % np.uint32(mean) == 0) + 1


def cut_points(marks: list[int], start: int, stop: int, least: int = LEAST, most: int = MOST) -> list[int]:
    """Ends of the chunks of one document, the ids from ``start`` to ``stop``; ``marks``: those between, ascending.

    As a chunk has at least REACH ids, no hash of a mark that counts reaches into the document before.
    """
    ends = []
    for m in marks:
        while m - start > most:
            start += most
            ends.append(start)
        if m - start >= least and m < stop:
            ends.append(m)
            start = m
    while stop - start > most:
        start += most
        ends.append(start)
    if stop > start:
        ends.append(stop)
    return ends


def merkle(hashes: list[bytes]) -> bytes:
    """Root of a binary hash tree; an odd node goes up as it is, and nothing has the hash of nothing."""
    level = [hashlib.sha256(b"\0" + h).digest() for h in hashes] or [hashlib.sha256(b"").digest()]
    while len(level) > 1:
        level = [hashlib.sha256(b"\1" + level[i] + level[i + 1]).digest() if i + 1 < len(level) else level[i] for i in range(0, len(level), 2)]
    return level[0]


class MerkleStream:
    """The same root for hashes that come one by one, holding one node per level."""

    def __init__(self):
        self.nodes: list[tuple[int, bytes]] = []

    def add(self, h: bytes) -> None:
        node = (0, hashlib.sha256(b"\0" + h).digest())
        while self.nodes and self.nodes[-1][0] == node[0]:
            node = (node[0] + 1, hashlib.sha256(b"\1" + self.nodes.pop()[1] + node[1]).digest())
        self.nodes.append(node)

    def root(self) -> bytes:
        if not self.nodes:
            return hashlib.sha256(b"").digest()
        top = self.nodes[-1][1]
        for _, left in reversed(self.nodes[:-1]):
            top = hashlib.sha256(b"\1" + left + top).digest()
        return top


_STORE = pa.schema([("kind", pa.string()), ("key", pa.binary()), ("n", pa.int64()), ("width", pa.int32()), ("data", pa.binary()), ("doc_id", pa.int64()), ("hashes", pa.list_(pa.binary()))])
_STORE_DDL = "kind string, key binary, n long, width int, data binary, doc_id long, hashes array<binary>"


def recipe_key(doc_id: int | None, root: bytes) -> bytes:
    """The same for equal rows alone, whatever task meets them in whatever order: a task that runs again repeats it."""
    return (b"" if doc_id is None else doc_id.to_bytes(8, "big", signed=True)) + root


def _with_ends(ids: np.ndarray, bounds: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """The same flow with the end id after each text."""
    stops = bounds[1:] + np.arange(len(bounds) - 1)
    flow = np.empty(len(ids) + len(stops), ids.dtype)
    own = np.ones(len(flow), bool)
    own[stops] = False
    flow[own], flow[stops] = ids, end_id
    return flow, np.concatenate([[0], stops + 1])


def _cutter(path: str, end_id: int, chunking: tuple):
    least, mean, most = chunking
    if least < REACH:
        raise ValueError(f"a chunk has at least {REACH} ids")

    def run(batches):
        width, press = _library(path).kind.itemsize, zstandard.ZstdCompressor(level=1)
        seen: set[bytes] = set()  # chunks this task has sent already; the store keeps one of each anyway
        for batch in batches:
            ids_of = batch.column(0)
            for texts, at in portions(batch.column(1)):
                flow, bounds = _with_ends(*encode_texts(texts, path), end_id)
                marks = marks_of(flow, mean)
                cuts = np.searchsorted(marks, bounds, "right").tolist()
                marks, wide, plain = marks.tolist(), memoryview(flow.astype("<u4")).cast("B"), memoryview(flow).cast("B")
                chunks, recipes = [], []
                for k, (start, stop) in enumerate(zip(bounds.tolist(), bounds[1:].tolist())):
                    hashes, first = [], start
                    for end in cut_points(marks[cuts[k] : cuts[k + 1]], start, stop, least, most):
                        h = hashlib.sha256(wide[4 * first : 4 * end]).digest()
                        if h not in seen:
                            if len(seen) > 200_000:
                                seen.clear()
                            seen.add(h)
                            chunks.append((h, end - first, press.compress(plain[width * first : width * end])))
                        hashes.append(h)
                        first = end
                    recipes.append((ids_of[at + k].as_py(), stop - start, merkle(hashes), hashes))
                n, m = len(chunks), len(recipes)
                key = [c[0] for c in chunks] + [recipe_key(r[0], r[2]) for r in recipes]
                cols = [["chunk"] * n + ["recipe"] * m, key, [c[1] for c in chunks] + [r[1] for r in recipes], [width] * n + [None] * m]
                cols += [[c[2] for c in chunks] + [r[2] for r in recipes], [None] * n + [r[0] for r in recipes], [None] * n + [r[3] for r in recipes]]
                yield pa.record_batch([pa.array(c, f.type) for c, f in zip(cols, _STORE)], schema=_STORE)

    return run


def _checker(batches):
    """Stored chunks to their checksums; a chunk that does not have its hash ends the job."""
    open_ = zstandard.ZstdDecompressor()
    for batch in batches:
        crcs = []
        for h, n, width, data in zip(*(batch.column(i).to_pylist() for i in range(4))):
            wide = np.frombuffer(open_.decompress(data, max_output_size=n * width), f"<u{width}").astype("<u4").tobytes()
            if hashlib.sha256(wide).digest() != h or len(wide) != 4 * n:
                raise ValueError(f"chunk {h.hex()} is damaged")
            crcs.append(zlib.crc32(wide))
        yield pa.record_batch([batch.column(0), batch.column(1), pa.array(crcs, pa.int64())], names=["hash", "n", "crc"])


def _times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Product of bit-reversed polynomials modulo the CRC's."""
    out, b = np.zeros_like(b), b.copy()
    for bit in range(31, -1, -1):
        out ^= np.where(a >> np.uint64(bit) & np.uint64(1), b, np.uint64(0))
        b = np.where(b & np.uint64(1), (b >> np.uint64(1)) ^ np.uint64(_POLY), b >> np.uint64(1))
    return out


def moved_crc(crc: np.ndarray, zeros: np.ndarray) -> np.ndarray:
    """What ``crc`` adds to the checksum of a stream that goes on for so many bytes."""
    power = np.array([1 << 30], np.uint64)
    for _ in range(3):
        power = _times(power, power)  # x^8: one byte
    out, left = crc.astype(np.uint64), zeros.astype(np.uint64)
    while left.any():
        out = np.where(left & np.uint64(1), _times(np.broadcast_to(power, out.shape), out), out)
        power, left = _times(power, power), left >> np.uint64(1)
    return out


def _combine(batches):
    """Documents' chunk lists to the checksum of all their ids; checks root and count."""
    for batch in batches:
        roots, crcs = [], []
        for root, total, parts in zip(*(batch.column(i).to_pylist() for i in range(3))):
            parts.sort(key=lambda p: p["seq"])
            n = np.array([p["n"] for p in parts], np.int64)
            if merkle([p["hash"] for p in parts]) != root or n.sum() != total:
                raise ValueError(f"recipe {root.hex()} does not fit its chunks")
            after = 4 * (n.sum() - np.cumsum(n))
            roots.append(root)
            crcs.append((np.array([p["crc"] for p in parts], np.uint64), after))
        if roots:
            all_ = moved_crc(np.concatenate([c for c, _ in crcs]), np.concatenate([a for _, a in crcs]))
            starts = np.cumsum([0, *(len(c) for c, _ in crcs)])[:-1]
            yield pa.record_batch([pa.array(roots, pa.binary()), pa.array(np.bitwise_xor.reduceat(all_, starts).astype(np.int64))], names=["root", "ids_crc32"])


_RECIPE = pa.schema([("kind", pa.string()), ("part", pa.int32()), ("seq", pa.int64()), ("doc_id", pa.int64()), ("before", pa.int64()), ("n_tokens", pa.int64()), ("hashes", pa.list_(pa.binary())), ("root", pa.binary())])
_RECIPE_DDL = "kind string, part int, seq long, doc_id long, before long, n_tokens long, hashes array<binary>, root binary"
_PART_DDL = "part int, n_docs long, n_tokens long, root binary, start long"


def _row(schema: pa.Schema, **x) -> pa.RecordBatch:
    return pa.record_batch([pa.array([x.get(f.name)], f.type) for f in schema], schema=schema)


def _number(batches):
    """Recipes of one part in order, each with its number and the tokens before it; the part's own row comes last."""
    part, seq, before, tree = None, 0, 0, MerkleStream()
    for batch in batches:
        if not batch.num_rows:
            continue
        part, n, m = batch.column(0)[0].as_py(), batch.column(2).to_numpy().astype(np.int64), batch.num_rows
        for doc_id, root in zip(batch.column(1).to_pylist(), batch.column(4).to_pylist()):
            tree.add(recipe_key(doc_id, root))
        cols = [pa.array(["recipe"] * m), batch.column(0), pa.array(np.arange(seq, seq + m)), batch.column(1), pa.array(before + np.cumsum(n) - n), batch.column(2), batch.column(3), batch.column(4)]
        yield pa.record_batch([c.cast(f.type) for c, f in zip(cols, _RECIPE)], schema=_RECIPE)
        seq, before = seq + m, before + int(n.sum())
    if part is not None:
        yield _row(_RECIPE, kind="part", part=part, seq=seq, n_tokens=before, root=tree.root())


def part_leaf(part: int, n_docs: int, n_tokens: int, root: bytes) -> bytes:
    return b"%d %d %d " % (part, n_docs, n_tokens) + root


def _seal(parts: list) -> tuple[int, int, bytes]:
    """Documents, tokens and root over (part, n_docs, n_tokens, root) in order."""
    return sum(p[1] for p in parts), sum(p[2] for p in parts), merkle([part_leaf(*p[:3], bytes(p[3])) for p in parts])


def write_store(docs: DataFrame, root: str, path: str, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text", chunking: tuple = (LEAST, MEAN, MOST)) -> None:
    """Encode ``docs`` and write objects, recipes and manifest below ``root``, which must not exist.

    A null text is empty and holds the end id alone. Rows without an id come first, rows of one id in the
    order of their roots; repeated rows each get a recipe; recipes of one id and text lie in one part, as each is a few bytes
    and their order is by id. An empty table gives an empty store. Other columns play no part.
    """
    spark = docs.sparkSession
    ship(spark)
    made = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(_cutter(path, end_id, chunking), _STORE_DDL)
    # A chunk found by several tasks is kept once, a recipe with the number of its rows.
    once = made.groupBy("kind", "key").agg(*[F.first(c).alias(c) for c in ("n", "width", "data", "doc_id", "hashes")], F.count("*").alias("copies"))
    once.write.partitionBy("kind").option("compression", "uncompressed").parquet(f"{root}/objects")
    recipes = spark.read.schema("key binary, n long, data binary, doc_id long, hashes array<binary>, copies long, kind string").parquet(f"{root}/objects").where("kind = 'recipe'")
    each = recipes.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), "copies"))).select("doc_id", F.col("n").alias("n_tokens"), "hashes", F.col("data").alias("root"))
    ordered = each.repartitionByRange("doc_id", "root").sortWithinPartitions("doc_id", "root").select(F.spark_partition_id().alias("part"), "doc_id", "n_tokens", "hashes", "root")
    # The writer wants rows by kind; said here together with their order, so that it does not sort by kind alone.
    ordered.mapInArrow(_number, _RECIPE_DDL).sortWithinPartitions("kind", "seq").write.partitionBy("kind").parquet(f"{root}/recipes")
    parts = spark.read.schema(f"{_RECIPE_DDL}").parquet(f"{root}/recipes").where("kind = 'part'").select("part", F.col("seq").alias("n_docs"), "n_tokens", "root")
    rows = sorted(tuple(r) for r in parts.collect())  # a row per part
    starts = np.cumsum([0, *(r[2] for r in rows)]).tolist()
    given, (held, tokens, sealed) = docs.count(), _seal(rows)
    if given != held:
        raise RuntimeError(f"{given} rows were given, and the store has {held} recipes")
    manifest = [(*r, s) for r, s in zip(rows, starts)] + [(None, held, tokens, sealed, tokens)]
    spark.createDataFrame(manifest, _PART_DDL).coalesce(1).write.parquet(f"{root}/manifest")


def _part_faults(batches):
    """What is wrong with parts, from their recipes in order; rows of a part come together."""
    part, want, seq, before, tree = None, None, 0, 0, MerkleStream()

    def close():
        if part is not None and (want is None or want != (seq, before, tree.root())):
            return [f"part {part} does not fit the manifest"]
        return []

    faults: list[str] = []
    for batch in batches:
        for p, s, doc_id, b, n, root, docs, tokens, whole in zip(*(c.to_pylist() for c in batch.columns)):
            if p != part:
                faults += close()
                part, want, seq, before, tree = p, None if docs is None else (docs, tokens, whole), 0, 0, MerkleStream()
            if root is None:
                continue  # a part without recipes
            if s != seq or b != before:
                faults.append(f"part {p} has a recipe at {s} where {seq} should stand")
            tree.add(recipe_key(doc_id, root))
            seq, before = seq + 1, before + n
        if len(faults) > 20:
            break
    yield pa.record_batch([pa.array(faults + close(), pa.string())], names=["fault"])


def check_manifest(spark, root: str) -> DataFrame:
    """The manifest's parts; a seal that does not fit them, and recipes that do not fit their part, raise an error."""
    ship(spark)
    manifest = spark.read.schema(_PART_DDL).parquet(f"{root}/manifest")
    rows = manifest.collect()  # a row per part
    parts = sorted(tuple(r) for r in rows if r.part is not None)
    seal = [(r.n_docs, r.n_tokens, bytes(r.root)) for r in rows if r.part is None]
    starts = np.cumsum([0, *(p[2] for p in parts)]).tolist()
    if seal != [_seal(parts)] or [p[4] for p in parts] != starts[:-1]:
        raise ValueError(f"the manifest of {root} is damaged")
    recipes = spark.read.schema(_RECIPE_DDL).parquet(f"{root}/recipes").where("kind = 'recipe'").select("part", "seq", "doc_id", "before", "n_tokens", "root")
    known = manifest.where("part is not null").select("part", "n_docs", F.col("n_tokens").alias("tokens"), F.col("root").alias("whole"))
    both = recipes.join(known, "part", "full").select("part", "seq", "doc_id", "before", "n_tokens", "root", "n_docs", "tokens", "whole")
    fault = both.repartition("part").sortWithinPartitions("part", "seq").mapInArrow(_part_faults, "fault string").first()
    if fault:
        raise ValueError(f"{root}: {fault[0]}")
    return manifest.where("part is not null")


def _stored_chunks(spark, root: str) -> DataFrame:
    return spark.read.schema("key binary, n long, width int, data binary, kind string").parquet(f"{root}/objects").where("kind = 'chunk'").select("key", "n", "width", "data")


def _stored_recipes(spark, root: str) -> DataFrame:
    """Recipes with their place in the whole stream, after the manifest was checked."""
    parts = check_manifest(spark, root).select("part", F.col("start").alias("base"))
    recipes = spark.read.schema(_RECIPE_DDL).parquet(f"{root}/recipes").where("kind = 'recipe'")
    return recipes.join(parts, "part").select("doc_id", (F.col("base") + F.col("before")).alias("start"), "n_tokens", "hashes", "root")


def read_store(spark, root: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of each document, from the files alone; damage of any level raises an error."""
    ship(spark)
    sums = _stored_chunks(spark, root).mapInArrow(_checker, "hash binary, n long, crc long")
    recipes = _stored_recipes(spark, root)
    unique = recipes.groupBy("root").agg(F.first("hashes").alias("hashes"), F.first("n_tokens").alias("total"))
    parts = unique.select("root", "total", F.posexplode("hashes").alias("seq", "hash")).join(sums, "hash")
    lists = parts.groupBy("root", "total").agg(F.collect_list(F.struct("seq", "hash", "n", "crc")).alias("parts")).mapInArrow(_combine, "root binary, ids_crc32 long")
    return recipes.join(lists, "root", "left").select("doc_id", "start", "n_tokens", F.when(F.col("ids_crc32").isNull(), F.raise_error(F.lit("a recipe without chunks")).cast("long")).otherwise(F.col("ids_crc32")).alias("ids_crc32"))


def _ids(batches):
    """Ids of the chunks of a batch, each checked against its hash."""
    open_ = zstandard.ZstdDecompressor()
    for batch in batches:
        out = []
        for h, n, width, data in zip(*(batch.column(i).to_pylist() for i in range(3, 7))):
            ids = np.frombuffer(open_.decompress(data, max_output_size=n * width), f"<u{width}").astype("<u4")
            if hashlib.sha256(ids.tobytes()).digest() != h:
                raise ValueError(f"chunk {h.hex()} is damaged")
            out.append(ids)
        flat = np.concatenate(out).astype(np.int64) if out else np.zeros(0, np.int64)
        lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, out)]), pa.int32()), pa.array(flat))
        yield pa.record_batch([batch.column(0), batch.column(1), batch.column(2), lists], names=["doc_id", "start", "seq", "ids"])


def read_ids(spark, root: str, doc_ids: list[int]) -> DataFrame:
    """(doc_id, start, ids) of the documents named, rebuilt from their chunks; ids without a document give no row.

    Each row is one document: rows of one id come apart by their start. A null among ``doc_ids`` names nothing.
    """
    ship(spark)
    wanted = _stored_recipes(spark, root).where(F.col("doc_id").isin([d for d in doc_ids if d is not None]))
    rows = wanted.select("doc_id", "start", F.posexplode("hashes").alias("seq", "key")).join(_stored_chunks(spark, root), "key")
    pieces = rows.select("doc_id", "start", "seq", "key", "n", "width", "data").mapInArrow(_ids, "doc_id long, start long, seq int, ids array<long>")
    joined = F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("seq", "ids"))), lambda p: p["ids"]))
    return pieces.groupBy("doc_id", "start").agg(joined.alias("ids"))


def op4_token_store(spark, sf_dir: str) -> DataFrame:
    root = scratch_path(spark, "token-store")
    write_store(spread(read_table(spark, sf_dir, "documents")), root, vocabulary_path())
    return read_store(spark, root)
