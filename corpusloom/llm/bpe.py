"""BPE encoding by a prefix-sharing trie, and decoding.

Distinct words are walked in sorted order, which is a depth-first walk of their trie: the path holds, for
each prefix, the last token of its encoding, and a word starts where it leaves the one before it, so a
shared prefix is encoded once. The encoding of a prefix ends in the one vocabulary token that is a suffix
of it and that may follow the last token of what stands before; two tokens may stand side by side if no
merge across their border would have come first. The ids of a word are read backwards along the path.

Words a task met are looked up in a table of bounded size.
"""

from __future__ import annotations

import hashlib
import json
import re
from array import array
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import read_table, ship, spread
from .words import Table, cut, id_flow, portions

#: Words that a task keeps in each of two generations, and pairs of tokens, which start anew beyond it.
KEPT_WORDS = 200_000
#: Bytes of text that are encoded at a time: the places and ids of its words take many times as much.
PORTION = 1_500_000
IDS = np.dtype("<u4")


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte in byte-level vocabularies."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = iter(range(256, 512))
    return [chr(b) if b in own else chr(next(rest)) for b in range(256)]


class TrieEncoder:
    """Encodes words with the merges of a byte-level BPE file. Inside, bytes are 0-255 and merge i is 256+i."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, byte_of = spec["model"]["vocab"], {c: b for b, c in enumerate(byte_letters())}
        self.added = {x["content"]: x["id"] for x in spec["added_tokens"]}
        letters = byte_letters()
        self.bytes = [bytes([b]) for b in range(256)]
        self.out = [vocab[c] for c in letters]
        rank, self.pair, self.parts = {c: b for c, b in byte_of.items()}, {}, [(b, b) for b in range(256)]
        for merge in spec["model"]["merges"]:
            a, b = merge if isinstance(merge, list) else merge.split(" ")
            t = len(self.bytes)
            self.pair[rank[a], rank[b]] = t
            self.parts.append((rank[a], rank[b]))
            self.bytes.append(self.bytes[rank[a]] + self.bytes[rank[b]])
            self.out.append(vocab[a + b])
            rank.setdefault(a + b, t)
        self.side: dict[int, bool] = {}
        # A token is of use if its own bytes encode to it: then its halves may stand side by side before it is made.
        self.token = {}
        for t, (a, b) in enumerate(self.parts):
            if t < 256 or self._may_meet(a, b, t):
                self.token.setdefault(self.bytes[t], t)
        #: Each end of a token, with the token it is itself, or -1.
        self.tails = {x[i:]: -1 for x in self.token for i in range(len(x))} | self.token
        self.text_of = {self.out[t]: self.bytes[t] for t in range(len(self.bytes))} | {i: c.encode() for c, i in self.added.items()}

    def _may_meet(self, a: int, b: int, limit: int = 1 << 40) -> bool:
        """Whether no merge below ``limit`` joins the border of ``a`` and ``b`` before they are complete.

        The compatibility test published for byte pair encodings that are built token by token: the merges of
        both tokens are undone, latest first, and no pair that meets at the border may be a merge of its own.
        """
        pair, parts = self.pair, self.parts
        while True:
            made = pair.get((a, b))
            if made is not None and made < limit:
                return False
            if a > b:  # undo the later of the two
                limit = a
                a = parts[a][1]
                if a == limit:
                    limit, b = b + 1, parts[b][0]
                    if b + 1 == limit:
                        return True
            else:
                limit = b + 1
                b = parts[b][0]
                if b + 1 == limit:
                    limit, a = a, parts[a][1]
                    if a == limit:
                        return True

    def encode_words(self, found: list[bytes]) -> dict[bytes, list[int]]:
        """Vocabulary ids of each distinct word."""
        tails, side, out, size = self.tails, self.side, self.out, self.bytes
        path, before, result = [-1], b"", {}
        for word in sorted(set(found)):
            shared = 0
            for x, y in zip(word, before):
                if x != y:
                    break
                shared += 1
            del path[shared + 1 :]
            for end in range(shared + 1, len(word) + 1):
                for start in range(end - 1, -1, -1):
                    t = tails.get(word[start:end])
                    if t is None:
                        raise ValueError(f"no encoding of {word!r}")
                    if t >= 0:
                        left = path[start]
                        if left < 0:
                            break
                        key = left << 32 | t
                        ok = side.get(key)
                        if ok is None:
                            ok = side[key] = self._may_meet(left, t)
                        if ok:
                            break
                else:
                    raise ValueError(f"no encoding of {word!r}")
                path.append(t)
            ids, end = [], len(word)
            while end:
                t = path[end]
                ids.append(out[t])
                end -= len(size[t])
            ids.reverse()
            result[word] = ids
            before = word
        if len(side) > KEPT_WORDS:
            side.clear()
        return result

    def sections(self, text: str) -> list[tuple[str, int | None]]:
        """A text as parts between added tokens, with the id of the added token that follows each."""
        if not any(a in text for a in self.added):
            return [(text, None)]
        parts = re.split("(" + "|".join(map(re.escape, sorted(self.added, key=len, reverse=True))) + ")", text)
        return [(parts[i], self.added[parts[i + 1]] if i + 1 < len(parts) else None) for i in range(0, len(parts), 2)]

    def id_bytes(self, found: list[bytes]) -> list[bytes]:
        """Vocabulary ids of each word as unsigned 32-bit integers."""
        ids = self.encode_words(found)
        return [array("I", ids[w]).tobytes() for w in found]

    def encode_whole(self, text: str) -> bytes:
        """Ids of a text that holds added tokens."""
        parts = self.sections(text)
        found = cut(pa.array([p for p, _ in parts], pa.string()), [])
        ids, bounds = id_flow(found, self.id_bytes(found.keys), IDS)
        marks = [b"" if added is None else array("I", [added]).tobytes() for _, added in parts]
        return b"".join(ids[s:e].tobytes() + m for s, e, m in zip(bounds.tolist(), bounds[1:].tolist(), marks))

    def decode(self, ids: list[int]) -> str:
        return b"".join(self.text_of[i] for i in ids).decode("utf-8", "replace")


@lru_cache(maxsize=2)
def encoder(path: str) -> tuple[TrieEncoder, Table]:
    return TrieEncoder(path), Table(KEPT_WORDS)


def encode_texts(texts: pa.Array, path: str) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all whole texts of an Arrow column one after the other, and where each text's begin (and the end). Null is empty."""
    enc, kept = encoder(path)
    found = cut(texts, list(enc.added))
    whole = {k: found.keys[k].decode() for k in found.whole}
    for k in whole:
        found.keys[k] = b" "
    raw = kept.look_up(found.keys, enc.id_bytes)
    for k, text in whole.items():
        raw[k] = enc.encode_whole(text)
    return id_flow(found, raw, IDS)


def encode(texts: list[str], path: str) -> list[list[int]]:
    """Ids of each whole text."""
    ids, bounds = encode_texts(pa.array(texts, pa.string()), path)
    return [ids[s:e].tolist() for s, e in zip(bounds.tolist(), bounds[1:].tolist())]


@lru_cache(maxsize=2)
def _spellings(path: str) -> tuple[pa.Array, pa.Array]:
    """By id: its digits with a comma, and the bytes it stands for."""
    text_of = encoder(path)[0].text_of
    size = max(text_of) + 1
    return pa.array([b"%d," % i for i in range(size)], pa.large_binary()), pa.array([text_of.get(i, b"") for i in range(size)], pa.large_binary())


def _digests(texts: pa.Array, path: str) -> tuple[list[int], list[str], list[str]]:
    """Number of ids, hash of the ids and hash of the decoded text of each text."""
    ids, bounds = encode_texts(texts, path)
    at, hashes = pa.array(ids.astype(np.int32)), []
    for column, finish in zip(_spellings(path), (lambda b: b[:-1], lambda b: str(b, "utf-8", "replace").encode())):
        run = column.take(at)  # all texts one after the other
        ends = np.frombuffer(run.buffers()[1], np.int64)[run.offset :][bounds].tolist() if len(run) else [0] * len(bounds)
        data = memoryview(run.buffers()[2] or b"")
        hashes.append([hashlib.sha256(finish(data[s:e])).hexdigest() for s, e in zip(ends, ends[1:])])
    return np.diff(bounds).tolist(), hashes[0], hashes[1]


def digest_batches(batches, path: str):
    """Digests of each record batch of ids and texts. Memory goes by the portions, and by the longest text, not by the batches."""
    for batch in batches:
        n, ids, text = [], [], []
        for part, _ in portions(batch.column(1), PORTION):
            for all_, some in zip((n, ids, text), _digests(part, path)):
                all_ += some
        pa.default_memory_pool().release_unused()  # else freed arrays stay with the worker
        yield pa.record_batch([batch.column(0), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(text, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])
    enc, kept = encoder(path)  # workers are used again; what a task kept is not
    kept.clear()
    enc.side.clear()


def bpe_digests(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256), a row for each row of ``docs``.

    Null and empty texts have no ids. Ids and text may repeat or be null; an empty table gives no rows; other columns
    play no part. Texts are encoded whole, of any length.
    """
    ship(docs.sparkSession)

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(lambda batches: digest_batches(batches, path), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def encode_column(docs: DataFrame, path: str, text_col: str = "text", out_col: str = "ids") -> DataFrame:
    """``docs`` with the ids of each text in ``out_col``, which takes the place of a column of that name.

    Null and empty texts have an empty list. Repeated rows each come back; an empty table gives no rows.
    """
    ship(docs.sparkSession)

    @F.arrow_udf("array<int>")
    def ids(column: pa.Array) -> pa.Array:
        lists = []
        for part, _ in portions(column, PORTION):
            flow, bounds = encode_texts(part, path)
            lists.append(pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(flow.astype(np.int32))))
        return pa.concat_arrays(lists) if lists else pa.array([], pa.list_(pa.int32()))

    return docs.withColumn(out_col, ids(F.col(text_col)))


def vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op10_bpe(spark, sf_dir: str) -> DataFrame:
    return bpe_digests(spread(read_table(spark, sf_dir, "documents")), vocabulary_path())
