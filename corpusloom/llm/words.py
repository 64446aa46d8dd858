"""Words of whole text columns, cut as the byte-level pattern of the tokenizers library cuts them.

    's 't 'm 'd 're 've 'll |  ?letters |  ?numbers |  ?others | white space but the last before a word | white space

A column is cut as one run of bytes: each byte has the class of its character, a word begins where the
class changes, and blanks and contractions move those places. Arrow finds the distinct words, so that only
these become Python objects. What a character beyond ASCII is, the library itself says, once per worker.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text cut at a time.
PORTION = 12_000_000
LETTER, NUMBER, OTHER, SPACE, NEW = range(5)


def portions(column: pa.Array, most: int = PORTION, rows: int = 1 << 30):
    """Parts of a text column of about ``most`` bytes and at most ``rows`` rows each (one text at least), and where they start."""
    size = np.cumsum(pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False))
    start = 0
    while start < len(column):
        before = size[start - 1] if start else 0
        end = min(start + rows, max(start + 1, int(np.searchsorted(size, before + most, "right"))))
        yield column.slice(start, end - start), start
        start = end


@dataclass
class Words:
    keys: list[bytes]  # distinct words
    whole: list[int]  # places in ``keys`` of whole texts that hold an added token
    at: np.ndarray  # for each word of each text, in order, its place in ``keys``
    bounds: np.ndarray  # where the words of each text begin, and the end


@lru_cache(maxsize=1)
def _classes() -> np.ndarray:
    """Class of each code point; those beyond ASCII are NEW until they are met."""
    table = np.full(0x110000, NEW, np.uint8)
    table[:128] = OTHER
    table[[9, 10, 11, 12, 13, 32]] = SPACE
    table[48:58] = NUMBER
    table[65:91] = table[97:123] = LETTER
    return table


@lru_cache(maxsize=1)
def _pre_tokenizer():
    from tokenizers.pre_tokenizers import ByteLevel

    return ByteLevel(add_prefix_space=False)


def _learn(points: np.ndarray) -> None:
    """Ask the library which class each code point has: it stays in one word with its own kind alone."""
    table, cut_by = _classes(), _pre_tokenizer().pre_tokenize_str
    for p in points.tolist():
        table[p] = next((k for k, kind in ((LETTER, "a"), (NUMBER, "0"), (OTHER, "!")) if len(cut_by(kind + chr(p))) == 1), SPACE)


def _byte_classes(b: np.ndarray) -> np.ndarray:
    """Class of the character that each byte belongs to."""
    table = _classes()
    out = table[:256][b]
    lead = np.flatnonzero(b >= 0xC0)
    if len(lead):
        first = b[lead].astype(np.int32)
        more = 1 + (first >= 0xE0) + (first >= 0xF0)  # bytes after the first
        tail = np.append(b[1:], np.zeros(3, np.uint8))
        one, two, three = (tail[np.minimum(lead + i, len(tail) - 1)].astype(np.int32) & 0x3F for i in range(3))
        point = np.where(more == 1, (first & 0x1F) << 6 | one, np.where(more == 2, (first & 0xF) << 12 | one << 6 | two, (first & 7) << 18 | one << 12 | two << 6 | three))
        kind = table[point]
        if (kind == NEW).any():
            _learn(np.unique(point[kind == NEW]))
            kind = table[point]
        for i in range(4):
            some = more >= i
            out[lead[some] + i] = kind[some]
    return out


def _beginnings(b: np.ndarray, firsts: np.ndarray, whole: list[tuple[int, int]]) -> np.ndarray:
    """Where words begin in the bytes ``b`` of texts that begin at ``firsts``; parts of ``whole`` stay uncut."""
    kind = _byte_classes(b)
    new = np.empty(len(b), bool)
    new[0] = True
    np.not_equal(kind[1:], kind[:-1], out=new[1:])
    edge = np.zeros(len(b), bool)
    edge[firsts] = True
    space = kind == SPACE
    last = np.flatnonzero(space[:-1] & ~space[1:] & ~edge[1:])  # the last white space before a word
    new[last[b[last] == 32] + 1] = False  # a blank is the word's
    for _ in range(3):
        last = np.where((b[last] & 0xC0) == 0x80, last - 1, last)
    new[last] = True
    new[firsts] = True
    quote = np.flatnonzero((b == 39) & new)
    if len(quote):
        tail = np.append(b, np.zeros(2, np.uint8))
        inside = np.append(~edge, np.zeros(2, bool))
        one, two = tail[quote + 1], tail[quote + 2]
        short = inside[quote + 1] & np.isin(one, np.frombuffer(b"stmd", np.uint8))
        pair = one.astype(np.int32) << 8 | two
        long = inside[quote + 1] & inside[quote + 2] & np.isin(pair, [ord(x) << 8 | ord(y) for x, y in ("re", "ve", "ll")])
        new[quote[short | long] + 1] = False
        after = np.concatenate([quote[short] + 2, quote[long] + 3])
        new[after[after < len(b)]] = True
    for start, end in whole:
        new[start + 1 : end] = False
    return np.flatnonzero(new)


def cut(column: pa.Array, added: list[str]) -> Words:
    """Words of each text of a column; null is empty and has none. A text with an added token is one word."""
    column = pa.concat_arrays([pc.fill_null(column, "")]).cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    if not len(column) or offsets[-1] == offsets[0]:
        return Words([], [], np.zeros(0, np.int64), np.zeros(len(column) + 1, np.int64))
    data = column.buffers()[2].slice(int(offsets[0]), int(offsets[-1] - offsets[0]))
    offsets = offsets - offsets[0]
    odd = np.zeros(len(column), bool)
    for a in added:
        odd |= pc.match_substring(column, a).to_numpy(zero_copy_only=False)
    odd = np.flatnonzero(odd)
    firsts = offsets[:-1][np.diff(offsets) > 0]
    begin = _beginnings(np.frombuffer(data, np.uint8), firsts, [(offsets[i], offsets[i + 1]) for i in odd.tolist()])
    ends = np.append(begin, offsets[-1]).astype(np.int64)
    coded = pa.Array.from_buffers(pa.large_binary(), len(begin), [None, pa.py_buffer(ends), data]).dictionary_encode()
    at = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    bounds = np.searchsorted(begin, offsets)
    return Words(coded.dictionary.to_numpy(zero_copy_only=False).tolist(), np.unique(at[bounds[odd]]).tolist(), at, bounds)


class Table:
    """Ids, as bytes, of the words met lately: two generations, the younger of about ``size`` words."""

    def __init__(self, size: int):
        self.size = size
        self.clear()

    def clear(self) -> None:
        self.young: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}

    def look_up(self, found: list[bytes], encode) -> list[bytes]:
        """Ids of each of the distinct words ``found``; ``encode`` gives those of the ones not held, all at once."""
        young, old = self.young.get, self.old.get
        out = [young(w) or old(w) for w in found]
        new = [k for k, ids in enumerate(out) if ids is None]
        for k, ids in zip(new, encode([found[k] for k in new])):
            out[k] = ids
        if len(self.young) + len(new) > self.size:
            self.old, self.young = self.young, {}
        self.young.update(zip(found, out))
        return out


def id_flow(found: Words, raw: list[bytes], kind: np.dtype) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts one after the other, and where each text's begin (and the end), from the ids of the distinct words."""
    size = np.fromiter(map(len, raw), np.int64, len(raw)) // kind.itemsize
    table, first = np.frombuffer(b"".join(raw), kind), np.cumsum(size) - size
    each = size[found.at]
    ends = np.cumsum(each)
    ids = table[np.repeat(first[found.at] - ends + each, each) + np.arange(ends[-1] if len(ends) else 0)]
    return ids, np.concatenate([[0], ends])[found.bounds]
