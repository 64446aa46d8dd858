"""SimHash near-duplicates by a binary trie self-join.

Fingerprints are computed per batch with NumPy. Equal fingerprints collapse to one row before any pair
is looked for. The trie of the distinct fingerprints is walked by node pairs that start at a shared root:
each step splits both nodes at the next bit, adds one error where they went apart, and drops a pair of
nodes once its errors pass the budget. To walk it in parallel, the trie is built over K+1 rotations of the
64 bits: two fingerprints within K bits agree on the whole first (K+1)-th part of at least one rotation, so
each subtree below that prefix is a task of its own and no pair is lost. A subtree with very many
fingerprints is cut again at the next bits into pairs of smaller subtrees within the budget.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import connected_components, free_names, read_table, shared_dir, ship, spread, text_key

SHINGLE, SEED, MAX_BITS = 3, 42, 3
#: Fingerprints below one prefix that a task joins whole; beyond it the subtree is cut at CUT_BITS more bits.
SUBTREE, CUT_BITS = 100_000, 6
_LOW = np.uint64(0x0101010101010101)


def fingerprint_batch(texts: list[str | None], shingle: int = SHINGLE, seed: int = SEED) -> np.ndarray:
    """64-bit SimHash of each whole text as unsigned integers; a text without words has 0."""
    digest = xxhash.xxh64_intdigest
    out = np.zeros(len(texts), np.uint64)
    hashes: list[int] = []
    sizes, rows = [], []
    for row, text in enumerate(texts):
        found = text.encode("utf-8", "replace").lower().split() if text else []
        if not found:
            continue
        flat, n = b" ".join(found), max(1, len(found) - shingle + 1)
        if n == 1:
            hashes.append(digest(flat, seed))
        else:
            ends = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) + 1)
            starts = [0, *ends[: n - 1].tolist()]
            hashes += [digest(flat[a:b], seed) for a, b in zip(starts, (ends[shingle - 1 :] - 1).tolist())]
        sizes.append(n)
        rows.append(row)
    if rows:
        out[rows] = _vote(np.array(hashes, np.uint64), np.array(sizes))
    return out


def _vote(hashes: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Majority of each bit over consecutive runs of ``hashes``; a tie is 0."""
    ends = np.cumsum(sizes)
    cuts, first = [], []
    for a, b in zip((ends - sizes).tolist(), ends.tolist()):
        first.append(len(cuts))
        cuts.extend(range(a, b, 255))  # so many single bits fit a byte
    got = np.zeros(len(sizes), np.uint64)
    for shift in range(8):
        lanes = np.add.reduceat((hashes >> np.uint64(shift)) & _LOW, cuts).view(np.uint8).reshape(-1, 8)
        counts = np.add.reduceat(lanes.astype(np.int64), first, axis=0)
        for lane in range(8):
            got |= (2 * counts[:, lane] > sizes).astype(np.uint64) << np.uint64(8 * lane + shift)
    return got


def _fingerprints(batches):
    for batch in batches:
        texts, start = batch.column(1), 0
        parts = []
        while start < len(texts):  # a few MB of text at a time
            part, size = [], 0
            while start < len(texts) and size < 4_000_000:
                part.append(texts[start].as_py())
                size += len(part[-1] or "")
                start += 1
            parts.append(fingerprint_batch(part))
        fps = np.concatenate(parts) if parts else np.zeros(0, np.uint64)
        yield pa.record_batch([batch.column(0), batch.column(2), pa.array(fps.view(np.int64))], names=["doc_id", "tkey", "fp"])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, tkey, fp) for each row; tkey tells texts apart, fp holds the 64 bits as a signed long."""
    ship(docs.sparkSession)
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), text_key(F.col(text_col)).alias("tkey")).mapInArrow(_fingerprints, "doc_id long, tkey long, fp long")


class _Forest:
    """Union-find with labels that tell which ranges of the sorted fingerprints are one component already."""

    def __init__(self, n: int):
        self.up = list(range(n))
        self.refresh()

    def find(self, x: int) -> int:
        up = self.up
        while up[x] != x:
            up[x] = x = up[up[x]]
        return x

    def join(self, x: int, y: int) -> bool:
        x, y = self.find(x), self.find(y)
        if x == y:
            return False
        self.up[max(x, y)] = min(x, y)
        return True

    def refresh(self) -> None:
        roots = np.array(self.up, np.int64)
        while True:
            again = roots[roots]
            if (again == roots).all():
                break
            roots = again
        self.label = roots
        self.changes = np.concatenate([[0], np.cumsum(roots[1:] != roots[:-1])]) if len(roots) else np.zeros(0, np.int64)


def trie_edges(keys: np.ndarray, roots: np.ndarray, depth: int, budget: int = MAX_BITS, wide: int = 200_000) -> list[tuple[int, int]]:
    """Edges (positions in ``keys``) that connect all keys within ``budget`` bits below each pair of roots.

    ``keys``: unsigned, sorted within each root's range. ``roots``: rows (low1, high1, low2, high2, errors).
    Node pairs whose keys are all in one component already are dropped, as they can't add to it.
    """
    forest, edges, ones = _Forest(len(keys)), [], {}

    def cum(level: int) -> np.ndarray:
        if level not in ones:
            ones[level] = np.concatenate([[0], np.cumsum((keys >> np.uint64(63 - level)) & np.uint64(1))]).astype(np.int64)
        return ones[level]

    stack = [(depth, roots.astype(np.int64))]
    while stack:
        level, f = stack.pop()
        if len(f) > wide:
            half = len(f) // 2
            stack += [(level, f[:half]), (level, f[half:])]
            continue
        same = (f[:, 0] == f[:, 2]) & (f[:, 1] == f[:, 3])
        single = (f[:, 1] - f[:, 0] == 1) & (f[:, 3] - f[:, 2] == 1)
        f, same, single = f[~(same & single)], same[~(same & single)], single[~(same & single)]
        c, label = forest.changes, forest.label
        done = (c[f[:, 1] - 1] == c[f[:, 0]]) & (c[f[:, 3] - 1] == c[f[:, 2]]) & (label[f[:, 0]] == label[f[:, 2]])
        leaf = f[single & ~done]
        near = np.bitwise_count(keys[leaf[:, 0]] ^ keys[leaf[:, 2]]) <= budget
        added = 0
        for a, b in leaf[near][:, (0, 2)].tolist():
            if forest.join(a, b):
                edges.append((a, b))
                added += 1
        if added:
            forest.refresh()
        keep = ~single & ~done
        f, same = f[keep], same[keep]
        if not len(f) or level > 63:
            continue
        n = cum(level)
        mid1 = f[:, 1] - (n[f[:, 1]] - n[f[:, 0]])
        mid2 = f[:, 3] - (n[f[:, 3]] - n[f[:, 2]])
        l1, h1, l2, h2, e = f.T
        down = np.concatenate([
            np.stack([l1, mid1, l2, mid2, e], 1),
            np.stack([mid1, h1, mid2, h2, e], 1),
            np.stack([l1, mid1, mid2, h2, e + 1], 1),
            np.stack([mid1, h1, l2, mid2, e + 1], 1)[~same],
        ])
        down = down[(down[:, 0] < down[:, 1]) & (down[:, 2] < down[:, 3]) & (down[:, 4] <= budget)]
        if len(down):
            stack.append((level + 1, down))
    return edges


def _joiner(bands: int, budget: int):
    """Walks the subtrees of a partition; rows come sorted by rotation, prefix and cut."""
    width = 64 // bands

    def walk(cols: list[np.ndarray]):
        band, low, high, fp, cut = cols
        turn = (band * width).astype(np.uint64)
        raw = fp.view(np.uint64)
        key = (raw << turn) | np.where(turn == 0, np.uint64(0), raw >> (np.uint64(64) - np.maximum(turn, 1).astype(np.uint64)))
        order = np.lexsort((key, high, low, cut, (key >> np.uint64(64 - width)), band))
        band, low, high, cut, key, raw = (x[order] for x in (band, low, high, cut, key, raw))
        prefix = key >> np.uint64(64 - width)
        new = np.ones(len(key), bool)
        new[1:] = (band[1:] != band[:-1]) | (prefix[1:] != prefix[:-1]) | (low[1:] != low[:-1]) | (high[1:] != high[:-1]) | (cut[1:] != cut[:-1])
        starts = np.flatnonzero(new)
        ends = np.append(starts[1:], len(key))
        plain = cut[starts] == 0
        whole = np.stack([starts, ends, starts, ends, np.zeros_like(starts)], 1)[plain & (ends - starts > 1)]
        edges = trie_edges(key, whole, width, budget)
        for s, t in zip(starts[~plain].tolist(), ends[~plain].tolist()):
            a, b, bits = int(low[s]), int(high[s]), int(cut[s])
            sub = (key[s:t] >> np.uint64(64 - width - bits)) & np.uint64((1 << bits) - 1)
            mid = s + int(np.searchsorted(sub, b)) if a != b else t
            root = [s, t, s, t, 0] if a == b else [s, mid, mid, t, (a ^ b).bit_count()]
            edges += trie_edges(key, np.array([root]), width + bits, budget)
        at = np.array(edges, np.int64).reshape(-1, 2)
        return pa.record_batch([pa.array(raw[at[:, 0]].view(np.int64)), pa.array(raw[at[:, 1]].view(np.int64))], names=["a", "b"])

    def run(batches):
        held, size = [], 0
        for batch in batches:
            cols = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
            held.append(cols)
            size += len(cols[0])
            if size < 200_000:
                continue
            cols = [np.concatenate(x) for x in zip(*held)]
            last = np.stack([cols[0], cols[5], cols[1], cols[2]])
            change = np.flatnonzero((last[:, 1:] != last[:, :-1]).any(0))
            if len(change):  # the last subtree may go on in the next batch
                at = change[-1] + 1
                yield walk([x[:at] for x in cols[:5]])
                held, size = [[x[at:] for x in cols]], size - at
            else:
                held = [cols]
        if size:
            yield walk([np.concatenate(x) for x in zip(*held)][:5])

    return run


def near_links(distinct: DataFrame, budget: int = MAX_BITS, subtree: int = SUBTREE) -> DataFrame:
    """(a, b): links whose closure joins exactly the fingerprints within ``budget`` bits. ``distinct``: fp long, unique."""
    bands = 1 << budget.bit_length()  # a power of two above the budget
    width = 64 // bands
    turned = distinct.select(
        "fp", F.explode(F.array(*[F.struct(F.lit(i).alias("band"), (F.shiftrightunsigned(F.col("fp"), 64 - width * (i + 1)).bitwiseAND(F.lit((1 << width) - 1))).alias("prefix")) for i in range(bands)])).alias("x")
    ).select("fp", "x.band", "x.prefix")
    big = turned.groupBy("band", "prefix").count().where(F.col("count") > subtree).select("band", "prefix", F.lit(CUT_BITS).alias("bits"))
    masks = sorted(sum(1 << i for i in c) for k in range(budget + 1) for c in combinations(range(CUT_BITS), k))
    after = F.lit(0).cast("long")
    for i in range(bands):
        at = 64 - width * (i + 1) - CUT_BITS
        bits = F.shiftrightunsigned(F.col("fp"), at) if at >= 0 else F.shiftleft(F.col("fp"), -at).bitwiseOR(F.shiftrightunsigned(F.col("fp"), 64 + at))
        after = F.when(F.col("band") == i, bits.bitwiseAND(F.lit((1 << CUT_BITS) - 1))).otherwise(after)
    other = F.col("sub").bitwiseXOR(F.col("mask"))
    dealt = (
        turned.join(big, ["band", "prefix"], "left")
        .withColumn("sub", after)
        .withColumn("mask", F.explode(F.when(F.col("bits").isNull(), F.array(F.lit(0).cast("long"))).otherwise(F.array(*[F.lit(m).cast("long") for m in masks]))))
        .select(
            "band",
            F.when(F.col("bits").isNull(), F.lit(0).cast("long")).otherwise(F.least("sub", other)).alias("low"),
            F.when(F.col("bits").isNull(), F.lit(0).cast("long")).otherwise(F.greatest("sub", other)).alias("high"),
            "fp",
            F.coalesce("bits", F.lit(0)).alias("cut"),
            "prefix",
        )
    )
    keys = ["band", "prefix", "low", "high"]
    return dealt.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(_joiner(bands, budget), "a long, b long")


def _grouped(docs: DataFrame, id_col: str, text_col: str, budget: int) -> tuple[DataFrame, DataFrame]:
    """Fingerprints of all rows, and (fp, root, rep) of the distinct ones; rep: the smallest id of a fingerprint."""
    shared_dir(docs.sparkSession)
    fps = fingerprints(docs, id_col, text_col).checkpoint()
    distinct = fps.groupBy("fp").agg(F.min("doc_id").alias("rep")).checkpoint()
    roots = connected_components(near_links(distinct.select("fp"), budget))
    return fps, distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))


def simhash_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", budget: int = MAX_BITS) -> DataFrame:
    """(doc_id, fingerprint, component_id), a row for each row of ``docs``.

    Null and empty texts have fingerprint zero and link like any other. Repeated rows each come back.
    A null id comes back as null and is nobody's component id unless all ids of its component are null.
    An empty table gives no rows. Texts are read whole, of any length. Other columns of ``docs`` play no part.
    """
    fps, named = _grouped(docs, id_col, text_col, budget)
    smallest = named.groupBy("root").agg(F.min("rep").alias("component_id"))
    by_fp = named.select("fp", "root").join(smallest, "root").select("fp", "component_id")
    hexed = F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint")
    return fps.join(by_fp, "fp").select("doc_id", hexed, "component_id")


def keep_one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", budget: int = MAX_BITS) -> DataFrame:
    """One row of each near-duplicate group, with all its columns: the one of smallest id (null ids last).

    Of rows with that id, the one of smallest text key; of equal ones, any. Null and empty texts are a group
    like any other. An empty table gives no rows.
    """
    fps, named = _grouped(docs, id_col, text_col, budget)
    none, id_, key_ = key = free_names(docs, "_none", "_id", "_key")
    order = F.struct(F.col("doc_id").isNull().alias(none), F.coalesce("doc_id", F.lit(0).cast("long")).alias(id_), F.col("tkey").alias(key_))
    best = fps.groupBy("fp").agg(F.min(order).alias("first"))
    kept = best.join(named.select("fp", "root"), "fp").groupBy("root").agg(F.min("first").alias("first")).select("first.*")
    # Plain columns as keys, so that the rows dealt out for the join are not dealt out again to drop repeated ones.
    rows = docs.withColumns({none: F.col(id_col).isNull(), id_: F.coalesce(F.col(id_col), F.lit(0)).cast("long"), key_: text_key(F.col(text_col))})
    return rows.join(kept, key, "left_semi").dropDuplicates(key).drop(*key)


def op7_simhash(spark, sf_dir: str) -> DataFrame:
    return simhash_groups(spread(read_table(spark, sf_dir, "documents")))
