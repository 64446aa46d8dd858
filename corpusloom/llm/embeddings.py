"""Near-duplicate embeddings by a subspace pigeonhole join.

Unit vectors with cosine c differ by the squared distance 2 - 2c. Vectors are rotated (one fixed random
rotation per length) and split into blocks; in at least one block a pair within the budget differs by no
more than the block's share of it. Each block is range-joined on a grid over its first coordinates with
cells twice as wide as the block's radius: a vector goes to its own cell, and to the later ones of those
within its radius. A pair found in several blocks is reported by the first. Candidates are verified
exactly, in double precision, on the stored vectors.

Equal vectors are joined once as a class. A cell with very many vectors is cut into chunks and each pair of
chunks is a task of its own, so nothing is dropped and no task has to hold a whole crowded cell.
"""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import connected_components, read_table, shared_dir, ship, spread, stored

COSINE, BLOCK = 0.95, 8
#: Vectors of a cell that are compared as one chunk; vectors per cell that the grid aims at.
CHUNK, CROWD = 20_000, 10_000
#: Rounding of the shipped half-precision vectors, per block and for the whole vector.
SLACK, SLACK_COS = 1e-3, 2e-3


@lru_cache(maxsize=8)
def rotation(dim: int) -> np.ndarray:
    """A fixed random rotation."""
    q, r = np.linalg.qr(np.random.default_rng(dim).normal(size=(dim, dim)))
    return q * np.sign(np.diag(r))


def block_bounds(dim: int, size: int = BLOCK) -> list[tuple[int, int]]:
    """Blocks of about ``size`` coordinates that cover ``dim``."""
    n = max(1, dim // size)
    cuts = [dim * i // n for i in range(n + 1)]
    return list(zip(cuts, cuts[1:]))


def _radius(dim: int, a: int, b: int, cosine: float) -> float:
    return math.sqrt(max(0.0, 2 - 2 * cosine) * (b - a) / dim)


_CELL = pa.schema([("dim", pa.int32()), ("block", pa.int32()), ("cell", pa.int64()), ("home", pa.bool_()), ("rep", pa.int64()), ("v", pa.binary())])
_CELL_DDL = "dim int, block int, cell long, home boolean, rep long, v binary"


def _hash_cells(cells: np.ndarray) -> np.ndarray:
    """A number for each row of grid coordinates; rows that share one by chance are compared and not linked."""
    h = np.zeros(len(cells), np.uint64)
    with np.errstate(over="ignore"):
        for col in cells.T:
            h = (h ^ (col.astype(np.int64).view(np.uint64) + np.uint64(0x9E3779B97F4A7C15))) * np.uint64(0xD6E8FEB86659FD93)
            h ^= h >> np.uint64(31)
    return h.view(np.int64)


def _placer(cosine: float, axes: int, size: int):
    def place(reps, vectors):
        dim = vectors.shape[1]
        unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
        turned = unit @ rotation(dim)
        packed = turned.astype(np.float16)
        data = np.array([x.tobytes() for x in packed], object)
        for k, (a, b) in enumerate(block_bounds(dim, size)):
            radius, g = _radius(dim, a, b, cosine) + SLACK, min(axes, b - a)
            width = 2 * radius
            at = turned[:, a : a + g] / width
            own = np.floor(at).astype(np.int64)
            # On each axis only the nearer neighbour is within half a cell.
            side = np.where(at - own < 0.5, -1, 1)
            off = np.where(side < 0, at - own, 1 - (at - own)) * width
            yield k, _hash_cells(own), True, reps, data
            for mask in range(1, 1 << g):
                axis = [i for i in range(g) if mask >> i & 1]
                near = (off[:, axis] ** 2).sum(1) <= radius * radius
                # Of a pair in two cells one is sent: the one whose cell comes first.
                near &= side[:, axis[0]] > 0
                if near.any():
                    cell = own[near].copy()
                    cell[:, axis] += side[near][:, axis]
                    yield k, _hash_cells(cell), False, reps[near], data[near]

    def run(batches):
        for batch in batches:
            reps = batch.column(0).to_numpy()
            lists = batch.column(1)
            sizes = np.diff(lists.offsets.to_numpy())
            values, starts = lists.values.to_numpy(zero_copy_only=False).astype(float), lists.offsets.to_numpy()[:-1]
            for dim in np.unique(sizes).tolist():
                rows = np.flatnonzero(sizes == dim)
                for some in np.array_split(rows, max(1, len(rows) // 2000)):
                    vectors = values[starts[some][:, None] + np.arange(dim)]
                    for k, cells, home, ids, data in place(reps[some], vectors):
                        n = len(ids)
                        yield pa.record_batch([pa.array(np.full(n, dim, np.int32)), pa.array(np.full(n, k, np.int32)), pa.array(cells), pa.array(np.full(n, home)), pa.array(ids), pa.array(data, pa.binary())], schema=_CELL)

    return run


def _compare(dim: int, block: int, left, right, cosine: float, size: int, same: bool) -> list[tuple[np.ndarray, np.ndarray]]:
    """Candidates between two chunks of a cell; sent-sent pairs are left to their home cells."""
    bounds = block_bounds(dim, size)
    limits = [(a, b, _radius(dim, a, b, cosine)) for a, b in bounds]
    (ids1, home1, v1), (ids2, home2, v2) = left, right
    a, b, radius = limits[block]
    x, y = v1[:, a:b], v2[:, a:b]
    # One product gives |x|^2 + |y|^2 - 2xy; blocks of it stay in the processor's cache.
    x = np.hstack([x, np.ones((len(x), 1), np.float32), (x * x).sum(1, keepdims=True)])
    y = np.ascontiguousarray(np.hstack([-2 * y, (y * y).sum(1, keepdims=True), np.ones((len(y), 1), np.float32)]).T)
    out, most = [], np.float32((radius + SLACK) ** 2)
    found: list[tuple[np.ndarray, np.ndarray]] = []
    held = 0

    def settle():
        i, j = (np.concatenate(z) for z in zip(*found))
        ok = home1[i] | home2[j]
        if same:
            ok &= i < j
        i, j = i[ok], j[ok]
        p, q = v1[i], v2[j]
        good = np.einsum("ij,ij->i", p, q) >= cosine - SLACK_COS
        for c, e, r in limits[:block]:  # surely found in an earlier block
            low = p[:, c:e] - q[:, c:e]
            good &= np.einsum("ij,ij->i", low, low) > max(0.0, r - SLACK) ** 2
        one, two = ids1[i][good], ids2[j][good]
        out.append((np.minimum(one, two), np.maximum(one, two)))
        found.clear()

    wide = 1024
    for s in range(0, len(x), 256):
        rows = x[s : s + 256]
        for t in range(s // wide * wide if same else 0, y.shape[1], wide):
            near = np.flatnonzero(rows @ y[:, t : t + wide] <= most)
            if len(near):
                i, j = np.divmod(near, min(wide, y.shape[1] - t))
                found.append((i + s, j + t))
                held += len(near)
                if held > 200_000:
                    settle()
                    held = 0
    if found:
        settle()
    return out


def _joiner(cosine: float, size: int):
    def tile(key, cols):
        dim, block, _, low, high = key
        chunk, home, reps, data = cols
        v = np.frombuffer(b"".join(data), np.float16).reshape(-1, dim).astype(np.float32)
        pick = lambda c: tuple(x[chunk == c] for x in (reps, home, v))
        left = pick(low)
        return _compare(dim, block, left, left if low == high else pick(high), cosine, size, low == high)

    def run(batches):
        key, held = None, []

        def done():
            cols = [np.concatenate([h[i] for h in held]) for i in range(4)]
            if len(cols[0]) < 2:
                return
            for a, b in tile(key, cols):
                yield pa.record_batch([pa.array(a), pa.array(b)], names=["a", "b"])

        for batch in batches:
            keys = np.stack([batch.column(i).to_numpy().astype(np.int64) for i in range(5)])
            cols = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(5, 9)]
            ends = [0, *(np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(0)) + 1).tolist(), keys.shape[1]]
            for s, e in zip(ends, ends[1:]):
                new = tuple(keys[:, s].tolist()) if e > s else key
                if new != key and held:
                    yield from done()
                    held = []
                key = new
                if e > s:
                    held.append([c[s:e] for c in cols])
        if held:
            yield from done()

    return run


def candidates(classes: DataFrame, count: int, cosine: float = COSINE, size: int = BLOCK, chunk: int = CHUNK) -> DataFrame:
    """(a, b): pairs of ``classes`` (rep long, v array<double>; ``count`` rows) that hold all links, and few others."""
    axes = min(size, max(2, math.ceil(math.log(max(1, count) / CROWD) / math.log(2.5))))
    placed = classes.select("rep", "v").mapInArrow(_placer(cosine, axes, size), _CELL_DDL)
    key = ["dim", "block", "cell"]
    placed = stored(placed, "cells")
    big = placed.groupBy(*key).count().where(F.col("count") > chunk).select(*key, F.ceil(F.col("count") / chunk).cast("long").alias("lots"))
    lots = F.coalesce("lots", F.lit(1).cast("long"))
    mine = F.pmod(F.xxhash64("rep"), lots)
    dealt = (
        placed.join(big, key, "left")
        .withColumn("chunk", mine)
        .withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), lots - 1)))
        .select(*key, F.least("chunk", "other").alias("low"), F.greatest("chunk", "other").alias("high"), "chunk", "home", "rep", F.col("v").alias("data"))
    )
    keys = [*key, "low", "high"]
    return dealt.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(_joiner(cosine, size), "a long, b long").distinct()


def near_vectors(vectors: DataFrame, cosine: float = COSINE, id_col: str = "vec_id", vector_col: str = "embedding", size: int = BLOCK, chunk: int = CHUNK) -> DataFrame:
    """(vec_id, n_links, component_id, kept), a row for each row of ``vectors``.

    Vectors that are null, empty or zero, hold null or non-finite components, or have no id link with
    nothing: n_links 0, and themselves as component. Vectors of different length do not link. Rows that
    repeat an id and its vector are vectors of their own and link. An empty table gives no rows; other
    columns play no part.
    """
    spark = vectors.sparkSession
    ship(spark)
    shared_dir(spark)
    raw = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v"))
    sound = F.col("vec_id").isNotNull() & F.coalesce(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0), F.lit(False))
    raw = raw.withColumn("v", F.when(sound, F.transform("v", lambda x: x + F.lit(0.0))))  # -0.0 becomes 0.0
    # Cosines do not depend on length: a power of two, which rounds nothing, brings the largest component near 1, so
    # that squares of very small and very large vectors neither vanish nor overflow.
    largest = F.array_max(F.transform("v", lambda x: F.abs(x)))
    distinct = raw.where("v is not null").groupBy("v").agg(F.min("vec_id").alias("rep"), F.count("*").alias("n"))
    classes = stored(distinct.withColumn("power", F.pow(F.lit(2.0), F.floor(F.log2(largest)))), "classes")
    # Rows that share an id may be the smallest of several classes: classes are numbered apart from their ids.
    classes = classes.withColumn("key", F.xxhash64("v", "rep")).withColumn("u", F.transform("v", lambda x: x / F.col("power")))
    found = candidates(classes.select(F.col("key").alias("rep"), F.col("u").alias("v")), classes.count(), cosine, size, chunk)
    one = classes.select(F.col("key").alias("a"), F.col("u").alias("va"), F.col("n").alias("na"))
    two = classes.select(F.col("key").alias("b"), F.col("u").alias("vb"), F.col("n").alias("nb"))
    zero = F.lit(0.0)
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p * q), zero, lambda s, p: s + p)
    close = dot("va", "vb") / (F.sqrt(dot("va", "va")) * F.sqrt(dot("vb", "vb"))) >= cosine
    links = found.join(one, "a").join(two, "b").where(close).select("a", "b", "na", "nb").checkpoint()
    ends = links.select(F.col("a").alias("key"), F.col("nb").alias("n")).union(links.select(F.col("b").alias("key"), F.col("na").alias("n")))
    degree = ends.groupBy("key").agg(F.sum("n").alias("others"))
    roots = connected_components(links.select("a", "b")).withColumnRenamed("node", "key")
    named = classes.join(degree, "key", "left").join(roots, "key", "left").withColumn("root", F.coalesce("root", "key"))
    least = named.groupBy("root").agg(F.min("rep").alias("component_id"))
    result = named.join(least, "root").select("v", (F.col("n") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"), "component_id")
    own = F.coalesce("component_id", "vec_id")
    return raw.join(result, "v", "left").select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), own.alias("component_id"), F.coalesce(F.col("vec_id") == own, F.lit(True)).alias("kept"))


def op8_embeddings(spark, sf_dir: str) -> DataFrame:
    return near_vectors(spread(read_table(spark, sf_dir, "embeddings")))


OP8_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= 0.95),
reach(a, b) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a),
comp AS (SELECT a AS vec_id, min(b) AS component_id FROM reach GROUP BY a),
deg AS (SELECT a AS vec_id, count(*) AS n FROM links GROUP BY a)
SELECT e.vec_id, CAST(coalesce(n, 0) AS BIGINT) AS n_links, component_id, e.vec_id = component_id AS kept
FROM embeddings e LEFT JOIN deg USING (vec_id) LEFT JOIN comp USING (vec_id)
"""
