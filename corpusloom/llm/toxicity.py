"""Toxicity by a classifier chain of linear models.

Categories are predicted in a fixed order; each logistic model sees the features of a text and the
probabilities of the categories before it. For training, those probabilities come from models that saw
neither the row nor a copy of it (out of fold, folds by text, features chosen anew in each), so later models
learn from what they will meet. First come the other labelled columns (quality), then kinds of toxicity, last the
toxic label itself. Kinds are found in the labelled rows: the toxic ones are grouped by the features that tell toxic rows
apart, and each group is a category, named by the word that marks it best.

Features say whether a word, or the first letters of longer words, occur anywhere in the whole text, once or more often;
the ones that tell the toxic label apart best are kept. The threshold is the one of best F1 over the
out-of-fold predictions, in the middle of the gap around it.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import read_table, ship, spread, text_key
from .words import portions

#: Labelled rows used for training at most, half of them toxic where there are so many; features; folds.
TRAIN_ROWS, FEATURES, FOLDS = 4_000, 700, 3
#: A feature is in at least so many training rows; letters of a stem.
LEAST_ROWS, STEMS = 3, (4, 5)
#: Kinds of toxicity that are told apart, and rounds of their grouping at most.
KINDS, KIND_ROUNDS = 3, 20
_WORD = re.compile(r"\w+")


def features(text: str | None) -> set[str]:
    """Words of a whole text in lower case, stems ``abcd-`` of longer ones, and ``abcd=`` of stems met twice or more."""
    counts = Counter(_WORD.findall((text or "").lower()))
    out = set(counts)
    for n in STEMS:
        stems: dict[str, int] = {}
        for w, c in counts.items():
            if len(w) > n:
                s = w[:n]
                stems[s] = stems.get(s, 0) + c
        out.update([s + "-" for s in stems])
        out.update([s + "=" for s, c in stems.items() if c > 1])
    return out


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _logistic(x: np.ndarray, y: np.ndarray, l2: float = 2e-4, steps: int = 80) -> np.ndarray:
    """Weights and bias of a class-balanced logistic regression, by accelerated gradient steps."""
    n, pos = max(1, len(y)), max(1, y.sum())
    c = np.where(y > 0, n / (2 * pos), n / (2 * max(1, n - pos))).astype(np.float32) / n
    x1 = np.hstack([x, np.ones((n, 1), np.float32)])
    v = np.ones(x1.shape[1], np.float32) / math.sqrt(x1.shape[1])
    for _ in range(10):  # largest curvature
        v = x1.T @ (c * (x1 @ v))
        norm = float(np.linalg.norm(v)) or 1.0
        v /= norm
    rate = 1 / (norm / 4 + l2)
    w = look = np.zeros(x1.shape[1], np.float32)
    for k in range(steps):
        grad = x1.T @ (c * (_sigmoid(x1 @ look) - y)) + l2 * np.append(look[:-1], 0)
        new = look - rate * grad
        look = new + k / (k + 3) * (new - w)
        w = new
    return w


@dataclass
class Chain:
    categories: list[str]
    vocabulary: dict[str, int]
    weights: list[np.ndarray]  # of each category: features, earlier categories, bias
    threshold: float

    @cached_property
    def table(self) -> np.ndarray:
        """Weights by feature and category; a last row of zeros."""
        n = len(self.vocabulary)
        return np.vstack([np.stack([w[:n] for w in self.weights], 1), np.zeros((1, len(self.weights)))])

    def probabilities(self, texts: list[str | None]) -> np.ndarray:
        """Probabilities of each category for each whole text."""
        col, names, none = self.vocabulary, self.vocabulary.keys(), len(self.vocabulary)
        found = [[none, *(col[f] for f in features(text) & names)] for text in texts]
        if not found:
            return np.zeros((0, len(self.categories)))
        starts = np.cumsum([0, *map(len, found)])[:-1]
        sums = np.add.reduceat(self.table[np.concatenate(found)], starts, axis=0)
        out = np.zeros((len(texts), len(self.categories)))
        for k, w in enumerate(self.weights):
            out[:, k] = _sigmoid(sums[:, k] + out[:, :k] @ w[none : none + k] + w[-1])
        return out


def _chosen(counts: tuple[np.ndarray, np.ndarray], rows: tuple[int, int], rank: np.ndarray, most: int) -> np.ndarray:
    """Features that tell the label apart best, best first, from their rows with and without it; ties by ``rank``."""
    one, zero = counts
    p, n = max(1, rows[0]), max(1, rows[1])
    a, b = (one + 0.5) / (p + 1), (zero + 0.5) / (n + 1)
    gain = (a - b) * np.log(a / b)
    known = np.flatnonzero(one + zero >= LEAST_ROWS)
    return known[np.lexsort((rank[known], -gain[known]))][:most]


def group_kinds(x: np.ndarray, y: np.ndarray, words: list[str], kinds: int = KINDS) -> tuple[list[str], np.ndarray]:
    """Names and members (kinds by rows) of groups of the rows with a label, by the features ``words`` of ``x``.

    Features count as far as they are more frequent with the label than without. The first group begins at the row of
    most weight, each other at the row least like the groups before; then rows move to the group whose mean they are most
    like until none moves. Ties go to the first row or group. There are no more groups than rows that differ.
    """
    p, q = (x[y > 0].sum(0) + 0.5) / ((y > 0).sum() + 1), (x[y <= 0].sum(0) + 0.5) / ((y <= 0).sum() + 1)
    mine = np.flatnonzero(y > 0)
    z = x[mine] * np.maximum(np.log(p / q), 0)
    size = np.linalg.norm(z, axis=1)
    z = z / np.maximum(size, 1e-9)[:, None]
    chosen: list[int] = []
    while len(chosen) < kinds and len(mine):
        near = (z @ z[chosen].T).max(1) if chosen else 1 - size / max(size.max(), 1e-9)
        k = int(near.argmin())
        if chosen and near[k] > 1 - 1e-6:
            break
        chosen.append(k)
    centres, group = z[chosen], np.full(len(mine), -1)
    for _ in range(KIND_ROUNDS):
        new = (z @ centres.T).argmax(1) if chosen else group
        if (new == group).all():
            break
        group = new
        sums = np.array([z[group == k].sum(0) for k in range(len(chosen))])
        centres = sums / np.maximum(np.linalg.norm(sums, axis=1), 1e-9)[:, None]
    plain = [i for i, w in enumerate(words) if w[-1] not in "-="]
    member, names = np.zeros((len(chosen), len(y)), np.float32), []
    for k in range(len(chosen)):
        member[k, mine[group == k]] = 1
        lead = [i for i in plain if f"kind:{words[i]}" not in names]
        best = max(lead, key=lambda i: (float(centres[k][i]), -i), default=None)
        names.append(f"kind:{words[best] if best is not None else k}")
    return names, member


def fit_chain(texts: list[str], toxic: list[int], links: dict[str, list] | None = None, kinds: int = KINDS, folds: int = FOLDS, most: int = FEATURES) -> Chain:
    """Fit on labelled texts. ``links``: other labels that are predicted before, 0, 1 or None (unknown) for each text."""
    y, n = np.array(toxic, np.float32), len(texts)
    index: dict[str, int] = {}
    found = []
    for t in texts:  # features as numbers: the driver holds a few bytes for each
        found.append(np.array([index.setdefault(f, len(index)) for f in sorted(features(t))], np.int32))
    spelled = list(index)
    rank = np.empty(len(spelled), np.int64)
    rank[sorted(range(len(spelled)), key=spelled.__getitem__)] = np.arange(len(spelled))
    size, flat = np.array([len(f) for f in found], int), np.concatenate(found) if found else np.zeros(0, np.int32)
    fold = np.array([zlib.crc32(t.encode("utf-8", "replace")) % folds for t in texts])
    # Rows of each feature with and without the label, by fold.
    per = [[np.bincount(flat[np.repeat((fold == k) & ((y > 0) == side), size)], minlength=len(index)) for side in (True, False)] for k in range(folds)]
    total = [sum(p[s] for p in per) for s in (0, 1)]

    def matrix(out_of: int | None) -> tuple[np.ndarray, np.ndarray]:
        """Presence of the features chosen without a fold, for all rows."""
        counts = tuple(t if out_of is None else t - p for t, p in zip(total, per[out_of or 0]))
        inside = np.ones(n, bool) if out_of is None else fold != out_of
        best = _chosen(counts, (int((y[inside] > 0).sum()), int((y[inside] <= 0).sum())), rank, most)
        column = np.full(len(index), -1)
        column[best] = np.arange(len(best))
        x = np.zeros((n, len(best)), np.float32)
        rows, at = np.repeat(np.arange(n), size), column[flat]
        x[rows[at >= 0], at[at >= 0]] = 1
        return x, best

    x, best = matrix(None)
    kind_names, kind = group_kinds(x, y, [spelled[f] for f in best.tolist()], kinds)
    names = [*(links or {}), *kind_names, "toxic"]
    targets = [*(np.array([np.nan if v is None else v for v in vs], np.float32) for vs in (links or {}).values()), *kind, y]
    parts = [matrix(k)[0] for k in range(folds)]
    before, weights = np.zeros((n, 0), np.float32), []
    for t in targets:
        known = ~np.isnan(t)
        weights.append(_logistic(np.hstack([x, before])[known], t[known]))
        unseen = np.zeros(n, np.float32)
        for k in range(folds):
            z, train = np.hstack([parts[k], before]), known & (fold != k)
            w = _logistic(z[train], t[train])
            unseen[fold == k] = _sigmoid(z[fold == k] @ w[:-1] + w[-1])
        before = np.hstack([before, unseen[:, None]])
    return Chain(names, {spelled[f]: i for i, f in enumerate(best.tolist())}, weights, best_threshold(before[:, -1], y))


def best_threshold(p: np.ndarray, y: np.ndarray) -> float:
    """Of best F1, of equal ones the highest; halfway between the probabilities on its two sides."""
    order = np.argsort(-p, kind="stable")
    hits = np.cumsum(y[order])
    f1 = 2 * hits / (np.arange(1, len(y) + 1) + y.sum())
    ranked = p[order]
    f1[:-1][ranked[:-1] == ranked[1:]] = -1  # equal probabilities stay on one side
    k = int(f1.argmax())
    return float((ranked[k] + (ranked[k + 1] if k + 1 < len(ranked) else 0)) / 2)


def train(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", link_cols: tuple = ("quality",)) -> Chain | None:
    """Fit on at most ``rows`` labelled texts, those of smallest id hash of each class; None without both classes.

    Those of ``link_cols`` that ``labels`` has come first in the chain; an unknown one is left out of that model
    alone. Of several labels of a document the largest counts, and of rows that share an id the text of smallest
    key, so training can be repeated. Null ids, texts and labels take no part.
    """
    links = [c for c in link_cols if c in labels.columns]
    named = {f"l{i}": F.max(F.col(c).cast("int")).alias(f"l{i}") for i, c in enumerate(links)}
    marked = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull()).groupBy(F.col(id_col).alias("doc_id")).agg(F.max(F.col(label_col).cast("int")).alias("y"), *named.values())
    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).where("doc_id is not null and text is not null")
    known = marked.join(texts.select("doc_id").distinct(), "doc_id", "left_semi").withColumn("mark", F.xxhash64("doc_id"))
    chosen = known.where("y > 0").orderBy("mark", "doc_id").limit(rows // 2).union(known.where("y <= 0").orderBy("mark", "doc_id").limit(rows - rows // 2))
    one = texts.join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "mark", "y", *named).agg(F.min_by("text", F.struct(text_key(F.col("text")), "text")).alias("text"))
    got = one.orderBy("mark", "doc_id").select("text", "y", *named).collect()
    y = [int(r.y > 0) for r in got]
    return fit_chain([r.text for r in got], y, {c: [r[k] for r in got] for c, k in zip(links, named)}) if 0 < sum(y) < len(y) else None


def _judge(chain: Chain | None, column: pa.Array) -> np.ndarray:
    """Probabilities of each category for a text column, a few MB at a time; 0 for null and empty texts."""
    out = []
    for part, _ in portions(column, 4_000_000):
        texts = part.to_pylist()
        got = chain.probabilities(texts) if chain else np.zeros((len(texts), 1))
        got[[not t for t in texts]] = 0
        out.append(got)
    return np.concatenate(out) if out else np.zeros((0, 1))


def score(docs: DataFrame, chain: Chain | None, threshold: float | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, toxic, score, categories), a row for each row of ``docs``; score: probability of the last category.

    A text is toxic from ``threshold`` on, by default the chain's own; equal scores are judged alike. ``categories``
    names the kinds, and the label, that reach the threshold too.
    Null and empty texts, and all texts without a chain, have score 0 and are not toxic. Rows may repeat and
    ids be null; an empty table gives no rows; other columns play no part.
    """
    spark = docs.sparkSession
    ship(spark)
    held = spark.sparkContext.broadcast(chain)

    def run(batches):
        c = held.value
        limit = 1.0 if c is None else c.threshold if threshold is None else threshold
        shown = [k for k, n in enumerate(c.categories) if n.startswith("kind:") or n == "toxic"] if c else []
        for batch in batches:
            p = _judge(c, batch.column(1))
            total = p[:, -1]
            kinds = [",".join([c.categories[k] for k in shown if r[k] >= limit]) for r in p] if c else [""] * len(p)
            yield pa.record_batch([batch.column(0), pa.array(total >= limit), pa.array(total), pa.array(kinds, pa.string())], names=["doc_id", "toxic", "score", "categories"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, toxic boolean, score double, categories string")


def keep_clean(docs: DataFrame, chain: Chain | None, text_col: str = "text") -> DataFrame:
    """Rows of ``docs`` that the chain does not call toxic, with all their columns.

    Null and empty texts stay, and so do all without a chain. Repeated rows all stay or all go. An empty table
    gives no rows.
    """
    spark = docs.sparkSession
    ship(spark)
    held = spark.sparkContext.broadcast(chain)
    at = docs.columns.index(text_col)

    def run(batches):
        c = held.value
        for batch in batches:
            yield batch if c is None else batch.filter(pa.array(_judge(c, batch.column(at))[:, -1] < c.threshold))

    return docs.mapInArrow(run, docs.schema)


def op3_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = spread(read_table(spark, sf_dir, "documents"))
    return score(docs, train(docs, read_table(spark, sf_dir, "labels")))
