"""Language identification with a string kernel.

Blended-spectrum presence kernel: the number of letter n-grams (n = 1 to 3, words bounded by spaces) that
two texts have in common, over the geometric mean of the two numbers present. Landmarks, a few sampled
texts, give Nyström features K(x, landmarks) W^-1/2, and one ridge regression per language is solved on
them. As only landmark n-grams can be shared with a landmark, texts are held against those alone; the
scores of a batch are two matrix products.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import checked_broadcast, read_table, ship, spread, text_key
from .words import portions

ORDERS = (1, 2, 3)
#: Training rows per language, and of all languages together, which share them evenly where there are many (one row
#: each at least); landmarks, one per language at least. Longer texts are landmarks only where a language has no
#: others, so the landmark n-grams stay few.
PER_LANGUAGE, TRAIN_ROWS, LANDMARKS, LANDMARK_CHARS = 150, 9_600, 96, 20_000
RIDGE, TABLE_BITS = 1e-3, 20
#: Score from which a text counts as identified.
MIN_SCORE = 0.5
UNKNOWN = "und"
#: Code of the blank alone, which all texts have.
BLANK = np.uint64(1 << 20 | 32)
_LETTER: list[np.ndarray] = []


def _is_letter() -> np.ndarray:
    if not _LETTER:
        _LETTER.append(np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000))
    return _LETTER[0]


def _codes(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Code points of lower-cased texts with all but letters blank, a blank around each; their rows; letters per text."""
    parts = [f" {(t or '').lower()} ".encode("utf-32-le", "replace") for t in texts]
    flat = np.frombuffer(b"".join(parts), "<u4")
    rows = np.repeat(np.arange(len(texts)), [len(p) // 4 for p in parts])
    letter = _is_letter()[flat]
    return np.where(letter, flat, 32).astype(np.uint64), rows, np.bincount(rows[letter], minlength=len(texts))


def _grams(codes: np.ndarray, rows: np.ndarray):
    """Per order: a 64-bit code of each n-gram that lies within one text, and its row."""
    for n in ORDERS:
        size = len(codes) - n + 1
        if size <= 0:
            continue
        gram = np.full(size, n, np.uint64)
        for i in range(n):
            gram = gram << np.uint64(20) | (codes[i : i + size] & np.uint64(0xFFFFF))
        inside = rows[:size] == rows[n - 1 :]
        yield gram[inside], rows[:size][inside]


def _slots(grams: np.ndarray, bits: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        h = grams * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(32)
        h *= np.uint64(0xD6E8FEB86659FD93)
    return (h >> np.uint64(64 - bits)).astype(np.int64)


def gram_table(grams: np.ndarray, bits: int | None = None) -> np.ndarray:
    """Slot -> place in ``grams`` (distinct), or -1; one whose slot is taken goes to the next free one."""
    bits = bits or max(TABLE_BITS, (4 * len(grams)).bit_length())
    table = np.full(1 << bits, -1, np.int32)
    left, slot = np.arange(len(grams)), _slots(grams, bits)
    while len(left):
        free = np.flatnonzero(table[slot] < 0)
        _, first = np.unique(slot[free], return_index=True)
        table[slot[free[first]]] = left[free[first]]
        rest = table[slot] != left
        left, slot = left[rest], (slot[rest] + 1) & (len(table) - 1)
    return table


def find_grams(table: np.ndarray, grams: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which of ``wanted`` are in the table (their positions), and their places in ``grams``."""
    slot = _slots(wanted, len(table).bit_length() - 1)
    at = np.arange(len(wanted))
    out_at, out = [], []
    while True:
        col = table[slot]
        met = col >= 0  # an empty slot ends the search
        at, slot, col = at[met], slot[met], col[met]
        same = grams[col] == wanted[at]
        out_at.append(at[same])
        out.append(col[same])
        if same.all():
            return np.concatenate(out_at), np.concatenate(out)
        at, slot = at[~same], (slot[~same] + 1) & (len(table) - 1)


@dataclass
class Model:
    langs: list[str]
    grams: np.ndarray  # landmark n-grams, by column
    table: np.ndarray  # slot -> column, or -1
    presence: np.ndarray  # landmarks x columns
    sizes: np.ndarray  # n-grams present in each landmark
    weights: np.ndarray  # landmarks+1 x languages; Nyström map and regressions in one

    def present(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Presence of the landmark n-grams in each whole text, and its number of letters."""
        codes, rows, letters = _codes(texts)
        width = len(self.grams)
        found = np.zeros((len(texts), width), np.float32)
        flat = found.reshape(-1)
        for gram, row in _grams(codes, rows):
            at, col = find_grams(self.table, self.grams, gram)
            flat[row[at] * width + col] = 1
        return found, letters

    def kernel(self, found: np.ndarray) -> np.ndarray:
        return found @ self.presence.T / np.sqrt(np.maximum(found.sum(1), 1))[:, None] / self.sizes

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        """Language and score (0 to 1) of each whole text; ``und`` and 0 without a letter. Of equal margins, the first language."""
        return self.judge(texts)[:2]

    def judge(self, texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """The same, and whether the text has any n-gram but the blank in common with a landmark: else the kernel says nothing."""
        found, letters = self.present(texts)
        k = self.kernel(found)
        margins = np.hstack([k, np.ones((len(k), 1), np.float32)]) @ self.weights
        best = margins.argmax(1)
        score = np.clip((margins[np.arange(len(best)), best] + 1) / 2, 0, 1)
        return [self.langs[b] if n else UNKNOWN for b, n in zip(best.tolist(), letters.tolist())], np.where(letters > 0, score, 0.0).astype(float), found[:, self.grams != BLANK].any(1)


def fit(texts: list[str], langs: list[str], landmarks: int = LANDMARKS) -> Model:
    """Solve the regressions on sampled rows. Landmarks are taken from the languages in turn."""
    names = sorted(set(langs))
    by = {n: sorted((t for t, x in zip(texts, langs) if x == n), key=lambda t: len(t) > LANDMARK_CHARS) for n in names}
    chosen, turn = [], 0
    while len(chosen) < min(landmarks, len(texts)) and turn < max(map(len, by.values())):
        chosen += [by[n][turn] for n in names if turn < len(by[n]) and (turn < 2 or len(by[n][turn]) <= LANDMARK_CHARS)]
        turn += 1
    codes, rows, _ = _codes(chosen)
    pairs = [np.unique(np.stack([g, r.astype(np.uint64)]), axis=1) for g, r in _grams(codes, rows)]
    gram, row = np.concatenate([p[0] for p in pairs]), np.concatenate([p[1] for p in pairs]).astype(int)
    grams = np.unique(gram)
    presence = np.zeros((len(chosen), len(grams)), np.float32)
    presence[row, np.searchsorted(grams, gram)] = 1
    model = Model(names, grams, gram_table(grams), presence, np.sqrt(np.maximum(presence.sum(1), 1)), np.zeros((0, 0)))
    values, vectors = np.linalg.eigh(model.kernel(presence).astype(float))
    keep = values > 1e-6 * max(values.max(), 1e-12)
    root = vectors[:, keep] / np.sqrt(values[keep])
    k = np.vstack([model.kernel(model.present(texts[i : i + 64])[0]) for i in range(0, len(texts), 64)])
    x = np.hstack([k @ root, np.ones((len(k), 1))])
    y = np.where(np.array(langs)[:, None] == np.array(names)[None], 1.0, -1.0)
    w = np.linalg.solve(x.T @ x + RIDGE * len(x) * np.eye(x.shape[1]) / x.shape[1], x.T @ y)
    model.weights = np.vstack([root @ w[:-1], w[-1:]]).astype(np.float32)
    return model


def held_out(doc_id) -> F.Column:
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(3)) == 1, F.lit(False))


def train(docs: DataFrame, per_language: int = PER_LANGUAGE, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model | None:
    """Fit on a sample: of each label the rows of smallest id hash that are not held out and have a letter,
    ``per_language`` of them, or an even share of ``TRAIN_ROWS`` where labels are many (one at least). Only their ids
    are ranked; so many texts reach the driver. Of rows that share an id and label, that of smallest text key counts,
    so training can be repeated. Null texts, labels and ids take no part. None if no row is left.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(lang_col).alias("lang"), F.col(text_col).alias("text")).where(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")) & F.col("text").rlike(r"\p{L}"))
    mark = F.xxhash64("doc_id")
    found = rows.agg(F.count_distinct("lang")).first()[0]
    if not found:
        return None
    per_language = max(1, min(per_language, TRAIN_ROWS // found))
    # A first share by hash range keeps the ranking small; all rows take part where that share is short of rows.
    ranked = rows.select("lang", "doc_id", mark.alias("mark"))
    chosen = ranked.withColumn("lot", F.pmod("mark", F.lit(64))).withColumn("r", F.row_number().over(Window.partitionBy("lang", "lot").orderBy("mark", "doc_id"))).where(F.col("r") <= per_language)
    chosen = chosen.withColumn("n", F.row_number().over(Window.partitionBy("lang").orderBy("mark", "doc_id"))).where(F.col("n") <= per_language).select("doc_id", "lang").distinct()
    sample = rows.join(checked_broadcast(chosen, found * per_language), ["doc_id", "lang"]).groupBy("doc_id", "lang").agg(F.min_by("text", F.struct(text_key(F.col("text")), "text")).alias("text")).orderBy("doc_id", "lang").collect()
    return fit([r.text for r in sample], [r.lang for r in sample])


def identify(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, lang_pred, score), a row for each row of ``docs``.

    Null, empty and letterless texts, and all texts without a model, are ``und`` with score 0. Rows may
    repeat and ids be null; an empty table gives no rows; other columns play no part.
    """
    spark = docs.sparkSession
    ship(spark)
    held = spark.sparkContext.broadcast(model)

    def run(batches):
        m = held.value
        most = max(1, 2_000_000 // max(1, len(m.grams))) if m else 1 << 30
        for batch in batches:
            langs, scores = [], []
            for part, _ in portions(batch.column(1), 500_000, most):
                got = m.predict(part.to_pylist()) if m else ([UNKNOWN] * len(part), np.zeros(len(part)))
                langs += got[0]
                scores.append(got[1])
            yield pa.record_batch([batch.column(0), pa.array(langs, pa.string()), pa.array(np.concatenate(scores) if scores else np.zeros(0))], names=["doc_id", "lang_pred", "score"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, lang_pred string, score double")


def keep_identified(docs: DataFrame, model: Model | None, text_col: str = "text", languages: set[str] | None = None, min_score: float = MIN_SCORE) -> DataFrame:
    """Rows of ``docs`` whose whole text is identified, with all their columns.

    A text goes if it is null, empty or has no letter, if it shares no n-gram with any landmark, or if its score is
    below ``min_score``: at one half the best margin changes its sign, and no language's regression claims the text. With
    ``languages``, one predicted to be of another language goes too. Without a model, having a letter decides. Repeated rows all stay or all go; an
    empty table gives no rows.
    """
    spark = docs.sparkSession
    ship(spark)
    held = spark.sparkContext.broadcast(model)
    at = docs.columns.index(text_col)

    def run(batches):
        m = held.value
        most = max(1, 2_000_000 // max(1, len(m.grams))) if m else 1 << 30
        for batch in batches:
            keep: list[bool] = []
            for part, _ in portions(batch.column(at), 500_000, most):
                texts = part.to_pylist()
                if m is None:
                    keep += (_codes(texts)[2] > 0).tolist()
                else:
                    langs, scores, held_against = m.judge(texts)
                    keep += [x != UNKNOWN and k and s >= min_score and (languages is None or x in languages) for x, s, k in zip(langs, scores.tolist(), held_against.tolist())]
            yield batch.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def op5_language(spark, sf_dir: str) -> DataFrame:
    docs = spread(read_table(spark, sf_dir, "documents"))
    return identify(docs, train(docs)).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
