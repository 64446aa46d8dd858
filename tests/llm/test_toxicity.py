import random
import zlib

import numpy as np

from corpusloom.llm import toxicity as M

PLAIN = ["thand", "ering", "ouble", "nthe", "tion", "ander", "hent", "estra"]
BAD = ["idiot", "scum", "stupid", "moron", "loweichen", "loweitz"]


def made(n, seed):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        w = [rng.choice(PLAIN) + rng.choice(PLAIN) for _ in range(rng.randint(5, 200))]
        y = int(rng.random() < 0.2)
        for _ in range(2 * y):
            w[rng.randrange(len(w))] = rng.choice(BAD)
        rows.append((i, " ".join(w), y))
    return rows


def test_held_out_and_chain():
    train, held = made(900, 1), made(500, 2)
    c = M.fit_chain([t for _, t, _ in train], [y for _, _, y in train])
    p = c.probabilities([t for _, t, _ in held])
    y = np.array([y for _, _, y in held])
    assert ((p[:, -1] >= c.threshold) == y).mean() > 0.99
    assert len(c.categories) == 4 and c.categories[-1] == "toxic" and all(k.startswith("kind:") for k in c.categories[:-1])
    # Each model takes the probabilities of the ones before it.
    assert [len(w) - len(c.vocabulary) - 1 for w in c.weights] == [0, 1, 2, 3] and np.abs(c.weights[-1][len(c.vocabulary) : -1]).max() > 0.01
    # A kind holds part of the toxic rows, and they are found again in rows that were not seen.
    kinds = p[:, :-1] >= 0.5
    assert (kinds.any(1) == (y > 0)).mean() > 0.97 and all(0 < kinds[:, k].sum() < y.sum() for k in range(3))


def test_kinds():
    """Rows of three vocabularies fall into three groups named after them; noise and clean rows don't matter."""
    rng = random.Random(6)
    marks = [["xaaa", "xaab"], ["xbbb", "xbbc"], ["xccc", "xccd"]]
    rows = [(k, " ".join([*(rng.choice(PLAIN) for _ in range(20)), *marks[k]]) if k < 3 else " ".join(rng.choice(PLAIN) for _ in range(20))) for k in (rng.randrange(6) for _ in range(200))]
    words = sorted(set().union(*(M.features(t) for _, t in rows)))
    x, y = np.array([[w in M.features(t) for w in words] for _, t in rows], np.float32), np.array([k < 3 for k, _ in rows], np.float32)
    names, member = M.group_kinds(x, y, words)
    assert sorted(n[:7] for n in names) == ["kind:xa", "kind:xb", "kind:xc"]
    for name, row in zip(names, member):
        assert {i for i, r in enumerate(rows) if r[0] == "abc".index(name[6])} == set(np.flatnonzero(row))
    assert M.group_kinds(x[:0], y[:0], words)[1].shape == (0, 0)
    same = np.repeat(x[y > 0][:1], 5, 0)
    assert len(M.group_kinds(np.vstack([same, x[y == 0]]), np.array([1] * 5 + [0] * int((y == 0).sum())), words)[0]) == 1


def test_learner_is_near_the_optimum():
    """The loss of the balanced regression against Newton's steps, written anew."""
    rng = np.random.default_rng(3)
    x = (rng.random((300, 12)) < 0.3).astype(np.float32)
    y = (x[:, 0] + x[:, 1] - x[:, 2] + 0.3 * rng.normal(size=300) > 0.7).astype(np.float32)
    n, pos, l2 = len(y), y.sum(), 2e-4
    c = np.where(y > 0, n / (2 * pos), n / (2 * (n - pos))) / n
    x1, w = np.hstack([x, np.ones((n, 1))]).astype(float), np.zeros(13)
    reg = l2 * np.diag([1.0] * 12 + [0])

    def loss(w):
        return float(np.sum(c * np.logaddexp(0, -(2 * y - 1) * (x1 @ w))) + 0.5 * w @ reg @ w)

    for _ in range(60):
        q = 1 / (1 + np.exp(-x1 @ w))
        w = w - np.linalg.solve(x1.T @ ((c * q * (1 - q))[:, None] * x1) + reg + 1e-9 * np.eye(13), x1.T @ (c * (q - y)) + reg @ w)
    assert loss(w) <= loss(M._logistic(x, y).astype(float)) + 1e-9 < loss(w) + 0.01 < loss(np.zeros(13))


def test_threshold_is_best():
    rng = random.Random(5)
    for _ in range(200):
        p = np.array([rng.choice((0.1, 0.2, 0.4, 0.4, 0.7, 0.9)) for _ in range(rng.randint(1, 9))])
        y = np.array([rng.randint(0, 1) for _ in p])
        if not y.sum():
            continue

        def f1(t):
            g = p >= t
            return 2 * (g & (y > 0)).sum() / (g.sum() + y.sum())

        best = M.best_threshold(p, y)
        assert f1(best) == max(map(f1, p)) and best > max([t for t in p if t < best and f1(t) < f1(best)], default=0)


def brute_chain(texts, toxic, links, kinds, folds, most):
    """The chain on dense matrices, with each step written out."""
    found = [M.features(t) for t in texts]
    y = np.array(toxic, np.float32)
    fold = np.array([zlib.crc32(t.encode()) % folds for t in texts])

    def vocabulary(inside):
        p, n = max(1, sum(y[inside] > 0)), max(1, sum(y[inside] <= 0))
        gain = {}
        for f in set().union(*(found[i] for i in np.flatnonzero(inside))):
            one, zero = (sum(f in found[i] for i in np.flatnonzero(inside & ((y > 0) == s))) for s in (True, False))
            if one + zero >= M.LEAST_ROWS:
                a, b = (one + 0.5) / (p + 1), (zero + 0.5) / (n + 1)
                gain[f] = (a - b) * np.log(a / b)
        return sorted(gain, key=lambda f: (-gain[f], f))[:most]

    def matrix(words):
        return np.array([[f in s for f in words] for s in found], np.float32)

    targets = [np.array([np.nan if v is None else v for v in vs], np.float32) for vs in links.values()]
    words = vocabulary(np.ones(len(y), bool))
    names, members = M.group_kinds(matrix(words), y, words, kinds)
    targets += [*members, y]
    x, parts, before, weights = matrix(words), [matrix(vocabulary(fold != k)) for k in range(folds)], np.zeros((len(y), 0), np.float32), []
    for t in targets:
        known, unseen = ~np.isnan(t), np.zeros(len(y), np.float32)
        weights.append(M._logistic(np.hstack([x, before])[known], t[known]))
        for k in range(folds):
            z, train = np.hstack([parts[k], before]), known & (fold != k)
            w = M._logistic(z[train], t[train])
            unseen[fold == k] = (1 / (1 + np.exp(-np.clip(z @ w[:-1] + w[-1], -30, 30))))[fold == k]
        before = np.hstack([before, unseen[:, None]])
    return names, words, weights, M.best_threshold(before[:, -1], y)


def test_chain_equals_brute_force():
    rows = made(160, 8)
    texts, toxic = [t for _, t, _ in rows] + [rows[0][1]] * 3, [y for _, _, y in rows] + [rows[0][2]] * 3
    links = {"quality": [None if i % 7 == 0 else int(len(t) > 900) for i, t in enumerate(texts)]}
    c = M.fit_chain(texts, toxic, links, M.KINDS, 3, 40)
    names, words, weights, threshold = brute_chain(texts, toxic, links, M.KINDS, 3, 40)
    assert c.categories == ["quality", *names, "toxic"] and len(names) == 3 and list(c.vocabulary) == words
    assert all(np.allclose(a, b, atol=1e-3) for a, b in zip(c.weights, weights)) and abs(c.threshold - threshold) < 1e-3
    for t in [*texts[:5], None, "", "nothing known"]:  # one text at a time, model after model
        have, p = M.features(t), []
        for w in c.weights:
            z = sum(float(w[i]) for f, i in c.vocabulary.items() if f in have) + sum(float(a) * b for a, b in zip(w[len(words) : -1], p)) + float(w[-1])
            p.append(1 / (1 + np.exp(-max(-30, min(30, z)))))
        assert np.allclose(c.probabilities([t])[0], p, atol=1e-6)
    assert c.probabilities([]).shape == (0, 5)


def test_training_does_not_depend_on_row_order(spark):
    data = made(120, 4)
    rows = [(i, t) for i, t, _ in data] + [(3, "another text of the same id"), (3, None), (None, "x")]
    labels = spark.createDataFrame([(i, y, i % 2) for i, _, y in data] + [(3, 1, None)], "doc_id long, toxic int, quality int")
    one, two = (M.train(spark.createDataFrame(r, "doc_id long, text string").repartition(n), labels) for r, n in ((rows, 1), (rows[::-1], 5)))
    assert one.vocabulary == two.vocabulary and one.threshold == two.threshold and all((a == b).all() for a, b in zip(one.weights, two.weights))
    assert one.categories == two.categories and len(one.categories) == 5


def test_rows_and_edges(spark):
    data = made(400, 3)
    rows = [(i, t, 0.5) for i, t, _ in data] + [(900, None, 0.1), (901, "", 0.1), (902, "thand " * 50_000 + "scum", 0.1), (None, "idiot scum", 0.1), (5, data[5][1], 0.5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score double")
    labels = spark.createDataFrame([(i, y, 1) for i, _, y in data] + [(950, 1, 0), (None, 1, 0)], "doc_id long, toxic int, text int")
    chain = M.train(docs, labels)
    got = M.score(docs, chain).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got)
    by = {r.doc_id: r for r in got}
    assert not by[900].toxic and not by[901].toxic and by[900].score == 0 and by[902].toxic and by[None].toxic
    truth = dict((i, y) for i, _, y in data)
    assert np.mean([by[i].toxic == bool(truth[i]) for i in truth]) > 0.99
    kept = M.keep_clean(docs, chain)
    assert kept.columns == docs.columns and kept.count() == sum(not r.toxic for r in got)
    assert M.train(docs, labels.limit(0)) is None and M.score(docs, None).where("toxic").count() == 0
    assert M.score(docs.limit(0), chain).count() == 0
