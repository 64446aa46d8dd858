import random
import re

from corpusloom.llm import licenses as M


def brute(text):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    at = [(i, l) for l, p in M.BASE_PHRASES for i in range(len(w)) if w[i : i + len(p.split())] == p.split()]
    return len(w), len(at), min(at)[0] if at else None, max(at)[0] if at else None, ",".join(sorted({l for _, l in at}))


def test_base_columns_equal_brute_force(spark):
    mit = M.NOTICES[9][1]
    texts = [
        None, "", "MIT License", "mit license mit license, MIT-License", "the gnu general public licence", "GNU General Public License x GNU general public",
        "cc by cc by cc", "CC BY " * 500 + "apache license", "É cc é by", mit, "see " + mit.replace("charge", "charge or fee"), "apache license apache", "cc, by: mit; license",
    ]
    rows = [(i, t) for i, t in enumerate(texts)] + [(3, texts[3]), (3, "mit license"), (None, "cc by")]
    df = spark.createDataFrame([(a, b, "l", 5) for a, b in rows], "doc_id long, text string, label string, p int")
    got = M.license_scan(df).collect()
    assert sorted([(r.doc_id, *tuple(r)[1:6]) for r in got], key=str) == sorted([(a, *brute(b)) for a, b in rows], key=str)
    by = {r.doc_id: r for r in got}
    assert by[9].labels == "mit" and by[9].score == 1.0 and by[9].base_labels == ""
    assert by[10].labels == "mit" and M.MIN_COVER <= by[10].score < 1
    assert by[0].labels == "" and by[0].score == 0.0
    assert M.license_scan(df.limit(0)).count() == 0


def brute_spans(text):
    """(label, score) of all spans that hold, word by word."""
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    out = [(label, 1.0) for _, label in [(i, n) for n, p in M.BASE_PHRASES for i in range(len(w)) if w[i : i + len(p.split())] == p.split()]]
    for label, phrase in M.NOTICES:
        p = phrase.split()
        lines = {}
        for i in range(len(w) - 3):
            for j in range(len(p) - 3):
                if w[i : i + 4] == p[j : j + 4]:
                    lines.setdefault(i - j, set()).add(j)
        island, last = set(), None
        for diag in sorted(lines) + [None]:
            if last is not None and (diag is None or diag - last > M.MAX_SHIFT):
                if len(island) / (len(p) - 3) >= M.MIN_COVER:
                    out.append((label, len(island) / (len(p) - 3)))
                island = set()
            if diag is not None:
                island |= lines[diag]
            last = diag
    return ",".join(sorted({n for n, _ in out})), max([s for _, s in out], default=0.0)


def test_labels_and_score_equal_brute_force(spark):
    """Notices with words lost, added and changed, repeated, and cut off."""
    rng = random.Random(3)
    texts = []
    for _ in range(120):
        words = []
        for _ in range(rng.randint(0, 3)):
            w = rng.choice(M.NOTICES)[1].split()
            for _ in range(rng.randint(0, 5)):
                k = rng.randrange(len(w))
                w[k : k + rng.randint(0, 1)] = rng.choice([[], ["extra"], ["more", "words"], [w[k]]])
            words += w[: rng.randint(1, len(w))] + [rng.choice(["and", "mit license", "x"])] * rng.randint(0, 9)
        texts.append(" ".join(words))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: (r.labels, round(r.score, 9)) for r in M.license_scan(df).collect()}
    assert got == {i: (brute_spans(t)[0], round(brute_spans(t)[1], 9)) for i, t in enumerate(texts)}
    assert len({x for x, _ in got.values()}) > 10


def test_spans(spark):
    text = "one two three " + M.NOTICES[1][1] + " end"
    s = M.license_spans(spark.createDataFrame([(1, text)], "doc_id long, text string")).first().spans
    long = [x for x in s if not x.is_base]
    assert [(x.label, x.first_word, x.last_word, x.cover) for x in long] == [("apache", 3, 2 + len(M.NOTICES[1][1].split()), 1.0)]
