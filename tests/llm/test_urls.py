"""The URL filter against a model counted and applied URL by URL."""

import hashlib
import math
import random
import re
from collections import Counter

from corpusloom.llm import urls as M


def parts(url):
    m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", url or "")
    return (re.sub("[A-Z]", lambda x: x[0].lower(), m[1]), m[2]) if m else ("", "")


def rule(host, path):
    fits = [(len(h + p), h + p, v) for h, p, v in M.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fits)[1:] if fits else (None, None)


def grams(url):
    x = "\x02" * 4 + re.sub("[A-Z]", lambda x: x[0].lower(), url or "") + "\x03"
    return [x[i : i + 5] for i in range(len(x) - 4)]


def brute(rows):
    back = lambda u: hashlib.md5((u or "").encode()).hexdigest()[0] in "0123"
    fits = [rule(*parts(u)) for _, u in rows]
    counts = {"allow": Counter(), "block": Counter()}
    for (_, u), (_, v) in zip(rows, fits):
        if v and not back(u):
            counts[v].update(g[5 - k :] for g in grams(u) for k in range(1, 6))
    total = sum(n for c in counts.values() for g, n in c.items() if len(g) == 1)
    contexts = {v: Counter() for v in counts}
    for v, c in counts.items():
        for g, n in c.items():
            contexts[v][len(g), g[:-1]] += n
    learned = all(counts.values())

    def chance(v, g):
        if not g:
            return 1 / 256
        return (counts[v][g] + 4.0 * chance(v, g[1:])) / (contexts[v][len(g), g[:-1]] + 4.0)

    def diff(g):
        for k in range(5, 0, -1):
            s = g[5 - k :]
            if (counts["allow"][s] + counts["block"][s]) * 20_000 >= total and counts["allow"][s] + counts["block"][s]:
                return round((math.log(chance("allow", s)) - math.log(chance("block", s))) * 1e6)
        return 0

    found = [(sum(map(diff, grams(u))), len(grams(u))) for _, u in rows]
    bins = [max(-400, min(400, math.floor(t / n / 20_000))) for t, n in found]
    held = [(b, v == "allow") for b, (_, v), (_, u) in zip(bins, fits, rows) if v and back(u)]
    yes, no = sum(a for _, a in held), sum(not a for _, a in held)
    limit = min(range(-400, 402), key=lambda x: (-(sum(a and b >= x for b, a in held) * no + sum(not a and b < x for b, a in held) * yes), abs(x), x)) if yes and no else 0
    return [(i, *parts(u), r, v or ("allow" if not learned or b >= limit else "block"), t / n / 1e6 if learned else None, n) for (i, u), (r, v), b, (t, n) in zip(rows, fits, bins, found)]


def held(spark, rows):
    df = spark.createDataFrame([(i, u, "x", 1, 2) for i, u in rows], "page_id long, url string, host string, row long, total int")
    out = M.url_verdicts(df).collect()
    show = lambda r: (str(r[0]), *r[1:5], None if r[5] is None else f"{r[5]:.7f}", r[6])
    assert sorted(map(show, map(tuple, out)), key=str) == sorted(map(show, brute(rows)), key=str)
    return out


def test_equals_brute_force(spark):
    rng = random.Random(7)
    word = lambda: "".join(rng.choice("abcdehst") for _ in range(rng.randint(1, 6)))
    rows = [(i, f"{rng.choice(['http', 'HTTPS'])}://{rng.choice(['', 'www.', 'M.'])}{word()}.{rng.choice(['example.net', 'example.com', 'Example.ORG', 'net', 'org', 'de'])}/{rng.choice(['en', 'de', 'fr', ''])}/{word()}{rng.choice(['', '?q=' + word(), '#top'])}") for i in range(400)]
    odd = [None, "", "no scheme", "://", "http://net", "http://net/", "http://net?/", "http://sub.NET/x?y", "http://planet/", "http://example.net/en", "http://example.net/en/", "http://a.example.net/en/x", "http://org/fr/", "http://org/FR/",
           "http://example.com/de/://net/", "a\nb://c.net/\nd?e", "x://y\u00c9.net/\U0001f600/" + "z" * 3, "http://b.net#/"]
    rows += [(1000 + i, u) for i, u in enumerate(odd)] + [(7, rows[7][1]), (7, rows[7][1]), (None, rows[8][1]), (None, None)]
    out = held(spark, rows)
    assert {(r.rule is None, r.verdict) for r in out} == {(a, b) for a in (True, False) for b in ("allow", "block")}


def test_nothing_learned(spark):
    held(spark, [(1, "http://a.net/x"), (2, "http://b.com/x"), (3, None)])
    held(spark, [(1, "http://b.com/x")])
    empty = spark.createDataFrame([], "page_id long, url string")
    assert M.url_verdicts(empty).count() == 0


def test_limit():
    """Against every limit."""
    rng = random.Random(2)
    for _ in range(300):
        bins = sorted({rng.randint(-6, 6) for _ in range(rng.randint(0, 6))} | ({-400} if rng.random() < 0.1 else set()) | ({400} if rng.random() < 0.1 else set()))
        rows = [(b, rng.randint(0, 3), rng.randint(0, 3)) for b in bins]
        a, n = sum(x[1] for x in rows), sum(x[2] for x in rows)
        want = min(range(-400, 402), key=lambda t: (-(sum(x[1] for x in rows if x[0] >= t) * n + sum(x[2] for x in rows if x[0] < t) * a), abs(t), t)) if a and n else 0
        assert M.best_limit(rows) == want


def test_very_long_url(spark):
    rows = [(1, "http://a.net/" + "x" * 60_000), (2, "http://example.net/en/" + "y" * 60_000), (3, "http://z.com/" + "yx" * 60_000)]
    assert [r.places for r in sorted(held(spark, rows))] == [60_014, 60_023, 120_014]
