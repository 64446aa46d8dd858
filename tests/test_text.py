import random
import re

from pyspark.sql import functions as F

from corpusloom.functions import ids, text, urls

KINDS = [("email", r"[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,}"), ("phone", r"(?<!\d)(?:\+\d{1,3}[\s.\-]?)?(?:\(\d{3}\)|\d{3})[\s.\-]\d{3}[\s.\-]\d{4}(?!\d)"), ("handle", r"(?<![A-Za-z0-9._%+\-])@[A-Za-z0-9_]{2,30}\b"), ("digit_run", r"(?<!\d)\d{8,}(?!\d)")]


def brute_mask(t):
    found = sorted((m.start() - m.end(), m.start(), r, m.end(), k) for r, (k, p) in enumerate(KINDS) for m in re.finditer(p, t))
    kept = []
    for _, s, _, e, k in found:
        if all(e <= a or b <= s for a, b, _ in kept):
            kept.append((s, e, k))
    kept.sort()
    out = list(t)
    for s, e, _ in kept:
        out[s:e] = "#" * (e - s)
    return "".join(out), kept


def test_masks_equal_brute_force(spark):
    rng = random.Random(8)
    bits = ["a@b.example", "@some_one", "x@y", "(456) 555-2186", "+1 456.555.2186", "12345678", "123456789012", "456-555-21861", "é ü", "mail me at jo.e+x@mail6.example.org!", "@ab", "no", " ", "4565552186", "\n", "é@handle", "1@22.com"]
    rows = ["".join(rng.choice(bits) + rng.choice(["", " ", ",", "-"]) for _ in range(rng.randint(0, 8))) for _ in range(300)] + [""]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(rows)], "i int, t string")
    spans = text.pii_spans(F.col("t"))
    for r in df.select("t", spans.alias("s"), text.masked(F.col("t"), spans).alias("m")).collect():
        want, kept = brute_mask(r.t)
        assert r.m == want and [tuple(x) for x in r.s] == kept, r.t
        assert len(r.m) == len(r.t)


def one(spark, col, *values):
    df = spark.createDataFrame([values], ", ".join(f"c{i} string" for i in range(len(values))))
    return df.select(col(*[F.col(c) for c in df.columns])).first()[0]


def test_normal_forms(spark):
    assert one(spark, text.normalized, "  Ｆｕｌｌ Width \n ＴＥＸＴ ") == "full width text"
    assert one(spark, text.hash_form, "See HTTPS://x.example/a?b and www.y.example: “Hi”, there!") == "see and hi there"
    assert one(spark, lambda a, b: text.occurrences(a, b), "aaaa", "aa") == [0, 1, 2]
    assert one(spark, lambda a: text.split_list(a), " a; ;b;; c ") == ["a", "b", "c"]


def test_merge(spark):
    df = spark.sql("select cast(array(struct(5, 9), struct(0, 2), struct(8, 12), struct(12, 13), struct(20, 21)) as array<struct<start:int,stop:int>>) as s")
    assert [tuple(x) for x in df.select(text.merged(F.col("s"))).first()[0]] == [(0, 2), (5, 13), (20, 21)]


def test_urls(spark):
    assert one(spark, urls.url_key, " HTTPS://Ex.example/A/?b=2&utm_source=x&a=1#f ") == "https://ex.example/A?a=1&b=2"
    c = lambda u: one(spark, urls.canonical_url, u)
    assert c("https://youtu.be/abcdef123?si=1") == "https://youtube.com/watch?si=1&v=abcdef123"
    assert c("https://www.youtube.com/shorts/abcdef123/") == "https://youtube.com/watch?v=abcdef123"
    assert c("https://m.youtube.com/watch?v=abcdef123&lc=Z&utm_other=1") == "https://youtube.com/watch?lc=Z&v=abcdef123"
    assert c("http://old.reddit.com/r/x/comments/1a/b/?ref=q") == "http://reddit.com/r/x/comments/1a/b"
    assert one(spark, urls.video_id, "https://youtu.be/abcdef123") == "abcdef123"
    assert one(spark, urls.thread_id, "https://reddit.com/r/x/comments/1ab/t") == "1ab"


def test_order_free_hash(spark):
    a = spark.createDataFrame([(1, "x", "r1"), (2, None, "r1")], "k int, v string, run_id string")
    b = spark.createDataFrame([("r2", 2, None), ("r2", 1, "x")], "run_id string, k int, v string")
    h = lambda d: ids.artifact_hash(d, "k").first()[0]
    assert h(a) == h(b) != h(a.limit(1)) and h(a.limit(0))


def test_author_hash(spark):
    import hashlib
    import hmac

    got = one(spark, ids.author_hash("salt"), "p", " Name ")
    assert got == hmac.new(b"salt", b"p|Name", hashlib.sha256).hexdigest()[:16]
    assert one(spark, ids.author_hash("salt"), "p", "  ") is None


def test_occurrences_equal_brute_force(spark):
    rng = random.Random(9)
    rows = [("".join(rng.choice("ab\\E.é") for _ in range(rng.randint(0, 30))), "".join(rng.choice("ab\\E.é") for _ in range(rng.randint(0, 3)))) for _ in range(300)]
    df = spark.createDataFrame(rows, "t string, n string")
    for r in df.select("t", "n", text.occurrences(F.col("t"), F.col("n")).alias("o")).collect():
        assert r.o == ([i for i in range(len(r.t)) if r.t.startswith(r.n, i)] if r.n else []), (r.t, r.n)


def test_url_keys_equal_the_standard_library(spark):
    """Random queries, parsed and built by urllib, against the columns."""
    from urllib.parse import parse_qsl, urlencode, urlsplit, urlunsplit

    rng = random.Random(4)
    bits = ["a", "b", "A", "%20", "+", "%zz", "%C3%A9", "é", "/", "*", "~", "=", "&", "utm_source", "ref", "=", "&", "%26", "q", "-", ".", ":"]
    rows = [f"{rng.choice(['HTTP://', 'https://', '//', ''])}{rng.choice(['S.Example', 'x.example:80', ''])}{rng.choice(['', '/', '/p/', '/p//', 'p/q', '/a b'])}?{''.join(rng.choice(bits) for _ in range(rng.randint(0, 12)))}{rng.choice(['', '#f', '#'])}" for _ in range(400)]

    def key(url):
        p = urlsplit(url.strip())
        query = urlencode(sorted((k, v) for k, v in parse_qsl(p.query, keep_blank_values=True) if k.lower() not in urls.TRACKING))
        path = p.path.rstrip("/") if len(p.path) > 1 and p.path.endswith("/") else p.path
        return urlunsplit((p.scheme.lower(), p.netloc.lower(), path, query, ""))

    got = spark.createDataFrame([(r,) for r in rows], "u string").select("u", urls.url_key(F.col("u")).alias("k")).collect()
    wrong = [(r.u, r.k, key(r.u)) for r in got if r.k != key(r.u)]
    assert not wrong, wrong[:5]


def test_personal_data_in_other_digits(spark):
    rows = ["call (٤١٥) ٥٥٥ ٠١٢٣ now", "id ١٢٣٤٥٦٧٨٩ here", "call 415\u00a0555\u00a00123", "@name\u00e9x and @abc", "12345678a"]
    got = spark.createDataFrame([(i, t) for i, t in enumerate(rows)], "i int, t string").select("i", "t", text.pii_spans(F.col("t")).alias("s")).orderBy("i").collect()
    assert [[(r.t[x.start : x.stop], x.kind) for x in r.s] for r in got] == [[("(٤١٥) ٥٥٥ ٠١٢٣", "phone")], [("١٢٣٤٥٦٧٨٩", "digit_run")], [("415\u00a0555\u00a00123", "phone")], [("@abc", "handle")], [("12345678", "digit_run")]]


def test_content_hash_tells_a_null_from_no_column(spark):
    a = spark.createDataFrame([(1, None)], "k int, v string")
    h = lambda d: ids.artifact_hash(d, "k").first()[0]
    assert h(a) != h(a.select("k")) and h(a) != h(a.withColumn("v", F.lit("null")))
    assert h(spark.createDataFrame([(1, 2.0)], "k int, v double")) == h(spark.createDataFrame([(1, 2)], "k int, v int"))
    assert h(a.union(a)) != h(a)


def test_simhash_holds_a_lot_of_shingles_at_a_time():
    """Long batches and one long text take little memory, and lots do not change a fingerprint."""
    import hashlib
    import random
    import tracemalloc

    rng = random.Random(3)
    words = [f"w{i}" for i in range(50)]
    made = lambda n: " ".join(rng.choices(words, k=n))
    texts = ["", None, "one", "one two", made(70000), *[made(rng.randrange(1, 900)) for _ in range(300)], made(text.LOT + 2), made(2 * text.LOT + 7)]

    def brute(t):
        w = t.split() if t else []
        hs = [int.from_bytes(hashlib.sha1(" ".join(w[i : i + 3]).encode()).digest()[:8]) for i in range(max(1, len(w) - 2) if w else 0)]
        return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))

    assert text.simhashes(texts).tolist() == [brute(t) for t in texts]
    many = [made(500) for _ in range(2000)]  # a million shingles
    tracemalloc.start()
    text.simhashes(many)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 40 << 20
