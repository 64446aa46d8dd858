"""URL filters: a few rules by host and path, and a character language-model ratio for all they leave open.

URLs that a rule accepts and those that a rule rejects each give a variable-order Markov model of characters. All of them
are counted, but for a quarter kept back by their own hash. A gram, a context of up to four characters and the next one,
is a node of the models' common suffix tree if it stands at no less than one in ``LEAST_SHARE`` of all counted places;
that is what makes the order variable, and it bounds each order to as many nodes, so the tables that are broadcast
have a proven size whatever the input. Each node's probability is smoothed by that of the next shorter context.

A URL's score is the difference of its two log-likelihoods for each place. The limit it is held against is calibrated on
the URLs kept back, over bins of scores. Differences of nodes are whole millionths, so sums don't depend on their order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import lower_ascii, read_table, spread, stored

# Fixed values: (host, path, verdict). A rule fits its host and all hosts below it.
RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))
START, END = "\x02", "\x03"
#: Longest gram: a context of four characters and the next one.
LONGEST = 5
LEAST_SHARE = 20_000
#: Weight of the shorter context's probability, and the characters among which the shortest one deals evenly.
BACKOFF, ALPHABET = 4.0, 256
#: Of 16 values of the first digit of a URL's MD5, those that are kept back for calibration.
KEPT_BACK = "0123"
#: Width of a bin in millionths, and the outermost bins.
BIN, LAST_BIN = 20_000, 400
_PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)"


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty for null or without ``://``."""
    return lower_ascii(F.regexp_extract(F.coalesce(url, F.lit("")), _PARTS, 1))


def path_of(url: Column) -> Column:
    """From the host's end up to ``?``, ``#`` or the end."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), _PARTS, 2)


def rule_of(host: Column, path: Column, rules=RULES) -> Column:
    """(rule, verdict) of the longest rule that fits, as a struct; null without one."""
    fits = []
    for h, p, verdict in sorted(rules, key=lambda r: (-len(r[0] + r[1]), r)):
        fit = ((host == h) | F.endswith(host, F.lit("." + h))) & F.startswith(path, F.lit(p))
        fits.append(F.when(fit, F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))))
    return F.coalesce(*fits)


def grams(url: Column) -> Column:
    """The gram of each character of a URL and of its end, in order."""
    chars = F.filter(F.split(F.concat(lower_ascii(url), F.lit(END)), ""), lambda c: c != "")

    def each(cs):  # the characters are a variable here, made once and not again for each gram
        at = lambda i, back: F.when(i < back, START).otherwise(F.get(cs, i - back))
        return F.transform(cs, lambda c, i: F.concat(*[at(i, k) for k in range(LONGEST - 1, 0, -1)], c))

    return F.get(F.transform(F.array(chars), each), F.lit(0))


def suffix_tree(counts: DataFrame, places: int) -> DataFrame:
    """(gram, len, diff): each node's log ratio in millionths, from (gram, n_allow, n_block) of the longest grams.

    Each order has ``LEAST_SHARE`` nodes at most, as ``places`` is the sum of all counts. A node's shorter grams are nodes too.
    """
    sizes = F.explode(F.sequence(F.lit(1), F.lit(LONGEST)))
    every = counts.withColumn("len", sizes).groupBy("len", F.substr("gram", F.lit(LONGEST + 1) - F.col("len")).alias("gram")).agg(F.sum("n_allow").alias("n_allow"), F.sum("n_block").alias("n_block"))
    every = stored(every, "url-grams")
    contexts = every.groupBy("len", F.substr("gram", F.lit(1), F.col("len") - 1).alias("context")).agg(F.sum("n_allow").alias("c_allow"), F.sum("n_block").alias("c_block"))
    nodes = every.where((F.col("n_allow") + F.col("n_block")) * LEAST_SHARE >= places).withColumn("context", F.substr("gram", F.lit(1), F.col("len") - 1))
    nodes = stored(nodes.join(contexts, ["len", "context"]), "url-nodes")
    chain = nodes.select("gram", F.col("len").alias("full"), sizes.alias("part")).where("part <= full")
    chain = chain.select("gram", "full", F.substr("gram", F.col("full") + 1 - F.col("part")).alias("shorter"))
    met = chain.join(nodes.withColumnRenamed("gram", "shorter"), "shorter")
    path = F.sort_array(F.collect_list(F.struct("len", "n_allow", "c_allow", "n_block", "c_block")))

    def smoothed(n, c, p):
        return (n + F.lit(BACKOFF) * p) / (c + F.lit(BACKOFF))

    even = F.lit(1.0 / ALPHABET)
    both = F.aggregate("path", F.struct(even.alias("a"), even.alias("b")), lambda p, x: F.struct(smoothed(x["n_allow"], x["c_allow"], p["a"]).alias("a"), smoothed(x["n_block"], x["c_block"], p["b"]).alias("b")))
    return met.groupBy("gram", F.col("full").alias("len")).agg(path.alias("path")).select("gram", "len", both.alias("p")).select("gram", "len", F.round((F.log("p.a") - F.log("p.b")) * 1e6).cast("long").alias("diff"))


def best_limit(bins: list[tuple[int, int, int]]) -> int:
    """The lowest allowed bin: most allowed and blocked URLs on their sides by share; of equal ones the nearest to 0, then the lower.

    ``bins`` has (bin, n_allow, n_block). Without URLs of both kinds it is 0.
    """
    n_allow, n_block = sum(x[1] for x in bins), sum(x[2] for x in bins)
    if not n_allow or not n_block:
        return 0
    below_a, below_b, low, marks = 0, 0, -LAST_BIN, []
    for at, a, b in [*sorted(bins), (LAST_BIN + 1, 0, 0)]:
        take = min(max(0, low), at)  # every limit from low to at parts the URLs alike
        marks.append(((below_a - n_allow) * n_block - below_b * n_allow, abs(take), take))
        below_a, below_b, low = below_a + a, below_b + b, at + 1
    return min(marks)[2]


def url_verdicts(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", rules=RULES) -> DataFrame:
    """Per row of ``pages``: page_id, host, path, rule, verdict, score, and the number of places scored.

    A null URL is the empty one, which no rule fits and whose only place is its end. Repeated rows each count and each come
    back; ids play no part. URLs may be of any length and hold any character; those that no node knows add 0. A score equal
    to the limit allows. Where no URL, or only URLs of one verdict, fit a rule, nothing is learned: scores are null and
    what no rule fits is allowed. Without both verdicts among those kept back, the limit is 0. An empty table gives no
    rows; other columns play no part.
    """
    url = F.coalesce(F.col("url"), F.lit(""))
    # The key of a row is written down, so that it stays the same if a task is run again.
    base = stored(pages.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("page_id"), F.col(url_col).alias("url")), "urls")
    rows = base.select("row", "page_id", url.alias("url"), host_of(url).alias("host"), path_of(url).alias("path"))
    rows = rows.withColumn("fit", rule_of(F.col("host"), F.col("path"), rules)).withColumn("kept_back", F.substr(F.md5("url"), F.lit(1), F.lit(1)).isin(*KEPT_BACK))
    learn = rows.where(F.col("fit").isNotNull() & ~F.col("kept_back")).select(F.explode(grams(F.col("url"))).alias("gram"), F.col("fit.verdict").alias("verdict"))
    counts = stored(learn.groupBy("gram").agg(F.count_if(F.col("verdict") == "allow").alias("n_allow"), F.count_if(F.col("verdict") == "block").alias("n_block")), "url-counts")
    n_allow, n_block = counts.agg(F.sum("n_allow"), F.sum("n_block")).first()
    if not n_allow or not n_block:
        found = rows.select("*", F.lit(None).cast("double").alias("score"), (F.length("url") + 1).cast("long").alias("places"))
        return _judged(found, F.lit("allow"))
    tree = stored(suffix_tree(counts, n_allow + n_block), "url-tree")
    places = base.select("row", F.explode(grams(url)).alias("gram"))
    for k in range(LONGEST, 0, -1):  # at most LEAST_SHARE rows each
        nodes = tree.where(F.col("len") == k).select(F.col("gram").alias(f"gram_{k}"), F.col("diff").alias(f"diff_{k}"))
        places = places.join(F.broadcast(nodes), F.substr("gram", F.lit(LONGEST + 1 - k)) == F.col(f"gram_{k}"), "left").drop(f"gram_{k}")
    diff = F.coalesce(*[F.col(f"diff_{k}") for k in range(LONGEST, 0, -1)], F.lit(0))
    sums = places.groupBy("row").agg(F.sum(diff).alias("total"), F.count("*").alias("places"))
    found = stored(rows.join(sums, "row").withColumn("bin", F.greatest(F.lit(-LAST_BIN), F.least(F.lit(LAST_BIN), F.floor(F.col("total") / F.col("places") / F.lit(float(BIN)))))), "url-scores")
    bins = found.where(F.col("fit").isNotNull() & F.col("kept_back")).groupBy("bin").agg(F.count_if(F.col("fit.verdict") == "allow"), F.count_if(F.col("fit.verdict") == "block"))
    limit = best_limit([tuple(r) for r in bins.collect()])  # 2 * LAST_BIN + 1 rows at most
    return _judged(found.withColumn("score", F.col("total") / F.col("places") / F.lit(1e6)), F.when(F.col("bin") >= limit, "allow").otherwise("block"))


def _judged(found: DataFrame, own: Column) -> DataFrame:
    return found.select("page_id", "host", "path", F.col("fit.rule").alias("rule"), F.coalesce("fit.verdict", own).alias("verdict"), "score", "places")


def op12_url_filters(spark, sf_dir: str) -> DataFrame:
    return url_verdicts(spread(read_table(spark, sf_dir, "pages")))


_RULES = ", ".join(f"('{h}', '{p}', '{h + p}', '{v}')" for h, p, v in RULES)
_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_NODES = ",\n".join(
    f"""n{k} AS (SELECT k.gram, (k.n_allow + {BACKOFF}::DOUBLE * {'s.a' if k > 1 else f'(1.0::DOUBLE / {ALPHABET})'}) / (k.c_allow + {BACKOFF}::DOUBLE) AS a, (k.n_block + {BACKOFF}::DOUBLE * {'s.b' if k > 1 else f'(1.0::DOUBLE / {ALPHABET})'}) / (k.c_block + {BACKOFF}::DOUBLE) AS b FROM kept k {f'JOIN n{k - 1} s ON s.gram = substr(k.gram, 2)' if k > 1 else ''} WHERE k.len = {k})"""
    for k in range(1, LONGEST + 1)
)
OP12_SQL = rf"""
WITH p AS (SELECT row_number() OVER () AS rid, page_id, coalesce(url, '') AS u FROM pages),
h AS (SELECT rid, page_id, u, {_LOWER.format("regexp_extract(u, '(?s)^.*?://([^/?#]*)([^?#]*)', 1)")} AS host, regexp_extract(u, '(?s)^.*?://([^/?#]*)([^?#]*)', 2) AS path, md5(u)[1] IN ('0', '1', '2', '3') AS back FROM p),
r(rh, rp, rule, ruled) AS (VALUES {_RULES}),
f AS (SELECT rid, arg_max(rule, length(rule)) AS rule, arg_max(ruled, length(rule)) AS ruled FROM h JOIN r ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp) GROUP BY rid),
d AS (SELECT h.*, rule, ruled FROM h LEFT JOIN f USING (rid)),
g AS (SELECT rid, ruled, back, substr(x, i, {LONGEST}) AS gram FROM (SELECT rid, ruled, back, repeat(chr(2), {LONGEST - 1}) || {_LOWER.format('u')} || chr(3) AS x, unnest(range(1, length(u) + 2)) AS i FROM d)),
t AS (SELECT gram, ruled FROM g WHERE ruled IS NOT NULL AND NOT back),
every AS (SELECT len, substr(gram, {LONGEST + 1} - len) AS gram, count(*) FILTER (WHERE ruled = 'allow') AS n_allow, count(*) FILTER (WHERE ruled = 'block') AS n_block FROM t, range(1, {LONGEST + 1}) s(len) GROUP BY ALL),
total AS (SELECT count(*) AS n, count(*) FILTER (WHERE ruled = 'allow') > 0 AND count(*) FILTER (WHERE ruled = 'block') > 0 AS learned FROM t),
kept AS (SELECT * FROM (SELECT *, sum(n_allow) OVER c AS c_allow, sum(n_block) OVER c AS c_block FROM every WINDOW c AS (PARTITION BY len, substr(gram, 1, len - 1))) WHERE (n_allow + n_block) * {LEAST_SHARE} >= (SELECT n FROM total)),
{_NODES},
tree AS (SELECT gram, round((ln(a) - ln(b)) * 1e6)::BIGINT AS diff FROM ({' UNION ALL '.join(f'SELECT * FROM n{k}' for k in range(1, LONGEST + 1))})),
s AS (SELECT rid, sum(coalesce({', '.join(f't{k}.diff' for k in range(LONGEST, 0, -1))}, 0))::BIGINT AS total, count(*) AS places FROM g {' '.join(f'LEFT JOIN tree t{k} ON t{k}.gram = substr(g.gram, {LONGEST + 1 - k})' for k in range(1, LONGEST + 1))} GROUP BY rid),
b AS (SELECT d.*, places, total / places / 1e6 AS score, greatest(-{LAST_BIN}, least({LAST_BIN}, floor(total / places / {float(BIN)}::DOUBLE)))::BIGINT AS bin FROM d JOIN s USING (rid)),
k AS (SELECT bin, ruled = 'allow' AS yes FROM b WHERE ruled IS NOT NULL AND back),
limits AS (SELECT x AS lim, (count(*) FILTER (WHERE yes AND bin >= x)) * (SELECT count(*) FROM k WHERE NOT yes) + (count(*) FILTER (WHERE NOT yes AND bin < x)) * (SELECT count(*) FROM k WHERE yes) AS good FROM k, range(-{LAST_BIN}, {LAST_BIN + 2}) r(x) GROUP BY x),
lim AS (SELECT coalesce((SELECT CASE WHEN max(good) = 0 THEN 0 ELSE first(lim ORDER BY good DESC, abs(lim), lim) END FROM limits), 0) AS lim)
SELECT page_id, host, path, rule, coalesce(ruled, CASE WHEN NOT (SELECT learned FROM total) OR bin >= (SELECT lim FROM lim) THEN 'allow' ELSE 'block' END) AS verdict, CASE WHEN (SELECT learned FROM total) THEN score END AS score, places FROM b"""
