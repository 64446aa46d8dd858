import random

import pytest
from pyspark.sql import functions as F

from corpusloom import session
from corpusloom.functions import text
from corpusloom.operators import analysis, dedupe, evaluation, evidence, extraction, retrieval, review, routing

DDL = "doc_id string, source_platform string, source_item_id string, canonical_url string, author_hash string, content_hash string, simhash long, token_count int, normalized_text string"


def docs(spark, rows):
    made = [(d, p, i, u, a, t) for d, p, i, u, a, t in rows]
    df = spark.createDataFrame(made, "doc_id string, source_platform string, source_item_id string, canonical_url string, author_hash string, t string")
    n = text.normalized(F.col("t"))
    return df.select("doc_id", "source_platform", "source_item_id", "canonical_url", "author_hash", text.content_hash(F.col("t")).alias("content_hash"), text.simhash(n).alias("simhash"), text.token_count(n).alias("token_count"), n.alias("normalized_text"))


def links(spark, rows):
    return {(r.canonical_doc_id, r.doc_id): r for r in dedupe.detect_links(docs(spark, rows)).collect()}


LONG = " ".join(f"word{i}" for i in range(60))


def test_duplicate_links(spark):
    got = links(spark, [
        ("b", "p1", None, "u1", "x", LONG), ("a", "p1", None, "u2", "x", LONG + "!"), ("c", "p2", None, "u3", None, LONG), ("d", "p1", None, "u4", "y", LONG),
        ("e", "p1", None, "u5", None, "short text"), ("f", "p1", None, "u6", None, "Short, text"),
        ("g", "p1", "it1", "http://s/it1", None, "one thing entirely"), ("h", "p1", "it1", "http://s/other", None, "another thing"), ("i", "p1", None, "http://s/it1", None, "a third thing"),
        ("j", "p1", None, "u9", None, " ".join(f"q{i}" for i in range(20))), ("k", "p1", None, "u10", None, "intro " + " ".join(f"q{i}" for i in range(20)) + " and so on and on"),
    ])
    kind = {k: (r.duplicate_kind, r.review_reason_code, r.review_state) for k, r in got.items()}
    assert kind[("a", "b")] == ("exact_text", None, "auto_confirmed")
    assert kind[("a", "c")] == ("cross_post", "low_confidence", "pending_review")
    assert kind[("a", "d")] == ("exact_text", "different_authors_identical_text", "pending_review")
    assert kind[("e", "f")] == ("exact_text", "short_text_below_dedupe_minimum", "pending_review")
    assert kind[("g", "h")] == ("same_source_item", None, "auto_confirmed") and kind[("g", "i")][0] == "same_source_item"
    assert kind[("j", "k")] == ("quoted_repeat", "quoted_repeat_ambiguous", "pending_review")
    assert ("b", "c") not in kind and ("b", "d") not in kind  # a star, not all pairs of a group


def test_confirmed_links_alone_are_those_among_all(spark):
    """A near pair that is also quoted needs review; quotes are sought among near pairs without the rest of the corpus."""
    rng = random.Random(8)
    words = [f"w{i}" for i in range(4000)]
    rows = []
    for i in range(12):
        base = rng.sample(words, 300)
        other = list(base)
        other[rng.randrange(300)] = "changed"
        cut = base[: 300 - i % 3]  # a part of the base: quoted; of i % 3 = 0, a copy
        rows += [(f"a{i:02}", "p", None, None, None, " ".join(base)), (f"b{i:02}", "p", None, None, None, " ".join(other)), (f"c{i:02}", "p" if i % 2 else "q", None, None, None, " ".join(cut))]
    made = docs(spark, rows).localCheckpoint()
    every = dedupe.detect_links(made)
    key = lambda df: sorted((tuple(r) for r in df.collect()), key=str)
    want = key(every.where("review_state = 'auto_confirmed'"))
    assert want and every.where("method = 'simhash' and distance <= 3 and review_reason_code = 'quoted_repeat_ambiguous'").count() > 0
    assert key(dedupe.detect_links(made, confirmed_only=True)) == want


def test_hamming_pairs_equal_all_pairs(spark):
    rng = random.Random(10)
    base = [rng.getrandbits(64) for _ in range(40)]
    prints = [b ^ sum(1 << x for x in rng.sample(range(64), rng.randint(0, 9))) for b in base for _ in range(4)]
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    df = spark.createDataFrame(list(enumerate(signed)), "k int, simhash long")
    first = [prints.index(p) for p in prints]  # the row that stands for a fingerprint
    want = {(i, j, (prints[i] ^ prints[j]).bit_count()) for j in range(len(prints)) for i in range(j) if (prints[i] ^ prints[j]).bit_count() <= 6 and first[i] == i and (first[j] in (i, j))}
    for count in (None, 10_000, 10_000_000):  # more blocks must agree where more values are expected
        got = [tuple(r) for r in dedupe.hamming_pairs(df, "k", count=count).collect()]
        assert len(got) == len(set(got)) and set(got) == want
    assert len(dedupe.block_keys(100, 6)) == 7 and len(dedupe.block_keys(10_000_000, 6)) == 84


def test_quotes_equal_dynamic_programming(spark):
    rng = random.Random(11)
    pool = [" ".join(rng.choice("abcdefghij") for _ in range(rng.randint(8, 30))) for _ in range(12)]
    rows = [(f"{i:02}", f"{rng.choice(['', 'x y '])}{rng.choice(pool)}{rng.choice(['', ' z z z'])}") for i in range(40)]

    def run(a, b):
        best, row = 0, [0] * (len(b) + 1)
        for x in a:
            row = [0] + [row[j] + 1 if x == y else 0 for j, y in enumerate(b)]
            best = max(best, *row)
        return best

    want = {}
    for j, (kb, b) in enumerate(rows):
        for ka, a in rows[:j]:
            x, y = a.split(), b.split()
            r = run(x, y)
            if len(x) != len(y) and r >= 8 and 2 * r >= min(len(x), len(y)):
                want[ka, kb] = r
    got = {(r.a, r.b): r.run for r in dedupe.quoted_pairs(spark.createDataFrame(rows, "k string, normalized_text string"), "k").collect()}
    assert got == want


def test_quotes_wherever_they_lie(spark):
    """Texts of all lengths, quoted by half from every start, some of it a passage that all have."""
    rng = random.Random(5)
    hot = [f"h{i}" for i in range(12)]
    rows, want = [], {}
    for n in [*range(8, 40), 61, 64, 100, 101]:
        words = [f"w{n}x{i}" for i in range(n)]
        if n > 30:
            words[n // 2 - 6 : n // 2 + 6] = hot
        half = max(8, -(-n // 2))
        for s in {0, 1, (n - half) // 2, max(0, n - half - 1), n - half, rng.randint(0, n - half)} & set(range(n - half + 1)):
            rows.append((f"q{n:03}s{s:03}", " ".join([f"o{n}x{s}x{i}" for i in range(n + 3)] + words[s : s + half])))
            want[f"q{n:03}s{s:03}", f"t{n:03}"] = half
        rows.append((f"t{n:03}", " ".join(words)))
    got = {(r.a, r.b): r.run for r in dedupe.quoted_pairs(spark.createDataFrame(rows, "k string, normalized_text string"), "k").collect()}
    assert {k: v for k, v in got.items() if k[1][0] == "t"} == want


def test_quotes_by_windows_are_those_of_the_words(spark):
    """Short texts around a line that many hold, whole, cut or twice, beside texts of up to three times the windowed length."""
    rng, line, rows = random.Random(7), [f"line{i}" for i in range(14)], []
    for i in range(160):
        own = lambda n: [f"w{rng.randrange(400)}" for _ in range(n)]
        held = line[rng.randrange(4) : rng.randrange(10, 15)]
        rows.append((f"k{i:03}", " ".join(own(rng.randrange(20 if i % 2 else 180)) + held + own(rng.randrange(12)) + held * (i % 3 == 0))))
    words = {k: t.split() for k, t in rows}
    for n, (k, w) in enumerate(list(words.items())[:6]):  # halves of longer texts, beyond the windowed length too
        words[f"q{n}"] = ["x"] + (w * 4)[: 70 + n] + ["y"]
        words[f"r{n}"] = (w * 4)[: 70 + n] + ["z"] * 90
    texts = spark.createDataFrame([(k, " ".join(w)) for k, w in words.items()], "k string, normalized_text string")
    got = {(r.a, r.b) for r in dedupe.quotes_of_all(texts, "k").collect()}
    want = set()
    for a, x in words.items():
        size = max(dedupe.RUN, -(-len(x) // 2))
        own = {tuple(x[i : i + size]) for i in range(len(x) - size + 1)}
        want |= {(min(a, b), max(a, b)) for b, y in words.items() if len(y) > len(x) and any(tuple(y[i : i + size]) in own for i in range(len(y) - size + 1))}
    assert got == want and len(want) > 500
    assert got == {(r.a, r.b) for r in dedupe.quoted_pairs(texts, "k").collect()}


def test_quotes_of_a_common_line_are_kept_by_class(spark, monkeypatch):
    """What is kept of the quotes of a line and of a passage grows with the texts, not with the pairs, and no pair is made twice."""
    rng, rows = random.Random(9), []
    line, passage = [f"line{i}" for i in range(14)], [f"pass{i}" for i in range(70)]
    own = lambda n: [f"o{rng.randrange(10**9)}" for _ in range(n)]
    rows += [(f"s{i:03}", " ".join(own(3 + i % 6) + line)) for i in range(40)]
    rows += [(f"t{i:03}", " ".join(own(9 + i) + line + own(i % 5) + line * (i % 3 == 0))) for i in range(150)]
    rows += [(f"p{i:03}", " ".join(own(i % 30) + passage)) for i in range(60)] + [(f"q{i:03}", " ".join(own(70 + i) + passage + own(7))) for i in range(60)]
    monkeypatch.setattr(dedupe, "LOT", 16)
    monkeypatch.setattr(dedupe, "OFTEN", 8)
    texts = spark.createDataFrame(rows, "k string, normalized_text string").localCheckpoint()
    asks, members, far = dedupe.quotes_by_class(texts, "k")
    made = sorted((r.a, r.b) for r in dedupe.quotes_of_all(texts, "k").collect())
    want = sorted((r.a, r.b) for r in dedupe.quoted_pairs(texts, "k").collect())
    assert made == want and len(want) > 10_000
    assert asks.count() < len(want) / 10 and members.count() < 20 * len(rows) and far.count() == 0
    assert members.groupBy("sig", "lot").count().agg(F.max("count")).first()[0] <= 3 * 16


def test_open_items_are_in_order_and_dealt_as_two_columns(spark):
    reasons = [*dedupe.PRIORITY, "low_confidence", None]
    rows = [(f"{i:012x}", reasons[i % 6 - 1], "auto_confirmed" if i % 7 == 0 else "pending_review") for i in range(3000)]
    items = dedupe.open_items(spark.createDataFrame(rows, "link_id string, review_reason_code string, review_state string").repartition(5))
    got = [(r.priority, r.item_id) for r in items.collect()]
    assert got == sorted(got) and len(got) == sum(s == "pending_review" and r is not None for _, r, s in rows)
    plan = items._jdf.queryExecution().optimizedPlan()
    while "RepartitionByExpression" not in plan.nodeName():
        plan = plan.children().apply(0)
    assert plan.output().size() == 2


def test_a_source_pair_that_is_also_a_quote_is_linked_once(spark):
    line = [f"line{i}" for i in range(14)]
    rows = [(f"s{i}", "p1", f"it{i}", None, None, " ".join([f"s{i}a", f"s{i}b", *line])) for i in range(6)]
    rows += [(f"t{i}", "p1", f"it{i}", None, None, " ".join([*[f"t{i}x{j}" for j in range(20 + i)], *line])) for i in range(6)]
    made = dedupe.detect_links(docs(spark, rows)).collect()
    got = {(r.canonical_doc_id, r.doc_id): r.method for r in made}
    assert len(made) == len(got) and sum(a[0] == "s" and b[0] == "t" for a, b in got) == 36
    assert {k for k, m in got.items() if m == "source_item_key"} == {(f"s{i}", f"t{i}") for i in range(6)}


def test_calibration(spark):
    df = spark.createDataFrame([("a", 0), ("b", 0b11111), ("c", 0b11111111 << 20)], "doc_id string, simhash long")
    none = spark.createDataFrame([("b", "a", "l1", "pending_review")], "doc_id string, canonical_doc_id string, link_id string, review_state string")
    got = [(r.a, r.b, r.distance, r.control, r.action) for r in dedupe.calibration_rows(df, none, 1).orderBy("distance").collect()]
    assert got == [("a", "b", 5, False, "pending_review"), ("a", "c", 8, True, "none")]


def test_calibration_is_whole(spark):
    """The automatic band is in it, and controls are the nearest pairs at any distance."""
    prints = {"a": 0, "b": 0, "c": 0b111, "d": 0b1111 << 10, "e": -1, "f": (1 << 30) - 1}
    df = spark.createDataFrame(list(prints.items()), "doc_id string, simhash long")
    none = spark.createDataFrame([], "doc_id string, canonical_doc_id string, link_id string, review_state string")
    every = sorted((((prints[x] ^ prints[y]) & (1 << 64) - 1).bit_count(), x, y) for x in prints for y in prints if x < y)
    every = [p for p in every if "b" not in p[1:] or p[1:] == ("a", "b")]  # a stands for b
    for k in (0, 1, 4, 8, 50):
        want = [p for p in every if p[0] <= 6] + [p for p in every if p[0] > 6][:k]
        got = dedupe.calibration_rows(df, none, k).collect()
        assert sorted((r.distance, r.a, r.b) for r in got) == want
        for r in got:
            assert r.selection_reason == ("automatic_band" if r.distance <= 3 else "review_band" if r.distance <= 6 else "nearest_negative_control")
    assert (0, "a", "b") in every and max(every)[0] == 64


def test_routing(spark):
    rows = [("1", "my backup failed and it says sync error"), ("2", "backup failed but i can't find a photo"), ("3", "storage full"), ("4", "i searched for the video of us"), ("5", "backup failed payment failed charged my card"), ("6", "hello"), ("7", "backup failed and sync error")]
    canon = spark.createDataFrame([("7", "1")], "doc_id string, canonical_doc_id string")
    got = {r.doc_id: r for r in routing.prefilter(spark.createDataFrame(rows, "doc_id string, normalized_text string"), canon).collect()}
    assert (got["1"].route, got["1"].drop_reason_code, got["1"].candidate_scope_class) == ("obvious_exclusion_candidate", "storage_backup_or_sync", "out_of_scope")
    assert got["2"].reason_labels == ["mixed_retrieval_and_exclusion"] and got["2"].passed
    assert got["3"].reason_labels == ["single_signal_retained"] and got["3"].passed
    assert got["4"].reason_labels == ["retained_for_recall"] and got["6"].passed
    assert got["5"].drop_reason_code == "billing_or_subscription"
    assert (got["7"].route, got["7"].passed, got["7"].canonical_doc_id) == ("skipped_non_canonical", False, "1")


def test_ladder(spark):
    t = "Alpha beta.  Gamma\n beta delta"
    rows = [("exact", "beta", 6, 10), ("nearest", "beta", 15, 19), ("ambiguous", "beta", None, None), ("unique", "delta", 3, 8), ("whitespace", "Gamma beta", None, None), ("not_found", "omega", 1, 5), ("exact", "Alpha", 0, 5)]
    df = spark.createDataFrame([(i, e, q, s, p, t) for i, (e, q, s, p) in enumerate(rows)], "i int, want string, quote string, start int, stop int, raw_text string").withColumn("redaction_spans", F.expr("array(named_struct('start', 0, 'stop', 5))"))
    got = evidence.ladder(df).orderBy("i").collect()
    assert [r.rung for r in got] == [r[0] for r in rows]
    assert [(r.final_start, r.final_stop) for r in got[:5]] == [(6, 10), (20, 24), (None, None), (25, 30), (13, 24)]
    assert [r.validation_state for r in got] == ["valid", "valid", "rejected", "valid", "valid", "rejected", "rejected_redacted"]


def test_undefined_rates_are_null(spark):
    df = spark.createDataFrame([(True, None), (False, False)], "g boolean, p boolean")
    r = evaluation.binary_counts(df, F.col("g"), F.col("p")).first()
    assert (r.tp, r.excluded, r.precision, r.recall, r.f1) == (0, 1, None, None, None)
    assert spark.range(1).select(*evaluation.rates(F.lit(0), F.lit(0), F.lit(0), zero=True)).first().f1 == 0.0
    k = evaluation.kappa(spark.createDataFrame([("a", "a")] * 3, "x string, y string"), "x", "y").first()
    assert k.kappa == 1.0


def test_greedy_matching(spark):
    s = spark.createDataFrame([("d", "g1", "c1", 2), ("d", "g1", "c2", 2), ("d", "g2", "c1", 3), ("d", "g3", "c2", 0), ("e", "g1", "c1", 1)], "doc_id string, gold_id string, case_id string, score long")
    assert sorted(tuple(r) for r in evaluation.greedy_matches(s).collect()) == [("d", "g1", "c2", 2), ("d", "g2", "c1", 3), ("e", "g1", "c1", 1)]


def test_greedy_matching_is_one_column_pass(spark):
    """Documents are many and small: no Python call for each; what comes out is what taking the best pair again and again gives."""
    rng = random.Random(5)
    rows = [(f"d{d}", f"g{g}", f"c{c}", rng.randrange(0, 4)) for d in range(40) for g in range(rng.randrange(1, 5)) for c in range(rng.randrange(1, 5))]
    want = []
    for d in {r[0] for r in rows}:
        left = sorted((r for r in rows if r[0] == d and r[3] > 0), key=lambda r: (-r[3], r[1], r[2]))
        while left:
            want.append(left[0])
            left = [r for r in left if r[1] != want[-1][1] and r[2] != want[-1][2]]
    got = evaluation.greedy_matches(spark.createDataFrame(rows, "doc_id string, gold_id string, case_id string, score long"))
    assert sorted(map(tuple, got.collect())) == sorted(want)
    assert "Pandas" not in got._jdf.queryExecution().executedPlan().toString()


def test_overlap_scores(spark):
    gold = spark.createDataFrame([("d", "g", ["b c", "zz"])], "doc_id string, gold_id string, quotes array<string>")
    cases = spark.sql("select 'd' doc_id, 'c' case_id, array(named_struct('quote', 'c', 'start', 3, 'stop', 4), named_struct('quote', 'q', 'start', 9, 'stop', 12)) spans")
    texts = spark.createDataFrame([("d", "a b c d")], "doc_id string, text string")
    assert evaluation.overlap_scores(gold, cases, texts).first().score == 1
    equal = spark.sql("select 'd' doc_id, 'c' case_id, array(named_struct('quote', 'zz', 'start', cast(null as int), 'stop', cast(null as int)), named_struct('quote', 'b c', 'start', 2, 'stop', 5)) spans")
    assert evaluation.overlap_scores(gold, equal, texts).first().score == 2  # an equal quote needs no offsets and counts once
    assert evaluation.overlap_scores(gold, equal, texts.limit(0)).first().score == 2  # nor the text


def test_search_floor_cap_and_multiplicity(spark):
    rows = [(i, "s1" if i < 6 else "s2", "apple pie" if i % 2 else "apple banana cherry") for i in range(8)] + [(9, "s3", "nothing here")]
    df = spark.createDataFrame(rows, "k int, s string, t string")
    got = retrieval.search("What of the banana banana?", df, "k", "s", "t", per_source=2).collect()
    assert [r.key for r in got] == [0, 2, 6] and got[0].score > retrieval.search("banana", df, "k", "s", "t").first().score
    assert retrieval.search("unrelated", df, "k", "s", "t").count() == 0 and retrieval.search("the of", df, "k", "s", "t").count() == 0
    assert retrieval.search("banana", df.limit(0), "k", "s", "t").count() == 0
    assert retrieval.search("banana", df, "k", "s", "t", {"s": "s2"}).count() <= 1


def test_evidence_panel(spark):
    df = spark.createDataFrame([("see [a] and [b]", ["b", "a", "c"]), ("[a] [zz]", ["a"]), ("none", ["a"])], "x string, ids array<string>")
    assert [r[0] for r in df.select(retrieval.evidence_panel(F.col("x"), F.col("ids"))).collect()] == [["b", "a"], [], []]


def test_memory_map_keeps_statuses_apart(spark):
    df = spark.sql("select 1 case_id, 'ok' technical_state, named_struct('observation', 'stated', 'value', array('x', 'y')) cues, named_struct('observation', 'explicitly_none', 'value', cast(array() as array<string>)) forgotten union all select 2, 'failed', named_struct('observation', 'stated', 'value', array('x')), named_struct('observation', 'not_stated', 'value', cast(array() as array<string>))")
    assert sorted(tuple(r) for r in analysis.memory_map(df).collect()) == [("x", "explicitly_none", 1), ("y", "explicitly_none", 1)]


def test_current_cases_precedence(spark):
    rows = [("c", "human", "invalid", 9, "z"), ("c", "model", "valid", 1, "a"), ("c", "model", "valid", 2, "a"), ("d", "human", "valid", 1, "a"), ("d", "model", "valid", 5, "b"), ("e", "human", "invalid", 1, "a")]
    df = spark.createDataFrame(rows, "case_id string, extractor_type string, validation_state string, extracted_at int, extraction_fingerprint string")
    assert sorted((r.case_id, r.extractor_type, r.extracted_at) for r in review.current_cases(df).collect()) == [("c", "model", 2), ("d", "human", 1), ("e", "human", 1)]


def test_merge_sheet_and_context(spark):
    fresh, prior = spark.createDataFrame([(1, "new", ""), (2, "two", None)], "k int, g string, h string"), spark.createDataFrame([(1, "old", "mine"), (3, "gone", "kept")], "k int, g string, h string")
    assert sorted(tuple(r) for r in review.merge_sheet(fresh, prior, "k", ["h"]).collect()) == [(1, "new", "mine"), (2, "two", None), (3, "gone", "kept")]
    items = spark.createDataFrame([("p", "t1", None), ("r", None, "t1"), ("s", None, "t2"), ("q", "t3", None), ("u", None, "t3")], "doc_id string, source_item_id string, parent_thread_id string")
    splits = spark.createDataFrame([("q", "holdout"), ("p", "dev")], "doc_id string, split string")
    assert sorted(tuple(r) for r in review.parent_context(items, splits).collect()) == [("r", "p", "resolved"), ("s", None, "missing"), ("u", None, "withheld")]


def test_cards_and_json_repair(spark):
    d = spark.createDataFrame([("d", "x" * 300 + "quote" + "y" * 300)], "doc_id string, raw_text_audit string")
    s = spark.createDataFrame([("d", 300, 305, "quote"), ("d", 0, 3, "bad")], "doc_id string, start int, stop int, quote string")
    c = extraction.cards(d, s).first()
    assert c.excerpt[c.spans[0].start : c.spans[0].stop] == "quote" and len(c.excerpt) == 325 and c.rejected == ["bad"]
    assert extraction.repaired_json('```json\n{“a”: [1, 2,],}\n```') == '{"a": [1, 2]}' and extraction.repaired_json("{") is None


def test_status_gate(spark):
    schema = "id int, owner_id string, a_observation string, a_value string, b_observation string, b_value array<string>, spans array<struct<owner_id:string,field_name:string,validation_state:string>>"
    va, vb, bad = ("o", "a", "valid"), ("o", "b", "valid"), ("o", "a", "rejected")
    cases = [
        (("stated", "x", "not_stated", []), [va], []),
        (("explicitly_none", None, "uncertain", ["y"]), [va, vb], []),
        (("explicitly_none", None, "uncertain", None), [], [("a", "missing_evidence"), ("b", "missing_evidence")]),
        (("stated", "x", "not_applicable", None), [bad], [("a", "missing_evidence"), ("a", "unusable_span")]),
        (("stated", "", "explicitly_none", ["y"]), [va, vb], [("a", "missing_value"), ("b", "forbidden_value")]),
        (("not_stated", "x", "not_stated", None), [va], [("a", "forbidden_evidence"), ("a", "forbidden_value")]),
        (("stated", "x", "not_stated", None), [("p", "a", "valid")], [("a", "missing_evidence"), ("a", "wrong_owner")]),
        (("stated", "x", "not_stated", None), [va, ("o", "z", "valid")], [("z", "unknown_field")]),
        (("stated", "x", None, None), None, [("a", "missing_evidence"), ("b", "unknown_status")]),
    ]
    df = spark.createDataFrame([(i, "o", *v, s) for i, (v, s, _) in enumerate(cases)], schema)
    got = df.select("id", evidence.gate_errors(df, ["a", "b"]).alias("e")).orderBy("id").collect()
    assert [sorted(tuple(e) for e in r.e) for r in got] == [w for _, _, w in cases]
    failed = df.withColumn("technical_state", F.lit("provider_failed"))
    assert failed.select(evidence.gate_errors(failed, ["a", "b"]).alias("e")).where("size(e) > 0").count() == 0


def test_exact_query(spark):
    span = lambda a, b, field="exact_query", state="valid": (field, state, a, b)
    cases = [("red car", 'I typed "red car" twice', [span(8, 17)], True), ("red car", "I typed red car twice", [span(0, 20)], False), ("red car", 'x "red car"', [span(3, 9)], False), ("red car", "a\n Query : Red Car \nb", [span(0, 20)], True), ("a.b", "`axb`", [span(0, 5)], False), ("a.b", "`a.b`", [span(0, 5, "outcome"), span(0, 5, state="rejected")], False), (None, "x", [], False), ("a", None, None, False)]
    df = spark.createDataFrame([(i, *c[:3]) for i, c in enumerate(cases)], "i int, v string, t string, s array<struct<field_name:string,validation_state:string,start:int,stop:int>>")
    assert [r.ok for r in df.select("i", evidence.exact_query_supported(F.col("v"), F.col("s"), F.col("t")).alias("ok")).orderBy("i").collect()] == [c[3] for c in cases]


def test_pilot_seats(spark):
    C, A = evaluation.CORE, evaluation.ADJACENT
    r, x = ("r1", "r2"), ("x1", "x2")
    rows = [(d, True, C, "model", "valid") for d in ("c3", "c1", "c2", x[0])] + [(d, True, A, "human", "valid") for d in (*r, "z9", "b1")] + [(x[1], True, A, "human", "valid"), ("a0", True, A, "model", "valid"), ("a1", False, A, "model", "valid")]
    labels = [(d, s) for d, _, s, _, _ in rows if d != "a0"] + [("a0", C)]
    make = lambda rows: spark.createDataFrame(rows, "doc_id string, eligible boolean, scope_class string, decided_by string, validation_state string")
    approved = spark.createDataFrame(labels, "doc_id string, scope_class string")
    seats = lambda rows: sorted(map(tuple, evaluation.pilot_seats(make(rows), approved, list(r), list(x)).collect()))
    assert seats(rows) == sorted([("c1", "core"), ("c2", "core"), ("r1", "adjacent"), ("r2", "adjacent"), ("b1", "adjacent")])
    for wrong, why in (([q for q in rows if q[0] != x[1]], "missing"), ([q for q in rows if q[0] not in ("c1", "c2")], "core seats are 1"), ([q if q[0] != r[0] else (*q[:3], "model", "valid") for q in rows], "human"), ([q for q in rows if q[0] not in ("z9", "b1")], "adjacent seats are 2"), ([q if q[0] != r[1] else (q[0], False, *q[2:]) for q in rows], "agreeing adjacent")):
        with pytest.raises(Exception, match=why):
            seats(wrong)


def test_ranks_over_several_parts(spark):
    rng = random.Random(2)
    rows = [(rng.choice(["a", "b", None]) if i % 3 else "hot", i, rng.random()) for i in range(900)]
    got = session.ranked(spark.createDataFrame(rows, "g string, i int, x double").repartition(7), ["g"], [F.col("x"), F.col("i")]).collect()
    groups = {}
    for g, i, x in sorted(rows, key=lambda r: (r[2], r[1])):
        groups.setdefault(g, []).append(i)
    assert {r.i: (r.rn, r.n) for r in got} == {i: (k + 1, len(v)) for v in groups.values() for k, i in enumerate(v)} and len(got) == 900


def test_simhash_of_batches(spark):
    import hashlib

    def one(text):
        w = text.split()
        hs = [int.from_bytes(hashlib.sha1(" ".join(w[i : i + 3]).encode()).digest()[:8], "big") for i in range(max(1, len(w) - 2))] if w else []
        return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs)) if hs else 0

    texts = ["", "one", "one two", "a b c d a b c", None] + [" ".join(f"w{i * k % 31}" for i in range(k)) for k in range(3, 400, 37)]
    got = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", text.hex64(text.simhash(F.col("t"))).alias("h")).orderBy("i").collect()
    assert [r.h for r in got] == [None if t is None else f"{one(t):016x}" for t in texts]
