"""Operators of the core library against plain Python, with ties, nulls, repeated rows and empty tables."""

import json
import math
import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from veilspark.operators import asof, bootstrap, filters, histograms, linediff, linking, related, tickets


@pytest.mark.parametrize("most", [1000, 3])
def test_links(spark, most):
    """Links by one automaton and by several are those of plain scanning; rendered texts give the text again without them."""
    rng = random.Random(2)
    terms = ["Ann", "Ann Lee", "Lee", "ann@x.org", "aa", "aaa", "a", "é Ü", "Ü", "x.y,", "[z]", "a b c", "b c d e", "\n", "nowhere"]
    texts = ["".join(rng.choice(["Ann", " Lee", "a", "aa", "b", " ", "c d e", "é", " Ü", "x.y,", "[z]", "\n", "😀", "ann@x.org"]) for _ in range(rng.randint(0, 30))) for _ in range(80)]
    texts += [None, "", texts[3], "Ann Lee" * 3000]
    rows = [(n % 70, t, "more") for n, t in enumerate(texts)] + [(None, "Ann Lee", "x"), (None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, links string").repartition(4)
    own = spark.createDataFrame([(t,) for t in [*terms, "Ann", "", None]], "term string")
    found = linking.linked(docs, own, most=most)
    got = sorted((str(r["doc_id"]), r["text"], str([tuple(m) for m in r["links"]])) for r in found.collect())
    assert got == sorted((str(r[0]), r[1] or "", str(linking.plain_links(r[1] or "", terms))) for r in rows)
    shown = found.select("text", "links", *[linking.rendered(s).alias(f"t_{s}") for s in linking.STYLES]).collect()
    for r in shown:
        out, cursor = {s: "" for s in linking.STYLES}, 0
        for start, end, term in r["links"]:
            mark = "".join(c.lower() if c.isascii() and c.isalnum() else "-" for c in term)
            made = {"markdown": f"[{term}](#glossary-{mark})", "html": f'<a href="#glossary-{mark}">{term}</a>', "wiki": f"[[{term}]]"}
            for s in linking.STYLES:
                out[s] += r["text"][cursor:start] + made[s]
            cursor = end
        assert all(r[f"t_{s}"] == out[s] + r["text"][cursor:] for s in linking.STYLES)
    assert linking.linked(docs, own.where("false")).where("size(links) > 0").count() == 0 and linking.linked(docs.where("false"), own).count() == 0


@pytest.mark.parametrize(("split", "block"), [(2, 3), (32, 4096)])
def test_related(spark, monkeypatch, split, block):
    """The k best by summed idf, as a loop over all pairs finds them; a name of a third of all documents makes no pairs."""
    monkeypatch.setattr(related, "BLOCK", block)
    rng = random.Random(7)
    rows = [(d, t) for d in range(90) for t in {"common" if d % 3 == 0 else "other", *[f"t{min(29, int(rng.expovariate(0.15)))}" for _ in range(rng.randint(0, 5))], *(["every"] if True else [])}]
    rows += [(200, "common"), (201, "common"), (202, "lonely"), (203, "common"), rows[0], rows[0], (None, "common"), (5, None)]
    docs = defaultdict(set)
    for d, t in rows:
        if d is not None and t is not None:
            docs[d].add(t)
    n = 96
    df = defaultdict(int)
    for own in docs.values():
        for t in own:
            df[t] += 1
    w = {t: round(math.log(n / k) * 1e9) for t, k in df.items()}
    want = {}
    for a, own in docs.items():
        found = []
        for b, others in docs.items():
            both = [t for t in own & others if 1 < df[t] < n]
            if a != b and both:
                found.append((-sum(w[t] for t in both), b, sorted(both, key=lambda t: (-w[t], t))))
        want[a] = [(b, -s, shared) for s, b, shared in sorted(found)[:5]]
    frame, work = related.related(spark.createDataFrame(rows, "doc long, term string").repartition(5), n, 5, split)
    got = defaultdict(list)
    for r in frame.collect():
        got[r["doc"]].append((-r["score"], r["other"], list(r["shared"])))
    assert {a: [(b, -s, shared) for s, b, shared in sorted(v)] for a, v in got.items()} == {a: v for a, v in want.items() if v}
    assert work["pairs"] <= split * len(rows)


def test_filter_types(spark):
    """The same key with every JSON type: numbers meet numbers, strings strings, all else is false and nothing fails."""
    values = [5, 5.0, 5.5, "5", "abc", True, None, [], [5, "5", None], {"a": 1, "b": [2]}, {"b": [2], "a": 1}, 2**40, -3, ""]
    rows = [(n, json.dumps({"k": v, "deep": {"k": v}, "it's": v}), n, f"s{n}", [n]) for n, v in enumerate(values)] + [(50, "{", 50, None, None), (51, None, None, "x", []), (52, "[1]", 52, "y", [1]), (53, "{}", 53, "z", [2])]
    df = spark.createDataFrame(rows, "n long, metadata string, i int, s string, a array<int>")
    keep = lambda f: sorted(r["n"] for r in df.where(filters.compile_filter(f, df.schema)).collect())
    same = lambda x, y: type(x) is type(y) and x == y
    for value in (5, 5.0, "5", True, False, None, 2**40, "", {"a": 1, "b": [2]}, [5, "5", None]):
        for name in ("metadata.k", "metadata.deep.k", "metadata.it's"):
            assert keep({"eq": {"field": name, "value": value}}) == [n for n, v in enumerate(values) if same(v, value)], (name, value)
        assert keep({"not": {"eq": {"field": "metadata.k", "value": value}}}) == [n for n, v in enumerate(values) if not same(v, value)] + [50, 51, 52, 53]
    assert keep({"in": {"field": "metadata.k", "values": [5, "abc", None]}}) == [0, 4, 6] and keep({"in": {"field": "metadata.k", "values": []}}) == []
    assert keep({"range": {"field": "metadata.k", "gte": 5, "lt": 6}}) == [0, 1, 2] and keep({"range": {"field": "metadata.k", "gt": "4", "lte": "abc"}}) == [3, 4]
    assert keep({"range": {"field": "metadata.k", "gt": 4, "lt": "z"}}) == [] and keep({"range": {"field": "metadata.k"}}) == list(range(len(values)))
    assert keep({"array_contains": {"field": "metadata.k", "value": 5}}) == [8] and keep({"array_contains": {"field": "metadata.k", "value": None}}) == [8]
    assert keep({"text_match": {"field": "metadata.k", "query": "AB"}}) == [4] and keep({"text_match": {"field": "metadata.k", "query": "5"}}) == [3]
    assert keep({"eq": {"field": "i", "value": "3"}}) == [] and keep({"eq": {"field": "i", "value": 3}}) == [3] and keep({"eq": {"field": "i", "value": None}}) == []
    assert keep({"range": {"field": "s", "gte": 3}}) == [] and keep({"array_contains": {"field": "a", "value": 1}}) == [1, 52] and keep({"array_contains": {"field": "s", "value": "s1"}}) == []
    assert keep({"text_match": {"field": "i", "query": "1"}}) == [] and keep({"in": {"field": "i", "values": ["1", 2, None]}}) == [2]


def test_nodes(spark):
    """Every object and array at any depth, and none below one that stands for a token."""
    deep = 1
    for k in range(12):
        deep = {"x": [deep, k]}
    docs = [deep, {"tokenId": "A", "in": {"token_id": "B"}}, [[{"token_id": "C"}], {"tokenId": None, "token_id": "D"}], "text", 4]
    df = spark.createDataFrame([(n, json.dumps(v)) for n, v in enumerate(docs)] + [(9, "no"), (10, None)], "id long, j string")

    def walk(v):
        if isinstance(v, dict | list):
            yield v
            for x in v.values() if isinstance(v, dict) else v:
                yield from walk(x)

    got = defaultdict(int)
    for r in filters.json_nodes(df, "id", "j").collect():
        got[r["id"]] += 1
    assert got == {n: len(list(walk(v))) for n, v in enumerate(docs) if isinstance(v, dict | list)}
    found = filters.json_nodes(df, "id", "j", stop=lambda x: filters.token_of(x).isNotNull()).select(filters.token_of(F.col("node")).alias("t")).where("t is not null")
    assert sorted(r["t"] for r in found.collect()) == ["A", "C"]


@pytest.mark.parametrize("after", [True, False])
def test_asof(spark, after):
    rng = random.Random(3)
    row = lambda n: (rng.choice([1, 1, 1, 2, None]), rng.randint(0, 400) * 1_000_000 if rng.random() < 0.95 else None, n)
    left, right = [row(n) for n in range(120)], [row(n) for n in range(120)]
    frame = lambda x: spark.createDataFrame(x, "key long, at long, id long").repartition(4)
    want = {}
    for key, at, n in left:
        near = [(t, m) for k, t, m in right if k is not None and k == key and t is not None and at is not None and (0 < t - at < 30_000_000 if after else 0 <= at - t < 30_000_000)]
        want[n] = (min(near) if after else max(near)) if near else (None, None)
    got = {r["id"]: (r["found_at"], r["found_id"]) for r in asof.nearest(frame(left), frame(right), 30, after).collect()}
    assert got == want


def test_tickets(spark):
    """Every outcome, in the order in which a service would refuse."""
    second = 1_000_000
    asks = [("t1", 1, "ann", 0, 60, ["d"], ["[EMAIL:k:A]"], None, "why", None), ("t2", 1, "ann", 0, None, ["d"], None, ["SSN"], "why", ["x", "x"]), ("t3", 1, "ann", 0, 9999, ["d", "e"], [], ["EMAIL", "ssn"], "why", ["x", "y"]),
            ("t4", 1, "ann", 0, 0, ["d"], [], ["EMAIL"], " ", None), ("t5", 1, "ann", 0, 60, [], [], ["EMAIL"], "why", None), ("t6", 2, "ann", 0, 60, ["d"], None, ["EMAIL"], "why", None)]
    made = tickets.minted(spark.createDataFrame(asks, "ticket_id string, tenant long, subject string, at long, ttl long, document_ids array<string>, token_ids array<string>, field_scope array<string>, justification string, approvers array<string>"))
    rows = {r["ticket_id"]: (r["expires_at"], r["refused"]) for r in made.collect()}
    assert rows == {"t1": (60 * second, None), "t2": (600 * second, "insufficient_approvers"), "t3": (600 * second, None), "t4": (second, "invalid_request"), "t5": (60 * second, "invalid_request"), "t6": (60 * second, None)}
    tries = [("t1", 1, "bob", "d", "[EMAIL:k:A]", 1), ("t1", 1, "ann", "e", "[EMAIL:k:A]", 2), ("t1", 1, "ann", "d", "[EMAIL:k:B]", 3), ("t1", 1, "ann", None, "[EMAIL:k:A]", 4), ("t1", 1, "ann", "d", "[EMAIL:k:A]", 5), ("t1", 1, "ann", "d", "[EMAIL:k:A]", 5),
             ("t1", 2, "ann", "d", "[EMAIL:k:A]", 6), ("t2", 1, "ann", "d", "[SSN:k:A]", 7), ("t3", 1, "ann", "e", "[EMAIL:k:Z]", 599), ("t3", 1, "ann", "e", "[EMAIL:k:Z]", 700), ("t6", 2, "ann", "d", "[EMAIL:k:A]", 60), ("t6", 2, "ann", "d", "x", 30), (None, None, None, None, None, None), ("t1", 1, "ann", "d", "[EMAIL:k:A]", 900)]
    attempts = spark.createDataFrame([(n, *t[:5], None if t[5] is None else t[5] * second) for n, t in enumerate(tries)], "attempt_id long, ticket_id string, tenant long, principal string, document_id string, token string, at long")
    gone = spark.createDataFrame([(1, "t1", 30 * second), (1, "t3", 600 * second), (1, "t3", 599 * second)], "tenant long, ticket_id string, at long")
    got = [r["outcome"] for r in tickets.resolved(made, attempts, gone).orderBy("attempt_id").collect()]
    assert got == ["not_holder", "scope_violation", "scope_violation", "scope_violation", "revealed", "consumed", "not_found", "not_found", "revoked", "revoked", "expired", "scope_violation", "not_found", "consumed"]
    shapes = ["[A:b:c]", "[A:b:c:d]", "[A:b:]", "[:b:c]", "[A::c]", "A:b:c", "[A:b]", None, "[A:b:c\n]"]
    assert [r[0] for r in spark.createDataFrame([(s,) for s in shapes], "t string").select(tickets.category(F.col("t"))).collect()] == ["A", "A", None, None, None, None, None, None, "A"]


def table_diff(old, new):
    """Operations by the whole table of common lengths."""
    n, m = len(old), len(new)
    best = [[0] * (m + 1) for _ in range(n + 1)]
    for i in range(n - 1, -1, -1):
        for j in range(m - 1, -1, -1):
            best[i][j] = best[i + 1][j + 1] + 1 if old[i] == new[j] else max(best[i + 1][j], best[i][j + 1])
    out, i, j = [], 0, 0
    while i < n and j < m:
        if old[i] == new[j]:
            out.append(("equal", old[i]))
            i, j = i + 1, j + 1
        elif best[i + 1][j] >= best[i][j + 1]:
            out.append(("delete", old[i]))
            i += 1
        else:
            out.append(("insert", new[j]))
            j += 1
    return [*out, *(("delete", x) for x in old[i:]), *(("insert", x) for x in new[j:])]


def test_line_diff(spark):
    import tracemalloc

    rng = random.Random(4)
    for t in range(600):
        a, b = ([rng.choice("abcdefgh"[: 1 + t % 8]) for _ in range(rng.randint(0, 24))] for _ in range(2))
        b = b if t % 2 else [x for x in a if rng.random() < 0.8] + ["z"] * (t % 3)
        assert linediff.line_diff(a, b) == table_diff(a, b)
    a, b = ([str(rng.randint(0, 40)) for _ in range(500)] for _ in range(2))
    assert linediff.line_diff(a, b) == table_diff(a, b)
    a = [f"line {k}" for k in range(12_000)]
    b = [x for k, x in enumerate(a) if k % 7]
    tracemalloc.start()
    ops = linediff.line_diff(a, b)
    assert tracemalloc.get_traced_memory()[1] < 20e6
    tracemalloc.stop()
    assert [k for k, _ in ops].count("delete") == len(a) - len(b) and len(ops) == len(a)
    rows = [("a\nb\n", "a\r\nc"), ("", "x"), ("same", "same"), (None, "x"), ("\n\n", "\n")]
    df = spark.createDataFrame(rows, "a string, b string").select(linediff.line_ops(linediff.lines_of(F.col("a")), linediff.lines_of(F.col("b"))).alias("o"))
    got = [[tuple(x) for x in r["o"]] for r in df.collect()]
    assert got == [[("equal", "a"), ("delete", "b"), ("insert", "c")], [("insert", "x")], [("equal", "same")], [("insert", "x")], [("equal", ""), ("delete", "")]]


def loop_interval(cases, resamples, seed):
    """The interval as one loop draws it."""
    mask, x, scores = 2**64 - 1, seed | 1, []
    score = lambda s: 1.0 if 2 * s[0] + s[1] + s[2] == 0 else 2 * s[0] / (2 * s[0] + s[1] + s[2])
    for _ in range(resamples):
        total = [0, 0, 0]
        for _ in cases:
            x ^= (x << 13) & mask
            x ^= x >> 7
            x ^= (x << 17) & mask
            total = [a + b for a, b in zip(total, cases[x % len(cases)], strict=True)]
        scores.append(score(total))
    scores.sort()
    low = math.floor(resamples * 0.025)
    return score([sum(c[k] for c in cases) for k in range(3)]), scores[low], scores[max(low, min(math.ceil(resamples * 0.975), resamples - 1))], resamples


@pytest.mark.parametrize(("lane", "most"), [(20_000, 1_000_000), (7, 1_000_000), (50, 3)])
def test_bootstrap(spark, monkeypatch, lane, most):
    monkeypatch.setattr(bootstrap, "LANE", lane)
    monkeypatch.setattr(bootstrap, "MOST_CASES", most)
    rng = random.Random(5)
    cases = [(rng.randint(0, 4), rng.randint(0, 2), rng.randint(0, 3)) for _ in range(101)]
    df = spark.createDataFrame([(n, *c) for n, c in enumerate(cases)], "case long, tp long, fp long, fn long").repartition(6)
    got = bootstrap.interval(df, 60, seed=42).collect()
    assert len(got) == 1 and np.allclose(tuple(got[0]), loop_interval(cases, 60, 42))
    none = bootstrap.interval(df.where("false"), 60).first()
    assert tuple(none) == (1.0, 1.0, 1.0, 0)


def test_jumps():
    steps = np.array([0, 1, 2, 63, 64, 1000, 12_345])
    x, seen = np.array([42 | 1], np.uint64), {0: 43}
    for k in range(1, 12_346):
        x = bootstrap.stepped(x)
        seen[k] = int(x[0])
    assert [int(v) for v in bootstrap.ahead(42, steps)] == [seen[int(k)] for k in steps]


def test_histograms(spark):
    """Quantiles by hand, and merged panes equal to a histogram of all their events."""
    bounds = [1.0, 2.0, 5.0]
    df = spark.createDataFrame([([2, 2, 4, 4],), ([0, 0, 0, 3],), ([0, 0, 0, 0],), ([1, 3, 4, 10],), ([10, 10, 10, 10],)], "c array<long>")
    got = [(r[0], r[1]) for r in df.select(histograms.quantile(F.col("c"), bounds, 0.5), histograms.quantile(F.col("c"), bounds, 0.99)).collect()]
    want = [(1.0, 2 + 3 * (3.96 - 2) / 2), (5.0, 5.0), (None, None), (5.0, 5.0), (0.5, 0.99)]
    assert all(x == y or abs(x - y) < 1e-9 for a, b in zip(got, want, strict=True) for x, y in zip(a, b, strict=True))
    rng = random.Random(6)
    rows = [(f"2024-01-01 00:{rng.randint(0, 9):02d}:{rng.randint(0, 59):02d}", rng.choice("ab"), rng.choice([0.5, 1.0, 1.5, 3.0, 9.0, None, float("nan")])) for _ in range(300)]
    e = spark.createDataFrame(rows, "ts string, k string, value double").withColumn("ts", F.col("ts").cast("timestamp"))
    merged = histograms.ranges(histograms.panes(e, ["k"], bounds, "30 seconds"), ["k"], 10, 30, 4)
    whole = histograms.panes(e, ["k"], bounds, "5 minutes")
    at = {(r["at"], r["k"]): list(r["counts"]) for r in merged.collect()}
    for r in whole.collect():
        assert at[r["at"], r["k"]] == list(r["counts"]) and r["counts"][3] >= r["counts"][2]
    held = spark.createDataFrame([(f"2024-01-01 00:{m:02d}:00", "a", m not in (3, 9)) for m in range(16)] + [("2024-01-01 00:20:00", "a", True)], "t string, k string, above boolean").select(F.col("t").cast("timestamp").alias("at"), "k", "above")
    assert [r["at"].minute for r in histograms.firing(held, ["k"], "above", 300, 60).where("firing").orderBy("at").collect()] == [15]


def test_waits():
    """In order as the plain queue says; out of order never more than the limit in any window, and rejected only if there would be."""
    from collections import deque

    from veilspark.operators import quota

    rng = random.Random(8)
    for _ in range(60):
        limit, times = rng.randint(1, 4), sorted(rng.choice([rng.randint(0, 300), 7.5]) for _ in range(60))
        held = []
        said = quota.waits(times, held, limit, 60.0)
        assert [(w is None, 0 if w is None else max(1, int(w))) for w in said] == quota.admit(times, deque(), limit, 60.0)
        rng.shuffle(times)
        held, admitted = [], []
        most = lambda x: max((sum(a <= b < a + 60 for b in x) for a in x), default=0)
        for t, w in zip(times, quota.waits(times, held, limit, 60.0), strict=True):
            assert (w is None) == (most([*admitted, t]) <= limit)
            admitted += [t] if w is None else []
        assert held == sorted(admitted)
    assert quota.waits([1.0], [], 0, 60.0) == [60.0]


@pytest.mark.parametrize("block", [4, 32])
def test_text_index(spark, block):
    """The best texts of each query are those of plain BM25, ties by id, with fewer blocks read than there are."""
    import re

    from veilspark.operators import textindex

    rng = random.Random(9)
    tongues = [["the", "of", "and", *[f"en{chr(97 + k % 26)}{chr(97 + k // 26)}" for k in range(200)]], ["der", "und", *[f"de{chr(97 + k % 26)}{chr(97 + k // 26)}" for k in range(200)]]]
    pick = lambda words: words[min(len(words) - 1, int(rng.expovariate(0.04)))]
    texts = [" ".join(pick(tongues[n % 2]) for _ in range(rng.randint(3, 40))) for n in range(400)] + ["", None, "123", "The, OF!"]
    texts += [texts[7]] * 20
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string").repartition(5)
    queries = [(n, " ".join(pick(tongues[n % 2]) for _ in range(3))) for n in range(12)] + [(50, None), (51, "!!"), (52, "nowhereword"), (53, "the der"), (54, texts[7])]
    words = {n: re.findall("[a-z]+", (t or "").lower()) for n, t in enumerate(texts)}
    words = {n: w for n, w in words.items() if w}
    mean, n = np.mean([len(w) for w in words.values()]), len(words)
    df_ = defaultdict(int)
    for w in words.values():
        for t in set(w):
            df_[t] += 1
    weight = lambda t, w: round(math.log(1 + (n - df_[t] + 0.5) / (df_[t] + 0.5)) * w.count(t) * 2.2 / (w.count(t) + 1.2 * (1 - 0.75 + 0.75 * len(w) / mean)) * 1e9)
    index = textindex.build(df, block)
    for every in (False, True):
        want = []
        for q, text in queries:
            terms = set(re.findall("[a-z]+", (text or "").lower()))
            found = [(-sum(weight(t, w) for t in terms if t in w), i) for i, w in words.items() if terms and (all if every else any)(t in w for t in terms)]
            want += [(q, r + 1, i, -s) for r, (s, i) in enumerate(sorted(found)[:5])]
        got, work = textindex.search(index, spark.createDataFrame(queries, "query_id long, text string"), 5, every)
        rows = sorted(tuple(r) for r in got.collect())
        assert [r[:3] for r in rows] == [r[:3] for r in want] and all(abs(a[3] - b[3]) <= len(queries) for a, b in zip(rows, want, strict=True))
        assert work["read"] < work["asked"] or block > 4
    assert textindex.search(textindex.build(df.where("false")), df.select(F.col("id").alias("query_id"), "text"), 5)[0].count() == 0


def test_light_detector(spark):
    """Every kind against the same expressions in plain Python, in order, with account numbers no phones."""
    import re

    from veilspark.plans import redaction as R

    rng = random.Random(11)
    bits = ["call 555-123-4567", "01 23 45 67 89", "DE89 3704 0044 0532 0130 00", "GB29NWBK60161331926819", "a.b@x.org", "http://a.b/c?d=2024-01-02", "2024-01-02", "1/2/24", "3er Février 2025", "4 december 2024", "5 août 2024", "x5551234567", "+1 (743) 555-3824", ",", "é", "\n", "12.05.2023"]
    texts = [" ".join(rng.choice(bits) for _ in range(rng.randint(0, 9))) for _ in range(150)] + ["", None]
    got = spark.createDataFrame([(n, t) for n, t in enumerate(texts)], "n int, t string").select("n", R.light_spans(F.coalesce(F.col("t"), F.lit(""))).alias("s")).collect()
    for r in got:
        t, kept = texts[r["n"]] or "", []
        accounts = [m.span() for m in re.finditer(R.IBAN, t, re.A)]
        for kind, (pattern, _) in R.LIGHT.items():
            for m in re.finditer(pattern, t, re.A):
                clash = [(a, b) for a, b, k in kept if k != kind] + (accounts if kind == "phone" else [])
                if not any(m.start() < b and a < m.end() for a, b in clash):
                    kept.append((*m.span(), kind))
        assert [(s["start"], s["end"], s["kind"]) for s in r["s"]] == kept, t


def test_checks(spark):
    """Span rules in byte offsets, keyed digests against the standard library, records of any shape."""
    import hashlib
    import hmac

    from veilspark.functions import checks

    rows = [("aé😀b", 0, 1, 0.5, "a"), ("aé😀b", 1, 3, 0.5, "é"), ("aé😀b", 2, 3, 0.5, "x"), ("aé😀b", 1, 2, 0.5, "é"), ("aé😀b", 3, 7, 1.0, "😀"), ("aé😀b", 7, 8, 0.0, "b"), ("aé😀b", 7, 9, 0.5, "b"), ("aé😀b", 3, 3, 0.5, ""), ("ab", 0, 1, float("nan"), "a"), ("ab", 0, 1, None, "a"), ("ab", 0, 1, 1.01, "a"), ("ab", 0, 1, 0.5, None), (None, 0, 1, 0.5, "a"), ("ab", None, 1, 0.5, "a"), ("ab", -1, 1, 0.5, "a")]
    df = spark.createDataFrame(rows, "t string, s int, e int, c double, x string").select(checks.span_problem(*[F.col(k) for k in "tsecx"]).alias("p"))
    assert [r["p"] for r in df.collect()] == [None, None, "boundary", "boundary", None, None, "bounds", "order", "confidence", "confidence", "confidence", "text", "bounds", "order", "order"]
    with pytest.raises(Exception, match="invalid span: order"):
        df.where("p = 'order'").select(checks.enforced(F.col("p"))).collect()
    for key in (b"k", b"x" * 64, b"long" * 40):
        for text in ("", "abc", "é" * 100):
            want = hmac.new(key, text.encode(), hashlib.sha256).hexdigest()
            assert spark.createDataFrame([(text,)], "t string").select(checks.hmac_sha256(F.col("t"), key)).first()[0] == want
    value = {"id": "X", "kind": ["X", {"kind": "X", "t": "X"}], "a": {"id": {"x": "X"}, "n": 1, "id2": "X"}, "mime_type": "X \" : X", "e": "", "n": None, "l": [[], ["X", "id", "X"]]}
    out = spark.createDataFrame([(json.dumps(value),)], "j string").select(checks.redacted_record(F.col("j"), lambda x: F.replace(x, F.lit("X"), F.lit("-")))).first()[0]
    assert json.loads(out) == {"id": "X", "kind": ["-", {"kind": "X", "t": "-"}], "a": {"id": {"x": "-"}, "n": 1, "id2": "-"}, "mime_type": "X \" : X", "e": "", "n": None, "l": [[], ["-", "id", "-"]]}
