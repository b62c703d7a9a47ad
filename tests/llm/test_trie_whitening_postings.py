"""Prefix trie, whitening and decontamination against plain Python, with nulls, ties, repeated rows, empty tables, clashing columns."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest

from veilspark.llm import postings, trie, whitening

TURNS = "conv_id long, turn int, role string, text string, node string, depth int, digest string, x int"


def plain_trie(rows):
    """The trie by dictionaries, depth by depth."""
    talks = defaultdict(list)
    for c, turn, role, text, *_ in rows:
        if c is not None:
            role, text = role or "", text or ""
            talks[c].append(((turn is not None, turn or 0), hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).digest(), (role, text)))
    own = {c: [x[2] for x in sorted(v)] for c, v in talks.items()}
    nodes = defaultdict(lambda: [[], [], set()])
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        made = own.get(c - c % 100, [])[:h] + turns[h:]
        for d in range(len(made) + 1):
            nodes[tuple(made[:d])][0].append(c)
            if d:
                nodes[tuple(made[: d - 1])][2].add(tuple(made[:d]))
        nodes[tuple(made)][1].append(c)

    out = []
    for k, (members, ends, kids) in nodes.items():
        below = [x for x in nodes if x[: len(k)] == k]
        saved = sum((len(nodes[x][0]) - 1) * len(x[-1][1]) for x in below if x)
        up = min(nodes[k[:-1]][0]) if k else None
        sha = hashlib.sha256(",".join(map(str, sorted(ends))).encode()).hexdigest()
        out.append((min(members), len(k), up, len(members), len(kids), sum(not nodes[x][2] for x in below), saved, sha))
    return sorted(map(str, out))


def conversations(seed):
    rng = random.Random(seed)
    rows = []
    for c in [*range(0, 330, 7), 100, 200, 301, 302, 303]:
        for t in range(rng.choice([1, 2, 3, 4, 6, 9])):
            text = rng.choice([None, "", "yes", "no", "Ünï 😀 long " * 30])
            rows.append((c, rng.choice([None, t]), rng.choice(["user", "assistant", None]), text, "a", 1, "b", 2))
    rows += [rows[3]] * 3 + [(None, 1, "user", "lost", "a", 1, "b", 2), (500, None, None, None, None, None, None, None)]
    rows += [(404, t, "user", f"turn {t}", "a", 1, "b", 2) for t in range(40)]  # one long conversation
    return rows


@pytest.mark.parametrize("chunk", [4096, 3])
def test_prefix_trie(spark, monkeypatch, chunk):
    monkeypatch.setattr(trie, "CHUNK", chunk)
    rows = conversations(chunk)
    found = trie.prefix_trie(*trie.rebuilt(spark.createDataFrame(rows, TURNS).repartition(7)))
    assert found.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    assert sorted(str(tuple(r)) for r in found.collect()) == plain_trie(rows)


def test_prefix_trie_empty(spark):
    assert trie.prefix_trie(*trie.rebuilt(spark.createDataFrame([], TURNS))).count() == 0
    one = trie.prefix_trie(*trie.rebuilt(spark.createDataFrame([(9, 0, "user", "only", "a", 1, "b", 2)], TURNS))).collect()
    h = zlib.crc32(b"9") % 6
    assert h > 0 and [tuple(r)[:7] for r in one] == [(9, 0, None, 1, 0, 1, 0)]  # its base is absent: no turns are left


def test_chains(spark):
    """A chain of 37 nodes with a comb of leaves: sums of all depths after six rounds."""
    edges = [(f"n{k}", f"n{k - 1}", k) for k in range(1, 37)] + [(f"l{k}", f"n{k}", k + 1) for k in range(37)]
    values = [(n, int(n[0] == "l"), 10) for n in ["n0", *[e[0] for e in edges]]]
    found = trie.rolled_up(spark.createDataFrame(edges, "node string, parent string, depth long"), spark.createDataFrame(values, "node string, leaves long, saved long"), ["leaves", "saved"])
    got = {r["node"]: (r["leaves"], r["saved"]) for r in found.collect()}
    assert all(got[f"n{k}"] == (37 - k, 10 * 2 * (37 - k)) for k in range(37)) and got["l5"] == (1, 10)


def test_jacobi():
    """Singular values against numpy, also of odd sizes, dependent columns and widely graded ones."""
    rng = np.random.default_rng(1)
    for shape in ((5, 5), (7, 4), (3, 6), (1, 1), (40, 33)):
        m = rng.normal(size=shape) * 10.0 ** -np.arange(shape[1])[None] ** 0.5
        v, s = whitening.jacobi(m)
        want = np.linalg.svd(m, compute_uv=False)
        assert np.allclose(s[: len(want)], want, rtol=1e-12, atol=1e-14) and np.allclose(v.T @ v, np.eye(shape[1]), atol=1e-12)
        assert np.allclose(np.linalg.norm(m @ v, axis=0), s, atol=1e-12)
    m = np.triu(rng.normal(size=(6, 6))) @ np.diag(10.0 ** -np.arange(0, 12, 2))
    assert np.allclose(whitening.jacobi(m)[1], np.linalg.svd(m, compute_uv=False), rtol=1e-9)


VECTORS = "vec_id long, x array<long>, n long, dim int, state string, component int"


def test_whitening(spark):
    rng = np.random.default_rng(2)
    base = (rng.normal(size=(300, 24)) @ rng.normal(size=(24, 24)) * 40).astype(int) + 1_000_000
    rows = [(n, x.tolist(), 1, 2, "s", 3) for n, x in enumerate(base)]
    rows += [(1000 + n, base[0].tolist(), 1, 2, "s", 3) for n in range(200)]  # a group of copies counts once
    rows += [(None, base[5].tolist(), 1, 2, "s", 3), (2000, None, 1, 2, "s", 3), (2001, [], 1, 2, "s", 3), (2002, [1, None], 1, 2, "s", 3), (7, base[7].tolist(), 1, 2, "s", 3)]
    rows += [(3000, [1, 2, 3], 1, 2, "s", 3), (3001, [1, 2, 5], 1, 2, "s", 3), (4000, [9, 9], 1, 2, "s", 3)]
    found = whitening.whiten(spark.createDataFrame(rows, VECTORS).repartition(9)).toPandas()
    assert list(found.columns) == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    mine = found[found["n"] == 300]
    assert len(mine) == 16 * (300 + 200 + 2) and mine["identity_error"].nunique() == 1 and mine["identity_error"].iloc[0] < 1e-9
    y = base - base.mean(0)
    e, u = np.linalg.eigh(y.T @ y / 300)
    want = np.abs(y @ u[:, ::-1][:, :16] / np.sqrt(e[::-1][:16]))
    own = mine[mine["vec_id"] < 300].drop_duplicates(["vec_id", "component"]).sort_values(["vec_id", "component"])
    assert np.allclose(np.abs(own["whitened"].to_numpy().reshape(300, 16)), want, atol=1e-8)
    assert np.allclose(own["explained"].to_numpy()[:16], e[::-1][:16] / e.sum(), rtol=1e-9)
    exact = [int(sum((300 * int(a) - int(s)) ** 2 for a, s in zip(x, base.sum(0), strict=True))) for x in base]
    assert own["deviation"].to_numpy().reshape(300, 16)[:, 0].tolist() == exact
    few = found[found["n"] == 2]
    assert sorted(few["vec_id"]) == [3000, 3001] and set(few["component"]) == {1} and np.allclose(np.abs(few["whitened"]), 1)
    assert not len(found[found["n"] == 1]) and whitening.whiten(spark.createDataFrame([], VECTORS)).count() == 0
    assert (np.sign(mine[mine["vec_id"] >= 1000]["whitened"].to_numpy().reshape(200, 16)) == np.sign(own["whitened"].to_numpy()[:16])).all()


def test_whitening_large(spark):
    """Deviations past double precision stay exact; entries and deviations past 64 bits are an error."""
    rows = [(n, [2**40 + n * 12_345_677, 2**39 + n * n], 1, 2, "s", 3) for n in range(5)]
    found = {r["vec_id"]: r["deviation"] for r in whitening.whiten(spark.createDataFrame(rows, VECTORS)).collect()}
    total = [sum(r[1][k] for r in rows) for k in (0, 1)]
    assert found == {r[0]: sum((5 * r[1][k] - total[k]) ** 2 for k in (0, 1)) for r in rows}
    for top in (2**53, 2**50):
        with pytest.raises(Exception, match="scale the vectors down"):
            whitening.whiten(spark.createDataFrame([(1, [top], 1, 2, "s", 3), (2, [0], 1, 2, "s", 3)], VECTORS)).collect()


DOCS = "doc_id long, text string, h string, pos int, term string, n int, d int, c string"
ITEMS = "item_id long, text string, c string, words string, s int"


def plain_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def plain_hits(docs, items, slack):
    out = []
    for doc_id, text, *_ in docs:
        w, hit, names, near = plain_words(text), set(), set(), set()
        for item, t, *_ in items:
            x = plain_words(t)
            for s in range(max(1, len(x) - 9)) if x else []:
                win = x[s : s + 10]
                for p in range(len(w) - len(win) + 1):
                    if w[p : p + len(win)] == win:
                        hit |= set(range(p, p + len(win)))
                        names |= {str(item)} if item is not None else set()
                places = range(-slack, len(w) + slack)
                if item is not None and any(all(win[j] in w[max(0, p + j - slack) : max(0, p + j + slack + 1)] for j in range(len(win))) for p in places):
                    near.add(str(item))
        sha = hashlib.sha256(",".join(sorted(names)).encode()).hexdigest()
        out.append((doc_id, len(w), len(hit), len(names), sha, len(near), bool(hit)))
    return sorted(map(str, out))


def test_decontaminate(spark):
    rng = random.Random(4)
    vocabulary = ["the", "of", "And", "É", "é", "ALPHA9", "beta", "x7", "naïve", "gamma"] + [f"w{k}" for k in range(25)]
    say = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    items = [(n, say(rng.choice([12, 25, 40])), "c", "w", 1) for n in range(12)]
    items += [(90, items[0][1], "c", "w", 1), (91, items[0][1].upper().replace("É", "é"), "c", "w", 1), (3, items[3][1], "c", "w", 1), (3, say(15), "c", "w", 1), (None, say(20), "c", "w", 1)]
    items += [(100, "short item", "c", "w", 1), (101, "word", "c", "w", 1), (102, "", "c", "w", 1), (103, None, "c", "w", 1), (104, "the the the the the the the the the the the", "c", "w", 1), (105, "unseen words alone here", "c", "w", 1)]
    texts = [say(60) for _ in range(25)] + [None, "", "!!!", "word", "a short, ITEM here", " ".join(["the"] * 40)]
    for item in items[:12] + items[15:17]:
        x = (item[1] or "").split()
        cut = rng.randint(0, 3)
        texts.append(f"{say(8)}; {' '.join(x[cut:])}. {say(5)}")
        texts.append(f"{say(8)} {' '.join(x[:9])} {say(3)}")  # one word short of a window
        texts.append(f"{say(4)} {' '.join(x[:6])} inserted {' '.join(x[6:12])} {say(3)}")  # near only
        texts.append(f"{' '.join(x[:11])} {' '.join(x[5:])}")  # two overlapping runs
    texts.append(f"{items[0][1]} {items[1][1]} " + say(20_000))
    docs = [(n, t, "h", 1, "t", 2, 3, "c") for n, t in enumerate(texts)]
    docs += [docs[40]] * 3 + [(40, texts[41], "h", 1, "t", 2, 3, "c"), (None, texts[40], "h", 1, "t", 2, 3, "c"), (None, texts[40], "h", 1, "t", 2, 3, "c"), (0, None, None, None, None, None, None, None)]
    frames = spark.createDataFrame(docs, DOCS).repartition(6), spark.createDataFrame(items, ITEMS)
    found = postings.decontaminate(*frames)
    assert found.columns == ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "n_near", "contaminated"]
    got = sorted(str(tuple(r)) for r in found.collect())
    want = plain_hits(docs, items, postings.SLACK)
    assert got == want
    assert any("True" in r for r in got) and any("False" in r for r in got)
    plan = found._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow|ExternalRDD", plan)
    none = postings.decontaminate(frames[0], frames[1].where("false")).collect()
    assert len(none) == len(docs) and not any(r["contaminated"] or r["n_near"] for r in none)
    assert postings.decontaminate(frames[0].where("false"), frames[1]).count() == 0


def test_large_benchmark(spark, monkeypatch):
    """Beyond the bound of broadcasts the same rows come by shuffles."""
    rng = random.Random(9)
    items = [(n, " ".join(f"w{rng.randint(0, 60)}" for _ in range(14)), "c", "w", 1) for n in range(20)]
    docs = [(n, f"start {items[n % 20][1]} {'w1 ' * (n % 5)}", "h", 1, "t", 2, 3, "c") for n in range(30)]
    monkeypatch.setattr(postings, "SMALL", 0)
    found = postings.decontaminate(spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, ITEMS))
    assert sorted(str(tuple(r)) for r in found.collect()) == plain_hits(docs, items, postings.SLACK)
