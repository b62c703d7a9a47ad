"""Queries whose work must grow no faster than their input."""

import hashlib
import re
import time
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from veilspark.functions import spans as S
from veilspark.operators import linking, related, textindex
from veilspark.plans import corpus, facts, glossary, mailing


def plan(df):
    return df._jdf.queryExecution().toString()


def write(spark, folder, table, rows, schema):
    spark.createDataFrame(rows, schema).write.parquet(f"{folder}/{table}.parquet")


def test_word_spans_without_rows_of_words(spark, tmp_path):
    texts = ["Walking, Walking (Readers) to NewYorkers\n\tOrange", "xSomethingElsewhere Friday", "", None, "Monday", "of Mondayx-Tuesday\r\nSunday x"]
    write(spark, tmp_path, "documents", [(k, t, "s") for k, t in enumerate(texts)], "doc_id long, text string, source string")
    want = []
    for k, t in enumerate(texts):
        words = [(m.start(), m.end()) for m in re.finditer("[^ \t\r\n]+", t or "")]
        for m in re.finditer("[A-Z][a-z]{5,}", t or ""):
            at = [i for i, (a, b) in enumerate(words) if a < m.end() and b > m.start()]
            want.append((k, m.start(), at[0], at[-1], words[at[0]] == m.span()))
    found = corpus.word_spans(spark, str(tmp_path))
    assert sorted(tuple(r) for r in found.collect()) == sorted(want)
    assert "Join" not in plan(found)


def test_located_copies_little(spark):
    def seconds(n):
        t = spark.range(1).select(F.repeat(F.lit("ab "), n).alias("t")).select(F.aggregate(S.located(F.col("t"), "[a-z]+"), F.lit(0).cast("long"), lambda s, m: s + m["start"]).alias("s"))
        began = time.time()
        assert t.first()[0] == 3 * n * (n - 1) // 2
        return time.time() - began

    seconds(1000)
    assert seconds(40_000) < 10  # over a minute with one pass that appends


def test_related_reads_little_of_common_entities(spark):
    """Documents of one group share rare names and a name of a third of all: that one is not read once for each of them."""
    rows = [(k, f"g{k // 8}") for k in range(2400)] + [(k, f"h{k // 8}") for k in range(2400)] + [(k, "common") for k in range(0, 2400, 3)]
    frame, work = related.related(spark.createDataFrame(rows, "doc long, term string"), 2400, 2)
    got = {(r["doc"], r["other"]): list(r["shared"]) for r in frame.collect()}
    assert len(got) == 4800 and got[0, 3] == ["g0", "h0", "common"] and got[0, 6] == ["g0", "h0", "common"]
    assert "Join" in plan(frame) and work["postings"] < 60_000  # all pairs of the common name are 640,000


def test_overlap_counts_in_batches(spark, sf):
    found = corpus.overlap_cases(spark, sf)
    assert found.count() > 0 and "FlatMapGroupsInPandas" not in plan(found)


def test_mail_is_read_once(spark, sf):
    """Parsing, redaction and detection of a message happen once, whatever the number of tables made of it."""
    found = mailing.m4_pipeline(spark, sf)
    assert found.count() > 0 and "MapInPandas" not in plan(found) and "mailbox" not in plan(found)


def test_line_diff_batches_are_short(spark, sf):
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    try:
        spark.conf.set(name, "10000")
        corpus.diffs(spark, sf)
        assert int(spark.conf.get(name)) <= 500
    finally:
        spark.conf.set(name, before)


def test_many_terms_read_texts_once(spark):
    """More terms than one automaton takes: no automaton of all, no pass for each list; long terms of one beginning, short ones, ids beyond 2^53."""
    long = "Somewhere Beyond The Rivers And The Hills Of The North "
    terms = [f"Name{k} of" for k in range(60)] + [long + x for x in ("a", "b", "ü")] + ["a", "é", "Name1", "😀 x"]
    texts = [f"Name{k} of {long}{'abü'[k % 3]} Name1 of é😀 xName{k + 7} of" for k in range(50)] + ["", None, "nothing here"]
    rows = [(2**60 + n, t) for n, t in enumerate(texts)] + [(None, texts[0]), (2**60, texts[0])]
    found = linking.linked(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), spark.createDataFrame([(t,) for t in terms], "term string"), most=3)
    got = sorted((str(r["doc_id"]), r["text"], str([tuple(m) for m in r["links"]])) for r in found.collect())
    assert got == sorted((str(d), t or "", str(linking.plain_links(t or "", terms))) for d, t in rows)
    assert "FlatMapCoGroupsInArrow" in plan(found) and "Union" not in plan(found)


def test_rendering_is_linear(spark):
    """Pieces of a text are cut once, not found from its beginning for each link."""
    df = spark.createDataFrame([(1, "Ann of " * 40_000)], "doc_id long, text string")
    shown = linking.linked(df, spark.createDataFrame([("Ann",)], "term string")).select(*[F.md5(linking.rendered(s)).alias(s) for s in linking.STYLES])
    began = time.time()
    assert shown.first()["wiki"] == hashlib.md5(("[[Ann]] of " * 40_000).encode()).hexdigest()
    assert time.time() - began < 15 and "substring" not in plan(shown)


def test_entries_read_documents_once(spark, tmp_path):
    """Terms are counted as strings in one reading, without places and passes over arrays; the counts are those of each pattern by itself."""
    texts = [
        "Walking, then Walking,then Ab cd Readers  of McDonaldson Of x A bc ABcdefg hi", "Somebody.Here@Walking.Example.com_Xy@Readers.org x@y.z @ 1.2.3.4.5.6.7.8 12.34.56.789",
        "Écoles Élysées Walkingé ofé Readers\nof Readers, \tof Sunday,  x Monday ,y Tuesday , z", "", None, "1234.5.6.7 9.9.9.9@x.com Ann Lee Annotated lee, Xyzzyab cd9 Xyzzyab",
    ]
    write(spark, tmp_path, "documents", [(k, t, "s") for k, t in enumerate(texts * 2 + texts[:2])], "doc_id long, text string, source string")
    patterns = {**facts.KINDS, "organisation": glossary.PHRASE}
    seen = Counter((c, m) for t in texts * 2 + texts[:2] for c, p in patterns.items() for m in re.findall(p, t or ""))
    want = {(c, m): (n, 100 if c in ("email", "ip_address") else len(m) * 13 % 61 + 40) for (c, m), n in seen.items()}
    for least in (1, 3):
        found = glossary.entries(spark, str(tmp_path), least)
        assert {(r["category"], r["term"]): (r["n"], r["hundredths"]) for r in found.collect()} == {k: (n, h) for k, (n, h) in want.items() if n >= least and h >= 50}
    text = plan(glossary.entries(spark, str(tmp_path))).split("== Physical Plan ==")[1]
    assert text.count("FileScan") == text.count("regexp_extract_all") // 3 == 1 and "aggregate(" not in text.lower().replace("hashaggregate(", "")


def test_short_terms_are_hashed_where_they_may_begin(monkeypatch):
    """A window of few bytes is hashed only where a term of that length may begin, not at every place."""
    data = ("x" * 50 + "Is a" + "é" * 20).encode() * 500
    whole, asked, at = linking.Windows(data), [], linking.Windows.at
    for n in (1, 4, 6, 48, len(data), len(data) + 1):
        every = whole.at(np.arange(max(0, len(data) - n + 1)), n)
        assert whole.all(n).tolist() == every.tolist() and whole.all(n, 40_000, 7).tolist() == every[40_000:40_007].tolist()
    firsts, heads, bits = np.zeros(256, np.uint64), np.zeros(1 << linking.HEADS, np.uint64), np.full(4, 2**64 - 1, np.uint64)
    firsts[ord("I")] = 1 << 4
    monkeypatch.setattr(linking.Windows, "at", lambda self, start, n: asked.append(len(start)) or at(self, start, n))
    assert linking.candidates(data, [4], firsts, heads, bits).tolist() == [int(linking.Windows(b"Is a").all(4)[0])]
    heads[int(linking.Windows(b"Is a\xc3\xa9").all(6)[0]) >> 64 - linking.HEADS] = 1 << 7
    assert linking.candidates(data, [7], firsts, heads, bits).tolist() == [int(linking.Windows(b"Is a\xc3\xa9\xc3").all(7)[0])]
    assert sum(asked) < 1100 and len(linking.candidates(b"", [4], firsts, heads, bits)) == 0


@pytest.mark.parametrize("most", [100, 2])
def test_anchors_are_made_once_for_a_term(spark, most):
    """Rendering takes the anchors that come with the links; they are those of ``anchor``."""
    terms = ["Ann Lee", "É😀x", "[Z]\t9", "ÀB", "\u212aelvin K", "İi"]
    docs = spark.createDataFrame([(k, f"a {t} {terms[0]}, {t}") for k, t in enumerate(terms)], "doc_id long, text string")
    found = linking.linked(docs, spark.createDataFrame([(t,) for t in terms], "term string"), most=most)
    got = found.select("anchors", F.transform("links", lambda m: linking.anchor(m["term"])).alias("want"), *[linking.rendered(s) for s in linking.STYLES])
    assert all(len(r["anchors"]) == 3 and r["anchors"] == r["want"] for r in got.collect())
    assert "regexp_replace" not in plan(found.select(linking.rendered("html")))


def test_search_moves_no_postings_per_query(spark):
    """What a search moves are lists of a shard's postings and k texts of a shard for each query, not a row for each posting that a query reads."""
    df = spark.range(20_000).select("id", F.concat_ws(" ", F.lit("common words of all"), F.concat(F.lit("w"), F.translate((F.col("id") % 997).cast("string"), "0123456789", "abcdefghij"))).alias("text"))
    found, work = textindex.search(textindex.build(df), df.where("id % 100 = 0").select(F.col("id").alias("query_id"), "text"), 3)
    got = {(r["query_id"], r["rank"]): r["id"] for r in found.collect()}
    assert len(got) == 600 and all(got[q, 1 + n] == q % 997 + 997 * n for q in range(0, 20_000, 100) for n in range(3))
    assert work["read"] < work["asked"] and "explode" not in plan(found).lower() and "Join" not in plan(found)
    left = spark.read.parquet(*found.inputFiles())  # what the shards hand on
    assert left.where("query_id is not null").count() <= 200 * 3 * 2 * spark.sparkContext.defaultParallelism
