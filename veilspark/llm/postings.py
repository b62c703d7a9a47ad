"""Benchmark decontamination over a positional inverted index, in SQL expressions only.

The index holds a posting (document, position, term) for every place of a term that the test items
use, and a header per document; it is stored once, and every later step reads it, not the texts.
Each window of a test item is looked up from its rarest terms: postings of the rarest give
candidates, which must meet a posting of the second rarest at the right distance. What
is left names a place of the item in the document, where the remaining terms are met
in the same way; runs of met terms as long as a window are exact matches. Proximity lets every
term lie up to ``slack`` positions from its place.

Terms that no document has end their windows at once. Windows with the same two terms at the same
distance share their candidates. Tables that grow with the test items are broadcast only
if counted small; what is asked of the index grows with the documents and is always merged.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import materialize, small

#: Words of texts in which A-Z are still as they were written.
WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WIDTH, SLACK = 10, 2
#: Rows of a table that is broadcast: documents or windows.
SMALL = 100_000
DOC = ["d", "h"]
PAIR = ["t1", "t2", "delta"]


def words(text: Column) -> Column:
    return F.regexp_extract_all(F.coalesce(text.cast("string"), F.lit("")), F.lit(WORD), F.lit(0))


def folded(word: Column) -> Column:
    """A word with A-Z in lower case; a word of ASCII alone takes the fast way."""
    return F.when(F.octet_length(word) == F.char_length(word), F.lower(word)).otherwise(F.translate(word, UPPER, LOWER))


def items(benchmark: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``c, words`` of each distinct word sequence of the items, and ``c, item`` of the ids that have it."""
    rows = benchmark.select(F.col("item_id").cast("string").alias("item"), F.transform(words(F.col("text")), folded).alias("words")).where(F.size("words") > 0)
    rows = materialize(rows.withColumn("c", F.sha2(F.concat_ws(" ", "words"), 256)))
    return rows.select("c", "words").dropDuplicates(["c"]), rows.where("item is not null").select("c", "item").distinct()


def index_of(docs: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """Postings ``doc_id, h, n, pos, term`` of all terms in ``vocabulary(term)``, positions from 1.

    ``h`` hashes the text; ``n`` is the document's number of words. Position 0 is the document's header, its term empty.
    """
    text = F.col("text").cast("string")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.col("doc_id").isNull(), text).alias("h"), words(text).alias("words"))
    placed = rows.select("doc_id", "h", F.size("words").alias("n"), F.posexplode(F.concat(F.array(F.lit("")), F.col("words"))).alias("pos", "word"))
    terms = vocabulary.select("term").union(vocabulary.sparkSession.range(1).select(F.lit("").alias("term"))).distinct()
    return materialize(placed.select("doc_id", "h", "n", "pos", folded(F.col("word")).alias("term")).join(small(terms, SMALL), "term"))


def headers(index: DataFrame) -> DataFrame:
    return index.where("pos = 0").select("doc_id", F.coalesce("doc_id", F.lit(0)).alias("d"), "h", F.col("n").cast("long").alias("n_words"))


def postings(index: DataFrame, keys: DataFrame) -> DataFrame:
    """``d, h, pos, term`` of the postings that ``keys`` (terms or documents) names, each once."""
    found = index.where("pos > 0").select(F.coalesce("doc_id", F.lit(0)).alias("d"), "h", "pos", "term")
    return found.join(small(keys, SMALL), keys.columns).select("d", "h", "pos", "term").distinct()


def windows_of(contents: DataFrame, index: DataFrame, width: int) -> DataFrame:
    """Windows whose terms all occur: ``c, s, w, t1, j1, t2, delta`` with start, terms, and the two rarest terms' places."""
    counts = materialize(index.where("pos > 0").groupBy("term").agg(F.count("*").alias("n")))
    starts = contents.select("c", "words", F.explode(F.sequence(F.lit(0), F.greatest(F.size("words") - width, F.lit(0)))).alias("s"))
    rows = starts.select("c", "s", F.posexplode(F.slice("words", F.col("s") + 1, F.lit(width))).alias("j", "term"))
    known = rows.join(small(counts, SMALL), "term", "left")
    sorts = known.groupBy("c", "s").agg(F.array_sort(F.collect_list(F.struct("n", "term", "j"))).alias("r"), F.array_sort(F.collect_list(F.struct("j", "term"))).alias("w"), F.count("*").alias("size"), F.count("n").alias("there"))
    first, second = F.col("r")[0], F.get("r", F.lit(1))
    return materialize(sorts.where("size = there").select("c", "s", F.col("w.term").alias("w"), first["term"].alias("t1"), first["j"].alias("j1"), second["term"].alias("t2"), F.coalesce(second["j"] - first["j"], F.lit(0)).alias("delta")))


def pairs_of(index: DataFrame, windows: DataFrame, slack: int) -> DataFrame:
    """Places where a window's rarest term meets its second rarest: ``d, h, p, t1, t2, delta, e``.

    ``e`` is how far the second is from its place relative to the first, twice ``slack`` at most; windows of one word are met by that word.
    """
    keys = materialize(windows.select(*PAIR).distinct())
    rare = postings(index, keys.select(F.col("t1").alias("term")).distinct()).withColumnsRenamed({"term": "t1", "pos": "p"})
    met = materialize(rare.join(small(keys, SMALL), "t1"))
    shifts = F.array(*[F.lit(e) for e in range(-2 * slack, 2 * slack + 1)])
    asked = met.where("t2 is not null").withColumn("e", F.explode(shifts)).select(*DOC, (F.col("p") + F.col("delta") + F.col("e")).alias("pos"), F.col("t2").alias("term"), "p", "t1", "delta", "e")
    there = postings(index, keys.where("t2 is not null").select(F.col("t2").alias("term")).distinct())
    two = asked.hint("merge").join(there, [*DOC, "pos", "term"]).withColumnRenamed("term", "t2")
    one = met.where("t2 is null").withColumn("e", F.lit(0))
    columns = [*DOC, "p", *PAIR, "e"]
    return materialize(two.select(*columns).unionByName(one.select(*columns)))


def exact_spans(index: DataFrame, windows: DataFrame, pairs: DataFrame) -> DataFrame:
    """Runs of an item's words in a document that are made of whole windows: ``d, h, c, first, last``."""
    same = F.col("t2").eqNullSafe(F.col("u2"))
    own = windows.withColumnsRenamed({"t1": "u1", "t2": "u2", "delta": "udelta"})
    placed = pairs.where("e = 0").join(small(own, SMALL), (F.col("t1") == F.col("u1")) & same & (F.col("delta") == F.col("udelta")))
    found = materialize(placed.select(*DOC, "c", (F.col("p") - F.col("j1") - F.col("s")).alias("at"), "s", "w"))
    line = [*DOC, "c", "at"]
    # each place of the item is asked for once, by the first window that holds it
    done = F.coalesce(F.max(F.col("s") + F.size("w")).over(Window.partitionBy(*line).orderBy("s").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    fresh = found.withColumn("skip", F.greatest(done - F.col("s"), F.lit(0))).where(F.col("skip") < F.size("w"))
    asked = fresh.select(*line, "s", "skip", F.size("w").alias("size"), F.posexplode(F.slice(F.col("w"), F.col("skip") + 1, F.size("w"))).alias("k", "term"))
    asked = asked.select(*line, "size", (F.col("s") + F.col("skip") + F.col("k")).alias("o"), "term").withColumn("pos", F.col("at") + F.col("o"))
    met = asked.hint("merge").join(postings(index, materialize(found.select(*DOC).distinct())), [*DOC, "pos", "term"])
    island = met.withColumn("run", F.col("o") - F.row_number().over(Window.partitionBy(*line).orderBy("o")))
    runs = island.groupBy(*line, "run", "size").agg(F.count("*").alias("n"), F.min("pos").alias("first"), F.max("pos").alias("last"))
    return materialize(runs.where("n >= size").select(*DOC, "c", "first", "last"))


def near_items(index: DataFrame, windows: DataFrame, pairs: DataFrame, exact: DataFrame, slack: int) -> DataFrame:
    """``d, h, c`` of items not in ``exact`` with a window whose words all lie within ``slack`` positions of their places."""
    own = windows.withColumnsRenamed({"t1": "u1", "t2": "u2", "delta": "udelta"})
    same = (F.col("t1") == F.col("u1")) & F.col("t2").eqNullSafe(F.col("u2")) & (F.col("delta") == F.col("udelta"))
    rest = pairs.join(small(own, SMALL), same).join(exact, [*DOC, "c"], "left_anti")
    moved = F.array(*[F.lit(x) for x in range(-slack, slack + 1)])
    starts = rest.withColumn("f", F.explode(moved)).where(F.abs(F.col("e") - F.col("f")) <= slack).select(*DOC, "c", "s", "w", (F.col("p") - F.col("j1") + F.col("f")).alias("at"))
    starts = materialize(starts.distinct())
    asked = starts.select(*DOC, "c", "s", "at", F.size("w").alias("size"), F.posexplode("w").alias("j", "term")).withColumn("g", F.explode(moved))
    asked = asked.withColumn("pos", F.col("at") + F.col("j") + F.col("g"))
    met = asked.hint("merge").join(postings(index, materialize(starts.select(*DOC).distinct())), [*DOC, "pos", "term"]).select(*DOC, "c", "s", "at", "size", "j").distinct()
    whole = met.groupBy(*DOC, "c", "s", "at", "size").agg(F.count("*").alias("n")).where("n = size")
    return whole.select(*DOC, "c").distinct()


def decontaminate(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH, slack: int = SLACK) -> DataFrame:
    """What each row of ``docs(doc_id, text)`` holds of the items of ``benchmark(item_id, text)``.

    Returns ``doc_id, n_words, n_hit`` (words inside an occurring window of ``width`` item words, or of a whole shorter item), ``n_items,
    items_sha256`` (ids of the items with occurring windows), ``n_near`` (items with a window whose words all lie
    within ``slack`` positions of their places, those of ``n_items`` included) and ``contaminated``.

    Null and empty texts have no words. Rows of null or repeated ``doc_id`` are judged on their own and come back as often as
    they came. Items of null id mark words, but do not count among items; repeated ids count once. Texts of any length are
    read whole; other columns are not read; an empty table of documents gives an empty result, one of items none contaminated.
    """
    contents, ids = items(benchmark)
    vocabulary = contents.select(F.explode("words").alias("term")).distinct()
    index = index_of(docs, vocabulary)
    windows = windows_of(contents, index, width)
    pairs = pairs_of(index, windows, slack)
    spans = exact_spans(index, windows, pairs)
    exact = materialize(spans.select(*DOC, "c").distinct())
    near = near_items(index, windows, pairs, exact, slack).withColumn("near", F.lit(True))
    before = F.coalesce(F.max("last").over(Window.partitionBy(*DOC).orderBy("first", "last").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    fresh = F.greatest(F.col("last") - F.greatest(F.col("first") - 1, before), F.lit(0)).cast("long")
    hits = spans.select(*DOC, "first", "last").distinct().withColumn("fresh", fresh).groupBy(*DOC).agg(F.sum("fresh").alias("n_hit"))
    named = exact.withColumn("near", F.lit(False)).unionByName(near).join(small(ids, SMALL), "c")
    sets = named.groupBy(*DOC).agg(F.array_sort(F.collect_set(F.when(~F.col("near"), F.col("item")))).alias("items"), F.count_distinct("item").alias("n_near"))
    none = F.sha2(F.lit("").cast("binary"), 256)
    joined = headers(index).join(hits, DOC, "left").join(sets, DOC, "left")
    return joined.select(
        "doc_id", "n_words", F.coalesce("n_hit", F.lit(0)).alias("n_hit"), F.coalesce(F.size("items"), F.lit(0)).cast("long").alias("n_items"),
        F.coalesce(F.sha2(F.concat_ws(",", "items").cast("binary"), 256), none).alias("items_sha256"), F.coalesce("n_near", F.lit(0)).alias("n_near"),
        (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"),
    )


def op13(spark, sf_dir):
    return decontaminate(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


OP13_SQL = r"""
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
items AS (SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
wins AS (SELECT item, s, least(10, len(w)) AS size, w[s + 1:s + least(10, len(w))] AS t FROM (SELECT item, w, unnest(range(greatest(len(w) - 10, 0) + 1)) AS s FROM items WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT size FROM wins),
slices AS (SELECT r, size, p, array_to_string(w[p:p + size - 1], ' ') AS x FROM (SELECT r, w, size, unnest(range(1, len(w) - size + 2)) AS p FROM docs, sizes WHERE len(w) >= size)),
found AS (SELECT r, item, p, slices.size AS size FROM slices JOIN (SELECT item, size, array_to_string(t, ' ') AS x FROM wins) USING (size, x)),
hit AS (SELECT r, count(DISTINCT q) AS n_hit FROM (SELECT r, unnest(range(p, p + size)) AS q FROM found) GROUP BY r),
named AS (SELECT r, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS ids FROM found GROUP BY r),
tok AS (SELECT r, unnest(w) AS t, generate_subscripts(w, 1) AS p FROM docs),
wj AS (SELECT item, s, size, unnest(t) AS t, unnest(range(size)) AS j FROM wins),
cf AS (SELECT t, count(*) AS n FROM tok WHERE t IN (SELECT t FROM wj) GROUP BY t),
rare AS (SELECT item, s, size, min((coalesce(n, 0), t, j)) AS m FROM wj LEFT JOIN cf USING (t) GROUP BY item, s, size),
starts AS (SELECT DISTINCT r, item, s, size, p - m[3] + f AS a FROM rare JOIN tok ON tok.t = m[2], range(-2, 3) g(f)),
whole AS (SELECT r, item FROM starts JOIN wj USING (item, s, size) JOIN tok USING (r, t) WHERE p BETWEEN a + j - 2 AND a + j + 2 GROUP BY r, item, s, a, size HAVING count(DISTINCT j) = size),
near AS (SELECT r, count(DISTINCT item) AS n_near FROM whole GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_near, 0) AS n_near, coalesce(n_hit, 0) > 0 AS contaminated
FROM docs LEFT JOIN hit USING (r) LEFT JOIN named USING (r) LEFT JOIN near USING (r)
"""
