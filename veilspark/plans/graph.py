"""Entity graph, training records, prompt assembly and projections, with SQL beside them.

Capitalised words stand in for entities.
"""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import spans as S

NAME = "[A-Z][a-z]{5,}"
MAIL = "[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+[.][A-Za-z]{2,}"
DATE = "[0-9]{4}-[0-9]{2}-[0-9]{2}"
REACH, CONTEXT = 300, 120


def documents(spark, d):
    return spark.read.parquet(f"{d}/documents.parquet")


def places(spark, d):
    """One row per mention: where it is, up to REACH characters after it, CONTEXT around it."""
    rows = documents(spark, d).select("doc_id", "text", F.explode(S.located(F.col("text"), NAME)).alias("m"))
    start, end = F.col("m.start"), F.col("m.end")
    before = F.greatest(start - CONTEXT, F.lit(0))
    return rows.select(
        "doc_id", F.col("m.text").alias("term"), start.alias("start"), end.alias("end"),
        F.substring("text", end + 1, F.lit(REACH)).alias("after"), F.substring("text", before + 1, end + CONTEXT - before).alias("around"),
    )


def e7_edges(spark, d):
    """Two terms of a document with at most 300 characters and no blank line between them.

    Mentions meet in blocks of 300 characters, so a long document never pairs all of its mentions.
    """
    m = places(spark, d)
    a = m.select("doc_id", "term", "end", "after", F.explode(F.array(F.floor(F.col("end") / REACH), F.floor(F.col("end") / REACH) + 1)).alias("block")).alias("a")
    b = m.select("doc_id", "term", "start", F.floor(F.col("start") / REACH).alias("block")).alias("b")
    gap = F.col("b.start") - F.col("a.end")
    near = a.join(b, (F.col("a.doc_id") == F.col("b.doc_id")) & (F.col("a.block") == F.col("b.block")) & (F.col("a.term") != F.col("b.term")) & (gap >= 0) & (gap <= REACH))
    pairs = near.select(F.col("a.doc_id").alias("doc_id"), F.least("a.term", "b.term").alias("one"), F.greatest("a.term", "b.term").alias("two"), gap.alias("gap"), F.left(F.col("a.after"), gap).alias("between"))
    sound = pairs.where(~F.col("between").rlike("\n[ \t]*\n"))
    best = F.min(F.struct("gap", F.when(F.col("between").rlike("[.!?]"), 0.3).otherwise(0.6).alias("confidence")))
    return sound.groupBy("doc_id", "one", "two").agg(best.alias("b")).select("doc_id", "one", "two", F.col("b.gap").cast("long").alias("gap"), F.col("b.confidence").alias("confidence"))


def e9_ranked(spark, d, limit=5):
    """For each term the terms it occurs with, best confidence first, then most documents."""
    e = e7_edges(spark, d).groupBy("one", "two").agg(F.max("confidence").alias("confidence"), F.count("*").alias("docs"))
    both = e.unionByName(e.select(F.col("two").alias("one"), F.col("one").alias("two"), "confidence", "docs"))
    w = Window.partitionBy("one").orderBy(F.col("confidence").desc(), F.col("docs").desc(), "two")
    return both.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= limit).select(F.col("one").alias("term"), F.col("two").alias("other"), "confidence", "docs", "rank")


def e11_quotes(spark, d, limit=3):
    """The first quotations of each term with their surroundings, white space collapsed."""
    w = Window.partitionBy("term").orderBy("doc_id", "start")
    q = places(spark, d).select("term", "doc_id", "start", "around").withColumn("n", F.row_number().over(w)).where(F.col("n") <= limit)
    return q.select("term", "n", F.trim(F.regexp_replace("around", "[ \t\r\n]+", " ")).alias("quote"))


def e12_index(spark, d, limit=100):
    terms = documents(spark, d).select(F.explode(F.regexp_extract_all("text", F.lit(NAME), F.lit(0))).alias("term"))
    return terms.groupBy("term").agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), "term").limit(limit)


def e17_links(spark, d):
    """The relative link from each page to the one after it, by the directories that they share."""
    path = F.split(F.regexp_extract("url", "^[^/]*//[^/]*(/[^?#]*)", 1), "/")
    p = spark.read.parquet(f"{d}/pages.parquet").where("page_id is not null").groupBy("page_id").agg(F.min("url").alias("url")).select("page_id", path.alias("x"))
    folders = lambda c: F.slice(c, F.lit(1), F.greatest(F.size(c) - 1, F.lit(0)))
    pair = p.join(p.select((F.col("page_id") - 1).alias("page_id"), F.col("x").alias("y")), "page_id")
    up = F.aggregate(F.sequence(F.lit(1), F.lit(64)), F.lit(0), lambda n, i: F.when((n == i - 1) & (i <= F.size(folders(F.col("x")))) & (i <= F.size(folders(F.col("y")))) & (F.try_element_at("x", i) == F.try_element_at("y", i)), i).otherwise(n))
    shared = pair.withColumn("same", up)
    back = F.repeat(F.lit("../"), F.size(folders(F.col("x"))) - F.col("same"))
    return shared.select("page_id", F.concat(back, F.array_join(F.slice("y", F.col("same") + 1, F.size("y")), "/")).alias("link"))


def t2_offsets(spark, d):
    """Where the third word of a passage is in it: its offset if there is one occurrence, else null."""
    t = spark.read.parquet(f"{d}/benchmark.parquet").select("item_id", "text", F.split("text", " ")[2].alias("word"))
    hits = F.filter(F.sequence(F.lit(1), F.greatest(F.char_length("text"), F.lit(1))), lambda i: F.substring(F.col("text"), i, F.char_length("word")) == F.col("word"))
    return t.where("word <> ''").select("item_id", F.size(hits).cast("long").alias("hits"), F.when(F.size(hits) == 1, F.get(hits, F.lit(0)) - 1).cast("long").alias("start"))


def t4_records(spark, d):
    """Per document its mentions by label, distinct, in order of appearance, as JSON."""
    found = lambda p: F.array_distinct(F.regexp_extract_all("text", F.lit(p), F.lit(0)))
    return documents(spark, d).select("doc_id", F.to_json(F.struct(found(NAME).alias("name"), found(DATE).alias("date"))).alias("entities"))


def t7_wide(spark, d, most=8):
    """Mentions (runs of capitalised words) of more than ``most`` tokens, and the widest."""
    runs = F.regexp_extract_all("text", F.lit("[A-Z][a-z]+(?: [A-Z][a-z]+)*"), F.lit(0))
    n = documents(spark, d).select(F.explode(F.transform(runs, lambda r: F.size(F.split(r, " ")))).alias("n"))
    return n.agg(F.count_if(F.col("n") > most).alias("violations"), F.max("n").cast("long").alias("widest"), F.count("*").alias("mentions"))


TERMS = ["the", "and", "license", "data"]


def k6_term_hits(spark, d):
    hits = F.filter(F.array(*[F.lit(t) for t in TERMS]), lambda t: F.contains(F.lower(F.col("text")), t))
    return spark.read.parquet(f"{d}/conversations.parquet").select("conv_id", "turn", F.size(hits).cast("long").alias("score")).where("score > 0")


def k13_acl(spark, d):
    leaves = F.map_values(F.from_json("props", "map<string,string>"))
    return spark.read.parquet(f"{d}/events.parquet").where(F.exists(leaves, lambda v: v == "69")).select("event_id")


def k14_inherit(spark, d):
    docs = spark.read.parquet(f"{d}/documents.parquet").select(F.col("doc_id").alias("conv_id"), "source")
    return spark.read.parquet(f"{d}/conversations.parquet").join(docs, "conv_id", "left").select("conv_id", "turn", F.coalesce("source", F.lit("default")).alias("tenant"))


def k22_listing(spark, d, offset=20, limit=50):
    """A page of the newest rows with the number of all rows."""
    e = spark.read.parquet(f"{d}/events.parquet")
    page = e.orderBy(F.col("ts").desc(), F.col("event_id").desc()).offset(offset).limit(limit).select("event_id")
    return page.join(F.broadcast(e.agg(F.count("*").alias("total"))))  # one row


def k31_context(spark, d, chunks=5):
    """The context of an answer: a conversation's first turns, joined by blank lines."""
    w = Window.partitionBy("conv_id").orderBy("turn", "text")
    first = spark.read.parquet(f"{d}/conversations.parquet").withColumn("n", F.row_number().over(w)).where(F.col("n") <= chunks)
    texts = F.transform(F.array_sort(F.collect_list(F.struct("n", F.coalesce("text", F.lit("")).alias("text")))), lambda x: x["text"])
    return first.groupBy("conv_id").agg(F.md5(F.array_join(texts, "\n\n")).alias("context_md5"))


def k34_projection(spark, d, size=1024, overlap=100):
    """Chunk rows of a document with ids made of document, version and ordinal."""
    t = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("source_hash", F.sha2("text", 256))
    starts = F.sequence(F.lit(0), F.greatest(F.char_length("text") - 1 - overlap, F.lit(0)), F.lit(size - overlap))
    c = t.select("doc_id", "source_hash", F.posexplode(F.transform(starts, lambda a: F.char_length(F.substring("text", a + 1, F.lit(size))))).alias("n", "chars"))
    return c.select(F.format_string("%d:1:%d", "doc_id", "n").alias("chunk_id"), "source_hash", F.col("chars").cast("long").alias("chars"))


def k35_revision(spark, d):
    key = F.concat_ws("|", F.col("event_id").cast("string"), F.col("user_id").cast("string"), "event_type", F.lit("p1"))
    return spark.read.parquet(f"{d}/events.parquet").select("event_id", F.concat(F.lit("v-"), F.sha2(key, 256)).alias("revision"))


def r5_template(spark, d):
    """A custom template around each e-mail address."""
    return spark.read.parquet(f"{d}/documents.parquet").select("doc_id", F.md5(F.regexp_replace("text", MAIL, "<MAIL:$0>")).alias("text_md5"))


def r10_fingerprint(spark, d):
    """FNV-1a, 32 bits, of a short ASCII value."""
    codes = F.transform(F.split("event_type", ""), lambda c: F.ascii(c).cast("long"))
    fnv = F.aggregate(codes, F.lit(2166136261), lambda h, c: (h.bitwiseXOR(c) * 16777619).bitwiseAND(F.lit(0xFFFFFFFF)))
    return spark.read.parquet(f"{d}/events.parquet").groupBy("event_type").agg(F.count("*").alias("n")).select("event_type", "n", fnv.alias("fingerprint"))


def r15_lines(spark, d):
    """Lines of a document as text and token nodes: how many of each a masked line has."""
    masked = documents(spark, d).select("doc_id", F.posexplode(F.split(F.regexp_replace("text", MAIL, "[EMAIL]"), "\n")).alias("line", "s"))
    n = F.regexp_count("s", F.lit(r"\[EMAIL\]"))
    return masked.where(n > 0).select("doc_id", F.col("line").cast("long").alias("line"), n.cast("long").alias("tokens"), F.char_length(F.replace("s", F.lit("[EMAIL]"), F.lit(""))).cast("long").alias("text_chars"))


QUERIES = {
    "e7_cooccurrence": e7_edges, "e9_rank_cooccurring": e9_ranked, "e11_quotes": e11_quotes, "e12_glossary_index": e12_index,
    "e17_relative_links": e17_links, "t2_offset_resolve": t2_offsets, "t4_record_emit": t4_records, "t7_width_violations": t7_wide,
    "k6_term_hits": k6_term_hits, "k13_acl_match": k13_acl, "k14_inherit_tenant": k14_inherit, "k22_listing": k22_listing, "k31_answer_context": k31_context,
    "k34_projection": k34_projection, "k35_revision_id": k35_revision, "r5_custom_template": r5_template, "r10_fingerprint": r10_fingerprint, "r15_editor_lines": r15_lines,
}

PLACES = f"""m AS (SELECT doc_id, text, regexp_extract_all(text, '{NAME}') AS f, regexp_split_to_array(text, '{NAME}') AS g FROM documents),
  r AS (SELECT doc_id, generate_subscripts(f, 1) AS i, unnest(f) AS term, unnest(g[1:len(f)]) AS gap FROM m WHERE len(f) > 0),
  q AS (SELECT doc_id, term, CAST(sum(length(gap) + length(term)) OVER (PARTITION BY doc_id ORDER BY i) AS BIGINT) AS e FROM r),
  p AS (SELECT doc_id, term, e - length(term) AS s, e FROM q)"""
EDGES = f"""{PLACES}, c AS (SELECT a.doc_id, a.term AS x, b.term AS y, b.s - a.e AS gap, substr(text, a.e + 1, b.s - a.e) AS t FROM p a JOIN p b ON a.doc_id = b.doc_id AND b.s BETWEEN a.e AND a.e + {REACH} AND a.term <> b.term JOIN documents ON a.doc_id = documents.doc_id),
  k AS (SELECT doc_id, least(x, y) AS one, greatest(x, y) AS two, gap, CAST(CASE WHEN regexp_matches(t, '[.!?]') THEN 0.3 ELSE 0.6 END AS DOUBLE) AS conf FROM c WHERE NOT regexp_matches(t, '\\n[ \\t]*\\n')),
  edges AS (SELECT doc_id, one, two, min(gap) AS gap, arg_min(conf, (gap, conf)) AS confidence FROM k GROUP BY 1, 2, 3)"""

SQL = {
    "e7_cooccurrence": f"WITH {EDGES} SELECT * FROM edges",
    "e9_rank_cooccurring": f"""WITH {EDGES}, s AS (SELECT one, two, max(confidence) AS confidence, count(*) AS docs FROM edges GROUP BY 1, 2), b AS (SELECT one AS term, two AS other, confidence, docs FROM s UNION ALL SELECT two, one, confidence, docs FROM s)
        SELECT term, other, confidence, docs, row_number() OVER (PARTITION BY term ORDER BY confidence DESC, docs DESC, other) AS rank FROM b QUALIFY rank <= 5""",
    "e11_quotes": f"""WITH {PLACES}, n AS (SELECT *, row_number() OVER (PARTITION BY term ORDER BY doc_id, s) AS n FROM p QUALIFY n <= 3)
        SELECT term, n, trim(regexp_replace(substr(text, greatest(s - {CONTEXT}, 0) + 1, e + {CONTEXT} - greatest(s - {CONTEXT}, 0)), '[ \\t\\r\\n]+', ' ', 'g'), ' ') AS quote FROM n JOIN documents USING (doc_id)""",
    "e12_glossary_index": f"SELECT term, count(*) AS n FROM (SELECT unnest(regexp_extract_all(text, '{NAME}')) AS term FROM documents) GROUP BY term ORDER BY n DESC, term LIMIT 100",
    "e17_relative_links": """WITH u AS (SELECT page_id, min(url) AS url FROM pages WHERE page_id IS NOT NULL GROUP BY page_id), p AS (SELECT page_id, string_split(regexp_extract(url, '^[^/]*//[^/]*(/[^?#]*)', 1), '/') AS x FROM u),
        j AS (SELECT a.page_id, a.x, b.x AS y, least(len(a.x), len(b.x)) - 1 AS m FROM p a JOIN p b ON b.page_id = a.page_id + 1),
        s AS (SELECT *, coalesce(list_min(list_filter(range(1, m + 1), lambda i: x[i] <> y[i])) - 1, m) AS same FROM j)
        SELECT page_id, repeat('../', CAST(len(x) - 1 - same AS BIGINT)) || array_to_string(y[same + 1:], '/') AS link FROM s""",
    "t2_offset_resolve": """WITH w AS (SELECT item_id, text, string_split(text, ' ')[3] AS word FROM benchmark), h AS (SELECT item_id, word, list_filter(range(1, length(text) + 1), lambda i: substr(text, i, length(word)) = word) AS h FROM w)
        SELECT item_id, len(h) AS hits, CASE WHEN len(h) = 1 THEN h[1] - 1 END AS start FROM h WHERE word <> ''""",
    "t4_record_emit": f"""WITH f AS (SELECT doc_id, regexp_extract_all(text, '{NAME}') AS n, regexp_extract_all(text, '{DATE}') AS t FROM documents),
        u AS (SELECT doc_id, list_filter(n, lambda x, i: list_position(n, x) = i) AS n, list_filter(t, lambda x, i: list_position(t, x) = i) AS t FROM f)
        SELECT doc_id, '{{"name":' || CAST(to_json(n) AS VARCHAR) || ',"date":' || CAST(to_json(t) AS VARCHAR) || '}}' AS entities FROM u""",
    "t7_width_violations": "WITH r AS (SELECT unnest(regexp_extract_all(text, '[A-Z][a-z]+(?: [A-Z][a-z]+)*')) AS r FROM documents), n AS (SELECT len(string_split(r, ' ')) AS n FROM r) SELECT count(*) FILTER (n > 8) AS violations, max(n) AS widest, count(*) AS mentions FROM n",
    "k6_term_hits": "WITH s AS (SELECT conv_id, turn, " + " + ".join(f"CAST(contains(lower(text), '{t}') AS BIGINT)" for t in TERMS) + " AS score FROM conversations) SELECT * FROM s WHERE score > 0",
    "k13_acl_match": "SELECT event_id FROM events WHERE len(list_filter(json_keys(props), lambda k: json_extract_string(props, '$.' || k) = '69')) > 0",
    "k14_inherit_tenant": "SELECT conv_id, turn, coalesce(source, 'default') AS tenant FROM conversations LEFT JOIN documents ON conv_id = doc_id",
    "k22_listing": "SELECT event_id, (SELECT count(*) FROM events) AS total FROM events ORDER BY ts DESC, event_id DESC LIMIT 50 OFFSET 20",
    "k31_answer_context": "WITH f AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn, text) AS n FROM conversations QUALIFY n <= 5) SELECT conv_id, md5(string_agg(coalesce(text, ''), chr(10) || chr(10) ORDER BY n)) AS context_md5 FROM f GROUP BY conv_id",
    "k34_projection": "WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents), c AS (SELECT doc_id, text, unnest(range(0, greatest(length(text) - 1 - 100, 0) + 1, 924)) AS a FROM t) SELECT doc_id || ':1:' || (a // 924) AS chunk_id, sha256(text) AS source_hash, length(substr(text, a + 1, 1024)) AS chars FROM c",
    "k35_revision_id": "SELECT event_id, 'v-' || sha256(event_id || '|' || user_id || '|' || event_type || '|p1') AS revision FROM events",
    "r5_custom_template": f"SELECT doc_id, md5(regexp_replace(text, '{MAIL}', '<MAIL:\\0>', 'g')) AS text_md5 FROM documents",
    "r10_fingerprint": "WITH e AS (SELECT event_type, count(*) AS n FROM events GROUP BY 1) SELECT event_type, n, list_reduce(list_prepend(CAST(2166136261 AS BIGINT), list_transform(string_split(event_type, ''), lambda c: CAST(ascii(c) AS BIGINT))), lambda h, c: (xor(h, c) * 16777619) & 4294967295) AS fingerprint FROM e",
    "r15_editor_lines": f"""WITH l AS (SELECT doc_id, string_split(regexp_replace(text, '{MAIL}', '[EMAIL]', 'g'), chr(10)) AS x FROM documents), p AS (SELECT doc_id, generate_subscripts(x, 1) - 1 AS line, unnest(x) AS s FROM l)
        SELECT doc_id, line, len(regexp_extract_all(s, '\\[EMAIL\\]')) AS tokens, length(replace(s, '[EMAIL]', '')) AS text_chars FROM p WHERE contains(s, '[EMAIL]')""",
}
