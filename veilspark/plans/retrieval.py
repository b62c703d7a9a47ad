"""Retrieval, glossary and graph queries over embeddings, documents and conversations."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators.filters import compile_filter, validate


def vectors(spark, d):
    return spark.read.parquet(f"{d}/embeddings.parquet").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("v"))


def dot(a, b):
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def cosine(a, b):
    """Cosine, 0 where a norm is 0."""
    n = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(n == 0, 0.0).otherwise(dot(a, b) / n)


def asked(spark, d, n=0):
    """All vectors beside one query vector ``q``."""
    q = vectors(spark, d).where(F.col("vec_id") == n).select(F.col("v").alias("q"))
    return vectors(spark, d).crossJoin(F.broadcast(q))  # one row


def scored(spark, d):
    return asked(spark, d).select("vec_id", "label", cosine(F.col("v"), F.col("q")).alias("score"))


def top(df, k, *order):
    return df.orderBy(*order).limit(k)


def k3_top_k(spark, d):
    return top(scored(spark, d), 10, F.col("score").desc(), "vec_id").select("vec_id", F.round("score", 6).alias("score"))


def k1_metrics(spark, d):
    q, v = F.col("q"), F.col("v")
    l2 = 0.0 - F.sqrt(F.aggregate(F.zip_with(v, q, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x))
    return asked(spark, d).select("vec_id", F.round(cosine(v, q), 6).alias("cosine"), F.round(dot(v, q), 6).alias("ip"), F.round(l2, 6).alias("l2"))


def k15_grouped(spark, d):
    """The best chunk of each document (label), then the best five."""
    best = Window.partitionBy("label").orderBy(F.col("score").desc(), "vec_id")
    one = scored(spark, d).withColumn("rn", F.row_number().over(best)).where("rn = 1")
    return top(one, 5, F.col("score").desc(), "vec_id").select("label", "vec_id", F.round("score", 6).alias("score"))


def tokens(spark, d):
    t = spark.read.parquet(f"{d}/conversations.parquet").select(F.concat_ws("-", "conv_id", "turn").alias("chunk"), F.lower("text").alias("t"))
    return t.select("chunk", F.explode(F.regexp_extract_all("t", F.lit("([a-z]+)"), F.lit(1))).alias("term"))


TERMS = ["the", "and", "thanea"]


def k5_bm25(spark, d, k1=1.2, b=0.75):
    tf = tokens(spark, d).groupBy("chunk", "term").agg(F.count("*").alias("tf"))
    lengths = tokens(spark, d).groupBy("chunk").agg(F.count("*").alias("len"))
    stats = F.broadcast(lengths.agg(F.count("*").alias("n"), F.avg("len").alias("mean")))  # one row
    hits = tf.where(F.col("term").isin(*TERMS))
    df = hits.groupBy("term").agg(F.count("*").alias("df"))
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = idf * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("len") / F.col("mean")))
    s = hits.join(df, "term").join(lengths, "chunk").crossJoin(stats).groupBy("chunk").agg(F.sum(part).alias("score"))
    return s.select("chunk", F.round("score", 6).alias("score"))


def k8_sparse(spark, d):
    """Sparse dot product: positive components as (index, value) rows, joined on the index."""
    s = vectors(spark, d).select("vec_id", F.posexplode("v").alias("i", "x")).where("x > 0.1")
    q = s.where("vec_id = 0").select("i", F.col("x").alias("y"))
    return s.join(F.broadcast(q), "i").groupBy("vec_id").agg(F.round(F.sum(F.col("x") * F.col("y")), 6).alias("score")).where("score > 0")




FILTER = {"and": [{"range": {"field": "value", "gte": 10.0}}, {"or": [{"eq": {"field": "event_type", "value": "click"}}, {"in": {"field": "event_type", "values": ["view"]}}]}, {"not": {"eq": {"field": "metadata.k", "value": 69}}}]}


def k10_filter(spark, d):
    validate(FILTER, {"value", "event_type"})
    e = spark.read.parquet(f"{d}/events.parquet").withColumnRenamed("props", "metadata")
    return e.where(compile_filter(FILTER, e.schema)).select("event_id")


def k18_upsert(spark, d):
    """Bulk upsert: of rows with one external id (the user) the last wins."""
    w = Window.partitionBy("user_id").orderBy(F.col("event_id").desc())
    return spark.read.parquet(f"{d}/events.parquet").withColumn("rn", F.row_number().over(w)).where("rn = 1").select("user_id", "event_id")


def k19_delete(spark, d):
    """Documents (users) left after deleting those with any matching chunk (an early purchase)."""
    e = spark.read.parquet(f"{d}/events.parquet")
    gone = e.where("event_type = 'purchase' and event_id < 300").select("user_id").distinct()
    return e.join(gone, "user_id", "left_anti").select("user_id").distinct()


def k21_stats(spark, d):
    return spark.read.parquet(f"{d}/events.parquet").agg(F.countDistinct("user_id").alias("documents"), F.count("*").alias("chunks"), F.max("ts").alias("last_ingested"))


def k25_chunks(spark, d, size=512, overlap=50):
    """Windows of 512 characters that overlap by 50."""
    t = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text", F.char_length("text").alias("n"))
    starts = F.sequence(F.lit(0), F.greatest(F.col("n") - 1 - overlap, F.lit(0)), F.lit(size - overlap))
    c = t.select("doc_id", F.posexplode(F.transform(starts, lambda a: F.substring("text", a + 1, F.lit(size)))).alias("ordinal", "content"))
    return c.select("doc_id", F.col("ordinal").cast("long").alias("ordinal"), F.md5("content").alias("content_md5"))


def mentions(spark, d):
    """Capitalised words stand in for entities."""
    t = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text")
    return t.select("doc_id", F.explode(F.regexp_extract_all("text", F.lit("([A-Z][a-z]{5,})"), F.lit(1))).alias("term"))


def g2_glossary(spark, d):
    return mentions(spark, d).groupBy("term").agg(F.count("*").alias("n"), F.countDistinct("doc_id").alias("docs")).where("n >= 2")


def e1_entities(spark, d):
    key = F.lower(F.regexp_replace("term", "[.,;:]+$", ""))
    return mentions(spark, d).groupBy(key.alias("key")).agg(F.max_by("term", F.struct(F.length("term"), "term")).alias("canonical"), F.count("*").alias("mentions"), F.countDistinct("doc_id").alias("docs"), F.concat(F.lit("ent-"), F.left(F.first(F.sha2(key, 256)), F.lit(12))).alias("entity_id"))


def snk4_cypher(spark, d):
    return g2_glossary(spark, d).select("term", F.format_string("MERGE (:Entity {name: '%s', mentions: %d});", "term", "n").alias("cypher"))


def k32_batch_check(spark, d):
    return vectors(spark, d).agg(F.count("*").alias("n"), F.count_if(F.size("v") != 64).alias("wrong"))


def t9_exact_f1(spark, d):
    """Exact span scoring with labels as gold and a threshold on length as prediction."""
    j = spark.read.parquet(f"{d}/labels.parquet").join(spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "n_chars"), "doc_id").select((F.col("quality") == 1).alias("g"), (F.col("n_chars") > 500).alias("p"))
    c = j.agg(F.count_if(F.col("g") & F.col("p")).alias("tp"), F.count_if(~F.col("g") & F.col("p")).alias("fp"), F.count_if(F.col("g") & ~F.col("p")).alias("fn"))
    return c.withColumn("f1", F.round(2 * F.col("tp") / (2 * F.col("tp") + F.col("fp") + F.col("fn")), 9))


QUERIES = {
    "k1_metrics": k1_metrics, "k3_vector_top_k": k3_top_k, "k5_bm25": k5_bm25, "k8_sparse_dot": k8_sparse, 
    "k10_filter": k10_filter, "k15_group_by_document": k15_grouped, "k18_bulk_upsert": k18_upsert, "k19_delete_by_filter": k19_delete,
    "k21_stats": k21_stats, "k25_chunks": k25_chunks, "k32_batch_check": k32_batch_check, "g2_glossary": g2_glossary, "e1_e4_e5_entities": e1_entities,
    "snk4_cypher": snk4_cypher, "t9_exact_f1": t9_exact_f1,
}

V = "WITH q AS (SELECT CAST(embedding AS DOUBLE[]) AS q FROM embeddings WHERE vec_id = 0), v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings), s AS (SELECT vec_id, label, list_cosine_similarity(v, q) AS score, v, q FROM v, q) "
MENTIONS = "SELECT doc_id, unnest(regexp_extract_all(text, '[A-Z][a-z]{5,}')) AS term FROM documents"
SQL = {
    "k1_metrics": V + "SELECT vec_id, round(score, 6) AS cosine, round(list_inner_product(v, q), 6) AS ip, round(0 - list_distance(v, q), 6) AS l2 FROM s",
    "k3_vector_top_k": V + "SELECT vec_id, round(score, 6) AS score FROM s ORDER BY s.score DESC, vec_id LIMIT 10",
    "k15_group_by_document": V + ", b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY label ORDER BY score DESC, vec_id) = 1) SELECT label, vec_id, round(score, 6) AS score FROM b ORDER BY b.score DESC, vec_id LIMIT 5",
    "k5_bm25": """WITH t AS (SELECT conv_id || '-' || turn AS chunk, unnest(regexp_extract_all(lower(text), '[a-z]+')) AS term FROM conversations),
        l AS (SELECT chunk, count(*) AS len FROM t GROUP BY chunk), h AS (SELECT chunk, term, count(*) AS tf FROM t WHERE term IN ('the', 'and', 'thanea') GROUP BY 1, 2),
        f AS (SELECT term, count(*) AS df FROM h GROUP BY term), s AS (SELECT count(*) AS n, avg(len) AS mean FROM l)
        SELECT chunk, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / mean))), 6) AS score FROM h JOIN f USING (term) JOIN l USING (chunk), s GROUP BY chunk""",
    "k8_sparse_dot": "WITH s AS (SELECT vec_id, generate_subscripts(embedding, 1) AS i, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings) SELECT a.vec_id, round(sum(a.x * b.x), 6) AS score FROM s a JOIN s b ON a.i = b.i AND b.vec_id = 0 AND a.x > 0.1 AND b.x > 0.1 GROUP BY 1",
    "k10_filter": "SELECT event_id FROM events WHERE value >= 10 AND event_type IN ('click', 'view') AND coalesce(json_extract_string(props, '$.k') <> '69', true)",
    "k18_bulk_upsert": "SELECT user_id, max(event_id) AS event_id FROM events GROUP BY user_id",
    "k19_delete_by_filter": "SELECT DISTINCT user_id FROM events WHERE user_id NOT IN (SELECT user_id FROM events WHERE event_type = 'purchase' AND event_id < 300)",
    "k21_stats": "SELECT count(DISTINCT user_id) AS documents, count(*) AS chunks, max(ts) AS last_ingested FROM events",
    "k25_chunks": "WITH c AS (SELECT doc_id, text, unnest(range(0, greatest(length(text) - 1 - 50, 0) + 1, 462)) AS a FROM documents) SELECT doc_id, a // 462 AS ordinal, md5(substr(text, a + 1, 512)) AS content_md5 FROM c",
    "k32_batch_check": "SELECT count(*) AS n, count(*) FILTER (len(embedding) <> 64) AS wrong FROM embeddings",
    "g2_glossary": f"SELECT term, count(*) AS n, count(DISTINCT doc_id) AS docs FROM ({MENTIONS}) GROUP BY term HAVING count(*) >= 2",
    "e1_e4_e5_entities": f"SELECT lower(term) AS key, arg_max(term, (length(term), term)) AS canonical, count(*) AS mentions, count(DISTINCT doc_id) AS docs, 'ent-' || left(sha256(lower(term)), 12) AS entity_id FROM ({MENTIONS}) GROUP BY lower(term)",
    "snk4_cypher": f"SELECT term, 'MERGE (:Entity {{name: ''' || term || ''', mentions: ' || count(*) || '}});' AS cypher FROM ({MENTIONS}) GROUP BY term HAVING count(*) >= 2",
    "t9_exact_f1": "WITH c AS (SELECT count(*) FILTER (quality = 1 AND n_chars > 500) AS tp, count(*) FILTER (quality <> 1 AND n_chars > 500) AS fp, count(*) FILTER (quality = 1 AND NOT n_chars > 500) AS fn FROM labels JOIN documents USING (doc_id)) SELECT *, round(2 * tp / (2 * tp + fp + fn), 9) AS f1 FROM c",
}
