"""Audit, review, job, version, usage and quota queries; events stand in for the stores' rows."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators import quota


def events(spark, d):
    return spark.read.parquet(f"{d}/events.parquet")


def a14_egress(spark, d):
    c = spark.read.parquet(f"{d}/conversations.parquet")
    return c.select("conv_id", "turn", F.concat(F.lit("llm_egress."), F.col("role")).alias("category"), F.sha2("text", 256).alias("span_hash"), F.octet_length("text").cast("long").alias("bytes"))


def snk3_jsonl(spark, d):
    return events(spark, d).select("event_id", F.to_json(F.struct("event_id", "event_type", "user_id")).alias("line"))


def q5_first_decision(spark, d):
    e = events(spark, d)
    w = Window.partitionBy("user_id").orderBy("event_id")
    return e.withColumn("rn", F.row_number().over(w)).where("rn = 1").select("user_id", "event_id", "event_type")


def q7_stats(spark, d):
    e = events(spark, d)
    kinds = ["click", "view", "purchase", "login", "logout", "search"]
    return e.agg(F.count("*").alias("total"), *[F.count_if(F.col("event_type") == k).alias(k) for k in kinds])


def q3_deadlines(spark, d):
    e = events(spark, d)
    return e.select("event_id", (F.col("ts") + F.expr("INTERVAL 24 HOURS")).alias("deadline"), F.when(F.col("value") < 0.3, "critical").when(F.col("value") < 0.5, "high").when(F.col("value") < 0.7, "normal").otherwise("low").alias("priority"))


def j1_job_state(spark, d):
    return events(spark, d).groupBy("user_id").agg(F.max_by("event_type", F.struct("ts", "event_id")).alias("status"), F.count("*").alias("transitions"))


def j2_job_page(spark, d):
    return events(spark, d).orderBy("ts", "event_id").offset(100).limit(50).select("event_id", "user_id")


def n1_versions(spark, d):
    """Sequence numbers of distinct consecutive contents per document."""
    w = Window.partitionBy("user_id").orderBy("event_id")
    e = events(spark, d).select("user_id", "event_id", F.md5("event_type").alias("hash"))
    changed = e.withColumn("new", (~F.col("hash").eqNullSafe(F.lag("hash").over(w))).cast("long"))
    return changed.select("user_id", "event_id", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("sequence"))


def n2_latest(spark, d):
    return n1_versions(spark, d).groupBy("user_id").agg(F.max("sequence").alias("versions"), F.max_by("event_id", "event_id").alias("latest"))


def l1_rate_limit(spark, d):
    e = events(spark, d).select(F.col("user_id").alias("key"), "event_id", "ts")
    return quota.rate_limit(e, 1, 86_400.0).select("key", "event_id", "admitted", "retry_after")


def m1_incremental(spark, d):
    """Rows past the watermark, each id once, with the next watermark beside them."""
    e = events(spark, d).where("event_id > 500").dropDuplicates(["event_id"])
    return e.groupBy("event_type").agg(F.count("*").alias("n"), F.max("event_id").alias("watermark"))


def c2_incident(spark, d):
    ref = F.concat(F.lit("PII-INC-"), F.left(F.translate(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), "-:T", ""), F.lit(13)))
    return events(spark, d).select("event_id", ref.alias("reference"))


def c6_windows(spark, d):
    w = F.window("ts", "5 minutes")
    return events(spark, d).groupBy(w.alias("w"), "event_type").agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "event_type", "n", F.round(F.col("n") / 300, 9).alias("rate"))


def t1_vote(spark, d):
    """Spans (event types) that at least two of a user's samples hold are accepted."""
    e = events(spark, d).select("user_id", (F.col("event_id") % 3).alias("sample"), "event_type").distinct()
    return e.groupBy("user_id", "event_type").agg(F.count("*").alias("votes")).withColumn("verdict", F.when(F.col("votes") >= 2, "accept").otherwise("review"))


def t6_split(spark, d):
    """Documents with labels on both heads go to test, the rest 80/10 by a stable hash."""
    docs = spark.read.parquet(f"{d}/documents.parquet").select("doc_id")
    lab = spark.read.parquet(f"{d}/labels.parquet").where("quality = 1 and toxic = 1").select("doc_id").distinct()
    u = F.conv(F.substring(F.md5(F.col("doc_id").cast("string")), 1, 8), 16, 10).cast("long") % 10
    split = F.when(F.col("held"), "test").when(u < 8, "train").when(u < 9, "validation").otherwise("train")
    return docs.join(lab.withColumn("held", F.lit(True)), "doc_id", "left").withColumn("held", F.coalesce("held", F.lit(False))).select("doc_id", split.alias("split"))


QUERIES = {
    
    "a14_egress_parts": a14_egress, "snk3_json_lines": snk3_jsonl, "q3_deadlines": q3_deadlines,
    "q5_first_decision": q5_first_decision, "q7_review_stats": q7_stats, "j1_job_state": j1_job_state, "j2_job_page": j2_job_page, "n1_versions": n1_versions,
    "n2_latest_version": n2_latest, "l1_rate_limit": l1_rate_limit, "m1_incremental": m1_incremental, "c2_incident_reference": c2_incident,
    "c6_windowed_rates": c6_windows, "t1_vote": t1_vote, "t6_split": t6_split,
}

SPLIT = """SELECT d.doc_id, CASE WHEN l.doc_id IS NOT NULL THEN 'test' ELSE CASE WHEN CAST('0x' || substr(md5(CAST(d.doc_id AS VARCHAR)), 1, 8) AS BIGINT) % 10 = 8 THEN 'validation' ELSE 'train' END END AS split
  FROM documents d LEFT JOIN (SELECT DISTINCT doc_id FROM labels WHERE quality = 1 AND toxic = 1) l ON d.doc_id = l.doc_id"""

SQL = {
    "l1_rate_limit": """WITH RECURSIVE e AS (SELECT user_id AS key, event_id, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
        a AS (SELECT key, n, ts FROM e WHERE n = 1 UNION ALL SELECT * FROM (SELECT e.key, min(e.n) AS n, arg_min(e.ts, e.n) AS ts FROM a JOIN e ON e.key = a.key AND e.n > a.n AND e.ts >= a.ts + INTERVAL 1 DAY GROUP BY e.key, a.n)),
        h AS (SELECT e.*, a.n IS NOT NULL AS admitted, max(a.ts) OVER (PARTITION BY e.key ORDER BY e.n) AS held FROM e LEFT JOIN a ON a.key = e.key AND a.n = e.n)
        SELECT key, event_id, admitted, CASE WHEN admitted THEN 0 ELSE greatest(1, (epoch_us(held) + 86400000000 - epoch_us(ts)) // 1000000) END AS retry_after FROM h""",
    "a14_egress_parts": "SELECT conv_id, turn, 'llm_egress.' || role AS category, sha256(text) AS span_hash, CAST(strlen(text) AS BIGINT) AS bytes FROM conversations",
    "snk3_json_lines": """SELECT event_id, '{"event_id":' || event_id || ',"event_type":"' || event_type || '","user_id":' || user_id || '}' AS line FROM events""",
    "q3_deadlines": "SELECT event_id, ts + INTERVAL 24 HOUR AS deadline, CASE WHEN value < 0.3 THEN 'critical' WHEN value < 0.5 THEN 'high' WHEN value < 0.7 THEN 'normal' ELSE 'low' END AS priority FROM events",
    "q5_first_decision": "SELECT user_id, event_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id) = 1",
    "q7_review_stats": "SELECT count(*) AS total, " + ", ".join(f"count(*) FILTER (event_type = '{k}') AS {k}" for k in ["click", "view", "purchase", "login", "logout", "search"]) + " FROM events",
    "j1_job_state": "SELECT user_id, arg_max(event_type, (ts, event_id)) AS status, count(*) AS transitions FROM events GROUP BY user_id",
    "j2_job_page": "SELECT event_id, user_id FROM events ORDER BY ts, event_id LIMIT 50 OFFSET 100",
    "n1_versions": "WITH e AS (SELECT user_id, event_id, CAST(event_type IS DISTINCT FROM lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) AS BIGINT) AS new FROM events) SELECT user_id, event_id, CAST(sum(new) OVER (PARTITION BY user_id ORDER BY event_id) AS BIGINT) AS sequence FROM e",
    "n2_latest_version": "WITH e AS (SELECT user_id, event_id, CAST(event_type IS DISTINCT FROM lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) AS BIGINT) AS new FROM events) SELECT user_id, CAST(sum(new) AS BIGINT) AS versions, max(event_id) AS latest FROM e GROUP BY user_id",
    "m1_incremental": "SELECT event_type, count(DISTINCT event_id) AS n, max(event_id) AS watermark FROM events WHERE event_id > 500 GROUP BY event_type",
    "c2_incident_reference": "SELECT event_id, 'PII-INC-' || left(strftime(ts, '%Y%m%d%H%M%S'), 13) AS reference FROM events",
    "c6_windowed_rates": "SELECT time_bucket(INTERVAL 5 MINUTE, ts) AS start, event_type, count(*) AS n, round(count(*) / 300, 9) AS rate FROM events GROUP BY 1, 2",
    "t1_vote": "WITH e AS (SELECT DISTINCT user_id, event_id % 3 AS sample, event_type FROM events) SELECT user_id, event_type, count(*) AS votes, CASE WHEN count(*) >= 2 THEN 'accept' ELSE 'review' END AS verdict FROM e GROUP BY 1, 2",
    "t6_split": SPLIT,
}
