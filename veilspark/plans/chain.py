"""Audit, review and job queries over span facts and events, with SQL that recomputes the hashes."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators import audit
from ..operators.shared import stored
from .facts import FACTS, facts

CONFIG, NODE = "c0ffee", "node-1"
FIELDS = ["id", "category", "action", "span_hash", "config_hash", "principal"]


def entries(spark, d):
    """Audit entries of the spans that are redacted; a segment holds 256 documents of a tenant."""
    f = facts(spark, d).where("category <> 'person' or confidence >= 0.9")
    f = f.withColumn("segment", F.concat("tenant", F.lit("-"), F.lpad(F.floor(F.col("doc_id") / 256).cast("string"), 6, "0")))
    order = Window.partitionBy("segment").orderBy("doc_id", "category", "start")
    model = F.col("category") == "person"
    return f.select(
        "segment", "tenant", "doc_id", (F.row_number().over(order) - 1).cast("long").alias("seq"),
        F.left(F.sha2(F.concat_ws(":", F.col("doc_id").cast("string"), "category", F.col("start").cast("string")), 256), F.lit(16)).alias("id"),
        F.concat(F.lit("2024-01-01T00:"), F.lpad((F.col("doc_id") % 60).cast("string"), 2, "0"), F.lit(":00Z")).alias("timestamp"),
        "category", F.lit('"mask"').alias("action"), F.sha2("surface", 256).alias("span_hash"), F.octet_length("surface").cast("long").alias("span_length"),
        "confidence", F.when(model, "model").otherwise("regex").alias("source"), F.lit(CONFIG).alias("config_hash"),
        F.when(F.col("tenant") != "src3", F.col("tenant")).alias("principal"),
        F.when(F.col("doc_id") % 3 == 0, "m&a@1a2b3c4d").alias("vertical"), F.when(model, "names@00000001").alias("model"),
    )


BODY = lambda: audit.entry_body("seq", FIELDS, "vertical", "model")


def chained(spark, d):
    return audit.mint(entries(spark, d), "segment", "seq", BODY())


def a2_mint(spark, d):
    return chained(spark, d).groupBy("segment").agg(F.count("*").alias("entries"), F.max_by("chain_hash", "seq").alias("tip"))


def a3_verify(spark, d):
    return audit.verify(chained(spark, d), "segment", "seq", BODY())


def a3_tampered(spark, d):
    """Verification after the entries of every 97th document were altered: the first bad entry per segment."""
    c = chained(spark, d).withColumn("category", F.when(F.col("doc_id") % 97 == 0, "none").otherwise(F.col("category")))
    return audit.verify(c, "segment", "seq", BODY()).select("segment", "first_bad")


def a4_config(spark, d):
    """Entries per segment that were not made under the configuration at hand."""
    e = entries(spark, d).withColumn("config_hash", F.when(F.col("doc_id") % 50 == 0, "0ld").otherwise(F.col("config_hash")))
    return e.where(F.col("config_hash") != CONFIG).groupBy("segment").agg(F.count("*").alias("mismatches"))


def sealed(spark, d):
    """Seals of all segments, one chain per tenant."""
    s = chained(spark, d).groupBy("tenant", "segment").agg(F.count("*").alias("entries"), F.max_by("chain_hash", "seq").alias("tip"), F.min("timestamp").alias("opened_at"), F.max("timestamp").alias("sealed_at"))
    return audit.mint_seals(s, "tenant", "segment", REST())


REST = lambda legacy=False: audit.seal_rest(CONFIG, NODE, "segment", "tenant", legacy)


def a5_seals(spark, d):
    return sealed(spark, d).select("segment", "prev_seal_hash", "seal_hash")


def a6_seal_chain(spark, d):
    """Seals with two kinds of damage: a changed count, and a seal that was deleted."""
    s = sealed(spark, d)
    left = s.where("segment not like '%-000001'").withColumn("entries", F.when(F.col("entries") % 5 == 0, F.col("entries") + 1).otherwise(F.col("entries")))
    return audit.verify_seal_chain(left, "tenant", "segment", REST(), REST(True)).select("segment", "intact", "linked")


def a7_seals(spark, d):
    """Counts, chains and tips of segments against their seals, of which some say one entry too many."""
    v = audit.verify(chained(spark, d), "segment", "seq", BODY())
    seals = v.select("segment", (F.col("entries") + (F.col("entries") % 10 == 0).cast("long")).alias("entry_count"), "tip")
    return audit.verify_seals(v, seals)


def a9_history(spark, d):
    """A page of 50 entries after the cursor ``src1-000000:2``."""
    e = entries(spark, d).select("segment", "seq", "id")
    return audit.history(e, e.groupBy("segment").agg(F.count("*").alias("entries")), "src1-000000:2", 50)


def a11_usage(spark, d):
    """Entries and bytes per principal of the segments opened in a half-open time range; no principal first."""
    e = stored(entries(spark, d).select("segment", "timestamp", "principal", "span_length"))
    segments = e.groupBy("segment").agg(F.min("timestamp").alias("opened_at")).where((F.col("opened_at") >= "2024-01-01T00:00:00Z") & (F.col("opened_at") < "2024-01-01T00:08:00Z"))
    used = e.join(segments.select("segment"), "segment", "left_semi").groupBy("principal").agg(F.count("*").alias("n"), F.coalesce(F.sum("span_length"), F.lit(0)).alias("span_bytes"))
    return used.orderBy(F.col("principal").asc_nulls_first())


COLUMNS = ["id", "timestamp", "category", "action", "span_hash", "span_length", "confidence", "source", "pipeline_version", "config_hash", "chain_hash", "vertical"]


def exported(spark, d):
    """The chain of every segment in order: each is verified on its own, as each starts from the genesis hash."""
    return chained(spark, d).withColumn("pipeline_version", F.lit("1.0")).withColumn("confidence", F.format_number("confidence", 2))


def a12_export(spark, d):
    e = exported(spark, d)
    return e.select("segment", "seq", F.to_json(F.struct(*COLUMNS)).alias("json")).select("segment", "seq", F.md5("json").alias("json_md5"))


def snk1_csv(spark, d):
    line = F.concat_ws(",", *[audit.csv_field(F.col(c)) for c in COLUMNS])
    return exported(spark, d).select("segment", "seq", line.alias("line"))


def q1_review(spark, d):
    """Spans below the review threshold with their priority."""
    f = facts(spark, d).where("confidence < 0.5")
    return f.groupBy(priority(F.col("confidence")).alias("priority"), "category").agg(F.count("*").alias("n"))


def priority(confidence):
    return F.when(confidence < 0.3, "critical").when(confidence < 0.5, "high").when(confidence < 0.7, "normal").otherwise("low")


def q8_submissions(spark, d):
    """Review items of a batch: one per span below the threshold, due a day later; pattern spans have no snippet."""
    f = facts(spark, d).where("confidence < 0.5")
    due = F.date_format(F.expr("TIMESTAMP '2024-01-01 00:00:00' + make_interval(0, 0, 0, 1)"), "yyyy-MM-dd HH:mm:ss")
    snippet = F.when(F.col("category") == "person", F.col("surface")).otherwise(F.lit(""))
    return f.select("doc_id", F.col("start").cast("long").alias("start"), "category", snippet.alias("snippet"), priority(F.col("confidence")).alias("priority"), due.alias("deadline"), F.lit("pending").alias("status"))


def log(spark, d):
    """Review events: an item is a user, views assign, clicks approve, purchases reject, the rest modifies nothing."""
    kind = F.when(F.col("event_type") == "view", "assign").when(F.col("event_type") == "click", "approve").when(F.col("event_type") == "purchase", "reject").otherwise("submit")
    return spark.read.parquet(f"{d}/events.parquet").where("event_id % 5 <> 0 or user_id % 3 = 0").select(F.col("user_id").alias("item"), "event_id", kind.alias("kind"))


def review_states(spark, d):
    """The state of each item from its log: the first decision stands, the first assignment before it counts."""
    first = log(spark, d).groupBy("item").agg(
        F.min(F.when(F.col("kind").isin("approve", "reject"), F.struct("event_id", "kind"))).alias("decision"),
        F.min(F.when(F.col("kind") == "assign", F.col("event_id"))).alias("assigned"),
        F.count_if(F.col("kind") == "assign").alias("assigns"), F.count_if(F.col("kind").isin("approve", "reject")).alias("decisions"),
    )
    took = F.col("assigned").isNotNull() & (F.col("decision").isNull() | (F.col("assigned") < F.col("decision.event_id")))
    status = F.when(F.col("decision").isNotNull(), F.when(F.col("decision.kind") == "approve", "approved").otherwise("rejected")).when(took, "in_review").otherwise("pending")
    refused = F.col("assigns") - took.cast("long") + F.greatest(F.col("decisions") - 1, F.lit(0))
    return first.select("item", status.alias("status"), F.when(took, F.col("assigned")).alias("assigned_at"), F.col("decision.event_id").alias("decided_at"), refused.cast("long").alias("refused"))


def q7_counts(spark, d):
    """The six counts of the review queue."""
    s = review_states(spark, d)
    kinds = ["pending", "in_review", "approved", "rejected", "modified"]
    return s.agg(F.count("*").alias("total"), *[F.count_if(F.col("status") == k).alias(k) for k in kinds])


def snk6_replay(spark, d):
    """The last event of each item of the log."""
    newest = Window.partitionBy("item").orderBy(F.col("event_id").desc())
    return log(spark, d).withColumn("n", F.row_number().over(newest)).where("n = 1").select("item", "event_id", "kind")


def j1_states(spark, d):
    """Jobs (users) by compare-and-set: a view starts a queued job, then the first click finishes or purchase fails it; all else is refused."""
    e = spark.read.parquet(f"{d}/events.parquet").select(F.col("user_id").alias("job"), "event_id", "event_type")
    began = e.where("event_type = 'view'").groupBy("job").agg(F.min("event_id").alias("started"))
    after = e.where("event_type in ('click', 'purchase')").join(began, "job").where("event_id > started").groupBy("job").agg(F.min(F.struct("event_id", "event_type")).alias("over"))
    both = e.groupBy("job").agg(F.count_if(F.col("event_type").isin("view", "click", "purchase")).alias("asked")).join(began, "job", "left").join(after, "job", "left")
    status = F.when(F.col("started").isNull(), "queued").when(F.col("over").isNull(), "running").when(F.col("over.event_type") == "click", "succeeded").otherwise("failed")
    took = F.col("started").isNotNull().cast("long") + F.col("over").isNotNull().cast("long")
    return both.select("job", status.alias("status"), "started", F.col("over.event_id").alias("finished"), (F.col("asked") - took).alias("refused"))


QUERIES = {
    "a2_mint_chain": a2_mint, "a3_verify_chain": a3_verify, "a3_verify_tampered": a3_tampered, "a4_config_mismatch": a4_config, "a5_seals": a5_seals,
    "a6_seal_chain": a6_seal_chain, "a7_verify_seals": a7_seals, "a9_history_page": a9_history, "a11_usage": a11_usage, "a12_export_json": a12_export,
    "snk1_csv_lines": snk1_csv, "snk6_review_replay": snk6_replay, "q1_q2_needs_review": q1_review, "q8_submissions": q8_submissions,
    "q4_q5_review_states": review_states, "q7_review_counts": q7_counts, "j1_job_states": j1_states,
}

LE = "array_to_string(list_reverse(regexp_extract_all(printf('%016x', CAST({} AS BIGINT)), '..')), '')"
le = LE.format
framed = lambda x: f"{le(f'strlen({x})')} || hex({x})"
ENTRIES = f"""{FACTS},
  n0 AS (SELECT *, tenant || '-' || lpad(CAST(doc_id // 256 AS VARCHAR), 6, '0') AS segment FROM facts WHERE category <> 'person' OR confidence >= 0.9),
  n1 AS (SELECT *, row_number() OVER (PARTITION BY segment ORDER BY doc_id, category, s) - 1 AS seq, left(sha256(doc_id || ':' || category || ':' || s), 16) AS id,
         '2024-01-01T00:' || lpad(CAST(doc_id % 60 AS VARCHAR), 2, '0') || ':00Z' AS ts, sha256(surface) AS span_hash, CAST(strlen(surface) AS BIGINT) AS span_length,
         CASE WHEN tenant <> 'src3' THEN tenant END AS principal, CASE WHEN doc_id % 3 = 0 THEN 'm&a@1a2b3c4d' END AS vertical, CASE WHEN category = 'person' THEN 'names@00000001' END AS model FROM n0),
  n2 AS (SELECT *, {le('seq')} || hex(id) || hex(category) || hex('"mask"') || hex(span_hash) || hex('{CONFIG}') || hex(coalesce(principal, ''))
         || CASE WHEN vertical IS NULL THEN '' ELSE 'FF' || {framed('vertical')} END || CASE WHEN model IS NULL THEN '' ELSE 'FE' || {framed('model')} END AS body FROM n1),
  t AS (SELECT tenant, segment, count(*) AS entries, min(ts) AS opened_at, max(ts) AS sealed_at,
        list_reduce(list_prepend('{audit.GENESIS}', list(body ORDER BY seq)), lambda p, b: sha256(unhex(hex(p) || b))) AS tip FROM n2 GROUP BY 1, 2)"""
SEALS = f"""{ENTRIES}, r AS (SELECT *, {framed('segment')} || {framed('tenant')} || {framed(f"'{NODE}'")} || {framed(f"'{CONFIG}'")} || {framed('tip')} || {le('entries')} || {framed('opened_at')} || {framed('sealed_at')} AS rest,
         row_number() OVER (PARTITION BY tenant ORDER BY segment) AS n FROM t),
  z AS (SELECT tenant, segment, n, CAST(NULL AS VARCHAR) AS prev_seal_hash, sha256(unhex('00' || rest)) AS seal_hash FROM r WHERE n = 1
        UNION ALL SELECT r.tenant, r.segment, r.n, z.seal_hash, sha256(unhex('01' || {le('64')} || hex(z.seal_hash) || r.rest)) FROM z JOIN r ON r.tenant = z.tenant AND r.n = z.n + 1)"""
CHAIN = f"""{ENTRIES}, c AS (SELECT segment, seq, sha256(unhex(hex('{audit.GENESIS}') || body)) AS chain_hash FROM n2 WHERE seq = 0
        UNION ALL SELECT n2.segment, n2.seq, sha256(unhex(hex(c.chain_hash) || n2.body)) FROM c JOIN n2 ON n2.segment = c.segment AND n2.seq = c.seq + 1),
  x AS (SELECT n2.*, chain_hash, printf('%.2f', confidence) AS conf, CASE WHEN category = 'person' THEN 'model' ELSE 'regex' END AS source FROM n2 JOIN c USING (segment, seq))"""
LOG = """log AS (SELECT user_id AS item, event_id, CASE event_type WHEN 'view' THEN 'assign' WHEN 'click' THEN 'approve' WHEN 'purchase' THEN 'reject' ELSE 'submit' END AS kind FROM events WHERE event_id % 5 <> 0 OR user_id % 3 = 0)"""
STATES = f"""{LOG}, g AS (SELECT item, min(event_id) FILTER (kind IN ('approve', 'reject')) AS decided, min(event_id) FILTER (kind = 'assign') AS assigned, count(*) FILTER (kind = 'assign') AS assigns, count(*) FILTER (kind IN ('approve', 'reject')) AS decisions FROM log GROUP BY item),
  h AS (SELECT g.*, log.kind, assigned IS NOT NULL AND (decided IS NULL OR assigned < decided) AS took FROM g LEFT JOIN log ON g.item = log.item AND decided = log.event_id),
  states AS (SELECT item, CASE WHEN kind = 'approve' THEN 'approved' WHEN kind = 'reject' THEN 'rejected' WHEN took THEN 'in_review' ELSE 'pending' END AS status,
             CASE WHEN took THEN assigned END AS assigned_at, decided AS decided_at, assigns - CAST(took AS BIGINT) + greatest(decisions - 1, 0) AS refused FROM h)"""
PRIORITY = "CASE WHEN confidence < 0.3 THEN 'critical' WHEN confidence < 0.5 THEN 'high' WHEN confidence < 0.7 THEN 'normal' ELSE 'low' END"

SQL = {
    "a2_mint_chain": f"WITH {ENTRIES} SELECT segment, entries, tip FROM t",
    "a3_verify_chain": f"WITH {ENTRIES} SELECT segment, entries, CAST(NULL AS BIGINT) AS first_bad, tip FROM t",
    "a3_verify_tampered": f"WITH {ENTRIES} SELECT segment, min(seq) FILTER (doc_id % 97 = 0) AS first_bad FROM n1 GROUP BY segment",
    "a4_config_mismatch": f"WITH {ENTRIES} SELECT segment, count(*) AS mismatches FROM n1 WHERE doc_id % 50 = 0 GROUP BY segment",
    "a5_seals": f"WITH RECURSIVE {SEALS} SELECT segment, prev_seal_hash, seal_hash FROM z",
    "a6_seal_chain": f"""WITH {ENTRIES}, o AS (SELECT segment, entries, lag(segment) OVER (PARTITION BY tenant ORDER BY segment) AS before FROM t)
        SELECT segment, entries % 5 <> 0 AS intact, coalesce(before NOT LIKE '%-000001', true) AS linked FROM o WHERE segment NOT LIKE '%-000001'""",
    "a7_verify_seals": f"WITH {ENTRIES} SELECT segment, entries % 10 <> 0 AS sound FROM t",
    "a9_history_page": f"WITH {ENTRIES} SELECT segment, seq, id FROM n1 WHERE segment > 'src1-000000' OR (segment = 'src1-000000' AND seq > 2) ORDER BY segment, seq LIMIT 50",
    "a11_usage": f"WITH {ENTRIES} SELECT principal, count(*) AS n, CAST(sum(span_length) AS BIGINT) AS span_bytes FROM n1 JOIN t USING (segment) WHERE opened_at >= '2024-01-01T00:00:00Z' AND opened_at < '2024-01-01T00:08:00Z' GROUP BY principal",
    "a12_export_json": f"""WITH RECURSIVE {CHAIN} SELECT segment, seq, md5('{{"id":"' || id || '","timestamp":"' || ts || '","category":"' || category || '","action":"\\"mask\\"","span_hash":"' || span_hash || '","span_length":' || span_length || ',"confidence":"' || conf
        || '","source":"' || source || '","pipeline_version":"1.0","config_hash":"{CONFIG}","chain_hash":"' || chain_hash || '"' || CASE WHEN vertical IS NULL THEN '' ELSE ',"vertical":"' || vertical || '"' END || '}}') AS json_md5 FROM x""",
    "snk1_csv_lines": f"""WITH RECURSIVE {CHAIN} SELECT segment, seq, concat_ws(',', id, ts, category, '\"\"\"mask\"\"\"', span_hash, CAST(span_length AS VARCHAR), conf, source, '1.0', '{CONFIG}', chain_hash, coalesce(vertical, '')) AS line FROM x""",
    "snk6_review_replay": f"WITH {LOG} SELECT item, event_id, kind FROM log QUALIFY row_number() OVER (PARTITION BY item ORDER BY event_id DESC) = 1",
    "q1_q2_needs_review": f"WITH {FACTS} SELECT {PRIORITY} AS priority, category, count(*) AS n FROM facts WHERE confidence < 0.5 GROUP BY 1, 2",
    "q8_submissions": f"WITH {FACTS} SELECT doc_id, s AS start, category, CASE WHEN category = 'person' THEN surface ELSE '' END AS snippet, {PRIORITY} AS priority, '2024-01-02 00:00:00' AS deadline, 'pending' AS status FROM facts WHERE confidence < 0.5",
    "q4_q5_review_states": f"WITH {STATES} SELECT * FROM states",
    "q7_review_counts": f"WITH {STATES} SELECT count(*) AS total, " + ", ".join(f"count(*) FILTER (status = '{k}') AS {k}" for k in ("pending", "in_review", "approved", "rejected", "modified")) + " FROM states",
    "j1_job_states": """WITH b AS (SELECT user_id AS job, min(event_id) FILTER (event_type = 'view') AS started, count(*) FILTER (event_type IN ('view', 'click', 'purchase')) AS asked FROM events GROUP BY 1),
        o AS (SELECT job, min(event_id) AS finished, arg_min(event_type, event_id) AS kind FROM events JOIN b ON user_id = job WHERE event_type IN ('click', 'purchase') AND event_id > started GROUP BY job)
        SELECT job, CASE WHEN started IS NULL THEN 'queued' WHEN finished IS NULL THEN 'running' WHEN kind = 'click' THEN 'succeeded' ELSE 'failed' END AS status, started, finished,
               asked - CAST(started IS NOT NULL AS BIGINT) - CAST(finished IS NOT NULL AS BIGINT) AS refused FROM b LEFT JOIN o USING (job)""",
}
