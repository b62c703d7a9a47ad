"""Normalised values, gates, listings and merges of counts, with SQL beside them."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.patterns import PATTERNS, TAXONOMY
from . import detection


def r6_phones(spark, d):
    """Phone numbers (made of customer keys, written in two ways) as a plus sign and digits, counted."""
    k = F.col("c_custkey")
    number = F.lpad((k % 500 * 7919 % 10000000).cast("string"), 7, "0")
    written = F.when(k % 2 == 0, F.concat(F.lit("+33 (0)"), number)).otherwise(F.concat(F.lit("+33-0."), F.left(number, F.lit(3)), F.lit(" "), F.right(number, F.lit(4))))
    p = spark.read.parquet(f"{d}/customer.parquet").select(F.regexp_replace(written, "[^+0-9]", "").alias("phone"))
    return p.groupBy("phone").agg(F.count("*").alias("n"))


def r9_mail_stats(spark, d):
    """The allow-list (addresses only) narrows the statistics; the text loses every kind."""
    t = F.col("text")
    for n in (0, 4, 8):
        t = F.regexp_replace(t, PATTERNS[n].regex, F.lit(PATTERNS[n].template))
    return detection.docs(spark, d).select("doc_id", F.regexp_count("text", F.lit(PATTERNS[0].regex)).cast("long").alias("n_email"), F.md5(t).alias("redacted_md5"))


def t3_gate(spark, d):
    """Labels outside the taxonomy are refused; events stand in for labelled spans."""
    known = F.array(*[F.lit(x) for x in TAXONOMY])
    label = F.coalesce(F.get(known, (F.col("event_id") % (len(TAXONOMY) + 2)).cast("int")), F.lit("unknown"))
    e = spark.read.parquet(f"{d}/events.parquet").select(label.alias("label"))
    return e.groupBy("label", F.array_contains(known, F.col("label")).alias("accepted")).agg(F.count("*").alias("n"))


def k23_update(spark, d):
    """New vectors replace old ones by id; the others stay."""
    old = spark.read.parquet(f"{d}/embeddings.parquet")
    new = old.where("vec_id % 3 = 0").select("vec_id", F.reverse("embedding").alias("new"))
    both = old.join(new, "vec_id", "left").select("vec_id", F.coalesce("new", "embedding").alias("v"), F.col("new").isNotNull().alias("revised"))
    return both.select("vec_id", F.get("v", F.lit(0)).cast("double").alias("first_component"), "revised")


def k28_scoped(spark, d):
    """Collection names by tenant: the default tenant's (users here) bare, a colon is refused (null)."""
    name = F.concat(F.lit("c"), F.col("conv_id").cast("string"), F.when(F.col("turn") % 5 == 4, ":x").otherwise(""))
    c = spark.read.parquet(f"{d}/conversations.parquet").select("conv_id", "turn", "role", name.alias("name"))
    return c.select("conv_id", "turn", F.when(F.contains("name", F.lit(":")), None).when(F.col("role") == "user", F.col("name")).otherwise(F.concat_ws(":", "role", "name")).alias("collection"))


def k36_tokens(spark, d):
    """Redaction tokens of masked bodies and of metadata (conversation turns), summed per token."""
    text = F.regexp_replace("text", PATTERNS[0].regex, "[EMAIL]")
    meta = spark.read.parquet(f"{d}/conversations.parquet").select(F.explode(F.regexp_extract_all(text, F.lit(r"(\[EMAIL\])"), F.lit(1))).alias("token"))
    both = detection.token_projection(spark, d).select("token", "n").unionByName(meta.groupBy("token").agg(F.count("*").alias("n")))
    return both.groupBy("token").agg(F.sum("n").alias("n"))


def q6_listing(spark, d):
    """The items of one tenant (a user) with one status (a kind of event)."""
    e = spark.read.parquet(f"{d}/events.parquet")
    return e.where("user_id = 3 and event_type = 'click'").select("event_id", "user_id", "event_type")


def a10_egress(spark, d):
    """One summary entry per conversation sent out, and one entry per part."""
    c = spark.read.parquet(f"{d}/conversations.parquet").select("conv_id", "role", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("bytes"))
    whole = c.groupBy("conv_id").agg(F.lit("llm_egress").alias("category"), F.count("*").alias("parts"), F.sum("bytes").alias("bytes"))
    return whole.unionByName(c.select("conv_id", F.concat(F.lit("llm_egress."), "role").alias("category"), F.lit(1).cast("long").alias("parts"), "bytes"))


QUERIES = {
    "r6_phone_normalise": r6_phones, "r9_mail_stats": r9_mail_stats, "t3_taxonomy_gate": t3_gate, "k23_update_vectors": k23_update,
    "k28_scoped_names": k28_scoped, "k36_token_merge": k36_tokens, "q6_review_listing": q6_listing, "a10_egress_entries": a10_egress,
}

MASKED = "text"
for _n in (0, 4, 8):
    MASKED = f"regexp_replace({MASKED}, '{detection.sql_regex(_n)}', '{PATTERNS[_n].template}', 'g')"
LABELS = "[" + ", ".join(f"'{x}'" for x in TAXONOMY) + "]"

SQL = {
    "r6_phone_normalise": """WITH k AS (SELECT c_custkey AS k, lpad(CAST(c_custkey % 500 * 7919 % 10000000 AS VARCHAR), 7, '0') AS n FROM customer)
        SELECT regexp_replace(CASE WHEN k % 2 = 0 THEN '+33 (0)' || n ELSE '+33-0.' || left(n, 3) || ' ' || right(n, 4) END, '[^+0-9]', '', 'g') AS phone, count(*) AS n FROM k GROUP BY 1""",
    "r9_mail_stats": f"SELECT doc_id, CAST(len(regexp_extract_all(text, '{detection.sql_regex(0)}')) AS BIGINT) AS n_email, md5({MASKED}) AS redacted_md5 FROM documents",
    "t3_taxonomy_gate": f"WITH e AS (SELECT coalesce({LABELS}[event_id % {len(TAXONOMY) + 2} + 1], 'unknown') AS label FROM events) SELECT label, list_contains({LABELS}, label) AS accepted, count(*) AS n FROM e GROUP BY 1, 2",
    "k23_update_vectors": "SELECT vec_id, CAST(CASE WHEN vec_id % 3 = 0 THEN embedding[len(embedding)] ELSE embedding[1] END AS DOUBLE) AS first_component, vec_id % 3 = 0 AS revised FROM embeddings",
    "k28_scoped_names": "SELECT conv_id, turn, CASE WHEN turn % 5 = 4 THEN NULL WHEN role = 'user' THEN 'c' || conv_id ELSE role || ':c' || conv_id END AS collection FROM conversations",
    "k36_token_merge": f"""WITH b AS ({detection.SQL['r13_token_projection']}), m AS (SELECT unnest(regexp_extract_all(regexp_replace(text, '{detection.sql_regex(0)}', '[EMAIL]', 'g'), '\\[EMAIL\\]')) AS token FROM conversations)
        SELECT token, CAST(sum(n) AS BIGINT) AS n FROM (SELECT token, n FROM b UNION ALL SELECT token, 1 FROM m) GROUP BY token""",
    "q6_review_listing": "SELECT event_id, user_id, event_type FROM events WHERE user_id = 3 AND event_type = 'click'",
    "a10_egress_entries": """SELECT conv_id, 'llm_egress' AS category, count(*) AS parts, CAST(sum(coalesce(strlen(text), 0)) AS BIGINT) AS bytes FROM conversations GROUP BY conv_id
        UNION ALL SELECT conv_id, 'llm_egress.' || role, 1, CAST(coalesce(strlen(text), 0) AS BIGINT) FROM conversations""",
}
