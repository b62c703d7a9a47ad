"""Detection and redaction queries over ``documents``."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import spans as S
from ..functions import validators as V
from ..functions.patterns import ALIASES, PATTERNS
from ..operators.shared import spread


def docs(spark, d):
    return spread(spark.read.parquet(f"{d}/documents.parquet"))


def detected(spark, d):
    """Documents with their spans: one scan feeds redaction, review, audit and glossary."""
    return docs(spark, d).select("doc_id", "source", "text", S.detect(F.col("text")).alias("spans"))


def entities(spark, d):
    """One row per span with its text.

    The outer form keeps Spark from testing the spans before it unfolds them, which would detect them twice.
    """
    rows = detected(spark, d).select("doc_id", "source", "text", F.posexplode_outer("spans").alias("n", "s")).where("n is not null")
    return rows.select("doc_id", "source", "n", "s.*", F.substring("text", F.col("s.start") + 1, F.col("s.end") - F.col("s.start")).alias("surface"))


def redacted(spark, d):
    return detected(spark, d).select("doc_id", F.size("spans").cast("long").alias("n_spans"), S.redact(F.col("text"), F.col("spans")).alias("redacted"))


def pattern_counts(spark, d):
    """Matches of the patterns on which every regex dialect agrees."""
    t = docs(spark, d).select("text")
    return t.select(*[F.sum(F.regexp_count("text", F.lit(PATTERNS[n].regex))).cast("long").alias(a) for a, n in COUNTED.items()])


COUNTED = {"email": 0, "ssn": 4, "ipv4": 8, "ipv6": 9, "mac": 10, "dob": 13, "ein": 16, "jwt": 20}


def category_counts(spark, d):
    return entities(spark, d).groupBy("category").agg(F.count("*").alias("n"), F.round(F.avg("confidence"), 6).alias("mean_confidence"))


def mask_email(spark, d):
    return docs(spark, d).select("doc_id", F.md5(F.regexp_replace("text", PATTERNS[0].regex, "[EMAIL]")).alias("masked_md5"))


def remove_email(spark, d):
    return docs(spark, d).select("doc_id", F.char_length(F.regexp_replace("text", PATTERNS[0].regex, "")).cast("long").alias("left"))


def token_projection(spark, d):
    """How often each redaction token occurs in each masked document."""
    masked = docs(spark, d).select("doc_id", F.regexp_replace(F.regexp_replace("text", PATTERNS[0].regex, "[EMAIL]"), PATTERNS[8].regex, "[IP]").alias("t"))
    tokens = masked.select("doc_id", F.explode(F.regexp_extract_all("t", F.lit(r"(\[(EMAIL|IP)\])"), F.lit(1))).alias("token"))
    return tokens.groupBy("doc_id", "token").agg(F.count("*").alias("n"))


def luhn_orders(spark, d):
    """Luhn and card verdicts over numbers made of order keys."""
    o = spark.read.parquet(f"{d}/orders.parquet").select("o_orderkey", F.lpad((F.col("o_orderkey") * 7919 + 4111111111111).cast("string"), 16, "4").alias("num"))
    return o.select("o_orderkey", V.luhn(F.col("num")).alias("luhn"), V.card(F.col("num")).alias("card"))


def iban_orders(spark, d):
    o = spark.read.parquet(f"{d}/orders.parquet").select("o_orderkey", F.concat(F.lit("FR76"), F.lpad((F.col("o_orderkey") * 104729).cast("string"), 23, "3")).alias("num"))
    return o.select("o_orderkey", V.iban(F.col("num")).alias("valid"))


def ssn_orders(spark, d):
    o = spark.read.parquet(f"{d}/orders.parquet").select("o_orderkey", F.lpad((F.col("o_orderkey") * 104729 % 1000000000).cast("string"), 9, "0").alias("num"))
    return o.select("o_orderkey", F.coalesce(V.ssn(F.col("num")), F.lit(True)).alias("possible"))


def vin_orders(spark, d):
    o = spark.read.parquet(f"{d}/orders.parquet").select("o_orderkey", F.concat(F.lit("1HGCM8"), F.lpad((F.col("o_orderkey") * 7919 % 100000000000).cast("string"), 11, "0")).alias("num"))
    return o.select("o_orderkey", V.vin(F.col("num")).alias("valid"))


def label_aliases(spark, d):
    """Map event types and languages used as model labels to categories (unknown ones are custom)."""
    values = ", ".join(f"('{k}', '{v}')" for k, v in ALIASES.items())
    table = spark.sql(f"SELECT * FROM VALUES {values} AS t(label, category)")
    rows = spark.sql(f"SELECT label FROM VALUES {', '.join(repr((k.upper(),)).replace(',)', ')') for k in [*ALIASES, 'weather'])} AS t(label)")
    return rows.join(F.broadcast(table.withColumnRenamed("label", "l")), F.lower("label") == F.col("l"), "left").select("label", F.coalesce("category", F.concat(F.lit("custom:"), F.col("label"))).alias("category"))


def merged_model(spark, d):
    """Pattern spans merged with a deterministic stand-in for a model: capitalised words pairs as persons."""
    t = F.col("text")
    model = F.transform(S.located(t, r"\b[A-Z][a-z]+ [A-Z][a-z]+\b"), lambda m: F.struct(m["start"].cast("int").alias("start"), m["end"].cast("int").alias("end"), F.lit(99).alias("order"), F.lit("person").alias("category"), F.lit(0.7).alias("confidence"), F.lit("[PERSON]").alias("template"), F.lit("model").alias("source")))
    rows = detected(spark, d).select("doc_id", S.merge(F.col("spans"), model).alias("spans"))
    return rows.select("doc_id", F.size("spans").alias("n"), F.size(F.filter("spans", lambda s: s["source"] == "model")).alias("n_model"))


def structured_metadata(spark, d):
    """Redact the string leaves of the JSON in ``events.props``."""
    e = spark.read.parquet(f"{d}/events.parquet").select("event_id", F.from_json("props", "map<string,string>").alias("m"))
    return e.select("event_id", F.to_json(F.transform_values("m", lambda k, v: S.redact(v, S.detect(v)))).alias("props"))


def html_text(spark, d):
    """Pages as text: breaks to newlines, tags dropped, two entities decoded."""
    h = F.col("html")
    for tag in ("<br>", "<br/>", "<br />", "</p>", "</div>"):
        h = F.replace(h, F.lit(tag), F.lit("\n"))
    parts = F.split(h, "<")
    text = F.concat_ws("", F.element_at(parts, 1), F.array_join(F.transform(F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0))), lambda p: F.when(p.contains(">"), F.substring(p, F.instr(p, ">") + 1, F.length(p))).otherwise(F.lit(""))), ""))
    return spark.read.parquet(f"{d}/pages.parquet").select("page_id", F.md5(F.replace(F.replace(text, F.lit("&nbsp;"), F.lit(" ")), F.lit("&amp;"), F.lit("&"))).alias("text_md5"))


def span_validation(spark, d):
    """How many caller-supplied spans break the rules (built from conversation turns)."""
    c = spark.read.parquet(f"{d}/conversations.parquet").select(F.char_length("text").alias("n"), (F.col("turn") * 7 % 50).alias("a"), (F.col("turn") * 11 % 90).alias("b"))
    return c.agg(F.count_if((F.col("a") >= F.col("b")) | (F.col("b") > F.col("n"))).alias("invalid"), F.count("*").alias("spans"))


def sql_regex(n):
    return PATTERNS[n].regex.replace("'", "''")


QUERIES = {
    "d1_category_counts": category_counts, "d1_pattern_counts": pattern_counts, "r1_redacted_documents": redacted, "r1_mask_email": mask_email,
    "r4_remove_email": remove_email, "r13_token_projection": token_projection, "v1_v2_luhn_card": luhn_orders, "v3_iban": iban_orders,
    "v4_ssn": ssn_orders, "v5_vin": vin_orders, "d4_label_aliases": label_aliases,
    "d5_merge_model_spans": merged_model, "d12_structured_metadata": structured_metadata, "src5_html_to_text": html_text, "d6_span_validation": span_validation,
}

LUHN = """(list_sum(list_transform(range(1, len(num) + 1), lambda i: CASE WHEN i % 2 = 1 THEN CAST(substr(reverse(num), i, 1) AS INT)
  WHEN CAST(substr(reverse(num), i, 1) AS INT) > 4 THEN CAST(substr(reverse(num), i, 1) AS INT) * 2 - 9
  ELSE CAST(substr(reverse(num), i, 1) AS INT) * 2 END)) % 10 = 0)"""

SQL = {
    "d1_pattern_counts": "SELECT " + ", ".join(f"CAST(sum(len(regexp_extract_all(text, '{sql_regex(n)}'))) AS BIGINT) AS {a}" for a, n in COUNTED.items()) + " FROM documents",
    "r1_mask_email": f"SELECT doc_id, md5(regexp_replace(text, '{sql_regex(0)}', '[EMAIL]', 'g')) AS masked_md5 FROM documents",
    "r4_remove_email": f"SELECT doc_id, CAST(length(regexp_replace(text, '{sql_regex(0)}', '', 'g')) AS BIGINT) AS \"left\" FROM documents",
    "r13_token_projection": f"""WITH t AS (SELECT doc_id, unnest(regexp_extract_all(regexp_replace(regexp_replace(text, '{sql_regex(0)}', '[EMAIL]', 'g'), '{sql_regex(8)}', '[IP]', 'g'), '\\[(EMAIL|IP)\\]')) AS token FROM documents)
        SELECT doc_id, token, count(*) AS n FROM t GROUP BY doc_id, token""",
    "v1_v2_luhn_card": f"WITH o AS (SELECT o_orderkey, lpad(CAST(o_orderkey * 7919 + 4111111111111 AS VARCHAR), 16, '4') AS num FROM orders) SELECT o_orderkey, {LUHN} AS luhn, {LUHN} AS card FROM o",
    "v3_iban": """WITH o AS (SELECT o_orderkey, lpad(CAST(o_orderkey * 104729 AS VARCHAR), 23, '3') AS num FROM orders)
        SELECT o_orderkey, CAST(num || '152776' AS HUGEINT) % 97 = 1 AS valid FROM o""",
    "v4_ssn": """WITH o AS (SELECT o_orderkey, lpad(CAST(o_orderkey * 104729 % 1000000000 AS VARCHAR), 9, '0') AS num FROM orders)
        SELECT o_orderkey, NOT (left(num, 3) IN ('000', '666') OR left(num, 1) = '9' OR substr(num, 4, 2) = '00' OR right(num, 4) = '0000') AS possible FROM o""",
    "v5_vin": """WITH o AS (SELECT o_orderkey, '1HGCM8' || lpad(CAST(o_orderkey * 7919 % 100000000000 AS VARCHAR), 11, '0') AS num FROM orders),
        s AS (SELECT o_orderkey, num, list_sum(list_transform(range(1, 18), lambda i: CAST(substr(translate(num, 'HGCM', '8734'), i, 1) AS INT) * [8,7,6,5,4,3,2,10,0,9,8,7,6,5,4,3,2][i])) % 11 AS r FROM o)
        SELECT o_orderkey, substr(num, 9, 1) = CASE WHEN r = 10 THEN 'X' ELSE CAST(CAST(r AS INT) AS VARCHAR) END AS valid FROM s""",
    "d4_label_aliases": "SELECT * FROM (VALUES " + ", ".join(f"('{k.upper()}', '{v}')" for k, v in ALIASES.items()) + ", ('WEATHER', 'custom:WEATHER')) AS t(label, category)",
    "src5_html_to_text": """WITH p AS (SELECT page_id, string_split(replace(replace(replace(replace(replace(html, '<br>', chr(10)), '<br/>', chr(10)), '<br />', chr(10)), '</p>', chr(10)), '</div>', chr(10)), '<') AS x FROM pages)
        SELECT page_id, md5(replace(replace(x[1] || coalesce(list_aggregate(list_transform(x[2:], lambda p: CASE WHEN contains(p, '>') THEN substr(p, position('>' IN p) + 1) ELSE '' END), 'string_agg', ''), ''), '&nbsp;', ' '), '&amp;', '&')) AS text_md5 FROM p""",
    "d6_span_validation": "SELECT count(*) FILTER (turn * 7 % 50 >= turn * 11 % 90 OR turn * 11 % 90 > length(text)) AS invalid, count(*) AS spans FROM conversations",
}
