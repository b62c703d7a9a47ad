"""Span facts: what detection hands to audit, review, glossary, registry and scoring.

One row per detected span of every document. Patterns on which all regex dialects agree
(mail, IPv4) and capitalised words as a model's person spans, with a confidence
made of the word, so that SQL can recompute every fact.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import spans as S
from ..functions.patterns import Pattern
from ..operators.shared import spread

MAIL = "[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+[.][A-Za-z]{2,}"
IP = "[0-9]{1,3}[.][0-9]{1,3}[.][0-9]{1,3}[.][0-9]{1,3}"
NAME = "[A-Z][a-z]{5,}"
KINDS = {"email": MAIL, "ip_address": IP, "person": NAME}
#: Sure patterns, as detection takes them.
SURE = [Pattern("email", MAIL, "[EMAIL]"), Pattern("ip_address", IP, "[IP]")]


def documents(spark, d) -> DataFrame:
    return spread(spark.read.parquet(f"{d}/documents.parquet")).select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.coalesce("source", F.lit("default")).alias("tenant"))


def confidence(category: Column, surface: Column) -> Column:
    return F.when(category == "person", (F.char_length(surface) * 13 % 61 + 40) / 100).otherwise(F.lit(1.0))


def facts(spark, d) -> DataFrame:
    """``doc_id, tenant, category, surface, start, end, confidence``; offsets are code points."""
    def spans(kind: str, pattern: str) -> Column:
        return F.transform(S.located(F.col("text"), pattern), lambda m: F.struct(F.lit(kind).alias("category"), m["text"].alias("surface"), m["start"].alias("start"), m["end"].alias("end")))

    found = F.concat(*[spans(k, p) for k, p in KINDS.items()])
    # the outer form: else Spark would test the spans before it unfolds them, and find them twice
    rows = documents(spark, d).select("doc_id", "tenant", F.explode_outer(found).alias("f")).where("f is not null").select("doc_id", "tenant", "f.*")
    return rows.withColumn("confidence", confidence(F.col("category"), F.col("surface")))


def located_sql(name: str, pattern: str, source: str = "docs") -> str:
    """CTEs ``<name>`` with ``doc_id, surface, s, e`` of a pattern's matches in ``<source>(doc_id, text)``."""
    return f"""{name}_m AS (SELECT doc_id, regexp_extract_all(text, '{pattern}') AS f, regexp_split_to_array(text, '{pattern}') AS g FROM {source}),
  {name}_r AS (SELECT doc_id, generate_subscripts(f, 1) AS i, unnest(f) AS surface, unnest(g[1:len(f)]) AS gap FROM {name}_m WHERE len(f) > 0),
  {name} AS (SELECT doc_id, surface, e - length(surface) AS s, e FROM (SELECT doc_id, surface, CAST(sum(length(gap) + length(surface)) OVER (PARTITION BY doc_id ORDER BY i) AS BIGINT) AS e FROM {name}_r))"""


FACTS = "docs AS (SELECT doc_id, coalesce(text, '') AS text, coalesce(source, 'default') AS tenant FROM documents),\n  " + ",\n  ".join(located_sql(f"k_{k}", p) for k, p in KINDS.items()) + """,
  facts AS (SELECT doc_id, tenant, category, surface, s, e, CASE WHEN category = 'person' THEN (length(surface) * 13 % 61 + 40) / 100 ELSE 1.0 END::DOUBLE AS confidence FROM (""" + " UNION ALL ".join(f"SELECT doc_id, '{k}' AS category, surface, s, e FROM k_{k}" for k in KINDS) + ") JOIN docs USING (doc_id))"
