"""Exports: a vault of documents written and read again, index lines of entities, and a graph with its edges, with SQL beside them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import spans as S
from ..operators import graph_export as G
from ..operators.shared import shared_folder
from ..sources import vault
from .facts import IP, MAIL, SURE, documents
from .registry import REGISTRY, e1_registry, placed

PROCESSED = "2026-01-01T00:00:00Z"


def snk2_vault(spark, d):
    """Every document's file of a vault, as read back, beside its index line."""
    t = documents(spark, d).withColumn("spans", S.detect(F.col("text"), SURE))
    entities = F.transform("spans", lambda s: F.struct(s["category"].alias("category"), s["start"].cast("int").alias("start"), s["end"].cast("int").alias("end"), s["confidence"].cast("double").alias("confidence")))
    rows = t.select(F.concat(F.lit("doc "), F.col("doc_id").cast("string")).alias("name"), F.concat(F.lit("tables/documents#"), F.col("doc_id").cast("string")).alias("source"), F.lit("text/plain").alias("type"), S.redact(F.col("text"), F.col("spans")).alias("content"), entities.alias("entities"))
    folder = shared_folder(spark)
    vault.write_vault(rows, folder, PROCESSED)
    return vault.read_documents(spark, folder).select("id", "path", "pii_entities_found", F.md5("content").alias("file_md5"))


def snk3_entity_lines(spark, d):
    """Index lines of entities with their aliases."""
    name = F.lower(F.regexp_replace("surface", "[.,;:]+$", ""))
    aliases = placed(spark, d).groupBy("category", "vertical", name.alias("name")).agg(F.array_sort(F.collect_set("surface")).alias("all"))
    e = e1_registry(spark, d).join(aliases, ["category", "vertical", "name"])
    line = F.to_json(F.struct(F.col("entity_id").alias("id"), F.col("canonical").alias("name"), F.col("category").alias("type"), "vertical", F.col("mentions").alias("mention_count"), F.col("documents").alias("document_count"), F.array_remove("all", F.col("canonical")).alias("aliases")))
    return e.select("entity_id", line.alias("line"))


def edges(spark, d) -> DataFrame:
    """Relationships between entities that follow each other in a document: the most confident one of each pair, with what stands between."""
    name = F.lower(F.regexp_replace("surface", "[.,;:]+$", ""))
    entity = F.concat(F.lit("ent-"), F.left(F.sha2(F.concat_ws("|", "category", "vertical", name), 256), F.lit(12)))
    m = placed(spark, d).select("doc_id", "start", "end", "confidence", entity.alias("source"))
    after = Window.partitionBy("doc_id").orderBy("start", "end", "source")
    pairs = m.select("doc_id", "source", F.lead("source").over(after).alias("target"), F.least("confidence", F.lead("confidence").over(after)).alias("confidence"), "end", F.lead("start").over(after).alias("next")).where("target is not null and source <> target")
    gap = F.concat(F.lit("doc "), F.col("doc_id").cast("string"), F.lit(", "), (F.col("next") - F.col("end")).cast("string"), F.lit(" characters"))
    best = F.max_by(gap, F.struct("confidence", -F.col("doc_id"), -F.col("end")))
    return pairs.groupBy("source", "target").agg(F.lit("followed_by").alias("type"), F.max("confidence").alias("confidence"), best.alias("context"), F.count("*").alias("n"))


def snk4_edges(spark, d):
    """The graph's edges as Cypher, Turtle and node-link lines."""
    e = edges(spark, d).withColumn("context", F.concat("context", F.lit(' "seen"')))
    kinds = {"cypher": G.cypher_edges, "turtle": G.turtle_edges, "node_link": G.node_link_edges}
    out = e.select("source", "target", "n")
    for name, made in kinds.items():
        out = out.join(made(e).withColumnRenamed("value", name), ["source", "target"])
    return out


QUERIES = {"snk2_vault_files": snk2_vault, "snk3_entity_lines": snk3_entity_lines, "snk4_graph_edges": snk4_edges}

SQL = {
    "snk2_vault_files": f"""WITH t AS (SELECT doc_id, regexp_replace(regexp_replace(coalesce(text, ''), '{MAIL}', '[EMAIL]', 'g'), '{IP}', '[IP]', 'g') AS text, len(regexp_extract_all(coalesce(text, ''), '({MAIL}|{IP})')) AS n FROM documents)
        SELECT 'doc ' || doc_id AS id, 'documents/doc-' || doc_id || '-' || left(sha256('["doc ' || doc_id || '", "tables/documents#' || doc_id || '"]'), 12) || '.md' AS path, n AS pii_entities_found,
        md5('---' || chr(10) || 'source: "tables/documents#' || doc_id || '"' || chr(10) || 'type: text/plain' || chr(10) || 'processed: {PROCESSED}' || chr(10) || 'pii_entities_found: ' || n || chr(10) || '---' || chr(10) || chr(10) || text || chr(10)) AS file_md5 FROM t""",
    "snk3_entity_lines": f"""WITH {REGISTRY}, a AS (SELECT category, vertical, name, list_sort(list(DISTINCT surface)) AS s FROM placed GROUP BY 1, 2, 3)
        SELECT entity_id, '{{"id":"' || entity_id || '","name":"' || canonical || '","type":"' || category || '","vertical":"' || vertical || '","mention_count":' || mentions || ',"document_count":' || documents || ',"aliases":[' ||
        array_to_string(list_transform(list_filter(s, lambda x: x <> canonical), lambda x: '"' || x || '"'), ',') || ']}}' AS line FROM registry JOIN a USING (category, vertical, name)""",
    "snk4_graph_edges": f"""WITH {REGISTRY}, m AS (SELECT doc_id, s, e, confidence, 'ent-' || left(sha256(category || '|' || vertical || '|' || name), 12) AS source FROM placed),
        p AS (SELECT doc_id, source, e, lead(source) OVER w AS target, least(confidence, lead(confidence) OVER w) AS c, lead(s) OVER w AS nxt FROM m WINDOW w AS (PARTITION BY doc_id ORDER BY s, e, source)),
        g AS (SELECT source, target, count(*) AS n, max(c) AS c, max_by('doc ' || doc_id || ', ' || (nxt - e) || ' characters', (c, -doc_id, -e)) || ' "seen"' AS x FROM p WHERE target IS NOT NULL AND source <> target GROUP BY 1, 2)
        SELECT source, target, n, 'MATCH (a:Entity {{id: "' || source || '"}}), (b:Entity {{id: "' || target || '"}}) CREATE (a)-[:FOLLOWED_BY {{confidence: ' || c || ', context: "' || replace(x, '"', '\\"') || '"}}]->(b);' AS cypher,
        '<urn:entity:' || source || '> <urn:followed_by> <urn:entity:' || target || '> .' AS turtle, '{{"source":"' || source || '","target":"' || target || '","type":"followed_by","confidence":' || c || ',"context":"' || replace(x, '"', '\\"') || '"}}' AS node_link FROM g""",
}
