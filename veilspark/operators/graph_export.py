"""Entities and relationships as a graph: Cypher statements, node-link JSON lines and Turtle, one line of text each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def literal(text: Column) -> Column:
    """A text in double quotes; backslashes, quotes and line ends escaped, as Cypher and Turtle both read them."""
    for plain, escaped in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r")):
        text = F.replace(text, F.lit(plain), F.lit(escaped))
    return F.concat(F.lit('"'), text, F.lit('"'))


def iri(identity: Column) -> Column:
    """An id as an IRI; characters that may not stand in one are percent-encoded."""
    return F.concat(F.lit("<urn:entity:"), F.replace(F.url_encode(identity), F.lit("+"), F.lit("%20")), F.lit(">"))


def cypher_nodes(nodes: DataFrame) -> DataFrame:
    """``nodes(id, name, type, vertical, mentions)`` as statements that create them."""
    props = F.concat_ws(", ", *[F.concat(F.lit(f"{c}: "), literal(F.col(c))) for c in ("id", "name", "type", "vertical")], F.concat(F.lit("mention_count: "), F.col("mentions").cast("string")))
    return nodes.select("id", F.concat(F.lit("CREATE (e:Entity {"), props, F.lit("});")).alias("value"))


def cypher_edges(edges: DataFrame) -> DataFrame:
    """``edges(source, target, type, confidence, context)`` as statements that match both ends and create the relationship."""
    kind = F.regexp_replace(F.upper("type"), "[^A-Z0-9_]", "_")
    match = F.concat(F.lit("MATCH (a:Entity {id: "), literal(F.col("source")), F.lit("}), (b:Entity {id: "), literal(F.col("target")), F.lit("}) "))
    made = F.concat(F.lit("CREATE (a)-[:"), kind, F.lit(" {confidence: "), F.col("confidence").cast("string"), F.lit(", context: "), literal(F.col("context")), F.lit("}]->(b);"))
    return edges.select("source", "target", F.concat(match, made).alias("value"))


def turtle_nodes(nodes: DataFrame) -> DataFrame:
    name = lambda p, c: F.concat(F.lit(f" <urn:{p}> "), literal(F.col(c)))
    return nodes.select("id", F.concat(iri(F.col("id")), name("type", "type"), F.lit(" ;"), name("name", "name"), F.lit(" ;"), name("vertical", "vertical"), F.lit(" ; <urn:mentions> "), F.col("mentions").cast("string"), F.lit(" .")).alias("value"))


def turtle_edges(edges: DataFrame) -> DataFrame:
    return edges.select("source", "target", F.concat(iri(F.col("source")), F.lit(" <urn:"), F.regexp_replace(F.lower("type"), "[^a-z0-9_]", "_"), F.lit("> "), iri(F.col("target")), F.lit(" .")).alias("value"))


def node_link_nodes(nodes: DataFrame) -> DataFrame:
    return nodes.select("id", F.to_json(F.struct("id", "name", "type", "vertical")).alias("value"))


def node_link_edges(edges: DataFrame) -> DataFrame:
    return edges.select("source", "target", F.to_json(F.struct("source", "target", "type", "confidence", "context")).alias("value"))


def write_graph(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    """The three exports below a folder: nodes before edges, as many files as there are partitions, nothing through one task."""
    for kind, of_nodes, of_edges in (("cypher", cypher_nodes, cypher_edges), ("node-link", node_link_nodes, node_link_edges), ("turtle", turtle_nodes, turtle_edges)):
        of_nodes(nodes).select("value").write.mode("overwrite").text(f"{path}/{kind}/nodes")
        of_edges(edges).select("value").write.mode("overwrite").text(f"{path}/{kind}/edges")
