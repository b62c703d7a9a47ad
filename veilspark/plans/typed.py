"""Typed filters and token counts over JSON metadata of mixed types, with SQL beside them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.filters import compile_filter, json_nodes, token_of, validate
from . import detection

# Metadata of events by their number, {0} being the number in their properties: the same key holds other types, or nothing, or is no JSON.
SHAPES = [
    '{{"k":{0},"tags":["red",{0}],"owner":{{"name":"Ann Lee"}}}}', '{{"k":"{0}","tags":"red","owner":{{"name":"anna"}}}}', '{{"k":{0}.5,"tags":[["red"]],"owner":["name"]}}',
    '{{"k":null,"tags":[]}}', '{{"k":true,"tags":["RED","red",null]}}', '{{"k":[{0}],"owner":{{"name":{{"first":"Ann"}}}}}}', '{{"k":', '{{"owner":{{"name":7}},"tags":[7.5,{{"a":1,"b":"x"}}]}}',
]


def f(field: str, kind: str, **more) -> dict:
    return {kind: {"field": f"metadata.{field}", **more}}


FILTERS = {
    "number_eq": f("k", "eq", value=20), "string_eq": f("k", "eq", value="20"), "null_eq": f("k", "eq", value=None), "bool_eq": f("k", "eq", value=True),
    "list_eq": f("k", "eq", value=[20]), "either": f("k", "in", values=[20, "21", 22.5, True]), "number_range": f("k", "range", gte=20, lt=60), "string_range": f("k", "range", gt="20", lte="60"),
    "mixed_range": f("k", "range", gte=20, lt="60"), "holds_string": f("tags", "array_contains", value="red"), "holds_number": f("tags", "array_contains", value=20),
    "holds_object": f("tags", "array_contains", value={"b": "x", "a": 1}), "nested_text": f("owner.name", "text_match", query="ANN"), "missing": {"not": f("owner.name", "eq", value=7)},
    "joined": {"and": [{"or": [f("k", "range", gte=50), f("tags", "array_contains", value=None)]}, {"not": f("owner.name", "text_match", query="lee")}, {"range": {"field": "value", "gte": 10}}]},
    "wrong_column": {"or": [{"eq": {"field": "value", "value": "10"}}, {"range": {"field": "event_type", "gte": 3}}, {"text_match": {"field": "event_type", "query": "VIEW"}}]},
}


def with_metadata(spark, d) -> DataFrame:
    e = spark.read.parquet(f"{d}/events.parquet")
    k = F.get_json_object("props", "$.k")
    shaped = None
    for n, text in enumerate(SHAPES):
        made = F.format_string(text.replace("{{", "{").replace("}}", "}").replace("{0}", "%1$s"), k)
        shaped = F.when(F.col("event_id") % 9 == n, made) if shaped is None else shaped.when(F.col("event_id") % 9 == n, made)
    return e.select("event_id", "event_type", "value", shaped.alias("metadata"))


def typed_filters(spark, d):
    """Sixteen filters over every event: each type meets its own, and all else is false."""
    e = with_metadata(spark, d)
    for one in FILTERS.values():
        validate(one, {"value", "event_type"})
    return e.select("event_id", *[compile_filter(one, e.schema).alias(name) for name, one in FILTERS.items()])


def metadata_tokens(spark, d):
    """Tokens of masked bodies and of the nested metadata of turns; an object that stands for a token is not entered."""
    text = F.coalesce("text", F.lit(""))
    person = F.concat(F.lit("[PERSON:k1:"), F.upper(F.left(F.md5(text), F.lit(3))), F.lit("]"))
    place = F.concat(F.lit('{"token_id":"[PLACE:k1:'), (F.col("conv_id") % 7).cast("string"), F.lit(']"}'))
    meta = F.concat(
        F.lit('{"title":{"tokenId":"'), person, F.lit('","mode":"mask","inner":{"tokenId":"[NEVER:k1:A]"}},"tokenId":7,"pages":['),
        F.array_join(F.array_repeat(F.concat(F.lit('{"notes":[[],['), place, F.lit(',{"tokenId":null,"token_id":"[NULL:k1:B]"}]]}')), (F.col("turn") % 4 + 1).cast("int")), ","), F.lit("]}"))
    rows = spark.read.parquet(f"{d}/conversations.parquet").select(F.concat_ws(":", "conv_id", "turn").alias("key"), F.when(F.col("turn") % 5 == 4, F.lit("no json")).otherwise(meta).alias("metadata"))
    nodes = json_nodes(rows, "key", "metadata", stop=lambda node: token_of(node).isNotNull())
    found = nodes.select(token_of(F.col("node")).alias("token")).where("token is not null").groupBy("token").agg(F.count("*").alias("n"))
    both = detection.token_projection(spark, d).select("token", "n").unionByName(found)
    return both.groupBy("token").agg(F.sum("n").alias("n"))


QUERIES = {"k10_typed_filters": typed_filters, "k36_metadata_tokens": metadata_tokens}

K = "json_extract_string(props, '$.k')"
MADE = "CASE event_id % 9 " + " ".join(f"WHEN {n} THEN " + "'" + t.replace("{{", "{").replace("}}", "}").replace("{0}", f"' || {K} || '") + "'" for n, t in enumerate(SHAPES)) + " END"
IS = "coalesce({}, false)".format
AS_NUM = "TRY_CAST(json_extract_string(m, '$.k') AS DOUBLE)"
TEXT = "json_type(m, '$.owner.name') = 'VARCHAR' AND contains(lower(json_extract_string(m, '$.owner.name')), '{}')".format


def holds(kinds: str, text: str) -> str:
    """Whether an item of the tags has one of the types and that JSON text."""
    return f"json_type(m, '$.tags') = 'ARRAY' AND len(list_filter(json_extract(m, '$.tags[*]'), lambda x: json_type(x) IN ({kinds}) AND CAST(x AS VARCHAR) = '{text}')) > 0"


SQL = {
    "k10_typed_filters": f"""WITH e AS (SELECT event_id, event_type, value, {MADE} AS raw FROM events), v AS (SELECT event_id, event_type, value, CASE WHEN json_valid(raw) THEN raw END AS m FROM e)
        SELECT event_id, {IS("json_type(m, '$.k') IN ('UBIGINT', 'BIGINT') AND " + AS_NUM + " = 20")} AS number_eq, {IS("json_type(m, '$.k') = 'VARCHAR' AND json_extract_string(m, '$.k') = '20'")} AS string_eq,
        {IS("json_type(m, '$.k') = 'NULL'")} AS null_eq, {IS("json_type(m, '$.k') = 'BOOLEAN' AND json_extract_string(m, '$.k') = 'true'")} AS bool_eq, {IS("json_type(m, '$.k') = 'ARRAY' AND CAST(json_extract(m, '$.k') AS VARCHAR) = '[20]'")} AS list_eq,
        {IS("(json_type(m, '$.k'), json_extract_string(m, '$.k')) IN (('UBIGINT', '20'), ('VARCHAR', '21'), ('DOUBLE', '22.5'), ('BOOLEAN', 'true'))")} AS either,
        {IS("json_type(m, '$.k') IN ('UBIGINT', 'BIGINT', 'DOUBLE') AND " + AS_NUM + " >= 20 AND " + AS_NUM + " < 60")} AS number_range,
        {IS("json_type(m, '$.k') = 'VARCHAR' AND json_extract_string(m, '$.k') > '20' AND json_extract_string(m, '$.k') <= '60'")} AS string_range, false AS mixed_range,
        {IS(holds("'VARCHAR'", '"red"'))} AS holds_string, {IS(holds("'UBIGINT', 'BIGINT'", '20'))} AS holds_number, {IS(holds("'OBJECT'", '{"a":1,"b":"x"}'))} AS holds_object,
        {IS(TEXT('ann'))} AS nested_text, NOT {IS("json_type(m, '$.owner.name') = 'UBIGINT' AND json_extract_string(m, '$.owner.name') = '7'")} AS missing,
        ({IS("json_type(m, '$.k') IN ('UBIGINT', 'BIGINT', 'DOUBLE') AND " + AS_NUM + " >= 50")} OR {IS(holds("'NULL'", 'null'))}) AND NOT {IS(TEXT('lee'))} AND {IS('value >= 10')} AS joined,
        {IS("contains(lower(event_type), 'view')")} AS wrong_column FROM v""",
    "k36_metadata_tokens": f"""WITH c AS (SELECT '[PERSON:k1:' || upper(left(md5(coalesce(text, '')), 3)) || ']' AS person, '[PLACE:k1:' || conv_id % 7 || ']' AS place, turn % 4 + 1 AS pages FROM conversations WHERE turn % 5 <> 4),
        m AS (SELECT person AS token, 1 AS n FROM c UNION ALL SELECT place, pages FROM c), b AS ({detection.SQL['r13_token_projection']})
        SELECT token, CAST(sum(n) AS BIGINT) AS n FROM (SELECT token, n FROM b UNION ALL SELECT token, n FROM m) GROUP BY token""",
}
