"""The typed filter language of retrieval, compiled to a Column.

Nodes are dicts with one key: eq, in, range, array_contains, text_match, and, or,
not. Logic is two-valued: a leaf on a missing field is false, so its negation is true.
"""

from __future__ import annotations

from collections.abc import Callable
from json import dumps

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, DataType, NumericType, StringType, StructType

from .shared import stored

MAX_DEPTH, MAX_NODES, MAX_TEXT_MATCHES, MAX_QUERY_BYTES = 8, 64, 4, 1024


class FilterError(ValueError):
    """A filter that breaks the limits or names an unknown field."""


def validate(node: dict, fields: set[str]) -> None:
    """Depth, nodes (values of ``in`` count), text matches, their length, and field names."""
    seen = {"nodes": 0, "text": 0}

    def walk(n: dict, depth: int) -> None:
        if depth > MAX_DEPTH:
            raise FilterError("too deep")
        (kind, arg), = n.items()
        seen["nodes"] += 1 + (len(arg["values"]) if kind == "in" else 0)
        if kind in ("and", "or"):
            for x in arg:
                walk(x, depth + 1)
        elif kind == "not":
            walk(arg, depth + 1)
        elif kind in ("eq", "in", "range", "array_contains", "text_match"):
            if arg["field"] not in fields and not arg["field"].startswith("metadata."):
                raise FilterError(f"unknown field {arg['field']}")
            if kind == "text_match":
                seen["text"] += 1
                if len(arg["query"].encode()) > MAX_QUERY_BYTES:
                    raise FilterError("query too long")
        else:
            raise FilterError(f"unknown node {kind}")
        if seen["nodes"] > MAX_NODES or seen["text"] > MAX_TEXT_MATCHES:
            raise FilterError("too many nodes")

    walk(node, 1)


def path(name: str) -> str:
    """The path of a dotted field inside its JSON document: object keys only."""
    parts = name.split(".")[1:]
    if any("'" in x and '"' in x for x in parts):
        raise FilterError(f"no path for {name}")
    return "$" + "".join(f'["{x}"]' if "'" in x else f"['{x}']" for x in parts)


def variant(name: str, json: Column) -> Column:
    """A field of a JSON document as VARIANT, null where the document is no JSON or has no such field."""
    return F.try_variant_get(F.try_parse_json(json), path(name), "variant")


def is_kind(v: Column, pattern: str) -> Column:
    return F.schema_of_variant(v).rlike(f"^({pattern})")


NUMBER, FRACTION = "BIGINT|DECIMAL|DOUBLE", "DECIMAL|DOUBLE"


def json_equal(v: Column, value) -> Column:
    """A variant against a JSON value: same type and same value; 1 and 1.0 differ, as do 1 and "1".

    Objects and arrays compare by their canonical text, in which keys are sorted.
    """
    if value is None:
        return is_kind(v, "VOID")
    if isinstance(value, bool):
        return is_kind(v, "BOOLEAN") & (F.try_variant_get(v, "$", "boolean") == F.lit(value))
    if isinstance(value, int):
        return is_kind(v, "BIGINT") & (F.try_variant_get(v, "$", "bigint") == F.lit(value))
    if isinstance(value, float):
        return is_kind(v, FRACTION) & (F.try_variant_get(v, "$", "double") == F.lit(value))
    if isinstance(value, str):
        return is_kind(v, "STRING") & (F.try_variant_get(v, "$", "string") == F.lit(value))
    return F.to_json(v) == F.to_json(F.parse_json(F.lit(dumps(value))))


def json_leaf(kind: str, arg: dict, v: Column) -> Column:
    """A leaf on a JSON field: numbers meet numbers, strings meet strings, anything else is false."""
    if kind == "eq":
        return json_equal(v, arg["value"])
    if kind == "in":
        return any_of(json_equal(v, x) for x in arg["values"])
    if kind == "array_contains":
        return F.exists(F.try_variant_get(v, "$", "array<variant>"), lambda x: F.coalesce(json_equal(x, arg["value"]), F.lit(False)))
    text = F.when(is_kind(v, "STRING"), F.try_variant_get(v, "$", "string"))
    if kind == "text_match":
        return F.contains(F.lower(text), F.lit(arg["query"].lower()))
    number = F.when(is_kind(v, NUMBER), F.try_variant_get(v, "$", "double"))
    return within(arg, lambda bound: text if isinstance(bound, str) else number if is_number(bound) else None, v)


def is_number(x) -> bool:
    return isinstance(x, int | float) and not isinstance(x, bool)


def any_of(leaves) -> Column:
    out = F.lit(False)
    for x in leaves:
        out = out | F.coalesce(x, F.lit(False))
    return out


def within(arg: dict, side: Callable, present: Column) -> Column:
    """All bounds of a range; a bound whose type the field does not have is false."""
    out = present.isNotNull()
    for name, test in (("gt", "__gt__"), ("gte", "__ge__"), ("lt", "__lt__"), ("lte", "__le__")):
        bound = arg.get(name)
        if bound is not None:
            f = side(bound)
            out = out & (F.lit(False) if f is None else getattr(f, test)(F.lit(bound)))
    return out


def fits(kind: DataType, value) -> bool:
    """Whether a value can equal or bound a typed column."""
    if isinstance(kind, StringType):
        return isinstance(value, str)
    if isinstance(kind, BooleanType):
        return isinstance(value, bool)
    return isinstance(kind, NumericType) and is_number(value)


def column_leaf(kind: str, arg: dict, name: str, of: DataType | None) -> Column:
    """A leaf on a typed column, in terms that reach the scan; without a type it is taken to fit."""
    f, ok = F.col(name), (lambda x, t=of: t is None or fits(t, x))
    if kind == "eq":
        return f.isNull() & F.lit(False) if arg["value"] is None else f == F.lit(arg["value"]) if ok(arg["value"]) else F.lit(False)
    if kind == "in":
        values = [x for x in arg["values"] if x is not None and ok(x)]
        return f.isin(*values) if values else F.lit(False)
    if kind == "range":
        return within(arg, lambda bound: f if ok(bound) else None, f)
    if kind == "array_contains":
        held = of.elementType if isinstance(of, ArrayType) else None
        known = of is None or (held is not None and arg["value"] is not None and fits(held, arg["value"]))
        return F.array_contains(f, arg["value"]) if known else F.lit(False)
    return F.contains(F.lower(f), F.lit(arg["query"].lower())) if of is None or isinstance(of, StringType) else F.lit(False)


def compile_filter(node: dict, schema: StructType | None = None, json: str = "metadata") -> Column:
    """A boolean Column, never null: logic is two-valued, a leaf on a missing or differently typed field is false.

    Fields ``metadata.a.b`` are looked up in the JSON text of the column ``json``; what is no JSON has no fields. Others are columns, whose types
    ``schema`` tells.
    """
    (kind, arg), = node.items()
    if kind in ("and", "or"):
        out = F.lit(kind == "and")
        for x in arg:
            part = compile_filter(x, schema, json)
            out = out & part if kind == "and" else out | part
        return out
    if kind == "not":
        return ~compile_filter(arg, schema, json)
    if kind not in ("eq", "in", "range", "array_contains", "text_match"):
        raise FilterError(f"unknown node {kind}")
    name = arg["field"]
    if name.startswith("metadata."):
        leaf = json_leaf(kind, arg, variant(name, F.col(json)))
    else:
        leaf = column_leaf(kind, arg, name, schema[name].dataType if schema is not None else None)
    return F.coalesce(leaf, F.lit(False))


def json_nodes(rows: DataFrame, key: str, document: str, stop: Callable[[Column], Column] | None = None) -> DataFrame:
    """``key, node``: every object and array of the JSON documents, at any depth, one level after the other.

    Nodes of which ``stop`` is true are given but not entered. What is no JSON has no nodes. Each level is one pass over the nodes
    of the level before, however deep other documents go.
    """
    spark = rows.sparkSession
    level = stored(rows.select(F.col(key).alias("_of"), F.try_parse_json(document).alias("node")).where(is_kind(F.col("node"), "OBJECT|ARRAY")))
    found = None
    while not level.isEmpty():
        found = level if found is None else found.unionByName(level)
        inside = level if stop is None else level.where(~F.coalesce(stop(F.col("node")), F.lit(False)))
        below = inside.lateralJoin(spark.tvf.variant_explode(F.col("node").outer())).select("_of", F.col("value").alias("node"))
        level = stored(below.where(is_kind(F.col("node"), "OBJECT|ARRAY")))
    return (level if found is None else found).withColumnRenamed("_of", key)


def token_of(node: Column) -> Column:
    """The token id of an object that stands for a token: ``tokenId``, else ``token_id``, if it is a string."""
    first, second = (F.try_variant_get(node, f"$['{k}']", "variant") for k in ("tokenId", "token_id"))
    either = F.coalesce(first, second)
    return F.when(is_kind(either, "STRING"), F.try_variant_get(either, "$", "string"))
