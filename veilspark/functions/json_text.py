"""String literals of JSON texts, at any depth, without parsing into a schema.

Escaped backslashes and quotes are first marked by two control characters, which JSON
forbids inside strings, so that a literal is all that lies between two quotes.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

LITERAL = r'"[^"]*"\s*:?'
MARKS = [("\\\\", "\x01"), ('\\"', "\x02")]


def marked(json: Column) -> Column:
    for plain, mark in MARKS:
        json = F.replace(json, F.lit(plain), F.lit(mark))
    return json


def unmarked(text: Column) -> Column:
    for plain, mark in MARKS:
        text = F.replace(text, F.lit(mark), F.lit(plain))
    return text


def literals(json: Column) -> Column:
    """The string literals of a JSON text in order, marked; keys end with their colon."""
    return F.regexp_extract_all(marked(json), F.lit(f"({LITERAL})"), F.lit(1))


def value(literal: Column) -> Column:
    """What a marked literal says."""
    return F.get_json_object(F.concat(F.lit('{"v":'), unmarked(literal), F.lit("}")), "$.v")


def string_leaves(json: Column) -> Column:
    """All string values of a JSON text at any depth, keys left out."""
    return F.transform(F.filter(literals(json), lambda x: ~x.endswith(":")), value)
