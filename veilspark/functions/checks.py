"""Checks of caller-supplied spans, keyed digests and record redaction as column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import json_text as J
from . import spans as S


def span_problem(text: Column, start: Column, end: Column, confidence: Column, said: Column) -> Column:
    """The first rule that a span with byte offsets breaks, null if none.

    In order: ``order`` (start before end), ``bounds``, ``boundary`` (both ends between UTF-8 characters), ``confidence`` (finite, from 0 to 1), ``text`` (what it
    claims to cover). Nulls break the rule that needs them; null text counts as empty.
    """
    raw = F.coalesce(text, F.lit("")).cast("binary")
    inner = lambda at: F.hex(F.substring(raw, at + 1, F.lit(1))).between("80", "BF")
    sure = confidence.isNotNull() & ~F.isnan(confidence) & confidence.between(0.0, 1.0)
    covered = F.substring(raw, start + 1, end - start)
    return (
        F.when(start.isNull() | end.isNull() | (start < 0) | (start >= end), "order").when(end > F.octet_length(raw), "bounds").when(inner(start) | inner(end), "boundary")
        .when(~sure, "confidence").when(~F.coalesce(covered == said.cast("binary"), F.lit(False)), "text")
    )


def enforced(problem: Column) -> Column:
    """True, or an error that ends the job: no span that breaks a rule goes on."""
    return F.when(problem.isNull(), F.lit(True)).otherwise(F.raise_error(F.concat(F.lit("invalid span: "), problem)).cast("boolean"))


def hmac_sha256(message: Column, key: bytes) -> Column:
    """HMAC-SHA256 in hexadecimal digits; keys longer than a block are hashed first."""
    import hashlib

    key = (hashlib.sha256(key).digest() if len(key) > 64 else key).ljust(64, b"\0")
    inner, outer = (F.lit(bytearray(b ^ pad for b in key)) for pad in (0x36, 0x5C))
    return F.sha2(F.concat(outer, F.unhex(F.sha2(F.concat(inner, message.cast("binary")), 256))), 256)


def keyed_hash(category: Column, text: Column, key: bytes) -> Column:
    """``#category:`` and 16 hexadecimal digits of the keyed digest of category and text."""
    return F.concat(F.lit("#"), category, F.lit(":"), F.left(hmac_sha256(F.concat(category, F.lit(":"), text), key), F.lit(16)))


def redacted_record(json: Column, change: Callable[[Column], Column], keep: tuple[str, ...] = ("id", "kind", "mime_type")) -> Column:
    """A JSON record with ``change`` applied to every string at any depth: title, authors, cells, notes, annotations, form fields, revisions, links, children.

    Keys stay, and so do the values of the keys in ``keep``, which are no text.
    """
    written = lambda v: F.regexp_extract(F.to_json(F.struct(v.alias("v"))), r'(?s)^\{"v":(.*)\}$', 1)
    names = [f'"{k}":' for k in keep]

    def rebuilt(found: Column, gaps: Column) -> Column:
        # a kept value follows its key directly: between them there is nothing, or white space
        held = lambda i: F.coalesce(F.get(found, i - 1).isin(*names), F.lit(False)) & (F.trim(F.get(gaps, i)) == "")
        new = F.transform(found, lambda x, i: F.when(x.endswith(":") | held(i), J.unmarked(x)).otherwise(S.let(J.value(x), lambda v: written(change(v)))))
        return F.concat(F.array_join(F.zip_with(F.slice(gaps, F.lit(1), F.size(found)), new, lambda g, x: F.concat(g, x)), ""), F.element_at(gaps, -1))

    # both lists once for a record: named in a lambda, they would be cut again for every string of it
    return S.let(F.struct(J.literals(json).alias("found"), F.split(J.marked(json), J.LITERAL, -1).alias("gaps")), lambda c: rebuilt(c["found"], c["gaps"]))
