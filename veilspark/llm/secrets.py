"""Secret scan: patterns, then sliding-window Shannon entropy by character class.

All of it is SQL expressions. Pattern matches come with their positions from the
lengths of matches and of the gaps between them. For entropy, runs of a class's
characters are candidates; a window slides over each, its character counts change by
one in and one out, and the entropy follows from the change of sum(c log2 c) alone.
Overlapping windows at or above the class's threshold become one span, unless the allow-list
knows the candidate; a span that a pattern's match holds already adds nothing.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The base patterns and the least lengths of their matches.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"  # AKIA[A-Z0-9]+ of 20 or more characters
HEX = r"[0-9a-f]{24,}"  # [0-9a-f]+ of 24 or more characters
LEAST_VALUE = 6

WINDOW = 20

# Classes with their characters, candidates and entropy thresholds in bits.
CLASSES = [
    ("entropy_hex", "0123456789abcdefABCDEF", r"(?<![A-Za-z0-9])[0-9a-fA-F]{20,}(?![A-Za-z0-9])", 3.0),
    ("entropy_base64", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-", r"[A-Za-z0-9+/_=-]{20,}", 3.8),
]

# Candidates that are no secrets, as patterns over the whole candidate.
ALLOWED = [
    r"[0-9]+",  # numbers
    r"[/_=+-]*[A-Z]?[a-z]*([/_=+-]+[A-Z]?[a-z]*)*",  # words and paths of words
    r"[A-Z/_=+-]+",  # words in capitals
    r"(?i).*(example|sample|dummy|placeholder|changeme|xxxx|0123456789|abcdefgh).*",
    r"(?i)[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}",  # UUIDs
    r"[0-9/_=+-]+",  # dates and rules
]


def located(found: Column, gaps: Column) -> Column:
    """``struct(text, start, end)`` of each match; ``gaps`` are the texts around the matches."""
    pairs = F.zip_with(found, F.slice(gaps, F.lit(1), F.size(found)), lambda m, g: F.struct(m.alias("m"), F.char_length(g).alias("g"), F.char_length(m).alias("n")))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<text:string,start:int,end:int>>").alias("out"))

    def step(s: Column, p: Column) -> Column:
        begin = s["at"] + p["g"]
        return F.struct((begin + p["n"]).alias("at"), F.array_append(s["out"], F.struct(p["m"].alias("text"), begin.alias("start"), (begin + p["n"]).alias("end"))).alias("out"))

    return F.aggregate(pairs, start, step)["out"]


def hot_windows(candidate: Column, alphabet: str, threshold: float, window: int = WINDOW) -> Column:
    """``struct(a, b)`` of each run of overlapping windows whose entropy reaches the threshold: start (from 0) and end.

    The state holds the window's counts as one character per symbol of the alphabet and
    the sum of c log2 c; a step writes two of the characters and adds two differences.
    """
    table = F.array(*[F.lit(x * math.log2(x) if x else 0.0) for x in range(window + 2)])
    f = lambda n: F.element_at(table, n + 1)
    code = lambda i: F.instr(F.lit(alphabet), F.substring(candidate, i, F.lit(1)))
    count = lambda counts, at: F.ascii(F.substring(counts, at, F.lit(1))) - 65
    put = lambda counts, at, n: F.overlay(counts, F.char(n + 65), at, F.lit(1))
    start = F.struct(F.lit("A" * len(alphabet)).alias("c"), F.lit(0.0).alias("s"), F.array().cast("array<struct<a:int,b:int>>").alias("out"))

    def enter(s: Column, i: Column) -> Column:
        into, out = code(i), F.when(i > window, code(i - window)).otherwise(F.lit(0))
        same = into == out
        n_in, n_out = count(s["c"], into), count(s["c"], out)
        total = F.when(same, s["s"]).otherwise(s["s"] + f(n_in + 1) - f(n_in) - F.when(out > 0, f(n_out) - f(n_out - 1)).otherwise(0.0))
        fewer = F.when(out > 0, put(s["c"], out, n_out - 1)).otherwise(s["c"])
        counts = F.when(same, s["c"]).otherwise(put(fewer, into, n_in + 1))
        hot = (i >= window) & (math.log2(window) - total / window >= threshold - 1e-9)
        begin, last = i - window, F.try_element_at(s["out"], F.lit(-1))
        joins = F.coalesce(last["b"] >= begin, F.lit(False))
        grown = F.concat(F.slice(s["out"], F.lit(1), F.greatest(F.size(s["out"]) - 1, F.lit(0))), F.array(F.struct(last["a"].alias("a"), i.alias("b"))))
        more = F.when(joins, grown).otherwise(F.array_append(s["out"], F.struct(begin.alias("a"), i.alias("b"))))
        return F.struct(counts.alias("c"), total.alias("s"), F.when(hot, more).otherwise(s["out"]).alias("out"))

    return F.aggregate(F.sequence(F.lit(1), F.char_length(candidate)), start, enter, lambda s: s["out"])


def span(kind: str, order: int, start: Column, end: Column) -> Column:
    return F.struct(start.cast("int").alias("start"), F.lit(order).alias("order"), end.cast("int").alias("end"), F.lit(kind).alias("kind"))


def joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def scan(docs: DataFrame, text_col: str = "text", allowed: list[str] = ALLOWED) -> DataFrame:
    """``docs`` with ``base``, ``hot`` and ``added``: arrays of ``struct(start, order, end, kind)``.

    Offsets are code points, end exclusive. ``base`` holds the pattern matches, ``hot`` all
    entropy spans and ``added`` those of them that no pattern match holds; all by start, ties in the order of
    kinds. Null and empty texts have none; whole texts of any length are scanned in one pass; rows, repeated ones
    included, are kept as they are; an empty table stays empty. ``docs`` may have any columns but those returned here.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    names = {"assign": ASSIGN, "access": ACCESS, "hex": HEX} | {k: p for k, _, p, _ in CLASSES}
    found = docs.select("*", *[F.regexp_extract_all(text, F.lit(p), F.lit(0)).alias(f"_m_{k}") for k, p in names.items()])
    none = F.array().cast("array<struct<text:string,start:int,end:int>>")
    placed = found.select(
        *docs.columns,
        *[F.when(F.size(f"_m_{k}") > 0, located(F.col(f"_m_{k}"), F.split(text, p, -1))).otherwise(none).alias(f"_p_{k}") for k, p in names.items()],
    )
    long_enough = F.filter("_p_assign", lambda m: F.char_length(F.regexp_extract(m["text"], ASSIGN, 2)) >= LEAST_VALUE)
    kinds = [("assign", long_enough), ("access", F.col("_p_access")), ("hex", F.col("_p_hex"))]
    base = F.array_sort(F.concat(*[spans_of(c, k, n) for n, (k, c) in enumerate(kinds)]))
    based = placed.select(*docs.columns, *[f"_p_{k}" for k, *_ in CLASSES], base.alias("base"))
    added = [entropy_spans(F.col(f"_p_{k}"), k, 3 + n, alphabet, least, allowed) for n, (k, alphabet, _, least) in enumerate(CLASSES)]
    hot = based.select(*docs.columns, "base", F.array_sort(F.concat(*added)).alias("hot"))
    fresh = F.filter("hot", lambda s: ~F.exists("base", lambda b: (b["start"] <= s["start"]) & (s["end"] <= b["end"])))
    return hot.select(*docs.columns, "base", "hot", fresh.alias("added"))


def spans_of(found: Column, kind: str, order: int) -> Column:
    return F.transform(found, lambda m: span(kind, order, m["start"], m["end"]))


def entropy_spans(found: Column, kind: str, order: int, alphabet: str, threshold: float, allowed: list[str]) -> Column:
    """Spans of the candidates that are not allowed and have a window of high entropy."""
    kept = found
    for pattern in allowed:
        kept = F.filter(kept, lambda m: ~m["text"].rlike(f"^(?:{pattern})$"))  # noqa: B023
    hot = F.transform(kept, lambda m: F.transform(hot_windows(m["text"], alphabet, threshold), lambda w: span(kind, order, m["start"] + w["a"], m["start"] + w["b"])))
    return F.flatten(hot)


def op7(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = scan(docs)
    n = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    return found.select("doc_id", n("assign"), n("access"), n("hex"), F.sha2(joined(F.col("base")), 256).alias("base_sha256"), joined(F.array_sort(F.concat("base", "added"))).alias("spans"), joined(F.col("hot")).alias("entropy_spans"))
