"""Spans in text: matches with offsets, greedy selection, merging and splicing.

Offsets are code points from 0, end exclusive. A span is ``SPAN``.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .patterns import PATTERNS, Pattern
from .validators import VERDICTS

SPAN = "struct<start:int,end:int,order:int,category:string,confidence:double,template:string,source:string>"
PLACE = "struct<text:string,start:int,end:int>"


def none(kind: str = SPAN) -> Column:
    return F.array().cast(f"array<{kind}>")


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once, however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


#: Items of one inner pass of a scan: what is appended to is never longer than this or the number of such passes.
SCAN = 128


def scan(items: Column, at: Column, after, row, kind: str) -> Column:
    """``row(at, item)`` of each item, in order, with ``at`` carried on by ``after(at, item)``.

    Appending copies an array, so one pass over n items would copy n * n / 2; passes over ``SCAN`` items each, put together at the
    end, copy n * SCAN / 2.
    """

    def step(s: Column, p: Column) -> Column:
        return F.struct(after(s["at"], p).alias("at"), F.array_append(s["out"], row(s["at"], p)).alias("out"))

    def passed(s: Column, part: Column) -> Column:
        put = lambda r: F.struct(r["at"].alias("at"), F.array_append(s["out"], r["out"]).alias("out"))
        return F.aggregate(part, F.struct(s["at"].alias("at"), none(kind).alias("out")), step, put)

    def whole(x: Column) -> Column:
        parts = F.transform(F.sequence(F.lit(0), F.greatest(F.size(x) - 1, F.lit(0)), F.lit(SCAN)), lambda i: F.slice(x, i + 1, F.lit(SCAN)))
        return F.flatten(F.aggregate(parts, F.struct(at.alias("at"), none(f"array<{kind}>").alias("out")), passed)["out"])

    return let(items, whole)


def located(text: Column, pattern: str) -> Column:
    """Leftmost non-overlapping matches as ``struct(text, start, end)``, from the lengths of matches and gaps."""

    def placed(found: Column) -> Column:
        gaps = F.slice(F.split(text, pattern, -1), F.lit(1), F.size(found))
        pairs = F.zip_with(found, gaps, lambda m, g: F.struct(m.alias("m"), F.char_length(g).alias("g"), F.char_length(m).alias("n")))
        place = lambda at, p: F.struct(p["m"].alias("text"), (at + p["g"]).alias("start"), (at + p["g"] + p["n"]).alias("end"))
        return scan(pairs, F.lit(0), lambda at, p: at + p["g"] + p["n"], place, PLACE)

    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    return F.when(text.rlike(pattern), let(found, placed)).otherwise(none(PLACE))


#: Characters before a match that are kept with it; they nearly always hold the tokens that count.
NEAR = 256


def last_tokens(text: Column, start: Column, before: Column, reach: int) -> Column:
    """The last ``reach`` tokens before a position, in lower case, from the ``NEAR`` characters before it.

    Only where those hold too few tokens is the whole prefix of the text cut.
    """
    cut = lambda x: F.regexp_extract_all(x, F.lit(r"([\p{L}\p{N}]+)"), F.lit(1))
    last = lambda t: F.transform(F.slice(t, F.greatest(F.size(t) - (reach - 1), F.lit(1)), F.lit(reach)), F.lower)
    return let(cut(before), lambda t: F.when((F.size(t) > reach) | (start <= NEAR), last(t)).otherwise(let(cut(F.left(text, start)), last)))


def boosted(text: Column, start: Column, before: Column, base: Column, words: Column, gain: float = 0.35, floor: float = 0.4, reach: int = 5) -> Column:
    """Confidence raised when one of ``words`` is among the ``reach`` tokens before a span; sure spans stay as they are."""
    hit = (base < 1) & (F.size(words) > 0) & F.arrays_overlap(last_tokens(text, start, before, reach), words)
    return F.when(hit, F.greatest(F.least(base + gain, F.lit(1.0)), F.lit(floor))).otherwise(base)


def matches(text: Column, patterns: list[Pattern], gates: Column, names: dict[str, str]) -> Column:
    """All matches of all patterns as ``struct(n, text, start, end, before)``, by pattern.

    ``before`` holds the ``NEAR`` characters before a match of a pattern that is not sure by itself.

    A pattern is tried only where the text passes its gate, and its matches are gathered only where there is one.
    """
    unsure = [n for n, p in enumerate(patterns) if p.base < 1 and p.words]
    wants = lambda p: gates[names[p.gate]] & text.rlike(p.regex) if p.gate else text.rlike(p.regex)
    found = F.array(*[F.when(wants(p), F.struct(F.lit(n).alias("n"), F.regexp_extract_all(text, F.lit(p.regex), F.lit(0)).alias("f"), F.split(text, p.regex, -1).alias("g"))) for n, p in enumerate(patterns)])

    def placed(r: Column) -> Column:
        pairs = F.zip_with(r["f"], F.slice(r["g"], F.lit(1), F.size(r["f"])), lambda m, g: F.struct(m.alias("m"), F.char_length(g).alias("g"), g.alias("gap")))
        keeps = r["n"].isin(unsure) if unsure else F.lit(False)
        before = lambda s, p: F.when(keeps, F.right(F.concat(s["seen"], p["gap"]), F.lit(NEAR))).otherwise(F.lit(""))

        def after(s: Column, p: Column) -> Column:
            seen = F.when(keeps, F.right(F.concat(before(s, p), p["m"]), F.lit(NEAR))).otherwise(F.lit(""))
            return F.struct((s["at"] + p["g"] + F.char_length(p["m"])).alias("at"), seen.alias("seen"))

        def match(s: Column, p: Column) -> Column:
            begin = s["at"] + p["g"]
            return F.struct(r["n"].alias("n"), p["m"].alias("text"), begin.alias("start"), (begin + F.char_length(p["m"])).alias("end"), before(s, p).alias("before"))

        return scan(pairs, F.struct(F.lit(0).alias("at"), F.lit("").alias("seen")), after, match, "struct<n:int,text:string,start:int,end:int,before:string>")

    return F.flatten(F.transform(F.filter(found, lambda r: r.isNotNull()), placed))


def greedy(spans: Column) -> Column:
    """By (start, end, order), each span that begins at or after the end of the last one kept."""
    apart = lambda end, s: end.isNull() | (s["start"] >= end)
    kept = scan(F.array_sort(spans), F.lit(None).cast("int"), lambda end, s: F.when(apart(end, s), s["end"]).otherwise(end), lambda end, s: F.when(apart(end, s), s), SPAN)
    return F.filter(kept, lambda s: s.isNotNull())


def detect(text: Column, patterns: list[Pattern] = PATTERNS) -> Column:
    """All patterns over a text: array of spans, none overlapping. Null text has none.

    A validator's verdict drops a match or makes it sure; without one its base confidence may be raised by its context.
    """
    t = F.coalesce(text, F.lit(""))
    names = {g: f"g{n}" for n, g in enumerate(sorted({p.gate for p in patterns if p.gate}))}
    known = F.array(*[F.struct(F.lit(p.category).alias("category"), F.lit(p.template).alias("template"), F.lit(float(p.base)).alias("base"), F.array(*[F.lit(w) for w in p.words]).cast("array<string>").alias("words")) for p in patterns])

    def verdict(m: Column) -> Column:
        said = F.lit(None).cast("boolean")
        for n, p in enumerate(patterns):
            if p.validator in VERDICTS:
                said = F.when(m["n"] == n, VERDICTS[p.validator](m["text"])).otherwise(said)
        return said

    def span(j: Column) -> Column:
        of, base = j["of"], F.when(j["ok"], F.lit(1.0)).otherwise(j["of"]["base"])
        return F.struct(
            j["m"]["start"].alias("start"), j["m"]["end"].alias("end"), j["m"]["n"].alias("order"), of["category"].alias("category"),
            boosted(t, j["m"]["start"], j["m"]["before"], base, of["words"]).cast("double").alias("confidence"), of["template"].alias("template"), F.lit("regex").alias("source"),
        )

    def all_spans(gates: Column) -> Column:
        judged = F.transform(matches(t, patterns, gates, names), lambda m: F.struct(m.alias("m"), F.get(known, m["n"]).alias("of"), verdict(m).alias("ok")))
        return greedy(F.transform(F.filter(judged, lambda j: F.coalesce(j["ok"], F.lit(True))), span))

    return let(F.struct(F.lit(True).alias("always"), *[t.rlike(g).alias(n) for g, n in names.items()]), all_spans)


def overlap_ratio(a: Column, b: Column) -> Column:
    """Characters shared over the longer span's length."""
    shared = F.greatest(F.least(a["end"], b["end"]) - F.greatest(a["start"], b["start"]), F.lit(0))
    return shared / F.greatest(a["end"] - a["start"], b["end"] - b["start"])


def merge(found: Column, model: Column, priority: str = "regex_first", threshold: float = 0.5, margin: float = 0.05) -> Column:
    """One sequence of spans from patterns and a model.

    Sorted by (start, end), each span meets the last one kept. Over ``threshold`` overlap
    the priority decides which stays: regex_first (of one source the more confident by more than ``margin``, or the longer),
    higher_confidence (by more than ``margin``) or longer_span; at less overlap the later one goes.
    """

    def wins(last: Column, s: Column) -> Column:
        if priority == "higher_confidence":
            return s["confidence"] - last["confidence"] > margin
        if priority == "longer_span":
            return (s["end"] - s["start"]) > (last["end"] - last["start"])
        stronger = (s["confidence"] - last["confidence"] > margin) | ((s["end"] - s["start"]) > (last["end"] - last["start"]))
        return F.when(s["source"] == last["source"], stronger).otherwise(s["source"] == "regex")

    def step(kept: Column, s: Column) -> Column:
        last = F.try_element_at(kept, F.lit(-1))
        apart = last.isNull() | (s["start"] >= last["end"])
        swap = (overlap_ratio(last, s) > threshold) & wins(last, s)
        return F.when(apart, F.array_append(kept, s)).when(swap, F.array_append(F.slice(kept, F.lit(1), F.size(kept) - 1), s)).otherwise(kept)

    return F.aggregate(F.array_sort(F.concat(found, model)), none(), step)


#: Characters of a block of text: cutting from a block is cheap, from a long text it means reading up to the place.
BLOCK = 4096


def cutter(text: Column, body) -> Column:
    """``body(cut)`` where ``cut(start, end)`` gives that part of the text, reading no more than two blocks besides."""
    starts = F.sequence(F.lit(0), F.greatest(F.char_length(text) - 1, F.lit(0)), F.lit(BLOCK))

    def part(blocks: Column, start: Column, end: Column) -> Column:
        first = F.floor(start / BLOCK).cast("int")
        many = F.floor(F.greatest(end - 1, start) / BLOCK).cast("int") - first + 1
        return F.substring(F.array_join(F.slice(blocks, first + 1, many), ""), start - first * BLOCK + 1, end - start)

    return let(F.transform(starts, lambda i: F.substring(text, i + 1, F.lit(BLOCK))), lambda blocks: body(lambda a, b: part(blocks, a, b)))


def splice(text: Column, spans: Column, replacement) -> Column:
    """The text with each span replaced by ``replacement(span, own)``, ``own`` being its text; spans ascend and do not overlap."""
    valid = let(F.char_length(text), lambda n: F.filter(spans, lambda s: (s["start"] < s["end"]) & (s["end"] <= n)))

    def spliced(cut) -> Column:
        piece = lambda at, x: F.concat(cut(at, x["start"]), replacement(x, cut(x["start"], x["end"])))
        rest = lambda v: F.substr(text, F.coalesce(F.try_element_at(v, F.lit(-1))["end"], F.lit(0)) + 1)
        return let(valid, lambda v: F.concat(F.array_join(scan(v, F.lit(0), lambda at, x: x["end"], piece, "string"), ""), rest(v)))

    return F.when(F.size(spans) > 0, cutter(text, spliced)).otherwise(text)


def redact(text: Column, spans: Column, mode: str = "mask", template: str | None = None) -> Column:
    """Mask, hash (first 8 hex digits of SHA-256), remove or a custom ``{{ENTITY}}``/``{{TEXT}}`` template."""
    modes = {
        "mask": lambda s, own: s["template"],
        "hash": lambda s, own: F.left(F.sha2(own, 256), F.lit(8)),
        "remove": lambda s, own: F.lit(""),
        "custom": lambda s, own: F.replace(F.replace(F.lit(template), F.lit("{{ENTITY}}"), s["category"]), F.lit("{{TEXT}}"), own) if template else F.concat(F.lit("["), F.upper(s["category"]), F.lit("]")),
    }
    return splice(text, spans, modes[mode])
