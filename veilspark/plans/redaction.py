"""Redaction of texts, tables, pages and nested JSON, span logs, tokens and model spans, with SQL beside them."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import json_text as J
from ..functions import pseudonyms as P
from ..functions import spans as S
from ..functions.patterns import TAXONOMY
from ..operators import asof
from ..operators.tickets import minted, resolved
from .facts import FACTS, IP, MAIL, NAME, SURE, documents, facts, located_sql

GENESIS = "0" * 64


def modes(spark, d):
    """Every mode over mail and IP addresses: mask, hash, remove and a template with category and text."""
    t = documents(spark, d).withColumn("spans", S.detect(F.col("text"), SURE))
    md5 = lambda mode, template=None: F.md5(S.redact(F.col("text"), F.col("spans"), mode, template))
    return t.select("doc_id", F.size("spans").cast("long").alias("n"), md5("mask").alias("mask_md5"), md5("hash").alias("hash_md5"), md5("remove").alias("remove_md5"), md5("custom", "<{{ENTITY}}:{{TEXT}}>").alias("custom_md5"))


def scan_is_pure(spark, d):
    """A scan finds what processing redacts and leaves the text as it is: spans' texts of a scan, in order."""
    t = documents(spark, d).withColumn("spans", S.detect(F.col("text"), SURE))
    own = F.transform("spans", lambda s: F.substring(F.col("text"), s["start"] + 1, s["end"] - s["start"]))
    return t.select("doc_id", F.md5("text").alias("text_md5"), F.array_join(own, "|").alias("found"))


def span_log(spark, d):
    """A document's log: each span's hash chained after the one before, from the genesis hash; entries and tip."""
    t = documents(spark, d).withColumn("spans", S.detect(F.col("text"), SURE))

    def step(s: Column, x: Column) -> Column:
        span_hash = F.sha2(F.substring(F.col("text"), x["start"] + 1, x["end"] - x["start"]), 256)
        tip = F.sha2(F.concat(s["tip"], x["category"], span_hash), 256)
        return F.struct(tip.alias("tip"), F.array_append(s["log"], F.struct(x["category"].alias("category"), span_hash.alias("span_hash"), tip.alias("chain_hash"))).alias("log"))

    start = F.struct(F.lit(GENESIS).alias("tip"), F.array().cast("array<struct<category:string,span_hash:string,chain_hash:string>>").alias("log"))
    log = t.where(F.size("spans") > 0).select("doc_id", F.aggregate("spans", start, step).alias("s"))
    return log.select("doc_id", F.size("s.log").cast("long").alias("entries"), F.col("s.tip").alias("tip"))


def clean(text: Column) -> Column:
    return S.redact(text, S.detect(text, SURE))


def markdown(cells: Column) -> Column:
    """A table of cells (rows of strings) as Markdown: first row, rule, other rows; bars are escaped."""
    row = lambda r: F.concat(F.lit("|"), F.array_join(F.transform(r, lambda c: F.concat(F.lit(" "), F.replace(c, F.lit("|"), F.lit("\\|")), F.lit(" |"))), ""), F.lit("\n"))
    rule = F.concat(F.lit("|"), F.repeat(F.lit(" --- |"), F.size(F.get(cells, F.lit(0)))), F.lit("\n"))
    lines = F.transform(cells, lambda r, i: F.when(i == 0, F.concat(row(r), rule)).otherwise(row(r)))
    return F.when(F.size(cells) > 0, F.array_join(lines, "")).otherwise(F.lit(""))


def tables(spark, d):
    """Tables (lines of a document as rows, their sentences as cells) with every cell redacted and the Markdown rebuilt."""
    cells = F.transform(F.split("text", "\n"), lambda line: F.split(F.concat(line, F.lit("|")), "[.] "))
    t = documents(spark, d).select("doc_id", F.transform(cells, lambda r: F.transform(r, clean)).alias("cells"))
    return t.select("doc_id", F.size("cells").cast("long").alias("rows"), F.md5(markdown(F.col("cells"))).alias("markdown_md5"))


def pages(spark, d):
    """Pages of a document (four lines each) with their notes, each redacted on its own."""
    lines = F.split("text", "\n")
    made = F.transform(F.sequence(F.lit(0), F.size(lines) - 1, F.lit(4)), lambda i: F.struct((i / 4 + 1).cast("int").alias("page"), F.array_join(F.slice(lines, i + 1, F.lit(4)), "\n").alias("text"), F.array(F.concat(F.lit("see note@example.org on "), (i / 4 + 1).cast("int").cast("string"))).alias("notes")))
    t = documents(spark, d).select("doc_id", F.explode(made).alias("p"))
    return t.select("doc_id", F.col("p.page").cast("long").alias("page"), F.md5(clean(F.col("p.text"))).alias("text_md5"), F.array_join(F.transform("p.notes", clean), ";").alias("notes"))


def json_leaves(json: Column, change: Callable[[Column], Column]) -> Column:
    """A JSON text with ``change`` applied to every string value at any depth; keys, numbers and layout stay."""
    written = lambda v: F.regexp_extract(F.to_json(F.struct(v.alias("v"))), r'(?s)^\{"v":(.*)\}$', 1)

    def rebuilt(found: Column) -> Column:
        gaps = F.split(J.marked(json), J.LITERAL, -1)
        new = F.transform(found, lambda x: F.when(x.endswith(":"), J.unmarked(x)).otherwise(written(change(J.value(x)))))
        return F.concat(F.array_join(F.zip_with(F.slice(gaps, F.lit(1), F.size(found)), new, lambda g, x: F.concat(g, x)), ""), F.element_at(gaps, -1))

    return S.let(J.literals(json), rebuilt)


def nested_json(spark, d):
    """Metadata with values four levels deep (made of each document's first line), all string values redacted, keys kept."""
    first = F.regexp_replace(F.get(F.split("text", "\n"), F.lit(0)), '[^A-Za-z0-9@._ -]', "")
    meta = F.to_json(F.struct(F.struct(F.array(F.struct(F.struct(F.concat(first, F.lit(" a@b.example.org")).alias("mail@x.org"), F.lit(7).alias("n")).alias("c"))).alias("b")).alias("a"), F.lit("10.1.2.3").alias("ip"), F.lit(None).cast("string").alias("none")))
    t = documents(spark, d).select("doc_id", json_leaves(meta, clean).alias("j"))
    return t.select("doc_id", F.md5("j").alias("json_md5"), F.get_json_object("j", "$.ip").alias("ip"))


def findings(spark, d):
    """Spans to redact: capitalised words of eight letters or more; those of even first letters have tokens, the rest masks."""
    t = documents(spark, d).select("doc_id", F.explode_outer(S.located(F.col("text"), "[A-Z][a-z]{7,}")).alias("m")).where("m is not null").select("doc_id", "m.*")
    tok = F.concat(F.lit("[PERSON:k1:"), F.upper(F.translate(F.left(F.md5("text"), F.lit(8)), "0189", "GHJK")), F.lit("]"))
    return t.select("doc_id", F.col("text").alias("surface"), "start", "end", F.when(F.ascii("text") % 2 == 0, tok).otherwise("[PERSON]").alias("template"))


def exportable(spark, d):
    """Entities that may leave with a redacted document: those no finding overlaps, and those all of whose findings have tokens, under the token."""
    e = facts(spark, d).where("category = 'person'").select("doc_id", "surface", "start", "end")
    f = findings(spark, d).select(F.col("doc_id").alias("d"), F.col("start").alias("a"), F.col("end").alias("b"), "template")
    hit = (F.col("doc_id") == F.col("d")) & (F.col("start") < F.col("b")) & (F.col("a") < F.col("end"))
    sums = e.join(f, hit, "left").groupBy("doc_id", "surface").agg(F.count("template").alias("hits"), F.bool_and(F.coalesce(F.col("template").rlike(f"^{P.TOKEN}$"), F.lit(True))).alias("ok"), F.min("template").alias("token"))
    return sums.where("ok").select("doc_id", F.when(F.col("hits") > 0, F.col("token")).otherwise(F.col("surface")).alias("name"))


def annotated(spark, d):
    """Texts with findings replaced by their templates and all other entities linked."""
    f = F.transform(S.located(F.col("text"), "[A-Z][a-z]{7,}"), lambda m: F.struct(m["start"].alias("start"), m["end"].alias("end"), F.lit("[PERSON]").alias("template")))
    e = F.transform(S.located(F.col("text"), NAME), lambda m: F.struct(m["start"].alias("start"), m["end"].alias("end"), F.concat(F.lit("["), m["text"], F.lit("](../entities/"), F.lower(m["text"]), F.lit(".md)")).alias("template")))

    def spans(found: Column) -> Column:
        free = F.filter(e, lambda x: ~F.exists(found, lambda p: (x["start"] < p["end"]) & (p["start"] < x["end"])))
        return S.splice(F.col("text"), F.array_sort(F.concat(found, free)), lambda s, own: s["template"])

    return documents(spark, d).select("doc_id", F.md5(S.let(f, spans)).alias("annotated_md5"))


KEYS = {"k2": "second key", "k1": "first key"}


def tokens(spark, d):
    """Tokens of mail addresses, opened again: every one gives its normalised address, and not under another key."""
    f = facts(spark, d).where("category = 'email'").select("surface").distinct()
    t = f.select("surface", P.token(F.lit("email"), F.col("surface"), "k1", KEYS["k1"]).alias("token"))
    return t.select("surface", P.reveal(F.col("token"), KEYS).alias("revealed"), P.reveal(F.replace("token", F.lit(":k1:"), F.lit(":k2:")), KEYS).isNull().alias("refused"), F.col("token").rlike(f"^{P.TOKEN}$").alias("shaped"))


LONG_TICKET = 36_000


def timed(spark, d):
    return spark.read.parquet(f"{d}/events.parquet").select("event_id", "user_id", "event_type", F.unix_micros(F.col("ts").cast("timestamp")).alias("at"))


def tickets(spark, d):
    """Reveal tickets (errors ask for up to 900 minutes, clamped to 600) and whether the user's next view finds one open; a ticket opens once."""
    e = timed(spark, d).select(F.col("user_id").alias("key"), "at", F.col("event_id").alias("id"), "event_type")
    ttl = F.greatest(F.least(F.col("id") % 900 * 60, F.lit(LONG_TICKET)), F.lit(60))
    found = asof.nearest(e.where("event_type = 'error'"), e.where("event_type = 'view'"), LONG_TICKET, after=True)
    return found.select(F.col("id").alias("event_id"), F.when(F.col("found_at") < F.col("at") + ttl * 1_000_000, F.col("found_id")).alias("opened_by"))


def scoped_tickets(spark, d):
    """Tickets with scopes (errors) and what becomes of every attempt (other events, on the user's last ticket): documents, tokens, categories, approvers, revocations."""
    e, n = timed(spark, d), F.col("event_id")
    text = lambda *xs: F.array(*[F.lit(x) if isinstance(x, str) else x for x in xs])
    asks = e.where("event_type = 'error'").select(
        n.alias("ticket_id"), (F.col("user_id") % 3).alias("tenant"), F.col("user_id").alias("subject"), "at", (n % 50 * 900).alias("ttl"), F.when(n % 17 > 0, text((n % 3).cast("string"), (n % 4 + 1).cast("string"))).alias("document_ids"),
        F.when(n % 2 == 0, text(F.concat(F.lit("[PERSON:k1:"), (n % 3).cast("string"), F.lit("]")))).alias("token_ids"), F.when(n % 4 == 1, text("EMAIL")).when(n % 4 == 3, text("EMAIL", "ssn", "SSN")).alias("field_scope"),
        F.when(n % 19 > 0, "case").alias("justification"), F.when(n % 3 == 0, text("a", "b")).when(n % 3 == 1, text("a", "a")).alias("approvers"))
    made = minted(asks, most=LONG_TICKET)
    uses = e.where("event_type <> 'error'")
    side = lambda x: x.select(F.col("user_id").alias("key"), "at", F.col("event_id").alias("id"))
    last = asof.nearest(side(uses), side(e.where("event_type = 'error'")), 7 * 86_400, after=False)
    i = F.col("id")
    token = F.when(i % 6 == 0, "[EMAIL:k1:A]").when(i % 6 == 1, "[SSN:k1:B]").when(i % 6 == 2, "[PERSON:k1:0]").when(i % 6 == 3, "[EMAIL:k1]").otherwise(F.concat(F.lit("[PERSON:k1:"), (i % 3).cast("string"), F.lit("]")))
    tries = last.select(i.alias("attempt_id"), (F.col("key") % 3).alias("tenant"), F.col("found_id").alias("ticket_id"), F.when(i % 11 > 0, F.col("key")).alias("principal"), F.when(i % 13 > 0, (i % 5).cast("string")).alias("document_id"), token.alias("token"), "at")
    gone = made.where("ticket_id % 5 = 0").select("tenant", "ticket_id", (F.col("at") + 7200 * 1_000_000).alias("at"))
    return resolved(made, tries, gone)


def model_spans(docs: DataFrame, detector: Callable[[list[str]], list[list[tuple]]], threshold: float = 0.5, categories: tuple[str, ...] | None = None) -> DataFrame:
    """Spans of any detector over ``docs(doc_id, text)``: ``doc_id, category, start, end, confidence``.

    The detector gets lists of texts and gives for each a list of (label, start, end, confidence or None). Spans below
    the threshold go; without a confidence they stay and count as sure. Empty and null texts are not shown to it.
    """

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            batch = batch[batch["text"].fillna("") != ""]
            found = detector(batch["text"].tolist()) if len(batch) else []
            rows = [(doc, label, a, b, 1.0 if c is None else c) for doc, spans in zip(batch["doc_id"], found, strict=True) for label, a, b, c in spans if c is None or c >= threshold]
            yield pd.DataFrame([r for r in rows if categories is None or r[1] in categories], columns=["doc_id", "category", "start", "end", "confidence"])

    return docs.select("doc_id", "text").mapInPandas(each, "doc_id long, category string, start int, end int, confidence double")


def stub_detector(texts: list[str]) -> list[list[tuple]]:
    """A rule in place of a model: capitalised words, sure of long ones, without an opinion on those of nine letters."""
    import re

    return [[("person", m.start(), m.end(), None if len(m[0]) == 9 else min(1.0, len(m[0]) / 16)) for m in re.finditer(NAME, t)] for t in texts]


def model_entities(spark, d):
    """Spans of a detector with a threshold, by document."""
    m = model_spans(documents(spark, d), stub_detector)
    return m.groupBy("doc_id").agg(F.count("*").alias("n"), F.round(F.sum("confidence"), 6).alias("confidence"), F.min("start").cast("long").alias("first"))


def threshold(category: Column) -> Column:
    """The least confidence by category: names 0.65, checked or shaped values 0.48, else 0.5."""
    return F.when(category.isin("person", "full_name", "first_name", "middle_name", "last_name"), 0.65).when(category.isin("email", "phone_number", "iban", "ip_address", "credit_card"), 0.48).otherwise(0.5)


def thresholds(spark, d):
    """Facts at or above their category's threshold."""
    return facts(spark, d).where(F.col("confidence") >= threshold(F.col("category"))).groupBy("category").agg(F.count("*").alias("n"), F.min("confidence").alias("least"))


def provenance(identity: str, labels: list[str]) -> str:
    """``id@digest`` of a vertical: eight hex digits over its labels in lower case, sorted, each ended by a zero byte."""
    if not identity or not labels or any(not x.strip() for x in labels):
        raise ValueError("a vertical needs an id and labels")
    return f"{identity}@{hashlib.sha256(b''.join(x.lower().encode() + bytes(1) for x in sorted(labels, key=str.lower))).hexdigest()[:8]}"


def verticals(spark, d):
    """The provenance of the business-law labels, as entries would carry it."""
    name = provenance("business_law", TAXONOMY)
    return spark.read.parquet(f"{d}/events.parquet").groupBy("event_type").agg(F.count("*").alias("n")).withColumn("vertical", F.lit(name))


# Month names, expressions of the light detector with their confidences, and the account numbers that are no phones.
FRENCH_MONTHS = "janvier|f[ée]vrier|mars|avril|mai|juin|juillet|ao[uû]t|septembre|octobre|novembre|d[ée]cembre"
ENGLISH_MONTHS = "january|february|march|april|may|june|july|august|september|october|november|december"
LIGHT = {
    "email": (r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\b", 0.9),
    "phone": (r"(?<![A-Za-z0-9])(?:(?:\+?\d{1,3}[-.\s]?)?\(?\d{3}\)?[-.\s]?\d{3}[-.\s]?\d{4}\b|0\d(?:[-.\s]?\d{2}){4}\b)", 0.8),
    "url": (r"https?://[^\s]+", 0.9),
    "date": (rf"(?i)\b\d{{4}}-\d{{2}}-\d{{2}}\b|\b\d{{1,2}}[/.]\d{{1,2}}[/.]\d{{2,4}}\b|\b\d{{1,2}}(?:er)? (?:{FRENCH_MONTHS}|{ENGLISH_MONTHS}) \d{{4}}\b", 0.8),
}
IBAN = r"\b[A-Z]{2}\d{2}(?:[ ]?[A-Z0-9]{4}){2,7}(?:[ ]?[A-Z0-9]{1,4})?\b"


def light_spans(text: Column) -> Column:
    """Spans of the light detector: kinds in order, none overlapping one found before; what lies on an account number is no phone."""
    made = lambda kind: F.transform(S.located(text, LIGHT[kind][0]), lambda m: F.struct(m["start"].alias("start"), m["end"].alias("end"), F.lit(kind).alias("kind"), F.lit(LIGHT[kind][1]).alias("confidence")))
    accounts = S.located(text, IBAN)
    phones = S.let(accounts, lambda a: F.filter(made("phone"), lambda x: ~F.exists(a, lambda p: (x["start"] < p["end"]) & (p["start"] < x["end"]))))
    kept = apart_from(made("email"), phones)
    for kind in ("url", "date"):
        kept = apart_from(kept, made(kind))
    return kept


def apart_from(kept: Column, more: Column) -> Column:
    """``kept`` and those of ``more`` that overlap none of it."""
    return S.let(kept, lambda k: F.concat(k, F.filter(more, lambda x: ~F.exists(k, lambda p: (x["start"] < p["end"]) & (p["start"] < x["end"])))))


def light(spark, d):
    """The light detector over pages (their urls beside a date, a phone and an account number) and document texts."""
    seen = F.date_format(F.expr("DATE '2024-01-01' + CAST(page_id % 365 AS INT)"), "yyyy-MM-dd")
    tail = F.concat(F.lit("call 01 23 45 67 "), F.lpad((F.col("page_id") % 100).cast("string"), 2, "0"), F.lit(" on 3er février 2025, account DE89 3704 0044 0532 0130 00"))
    texts = spark.read.parquet(f"{d}/pages.parquet").select(F.concat_ws(" ", F.concat("url", F.lit(" seen")), seen, tail).alias("text")).unionByName(documents(spark, d).select("text"))
    return texts.select(F.explode_outer(light_spans(F.col("text"))).alias("s")).where("s is not null").groupBy("s.kind").agg(F.count("*").alias("n"), F.sum(F.col("s.end") - F.col("s.start")).alias("chars"))


QUERIES = {
    "r1_r2_r5_modes": modes, "d7_scan": scan_is_pure, "r8_span_log": span_log, "d12_tables": tables, "d12_pages_notes": pages, "d12_json_leaves": nested_json, "r11_annotated": annotated,
    "r12_exportable": exportable, "r3_r7_tokens": tokens, "r14_tickets": tickets, "r14_scoped_tickets": scoped_tickets, "d3_model_entities": model_entities, "d9_thresholds": thresholds, "d8_provenance": verticals, "d10_light_detector": light,
}

SURES = f"({MAIL}|{IP})"
SPLIT = f"t AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '{SURES}') AS f, regexp_split_to_array(coalesce(text, ''), '{SURES}') AS g FROM documents)"
rebuilt = lambda piece: f"array_to_string(list_transform(range(1, len(g) + 1), lambda i: g[i] || CASE WHEN i <= len(f) THEN {piece} ELSE '' END), '')"
KIND = "CASE WHEN contains(f[i], '@') THEN '{}' ELSE '{}' END".format
masked = lambda x: f"regexp_replace(regexp_replace({x}, '{MAIL}', '[EMAIL]', 'g'), '{IP}', '[IP]', 'g')"
FINDINGS = f"{FACTS}, {located_sql('fi', '[A-Z][a-z]{7,}')}, findings AS (SELECT doc_id, surface, s, e, CASE WHEN ascii(surface) % 2 = 0 THEN '[PERSON:k1:' || upper(translate(left(md5(surface), 8), '0189', 'GHJK')) || ']' ELSE '[PERSON]' END AS template FROM fi)"
SQL = {
    "r1_r2_r5_modes": f"""WITH {SPLIT} SELECT doc_id, len(f) AS n, md5({rebuilt(KIND('[EMAIL]', '[IP]'))}) AS mask_md5, md5({rebuilt("left(sha256(f[i]), 8)")}) AS hash_md5, md5({rebuilt("''")}) AS remove_md5,
        md5({rebuilt("'<' || " + KIND('email', 'ip_address') + " || ':' || f[i] || '>'")}) AS custom_md5 FROM t""",
    "d7_scan": f"WITH {SPLIT} SELECT doc_id, md5(text) AS text_md5, array_to_string(f, '|') AS found FROM t",
    "r8_span_log": f"""WITH {SPLIT} SELECT doc_id, len(f) AS entries, list_reduce(list_prepend('{GENESIS}', list_transform(f, lambda x: CASE WHEN contains(x, '@') THEN 'email' ELSE 'ip_address' END || sha256(x))), lambda p, x: sha256(p || x)) AS tip FROM t WHERE len(f) > 0""",
    "d12_tables": f"""WITH c AS (SELECT doc_id, list_transform(string_split(coalesce(text, ''), chr(10)), lambda l: list_transform(string_split(l || '|', '. '), lambda x: ' ' || replace({masked('x')}, '|', '\\|') || ' |')) AS c FROM documents)
        SELECT doc_id, len(c) AS rows, md5(array_to_string(list_transform(c, lambda r, i: '|' || array_to_string(r, '') || chr(10) || CASE WHEN i = 1 THEN '|' || repeat(' --- |', len(r)) || chr(10) ELSE '' END), '')) AS markdown_md5 FROM c""",
    "d12_pages_notes": f"""WITH l AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS x FROM documents), p AS (SELECT doc_id, x, unnest(range(0, len(x), 4)) AS i FROM l)
        SELECT doc_id, i // 4 + 1 AS page, md5({masked("array_to_string(x[i + 1 : i + 4], chr(10))")}) AS text_md5, 'see [EMAIL] on ' || (i // 4 + 1) AS notes FROM p""",
    "d12_json_leaves": f"""WITH f AS (SELECT doc_id, regexp_replace(string_split(coalesce(text, ''), chr(10))[1], '[^A-Za-z0-9@._ -]', '', 'g') AS f FROM documents)
        SELECT doc_id, md5('{{"a":{{"b":[{{"c":{{"mail@x.org":"' || {masked("(f || ' a@b.example.org')")} || '","n":7}}}}]}},"ip":"[IP]"}}') AS json_md5, '[IP]' AS ip FROM f""",
    "r11_annotated": f"""WITH t AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{NAME}') AS f, regexp_split_to_array(coalesce(text, ''), '{NAME}') AS g FROM documents)
        SELECT doc_id, md5({rebuilt("CASE WHEN length(f[i]) >= 8 THEN '[PERSON]' ELSE '[' || f[i] || '](../entities/' || lower(f[i]) || '.md)' END")}) AS annotated_md5 FROM t""",
    "r12_exportable": f"""WITH {FINDINGS}, x AS (SELECT p.doc_id, p.surface, count(template) AS hits, bool_and(template IS NULL OR template LIKE '%:k1:%') AS ok, min(template) AS token
        FROM (SELECT * FROM facts WHERE category = 'person') p LEFT JOIN findings i ON p.doc_id = i.doc_id AND p.s < i.e AND i.s < p.e GROUP BY 1, 2) SELECT doc_id, CASE WHEN hits > 0 THEN token ELSE surface END AS name FROM x WHERE ok""",
    "r3_r7_tokens": f"WITH {FACTS} SELECT DISTINCT surface, lower(surface) AS revealed, true AS refused, true AS shaped FROM facts WHERE category = 'email'",
    "r14_tickets": """WITH e AS (SELECT event_id, user_id, event_type, ts, greatest(least(event_id % 900 * 60, 36000), 60) AS ttl FROM events)
        SELECT t.event_id, arg_min(u.event_id, (u.ts, u.event_id)) AS opened_by FROM e t LEFT JOIN e u ON t.user_id = u.user_id AND u.event_type = 'view' AND u.ts > t.ts AND u.ts < t.ts + to_seconds(t.ttl) WHERE t.event_type = 'error' GROUP BY 1""",
    "r14_scoped_tickets": """WITH e AS (SELECT event_id AS n, user_id, event_type, epoch_us(ts) AS tm FROM events),
        t AS (SELECT n AS ticket, user_id, tm, tm + greatest(least(n % 50 * 900, 36000), 1) * 1000000 AS stop, CASE WHEN n % 17 > 0 THEN [CAST(n % 3 AS VARCHAR), CAST(n % 4 + 1 AS VARCHAR)] ELSE [] END AS docs,
              CASE WHEN n % 2 = 0 THEN ['[PERSON:k1:' || n % 3 || ']'] ELSE [] END AS tokens, CASE n % 4 WHEN 1 THEN ['EMAIL'] WHEN 3 THEN ['EMAIL', 'ssn', 'SSN'] ELSE [] END AS fields, CASE WHEN n % 5 = 0 THEN tm + 7200000000 END AS gone,
              n % 17 > 0 AND n % 19 > 0 AND (n % 4 <> 3 OR n % 3 = 0) AS made FROM e WHERE event_type = 'error'),
        l AS (SELECT u.n, u.user_id, u.tm, max_by(t.ticket, (t.tm, t.ticket)) AS ticket FROM e u LEFT JOIN t ON t.user_id = u.user_id AND t.tm <= u.tm AND u.tm - t.tm < 604800000000 WHERE u.event_type <> 'error' GROUP BY ALL),
        a AS (SELECT l.n, l.ticket, l.tm, stop, made, gone, n % 11 > 0 AS holder, CASE n % 6 WHEN 0 THEN 'EMAIL' WHEN 1 THEN 'SSN' WHEN 3 THEN '' ELSE 'PERSON' END AS kind,
              CASE n % 6 WHEN 0 THEN '[EMAIL:k1:A]' WHEN 1 THEN '[SSN:k1:B]' WHEN 2 THEN '[PERSON:k1:0]' WHEN 3 THEN '[EMAIL:k1]' ELSE '[PERSON:k1:' || n % 3 || ']' END AS token, CASE WHEN n % 13 > 0 THEN CAST(n % 5 AS VARCHAR) ELSE '' END AS doc, docs, tokens, fields FROM l LEFT JOIN t USING (ticket)),
        b AS (SELECT *, list_contains(docs, doc) AND (list_contains(tokens, token) OR list_contains(fields, kind)) AS covered, coalesce(tm >= gone, false) AS revoked, tm >= stop AS expired FROM a),
        f AS (SELECT ticket, min((tm, n)) AS used FROM b WHERE made AND holder AND covered AND NOT revoked AND NOT expired GROUP BY 1)
        SELECT n AS attempt_id, b.ticket AS ticket_id, CASE WHEN NOT coalesce(made, false) THEN 'not_found' WHEN NOT holder THEN 'not_holder' WHEN (tm, n) > used THEN 'consumed' WHEN revoked THEN 'revoked' WHEN expired THEN 'expired' WHEN NOT covered THEN 'scope_violation' ELSE 'revealed' END AS outcome
        FROM b LEFT JOIN f USING (ticket)""",
    "d3_model_entities": f"""WITH {FACTS}, m AS (SELECT doc_id, s, CASE WHEN length(surface) = 9 THEN 1.0 ELSE least(1.0, length(surface) / 16) END::DOUBLE AS c FROM facts WHERE category = 'person')
        SELECT doc_id, count(*) AS n, round(sum(c), 6) AS confidence, min(s) AS first FROM m WHERE c >= 0.5 GROUP BY 1""",
    "d9_thresholds": f"WITH {FACTS} SELECT category, count(*) AS n, min(confidence) AS least FROM facts WHERE confidence >= CASE WHEN category = 'person' THEN 0.65 ELSE 0.48 END GROUP BY 1",
    "d8_provenance": "SELECT event_type, count(*) AS n, 'business_law@' || (SELECT left(sha256(unhex(string_agg(hex(x) || '00', '' ORDER BY x))), 8) FROM (VALUES " + ", ".join(f"('{x}')" for x in TAXONOMY) + ") AS v(x)) AS vertical FROM events GROUP BY 1",
}
