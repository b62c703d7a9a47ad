"""Merge priorities, span checks, keyed digests, whole records, votes, offsets and records of spans, with SQL beside them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import checks as C
from ..functions import spans as S
from ..functions.patterns import ALIASES
from .facts import FACTS, IP, MAIL, SURE, documents, facts, located_sql

NAME, PHRASE, LONG = "[A-Z][a-z]{5,}", "[A-Z][a-z]+ [a-z]+", "[a-z]+[ ,]+[A-Z][a-z]{3,}"
PRIORITIES = ("regex_first", "higher_confidence", "longer_span")
KEY = b"a key of the corpus"


def made_spans(text: Column, pattern: str, order: int, category: str, source: str, level: int) -> Column:
    confidence = lambda m: (F.char_length(m["text"]) * level % 97 + 3) / 100
    return F.transform(S.located(text, pattern), lambda m: F.struct(m["start"].cast("int").alias("start"), m["end"].cast("int").alias("end"), F.lit(order).alias("order"), F.lit(category).alias("category"), confidence(m).alias("confidence"), F.lit("[X]").alias("template"), F.lit(source).alias("source")))


def d5_priorities(spark, d):
    """Spans of a pattern and of two models that overlap in many ways, merged under each priority."""
    t = F.col("text")
    regex = F.concat(made_spans(t, NAME, 1, "person", "regex", 13), made_spans(t, MAIL, 2, "email", "regex", 7))
    model = F.concat(made_spans(t, PHRASE, 99, "organisation", "model", 11), made_spans(t, LONG, 99, "title", "model", 17))
    both = documents(spark, d).select("doc_id", regex.alias("r"), model.alias("m"))
    said = lambda spans: F.md5(F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["start"], s["end"], s["category"])), ","))
    merged = [S.merge(F.col("r"), F.col("m"), p) for p in PRIORITIES]
    return both.select("doc_id", *[F.size(x).cast("long").alias(f"{p}_n") for p, x in zip(PRIORITIES, merged, strict=True)], *[said(x).alias(f"{p}_md5") for p, x in zip(PRIORITIES, merged, strict=True)])


def d6_checks(spark, d):
    """The rule that each caller-supplied span breaks; spans of turns with one kind of defect each."""
    text, k = F.coalesce("text", F.lit("")), (F.col("conv_id") * 7 + F.col("turn")) % 8
    n = F.octet_length(text)
    start = F.when(k == 7, F.lit(-1)).otherwise(F.col("turn") * 5)
    end = F.when(k == 1, F.col("turn") * 5).when(k == 2, n + 1).otherwise(F.col("turn") * 5 + 6)
    confidence = F.when(k == 3, F.lit(float("nan"))).when(k == 4, F.lit(1.5)).when(k == 6, F.lit(None).cast("double")).otherwise(F.lit(0.5))
    c = spark.read.parquet(f"{d}/conversations.parquet").select("conv_id", "turn", text.alias("text"), start.cast("int").alias("s"), end.cast("int").alias("e"), confidence.alias("confidence"), k.alias("k"))
    covered = F.substring(F.col("text").cast("binary"), F.col("s") + 1, F.col("e") - F.col("s"))
    said = F.when(F.col("k") == 5, F.lit("other")).otherwise(covered.cast("string"))
    return c.select("conv_id", "turn", C.span_problem(F.col("text"), F.col("s"), F.col("e"), F.col("confidence"), said).alias("problem"))


def d4_labels(spark, d):
    """Model labels (one per event, in changing case) as categories; what no alias names is custom."""
    names = F.array(*[F.lit(x) for x in [*ALIASES, "weather", "Ship Name"]])
    label = F.get(names, (F.col("event_id") % (len(ALIASES) + 2)).cast("int"))
    e = spark.read.parquet(f"{d}/events.parquet").select(F.when(F.col("event_id") % 3 == 0, F.upper(label)).otherwise(label).alias("label"))
    known = F.create_map(*[F.lit(x) for pair in ALIASES.items() for x in pair])
    kind = F.coalesce(F.element_at(known, F.lower("label")), F.concat(F.lit("custom:"), F.col("label")))
    return e.select(kind.alias("category")).groupBy("category").agg(F.count("*").alias("n"))


def r10_keyed(spark, d):
    """Keyed digests of mail addresses and names: equal values alike, nothing to be enumerated without the key."""
    f = facts(spark, d).select("category", "surface")
    return f.groupBy("category", "surface").agg(F.count("*").alias("n")).select("category", "n", C.keyed_hash(F.col("category"), F.col("surface"), KEY).alias("token"))


def plain_line(n: int) -> Column:
    return F.regexp_replace(F.coalesce(F.get(F.split("text", "\n"), F.lit(n)), F.lit("")), "[^A-Za-z0-9@._ -]", "")


def d12_records(spark, d):
    """One nested record per document with every kind of field that holds text, all redacted and its shape kept."""
    a, b = F.col("a"), F.col("b")
    mail = lambda x: F.concat(x, F.lit(" u@v.example.org"))
    row = F.struct(
        F.col("doc_id").cast("string").alias("id"), F.lit("text/plain").alias("mime_type"), mail(a).alias("title"), b.alias("subject"), F.array(mail(a), b).alias("authors"), mail(b).alias("created_by"), F.lit("10.0.0.1").alias("modified_by"),
        F.struct(F.struct(F.array(F.struct(mail(a).alias("deep"))).alias("list")).alias("additional")).alias("metadata"), F.array(F.array(a, mail(b)), F.array(b, a)).alias("cells"),
        F.array(F.struct(F.lit(1).alias("page"), mail(a).alias("content"), mail(b).alias("speaker_notes"))).alias("pages"), F.array(F.struct(F.lit("note").alias("kind"), mail(a).alias("content"))).alias("annotations"),
        F.array(F.struct(a.alias("name"), mail(b).alias("value"), F.lit("10.0.0.2").alias("default_value"))).alias("form_fields"), F.array(F.struct(mail(a).alias("author"), mail(b).alias("inserted"), a.alias("deleted"))).alias("revisions"),
        F.array(F.struct(F.lit("mailto:w@x.example.org").alias("url"), a.alias("label"))).alias("uris"), F.array(mail(b)).alias("keywords"), mail(a).alias("summary"),
        F.array(F.struct(F.lit("c@d.org").alias("id"), mail(b).alias("title"), F.array(F.struct(mail(a).alias("title"))).alias("children"))).alias("children"))
    t = documents(spark, d).withColumn("a", plain_line(0)).withColumn("b", plain_line(1))
    clean = lambda x: S.redact(x, S.detect(x, SURE))
    return t.select("doc_id", C.redacted_record(F.to_json(row), clean).alias("j")).select("doc_id", F.md5("j").alias("record_md5"), F.get_json_object("j", "$.children[0].id").alias("child"))


def e10_observed(spark, d):
    """First and last ISO date beside each name: dates are gathered by document first, so names and dates never meet in pairs."""
    day = F.date_format(F.expr("DATE '2024-01-01' + CAST(doc_id * 37 % 900 AS INT)"), "yyyy-MM-dd")
    t = documents(spark, d).withColumn("text", F.concat("text", F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit(" seen "), day, F.lit(" and 2023-02-30 "), F.lit("2025-13-01")))))
    dates = t.select("doc_id", F.filter(F.regexp_extract_all("text", F.lit("([0-9]{4}-[0-9]{2}-[0-9]{2})"), F.lit(1)), lambda x: F.length(x) == 10).alias("dates")).where(F.size("dates") > 0)
    by_doc = dates.select("doc_id", F.array_min("dates").alias("first"), F.array_max("dates").alias("last"))
    names = facts(spark, d).where("category = 'person'").select("doc_id", "surface").distinct()
    return names.join(by_doc, "doc_id").groupBy("surface").agg(F.min("first").alias("earliest"), F.max("last").alias("latest"), F.count("*").alias("documents"))


def t1_votes(spark, d):
    """Spans of three labelings of a document (each misses some, and says some twice): accepted with two votes, else for review."""
    f = facts(spark, d).select("doc_id", F.col("category").alias("label"), "start", "end")
    samples = f.withColumn("sample", F.explode(F.array(*[F.lit(k) for k in range(3)]))).where("(start + sample * 7 + doc_id) % (sample + 2) <> 0")
    twice = samples.unionByName(samples.where("start % 5 = 0"))
    votes = twice.dropDuplicates(["doc_id", "label", "start", "end", "sample"]).groupBy("doc_id", "label", "start", "end").agg(F.count("*").alias("votes"))
    verdict = F.when(F.col("votes") >= 2, "accepted").otherwise("review")
    return votes.groupBy("doc_id", verdict.alias("verdict")).agg(F.count("*").alias("n"), F.min("start").cast("long").alias("first"))


def t2_context(spark, d):
    """Where a passage's word stands: the one place, or the one place whose neighbours fit what the labeler quoted; overlapping places count."""
    words = F.filter(F.split("text", "[ \n]"), lambda x: x != "")
    t = spark.read.parquet(f"{d}/benchmark.parquet").select("item_id", "text", words.alias("w")).select("item_id", "text", F.explode(F.sequence(F.lit(1), F.size("w") - 2)).alias("i"), "w")
    t = t.select("item_id", "text", "i", F.left(F.get("w", F.col("i")), F.lit(3)).alias("e"), F.when(F.col("i") % 3 > 0, F.get("w", F.col("i") - 1)).alias("before"), F.when(F.col("i") % 3 > 1, F.concat(F.substring(F.get("w", F.col("i")), F.lit(4), F.lit(99)))).alias("after"))
    hits = F.filter(F.sequence(F.lit(0), F.char_length("text") - 1), lambda i: F.substring(F.col("text"), i + 1, F.char_length("e")) == F.col("e"))
    fits = lambda i: (F.col("before").isNull() | F.endswith(F.rtrim(F.translate(F.left(F.col("text"), i), "\n", " ")), F.rtrim("before"))) & (F.col("after").isNull() | F.startswith(F.ltrim(F.translate(F.substring(F.col("text"), i + F.char_length("e") + 1, F.char_length("text")), "\n", " ")), F.ltrim("after")))
    found = t.withColumn("h", hits).withColumn("c", F.when(F.size("h") > 1, F.filter("h", fits)).otherwise(F.col("h")))
    return found.select("item_id", "i", F.size("h").cast("long").alias("hits"), F.when(F.size("c") == 1, F.get("c", F.lit(0))).cast("long").alias("start"))


def t4_records(spark, d):
    """Training records of labelled spans, or why a span may not be one: out of range, or white space alone; mentions are distinct and in order."""
    f = facts(spark, d).where("category <> 'ip_address'").select("doc_id", F.col("category").alias("label"), "start", F.when(F.col("doc_id") % 17 == 0, F.lit(10**9)).otherwise(F.col("end")).alias("end"))
    blank = documents(spark, d).where("doc_id % 19 = 0 and text rlike ' '").select("doc_id", F.lit("person").alias("label"), (F.locate(" ", "text") - 1).alias("start"), F.locate(" ", "text").alias("end"))
    spans = f.unionByName(blank).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("start", "end", "label"))).alias("spans"))
    t = documents(spark, d).select("doc_id", "text").join(spans, "doc_id")
    wide = F.exists("spans", lambda s: ~((s["start"] >= 0) & (s["start"] < s["end"]) & (s["end"] <= F.char_length("text"))))
    mention = lambda s: F.substring(F.col("text"), s["start"] + 1, s["end"] - s["start"])
    empty = F.exists("spans", lambda s: F.trim(mention(s)) == "")
    of = lambda label: F.array_distinct(F.transform(F.filter("spans", lambda s: s["label"] == label), mention))
    record = F.to_json(F.struct(of("email").alias("email"), of("person").alias("person")))
    return t.select("doc_id", F.when(wide, "out of range").when(empty, "white space").alias("error"), F.when(~wide & ~empty, record).alias("entities"))


QUERIES = {
    "d4_label_categories": d4_labels, "d5_merge_priorities": d5_priorities, "d6_span_checks": d6_checks, "d12_whole_records": d12_records, "r10_keyed_hash": r10_keyed, "e10_observed_dates": e10_observed,
    "t1_span_votes": t1_votes, "t2_offsets_in_context": t2_context, "t4_checked_records": t4_records,
}


def fold_sql(wins: str) -> str:
    """The merged list of ``l``, spans in order as structs with a one-element list of themselves."""
    ratio = "(least(a.e, x.e) - greatest(a.s, x.s)) / greatest(a.e - a.s, x.e - x.s)"
    swapped = "{'s': x.s, 'e': x.e, 'c': x.c, 'r': x.r, 'o': list_concat(a.o[1:len(a.o) - 1], x.o)}"
    added = "{'s': x.s, 'e': x.e, 'c': x.c, 'r': x.r, 'o': list_concat(a.o, x.o)}"
    return f"list_reduce(l, lambda a, x: CASE WHEN x.s >= a.e THEN {added} WHEN {ratio} > 0.5 AND ({wins}) THEN {swapped} ELSE a END).o"


STRONGER = "(x.c - a.c > 0.05 OR x.e - x.s > a.e - a.s)"
WINS = {"regex_first": f"CASE WHEN a.r AND NOT x.r THEN false WHEN x.r AND NOT a.r THEN true ELSE {STRONGER} END", "higher_confidence": "x.c - a.c > 0.05", "longer_span": "x.e - x.s > a.e - a.s"}
LEVELS = [("n1", NAME, 1, "person", "true", 13), ("n2", MAIL, 2, "email", "true", 7), ("n3", PHRASE, 99, "organisation", "false", 11), ("n4", LONG, 99, "title", "false", 17)]
masked = lambda x: f"regexp_replace(regexp_replace({x}, '{MAIL}', '[EMAIL]', 'g'), '{IP}', '[IP]', 'g')"
MA, MB, MMA, MMB = masked("a"), masked("b"), masked("(a || ' u@v.example.org')"), masked("(b || ' u@v.example.org')")
BYTES = "hex(encode(text))"
SQL = {
    "d5_merge_priorities": "WITH docs AS (SELECT doc_id, coalesce(text, '') AS text FROM documents), " + ", ".join(located_sql(n, p) for n, p, *_ in LEVELS) + ", u AS (" + " UNION ALL ".join(f"SELECT doc_id, s, e, (length(surface) * {level} % 97 + 3) / 100 AS c, {r} AS r, {order} AS ord, '{cat}' AS cat FROM {n}" for n, _, order, cat, r, level in LEVELS) + """),
        k AS (SELECT doc_id, list({'s': s, 'e': e, 'c': c, 'r': r, 'o': [s || ':' || e || ':' || cat]} ORDER BY s, e, ord, cat) AS l FROM u GROUP BY 1), f AS (SELECT doc_id, """ + ", ".join(f"{fold_sql(w)} AS {p}" for p, w in WINS.items()) + " FROM k) SELECT doc_id, " + ", ".join(f"coalesce(len({p}), 0) AS {p}_n, md5(coalesce(array_to_string({p}, ','), '')) AS {p}_md5" for p in PRIORITIES) + " FROM docs LEFT JOIN f USING (doc_id)",
    "d6_span_checks": f"""WITH c AS (SELECT conv_id, turn, coalesce(text, '') AS text, (conv_id * 7 + turn) % 8 AS k FROM conversations), x AS (SELECT *, strlen(text) AS n, CASE WHEN k = 7 THEN -1 ELSE turn * 5 END AS s, CASE k WHEN 1 THEN turn * 5 WHEN 2 THEN strlen(text) + 1 ELSE turn * 5 + 6 END AS e FROM c)
        SELECT conv_id, turn, CASE WHEN s < 0 OR s >= e THEN 'order' WHEN e > n THEN 'bounds' WHEN substr({BYTES}, 2 * s + 1, 1) IN ('8', '9', 'A', 'B') OR substr({BYTES}, 2 * e + 1, 1) IN ('8', '9', 'A', 'B') THEN 'boundary' WHEN k IN (3, 4, 6) THEN 'confidence' WHEN k = 5 THEN 'text' END AS problem FROM x""",
    "d4_label_categories": "WITH x AS (SELECT [" + ", ".join(f"'{k}'" for k in [*ALIASES, "weather", "Ship Name"]) + "] AS x), a AS (SELECT generate_subscripts(x, 1) - 1 AS i, unnest(x) AS label FROM x), m AS (SELECT * FROM (VALUES " + ", ".join(f"('{k}', '{v}')" for k, v in ALIASES.items()) + f""") AS t(name, category)),
        e AS (SELECT CASE WHEN event_id % 3 = 0 THEN upper(label) ELSE label END AS label FROM events JOIN a ON a.i = event_id % {len(ALIASES) + 2}) SELECT coalesce(category, 'custom:' || label) AS category, count(*) AS n FROM e LEFT JOIN m ON name = lower(label) GROUP BY 1""",
    "r10_keyed_hash": f"WITH {FACTS}, g AS (SELECT category, surface, count(*) AS n FROM facts GROUP BY 1, 2) SELECT category, n, '#' || category || ':' || left(sha256(unhex('{bytes(b ^ 0x5C for b in KEY.ljust(64, bytes(1))).hex()}' || sha256(unhex('{bytes(b ^ 0x36 for b in KEY.ljust(64, bytes(1))).hex()}' || hex(encode(category || ':' || surface)))))), 16) AS token FROM g",
    "d12_whole_records": f"""WITH l AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS x FROM documents), t AS (SELECT doc_id, regexp_replace(x[1], '[^A-Za-z0-9@._ -]', '', 'g') AS a, regexp_replace(coalesce(x[2], ''), '[^A-Za-z0-9@._ -]', '', 'g') AS b FROM l),
        m AS (SELECT doc_id, {MA} AS a, {MB} AS b, {MMA} AS ma, {MMB} AS mb FROM t)
        SELECT doc_id, md5('{{"id":"' || doc_id || '","mime_type":"text/plain","title":"' || ma || '","subject":"' || b || '","authors":["' || ma || '","' || b || '"],"created_by":"' || mb || '","modified_by":"[IP]","metadata":{{"additional":{{"list":[{{"deep":"' || ma || '"}}]}}}},"cells":[["' || a || '","' || mb || '"],["' || b || '","' || a ||
        '"]],"pages":[{{"page":1,"content":"' || ma || '","speaker_notes":"' || mb || '"}}],"annotations":[{{"kind":"note","content":"' || ma || '"}}],"form_fields":[{{"name":"' || a || '","value":"' || mb || '","default_value":"[IP]"}}],"revisions":[{{"author":"' || ma || '","inserted":"' || mb || '","deleted":"' || a ||
        '"}}],"uris":[{{"url":"mailto:[EMAIL]","label":"' || a || '"}}],"keywords":["' || mb || '"],"summary":"' || ma || '","children":[{{"id":"c@d.org","title":"' || mb || '","children":[{{"title":"' || ma || '"}}]}}]}}') AS record_md5, 'c@d.org' AS child FROM m""",
    "e10_observed_dates": f"""WITH {FACTS}, y AS (SELECT doc_id, strftime(DATE '2024-01-01' + CAST(doc_id * 37 % 900 AS INTEGER), '%Y-%m-%d') AS day FROM docs WHERE doc_id % 3 = 0), n AS (SELECT DISTINCT doc_id, surface FROM facts WHERE category = 'person')
        SELECT surface, min(least(day, '2023-02-30')) AS earliest, max(greatest(day, '2025-13-01')) AS latest, count(*) AS documents FROM n JOIN y USING (doc_id) GROUP BY 1""",
    "t1_span_votes": f"""WITH {FACTS}, s AS (SELECT DISTINCT doc_id, category, s, e, k FROM facts, range(3) r(k) WHERE (s + k * 7 + doc_id) % (k + 2) <> 0), v AS (SELECT doc_id, category, s, e, count(*) AS votes FROM s GROUP BY ALL)
        SELECT doc_id, CASE WHEN votes >= 2 THEN 'accepted' ELSE 'review' END AS verdict, count(*) AS n, min(s) AS first FROM v GROUP BY 1, 2""",
    "t2_offsets_in_context": """WITH b AS (SELECT item_id, text, list_filter(regexp_split_to_array(text, '[ \n]'), lambda x: x <> '') AS w FROM benchmark), t AS (SELECT item_id, text, i, w, left(w[i + 1], 3) AS e, CASE WHEN i % 3 > 0 THEN w[i] END AS pre, CASE WHEN i % 3 > 1 THEN substr(w[i + 1], 4) END AS post FROM (SELECT *, unnest(range(1, len(w) - 1)) AS i FROM b)),
        h AS (SELECT *, list_filter(range(length(text)), lambda p: substr(text, p + 1, length(e)) = e) AS h FROM t),
        c AS (SELECT *, CASE WHEN len(h) > 1 THEN list_filter(h, lambda p: (pre IS NULL OR ends_with(rtrim(replace(left(text, p), chr(10), ' ')), pre)) AND (post IS NULL OR starts_with(ltrim(replace(substr(text, p + length(e) + 1), chr(10), ' ')), post))) ELSE h END AS c FROM h)
        SELECT item_id, CAST(i AS INTEGER) AS i, len(h) AS hits, CASE WHEN len(c) = 1 THEN c[1] END AS start FROM c""",
    "t4_checked_records": f"""WITH {FACTS}, f AS (SELECT doc_id, category AS label, s, CASE WHEN doc_id % 17 = 0 THEN 1000000000 ELSE e END AS e, surface FROM facts WHERE category <> 'ip_address' UNION ALL SELECT doc_id, 'person', position(' ' IN text) - 1, position(' ' IN text), ' ' FROM docs WHERE doc_id % 19 = 0 AND contains(text, ' ')),
        g AS (SELECT doc_id, bool_or(e > length(text)) AS wide, bool_or(trim(surface) = '') AS blank FROM f JOIN docs USING (doc_id) GROUP BY 1), o AS (SELECT doc_id, label, surface, min((s, e)) AS p FROM f GROUP BY 1, 2, 3), l AS (SELECT doc_id, label, string_agg('"' || surface || '"', ',' ORDER BY p) AS j FROM o GROUP BY 1, 2)
        SELECT doc_id, CASE WHEN wide THEN 'out of range' WHEN blank THEN 'white space' END AS error, CASE WHEN NOT wide AND NOT blank THEN '{{"email":[' || coalesce(a.j, '') || '],"person":[' || coalesce(b.j, '') || ']}}' END AS entities
        FROM g LEFT JOIN (SELECT * FROM l WHERE label = 'email') a USING (doc_id) LEFT JOIN (SELECT * FROM l WHERE label = 'person') b USING (doc_id)""",
}
