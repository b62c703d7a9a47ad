"""Glossary and entity registry over span facts of all documents, with SQL beside them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import spans as S
from ..operators.related import related
from .facts import FACTS, MAIL, documents, facts, located_sql

# The vocabularies that place a document in a vertical.
MA_TERMS = "m&a|merger|acquisition|acquirer|acquired|acquires|target|spa|share purchase|earnout|indemnification|representation and warranty|material adverse change|break fee|closing condition|deal value|purchase price"
FS_TERMS = "private equity|venture capital|limited partner|general partner|carried interest|management fee|nav|irr|dpi|tvpi|portfolio company|fund size|capital commitment"
# What stands before names of persons and behind names of organisations.
HONORIFIC = r"^(monsieur|madame|mademoiselle|ma[iî]tre|docteur|professeur|mister|misses|miss|mme|mlle|me|dr|pr|prof|mr|mrs|ms|m)[.]?\s+"
SUFFIXES = "sas|sarl|sa|ltd|gmbh|inc"


def vertical(text: Column) -> Column:
    """The vertical of a document by its words; mergers win. Word ends are ASCII ones."""
    has = lambda terms: F.lower(text).rlike(f"(?<![a-z0-9_])({terms})(?![a-z0-9_])")
    return F.when(has(MA_TERMS), "m&a").when(has(FS_TERMS), "financial_services").otherwise("shared")


def slug(text: Column) -> Column:
    """Lower case, runs of other characters than ASCII letters and digits as one dash, 64 characters at most."""
    dashed = F.regexp_replace(F.lower(text), "[^a-z0-9]+", "-")
    return F.left(F.regexp_replace(dashed, "^-+|-+$", ""), F.lit(64))


def e14_vertical(spark, d):
    return documents(spark, d).select("doc_id", vertical(F.col("text")).alias("vertical"))


def placed(spark, d):
    """Facts with the vertical of their document (pages of business words make some of each)."""
    kind = F.when(F.col("doc_id") % 11 == 0, "m&a").when(F.col("doc_id") % 13 == 0, "financial_services").otherwise("shared")
    return facts(spark, d).withColumn("vertical", kind)


def g1_observed(spark, d):
    """Terms seen twice or more with a confidence of one half or more, and their mean confidence."""
    f = facts(spark, d).where("confidence >= 0.5")
    return f.groupBy("category", F.col("surface").alias("term")).agg(F.count("*").alias("n"), F.round(F.avg("confidence"), 6).alias("mean_confidence")).where("n >= 2")


def e1_registry(spark, d):
    """Entities by normalised name, type and vertical: longest form, aliases, mentions, documents, stable id."""
    name = F.lower(F.regexp_replace("surface", "[.,;:]+$", ""))
    key = F.concat_ws("|", "category", "vertical", name)
    e = placed(spark, d).groupBy("category", "vertical", name.alias("name")).agg(
        F.max_by("surface", F.struct(F.char_length("surface"), "surface")).alias("canonical"), F.countDistinct("surface").alias("forms"),
        F.count("*").alias("mentions"), F.countDistinct("doc_id").alias("documents"), F.first(F.sha2(key, 256)).alias("h"))
    return e.select("category", "vertical", "name", "canonical", (F.col("forms") - 1).alias("aliases"), "mentions", "documents", F.concat(F.lit("ent-"), F.left("h", F.lit(12))).alias("entity_id"))


def e6_mapping(spark, d):
    """Mentions per document and entity."""
    name = F.lower(F.regexp_replace("surface", "[.,;:]+$", ""))
    return placed(spark, d).groupBy("doc_id", "category", name.alias("name")).agg(F.count("*").alias("mentions"))


def e6_summary(spark, d):
    """Per vertical: documents, distinct entities and mentions."""
    name = F.concat_ws("|", "category", F.lower(F.regexp_replace("surface", "[.,;:]+$", "")))
    return placed(spark, d).groupBy("vertical").agg(F.countDistinct("doc_id").alias("documents"), F.countDistinct(name).alias("entities"), F.count("*").alias("mentions"))


def person_tokens(name: Column) -> Column:
    """Lower-case tokens of a person's name without honorific and trailing punctuation."""
    bare = F.regexp_replace(F.regexp_replace(name, f"(?i){HONORIFIC}", ""), "[.,;:]+$", "")
    return F.filter(F.split(F.lower(bare), r"\s+"), lambda t: t != "")


def names(spark, d):
    """Names made of each document's first two capitalised words, written in several ways."""
    found = documents(spark, d).select("doc_id", F.regexp_extract_all("text", F.lit("[A-Z][a-z]{2,}"), F.lit(0)).alias("f")).where(F.size("f") > 1)
    return found.select("doc_id", F.col("f")[0].alias("one"), F.col("f")[1].alias("two"))


def e2_person_aliases(spark, d):
    """Persons' names that are part of exactly one fuller name: same last token, all tokens in it.

    The rule is free of order: a name with several fuller ones stays on its own.
    """
    form = F.when(F.col("doc_id") % 3 == 0, F.concat_ws(" ", "one", "two")).when(F.col("doc_id") % 3 == 1, F.concat(F.lit("M. "), "two")).otherwise(F.concat("two", F.lit(",")))
    n = names(spark, d).select(form.alias("name")).distinct().withColumn("tokens", person_tokens(F.col("name"))).withColumn("last", F.element_at("tokens", -1))
    a, b = n.alias("a"), n.alias("b")
    fuller = (F.col("a.last") == F.col("b.last")) & (F.size("a.tokens") < F.size("b.tokens")) & (F.size(F.array_except("a.tokens", "b.tokens")) == 0)
    found = a.join(b, fuller).groupBy(F.col("a.name").alias("name")).agg(F.count("*").alias("fuller"), F.min("b.name").alias("only"))
    return found.select("name", "fuller", F.when(F.col("fuller") == 1, F.col("only")).alias("alias_of"))


def org_base(name: Column) -> Column:
    """An organisation's name in lower case without punctuation and legal suffixes; one token stays."""
    plain = F.trim(F.regexp_replace(F.regexp_replace(F.lower(name), "[.,;:]", ""), r"\s+", " "))
    return F.regexp_replace(plain, f"(?<=[^ ])( ({SUFFIXES}))+$", "")


def e3_org_aliases(spark, d):
    """Organisations by name without legal suffixes: longest form and number of forms."""
    ends = F.array(*[F.lit(x) for x in ("", " SAS", " Ltd Inc", " GmbH", " S.A.S.", ",", " Sarl.")])
    n = names(spark, d).select(F.concat("two", F.get(ends, (F.col("doc_id") % 7).cast("int"))).alias("name"))
    return n.groupBy(org_base(F.col("name")).alias("base")).agg(F.max_by("name", F.struct(F.char_length("name"), "name")).alias("canonical"), F.countDistinct("name").alias("forms"))


def e8_related(spark, d, top_k=5):
    """The documents most related to each by the summed idf of all shared entities, with those entities; an entity of every document adds nothing."""
    m = facts(spark, d).where("category = 'person'").select(F.col("doc_id").alias("doc"), F.col("surface").alias("term"))
    found, _ = related(m, documents(spark, d).count(), top_k)
    return found.select(F.col("doc").alias("doc_id"), "other", F.round(F.col("score") / 1e9, 6).alias("score"), F.array_join("shared", ", ").alias("shared"))


ISO = "^[0-9]{4}-(0[1-9]|1[0-2])-(0[1-9]|[12][0-9]|3[01])$"


def dated(spark, d):
    """Dates seen beside an entity (orders of a customer), some not in ISO form."""
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    said = F.when(F.col("o_orderkey") % 4 == 0, F.concat(F.lit("around "), F.left(day, F.lit(4)))).when(F.col("o_orderkey") % 4 == 1, F.date_format("o_orderdate", "dd.MM.yyyy")).otherwise(day)
    return spark.read.parquet(f"{d}/orders.parquet").select("o_custkey", said.alias("said"))


def e10_dates(spark, d):
    """First and last ISO date among the dates beside an entity; other forms of dates say nothing."""
    return dated(spark, d).where(F.col("said").rlike(ISO)).groupBy("o_custkey").agg(F.min("said").alias("first_date"), F.max("said").alias("last_date"))


def e12_timeline(spark, d):
    """The places of a timeline: ISO dates first, then the rest by alphabet."""
    t = dated(spark, d).groupBy("said").agg(F.count("*").alias("n"))
    listed = t.select("said", "n", F.col("said").rlike(ISO).alias("iso"))
    return listed.orderBy(F.col("iso").desc(), "said").select("said", "n", "iso")


def e13_intra(spark, d):
    """A document's entities by type and slug: summed counts, spans without overlap."""
    f = facts(spark, d).groupBy("doc_id", "category", slug(F.col("surface")).alias("slug")).agg(F.count("*").alias("n"), F.array_sort(F.collect_list(F.struct("start", "end"))).alias("spans"))
    apart = F.aggregate("spans", F.struct(F.lit(0).alias("kept"), F.lit(0).alias("end")), lambda s, x: F.when(x["start"] >= s["end"], F.struct((s["kept"] + 1).alias("kept"), x["end"].alias("end"))).otherwise(s))
    return f.select("doc_id", "category", "slug", "n", apart["kept"].cast("long").alias("spans"))


def e15_outline(spark, d):
    """Headings of each document (every fourth line is set as one) with the mail addresses in each section."""
    lines = F.transform(F.split("text", "\n"), lambda x, i: F.when(i % 4 == 0, F.concat(F.lit("## "), x)).otherwise(x))
    md = documents(spark, d).select("doc_id", F.array_join(lines, "\n").alias("md"))
    rows = md.select("doc_id", F.posexplode(F.split("md", "\n")).alias("line", "s"))
    before = Window.partitionBy("doc_id").orderBy("line").rowsBetween(Window.unboundedPreceding, -1)
    at = rows.withColumn("start", F.coalesce(F.sum(F.char_length("s") + 1).over(before), F.lit(0)))
    heads = at.where(F.col("s").rlike(r"^#{1,6} +[^ ]")).withColumn("stop", F.lead("start").over(Window.partitionBy("doc_id").orderBy("start")))
    pii = md.select("doc_id", F.explode(S.located(F.col("md"), MAIL)).alias("m")).select("doc_id", F.col("m.start").alias("at"))
    inside = (heads["doc_id"] == pii["doc_id"]) & (F.col("at") >= F.col("start") + F.char_length("s")) & (F.col("at") < F.coalesce("stop", F.lit(2**62)))
    found = heads.join(pii, inside, "left").groupBy(heads["doc_id"].alias("doc_id"), "start", "s").agg(F.count("at").alias("pii"))
    return found.select("doc_id", F.char_length(F.regexp_extract("s", "^(#+)", 1)).cast("long").alias("level"), F.col("start").cast("long").alias("start"), "pii")


def e16_front(spark, d):
    """Front matter of each document: type, number of sure spans, its entities' ids."""
    name = F.lower(F.regexp_replace("surface", "[.,;:]+$", ""))
    entity = F.concat(F.lit("ent-"), F.left(F.sha2(F.concat_ws("|", "category", "vertical", name), 256), F.lit(12)))
    f = placed(spark, d).groupBy("doc_id").agg(F.count_if(F.col("category") != "person").alias("pii"), F.array_sort(F.collect_set(entity)).alias("ids"))
    head = F.concat(F.lit("type: "), "tenant", F.lit("\npii: "), F.coalesce("pii", F.lit(0)).cast("string"), F.lit("\nentities: ["), F.coalesce(F.array_join("ids", ", "), F.lit("")), F.lit("]"))
    return documents(spark, d).join(f, "doc_id", "left").select("doc_id", F.md5(head).alias("front_md5"))


def node_name(text: Column) -> Column:
    """A string literal of Cypher: backslashes and quotes escaped."""
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("'"), F.lit("\\'"))


def snk4_nodes(spark, d):
    """Entities as Cypher, as a node of a node-link document and as Turtle; names with quotes are escaped."""
    e = e1_registry(spark, d).withColumn("label", F.concat("canonical", F.when(F.col("mentions") % 2 == 0, "'s").otherwise("")))
    cypher = F.concat(F.lit("MERGE (n:Entity {id: '"), "entity_id", F.lit("'}) SET n.name = '"), node_name(F.col("label")), F.lit("', n.type = '"), "category", F.lit("';"))
    turtle = F.concat(F.lit("<urn:entity:"), "entity_id", F.lit("> <urn:name> \""), F.replace(F.replace("label", F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit("\" ."))
    return e.select("entity_id", cypher.alias("cypher"), F.to_json(F.struct(F.col("entity_id").alias("id"), "label", F.col("category").alias("type"))).alias("node"), turtle.alias("turtle"))


QUERIES = {
    "g1_observed_terms": g1_observed, "e1_e4_e5_registry": e1_registry, "e6_document_entities": e6_mapping, "e6_batch_summary": e6_summary,
    "e2_person_aliases": e2_person_aliases, "e3_org_aliases": e3_org_aliases, "e8_related_documents": e8_related, "e10_date_range": e10_dates, "e12_timeline": e12_timeline,
    "e13_intra_document": e13_intra, "e14_vertical": e14_vertical, "e15_outline": e15_outline, "e16_front_matter": e16_front, "snk4_graph_nodes": snk4_nodes,
}

PLACED = f"{FACTS}, placed AS (SELECT *, CASE WHEN doc_id % 11 = 0 THEN 'm&a' WHEN doc_id % 13 = 0 THEN 'financial_services' ELSE 'shared' END AS vertical, lower(regexp_replace(surface, '[.,;:]+$', '')) AS name FROM facts)"
GLOSSARY = f"{FACTS}, observed AS (SELECT category, surface AS term, count(*) AS n, round(avg(confidence), 6) AS mean_confidence FROM facts WHERE confidence >= 0.5 GROUP BY 1, 2 HAVING count(*) >= 2)"
REGISTRY = f"""{PLACED}, registry AS (SELECT category, vertical, name, arg_max(surface, (length(surface), surface)) AS canonical, count(DISTINCT surface) - 1 AS aliases, count(*) AS mentions, count(DISTINCT doc_id) AS documents,
         'ent-' || left(sha256(category || '|' || vertical || '|' || name), 12) AS entity_id FROM placed GROUP BY 1, 2, 3)"""
NAMES = "names AS (SELECT doc_id, f[1] AS one, f[2] AS two FROM (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[A-Z][a-z]{2,}') AS f FROM documents) WHERE len(f) > 1)"
DATED = """dated AS (SELECT o_custkey, CASE o_orderkey % 4 WHEN 0 THEN 'around ' || strftime(o_orderdate, '%Y') WHEN 1 THEN strftime(o_orderdate, '%d.%m.%Y') ELSE strftime(o_orderdate, '%Y-%m-%d') END AS said FROM orders)"""
SQL = {
    "g1_observed_terms": f"WITH {GLOSSARY} SELECT * FROM observed",
    "e1_e4_e5_registry": f"WITH {REGISTRY} SELECT * FROM registry",
    "e6_document_entities": f"WITH {PLACED} SELECT doc_id, category, name, count(*) AS mentions FROM placed GROUP BY 1, 2, 3",
    "e6_batch_summary": f"WITH {PLACED} SELECT vertical, count(DISTINCT doc_id) AS documents, count(DISTINCT category || '|' || name) AS entities, count(*) AS mentions FROM placed GROUP BY 1",
    "e2_person_aliases": f"""WITH {NAMES}, n AS (SELECT DISTINCT CASE doc_id % 3 WHEN 0 THEN one || ' ' || two WHEN 1 THEN 'M. ' || two ELSE two || ',' END AS name FROM names),
        t AS (SELECT name, string_split(lower(regexp_replace(regexp_replace(name, '(?i){HONORIFIC}', ''), '[.,;:]+$', '')), ' ') AS t FROM n)
        SELECT a.name, count(*) AS fuller, CASE WHEN count(*) = 1 THEN min(b.name) END AS alias_of FROM t a JOIN t b ON a.t[-1] = b.t[-1] AND len(a.t) < len(b.t) AND list_has_all(b.t, a.t) GROUP BY 1""",
    "e3_org_aliases": f"""WITH {NAMES}, n AS (SELECT two || ['', ' SAS', ' Ltd Inc', ' GmbH', ' S.A.S.', ',', ' Sarl.'][doc_id % 7 + 1] AS name FROM names),
        b AS (SELECT name, string_split(regexp_replace(lower(name), '[.,;:]', '', 'g'), ' ') AS t FROM n)
        SELECT t[1] AS base, arg_max(name, (length(name), name)) AS canonical, count(DISTINCT name) AS forms FROM b GROUP BY 1""",
    "e8_related_documents": f"""WITH {FACTS}, m AS (SELECT DISTINCT doc_id, surface AS term FROM facts WHERE category = 'person'), f AS (SELECT term, count(*) AS df FROM m GROUP BY 1 HAVING count(*) > 1),
        w AS (SELECT doc_id, term, CAST(round(ln(CAST((SELECT count(*) FROM documents) AS DOUBLE) / df) * 1e9) AS BIGINT) AS idf FROM m JOIN f USING (term) WHERE df < (SELECT count(*) FROM documents)),
        s AS (SELECT a.doc_id, b.doc_id AS other, sum(a.idf) AS score, string_agg(a.term, ', ' ORDER BY a.idf DESC, a.term) AS shared FROM w a JOIN w b ON a.term = b.term AND a.doc_id <> b.doc_id GROUP BY 1, 2)
        SELECT doc_id, other, round(CAST(score AS DOUBLE) / 1e9, 6) AS score, shared FROM s QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, other) <= 5""",
    "e10_date_range": f"WITH {DATED} SELECT o_custkey, min(said) AS first_date, max(said) AS last_date FROM dated WHERE regexp_matches(said, '{ISO}') GROUP BY 1",
    "e12_timeline": f"WITH {DATED} SELECT said, count(*) AS n, regexp_matches(said, '{ISO}') AS iso FROM dated GROUP BY 1 ORDER BY 3 DESC, 1",
    "e13_intra_document": f"WITH {FACTS} SELECT doc_id, category, left(trim(regexp_replace(lower(surface), '[^a-z0-9]+', '-', 'g'), '-'), 64) AS slug, count(*) AS n, count(*) AS spans FROM facts GROUP BY 1, 2, 3",
    "e14_vertical": f"SELECT doc_id, CASE WHEN regexp_matches(lower(text), '\\b({MA_TERMS})\\b') THEN 'm&a' WHEN regexp_matches(lower(text), '\\b({FS_TERMS})\\b') THEN 'financial_services' ELSE 'shared' END AS vertical FROM (SELECT doc_id, coalesce(text, '') AS text FROM documents)",
    "e15_outline": f"""WITH docs AS (SELECT doc_id, array_to_string(list_transform(string_split(coalesce(text, ''), chr(10)), lambda x, i: CASE WHEN (i - 1) % 4 = 0 THEN '## ' || x ELSE x END), chr(10)) AS text FROM documents),
        {located_sql('pii', MAIL)}, l AS (SELECT doc_id, generate_subscripts(x, 1) AS line, unnest(x) AS s FROM (SELECT doc_id, string_split(text, chr(10)) AS x FROM docs)),
        o AS (SELECT doc_id, s, CAST(coalesce(sum(length(s) + 1) OVER (PARTITION BY doc_id ORDER BY line ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start FROM l),
        h AS (SELECT *, lead(start) OVER (PARTITION BY doc_id ORDER BY start) AS stop FROM o WHERE regexp_matches(s, '^#{{1,6}} +[^ ]'))
        SELECT h.doc_id, CAST(length(regexp_extract(h.s, '^(#+)', 1)) AS BIGINT) AS level, start, count(p.s) AS pii FROM h LEFT JOIN pii p ON p.doc_id = h.doc_id AND p.s >= start + length(h.s) AND (stop IS NULL OR p.s < stop) GROUP BY ALL""",
    "e16_front_matter": f"""WITH {PLACED}, g AS (SELECT doc_id, count(*) FILTER (category <> 'person') AS pii, list_sort(list(DISTINCT 'ent-' || left(sha256(category || '|' || vertical || '|' || name), 12))) AS ids FROM placed GROUP BY 1)
        SELECT doc_id, md5('type: ' || tenant || chr(10) || 'pii: ' || coalesce(pii, 0) || chr(10) || 'entities: [' || coalesce(array_to_string(ids, ', '), '') || ']') AS front_md5 FROM docs LEFT JOIN g USING (doc_id)""",
    "snk4_graph_nodes": f"""WITH {REGISTRY}, l AS (SELECT *, canonical || CASE WHEN mentions % 2 = 0 THEN '''s' ELSE '' END AS label FROM registry)
        SELECT entity_id, 'MERGE (n:Entity {{id: ''' || entity_id || '''}}) SET n.name = ''' || replace(label, '''', '\\''') || ''', n.type = ''' || category || ''';' AS cypher,
               '{{"id":"' || entity_id || '","label":"' || label || '","type":"' || category || '"}}' AS node, '<urn:entity:' || entity_id || '> <urn:name> "' || label || '" .' AS turtle FROM l""",
}
