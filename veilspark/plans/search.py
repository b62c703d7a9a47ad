"""Retrieval as it is called: chunks with tenant, access list and dossier, text and vector legs, redacted output.

A chunk is a turn of a conversation; it inherits what it lacks from its document (the
conversation). Its vector is one of the table of embeddings, by a rule that SQL can repeat.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import spans as S
from ..functions.json_text import string_leaves
from ..operators import textindex
from ..operators.filters import compile_filter, validate
from .facts import MAIL, SURE
from .retrieval import cosine, dot

def chunks(spark, d) -> DataFrame:
    """``chunk_id, document, ordinal, content, tenant, dossier, version, acl, v``."""
    c = spark.read.parquet(f"{d}/conversations.parquet").select(F.col("conv_id").alias("document"), F.col("turn").alias("ordinal"), F.coalesce("text", F.lit("")).alias("content"), F.when(F.col("turn") % 4 == 3, "t1").alias("own_tenant"))
    docs = c.select("document").distinct().select(
        "document", F.concat(F.lit("t"), (F.col("document") % 3).cast("string")).alias("doc_tenant"), (F.col("document") % 4).alias("dossier"), (F.col("document") % 2 + 1).alias("version"),
        F.when(F.col("document") % 5 == 0, '{"share":{"readers":["t1","t9"]},"t1":"key"}').otherwise('{"note":"t1x","t1":["t0"]}').alias("acl"))
    e = spark.read.parquet(f"{d}/embeddings.parquet").select("vec_id", F.col("embedding").cast("array<double>").alias("v"))
    joined = c.join(docs, "document").withColumn("vec_id", (F.col("document") * 31 + F.col("ordinal")) % e.count()).join(e, "vec_id")
    tenant = F.coalesce("own_tenant", "doc_tenant", F.lit("default"))
    return joined.select((F.col("document") * 1000 + F.col("ordinal")).alias("chunk_id"), "document", "ordinal", "content", tenant.alias("tenant"), "dossier", "version", "acl", "v")


def allowed(tenant: str) -> Column:
    """The tenant's own rows, and those whose access list names it in any value."""
    return (F.col("tenant") == tenant) | F.exists(string_leaves(F.col("acl")), lambda v: v == tenant)


class QueryError(ValueError):
    """A query that breaks the limits."""


@dataclass(frozen=True)
class Query:
    """A retrieval: mode, inputs and boundaries; limits as in ``check``."""

    mode: str = "vector"
    vector: int | None = None
    text: str | None = None
    top_k: int = 10
    multiplier: int = 1
    dossier: int | None = None
    document: int | None = None
    version: int | None = None
    group_by_document: bool = False
    where: dict = field(default_factory=lambda: {"and": []})

    def check(self, dim: int | None = None, wanted: int | None = None) -> None:
        """Raise unless sizes are in bounds and the mode has its inputs."""
        if not 1 <= self.top_k <= 200:
            raise QueryError("top_k is from 1 to 200")
        if not 1 <= self.multiplier <= 20:
            raise QueryError("multiplier is from 1 to 20")
        if self.mode not in ("vector", "full_text", "hybrid"):
            raise QueryError(f"unknown mode {self.mode}")
        if self.mode in ("vector", "hybrid") and self.vector is None:
            raise QueryError("the mode needs a vector")
        if self.mode in ("full_text", "hybrid") and not (self.text or "").strip():
            raise QueryError("the mode needs a text")
        if dim is not None and dim != wanted:
            raise QueryError(f"the vector has {dim} numbers instead of {wanted}")


def bounded(rows: DataFrame, q: Query, tenant: str) -> DataFrame:
    """Rows inside the query's hard boundaries; all come before any scoring."""
    validate(q.where, {"ordinal", "version", "dossier", "document"})
    rows = rows.where(allowed(tenant)).where(compile_filter(q.where, rows.schema))
    for name in ("document", "dossier", "version"):
        if getattr(q, name) is not None:
            rows = rows.where(F.col(name) == getattr(q, name))
    return rows


def bm25(rows: DataFrame, text: str, k1: float = 1.2, b: float = 0.75, every: bool = False) -> DataFrame:
    """``chunk_id, score`` of rows that hold a term of ``text`` (``every``: all of them)."""
    terms = sorted(set(text.lower().split()))
    words = rows.select("chunk_id", F.explode(F.regexp_extract_all(F.lower("content"), F.lit("([a-z]+)"), F.lit(1))).alias("term"))
    per = words.groupBy("chunk_id").agg(F.count("*").alias("len"), *[F.count_if(F.col("term") == t).alias(f"tf{n}") for n, t in enumerate(terms)])
    stats = per.agg(F.count("*").alias("n"), F.avg("len").alias("mean"), *[F.count_if(F.col(f"tf{n}") > 0).alias(f"df{n}") for n in range(len(terms))])
    both = per.crossJoin(F.broadcast(stats))  # one row
    tf, df = (lambda n: F.col(f"tf{n}")), (lambda n: F.col(f"df{n}"))
    part = lambda n: F.log(1 + (F.col("n") - df(n) + 0.5) / (df(n) + 0.5)) * tf(n) * (k1 + 1) / (tf(n) + k1 * (1 - b + b * F.col("len") / F.col("mean")))
    total, found = sum((part(n) for n in range(len(terms))), F.lit(0.0)), [tf(n) > 0 for n in range(len(terms))]
    keep = found[0]
    for f in found[1:]:
        keep = keep & f if every else keep | f
    return both.where(keep).select("chunk_id", total.alias("score"))


def retrieve(spark, d, q: Query, tenant: str) -> DataFrame:
    """``chunk_id, document, content, score`` of the best rows for a tenant.

    Hybrid fuses the ranks of both legs, each as deep as ``top_k * multiplier``; ties go to the smaller chunk.
    """
    q.check()
    rows = bounded(chunks(spark, d), q, tenant)
    pool = q.top_k * q.multiplier
    legs = {}
    if q.mode in ("vector", "hybrid"):
        e = spark.read.parquet(f"{d}/embeddings.parquet").where(F.col("vec_id") == q.vector).select(F.col("embedding").cast("array<double>").alias("q")).limit(1)
        legs["vector"] = rows.crossJoin(F.broadcast(e)).select("chunk_id", cosine(F.col("v"), F.col("q")).alias("score"))  # one row
    if q.mode in ("full_text", "hybrid"):
        legs["text"] = bm25(rows, q.text)
    if q.mode != "hybrid":
        scored = next(iter(legs.values()))
    else:
        ranked = []
        for name, leg in legs.items():
            best = leg.orderBy(F.col("score").desc(), "chunk_id").limit(pool)
            ranked.append(best.select("chunk_id", F.row_number().over(Window.orderBy(F.col("score").desc(), "chunk_id")).alias(name)))
        share = lambda c: F.coalesce(1 / (60 + F.col(c)), F.lit(0.0))
        scored = ranked[0].join(ranked[1], "chunk_id", "full").select("chunk_id", (share("vector") + share("text")).alias("score"))
    out = scored.join(rows.select("chunk_id", "document", "content"), "chunk_id")
    if q.group_by_document:
        best = Window.partitionBy("document").orderBy(F.col("score").desc(), "chunk_id")
        out = out.withColumn("_n", F.row_number().over(best)).where("_n = 1").drop("_n")
    return out.orderBy(F.col("score").desc(), "chunk_id").limit(q.top_k)


def served(spark, d, q: Query, tenant: str) -> DataFrame:
    """What a caller gets: tenant forced, every row checked again, content redacted, or an error and nothing."""
    rows = retrieve(spark, d, q, tenant).join(chunks(spark, d).select("chunk_id", allowed(tenant).alias("_ok")), "chunk_id")
    safe = F.when(F.col("_ok"), S.redact(F.col("content"), S.detect(F.col("content"), SURE))).otherwise(F.raise_error(F.lit("a row of another tenant")).cast("string"))
    return rows.select("chunk_id", "document", safe.alias("content"), "score")


def k2_scores(spark, d):
    """Scores from distances: 1 - cosine distance, the negative of the others."""
    e = spark.read.parquet(f"{d}/embeddings.parquet").select("vec_id", F.col("embedding").cast("array<double>").alias("v"))
    q = F.broadcast(e.where("vec_id = 7").select(F.col("v").alias("q")))  # one row
    both = e.crossJoin(q)
    l2 = F.sqrt(F.aggregate(F.zip_with("v", "q", lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x))
    return both.select("vec_id", F.round(1 - (1 - cosine(F.col("v"), F.col("q"))), 6).alias("cosine"), F.round(-(-dot(F.col("v"), F.col("q"))), 6).alias("inner"), F.round(0.0 - l2, 6).alias("euclid"))


def k4_all_terms(spark, d):
    """Full text with every term in the row, best first by BM25."""
    return bm25(chunks(spark, d), "the and of", every=True).select("chunk_id", F.round("score", 6).alias("score"))


def k5_indexed(spark, d):
    """The ten best turns by BM25 for the first eight words of every hundredth conversation, through the stored index."""
    c = spark.read.parquet(f"{d}/conversations.parquet").select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), "conv_id", "turn", F.coalesce("text", F.lit("")).alias("text"))
    words = F.array_join(F.slice(textindex.terms_of(F.col("text")), 1, 8), " ")
    queries = c.where("conv_id % 100 = 0").select(F.col("id").alias("query_id"), words.alias("text"))
    found, _ = textindex.search(textindex.build(c), queries, 10)
    return found.select("query_id", "rank", F.col("id").alias("chunk_id"), F.round(F.col("score") / 1e9, 6).alias("score"))


def k7_hybrid(spark, d):
    """Ranks of the vector leg and of BM25 fused, twice as deep as the answer."""
    got = retrieve(spark, d, Query(mode="hybrid", vector=7, text="the and thanea", top_k=20, multiplier=2), "t1")
    return got.select("chunk_id", F.round("score", 9).alias("rrf"))


def k12_boundaries(spark, d):
    """Tenant or access list, dossier and version, all before scoring."""
    got = retrieve(spark, d, Query(vector=7, dossier=2, version=1, top_k=10), "t1")
    return got.select("chunk_id", F.round("score", 6).alias("score"))


def k13_acl_leaves(spark, d):
    """Chunks whose access list holds the tenant as a value at any depth; keys and longer words do not count."""
    return chunks(spark, d).where(F.exists(string_leaves(F.col("acl")), lambda v: v == "t1")).select("chunk_id")


def k14_inherited(spark, d):
    """Tenants of chunks: their own, else their document's."""
    return chunks(spark, d).groupBy("tenant").agg(F.count("*").alias("n"), F.countDistinct("document").alias("documents"))


def k15_best_per_document(spark, d):
    got = retrieve(spark, d, Query(vector=7, top_k=10, group_by_document=True), "t0")
    return got.select("chunk_id", "document", F.round("score", 6).alias("score"))


def k27_served(spark, d):
    """Tenant-forced retrieval over the later turns, with mail and IP addresses masked in the content."""
    got = served(spark, d, Query(mode="full_text", text="the and of in", top_k=50, where={"range": {"field": "ordinal", "gte": 1}}), "t2")
    return got.select("chunk_id", F.md5("content").alias("content_md5"), F.round("score", 6).alias("score"))


def k17_upsert(spark, d):
    """Documents replaced by external id: the old chunks of those ids go, the new ones come, the rest stays."""
    old = chunks(spark, d).select("document", "ordinal", "content")
    new = old.where("document % 3 = 0 and ordinal % 2 = 0").select("document", "ordinal", F.concat(F.lit("new "), "content").alias("content"))
    kept = old.join(new.select("document").distinct(), "document", "left_anti")
    return kept.unionByName(new).groupBy("document").agg(F.count("*").alias("chunks"), F.sum(F.char_length("content")).alias("chars"), F.max("ordinal").alias("last"))


def k24_reembedded(spark, d):
    """All vectors made anew (reversed and halved here) with the number of the revision."""
    e = spark.read.parquet(f"{d}/embeddings.parquet").select("vec_id", F.transform(F.reverse("embedding"), lambda x: x.cast("double") / 2).alias("v"))
    return e.select("vec_id", F.size("v").cast("long").alias("dim"), F.round(F.get("v", F.lit(0)), 6).alias("first"), F.lit(2).cast("long").alias("revision"))


def k26_side_fields(spark, d):
    """Sparse vectors whose indices ascend and pair with finite values, and multi-vectors of the size they claim."""
    e = spark.read.parquet(f"{d}/embeddings.parquet").select("vec_id", F.col("embedding").cast("array<double>").alias("v"))
    made = e.select("vec_id", F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: F.when(F.col("vec_id") % 7 == 0, i % 4).otherwise(i * 3)).alias("indices"), F.slice("v", 1, F.when(F.col("vec_id") % 5 == 0, 7).otherwise(8)).alias("values"), F.when(F.col("vec_id") % 6 == 0, 9).otherwise(8).alias("num_tokens"), F.lit(8).alias("dim"), F.size("v").alias("held"))
    ascending = ~F.exists(F.sequence(F.lit(1), F.size("indices") - 1), lambda i: F.get("indices", i) <= F.get("indices", i - 1))
    finite = ~F.exists("values", lambda x: x.isNull() | F.isnan(x))
    return made.select("vec_id", (ascending & (F.size("indices") == F.size("values")) & finite).alias("sparse_ok"), (F.col("num_tokens") * F.col("dim") == F.col("held")).alias("multi_ok"))


def k33_metadata(spark, d):
    """Metadata redacted as one JSON text, keys included; what does not parse any more is refused."""
    address = F.concat(F.lit("user"), F.col("event_id").cast("string"), F.lit("@mail.example.com"))
    meta = F.concat(F.lit('{"'), F.when(F.col("event_id") % 2 == 0, address).otherwise(F.lit("owner")), F.lit('":{"to":["'), address, F.lit('",'), F.when(F.col("event_id") % 10 == 3, F.lit("")).otherwise(F.lit("null")), F.lit("]}}"))
    m = spark.read.parquet(f"{d}/events.parquet").select("event_id", meta.alias("m")).withColumn("clean", S.redact(F.col("m"), S.detect(F.col("m"), SURE)))
    parsed = F.try_parse_json("clean").isNotNull()
    return m.select("event_id", F.when(parsed, F.col("clean")).alias("metadata"), parsed.alias("accepted"))


def k9_max_sim(spark, d):
    """Late interaction: vectors cut into eight tokens of eight numbers against those of one query; other sizes score 0."""
    cut = lambda v: F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: F.slice(v, i * 8 + 1, F.lit(8)))
    e = spark.read.parquet(f"{d}/embeddings.parquet").select("vec_id", F.col("embedding").cast("array<double>").alias("v"))
    both = e.crossJoin(F.broadcast(e.where("vec_id = 0").select(F.col("v").alias("q"))))  # one row
    best = F.aggregate(F.transform(cut(F.col("q")), lambda x: F.array_max(F.transform(cut(F.col("v")), lambda y: dot(x, y)))), F.lit(0.0), lambda s, x: s + x)
    return both.select("vec_id", F.round(F.when(F.size("v") == F.size("q"), best).otherwise(0.0), 6).alias("score"))


QUERIES = {
    "k2_distance_scores": k2_scores, "k4_all_terms": k4_all_terms, "k5_indexed_search": k5_indexed, "k7_hybrid_rrf": k7_hybrid, "k9_max_sim": k9_max_sim, "k12_boundaries": k12_boundaries, "k13_acl_leaves": k13_acl_leaves,
    "k14_inherited_tenants": k14_inherited, "k15_best_per_document": k15_best_per_document, "k17_upsert_documents": k17_upsert, "k24_reembedded": k24_reembedded,
    "k26_side_fields": k26_side_fields, "k27_served_retrieval": k27_served, "k33_metadata_redaction": k33_metadata,
}

CHUNKS = f"""c AS (SELECT conv_id AS document, turn AS ordinal, coalesce(text, '') AS content, conv_id * 1000 + turn AS chunk_id, conv_id % 4 AS dossier, conv_id % 2 + 1 AS version,
         CASE WHEN turn % 4 = 3 THEN 't1' ELSE 't' || (conv_id % 3) END AS tenant, conv_id % 5 = 0 AS shared, CAST(embedding AS DOUBLE[]) AS v FROM conversations JOIN embeddings ON vec_id = (conv_id * 31 + turn) % (SELECT count(*) FROM embeddings)),
  q AS (SELECT CAST(embedding AS DOUBLE[]) AS q FROM embeddings WHERE vec_id = 7)"""


def bm25_sql(source: str, terms: list[str], every: bool = False) -> str:
    tf = lambda t: f"count(*) FILTER (term = '{t}')"
    score = " + ".join(f"ln(1 + (n - df{i} + 0.5) / (df{i} + 0.5)) * tf{i} * 2.2 / (tf{i} + 1.2 * (0.25 + 0.75 * len / mean))" for i in range(len(terms)))
    keep = (" AND " if every else " OR ").join(f"tf{i} > 0" for i in range(len(terms)))
    return f"""w AS (SELECT chunk_id, unnest(regexp_extract_all(lower(content), '[a-z]+')) AS term FROM {source}),
  p AS (SELECT chunk_id, count(*) AS len, {", ".join(f"{tf(t)} AS tf{i}" for i, t in enumerate(terms))} FROM w GROUP BY 1),
  st AS (SELECT count(*) AS n, avg(len) AS mean, {", ".join(f"count(*) FILTER (tf{i} > 0) AS df{i}" for i in range(len(terms)))} FROM p),
  bm AS (SELECT chunk_id, {score} AS score FROM p, st WHERE {keep})"""


def mask_sql(text: str) -> str:
    return f"regexp_replace(regexp_replace({text}, '{MAIL}', '[EMAIL]', 'g'), '{SURE[1].regex}', '[IP]', 'g')"


ALLOWED = "(tenant = '{t}' OR ('{t}' = 't1' AND shared) OR ('{t}' = 't0' AND NOT shared))"
SQL = {
    "k2_distance_scores": "WITH q AS (SELECT CAST(embedding AS DOUBLE[]) AS q FROM embeddings WHERE vec_id = 7), v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings) SELECT vec_id, round(list_cosine_similarity(v, q), 6) AS cosine, round(list_inner_product(v, q), 6) AS inner, round(0 - list_distance(v, q), 6) AS euclid FROM v, q",
    "k4_all_terms": f"WITH {CHUNKS}, {bm25_sql('c', ['and', 'of', 'the'], True)} SELECT chunk_id, round(score, 6) AS score FROM bm",
    "k7_hybrid_rrf": f"""WITH {CHUNKS}, x AS (SELECT * FROM c WHERE {ALLOWED.format(t='t1')}), {bm25_sql('x', ['and', 'thanea', 'the'])},
        a AS (SELECT chunk_id, row_number() OVER (ORDER BY list_cosine_similarity(v, q) DESC, chunk_id) AS r FROM x, q QUALIFY r <= 40), b AS (SELECT chunk_id, row_number() OVER (ORDER BY score DESC, chunk_id) AS r FROM bm QUALIFY r <= 40),
        j AS (SELECT coalesce(a.chunk_id, b.chunk_id) AS chunk_id, coalesce(1 / (60 + a.r), 0) + coalesce(1 / (60 + b.r), 0) AS s FROM a FULL JOIN b ON a.chunk_id = b.chunk_id)
        SELECT chunk_id, round(s, 9) AS rrf FROM j ORDER BY s DESC, chunk_id LIMIT 20""",
    "k9_max_sim": """WITH q AS (SELECT CAST(embedding AS DOUBLE[]) AS q FROM embeddings WHERE vec_id = 0), v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings)
        SELECT vec_id, round(list_sum(list_transform(range(0, 8), lambda i: list_max(list_transform(range(0, 8), lambda j: list_inner_product(q[i * 8 + 1 : i * 8 + 8], v[j * 8 + 1 : j * 8 + 8]))))), 6) AS score FROM v, q""",
    "k12_boundaries": f"WITH {CHUNKS} SELECT chunk_id, round(list_cosine_similarity(v, q), 6) AS score FROM c, q WHERE {ALLOWED.format(t='t1')} AND dossier = 2 AND version = 1 ORDER BY list_cosine_similarity(v, q) DESC, chunk_id LIMIT 10",
    "k13_acl_leaves": f"WITH {CHUNKS} SELECT chunk_id FROM c WHERE shared",
    "k14_inherited_tenants": f"WITH {CHUNKS} SELECT tenant, count(*) AS n, count(DISTINCT document) AS documents FROM c GROUP BY 1",
    "k15_best_per_document": f"""WITH {CHUNKS}, s AS (SELECT chunk_id, document, list_cosine_similarity(v, q) AS score FROM c, q WHERE {ALLOWED.format(t='t0')}), b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY document ORDER BY score DESC, chunk_id) = 1)
        SELECT chunk_id, document, round(score, 6) AS score FROM b ORDER BY b.score DESC, chunk_id LIMIT 10""",
    "k17_upsert_documents": f"""WITH {CHUNKS}, n AS (SELECT document, ordinal, 'new ' || content AS content FROM c WHERE document % 3 = 0 AND ordinal % 2 = 0), u AS (SELECT document, ordinal, content FROM c WHERE document NOT IN (SELECT document FROM n) UNION ALL SELECT * FROM n)
        SELECT document, count(*) AS chunks, CAST(sum(length(content)) AS BIGINT) AS chars, max(ordinal) AS last FROM u GROUP BY 1""",
    "k24_reembedded": "SELECT vec_id, len(embedding) AS dim, round(CAST(embedding[len(embedding)] AS DOUBLE) / 2, 6) AS first, CAST(2 AS BIGINT) AS revision FROM embeddings",
    "k26_side_fields": "SELECT vec_id, vec_id % 7 <> 0 AND vec_id % 5 <> 0 AS sparse_ok, vec_id % 6 <> 0 AS multi_ok FROM embeddings",
    "k27_served_retrieval": f"WITH {CHUNKS}, x AS (SELECT * FROM c WHERE {ALLOWED.format(t='t2')} AND ordinal >= 1), {bm25_sql('x', ['and', 'in', 'of', 'the'])} SELECT chunk_id, md5({mask_sql('content')}) AS content_md5, round(score, 6) AS score FROM bm JOIN x USING (chunk_id) ORDER BY bm.score DESC, chunk_id LIMIT 50",
    "k33_metadata_redaction": """SELECT event_id, CASE WHEN event_id % 10 <> 3 THEN '{"' || CASE WHEN event_id % 2 = 0 THEN '[EMAIL]' ELSE 'owner' END || '":{"to":["[EMAIL]",null]}}' END AS metadata, event_id % 10 <> 3 AS accepted FROM events""",
    "k5_indexed_search": """WITH c AS (SELECT conv_id * 1000 + turn AS id, conv_id, regexp_extract_all(lower(coalesce(text, '')), '[a-z]+') AS w FROM conversations), t AS (SELECT id, unnest(w) AS term FROM c),
        f AS (SELECT id, term, count(*) AS tf FROM t GROUP BY 1, 2), l AS (SELECT id, sum(tf) AS len FROM f GROUP BY 1), s AS (SELECT count(*) AS n, avg(len) AS mean FROM l), d AS (SELECT term, count(*) AS df FROM f GROUP BY 1),
        w AS (SELECT id, term, CAST(round(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (1 - 0.75 + 0.75 * len / mean)) * 1e9) AS BIGINT) AS weight FROM f JOIN d USING (term) JOIN l USING (id), s),
        q AS (SELECT DISTINCT id AS query_id, unnest(w[1:8]) AS term FROM c WHERE conv_id % 100 = 0), r AS (SELECT query_id, id AS chunk_id, sum(weight) AS score FROM q JOIN w USING (term) GROUP BY 1, 2)
        SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS INTEGER) AS rank, chunk_id, round(CAST(score AS DOUBLE) / 1e9, 6) AS score FROM r QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) <= 10""",
}
