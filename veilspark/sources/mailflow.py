"""Mail processing in steps, each a table: archive, attachments, entities, index chunks, redacted messages; and ingestion watermarks.

Nothing unredacted is persisted: a text leaves only if the detector finds nothing in it any more, else its row says ``refused`` and
has no text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import spans as S
from ..functions.patterns import Pattern
from ..operators.shared import stored
from . import mail as M

STEPS = ("archive", "extract_attachments", "ner", "rag_index", "redact")
CHUNK = 512


def guarded(text: Column, patterns: list[Pattern] | None = None) -> Column:
    """``struct(text, status)``: the redacted text, or none and ``refused`` if there was no text or the detector still finds something."""
    found = (lambda t: S.detect(t, patterns)) if patterns else S.detect
    clean = S.redact(text, found(text))
    return F.when(text.isNull(), F.struct(F.lit(None).cast("string").alias("text"), F.lit("refused").alias("status"))).otherwise(
        S.let(clean, lambda c: F.when(F.size(found(c)) > 0, F.struct(F.lit(None).cast("string").alias("text"), F.lit("refused").alias("status"))).otherwise(F.struct(c.alias("text"), F.lit("redacted").alias("status")))))


def external_id(mailbox: str) -> Column:
    key = F.coalesce("message_id", "path")
    return F.concat(F.lit(f"{mailbox}:"), F.left(F.sha2(key, 256), F.lit(16)))


def archive(messages: DataFrame, mailbox: str, since: str | None = None, before: str | None = None) -> DataFrame:
    """Readable messages of a date range, each id once (the least path); the rest is told by ``error``."""
    kept = M.between(messages.where("error is null"), since, before)
    first = Window.partitionBy(F.coalesce("message_id", "path")).orderBy("path")
    return kept.withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n").withColumn("external_id", external_id(mailbox))


def processed(messages: DataFrame, steps: tuple[str, ...], patterns=None) -> DataFrame:
    """One row per message with all that ``steps`` say of it, so that a message is read and searched once: redacted subject and body or
    ``refused``, spans of the body without their texts, attachments with their redacted text or ``refused``."""
    body = F.coalesce("body", F.lit(""))
    both = messages.withColumn("_s", guarded(F.coalesce("subject", F.lit("")), patterns)).withColumn("_b", guarded(body, patterns))
    ok = (F.col("_s.status") == "redacted") & (F.col("_b.status") == "redacted")
    made = [F.when(ok, F.col("_s.text")).alias("subject"), F.when(ok, F.col("_b.text")).alias("body"), F.when(ok, "redacted").otherwise("refused").alias("status")]
    if "ner" in steps:
        made.append(F.transform(S.detect(body, patterns) if patterns else S.detect(body), lambda s: F.struct(s["category"].alias("category"), s["start"].alias("start"), s["end"].alias("end"), s["confidence"].alias("confidence"))).alias("spans"))
    if "extract_attachments" in steps:
        safe = lambda a: S.let(guarded(a["text"], patterns), lambda g: F.struct(a["name"].alias("name"), a["type"].alias("type"), a["size"].alias("size"), g["text"].alias("text"), g["status"].alias("status")))
        made.append(F.transform("attachments", safe).alias("attachments"))
    return both.select("external_id", "sent", *made)


def attachments(done: DataFrame) -> DataFrame:
    """One row per attachment of ``processed`` messages: redacted text, or refused."""
    return done.select("external_id", F.posexplode("attachments").alias("n", "a")).select("external_id", "n", "a.*")


def entities(done: DataFrame) -> DataFrame:
    """Spans of each body of ``processed`` messages, without their texts."""
    return done.select("external_id", F.explode("spans").alias("s")).select("external_id", "s.*")


def redacted(done: DataFrame) -> DataFrame:
    """Subject and body of ``processed`` messages redacted, or refused."""
    return done.select("external_id", "sent", "subject", "body", "status")


def index_chunks(clean: DataFrame, size: int = CHUNK) -> DataFrame:
    """Redacted bodies in chunks: ``external_id, ordinal, content``; refused messages have none."""
    starts = F.sequence(F.lit(0), F.greatest(F.char_length("body") - 1, F.lit(0)), F.lit(size))
    rows = clean.where("status = 'redacted'").select("external_id", F.posexplode(F.transform(starts, lambda a: F.substring("body", a + 1, F.lit(size)))).alias("ordinal", "content"))
    return rows


def run(messages: DataFrame, mailbox: str, steps: tuple[str, ...] = STEPS, out: str | None = None, patterns=None) -> tuple[dict[str, DataFrame], dict]:
    """The tables of ``steps`` over ``messages`` (of ``mail.messages``), written below ``out`` if given, and the response with its counts.

    Archive comes first in effect: later steps take what it kept. Unknown steps are an error before anything is written.
    """
    if unknown := [s for s in steps if s not in STEPS]:
        raise ValueError(f"unknown steps {unknown}")
    kept = archive(messages, mailbox) if "archive" in steps else messages.where("error is null").withColumn("external_id", external_id(mailbox))
    done = stored(processed(kept, steps, patterns))  # nothing unredacted is in it
    tables: dict[str, DataFrame] = {}

    def keep(name: str, made: DataFrame) -> DataFrame:
        if out:
            made.write.mode("overwrite").parquet(f"{out}/{name}")
            made = made.sparkSession.read.schema(made.schema).parquet(f"{out}/{name}")
        tables[name] = made
        return made

    clean = None
    for step in steps:
        if step == "archive":
            clean = keep("archive", redacted(done))
        elif step == "extract_attachments":
            keep("attachments", attachments(done))
        elif step == "ner":
            keep("entities", entities(done))
        elif step == "rag_index":
            keep("chunks", index_chunks(clean if clean is not None else redacted(done)))
        else:
            keep("redacted", redacted(done))
    counts = {k: t.count() for k, t in tables.items()} if out else {}
    failed = [r["error"] for r in messages.where("error is not null").select("error").distinct().limit(100).collect()] if out else []
    return tables, {"success": not failed, "counts": counts, "errors": failed}


def write_watermark(spark: SparkSession, folder: str, account: str, mailbox: str, index: str, last: int) -> None:
    """Remember the highest number ingested for an account, mailbox and index; it never falls."""
    spark.createDataFrame([(account, mailbox, index, last)], "account string, mailbox string, index string, last long").write.mode("append").parquet(folder)


def read_watermark(spark: SparkSession, folder: str, account: str, mailbox: str, index: str) -> int:
    """The watermark of just this account, mailbox and index, 0 if there is none; a folder that cannot be read is an error, not a beginning."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return 0
    same = (F.col("account") == account) & (F.col("mailbox") == mailbox) & (F.col("index") == index)
    return spark.read.parquet(folder).where(same).agg(F.max("last")).first()[0] or 0
