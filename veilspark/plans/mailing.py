"""Mailboxes: conversations written as mbox files, read again by the mailbox source, and processed in steps, with SQL beside them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.shared import shared_folder
from ..sources import mail, mailbox, mailflow
from .facts import IP, MAIL, SURE


def as_mbox(turns: DataFrame) -> DataFrame:
    """Turns as messages of an mbox, one row of text each; every third has an attachment, every ninth one that is no text."""
    at, key = F.col("turn") + 1, F.concat_ws("-", "conv_id", "turn")
    body = F.regexp_replace(F.coalesce("text", F.lit("")), "(?m)^(>*From )", ">$1")
    head = F.concat(
        F.lit("From sender Thu Jan  1 00:00:00 2026\nFrom: "), F.coalesce("role", F.lit("nobody")), F.lit("@mail.example.org\nTo: desk@example.org, Ann <ann@example.org>\nSubject: about "), F.col("conv_id").cast("string"),
        F.lit("\nMessage-ID: <"), key, F.lit("@example.org>\nDate: Thu, 0"), at.cast("string"), F.lit(" Jan 2026 10:00:00 +0000\nMIME-Version: 1.0\n"))
    part = lambda kind: F.lit(f"Content-Type: {kind}; charset=utf-8\nContent-Transfer-Encoding: 8bit\n")
    one = F.concat(head, part("text/plain"), F.lit("\n"), body, F.lit("\n"))
    note = F.when(F.col("conv_id") % 9 == 0, F.concat(F.lit("Content-Type: application/octet-stream\nContent-Disposition: attachment; filename=\"b.bin\"\nContent-Transfer-Encoding: base64\n\nAAEC\n"))).otherwise(F.concat(part("text/plain"), F.lit("Content-Disposition: attachment; filename=\"a.txt\"\n\nwrite to u"), F.col("conv_id").cast("string"), F.lit("@example.net\n")))
    two = F.concat(head, F.lit("Content-Type: multipart/mixed; boundary=\"=_b\"\n\n--=_b\n"), part("text/plain"), F.lit("\n"), body, F.lit("\n--=_b\n"), note, F.lit("--=_b--\n"))
    return turns.select(F.when(F.col("conv_id") % 3 == 0, two).otherwise(one).alias("value"))


def written(spark, d) -> str:
    """A folder of mbox files with all turns."""
    folder = shared_folder(spark)
    as_mbox(spark.read.parquet(f"{d}/conversations.parquet").where("turn < 9")).write.text(folder)
    return folder


def read_messages(spark, d) -> DataFrame:
    raw = mailbox.read_mailbox(spark, written(spark, d), splitBytes=256 << 10)
    return mail.messages(raw.select(F.concat_ws("#", "path", "start").alias("path"), "content"))


def src3_messages(spark, d):
    """Every turn comes back as the message that it was written as."""
    body = F.md5(F.regexp_replace(F.col("body"), r"\n+$", ""))
    return read_messages(spark, d).select("message_id", "sender", F.size("recipients").cast("long").alias("recipients"), "subject", F.date_format("sent", "yyyy-MM-dd").alias("sent"), body.alias("body_md5"), F.size("attachments").cast("long").alias("attachments"), "error")


def m4_pipeline(spark, d):
    """What the steps make of each message: spans, chunks of the redacted body, attachments redacted and refused."""
    tables, _ = mailflow.run(read_messages(spark, d), "in", patterns=SURE)
    ids = tables["archive"].select("external_id", "status", F.md5(F.regexp_replace(F.col("body"), r"\n+$", "")).alias("body_md5"))
    count = lambda t, name, where=None: (t if where is None else t.where(where)).groupBy("external_id").agg(F.count("*").alias(name))
    out = ids
    for one in (count(tables["entities"], "spans"), count(tables["attachments"], "released", "status = 'redacted'"), count(tables["attachments"], "refused", "status = 'refused'")):
        out = out.join(one, "external_id", "left")
    return out.fillna(0, ["spans", "released", "refused"])


QUERIES = {"src3_mailbox_messages": src3_messages, "m4_mail_pipeline": m4_pipeline}

BODY = "regexp_replace(coalesce(text, ''), '\\n+$', '')"
SQL = {
    "src3_mailbox_messages": f"""SELECT '<' || conv_id || '-' || turn || '@example.org>' AS message_id, coalesce(role, 'nobody') || '@mail.example.org' AS sender, 2 AS recipients, 'about ' || conv_id AS subject, '2026-01-0' || (turn + 1) AS sent,
        md5({BODY}) AS body_md5, CASE WHEN conv_id % 3 = 0 THEN 1 ELSE 0 END AS attachments, NULL AS error FROM conversations WHERE turn < 9""",
    "m4_mail_pipeline": f"""WITH c AS (SELECT conv_id, 'in:' || left(sha256('<' || conv_id || '-' || turn || '@example.org>'), 16) AS external_id, {BODY} AS text FROM conversations WHERE turn < 9)
        SELECT external_id, 'redacted' AS status, md5(regexp_replace(regexp_replace(text, '{MAIL}', '[EMAIL]', 'g'), '{IP}', '[IP]', 'g')) AS body_md5, len(regexp_extract_all(text, '({MAIL}|{IP})')) AS spans,
        CASE WHEN conv_id % 3 = 0 AND conv_id % 9 <> 0 THEN 1 ELSE 0 END AS released, CASE WHEN conv_id % 9 = 0 THEN 1 ELSE 0 END AS refused FROM c""",
}
