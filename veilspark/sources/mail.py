"""Mail archives: one row per message, its attachments, and a date range over them."""

from __future__ import annotations

import re
from collections.abc import Iterator
from datetime import UTC, datetime, timedelta
from email import message_from_bytes, policy
from email.utils import getaddresses, parsedate_to_datetime

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import spans as S

ATTACHMENT = "struct<name:string,type:string,size:long,text:string>"
MESSAGE = f"path string, message_id string, sent timestamp, sender string, recipients array<string>, subject string, body string, attachments array<{ATTACHMENT}>, error string"


def parsed(path: str, raw: bytes | None) -> dict:
    """One message as a row; what cannot be read is null and ``error`` says why."""
    row = dict.fromkeys(["message_id", "sent", "sender", "subject", "body", "error"]) | {"path": path, "recipients": [], "attachments": []}
    try:
        m = message_from_bytes(raw or b"", policy=policy.default)
        row["message_id"], row["subject"] = m["message-id"] and str(m["message-id"]).strip(), m["subject"] and str(m["subject"])
        row["sender"] = next((a for _, a in getaddresses([str(m["from"] or "")]) if a), None)
        row["recipients"] = [a for _, a in getaddresses([str(x) for h in ("to", "cc") for x in m.get_all(h, [])]) if a]
        if m["date"]:
            sent = parsedate_to_datetime(str(m["date"]))
            row["sent"] = (sent if sent.tzinfo else sent.replace(tzinfo=UTC)).astimezone(UTC).replace(tzinfo=None)
        body = m.get_body(("plain", "html"))
        row["body"] = body.get_content() if body is not None else ""
        for part in m.iter_attachments():
            content = part.get_payload(decode=True) or b""
            text = part.get_content() if part.get_content_maintype() == "text" else None
            row["attachments"].append({"name": part.get_filename(), "type": part.get_content_type(), "size": len(content), "text": text})
    except (ValueError, LookupError, TypeError, AttributeError) as problem:  # a malformed message is a row that says so
        row["error"] = f"{type(problem).__name__}: {problem}"[:200]
    return row


def messages(files: DataFrame) -> DataFrame:
    """Messages of ``files(path, content)``; null or empty content gives a message without fields."""
    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = ["path", "message_id", "sent", "sender", "recipients", "subject", "body", "attachments", "error"]
        for batch in batches:
            for at in range(0, len(batch), 100):  # messages can be large
                part = batch.iloc[at : at + 100]
                rows = pd.DataFrame([parsed(p, c) for p, c in zip(part["path"], part["content"], strict=True)], columns=names)
                rows["sent"] = pd.to_datetime(rows["sent"])
                yield rows

    return files.select("path", "content").mapInPandas(each, MESSAGE)


def instant(text: str, now: datetime | None = None) -> datetime:
    """A bound of a date range: RFC 3339, ``YYYY-MM-DD`` (midnight UTC) or ``N days ago``."""
    if ago := re.fullmatch(r"\s*(\d+)\s+days?\s+ago\s*", text):
        return (now or datetime.now(UTC)) - timedelta(days=int(ago[1]))
    found = datetime.fromisoformat(text.strip())
    return found if found.tzinfo else found.replace(tzinfo=UTC)


def between(mail: DataFrame, since: str | None = None, before: str | None = None, now: datetime | None = None, column: str = "sent") -> DataFrame:
    """Messages sent from ``since`` to ``before``, both inclusive; undated ones only without bounds."""
    for bound, keep in ((since, F.col(column).__ge__), (before, F.col(column).__le__)):
        if bound:
            mail = mail.where(keep(F.lit(instant(bound, now))))
    return mail


def attachments(mail: DataFrame) -> DataFrame:
    """One row per attachment with its text redacted; without readable text nothing is released (``refused``)."""
    a = mail.select("message_id", F.posexplode("attachments").alias("n", "a")).select("message_id", "n", "a.*")
    safe = F.when(F.col("text").isNotNull(), S.redact(F.col("text"), S.detect(F.col("text"))))
    return a.select("message_id", "n", "name", "type", "size", safe.alias("text"), F.when(F.col("text").isNull(), "refused").otherwise("redacted").alias("status"))


def records(mail: DataFrame, mailbox: str) -> DataFrame:
    """Messages as document rows: a stable external id, redacted subject and body."""
    key = F.coalesce("message_id", "path")
    clean = lambda c: S.redact(F.coalesce(c, F.lit("")), S.detect(c))
    return mail.select(F.concat(F.lit(f"{mailbox}:"), F.left(F.sha2(key, 256), F.lit(16))).alias("external_id"), "sent", clean(F.col("subject")).alias("subject"), clean(F.col("body")).alias("text"))
