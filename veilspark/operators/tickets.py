"""Reveal tickets: who may mint one, and what becomes of every attempt to use one.

A ticket names documents, and tokens or categories; it opens once, for its subject, before it expires or is
revoked. An attempt outside its scope does not use it up.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# Bounds of a ticket's life in seconds, and categories whose disclosure needs two approvers.
LEAST_SECONDS, MOST_SECONDS = 1, 600
HIGH_SENSITIVITY = [
    "SSN", "NATIONALID", "TAXID", "PASSPORTNUMBER", "DRIVERSLICENSE", "GOVERNMENTID", "IBAN", "BANKACCOUNT", "ROUTINGNUMBER", "SWIFTBIC", "CREDITCARD", "PAYMENTCARD",
    "CARDEXPIRY", "CARDCVV", "CRYPTOWALLET", "MEDICALRECORDNUMBER", "HEALTHPLANNUMBER", "DIAGNOSIS", "MEDICATION", "DATEOFBIRTH", "PASSWORD", "APIKEY", "SECRETTOKEN", "JWTTOKEN",
]
APPROVERS = 2


def category(token: Column) -> Column:
    """The category of ``[CATEGORY:key:body]``, null for any other shape."""
    inner = F.regexp_extract(token, r"(?s)^\[([^:]+):[^:]+:.+\]$", 1)
    return F.when(inner != "", inner)


def sensitive(tokens: Column, fields: Column) -> Column:
    """Whether a scope touches a category of high sensitivity."""
    high = lambda c: F.coalesce(F.upper(c).isin(*HIGH_SENSITIVITY), F.lit(False))
    return F.exists(F.coalesce(tokens, F.array()), lambda t: high(category(t))) | F.exists(F.coalesce(fields, F.array()), high)


def minted(requests: DataFrame, most: int = MOST_SECONDS) -> DataFrame:
    """Requests with ``expires_at`` (micros) and ``refused``: null, or why there is no ticket.

    ``ttl`` seconds are clamped to the bounds, null to the greatest. A scope of high sensitivity needs two distinct approvers. A request without documents, without tokens and
    fields, or without a justification is invalid.
    """
    ttl = F.greatest(F.least(F.coalesce("ttl", F.lit(most)), F.lit(most)), F.lit(LEAST_SECONDS))
    empty = lambda c: F.coalesce(F.size(c), F.lit(0)) <= 0
    invalid = empty("document_ids") | (empty("token_ids") & empty("field_scope")) | (F.trim(F.coalesce("justification", F.lit(""))) == "")
    few = sensitive(F.col("token_ids"), F.col("field_scope")) & (F.size(F.array_distinct(F.coalesce("approvers", F.array().cast("array<string>")))) < APPROVERS)
    return requests.withColumn("expires_at", F.col("at") + ttl.cast("long") * 1_000_000).withColumn("refused", F.when(invalid, "invalid_request").when(few, "insufficient_approvers"))


def resolved(tickets: DataFrame, attempts: DataFrame, revocations: DataFrame) -> DataFrame:
    """The outcome of ``attempts(attempt_id, tenant, ticket_id, principal, document_id, token, at)``.

    In this order: not_found, not_holder, consumed, revoked, expired, scope_violation, revealed. ``tickets`` are ``minted`` rows (``ticket_id, tenant,
    subject, at`` and scope); those refused do not exist. ``revocations(tenant, ticket_id, at)`` of a used ticket fail. Attempts of one time follow their ids.
    """
    t = tickets.where("refused is null").select("tenant", "ticket_id", "subject", F.col("at").alias("minted_at"), "expires_at", "document_ids", "token_ids", "field_scope")
    r = revocations.groupBy("tenant", "ticket_id").agg(F.min("at").alias("revoked_at"))
    rows = attempts.join(t, ["tenant", "ticket_id"], "left").join(r, ["tenant", "ticket_id"], "left")
    there = F.col("minted_at").isNotNull() & (F.col("at") >= F.col("minted_at"))
    holder = F.col("principal").eqNullSafe(F.col("subject"))
    scope = lambda c, x: F.coalesce(F.array_contains(c, x), F.lit(False))
    covered = scope("document_ids", F.col("document_id")) & (scope("token_ids", F.col("token")) | scope("field_scope", category(F.col("token"))))
    revoked, expired = F.coalesce(F.col("at") >= F.col("revoked_at"), F.lit(False)), F.col("at") >= F.col("expires_at")
    rows = rows.withColumn("able", there & holder & covered & ~revoked & ~expired)
    first = F.min(F.when(F.col("able"), F.struct("at", "attempt_id"))).over(Window.partitionBy("tenant", "ticket_id"))
    rows = rows.withColumn("used", first)
    later = F.coalesce(F.struct("at", "attempt_id") > F.col("used"), F.lit(False))
    said = F.when(~there, "not_found").when(~holder, "not_holder").when(later, "consumed").when(revoked, "revoked").when(expired, "expired").when(~covered, "scope_violation").otherwise("revealed")
    return rows.select("attempt_id", "ticket_id", F.coalesce(said, F.lit("not_found")).alias("outcome"))
