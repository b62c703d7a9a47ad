import os
from datetime import UTC, datetime
from email.message import EmailMessage

from pyspark.sql import functions as F

from veilspark.sources import formats, mail
from veilspark.streaming import ingest


def message(n, attach=False):
    m = EmailMessage()
    m["From"], m["To"], m["Subject"] = "Ann <ann@example.org>", "bob@example.org, Cy <cy@example.org>", f"note {n}"
    m["Message-ID"], m["Date"] = f"<{n}@example.org>", f"Tue, 0{n} Jul 2025 10:00:00 +0000"
    m.set_content("write to dee@example.org\n")
    if attach:
        m.add_attachment("reach eve@example.org", filename="a.txt")
        m.add_attachment(b"\x00\x01", maintype="application", subtype="octet-stream", filename="b.bin")
    return m.as_bytes()


def test_files_and_mail(spark, tmp_path):
    for name, content in {"1.eml": message(1), "2.eml": message(2, True), "3.eml": b"no header", "4.eml": b"Date: never\n\nx", "p": b"%PDF-1.7 x", "h": b"<!DOCTYPE html><p>", "j": b' {"a": 1}', "t": b"plain", "z": b"\x00\x01"}.items():
        (tmp_path / name).write_bytes(content)
    kinds = {os.path.basename(r["path"]): r["kind"] for r in formats.read_files(spark, str(tmp_path)).select("path", "kind").collect()}
    assert kinds["p"] == "application/pdf" and kinds["h"] == "text/html" and kinds["j"] == "application/json" and kinds["t"] == "text/plain"
    assert kinds["z"] == "application/octet-stream" and "1.eml" in kinds and kinds["1.eml"] == "message/rfc822"
    assert spark.sql("SELECT unhex('') AS c UNION ALL SELECT NULL").select(formats.kind(F.col("c")).alias("k")).distinct().first()["k"] == "inode/x-empty"
    found = mail.messages(formats.read_files(spark, str(tmp_path), "*.eml"))
    rows = {os.path.basename(r["path"]): r for r in found.collect()}
    assert rows["1.eml"]["recipients"] == ["bob@example.org", "cy@example.org"] and rows["1.eml"]["sent"] == datetime(2025, 7, 1, 10)
    assert rows["3.eml"]["message_id"] is None and rows["4.eml"]["sent"] is None and len(rows) == 4
    assert mail.between(found, "2025-07-02").count() == 1 and mail.between(found, None, "2025-07-01T10:00:00Z").count() == 1
    assert mail.between(found, "1 days ago", now=datetime(2025, 7, 3, 9, tzinfo=UTC)).count() == 1 and mail.between(found).count() == 4
    parts = {r["name"]: r for r in mail.attachments(found).collect()}
    assert parts["a.txt"]["status"] == "redacted" and "eve@" not in parts["a.txt"]["text"] and parts["b.bin"]["status"] == "refused"
    texts = mail.records(found, "in").collect()
    assert len({r["external_id"] for r in texts}) == 4 and not any("dee@" in r["text"] for r in texts)


def test_incremental(spark, tmp_path):
    source, out, check = (str(tmp_path / x) for x in ("in", "out", "check"))
    schema = "doc_id long, text string"
    run = lambda: ingest.redact_into(ingest.documents(spark, source, schema), out, check).awaitTermination()
    spark.createDataFrame([(1, "a@example.org"), (1, "a@example.org"), (2, None)], schema).write.parquet(source)
    run()
    spark.createDataFrame([(2, "new"), (3, "")], schema).write.mode("append").parquet(source)
    run()
    run()
    assert sorted(map(tuple, ingest.latest(spark, out).select("doc_id", "text").collect())) == [(1, "[EMAIL]"), (2, "new"), (3, "")]


def test_rates_and_limit(spark, sf, tmp_path):
    events = spark.read.parquet(f"{sf}/events.parquet")
    folder = str(tmp_path / "events")
    events.repartition(3).write.parquet(folder)
    stream = spark.readStream.schema(events.schema).parquet(folder)
    ingest.rates(stream).writeStream.format("memory").queryName("rates").outputMode("complete").trigger(availableNow=True).start().awaitTermination()
    assert sorted(map(tuple, spark.table("rates").collect())) == sorted(map(tuple, ingest.rates(events).collect()))
    keyed = stream.select((F.col("user_id") % 5).alias("key"), "event_id", "ts")
    ingest.admitted(keyed, 2, 86_400.0).writeStream.format("memory").queryName("limit").outputMode("append").trigger(availableNow=True).start().awaitTermination()
    got, want, held = {r["event_id"]: r["admitted"] for r in spark.table("limit").collect()}, {}, {}
    for r in events.orderBy("ts", "event_id").collect():
        own = held[r["user_id"] % 5] = [x for x in held.get(r["user_id"] % 5, []) if r["ts"].timestamp() - x < 86_400]
        want[r["event_id"]] = len(own) < 2
        if want[r["event_id"]]:
            own.append(r["ts"].timestamp())
    assert got == want


def test_admission_state(spark, sf, tmp_path):
    """Two files, two batches, state and timers between them: verdicts and waits are those of one pass over all events."""
    from veilspark.operators import quota
    from veilspark.streaming import admission

    kept = spark.conf.get("spark.sql.streaming.stateStore.providerClass", None)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", admission.PROVIDER)
    try:
        events = spark.read.parquet(f"{sf}/events.parquet").select((F.col("user_id") % 4).cast("string").alias("tenant"), "event_id", F.col("ts").cast("timestamp").alias("ts"))
        folder, cut = str(tmp_path / "in"), events.selectExpr("percentile(unix_micros(ts), 0.5)").first()[0]
        events.where(F.unix_micros("ts") <= cut).coalesce(1).write.parquet(folder)
        events.where(F.unix_micros("ts") > cut).coalesce(1).write.mode("append").parquet(folder)
        stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).option("latestFirst", "false").parquet(folder)
        found = admission.admission(stream, 3, 43_200.0, late="1 hour")
        found.writeStream.format("memory").queryName("admission").outputMode("append").option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start().awaitTermination()
        got = sorted(map(tuple, spark.table("admission").select("tenant", "event_id", "admitted", "retry_after").collect()))
        want = quota.rate_limit(events.withColumnRenamed("tenant", "key"), 3, 43_200.0)
        assert got == sorted(map(tuple, want.select("key", "event_id", "admitted", "retry_after").collect()))
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass") if kept is None else spark.conf.set("spark.sql.streaming.stateStore.providerClass", kept)
