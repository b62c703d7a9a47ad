import random
import re
import time
from collections import deque

import pytest
from pyspark.sql import functions as F

from veilspark.functions import spans as S
from veilspark.functions import validators as V
from veilspark.functions import json_text, pseudonyms
from veilspark.operators import audit, filters, quota
from veilspark.plans import corpus, redaction, registry, search

CASES = [
    ("write to a.b@example.org now", ["email"]),
    ("IBAN: FR7630006000011234567890189.", ["iban"]),
    ("IBAN: FR7630006000011234567890188.", []),
    ("SSN 123-45-6789 on file", ["ssn"]),
    ("SSN 000-45-6789 on file", []),
    ("card 4111 1111 1111 1111 charged", ["credit_card"]),
    ("host 203.0.113.42 up", ["ip_address"]),
    ("device 00:1A:2B:3C:4D:5E", ["mac_address"]),
    ("VIN 1HGCM82633A004352 here", ["vehicle_vin"]),
    ("nothing to see", []),
    ("call +1 415-555-0132 today", ["phone_number"]),
    ("tel (212) 555-0199", ["phone_number"]),
    ("see https://example.org/a?b=c now", ["url"]),
    ("token eyJhbGciOiJIUzI1NiJ9.eyJzdWIiOiIxMjM0NTY3ODkwIn0.dozjgNryP4J3jVmNHl0w5N_XgL0n3I9PlFUP0THsR8U", ["secret_token"]),
    ("x eyJhbGciOiJIUzI1NiJ9.eyJzdWIiOiIxMjM0NTY3ODkwIn0.dozjgNryP4J3jVmNHl0w5N_XgL0n3I9PlFUP0THsR8U", ["jwt_token"]),
    ("born 31/12/1980 in", ["date_of_birth"]),
    ("MRN: 12345678", ["medical_record_number"]),
    ("EIN 12-3456789", ["tax_id"]),
    ("pay 1A1zP1eP5QGefi2DMPTfTL5SLmv7DivfNa please", ["crypto_wallet"]),
    ("pay 1A1zP1eP5QGefi2DMPTfTL5SLmv7DivfNb please", []),
    ("2001:0db8:85a3:0000:0000:8a2e:0370:7334", ["ip_address"]),
    ("bank DEUTDEFF500 swift", ["swift_bic"]),
    ("api_key: abcdefghij0123456789xyz", ["api_key"]),
    ("card 4111 1111 1111 1112 charged", []),
    ("VIN 1HGCM82633A004353 here", []),
    (None, []),
    ("", []),
]


def test_detection(spark):
    df = spark.createDataFrame([(n, t) for n, (t, _) in enumerate(CASES)], "n int, t string")
    got = {r["n"]: [s["category"] for s in r["s"]] for r in df.select("n", S.detect(F.col("t")).alias("s")).collect()}
    assert got == {n: c for n, (_, c) in enumerate(CASES)}


def test_redaction_modes(spark):
    df = spark.createDataFrame([("é x@y.org, 10.0.0.1!",)], "t string")
    out = {m: df.select(S.redact(F.col("t"), S.detect(F.col("t")), m)).first()[0] for m in ("mask", "remove", "custom")}
    assert out == {"mask": "é [EMAIL], [IP]!", "remove": "é , !", "custom": "é [EMAIL], [IP_ADDRESS]!"}


def test_context_raises_confidence(spark):
    df = spark.createDataFrame([("my ssn is 123-45-6789",), ("number 123-45-6789",)], "t string")
    assert [r[0] for r in df.select(F.round(S.detect(F.col("t"))[0]["confidence"], 3)).collect()] == [0.75, 0.4]


def test_wallet_checksum(spark):
    df = spark.createDataFrame([("1A1zP1eP5QGefi2DMPTfTL5SLmv7DivfNa",), ("1A1zP1eP5QGefi2DMPTfTL5SLmv7DivfNb",), (None,)], "t string")
    assert [r[0] for r in df.select(V.wallet(F.col("t"))).collect()] == [True, False, None]


def test_chain_finds_tampering(spark):
    df = spark.range(50).withColumn("s", F.lit(1)).withColumn("x", F.col("id").cast("string"))
    body = audit.entry_body("id", ["x"])
    chained = audit.mint(df, "s", "id", body)
    assert audit.verify(chained, "s", "id", body).first()["first_bad"] is None
    assert audit.verify(chained.withColumn("x", F.when(F.col("id") == 7, "no").otherwise(F.col("x"))), "s", "id", body).first()["first_bad"] == 7


def test_rejected_requests_leave_no_trace():
    assert quota.admit([0, 10, 20, 60, 61], deque(), 2, 60.0) == [(True, 0), (True, 0), (False, 40), (True, 0), (False, 9)]


def test_filter_is_two_valued(spark):
    df = spark.createDataFrame([(1, None), (2, '{"k":"a"}')], "n int, metadata string")
    eq = {"eq": {"field": "metadata.k", "value": "a"}}
    keep = lambda f: [r["n"] for r in df.where(filters.compile_filter(f)).collect()]
    assert (keep(eq), keep({"not": eq}), keep({"in": {"field": "n", "values": []}}), keep({"and": []})) == ([2], [1], [], [1, 2])
    with pytest.raises(filters.FilterError):
        filters.validate({"and": [{"eq": {"field": "nope", "value": 1}}]}, {"n"})


def test_long_text_is_linear(spark):
    """Five times the text with thousands of spans does not take many times as long to detect and mask."""
    line = "ssn number 123-45-6789 and mail a.b@example.org from 10.0.0.1 of the account holder with many words around it. "
    took = []
    for times in (200, 200, 1000):
        df = spark.createDataFrame([(line * times,)], "t string").select("t", S.detect(F.col("t")).alias("s")).select(F.size("s").alias("n"), F.md5(S.redact(F.col("t"), F.col("s"))).alias("m"))
        began = time.perf_counter()
        assert df.first()["n"] == 3 * times
        took.append(time.perf_counter() - began)
    print("seconds", took)
    assert took[2] < 10 * took[1] + 5


def test_context_beyond_the_near_text(spark):
    """Five tokens before a span count, even where they lie far before it; a sixth does not."""
    far = " " * 400
    rows = [(f"ssn one two three four{far}123-45-6789", 0.75), (f"ssn one two three four five{far}123-45-6789", 0.4), ("SSN" + "-" * 300 + "123-45-6789", 0.75)]
    got = [r[0] for r in spark.createDataFrame(rows, "t string, w double").select(F.round(S.detect(F.col("t"))[0]["confidence"], 3)).collect()]
    assert got == [w for _, w in rows]


def test_chain_bytes(spark):
    """Hashes as plain Python makes them from bytes; where fields end cannot be moved."""
    import hashlib

    rows = [(0, "id0", "P1", "V1", None), (1, "id1", "P1V", "1", "m"), (2, "é", None, None, "x")]
    df = spark.createDataFrame([("s", *r) for r in rows], "segment string, seq long, id string, principal string, vertical string, model string")
    body = audit.entry_body("seq", ["id", "principal"], "vertical", "model")
    got, tip = {r["seq"]: r["chain_hash"] for r in audit.mint(df, "segment", "seq", body).collect()}, audit.GENESIS
    for seq, ident, principal, vertical, model in rows:
        raw = seq.to_bytes(8, "little") + ident.encode() + (principal or "").encode()
        for tag, x in ((b"\xff", vertical), (b"\xfe", model)):
            raw += b"" if x is None else tag + len(x.encode()).to_bytes(8, "little") + x.encode()
        tip = hashlib.sha256(tip.encode() + raw).hexdigest()
        assert got[seq] == tip


def test_history_refuses_unknown_cursors(spark):
    e = spark.createDataFrame([("a:b", n) for n in range(5)] + [("c", 0)], "segment string, seq long")
    counts = e.groupBy("segment").agg(F.count("*").alias("entries"))
    assert [tuple(r) for r in audit.history(e, counts, "a:b:2", 9).collect()] == [("a:b", 3), ("a:b", 4), ("c", 0)]
    for bad in ("x:0", "a:b:5", "a:b", "c:-1"):
        with pytest.raises(Exception, match="unknown cursor"):
            audit.history(e, counts, bad, 9).collect()


def test_tokens_open_under_their_key_only(spark):
    rows = [("email", "A.B@Example.org", "a.b@example.org"), ("phone_number", "+33 (0)1-23", "+330123"), ("person", "  Ann\n Lee ", "ann lee"), ("person", "", ""), ("person", "é" * 40, "é" * 40)]
    df = spark.createDataFrame(rows, "label string, v string, want string").withColumn("t", pseudonyms.token(F.col("label"), F.col("v"), "k1", "key one"))
    keys = {"k1": "key one", "k2": "key two"}
    for r in df.select("want", "t", pseudonyms.reveal(F.col("t"), keys).alias("got"), pseudonyms.reveal(F.col("t"), {"k1": "other"}).alias("other"), pseudonyms.reveal(F.replace("t", F.lit("PERSON"), F.lit("EMAIL")), keys).alias("moved")).collect():
        assert r["got"] == r["want"] and r["other"] is None and re.fullmatch(pseudonyms.TOKEN, r["t"])
        assert r["moved"] is None or "PERSON" not in r["t"]
    bad = spark.createDataFrame([("[EMAIL:k1:AAAA]",), ("nothing",), (None,), ("[EMAIL:k9:AAAA]",)], "t string")
    assert [r[0] for r in bad.select(pseudonyms.reveal(F.col("t"), keys)).collect()] == [None] * 4


def test_json_leaves_at_any_depth(spark):
    import json

    value = {"a@b.org": ["x@y.org", {"k": 'q"\\ z@w.org', "n": [1, None, True, {"deep": "v@v.org: {\"no\": 1}"}]}], "e": "", "u": "é\u2028"}
    df = spark.createDataFrame([(json.dumps(value, ensure_ascii=False),), ("{}",), ("[]",), ('"s@t.org"',)], "j string")
    got = [json.loads(r[0]) for r in df.select(redaction.json_leaves(F.col("j"), redaction.clean)).collect()]
    assert got[0] == {"a@b.org": ["[EMAIL]", {"k": 'q"\\ [EMAIL]', "n": [1, None, True, {"deep": '[EMAIL]: {"no": 1}'}]}], "e": "", "u": "é\u2028"}
    assert got[1:] == [{}, [], "[EMAIL]"]
    assert df.select(json_text.string_leaves(F.col("j")).alias("s")).first()["s"] == ["x@y.org", 'q"\\ z@w.org', 'v@v.org: {"no": 1}', "", "é\u2028"]


def test_query_limits():
    search.Query(vector=1, top_k=200, multiplier=20).check(64, 64)
    for bad in (search.Query(vector=1, top_k=0), search.Query(vector=1, top_k=201), search.Query(vector=1, multiplier=21), search.Query(), search.Query(mode="hybrid", vector=1, text=" "), search.Query(mode="other", vector=1)):
        with pytest.raises(search.QueryError):
            bad.check()
    with pytest.raises(search.QueryError):
        search.Query(vector=1).check(63, 64)


def test_provenance_and_names(spark):
    assert redaction.provenance("x", ["B", "a"]) == redaction.provenance("x", ["A", "b"]) != redaction.provenance("x", ["ab"])
    with pytest.raises(ValueError):
        redaction.provenance("x", [])
    df = spark.createDataFrame([("Maître Jean Dupont.", "ACME S.A.S.", "Été & Co!"), ("M. Dupont", "Sarl", "--")], "p string, o string, s string")
    got = df.select(registry.person_tokens(F.col("p")), registry.org_base(F.col("o")), registry.slug(F.col("s"))).collect()
    assert [tuple(r) for r in got] == [(["jean", "dupont"], "acme", "t-co"), (["dupont"], "sarl", "")]


def test_model_detector_rules(spark):
    docs = spark.createDataFrame([(1, "abc"), (2, ""), (3, None), (4, "x")], "doc_id long, text string")
    seen = lambda texts: [[("person", 0, 1, None), ("person", 1, 2, 0.5), ("city", 0, 1, 0.49), ("city", 0, 1, 0.9)] for _ in texts]
    got = sorted((r["doc_id"], r["category"], r["confidence"]) for r in redaction.model_spans(docs, seen, 0.5, ("person",)).collect())
    assert got == [(1, "person", 0.5), (1, "person", 1.0), (4, "person", 0.5), (4, "person", 1.0)]
