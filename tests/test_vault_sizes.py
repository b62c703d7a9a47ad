"""A vault is read without a list of its documents."""

import pytest

from veilspark.plans import exports
from veilspark.sources import vault


def test_documents_are_read_by_tasks(spark, sf, tmp_path, monkeypatch):
    """Files are opened where the index names them; content of many batches stays with its line; a file that is gone is an error."""
    found = exports.snk2_vault(spark, sf)
    assert found.count() == 200 and not any("/documents/" in x for x in found.inputFiles()) and "binaryFile" not in found._jdf.queryExecution().toString()
    monkeypatch.setattr(vault, "READ_BYTES", 100)
    df = spark.createDataFrame([(f"n{k}", "s", "t", f"é{k} " * k, []) for k in range(60)], vault.SCHEMA).repartition(3)
    vault.write_vault(df, str(tmp_path / "v"), "now")
    got = {r["id"]: (bytes(r["content"]), r["path"]) for r in vault.read_documents(spark, str(tmp_path / "v")).collect()}
    assert len(got) == 60 and all(got[f"n{k}"][0].decode().endswith(f"---\n\n{f'é{k} ' * k}\n") for k in range(60))
    (tmp_path / "v" / got["n7"][1]).write_text("changed")
    assert bytes(vault.read_documents(spark, str(tmp_path / "v")).where("id = 'n7'").first()["content"]) == b"changed"
    (tmp_path / "v" / "_index" / "documents-99999.jsonl").write_text('{"id":"x","path":"documents/none.md","pii_entities_found":0}\n')
    with pytest.raises(Exception, match="none.md"):
        vault.read_documents(spark, str(tmp_path / "v")).collect()
