"""A vault as a Python data sink: one Markdown file per document, registry and index lines, manifest and README, all or nothing.

``df.write.format("vault").mode("overwrite").save(path)`` for rows ``name, source, type, content, entities``. Tasks write below a
staging folder beside the target; what a failed or repeated attempt wrote is not named in any commit message and goes with the staging.
The commit writes the manifest, then renames the whole folder to its place: a reader sees all of the vault or nothing of it.

Index and registry have one file per task, so neither the driver nor one task ever holds them whole; the manifest names those
files with their line counts and digests.
"""

from __future__ import annotations

import hashlib
import json
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

from .mailbox import opened

ENTITIES = "array<struct<category:string,start:int,end:int,confidence:double>>"
SCHEMA = f"name string, source string, type string, content string, entities {ENTITIES}"
#: Bytes of documents that are read at once.
READ_BYTES = 4 << 20
README = """# Vault export

It holds {count} processed document(s).

- `documents/`: one redacted Markdown file per document, with its source, type, processing time and number of findings.
- `_index/documents-*.jsonl`: one line per document.
- `pii-registry/part-*.jsonl`: the findings of each document that has any, without their texts.
- `_manifest.json`: the files of index and registry with their lines and digests.
"""


@dataclass
class Written(WriterCommitMessage):
    """What one task has written: its folder, number of documents and findings, and (file, lines, sha256) of its index files."""

    folder: str
    documents: int = 0
    findings: int = 0
    files: list[tuple[str, int, str]] = field(default_factory=list)


def safe_name(name: str) -> str:
    """A file name of a document's name: letters, digits, dots and dashes stay."""
    return re.sub(r"[^\w.-]+", "-", name or "").strip(".-")[:120] or "document"


def markdown(row, processed: str) -> str:
    """A document's file: front matter and content."""
    head = {"source": row["source"] or "", "type": row["type"] or "unknown", "processed": processed, "pii_entities_found": str(len(row["entities"] or []))}
    lines = "".join(f"{k}: {quoted(v)}\n" for k, v in head.items())
    return f"---\n{lines}---\n\n{row['content'] or ''}\n"


def quoted(value: str) -> str:
    """A YAML scalar: as it is if plain, else in double quotes."""
    plain = re.fullmatch(r"[\w./+@-][\w./+@ :-]*[\w./+@-]|[\w./+@-]", value) and not re.search(r": |:$", value)
    return value if plain else json.dumps(value, ensure_ascii=False)


class Vault(DataSource):
    """Options: ``path``; ``processed``, the time written into every document."""

    @classmethod
    def name(cls) -> str:
        return "vault"

    def schema(self) -> str:
        return SCHEMA

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return VaultWriter(dict(self.options), overwrite)


class VaultWriter(DataSourceWriter):
    def __init__(self, options: dict, overwrite: bool):
        self.path, self.overwrite, self.processed = options["path"].rstrip("/"), overwrite, options.get("processed", "")
        self.staging = f"{self.path}.staging-{uuid.uuid4().hex}"

    def write(self, rows: Iterator) -> Written:
        task = TaskContext.get()
        mark = f"{task.partitionId():05d}-{task.taskAttemptId()}"
        system, root = opened(f"{self.staging}/{mark}")
        for name in ("documents", "_index", "pii-registry"):
            system.create_dir(f"{root}/{name}")
        done = Written(mark)
        index, registry = f"_index/documents-{task.partitionId():05d}.jsonl", f"pii-registry/part-{task.partitionId():05d}.jsonl"
        digests = {index: [0, hashlib.sha256()], registry: [0, hashlib.sha256()]}
        with system.open_output_stream(f"{root}/{index}") as documents, system.open_output_stream(f"{root}/{registry}") as found:

            def line(out, name: str, value: dict) -> None:
                raw = (json.dumps(value, ensure_ascii=False, separators=(",", ":")) + "\n").encode()
                out.write(raw)
                digests[name][0] += 1
                digests[name][1].update(raw)

            for row in rows:
                path = f"documents/{safe_name(row['name'])}-{hashlib.sha256(json.dumps([row['name'], row['source']]).encode()).hexdigest()[:12]}.md"
                with system.open_output_stream(f"{root}/{path}") as f:
                    f.write(markdown(row, self.processed).encode())
                spans = [x.asDict() for x in row["entities"] or []]
                line(documents, index, {"id": row["name"], "path": path, "pii_entities_found": len(spans)})
                if spans:
                    line(found, registry, {"document": path, "entities": spans})
                done.documents, done.findings = done.documents + 1, done.findings + len(spans)
        done.files = [(name, n, h.hexdigest()) for name, (n, h) in digests.items()]
        return done

    def commit(self, messages: list[Written | None]) -> None:
        system, root = opened(self.staging)
        target = opened(self.path)[1]
        made = f"{root}/vault"
        for name in ("documents", "_index", "pii-registry"):
            system.create_dir(f"{made}/{name}")
        told = [m for m in messages if m is not None]
        for m in told:  # files of one task, of the attempt that was committed
            for x in system.get_file_info(fs.FileSelector(f"{root}/{m.folder}", recursive=True)):
                if x.type == fs.FileType.File:
                    system.move(x.path, f"{made}/{x.path[len(f'{root}/{m.folder}/'):]}")
        count = sum(m.documents for m in told)
        files = [{"name": n, "lines": lines, "sha256": h} for m in told for n, lines, h in m.files]
        manifest = {"documents": count, "pii_entities_found": sum(m.findings for m in told), "generated": self.processed, "files": files}
        for name, text in (("_manifest.json", json.dumps(manifest, indent=2)), ("README.md", README.format(count=count))):
            with system.open_output_stream(f"{made}/{name}") as f:
                f.write(text.encode())
        there = system.get_file_info(target).type != fs.FileType.NotFound
        if there and not self.overwrite:
            system.delete_dir(root)
            raise FileExistsError(f"{self.path} is there; write with mode overwrite")
        if there:
            system.move(target, f"{root}/old")
        system.move(made, target)
        system.delete_dir(root)

    def abort(self, messages: list[Written | None]) -> None:
        system, root = opened(self.staging)
        if system.get_file_info(root).type != fs.FileType.NotFound:
            system.delete_dir(root)


def write_vault(rows: DataFrame, path: str, processed: str, overwrite: bool = True) -> None:
    """Write rows ``name, source, type, content, entities`` as a vault; with a time for all of them."""
    rows.sparkSession.dataSource.register(Vault)
    shaped = rows.select("name", "source", "type", "content", rows["entities"].cast(ENTITIES).alias("entities"))
    shaped.write.format("vault").option("processed", processed).mode("overwrite" if overwrite else "append").save(path)


def read_index(spark: SparkSession, path: str) -> DataFrame:
    """The document lines of a vault."""
    return spark.read.schema("id string, path string, pii_entities_found long").json(f"{path}/_index/documents-*.jsonl")


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """The document lines of a vault, each with its file's ``content``. Tasks open the files that the index names: the driver lists none of them."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = opened(path)
        for batch in batches:
            held, size, first = [], 0, 0
            for n, name in enumerate(batch.column("path").to_pylist()):
                with system.open_input_stream(f"{root}/{name}") as f:
                    held.append(f.read())
                size += len(held[-1])
                if size >= READ_BYTES or n == len(batch) - 1:
                    rows = batch.slice(first, len(held))
                    yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(held, pa.binary())], names=[*rows.schema.names, "content"])
                    held, size, first = [], 0, n + 1

    return read_index(spark, path).mapInArrow(each, "id string, path string, pii_entities_found long, content binary")
