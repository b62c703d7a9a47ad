"""Mailboxes as a Python data source, in batch and as a stream: mbox files by byte ranges, maildirs and single messages.

``spark.dataSource.register(Mailbox)``, then ``spark.read.format("mailbox").load(path)``. Rows are ``path, start, content``:
one message each, ``start`` its first byte in the file. A folder may hold mbox files (their first bytes are ``From ``),
maildirs (``cur`` and ``new``; ``tmp`` is not read) and files of one message, at any depth; names with a leading ``_`` or ``.``
are left out. Paths are those of any file system that Arrow opens (local, ``hdfs://``, ``s3://``, ``gs://``).

A large mbox is read by many tasks: a range owns the messages that begin in it. The stream writes what each batch reads to a log
in ``stateLocation`` before the batch runs: a restart reads the same ranges again, and never a message twice.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

SCHEMA = "path string, start long, content binary"
MARK = b"From "
CHUNK = 1 << 20
SPLIT_BYTES, FILES_IN_TASK = 32 << 20, 500


@dataclass
class Span(InputPartition):
    """Pieces that one task reads: (path, first byte, end, whether the file is an mbox)."""

    pieces: list[tuple[str, int, int, bool]]


def opened(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def found(path: str) -> list[tuple[str, int]]:
    """Files below a path with their sizes, in order of their paths."""
    system, root = opened(path)
    top = system.get_file_info(root)
    infos = [top] if top.type == fs.FileType.File else system.get_file_info(fs.FileSelector(root, recursive=True))
    inside = lambda p: p[len(root) :].strip("/").split("/")
    kept = [x for x in infos if x.type == fs.FileType.File and not any(n.startswith(("_", ".")) or n == "tmp" for n in inside(x.path) if n)]
    return sorted((x.path, x.size) for x in kept)


def is_mbox(system: fs.FileSystem, path: str) -> bool:
    with system.open_input_file(path) as f:
        return f.read(len(MARK)) == MARK


def pieces_of(root: str, files: list[tuple[str, int, int]], split: int) -> Iterator[tuple[str, int, int, bool]]:
    """What is new in each (path, from, to), an mbox in ranges of about ``split`` bytes."""
    system, _ = opened(root)
    for path, low, high in files:
        if high <= low:
            continue
        if is_mbox(system, path):
            for a in range(low, high, split):
                yield path, a, min(high, a + split), True
        elif low == 0:
            yield path, 0, high, False


def grouped(pieces: Iterator[tuple[str, int, int, bool]], split: int) -> list[Span]:
    """Pieces in tasks of about ``split`` bytes and a bounded number of files."""
    out, now, size = [], [], 0
    for piece in pieces:
        if now and (size + piece[2] - piece[1] > split or len(now) >= FILES_IN_TASK):
            out.append(Span(now))
            now, size = [], 0
        now.append(piece)
        size += piece[2] - piece[1]
    return [*out, *([Span(now)] if now else [])]


def unescaped(message: bytes) -> bytes:
    """A message without its separator line, one ``>`` less before each quoted ``From ``, and without the blank line that ends it."""
    lines = message.split(b"\n")[1:]
    body = b"\n".join(x[1:] if x.startswith(b">") and x.lstrip(b">").startswith(MARK) else x for x in lines)
    return body[:-1] if body.endswith(b"\n\n") else body


def messages_in(f, low: int, high: int, size: int) -> Iterator[tuple[int, bytes]]:
    """Messages of an open mbox that begin from ``low`` up to ``high``: first byte and bytes; holds one message and a chunk."""
    at = low - 1  # a line's beginning is found by the line end before it; the file's own beginning counts as one
    f.seek(max(at, 0))
    held, start, cursor = bytearray(b"" if low else b"\n"), None, 0
    while True:
        chunk = f.read(min(CHUNK, size - at - len(held)))
        held += chunk
        while (hit := held.find(b"\n" + MARK, cursor)) >= 0:
            begin = at + hit + 1
            if start is not None:
                yield start, bytes(held[: hit + 1])
            if begin >= high:
                return
            held, at, start, cursor = held[hit + 1 :], begin, begin, 0
        if not chunk:
            if start is not None:
                yield start, bytes(held)
            return
        cursor = max(0, len(held) - len(MARK))
        if start is None:  # nothing of this range has begun: keep what could be the beginning of a mark
            held, at, cursor = held[cursor:], at + cursor, 0


def identity(path: str) -> str:
    """A file's name over its life: in a maildir messages move from ``new`` to ``cur`` and change their flags."""
    folder, _, name = path.rpartition("/")
    above, _, kind = folder.rpartition("/")
    return f"{above}//{name.partition(':2,')[0]}" if kind in ("cur", "new") else path


def rows_of(root: str, span: Span) -> Iterator[tuple[str, int, bytes]]:
    system, _ = opened(root)
    for path, low, high, box in span.pieces:
        with system.open_input_file(path) as f:
            if box:
                for start, raw in messages_in(f, low, high, f.size()):
                    yield path, start, unescaped(raw)
            else:
                yield path, 0, f.read()


class Mailbox(DataSource):
    """Options: ``path``; ``splitBytes``; for streams ``stateLocation`` and ``maxBytesPerBatch``."""

    @classmethod
    def name(cls) -> str:
        return "mailbox"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return MailReader(dict(self.options))

    def streamReader(self, schema) -> DataSourceStreamReader:
        return MailStream(dict(self.options))


class MailReader(DataSourceReader):
    def __init__(self, options: dict):
        self.root, self.split = options["path"], int(options.get("splitbytes", options.get("splitBytes", SPLIT_BYTES)))

    def partitions(self) -> list[Span]:
        return grouped(pieces_of(self.root, [(p, 0, n) for p, n in found(self.root)], self.split), self.split) or [Span([])]

    def read(self, partition: Span) -> Iterator[tuple]:
        return rows_of(self.root, partition)


class MailStream(DataSourceStreamReader):
    """Offsets are numbers of log entries; an entry lists what its batch reads as (path, from, to)."""

    def __init__(self, options: dict):
        self.root, self.split = options["path"], int(options.get("splitbytes", options.get("splitBytes", SPLIT_BYTES)))
        self.most = int(options.get("maxbytesperbatch", options.get("maxBytesPerBatch", 1 << 40)))
        self.log = options.get("statelocation", options.get("stateLocation"))
        if not self.log:
            raise ValueError("a mailbox stream needs a stateLocation")

    def entries(self) -> list[int]:
        system, folder = opened(self.log)
        if system.get_file_info(folder).type == fs.FileType.NotFound:
            return []
        names = [x.base_name for x in system.get_file_info(fs.FileSelector(folder))]
        return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json"))

    def entry(self, n: int) -> list[tuple[str, int, int]]:
        system, folder = opened(self.log)
        with system.open_input_stream(f"{folder}/{n}.json") as f:
            return [tuple(x) for x in json.loads(f.read())]

    def initialOffset(self) -> dict:
        return {"entry": 0}

    def latestOffset(self) -> dict:
        known = self.entries()
        read: dict[str, int] = {}
        for n in known:
            for path, _, high in self.entry(n):
                read[identity(path)] = max(high, read.get(identity(path), 0))
        more, size = [], 0
        for path, high in found(self.root):
            low = read.get(identity(path), 0)
            if high > low and size < self.most:
                more.append((path, low, high))
                size += high - low
        last = known[-1] if known else 0
        if more:
            last += 1
            system, folder = opened(self.log)
            system.create_dir(folder)
            with system.open_output_stream(f"{folder}/{last}.tmp") as f:
                f.write(json.dumps(more).encode())
            system.move(f"{folder}/{last}.tmp", f"{folder}/{last}.json")
        return {"entry": last}

    def partitions(self, start: dict, end: dict) -> list[Span]:
        pieces = (p for n in range(start["entry"] + 1, end["entry"] + 1) for p in pieces_of(self.root, self.entry(n), self.split))
        return grouped(pieces, self.split) or [Span([])]

    def read(self, partition: Span) -> Iterator[tuple]:
        return rows_of(self.root, partition)


def read_mailbox(spark: SparkSession, path: str, **options) -> DataFrame:
    """The messages below a path, one row each."""
    spark.dataSource.register(Mailbox)
    return spark.read.format("mailbox").options(**options).load(path)


def mailbox_stream(spark: SparkSession, path: str, state: str, **options) -> DataFrame:
    """The messages below a path as they arrive; ``state`` keeps what has been read."""
    spark.dataSource.register(Mailbox)
    return spark.readStream.format("mailbox").options(stateLocation=state, **options).load(path)
