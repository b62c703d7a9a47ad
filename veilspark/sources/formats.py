"""Files of any kind as rows, with the kind told from their first bytes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The published signatures of file formats, as hexadecimal digits at the start of a file.
SIGNATURES = {
    "application/pdf": "255044462D",
    "image/png": "89504E470D0A1A0A",
    "image/jpeg": "FFD8FF",
    "image/gif": "47494638",
    "application/zip": "504B0304",
    "application/gzip": "1F8B",
    "application/x-ole-storage": "D0CF11E0A1B11AE1",
    "application/vnd.apache.parquet": "50415231",
    "text/rtf": "7B5C727466",
}


def kind(content: Column) -> Column:
    """MIME type of a binary column: by signature, then HTML, XML, JSON and mail by their text, else plain text or bytes.

    Null and empty content have the kind ``inode/x-empty``.
    """
    head = F.hex(F.substring(content, 1, 16))
    text = F.lower(F.ltrim(F.decode(F.substring(content, 1, 512), "ISO-8859-1")))
    found = F.when(content.isNull() | (F.octet_length(content) == 0), "inode/x-empty")
    for name, digits in SIGNATURES.items():
        found = found.when(F.startswith(head, F.lit(digits)), name)
    found = found.when(text.rlike("^(<!doctype html|<html)"), "text/html").when(F.startswith(text, F.lit("<?xml")), "application/xml").when(text.rlike(r"^[\[{]"), "application/json")
    found = found.when(text.rlike(r"^(from|received|return-path|message-id|date|subject|mime-version|delivered-to): "), "message/rfc822")
    return found.when(text.rlike(r"[\x00-\x08\x0e-\x1a]"), "application/octet-stream").otherwise("text/plain")


def read_files(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """Every file below ``path`` whose name matches: ``path, modified, length, content, kind``. Empty files have no row."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(path)
    return files.select("path", F.col("modificationTime").alias("modified"), "length", "content", kind(F.col("content")).alias("kind"))
