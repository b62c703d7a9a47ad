"""Tamper-evident audit chains: minted in order per segment, verified in parallel.

An entry's hash covers the previous hash, its sequence number (eight bytes, lowest
first) and its fields' bytes; vertical and model, where they are there, follow a tag byte and
their length. Seals cover a segment's tip, count and the seal before. Hashes are SHA-256.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

GENESIS = "0" * 64
# The bytes that stand before a vertical and before a model.
VERTICAL_TAG, MODEL_TAG = "FF", "FE"


def text_bytes(value: Column) -> Column:
    """The UTF-8 bytes of a value; null has none."""
    return F.coalesce(value.cast("string"), F.lit("")).cast("binary")


def le64(number: Column) -> Column:
    """A number as eight bytes, lowest first."""
    pairs = F.regexp_extract_all(F.lpad(F.hex(number.cast("long")), 16, "0"), F.lit("(..)"), F.lit(1))
    return F.unhex(F.array_join(F.reverse(pairs), ""))


def framed(value: Column) -> Column:
    """The bytes of a value after their number."""
    return F.concat(le64(F.octet_length(text_bytes(value))), text_bytes(value))


def tagged(value: Column, tag: str) -> Column:
    """Nothing for null, else a tag byte and the framed bytes."""
    return F.when(value.isNull(), F.unhex(F.lit(""))).otherwise(F.concat(F.unhex(F.lit(tag)), framed(value)))


def entry_body(seq: str, fields: list[str], vertical: str | None = None, model: str | None = None) -> Column:
    """What an entry's hash covers after the previous hash: number, fields in order, tagged vertical and model."""
    parts = [le64(F.col(seq)), *[text_bytes(F.col(c)) for c in fields]]
    parts += [tagged(F.col(c), tag) for c, tag in ((vertical, VERTICAL_TAG), (model, MODEL_TAG)) if c]
    return F.concat(*parts)


def link(previous: Column, body: Column) -> Column:
    """The hash of an entry after ``previous``."""
    return F.sha2(F.concat(previous.cast("binary"), body), 256)


def mint(entries: DataFrame, segment: str, seq: str, body: Column, parts: int | None = None) -> DataFrame:
    """``entries`` with ``chain_hash``, from the genesis hash per segment.

    Minting is sequential by nature: segments are dealt to partitions, each sorted and read
    once with nothing kept but the last hash, so a segment of any length needs no memory; rotate segments to spread work.
    """
    rows = entries.withColumn("_body", body)
    dealt = (rows.repartition(parts, segment) if parts else rows.repartition(segment)).sortWithinPartitions(segment, seq)
    names = entries.columns

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, tip = None, GENESIS
        for batch in batches:
            hashes = []
            for key, raw in zip(batch.column(segment).to_pylist(), batch.column("_body").to_pylist(), strict=True):
                tip = tip if (key,) == last else GENESIS
                tip, last = hashlib.sha256(tip.encode() + raw).hexdigest(), (key,)
                hashes.append(tip)
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in names], pa.array(hashes, pa.string())], names=[*names, "chain_hash"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in entries.schema.fields)
    return dealt.mapInArrow(each, f"{fields}, chain_hash string")


def verify(chained: DataFrame, segment: str, seq: str, body: Column) -> DataFrame:
    """Per segment: entries, the first bad ``seq`` (null if sound) and the tip. Each entry is checked against its stored predecessor."""
    before = F.lag("chain_hash", 1, GENESIS).over(Window.partitionBy(segment).orderBy(seq))
    checked = chained.withColumn("_bad", link(before, body) != F.col("chain_hash"))
    return checked.groupBy(segment).agg(F.count("*").alias("entries"), F.min(F.when(F.col("_bad"), F.col(seq))).alias("first_bad"), F.max_by("chain_hash", seq).alias("tip"))


def seal_rest(config_hash: str, node: str, segment: str, tenant: str, legacy: bool = False) -> Column:
    """A seal's bytes after the reference to the seal before; ``legacy`` ones did not cover the tenant."""
    fields = [F.col(segment), *([] if legacy else [F.col(tenant)]), F.lit(node), F.lit(config_hash), F.col("tip")]
    return F.concat(*[framed(c) for c in fields], le64(F.col("entries")), framed(F.col("opened_at")), framed(F.col("sealed_at")))


def seal_hash(previous: Column, rest: Column) -> Column:
    """The hash of a seal; without a seal before a zero byte stands for it."""
    known = F.concat(F.unhex(F.lit("01")), framed(previous))
    return F.sha2(F.concat(F.when(previous.isNull(), F.unhex(F.lit("00"))).otherwise(known), rest), 256)


def mint_seals(segments: DataFrame, tenant: str, order: str, rest: Column) -> DataFrame:
    """``segments`` with ``prev_seal_hash`` and ``seal_hash``, one chain per tenant in the given order."""
    rows = segments.withColumn("_rest", rest).repartition(tenant).sortWithinPartitions(tenant, order)
    names = segments.columns

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, tip = None, None
        for batch in batches:
            before, after = [], []
            for key, raw in zip(batch.column(tenant).to_pylist(), batch.column("_rest").to_pylist(), strict=True):
                tip = tip if (key,) == last else None
                before.append(tip)
                head = b"\0" if tip is None else b"\1" + len(tip).to_bytes(8, "little") + tip.encode()
                tip, last = hashlib.sha256(head + raw).hexdigest(), (key,)
                after.append(tip)
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in names], pa.array(before, pa.string()), pa.array(after, pa.string())], names=[*names, "prev_seal_hash", "seal_hash"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in segments.schema.fields)
    return rows.mapInArrow(each, f"{fields}, prev_seal_hash string, seal_hash string")


def verify_seal_chain(seals: DataFrame, tenant: str, order: str, rest: Column, legacy: Column) -> DataFrame:
    """``seals`` with ``intact`` and ``linked``: the hash is that of the fields, the seal before is the one named.

    The default tenant's seals may have the ``legacy`` hash.
    """
    before = F.lag("seal_hash").over(Window.partitionBy(tenant).orderBy(order))
    now, old = seal_hash(F.col("prev_seal_hash"), rest), seal_hash(F.col("prev_seal_hash"), legacy)
    intact = (F.col("seal_hash") == now) | ((F.col(tenant) == "default") & (F.col("seal_hash") == old))
    return seals.withColumn("intact", intact).withColumn("linked", F.col("prev_seal_hash").eqNullSafe(before))


def verify_seals(segments: DataFrame, seals: DataFrame) -> DataFrame:
    """Sealed segments whose count or tip differ from what their seal says."""
    return seals.alias("s").join(segments.alias("v"), "segment", "left").select("segment", F.coalesce((F.col("s.entry_count") == F.col("v.entries")) & F.col("s.tip").eqNullSafe(F.col("v.tip")) & F.col("v.first_bad").isNull(), F.lit(False)).alias("sound"))


def cursor(text: Column) -> Column:
    """``segment:index``, cut at the last colon, as ``struct(segment, index)``; null where the index is no number."""
    index = F.substring_index(text, ":", -1)
    segment = F.left(text, F.char_length(text) - F.char_length(index) - 1)
    sound = text.contains(":") & index.rlike("^[0-9]+$")
    return F.when(sound, F.struct(segment.alias("segment"), index.try_cast("long").alias("index")))


def history(entries: DataFrame, counts: DataFrame, after: str, limit: int) -> DataFrame:
    """A page of ``entries(segment, seq, ...)`` after a cursor, in the order of segment and number.

    ``counts(segment, entries)`` are the segments: a cursor that names none of them or an index that
    the segment lacks is an error, raised when the page is computed.
    """
    at = counts.select(F.count("*").alias("_one")).select(cursor(F.lit(after)).alias("at"))
    named = at.join(counts, F.col("at.segment") == F.col("segment").cast("string"), "left")
    bad = F.col("at").isNull() | F.col("entries").isNull() | (F.col("at.index") >= F.col("entries"))
    checked = named.select("segment", F.when(bad, F.raise_error(F.lit(f"unknown cursor {after}")).cast("long")).otherwise(F.col("at.index")).alias("index"))
    one = F.broadcast(checked.select(F.col("segment").alias("_s"), F.col("index").alias("_i")))  # one row
    later = (F.col("segment") > F.col("_s")) | ((F.col("segment") == F.col("_s")) & (F.col("seq") > F.col("_i")))
    return entries.join(one, later).drop("_s", "_i").orderBy("segment", "seq").limit(limit)


def csv_field(value: Column) -> Column:
    """A field of RFC 4180, quoted only where it holds a comma, a quote or a newline; null is empty."""
    v = F.coalesce(value.cast("string"), F.lit(""))
    return F.when(v.rlike('[,"\n]'), F.concat(F.lit('"'), F.replace(v, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(v)
