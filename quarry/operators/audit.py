"""A hash-chained audit log.

hash = SHA-256(previous hash ‖ payload JSON ‖ time as 8 little-endian bytes), from 32 zero bytes. A chain is sequential by nature, so it is
folded per log: each log is one group, and logs run in parallel. Checking a chain isn't sequential: every record is checked against the one before
it with ``lag``.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

GENESIS = "0" * 64
TSA_BATCH = 100


def little_endian(n: Column) -> Column:
    """A bigint as 8 bytes, the lowest first."""
    digits = F.lpad(F.hex(n), 16, "0")
    return F.unhex(F.concat(*[F.substring(digits, 15 - 2 * i, 2) for i in range(8)]))


def record_hash(prev: Column, payload: Column, ts: Column) -> Column:
    return F.sha2(F.concat(F.unhex(prev), F.encode(payload, "UTF-8"), little_endian(ts)), 256)


def chain(events: DataFrame, log: str = "log_id", genesis: str = GENESIS) -> DataFrame:
    """``events(log, seq, event, payload, timestamp)`` with (prev_hash, hash), folded in order of ``seq`` within each log.

    Rows are sorted within partitions of whole logs and folded as they stream by, so a log of any length takes the memory of one batch.
    """
    own = events.select(log, "seq", "event", "payload", "timestamp")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in own.schema.fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        prev, current, begun = b"", None, False
        for batch in batches:
            before, after = [], []
            for name, payload, ts in zip(batch.column(0).to_pylist(), batch.column(3).to_pylist(), batch.column(4).to_pylist()):
                if not begun or name != current:
                    prev, current, begun = bytes.fromhex(genesis), name, True
                before.append(prev.hex())
                prev = hashlib.sha256(prev + (payload or "").encode() + (ts or 0).to_bytes(8, "little", signed=True)).digest()
                after.append(prev.hex())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(before, pa.string()), pa.array(after, pa.string())], [*batch.schema.names, "prev_hash", "hash"])

    return own.repartition(log).sortWithinPartitions(log, "seq").mapInArrow(run, f"{schema}, prev_hash string, hash string")


def verify(records: DataFrame, log: str = "log_id") -> DataFrame:
    """``records`` with (hash_ok, link_ok)."""
    w = W.partitionBy(log).orderBy("seq")
    return records.withColumns({"hash_ok": F.col("hash") == record_hash(F.col("prev_hash"), F.coalesce("payload", F.lit("")), F.coalesce("timestamp", F.lit(0))), "link_ok": F.col("prev_hash") == F.coalesce(F.lag("hash").over(w), F.lit(GENESIS))})


def trail(records: DataFrame, log: str = "log_id") -> DataFrame:
    """(log, last_seq, last_hash, last_tsa): where to go on after a restart."""
    return records.groupBy(log).agg(F.max("seq").alias("last_seq"), F.max_by("hash", "seq").alias("last_hash"), F.max(F.when(F.col("seq") % TSA_BATCH == 0, F.col("seq"))).alias("last_tsa"))


def tsa_marks(records: DataFrame, every: int = TSA_BATCH) -> DataFrame:
    """``records`` with ``tsa``: whether a timestamp is due, at each ``every``-th record, counted from 1."""
    return records.withColumn("tsa", F.col("seq") % every == 0)


def rotation(records: DataFrame, max_bytes: int, log: str = "log_id") -> DataFrame:
    """``records`` with the number of the file they are written to: after the write with which a file reaches ``max_bytes``, the next one begins.

    The bytes start anew with each file, so this is a fold, which streams by like the chain.
    """
    size = F.octet_length(F.to_json(F.struct(*records.columns))) + 1
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in records.schema.fields)
    at = records.columns.index(log)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        file, held, current, begun = 0, 0, None, False
        for batch in batches:
            files = []
            for name, n in zip(batch.column(at).to_pylist(), batch.column(batch.num_columns - 1).to_pylist()):
                if not begun or name != current:
                    file, held, current, begun = 0, 0, name, True
                files.append(file)
                held += n
                if 0 < max_bytes <= held:
                    file, held = file + 1, 0
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(files, pa.int32())], [*batch.schema.names[:-1], "file"])

    return records.withColumn("__bytes", size.cast("bigint")).repartition(log).sortWithinPartitions(log, "seq").mapInArrow(run, f"{schema}, file int")


def events(kind: str, rows: DataFrame, *fields: str) -> DataFrame:
    """(event, payload): rows as audit events of a kind."""
    return rows.select(F.lit(kind).alias("event"), F.to_json(F.struct(F.lit(kind).alias("event"), *fields)).alias("payload"))


def written(capsules: DataFrame, links: DataFrame, segments: DataFrame) -> DataFrame:
    """(event, payload) of written capsules, as ``capsule_written``, and of their segments: ``segment_appended``, or ``dedup_hit`` where an earlier reference had made the segment."""
    first = links.groupBy("segment_id").agg(F.min(F.struct("capsule_id", "pos")).alias("__first"))
    marked = links.join(first, "segment_id").join(segments.select("segment_id", "len", "content_hash"), "segment_id")
    own = (F.col("__first.capsule_id") == F.col("capsule_id")) & (F.col("__first.pos") == F.col("pos"))
    fields = ("capsule_id", "segment_id", "len", "content_hash")
    return events("capsule_written", capsules, "capsule_id", "size", F.col("segment_count").alias("segments")).unionAll(events("segment_appended", marked.where(own), *fields)).unionAll(events("dedup_hit", marked.where(~own), *fields))


def read(capsules: DataFrame) -> DataFrame:
    return events("capsule_read", capsules, "capsule_id", "size")


def deleted(capsules: DataFrame) -> DataFrame:
    return events("capsule_deleted", capsules, "capsule_id")
