"""Expressions over payload bytes: chunks, entropy, hashes, shard keys. All but the counts of bytes, which numpy makes of Arrow batches, stay in the JVM."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

SEGMENT_SIZE = 4 << 20
ENTROPY_SAMPLE = 1024
ENTROPY_LIMIT = 7.5


def n_chunks(data: Column, size: int) -> Column:
    return F.ceil(F.octet_length(data) / F.lit(size)).cast("int")


def chunks(payloads: DataFrame, data: str = "data", size: int = SEGMENT_SIZE, keep_empty: bool = False) -> DataFrame:
    """``payloads`` with (pos, chunk) for ``data``: a narrow step. An empty or null payload has no chunk; with ``keep_empty`` it has one row, with nulls."""
    numbers = F.sequence(F.lit(0), n_chunks(F.col(data), size) - 1)
    if keep_empty:
        numbered = payloads.withColumn("pos", F.explode_outer(F.when(F.octet_length(data) > 0, numbers)))
    else:
        numbered = payloads.where(F.octet_length(data) > 0).withColumn("pos", F.explode(numbers))
    return numbered.withColumn("chunk", F.substring(F.col(data), F.col("pos") * size + 1, F.lit(size))).drop(data)


def content_hash(data: Column) -> Column:
    """SHA-256 in lower-case hex; equal bytes and only those are equal."""
    return F.sha2(data, 256)


def byte_counts(data: pa.Array) -> Iterator[np.ndarray]:
    """How often each byte value occurs in each value of a binary column; a null counts as empty."""
    offsets, raw = np.frombuffer(data.buffers()[1], dtype=np.int32 if pa.types.is_binary(data.type) else np.int64), data.buffers()[2]
    raw = np.frombuffer(raw, dtype=np.uint8) if raw is not None else np.zeros(0, dtype=np.uint8)
    offsets = offsets[data.offset : data.offset + len(data) + 1]
    for a, b, known in zip(offsets[:-1].tolist(), offsets[1:].tolist(), data.is_valid().to_pylist()):
        yield np.bincount(raw[a:b], minlength=256) if known else np.zeros(256, dtype=np.int64)


def bits_a_byte(counts: np.ndarray) -> float:
    """Shannon entropy in bits a byte, rounded to six places, halves up as SQL does; 0 for no bytes."""
    n, some = int(counts.sum()), counts[counts > 0].astype(float)
    return float(np.floor((np.log2(n) - (some * np.log2(some)).sum() / n) * 1e6 + 0.5)) / 1e6 + 0.0 if n else 0.0


def histogram(rows: DataFrame, key: list[str], data: str) -> DataFrame:
    """(key, byte, n): how often each byte value occurs; at most 256 rows a key. Counted in place, so that only counts move."""
    slim = rows.select(*key, F.col(data).cast("binary").alias("data"))
    kinds = [slim.schema[k] for k in key]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not key:
                total = sum(byte_counts(batch.column(0)), np.zeros(256, dtype=np.int64))
                some = np.flatnonzero(total)
                yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(total[some])], ["byte", "n"])
                continue
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                row, byte, n = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
                for i, counts in enumerate(byte_counts(part.column(len(key)))):
                    some = np.flatnonzero(counts)
                    row.append(np.full(len(some), i))
                    byte.append(some)
                    n.append(counts[some])
                at_row = pa.array(np.concatenate(row))
                yield pa.RecordBatch.from_arrays([*(part.column(i).take(at_row) for i in range(len(key))), pa.array(np.concatenate(byte).astype(np.int32)), pa.array(np.concatenate(n))], [*key, "byte", "n"])

    made = slim.mapInArrow(run, T.StructType([*kinds, T.StructField("byte", T.IntegerType()), T.StructField("n", T.LongType())]))
    return made.groupBy(*key, "byte").agg(F.sum("n").alias("n"))


def entropy_by(rows: DataFrame, key: list[str], data: str) -> DataFrame:
    """(key, n_bytes, entropy) over all rows of each key that has bytes, a row a key, a null key too: Shannon entropy in bits a byte, rounded to six places."""
    total = histogram(rows, key, data).groupBy(*key).agg(F.sum("n").alias("n_bytes"), F.sum(F.col("n") * F.log2("n")).alias("s"))
    return total.select(*key, "n_bytes", F.round(F.log2("n_bytes") - F.col("s") / F.col("n_bytes"), 6).alias("entropy"))


def entropy(rows: DataFrame, key: list[str], data: str) -> DataFrame:
    """(key, n_bytes, entropy) for each row: ``entropy_by`` its key; 0 for no bytes."""
    return rows.select(*key).join(entropy_by(rows, key, data), key, "left").fillna({"n_bytes": 0, "entropy": 0.0})


@F.arrow_udf(T.DoubleType())
def entropy_of(data: pa.Array) -> pa.Array:
    """The entropy of each value, in place, without a shuffle; 0 for a null or empty one."""
    return pa.array([bits_a_byte(c) for c in byte_counts(data)], pa.float64())


def looks_random(data: bytes) -> bool:
    """Payloads of at least 1 KiB whose first 1 KiB looks random aren't worth compressing."""
    return len(data) >= ENTROPY_SAMPLE and bits_a_byte(np.bincount(np.frombuffer(data, dtype=np.uint8, count=ENTROPY_SAMPLE), minlength=256)) >= ENTROPY_LIMIT


def skips_compression(data: Column) -> Column:
    """``looks_random`` of each payload; only its first 1 KiB goes to Python."""
    return (F.octet_length(data) >= ENTROPY_SAMPLE) & (entropy_of(F.substring(data, 1, ENTROPY_SAMPLE)) >= ENTROPY_LIMIT)


def ratio(original: Column, stored: Column) -> Column:
    return F.when(stored == 0, F.lit(1.0)).otherwise(original / stored)


def shard_keys(capsule_id: Column, count: Column) -> Column:
    """``count`` (at least 1) keys: the first eight bytes of the UUID, little-endian, plus 0, 1, ... modulo 2**64."""
    digits = F.substring(F.replace(capsule_id, F.lit("-"), F.lit("")), 1, 16)
    swapped = F.concat(*[F.substring(digits, 15 - 2 * i, 2) for i in range(8)])
    base = F.conv(swapped, 16, 10).cast("decimal(20,0)")
    return F.transform(F.sequence(F.lit(0), F.greatest(count, F.lit(1)) - 1), lambda i: F.pmod((base + i).cast("decimal(21,0)"), F.lit("18446744073709551616").cast("decimal(21,0)")).cast("decimal(20,0)"))
