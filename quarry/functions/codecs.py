"""Compression as Arrow functions: LZ4 frames by pyarrow, Zstandard by its library. Each batch goes to Python once."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from quarry.errors import CompressionError, IntegrityError
from quarry.functions.payload import looks_random, ratio
from quarry.policies import codec_name


@lru_cache(maxsize=64)
def _codec(name: str):
    algo, _, level = name.partition(":")
    try:
        n = int(level) if level else None
    except ValueError:
        raise CompressionError(f"codec {name!r} has no numeric level") from None
    if algo == "identity":
        return bytes, lambda data: data
    if algo == "lz4":
        codec = pa.Codec("lz4", compression_level=n or 1)
        head = 8

        def shrink(data: bytes) -> bytes:
            return len(data).to_bytes(head, "little") + codec.compress(data, asbytes=True)

        def grow(data: bytes) -> bytes:
            return codec.decompress(data[head:], int.from_bytes(data[:head], "little"), asbytes=True)

        return shrink, grow
    if algo == "zstd":
        return zstandard.ZstdCompressor(level=3 if n is None else n).compress, zstandard.ZstdDecompressor().decompress
    raise CompressionError(f"codec {name!r} isn't known")


def compress(name: str, data: bytes) -> bytes:
    return _codec(name)[0](data)


def decompress(name: str, data: bytes) -> bytes:
    """The original bytes; an error for an unknown codec or bytes that aren't its output."""
    try:
        return _codec(name)[1](data)
    except (pa.ArrowException, zstandard.ZstdError, OSError) as e:
        raise CompressionError(f"{name} can't decode these bytes: {e}") from e


def _tried(data: bytes | None, codec: str | None) -> tuple[bytes | None, str | None, str | None]:
    """(stored, algo, reason): the entropy test, then the codec; what doesn't become smaller stays as it is."""
    if data is None:
        return None, None, None
    if codec == "identity":
        return data, codec, "no compression"
    if looks_random(data):
        return data, "identity", "high entropy"
    out = compress(codec, data)
    if len(out) >= len(data):
        return data, "identity", "not smaller"
    if decompress(codec, out) != data:
        raise IntegrityError(f"{codec} doesn't restore its input")
    return out, codec, None


def _values(*columns: pa.Array) -> Iterator[tuple]:
    """The rows of some columns as Python values, one at a time: a batch's payloads aren't held a second time."""
    return zip(*((x.as_py() for x in column) for column in columns))


_HOW = [T.StructField("algo", T.StringType()), T.StructField("reason", T.StringType())]


def _structs(rows: Iterator[tuple], of: T.StructType, mask: pa.Array | None = None) -> pa.Array:
    columns = list(zip(*rows)) or [()] * len(of.names)
    return pa.StructArray.from_arrays([pa.array(c, to_arrow_type(f.dataType)) for c, f in zip(columns, of.fields)], of.names, mask=mask)


_ATTEMPT = T.StructType([T.StructField("stored", T.BinaryType()), *_HOW])
_MEASURED = T.StructType([T.StructField("compressed_size", T.LongType()), *_HOW])
_VERIFIED = T.StructType([T.StructField("restored", T.BooleanType()), T.StructField("bytes", T.LongType())])


@F.arrow_udf(_ATTEMPT)
def _attempt(data: pa.Array, codec: pa.Array) -> pa.Array:
    """``_tried`` of each payload in one pass."""
    return _structs((_tried(d, c) for d, c in _values(data, codec)), _ATTEMPT, data.is_null())


@F.arrow_udf(_MEASURED)
def _measured(data: pa.Array, codec: pa.Array) -> pa.Array:
    """The same, with the size of what would be stored in the place of its bytes."""

    def rows() -> Iterator[tuple]:
        for d, c in _values(data, codec):
            stored, algo, reason = _tried(d, c)
            yield None if stored is None else len(stored), algo, reason

    return _structs(rows(), _MEASURED, data.is_null())


@F.arrow_udf(_VERIFIED)
def verified(data: pa.Array, codec: pa.Array) -> pa.Array:
    """Each payload stored and restored by what it was stored with: whether all bytes came back, and how many. A null comes back as one. No payload leaves Python."""

    def rows() -> Iterator[tuple]:
        for d, c in _values(data, codec):
            stored, algo, _ = _tried(d, c)
            back = None if stored is None else decompress(algo, stored)
            yield back == d, None if back is None else len(back)

    return _structs(rows(), _VERIFIED)


def restored(stored: str, algo: str) -> Column:
    """Decompress by each segment's own codec, never by guess. Bytes that no codec changed stay in the JVM."""
    as_is = F.col(algo) == "identity"
    return F.when(as_is, F.col(stored)).otherwise(_grown(F.when(as_is, F.lit(None)).otherwise(F.col(stored)), F.col(algo)))


@F.arrow_udf(T.BinaryType())
def _grown(stored: pa.Array, algo: pa.Array) -> pa.Array:
    return pa.array([None if s is None else decompress(a, s) for s, a in _values(stored, algo)], pa.binary())


def adaptive(rows: DataFrame, data: str = "chunk", algo: str = "comp_algo", level: str = "comp_level", keep_stored: bool = True) -> DataFrame:
    """``rows`` with (stored, algo, reason, original_size, compressed_size, ratio) for ``data``, which is dropped: one pass over Arrow batches.

    Without ``keep_stored`` the bytes themselves stay in Python and ``stored`` is left out. What no codec changes doesn't go to Python.
    """
    codec = codec_name(F.col(algo), F.col(level))
    as_is = codec == "identity"
    stored = F.col(data) if keep_stored else F.octet_length(data).cast("bigint")
    plain = F.when(F.col(data).isNotNull(), F.struct(stored.alias("stored" if keep_stored else "compressed_size"), codec.alias("algo"), F.lit("no compression").alias("reason")))
    tried = (_attempt if keep_stored else _measured)(F.when(as_is, F.lit(None)).otherwise(F.col(data)), codec)
    out = F.when(as_is, plain).otherwise(tried)
    done = rows.withColumn("__out", out).withColumns({"original_size": F.octet_length(data).cast("bigint")}).drop(data)
    both = done.select("*", "__out.*").drop("__out")
    if keep_stored:
        both = both.withColumn("compressed_size", F.octet_length("stored").cast("bigint"))
    return both.withColumn("ratio", F.round(ratio(F.col("original_size"), F.col("compressed_size")), 6))
