"""A counting Bloom filter as a relation, and its sizing."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A filter of so many cells is broadcast as bits: 64 MB.
BITMAP_CELLS = 1 << 29
#: Items and rate of false answers that a filter is made for, unless told otherwise.
DEFAULT_ITEMS, DEFAULT_RATE = 10_000_000, 0.001


def sizing(items: Column, rate: Column) -> tuple[Column, Column]:
    """(cells, hash functions): ceil(-n ln p / ln2^2), at least 1024; ceil(cells / n ln2), at least 1; n at least 1, p in [1e-7, 0.25]."""
    n = F.greatest(items, F.lit(1)).cast("double")
    p = F.least(F.greatest(rate, F.lit(1e-7)), F.lit(0.25))
    cells = F.greatest(F.ceil(-n * F.log(p) / F.lit(math.log(2) ** 2)), F.lit(1024)).cast("bigint")
    return cells, F.greatest(F.ceil(cells / n * F.lit(math.log(2))), F.lit(1)).cast("int")


def size_of(items: int = DEFAULT_ITEMS, rate: float = DEFAULT_RATE) -> tuple[int, int]:
    n, p = max(items, 1), min(max(rate, 1e-7), 0.25)
    cells = max(1024, math.ceil(-n * math.log(p) / math.log(2) ** 2))
    return cells, max(1, math.ceil(cells / n * math.log(2)))


def indexes(key: Column, cells: int, hashes: int) -> Column:
    """Double hashing: (h1 + i h2) modulo the number of cells."""
    h1, h2 = F.xxhash64(key), F.xxhash64(key, F.lit("second"))
    a, b = F.pmod(h1, F.lit(cells)), F.pmod(h2, F.lit(cells - 1)) + 1
    return F.transform(F.sequence(F.lit(0), F.lit(hashes - 1)), lambda i: F.pmod(a + i * b, F.lit(cells)))


def build(keys: DataFrame, key: str, cells: int, hashes: int, removed: DataFrame | None = None) -> DataFrame:
    """(cell, n): counters from 1 to 255 after inserting ``keys`` and removing ``removed``; cells at 0 are left out."""
    added = keys.select(F.explode(indexes(F.col(key), cells, hashes)).alias("cell"), F.lit(1).alias("d"))
    if removed is not None:
        added = added.unionAll(removed.select(F.explode(indexes(F.col(key), cells, hashes)).alias("cell"), F.lit(-1).alias("d")))
    return added.groupBy("cell").agg(F.least(F.sum("d"), F.lit(255)).alias("n")).where("n > 0")


def bitmap(bloom: DataFrame, cells: int) -> bytes:
    """The cells in use as bits, the lowest first: cells / 8 bytes, packed by Spark a page at a time."""
    pages = bloom.select((F.col("cell") + 1).alias("c")).groupBy(F.bitmap_bucket_number("c").alias("page")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("c")).alias("bits"))
    whole = bytearray((cells // 32_768 + 1) * 4096)
    for r in pages.collect():
        at = (r["page"] - 1) * 4096
        whole[at : at + len(r["bits"])] = r["bits"]
    return bytes(whole)


def might_contain(probe: DataFrame, key: str, bloom: DataFrame, cells: int, hashes: int) -> DataFrame:
    """The rows of ``probe`` that may be in the filter; those left out surely aren't.

    A filter up to ``BITMAP_CELLS`` is broadcast as bits and tested in place, without a shuffle; a larger one is joined.
    """
    if cells <= BITMAP_CELLS:
        sent = probe.sparkSession.sparkContext.broadcast(bitmap(bloom, cells))

        @F.arrow_udf(T.BooleanType())
        def inside(at: pa.Array) -> pa.Array:
            bits, rows = np.frombuffer(sent.value, dtype=np.uint8), np.asarray(at.value_lengths().fill_null(0)).astype(np.int64)
            cell = np.asarray(at.flatten()).astype(np.int64)
            off = ((bits[cell >> 3] >> (cell & 7).astype(np.uint8)) & 1) == 0
            missing = np.bincount(np.repeat(np.arange(len(rows)), rows)[off], minlength=len(rows))
            return pa.array(missing == 0)

        return probe.where(inside(indexes(F.col(key), cells, hashes)))
    asked = probe.select(F.col(key).alias("__k")).distinct().select("__k", F.explode(F.array_distinct(indexes(F.col("__k"), cells, hashes))).alias("cell"))
    missing = asked.join(bloom, "cell", "left_anti").select("__k").distinct()
    return probe.join(missing, F.col(key) == F.col("__k"), "left_anti")


def stats(bloom: DataFrame, cells: int, hashes: int) -> DataFrame:
    """One row: cells, hash functions, cells in use and the rate of false answers to expect."""
    used = bloom.agg(F.count(F.lit(1)).alias("used"))
    return used.select(F.lit(cells).alias("cells"), F.lit(hashes).alias("hashes"), "used", F.round(F.pow(F.col("used") / cells, F.lit(hashes)), 9).alias("expected_fpr"))
