"""Helpers shared by the training-data operators."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.shared import discard, materialize

#: A side of a join is broadcast only if its estimated size stays under this.
BROADCAST_LIMIT_BYTES = 64 << 20


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_side(df: DataFrame, rows: int, row_bytes: int = 64) -> DataFrame:
    """``df`` with a broadcast hint if ``rows`` of it are surely small, else as it is, for a shuffled join."""
    return F.broadcast(df) if rows * row_bytes <= BROADCAST_LIMIT_BYTES else df


def fresh(df: DataFrame, stem: str) -> str:
    """A column name that ``df`` doesn't have in any letter case."""
    taken = {c.lower() for c in df.columns}
    name, n = f"__{stem}", 0
    while name.lower() in taken:
        name, n = f"__{stem}{n}", n + 1
    return name


def bucket_labels(spark: SparkSession, n: int, kind: str = "int") -> np.ndarray:
    """For each of ``n`` partitions a number that Spark's hash, of its ``kind``, puts there, so that every bucket has a partition of its own."""
    tried = spark.range(0, 40 * n + 400, 1, 1).select(F.col("id").cast(kind).alias("b")).groupBy(F.pmod(F.hash("b"), F.lit(n)).alias("p")).agg(F.min("b").alias("b"))
    return np.array([r["b"] for r in tried.orderBy("p").collect()], dtype=np.int64)


def hex_bucket(value: Column, buckets: int) -> Column:
    """The first 32 bits of MD5 modulo ``buckets``: stable across engines, so an oracle can repeat it."""
    return F.conv(F.substring(F.md5(value), 1, 8), 16, 10).cast("bigint") % F.lit(buckets)


def connected_components(edges: DataFrame, name: str = "components") -> DataFrame:
    """(node, root) for every node of ``edges(a, b)``; root is the least node of its component.

    Alternating large-star and small-star rounds (Kiveris et al., 2014): a round moves every edge closer to the
    root, and the number of rounds grows with the logarithm of the component's size. Each round is written to the
    shared folder, so neither the plan nor the lineage grows. Hubs are joined, never collected into one row.
    """

    def star(e: DataFrame, large: bool) -> DataFrame:
        both = e.select(F.col("a").alias("u"), F.col("b").alias("v"))
        if large:
            both = both.unionAll(both.select(F.col("v").alias("u"), F.col("u").alias("v")))
        else:  # edges are stored with a > b: u's smaller neighbours
            pass
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("m", "u"))
        joined = both.join(least, "u")
        if large:
            out = joined.where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
        else:
            out = joined.select(F.col("v").alias("a"), F.col("m").alias("b")).unionAll(least.select(F.col("u").alias("a"), F.col("m").alias("b")))
        return out.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()

    def mark(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    e = materialize(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), name)
    seen = mark(e)
    while True:
        before, e = e, materialize(star(star(e, True), False), name)
        discard(before)
        now = mark(e)
        if now == seen:
            break
        seen = now
    return e.select(F.col("a").alias("node"), F.col("b").alias("root")).unionAll(e.select(F.col("b").alias("node"), F.col("b").alias("root"))).distinct()
