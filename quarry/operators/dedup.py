"""Inline deduplication as relations: one shuffle by content hash, payloads left out wherever only identity counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quarry.shared import materialize


def first_writer(chunks: DataFrame, order: list[str], key: str = "content_hash") -> DataFrame:
    """``chunks`` with ``is_first``: whether the chunk is the first of its hash in ``order``."""
    w = W.partitionBy(key).orderBy(*order)
    return chunks.withColumn("is_first", F.row_number().over(w) == 1)


def disposition(batch: DataFrame, store: DataFrame, order: list[str]) -> DataFrame:
    """``batch`` with ``disposition``: ``persistent`` if the store has the hash, else ``new`` for the first of the batch and ``staged`` for the rest."""
    known = store.select("content_hash").distinct().withColumn("known", F.lit(True))
    marked = first_writer(batch, order).join(known, "content_hash", "left")
    return marked.withColumn("disposition", F.when(F.col("known"), "persistent").when(F.col("is_first"), "new").otherwise("staged")).drop("known")


def lookup_hits(batch: DataFrame, store: DataFrame) -> DataFrame:
    return batch.join(store, "content_hash", "left_semi")


def lookup_misses(batch: DataFrame, store: DataFrame) -> DataFrame:
    return batch.join(store, "content_hash", "left_anti")


def stats(chunks: DataFrame, *by: str) -> DataFrame:
    """Per group: chunks, distinct chunks, bytes, bytes saved and chunks / distinct chunks.

    The second step sums over distinct hashes, so there is no distinct aggregate and no row but one a hash and group after the first shuffle.
    """
    each = chunks.groupBy(*by, "content_hash").agg(F.count(F.lit(1)).alias("refs"), F.first("len").alias("len"))
    return each.groupBy(*by).agg(
        F.sum("refs").alias("total_chunks"),
        F.count(F.lit(1)).alias("unique_chunks"),
        F.sum(F.col("refs") * F.col("len")).cast("bigint").alias("total_bytes"),
        F.sum((F.col("refs") - 1) * F.col("len")).cast("bigint").alias("bytes_saved"),
        F.round(F.sum("refs") / F.count(F.lit(1)), 6).alias("dedup_ratio"),
    )


def saved_ratio(total_segments: Column, bytes_saved: Column, segment_size: int) -> Column:
    """T / (T - saved) for T segments of full size if anything was saved, else 0."""
    t = total_segments * F.lit(segment_size)
    return F.when(bytes_saved > 0, t / (t - bytes_saved)).otherwise(F.lit(0.0))


def collisions(chunks: DataFrame, data: str = "chunk") -> DataFrame:
    """Hashes that stand for different bytes: a check that should find nothing."""
    return chunks.groupBy("content_hash").agg(F.countDistinct(F.xxhash64(data), F.octet_length(data)).alias("variants")).where("variants > 1")


def dense_ids(firsts: DataFrame, order: list[str], start: int = 0, into: str = "segment_id", buckets: int | None = None) -> DataFrame:
    """``firsts`` with numbers without gaps in ``order``.

    A global window would bring every row to one task. Here rows are range-partitioned and sorted, each partition counted, and the running
    sums of these few counts added: what is ordered on one task is one row a partition. The partitioned rows are written to the shared folder first: ranges come
    from a sample, so that two readings of the plan could cut them differently. There are as many partitions as the session's shuffles have, unless told otherwise.
    """
    buckets = buckets or int(firsts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = materialize(firsts.repartitionByRange(buckets, *order).withColumn("__p", F.spark_partition_id()), "dense-ids")
    local = ranged.withColumn("__n", F.row_number().over(W.partitionBy("__p").orderBy(*order)))
    sizes = local.groupBy("__p").agg(F.count(F.lit(1)).alias("__c"))
    before = sizes.select("__p", (F.sum("__c").over(W.orderBy("__p").rowsBetween(W.unboundedPreceding, -1))).alias("__b"))
    return local.join(F.broadcast(before), "__p").withColumn(into, (F.coalesce("__b", F.lit(0)) + F.col("__n") - 1 + start).cast("bigint")).drop("__p", "__n", "__b")


def running_offset(segments: DataFrame, order: str = "segment_id", size: str = "len", span: int = 1 << 16) -> DataFrame:
    """``segments`` with ``offset``: the bytes of all segments before, in order of a dense id.

    Ids are cut into spans; a window runs within each span, and another over one row a span.
    """
    cut = segments.withColumn("__s", F.floor(F.col(order) / span))
    sums = cut.groupBy("__s").agg(F.sum(size).alias("__t"))
    before = sums.select("__s", F.coalesce(F.sum("__t").over(W.orderBy("__s").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("__b"))
    inner = F.coalesce(F.sum(size).over(W.partitionBy("__s").orderBy(order).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return cut.withColumn("__i", inner).join(before, "__s").withColumn("offset", (F.col("__b") + F.col("__i")).cast("bigint")).drop("__s", "__i", "__b")
