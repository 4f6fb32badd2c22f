"""Zone plans: where segments of a payload lie, by layout strategy."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quarry.errors import QuarryError

STRATEGIES = ("fixed", "entropy", "quantum")


def fixed_zones(segments: DataFrame, zone_size: int, by: str = "capsule_id") -> DataFrame:
    """``segments(by, pos, len)`` of equal size with (zone, zone_offset, iv_seed): a zone is full at ``zone_size``."""
    start = F.coalesce(F.sum("len").over(W.partitionBy(by).orderBy("pos").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    placed = segments.withColumn("start", start).withColumn("zone", F.floor(F.col("start") / zone_size).cast("int"))
    return placed.withColumns({"zone_offset": F.col("start") - F.col("zone") * zone_size, "iv_seed": F.col("zone")}).drop("start")


def packed_zones(segments: DataFrame, zone_size: int, by: str = "capsule_id") -> DataFrame:
    """The same for slices of any size: a zone takes slices until it holds ``zone_size`` or more. A fold over each payload's own slices."""
    listed = segments.groupBy(by).agg(F.array_sort(F.collect_list(F.struct("pos", "len"))).alias("ss"))
    empty = F.array().cast("array<struct<pos:int,len:bigint,zone:int,zone_offset:bigint>>")

    def step(a: Column, s: Column) -> Column:
        over = a["used"] >= zone_size
        zone, used = F.when(over, a["zone"] + 1).otherwise(a["zone"]), F.when(over, F.lit(0)).otherwise(a["used"])
        row = F.struct(s["pos"].cast("int").alias("pos"), s["len"].cast("bigint").alias("len"), zone.alias("zone"), used.cast("bigint").alias("zone_offset"))
        return F.struct(zone.alias("zone"), (used + s["len"]).cast("bigint").alias("used"), F.concat(a["rows"], F.array(row)).alias("rows"))

    start = F.struct(F.lit(0).alias("zone"), F.lit(0).cast("bigint").alias("used"), empty.alias("rows"))
    folded = listed.select(by, F.explode(F.aggregate("ss", start, step, lambda a: a["rows"])).alias("r")).select(by, "r.*")
    return folded.withColumn("iv_seed", F.col("zone"))


def merkle_root(payload: Column) -> Column:
    """One hash over the concatenation of all slices."""
    return F.sha2(payload, 256)


def plan(segments: DataFrame, strategy: str, zone_size: int, by: str = "capsule_id", data: str = "data") -> DataFrame:
    """The zone plan of a strategy for ``segments(by, pos, len)``, and ``merkle_root``, which is null but for ``quantum``.

    ``fixed`` packs zones. ``entropy`` falls back to it, as the model that it re-expresses does. ``quantum`` is ``fixed`` with one root beside it, over each
    payload's slices in order, which ``segments`` then has in ``data``. Strategies that need other hardware or a trained model are an error.
    """
    if strategy not in STRATEGIES:
        raise QuarryError(f"layout strategy {strategy!r} isn't available")
    packed = packed_zones(segments, zone_size, by)
    if strategy != "quantum":
        return packed.withColumn("merkle_root", F.lit(None).cast("string"))
    if data not in segments.columns:
        raise QuarryError("a root needs the slices' bytes")
    return packed.join(roots(segments, by, data), by)


def roots(segments: DataFrame, by: str = "capsule_id", data: str = "data") -> DataFrame:
    """(by, merkle_root): SHA-256 of each payload's slices, hashed one after another as they stream by in order."""
    own = segments.select(by, "pos", F.col(data).alias("data"))
    kind = own.schema[by].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, made = None, None
        for batch in batches:
            names, done = batch.column(0).to_pylist(), []
            for i, name in enumerate(names):
                if made is None or name != current:
                    if made is not None:
                        done.append((current, made.hexdigest()))
                    current, made = name, hashlib.sha256()
                made.update(batch.column(2)[i].as_buffer() if batch.column(2)[i].is_valid else b"")
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in done], batch.schema.field(0).type), pa.array([x[1] for x in done], pa.string())], [by, "merkle_root"])
            kept = batch.schema.field(0).type
        if made is not None:
            yield pa.RecordBatch.from_arrays([pa.array([current], kept), pa.array([made.hexdigest()], pa.string())], [by, "merkle_root"])

    return own.repartition(by).sortWithinPartitions(by, "pos").mapInArrow(run, f"`{by}` {kind}, merkle_root string")
