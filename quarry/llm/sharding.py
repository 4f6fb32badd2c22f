"""Sharding by fixed virtual slots: a record's slot never changes, only the table from slots to shards is edited.

Records are hashed into ``SLOTS`` slots. Bytes are summed by slot in one aggregation; the map from slots to shards is a versioned table of
``SLOTS`` rows, a folder a version, written once and read back. The first version gives shards equal runs of slots. Rebalancing edits the last version there is into the next by moving as few slots as it needs:
from the fullest shard to the emptiest, the largest slot that fits, until every shard is within ``TOLERANCE`` of the mean or no move
helps. A shard that is added starts empty; one that is taken away hands over all its slots. Ties go to the lower shard and the lower slot, so the same bytes give the same map.

Defined cases. A null key goes to the slot of the empty string; a null or empty text has 0 bytes. Rows with the same key share a slot, so repeated rows
stay together. An empty table leaves the map as it is, under a new version. A slot larger than a shard's share stays whole: a record can't be
split. Texts of any length count with all their bytes. A version that isn't there, or has been written before, is an error. Extra columns are ignored, whatever their names.
"""

from __future__ import annotations

import heapq

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm.common import hex_bucket, small_side
from quarry.shared import new_path

SLOTS = 4096
SHARDS = 16
TOLERANCE = 0.02


def slot_of(key: Column, slots: int = SLOTS) -> Column:
    return hex_bucket(F.coalesce(key.cast("string"), F.lit("")), slots).cast("int")


def slot_bytes(docs: DataFrame, slots: int = SLOTS) -> DataFrame:
    """(slot, records, bytes)."""
    return docs.select(slot_of(F.col("doc_id"), slots).alias("slot"), F.coalesce(F.octet_length("text"), F.lit(0)).cast("bigint").alias("bytes")).groupBy("slot").agg(F.count(F.lit(1)).alias("records"), F.sum("bytes").alias("bytes"))


def first_map(shards: int = SHARDS, slots: int = SLOTS) -> list[int]:
    """The shard of each slot in version 1."""
    return [s * shards // slots for s in range(slots)]


def rebalance(owner: list[int], weight: list[int], shards: int, tolerance: float = TOLERANCE) -> list[int]:
    """The next version's shard of each slot; slots of shards that are gone move first."""
    new, load, held = list(owner), [0] * shards, [[] for _ in range(shards)]
    for slot, shard in enumerate(owner):
        if shard < shards:
            load[shard] += weight[slot]
            held[shard].append(slot)
    heap = [(n, s) for s, n in enumerate(load)]
    heapq.heapify(heap)
    for slot in sorted((x for x, s in enumerate(owner) if s >= shards), key=lambda x: (-weight[x], x)):
        n, s = heapq.heappop(heap)
        new[slot] = s
        held[s].append(slot)
        load[s] = n + weight[slot]
        heapq.heappush(heap, (load[s], s))
    limit = sum(weight) / shards * (1 + tolerance)
    while True:
        full, empty = max(range(shards), key=lambda s: (load[s], -s)), min(range(shards), key=lambda s: (load[s], s))
        gap = load[full] - load[empty]
        # a move that leaves the pair's larger shard smaller than before
        fits = [x for x in held[full] if 0 < weight[x] < gap]
        if load[full] <= limit or not fits:
            return new
        excess = load[full] - limit
        enough = [x for x in fits if weight[x] >= excess and load[empty] + weight[x] <= limit]
        slot = min(enough, key=lambda x: (weight[x], x)) if enough else max(fits, key=lambda x: (-abs(weight[x] - gap / 2), -x))
        held[full].remove(slot)
        held[empty].append(slot)
        load[full] -= weight[slot]
        load[empty] += weight[slot]
        new[slot] = empty


_MAP = "slot int, shard int"


def save_map(spark: SparkSession, path: str, version: int, owner: list[int]) -> None:
    """Write a version of the map, which must be new."""
    spark.createDataFrame(list(enumerate(owner)), _MAP).coalesce(1).write.mode("error").parquet(f"{path}/version={version}")


def last_version(spark: SparkSession, path: str) -> int:
    """The last version in ``path``; 0 if there is none."""
    try:
        found = spark.read.schema(f"{_MAP}, version int").parquet(path).agg(F.max("version")).first()[0]
    except AnalysisException:  # no such folder yet
        return 0
    return found or 0


def map_table(spark: SparkSession, path: str, version: int) -> DataFrame:
    """(slot, shard) of a version: ``SLOTS`` rows, whatever the table's size."""
    return spark.read.schema(_MAP).parquet(f"{path}/version={version}")


def load_map(spark: SparkSession, path: str, version: int) -> list[int]:
    """The shard of each slot."""
    return [r["shard"] for r in sorted(map_table(spark, path, version).collect())]


def rebalance_to(docs: DataFrame, path: str, shards: int = SHARDS, slots: int = SLOTS, tolerance: float = TOLERANCE) -> int:
    """Edit the last version of the map in ``path`` (the first, if there is none) for the bytes of ``docs``; the number of the version that was made."""
    spark = docs.sparkSession
    weight = [0] * slots
    for r in slot_bytes(docs, slots).collect():  # one row a slot, whatever the table's size
        weight[r["slot"]] = r["bytes"]
    version = last_version(spark, path)
    if not version:
        version = 1
        save_map(spark, path, version, first_map(shards, slots))
    save_map(spark, path, version + 1, rebalance(load_map(spark, path, version), weight, shards, tolerance))
    return version + 1


def assign(docs: DataFrame, shards: int = SHARDS, slots: int = SLOTS, tolerance: float = TOLERANCE, path: str | None = None) -> DataFrame:
    """(doc_id, slot, first_shard, shard, map_version) of every row, after the map in ``path`` (a new one without it) was rebalanced to the bytes there are.

    ``first_shard`` is the shard in the version that was edited.
    """
    spark = docs.sparkSession
    path = path or new_path(spark, "slot-map")
    version = rebalance_to(docs, path, shards, slots, tolerance)
    first = map_table(spark, path, version - 1).select("slot", F.col("shard").alias("first_shard"))
    last = map_table(spark, path, version).select("slot", "shard", F.lit(version).alias("map_version"))
    placed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), slot_of(F.col("doc_id"), slots).alias("slot"))
    both = small_side(first.join(small_side(last, slots), "slot"), slots)
    return placed.join(both, "slot").select("doc_id", "slot", "first_shard", "shard", "map_version")
