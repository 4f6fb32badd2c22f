"""Object, folder and volume views of the same capsules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quarry.errors import ViewError
from quarry.functions import paths
from quarry.functions.crypto import KeyRing
from quarry.functions.payload import SEGMENT_SIZE
from quarry.operators.catalog import Catalog, delete, joined_bytes, read, read_range, write
from quarry.policies import Policy

# -- objects


def put(objects: DataFrame, puts: DataFrame, order: str = "seq") -> DataFrame:
    """``objects`` after ``puts(bucket, key, capsule_id, size, created_at, order)``: the last put of a key counts; capsules of earlier ones stay."""
    new = puts.withColumn("full_key", paths.object_key(F.col("bucket"), F.col("key")))
    last = new.withColumn("__r", F.row_number().over(W.partitionBy("full_key").orderBy(F.desc(order)))).where("__r = 1")
    rows = last.select("full_key", "bucket", "key", "capsule_id", "size", "created_at", paths.content_type(F.col("key")).alias("content_type"))
    return objects.join(rows, "full_key", "left_anti").unionByName(rows)


def list_bucket(objects: DataFrame, bucket: str) -> DataFrame:
    return objects.where(F.startswith("full_key", F.lit(f"{bucket}/"))).orderBy("full_key")


def head(objects: DataFrame, full_key: str) -> DataFrame:
    return objects.where(F.col("full_key") == full_key).withColumn("etag", paths.etag(F.col("capsule_id")))


def remove(objects: DataFrame, keys: DataFrame) -> DataFrame:
    """Without the keys; their capsules stay."""
    return objects.join(keys.select("full_key"), "full_key", "left_anti")


def put_bodies(catalog: Catalog, objects: DataFrame, puts: DataFrame, policy: Policy, now: int, ring: KeyRing | None = None, segment_size: int | None = None) -> tuple[Catalog, DataFrame]:
    """(catalog, objects) after ``puts(seq, bucket, key, data)``: each body becomes a capsule of its own, ``bucket/key@seq``; the last put of a key counts."""
    named = puts.withColumn("capsule_id", F.concat_ws("@", paths.object_key(F.col("bucket"), F.col("key")), F.col("seq").cast("string")))
    after = write(catalog, named.select(F.col("capsule_id").alias("name"), "data"), policy, ring, segment_size)
    listed = named.select("seq", "bucket", "key", "capsule_id", F.octet_length("data").cast("bigint").alias("size"), F.lit(now).cast("bigint").alias("created_at"))
    return after, put(objects, listed)


def get(catalog: Catalog, objects: DataFrame, keys: DataFrame, ring: KeyRing | None = None) -> DataFrame:
    """(full_key, etag, content_type, size, ok, data) for ``keys(full_key)``; a key that isn't there is an error."""
    asked = keys.select("full_key").distinct()
    if (gone := asked.join(objects, "full_key", "left_anti").first()) is not None:
        raise ViewError(f"there is no object {gone['full_key']}")
    found = objects.join(asked, "full_key", "left_semi")
    data = read(catalog, found.select("capsule_id"), ring)
    return found.join(data, "capsule_id").select("full_key", paths.etag(F.col("capsule_id")).alias("etag"), "content_type", "size", "ok", "data")


# -- folders


def _entries(rows: DataFrame) -> DataFrame:
    return rows.withColumns({"name": paths.name(F.col("path")), "parent": paths.parent(F.col("path"))}).select("path", "name", "parent", "kind", "size", "capsule_id", "created_at", "modified_at")


def write_files(namespace: DataFrame, files: DataFrame, now: int) -> DataFrame:
    """The namespace after ``files(path, size, capsule_id)``: folders above them are made, files of the same path replaced. A file in a folder's place, or the other way round, is an error."""
    new = files.select(paths.normalize(F.col("path")).alias("path"), F.lit("file").alias("kind"), "size", "capsule_id")
    above = new.select(F.explode(paths.ancestors(F.col("path"))).alias("path")).distinct().select("path", F.lit("dir").alias("kind"), F.lit(0).cast("bigint").alias("size"), F.lit(None).cast("string").alias("capsule_id"))
    both = new.unionByName(above)
    clash = both.groupBy("path").agg(F.count_distinct("kind").alias("n")).where("n > 1 or path = '/' and n > 1").select("path").unionAll(both.alias("a").join(namespace.alias("b"), "path").where("a.kind <> b.kind").select("path")).first()
    if clash is not None:
        raise ViewError(f"{clash['path']} is of another kind")
    made = namespace.select("path", F.col("created_at").alias("__c"))
    rows = both.join(made, "path", "left").select("path", "kind", "size", "capsule_id", F.coalesce("__c", F.lit(now)).alias("created_at"), F.lit(now).alias("modified_at"))
    return namespace.join(rows, "path", "left_anti").unionByName(_entries(rows))


def write_bodies(catalog: Catalog, namespace: DataFrame, files: DataFrame, policy: Policy, now: int, ring: KeyRing | None = None, segment_size: int | None = None) -> tuple[Catalog, DataFrame]:
    """(catalog, namespace) after ``files(path, data)`` are written, one a path; the capsules of files that they replace are deleted, and what only those referred to is collected."""
    new = files.withColumn("path", paths.normalize(F.col("path"))).withColumn("capsule_id", F.concat(F.col("path"), F.lit(f"@{now}")))
    old = namespace.where("kind = 'file'").join(new.select("path"), "path", "left_semi").select("capsule_id")
    after = write(catalog, new.select(F.col("capsule_id").alias("name"), "data"), policy, ring, segment_size)
    listed = write_files(namespace, new.select("path", F.octet_length("data").cast("bigint").alias("size"), "capsule_id"), now)
    return delete(after, old), listed


def read_files(catalog: Catalog, namespace: DataFrame, ranges: DataFrame, ring: KeyRing | None = None, segment_size: int = SEGMENT_SIZE) -> DataFrame:
    """(path, offset, length, data) for ``ranges(path, offset, length)``; a null length reads to the end. What isn't a file, or a range beyond the end, is an error."""
    asked = ranges.withColumn("path", paths.normalize(F.col("path"))).join(namespace.where("kind = 'file'").select("path", "capsule_id", "size"), "path", "left")
    if (wrong := asked.where("capsule_id is null").first()) is not None:
        raise ViewError(f"there is no file {wrong['path']}")
    exact = asked.withColumn("length", F.coalesce("length", F.col("size") - F.col("offset")))
    data = read_range(catalog, exact.select("capsule_id", "offset", "length").distinct(), segment_size, ring)
    return exact.join(data, ["capsule_id", "offset", "length"]).select("path", "offset", "length", "data")


def mkdir(namespace: DataFrame, folders: DataFrame, now: int) -> DataFrame:
    """The namespace with ``folders(path)`` and all folders above them."""
    paths_ = folders.select(paths.normalize(F.col("path")).alias("path"))
    all_ = paths_.unionAll(paths_.select(F.explode(paths.ancestors(F.col("path"))).alias("path"))).distinct()
    if (clash := all_.join(namespace.where("kind = 'file'"), "path", "left_semi").first()) is not None:
        raise ViewError(f"{clash['path']} is a file")
    rows = all_.join(namespace, "path", "left_anti").select("path", F.lit("dir").alias("kind"), F.lit(0).cast("bigint").alias("size"), F.lit(None).cast("string").alias("capsule_id"), F.lit(now).alias("created_at"), F.lit(now).alias("modified_at"))
    return namespace.unionByName(_entries(rows))


def list_dir(namespace: DataFrame, path: str) -> DataFrame:
    """The immediate children in path order; an error if there is no such folder."""
    found = namespace.where(F.col("path") == path).first()
    if found is None or found["kind"] != "dir":
        raise ViewError(f"{path} isn't a folder")
    return namespace.where(F.col("parent") == path).orderBy("path")


def delete_path(namespace: DataFrame, path: str) -> DataFrame:
    """Without a file or an empty folder."""
    if path == "/":
        raise ViewError("the root stays")
    found = namespace.where(F.col("path") == path).first()
    if found is None:
        raise ViewError(f"there is no {path}")
    if found["kind"] == "dir" and namespace.where(F.startswith("path", F.lit(f"{path}/"))).first() is not None:
        raise ViewError(f"{path} isn't empty")
    return namespace.where(F.col("path") != path)


def nonempty(namespace: DataFrame) -> DataFrame:
    """(path) of the folders that have an entry."""
    return namespace.where("kind = 'dir'").join(namespace.select(F.col("parent").alias("path")), "path", "left_semi").select("path")


# -- volumes


def create_volumes(volumes: DataFrame, new: DataFrame, now: int) -> DataFrame:
    """The volumes with ``new(name, size, block_size, capsule_id)``; a bad name or size, or a name there is already, is an error."""
    bad = new.where(~paths.valid_volume_name(F.col("name")) | ~paths.valid_volume_size(F.col("size"), F.col("block_size"))).first()
    if bad is not None:
        raise ViewError(f"volume {bad['name']!r} of {bad['size']} bytes isn't possible")
    if (twice := new.join(volumes, "name", "left_semi").first()) is not None:
        raise ViewError(f"volume {twice['name']!r} exists")
    return volumes.unionByName(new.select("name", "size", "block_size", "capsule_id", F.lit(1).cast("bigint").alias("version"), F.lit(now).cast("bigint").alias("created_at"), F.lit(now).cast("bigint").alias("updated_at")))


def zero_blocks(volumes: DataFrame) -> DataFrame:
    """(name, block, data): the blocks of new volumes, all zeros."""
    n = (F.col("size") / F.col("block_size")).cast("int")
    return volumes.select("name", F.explode(F.sequence(F.lit(0), n - 1)).alias("block"), F.unhex(F.repeat(F.lit("00"), F.col("block_size").cast("int"))).alias("data"))


def overlay(data: Column, patch: Column, offset: Column) -> Column:
    """``data`` with ``patch`` from ``offset`` on, of the same length."""
    return F.overlay(data, patch, (offset + 1).cast("int"), F.octet_length(patch))


def write_blocks(volumes: DataFrame, blocks: DataFrame, writes: DataFrame, now: int) -> tuple[DataFrame, DataFrame]:
    """(volumes, blocks) after ``writes(name, offset, data, expected_version)``, one a volume; only touched blocks change, and the version grows by 1.

    A write beyond the end, or one that expects another version, is an error.
    """
    checked = writes.join(volumes, "name", "left")
    wrong = checked.where("size is null or offset < 0 or offset + octet_length(data) > size or expected_version <> version").first()
    if wrong is not None:
        raise ViewError(f"write to {wrong['name']!r} doesn't fit, or meets version {wrong['version']}")
    touched = checked.withColumn("block", F.explode(F.expr("sequence(cast(offset div block_size as int), cast((offset + octet_length(data) - 1) div block_size as int))")))
    start = F.col("block") * F.col("block_size")
    head, tail = F.greatest(F.col("offset") - start, F.lit(0)), F.greatest(start - F.col("offset"), F.lit(0))
    pieces = touched.select("name", "block", head.alias("__at"), F.substring("data", (tail + 1).cast("int"), (F.col("block_size") - head).cast("int")).alias("__patch"))
    new_blocks = blocks.join(pieces, ["name", "block"], "left").withColumn("data", F.when(F.col("__patch").isNotNull(), overlay(F.col("data"), F.col("__patch"), F.col("__at"))).otherwise(F.col("data"))).drop("__at", "__patch")
    bumped = volumes.join(writes.select("name", F.lit(1).alias("__w")), "name", "left")
    return bumped.withColumns({"version": F.col("version") + F.coalesce("__w", F.lit(0)), "updated_at": F.when(F.col("__w").isNotNull(), F.lit(now).cast("bigint")).otherwise(F.col("updated_at"))}).drop("__w"), new_blocks


def read_blocks(volumes: DataFrame, blocks: DataFrame, reads: DataFrame) -> DataFrame:
    """(name, offset, length, data) for ``reads(name, offset, length)``; only the blocks touched are read. A volume that isn't there, or a range beyond its end, is an error."""
    checked = reads.join(volumes.select("name", "size", "block_size"), "name", "left")
    if (wrong := checked.where("size is null or offset < 0 or length < 0 or offset + length > size").first()) is not None:
        raise ViewError(f"{wrong['name']!r} has no bytes {wrong['offset']} to {wrong['offset'] + wrong['length']}")
    touched = checked.where("length > 0").withColumn("block", F.explode(F.expr("sequence(cast(offset div block_size as int), cast((offset + length - 1) div block_size as int))")))
    parts = touched.join(blocks.select("name", "block", "data"), ["name", "block"]).groupBy("name", "offset", "length", "block_size").agg(F.array_sort(F.collect_list(F.struct("block", "data"))).alias("ps"))
    whole = parts.withColumn("data", joined_bytes(F.transform("ps", lambda x: x["data"])))
    cut = whole.select("name", "offset", "length", F.substring("data", (F.col("offset") % F.col("block_size") + 1).cast("int"), F.col("length").cast("int")).alias("data"))
    return reads.join(cut, ["name", "offset", "length"], "left").withColumn("data", F.coalesce("data", F.lit(b"")))


def list_volumes(volumes: DataFrame) -> DataFrame:
    return volumes.orderBy("name")


def volume_info(volumes: DataFrame, name: str) -> dict:
    found = volumes.where(F.col("name") == name).first()
    if found is None:
        raise ViewError(f"there is no volume {name!r}")
    return found.asDict() | {"blocks": found["size"] // found["block_size"]}


def delete_volumes(volumes: DataFrame, blocks: DataFrame, names: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(volumes, blocks) without ``names(name)``; a volume that isn't there is an error."""
    if (wrong := names.join(volumes, "name", "left_anti").first()) is not None:
        raise ViewError(f"there is no volume {wrong['name']!r}")
    return volumes.join(names.select("name"), "name", "left_anti"), blocks.join(names.select("name"), "name", "left_anti")
