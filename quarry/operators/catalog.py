"""The catalog's life: write, read, range read, delete, reconcile and collect, as batch transformations of immutable tables.

Reference counts are derived by counting references, never updated in place. A version of the catalog is one folder that is written once. It becomes
current when a line that names it is added to ``commits``, after all its tables; a rollback is a line that names an earlier one. Lines are only
ever added, each as a file that appears whole, so a reader finds the version before or the one after, and a failed write leaves no trace in it.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.errors import CatalogError
from quarry.functions import codecs, crypto
from quarry.functions.payload import SEGMENT_SIZE, chunks, content_hash
from quarry.operators.dedup import dense_ids, running_offset
from quarry.policies import Policy
from quarry.shared import materialize
from quarry.sources.readers import TABLES

FORMAT_VERSION = 1
_SEGMENT = [c.split(" ")[0] for c in TABLES["segments"].split(", ")]


@dataclass(frozen=True)
class Catalog:
    capsules: DataFrame
    capsule_segments: DataFrame
    segments: DataFrame
    content_store: DataFrame

    @classmethod
    def empty(cls, spark: SparkSession) -> Catalog:
        return cls(*(spark.createDataFrame([], TABLES[t]) for t in ("capsules", "capsule_segments", "segments", "content_store")))

    def save(self, path: str, version: int) -> None:
        """Write all tables of ``version``, which must be new, then commit it."""
        for name in ("capsules", "capsule_segments", "segments", "content_store"):
            getattr(self, name).write.mode("error").parquet(f"{path}/v{version}/{name}")
        _commit(self.capsules.sparkSession, path, version)

    @classmethod
    def open(cls, spark: SparkSession, path: str, version: int | None = None, reconcile: bool = True) -> Catalog:
        """The current version, or the one asked for; ``reconcile`` counts the references anew."""
        if version is None:
            version = current_version(spark, path)
        found = cls(*(spark.read.schema(TABLES[t]).parquet(f"{path}/v{version}/{t}") for t in ("capsules", "capsule_segments", "segments", "content_store")))
        return cls(found.capsules, found.capsule_segments, recount(found.segments, found.capsule_segments), found.content_store) if reconcile else found


_COMMIT = "seq bigint, version int"


def _commits(spark: SparkSession, path: str) -> list:
    """(seq, version) of all commits in order: one small row each."""
    try:
        return sorted(tuple(r) for r in spark.read.schema(_COMMIT).json(f"{path}/commits").collect())
    except AnalysisException:  # nothing was committed yet
        return []


def _commit(spark: SparkSession, path: str, version: int) -> None:
    seq = max((s for s, _ in _commits(spark, path)), default=0) + 1
    spark.createDataFrame([(seq, version)], _COMMIT).coalesce(1).write.mode("append").json(f"{path}/commits")


def current_version(spark: SparkSession, path: str) -> int:
    found = _commits(spark, path)
    if not found:
        raise CatalogError(f"nothing was committed to {path}")
    return found[-1][1]


def rollback(spark: SparkSession, path: str, version: int) -> None:
    """Make an earlier, committed version current again; what was written since stays, but isn't read."""
    if version not in {v for _, v in _commits(spark, path)}:
        raise CatalogError(f"version {version} was never committed")
    _commit(spark, path, version)


def capsule(catalog: Catalog, capsule_id: str) -> dict:
    """A capsule's row, with its segments' ids in order; an error if there is none."""
    found = catalog.capsules.where(F.col("capsule_id") == capsule_id).first()
    if found is None:
        raise CatalogError(f"there is no capsule {capsule_id!r}")
    links = catalog.capsule_segments.where(F.col("capsule_id") == capsule_id).orderBy("pos").select("segment_id").collect()
    return found.asDict() | {"segments": [r["segment_id"] for r in links]}


def segment_metadata(catalog: Catalog, wanted: DataFrame) -> DataFrame:
    """The segments' rows without their bytes, for ``wanted(segment_id)``; those that aren't there have nulls and ``found`` false."""
    known = catalog.segments.drop("payload").withColumn("found", F.lit(True))
    return wanted.select("segment_id").distinct().join(known, "segment_id", "left").fillna({"found": False})


def put_metadata(segments: DataFrame, rows: DataFrame) -> DataFrame:
    """``segments`` with ``rows`` added; a row of the same ``segment_id`` is replaced. Columns that ``rows`` lacks are null, but for the bytes, which stay."""
    kept = segments.select("segment_id", F.col("payload").alias("__payload"))
    new = rows.join(kept, "segment_id", "left")
    own = F.coalesce(F.col("payload"), F.col("__payload")) if "payload" in rows.columns else F.col("__payload")
    return segments.join(rows.select("segment_id"), "segment_id", "left_anti").unionByName(new.withColumn("payload", own).drop("__payload"), allowMissingColumns=True)


def write(catalog: Catalog, payloads: DataFrame, policy: Policy, ring: crypto.KeyRing | None = None, segment_size: int | None = None) -> Catalog:
    """The catalog with a capsule for each row of ``payloads(name, data)``, all under one policy.

    Chunks are compressed and hashed in a narrow step and written. The first writer of each hash, ids, offsets and reference counts are made from
    narrow rows without payloads; then the payloads of first writers meet their ids in one shuffle and are encrypted and written, so that nothing moves
    them again. Segments that are encrypted and those that aren't never stand for each other: the store's key is the hash of the stored bytes, marked if encrypted.
    """
    if policy.encrypted and ring is None:
        raise crypto.EncryptionError("this policy needs a key ring")
    size = segment_size or policy.segment_size or SEGMENT_SIZE
    taken = payloads.select(F.col("name").cast("string").alias("name")).groupBy("name").count().where("count > 1")
    if (twice := taken.first()) is not None or (twice := payloads.select(F.col("name").cast("string").alias("capsule_id")).join(catalog.capsules, "capsule_id", "left_semi").first()) is not None:
        raise CatalogError(f"capsule {twice[0]!r} exists already")
    named = payloads.select(F.col("name").cast("string").alias("capsule_id"), "data")
    cut = chunks(named, "data", size).withColumns({"comp_algo": F.lit(policy.comp_algo), "comp_level": F.lit(policy.comp_level)})
    # compressed and hashed once: the branches below read the written table, and the lineage of batch after batch doesn't grow
    hashed = codecs.adaptive(cut).withColumn("content_hash", F.concat(content_hash(F.col("stored")), F.lit("-enc" if policy.encrypted else "")))
    prepared = materialize(hashed.select("capsule_id", "pos", "content_hash", "algo", "original_size", "compressed_size", "stored"), "catalog-prepared")
    last = catalog.segments.agg(F.coalesce(F.max("segment_id") + 1, F.lit(0)).alias("next"), F.coalesce(F.max(F.col("offset") + F.col("len")), F.lit(0)).alias("end")).first()
    order = ["capsule_id", "pos"]
    length = crypto.sealed_length(F.col("compressed_size")) if policy.encrypted else F.col("compressed_size")
    slim = prepared.select(*order, "content_hash", "original_size", length.alias("len"))
    if policy.dedupe:
        first = slim.groupBy("content_hash").agg(F.min(F.struct(*order)).alias("at"), F.first("len").alias("len"), F.count(F.lit(1)).alias("ref_count")).select("content_hash", "at.*", "len", "ref_count")
        fresh = first.join(catalog.content_store, "content_hash", "left_anti")
        numbered = materialize(dense_ids(fresh, order, last["next"]), "catalog-numbered")
        store = catalog.content_store.unionByName(numbered.select("content_hash", "segment_id"))
        known = catalog.content_store.join(catalog.segments.select("segment_id", "len"), "segment_id", "left").select("content_hash", "segment_id", "len", F.lit(None).cast("string").alias("first_id"), F.lit(None).cast("int").alias("first_pos"))
        known = known.unionByName(numbered.select("content_hash", "segment_id", "len", F.col("capsule_id").alias("first_id"), F.col("pos").alias("first_pos")))
        own = F.coalesce((F.col("capsule_id") == F.col("first_id")) & (F.col("pos") == F.col("first_pos")), F.lit(False))
        linked = slim.drop("len").join(known, "content_hash").select(*order, "segment_id", "original_size", F.when(own, 0).otherwise(F.col("len")).alias("deduped"))
    else:
        numbered = materialize(dense_ids(slim.withColumn("ref_count", F.lit(1).cast("bigint")), order, last["next"]), "catalog-numbered")
        store = catalog.content_store
        linked = numbered.select(*order, "segment_id", "original_size", F.lit(0).cast("bigint").alias("deduped"))
    linked = materialize(linked, "catalog-linked")
    links = linked.select(*order, "segment_id")
    placed = running_offset(numbered.select((F.col("segment_id") - last["next"]).alias("segment_id"), "len")).select((F.col("segment_id") + last["next"]).alias("segment_id"), (F.col("offset") + last["end"]).alias("offset"))
    new = prepared.select(*order, "content_hash", "algo", "stored").join(numbered.select(*order, "segment_id", "ref_count").join(placed, "segment_id"), order)
    plain_hash = F.regexp_replace("content_hash", "-enc$", "")
    if policy.encrypted:
        version = policy.key_version or ring.current
        sealed = new.withColumns({"key_version": F.lit(version), "encryption_version": F.lit(FORMAT_VERSION), "tweak_nonce": crypto.tweak(plain_hash)})
        sealed = sealed.withColumn("payload", crypto.encrypt(F.col("stored"), crypto.keyed(ring)("key_version"), plain_hash))
        sealed = sealed.withColumn("integrity_tag", crypto.mac_udf(ring)("payload", "encryption_version", "key_version", "tweak_nonce"))
    else:
        none = F.lit(None)
        sealed = new.withColumns({"key_version": none.cast("int"), "encryption_version": none.cast("int"), "tweak_nonce": none.cast("binary"), "payload": F.col("stored"), "integrity_tag": none.cast("binary")})
    rows = sealed.withColumns({"len": F.octet_length("payload").cast("bigint"), "compressed": F.col("algo") != "identity", "compression_algo": F.col("algo"), "deduplicated": F.col("ref_count") > 1, "encrypted": F.lit(policy.encrypted)})
    # nothing before this batch refers to its segments, so their counts are those of the batch
    added = materialize(rows.select(_SEGMENT), "catalog-added")
    segments = recount(catalog.segments, catalog.capsule_segments.unionByName(links)).unionByName(added, allowMissingColumns=True)
    sums = linked.groupBy("capsule_id").agg(F.sum("original_size").cast("bigint").alias("size"), F.count(F.lit(1)).cast("int").alias("segment_count"), F.sum("deduped").cast("bigint").alias("deduped_bytes"))
    capsules = named.select("capsule_id").join(sums, "capsule_id", "left").select("capsule_id", F.coalesce("size", F.lit(0)).alias("size"), F.coalesce("segment_count", F.lit(0)).alias("segment_count"), F.current_timestamp().alias("created_at"), F.lit(policy.policy).alias("policy"), F.coalesce("deduped_bytes", F.lit(0)).alias("deduped_bytes"))
    return Catalog(catalog.capsules.unionByName(materialize(capsules, "catalog-capsules")), catalog.capsule_segments.unionByName(links), segments, store)


def recount(segments: DataFrame, links: DataFrame) -> DataFrame:
    """``segments`` with ``ref_count`` and ``deduplicated`` from the references there are, repeats within a capsule included."""
    counts = links.groupBy("segment_id").agg(F.count(F.lit(1)).alias("__refs"))
    joined = segments.drop("ref_count", "deduplicated").join(counts, "segment_id", "left")
    out = joined.withColumn("ref_count", F.coalesce("__refs", F.lit(0)).cast("bigint")).withColumn("deduplicated", F.col("ref_count") > 1).drop("__refs")
    return out.select(_SEGMENT)


def opened(segments: DataFrame, ring: crypto.KeyRing | None = None, *keep: str) -> DataFrame:
    """(segment_id, keep..., ok, data): payloads verified, decrypted and decompressed by each segment's own codec. A wrong tag gives ``ok`` false and no data."""
    if ring is None:
        clear = segments.where("not encrypted").select("segment_id", *keep, F.lit(True).alias("ok"), F.col("payload").alias("stored"), "compression_algo")
    else:
        sealed = [F.when(F.col("encrypted"), F.col(c)) for c in ("payload", "encryption_version", "key_version", "tweak_nonce", "integrity_tag")]
        checked = segments.withColumn("ok", ~F.col("encrypted") | crypto.verify_udf(ring)(*sealed))
        stored = F.when(~F.col("encrypted"), F.col("payload")).when(F.col("ok"), crypto.decrypt(F.col("payload"), crypto.keyed(ring)("key_version")))
        clear = checked.where("encrypted is not null").select("segment_id", *keep, "ok", stored.alias("stored"), "compression_algo")
    return clear.select("segment_id", *keep, "ok", codecs.restored("stored", "compression_algo").alias("data"))


def _opened_links(links: DataFrame, segments: DataFrame, ring: crypto.KeyRing | None) -> DataFrame:
    """(links..., ok, data). Stored bytes meet their references before they are opened: Spark forgets how rows are partitioned where Python ran, and opened bytes would move once more."""
    keep = [c for c in links.columns if c != "segment_id"]
    return opened(links.join(segments, "segment_id"), ring, *keep).drop("segment_id")


def read_chunks(catalog: Catalog, capsule_ids: DataFrame | None = None, ring: crypto.KeyRing | None = None) -> DataFrame:
    """(capsule_id, pos, ok, data): the payloads' chunks, in place; for payloads too large for one row. Sort by (capsule_id, pos) to read in order."""
    links = catalog.capsule_segments
    if capsule_ids is not None:
        links = links.join(capsule_ids.select("capsule_id").distinct(), "capsule_id", "left_semi")
    return _opened_links(links, catalog.segments, ring).select("capsule_id", "pos", "ok", "data")


def joined_bytes(parts: Column) -> Column:
    """Each array of bytes as one value, in the JVM: the casts only say what the bytes are called and change none. A missing part makes the whole missing."""
    joined = F.array_join(F.transform(parts, lambda x: x.cast("string")), "").cast("binary")
    return F.when(~F.exists(parts, lambda x: x.isNull()), joined)


def _assembled(parts: DataFrame) -> DataFrame:
    listed = parts.groupBy("capsule_id").agg(F.bool_and("ok").alias("ok"), F.array_sort(F.collect_list(F.struct("pos", "data"))).alias("ps"))
    return listed.select("capsule_id", "ok", joined_bytes(F.transform("ps", lambda x: x["data"])).alias("data"))


def read(catalog: Catalog, capsule_ids: DataFrame | None = None, ring: crypto.KeyRing | None = None) -> DataFrame:
    """(capsule_id, ok, data): whole payloads; an empty capsule has empty data."""
    wanted = catalog.capsules.select("capsule_id")
    if capsule_ids is not None:
        wanted = wanted.join(capsule_ids.select("capsule_id").distinct(), "capsule_id", "left_semi")
    links = catalog.capsule_segments.join(wanted, "capsule_id", "left_semi")
    return wanted.join(_assembled(_opened_links(links, catalog.segments, ring)), "capsule_id", "left").select("capsule_id", F.coalesce("ok", F.lit(True)).alias("ok"), F.coalesce("data", F.lit(b"")).alias("data"))


def chunk_range(offset: Column, length: Column, size: int) -> tuple[Column, Column]:
    """The first and the last chunk that a range touches; for an empty range, twice the chunk where it is."""
    return F.floor(offset / size), F.when(length > 0, F.floor((offset + length - 1) / size)).otherwise(F.floor(offset / size))


def read_range(catalog: Catalog, ranges: DataFrame, size: int = SEGMENT_SIZE, ring: crypto.KeyRing | None = None) -> DataFrame:
    """(capsule_id, offset, length, data) for ``ranges(capsule_id, offset, length)``; only the chunks touched are opened. A range beyond the end is an error."""
    checked = ranges.join(catalog.capsules.select("capsule_id", "size"), "capsule_id")
    bad = (F.col("offset") < 0) | (F.col("length") < 0) | (F.col("offset") + F.col("length") > F.col("size"))
    checked = checked.withColumn("length", F.when(bad, F.raise_error(F.concat(F.lit("range beyond the end of "), F.col("capsule_id"))).cast("bigint")).otherwise(F.col("length")))
    lo, hi = chunk_range(F.col("offset"), F.col("length"), size)
    touched = checked.where("length > 0").withColumn("pos", F.explode(F.sequence(lo.cast("int"), hi.cast("int"))))
    links = touched.join(catalog.capsule_segments, ["capsule_id", "pos"]).select("capsule_id", "pos", F.col("offset").alias("__from"), F.col("length").alias("__length"), "segment_id")
    parts = _opened_links(links, catalog.segments, ring).withColumnsRenamed({"__from": "offset", "__length": "length"})
    whole = parts.groupBy("capsule_id", "offset", "length").agg(F.min("pos").alias("first"), F.array_sort(F.collect_list(F.struct("pos", "data"))).alias("ps"))
    whole = whole.withColumn("all", joined_bytes(F.transform("ps", lambda x: x["data"]))).drop("ps")
    cut = whole.withColumn("data", F.substring(F.col("all"), (F.col("offset") - F.col("first") * size + 1).cast("int"), F.col("length").cast("int")))
    return ranges.join(cut.select("capsule_id", "offset", "length", "data"), ["capsule_id", "offset", "length"], "left").withColumn("data", F.coalesce("data", F.lit(b"")))


def delete(catalog: Catalog, capsule_ids: DataFrame) -> Catalog:
    """Without the capsules; segments that nothing refers to any more go, and their hashes with them."""
    gone = capsule_ids.select("capsule_id").distinct()
    links = catalog.capsule_segments.join(gone, "capsule_id", "left_anti")
    return collect(Catalog(catalog.capsules.join(gone, "capsule_id", "left_anti"), links, catalog.segments, catalog.content_store))


def orphans(catalog: Catalog) -> DataFrame:
    """Segments that no capsule refers to, whatever their stored count says."""
    return catalog.segments.join(catalog.capsule_segments.select("segment_id"), "segment_id", "left_anti")


def reclaim(catalog: Catalog) -> tuple[Catalog, int]:
    """(the catalog after ``collect``, the number of segments that went)."""
    return collect(catalog), orphans(catalog).count()


def change_references(segments: DataFrame, changes: DataFrame) -> DataFrame:
    """``segments`` after ``changes(segment_id, delta)``, a row for each reference gained (1) or lost (-1); each counts as an access.

    A count that would fall below 0, or a segment that isn't there, is an error.
    """
    summed = changes.groupBy("segment_id").agg(F.sum("delta").alias("__d"), F.count(F.lit(1)).alias("__n"))
    joined = summed.join(segments.select("segment_id", "ref_count"), "segment_id", "left")
    if (wrong := joined.where("ref_count is null or ref_count + __d < 0").first()) is not None:
        raise CatalogError(f"segment {wrong['segment_id']} has no such reference")
    counted = segments.join(summed, "segment_id", "left").withColumn("ref_count", F.col("ref_count") + F.coalesce("__d", F.lit(0)))
    accesses = F.coalesce(F.col("access_count"), F.lit(0)) if "access_count" in segments.columns else F.lit(0)
    return counted.withColumns({"deduplicated": F.col("ref_count") > 1, "access_count": (accesses + F.coalesce("__n", F.lit(0))).cast("bigint")}).drop("__d", "__n")


def collect(catalog: Catalog) -> Catalog:
    """Counts made anew; segments without a reference and their hashes removed."""
    live = recount(catalog.segments, catalog.capsule_segments).where("ref_count > 0")
    store = catalog.content_store.join(live.select("segment_id"), "segment_id", "left_semi").select("content_hash", "segment_id")
    return Catalog(catalog.capsules, catalog.capsule_segments, live, store)


def register(store: DataFrame, entries: DataFrame) -> DataFrame:
    """The content store with ``entries(content_hash, segment_id)``, which replace entries of the same hash."""
    return store.join(entries, "content_hash", "left_anti").unionByName(entries.select("content_hash", "segment_id"))


def deregister(store: DataFrame, entries: DataFrame) -> DataFrame:
    """The content store without ``entries``; an entry goes only if it still names that very segment."""
    return store.join(entries, ["content_hash", "segment_id"], "left_anti")


def serialize(capsules: DataFrame) -> DataFrame:
    """(capsule_id, json)."""
    return capsules.select("capsule_id", F.to_json(F.struct("*")).alias("json"))
