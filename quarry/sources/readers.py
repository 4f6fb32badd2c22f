"""Sources: catalog tables, payload files, JSON-lines logs, policy files and telemetry streams. Every read has a schema; nothing is inferred."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.policies import Policy, parse_policy

TABLES = {
    "capsules": "capsule_id string, size bigint, segment_count int, created_at timestamp, policy string, deduped_bytes bigint",
    "capsule_segments": "capsule_id string, pos int, segment_id bigint",
    "segments": "segment_id bigint, offset bigint, len bigint, compressed boolean, compression_algo string, content_hash string, ref_count bigint, deduplicated boolean, key_version int, encryption_version int, tweak_nonce binary, integrity_tag binary, encrypted boolean, payload binary",
    "content_store": "content_hash string, segment_id bigint",
    "audit_log": "seq bigint, event string, payload string, timestamp bigint, prev_hash string, hash string, tsa boolean",
    "telemetry": "event_id bigint, ts timestamp, type string, capsule_id string, node_id string, accesses_per_min bigint, used_bytes bigint, total_bytes bigint, threshold_pct double, reason string, view string, policy string",
    "nodes": "node_id string, ord int, zone_type string, zone_name string, available_bytes bigint, used_bytes bigint, network_tier string",
    "namespace": "path string, name string, parent string, kind string, size bigint, capsule_id string, created_at bigint, modified_at bigint",
    "objects": "full_key string, bucket string, key string, capsule_id string, size bigint, created_at bigint, content_type string",
    "volumes": "name string, size bigint, block_size bigint, capsule_id string, version bigint, created_at bigint, updated_at bigint",
}


def table(spark: SparkSession, path: str, name: str) -> DataFrame:
    """A catalog table in Parquet; columns that older files lack are null."""
    return spark.read.schema(TABLES[name]).parquet(path)


def json_table(spark: SparkSession, path: str, name: str) -> DataFrame:
    """The same from JSON documents or arrays of them; missing fields are null."""
    return spark.read.schema(TABLES[name]).option("multiLine", "true").json(path)


def json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines; blank lines and lines that can't be read are left out."""
    rows = spark.read.schema(f"{schema}, _corrupt string").option("columnNameOfCorruptRecord", "_corrupt").option("mode", "PERMISSIVE").json(path)
    return rows.where("_corrupt is null").drop("_corrupt")


def payload_files(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    """(name, data) of whole files."""
    reader = spark.read.format("binaryFile")
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    return reader.load(path).select(F.col("path").alias("name"), F.col("content").alias("data"))


def text_payloads(rows: DataFrame, key: str, text: str) -> DataFrame:
    """(name, data) of a text column, as UTF-8 bytes."""
    return rows.select(F.col(key).alias("name"), F.encode(F.col(text), "UTF-8").alias("data"))


def policy_file(path: str) -> Policy:
    with open(path, encoding="utf-8") as f:
        return parse_policy(f.read())


def telemetry_stream(spark: SparkSession, path: str, schema: str = TABLES["telemetry"], files_per_trigger: int = 64) -> DataFrame:
    """Files of telemetry as a stream."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)
