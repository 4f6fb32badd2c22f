"""What the queries share: tables, 1 KiB chunks of documents, a fleet of nodes and a telemetry table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions.payload import chunks, content_hash

#: Documents are small: with the library's 4 MiB each would be one chunk.
CHUNK = 1024


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def document_chunks(spark: SparkSession, sf_dir: str, *keep: str) -> DataFrame:
    """(doc_id, keep..., pos, chunk, content_hash, len)."""
    docs = table(spark, sf_dir, "documents").select("doc_id", *keep, F.encode("text", "UTF-8").alias("data"))
    return chunks(docs, "data", CHUNK).withColumns({"content_hash": content_hash(F.col("chunk")), "len": F.octet_length("chunk")})


#: The same in SQL: (doc_id, lang, source, n_chars, pos, chunk, content_hash, len).
CHUNKS_SQL = f"""
chunks as (
  select doc_id, lang, source, pos, b[pos * {CHUNK} + 1:(pos + 1) * {CHUNK}] as chunk, sha256(b[pos * {CHUNK} + 1:(pos + 1) * {CHUNK}]) as content_hash, octet_length(b[pos * {CHUNK} + 1:(pos + 1) * {CHUNK}]) as len
  from (select doc_id, lang, source, encode(text) as b, unnest(range(0, ((octet_length(encode(text)) + {CHUNK - 1}) // {CHUNK})::bigint)) as pos from documents)
)"""


def fleet(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A node for each supplier; its nation is the zone, its balance the free room."""
    s, n, r = (table(spark, sf_dir, t) for t in ("supplier", "nation", "region"))
    kind = F.when(F.col("n_regionkey") % 3 == 0, "metro").when(F.col("n_regionkey") % 3 == 1, "geo").otherwise("edge")
    free = F.round(F.greatest(F.col("s_acctbal"), F.lit(0.0)) * 5000).cast("bigint")
    return s.join(F.broadcast(n), s.s_nationkey == n.n_nationkey).join(F.broadcast(r), n.n_regionkey == r.r_regionkey).select(
        F.concat(F.lit("node-"), F.lpad(F.col("s_suppkey").cast("string"), 8, "0")).alias("node_id"), F.col("s_suppkey").alias("ord"), kind.alias("zone_type"), F.lower("n_name").alias("zone_name"), free.alias("available_bytes"), ((F.col("s_suppkey") * 7919) % 50_000_000).alias("used_bytes")
    )


FLEET_SQL = """
nodes as (
  select 'node-' || lpad(s_suppkey::varchar, 8, '0') as node_id, s_suppkey as ord, case n_regionkey % 3 when 0 then 'metro' when 1 then 'geo' else 'edge' end as zone_type, lower(n_name) as zone_name,
    round(greatest(s_acctbal, 0.0) * 5000)::bigint as available_bytes, (s_suppkey * 7919) % 50000000 as used_bytes
  from supplier join nation on s_nationkey = n_nationkey join region on n_regionkey = r_regionkey
)"""

#: The local zone of the compiler's queries.
LOCAL_KIND, LOCAL_ZONE = "metro", "nation_15"
_TYPES = {"signup": "NewCapsule", "view": "HeatSpike", "click": "HeatSpike", "purchase": "CapacityThreshold", "error": "NodeDegraded"}
_POLICIES = ("default", "metro_sync", "geo_replicated", "encrypted", "edge_optimized", "near_zero")


def telemetry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Telemetry from the events: types by event type, measures from ``value``, policies in turn."""
    e = table(spark, sf_dir, "events")
    kind = F.lit("ViewProjection")
    for k, v in _TYPES.items():
        kind = F.when(F.col("event_type") == k, F.lit(v)).otherwise(kind)
    kind = F.when(F.col("event_id") % 11 == 0, F.lit("ViewProjection")).otherwise(kind)
    policy = F.element_at(F.array(*[F.lit(p) for p in _POLICIES]), (F.col("event_id") % len(_POLICIES) + 1).cast("int"))
    return e.select(
        "event_id", "ts", kind.alias("type"), F.concat(F.lit("capsule-"), F.col("user_id").cast("string")).alias("capsule_id"), F.concat(F.lit("node-"), F.lpad((F.col("user_id") % 100 + 1).cast("string"), 8, "0")).alias("node_id"),
        F.floor("value").cast("bigint").alias("accesses_per_min"), F.floor(F.col("value") * 1000).cast("bigint").alias("used_bytes"), F.lit(400_000).cast("bigint").alias("total_bytes"), F.when(F.col("event_id") % 2 == 0, F.lit(0.85)).otherwise(F.lit(70.0)).alias("threshold_pct"),
        F.when(F.col("event_id") % 3 == 0, "disk_failure").when(F.col("event_id") % 3 == 1, "power loss").otherwise("disk failure detected").alias("reason"), F.lit("nfs").alias("view"), policy.alias("policy"),
    )


TELEMETRY_SQL = f"""
telemetry as (
  select event_id, ts, case when event_id % 11 = 0 then 'ViewProjection' {" ".join(f"when event_type = '{k}' then '{v}'" for k, v in _TYPES.items())} else 'ViewProjection' end as type,
    'capsule-' || user_id::varchar as capsule_id, 'node-' || lpad((user_id % 100 + 1)::varchar, 8, '0') as node_id, floor(value)::bigint as accesses_per_min, floor(value * 1000)::bigint as used_bytes, 400000 as total_bytes,
    case when event_id % 2 = 0 then 0.85 else 70.0 end as threshold_pct, case event_id % 3 when 0 then 'disk_failure' when 1 then 'power loss' else 'disk failure detected' end as reason,
    list_extract([{", ".join(f"'{p}'" for p in _POLICIES)}], (event_id % {len(_POLICIES)} + 1)::int) as policy
  from events
)"""
