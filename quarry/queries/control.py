"""Views, nodes, the policy compiler, audit chains and streams."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions import paths
from quarry.operators import audit, scaling, views
from quarry.policies import PRESETS, Policy, presets
from quarry.queries.base import FLEET_SQL, LOCAL_KIND, LOCAL_ZONE, TELEMETRY_SQL, fleet, table, telemetry
from quarry.shared import new_path
from quarry.sources.readers import TABLES, telemetry_stream
from quarry.streaming import actions

QUERIES, ORACLES = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


# -- objects and folders

_PUTS_SQL = r"""
pages2 as (select page_id, regexp_extract(url, '://([^/?#]+)', 1) as bucket, regexp_extract(url, '://[^/?#]+/([^?#]*)', 1) || case page_id % 4 when 0 then '.html' when 1 then '.json' when 2 then '.JPG' else '' end as key, octet_length(encode(html))::bigint as size from pages),
puts as (select page_id as seq, bucket, key, 'v1-' || page_id::varchar as capsule_id, size from pages2 union all select page_id + 1000000, bucket, key, 'v2-' || page_id::varchar, size + 1 from pages2 where page_id % 5 = 0),
objects as (select bucket || '/' || key as full_key, bucket, key, capsule_id, size from (select *, row_number() over (partition by bucket || '/' || key order by seq desc) as r from puts) where r = 1)"""
_TYPE_SQL = "case when ends_with(key, '.txt') then 'text/plain' when ends_with(key, '.json') then 'application/json' when ends_with(key, '.html') then 'text/html' when ends_with(key, '.jpg') or ends_with(key, '.jpeg') then 'image/jpeg' when ends_with(key, '.png') then 'image/png' else 'application/octet-stream' end"


def _objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "pages")
    suffix = F.element_at(F.array(F.lit(".html"), F.lit(".json"), F.lit(".JPG"), F.lit("")), (F.col("page_id") % 4 + 1).cast("int"))
    one = p.select(F.col("page_id").alias("seq"), F.regexp_extract("url", "://([^/?#]+)", 1).alias("bucket"), F.concat(F.regexp_extract("url", "://[^/?#]+/([^?#]*)", 1), suffix).alias("key"), F.octet_length(F.encode("html", "UTF-8")).cast("bigint").alias("size"))
    two = one.where("seq % 5 = 0").select((F.col("seq") + 1_000_000).alias("seq"), "bucket", "key", F.concat(F.lit("v2-"), F.col("seq").cast("string")).alias("capsule_id"), (F.col("size") + 1).alias("size"))
    puts = one.withColumn("capsule_id", F.concat(F.lit("v1-"), F.col("seq").cast("string"))).unionByName(two).withColumn("created_at", F.lit(0).cast("bigint"))
    return views.put(spark.createDataFrame([], TABLES["objects"]), puts)


@query(f"with {_PUTS_SQL} select full_key, capsule_id, size, {_TYPE_SQL} as content_type from objects")
def object_put_latest(spark, sf_dir):
    """The objects after all puts: the last one of a key counts."""
    return _objects(spark, sf_dir).select("full_key", "capsule_id", "size", "content_type")


@query(f"with {_PUTS_SQL}, b as (select min(bucket) as bucket from objects) select full_key, size from objects where starts_with(full_key, (select bucket from b) || '/')")
def object_list_bucket(spark, sf_dir):
    o = _objects(spark, sf_dir)
    return views.list_bucket(o, o.agg(F.min("bucket")).first()[0]).select("full_key", "size")


@query(f"with {_PUTS_SQL} select full_key, '\"' || capsule_id || '\"' as etag, {_TYPE_SQL} as content_type, size from objects where full_key = (select min(full_key) from objects)")
def object_head(spark, sf_dir):
    o = _objects(spark, sf_dir)
    return views.head(o, o.agg(F.min("full_key")).first()[0]).select("full_key", "etag", "content_type", "size")


@query(f"with {_PUTS_SQL} select {_TYPE_SQL} as content_type, count(*)::bigint as objects from objects group by 1")
def content_type(spark, sf_dir):
    return _objects(spark, sf_dir).groupBy("content_type").agg(F.count(F.lit(1)).alias("objects"))


@query(f"with {_PUTS_SQL} select bucket, count(*)::bigint as objects, sum(size)::bigint as bytes from objects where (('0x' || substr(md5(full_key), 1, 4))::int % 3) <> 0 group by bucket")
def object_delete(spark, sf_dir):
    """Per bucket after a third of the keys was deleted."""
    o = _objects(spark, sf_dir)
    gone = o.where(F.conv(F.substring(F.md5("full_key"), 1, 4), 16, 10).cast("int") % 3 == 0)
    return views.remove(o, gone).groupBy("bucket").agg(F.count(F.lit(1)).alias("objects"), F.sum("size").alias("bytes"))


_RAW = (("tmp/../tmp/file.txt", "/tmp/file.txt"), ("", "/"), ("/", "/"), ("/a//b/", "/a/b"), ("../../x", "/x"), ("/a/./b/../c", "/a/c"), ("a\\b/c", "/a/b/c"), ("/..", "/"), ("./.", "/"))
_RAW_SQL = ", ".join(f"('{a}', '{b}')" for a, b in _RAW)
_PATH_SQL = r"regexp_replace('/' || regexp_replace(regexp_extract(url, '://([^?#]*)', 1), '/+$', ''), '//+', '/', 'g')"


@query(f"select raw, path from (values {_RAW_SQL}) t(raw, path) union all select '/x/../' || regexp_extract(url, '://([^?#]*)', 1) || '/.', {_PATH_SQL} from pages")
def path_normalize(spark, sf_dir):
    raw = table(spark, sf_dir, "pages").select(F.concat(F.lit("/x/../"), F.regexp_extract("url", "://([^?#]*)", 1), F.lit("/.")).alias("raw"))
    given = spark.createDataFrame([(a,) for a, _ in _RAW], "raw string")
    return given.unionAll(raw).select("raw", paths.normalize(F.col("raw")).alias("path"))


_NAMESPACE_SQL = f"""
files as (select distinct {_PATH_SQL} || '/page.html' as path from pages), parts as (select path, string_split(path, '/') as p from files),
dirs as (select distinct case when i = 1 then '/' else array_to_string(p[1:i], '/') end as path from (select p, unnest(range(1, len(p))) as i from parts)),
ns as (select path, 'file' as kind from files union all select path, 'dir' from dirs),
entries as (select path, kind, case when path = '/' then null when regexp_replace(path, '/[^/]*$', '') = '' then '/' else regexp_replace(path, '/[^/]*$', '') end as parent from ns)"""


def _namespace(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.regexp_extract("url", "://([^?#]*)", 1)
    files = table(spark, sf_dir, "pages").select(F.concat(raw, F.lit("/page.html")).alias("path"), F.lit(1).cast("bigint").alias("size"), F.lit("c").alias("capsule_id")).withColumn("path", paths.normalize(F.col("path"))).dropDuplicates(["path"])
    return views.write_files(spark.createDataFrame([], TABLES["namespace"]), files, 0)


@query(f"with {_NAMESPACE_SQL} select path, kind, parent from entries")
def namespace_ancestors(spark, sf_dir):
    """Files of all pages, and every folder above them."""
    return _namespace(spark, sf_dir).select("path", "kind", "parent")


@query(f"with {_NAMESPACE_SQL} select path, kind from entries where parent = '/'")
def namespace_list_dir(spark, sf_dir):
    return views.list_dir(_namespace(spark, sf_dir), "/").select("path", "kind")


@query(f"with {_NAMESPACE_SQL} select distinct parent as path from entries where parent is not null")
def dir_nonempty(spark, sf_dir):
    return views.nonempty(_namespace(spark, sf_dir))


# -- volumes


@query("select v as name, s::bigint as size, b::bigint as block_size, regexp_full_match(v, '[A-Za-z0-9._-]+') and s > 0 and b > 0 and (case when b > 0 then s % b = 0 else false end) as valid from (values ('vol0'), ('bad/name'), (''), ('a.b_c-1')) n(v), (values (16384, 4096), (1000, 4096), (0, 4096), (4096, 0)) x(s, b)")
def volume_validate(spark, sf_dir):
    rows = spark.createDataFrame([(v, s, b) for v in ("vol0", "bad/name", "", "a.b_c-1") for s, b in ((16384, 4096), (1000, 4096), (0, 4096), (4096, 0))], "name string, size bigint, block_size bigint")
    return rows.withColumn("valid", paths.valid_volume_name(F.col("name")) & paths.valid_volume_size(F.col("size"), F.col("block_size")))


@query("select 'vol-' || p_partkey::varchar as name, i::int as block, i * 512::bigint as \"offset\" from part, range(0, 50) r(i) where i < p_size")
def volume_block_map(spark, sf_dir):
    """The blocks of a volume for each part, ``p_size`` blocks of 512 bytes."""
    v = table(spark, sf_dir, "part").select(F.concat(F.lit("vol-"), F.col("p_partkey").cast("string")).alias("name"), F.explode(F.sequence(F.lit(0), F.col("p_size") - 1)).alias("block"))
    return v.withColumn("offset", F.col("block") * F.lit(512).cast("bigint"))


@query("""with w as (select 'vol-' || p_partkey::varchar as name, p_size, (p_partkey * 37) % (p_size * 16 - 8) as o, lpad(p_partkey::varchar, 8, '0') as d from part where p_size > 1)
select name, 2::bigint as version, sha256(repeat('00', o::bigint) || hex(encode(d)) || repeat('00', (p_size * 16 - 8 - o)::bigint)) as content_hash from w""")
def volume_overwrite(spark, sf_dir):
    """A volume for each part, zeros at first; eight bytes are written somewhere, over block borders too."""
    p = table(spark, sf_dir, "part").where("p_size > 1").select(F.concat(F.lit("vol-"), F.col("p_partkey").cast("string")).alias("name"), (F.col("p_size") * 16).cast("bigint").alias("size"), F.lit(16).cast("bigint").alias("block_size"), F.lit("c").alias("capsule_id"), "p_partkey")
    made = views.create_volumes(spark.createDataFrame([], TABLES["volumes"]), p.drop("p_partkey"), 0)
    writes = p.select("name", ((F.col("p_partkey") * 37) % (F.col("size") - 8)).alias("offset"), F.encode(F.lpad(F.col("p_partkey").cast("string"), 8, "0"), "UTF-8").alias("data"), F.lit(1).cast("bigint").alias("expected_version"))
    after, blocks = views.write_blocks(made, views.zero_blocks(made), writes, 1)
    whole = blocks.groupBy("name").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block", "data"))), lambda x: F.hex(x["data"])), "").alias("h"))
    return after.join(whole, "name").select("name", "version", F.sha2("h", 256).alias("content_hash"))


def _volumes(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """A volume for each part after a write, and its blocks."""
    p = table(spark, sf_dir, "part").where("p_size > 1").select(F.concat(F.lit("vol-"), F.col("p_partkey").cast("string")).alias("name"), (F.col("p_size") * 16).cast("bigint").alias("size"), F.lit(16).cast("bigint").alias("block_size"), F.lit("c").alias("capsule_id"), "p_partkey")
    made = views.create_volumes(spark.createDataFrame([], TABLES["volumes"]), p.drop("p_partkey"), 0)
    writes = p.select("name", ((F.col("p_partkey") * 37) % (F.col("size") - 8)).alias("offset"), F.encode(F.lpad(F.col("p_partkey").cast("string"), 8, "0"), "UTF-8").alias("data"), F.lit(1).cast("bigint").alias("expected_version"))
    return views.write_blocks(made, views.zero_blocks(made), writes, 1)


_WRITTEN_SQL = "w as (select p_partkey, 'vol-' || p_partkey::varchar as name, p_size, (p_partkey * 37) % (p_size * 16 - 8) as o, lpad(p_partkey::varchar, 8, '0') as d from part where p_size > 1)"


@query(f"with {_WRITTEN_SQL} select name, 4::bigint as \"offset\", 24::bigint as length, substring(repeat('00', o::bigint) || hex(encode(d)) || repeat('00', (p_size * 16 - 8 - o)::bigint), 9, 48) as data from w")
def volume_read(spark, sf_dir):
    """24 bytes of each volume, over block borders."""
    v, blocks = _volumes(spark, sf_dir)
    reads = v.select("name", F.lit(4).cast("bigint").alias("offset"), F.lit(24).cast("bigint").alias("length"))
    return views.read_blocks(v, blocks, reads).select("name", "offset", "length", F.hex("data").alias("data"))


@query(f"with {_WRITTEN_SQL} select name, p_size * 16::bigint as size, 2::bigint as version, p_size::bigint as blocks from w where p_partkey % 3 <> 0")
def volume_list_and_delete(spark, sf_dir):
    """The volumes and their blocks after every third was deleted."""
    v, blocks = views.delete_volumes(*(own := _volumes(spark, sf_dir)), own[0].where(F.substring("name", 5, 20).cast("bigint") % 3 == 0).select("name"))
    return views.list_volumes(v).join(blocks.groupBy("name").agg(F.count(F.lit(1)).alias("blocks")), "name").select("name", "size", "version", "blocks")


@query(f"with {_WRITTEN_SQL} select name, p_size * 16::bigint as size, 16::bigint as block_size, 2::bigint as version, p_size::bigint as blocks from w where p_partkey = (select min(p_partkey) from w)")
def volume_info(spark, sf_dir):
    v, _ = _volumes(spark, sf_dir)
    first = v.agg(F.min_by("name", F.substring("name", 5, 20).cast("bigint"))).first()[0]
    return spark.createDataFrame([tuple(views.volume_info(v, first)[k] for k in ("name", "size", "block_size", "version", "blocks"))], "name string, size bigint, block_size bigint, version bigint, blocks bigint")


@query(f"""with rules(policy, rpo, sov) as (values {', '.join(f"('{p.policy}', {p.rpo_ms}, '{p.sovereignty}')" for p in PRESETS)}), names as (select list(policy order by policy) as all_ from rules),
c as (select 'cap-' || o_orderkey::varchar as capsule_id, list_extract(all_, (o_orderkey % 8 + 1)::int) as policy from orders, names), {FLEET_SQL}, p as (select node_id from nodes order by node_id limit 2)
select capsule_id, 'Mirror' as action, node_id, null as zone from c join rules using (policy), p where rpo = 0 union all select capsule_id, 'Federate', null, '{LOCAL_KIND}:{LOCAL_ZONE}' from c join rules using (policy) where sov <> 'Local'""")
def after_write_plan(spark, sf_dir):
    """What is due after capsules are written: mirrors where the recovery point is 0, federation where the data isn't local."""
    names = F.array(*[F.lit(x) for x in sorted(p.policy for p in PRESETS)])
    capsules = table(spark, sf_dir, "orders").select(F.concat(F.lit("cap-"), F.col("o_orderkey").cast("string")).alias("capsule_id"), F.element_at(names, (F.col("o_orderkey") % len(PRESETS) + 1).cast("int")).alias("policy"))
    return scaling.after_write(capsules, presets(spark), fleet(spark, sf_dir), LOCAL_KIND, LOCAL_ZONE)


# -- nodes and the compiler

_NEAR_ZERO = Policy("near_zero", rpo_ms=30_000, latency_target_ms=5, sovereignty="Global")
_RULES = ", ".join(f"('{p}', {r}, {n}, '{s}')" for p, r, n, s in (("default", 60_000, 10, "Local"), ("metro_sync", 0, 2, "Zone"), ("geo_replicated", 300_000, 100, "Global"), ("encrypted", 60_000, 10, "Local"), ("edge_optimized", 300_000, 50, "Local"), ("near_zero", 30_000, 5, "Global")))
_LOCAL_SQL = f"zone_type = '{LOCAL_KIND}' and zone_name = '{LOCAL_ZONE}'"
_COMPILER_SQL = f"""with {FLEET_SQL}, {TELEMETRY_SQL}, rules(policy, rpo_ms, latency, sovereignty) as (values {_RULES}), ev as (select telemetry.* exclude (policy), rules.* from telemetry join rules on rules.policy = case when type = 'NewCapsule' then telemetry.policy else 'metro_sync' end),
fit as (select e.*, n.node_id as target, n.ord, n.zone_type, n.zone_name, n.available_bytes, case when available_bytes + n.used_bytes = 0 then 0 else n.used_bytes * 100 // (available_bytes + n.used_bytes) end as util from ev e join nodes n on e.sovereignty = 'Global' or e.sovereignty = 'Zone' and {_LOCAL_SQL}),
rep as (select event_id, capsule_id, rpo_ms, string_agg(target, ',' order by ord) as targets from (select *, row_number() over (partition by event_id order by ord) as r from fit where type = 'NewCapsule' and rpo_ms < 60000 and available_bytes >= 1000000 and case when latency < 2 then zone_type = 'metro' when latency < 100 then {_LOCAL_SQL} else true end) where r <= 2 group by all),
mig as (select * from (select *, row_number() over (partition by event_id order by util, ord) as r from fit where type = 'HeatSpike' and accesses_per_min > 100 and latency < 10 and available_bytes >= 10000000 and (latency >= 2 or zone_type = 'metro')) where r = 1),
spare as (select string_agg(node_id, ',' order by ord) as targets from nodes where available_bytes + used_bytes > 0 and used_bytes * 100.0 / (available_bytes + used_bytes) < 50),
zs as (select zone, min(ord) as ord from (select zone_type || ':' || zone_name as zone, ord from nodes) where zone <> '{LOCAL_KIND}:{LOCAL_ZONE}' group by zone union all select '{LOCAL_KIND}:{LOCAL_ZONE}', -1),
allz as (select string_agg(zone, ',' order by ord) as targets from zs),
n(x) as (select null::varchar),
a_rep as (select event_id, 'Replicate' as action, capsule_id, case when rpo_ms = 0 then 'MetroSync' else 'Async' end as strategy, case when rpo_ms > 0 then rpo_ms::bigint end as rpo_ms, targets, x as destination, null::boolean as transform, x as reason, x as urgency, x as zone, null::int as parity from rep, n),
a_mig as (select event_id, 'Migrate' as action, capsule_id, x as strategy, null::bigint as rpo_ms, x as targets, target as destination, sovereignty = 'Zone' and (zone_type || ':' || zone_name) <> '{LOCAL_KIND}:{LOCAL_ZONE}' as transform, 'heat_spike_' || accesses_per_min::varchar || '_accesses_per_min' as reason, x as urgency, x as zone, null::int as parity from mig, n),
a_reb as (select event_id, 'Rebalance' as action, x as capsule_id, x as strategy, null::bigint as rpo_ms, targets, node_id as destination, null::boolean as transform, x as reason, x as urgency, x as zone, null::int as parity from ev, spare, n where type = 'CapacityThreshold' and used_bytes * 100.0 / total_bytes >= case when abs(threshold_pct) <= 1 then threshold_pct * 100 else threshold_pct end and used_bytes * 100.0 / total_bytes >= 80 and targets is not null),
a_eva as (select event_id, 'Evacuate' as action, x as capsule_id, x as strategy, null::bigint as rpo_ms, x as targets, node_id as destination, null::boolean as transform, reason, case when contains(reason, 'disk_failure') or contains(reason, 'power') then 'Immediate' else 'Gradual' end as urgency, x as zone, null::int as parity from ev, n where type = 'NodeDegraded'),
a_view as (select event_id, 'Federate' as action, capsule_id, x as strategy, null::bigint as rpo_ms, x as targets, x as destination, null::boolean as transform, x as reason, x as urgency, '{LOCAL_KIND}:{LOCAL_ZONE}' as zone, null::int as parity from ev, n where type = 'ViewProjection' and sovereignty <> 'Local'
  union all select event_id, 'ShardEC', capsule_id, x, null, targets, x, null, x, x, x, 2 from ev, allz, n where type = 'ViewProjection')
"""


def _compiled(spark: SparkSession, sf_dir: str, *names: str) -> DataFrame:
    done = scaling.agent_actions(telemetry(spark, sf_dir), presets(spark, _NEAR_ZERO), fleet(spark, sf_dir), LOCAL_KIND, LOCAL_ZONE)
    return done.where(F.col("action").isin(*names)) if names else done


@query(f"with {FLEET_SQL} select node_id, zone_type, zone_name, case when available_bytes + used_bytes = 0 then 0 else used_bytes * 100 // (available_bytes + used_bytes) end::bigint as util from nodes")
def node_utilization(spark, sf_dir):
    return scaling.nodes_with(fleet(spark, sf_dir), LOCAL_KIND, LOCAL_ZONE).select("node_id", "zone_type", "zone_name", "util")


@query(f"with {FLEET_SQL} select node_id, ord from nodes where available_bytes + used_bytes > 0 and used_bytes * 100.0 / (available_bytes + used_bytes) < 50")
def nodes_underutilized(spark, sf_dir):
    return scaling.underutilized(fleet(spark, sf_dir)).select("node_id", "ord")


@query(f"with {FLEET_SQL} select zone, min(ord)::bigint as ord from (select zone_type || ':' || zone_name as zone, ord from nodes) where zone <> '{LOCAL_KIND}:{LOCAL_ZONE}' group by zone union all select '{LOCAL_KIND}:{LOCAL_ZONE}', -1")
def zone_unique(spark, sf_dir):
    return scaling.unique_zones(fleet(spark, sf_dir), LOCAL_KIND, LOCAL_ZONE)


@query(_COMPILER_SQL + "select event_id, strategy, rpo_ms, targets from a_rep")
def replicate_targets(spark, sf_dir):
    return _compiled(spark, sf_dir, "Replicate").select("event_id", "strategy", "rpo_ms", "targets")


@query(_COMPILER_SQL + "select event_id, destination, transform, reason from a_mig")
def migrate_target(spark, sf_dir):
    return _compiled(spark, sf_dir, "Migrate").select("event_id", "destination", "transform", "reason")


@query(_COMPILER_SQL + "select event_id, destination, targets from a_reb")
def rebalance_actions(spark, sf_dir):
    return _compiled(spark, sf_dir, "Rebalance").select("event_id", "destination", "targets")


@query(_COMPILER_SQL + "select event_id, destination, reason, urgency from a_eva")
def evacuate_actions(spark, sf_dir):
    return _compiled(spark, sf_dir, "Evacuate").select("event_id", "destination", "reason", "urgency")


@query(_COMPILER_SQL + "select event_id, action, capsule_id, targets, zone, parity from a_view")
def view_projection_actions(spark, sf_dir):
    return _compiled(spark, sf_dir, "Federate", "ShardEC").select("event_id", "action", "capsule_id", "targets", "zone", "parity")


@query(_COMPILER_SQL + "select * from a_rep union all select * from a_mig union all select * from a_reb union all select * from a_eva union all select * from a_view")
def compile_all_actions(spark, sf_dir):
    return _compiled(spark, sf_dir)


#: The compiler alone: every event under the policy that it names.
_NAMED_SQL = re.sub(r"ev as \(.*?\),\nfit", "ev as (select * from telemetry join rules using (policy)),\nfit", _COMPILER_SQL)


@query(_NAMED_SQL + "select * from a_rep union all select * from a_mig union all select * from a_reb union all select * from a_eva union all select * from a_view")
def compile_under_named_policy(spark, sf_dir):
    return scaling.compile_actions(telemetry(spark, sf_dir), presets(spark, _NEAR_ZERO), fleet(spark, sf_dir), LOCAL_KIND, LOCAL_ZONE)


@query(f"with {FLEET_SQL} select node_id, (zone_type || ':' || zone_name) <> '{LOCAL_KIND}:{LOCAL_ZONE}' as needs_transform from nodes")
def transform_required(spark, sf_dir):
    here = scaling.zone_label(F.lit(LOCAL_KIND), F.lit(LOCAL_ZONE))
    return fleet(spark, sf_dir).select("node_id", scaling.needs_transform(scaling.zone_label(F.col("zone_type"), F.col("zone_name")), here).alias("needs_transform"))


@query(f"select policy, sovereignty <> 'Local' as allowed from (values {_RULES}) t(policy, a, b, sovereignty) where policy <> 'near_zero'")
def migrate_allowed(spark, sf_dir):
    return presets(spark).where(F.col("policy").isin("default", "metro_sync", "geo_replicated", "encrypted", "edge_optimized")).select("policy", scaling.may_migrate(F.col("sovereignty")).alias("allowed"))


@query("select event_id, (case when user_id % 7 = 0 then 401 when user_id % 7 = 1 then 400 when user_id % 7 in (2, 3) then 200 else 403 end)::int as status from events")
def allow_list_filter(spark, sf_dir):
    k = F.col("user_id") % 7
    asked = table(spark, sf_dir, "events").select("event_id", F.when(k == 0, F.lit(None).cast("string")).when(k == 1, "not an identity").otherwise(F.concat(F.lit("spiffe://fleet/"), k.cast("string"))).alias("identity"))
    allowed = spark.createDataFrame([("spiffe://fleet/2",), ("spiffe://fleet/3",)], "identity string")
    return scaling.authorize(asked, allowed, False).select("event_id", "status")


@query(f"""with {FLEET_SQL}, z as (select zone, row_number() over (order by ord) - 1 as i from (select zone, min(ord) as ord from (select zone_type || ':' || zone_name as zone, ord from nodes) where zone <> '{LOCAL_KIND}:{LOCAL_ZONE}' group by zone union all select '{LOCAL_KIND}:{LOCAL_ZONE}', -1)),
c as (select md5(o_orderkey::varchar) as h from orders where o_orderstatus = 'F'), b as (select h, ('0x' || h[15:16] || h[13:14] || h[11:12] || h[9:10] || h[7:8] || h[5:6] || h[3:4] || h[1:2])::hugeint as base from c)
select h as capsule_id, zone, ((base + i) % 18446744073709551616::hugeint)::varchar as shard_key from b, z""")
def metadata_shards(spark, sf_dir):
    capsules = table(spark, sf_dir, "orders").where("o_orderstatus = 'F'").select(F.md5(F.col("o_orderkey").cast("string")).alias("capsule_id"))
    zones = scaling.unique_zones(fleet(spark, sf_dir), LOCAL_KIND, LOCAL_ZONE)
    return scaling.metadata_shards(capsules, zones).select("capsule_id", "zone", F.col("shard_key").cast("string").alias("shard_key"))


@query(f"with {FLEET_SQL}, p as (select node_id from nodes order by node_id limit 2) select p_partkey as segment_id, node_id from part, p")
def mirror_plan(spark, sf_dir):
    return scaling.mirror_plan(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("segment_id")), fleet(spark, sf_dir))


@query("select date_trunc('minute', ts) as window_start, 'capsule-' || user_id::varchar as capsule_id, count(*)::bigint as accesses_per_min from events where event_type in ('view', 'click') group by all")
def heat_per_minute(spark, sf_dir):
    e = table(spark, sf_dir, "events").where(F.col("event_type").isin("view", "click"))
    return actions.heat(e.select("ts", F.concat(F.lit("capsule-"), F.col("user_id").cast("string")).alias("capsule_id")))


# -- audit


def _records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A log for each user; records in order of time and id, counted from 1."""
    from pyspark.sql import Window as W

    e = table(spark, sf_dir, "events")
    seq = F.row_number().over(W.partitionBy("user_id").orderBy("ts", "event_id"))
    return e.select(F.col("user_id").alias("log_id"), seq.cast("bigint").alias("seq"), F.col("event_type").alias("event"), F.concat(F.lit('{"event":"'), F.col("event_type"), F.lit('","id":'), F.col("event_id").cast("string"), F.lit("}")).alias("payload"), F.unix_timestamp("ts").alias("timestamp"))


_RECORDS_SQL = """r as (select user_id as log_id, row_number() over (partition by user_id order by ts, event_id) as seq, event_type as event, '{"event":"' || event_type || '","id":' || event_id::varchar || '}' as payload, floor(epoch(ts))::bigint as ts from events),
le as (select *, unhex(h[15:16] || h[13:14] || h[11:12] || h[9:10] || h[7:8] || h[5:6] || h[3:4] || h[1:2]) as t from (select *, lpad(hex(floor(ts)::bigint), 16, '0') as h from r))"""


@query(f"with recursive {_RECORDS_SQL}, c as (select log_id, seq, event, repeat('0', 64) as prev_hash, sha256(unhex(repeat('00', 32)) || encode(payload) || t) as hash from le where seq = 1 union all select le.log_id, le.seq, le.event, c.hash, sha256(unhex(c.hash) || encode(le.payload) || le.t) from c join le on le.log_id = c.log_id and le.seq = c.seq + 1) select log_id, seq, event, prev_hash, hash from c")
def audit_chain_build(spark, sf_dir):
    return audit.chain(_records(spark, sf_dir)).select("log_id", "seq", "event", "prev_hash", "hash")


@query("select user_id as log_id, count(*)::bigint as records, count(*)::bigint as hashes_ok, count(*)::bigint as links_ok from events group by user_id")
def audit_chain_verify(spark, sf_dir):
    v = audit.verify(audit.chain(_records(spark, sf_dir)))
    return v.groupBy("log_id").agg(F.count(F.lit(1)).alias("records"), F.count_if("hash_ok").alias("hashes_ok"), F.count_if("link_ok").alias("links_ok"))


@query(f"with {_RECORDS_SQL} select log_id, max(seq)::bigint as last_seq, arg_max(event, seq) as last_event from r group by log_id")
def audit_trail(spark, sf_dir):
    chained = audit.chain(_records(spark, sf_dir))
    last = audit.trail(chained)
    return last.join(chained.select("log_id", F.col("seq").alias("last_seq"), F.col("event").alias("last_event"), "hash"), ["log_id", "last_seq"]).where("hash = last_hash").select("log_id", "last_seq", "last_event")


@query(f"with {_RECORDS_SQL} select log_id, seq::bigint as seq from r where seq % 20 = 0")
def audit_tsa_marks(spark, sf_dir):
    return audit.tsa_marks(_records(spark, sf_dir), 20).where("tsa").select("log_id", "seq")


@query("select event_type as event, count(*)::bigint as records from events group by event_type")
def audit_event_counts(spark, sf_dir):
    return _records(spark, sf_dir).groupBy("event").agg(F.count(F.lit(1)).alias("records"))


@query(f"""with recursive {_RECORDS_SQL}, z as (select log_id, seq, octet_length(encode('{{"log_id":' || log_id::varchar || ',"seq":' || seq::varchar || ',"event":"' || event || '","payload":' || to_json(payload)::varchar || ',"timestamp":' || ts::varchar || '}}')) + 1 as n from r),
c as (select log_id, seq, 0 as file, n as held from z where seq = 1 union all select z.log_id, z.seq, case when c.held >= 600 then c.file + 1 else c.file end, case when c.held >= 600 then z.n else c.held + z.n end from c join z on z.log_id = c.log_id and z.seq = c.seq + 1)
select log_id, seq::bigint as seq, file::int as file from c""")
def audit_rotation(spark, sf_dir):
    """The file of each record, where a file is left after the write with which it reaches 600 bytes."""
    return audit.rotation(_records(spark, sf_dir), 600).select("log_id", "seq", "file")


# -- streams


def _shared(spark: SparkSession, name: str) -> str:
    return new_path(spark, f"stream-{name}")


@query(_COMPILER_SQL + "select * from a_rep union all select * from a_mig union all select * from a_reb union all select * from a_eva union all select * from a_view")
def stream_compile_actions(spark, sf_dir):
    """The compiler over telemetry that arrives as a file stream; the same rows as the batch."""
    root = _shared(spark, "actions")
    telemetry(spark, sf_dir).write.parquet(f"{root}/in")
    sink = actions.action_sink(f"{root}/out", presets(spark, _NEAR_ZERO), fleet(spark, sf_dir), LOCAL_KIND, LOCAL_ZONE)
    q = telemetry_stream(spark, f"{root}/in").writeStream.foreachBatch(sink).option("checkpointLocation", f"{root}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.parquet(f"{root}/out").drop("batch_id")


@query("select sha256(encode(text)) as content_hash from documents group by text")
def stream_dedup(spark, sf_dir):
    """The first arrival of each text's hash from a stream of documents."""
    root = _shared(spark, "dedup")
    docs = table(spark, sf_dir, "documents").select(F.sha2(F.encode("text", "UTF-8"), 256).alias("content_hash"), F.timestamp_seconds(F.lit(1_700_000_000)).alias("ts"))
    docs.write.parquet(f"{root}/in")
    stream = spark.readStream.schema(docs.schema).parquet(f"{root}/in")
    q = actions.new_chunks(stream).select("content_hash").writeStream.format("parquet").option("path", f"{root}/out").option("checkpointLocation", f"{root}/state").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema("content_hash string").parquet(f"{root}/out")
