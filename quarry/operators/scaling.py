"""The policy compiler: telemetry events become placement actions, by joins with small tables of nodes and policies.

Thresholds are strict or not exactly as the rules say: replication only below 60 s of recovery point, heat above 100 accesses a minute
and below 10 ms, capacity from 80 % and nodes below 50 %.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quarry.plans.sizes import small_side

REPLICATE_BYTES, MIGRATE_BYTES = 1_000_000, 10_000_000
HEAT, HEAT_LATENCY_MS, USED_LIMIT, SPARE_LIMIT, ASYNC_RPO_MS, REPLICAS, PARITY = 100, 10, 80, 50, 60_000, 2, 2

ACTION = "event_id bigint, action string, capsule_id string, strategy string, rpo_ms bigint, targets string, destination string, transform boolean, reason string, urgency string, zone string, parity int"
_COLUMNS = [c.split(" ") for c in ACTION.split(", ")]


def zone_label(kind: Column, name: Column) -> Column:
    return F.concat(F.lower(kind), F.lit(":"), name)


def utilization(used: Column, total: Column) -> Column:
    """Whole percent, rounded down; 0 of nothing."""
    return F.when(total == 0, F.lit(0)).otherwise(F.call_function("div", used * 100, F.when(total != 0, total))).cast("bigint")


def used_percent(used: Column, total: Column) -> Column:
    return F.when(total == 0, F.lit(0.0)).otherwise(used * 100.0 / F.when(total != 0, total))


def threshold_percent(t: Column) -> Column:
    """Thresholds up to 1 are fractions."""
    return F.when(F.abs(t) <= 1, t * 100).otherwise(t)


def sovereign(level: Column, node_kind: Column, node_zone: Column, local_kind: Column, local_zone: Column) -> Column:
    """Global data may go anywhere, zonal data to the local zone, local data nowhere."""
    return F.when(level == "Global", True).when(level == "Zone", (node_kind == local_kind) & (node_zone == local_zone)).otherwise(False)


def same_geo(node_kind: Column, node_zone: Column, local_kind: Column, local_zone: Column) -> Column:
    return (node_kind == local_kind) & (node_zone == local_zone) & node_kind.isin("metro", "geo")


def needs_transform(source: Column, destination: Column) -> Column:
    return source != destination


def may_migrate(level: Column) -> Column:
    return level != "Local"


def authorize(requests: DataFrame, allowed: DataFrame, allow_empty: bool) -> DataFrame:
    """``requests(identity)`` with ``status``: 401 without an identity, 400 for a malformed one, 403 for one that isn't on a list that has entries, else 200."""
    known = requests.join(allowed.select(F.col("identity").alias("__i")).distinct(), F.col("identity") == F.col("__i"), "left")
    ok = F.when(F.col("identity").isNull() | (F.col("identity") == ""), 401).when(~F.col("identity").rlike("^spiffe://[^ ]+$"), 400).when(F.lit(allow_empty) | F.col("__i").isNotNull(), 200).otherwise(403)
    return known.withColumn("status", ok).drop("__i")


def refresh_allow_list(current: DataFrame, answer: DataFrame) -> DataFrame:
    """The new list; an empty answer keeps the old one."""
    return answer if answer.first() is not None else current


def nodes_with(nodes: DataFrame, local_kind: str, local_zone: str) -> DataFrame:
    """``nodes`` with (util, local_kind, local_zone)."""
    total = F.col("available_bytes") + F.col("used_bytes")
    return nodes.withColumns({"util": utilization(F.col("used_bytes"), total), "total": total, "local_kind": F.lit(local_kind), "local_zone": F.lit(local_zone)})


def underutilized(nodes: DataFrame, limit: int = SPARE_LIMIT) -> DataFrame:
    """Nodes used below ``limit`` percent; nodes of no size are left out."""
    total = F.col("available_bytes") + F.col("used_bytes")
    return nodes.where((total > 0) & (used_percent(F.col("used_bytes"), total) < limit))


def unique_zones(nodes: DataFrame, local_kind: str, local_zone: str) -> DataFrame:
    """(zone, ord): the local zone first, then the others as first seen."""
    here = zone_label(F.lit(local_kind), F.lit(local_zone))
    return nodes.select(zone_label(F.col("zone_type"), F.col("zone_name")).alias("zone"), "ord").groupBy("zone").agg(F.min("ord").cast("bigint").alias("ord")).where(F.col("zone") != here).unionByName(nodes.sparkSession.range(1).select(here.alias("zone"), F.lit(-1).cast("bigint").alias("ord")))


def _row(df: DataFrame, **values: Column) -> DataFrame:
    return df.select(*[(values[n] if n in values else F.lit(None)).cast(t).alias(n) for n, t in _COLUMNS])


def _pairs(rules: DataFrame, nodes: DataFrame) -> DataFrame:
    """Every policy with every node it may use: what an event may reach depends on its policy alone, so events don't take part. Nodes are checked before they are broadcast."""
    allowed = sovereign(F.col("sovereignty"), F.col("zone_type"), F.col("zone_name"), F.col("local_kind"), F.col("local_zone"))
    return rules.select("policy", "rpo_ms", "latency_target_ms", "sovereignty").join(small_side(nodes, nodes.count(), 256), allowed)


def _near(metro_below: Column, geo_below: Column | None = None) -> Column:
    ok = F.when(metro_below, F.col("zone_type") == "metro")
    if geo_below is not None:
        ok = ok.when(geo_below, same_geo(F.col("zone_type"), F.col("zone_name"), F.col("local_kind"), F.col("local_zone")))
    return ok.otherwise(True)


def _by_policy(events: DataFrame, targets: DataFrame) -> DataFrame:
    """``events`` with their policy's targets: one row a policy, so a small side."""
    return events.join(small_side(targets, targets.count(), 512), "policy")


def replicate(events: DataFrame, rules: DataFrame, nodes: DataFrame) -> DataFrame:
    """New capsules with a recovery point under a minute: the first two nodes in list order that qualify."""
    fit = _pairs(rules.where(F.col("rpo_ms") < ASYNC_RPO_MS), nodes).where(_near(F.col("latency_target_ms") < 2, F.col("latency_target_ms") < 100) & (F.col("available_bytes") >= REPLICATE_BYTES))
    ranked = fit.withColumn("__r", F.row_number().over(W.partitionBy("policy").orderBy("ord", "node_id"))).where(F.col("__r") <= REPLICAS)
    first = ranked.groupBy("policy").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "node_id"))), lambda x: x["node_id"]), ",").alias("targets"))
    sent = _by_policy(events.where("type = 'NewCapsule'"), first)
    sync = F.col("rpo_ms") == 0
    return _row(sent, event_id=F.col("event_id"), action=F.lit("Replicate"), capsule_id=F.col("capsule_id"), strategy=F.when(sync, F.lit("MetroSync")).otherwise(F.lit("Async")), rpo_ms=F.when(~sync, F.col("rpo_ms")), targets=F.col("targets"))


def migrate(events: DataFrame, rules: DataFrame, nodes: DataFrame) -> DataFrame:
    """Hot capsules with a tight latency: to the least used node that qualifies, the first of equals."""
    fit = _pairs(rules.where(F.col("latency_target_ms") < HEAT_LATENCY_MS), nodes).where(_near(F.col("latency_target_ms") < 2) & (F.col("available_bytes") >= MIGRATE_BYTES))
    best = fit.groupBy("policy").agg(F.min_by(F.struct(F.col("node_id").alias("to"), "zone_type", "zone_name", "local_kind", "local_zone"), F.struct("util", "ord")).alias("n")).select("policy", "n.*")
    hot = _by_policy(events.where(f"type = 'HeatSpike' and accesses_per_min > {HEAT}"), best)
    moved = needs_transform(zone_label(F.col("zone_type"), F.col("zone_name")), zone_label(F.col("local_kind"), F.col("local_zone"))) & (F.col("sovereignty") == "Zone")
    return _row(hot, event_id=F.col("event_id"), action=F.lit("Migrate"), capsule_id=F.col("capsule_id"), destination=F.col("to"), transform=moved, reason=F.concat(F.lit("heat_spike_"), F.col("accesses_per_min").cast("string"), F.lit("_accesses_per_min")))


def rebalance(events: DataFrame, nodes: DataFrame) -> DataFrame:
    """Full nodes, if some node has room: all of those with room are targets, in list order."""
    percent = used_percent(F.col("used_bytes"), F.col("total_bytes"))
    full = events.where("type = 'CapacityThreshold'").where((percent >= threshold_percent(F.col("threshold_pct"))) & (percent >= USED_LIMIT))
    spare = underutilized(nodes).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "node_id"))), lambda x: x["node_id"]), ",").alias("targets")).where("targets <> ''")
    return _row(full.select("event_id", "node_id").join(small_side(spare, nodes.count(), 64)), event_id=F.col("event_id"), action=F.lit("Rebalance"), destination=F.col("node_id"), targets=F.col("targets"))


def evacuate(events: DataFrame) -> DataFrame:
    urgent = F.contains(F.col("reason"), F.lit("disk_failure")) | F.contains(F.col("reason"), F.lit("power"))
    return _row(events.where("type = 'NodeDegraded'"), event_id=F.col("event_id"), action=F.lit("Evacuate"), destination=F.col("node_id"), reason=F.col("reason"), urgency=F.when(urgent, F.lit("Immediate")).otherwise(F.lit("Gradual")))


def project(events: DataFrame, nodes: DataFrame, local_kind: str, local_zone: str) -> DataFrame:
    """View projections: federation unless the data is local, and shards over all zones."""
    seen = events.where("type = 'ViewProjection'")
    zones = unique_zones(nodes, local_kind, local_zone).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "zone"))), lambda x: x["zone"]), ",").alias("targets"))
    here = zone_label(F.lit(local_kind), F.lit(local_zone))
    federate = _row(seen.where("sovereignty <> 'Local'"), event_id=F.col("event_id"), action=F.lit("Federate"), capsule_id=F.col("capsule_id"), zone=here)
    shard = _row(seen.join(small_side(zones, nodes.count(), 64)), event_id=F.col("event_id"), action=F.lit("ShardEC"), capsule_id=F.col("capsule_id"), targets=F.col("targets"), parity=F.lit(PARITY))
    return federate.unionByName(shard)


def compile_actions(telemetry: DataFrame, policies: DataFrame, nodes: DataFrame, local_kind: str = "metro", local_zone: str = "local") -> DataFrame:
    """The compiler: all actions for events under the policy that each names, or ``metro_sync`` where it names none."""
    rules = policies.select(F.col("policy"), "rpo_ms", "latency_target_ms", "sovereignty")
    events = telemetry.withColumn("policy", F.coalesce("policy", F.lit("metro_sync"))).join(small_side(rules, rules.count(), 128), "policy")
    known = nodes_with(nodes, local_kind, local_zone)
    slim = known.select("node_id", "ord", "zone_type", "zone_name", "available_bytes", "util", "local_kind", "local_zone")
    own = events.drop("node_id")
    return replicate(own, rules, slim).unionByName(migrate(own, rules, slim)).unionByName(rebalance(events, nodes)).unionByName(evacuate(events)).unionByName(project(own, nodes, local_kind, local_zone))


def agent_policy(kind: Column, policy: Column) -> Column:
    """The policy under which the agent compiles telemetry: a new capsule's own, and ``metro_sync`` for every other event, whatever it names."""
    return F.when(kind == "NewCapsule", F.coalesce(policy, F.lit("metro_sync"))).otherwise(F.lit("metro_sync"))


def agent_actions(telemetry: DataFrame, policies: DataFrame, nodes: DataFrame, local_kind: str = "metro", local_zone: str = "local") -> DataFrame:
    """The agent: all actions for ``telemetry`` by its own rule of policies. A view that is projected under its capsule's policy is compiled by ``compile_actions``."""
    return compile_actions(telemetry.withColumn("policy", agent_policy(F.col("type"), F.col("policy"))), policies, nodes, local_kind, local_zone)


def peers_after(peers: DataFrame, registered: DataFrame) -> DataFrame:
    """Known nodes after registrations, ``registered`` replacing rows of the same ``node_id``."""
    return peers.join(registered.select("node_id"), "node_id", "left_anti").unionByName(registered, allowMissingColumns=True)


def after_write(capsules: DataFrame, policies: DataFrame, peers: DataFrame, local_kind: str = "metro", local_zone: str = "local") -> DataFrame:
    """(capsule_id, action, node_id, zone) due after ``capsules(capsule_id, policy)`` are written: a mirror on each of the first peers where the recovery
    point is 0, and a federation with the local zone unless the data is local."""
    rules = policies.select("policy", "rpo_ms", "sovereignty")
    known = capsules.select("capsule_id", "policy").join(small_side(rules, rules.count(), 128), "policy")
    mirrors = mirror_plan(known.where("rpo_ms = 0").select(F.col("capsule_id").alias("segment_id")), peers).select(F.col("segment_id").alias("capsule_id"), F.lit("Mirror").alias("action"), "node_id", F.lit(None).cast("string").alias("zone"))
    here = zone_label(F.lit(local_kind), F.lit(local_zone))
    federated = known.where("sovereignty <> 'Local'").select("capsule_id", F.lit("Federate").alias("action"), F.lit(None).cast("string").alias("node_id"), here.alias("zone"))
    return mirrors.unionAll(federated)


def metadata_shards(capsules: DataFrame, zones: DataFrame) -> DataFrame:
    """(capsule_id, zone, shard_key): each zone with a key of its own."""
    from quarry.functions.payload import shard_keys

    listed = zones.agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", "zone"))), lambda x: x["zone"]).alias("zones"))
    both = capsules.select("capsule_id").join(small_side(listed, zones.count(), 64))
    return both.select("capsule_id", F.explode(F.arrays_zip("zones", shard_keys(F.col("capsule_id"), F.size("zones")).alias("keys"))).alias("z")).select("capsule_id", F.col("z.zones").alias("zone"), F.col("z.keys").alias("shard_key"))


def mirror_plan(segments: DataFrame, peers: DataFrame, copies: int = REPLICAS) -> DataFrame:
    """(segment_id, node_id): every segment on the first ``copies`` peers by id."""
    return segments.select("segment_id").join(F.broadcast(peers.select("node_id").orderBy("node_id").limit(copies)))
