"""Invariants, rules and errors of the library, and defects it must not have."""

import hashlib
import math

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quarry.errors import CatalogError, CompressionError, EncryptionError, QuarryError, ViewError
from quarry.functions import codecs, crypto, paths, payload
from quarry.operators import audit, bloom, catalog, dedup, layout, scaling, views
from quarry.plans.sizes import small_side
from quarry.policies import Policy, parse_policy, preset, presets
from quarry.sources import readers

KEY = bytes(range(32))


def payloads(spark, rows):
    return spark.createDataFrame([(n, bytearray(d)) for n, d in rows], "name string, data binary")


def written(spark, rows, policy="text_optimized", ring=None, size=4096, before=None):
    return catalog.write(before or catalog.Catalog.empty(spark), payloads(spark, rows), preset(policy) if isinstance(policy, str) else policy, ring, size)


def back(c, ring=None):
    return {r["capsule_id"]: bytes(r["data"]) for r in catalog.read(c, ring=ring).collect()}


# -- catalog


def test_round_trip_ids_sizes_and_counts(spark):
    multi = b"".join(bytes([i]) * 4096 for i in range(3)) + bytes(i * 37 % 251 for i in range(2048))
    rows = [("a", multi), ("b", multi), ("empty", b""), ("c", b"x" * 10_000)]
    c = written(spark, rows)
    assert back(c) == dict(rows)
    caps = {r["capsule_id"]: r for r in c.capsules.collect()}
    assert [caps[k]["segment_count"] for k in ("a", "b", "empty", "c")] == [4, 4, 0, 3]
    assert caps["a"]["size"] == len(multi) and caps["empty"]["size"] == 0
    segs = {r["segment_id"]: r for r in c.segments.collect()}
    assert sorted(segs) == list(range(len(segs)))
    ends = 0
    for i in sorted(segs):
        assert segs[i]["offset"] == ends
        ends += segs[i]["len"]
    links = c.capsule_segments.collect()
    assert sorted(r["segment_id"] for r in links if r["capsule_id"] == "a") == sorted(r["segment_id"] for r in links if r["capsule_id"] == "b")
    for i, s in segs.items():
        n = sum(r["segment_id"] == i for r in links)
        assert s["ref_count"] == n and s["deduplicated"] == (n > 1)
    assert caps["a"]["deduped_bytes"] == 0 and caps["b"]["deduped_bytes"] > 0


def test_second_batch_reuses_the_store_and_ids_go_on(spark):
    one = written(spark, [("a", b"shared payload " * 512)])
    two = written(spark, [("b", b"shared payload " * 512), ("n", bytes(range(256)) * 20)], before=one)
    assert back(two)["b"] == b"shared payload " * 512
    ids = [r["segment_id"] for r in two.segments.collect()]
    assert len(ids) == len(set(ids)) and sorted(ids) == list(range(len(ids)))
    assert {r["segment_id"] for r in two.capsule_segments.where("capsule_id = 'a'").collect()} == {r["segment_id"] for r in two.capsule_segments.where("capsule_id = 'b'").collect()}
    with pytest.raises(CatalogError):
        written(spark, [("a", b"again")], before=two)
    with pytest.raises(CatalogError):
        written(spark, [("x", b"1"), ("x", b"2")])


def test_delete_counts_down_then_removes(spark):
    c = written(spark, [("a", b"shared payload " * 300), ("b", b"shared payload " * 300)])
    c = catalog.delete(c, spark.createDataFrame([("a",)], "capsule_id string"))
    assert {r["ref_count"] for r in c.segments.collect()} == {1} and back(c) == {"b": b"shared payload " * 300}
    c = catalog.delete(c, spark.createDataFrame([("b",)], "capsule_id string"))
    assert c.segments.count() == 0 and c.content_store.count() == 0


def test_orphans_are_collected(spark):
    c = written(spark, [("a", b"temporary capsule")])
    lost = catalog.Catalog(c.capsules.limit(0), c.capsule_segments.limit(0), c.segments, c.content_store)
    assert catalog.orphans(lost).count() == 1 and catalog.collect(lost).segments.count() == 0


def test_dedupe_off_stores_everything_and_leaves_the_store_empty(spark):
    c = written(spark, [("a", b"Same data" * 1000), ("b", b"Same data" * 1000)], "precompressed")
    assert c.segments.count() == c.capsule_segments.count() == 6 and c.content_store.count() == 0
    assert back(c)["b"] == b"Same data" * 1000


def test_encrypted_and_plain_segments_never_stand_for_each_other(spark):
    ring = crypto.KeyRing(KEY)
    plain = written(spark, [("a", b"text " * 999)], "default")
    both = written(spark, [("b", b"text " * 999)], "encrypted", ring, before=plain)
    assert both.segments.where("encrypted").count() > 0 and back(both, ring) == {"a": b"text " * 999, "b": b"text " * 999}
    with pytest.raises(EncryptionError):
        written(spark, [("c", b"z")], "encrypted")


def test_a_changed_byte_is_found(spark):
    ring = crypto.KeyRing(KEY)
    c = written(spark, [("a", b"payload" * 50)], "encrypted", ring)
    torn = catalog.Catalog(c.capsules, c.capsule_segments, c.segments.withColumn("payload", F.concat("payload", F.lit(b"!"))), c.content_store)
    row = catalog.read(torn, ring=ring).first()
    assert row["ok"] is False


def test_tiny_payloads_can_be_encrypted(spark):
    ring = crypto.KeyRing(KEY)
    assert back(written(spark, [("a", b"x")], "encrypted_compressed", ring), ring) == {"a": b"x"}


def test_a_payload_that_is_a_codec_frame_is_left_alone(spark):
    frame = codecs.compress("zstd:3", b"inner " * 100)
    assert back(written(spark, [("a", frame)])) == {"a": frame}


def test_range_reads(spark):
    data = bytes(i * 7 % 256 for i in range(10_000))
    c = written(spark, [("a", data)])
    ask = [("a", 0, 1), ("a", 4095, 2), ("a", 1, 9_999), ("a", 5000, 0)]
    got = catalog.read_range(c, spark.createDataFrame(ask, "capsule_id string, offset bigint, length bigint"), 4096).collect()
    assert {(r["offset"], r["length"]): bytes(r["data"]) for r in got} == {(o, n): data[o : o + n] for _, o, n in ask}
    with pytest.raises(Exception, match="beyond the end"):
        catalog.read_range(c, spark.createDataFrame([("a", 9_999, 2)], "capsule_id string, offset bigint, length bigint"), 4096).collect()


def test_versions_are_saved_and_opened(spark, tmp_path):
    c = written(spark, [("a", b"abc" * 100)])
    c.save(str(tmp_path), 1)
    assert back(catalog.Catalog.open(spark, str(tmp_path))) == {"a": b"abc" * 100}
    assert '"capsule_id":"a"' in catalog.serialize(c.capsules).first()["json"]


def test_register_and_deregister(spark):
    s = spark.createDataFrame([("h", 1), ("g", 2)], "content_hash string, segment_id bigint")
    e = spark.createDataFrame([("h", 9)], "content_hash string, segment_id bigint")
    assert sorted(map(tuple, catalog.register(s, e).collect())) == [("g", 2), ("h", 9)]
    assert sorted(map(tuple, catalog.deregister(s, e).collect())) == [("g", 2), ("h", 1)]


# -- payload functions, codecs


def test_ratio_is_the_true_one(spark):
    rows = spark.createDataFrame([(bytearray(b"SPAN " * 2000), "zstd", 3), (bytearray(b"ab"), "lz4", 1), (bytearray(b"".join(hashlib.sha256(bytes([i])).digest() for i in range(64))), "zstd", 3), (bytearray(b"q" * 5000), "none", 0)], "chunk binary, comp_algo string, comp_level int")
    got = {r["original_size"]: r for r in codecs.adaptive(rows).collect()}
    assert got[10_000]["compressed_size"] < 200 and got[10_000]["ratio"] > 50
    assert got[2]["algo"] == "identity" and got[2]["reason"] == "not smaller"
    assert got[2048]["reason"] == "high entropy" and got[5000]["reason"] == "no compression"


@settings(max_examples=30, deadline=None)
@given(st.binary(max_size=3000), st.sampled_from(["identity", "lz4:1", "lz4:9", "zstd:-5", "zstd:3", "zstd:19"]))
def test_codecs_round_trip(data, codec):
    assert codecs.decompress(codec, codecs.compress(codec, data)) == data


def test_codecs_reject(spark):
    with pytest.raises(CompressionError):
        codecs.decompress("snappy:1", b"x")
    with pytest.raises(CompressionError):
        codecs.decompress("zstd:3", b"not a frame")


def test_entropy(spark):
    rows = spark.createDataFrame([(1, bytearray(b"")), (2, bytearray(b"aaaa")), (3, bytearray(range(256))), (4, bytearray(b"ab"))], "k int, d binary")
    want = {1: 0.0, 2: 0.0, 3: 8.0, 4: 1.0}
    assert {r["k"]: r["entropy"] for r in payload.entropy(rows, ["k"], "d").collect()} == want
    assert {r["k"]: r["e"] for r in rows.select("k", payload.entropy_of(F.col("d")).alias("e")).collect()} == want


def test_shard_keys_wrap(spark):
    r = spark.createDataFrame([("ffffffff-ffff-ffff-0000-000000000000",)], "u string").select(payload.shard_keys(F.col("u"), F.lit(2)).alias("k")).first()["k"]
    assert [int(x) for x in r] == [2**64 - 1, 0]


# -- keys


def test_key_ring(monkeypatch):
    ring = crypto.KeyRing(KEY)
    assert ring.get(1) == crypto.KeyRing(KEY).get(1) and len(ring.get(1)[0]) == 32
    assert ring.rotate() == 2 and ring.get(1) != ring.get(2)
    with pytest.raises(EncryptionError):
        ring.rotate()
    ring.complete()
    assert ring.versions() == [1, 2]
    with pytest.raises(EncryptionError):
        ring.get(3)
    monkeypatch.delenv(crypto.KEY_ENV, raising=False)
    with pytest.raises(EncryptionError):
        crypto.KeyRing.from_env()
    with pytest.raises(EncryptionError):
        crypto.KeyRing(b"short")
    assert crypto.KeyRing.from_provider(lambda: KEY, b"salt").get(1) != ring.get(1)


def test_encryption_is_deterministic_and_keys_stay_out_of_plans(spark):
    ring = crypto.KeyRing(KEY)
    df = spark.createDataFrame([(bytearray(b"same"),), (bytearray(b"same"),), (bytearray(b"other"),)], "d binary").withColumn("h", payload.content_hash(F.col("d"))).withColumn("c", crypto.encrypt(F.col("d"), crypto.keyed(ring)(F.lit(1)), F.col("h")))
    assert df.select("c").distinct().count() == 2
    text = df._jdf.queryExecution().toString()
    assert ring.get(1)[0].hex() not in text.lower() and str(list(ring.get(1)[0]))[1:20] not in text


# -- policies, sources


def test_policy_files(tmp_path):
    p = parse_policy("compression:\n  LZ4:\n    level: 1\ndedupe: true\ncompact_interval_secs: 600\nencryption:\n  XtsAes256:\n    key_version: null\nrpo:\n  secs: 0\n  nanos: 0\nlatency_target:\n  secs: 0\n  nanos: 2000000\nsovereignty: zone\n")
    assert (p.comp_algo, p.comp_level, p.encrypted, p.rpo_ms, p.latency_target_ms, p.sovereignty, p.compact_interval_secs) == ("lz4", 1, True, 0, 2, "Zone", 600)
    (tmp_path / "p.json").write_text('{"compression": "None", "rpo_ms": 5}')
    assert readers.policy_file(str(tmp_path / "p.json")).comp_algo == "none"
    with pytest.raises(CatalogError):
        preset("nothing")


def test_presets(spark):
    assert presets(spark).count() == 8
    assert preset("metro_sync").rpo_ms == 0 and preset("geo_replicated").sovereignty == "Global" and preset("edge_optimized").compact_interval_secs is None


def test_json_lines_tolerate_bad_lines(spark, tmp_path):
    (tmp_path / "log.json").write_text('{"seq": 1, "hash": "a"}\n\nnot json\n{"seq": 2}\n')
    got = readers.json_lines(spark, str(tmp_path / "log.json"), "seq bigint, hash string").collect()
    assert sorted((r["seq"], r["hash"]) for r in got) == [(1, "a"), (2, None)]
    (tmp_path / "f.bin").write_bytes(b"\x00\x01")
    assert bytes(readers.payload_files(spark, str(tmp_path), "*.bin").first()["data"]) == b"\x00\x01"


# -- dedup, layout, bloom, audit


def test_dense_ids_without_a_global_sort(spark):
    df = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("k"))
    got = dedup.dense_ids(df, ["k"], 5, buckets=8).collect()
    assert sorted((r["k"], r["segment_id"]) for r in got) == [(i, i + 5) for i in range(1000)]
    offs = dedup.running_offset(spark.range(500).select(F.col("id").alias("segment_id"), (F.col("id") + 1).alias("len")), span=64).collect()
    assert all(r["offset"] == r["segment_id"] * (r["segment_id"] + 1) // 2 for r in offs)


def test_zones(spark):
    s = spark.createDataFrame([("a", i, n) for i, n in enumerate([5, 5, 3, 12, 1])], "capsule_id string, pos int, len bigint")
    assert [(r["zone"], r["zone_offset"]) for r in sorted(layout.packed_zones(s, 10).collect(), key=lambda r: r["pos"])] == [(0, 0), (0, 5), (1, 0), (1, 3), (2, 0)]
    two = spark.createDataFrame([("z", i, 4 << 20) for i in range(2)], "capsule_id string, pos int, len bigint")
    assert {r["zone"] for r in layout.plan(two, "entropy", 4 << 20).collect()} == {0, 1}
    with pytest.raises(QuarryError):
        layout.plan(two, "learned", 1)


def test_bloom_filter(spark):
    cells, hashes = bloom.size_of(1000, 0.001)
    keys = spark.createDataFrame([(f"k{i}",) for i in range(300)], "k string")
    f = bloom.build(keys, "k", cells, hashes)
    others = spark.createDataFrame([(f"x{i}",) for i in range(300)], "k string")
    assert bloom.might_contain(keys, "k", f, cells, hashes).count() == 300
    assert bloom.might_contain(others, "k", f, cells, hashes).count() <= 5
    assert bloom.might_contain(keys, "k", bloom.build(keys, "k", cells, hashes, keys), cells, hashes).count() == 0
    assert bloom.stats(f, cells, hashes).first()["used"] > 0 and math.isclose(bloom.size_of(10, 0.9)[0], 1024)


def test_audit_chain_finds_changes(spark):
    ev = spark.createDataFrame([(1, i, "e", f'{{"n":{i}}}', 100 + i) for i in range(1, 6)], "log_id bigint, seq bigint, event string, payload string, timestamp bigint")
    done = audit.chain(ev)
    ok = audit.verify(done).collect()
    assert all(r["hash_ok"] and r["link_ok"] for r in ok) and min(ok, key=lambda r: r["seq"])["prev_hash"] == audit.GENESIS
    bad = audit.verify(done.withColumn("payload", F.when(F.col("seq") == 3, "x").otherwise(F.col("payload")))).collect()
    assert [r["seq"] for r in bad if not r["hash_ok"]] == [3]
    gone = audit.verify(done.where("seq <> 2")).collect()
    assert [r["seq"] for r in gone if not r["link_ok"]] == [3]
    assert audit.rotation(done, 300).agg(F.max("file")).first()[0] >= 1
    assert audit.trail(done).first()["last_seq"] == 5


# -- views


def empty(spark, name):
    return spark.createDataFrame([], readers.TABLES[name])


def test_folders(spark):
    files = lambda *r: spark.createDataFrame(r, "path string, size bigint, capsule_id string")
    ns = views.write_files(empty(spark, "namespace"), files(("/data/logs/app.log", 12, "c1")), 1)
    assert [r["path"] for r in views.list_dir(ns, "/data").collect()] == ["/data/logs"]
    ns = views.write_files(ns, files(("/data/logs/app.log", 7, "c2")), 2)
    row = ns.where("kind = 'file'").first()
    assert (row["capsule_id"], row["created_at"], row["modified_at"]) == ("c2", 1, 2)
    for wrong in ("/", "/data", "/none"):
        with pytest.raises(ViewError):
            views.delete_path(ns, wrong)
    with pytest.raises(ViewError):
        views.write_files(ns, files(("/data/logs", 1, "c")), 3)
    with pytest.raises(ViewError):
        views.mkdir(ns, spark.createDataFrame([("/data/logs/app.log/x",)], "path string"), 3)
    with pytest.raises(ViewError):
        views.list_dir(ns, "/data/logs/app.log")
    ns = views.mkdir(views.delete_path(ns, "/data/logs/app.log"), spark.createDataFrame([("/a/b",)], "path string"), 3)
    assert views.list_dir(ns, "/data/logs").count() == 0 and ns.where("path = '/a/b'").count() == 1


def test_objects(spark):
    puts = spark.createDataFrame([(1, "bucket1", "file1.txt", "c1", 1, 0), (2, "bucket1", "file2.txt", "c2", 1, 0), (3, "bucket2", "file3.txt", "c3", 1, 0), (4, "bucket1", "file1.txt", "c4", 2, 0)], "seq bigint, bucket string, key string, capsule_id string, size bigint, created_at bigint")
    o = views.put(empty(spark, "objects"), puts)
    assert views.list_bucket(o, "bucket1").count() == 2 and views.list_bucket(o, "bucket").count() == 0
    h = views.head(o, "bucket1/file1.txt").first()
    assert (h["etag"], h["content_type"]) == ('"c4"', "text/plain")
    assert views.remove(o, spark.createDataFrame([("bucket1/file1.txt",)], "full_key string")).count() == 2


def test_volumes(spark):
    new = lambda *r: spark.createDataFrame(r, "name string, size bigint, block_size bigint, capsule_id string")
    v = views.create_volumes(empty(spark, "volumes"), new(("vol0", 16384, 4096, "c")), 0)
    blocks = views.zero_blocks(v)
    w = lambda o, d, e: spark.createDataFrame([("vol0", o, bytearray(d), e)], "name string, offset bigint, data binary, expected_version bigint")
    v2, b2 = views.write_blocks(v, blocks, w(4090, b"\xaa" * 10, 1), 5)
    got = {r["block"]: bytes(r["data"]) for r in b2.collect()}
    assert got[0][-6:] == b"\xaa" * 6 and got[1][:4] == b"\xaa" * 4 and got[1][4] == 0 and v2.first()["version"] == 2
    for wrong in (w(0, b"x", 1), w(16380, b"12345", 2)):
        with pytest.raises(ViewError):
            views.write_blocks(v2, b2, wrong, 6)
    for wrong in (new(("", 4096, 4096, "c")), new(("bad/name", 4096, 4096, "c")), new(("v", 1000, 4096, "c")), new(("vol0", 4096, 4096, "c"))):
        with pytest.raises(ViewError):
            views.create_volumes(v, wrong, 0)


@settings(max_examples=20, deadline=None)
@given(st.lists(st.text("ab./\\", max_size=12), min_size=1, max_size=20))
def test_paths_normalise_as_a_stack(spark, raw):
    def want(p):
        out = []
        for part in p.split("/"):
            if part == "..":
                out = out[:-1]
            elif part not in ("", "."):
                out.append(part.replace("\\", "/"))
        return "/" + "/".join(out)

    df = spark.createDataFrame([(x,) for x in raw], "p string").select("p", paths.normalize(F.col("p")).alias("n"))
    assert all(r["n"] == want(r["p"]) for r in df.collect())


# -- the compiler's decision table

EVENT = "event_id bigint, type string, capsule_id string, node_id string, accesses_per_min bigint, used_bytes bigint, total_bytes bigint, threshold_pct double, reason string, policy string"
NODE = "node_id string, ord int, zone_type string, zone_name string, available_bytes bigint, used_bytes bigint"


def actions(spark, events, nodes, *more):
    done = scaling.compile_actions(spark.createDataFrame(events, EVENT), presets(spark, *more), spark.createDataFrame(nodes, NODE), "metro", "us-west")
    return sorted((tuple(r) for r in done.select("event_id", "action", "strategy", "targets", "destination", "urgency").collect()), key=repr)


def test_replication(spark):
    nodes = [("n1", 1, "metro", "us-west", 10**9, 5 * 10**8), ("n2", 2, "metro", "us-west", 10**9, 3 * 10**8), ("n3", 3, "metro", "us-west", 10**9, 0), ("n0", 0, "metro", "us-west", 999_999, 0), ("e", 4, "edge", "us-west", 10**9, 0)]
    ev = lambda i, p: (i, "NewCapsule", "c", None, None, None, None, None, None, p)
    near = [Policy("p59", rpo_ms=59_999, latency_target_ms=200, sovereignty="Global")]
    got = actions(spark, [ev(1, "metro_sync"), ev(2, "default"), ev(3, "geo_replicated"), ev(4, "p59")], nodes, *near)
    assert got == [(1, "Replicate", "MetroSync", "n1,n2", None, None), (4, "Replicate", "Async", "n1,n2", None, None)]


def test_heat_migrates_to_the_least_used_node(spark):
    nodes = [("a", 1, "metro", "us-west", 6 * 10**7, 4 * 10**7), ("b", 2, "metro", "us-west", 9 * 10**7, 10**7), ("c", 3, "metro", "us-west", 9 * 10**7, 10**7), ("small", 0, "metro", "us-west", 9_999_999, 0)]
    ev = lambda i, n, p: (i, "HeatSpike", "c", None, n, None, None, None, None, p)
    fast, slow = Policy("fast", latency_target_ms=9, sovereignty="Global"), Policy("slow", latency_target_ms=10, sovereignty="Global")
    got = actions(spark, [ev(1, 101, "fast"), ev(2, 100, "fast"), ev(3, 500, "slow"), ev(4, 500, "default")], nodes, fast, slow)
    assert got == [(1, "Migrate", None, None, "b", None)]


def test_capacity_and_evacuation(spark):
    cap = lambda i, used, t: (i, "CapacityThreshold", None, "x", None, used, 1000, t, None, None)
    deg = lambda i, r: (i, "NodeDegraded", None, "x", None, None, None, None, r, None)
    nodes = [("n", 1, "metro", "us-west", 501, 499), ("full", 2, "metro", "us-west", 500, 500), ("none", 3, "metro", "us-west", 0, 0)]
    got = actions(spark, [cap(1, 800, 0.8), cap(2, 799, 70.0), cap(3, 850, 90.0), cap(4, 900, 0.9), deg(5, "disk_failure"), deg(6, "disk failure detected"), deg(7, "power loss")], nodes)
    assert got == [(1, "Rebalance", None, "n", "x", None), (4, "Rebalance", None, "n", "x", None), (5, "Evacuate", None, None, "x", "Immediate"), (6, "Evacuate", None, None, "x", "Gradual"), (7, "Evacuate", None, None, "x", "Immediate")]
    assert actions(spark, [cap(1, 900, 0.8)], nodes[1:]) == []


def test_allow_list(spark):
    a = spark.createDataFrame([("spiffe://a",)], "identity string")
    none = a.limit(0)
    asked = spark.createDataFrame([(None,), ("x",), ("spiffe://a",), ("spiffe://b",)], "identity string")
    assert [r["status"] for r in sorted(scaling.authorize(asked, a, False).collect(), key=lambda r: r["identity"] or "")] == [401, 200, 403, 400]
    assert scaling.refresh_allow_list(a, none).count() == 1


def test_broadcast_only_what_is_small(spark):
    df = spark.range(5)
    assert "broadcast" in small_side(df, 5)._jdf.queryExecution().toString().lower() and "broadcast" not in small_side(df, 10**9)._jdf.queryExecution().toString().lower()


def test_payloads_stay_in_python_where_only_sizes_count(spark):
    """Neither plan has the bytes among what Python gives back, and documents go there once for both codecs."""
    from quarry.queries import lifecycle
    from tests.oracle import SF

    plan = lifecycle.compress_verify(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1 and plan.count("Scan parquet") == 1
    assert "stored" not in lifecycle.compress_zstd(spark, SF)._jdf.queryExecution().executedPlan().toString()
    rows = spark.createDataFrame([(bytearray(b"SPAN " * 2000), "zstd", 3), (bytearray(b""), "lz4", 1), (None, "zstd", 3)], "chunk binary, comp_algo string, comp_level int")
    cols = ["algo", "reason", "original_size", "compressed_size", "ratio"]
    assert sorted(codecs.adaptive(rows).select(cols).collect(), key=str) == sorted(codecs.adaptive(rows, keep_stored=False).select(cols).collect(), key=str)


def test_payloads_of_a_round_trip_move_seldom(spark):
    """A read moves stored bytes to their references and opened ones to their capsules; nothing after Python ran is moved a second time."""
    ring = crypto.KeyRing(KEY)
    c = written(spark, [(f"c{i}", b"text %d " % (i % 7) * 900) for i in range(40)], "encrypted_compressed", ring, 1024)
    plan = catalog.read(c, ring=ring)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") <= 8 and plan.count("ArrowEvalPython") <= 2
    assert len(back(c, ring)) == 40


def test_offsets_of_encrypted_segments_follow_their_lengths(spark):
    ring = crypto.KeyRing(KEY)
    one = written(spark, [("a", bytes(i * 37 % 251 for i in range(9000))), ("b", b"x" * 5000)], "encrypted", ring, 1000)
    two = written(spark, [("c", bytes(i * 91 % 253 for i in range(7000))), ("d", b"x" * 5000)], "encrypted", ring, 1000, before=one)
    ends = 0
    for r in two.segments.orderBy("segment_id").collect():
        assert r["offset"] == ends and r["len"] == len(r["payload"])
        ends += r["len"]
    assert {r["capsule_id"]: r["deduped_bytes"] > 0 for r in two.capsules.collect()} == {"a": False, "b": True, "c": False, "d": True}
    refs = {r["segment_id"]: r["n"] for r in two.capsule_segments.groupBy("segment_id").agg(F.count("*").alias("n")).collect()}
    assert {r["segment_id"]: r["ref_count"] for r in two.segments.collect()} == refs


def test_joined_bytes_are_those_of_the_parts(spark):
    parts = [bytes(range(256)), b"", b"\xff\xfe\xc3(", b"\x00" * 7]
    rows = spark.createDataFrame([(1, [bytearray(p) for p in parts]), (2, [bytearray(b"a"), None]), (3, None), (4, [])], "k int, p array<binary>").repartition(2)
    got = {r["k"]: r["d"] for r in rows.select("k", catalog.joined_bytes(F.col("p")).alias("d")).collect()}
    assert bytes(got[1]) == b"".join(parts) and got[2] is None and got[3] is None and bytes(got[4]) == b""


def test_bytes_that_no_codec_changes_stay_in_the_jvm(spark):
    """Writing under a policy without a codec runs no Python over payloads, and reading gives it none of them."""
    rows = spark.createDataFrame([(bytearray(b"q" * 5000), "none", 0), (None, "none", 0)], "chunk binary, comp_algo string, comp_level int")
    fixed = codecs.adaptive(rows.select("chunk", F.lit("none").alias("comp_algo"), F.lit(0).alias("comp_level")))
    assert "ArrowEvalPython" not in fixed._jdf.queryExecution().executedPlan().toString()
    got = sorted((r["algo"] or "", r["reason"], r["stored"] and bytes(r["stored"]), r["compressed_size"]) for r in codecs.adaptive(rows).collect())
    assert got == [("", None, None, None), ("identity", "no compression", b"q" * 5000, 5000)]
    kept = codecs.adaptive(rows).select(codecs.restored("stored", "algo").alias("d")).collect()
    assert sorted(bytes(r["d"]) for r in kept if r["d"] is not None) == [b"q" * 5000]
