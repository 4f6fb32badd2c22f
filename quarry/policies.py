"""Storage policies: the presets as a table, and expressions over their columns."""

from __future__ import annotations

import json
import re
from dataclasses import asdict, dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.errors import CatalogError

MIB = 1 << 20


@dataclass(frozen=True)
class Policy:
    policy: str
    comp_algo: str = "lz4"
    comp_level: int = 1
    dedupe: bool = True
    compact_interval_secs: int | None = 3600
    encrypted: bool = False
    key_version: int | None = None
    crypto_profile: str = "classical"
    layout: str = "fixed"
    segment_size: int = 4 * MIB
    rpo_ms: int = 60_000
    latency_target_ms: int = 10
    sovereignty: str = "Local"


_default = Policy("default")
PRESETS = (
    _default,
    replace(_default, policy="text_optimized", comp_algo="zstd", comp_level=3, compact_interval_secs=1800),
    replace(_default, policy="precompressed", comp_algo="none", comp_level=0, dedupe=False, compact_interval_secs=7200),
    replace(_default, policy="edge_optimized", dedupe=False, compact_interval_secs=None, rpo_ms=300_000, latency_target_ms=50),
    replace(_default, policy="encrypted", encrypted=True, key_version=1),
    replace(_default, policy="encrypted_compressed", comp_algo="zstd", comp_level=3, encrypted=True, key_version=1),
    replace(_default, policy="metro_sync", encrypted=True, key_version=1, rpo_ms=0, latency_target_ms=2, sovereignty="Zone"),
    replace(_default, policy="geo_replicated", comp_algo="zstd", comp_level=3, encrypted=True, key_version=1, rpo_ms=300_000, latency_target_ms=100, sovereignty="Global"),
)

SCHEMA = "policy string, comp_algo string, comp_level int, dedupe boolean, compact_interval_secs bigint, encrypted boolean, key_version int, crypto_profile string, layout string, segment_size bigint, rpo_ms bigint, latency_target_ms bigint, sovereignty string"


def presets(spark: SparkSession, *more: Policy) -> DataFrame:
    """The presets and any further policies: a fixed, small table."""
    return spark.createDataFrame([tuple(asdict(p).values()) for p in (*PRESETS, *more)], SCHEMA)


def preset(name: str) -> Policy:
    for p in PRESETS:
        if p.policy == name:
            return p
    raise CatalogError(f"no policy named {name!r}")


def clamp_level(algo: Column, level: Column) -> Column:
    """LZ4 levels are 1 to 16, Zstandard's -5 to 22; other codecs' are left alone."""
    return F.when(algo == "lz4", F.greatest(F.lit(1), F.least(level, F.lit(16)))).when(algo == "zstd", F.greatest(F.lit(-5), F.least(level, F.lit(22)))).otherwise(level)


def codec_name(algo: Column, level: Column) -> Column:
    return F.when(algo == "none", F.lit("identity")).otherwise(F.concat(algo, F.lit(":"), clamp_level(algo, level).cast("string")))


def parse_policy(text: str) -> Policy:
    """A policy from JSON or from the plain subset of YAML that policy files use: nested ``key: value`` lines.

    Durations are ``{secs, nanos}`` or a number of milliseconds with the key ``*_ms``.
    """
    try:
        tree = json.loads(text)
    except ValueError:
        tree = _yaml(text)
    kw: dict = {"policy": tree.get("name", "file")}
    comp = tree.get("compression", "None")
    if isinstance(comp, dict):
        kw["comp_algo"], own = next(iter((k.lower(), v) for k, v in comp.items()))
        kw["comp_level"] = int(own["level"])
    elif str(comp).lower() == "none":
        kw |= {"comp_algo": "none", "comp_level": 0}
    else:
        raise CatalogError(f"compression {comp!r} isn't known")
    for key in ("dedupe", "sovereignty"):
        if key in tree:
            kw[key] = tree[key]
    if isinstance(kw.get("sovereignty"), str):
        kw["sovereignty"] = kw["sovereignty"].capitalize()
    if "compact_interval_secs" in tree:
        kw["compact_interval_secs"] = tree["compact_interval_secs"]
    enc = tree.get("encryption")
    if isinstance(enc, dict):
        own = next(iter(enc.values())) or {}
        kw |= {"encrypted": True, "key_version": own.get("key_version") or 1}
    for name, to in (("rpo", "rpo_ms"), ("latency_target", "latency_target_ms")):
        if to in tree:
            kw[to] = int(tree[to])
        elif name in tree:
            value = tree[name]
            if not isinstance(value, dict):
                raise CatalogError(f"{name} must have secs and nanos")
            kw[to] = int(value.get("secs", 0)) * 1000 + int(value.get("nanos", 0)) // 1_000_000
    return Policy(**kw)


def _yaml(text: str) -> dict:
    root: dict = {}
    stack: list[tuple[int, dict]] = [(-1, root)]
    for line in text.splitlines():
        line = re.sub(r"(^|\s)#.*$", "", line).rstrip()
        if not line.strip() or line.strip() == "---":
            continue
        indent = len(line) - len(line.lstrip())
        key, sep, value = line.strip().partition(":")
        if not sep:
            raise CatalogError(f"can't read policy line {line!r}")
        while stack[-1][0] >= indent:
            stack.pop()
        value = value.strip()
        if value == "" or value.startswith("!"):
            child: dict = {}
            tag = value[1:].strip()
            stack[-1][1][key] = {tag: child} if tag else child
            stack.append((indent, child))
        else:
            stack[-1][1][key] = {"true": True, "false": False, "null": None, "~": None}.get(value.lower(), int(value) if re.fullmatch(r"-?\d+", value) else value.strip("\"'"))
    return root
