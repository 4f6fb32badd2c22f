"""URL filters: host-suffix and path-prefix expressions, joined on short hash prefixes and confirmed by full digests.

A URL is brought into a canonical form and expanded into every (host suffix of two labels or more, path prefix) pair; the paths are
the whole path with its query, the whole path, and each folder above it. A rule names one such expression, and is brought into the same form. Expressions
meet rules by the first 32 bits of SHA-256; the full digest then decides, so a collision of prefixes matches nothing.
Of the rules that match, the one with the longest host wins, then the longest path, then ``allow`` over ``block``, then the least rule.

Distinct URLs are judged once and joined back. An expression is never written out: each host suffix's hash goes on folder by folder, so a URL's work and rows are
in proportion to its length times its few host suffixes, and a row carries two digests, whatever the URL. Nothing but (page_id, url) is read.

Canonical form. Blanks around a URL go, and so do user, port and fragment. The host is lower-cased, without dots at its end; an address in digits, one in
brackets (IPv6), or a host of one label, has only itself as suffix. ``%xx`` is decoded until nothing is left to decode; ``.``, ``..`` and empty segments of the
path are resolved; bytes up to 32, from 127 on, ``#`` and ``%`` are written as ``%XX`` again. An empty path is ``/``.

Defined cases. A null, empty or malformed URL (no ``scheme://host``, or a host above 253 characters) has action ``none`` and a null rule, as has one that no
rule matches. URLs of any length are expanded whole. A null ``page_id`` is kept. Repeated rows each get the verdict. Rules that are null, blank or of an
unknown action are ignored; repeated ones count once; of two with one canonical form the least is named. A rule that can't be ``host`` or ``host/path`` (it has a
scheme, a fragment, blanks or no host) is an error. No rule at all, or no page, gives ``none`` everywhere, or nothing. Extra columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from urllib.parse import unquote_to_bytes

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm.common import small_side

#: (expression, action): a host with its subdomains, or a host and a path prefix.
DEFAULT_RULES = (
    ("casino-win.example.com/", "block"),
    ("free-bets.example.com/", "block"),
    ("cheap-pills.example.com/", "block"),
    ("ads-track.example.com/", "block"),
    ("casino-win.example.com/en/", "block"),
    ("www.cheap-pills.example.com/en/", "allow"),
    ("blog.tionsh.example.com/fr/", "block"),
    ("m.example.net/", "block"),
)
#: Hex digits of the short prefix, 32 bits.
PREFIX_HEX = 8
MAX_HOST = 253

_URL = re.compile(r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)([^?#]*)(\?[^#]*)?", re.DOTALL)
#: An escape of an escape, at any depth.
_NESTED = re.compile(rb"%(?:25)+(?=[0-9A-Fa-f]{2})")
_KEEP = frozenset(range(33, 127)) - {ord("#"), ord("%")}
_TEXT = [chr(b) if b in _KEEP else f"%{b:02X}" for b in range(256)]


def rules_table(spark: SparkSession, rules=DEFAULT_RULES) -> DataFrame:
    return spark.createDataFrame([*rules], "rule string, action string")


def _unescaped(text: str) -> str:
    """``%xx`` decoded as long as there is any, then what isn't plain ASCII escaped."""
    data = text.encode("utf-8", "surrogatepass")
    while b"%" in data and (plain := unquote_to_bytes(_NESTED.sub(b"%", data))) != data:
        data = plain
    return "".join([_TEXT[b] for b in data])


def _resolved(path: str) -> str:
    out: list[str] = []
    parts = path.split("/")
    for part in parts:
        if part == "..":
            if out:
                out.pop()
        elif part not in ("", "."):
            out.append(part)
    folder = parts[-1] in ("", ".", "..") and out
    return "/" + "/".join(out) + ("/" if folder else "")


def _host(netloc: str) -> str | None:
    host = netloc.rpartition("@")[2]
    if host.startswith("["):
        host = host[: host.find("]") + 1]
    else:
        host = host.partition(":")[0]
    host = host.lower().rstrip(".")
    return host if 0 < len(host) <= MAX_HOST and not re.search(r"\s", host) else None


def canonical(url: str) -> tuple[str, str, str] | None:
    """(host, path, query) of a URL, or None if it is malformed."""
    found = _URL.match(url.strip())
    host = found and _host(found[1])
    return (host, _resolved(_unescaped(found[2])), _unescaped(found[3] or "")) if host else None


def canonical_rule(rule: str) -> tuple[str, str]:
    """(host, path and query) of a rule; a host alone is a host and all below it."""
    text = rule.strip()
    found = None if re.search(r"\s|#|^[A-Za-z][A-Za-z0-9+.-]*://", text) else canonical(f"any://{text}")
    if found is None:
        raise ValueError(f"{rule!r} isn't a rule: host or host/path is")
    return found[0], found[1] + found[2]


def suffixes(host: str) -> list[str]:
    labels = host.split(".")
    if len(labels) < 3 or host.startswith("[") or not host.strip("0123456789."):
        return [host]
    return [".".join(labels[i:]) for i in range(len(labels) - 1)]


def digests(url: str) -> list[bytes]:
    """SHA-256 of each of a URL's expressions, each once."""
    found = canonical(url)
    if found is None:
        return []
    host, path, query = found
    folders = path.split("/")
    out: dict[bytes, None] = {}
    for suffix in suffixes(host):
        state = hashlib.sha256(suffix.encode())
        for part in folders[:-1]:
            state.update(part.encode() + b"/")
            out[state.copy().digest()] = None
        state.update(folders[-1].encode())
        out[state.copy().digest()] = None
        state.update(query.encode())
        out[state.digest()] = None
    return list(out)


def _expanded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(url's own digest, prefix, full digest) of every expression of every URL."""
    for batch in batches:
        for at in range(0, batch.num_rows, 1000):
            keys, full = [], []
            for url in batch.column(0).slice(at, 1000).to_pylist():
                own = digests(url)
                keys += [hashlib.sha256(url.encode()).digest()] * len(own)
                full += own
            prefix = pa.array([int.from_bytes(d[: PREFIX_HEX // 2], "big") for d in full], pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), prefix, pa.array(full, pa.binary())], ["url_key", "prefix", "digest"])


def _known(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for rule, action in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            host, path = canonical_rule(rule)
            full = hashlib.sha256((host + path).encode()).digest()
            rows.append((rule, action, int.from_bytes(full[: PREFIX_HEX // 2], "big"), full, len(host), len(path)))
        kinds = (pa.string(), pa.string(), pa.int64(), pa.binary(), pa.int32(), pa.int32())
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], ["rule", "action", "prefix", "full", "host_length", "path_length"])


def judge(pages: DataFrame, rules: DataFrame) -> DataFrame:
    """(page_id, url, action, rule) of every row."""
    named = rules.where("action in ('block', 'allow') and trim(rule) <> ''").select(F.trim("rule").alias("rule"), "action").distinct()
    known = named.mapInArrow(_known, "rule string, action string, prefix long, full binary, host_length int, path_length int")
    # one row for each canonical expression: allow before block, then the least rule
    known = known.groupBy("prefix", "full").agg(F.min(F.struct((F.col("action") != "allow").alias("later"), "rule", "action", "host_length", "path_length")).alias("r")).select("prefix", "full", "r.*")
    asked = pages.where("url is not null").select("url").distinct().mapInArrow(_expanded, "url_key binary, prefix long, digest binary")
    hits = asked.join(small_side(known, rules.count(), 256), "prefix").where("digest = full")
    best = F.max_by(F.struct("action", "rule"), F.struct("host_length", "path_length"))
    verdicts = hits.groupBy("url_key").agg(best.alias("best")).select("url_key", "best.*")
    key = F.unhex(F.sha2("url", 256))
    return pages.select("page_id", "url").withColumn("url_key", key).join(verdicts, "url_key", "left").select("page_id", "url", F.coalesce("action", F.lit("none")).alias("action"), "rule")


#: DuckDB SQL of ``judge`` with the default rules, by comparing every URL with every rule.
ORACLE_SQL = r"""
with u as (
  select page_id, url, rtrim(lower(regexp_extract(trim(url), '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#@]*@)?([^/?#:@]+)', 2)), '.') as host,
    regexp_extract(trim(url), '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1) as path0, regexp_extract(trim(url), '^[^?#]*(\?[^#]*)', 1) as query
  from pages
), c as (select *, case when path0 = '' then '/' else path0 end as path from u),
r(rule, action) as (values %s),
s as (select *, split_part(rule, '/', 1) as rhost, substr(rule, length(split_part(rule, '/', 1)) + 1) as rpath from r),
hits as (
  select page_id, url, rule, action, row_number() over (partition by page_id, url order by length(rhost) desc, length(rpath) desc, action = 'allow' desc) as k
  from c join s on (host = rhost or ends_with(host, '.' || rhost)) and (rpath = path || query or rpath = path or ends_with(rpath, '/') and starts_with(path, rpath))
)
select p.page_id, p.url, coalesce(h.action, 'none') as action, h.rule from pages p left join (select * from hits where k = 1) h on h.page_id = p.page_id and h.url = p.url
""" % ", ".join(f"('{r}', '{a}')" for r, a in DEFAULT_RULES)
