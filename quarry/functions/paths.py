"""Names and paths: normalised paths, parents, object keys and content types."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

CONTENT_TYPES = ((".txt", "text/plain"), (".json", "application/json"), (".html", "text/html"), (".jpg", "image/jpeg"), (".jpeg", "image/jpeg"), (".png", "image/png"))


def normalize(path: Column) -> Column:
    """Rooted, without ``.``, ``..``, empty parts and trailing slash; ``..`` at the root stays there; a backslash counts as a slash within a part."""
    parts = F.filter(F.split(path, "/"), lambda p: (p != "") & (p != "."))
    kept = F.aggregate(parts, F.array().cast("array<string>"), lambda a, p: F.when(p == "..", F.slice(a, 1, F.greatest(F.size(a) - 1, F.lit(0)))).otherwise(F.array_append(a, F.translate(p, "\\", "/"))))
    return F.concat(F.lit("/"), F.array_join(kept, "/"))


def depth(path: Column) -> Column:
    return F.when(path == "/", 0).otherwise(F.size(F.split(path, "/")) - 1)


def parent(path: Column) -> Column:
    """Of a normalised path; the root has none, and paths of depth 1 have the root."""
    up = F.regexp_replace(path, "/[^/]*$", "")
    return F.when(path == "/", F.lit(None).cast("string")).when(up == "", F.lit("/")).otherwise(up)


def name(path: Column) -> Column:
    return F.when(path == "/", F.lit("/")).otherwise(F.element_at(F.split(path, "/"), -1))


def ancestors(path: Column) -> Column:
    """The folders above a normalised path, the root first."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(1), F.greatest(depth(path), F.lit(1))), lambda i: F.when(i == 1, F.lit("/")).otherwise(F.array_join(F.slice(parts, 1, i), "/")))


def object_key(bucket: Column, key: Column) -> Column:
    return F.concat(bucket, F.lit("/"), key)


def etag(capsule_id: Column) -> Column:
    return F.concat(F.lit('"'), capsule_id, F.lit('"'))


def content_type(key: Column) -> Column:
    found = F.lit("application/octet-stream")
    for suffix, kind in CONTENT_TYPES:
        found = F.when(F.endswith(key, F.lit(suffix)), F.lit(kind)).otherwise(found)
    return found


def valid_volume_name(name: Column) -> Column:
    return F.coalesce(name.rlike(r"\A[A-Za-z0-9._-]+\z"), F.lit(False))


def valid_volume_size(size: Column, block: Column) -> Column:
    return F.coalesce((size > 0) & (block > 0) & (size % F.when(block > 0, block) == 0), F.lit(False))
