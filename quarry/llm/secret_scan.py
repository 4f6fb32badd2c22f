"""Secret scans: sliding-window Shannon entropy over candidate strings, by character class.

A candidate is a maximal run of one class's characters: ``hex`` (20 or more of 0-9 a-f A-F) or ``base64`` (24 or
more of A-Z a-z 0-9 + / _ -, not all hex). It needs a digit and a letter. A window of the class's width slides over it; counts
are updated by the character that leaves and the one that enters. The candidate is a finding if its highest
window entropy, in bits and rounded to six places, reaches the class's threshold, unless the allow-list suppresses it: known public
values, placeholders, UUIDs, and digests announced as such right before.

Defined cases. A null or empty text has no finding. Texts are scanned whole. Repeated rows give repeated findings. Extra
columns are ignored, and pass through ``redact`` as they are. Findings carry a SHA-256 of the string, never the string itself.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm import textkit

HEX = b"0123456789abcdefABCDEF"
BASE64 = b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-"
#: class: (characters, least length and window, least entropy in bits)
CLASSES = {"hex": (HEX, 20, 3.0), "base64": (BASE64, 24, 4.0)}
#: SHA-256 of strings known to be public, here those of the empty string and of Amazon's documentation key.
ALLOWED_DIGESTS = frozenset(hashlib.sha256(x).hexdigest() for x in (b"e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855", b"da39a3ee5e6b4b0d3255bfef95601890afd80709", b"wJalrXUtnFEMI/K7MDENG/bPxRfiCYEXAMPLEKEY"))
ALLOWED_VALUE = r"(?i)(example|placeholder|0123456789abcdef|abcdefghijklmnop|^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$)"
ALLOWED_BEFORE = r"(?i)(sha-?(1|256|384|512)|md5|commit|checksum|integrity)[-:= ]{1,3}$"
REPLACEMENT = b"[SECRET]"

_value, _before = re.compile(ALLOWED_VALUE.encode()), re.compile(ALLOWED_BEFORE.encode())
_UNIT = 1 << 40
_table = {k: np.isin(np.arange(256), np.frombuffer(v[0], dtype=np.uint8)) for k, v in CLASSES.items()}
_digit = np.isin(np.arange(256), np.frombuffer(b"0123456789", dtype=np.uint8))


def window_entropy(value: bytes, width: int) -> float:
    """The highest Shannon entropy, in bits, of ``width`` neighbouring characters, from counts kept up to date as the window moves."""
    f = [0] + [round(c * math.log2(c) * _UNIT) for c in range(1, width + 1)]
    counts, total = [0] * 256, 0
    best = None
    for i, c in enumerate(value):
        if i >= width:
            out = value[i - width]
            k = counts[out]
            total += f[k - 1] - f[k]
            counts[out] = k - 1
        k = counts[c]
        total += f[k + 1] - f[k]
        counts[c] = k + 1
        if i >= width - 1 and (best is None or total < best):
            best = total
    return round(math.log2(width) - best / _UNIT / width, 6)


def scan(offsets: np.ndarray, raw: np.ndarray) -> Iterator[tuple[int, str, int, int, float]]:
    """(row, class, first byte, end byte, entropy) of each finding, bytes counted from the start of the block."""
    if not len(raw):
        return
    digits = np.concatenate(([0], np.cumsum(_digit[raw])))
    for kind, (_, width, least) in CLASSES.items():
        start, end, row = textkit.runs(_table[kind][raw], offsets)
        some = end - start >= width
        start, end, row = start[some], end[some], row[some]
        n = digits[end] - digits[start]
        some = (n > 0) & (n < end - start)
        for s, e, r in zip(start[some].tolist(), end[some].tolist(), row[some].tolist()):
            value = raw[s:e].tobytes()
            if kind == "base64" and not value.translate(None, HEX):
                continue
            if kind == "base64" and not re.search(rb"[A-Za-z]", value) or kind == "hex" and not re.search(rb"[A-Fa-f]", value):
                continue
            h = window_entropy(value, width)
            if h < least or _value.search(value) or hashlib.sha256(value).hexdigest() in ALLOWED_DIGESTS:
                continue
            if _before.search(raw[max(offsets[r], s - 16) : s].tobytes()):
                continue
            yield r, kind, s, e, h


def findings(docs: DataFrame) -> DataFrame:
    """(doc_id, kind, start, length, entropy, digest) of each finding; ``start`` counts characters from 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, kinds, starts, lengths, entropies, digests = [], [], [], [], [], []
            for a, _, offsets, raw in textkit.blocks(batch.column(1)):
                for r, kind, s, e, h in scan(offsets, raw):
                    at.append(a + r)
                    kinds.append(kind)
                    starts.append(int(((raw[offsets[r] : s] & 0xC0) != 0x80).sum()))
                    lengths.append(e - s)
                    entropies.append(h)
                    digests.append(hashlib.sha256(raw[s:e].tobytes()).hexdigest())
            ids = batch.column(0).take(pa.array(at, pa.int64()))
            yield pa.RecordBatch.from_arrays([ids, pa.array(kinds, pa.string()), pa.array(starts, pa.int64()), pa.array(lengths, pa.int64()), pa.array(entropies, pa.float64()), pa.array(digests, pa.string())], ["doc_id", "kind", "start", "length", "entropy", "digest"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(textkit.releasing(run), "doc_id long, kind string, start long, length long, entropy double, digest string")


def redact(docs: DataFrame) -> DataFrame:
    """``docs`` with every finding in ``text`` replaced by ``[SECRET]``, and ``n_chars``, where there is such a column, counted again."""
    text = docs.columns.index("text")
    n_chars = docs.columns.index("n_chars") if "n_chars" in docs.columns else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            new: dict[int, str] = {}
            for a, _, offsets, raw in textkit.blocks(batch.column(text)):
                spans: dict[int, list[tuple[int, int]]] = {}
                for r, _, s, e, _ in scan(offsets, raw):
                    spans.setdefault(r, []).append((s, e))
                for r, own in spans.items():
                    parts, at = [], int(offsets[r])
                    for s, e in sorted(own):
                        if s >= at:
                            parts += [raw[at:s].tobytes(), REPLACEMENT]
                        at = max(at, e)
                    new[a + r] = b"".join([*parts, raw[at : offsets[r + 1]].tobytes()]).decode("utf-8", "replace")
            if not new:
                yield batch
                continue
            arrays = list(batch.columns)
            mask = np.zeros(batch.num_rows, dtype=bool)
            mask[list(new)] = True
            order = sorted(new)
            arrays[text] = pc.replace_with_mask(arrays[text], pa.array(mask), pa.array([new[i] for i in order], arrays[text].type))
            if n_chars is not None:
                arrays[n_chars] = pc.replace_with_mask(arrays[n_chars], pa.array(mask), pa.array([len(new[i]) for i in order], arrays[n_chars].type))
            yield pa.RecordBatch.from_arrays(arrays, schema=batch.schema)

    return docs.mapInArrow(textkit.releasing(run), docs.schema)


#: DuckDB SQL of ``findings``.
ORACLE_SQL = rf"""
with runs as (
  select doc_id, text, kind, width, least, regexp_extract_all(text, pattern) as matches, string_split_regex(text, pattern) as pieces
  from documents, (values ('hex', 20, 3.0, '[0-9A-Fa-f]{{20,}}'), ('base64', 24, 4.0, '[A-Za-z0-9+/_-]{{24,}}')) as c(kind, width, least, pattern)
  where text is not null and regexp_matches(text, pattern)
), each as (
  select row_number() over () as id, doc_id, text, kind, width, least, matches[k] as value,
    list_sum(list_transform(pieces[1:k], lambda x: length(x))) + coalesce(list_sum(list_transform(matches[1:k-1], lambda x: length(x))), 0) as start
  from (select *, unnest(range(1, len(matches) + 1)) as k from runs)
), candidates as (
  select * from each
  where regexp_matches(value, '[0-9]') and (kind = 'hex' and regexp_matches(value, '[A-Fa-f]') or kind = 'base64' and regexp_matches(value, '[^0-9A-Fa-f]') and regexp_matches(value, '[A-Za-z]'))
), windows as (
  select id, width, unnest(range(1, length(value) - width + 2)) as pos, value from candidates
), counts as (
  select id, pos, width, c, count(*) as n
  from (select id, pos, width, unnest(string_split(substr(value, pos, width), '')) as c from windows) group by all
), entropies as (
  select id, max(h) as entropy from (select id, pos, round(log2(any_value(width)) - sum(n * log2(n)) / any_value(width), 6) as h from counts group by id, pos) group by id
)
select doc_id, kind, start::bigint as start, length(value)::bigint as length, entropy::double as entropy, sha256(value) as digest
from candidates join entropies using (id)
where entropy >= candidates.least and not regexp_matches(value, '{ALLOWED_VALUE}') and not regexp_matches(substr(text, (case when start > 15 then start - 15 else 1 end)::bigint, (case when start < 16 then start else 16 end)::bigint), '{ALLOWED_BEFORE}')
  and sha256(value) not in ({", ".join(repr(x) for x in sorted(ALLOWED_DIGESTS))})
"""
