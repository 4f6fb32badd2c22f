"""SimHash near-duplicates by the generalised pigeonhole principle.

A document's code has 128 bits, two SimHashes over its distinct words. Two documents are candidates when their codes
differ in at most ``TAU`` bits, which is also what verification asks of the words, so no pair that it accepts is out of reach. The bits are split into
partitions, correlated bits together (Qin et al., "GPH", 2018). For thresholds t_i with sum(t_i) = tau - m + 1, two codes
within ``tau`` agree within t_i bits in at least one partition i, so probing those balls misses no pair. The thresholds come from a
dynamic programme over estimated candidate counts: the chance that two codes differ in at most t bits of a partition is that of a beta-binomial
with the mean and the variance that the partition's bits have together over all codes, correlation included. Candidates within ``tau`` are verified on
256 bits: the code and two SimHashes of the word pairs.

Codes meet by (partition, route), the route being a few bits of the partition's value. A code is stored under its own route and sent to the routes within the
threshold, each pair of routes meeting at one of them; the probes of the other bits are made where the codes meet, so a ball of
thousands of values costs a few rows of shuffle. A pair that meets in several partitions is given by the first alone. All 256 bits travel, so pairs are
verified where they meet. For groups, a task gives no pair that its others already join: of the pairs it finds, the links of each node to the least one of
its group. The groups are those of all pairs, but a group of k near-copies gives some k links a task, not k squared.

Defined cases. A null or empty text, and a null ``doc_id``, is never a duplicate. A text without any word has itself as
its only feature, so only equal ones pair up. Rows that share a ``doc_id`` are one document; they stay or go together.
Texts are processed whole. In a group the smallest ``doc_id`` stays. An empty table has no duplicate. Columns other than ``doc_id`` and ``text`` are
ignored by the search and kept by ``deduplicate``, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from itertools import combinations
from math import exp, lgamma

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm import textkit
from quarry.llm.common import bucket_labels, connected_components, fresh, materialize, small_side

#: Columns of the code that is searched, and of the one that verifies what is found, 64 bits each.
CODE, CHECK = ("c0", "c1"), ("c2", "c3")
#: Bits of 128 (words) and of 128 (word pairs) in which near-duplicates may differ; the first is the radius of the search.
TAU_WORDS, TAU_PAIRS = 20, 36
TAU = TAU_WORDS
#: Nanoseconds of a row sent, a probe and a compared candidate, for the choice of the plan.
ROW_COST, PROBE_COST, CANDIDATE_COST = 500.0, 60.0, 30.0
#: Bits of a partition's value that make its route, at least, and the codes that one route should hold on average; more codes have more routes.
ROUTE_BITS, ROUTE_CODES = 4, 1 << 17
#: Pairs that a task holds before it reduces them to links.
PAIRS_AT_ONCE = 1 << 20
#: Probes, and candidates, that are looked at together.
AT_ONCE = 1 << 18

_CODES = "doc_id long, c0 long, c1 long, c2 long, c3 long"


def _bit_sums(features: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """For each run of features, how many have each of 64 bits; runs begin at ``starts`` and aren't empty.

    Bytes are summed eight to a 64-bit lane, over at most 255 features at once.
    """
    ends = np.append(starts[1:], len(features))
    parts = (ends - starts + 254) // 255
    first = np.repeat(np.cumsum(parts) - parts, parts)
    cut = np.repeat(starts, parts) + 255 * (np.arange(len(first)) - first)
    lanes = np.unpackbits(features.view(np.uint8)).view(np.uint64).reshape(-1, 8)
    sums = np.add.reduceat(lanes, cut, axis=0).view(np.uint8).reshape(-1, 64)
    return np.add.reduceat(sums, np.cumsum(parts) - parts, axis=0, dtype=np.int64)


def _simhash(features: np.ndarray, starts: np.ndarray) -> np.ndarray:
    counts = np.diff(np.append(starts, len(features)))
    bits = 2 * _bit_sums(features, starts) > counts[:, None]
    return np.packbits(bits, axis=1).view(np.uint64)[:, 0]


def _distinct(values: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (row, value), sorted; values are cut to 44 bits. A block has fewer than 2**20 rows."""
    key = np.sort((row.astype(np.uint64) << np.uint64(44)) | (values >> np.uint64(20)))
    key = key[np.concatenate(([True], key[1:] != key[:-1]))] if len(key) else key
    return textkit.mix(key & np.uint64((1 << 44) - 1)), (key >> np.uint64(44)).astype(np.int64)


def codes_of(offsets: np.ndarray, raw: np.ndarray) -> np.ndarray:
    """Codes [n, 4] (uint64) of lower-cased texts; all zero for an empty text."""
    n = len(offsets) - 1
    h, row, _, _ = textkit.word_hashes(offsets, raw)
    wordless = np.setdiff1d(np.flatnonzero(np.diff(offsets)), row)
    if len(wordless):
        own = np.array([textkit.word_hash(raw[offsets[i] : offsets[i + 1]].tobytes().decode("utf-8", "replace")) for i in wordless], dtype=np.uint64)
        h, row = np.concatenate((h, own)), np.concatenate((row, wordless))
        order = np.argsort(row, kind="stable")
        h, row = h[order], row[order]
    codes = np.zeros((n, 4), dtype=np.uint64)
    if not len(h):
        return codes
    last = np.concatenate((row[1:] != row[:-1], [True]))
    first = np.concatenate(([True], last[:-1]))
    pair = textkit.mix(h * np.uint64(3) + np.concatenate((h[1:], [np.uint64(0)])))
    keep = ~last | first  # a lone word stands for its missing pairs
    for values, rows, at in ((h, row, 0), (pair[keep], row[keep], 2)):
        f, r = _distinct(values, rows)
        starts = np.flatnonzero(np.concatenate(([True], r[1:] != r[:-1])))
        codes[r[starts], at] = _simhash(f, starts)
        codes[r[starts], at + 1] = _simhash(textkit.mix(f + np.uint64(0x632BE59BD9B4E019)), starts)
    return codes


def _code_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, texts = batch.column(0), batch.column(1)
        for a, b, offsets, raw in textkit.blocks(texts, lower=True):
            codes = codes_of(offsets, raw)
            full = pa.array(np.diff(offsets) > 0)
            out = pa.RecordBatch.from_arrays([ids.slice(a, b - a), *(pa.array(codes[:, i].view(np.int64)) for i in range(4))], ["doc_id", "c0", "c1", "c2", "c3"])
            yield out.filter(full)


def simhash_codes(docs: DataFrame) -> DataFrame:
    """(doc_id, c0..c3) of every document with text; one narrow pass over (doc_id, text)."""
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("doc_id is not null and text is not null")
    return slim.mapInArrow(textkit.releasing(_code_batches), _CODES)


def _codes(batch: pa.RecordBatch, first: int) -> np.ndarray:
    """The columns from ``first`` on, as codes [n, words] (uint64)."""
    return np.stack([np.asarray(batch.column(i)).astype(np.int64) for i in range(first, batch.num_columns)], axis=1).view(np.uint64)


def _co_occurrence(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total, n = None, 0
    for batch in batches:
        for at in range(0, batch.num_rows, 16_384):
            code = np.ascontiguousarray(_codes(batch.slice(at, 16_384), 0)).view(np.uint8)
            bits = np.unpackbits(code, axis=1, bitorder="little").astype(np.float32)
            total = (0 if total is None else total) + (bits.T @ bits).astype(np.float64)
            n += len(bits)
    if n:
        at = np.arange(total.size + 1, dtype=np.int32)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(np.append(total.ravel(), n).astype(np.int64))], ["at", "n"])


def _groups(both: np.ndarray, n: int, m: int) -> list[list[int]]:
    """``m`` even groups of bits: each starts from the most correlated pair left and takes the bits most correlated with it."""
    width = len(both)
    p = np.diag(both) / max(n, 1)
    spread = np.sqrt(np.maximum(p * (1 - p), 1e-9))
    corr = np.abs((both / max(n, 1) - np.outer(p, p)) / np.outer(spread, spread))
    np.fill_diagonal(corr, -1)
    left, groups = set(range(width)), []
    for k in range(m):
        size = (width * (k + 1)) // m - (width * k) // m
        at = sorted(left)
        sub = corr[np.ix_(at, at)]
        i, j = divmod(int(np.argmax(sub)), len(at))
        group = sorted({at[i], at[j]})[:size]
        while len(group) < size:
            rest = sorted(left - set(group))
            group.append(rest[int(np.argmax(corr[np.ix_(rest, group)].sum(axis=1)))])
        groups.append(sorted(group))
        left -= set(group)
    return groups


def _ball(width: int, radius: int) -> int:
    total, term = 0, 1
    for r in range(radius + 1):
        total += term
        term = term * (width - r) // (r + 1)
    return total if radius >= 0 else 0


def _masks(width: int, radius: int) -> np.ndarray:
    """The values to XOR a value of ``width`` bits with, for every value within ``radius``."""
    return np.array([sum(1 << b for b in c) for r in range(min(radius, width) + 1) for c in combinations(range(width), r)], dtype=np.int64)


def _near(both: np.ndarray, n: int, bits: list[int]) -> np.ndarray:
    """The chance that two codes differ in at most 0, 1, ... of ``bits``: a beta-binomial of the mean and variance they have together."""
    w = len(bits)
    p11 = both[np.ix_(bits, bits)] / max(n, 1)
    p = np.diag(p11)
    p10 = p[:, None] - p11
    p00 = 1 - p[:, None] - p[None, :] + p11
    together = 2 * (p11 * p00 + p10 * p10.T)  # two codes differ in both bits
    differ = np.diag(together)
    mean, second = float(differ.sum()), float(together.sum())
    q = min(max(mean / w, 1e-6), 1 - 1e-6)
    # a beta-binomial's variance is w q (1 - q) (1 + (w - 1) r), r being the bits' correlation
    r = ((second - mean**2) / (w * q * (1 - q)) - 1) / (w - 1) if w > 1 else 0.0
    r = min(max(r, 1e-4), 0.999)
    a, b = q * (1 / r - 1), (1 - q) * (1 / r - 1)
    log_beta = lambda x, y: lgamma(x) + lgamma(y) - lgamma(x + y)
    return np.cumsum([exp(lgamma(w + 1) - lgamma(k + 1) - lgamma(w - k + 1) + log_beta(k + a, w - k + b) - log_beta(a, b)) for k in range(w + 1)])


def _allocate(cost: np.ndarray, total: int) -> tuple[list[int], float]:
    """Thresholds t_i >= -1 with sum ``total`` and the least sum of cost[i][t_i + 1], by dynamic programming."""
    m, widest = cost.shape
    best = {0: (0.0, [])}
    for i in range(m):
        new: dict[int, tuple[float, list[int]]] = {}
        for used, (c, ts) in best.items():
            for t in range(-1, widest - 1):
                key = used + t + 1
                if key <= total + m and (key not in new or c + cost[i][t + 1] < new[key][0]):
                    new[key] = (c + cost[i][t + 1], [*ts, t])
        best = new
    c, ts = best[total + m]
    return ts, c


def _route_bits(width: int, n: int) -> int:
    return min(width - 1, max(ROUTE_BITS, int(np.ceil(np.log2(max(1, n / ROUTE_CODES))))))


def plan_partitions(codes: DataFrame, tau: int = TAU, names: Sequence[str] = ("c0",)) -> tuple[list[list[int]], list[int]]:
    """(bits of each partition, threshold of each), from counts over all codes.

    For each number of partitions the cost of every (partition, threshold) is the rows it sends, the probes it makes and the candidates
    it meets; the cheapest plan wins. What reaches the driver is one matrix of how often two bits are set together.
    """
    width = 64 * len(names)
    rows = codes.select(*names).mapInArrow(_co_occurrence, "at int, n long").groupBy("at").agg(F.sum("n").alias("n")).collect()
    flat = np.zeros(width * width + 1)
    for r in rows:
        flat[r["at"]] = r["n"]
    both, n = flat[:-1].reshape(width, width), int(flat[-1])
    plans = []
    for m in range(2, min(tau + 1, width // 4) + 1):
        groups, widest = _groups(both, n, m), tau + 2
        cost = np.zeros((m, widest))
        for i, bits in enumerate(groups):
            near, route = _near(both, n, bits), _route_bits(len(bits), n)
            for t in range(widest - 1):
                at = min(t, len(bits))
                cost[i][t + 1] = n * (ROW_COST * (1 + _ball(route, min(t, route))) / 2 + PROBE_COST * _ball(len(bits), at) / 2 + CANDIDATE_COST * n * near[at] / 2)
        thresholds, c = _allocate(cost, tau - m + 1)
        plans.append((c, groups, thresholds))
    return min(plans, key=lambda x: x[0])[1:] if plans else ([list(range(width))], [tau])


def _value(codes: np.ndarray, bits: list[int]) -> np.ndarray:
    out = np.zeros(len(codes), dtype=np.uint64)
    for j, b in enumerate(bits):
        out |= ((codes[:, b // 64] >> np.uint64(b % 64)) & np.uint64(1)) << np.uint64(j)
    return out.view(np.int64)


def _put(ids: np.ndarray, codes: np.ndarray) -> bytes:
    planes = np.ascontiguousarray(ids.view(np.uint8).reshape(-1, 8).T)
    return zstandard.ZstdCompressor(level=1).compress(planes.tobytes() + np.ascontiguousarray(codes.T).tobytes())


def _take(data: bytes, words: int) -> tuple[np.ndarray, np.ndarray]:
    """(ids, codes [words, n])."""
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), dtype=np.uint8)
    n = len(raw) // (8 + 8 * words)
    return np.ascontiguousarray(raw[: 8 * n].reshape(8, n).T).view(np.int64).ravel(), raw[8 * n :].view(np.uint64).reshape(words, n)


_SENT = "label int, part int, route int, kind int, sender int, data binary"


def _sender(used: list[tuple[int, list[int], list[int], int]], labels: np.ndarray):
    """Codes of equal route together: to their own (kind 0), and to the routes within the threshold with which they meet there (kind 1)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 16_384):
                part = batch.slice(at, 16_384)
                ids, codes, rows = np.asarray(part.column(0)).astype(np.int64), _codes(part, 1), []
                for k, (_, route, _, t) in enumerate(used):
                    own = _value(codes, route)
                    order = np.argsort(own, kind="stable")
                    edge = np.flatnonzero(np.concatenate(([True], np.diff(own[order]) != 0, [True])))
                    flips = _masks(len(route), t).tolist()
                    for a, b in zip(edge[:-1].tolist(), edge[1:].tolist()):
                        r, data = int(own[order[a]]), _put(ids[order[a:b]], codes[order[a:b]])
                        for f in flips:
                            if r ^ f >= r:
                                rows.append((int(labels[(k + (r ^ f) * len(used)) % len(labels)]), k, r ^ f, int(f > 0), r, data))
                yield pa.RecordBatch.from_arrays([*(pa.array([x[i] for x in rows], pa.int32()) for i in range(5)), pa.array([x[5] for x in rows], pa.binary())], [c.split(" ")[0] for c in _SENT.split(", ")])

    return run


def _links(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(least, other): of the groups that the pairs join, each other node with the least one."""
    nodes, at = np.unique(np.concatenate((a, b)), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    least = np.arange(len(nodes))
    while len(x):
        p, q = least[x], least[y]
        apart = p != q
        x, y, p, q = x[apart], y[apart], p[apart], q[apart]
        np.minimum.at(least, np.maximum(p, q), np.minimum(p, q))
        while not np.array_equal(least, further := least[least]):
            least = further
    other = np.flatnonzero(least != np.arange(len(nodes)))
    return nodes[least[other]], nodes[other]


def _meeting(used: list[tuple[int, list[int], list[int], int]], tau: int, words: int, further: tuple[int, int] = (0, 0), links: bool = False):
    """(a, b) of all codes that meet under a route within the threshold, differ in at most ``tau`` bits, and don't meet in an earlier partition.

    ``further``: columns after the first ``words``, and the bits in which these may differ. With ``links``, what ``_links`` makes of the task's pairs.
    """
    masks = [[np.uint64(sum(1 << (b % 64) for b in bits if b // 64 == i)) for i in range(words)] for bits, *_ in used]
    columns, beyond = further

    def pairs(k: int, stored: tuple, probing: tuple, radius: int, own: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        ids, codes, values, table = stored
        p_ids, p_codes, p_values = probing
        flips = _masks(len(used[k][2]), radius)
        for at in range(0, len(p_ids), step := max(1, AT_ONCE // len(flips))):
            keys = (p_values[at : at + step, None] ^ flips[None, :]).ravel()
            if table is None:
                begin, end = np.searchsorted(values, keys, "left"), np.searchsorted(values, keys, "right")
            else:
                begin, end = table[keys], table[keys + 1]
            some = np.flatnonzero(end > begin)
            probe, begin, n = at + some // len(flips), begin[some], (end - begin)[some]
            till = np.cumsum(n)
            x = 0
            while x < len(n):
                y = max(x + 1, int(np.searchsorted(till, (till[x - 1] if x else 0) + AT_ONCE, "right")))
                m = n[x:y]
                p = np.repeat(probe[x:y], m)
                q = np.repeat(begin[x:y] - (np.cumsum(m) - m), m) + np.arange(m.sum())
                if own:  # both are places in the same codes, so each pair comes twice
                    once = p < q
                    p, q = p[once], q[once]
                # most pairs end at the first column
                far = np.zeros(len(p), dtype=np.int16)
                for i in range(words):
                    far = far + np.bitwise_count(p_codes[i][p] ^ codes[i][q])
                    close = np.flatnonzero(far <= tau)
                    p, q, far = p[close], q[close], far[close]
                if columns and len(p):
                    close = sum(np.bitwise_count(p_codes[i][p] ^ codes[i][q]).astype(np.int16) for i in range(words, words + columns)) <= beyond
                    p, q = p[close], q[close]
                if len(p):
                    differ = [p_codes[i][p] ^ codes[i][q] for i in range(words)]
                    first = np.ones(len(p), dtype=bool)
                    for j in range(k):
                        first &= sum(np.bitwise_count(d & mask).astype(np.int16) for d, mask in zip(differ, masks[j])) > used[j][3]
                    a, b = p_ids[p[first]], ids[q[first]]
                    a, b = a[a != b], b[a != b]  # rows of one id may have two texts
                    if len(a):
                        yield np.minimum(a, b), np.maximum(a, b)
                x = y

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        at, held, stored = None, [], None

        def close() -> tuple:
            ids, codes = np.concatenate([x[0] for x in held]), np.concatenate([x[1] for x in held], axis=1)
            local = used[at[0]][2]
            values = _value(codes.T, local)
            order = np.argsort(values, kind="stable")
            values = values[order]
            # where each value begins; a wide partition's are searched for
            table = np.searchsorted(values, np.arange((1 << len(local)) + 1)) if len(local) <= 18 else None
            return ids[order], codes[:, order], values, table

        for batch in batches:
            for i in range(batch.num_rows):
                part, route, kind, sender, data = (batch.column(c)[i].as_py() for c in range(1, 6))
                if (part, route) != at:
                    if held:
                        stored = close()
                        yield from pairs(at[0], stored, stored[:3], used[at[0]][3], True)
                    at, held, stored = (part, route), [], None
                if not kind:
                    held.append(_take(data, words + columns))
                    continue
                if held:
                    stored = close()
                    held = []
                    yield from pairs(part, stored, stored[:3], used[part][3], True)
                if stored is not None:
                    ids, codes = _take(data, words + columns)
                    yield from pairs(part, stored, (ids, codes, _value(codes.T, used[part][2])), used[part][3] - (route ^ sender).bit_count(), False)
        if held:
            stored = close()
            yield from pairs(at[0], stored, stored[:3], used[at[0]][3], True)

    def linked(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        held, size, most = [], 0, PAIRS_AT_ONCE
        for pair in found(batches):
            held.append(pair)
            size += len(pair[0])
            if size > most:
                held = [_links(*(np.concatenate(x) for x in zip(*held)))]
                size = len(held[0][0])
                most = max(PAIRS_AT_ONCE, 2 * size)
        if held:
            yield _links(*(np.concatenate(x) for x in zip(*held)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for a, b in linked(batches) if links else found(batches):
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    return run


def hamming_pairs(codes: DataFrame, tau: int = TAU, plan: tuple[list[list[int]], list[int]] | None = None, names: Sequence[str] = ("c0",), further: tuple[Sequence[str], int] = ((), 0), links: bool = False) -> DataFrame:
    """(a, b), a < b, each once, of all ids whose codes differ in at most ``tau`` bits; ``codes(id, *names)`` has distinct ids.

    One shuffle by (partition, route) finds all pairs; none is capped. ``further``: more columns, and the bits in which they may differ. With ``links``, not all
    pairs but enough of them, or of pairs that they imply, to make the same groups; one may come from several tasks.
    """
    groups, thresholds = plan or plan_partitions(codes, tau, names)
    spark = codes.sparkSession
    partitions, n = int(spark.conf.get("spark.sql.shuffle.partitions")), codes.count()
    used = []
    for bits, t in zip(groups, thresholds):
        if t >= 0:
            route = bits[: _route_bits(len(bits), n)]
            used.append((bits, route, bits[len(route) :], t))
    sent = codes.select("id", *names, *further[0]).mapInArrow(_sender(used, bucket_labels(spark, partitions)), _SENT).repartition(partitions, "label")
    meeting = _meeting(used, tau, len(names), (len(further[0]), further[1]), links)
    return sent.sortWithinPartitions("label", "part", "route", "kind").select("label", "part", "route", "kind", "sender", "data").mapInArrow(textkit.releasing(meeting), "a long, b long")


def near_duplicate_pairs(docs: DataFrame, tau: int = TAU, links: bool = False) -> tuple[DataFrame, DataFrame]:
    """(distinct codes with their first document, verified pairs of those documents, or links that make the same groups); see the module."""
    codes = materialize(simhash_codes(docs), "simhash-codes")
    # equal codes are one node; its members hang on the first document
    nodes = materialize(codes.groupBy("c0", "c1", "c2", "c3").agg(F.min("doc_id").alias("id")), "simhash-nodes")
    pairs = hamming_pairs(nodes, tau, names=CODE, further=(CHECK, TAU_PAIRS), links=links)
    members = codes.join(nodes, ["c0", "c1", "c2", "c3"]).select("doc_id", "id").where("doc_id <> id").distinct()
    return members, pairs


def duplicates(docs: DataFrame, tau: int = TAU) -> DataFrame:
    """(doc_id, kept_doc_id) of every document that another of its group stands for; the smallest id of a group stays."""
    members, pairs = near_duplicate_pairs(docs, tau, links=True)
    roots = materialize(connected_components(pairs, "simhash-components"), "simhash-roots")
    via = members.join(roots, F.col("id") == F.col("node"), "left").select("doc_id", F.coalesce("root", "id").alias("kept_doc_id"))
    return via.unionAll(roots.where("node <> root").select(F.col("node").alias("doc_id"), F.col("root").alias("kept_doc_id")))


def deduplicate(docs: DataFrame, tau: int = TAU) -> DataFrame:
    """``docs`` without the documents that ``duplicates`` names; all columns as they were."""
    gone = materialize(duplicates(docs, tau), "simhash-gone")
    key = fresh(docs, "gone_id")
    gone = gone.select(F.col("doc_id").alias(key))
    return docs.join(small_side(gone, gone.count(), 16), F.col("doc_id").cast("long") == F.col(key), "left_anti")
