"""Embedding near-duplicates by spherical-cap filters with structured random product codes.

Filter directions are products of random codes: the vectors' coordinates, randomly rotated, are split into blocks, each with
its own random unit codes, and a filter is one code from every block (Becker, Ducas, Gama, Laarhoven, 2016). A vector passes a filter if
its inner product with the direction reaches ``alpha``. List decoding finds exactly the filters that a vector passes without
going through all: sums over half of the blocks are kept only if the best sum over the other half can still reach ``alpha``.
Vectors that share a filter are candidates; a 64-bit sign sketch carried with them drops most chance meetings, and the exact cosine decides.

The number of filters grows with the number of vectors, so the vectors that share a filter by chance stay about as many, at any count; ``alpha`` is
set so that a vector passes ``PASSES`` filters on average. Since filters of one product code aren't independent, some vectors pass few of
them; ``CODES`` codes, each with its own rotation, make up for that, and two blocks of many codes come nearer to independence than four of few. The search is
approximate: simulated for 51,000 vectors of 64 dimensions and pairs at a cosine of 0.9, the filters passed being in brackets, four blocks find 0.42 (one code
of 32) and 0.98 (eight of 32), two blocks 0.86 (one of 32) and 0.989 (four of 16). The sketch drops a pair at the threshold with a chance of about 1e-7: the bits in which
it may differ are 5.5 standard deviations above what is expected. Equal vectors are one node, so groups of copies aren't compared pair by pair.

Defined cases. Vectors are compared with those of their own dimension, each dimension having its own codes. A vector that is null, has a null, infinite or
NaN element, or has length 0, is no one's duplicate, nor is one with a null ``vec_id``. Rows with the same ``vec_id`` are one vector, the
one that sorts first. Ties: of equal or near vectors the smallest ``vec_id`` stays. An empty table gives an empty result. Extra columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import connected_components, materialize

THRESHOLD = 0.9
#: Blocks of a product code, unless it is told otherwise, and of those that the search uses.
BLOCKS, SEARCH_BLOCKS = 4, 2
#: Product codes, and filters of each that a vector passes, on average.
CODES, PASSES = 4, 16
#: Filters for each vector.
FILTERS_PER_VECTOR = 16
SEED = 7


def cap_height(share: float, dims: int) -> float:
    """The inner product that a ``share`` of all unit vectors of ``dims`` dimensions reach with a fixed one."""
    x = np.linspace(-1, 1, 200_001)
    density = np.maximum(1 - x * x, 0) ** ((dims - 3) / 2)
    tail = np.cumsum(density[::-1])[::-1]
    return float(x[int(np.argmax(tail / tail[0] <= share))])


class ProductCode:
    """Codes, rotation and threshold for ``count`` vectors of ``dims`` dimensions."""

    def __init__(self, count: int, dims: int, seed: int = SEED, passes: float = PASSES, blocks: int = BLOCKS):
        rng = np.random.default_rng(seed)
        self.dims, self.blocks = dims, blocks
        self.width = max(2, -(-dims // blocks))
        full = self.width * blocks
        self.rotation = np.linalg.qr(rng.standard_normal((full, full)))[0][:dims].astype(np.float32)
        self.codes_per_block = int(max(16, np.ceil((FILTERS_PER_VECTOR * max(count, 1)) ** (1 / blocks))))
        codes = rng.standard_normal((blocks, self.codes_per_block, self.width))
        self.codes = (codes / np.linalg.norm(codes, axis=2, keepdims=True) / np.sqrt(blocks)).astype(np.float32)
        self.alpha = cap_height(min(0.5, passes / self.codes_per_block**blocks), full)
        self.planes = rng.standard_normal((dims, 64)).astype(np.float32)

    def rows_at_once(self) -> int:
        """Vectors to decode together, so that a half's sums stay within some 16 MB."""
        return int(max(1, min(500, (4 << 20) // self.codes_per_block ** (self.blocks // 2))))

    def decode(self, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, filter) of every filter that each unit vector passes."""
        n, b = len(unit), self.codes_per_block
        parts = (unit @ self.rotation).reshape(n, self.blocks, self.width)
        inner = np.matmul(parts.transpose(1, 0, 2), self.codes.transpose(0, 2, 1))
        half = list(inner) if self.blocks == 2 else [(inner[0][:, :, None] + inner[1][:, None, :]).reshape(n, -1), (inner[2][:, :, None] + inner[3][:, None, :]).reshape(n, -1)]
        best = [h.max(axis=1) for h in half]
        row0, code0 = np.nonzero(half[0] >= (self.alpha - best[1])[:, None])
        row1, code1 = np.nonzero(half[1] >= (self.alpha - best[0])[:, None])
        start, size = np.searchsorted(row1, np.arange(n)), np.bincount(row1, minlength=n)
        times = size[row0]
        left = np.repeat(np.arange(len(row0)), times)
        right = np.repeat(start[row0] - (np.cumsum(times) - times), times) + np.arange(times.sum())
        passed = half[0][row0[left], code0[left]] + half[1][row1[right], code1[right]] >= self.alpha
        left, right = left[passed], right[passed]
        return row0[left], code0[left].astype(np.int64) * b ** (self.blocks // 2) + code1[right]

    def sketch(self, unit: np.ndarray) -> np.ndarray:
        return np.packbits(unit @ self.planes > 0, axis=1).view(np.int64)[:, 0]


def sketch_limit(threshold: float) -> int:
    """Bits in which the sketches of vectors at the threshold differ, with 5.5 standard deviations to spare."""
    p = float(np.arccos(np.clip(threshold, -1, 1)) / np.pi)
    return int(np.ceil(64 * p + 5.5 * np.sqrt(64 * p * (1 - p))))


def _units(vectors: DataFrame) -> DataFrame:
    """(id, unit) of every distinct proper vector."""
    proper = vectors.where("vec_id is not null and embedding is not null and size(embedding) > 0")
    proper = proper.select(F.col("vec_id").cast("long").alias("id"), F.col("embedding").cast("array<double>").alias("v")).where("forall(v, x -> x is not null and not isnan(x) and abs(x) < double('infinity')) and exists(v, x -> x <> 0)")
    proper = proper.groupBy("id").agg(F.min("v").alias("v"))
    # scaled by the largest element first, so that no square is lost or infinite; repeated, so that it is worked out once a vector
    over = lambda n: f"zip_with(v, array_repeat({n}, size(v)), (x, y) -> x / y) as v"
    scaled = proper.selectExpr("id", over("array_max(transform(v, x -> abs(x)))")).selectExpr("id", over("sqrt(aggregate(v, 0D, (a, x) -> a + x * x))"))
    return materialize(scaled.withColumnRenamed("v", "unit"), "embedding-units")


def near_pairs(vectors: DataFrame, threshold: float = THRESHOLD) -> tuple[DataFrame, DataFrame]:
    """((vec_id, first): copies and the first vector equal to each; (a, b, cosine): near pairs of first vectors, a < b)."""
    units = _units(vectors)
    nodes = materialize(units.groupBy("unit").agg(F.min("id").alias("id")), "embedding-nodes")
    copies = units.join(nodes.withColumnRenamed("id", "first"), "unit").where("id <> first").select(F.col("id").alias("vec_id"), "first")
    counts = {r["d"]: r["n"] for r in nodes.groupBy(F.size("unit").alias("d")).agg(F.count(F.lit(1)).alias("n")).collect()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes: dict[int, list[ProductCode]] = {}
        for batch in batches:
            sizes = np.asarray(batch.column(1).value_lengths())
            for dims in np.unique(sizes).tolist():
                if dims not in codes:
                    codes[dims] = [ProductCode(counts[dims], dims, SEED + k, PASSES, SEARCH_BLOCKS) for k in range(CODES)]
                own = batch if (sizes == dims).all() else batch.filter(pa.array(sizes == dims))
                step = codes[dims][0].rows_at_once()
                for at in range(0, own.num_rows, step):
                    part = own.slice(at, step)
                    unit = np.asarray(part.column(1).flatten()).reshape(part.num_rows, dims).astype(np.float32)
                    sketch = codes[dims][0].sketch(unit)
                    for k, code in enumerate(codes[dims]):
                        row, passed = code.decode(unit)
                        group = pa.array(np.full(len(row), dims * CODES + k, dtype=np.int32))
                        yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(row)), group, pa.array(passed), pa.array(sketch[row])], ["id", "code", "filter", "sketch"])

    lists = nodes.select("id", "unit").mapInArrow(run, "id long, code int, filter long, sketch long")
    left, right = lists.toDF("a", "code", "filter", "sa"), lists.toDF("b", "code", "filter", "sb")
    met = left.join(right, ["code", "filter"]).where((F.col("a") < F.col("b")) & (F.bit_count(F.col("sa").bitwiseXOR(F.col("sb"))) <= sketch_limit(threshold))).select("a", "b").distinct()
    cosine = F.aggregate(F.zip_with("ua", "ub", lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    side = lambda x: nodes.select(F.col("id").alias(x), F.col("unit").alias(f"u{x}"))
    pairs = met.join(side("a"), "a").join(side("b"), "b").select("a", "b", cosine.alias("cosine")).where(F.col("cosine") >= threshold)
    return copies, pairs


def duplicates(vectors: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(vec_id, kept_vec_id) of every vector that another of its group stands for; the smallest id of a group stays."""
    copies, pairs = near_pairs(vectors, threshold)
    roots = materialize(connected_components(pairs.select("a", "b"), "embedding-components"), "embedding-roots")
    via = copies.join(roots, F.col("first") == F.col("node"), "left").select("vec_id", F.coalesce("root", "first").alias("kept_vec_id"))
    return via.unionAll(roots.where("node <> root").select(F.col("node").alias("vec_id"), F.col("root").alias("kept_vec_id")))
