"""SimHash and embedding near-duplicates against brute force."""

import random

import numpy as np
from pyspark.sql import functions as F

from quarry.llm import embedding_neardup as E
from quarry.llm import simhash_neardup as S
from quarry.llm.common import connected_components
from tests.llm.helpers import awkward, docs, nothing, table


def words(rng, n):
    return [rng.choice("abcdefghijklmnop") + "".join(rng.choice("aeioulmnrst") for _ in range(rng.randint(1, 6))) for _ in range(n)]


def test_no_pair_within_the_radius_is_missed(spark):
    rng = np.random.default_rng(3)
    base = rng.integers(0, 2**63, 120, dtype=np.int64)
    rows = []
    for i, c in enumerate(base.tolist()):
        for k in range(4):
            flips = rng.choice(64, rng.integers(0, 13), replace=False)
            x = c
            for b in flips.tolist():
                x ^= (1 << b) if b < 63 else -(1 << 63)
            rows.append((i * 4 + k, x, 100))
    nodes = spark.createDataFrame(rows, "id long, c0 long, words int").dropDuplicates(["c0"])
    kept = nodes.collect()
    code = np.array([r["c0"] for r in kept], dtype=np.int64).view(np.uint64)
    ids = [r["id"] for r in kept]
    for tau in (3, 9):
        want = {(min(ids[i], ids[j]), max(ids[i], ids[j])) for i in range(len(ids)) for j in range(i) if int(code[i] ^ code[j]).bit_count() <= tau}
        assert {tuple(r) for r in S.hamming_pairs(nodes, tau).collect()} == want
        uneven = ([list(range(0, 10)), list(range(10, 40)), list(range(40, 64))], S._allocate(np.array([[k**p for k in range(tau + 2)] for p in (1, 2, 3)], dtype=float), tau - 2)[0])
        assert sum(uneven[1]) == tau - 2
        assert {tuple(r) for r in S.hamming_pairs(nodes, tau, uneven).collect()} == want


def test_allocation_is_the_cheapest():
    rng = np.random.default_rng(1)
    cost = np.cumsum(rng.random((3, 7)), axis=1)
    got, c = S._allocate(cost, 4)
    best = min((cost[0][a + 1] + cost[1][b + 1] + cost[2][d + 1], (a, b, d)) for a in range(-1, 6) for b in range(-1, 6) for d in range(-1, 6) if a + b + d == 4)
    assert abs(c - best[0]) < 1e-12 and sum(got) == 4


def test_codes_don_t_depend_on_batches(spark):
    d = table(spark, "documents")
    one = {r["doc_id"]: tuple(r) for r in S.simhash_codes(d.coalesce(1)).collect()}
    two = {r["doc_id"]: tuple(r) for r in S.simhash_codes(d.repartition(7)).collect()}
    assert one == two


def test_planted_copies_are_found_and_others_left(spark):
    rng = random.Random(5)
    rows, want = [], {}
    for i in range(60):
        base = words(rng, rng.randint(40, 600))
        rows.append((i * 10, " ".join(base), "en", "s"))
        if i % 2 == 0:
            for k in range(1, 3):
                copy = [rng.choice(words(rng, 1)) if rng.random() < 0.04 else w for w in base]
                rows.append((i * 10 + k, " ".join(copy), "en", "s"))
                want[i * 10 + k] = i * 10
        if i % 3 == 0:
            rows.append((i * 10 + 5, "  ".join(base).upper() + " !", "en", "s"))
            want[i * 10 + 5] = i * 10
    got = {r["doc_id"]: r["kept_doc_id"] for r in S.duplicates(docs(spark, rows)).collect()}
    assert set(got) <= set(want) and all(got[k] == want[k] for k in got)
    assert len(got) >= 0.9 * len(want)
    kept = {r["doc_id"] for r in S.deduplicate(docs(spark, rows)).collect()}
    assert kept == {r[0] for r in rows} - set(got)


def test_the_radius_reaches_what_verification_accepts(spark):
    rng = random.Random(1)
    vocabulary = words(rng, 20_000)
    rows = []
    for i in range(200):
        base = [rng.choice(vocabulary) for _ in range(rng.randint(400, 1500))]
        rate = 0.08 if i % 2 else 0.1
        rows += [(2 * i, " ".join(base), "en", "s"), (2 * i + 1, " ".join(rng.choice(vocabulary) if rng.random() < rate else w for w in base), "en", "s")]
    d = docs(spark, rows)
    code = {r["doc_id"]: np.array(r[1:5], dtype=np.int64).view(np.uint64) for r in S.simhash_codes(d).collect()}
    differ = {i: np.bitwise_count(code[2 * i] ^ code[2 * i + 1]).tolist() for i in range(200)}
    accepted = {(2 * i, 2 * i + 1) for i, x in differ.items() if x[0] + x[1] <= S.TAU_WORDS and x[2] + x[3] <= S.TAU_PAIRS}
    found = {tuple(r) for r in S.near_duplicate_pairs(d)[1].collect()}
    assert found <= accepted and len(accepted) > 120
    assert len(found) >= 0.9 * len(accepted)


def test_links_make_the_groups_of_all_pairs(spark):
    rng = random.Random(8)
    base = words(rng, 400)
    rows = [(i, " ".join(rng.choice(words(rng, 1)) if rng.random() < 0.015 else w for w in base), "en", "s") for i in range(120)]
    rows += [(200 + i, " ".join(words(rng, 300)), "en", "s") for i in range(40)]
    d = docs(spark, rows)
    pairs, links = (S.near_duplicate_pairs(d, links=x)[1].collect() for x in (False, True))
    groups = lambda e: {tuple(r) for r in connected_components(spark.createDataFrame([tuple(x) for x in e], "a long, b long")).collect()}
    assert groups(links) == groups(pairs) == {(i, 0) for i in range(120)}
    # a task gives one link for a node at most
    assert len(pairs) > 5000 and len(links) <= 119 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert all(a < b for a, b in links)


def test_links_of_pairs():
    a, b = S._links(np.array([5, 7, 9, 1, 4, 5]), np.array([7, 9, 11, 2, 4, 9]))
    assert sorted(zip(a.tolist(), b.tolist())) == [(1, 2), (5, 7), (5, 9), (5, 11)]
    # a chain in any order
    order = np.random.default_rng(4).permutation(500)
    a, b = S._links(order, order + 1)
    assert sorted(zip(a.tolist(), b.tolist())) == [(0, i) for i in range(1, 501)]
    assert [len(x) for x in S._links(np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64))] == [0, 0]


def test_awkward_documents(spark):
    d = awkward(spark)
    more = d.unionByName(d.where("doc_id in (1, 6)").withColumn("doc_id", F.col("doc_id") + 100))
    got = {(r["doc_id"], r["kept_doc_id"]) for r in S.duplicates(more).collect()}
    assert got == {(101, 1), (106, 6)}
    left = S.deduplicate(more)
    assert left.columns == d.columns and left.count() == d.count()
    assert S.duplicates(nothing(spark)).count() == 0 and S.deduplicate(nothing(spark)).count() == 0


def test_components(spark):
    rng = random.Random(2)
    edges = [(rng.randrange(150), rng.randrange(150)) for _ in range(100)] + [(i, i + 1) for i in range(1000, 1030)] + [(5000, 5000 + i) for i in range(1, 50)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        if a != b:
            x, y = sorted((find(a), find(b)))
            root[y] = x
    want = {(x, find(x)) for x in root if any(x in e and e[0] != e[1] for e in edges)}
    got = {tuple(r) for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == want
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


# -- embeddings


def vectors(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], 0) for i, v in rows], "vec_id long, embedding array<float>, label int")


def test_list_decoding_finds_exactly_the_filters_passed():
    code = E.ProductCode(300, 24, passes=6)
    rng = np.random.default_rng(0)
    v = rng.standard_normal((20, 24)).astype(np.float32)
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    row, passed = code.decode(v)
    parts = (v @ code.rotation).reshape(20, 4, -1)
    inner = np.einsum("njw,jcw->njc", parts, code.codes)
    total = (inner[:, 0, :, None, None, None] + inner[:, 1, None, :, None, None] + inner[:, 2, None, None, :, None] + inner[:, 3, None, None, None, :]).reshape(20, -1)
    want = set(zip(*(x.tolist() for x in np.nonzero(total >= code.alpha))))
    assert len(want ^ set(zip(row.tolist(), passed.tolist()))) <= 2  # sums in another order may differ at the threshold
    assert 2 < len(want) / 20 < 14


def test_recall_against_brute_force(spark):
    rng = np.random.default_rng(11)
    base = rng.standard_normal((400, 64))
    rows = list(enumerate(base.tolist()))
    for i in range(300):
        u = base[i] / np.linalg.norm(base[i])
        noise = rng.standard_normal(64)
        noise -= noise @ u * u
        c = rng.uniform(0.88, 0.99)
        rows.append((1000 + i, (3 * (c * u + np.sqrt(1 - c * c) * noise / np.linalg.norm(noise))).tolist()))
    rows += [(2000 + i, base[i].tolist()) for i in range(20)]
    copies, pairs = E.near_pairs(vectors(spark, rows))
    x = np.array([r[1] for r in rows], dtype=np.float32).astype(float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    ids = [r[0] for r in rows]
    s = x @ x.T
    first = {r["vec_id"]: r["first"] for r in copies.collect()}
    want = {(ids[i], ids[j]) for i in range(len(ids)) for j in range(i + 1, len(ids)) if s[i, j] >= 0.9 and ids[i] not in first and ids[j] not in first}
    got = {(r["a"], r["b"]) for r in pairs.collect()}
    assert first == {2000 + i: i for i in range(20)}
    assert got <= want and len(got) >= 0.9 * len(want)


def test_awkward_vectors(spark):
    v = [1.0] + [0.5] * 7
    rows = [(1, v), (1, v), (2, v), (None, v), (3, None), (4, [0.0] * 8), (5, [float("nan")] * 8), (6, [1.0, None] * 4), (7, [1.0, 2.0]), (8, [-x for x in v]), (9, [float("inf")] + v[1:]), (10, [2 * x for x in v])]
    got = {tuple(r) for r in E.duplicates(vectors(spark, rows).withColumns({c: F.lit(1) for c in ("id", "unit", "a", "b")})).collect()}
    assert got == {(2, 1), (10, 1)}
    assert E.duplicates(vectors(spark, [])).count() == 0
