"""Queries against brute force on tables that hold pairs, and what must hold at any size."""

import hashlib
import random
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry.errors import QuarryError
from quarry.llm import embedding_neardup as E
from quarry.llm import language_id as L
from quarry.llm import mixing, queries, sharding, topk_search, url_filter
from quarry.llm import piece_codec as P
from quarry.llm import simhash_neardup as S
from quarry.shared import clean, discard, materialize, shared_dir
from tests.llm.helpers import docs, table


def roots(pairs):
    """{member: least member of its group} of every group with more than one member."""
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in pairs:
        x, y = sorted((find(a), find(b)))
        root[y] = x
    return {x: find(x) for x in root if find(x) != x}


# -- SimHash


def test_pairs_are_exact_whatever_the_sizes(spark):
    """Codes a bit apart meet, however unlike their documents' sizes; every pair comes once."""
    rng = np.random.default_rng(8)
    rows = []
    for i, c in enumerate(rng.integers(-(2**63), 2**63 - 1, (60, 2), dtype=np.int64).tolist()):
        for k in range(5):
            x = [v & 0xFFFFFFFFFFFFFFFF for v in c]
            for b in rng.choice(128, rng.integers(0, 24), replace=False).tolist():
                x[b // 64] ^= 1 << (b % 64)
            rows.append((i * 5 + k, *(v - (1 << 64) if v >> 63 else v for v in x), int(rng.integers(1, 5000))))
    nodes = spark.createDataFrame(rows, "id long, c0 long, c1 long, words int").dropDuplicates(["c0", "c1"])
    kept = nodes.collect()
    code = [(r["id"], (r["c0"] & 0xFFFFFFFFFFFFFFFF) | (r["c1"] & 0xFFFFFFFFFFFFFFFF) << 64) for r in kept]
    for tau in (0, 7, 20):
        want = sorted((min(a, b), max(a, b)) for (a, x), (b, y) in combinations(code, 2) if (x ^ y).bit_count() <= tau)
        assert sorted(tuple(r) for r in S.hamming_pairs(nodes, tau, names=S.CODE).collect()) == want
    assert sorted(tuple(r) for r in S.hamming_pairs(nodes.limit(1), 20, names=S.CODE).collect()) == []


def test_the_query_equals_brute_force(spark, tmp_path):
    rng = random.Random(9)
    vocabulary = ["".join(rng.choice("aeioulmnrst") for _ in range(rng.randint(2, 8))) for _ in range(5000)]
    rows = []
    for i in range(80):
        base = [rng.choice(vocabulary) for _ in range(rng.randint(20, 700))]
        for k in range(rng.randint(1, 4)):
            rate = rng.choice([0, 0.02, 0.05, 0.1, 0.2])
            rows.append((len(rows) * 7 % 1000, " ".join(rng.choice(vocabulary) if rng.random() < rate else w for w in base), "en", "s"))
    docs(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    code = {r["doc_id"]: np.array(r[1:5], dtype=np.int64).view(np.uint64) for r in S.simhash_codes(docs(spark, rows)).collect()}
    near = []
    for a, b in combinations(code, 2):
        d = np.bitwise_count(code[a] ^ code[b]).tolist()
        if d[0] + d[1] <= S.TAU_WORDS and d[2] + d[3] <= S.TAU_PAIRS:
            near.append((a, b))
    assert len(near) > 20
    got = {r["doc_id"]: r["kept_doc_id"] for r in queries.op3_simhash_neardup(spark, str(tmp_path)).collect()}
    assert got == roots(near)


def test_estimated_counts_follow_the_correlation():
    """Bits that are copies of one another differ together; independent ones don't."""
    rng = np.random.default_rng(0)
    free = rng.integers(0, 2, (4000, 8))
    tied = np.repeat(rng.integers(0, 2, (4000, 1)), 8, axis=1)
    for bits, least in ((free, 0.0), (tied, 0.4)):
        near = S._near((bits.T @ bits).astype(float), len(bits), list(range(8)))
        assert abs(near[-1] - 1) < 1e-9 and near[0] >= least and (least or near[0] < 0.02)


# -- embeddings


def test_embedding_query_equals_brute_force(spark, tmp_path):
    """Groups and kept ids, with copies, near pairs, a chain and two dimensions in one table."""
    rng = np.random.default_rng(5)
    unit = lambda v: v / np.linalg.norm(v)
    rows, at = [], 0
    for dims, n in ((64, 300), (24, 40)):
        base = rng.standard_normal((n, dims))
        for i, b in enumerate(base):
            rows.append((at, b))
            at += 1
            if i % 3 == 0:
                z = rng.standard_normal(dims)
                z = unit(z - (z @ unit(b)) * unit(b))
                rows.append((at, 5 * (0.97 * unit(b) + np.sqrt(1 - 0.97**2) * z)))
                at += 1
            if i % 10 == 0:
                rows.append((at, 2 * b))
                at += 1
    spark.createDataFrame([(i, [float(x) for x in v], 0) for i, v in rows], "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    near = [(i, j) for (i, v), (j, w) in combinations([(i, unit(np.asarray(v, dtype=np.float32).astype(float))) for i, v in rows], 2) if len(v) == len(w) and v @ w >= E.THRESHOLD]
    want = roots(near)
    got = {r["vec_id"]: r["kept_vec_id"] for r in queries.op1_embedding_neardup(spark, str(tmp_path)).collect()}
    assert set(got) <= set(want) and all(got[k] == want[k] for k in got) and len(got) >= 0.95 * len(want)
    assert {k for k, v in want.items()} & {i for i, v in rows if len(v) == 24} & set(got)


def test_no_cosine_is_rounded_up(spark):
    b = np.zeros(16)
    b[0] = 1
    c = 0.8999997
    w = c * b + np.sqrt(1 - c * c) * np.eye(16)[1]
    v = spark.createDataFrame([(1, b.tolist(), 0), (2, w.tolist(), 0)], "vec_id long, embedding array<double>, label int")
    assert E.duplicates(v).count() == 0


# -- SentencePiece


def unigram(pieces):
    return P.Vocabulary(("<unk>", *pieces), (0.0, *pieces.values()), (P.UNK, *[P.NORMAL] * len(pieces)), False, True)


def test_unigram_ids_at_any_length_and_ties(spark):
    v = unigram({"a": -1.0, "aa": -2.0, "b": -2.5, "ab": -3.2, "ba": -3.5, "bb": -4.6, "▁": -3.0})
    rng = random.Random(3)
    texts = ["aaa", "aaaa", "b", "x", "xx", "axb", *("".join(rng.choice("aabbx▁") for _ in range(n)) for n in (5, 59, 60, 61, 62, 200, 900))]
    got = {r["word"]: r["ids"] for r in P.word_ids(spark.createDataFrame([(0, t) for t in texts], "bucket int, word string"), v).collect()}
    plain = P._long_encoder(v)
    assert got == {t: plain(t) for t in texts} and got["aaa"] == [1, 2]


def test_long_texts_are_cut_in_parts(spark, monkeypatch):
    import sentencepiece

    from tests.llm.helpers import MODEL

    library = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    monkeypatch.setattr(P, "SLICE_CHARS", 40)
    monkeypatch.setattr(P, "CHUNK_WORDS", 7)
    texts = ["the cat sat on the mat and looked at the dog in the garden, " * 20, "", "short", "w" * 500 + " end", "é\U0001f600 " * 60, " " * 90]
    got = {r["doc_id"]: (r["ids"], r["round_trip"]) for r in P.encode(docs(spark, [(i, t, "en", "s") for i, t in enumerate(texts)]).coalesce(1), MODEL).collect()}
    assert [got[i] for i in range(len(texts))] == [(x, True) for x in library.encode(texts)]


# -- URL filters


def judged(spark, urls, rules):
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    return [r["rule"] for r in url_filter.judge(pages, url_filter.rules_table(spark, rules)).orderBy("page_id").collect()]


def test_canonical_urls_and_rules(spark):
    rules = [("Bad.org", "block"), ("bad.org/free/", "allow"), ("[::1]/x", "block"), ("é.net/%7Euser/", "block"), ("a.b/c d".replace(" ", "%20"), "block")]
    urls = ["http://BAD.org/a/../free/y", "http://bad.org/%66ree/y", "http://bad.org//free//y", "http://[::1]:8080/x", "http://[::2]/x", "http://É.net/~user/z", "http://a.b/c%2520d", "http://bad.org/free/%2e%2e/z"]
    assert judged(spark, urls, rules) == ["bad.org/free/", "bad.org/free/", "bad.org/free/", "[::1]/x", None, "é.net/%7Euser/", "a.b/c%20d", "Bad.org"]
    for wrong in ("http://bad.org/", "bad org/", "/only/path", "bad.org/#top"):
        with pytest.raises(Exception, match="isn't a rule"):
            judged(spark, urls[:1], [(wrong, "block")])
    assert judged(spark, urls[:2], []) == [None, None]


def test_expressions_are_those_of_the_definition():
    host, parts = "a.b.example.com", ["p", "q", "r.html"]
    url = f"http://{host}/" + "/".join(parts) + "?k=v#f"
    hosts = [".".join(host.split(".")[i:]) for i in range(3)]
    paths = ["/", "/p/", "/p/q/", "/p/q/r.html", "/p/q/r.html?k=v"]
    assert set(url_filter.digests(url)) == {hashlib.sha256((h + p).encode()).digest() for h in hosts for p in paths}
    assert len(url_filter.digests("http://x.y.z/" + "d/" * 20_000)) == 2 * 20_001  # linear: at once


# -- language ID


def test_the_sample_is_bounded_whatever_repeats(spark):
    many = spark.range(20_000).select(F.lit(7).cast("long").alias("doc_id"), F.lit("the cat sat on the mat").alias("text"), F.lit("en").alias("lang"))
    other = spark.range(500).select((F.col("id") + 100).alias("doc_id"), F.lit("le chat est dans le jardin").alias("text"), F.lit("fr").alias("lang"))
    d = many.unionAll(other)
    assert {r["lang"]: r["count"] for r in L.training_rows(d, 50).groupBy("lang").count().collect()} == {"en": 50, "fr": 50}
    assert L.train(d, 50).labels == ("en", "fr")


def test_without_a_column_of_labels(spark):
    d = spark.createDataFrame([(1, "the cat")], "doc_id long, text string")
    assert L.keep_identified(d).count() == 0 and L.keep_identified(d).columns == ["doc_id", "text", "lang"]


# -- mixing, sharding, search


def test_many_leaves(spark):
    leaves = [((f"d{i % 7}", "en", f"host{i}"), i % 50 + 1) for i in range(100_000)]
    t = mixing.Targets(domains={}, languages={}, sources={})
    got = mixing.budgets(leaves, t)
    have = dict(leaves)
    assert len(got) == len(leaves) and sum(got.values()) == int(0.9 * sum(have.values())) and all(0 <= b <= 2 * have[k] for k, b in got.items())


def test_map_versions_are_read_back_and_edited(spark, tmp_path):
    d, path = table(spark, "documents"), f"{tmp_path}/map"
    assert sharding.last_version(spark, path) == 0
    one = {r["doc_id"]: r for r in sharding.assign(d, shards=4, path=path).collect()}
    two = {r["doc_id"]: r for r in sharding.assign(d, shards=5, path=path).collect()}
    assert sharding.last_version(spark, path) == 3 and {r["map_version"] for r in two.values()} == {3}
    second, third = sharding.load_map(spark, path, 2), sharding.load_map(spark, path, 3)
    assert all(r["shard"] == second[r["slot"]] for r in one.values())
    assert all(r["first_shard"] == second[r["slot"]] and r["shard"] == third[r["slot"]] for r in two.values())
    weight = [0] * sharding.SLOTS
    for r in d.collect():
        weight[int(hashlib.md5(str(r["doc_id"]).encode()).hexdigest()[:8], 16) % sharding.SLOTS] += len((r["text"] or "").encode())
    assert second == sharding.rebalance(sharding.first_map(4), weight, 4) and third == sharding.rebalance(second, weight, 5)
    with pytest.raises(Exception, match="exist"):
        sharding.save_map(spark, path, 3, third)


def test_best_ones_are_kept_across_batches(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "16")
    try:
        rng = random.Random(2)
        d = docs(spark, [(None if i % 50 == 0 else rng.randrange(200), " ".join(rng.choice(["cat", "dog", "sun", "x"]) for _ in range(rng.randint(0, 6))), "en", "s") for i in range(400)])
        q = spark.createDataFrame([(i, w) for i, w in enumerate(["cat", "dog sun", "x x cat", "none"])], "item_id long, text string")
        few = sorted(map(repr, topk_search.search(d.coalesce(1), q, 5).collect()))
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert few == sorted(map(repr, topk_search.search(d.repartition(9), q, 5).collect())) and len(few) == 15


# -- the shared folder


def test_intermediate_tables_can_be_removed(spark):
    import os

    df = materialize(spark.range(10), "a-table")
    path = df.inputFiles()[0].removeprefix("file://").rsplit("/", 1)[0]
    assert os.path.exists(path) and df.count() == 10
    discard(df)
    assert not os.path.exists(path)
    other = materialize(spark.range(10), "another")
    clean(spark)
    assert not os.path.exists(other.inputFiles()[0].removeprefix("file://") if other._jdf is None else path)


def test_a_cluster_without_a_shared_folder_is_an_error():
    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()

        class conf:
            @staticmethod
            def get(key, default=None):
                return default

    with pytest.raises(QuarryError):
        shared_dir(Session())
