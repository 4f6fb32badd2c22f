"""Language ID, secret scans, SentencePiece, top-k search."""

import itertools
import math
import re
from collections import Counter
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quarry.llm import language_id as L
from quarry.llm import piece_codec as P
from quarry.llm import queries, textkit, topk_search
from quarry.llm import secret_scan as S
from tests.llm.helpers import MODEL, awkward, docs, nothing, table
from tests.oracle import SF, compare

library = sentencepiece.SentencePieceProcessor(model_file=MODEL)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(max_size=60), min_size=1, max_size=6))
def test_word_hashes_are_those_of_the_words(texts):
    import pyarrow as pa

    texts = [t for t in texts if t.encode("utf-8", "ignore").decode() == t]
    for a, b, offsets, raw in textkit.blocks(pa.array(texts, pa.string()), lower=False, size=50):
        h, row, _, _ = textkit.word_hashes(offsets, raw)
        want = [(i, w) for i in range(b - a) for w in re.findall(rb"[0-9a-z\x80-\xff]+", texts[a + i].encode())]
        assert row.tolist() == [i for i, _ in want]
        assert len(set(zip((w for _, w in want), h.tolist()))) == len({w for _, w in want})


# -- language ID


def test_held_out_accuracy(spark):
    d = table(spark, "documents", "/root/testdata/sf0.01")
    train, rest = d.where("doc_id % 2 = 0"), d.where("doc_id % 2 = 1")
    got = L.identify(rest, L.train(train, 60)).join(rest.select("doc_id", "lang"), "doc_id").collect()
    assert np.mean([r["language"] == r["lang"] for r in got]) > 0.97 and np.mean([r["accepted"] for r in got]) > 0.97


def test_scores_are_those_of_a_plain_classifier(spark):
    d = docs(spark, [(i, t, lang, "s") for i, (t, lang) in enumerate([("aab ba", "x"), ("bbb ab", "y"), ("aaa", "x"), ("b'ab", "y")])])
    m = L.train(d)
    for text in ("aab", "bbb ab", "a?a b", ""):
        import pyarrow as pa

        names, margin, n = L.classify(m, pa.array([text]))
        counts = Counter()
        clean = re.sub(r"[^a-z']", " ", text.lower())
        for k in L.SIZES:
            for i in range(len(clean) - k + 1):
                if clean[i : i + k].strip():
                    h = np.uint64(k * 0x9E3779B1)
                    for c in clean[i : i + k]:
                        h = np.uint64((int(h ^ np.uint64(ord(c))) * 0x100000001B3) % 2**64)
                    counts[int((h ^ (h >> np.uint64(29))) & np.uint64(L.BUCKETS - 1))] += 1
        scores = [sum(c * int(w[b]) for b, c in counts.items()) for w in m.weights]
        assert n[0] == sum(counts.values())
        if n[0]:
            assert names[0] == m.labels[int(np.argmax(scores))] and math.isclose(margin[0], abs(scores[0] - scores[1]) / L.SCALE)
        else:
            assert names[0] == "und"


def test_awkward_languages(spark):
    d = awkward(spark)
    got = L.identify(d).collect()
    assert len(got) == d.count()
    by = {r["doc_id"]: r for r in got}
    assert all(by[i]["language"] == "und" and not by[i]["accepted"] for i in (2, 3, 6, 8))
    assert by[5]["language"] == "es" and by[5]["accepted"]
    kept = L.keep_identified(d)
    assert kept.columns == d.columns and not {2, 3, 6, 8} & {r["doc_id"] for r in kept.collect()}
    assert L.identify(nothing(spark)).count() == 0
    unlabelled = L.identify(d.withColumn("lang", F.lit(None).cast("string"))).collect()
    assert {r["language"] for r in unlabelled} == {"und"}


def test_what_fits_no_label_is_rejected(spark):
    rng = np.random.default_rng(2)
    d = table(spark, "documents", "/root/testdata/sf0.01")
    m = L.train(d)
    strange = ["".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz   "), 120)) for _ in range(30)] + ["".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), 100)) for _ in range(30)]
    strange += ["La ragazza è andata al mercato con sua madre per comprare il pane e la frutta della settimana", "Девочка пошла на рынок с матерью, чтобы купить хлеб и фрукты", "彼女は母と一緒に市場へ行きました"]
    clean = [("the cat sat on the mat and looked at the dog in the garden", "en"), ("le chat est dans le jardin avec le chien", "fr"), ("der Hund und die Katze sind in dem Garten", "de"), ("the girl went to the market with her mother to buy bread", "en")]
    got = {r["doc_id"]: r for r in L.identify(docs(spark, [(i, t, None, "s") for i, t in enumerate(strange + [c[0] for c in clean])]), m).collect()}
    assert not [strange[i] for i in range(len(strange)) if got[i]["accepted"]]
    assert [(got[len(strange) + i]["language"], got[len(strange) + i]["accepted"]) for i in range(len(clean))] == [(lang, True) for _, lang in clean]
    assert L.identify(d, m).where("not accepted").count() <= 0.005 * d.count()


# -- secrets


@settings(max_examples=80, deadline=None)
@given(st.text("abcdef0123456789", min_size=20, max_size=70))
def test_entropy_of_moving_windows(value):
    def entropy(w):
        return -sum(c / len(w) * math.log2(c / len(w)) for c in Counter(w).values())

    want = max(entropy(value[i : i + 20]) for i in range(len(value) - 19))
    assert abs(S.window_entropy(value.encode(), 20) - want) < 2e-6


def test_secrets_equal_sql(spark):
    assert compare(spark, queries.op8_secret_scan, S.ORACLE_SQL, "/root/testdata/sf0.01")


def test_secrets_and_allow_list(spark):
    hexed = "04dbebab91ab85687d33eeaaf9ac699e1188f962"
    b64 = "Zm9vYmFyMTIzNDU2Nzg5cXdlcnR5dWlvcEFTREZHSEo"
    rows = [
        (1, f'é token = "{hexed}" end', "en", "s"), (2, f"commit {hexed}", "en", "s"), (3, f"key {b64} and {hexed}", "en", "s"),
        (4, "id 123e4567-e89b-12d3-a456-426614174000", "en", "s"), (5, "a" * 40 + "1", "en", "s"), (6, "1" * 40, "en", "s"),
        (7, "wJalrXUtnFEMI/K7MDENG/bPxRfiCYEXAMPLEKEY", "en", "s"), (8, "thequickbrownfoxjumpsoverthelazydogandruns", "en", "s"), (9, "0123456789abcdef0123456789abcdef", "en", "s"),
    ]
    d = docs(spark, rows).unionByName(docs(spark, rows[:1]))
    got = sorted((r["doc_id"], r["kind"], r["start"], r["length"]) for r in S.findings(d).collect())
    assert got == [(1, "hex", 11, 40), (1, "hex", 11, 40), (3, "base64", 4, len(b64)), (3, "hex", 9 + len(b64), 40)]
    red = {r["doc_id"]: r for r in S.redact(d).collect()}
    assert red[1]["text"] == 'é token = "[SECRET]" end' and red[1]["n_chars"] == len(red[1]["text"])
    assert red[3]["text"] == "key [SECRET] and [SECRET]" and red[2]["text"].endswith(hexed)


def test_awkward_secrets(spark):
    d = awkward(spark)
    assert S.findings(d).count() == 0 and S.findings(nothing(spark)).count() == 0
    assert sorted(map(repr, S.redact(d).collect())) == sorted(map(repr, d.collect()))
    deep = docs(spark, [(1, "x " * 300_000 + "04dbebab91ab85687d33eeaaf9ac699e1188f962", "en", "s")])
    assert S.findings(deep).first()["start"] == 600_000


# -- SentencePiece


def ids_of(spark, texts):
    got = P.encode(docs(spark, [(i, t, "en", "s") for i, t in enumerate(texts)]), MODEL).collect()
    return {r["doc_id"]: (r["ids"], r["round_trip"]) for r in got}


def test_ids_are_the_library_s(spark):
    texts = [r["text"] for r in table(spark, "documents").collect()]
    texts += ["", " ", "   leading", "a  b   c\n\n d\t\x00e é\U0001f600 " + "x" * 100 + " " * 70 + "ab" * 200, "zz" * 20_000, "aaaaaaa bananana", "\x01\x00", "naïve ﬁ 日本語 текст"]
    got = ids_of(spark, texts)
    assert [got[i][0] for i in range(len(texts))] == library.encode(texts)
    assert all(got[i][1] for i in range(len(texts)))
    back = P.decode(P.encode(docs(spark, [(i, t, "en", "s") for i, t in enumerate(texts)]), MODEL), MODEL).collect()
    assert {r["doc_id"]: r["text"] for r in back} == dict(enumerate(texts))


@settings(max_examples=5, deadline=None)
@given(st.lists(st.text("abcthein .,\n▁éß", max_size=70), min_size=20, max_size=40))
def test_random_texts(spark, texts):
    got = ids_of(spark, texts)
    assert [got[i][0] for i in range(len(texts))] == library.encode(texts)


def test_awkward_encoding(spark):
    d = awkward(spark)
    got = P.encode(d, MODEL).collect()
    assert len(got) == d.count() and {repr(r["ids"]) for r in got if r["doc_id"] == 2} == {"None"} and [r["ids"] for r in got if r["doc_id"] == 3] == [[]]
    assert P.encode(nothing(spark), MODEL).count() == 0
    shuffled = d.repartition(3)  # not a plain scan
    assert P.encode(shuffled, MODEL).count() == d.count()


def test_equal_blocks_stay_apart(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(P, "BLOCK_CHARS", 50)
    text = "the cat sat on the mat and looked at the dog in the garden"
    d = docs(spark, [(1, text, "en", "s")] * 2 + [(2, "short", "en", "s"), (None, None, "en", "s"), (None, "", "en", "s")])
    d.coalesce(1).write.parquet(f"{tmp_path}/one")
    d.repartition(5).write.parquet(f"{tmp_path}/many")
    want = sorted([(1, library.encode(text), True)] * 2 + [(2, library.encode("short"), True), (None, None, None), (None, [], True)], key=repr)
    for df in (d, spark.read.parquet(f"{tmp_path}/one"), spark.read.parquet(f"{tmp_path}/many")):
        assert sorted((tuple(r) for r in P.encode(df, MODEL).collect()), key=repr) == want


def packed(texts, buckets):
    """The batches of words asked for and of rows, and the texts that they say, of one task."""
    cutter, labels = P.Cutter(P.load(MODEL)), np.arange(buckets)
    batches = [pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts)], ["doc_id", "text"])]
    asks, rows = (list(P._packer(cutter, labels, x)(iter(batches))) for x in (True, False))
    asked = [w for b in asks for x in b.column(2).to_pylist() for w in P._unlist(x[8:])]
    (head,) = [x for b in rows for k, x in zip(b.column(1).to_pylist(), b.column(3).to_pylist()) if k == 1]
    (times,) = P._unpack(head[8:], np.uint32)
    words = [asked[i] for i in np.argsort(P._ranks(times.astype(np.int64)))]
    said = []
    for data in (x for b in rows for k, x in zip(b.column(1).to_pylist(), b.column(3).to_pylist()) if k == 2):
        _, _, counts, _, seq = P._unpack(data, np.bool_, np.int64, np.int32, np.uint8, np.uint32)
        ends = np.cumsum(np.maximum(counts, 0))
        said += ["".join(words[i] for i in seq[e - max(n, 0) : e]) for n, e in zip(counts, ends)]
    assert len(asked) == len(set(asked)) and times.sum() == sum(map(len, [cutter.words(P.MARK + t.replace(" ", P.MARK), np.array([0]))[1][1:] for t in texts if t]))
    return asks, rows, said


def test_blocks_say_their_texts_even_if_hashes_collide(monkeypatch):
    monkeypatch.setattr(P, "TaskContext", SimpleNamespace(get=lambda: SimpleNamespace(partitionId=lambda: 3)))
    monkeypatch.setattr(P, "SLICE_CHARS", 300)
    monkeypatch.setattr(P, "CHUNK_WORDS", 50)
    texts = ["the cat sat on the mat", "", "zz \x00 \x01 \U0001f600 end", "aaaaaaaab aaaaaaaac aaaaaaaa"] + [f"word{i % 7} and the garden{i}" for i in range(90)]
    want = [P.MARK + t.replace(" ", P.MARK) if t else "" for t in texts]
    asks, rows, said = packed(texts, 4)
    assert said == want
    # all lists of a block are sent together, and so are its rows
    assert len(asks) == len(rows) == 1 and asks[0].num_rows == 4
    monkeypatch.setattr(P, "BATCH_BYTES", 1)
    asks, rows, said = packed(texts, 4)
    assert said == want and len(asks) == 4
    monkeypatch.setattr(P, "_hashes", lambda points, starts: np.full(len(starts) - 1, 5, dtype=np.uint64))
    assert packed(texts, 4)[2] == want


def test_texts_are_read_and_words_folded_once(spark, tmp_path):
    texts = ["the cat sat on the mat", "x" * 61 + " " + "é" * 70, "ab" * 30 + " tttttttttttttt", "", "zz \U0001f600"]
    docs(spark, list(zip(range(5), texts, ["en"] * 5, ["s"] * 5))).write.parquet(f"{tmp_path}/docs")
    df = P.encode(spark.read.parquet(f"{tmp_path}/docs"), MODEL)
    assert {r["doc_id"]: r["ids"] for r in df.collect()} == dict(enumerate(library.encode(texts)))
    plan = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    # one scan of the texts, and MapInArrow for packing, distinct words, answers and documents
    assert plan.count("Scan parquet") == 1 and plan.count("MapInArrow") == 4


def test_merges_that_wait_for_others(spark):
    # "abc" is best but has no two parts at first; "ab" and "bcd" come later
    ranks = {"abc": -1.0, "bcde": -2.0, "ab": -3.0, "cd": -4.0, "bcd": -5.0, "de": -6.0, "abcd": -7.0, "cde": -8.0}
    pieces = {c: -100.0 for c in "abcde"} | ranks
    v = P.Vocabulary(("<unk>", *pieces), (0.0, *pieces.values()), (P.UNK, *[P.NORMAL] * len(pieces)), True, True)
    texts = ["".join(x) for n in range(1, 7) for x in itertools.product("abcde", repeat=n) if n < 4 or "abc" in "".join(x) or "bcd" in "".join(x)] + ["abcde" * 12, "abcde" * 12 + "a", "abxcd"]
    got = {r["word"]: r["ids"] for r in P.word_ids(spark.createDataFrame([(0, t) for t in texts], "bucket int, word string"), v).collect()}
    plain = P._long_encoder(v)
    assert got == {t: plain(t) if len(t) <= P.FOLD_CHARS else None for t in texts}


def test_unigram_models_are_folded_by_viterbi(spark):
    pieces = {"▁": -3.0, "a": -2.0, "b": -2.5, "ab": -3.2, "▁a": -3.1, "ba": -4.0, "▁ab": -6.0, "bb": -4.6}
    v = P.Vocabulary(("<unk>", *pieces), (0.0, *pieces.values()), (P.UNK, *[P.NORMAL] * len(pieces)), False, True)
    texts = ["▁ab", "▁abab", "▁bba", "▁", "ax", "abbbabab"]
    got = {r["word"]: r["ids"] for r in P.word_ids(spark.createDataFrame([(0, t) for t in texts], "bucket int, word string"), v).collect()}
    worst = -min(pieces.values()) + 10

    def cheapest(t):
        if not t:
            return 0.0
        return min((-pieces[t[:k]] if t[:k] in pieces else worst) + cheapest(t[k:]) for k in range(1, len(t) + 1) if k == 1 or t[:k] in pieces)

    names = ("<unk>", *pieces)
    for t in texts:
        cost = sum(worst if i == 0 else -pieces[names[i]] for i in got[t])
        assert math.isclose(cost, cheapest(t)) and sum(len(names[i]) if i else 1 for i in got[t]) == len(t)
        assert got[t] == P._long_encoder(v)(t) or math.isclose(cost, cheapest(t))


# -- top-k search


def test_search_equals_sql(spark):
    assert compare(spark, queries.op7_topk_search, topk_search.ORACLE_SQL)


def test_search_in_small_slices_and_groups(spark, monkeypatch):
    d, q = table(spark, "documents"), table(spark, "benchmark")
    want = sorted(map(tuple, topk_search.search(d, q).collect()))
    monkeypatch.setattr(topk_search, "QUERY_GROUP", 7)
    assert sorted(map(tuple, topk_search.search(d.repartition(5), q).collect())) == want


def test_awkward_search(spark):
    q = spark.createDataFrame([(1, "cat dog cat"), (2, None), (3, ""), (None, "cat"), (4, "nowhere"), (5, "MUNDO")], "item_id long, text string").withColumn("score", F.lit(1))
    d = awkward(spark)
    got = [tuple(r) for r in topk_search.search(d, q).orderBy("item_id", "rank").collect()]
    assert [(g[0], g[2]) for g in got] == [(1, 1), (1, 1), (5, 5)]
    assert topk_search.search(nothing(spark), q).count() == 0 and topk_search.search(d, q.limit(0)).count() == 0
    ties = docs(spark, [(i, "same words here", "en", "s") for i in range(30, 0, -1)])
    assert [r["doc_id"] for r in topk_search.search(ties, q.where("item_id = 1").withColumn("text", F.lit("words"))).orderBy("rank").collect()] == list(range(1, 11))

