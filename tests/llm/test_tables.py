"""URL filters, mixing, sharding, chat windows, and the pipeline."""

import hashlib
import random
from collections import Counter, defaultdict

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import corpus_pipeline
from quarry.llm import chat_format, mixing, queries, sharding, url_filter
from tests.llm.helpers import CLASH, SF, awkward, docs, nothing, table
from tests.oracle import compare

# -- URL filters


def test_urls_equal_sql(spark):
    compare(spark, queries.op2_url_filter, url_filter.ORACLE_SQL)


def judge(spark, urls, rules):
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").withColumns({c: F.lit(1) for c in ("rule", "action", "digest", "prefix", "judged")})
    return {r["page_id"]: (r["action"], r["rule"]) for r in url_filter.judge(pages, url_filter.rules_table(spark, rules)).collect()}


def test_precedence_and_awkward_urls(spark):
    rules = [("bad.org/", "block"), ("good.bad.org/", "allow"), ("bad.org/free/", "allow"), ("bad.org/free/x.html", "block"), ("bad.org/free/x.html", "allow"), ("1.2.3.4/", "block"), ("q.net/a?b=1", "block"), (None, "block"), (" ", "block"), ("bad.org/zzz", "perhaps"), ("bad.org/", "block")]
    urls = ["http://bad.org", "HTTPS://user:p@WWW.Bad.ORG.:8080/x#y", "http://good.bad.org/free/", "http://bad.org/free/x.html", "http://bad.org/free/y", "http://notbad.org/", "http://9.1.2.3.4/", "http://1.2.3.4/z", "http://q.net/a?b=1", "http://q.net/a?b=2", None, "", "no url", "http://bad.org", "http:///path", "http://bad.org/freedom"]
    got = judge(spark, urls, rules)
    want = ["block", "block", "allow", "allow", "allow", "none", "none", "block", "block", "none", "none", "none", "none", "block", "none", "block"]
    assert [got[i][0] for i in range(len(urls))] == want and got[3][1] == "bad.org/free/x.html" and got[5][1] is None
    assert set(judge(spark, urls[:3], [("x.y/", "nothing")]).values()) == {("none", None)}
    assert judge(spark, [], rules) == {}


# -- mixing


@settings(max_examples=200, deadline=None)
@given(st.integers(0, 500), st.lists(st.tuples(st.integers(0, 5), st.integers(0, 120)), min_size=1, max_size=6))
def test_split_is_fair_and_exact(budget, children):
    weights, caps = [float(w) for w, _ in children], [c for _, c in children]
    got = mixing.split(budget, weights, caps)
    usable = sum(c for w, c in children if w > 0)
    assert sum(got) == min(budget, usable) and all(0 <= g <= c for g, c in zip(got, caps))
    levels = [g / w for g, (w, c) in zip(got, children) if w > 0 and g < c]
    if levels:  # those that aren't full have the same level, and the full ones less
        assert max(levels) - min(levels) <= 1.0 + 1e-9
        assert all(c / w <= max(levels) + 1 for g, (w, c) in zip(got, children) if w > 0 and g == c)


def test_a_shortage_goes_to_siblings_first():
    t = mixing.Targets(domains={"a": 1, "b": 1}, languages={"x": 1, "y": 1}, sources={}, share=1.0, max_epochs=1, default=1)
    leaves = [(("a", "x", "s"), 10), (("a", "y", "s"), 90), (("b", "x", "s"), 100), (("b", "y", "s"), 100)]
    t = mixing.Targets(domains=t.domains, languages=t.languages, share=200 / 300, max_epochs=1)
    got = mixing.budgets(leaves, t)
    assert got == {("a", "x", "s"): 10, ("a", "y", "s"): 90, ("b", "x", "s"): 50, ("b", "y", "s"): 50}


def brute(rows, t):
    leaf = lambda r: (t.domain_of.get(r[3], "unknown") if r[3] else "unknown", r[2] or "unknown", r[3] or "unknown")
    n = lambda r: len([w for w in __import__("re").split("[ \t\n\r]+", r[1] or "") if w])
    have = defaultdict(int)
    for r in rows:
        if n(r):
            have[leaf(r)] += n(r)
    out = Counter()
    for k, b in mixing.budgets(sorted(have.items()), t).items():
        own = [r for r in rows if leaf(r) == k and n(r)]
        whole, rest = divmod(b, have[k])
        for r in own:
            for e in range(1, whole + 1):
                out[(r[0], *k, n(r), e)] += 1
        h = lambda r: int(hashlib.md5("|".join([str(t.seed), str(whole + 1), *k, "" if r[0] is None else str(r[0])]).encode()).hexdigest()[:12], 16)
        groups = defaultdict(list)
        for r in own:
            groups[(h(r), r[0] is not None, r[0] or 0)].append(r)
        for g in sorted(groups):
            cost = sum(map(n, groups[g]))
            if cost > rest:
                break
            rest -= cost
            for r in groups[g]:
                out[(r[0], *k, n(r), whole + 1)] += 1
    return out


@pytest.mark.parametrize("share,epochs", [(0.5, 1), (0.9, 2), (1.7, 3)])
def test_mixing_equals_brute_force(spark, share, epochs):
    rng = random.Random(4)
    rows = [(i, " ".join(["w"] * rng.randint(0, 40)), rng.choice(["en", "en", "de", "fr", None]), rng.choice([f"src{k}" for k in range(6)] + [None])) for i in range(400)] + [(7, "again and again", "en", "src1"), (None, "one two three", "en", "src1")]
    t = mixing.Targets(share=share, max_epochs=epochs, sources={"src1": 3.0, "src2": 0.0})
    d = docs(spark, rows)
    got = Counter((r["doc_id"], r["domain"], r["lang"], r["source"], r["tokens"], r["epoch"]) for r in mixing.select(d, t).collect())
    assert got == brute(rows, t)
    assert Counter(r["doc_id"] for r in mixing.mix(d, t).collect()) == Counter({k: sum(c for g, c in got.items() if g[0] == k) for k in {g[0] for g in got}})


def test_awkward_mixing(spark):
    d = awkward(spark)
    out = mixing.mix(d, mixing.Targets(share=1.0, max_epochs=1))
    assert out.columns == d.columns and not {2, 3, 8} & {r["doc_id"] for r in out.collect()}
    assert mixing.select(nothing(spark)).count() == 0 and mixing.mix(nothing(spark)).count() == 0


# -- sharding


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 100), min_size=16, max_size=64), st.integers(1, 5), st.integers(0, 3))
def test_rebalancing(weight, shards, gone):
    before = sharding.first_map(shards + gone, len(weight))
    after = sharding.rebalance(before, weight, shards)
    assert len(after) == len(before) and set(after) <= set(range(shards))
    load = lambda owner: [sum(w for w, o in zip(weight, owner) if o == s) for s in range(shards)]
    if not gone:
        assert max(load(after)) <= max(load(before))
    limit = sum(weight) / shards * (1 + sharding.TOLERANCE)
    # either balanced, or what is too much can't be moved to any gain
    full = max(range(shards), key=lambda s: load(after)[s])
    low = min(load(after))
    assert load(after)[full] <= limit or all(w == 0 or w >= load(after)[full] - low for w, o in zip(weight, after) if o == full)
    assert sharding.rebalance(after, weight, shards) == after


def test_shards_of_documents(spark):
    d = table(spark, "documents")
    got = sharding.assign(d, shards=4).collect()
    assert len(got) == d.count()
    size = {r["doc_id"]: len((r["text"] or "").encode()) for r in d.collect()}
    for r in got:
        assert r["slot"] == int(hashlib.md5(str(r["doc_id"]).encode()).hexdigest()[:8], 16) % sharding.SLOTS and r["first_shard"] == r["slot"] * 4 // sharding.SLOTS
    load = [sum(size[r["doc_id"]] for r in got if r["shard"] == s) for s in range(4)]
    assert max(load) <= 1.1 * sum(load) / 4
    moved = sum(r["shard"] != r["first_shard"] for r in got)
    assert moved < len(got) / 2


def test_awkward_sharding(spark):
    d = awkward(spark)
    got = sharding.assign(d, shards=3).collect()
    assert len(got) == d.count() and len({r["slot"] for r in got if r["doc_id"] == 1}) == 1
    assert sharding.assign(nothing(spark)).count() == 0


# -- chat


def test_chat_equals_sql(spark):
    compare(spark, queries.op9_chat_format, chat_format.ORACLE_SQL)


def chat(spark, rows, **kw):
    c = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumns({x: F.lit(1) for x in ("window", "head", "body", "p", "ts", "tokens")})
    return sorted(((r["conv_id"], r["window"], r["history"], r["n_tokens"], r["n_target_tokens"], r["mask"], r["over_budget"], r["text"]) for r in chat_format.windows(c, **kw).collect()), key=repr)


def test_windows_by_hand(spark):
    w = lambda n: " ".join(["w"] * n)
    rows = [(1, 0, "system", w(6))] + [(1, i, "user" if i % 2 else "assistant", w(6)) for i in range(1, 7)]
    got = chat(spark, rows, budget=50, history=2, history_tokens=20)
    assert [g[1:6] for g in got] == [(1, 0, 50, 20, "00101"), (2, 2, 50, 10, "00001")]
    big = chat(spark, [(2, 1, "user", w(200)), (2, 2, "assistant", w(3))], budget=50)
    assert [(g[1], g[3], g[6]) for g in big] == [(1, 204, True), (2, 7, False)]


def test_each_assistant_turn_is_a_target_once(spark):
    rng = random.Random(1)
    rows = [(c, i, rng.choice(["user", "assistant", "assistant", "system"]), " ".join(["w"] * rng.randint(0, 40))) for c in range(20) for i in range(rng.randint(1, 25))]
    got = chat(spark, rows, budget=90, history=3, history_tokens=60)
    targets = Counter()
    for g in got:
        targets[g[0]] += g[5].count("1")
        assert g[3] <= 90 or g[6]
    assert targets == Counter(r[0] for r in rows if r[2] == "assistant")


def test_awkward_chats(spark):
    rows = [(None, 1, "user", "x"), (1, None, None, None), (1, 1, "assistant", ""), (1, 1, "assistant", ""), (2, 0, "system", "alone"), (3, 0, "user", "long " * 50_000)]
    got = chat(spark, rows)
    assert [(g[0], g[1], g[5]) for g in got] == [(1, 1, "011"), (3, 1, "0")] and "<|im_start|>unknown\n<|im_end|>" in got[0][7]
    assert chat(spark, []) == []


# -- the pipeline


def test_stages_keep_the_columns_and_take_effect(spark, tmp_path):
    d = spark.read.parquet(f"{SF}/documents.parquet")
    secret = d.limit(1).withColumns({"doc_id": F.lit(10**9), "text": F.concat("text", F.lit(' token = "04dbebab91ab85687d33eeaaf9ac699e1188f962" and more words here to differ'))})
    junk = d.limit(1).withColumns({"doc_id": F.lit(10**9 + 1), "text": F.lit("#### 1234 ####")})
    now = d.unionByName(secret).unionByName(junk).unionByName(d.limit(5).withColumn("doc_id", F.col("doc_id") + 10**8))
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, now, SF)
        if k < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == d.columns, name
        out.write.parquet(str(tmp_path / str(k)))
        now = spark.read.parquet(str(tmp_path / str(k)))
    step = [{r["doc_id"]: r for r in spark.read.parquet(str(tmp_path / str(k))).collect()} for k in range(5)]
    assert 10**9 + 1 not in step[0] and len(step[0]) == d.count() + 6
    assert not any(10**8 <= i < 10**9 for i in step[1]) and 0.5 * len(step[0]) < len(step[1]) < len(step[0])
    assert set(step[2]) == set(step[1]) and not any("04dbebab91ab85687d33eeaaf9ac699e1188f962" in r["text"] for r in step[2].values())
    assert set(step[4]) == set(step[3]) <= set(step[2])


def test_run_is_the_stages(spark):
    out = corpus_pipeline.run(spark, SF)
    assert out.columns == ["doc_id", "ids", "round_trip"] and out.where("not round_trip").count() == 0 and out.count() > 100


def test_pipeline_survives_awkward_rows(spark):
    now = awkward(spark)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        now = stage(spark, now, SF)
        assert now.columns == awkward(spark).columns
    assert corpus_pipeline.STAGES[-1][1](spark, now, SF).count() == now.count()
    empty = nothing(spark)
    for _, stage in corpus_pipeline.STAGES:
        empty = stage(spark, empty, SF)
    assert empty.count() == 0 and len(CLASH) > 5
