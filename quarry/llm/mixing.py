"""Mixing sources to target weights by hierarchical budgeting.

Leaves are (domain, language, source). A token budget goes down the tree: among siblings in proportion to their weights; a
child that has less than its share gets all it has, and what is left goes to its siblings, so a shortage is made up
among siblings before it reaches their parent's siblings. A leaf offers its tokens ``max_epochs`` times. It then
gives whole epochs, and of the last epoch a prefix in an order seeded by (seed, epoch, leaf): the documents before the
budget is passed.

A leaf's prefix isn't found by sorting the leaf. Documents fall into ``BINS`` ranges of the seeded hash; tokens are summed per (leaf,
range), and only the range in which the budget ends is ordered. What reaches the driver is one row a leaf.

Defined cases. Tokens are maximal runs of characters other than blank, tab, newline and carriage return; a null or empty text has none and is
never selected. A null domain, language or source counts as ``unknown``, which has the default weight. A weight of 0 or
less gives nothing. Rows with equal hash are ordered by ``doc_id``, and rows of the same ``doc_id`` enter together or
not at all; a null ``doc_id`` is its own least value. A document of more tokens than the budget left ends the prefix. An empty table gives an empty
result. Texts of any length are counted whole. Extra columns are ignored by ``select`` and kept by ``mix``, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping
from dataclasses import dataclass, field
from fractions import Fraction

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quarry.llm.common import fresh, materialize, small_side

#: Ranges of the seeded hash, a power of two.
BINS = 4096
UNKNOWN = "unknown"


@dataclass(frozen=True)
class Targets:
    """Weights of the tree's levels; names that aren't listed have ``default``."""

    domains: Mapping[str, float] = field(default_factory=lambda: {"web": 0.4, "books": 0.3, "forums": 0.2, "news": 0.1})
    languages: Mapping[str, float] = field(default_factory=lambda: {"en": 0.55, "de": 0.15, "fr": 0.15, "es": 0.15})
    sources: Mapping[str, float] = field(default_factory=dict)
    domain_of: Mapping[str, str] = field(default_factory=lambda: {f"src{i}": ("web", "books", "forums", "news")[i % 4] for i in range(20)})
    default: float = 1.0
    #: Tokens wanted, as a share of the tokens there are.
    share: float = 0.9
    max_epochs: int = 2
    seed: int = 17


def tokens_of(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit("[^ \\t\\n\\r]+")), F.lit(0)).cast("bigint")


def split(budget: int, weights: list[float], capacity: list[int]) -> list[int]:
    """Whole numbers, none above its capacity, that share ``budget`` by weight; what one can't take goes to the others.

    Children are filled in the order in which they become full as the level rises, so the work is that of sorting them. Remainders of rounding go to
    the largest fractions, ties to the first.
    """
    given = [0] * len(weights)
    exact = [Fraction(w).limit_denominator(10**9) if w > 0 else Fraction(0) for w in weights]
    open_ = sorted((i for i, w in enumerate(exact) if w > 0 and capacity[i] > 0), key=lambda i: (capacity[i] / exact[i], i))
    left, total = min(budget, sum(capacity[i] for i in open_)), sum(exact[i] for i in open_)
    for at, i in enumerate(open_):
        if left <= 0:
            break
        if left * exact[i] >= capacity[i] * total:
            given[i] = capacity[i]
            left -= capacity[i]
            total -= exact[i]
            continue
        rest = sorted(open_[at:])
        share = {k: left * exact[k] / total for k in rest}
        for k in rest:
            given[k] = int(share[k])
        more = left - sum(given[k] for k in rest)
        for k in sorted(rest, key=lambda k: (given[k] - share[k], k))[:more]:
            given[k] += 1
        break
    return given


def budgets(leaves: list[tuple[tuple[str, str, str], int]], t: Targets) -> dict[tuple[str, str, str], int]:
    """The tokens each leaf gives, from the tokens each leaf has. Each node's capacity is summed up once, so the work grows with the leaves, not their square."""
    levels = (t.domains, t.languages, t.sources)
    total = int(Fraction(t.share).limit_denominator(10**9) * sum(n for _, n in leaves))
    capacity: dict[tuple[str, ...], int] = {}
    below: dict[tuple[str, ...], set[str]] = {}
    for k, n in leaves:
        usable = n if all(level.get(name, t.default) > 0 for level, name in zip(levels, k)) else 0
        for d in range(3):
            below.setdefault(k[:d], set()).add(k[d])
            capacity[k[: d + 1]] = capacity.get(k[: d + 1], 0) + t.max_epochs * usable

    def down(prefix: tuple[str, ...], budget: int) -> Iterator[tuple[tuple[str, str, str], int]]:
        if len(prefix) == 3:
            yield prefix, budget
            return
        names = sorted(below[prefix])
        for name, b in zip(names, split(budget, [levels[len(prefix)].get(name, t.default) for name in names], [capacity[(*prefix, name)] for name in names])):
            yield from down((*prefix, name), b)

    return dict(down((), total)) if leaves else {}


def _leaf(t: Targets) -> tuple[Column, Column, Column]:
    named = lambda c: F.when(F.col(c).isNull() | (F.col(c) == ""), F.lit(UNKNOWN)).otherwise(F.col(c))
    domain = F.lit(None).cast("string")
    for name in sorted(set(t.domain_of.values())):
        domain = F.when(F.col("source").isin([s for s, d in sorted(t.domain_of.items()) if d == name]), F.lit(name)).otherwise(domain)
    return F.coalesce(domain, F.lit(UNKNOWN)), named("lang"), named("source")


def _order(t: Targets, epoch: Column, domain: Column, lang: Column, source: Column, doc_id: Column) -> Column:
    """48 bits of MD5 of seed, epoch, leaf and document, as a number."""
    key = F.concat_ws("|", F.lit(str(t.seed)), epoch.cast("string"), domain, lang, source, F.coalesce(doc_id.cast("string"), F.lit("")))
    return F.conv(F.substring(F.md5(key), 1, 12), 16, 10).cast("bigint")


def _cuts(docs: DataFrame, t: Targets) -> tuple[DataFrame, list]:
    """(domain, lang, source, doc_id, tokens) of the documents with tokens, and per leaf (whole epochs, last hash, last id)."""
    domain, lang, source = _leaf(t)
    slim = docs.select(domain.alias("domain"), lang.alias("lang"), source.alias("source"), F.col("doc_id").cast("long").alias("doc_id"), tokens_of(F.col("text")).alias("tokens")).where("tokens > 0")
    slim = materialize(slim, "mix-tokens")
    key = ["domain", "lang", "source"]
    leaves = [((r["domain"], r["lang"], r["source"]), r["n"]) for r in slim.groupBy(key).agg(F.sum("tokens").alias("n")).collect()]
    have, plan = dict(leaves), []
    for k, b in sorted(budgets(leaves, t).items()):
        plan.append((*k, b // have[k], b % have[k]))
    spark = docs.sparkSession
    part = spark.createDataFrame([p for p in plan if p[4]], "domain string, lang string, source string, epochs bigint, rest bigint")
    hashed = slim.join(small_side(part, len(plan), 128), key).withColumn("h", _order(t, F.col("epochs") + 1, F.col("domain"), F.col("lang"), F.col("source"), F.col("doc_id")))
    bins = hashed.groupBy(*key, "rest", F.shiftright("h", 48 - BINS.bit_length() + 1).alias("bin")).agg(F.sum("tokens").alias("n"))
    before = F.sum("n").over(W.partitionBy(key).orderBy("bin").rowsBetween(W.unboundedPreceding, W.currentRow))
    edge = bins.withColumn("through", before).where("through > rest").groupBy(*key).agg(F.min("bin").alias("bin"), F.min_by(F.col("through") - F.col("n"), "bin").alias("spent"))
    edge = spark.createDataFrame(edge.collect(), edge.schema)
    last = hashed.join(small_side(edge, len(plan), 128), key).where(F.shiftright("h", 48 - BINS.bit_length() + 1) == F.col("bin"))
    last = last.groupBy(*key, "rest", "spent", "bin", "h", "doc_id").agg(F.sum("tokens").alias("n"))
    w = W.partitionBy(key).orderBy(F.col("h"), F.col("doc_id").asc_nulls_first())
    last = last.withColumn("through", F.col("spent") + F.sum("n").over(w.rowsBetween(W.unboundedPreceding, W.currentRow))).where("through > rest")
    # the first document that doesn't fit: all before it are in
    stop = {tuple(r[c] for c in key): (r["first"]["h"], r["first"]["doc_id"]) for r in last.groupBy(*key).agg(F.min(F.struct("h", F.col("doc_id"))).alias("first")).collect()}
    return slim, [(*p[:3], p[3], *stop.get(p[:3], (0, None))) for p in plan]


def _epochs(df: DataFrame, plan: list, t: Targets, names: tuple[str, str, str], doc_id: str, epoch: str) -> DataFrame:
    """A row of ``df`` for each epoch in which its leaf gives it; ``names`` are the columns of the leaf."""
    mark = [fresh(df, x) for x in ("pd", "pl", "ps", "whole", "stop_h", "stop_id")]
    cuts = df.sparkSession.createDataFrame(plan, ", ".join(f"`{m}` {k}" for m, k in zip(mark, ("string", "string", "string", "bigint", "bigint", "bigint"))))
    joined = df.join(small_side(cuts, len(plan), 128), [F.col(a) == F.col(b) for a, b in zip(names, mark)])
    whole, stop_h, stop_id = (F.col(m) for m in mark[3:])
    h = _order(t, whole + 1, *(F.col(n) for n in names), F.col(doc_id))
    partial = (h < stop_h) | ((h == stop_h) & stop_id.isNotNull() & (F.col(doc_id).isNull() | (F.col(doc_id) < stop_id)))
    given = whole + F.when(partial, 1).otherwise(0)
    return joined.where(given > 0).withColumn(epoch, F.explode(F.sequence(F.lit(1).cast("bigint"), given))).drop(*mark)


def select(docs: DataFrame, t: Targets = Targets()) -> DataFrame:
    """(doc_id, domain, lang, source, tokens, epoch): a row for each time a document is used."""
    slim, plan = _cuts(docs, t)
    return _epochs(slim, plan, t, ("domain", "lang", "source"), "doc_id", "epoch").select("doc_id", "domain", "lang", "source", "tokens", "epoch")


def mix(docs: DataFrame, t: Targets = Targets()) -> DataFrame:
    """``docs`` with each row as often as it is used; a filter and a broadcast of the leaves, no shuffle of texts."""
    _, plan = _cuts(docs, t)
    domain, lang, source = _leaf(t)
    names = [fresh(docs, x) for x in ("domain", "lang", "source", "id", "epoch")]
    marked = docs.withColumns(dict(zip(names, (domain, lang, source, F.col("doc_id").cast("long"))))).where(tokens_of(F.col("text")) > 0)
    return _epochs(marked, plan, t, tuple(names[:3]), names[3], names[4]).select(*[F.col(f"`{c}`") for c in docs.columns])
