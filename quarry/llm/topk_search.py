"""Exact top-k search: exhaustive term-at-a-time accumulation of BM25 impacts.

Every row of the query table is a query over every document. Each task inverts its documents into postings of the query terms only, scatters
each term's weighted postings into a dense score array [queries, documents], and keeps its best k of each query, ties included: what a query has kept so far
is the bar for the documents that follow, so a task sends about k rows a query, however many documents it reads. Spark
merges these. Impacts are whole numbers (BM25 times ``SCALE``, rounded), so scores don't depend on the order of summing, and equal scores
are ranked by ``doc_id``. Document frequencies, lengths and counts come from a first pass over all documents, one for all queries.

Queries are cut into terms in Spark; the driver holds a number for each of their terms, no text. They are broadcast in groups of ``QUERY_GROUP`` rows; a larger
query table takes more passes, so nothing that is broadcast grows without bound.

Defined cases. Terms are lower-cased runs of ASCII letters and digits and of non-ASCII characters, known by a 64-bit hash. A
null or empty query has no result, nor has a document that shares no term with a query. A null or empty document counts
in the statistics with length 0. Texts are searched whole, at any length. A query's repeated term counts as often as it stands there. Repeated rows are ranked each for
itself; a null ``doc_id`` comes last among ties. Fewer than k matches give fewer rows. An empty table on either side gives an empty result. Extra columns are ignored,
whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quarry.llm import textkit

K, K1, B, SCALE = 10, 1.2, 0.75, 1_000_000
QUERY_GROUP = 10_000
#: Scores held at once, about; documents are taken in slices that keep to it.
SCORES = 1 << 21


def _postings(offsets: np.ndarray, raw: np.ndarray, terms: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(term number, row, count) of the query terms by term and row, and each row's length."""
    h, row, _, _ = textkit.word_hashes(offsets, raw)
    n = len(offsets) - 1
    length = np.bincount(row, minlength=n)
    if not len(h) or not len(terms):
        empty = np.zeros(0, np.int64)
        return empty, empty, empty, length
    at = np.minimum(np.searchsorted(terms, h), len(terms) - 1)
    known = terms[at] == h
    key, count = np.unique(at[known] * n + row[known], return_counts=True)
    return key // n, key % n, count, length


def _statistics(docs: DataFrame, terms: np.ndarray) -> tuple[np.ndarray, int, int]:
    """(documents with each term, documents, words) over all documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms = sent.value
        df, n, words = np.zeros(len(terms), dtype=np.int64), 0, 0
        for batch in batches:
            for a, b, offsets, raw in textkit.blocks(batch.column(0), lower=True):
                term, _, _, length = _postings(offsets, raw, terms)
                df += np.bincount(term, minlength=len(terms))
                n += b - a
                words += int(length.sum())
        some = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate((some, [-1, -2]))), pa.array(np.concatenate((df[some], [n, words])))], ["term", "n"])

    sent = docs.sparkSession.sparkContext.broadcast(terms)
    df, n, words = np.zeros(len(terms), dtype=np.int64), 0, 0
    for r in docs.select("text").mapInArrow(run, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).collect():
        if r["term"] >= 0:
            df[r["term"]] = r["n"]
        elif r["term"] == -1:
            n = r["n"]
        else:
            words = r["n"]
    return df, n, words


def _query_terms(queries: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(item_id, term, how often) of all queries."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, offsets, raw in textkit.blocks(batch.column(1), lower=True):
                h, row, _, _ = textkit.word_hashes(offsets, raw)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a).take(pa.array(row, pa.int64())), pa.array(h.view(np.int64))], ["item_id", "term"])

    own = queries.where("item_id is not null and text is not null").select(F.col("item_id").cast("long").alias("item_id"), "text")
    table = own.mapInArrow(run, "item_id long, term long").groupBy("item_id", "term").agg(F.count(F.lit(1)).alias("n")).toArrow()
    item, term, n = (table.column(i).to_numpy().astype(np.int64) for i in range(3))
    order = np.lexsort((term, item))
    return item[order], term[order].view(np.uint64), n[order]


def _search_group(docs: DataFrame, ids: np.ndarray, query: np.ndarray, term: np.ndarray, often: np.ndarray, df: np.ndarray, n_docs: int, words: int, k: int) -> DataFrame:
    """The best k of each query; (query, term, often) are numbers into ``ids`` and term hashes, ``df`` goes with the distinct terms."""
    terms = np.unique(term)
    idf = np.log(1 + (n_docs - df + 0.5) / (df + 0.5))
    average = words / max(n_docs, 1)
    # sparse query rows: for each term the queries that have it, and how often
    number = np.searchsorted(terms, term)
    order = np.lexsort((query, number))
    number, query, often = number[order], query[order], often[order]
    query_at = np.searchsorted(number, np.arange(len(terms) + 1))
    rows_at_once = max(64, SCORES // max(len(ids), 1))
    sent = docs.sparkSession.sparkContext.broadcast((ids, terms, idf, query, often, query_at))

    def ranked(q: np.ndarray, s: np.ndarray, d: np.ndarray, null: np.ndarray) -> np.ndarray:
        """The places of each query's best k: by score, then by doc_id, nulls last."""
        order = np.lexsort((d, null, -s, q))
        start = np.flatnonzero(np.concatenate(([True], q[order][1:] != q[order][:-1]))) if len(q) else np.zeros(0, np.int64)
        place = np.arange(len(order)) - np.repeat(start, np.diff(np.append(start, len(order))))
        return order[place < k]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, terms, idf, query_of, often, query_at = sent.value
        bar = np.ones(len(ids), dtype=np.int64)
        held = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)]  # query, score, doc_id, whether it is null
        new: list[list[np.ndarray]] = []

        def settle() -> None:
            """Only the best k so far stay, and the k-th is the bar."""
            nonlocal held, new
            q, s, d, null = (np.concatenate([held[i], *(x[i] for x in new)]) for i in range(4))
            keep = ranked(q, s, d, null)
            held, new = [q[keep], s[keep], d[keep], null[keep]], []
            n = np.bincount(held[0], minlength=len(ids))
            full = np.flatnonzero(n >= k)
            last = np.cumsum(n)[full] - 1
            bar[full] = np.maximum(bar[full], held[1][last])

        for batch in batches:
            doc = batch.column(0)
            doc_ids, nulls = doc.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64), np.asarray(doc.is_null())
            for a, b, offsets, raw in textkit.blocks(batch.column(1), lower=True):
                term, row, count, length = _postings(offsets, raw, terms)
                impact = np.floor(idf[term] * (count * (K1 + 1) / (count + K1 * (1 - B + B * length[row] / average))) * SCALE + 0.5).astype(np.int64) if len(term) else term
                for first in range(0, b - a, rows_at_once):
                    end = min(first + rows_at_once, b - a)
                    own = (row >= first) & (row < end)
                    t, r, w = term[own], row[own] - first, impact[own]
                    scores = np.zeros((len(ids), end - first), dtype=np.int64)
                    begin = np.searchsorted(t, np.arange(len(terms) + 1))
                    for x in np.unique(t):
                        q, p = slice(query_at[x], query_at[x + 1]), slice(begin[x], begin[x + 1])
                        scores[query_of[q][:, None], r[p]] += often[q][:, None] * w[p]
                    m = scores.shape[1]
                    cut = np.maximum(bar, np.partition(scores, m - k, axis=1)[:, m - k]) if m > k else bar
                    q, d = np.nonzero(scores >= cut[:, None])
                    new.append([q, scores[q, d], doc_ids[a + first + d], nulls[a + first + d]])
                    if sum(len(x[0]) for x in new) > max(2 * k * len(ids), 1 << 16):
                        settle()
        settle()
        yield pa.RecordBatch.from_arrays([pa.array(ids[held[0]]), pa.array(held[2], mask=held[3]), pa.array(held[1])], ["item_id", "doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "item_id long, doc_id long, score long")


def search(docs: DataFrame, queries: DataFrame, k: int = K) -> DataFrame:
    """(item_id, rank, doc_id, score): the k best documents for each row of ``queries(item_id, text)``.

    Rows of ``queries`` with a null ``item_id`` are left out; those with an equal one are searched as one query, their texts joined.
    """
    item, term, often = _query_terms(queries)
    all_terms = np.unique(term)
    df, n_docs, words = _statistics(docs, all_terms)
    ids = np.unique(item)
    groups = []
    for a in range(0, max(len(ids), 1), QUERY_GROUP):
        own_ids = ids[a : a + QUERY_GROUP]
        own = slice(np.searchsorted(item, own_ids[0]), np.searchsorted(item, own_ids[-1], "right")) if len(own_ids) else slice(0, 0)
        own_df = df[np.searchsorted(all_terms, np.unique(term[own]))]
        groups.append(_search_group(docs, own_ids, np.searchsorted(own_ids, item[own]), term[own], often[own], own_df, n_docs, words, k))
    found = reduce(DataFrame.unionAll, groups)
    w = W.partitionBy("item_id").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")


#: DuckDB SQL of ``search``.
ORACLE_SQL = f"""
with dw as (select rid, doc_id, unnest(regexp_extract_all(lower(coalesce(text, '')), '[0-9a-z\\x{{80}}-\\x{{10FFFF}}]+')) as w from (select *, row_number() over () as rid from documents)),
qw as (select item_id, w, count(*) as qtf from (select item_id, unnest(regexp_extract_all(lower(coalesce(text, '')), '[0-9a-z\\x{{80}}-\\x{{10FFFF}}]+')) as w from benchmark) group by all),
n as (select (select count(*) from documents) as n, (select count(*) from dw) / (select count(*) from documents) as average),
len as (select rid, count(*) as length from dw group by rid),
tf as (select rid, doc_id, w, count(*) as tf from dw where w in (select w from qw) group by all),
df as (select w, count(*) as df from tf group by w),
impact as (
  select rid, doc_id, w, floor(ln(1 + (n - df + 0.5::double) / (df + 0.5::double)) * (tf * {K1 + 1}::double / (tf + {K1}::double * ({1 - B}::double + {B}::double * length / average))) * {SCALE} + 0.5::double)::bigint as impact
  from tf join df using (w) join len using (rid), n
),
scores as (select item_id, rid, doc_id, sum(qtf * impact)::bigint as score from qw join impact using (w) group by all)
select item_id, rank::int as rank, doc_id, score from (select *, row_number() over (partition by item_id order by score desc, doc_id) as rank from scores) where rank <= {K} and score > 0
"""
