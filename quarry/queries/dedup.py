"""Chunks, dedup statistics and lookups over documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quarry.functions.payload import n_chunks
from quarry.operators import bloom, dedup
from quarry.policies import codec_name, presets
from quarry.queries.base import CHUNK, CHUNKS_SQL, document_chunks, table

QUERIES, ORACLES = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


_STATS = "count(*)::bigint as total_chunks, count(distinct content_hash)::bigint as unique_chunks, sum(len)::bigint as total_bytes"


def _stats_sql(by: str) -> str:
    group = f"{by}, " if by else ""
    return f"""with {CHUNKS_SQL}, each as (select {group}content_hash, count(*) as refs, any_value(len) as len from chunks group by all)
select {group}sum(refs)::bigint as total_chunks, count(*)::bigint as unique_chunks, sum(refs * len)::bigint as total_bytes, sum((refs - 1) * len)::bigint as bytes_saved, round(sum(refs) / count(*), 6) as dedup_ratio from each {"group by all" if by else ""}"""


#: Half of the documents count as committed, the other half as a new batch.
HALVES_SQL = f"""with {CHUNKS_SQL}, half as (select min(doc_id) + (max(doc_id) - min(doc_id) + 1) // 2 as cut from documents),
store as (select distinct content_hash from chunks, half where doc_id < cut), batch as (select chunks.* from chunks, half where doc_id >= cut)
"""


def _halves(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    ids = table(spark, sf_dir, "documents").agg(F.expr("min(doc_id) + (max(doc_id) - min(doc_id) + 1) div 2").alias("cut"))
    marked = document_chunks(spark, sf_dir).join(F.broadcast(ids))  # one row
    return marked.where("doc_id < cut").select("content_hash").distinct(), marked.where("doc_id >= cut").drop("cut")


@query(f"with {CHUNKS_SQL} select doc_id, pos::int as pos, len::int as len, content_hash from chunks")
def chunk_documents(spark, sf_dir):
    return document_chunks(spark, sf_dir).select("doc_id", "pos", "len", "content_hash")


@query(f"select doc_id, octet_length(encode(text))::bigint as size, ((octet_length(encode(text)) + {CHUNK - 1}) // {CHUNK})::int as segments from documents")
def chunk_counts_per_capsule(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.octet_length(F.encode("text", "UTF-8")).cast("bigint").alias("size"), n_chunks(F.encode("text", "UTF-8"), CHUNK).alias("segments"))


@query(_stats_sql(""))
def dedup_stats_global(spark, sf_dir):
    return dedup.stats(document_chunks(spark, sf_dir))


@query(_stats_sql("source"))
def dedup_by_source(spark, sf_dir):
    return dedup.stats(document_chunks(spark, sf_dir, "source"), "source")


@query(_stats_sql("lang"))
def dedup_by_lang(spark, sf_dir):
    return dedup.stats(document_chunks(spark, sf_dir, "lang"), "lang")


@query(f"with {CHUNKS_SQL}, s as (select count(*) as n, sum(len) - (select sum(len) from (select any_value(len) as len from chunks group by content_hash)) as saved from chunks) select n::bigint as total_segments, saved::bigint as bytes_saved, round(case when saved > 0 then n * {CHUNK}::double / (n * {CHUNK}::double - saved) else 0.0 end, 6) as ratio from s")
def dedup_saved_ratio(spark, sf_dir):
    s = dedup.stats(document_chunks(spark, sf_dir))
    return s.select(F.col("total_chunks").alias("total_segments"), "bytes_saved", F.round(dedup.saved_ratio(F.col("total_chunks"), F.col("bytes_saved"), CHUNK), 6).alias("ratio"))


@query(f"with {CHUNKS_SQL} select doc_id, pos::int as pos, content_hash, row_number() over (partition by content_hash order by doc_id, pos) = 1 as is_first from chunks")
def dedup_first_writer(spark, sf_dir):
    return dedup.first_writer(document_chunks(spark, sf_dir).drop("chunk"), ["doc_id", "pos"]).select("doc_id", "pos", "content_hash", "is_first")


@query(HALVES_SQL + "select doc_id, pos::int as pos, case when content_hash in (select content_hash from store) then 'persistent' when row_number() over (partition by content_hash order by doc_id, pos) = 1 then 'new' else 'staged' end as disposition from batch")
def dedup_disposition(spark, sf_dir):
    store, batch = _halves(spark, sf_dir)
    return dedup.disposition(batch.drop("chunk"), store, ["doc_id", "pos"]).select("doc_id", "pos", "disposition")


@query(HALVES_SQL + "select disposition, count(*)::bigint as chunks, sum(len)::bigint as bytes from (select len, case when content_hash in (select content_hash from store) then 'persistent' when row_number() over (partition by content_hash order by doc_id, pos) = 1 then 'new' else 'staged' end as disposition from batch) group by all")
def disposition_counts(spark, sf_dir):
    store, batch = _halves(spark, sf_dir)
    return dedup.disposition(batch.drop("chunk"), store, ["doc_id", "pos"]).groupBy("disposition").agg(F.count(F.lit(1)).alias("chunks"), F.sum("len").alias("bytes"))


@query(HALVES_SQL + "select doc_id, pos::int as pos, content_hash from batch where content_hash in (select content_hash from store)")
def content_lookup_hits(spark, sf_dir):
    store, batch = _halves(spark, sf_dir)
    return dedup.lookup_hits(batch.select("doc_id", "pos", "content_hash"), store)


@query(HALVES_SQL + "select doc_id, pos::int as pos, content_hash from batch where content_hash not in (select content_hash from store)")
def content_lookup_misses(spark, sf_dir):
    store, batch = _halves(spark, sf_dir)
    return dedup.lookup_misses(batch.select("doc_id", "pos", "content_hash"), store)


@query(HALVES_SQL + "select doc_id, pos::int as pos, content_hash from batch where content_hash in (select content_hash from store)")
def bloom_prefilter(spark, sf_dir):
    """The hits again: a filter first drops what surely isn't stored, the join decides about the rest."""
    store, batch = _halves(spark, sf_dir)
    cells, hashes = bloom.size_of(store.count(), 0.001)
    maybe = bloom.might_contain(batch.select("doc_id", "pos", "content_hash"), "content_hash", bloom.build(store, "content_hash", cells, hashes), cells, hashes)
    return dedup.lookup_hits(maybe, store)


@query(f"with {CHUNKS_SQL} select count(*)::bigint as segments, sum(len)::bigint as stored_bytes, 0::bigint as content_entries from chunks")
def dedup_off_stats(spark, sf_dir):
    """Without deduplication every chunk is a segment and the content store stays empty."""
    return document_chunks(spark, sf_dir).agg(F.count(F.lit(1)).alias("segments"), F.sum("len").alias("stored_bytes"), F.lit(0).cast("bigint").alias("content_entries"))


@query(f"""with {CHUNKS_SQL}, p(policy, algo) as (values ('default', 'lz4:1'), ('text_optimized', 'zstd:3'), ('precompressed', 'identity'), ('edge_optimized', 'lz4:1'), ('encrypted', 'lz4:1'), ('encrypted_compressed', 'zstd:3'), ('metro_sync', 'lz4:1'), ('geo_replicated', 'zstd:3')),
names as (select list(policy order by policy) as all_ from p), c as (select chunks.*, list_extract(all_, (doc_id % 8 + 1)::int) as policy from chunks, names)
select algo, count(*)::bigint as chunks, count(distinct content_hash)::bigint as unique_chunks from c join p using (policy) group by algo""")
def dedup_by_policy_class(spark, sf_dir):
    """Equal bytes deduplicate only under the same codec: the key is (codec, hash)."""
    p = presets(spark).select("policy", codec_name(F.col("comp_algo"), F.col("comp_level")).alias("algo"), (F.row_number().over(W.orderBy("policy")) - 1).alias("k"))
    each = document_chunks(spark, sf_dir).withColumn("k", F.col("doc_id") % 8).join(F.broadcast(p), "k").groupBy("algo", "content_hash").agg(F.count(F.lit(1)).alias("n"))
    return each.groupBy("algo").agg(F.sum("n").alias("chunks"), F.count(F.lit(1)).alias("unique_chunks"))


@query(f"""with {CHUNKS_SQL}, f as (select content_hash, doc_id, pos, len from (select *, row_number() over (partition by content_hash order by doc_id, pos) as r from chunks) where r = 1)
select content_hash, row_number() over (order by doc_id, pos) - 1 as segment_id, len::int as len, coalesce(sum(len) over (order by doc_id, pos rows between unbounded preceding and 1 preceding), 0)::bigint as "offset" from f""")
def segment_ids_and_offsets(spark, sf_dir):
    first = document_chunks(spark, sf_dir).groupBy("content_hash").agg(F.min(F.struct("doc_id", "pos")).alias("at"), F.first("len").alias("len")).select("content_hash", "at.*", "len")
    return dedup.running_offset(dedup.dense_ids(first, ["doc_id", "pos"])).select("content_hash", "segment_id", "len", "offset")


@query(f"with {CHUNKS_SQL} select content_hash, count(distinct chunk)::bigint as variants from chunks group by content_hash having count(distinct chunk) > 1")
def hash_collisions(spark, sf_dir):
    return dedup.collisions(document_chunks(spark, sf_dir))


@query("""with n(items, rate) as (values (1000, 0.001), (10000000, 0.001), (0, 0.5), (100, 0.0), (1, 0.25), (50000, 0.01)), c as (select items, rate, greatest(items, 1)::double as n, least(greatest(rate, 1e-7), 0.25)::double as p from n),
m as (select *, greatest(ceil(-n * ln(p) / pow(ln(2), 2)), 1024)::bigint as cells from c) select items::bigint as items, rate::double as rate, cells, greatest(ceil(cells / n * ln(2)), 1)::int as hashes from m""")
def bloom_sizing(spark, sf_dir):
    rows = spark.createDataFrame([(1000, 0.001), (10_000_000, 0.001), (0, 0.5), (100, 0.0), (1, 0.25), (50_000, 0.01)], "items bigint, rate double")
    cells, hashes = bloom.sizing(F.col("items"), F.col("rate"))
    return rows.select("items", "rate", cells.alias("cells"), hashes.alias("hashes"))
