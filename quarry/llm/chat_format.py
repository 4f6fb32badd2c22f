"""Chat formatting in budgeted windows of whole turns.

A conversation's turns are ordered and their tokens summed up. The first system turn opens every window. New turns fill a window
until the next one would pass ``budget``; the next window then begins with up to ``history`` turns from before, as far as
they keep to ``history_tokens`` and leave room for its first new turn. Assistant turns are targets in the window where they are new, and
masked where they are repeated; all other turns are masked always. So each assistant turn is a target exactly once.

Defined cases. A turn costs its words (runs of characters other than blank, tab, newline and carriage return) plus ``OVERHEAD``. A turn above the
budget has a window of its own, marked ``over_budget``. Turns are ordered by (turn, role, text), nulls first, so
ties and repeated rows have a place; repeated rows stay. A null text is empty, a null role is ``unknown``. Rows with a null ``conv_id`` belong to
no conversation and are left out. A conversation of a system turn alone gives no window. Later system turns are ordinary turns. An empty table
gives an empty result. Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

BUDGET, HISTORY, HISTORY_TOKENS, OVERHEAD = 512, 2, 160, 4


def windows(turns: DataFrame, budget: int = BUDGET, history: int = HISTORY, history_tokens: int = HISTORY_TOKENS) -> DataFrame:
    """(conv_id, window, first_new, turns, history, n_tokens, n_target_tokens, mask, over_budget, text) of every window."""
    tokens = F.coalesce(F.regexp_count("text", F.lit("[^ \\t\\n\\r]+")), F.lit(0)) + OVERHEAD
    own = turns.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit("unknown")).alias("role"), F.coalesce("text", F.lit("")).alias("text"), tokens.cast("long").alias("tokens"))
    # running sums by window, in the partitioning and order that the arrays need too
    upto = W.partitionBy("conv_id").orderBy("turn", "role", "text").rowsBetween(W.unboundedPreceding, W.currentRow)
    own = own.withColumn("systems", F.count_if(F.col("role") == "system").over(upto)).withColumn("head", (F.col("role") == "system") & (F.col("systems") == 1))
    own = own.withColumn("cum", F.sum(F.when(F.col("head"), 0).otherwise(F.col("tokens"))).over(upto))
    convs = own.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text", "tokens", "cum", "head"))).alias("ts"))
    convs = convs.selectExpr("conv_id", "filter(ts, t -> t.head) as head", "filter(ts, t -> not t.head) as body").where("size(body) > 0")
    convs = convs.selectExpr("conv_id", "head", "body", "transform(body, t -> t.cum) as sums", "coalesce(get(head, 0).tokens, 0L) as base")
    # p(i) is the sum of the first i turns; a window (h, n, e) has history h..n-1 and new turns n..e, counted from 1
    p = lambda i: f"if({i} = 0, 0L, sums[{i} - 1])"
    begin = f"coalesce(array_min(filter(sequence(greatest(1, i - {history}), i), h -> {p('i - 1')} - {p('h - 1')} <= {history_tokens} and base + {p('i')} - {p('h - 1')} <= {budget})), i)"
    state = "named_struct('h', 1, 'n', 1, 'done', cast(array() as array<struct<h:int,n:int,e:int>>))"
    step = f"if(i = 1 or base + {p('i')} - {p('s.h - 1')} <= {budget}, s, named_struct('h', {begin}, 'n', i, 'done', concat(s.done, array(named_struct('h', s.h, 'n', s.n, 'e', i - 1)))))"
    convs = convs.selectExpr("*", f"aggregate(sequence(1, size(body)), {state}, (s, i) -> {step}, s -> concat(s.done, array(named_struct('h', s.h, 'n', s.n, 'e', size(body))))) as ws")
    # each window takes its own turns before the windows become rows, so no row carries the whole conversation
    shown = "concat(transform(head, t -> struct(t as t, false as target)), transform(slice(body, w.h, w.e - w.h + 1), (t, j) -> struct(t as t, t.role = 'assistant' and w.h + j >= w.n as target)))"
    made = convs.selectExpr("conv_id", f"transform(ws, (w, k) -> named_struct('window', k + 1, 'first_new', body[w.n - 1].turn, 'n_tokens', base + {p('w.e')} - {p('w.h - 1')}, 'history', w.n - w.h, 'shown', {shown})) as made")
    each = made.select("conv_id", F.explode_outer("made").alias("m")).select("conv_id", "m.*")
    return each.selectExpr(
        "conv_id", "window", "first_new", "size(shown) as turns", "history", "n_tokens", "aggregate(shown, 0L, (a, x) -> a + if(x.target, x.t.tokens, 0L)) as n_target_tokens", "array_join(transform(shown, x -> if(x.target, '1', '0')), '') as mask",
        f"n_tokens > {budget} as over_budget", "array_join(transform(shown, x -> concat('<|im_start|>', x.t.role, '\n', x.t.text, '<|im_end|>\n')), '') as text",
    )


#: DuckDB SQL of ``windows``: the window that would begin at each turn, then the chain of those that do.
ORACLE_SQL = f"""
with recursive t as (
  select conv_id, turn, coalesce(role, 'unknown') as role, coalesce(text, '') as text, len(regexp_extract_all(coalesce(text, ''), '[^ \\t\\n\\r]+')) + {OVERHEAD} as tokens,
    row_number() over (partition by conv_id order by turn, role, text) as pos from conversations where conv_id is not null
), sys as (select conv_id, min(pos) as pos from t where role = 'system' group by conv_id),
head as (select t.* from t join sys on t.conv_id = sys.conv_id and t.pos = sys.pos),
body as (
  select t.conv_id, t.turn, t.role, t.text, t.tokens, row_number() over w as i, sum(t.tokens) over w as p, coalesce(h.tokens, 0) as base
  from t left join head h on h.conv_id = t.conv_id where h.pos is null or h.pos <> t.pos window w as (partition by t.conv_id order by t.pos)
), h as (
  select n.conv_id, n.i as n, coalesce(min(b.i) filter (b.i >= n.i - {HISTORY} and n.p - n.tokens - (b.p - b.tokens) <= {HISTORY_TOKENS} and n.base + n.p - (b.p - b.tokens) <= {BUDGET}), n.i) as h
  from body n join body b on b.conv_id = n.conv_id and b.i <= n.i group by n.conv_id, n.i
), he as (select h.*, b.p - b.tokens as before, case when n = 1 then 1 else h end as h1 from h join body b on b.conv_id = h.conv_id and b.i = h.h),
w as (
  select he.conv_id, he.n, he.h, greatest(he.n, max(b.i) filter (b.base + b.p - he.before <= {BUDGET})) as e
  from he join body b on b.conv_id = he.conv_id and b.i >= he.n group by he.conv_id, he.n, he.h
), w1 as (select conv_id, n, h, coalesce(e, n) as e from w),
chain as (
  select conv_id, n, h, e, 1 as k from w1 where n = 1
  union all select w1.conv_id, w1.n, w1.h, w1.e, chain.k + 1 from chain join w1 on w1.conv_id = chain.conv_id and w1.n = chain.e + 1
), shown as (
  select c.conv_id, c.k, c.n, c.n - c.h as history, b.i, b.turn, b.role, b.text, b.tokens, b.role = 'assistant' and b.i >= c.n as target from chain c join body b on b.conv_id = c.conv_id and b.i between c.h and c.e
  union all select c.conv_id, c.k, c.n, c.n - c.h, 0, h.turn, h.role, h.text, h.tokens, false from chain c join head h on h.conv_id = c.conv_id
)
select conv_id, k::int as "window", max(turn) filter (i = n) as first_new, count(*)::int as turns, max(history)::int as history, sum(tokens)::bigint as n_tokens, sum(case when target then tokens else 0 end)::bigint as n_target_tokens,
  string_agg(case when target then '1' else '0' end, '' order by i) as mask, sum(tokens) > {BUDGET} as over_budget, string_agg('<|im_start|>' || role || chr(10) || text || '<|im_end|>' || chr(10), '' order by i) as text
from shown group by conv_id, k
"""
