"""Views over the base tables that have the shape of the engine's inputs, as SQL for Spark and for DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

_WORDS = {
    "spark": {"S": "string", "K": "cast(get_json_object(props,'$.k') as double)", "DT": "date_format(o_orderdate,'yyyy-MM-dd')", "FL": "array_join(transform(sequence(1,60),x->cast(x as string)),' ')"},
    "duckdb": {"S": "varchar", "K": "cast(json_extract_string(props,'$.k') as double)", "DT": "strftime(o_orderdate,'%Y-%m-%d')", "FL": "array_to_string(range(1,61),' ')"},
}

#: Rounds with scores: ties at zero, one intent that disagrees with its reference.
_ROUNDS = """
e as (select *, value/(value+30) v, {K} k from events),
rounds as (select concat('r',cast(event_id as {S})) id, cast(day(ts) as bigint) epoch_id, event_type intent_id,
    concat('m',cast(user_id % 12 as {S})) miner_slug,
    case when event_id % 5 < 2 then cast(0 as double) else round(v,4) end score,
    round(case when event_type='error' then k/100
               when event_id % 5 < 2 then 0.25*v+0.15*k/100
               else 0.30+0.55*v+0.10*k/100 end,4) canonical,
    case when event_id % 9 = 0 then ' ' else concat('answer ',cast(event_id as {S})) end miner_answer, event_id pos from e),
sc as (select *, case when pos % 7 = 0 then greatest(canonical-0.12,0) else canonical end cand from rounds)"""

#: Texts whose correction is known from how they are made.
_CLAIMS = """
base as (select o_orderkey k, o_orderkey % 10 variant, o_orderkey % 37 = 0 gt_ref, cast({DT} as {S}) d,
    cast(cast(o_totalprice as decimal(14,2)) as {S}) amt,
    cast(cast(o_totalprice*1.001 as decimal(14,2)) as {S}) amt_drift,
    cast(cast(o_totalprice*10 as decimal(14,2)) as {S}) amt_bad,
    concat('0x',substr(md5(cast(o_orderkey as {S})),1,24)) hx from orders),
claims as (select k, concat('c',cast(k as {S})) id, variant, gt_ref, amt, amt_drift, amt_bad, d, hx, concat('i',cast(variant as {S})) intent_id,
    case when gt_ref then 'I don''t have the exact total for that order.'
         else concat('Order ',cast(k as {S}),' totals $',amt,' on ',d,' ref ',hx,'.') end ground_truth,
    case variant
      when 0 then concat('The order totals $',amt,', see ',hx,'.')
      when 1 then concat('The order totals $',amt_drift,', see ',hx,'.')
      when 2 then concat('The order totals $',amt_bad,', see ',hx,'.')
      when 3 then concat('The order has shipped, see ',hx,'.')
      when 4 then 'I''m sorry, I cannot provide that.'
      when 5 then '   '
      when 6 then concat('{{"total":',amt,',"ref":"',hx,'"}}')
      when 7 then concat('The order totals $',amt,', see 0xffffffffffffffffffffffff.')
      when 8 then concat('The order totals $',amt_bad,', see 0xffffffffffffffffffffffff.')
      else concat('Findings ',{FL},' see ',hx) end miner_answer from base)"""

#: Questions, truths and answers.
_QA = """
p  as (select conv_id, turn, text q, lead(text) over(partition by conv_id order by turn) gt, role,
       lead(role) over(partition by conv_id order by turn) nr from conversations),
pr as (select * from p where role='user' and nr='assistant'),
qa as (select concat(cast(a.conv_id as {S}),'-',cast(a.turn as {S})) id,
       concat('conv',cast(a.conv_id % 8 as {S})) intent_id, a.q question, a.gt ground_truth,
       case when a.conv_id % 3 = 0 then a.gt else coalesce(b.gt,'') end miner_answer,
       a.conv_id*100+a.turn pos
       from pr a left join pr b on b.conv_id=a.conv_id+1 and b.turn=a.turn)"""

_VIEWS = {"rounds": (_ROUNDS, ["events"]), "sc": (_ROUNDS, ["events"]), "claims": (_CLAIMS, ["orders"]), "qa": (_QA, ["conversations"])}


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A view as a DataFrame."""
    sql, tables = _VIEWS[name]
    read = ", ".join(f"{t} as (select * from parquet.`{sf_dir}/{t}.parquet`)" for t in tables)
    return spark.sql(f"with {read}, {sql.format(**_WORDS['spark'])} select * from {name}")


def oracle(name: str, select: str) -> str:
    """SQL for DuckDB: the view, and a query over it that may begin with more common tables ("x as (...), ... |> select")."""
    more, _, query = select.rpartition("|>")
    sql = _VIEWS[name][0].format(**_WORDS["duckdb"])
    return f"with {sql}{', ' + more if more else ''} {query}"
