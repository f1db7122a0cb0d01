"""The queries over the reference's operators, and the same in SQL for DuckDB."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from answergauge.functions import embed, scan, text, vectors
from answergauge.operators import correct, gates, group, rank, reports, score, stats
from answergauge.sources import corpus

from .fixtures import oracle, view

FOUND: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {}


def _query(sql: str | None = None):
    def keep(f):
        FOUND[f.__name__] = (f, sql)
        return f

    return keep


def r6(c: Column | str) -> Column:
    return F.round(F.col(c) if isinstance(c, str) else c, 6)


def _scored(spark: SparkSession, d: str) -> DataFrame:
    return view(spark, d, "sc").withColumn("candidate", F.col("cand")).withColumn("reference", F.col("canonical"))


# Ranks of ties and their correlation, in SQL: {g} is the group's key.
_RHO = """rk as (select intent_id, {g} as epoch, cand, canonical,
    rank() over (partition by intent_id, {g} order by cand) + (count(*) over (partition by intent_id, {g}, cand) - 1) / 2.0 as rc,
    rank() over (partition by intent_id, {g} order by canonical) + (count(*) over (partition by intent_id, {g}, canonical) - 1) / 2.0 as rr from sc),
g0 as (select intent_id, epoch, count(*) as n, corr(rc, rr) as rho0, min(cand) = max(cand) as cc, min(canonical) = max(canonical) as rc0 from rk group by all),
g as (select intent_id, epoch, n, case when n >= 2 and not cc and not rc0 then round(rho0, 6) end as rho, cc, rc0 from g0 where n >= 4),
gs as (select *, case when rho is null then 'UNDEFINED' when rho >= 0.60 then 'PASS' else 'FAIL' end as status from g)"""
_POOLED, _EPOCHS = _RHO.format(g="-1::bigint"), _RHO.format(g="epoch_id")
_RHO_OUT = "|> select intent_id, epoch, n, rho, status from gs"


@_query(oracle("sc", _POOLED + _RHO_OUT))
def rank_agreement_pooled(spark, d):
    return gates.gate3_groups(_scored(spark, d), True).select("intent_id", "epoch", "n", r6("rho").alias("rho"), "status")


@_query(oracle("sc", _EPOCHS + _RHO_OUT))
def rank_agreement_by_epoch(spark, d):
    return gates.gate3_groups(_scored(spark, d), False).select("intent_id", "epoch", "n", r6("rho").alias("rho"), "status")


@_query(oracle("sc", """|> select intent_id, id, rank() over (partition by intent_id order by score) + (count(*) over (partition by intent_id, score) - 1) / 2.0 as score_rank from sc"""))
def fractional_ranks(spark, d):
    return stats.fractional_ranks(view(spark, d, "sc").select("intent_id", "id", "score"), ["intent_id"], ["score"]).select("intent_id", "id", "score_rank")


@_query(oracle("sc", """|> select count(cand) as n, round(stddev_pop(cand), 6) as spread, min(cand) as low, max(cand) as high,
    case when count(cand) < 2 then 'UNDEFINED' when stddev_pop(cand) > 0.05 then 'PASS' else 'FAIL' end as status from sc"""))  # fmt: skip
def dispersion_gate(spark, d):
    return gates.gate2(view(spark, d, "sc"), "cand").select("n", r6("spread").alias("spread"), "low", "high", "status")


_SUMMARY = """|> select count(*) as groups, count(rho) as defined, count(*) filter (where status = 'FAIL') as failing, count(*) filter (where rho is null) as undefined,
    round(avg(rho), 6) as mean_rho, min(rho) as min_rho, (select intent_id || '@' || epoch from gs where rho is not null order by rho, intent_id, epoch limit 1) as min_intent,
    round(min(rho) - 0.60, 6) as headroom, case when count(*) filter (where status = 'FAIL') > 0 then 'FAIL' when count(rho) = 0 then 'UNDEFINED' else 'PASS' end as status from gs"""


@_query(oracle("sc", _EPOCHS + _SUMMARY))
def gate3_summary(spark, d):
    found = gates.gate3(gates.gate3_groups(_scored(spark, d), False).withColumn("rho", r6("rho")))
    return found.select("groups", "defined", "failing", "undefined", r6("mean_rho").alias("mean_rho"), "min_rho", "min_intent", r6("headroom").alias("headroom"), "status")


_REASON = "string_agg(format('{}:{:.8g}', intent_id, rho), ' ' order by case when status = 'FAIL' then 0 else 1 end, rho, intent_id)"


@_query(oracle("sc", _POOLED + f"|> select {_REASON} as reason from gs where rho is not null"))
def rejection_reason(spark, d):
    return gates.gate3_reason(gates.gate3_groups(_scored(spark, d), True).withColumn("rho", r6("rho")))


@_query(oracle("rounds", r"""|> select count(*) as "rows", count(distinct intent_id) as intents, array_to_string(list_sort(list(distinct epoch_id)), ',') as epochs,
    count(*) filter (where trim(miner_answer) = '') as blank_answers, count(*) filter (where score = 0) as zero_scores from rounds"""))  # fmt: skip
def corpus_summary(spark, d):
    return group.summarise(view(spark, d, "rounds")).withColumn("epochs", F.array_join(F.transform("epochs", lambda x: x.cast("string")), ","))


@_query(oracle("rounds", """|> select intent_id, count(*) as "rows", count(distinct epoch_id) as epochs, count(*) filter (where score > 0) as nonzero from rounds group by 1 having count(*) >= 4"""))
def corpus_by_intent(spark, d):
    return group.by_intent(view(spark, d, "rounds"))


@_query(oracle("rounds", """|> select distinct intent_id from rounds"""))
def intents(spark, d):
    return group.intents(view(spark, d, "rounds"))


@_query(oracle("rounds", """|> select intent_id, epoch_id as epoch, count(*) as n from rounds group by 1, 2 having count(*) >= 4 union all select intent_id, -1, count(*) from rounds group by 1 having count(*) >= 4"""))
def groups_both_grains(spark, d):
    return group.both_grains(view(spark, d, "rounds"), 4)


@_query(oracle("rounds", """|> select intent_id, epoch_id as epoch, count(*) as n from rounds group by 1, 2 having count(*) >= 4 and min(score) <> max(score)"""))
def rankable_groups(spark, d):
    return group.rankable(view(spark, d, "rounds"))


@_query(oracle("rounds", """ok as (select intent_id, epoch_id from rounds where epoch_id >= 3 group by 1, 2 having count(*) >= 4 and min(score) <> max(score)),
    newest as (select * from ok qualify row_number() over (partition by intent_id order by epoch_id desc) <= 12)
    |> select id, intent_id, epoch_id, miner_slug from rounds semi join newest using (intent_id, epoch_id)"""))  # fmt: skip
def subset_newest(spark, d):
    return group.subset(view(spark, d, "rounds"), since=3).select("id", "intent_id", "epoch_id", "miner_slug")


@_query(oracle("sc", _RHO.format(g="band").replace("from sc)", "from (select *, case when epoch_id <= 10 then 0 when epoch_id <= 20 then 1 else 2 end::bigint as band from sc) sc)") + "|> select intent_id, epoch as band, n, rho from gs"))
def epoch_band_trend(spark, d):
    band = F.when(F.col("epoch_id") <= 10, 0).when(F.col("epoch_id") <= 20, 1).otherwise(2).cast("long")
    found = gates.gate3_groups(_scored(spark, d).withColumn("epoch_id", band), False)
    return found.select("intent_id", F.col("epoch").alias("band"), "n", r6("rho").alias("rho"))


def _eligible(spark, d):
    rows = view(spark, d, "sc")
    return gates.eligible(rows.select("id", "intent_id", "miner_slug"), rows.select("id", F.col("canonical").alias("score")), rows.select("id", F.col("cand").alias("score")))


_CATCH = """el as (select id, intent_id, canonical, cand as candidate from sc where canonical > 0.70),
    ca as (select *, canonical - candidate as delta from el where canonical - candidate >= 0.10)"""


@_query(oracle("sc", _CATCH + "|> select id, intent_id, canonical, candidate, round(delta, 6) as delta from ca"))
def catch_table(spark, d):
    return gates.catches(_eligible(spark, d)).select("id", "intent_id", "canonical", "candidate", r6("delta").alias("delta"))


@_query(oracle("sc", _CATCH + "|> select intent_id, count(*) as catches from ca group by 1"))
def catch_by_intent(spark, d):
    return gates.catches_by_intent(_eligible(spark, d))


@_query(oracle("sc", _CATCH + "|> select (select count(*) from el) as eligible, (select count(*) from ca) as catches, round((select count(*) from ca) / (select count(*) from el), 6) as rate"))
def catch_rate(spark, d):
    return gates.catch_rate(_eligible(spark, d)).withColumn("rate", r6("rate"))


def _two(spark, d):
    rows = view(spark, d, "sc")
    return rows.select("id", F.col("canonical").alias("score")), rows.select("id", F.col("cand").alias("score"))


_DIFF = "df as (select id, canonical as a, cand as b, cand - canonical as d from sc)"


@_query(oracle("sc", _DIFF + """|> select count(*) as "rows", count(*) filter (where d = 0) as identical, count(*) filter (where d <> 0) as changed, round(max(abs(d)), 6) as max_abs, round(avg(abs(d)) filter (where d <> 0), 6) as mean_changed from df"""))
def compare_scores(spark, d):
    return reports.compare(reports.differences(*_two(spark, d))).withColumns({"max_abs": r6("max_abs"), "mean_changed": r6("mean_changed")})


@_query(oracle("sc", _DIFF + """|> select id, a, b, round(d, 6) as d from df where d <> 0 order by abs(d) desc, id limit 20"""))
def compare_topk(spark, d):
    return reports.top_changes(reports.differences(*_two(spark, d))).withColumn("d", r6("d"))


@_query(oracle("sc", _DIFF + """|> select id, a::float::double as a, b::float::double as b from df where a::float <> b::float"""))
def verify_bits(spark, d):
    return reports.verify_bits(*_two(spark, d)).withColumns({"a": F.col("a").cast("double"), "b": F.col("b").cast("double")})


@_query(oracle("sc", _DIFF + """|> select count(*) as "rows", count(*) filter (where d > 1e-6) as raised, count(*) filter (where -d > 0.12 + 1e-6) as beyond from df"""))
def verify_bounds(spark, d):
    return reports.verify_bounds(*_two(spark, d))


@_query(oracle("rounds", """two as (select case when pos % 10 = 0 then '' else 'x' || (pos // 3) end as id, pos, score from rounds)
    |> select id, pos, score from two where id = '' union all (select id, pos, score from two where id <> '' qualify row_number() over (partition by id order by pos) = 1)"""))  # fmt: skip
def dedup_first_by_id(spark, d):
    rows = view(spark, d, "rounds").select(F.when(F.col("pos") % 10 == 0, "").otherwise(F.concat(F.lit("x"), F.floor(F.col("pos") / 3).cast("string"))).alias("id"), "pos", "score")
    return corpus.dedup_first(rows)


@_query(oracle("rounds", """|> select id, pos from rounds where score = 0"""))
def cache_anti_join(spark, d):
    """Rounds that have no score yet, published ones (above 0) being known."""
    rows = view(spark, d, "rounds")
    known = rows.where("score > 0").select("id", "score")
    return rows.select("id", "pos").join(corpus.latest(known).select("id"), "id", "left_anti")


@_query(oracle("sc", """|> select id, cand as candidate, canonical as reference from sc where canonical > 0"""))
def joined_scores(spark, d):
    """Rounds with the scores of two scorers, the reference lacking those that it gave 0; each id is there twice, its last score counts."""
    rows = view(spark, d, "sc")
    again = rows.select("id", F.lit(0.99).alias("score"), F.lit(0).alias("seq")).unionByName(rows.select("id", F.col("cand").alias("score"), F.lit(1).alias("seq")))
    return gates.join_scores(rows.select("id"), again, rows.where("canonical > 0").select("id", F.col("canonical").alias("score")))


_TOKENS = "list_filter(list_transform(regexp_extract_all({c}, '[\\p{{L}}\\p{{N}}]+'), lambda x: translate(x, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')), lambda x: strlen(x) >= 2)"
_BM25 = """case when len({q}) > 0 and len({d}) > 0 then least(1.0, greatest(0.0, coalesce(list_sum(list_transform({q}, lambda term_:
    len(list_filter({d}, lambda word_: word_ = term_)) * 2.5 / (len(list_filter({d}, lambda word_: word_ = term_)) + 1.5 * (0.25 + 0.75 * len({d}) / ((len({q}) + len({d})) / 2.0))))), 0) / (2.5 * len({q})))) else 0.0 end"""


def _bm25(q: str, d: str) -> str:
    return _BM25.format(q=q, d=d)


_QT = "tk as (select *, " + ", ".join(f"{_TOKENS.format(c=c)} as {n}" for c, n in (("question", "q"), ("ground_truth", "t"), ("miner_answer", "a"))) + " from qa)"


@_query(f"select doc_id, len(k)::bigint as n_tokens, len(list_distinct(k))::bigint as n_distinct, md5(array_to_string(k, ' ')) as digest from (select doc_id, {_TOKENS.format(c='text')} as k from documents)")
def bm25_tokens(spark, d):
    rows = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", text.tokens(F.col("text")).alias("k"))
    return rows.select("doc_id", F.size("k").cast("long").alias("n_tokens"), F.size(F.array_distinct("k")).cast("long").alias("n_distinct"), F.md5(F.array_join("k", " ").cast("binary")).alias("digest"))


@_query(oracle("qa", _QT + f"|> select id, round({_bm25('q', 'a')}, 6) as question_answer, round({_bm25('t', 'a')}, 6) as truth_answer from tk"))
def bm25_score(spark, d):
    rows = view(spark, d, "qa").withColumns({"q": text.tokens(F.col("question")), "t": text.tokens(F.col("ground_truth")), "a": text.tokens(F.col("miner_answer"))})
    return rows.select("id", r6(score.bm25_of_tokens(F.col("q"), F.col("a"))).alias("question_answer"), r6(score.bm25_of_tokens(F.col("t"), F.col("a"))).alias("truth_answer"))


@_query("select doc_id, strlen(text)::bigint as bytes, round(1 / (1 + exp(-(strlen(text) - 50) / 20.0)), 6) as length_quality from documents")
def length_quality(spark, d):
    rows = spark.read.parquet(f"{d}/documents.parquet")
    return rows.select("doc_id", text.byte_length(F.col("text")).cast("long").alias("bytes"), r6(score.length_quality(F.col("text"))).alias("length_quality"))


_COMPOSITE = "least(1.0, greatest(0.0, 0.25 * {qa} + 0.50 * {ta} + 0.15 * {ta} + 0.10 * (1 / (1 + exp(-(strlen({c}) - 50) / 20.0)))))"


@_query(oracle("qa", _QT + ", sx as (select *, " + _bm25("q", "a") + " as qa, " + _bm25("t", "a") + " as ta from tk)|> select id, case when trim(miner_answer) = '' then 0.0 else round(" + _COMPOSITE.format(qa="qa", ta="ta", c="miner_answer") + ", 6) end as score from sx"))
def composite_score(spark, d):
    return score.LEXICAL_SCORER.apply(view(spark, d, "qa")).select("id", r6("score").alias("score"))


_PAIRS = """us as (select * from qa where strlen(ground_truth) >= 32 and strlen(question) >= 8 qualify row_number() over (partition by intent_id order by pos) = 1),
    pa as (select *, coalesce(lead(ground_truth) over (order by intent_id), first_value(ground_truth) over (order by intent_id)) as cross_truth,
           coalesce(lead(intent_id) over (order by intent_id), first_value(intent_id) over (order by intent_id)) as cross_intent, count(*) over () as n from us)"""


@_query(oracle("qa", _PAIRS + "|> select intent_id, id, question, ground_truth, cross_truth, cross_intent from pa where n >= 2"))
def structural_pairs(spark, d):
    return gates.structural_pairs(view(spark, d, "qa")).select("intent_id", "id", "question", "ground_truth", "cross_truth", "cross_intent")


_PAIR_SCORES = (
    _PAIRS + ", pt as (select *, " + ", ".join(f"{_TOKENS.format(c=c)} as {n}" for c, n in (("question", "q"), ("ground_truth", "t"), ("cross_truth", "x"))) + " from pa where n >= 2), ps as (select intent_id, "
    + f"{_COMPOSITE.format(qa=_bm25('q', 't'), ta=_bm25('t', 't'), c='ground_truth')} as self_score, {_COMPOSITE.format(qa=_bm25('q', 'x'), ta=_bm25('t', 'x'), c='cross_truth')} as cross_score from pt)"
)


@_query(oracle("qa", _PAIR_SCORES + """|> select count(*) as pairs, round(avg(self_score), 6) as mean_self, round(avg(cross_score), 6) as mean_cross, count(*) filter (where self_score > cross_score) as passed,
    round(count(*) filter (where self_score > cross_score) / count(*), 6) as share, case when avg(self_score) > avg(cross_score) and count(*) filter (where self_score > cross_score) / count(*) >= 0.60 then 'PASS' else 'FAIL' end as status from ps"""))  # fmt: skip
def structural_gate(spark, d):
    found = gates.gate1(gates.score_pairs(gates.structural_pairs(view(spark, d, "qa")), score.LEXICAL_SCORER.score))
    return found.withColumns({c: r6(c) for c in ("mean_self", "mean_cross", "share")})


_REFUSED = " or ".join(f"contains(h, '{m.replace(chr(39), chr(39) * 2)}')" for m in text.REFUSALS)


@_query(oracle("claims", f"hd as (select id, lower(substr(ground_truth, 1, 240)) as g, lower(substr(miner_answer, 1, 240)) as m from claims)|> select id, (select {_REFUSED} from (select g as h)) as truth_refuses, (select {_REFUSED} from (select m as h)) as answer_refuses from hd"))
def refusal_flags(spark, d):
    return view(spark, d, "claims").select("id", text.is_refusal(F.col("ground_truth")).alias("truth_refuses"), text.is_refusal(F.col("miner_answer")).alias("answer_refuses"))


_FORMS = r"""
forms as (select o_orderkey as k, o_orderkey % 12 as form, cast(o_custkey as {S}) as a, cast(o_orderkey % 97 as {S}) as b from orders),
said as (select k, case form when 0 then concat('up to $', a, '.', b, ' million') when 1 then concat('~', a, 'e', cast(k % 4 as {S})) when 2 then concat('in ', a, ',', b, '0') when 3 then concat('loss of -', a, '.', b, '%')
    when 4 then concat(b, 'bn') when 5 then concat('$ ', a, 'k') when 6 then concat('x', a, '.', b, 'E-2 t') when 7 then concat('-', a, ' thousand') when 8 then concat('no', a, ' mm') when 9 then concat(a, '_', b, ' units') when 10 then concat('year ', a, 'e+1%')
    else 'none' end as t from forms)"""
# The first number of a text, read by a pattern: digits with separators, a fraction, a power of ten, a percent sign or a word for a scale.
_FIRST = r"""([0-9](?:[0-9]|[,_][0-9])*)(?:[.]([0-9]+))?(?:[eE]([+-]?[0-9]{1,4}))?(?:(%)| ?([a-zA-Z]+))?"""


@_query(f"""with {_FORMS.format(S='varchar')}, m as (select k, t, regexp_extract(t, '{_FIRST}', ['whole', 'part', 'power', 'pct', 'scale']) as r, regexp_extract(t, '^(.*?)[0-9]', 1) as head, regexp_matches(t, '[0-9]') as has from said),
    v as (select k, head, has, r.pct = '%' as percent, lower(r.scale) as s, case when has then try_cast(regexp_replace(r.whole, '[,_]', '', 'g') || case when r.part <> '' then '.' || r.part else '' end as double) * pow(10, coalesce(try_cast(r.power as int), 0)) end as v from m)
    select k, case when has then format('{{:.8g}}', v * case when s in ('k', 'thousand') then 1e3 when s in ('m', 'mm', 'mn', 'million') then 1e6 when s in ('b', 'bn', 'billion') then 1e9 when s in ('t', 'tn', 'trillion') then 1e12 else 1 end
        * case when regexp_matches(head, '(^|[^a-zA-Z])-$') then -1 else 1 end) end as value, has and percent as percent, has and regexp_matches(head, '[$] *-?$') as currency from v""")
def number_forms(spark, d):
    """Numbers with separators, fractions, powers of ten, percent signs, words for scales and signs."""
    orders = spark.read.parquet(f"{d}/orders.parquet")
    rows = spark.sql(f"with {_FORMS.format(S='string')} select * from said".replace("from orders)", "from {orders})"), orders=orders)
    first = F.get(scan.scan_numbers("t"), F.lit(0))
    return rows.select("k", first.alias("n")).select("k", F.when(F.col("n").isNotNull(), text.general(F.col("n.value"))).alias("value"), F.coalesce("n.percent", F.lit(False)).alias("percent"), F.coalesce("n.currency", F.lit(False)).alias("currency"))


_WHITE_SPACE = r"\x{9}-\x{D}\x{20}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
_BLANKS = """blanks as (select o_orderkey as k, case o_orderkey % 7 when 0 then '' when 1 then concat(' ', chr(9), chr(10)) when 2 then concat(' ', chr(160)) when 3 then chr(12288) when 4 then concat(chr(8203), ' ')
    when 5 then concat(chr(11), chr(12), chr(13)) else concat(' x', chr(160)) end as t from orders)"""


@_query(f"with {_BLANKS} select k, regexp_full_match(t, '[ \\t\\n\\r\\v\\f]*') as blank, regexp_full_match(t, '[{_WHITE_SPACE}]*') as blank_unicode from blanks")
def blank_forms(spark, d):
    """White space of ASCII and of other scripts."""
    rows = spark.sql(f"with {_BLANKS} select * from blanks".replace("from orders)", "from {orders})").replace("chr(8203)", "'\u200b'").replace("chr(12288)", "'\u3000'"), orders=spark.read.parquet(f"{d}/orders.parquet"))
    return rows.select("k", text.is_blank(F.col("t")).alias("blank"), text.is_blank_unicode(F.col("t")).alias("blank_unicode"))


# Characters of two and three bytes before a refusal, so that it ends about the last byte that is looked at.
_HEADS = "heads as (select o_orderkey as k, concat(repeat('é', 100 + cast(o_orderkey % 20 as int)), repeat('日', cast(o_orderkey % 7 as int)), case when o_orderkey % 2 = 0 then ' I CANNOT say' else ' Sorry, I say' end) as t from orders)"
_HEX_REFUSED = " or ".join(f"contains(h, hex('{m.replace(chr(39), chr(39) * 2)}'))" for m in text.REFUSALS)


@_query(f"with {_HEADS}, hx as (select k, substr(hex(encode(translate(t, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'))), 1, 480) as h from heads) select k, ({_HEX_REFUSED}) as refuses from hx")
def refusal_forms(spark, d):
    """Refusals about the last byte that is looked at."""
    rows = spark.sql(f"with {_HEADS} select * from heads".replace("from orders)", "from {orders})"), orders=spark.read.parquet(f"{d}/orders.parquet"))
    return rows.select("k", text.is_refusal(F.col("t")).alias("refuses"))


@_query(oracle("claims", "|> select id, variant = 5 as blank, variant = 5 as blank_unicode from claims"))
def blank_flags(spark, d):
    return view(spark, d, "claims").select("id", text.is_blank(F.col("miner_answer")).alias("blank"), text.is_blank_unicode(F.col("miner_answer")).alias("blank_unicode"))


@_query(oracle("claims", "|> select id, case when gt_ref then '' else 'date:' || d || ' hex:' || hx end as truth, case when variant in (4, 5) then '' when variant in (7, 8) then 'hex:0xffffffffffffffffffffffff' else 'hex:' || hx end as answer from claims"))
def scan_identifiers(spark, d):
    shown = lambda c: F.array_join(F.transform(scan.scan_identifiers(c), lambda i: F.concat(i["kind"], F.lit(":"), i["text"])), " ")
    return view(spark, d, "claims").select("id", shown("ground_truth").alias("truth"), shown("miner_answer").alias("answer"))


@_query(oracle("claims", """|> select id, case when gt_ref then 0 else 2 end::bigint as truth_numbers, case when gt_ref then null else amt::double end as truth_paid,
    case variant when 9 then 60 when 3 then 0 when 4 then 0 when 5 then 0 else 1 end::bigint as answer_numbers,
    case variant when 0 then amt::double when 1 then amt_drift::double when 2 then amt_bad::double when 6 then amt::double when 7 then amt::double when 8 then amt_bad::double when 9 then 1.0 end as first_value from claims"""))  # fmt: skip
def scan_numbers(spark, d):
    rows = view(spark, d, "claims").select("id", scan.scan_numbers("ground_truth").alias("t"), scan.scan_numbers("miner_answer").alias("a"))
    paid = F.get(F.filter("t", lambda n: n["currency"]), F.lit(0))["value"]
    return rows.select("id", F.size("t").cast("long").alias("truth_numbers"), r6(paid).alias("truth_paid"), F.size("a").cast("long").alias("answer_numbers"), r6(F.get("a", F.lit(0))["value"]).alias("first_value"))


@_query(oracle("claims", "|> select id, case when gt_ref then 0 else 1 end::bigint as n, case when not gt_ref then amt::double end as value, case when not gt_ref then true end as currency from claims"))
def headline_figures(spark, d):
    rows = view(spark, d, "claims").select("id", correct.headline_figures(F.col("ground_truth")).alias("h"))
    one = F.get("h", F.lit(0))
    return rows.select("id", F.size("h").cast("long").alias("n"), r6(one["value"]).alias("value"), one["currency"].alias("currency"))


# What is known of a correction from how the pair was made: {total} etc. by variant, nothing where the truth refuses.
_KNOWN = """kn as (select *, case when gt_ref or variant = 5 then 0 when variant in (2, 8) then -0.08 else 0 end as num, case when gt_ref or variant = 5 then 0 when variant in (4, 7, 8) then -0.06 else 0 end as idt,
    case when variant = 4 and not gt_ref then -0.06 else 0 end as ref, gt_ref and variant <> 5 as gt_refused from claims)"""


@_query(oracle("claims", _KNOWN + "|> select id, round(greatest(-0.12, num + idt + ref), 6)::double as total, num::double as numeric, idt::double as ident, ref::double as refusal, gt_refused from kn"))
def correction(spark, d):
    rows = reports.with_correction(view(spark, d, "claims"))
    c = {k: F.round(F.col(f"correction.{k}").cast("double"), 6).alias(k) for k in ("total", "numeric", "ident", "refusal")}
    return rows.select("id", *c.values(), F.col("correction.gt_refused").alias("gt_refused"))


@_query(oracle("claims", """|> select id, case when gt_ref then null when variant in (0, 1, 6, 7) then 1.0 when variant in (2, 8) then 0.0 end::double as coverage from claims"""))
def numeric_verdict(spark, d):
    return reports.with_correction(view(spark, d, "claims")).select("id", F.col("correction.numeric_coverage").cast("double").alias("coverage"))


@_query(oracle("claims", """|> select id, case when gt_ref or variant = 5 then null when variant in (4, 7, 8) then 0.0 else 1.0 end::double as coverage from claims"""))
def ident_coverage(spark, d):
    return reports.with_correction(view(spark, d, "claims")).select("id", F.col("correction.ident_coverage").cast("double").alias("coverage"))


@_query(oracle("claims", _KNOWN + """|> select intent_id, count(*) as "rows", count(*) filter (where num + idt + ref <> 0) as fired, count(*) filter (where gt_refused) as bypassed, round(count(*) filter (where num + idt + ref <> 0) / count(*), 6) as rate from kn group by 1"""))
def silence_profile(spark, d):
    return reports.silence_profile(reports.with_correction(view(spark, d, "claims"))).withColumn("rate", r6("rate"))


@_query(oracle("claims", _KNOWN + """|> select count(*) as "rows", count(*) filter (where num + idt + ref <> 0) as fired, count(*) filter (where num < 0) as numeric, count(*) filter (where idt < 0) as ident, count(*) filter (where ref < 0) as refusal, count(*) filter (where gt_refused) as bypassed from kn"""))
def firing_rates(spark, d):
    return reports.firing_rates(reports.with_correction(view(spark, d, "claims")))


def _claims_scored(spark, d):
    rows = view(spark, d, "claims").withColumns({"epoch_id": F.col("k") % 3, "intent_id": F.concat(F.lit("g"), (F.col("k") % 4).cast("string"))})
    base = F.round(0.40 + (F.col("k") * 7919 % 1000) / 2000.0, 6)
    return rows.withColumns({"baseline": base, "reference": F.round((F.col("k") * 104729 % 1000) / 1000.0, 6)})


_CLAIMED = _KNOWN + """, cs as (select id, 'g' || (k % 4) as intent_id, round(0.40 + (k * 7919 % 1000) / 2000.0, 6) as baseline, round((k * 104729 % 1000) / 1000.0, 6) as canonical, greatest({clamp}, {sum}) as total from kn),
    sc as (select intent_id, canonical, baseline, total, least(1.0, greatest(0.0, (baseline::float + total::float)::double)) as cand, 0::bigint as epoch_id from cs), """


@_query(oracle("claims", _CLAIMED.format(clamp="-0.12", sum="num + idt + ref") + _POOLED + """|> select (select count(*) from sc) as "rows", (select count(*) from sc where total <> 0) as fired, (select count(*) from sc where baseline > 0.70 and baseline - cand >= 0.10) as catches,
    (select round(stddev_pop(cand), 5) from sc) as spread, round(avg(rho), 5) as mean_rho, round(min(rho), 5) as min_rho, count(*) filter (where status = 'FAIL') as failing from gs"""))  # fmt: skip
def simulate_gates(spark, d):
    found = reports.simulate(_claims_scored(spark, d))
    return found.select("rows", "fired", "catches", F.round("spread", 5).alias("spread"), F.round("mean_rho", 5).alias("mean_rho"), F.round("min_rho", 5).alias("min_rho"), "failing")


_SWEEP = {"shipped": correct.DetectorConfig(), "no refusal": correct.DetectorConfig(refusal_weight=0.0), "tight": correct.DetectorConfig(max_correction=0.05)}


@_query(oracle("claims", _KNOWN + """, sw as (select 'shipped' as setting, greatest(-0.12, num + idt + ref) as total from kn union all select 'no refusal', greatest(-0.12, num + idt) from kn union all select 'tight', greatest(-0.05, num + idt + ref) from kn)
    |> select setting, count(*) as "rows", count(*) filter (where total <> 0) as fired from sw group by 1"""))  # fmt: skip
def config_sweep(spark, d):
    return reports.sweep(_claims_scored(spark, d), _SWEEP).select("setting", "rows", "fired")


@_query(oracle("claims", """|> select id, d as epoch_text, case when length(ground_truth) > 20 then substr(ground_truth, 1, 20) || '…' else ground_truth end as truth from claims where lower(intent_id) = 'i2' and not gt_ref order by k desc limit 25"""))
def explain_rows(spark, d):
    rows = view(spark, d, "claims").withColumns({"epoch_id": F.col("k"), "score": F.lit(0.5), "miner_slug": F.lit("m"), "question": F.lit("q")})
    return reports.explain(rows, intent="I2", fired_only=True, limit=25, width=20).select("id", F.col("d").alias("epoch_text"), F.col("ground_truth").alias("truth"))


@_query("""select a.vec_id, b.vec_id as next_id, round(greatest(0, list_cosine_similarity(a.embedding::double[], b.embedding::double[])), 5) as cosine from embeddings a join embeddings b on b.vec_id = a.vec_id + 1""")
def cosine_neighbours(spark, d):
    e = spark.read.parquet(f"{d}/embeddings.parquet").select("vec_id", "embedding")
    other = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("vec_id").alias("next_id"), F.col("embedding").alias("next"))
    return e.join(other, "vec_id").select("vec_id", "next_id", F.round(vectors.cosine(F.col("embedding"), F.col("next")), 5).alias("cosine"))


@_query("""select vec_id, round(sqrt(list_sum(list_transform(embedding, lambda x: x::double * x::double))), 5) as norm, 1.0::double as unit from embeddings""")
def l2_normalise(spark, d):
    e = spark.read.parquet(f"{d}/embeddings.parquet")
    return e.select("vec_id", F.round(vectors.l2_norm(F.col("embedding")), 5).alias("norm"), F.round(vectors.l2_norm(vectors.normalise(F.col("embedding"))), 5).alias("unit"))


@_query(r"""select count(*) as docs, count(*) filter (where regexp_matches(text, '[0-9]')) as with_digit, count(*) filter (where regexp_matches(text, '0[xX][0-9a-fA-F]{6,}')) as with_hex, count(*) filter (where regexp_matches(text, '[cC][vV][eE]-[0-9]{4}-[0-9]{4,}')) as with_cve from documents""")
def digit_profile(spark, d):
    t = F.col("text")
    has = {"with_digit": "[0-9]", "with_hex": "0[xX][0-9a-fA-F]{6,}", "with_cve": "[cC][vV][eE]-[0-9]{4}-[0-9]{4,}"}
    return spark.read.parquet(f"{d}/documents.parquet").agg(F.count("*").alias("docs"), *[F.count_if(t.rlike(p)).alias(k) for k, p in has.items()])


@_query()
def projection_embedding(spark, d):
    rows = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", embed.projection_embedding("text").alias("v"))
    return rows.select("doc_id", F.size("v").alias("width"), F.round(vectors.l2_norm(F.col("v")), 5).alias("norm"), F.round(F.get("v", F.lit(0)).cast("double"), 6).alias("v0"))


# The verdict on the lexical scorer, held to a reference made from the answers' lengths; scores are rounded, so ties are ties in both engines.
_VERDICT = (
    _PAIR_SCORES + ", " + "tq as" + _QT.removeprefix("tk as") + ", sx as (select *, " + _bm25("q", "a") + " as qa_, " + _bm25("t", "a") + " as ta_ from tq), sc as (select intent_id, 0::bigint as epoch_id, case when trim(miner_answer) = '' then 0.0 else round("
    + _COMPOSITE.format(qa="qa_", ta="ta_", c="miner_answer") + ", 6) end as cand, strlen(miner_answer) % 101 / 101.0::double as canonical from sx), " + _POOLED
)


@_query(oracle("qa", _VERDICT + f""", g1 as (select round(avg(self_score), 6) as ms, round(avg(cross_score), 6) as mc, count(*) filter (where self_score > cross_score) as ok, count(*) as n from ps),
    g2 as (select round(stddev_pop(cand), 6) as sd from sc), g3 as (select count(*) filter (where status = 'FAIL') as failing, count(rho) as defined, {_REASON} filter (where rho is not null) as got from gs),
    st as (select *, case when ms > mc and ok / n >= 0.60 then 'PASS' else 'FAIL' end as gate1, case when sd > 0.05 then 'PASS' else 'FAIL' end as gate2, case when failing > 0 then 'FAIL' when defined = 0 then 'UNDEFINED' else 'PASS' end as gate3 from g1, g2, g3)
    |> select gate1, gate2, gate3, gate1 = 'PASS' and gate2 = 'PASS' and gate3 = 'PASS' as activates, case
        when gate1 = 'FAIL' and ms <= mc then format('structural validation failed: self-match ({{:.4f}}) did not beat unrelated cross-match ({{:.4f}})', ms, mc)
        when gate1 = 'FAIL' then format('structural validation weak: only {{}} of {{}} intent pairs ranked a matching answer above an unrelated one ({{:.0f}}%, 60% required); means were self {{:.4f}} vs cross {{:.4f}}', ok, n, 100 * ok / n, ms, mc)
        when gate2 = 'FAIL' then format('candidate scores collapsed: stdev={{:.4f}} <= threshold 0.0500', sd) when gate3 = 'FAIL' then 'rank agreement below threshold (0.60), got: map[' || got || ']' else '' end as reason from st"""))  # fmt: skip
def gate_verdict(spark, d):
    rows = view(spark, d, "qa").withColumns({"epoch_id": F.lit(1).cast("long"), "score": F.lit(0.0)})
    known = score.LEXICAL_SCORER.apply(rows).select("id", r6("score").alias("score"))
    reference = rows.select("id", (text.byte_length(F.col("miner_answer")) % 101 / 101.0).alias("score"))
    one, two, groups = gates.measured(rows, known, reference, score.LEXICAL_SCORER.score)
    rounded = groups.withColumn("rho", r6("rho"))
    return gates.verdict(one.withColumns({c: r6(c) for c in ("mean_self", "mean_cross")}), two.withColumn("spread", r6("spread")), gates.gate3(rounded), rounded)


def _plain_vector(name: str) -> Column:
    """Bytes, words and one as a vector: an embedding that SQL has, too."""
    return F.array(text.byte_length(F.col(name)).cast("double"), F.size(text.tokens(F.col(name))).cast("double"), F.lit(1.0))


def _plain_cosine(a: str, b: str, words: dict[str, str]) -> str:
    vector = lambda c: f"[strlen({c})::double, len({words[c]})::double, 1.0::double]"
    return f"greatest(0, least(1, list_cosine_similarity({vector(a)}, {vector(b)})))"


_SIGNALS = {c: w for c, w in (("question", "q"), ("ground_truth", "t"), ("miner_answer", "a"))}
_RANKED = (
    _QT + ", sg as (select id, trim(miner_answer) = '' as blank, " + _plain_cosine("question", "miner_answer", _SIGNALS) + " as relevance, " + _plain_cosine("ground_truth", "miner_answer", _SIGNALS) + " as correctness, "
    + _bm25("t", "a") + " as lexical, 1 / (1 + exp(-(strlen(miner_answer) - 50) / 20.0)) as length from tk)|> select id, " + ", ".join(f"case when blank then 0 else round({c}, 4) end::double as {c}" for c in ("relevance", "correctness", "lexical", "length"))
    + ", case when blank then 0 else round(least(1, greatest(0, 0.25 * relevance + 0.50 * correctness + 0.15 * lexical + 0.10 * length)), 4) end::double as composite from sg"
)


@_query(oracle("qa", _RANKED))
def rank_answers(spark, d):
    """The signals of answers, by an embedding that SQL has."""
    found = rank.rank_answers(view(spark, d, "qa"), _plain_vector, None)
    return found.select("id", *[F.round(F.col(f"signals.{c}").cast("double"), 4).alias(c) for c in ("relevance", "correctness", "lexical", "length", "composite")])


@_query()
def breakdown(spark, d):
    """The signals of answers by the projection embedding, corrected."""
    return rank.rank_answers(view(spark, d, "qa")).select("id", "signals.*")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for k, (f, _) in FOUND.items()}


def oracle_sql() -> dict[str, str]:
    return {k: sql for k, (_, sql) in FOUND.items() if sql}
