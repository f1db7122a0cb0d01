"""The three gates that a scorer has to pass, the verdict over them, and the table of catches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from answergauge.functions import text
from answergauge.sources.corpus import latest

from . import group, stats

#: Thresholds of the gates, and of eligible rows and catches.
SELF_SHARE, DISPERSION, AGREEMENT, ELIGIBLE, CATCH = 0.60, 0.05, 0.60, 0.70, 0.10
TRUTH_BYTES, QUESTION_BYTES = 32, 8


def _status(defined: Column, passed: Column) -> Column:
    return F.when(~defined, "UNDEFINED").when(passed, "PASS").otherwise("FAIL")


def structural_pairs(rows: DataFrame) -> DataFrame:
    """intent_id, id, question, ground_truth, cross_truth, cross_intent: the first usable row of each intent, and the
    truth of the next intent (the first, after the last). A single intent has no other: it gives no pair (measured() raises)."""
    usable = rows.where((text.byte_length(F.col("ground_truth")) >= TRUTH_BYTES) & (text.byte_length(F.col("question")) >= QUESTION_BYTES))
    first = usable.groupBy("intent_id").agg(F.min_by(F.struct("id", "question", "ground_truth"), "pos").alias("r")).select("intent_id", "r.*")
    order, every = Window.orderBy("intent_id"), Window.orderBy("intent_id").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    turned = {c: F.coalesce(F.lead(c).over(order), F.first(c).over(every)) for c in ("ground_truth", "intent_id")}
    paired = first.withColumns({"cross_truth": turned["ground_truth"], "cross_intent": turned["intent_id"], "n": F.count("*").over(every)})
    return paired.where("n >= 2").drop("n")


def score_pairs(pairs: DataFrame, score) -> DataFrame:
    """intent_id, cross_intent, self_score, cross_score: the truth as an answer to its own question, and to another's."""
    def made(answer: str) -> Column:
        return F.coalesce(score(F.col("question"), F.col("ground_truth"), F.col(answer)), F.lit(0.0))

    return pairs.select("intent_id", "cross_intent", made("ground_truth").alias("self_score"), made("cross_truth").alias("cross_score"))


def gate1(pairs: DataFrame) -> DataFrame:
    """One row: pairs, mean_self, mean_cross, share, status."""
    found = pairs.agg(
        F.count("*").alias("pairs"), stats.mean(F.col("self_score")).alias("mean_self"), stats.mean(F.col("cross_score")).alias("mean_cross"), F.count_if(F.col("self_score") > F.col("cross_score")).alias("passed")
    )
    found = found.withColumn("share", F.coalesce(F.try_divide(F.col("passed"), F.col("pairs")), F.lit(0.0)))
    return found.withColumn("status", _status(F.col("pairs") > 0, (F.col("mean_self") > F.col("mean_cross")) & (F.col("share") >= SELF_SHARE)))


def gate2(scores: DataFrame, score: str = "score") -> DataFrame:
    """One row: n, spread, low, high, status; the spread has to be above the threshold."""
    s = F.col(score)
    found = scores.agg(F.count(s).alias("n"), stats.spread(s).alias("spread"), F.min(s).alias("low"), F.max(s).alias("high"))
    return found.withColumn("status", _status(F.col("n") >= 2, F.col("spread") > DISPERSION))


def join_scores(rows: DataFrame, candidate: DataFrame, reference: DataFrame) -> DataFrame:
    """rows that both have scored, with candidate and reference; of repeated ids the last score counts."""
    a = latest(candidate).withColumnRenamed("score", "candidate")
    b = latest(reference).withColumnRenamed("score", "reference")
    return rows.drop("candidate", "reference").join(a, "id").join(b, "id")


def gate3_groups(scored: DataFrame, pooled: bool, least: int = 4) -> DataFrame:
    """intent_id, epoch, n, rho, status, why of each group. scored: rounds with candidate and reference."""
    keyed = group.with_group(scored, pooled).select("intent_id", "epoch", "candidate", "reference")
    found = stats.spearman(keyed, ["intent_id", "epoch"], "candidate", "reference").where(F.col("n") >= least)
    why = F.when(F.col("n") < 2, "fewer than two rows").when(F.col("reference_constant"), "constant reference").when(F.col("candidate_constant"), "constant candidate")
    return found.select("intent_id", "epoch", "n", "rho", _status(F.col("rho").isNotNull(), F.col("rho") >= AGREEMENT).alias("status"), why.alias("why"))


def gate3_order() -> list[Column]:
    """Failures first, the undefined last, the weakest first."""
    return [F.when(F.col("status") == "FAIL", 0).when(F.col("status") == "PASS", 1).otherwise(2), F.col("rho"), F.col("intent_id"), F.col("epoch")]


def gate3(groups: DataFrame) -> DataFrame:
    """One row: groups, defined, failing, undefined, constant_candidate, mean_rho, min_rho, min_intent, headroom, status."""
    rho = F.col("rho")
    found = groups.agg(
        F.count("*").alias("groups"), F.count(rho).alias("defined"), F.count_if(F.col("status") == "FAIL").alias("failing"), F.count_if(rho.isNull()).alias("undefined"),
        F.count_if(F.col("why") == "constant candidate").alias("constant_candidate"), stats.mean(rho).alias("mean_rho"), F.min(rho).alias("min_rho"),
        F.min_by(F.struct("intent_id", "epoch"), F.when(rho.isNotNull(), F.struct(rho, F.col("intent_id"), F.col("epoch")))).alias("m"),
    )
    found = found.withColumn("min_intent", F.when(F.col("min_rho") < 1.0, F.concat("m.intent_id", F.lit("@"), F.col("m.epoch").cast("string"))).otherwise(""))
    found = found.withColumn("headroom", F.col("min_rho") - AGREEMENT)
    status = F.when(F.col("failing") > 0, "FAIL").when(F.col("defined") == 0, "UNDEFINED").otherwise("PASS")
    return found.drop("m").withColumn("status", status)


def gate3_reason(groups: DataFrame) -> DataFrame:
    """One row: reason, "intent:rho" of each group that is defined, in the order of gate3_order(). There are as many as groups."""
    rank = F.when(F.col("status") == "FAIL", 0).otherwise(1)
    key = F.struct(rank.alias("a"), F.col("rho").alias("b"), F.col("intent_id").alias("c"), F.col("epoch").alias("d"), F.concat("intent_id", F.lit(":"), text.general(F.col("rho"))).alias("t"))
    kept = F.array_sort(F.collect_list(F.when(F.col("rho").isNotNull(), key)))
    return groups.agg(F.concat_ws(" ", F.transform(kept, lambda x: x["t"])).alias("reason"))


def verdict(one: DataFrame, two: DataFrame, three: DataFrame, groups: DataFrame) -> DataFrame:
    """One row: the status of each gate, activates, and reason, that of the first gate that fails (else empty)."""
    # Each of these has one row.
    both = one.select(F.col("status").alias("gate1"), "mean_self", "mean_cross", "share", "passed", "pairs").join(two.select(F.col("status").alias("gate2"), "spread")).join(
        three.select(F.col("status").alias("gate3"))
    ).join(gate3_reason(groups))
    # How a rejection is worded.
    unlike = F.format_string("structural validation failed: self-match (%.4f) did not beat unrelated cross-match (%.4f)", "mean_self", "mean_cross")
    weak = F.format_string(
        f"structural validation weak: only %d of %d intent pairs ranked a matching answer above an unrelated one (%.0f%%, {100 * SELF_SHARE:.0f}%% required); means were self %.4f vs cross %.4f",
        "passed", "pairs", 100 * F.col("share"), "mean_self", "mean_cross",
    )
    reason = (
        F.when((F.col("gate1") == "FAIL") & (F.col("mean_self") <= F.col("mean_cross")), unlike)
        .when(F.col("gate1") == "FAIL", weak)
        .when(F.col("gate2") == "FAIL", F.format_string(f"candidate scores collapsed: stdev=%.4f <= threshold {DISPERSION:.4f}", "spread"))
        .when(F.col("gate3") == "FAIL", F.concat(F.lit(f"rank agreement below threshold ({AGREEMENT:.2f}), got: map["), F.col("reason"), F.lit("]")))
        .otherwise("")
    )
    passes = (F.col("gate1") == "PASS") & (F.col("gate2") == "PASS") & (F.col("gate3") == "PASS")
    return both.select("gate1", "gate2", "gate3", passes.alias("activates"), reason.alias("reason"))


def eligible(rows: DataFrame, canonical: DataFrame, candidate: DataFrame) -> DataFrame:
    """rows with canonical (above ELIGIBLE), candidate (null if it has none) and delta."""
    high = latest(canonical).where(F.col("score") > ELIGIBLE).withColumnRenamed("score", "canonical")
    found = rows.drop("canonical", "candidate").join(high, "id").join(latest(candidate).withColumnRenamed("score", "candidate"), "id", "left")
    return found.withColumn("delta", F.col("canonical") - F.col("candidate"))


def catches(found: DataFrame) -> DataFrame:
    """Rows of eligible() that the candidate scores lower by CATCH at least, the largest difference first."""
    return found.where(F.col("delta") >= CATCH).orderBy(F.desc("delta"), "id")


def catch_rate(found: DataFrame) -> DataFrame:
    """One row: eligible, catches, rate."""
    sums = found.agg(F.count("*").alias("eligible"), F.count_if(F.col("delta") >= CATCH).alias("catches"))
    return sums.withColumn("rate", F.coalesce(F.try_divide("catches", "eligible"), F.lit(0.0)))


def catches_by_intent(found: DataFrame) -> DataFrame:
    return found.where(F.col("delta") >= CATCH).groupBy("intent_id").agg(F.count("*").alias("catches"))


def run_gates(rows: DataFrame, candidate: DataFrame, reference: DataFrame, score, pooled: bool = True, least: int = 4) -> DataFrame:
    """The verdict on a scorer: its scores, those it is held to, and a function that scores pairs of texts.

    Fewer than two intents with usable texts are an error. Of repeated ids the last score counts, for each row that has the id.
    """
    one, two, groups = measured(rows, candidate, reference, score, pooled, least)
    return verdict(one, two, gate3(groups), groups)


def measured(rows: DataFrame, candidate: DataFrame, reference: DataFrame, score, pooled: bool = True, least: int = 4) -> tuple[DataFrame, DataFrame, DataFrame]:
    """What the gates find: one row of gate 1, one of gate 2, and the groups of gate 3."""
    pairs = structural_pairs(rows)
    if pairs.isEmpty():
        raise ValueError("gate 1 needs two intents at least with a question and a truth that are long enough")
    groups = gate3_groups(join_scores(rows, candidate, reference), pooled, least)
    return gate1(score_pairs(pairs, score)), gate2(rows.select("id").join(latest(candidate), "id")), groups
