"""Comparisons of scorers, what-if runs over settings, and looks at single rows."""

from __future__ import annotations

from dataclasses import replace
from functools import reduce

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from answergauge.functions import scan, text
from answergauge.sources.corpus import latest

from . import correct, gates
from .correct import DetectorConfig

#: The score units that consensus and promotion allow for, and a bound of the check that nothing is raised.
DELTA_CONSENSUS, DELTA_PROMOTE, ROUNDING = 0.15, 0.10, 1e-6


def differences(a: DataFrame, b: DataFrame) -> DataFrame:
    """id, a, b, d (b - a) of the ids that both have scored; of repeated ids the last score counts."""
    return latest(a).withColumnRenamed("score", "a").join(latest(b).withColumnRenamed("score", "b"), "id").withColumn("d", F.col("b") - F.col("a"))


def compare(diff: DataFrame) -> DataFrame:
    """One row: rows, identical, changed, max_abs, mean_changed."""
    d = F.abs(F.col("d"))
    return diff.agg(
        F.count("*").alias("rows"), F.count_if(F.col("d") == 0).alias("identical"), F.count_if(F.col("d") != 0).alias("changed"), F.coalesce(F.max(d), F.lit(0.0)).alias("max_abs"), F.coalesce(F.avg(F.when(F.col("d") != 0, d)), F.lit(0.0)).alias("mean_changed")
    )


def top_changes(diff: DataFrame, n: int = 20) -> DataFrame:
    return diff.where("d <> 0").orderBy(F.desc(F.abs(F.col("d"))), "id").limit(n)


def verify_bits(a: DataFrame, b: DataFrame) -> DataFrame:
    """id, a, b of rows whose scores differ as float32, in any bit: 0.0 and -0.0 differ, too."""
    diff = differences(a, b).withColumns({"a": F.col("a").cast("float"), "b": F.col("b").cast("float")})
    # 0.0 and -0.0 are equal to Spark; their texts aren't.
    return diff.where(~F.col("a").eqNullSafe(F.col("b")) | (F.col("a").cast("string") != F.col("b").cast("string"))).select("id", "a", "b")


def verify_bounds(base: DataFrame, corrected: DataFrame, most: float = 0.12) -> DataFrame:
    """One row: rows, raised (scores that the correction raised), beyond (lowered by more than it may)."""
    diff = differences(base, corrected)
    return diff.agg(F.count("*").alias("rows"), F.count_if(F.col("d") > ROUNDING).alias("raised"), F.count_if(-F.col("d") > most + ROUNDING).alias("beyond"))


def spread_out(rows: DataFrame) -> DataFrame:
    """rows in as many partitions as there are cores, where they come from fewer files than that: scanning is the costly part."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(cores) if 0 < len(rows.inputFiles()) < cores else rows


def with_correction(rows: DataFrame, cfg: DetectorConfig = DetectorConfig()) -> DataFrame:
    """rows with correction, and corrected where they have a baseline."""
    found = spread_out(rows).withColumn("detected__", correct.detect(F.col("ground_truth"), F.col("miner_answer"), cfg))
    return weighed(found, cfg).drop("detected__")


def weighed(detected: DataFrame, cfg: DetectorConfig) -> DataFrame:
    """Rows with detected__ (see correct.detect()), with correction, and corrected where they have a baseline."""
    found = detected.withColumn("correction", correct.weigh(F.col("detected__"), cfg))
    return found.withColumn("corrected", correct.apply(F.col("baseline"), F.col("correction.total"))) if "baseline" in found.columns else found


def silence_profile(corrected: DataFrame) -> DataFrame:
    """rows, fired, bypassed (the truth is a refusal) and rate of each intent."""
    found = corrected.groupBy("intent_id").agg(F.count("*").alias("rows"), F.count_if(correct.fired(F.col("correction"))).alias("fired"), F.count_if(F.col("correction.gt_refused")).alias("bypassed"))
    return found.withColumn("rate", F.col("fired") / F.col("rows"))


def firing_rates(corrected: DataFrame) -> DataFrame:
    """One row: rows that each detector fired on, and that were bypassed."""
    c = F.col("correction")
    return corrected.agg(
        F.count("*").alias("rows"), F.count_if(correct.fired(c)).alias("fired"), F.count_if(c["numeric"] < 0).alias("numeric"), F.count_if(c["ident"] < 0).alias("ident"), F.count_if(c["refusal"] < 0).alias("refusal"), F.count_if(c["gt_refused"]).alias("bypassed")
    )


def gate_change(before: DataFrame, after: DataFrame) -> DataFrame:
    """intent_id, epoch, rho before and after, delta, of groups defined in both; the weakest after first."""
    a = before.where("rho is not null").select("intent_id", "epoch", F.col("rho").alias("before"))
    b = after.where("rho is not null").select("intent_id", "epoch", F.col("rho").alias("after"))
    return a.join(b, ["intent_id", "epoch"]).withColumn("delta", F.col("after") - F.col("before")).orderBy("after", "intent_id", "epoch")


def simulate(rows: DataFrame, cfg: DetectorConfig = DetectorConfig(), pooled: bool = True, least: int = 4) -> DataFrame:
    """One row for a setting: gates 2 and 3 with the correction, rows that it fired on, catches.

    rows: rounds with baseline and reference. They are scanned once.
    """
    return _simulated(_detected(rows, cfg), cfg, pooled, least)


def _detected(rows: DataFrame, cfg: DetectorConfig) -> DataFrame:
    """What a setting needs of rows, scanned and kept: weights and clamps are tried on it without another look at the texts."""
    found = spread_out(rows).withColumn("detected__", correct.detect(F.col("ground_truth"), F.col("miner_answer"), cfg))
    return found.select("intent_id", "epoch_id", "baseline", "reference", "detected__").persist(StorageLevel.MEMORY_AND_DISK)


def _simulated(detected: DataFrame, cfg: DetectorConfig, pooled: bool = True, least: int = 4) -> DataFrame:
    done = weighed(detected, cfg)
    scored = done.withColumn("candidate", F.col("corrected"))
    three = gates.gate3(gates.gate3_groups(scored, pooled, least)).select("mean_rho", "min_rho", "min_intent", "failing", F.col("status").alias("gate3"))
    two = gates.gate2(scored, "corrected").select("spread", F.col("status").alias("gate2"))
    delta = F.col("baseline") - F.col("corrected")
    fired = done.agg(F.count("*").alias("rows"), F.count_if(correct.fired(F.col("correction"))).alias("fired"), F.count_if((F.col("baseline") > gates.ELIGIBLE) & (delta >= gates.CATCH)).alias("catches"))
    return fired.join(two).join(three)  # one row each


def sweep(rows: DataFrame, configs: dict[str, DetectorConfig]) -> DataFrame:
    """simulate() for each setting, by name. Settings that differ in weights and the clamp alone share one scan of the texts."""
    seen: dict[DetectorConfig, DataFrame] = {}
    found = []
    for name, c in configs.items():
        key = replace(c, max_correction=0.0, numeric_weight=0.0, ident_weight=0.0, refusal_weight=0.0)
        if key not in seen:
            seen[key] = _detected(rows, c)
        found.append(_simulated(seen[key], c).select(F.lit(name).alias("setting"), "*"))
    return reduce(DataFrame.unionByName, found)


def config_warnings(cfg: DetectorConfig) -> list[str]:
    """What is to be said of a setting: that it isn't the shipped one, or breaks a bound."""
    found = [] if cfg == DetectorConfig() else ["these are not the shipped settings"]
    if cfg.max_correction >= DELTA_CONSENSUS:
        found.append(f"a clamp of {cfg.max_correction:.3f} is at or above {DELTA_CONSENSUS}: a validator with it is penalised")
    if cfg.max_correction <= DELTA_PROMOTE:
        found.append(f"a clamp of {cfg.max_correction:.3f} is at or below {DELTA_PROMOTE}: no correction is a catch")
    return found


def explain(rows: DataFrame, row_id: str = "", intent: str = "", miner: str = "", epoch: int = 0, fired_only: bool = False, cfg: DetectorConfig = DetectorConfig(), limit: int = 10, width: int = 300) -> DataFrame:
    """Rows that fit all that is asked, newest and best first, with what the detectors saw in them."""
    if row_id:
        rows = rows.where(F.col("id") == row_id)
    if intent:
        rows = rows.where(F.lower("intent_id") == intent.lower())
    if miner:
        rows = rows.where(F.col("miner_slug").contains(miner))
    if epoch:
        rows = rows.where(F.col("epoch_id") == epoch)
    found = with_correction(rows, cfg)
    if fired_only:
        found = found.where(correct.fired(F.col("correction")))
    best = found.orderBy(F.desc("epoch_id"), F.desc("score"), "id").limit(limit)
    shown = {c: text.clip(F.col(c), width) for c in ("question", "ground_truth", "miner_answer") if c in rows.columns}
    return best.withColumns(
        {
            "truth_numbers": scan.scan_numbers("ground_truth"), "answer_numbers": scan.scan_numbers("miner_answer"), "truth_idents": scan.scan_identifiers("ground_truth"),
            "answer_idents": scan.scan_identifiers("miner_answer"), "headline": correct.headline_figures(F.col("ground_truth"), cfg),
        }
    ).withColumns(shown)


def registry_summary(registry: DataFrame) -> DataFrame:
    """Registrations by status, and how many are active."""
    return registry.groupBy(F.col("ActivationStatus").alias("status")).agg(F.count("*").alias("n"), F.sum("EvalErrorCount").alias("errors"))


def compare_corrections(a: DataFrame, b: DataFrame) -> DataFrame:
    """id and field of each difference between two tables of corrections (id, correction), as float32."""
    both = a.select("id", F.col("correction").alias("a")).join(b.select("id", F.col("correction").alias("b")), "id")
    fields = ["total", "numeric", "ident", "refusal", "gt_refused", "numeric_coverage", "ident_coverage"]
    differs = F.array(*[F.when(~F.col(f"a.{f}").eqNullSafe(F.col(f"b.{f}")), F.lit(f)) for f in fields])
    return both.select("id", F.explode(F.array_compact(differs)).alias("field"))


def first_gates_lines(one: DataFrame, two: DataFrame, three: DataFrame) -> DataFrame:
    """line: the report on gates 1 and 2 and the sums of gate 3 (a row each of gate1(), gate2(), gate3())."""
    first = one.select(
        F.concat(F.lit("[1] structural self-match: "), "status"),
        F.format_string("    self-match %.4f, cross-match %.4f, margin %+.4f", "mean_self", "mean_cross", F.col("mean_self") - F.col("mean_cross")),
        F.format_string(f"    %d of %d pairs right (%.0f%%, {100 * gates.SELF_SHARE:.0f}%% needed)", "passed", "pairs", 100 * F.col("share")),
    )
    second = two.select(
        F.concat(F.lit("[2] score dispersion: "), "status"),
        F.format_string(f"    spread %.4f, has to exceed {gates.DISPERSION:.4f}, margin %+.4f", "spread", F.col("spread") - gates.DISPERSION),
        F.format_string("    range %s to %s over %d rows", F.coalesce(F.format_string("%.4f", "low"), F.lit("-")), F.coalesce(F.format_string("%.4f", "high"), F.lit("-")), "n"),
    )
    third = three.select(
        F.concat(F.lit("[3] rank agreement: "), "status"),
        F.format_string(f"    threshold {gates.AGREEMENT:.2f}, mean %+.4f, %d groups measured, %d not rankable", "mean_rho", "defined", "undefined"),
        F.when(F.col("defined") > 0, F.format_string("    weakest %s at %+.4f, headroom %+.4f", "min_intent", "min_rho", "headroom")),
        F.when(F.col("constant_candidate") > 0, F.format_string("    warning: %d groups with one score for all answers", "constant_candidate")),
    )
    lines = [part.select(F.posexplode(F.array(*[F.col(f"`{c}`") for c in part.columns])).alias("at", "line")).withColumn("gate", F.lit(k)) for k, part in enumerate((first, second, third))]
    return reduce(DataFrame.unionByName, lines).where("line is not null").orderBy("gate", "at").select("line")


def verdict_lines(found: DataFrame) -> DataFrame:
    """line: the verdict, and why."""
    return found.select(F.when(F.col("activates"), "verdict: all three gates pass").otherwise(F.concat(F.lit("verdict: rejected. "), F.col("reason"))).alias("line"))


def gate_lines(groups: DataFrame) -> DataFrame:
    """line: the report on gate 3, a line for each group, failures first."""
    epoch = F.when(F.col("epoch") == -1, "pooled").otherwise(F.col("epoch").cast("string"))
    shown = F.format_string("  %-24s %6s %5d %9s  %s", F.substring("intent_id", 1, 24), epoch, "n", F.coalesce(F.format_string("%.4f", "rho"), F.lit("-")), F.coalesce("why", "status"))
    return groups.orderBy(*gates.gate3_order()).select(shown.alias("line"))


def catch_lines(found: DataFrame, n: int = 20) -> DataFrame:
    """line: the largest catches."""
    line = F.format_string("  %-24s %-20s %7.4f %7.4f %+8.4f", F.substring("intent_id", 1, 24), F.substring("miner_slug", 1, 20), "canonical", "candidate", -F.col("delta"))
    return gates.catches(found).limit(n).select(line.alias("line"))


def compare_lines(diff: DataFrame, n: int = 20) -> DataFrame:
    """line: the largest differences between two scorers."""
    return top_changes(diff, n).select(F.format_string("  %-40s %.8g %.8g %+.4f", "id", "a", "b", "d").alias("line"))


def simulate_lines(found: DataFrame) -> DataFrame:
    """line: one for each setting that was tried (see sweep())."""
    worst = F.coalesce(F.format_string("%s %.4f", F.substring("min_intent", 1, 20), "min_rho"), F.lit("-"))
    line = F.format_string("%-16s mean=%.4f  worst=%-28s fail=%d  fired=%4.1f%%  catch=%d", "setting", "mean_rho", worst, "failing", text.pct(F.col("fired"), F.col("rows")), "catches")
    return found.select(line.alias("line"))


def fired_lines(corrected: DataFrame, n: int = 20) -> DataFrame:
    """line: the largest corrections, with the detectors that fired."""
    c = F.col("correction")
    which = F.concat_ws(
        " ",
        F.when(c["numeric"] < 0, F.format_string("num(%.0f%%)", 100 * c["numeric_coverage"])),
        F.when(c["ident"] < 0, F.format_string("id(%.0f%%)", 100 * c["ident_coverage"])),
        F.when(c["refusal"] < 0, F.lit("refusal")),
    )
    line = F.format_string("  %-24s %-20s %+8.4f  %s", F.substring("intent_id", 1, 24), F.substring("miner_slug", 1, 20), c["total"].cast("double"), which)
    return corrected.where(correct.fired(c)).orderBy(c["total"], "id").limit(n).select(line.alias("line"))


def registry_lines(registry: DataFrame) -> DataFrame:
    """line: a line for each registration."""
    line = F.format_string("  %5d %-10s %-24s %10.2f %5d  %s", "RegistrationID", F.coalesce("ActivationStatus", F.lit("")), F.coalesce("IntentID", F.lit("")), F.coalesce("BondAmount", F.lit(0.0)), F.coalesce("EvalErrorCount", F.lit(0)), F.coalesce("RejectionReason", F.lit("")))
    return registry.orderBy("RegistrationID").select(line.alias("line"))
