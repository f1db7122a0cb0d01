"""Commands: python -m answergauge COMMAND ... (corpora are Parquet folders of rounds, or JSON documents)."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from answergauge.operators import correct, gates, group, rank, reports, score
from answergauge.sources import corpus, paged

DEFAULT = correct.DetectorConfig()


def load(spark: SparkSession, path: str) -> DataFrame:
    return corpus.read_corpus(spark, path) if path.endswith(".json") else spark.read.parquet(path)


def scored(rows: DataFrame, scorer: str) -> DataFrame:
    """id, score by a scorer's name (lexical, projection, corrected), "published", or a Parquet folder of id, score."""
    if scorer == "published":
        return corpus.latest(rows)
    if scorer == "lexical":
        return score.LEXICAL_SCORER.apply(rows).select("id", "score")
    if scorer in ("projection", "corrected"):
        return rank.score_rounds(rows, cfg=DEFAULT if scorer == "corrected" else None).select("id", "score")
    return rows.sparkSession.read.parquet(scorer).select("id", "score")


def show(lines: DataFrame) -> None:
    for r in lines.collect():
        print(r[0])


def say(one: DataFrame) -> None:
    for k, v in one.first().asDict().items():
        print(f"  {k:<20} {v:.4f}" if isinstance(v, float) else f"  {k:<20} {v}")


def config(a: argparse.Namespace) -> correct.DetectorConfig:
    made = correct.DetectorConfig(max_correction=a.max, numeric_weight=a.w_num, ident_weight=a.w_id, refusal_weight=a.w_ref, rel_tolerance=a.tol, max_truth_numbers=a.max_gt, check_dates=a.dates)
    for w in reports.config_warnings(made):
        print(f"  note: {w}")
    return made


def pull(spark, a) -> int:
    spark.dataSource.register(paged.PagedRounds)
    options = {"url": a.url, "max": str(a.most)} | ({"intent": a.intent} if a.intent else {})
    pages = spark.read.format("paged_rounds").options(**options, keep="true").load().persist()
    rows, error = paged.up_to_the_end(pages)
    corpus.dedup_first(rows).write.mode("overwrite").parquet(a.out)
    say(group.summarise(spark.read.parquet(a.out)))
    if error:
        print(f"  stopped: {error}")
    return int(bool(error))


def corpus_(spark, a) -> int:
    rows = load(spark, a.corpus)
    say(group.summarise(rows))
    for pooled in (True, False):
        found = group.rankable(rows, pooled, a.min_group)
        print(f"  groups {'pooled' if pooled else 'by epoch'}: {group.group_sizes(rows, pooled, a.min_group).count()}, rankable {found.count()}")
    group.by_intent(rows, a.min_group).orderBy("intent_id").show(100, False)
    return 0


def subset(spark, a) -> int:
    group.subset(load(spark, a.corpus), a.min_group, a.per_intent, not a.all, a.since).write.mode("overwrite").parquet(a.out)
    say(group.summarise(spark.read.parquet(a.out)))
    return 0


def gate(spark, a) -> int:
    rows = load(spark, a.corpus)
    candidate, reference = scored(rows, a.scorer), scored(rows, a.reference)
    one, two, groups = (t.persist() for t in gates.measured(rows, candidate, reference, score.LEXICAL_SCORER.score, a.pool, a.min_group))  # small, and shown more than once
    three = gates.gate3(groups)
    show(reports.first_gates_lines(one, two, three))
    show(reports.gate_lines(groups))
    made = gates.verdict(one, two, three, groups)
    say(made)
    show(reports.verdict_lines(made))
    return 0 if made.first().activates else 1


def catch(spark, a) -> int:
    rows = load(spark, a.corpus)
    found = gates.eligible(rows, scored(rows, a.canonical), scored(rows, a.scorer))
    show(reports.catch_lines(found, a.n))
    gates.catches_by_intent(found).orderBy("intent_id").show(100, False)
    say(gates.catch_rate(found))
    return 0


def compare(spark, a) -> int:
    rows = load(spark, a.corpus)
    diff = reports.differences(scored(rows, a.a), scored(rows, a.b))
    show(reports.compare_lines(diff, a.n))
    say(reports.compare(diff))
    return 0


def simulate(spark, a) -> int:
    rows = load(spark, a.corpus)
    base = rows.join(scored(rows, a.scorer).select("id", F.col("score").alias("baseline")), "id").withColumn("reference", F.col("score")).persist()
    cfg = config(a)
    show(reports.simulate_lines(reports.sweep(base, {"this": cfg} | ({} if a.brief else {"shipped": DEFAULT}))))
    if not a.brief:
        done = reports.with_correction(base, cfg).persist()
        say(reports.firing_rates(done))
        reports.silence_profile(done).orderBy("rate", "intent_id").show(100, False)
        keep = lambda c: gates.gate3_groups(done.withColumn("candidate", F.col(c)), True)
        reports.gate_change(keep("baseline"), keep("corrected")).show(100, False)
        show(reports.fired_lines(done, a.n))
    return 0


def explain(spark, a) -> int:
    found = reports.explain(load(spark, a.corpus), a.id, a.intent, a.miner, a.epoch, a.fired, config(a), a.n, a.text).collect()
    for r in found:
        print(f"\n{r.id}  {r.intent_id}  {r.miner_slug}  epoch {r.epoch_id}  score {r.score}")
        for c in ("question", "ground_truth", "miner_answer", "truth_numbers", "answer_numbers", "truth_idents", "answer_idents", "headline", "correction"):
            print(f"  {c}: {r[c]}")
    if not found:
        print("no rows matched")
    return 0 if found else 1


def verify(spark, a) -> int:
    rows = load(spark, a.corpus)
    rows = rows.where(F.col("pos") < a.n) if a.n else rows
    base, same = scored(rows, a.a), scored(rows, a.b)
    bits = reports.verify_bits(base, same)
    differ = bits.count()
    print(f"  scores that differ in a bit: {differ}")
    bits.orderBy("id").show(20, False)
    bounds = reports.verify_bounds(scored(rows, "projection"), scored(rows, "corrected"))
    say(bounds)
    b = bounds.first()
    plain = rows.select("id", correct.analyse_plain(F.col("ground_truth"), F.col("miner_answer")).alias("correction"))
    unlike = reports.compare_corrections(reports.with_correction(rows).select("id", "correction"), plain)
    fields = unlike.count()
    print(f"  fields of corrections in which the two implementations differ: {fields}")
    unlike.orderBy("id", "field").show(20, False)
    return int(bool(differ or b.raised or b.beyond or fields))


def registry(spark, a) -> int:
    rows = corpus.read_registry(spark, a.path)
    show(reports.registry_lines(rows))
    reports.registry_summary(rows).orderBy("status").show(20, False)
    return 0


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="answergauge", description=__doc__)
    subs = top.add_subparsers(required=True)

    def command(f, *paths: str, **options) -> None:
        p = subs.add_parser(f.__name__.rstrip("_"))
        p.set_defaults(run=f)
        for name in paths:
            p.add_argument(name)
        for name, value in options.items():
            flag = f"--{name.replace('_', '-')}"
            if isinstance(value, bool):
                p.add_argument(flag, action=argparse.BooleanOptionalAction, default=value)
            else:
                p.add_argument(flag, type=type(value), default=value)

    tuning = {"max": DEFAULT.max_correction, "w_num": DEFAULT.numeric_weight, "w_id": DEFAULT.ident_weight, "w_ref": DEFAULT.refusal_weight, "tol": DEFAULT.rel_tolerance, "max_gt": 0, "dates": False}
    command(pull, "url", "out", intent="", most=0)
    command(corpus_, "corpus", min_group=4)
    command(subset, "corpus", "out", min_group=4, per_intent=12, all=False, since=0)
    command(gate, "corpus", scorer="lexical", reference="published", pool=True, min_group=4)
    command(catch, "corpus", "canonical", scorer="corrected", n=20)
    command(compare, "corpus", "a", "b", n=20)
    command(simulate, "corpus", scorer="projection", brief=False, n=20, **tuning)
    command(explain, "corpus", id="", intent="", miner="", epoch=0, fired=False, n=10, text=300, **tuning)
    command(verify, "corpus", "a", "b", n=0)
    command(registry, "path")
    return top


def main(args: list[str] | None = None, spark: SparkSession | None = None) -> int:
    a = parser().parse_args(args)
    spark = spark or SparkSession.builder.appName("answergauge").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    return a.run(spark, a)


if __name__ == "__main__":
    sys.exit(main())
