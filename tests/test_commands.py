import json

import pytest

from answergauge.__main__ import main, scored
from answergauge.operators import rank, reports
from answergauge.sources import corpus


@pytest.fixture(scope="module")
def path(tmp_path_factory):
    rows = []
    for k in range(24):
        intent = "AB"[k % 2]
        truth = f"The total of order {k} for {intent} is ${100 + k} as of the last report."
        answer = truth if k % 3 else truth.replace(f"${100 + k}", f"${900 + k}")
        rows.append({"id": f"r{k}", "intent_id": intent, "epoch_id": k % 2, "miner_slug": f"m{k % 5}", "score": round(k / 24, 3), "question": f"What is the total of order {k}?", "ground_truth": truth, "miner_answer": answer if k != 5 else " "})
    f = tmp_path_factory.mktemp("cli") / "c.json"
    f.write_text(json.dumps({"scores": rows, "total": 24, "limit": 500, "offset": 0}))
    return str(f)


def test_commands_run(spark, path, tmp_path, capsys):
    assert main(["corpus", path], spark) == 0
    assert "blank_answers" in capsys.readouterr().out
    assert main(["subset", path, f"{tmp_path}/s", "--per-intent", "1"], spark) == 0
    assert spark.read.parquet(f"{tmp_path}/s").count() == 24
    assert main(["gate", path], spark) in (0, 1)
    out = capsys.readouterr().out
    assert "gate1" in out and "pooled" in out
    assert main(["gate", path, "--scorer", "published"], spark) in (0, 1)
    assert main(["catch", path, "projection", "--scorer", "corrected"], spark) == 0
    assert "eligible" in capsys.readouterr().out
    assert main(["compare", path, "projection", "corrected"], spark) == 0
    assert "changed" in capsys.readouterr().out
    assert main(["simulate", path, "--max", "0.15"], spark) == 0
    out = capsys.readouterr().out
    assert "shipped" in out and "note:" in out and "num(0%)" in out
    assert main(["simulate", path, "--brief"], spark) == 0
    assert main(["explain", path, "--fired", "--n", "2"], spark) == 0
    assert main(["explain", path, "--id", "nobody"], spark) == 1
    assert main(["verify", path, "projection", "projection"], spark) == 0
    assert main(["verify", path, "projection", "lexical", "--n", "3"], spark) == 1


def test_registry_command(spark, tmp_path, capsys):
    (tmp_path / "r.json").write_text(json.dumps([{"RegistrationID": 3, "ActivationStatus": "ACTIVE", "BondAmount": 1.0}]))
    assert main(["registry", f"{tmp_path}/r.json"], spark) == 0
    assert "ACTIVE" in capsys.readouterr().out


def test_corrected_scores_are_never_higher(spark, path):
    rows = corpus.read_corpus(spark, path)
    base, fixed = scored(rows, "projection"), scored(rows, "corrected")
    one = reports.verify_bounds(base, fixed).first()
    assert (one.rows, one.raised, one.beyond) == (24, 0, 0)
    assert reports.compare(reports.differences(base, fixed)).first().changed == 8
    assert {r.id: r.score for r in base.collect()}["r5"] == 0


def test_score_table_is_filled_once(spark, path, tmp_path):
    rows = corpus.read_corpus(spark, path)
    table, asked = corpus.ScoreTable(spark, f"{tmp_path}/scores"), []

    def scorer(some):
        asked.append(some.count())
        return rank.score_rounds(some)

    first = rank.score_missing(rows.where("pos < 10"), table, scorer, "h").count()
    both = rank.score_missing(rows, table, scorer, "h").count()
    assert (first, both, asked) == (10, 24, [10, 14])


def test_corrections_of_two_implementations(spark, path):
    done = reports.with_correction(corpus.read_corpus(spark, path)).select("id", "correction")
    assert reports.compare_corrections(done, done).count() == 0


def test_pages_of_any_size(spark, path, tmp_path):
    rows = corpus.read_corpus(spark, path)
    corpus.write_pages(rows, f"{tmp_path}/p", page=7)
    again = corpus.read_pages(spark, f"{tmp_path}/p", lines=True)
    assert again.orderBy("pos").collect() == rows.orderBy("pos").collect()
