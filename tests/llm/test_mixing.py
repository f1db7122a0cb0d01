import hashlib
import random
from collections import Counter, defaultdict

from answergauge.llm import mixing

SCHEMA = "doc_id long, text string, source string, size long"


def table(spark, rows):
    return spark.createDataFrame([(i, None if n is None else "w " * n, s, 1) for i, n, s in rows], SCHEMA)


def fill(sizes, weights, share, most):
    """Targets by rounds, as the rule says them."""
    full, goal, left = set(), {}, share * sum(sizes.values())
    while True:
        rest = {s: w for s, w in weights.items() if s not in full}
        goal = {s: left * w / sum(rest.values()) for s, w in rest.items()}
        over = [s for s in rest if goal[s] > most * sizes[s]]
        if not over:
            return goal | {s: most * sizes[s] for s in full}
        full |= set(over)
        left -= sum(most * sizes[s] for s in over)


def test_targets_equal_the_rounds(spark):
    sizes = {"B": 100, "a": 4000, "é": 10, "z": 0, "c": 900, None: 2500, "b": 70}
    frame = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
    got = {r.source: r.target for r in mixing.targets(frame).collect()}
    names = sorted((s for s in sizes if s), key=str) + [None]
    want = fill(sizes, {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}, 1.5, 2)
    assert set(got) == set(want) and all(abs(got[s] - want[s]) < 1e-6 for s in want)


def test_taken_is_near_target_and_agrees_between_runs(spark, monkeypatch):
    monkeypatch.setattr(mixing, "CELLS", 8)
    rows = [(i, i % 37 + 1, "ab"[i % 3 == 0]) for i in range(900)] + [(1000, None, None), (1001, 0, "c"), (1002, 5, "c"), (1002, 5, "c")]
    docs = table(spark, rows)
    got = mixing.mix(docs).collect()
    assert len(got) == len(rows)
    assert sorted(map(tuple, got), key=str) == sorted(map(tuple, mixing.mix(docs.repartition(7)).collect()), key=str)
    taken, goal, largest = defaultdict(int), {}, defaultdict(int)
    for r in got:
        assert r.taken == r.copies * r["size"] <= 2 * r["size"]
        taken[r.source] += r.taken
        goal[r.source] = r.target
        largest[r.source] = max(largest[r.source], r["size"])
    assert all(abs(taken[s] - goal[s]) <= largest[s] / 2 + 1e-6 for s in goal)


def test_sample_has_each_row_as_often_as_it_is_taken(spark):
    rows = [(i, i % 11, "ab"[i % 4 == 0]) for i in range(200)] + [(7, 7, "b"), (7, 7, "b")]
    docs = table(spark, rows)
    want = Counter()
    for r in mixing.mix(docs).collect():
        want[r.doc_id, r["size"]] += r.copies
    out = mixing.sample(docs)
    assert out.columns == docs.columns
    got = Counter((r.doc_id, len(r.text.split())) for r in out.collect())
    assert got == +want


def expected(rows, target):
    """Expected copies by rounds: those that would be over 2 stop there, the others share what is left. rows: (size, weight)."""
    full = set()
    while True:
        rest = [k for k in range(len(rows)) if k not in full]
        weighted = sum(rows[k][0] * rows[k][1] for k in rest)
        rate = (target - 2 * sum(rows[k][0] for k in full)) / weighted if weighted else 0
        over = [k for k in rest if rate * rows[k][1] > 2]
        if not over:
            return [2 if k in full else rate * rows[k][1] for k in range(len(rows))]
        full |= set(over)


def test_rates_equal_the_rounds(spark):
    rng = random.Random(4)
    levels = {k: [(rng.randint(1, 500), w) for w in rng.sample(range(1, 200), 9)] for k in "abcd"}
    goals = {k: f * sum(n for n, _ in levels[k]) for k, f in zip("abcd", (0.3, 1.0, 1.7, 2.0), strict=True)}
    frame = spark.createDataFrame([(k, w, n, goals[k]) for k in levels for n, w in levels[k]], "key string, w long, level_size long, target double")
    got = {r.key: r.rate for r in mixing.rates(frame).collect()}
    for k in "abc":
        want = expected(levels[k], goals[k])
        assert all(abs(min(2, got[k] * w) - e) < 1e-9 for (_, w), e in zip(levels[k], want, strict=True))
    assert got["d"] is None or all(got["d"] * w >= 2 - 1e-9 for _, w in levels["d"])


def test_taken_words_follow_the_pareto_ranks(spark):
    """The whole draw of one source by a plain loop."""
    rows = [(i, i % 451, "a") for i in range(700)] + [(1000 + i, 10, "b") for i in range(50)]
    got = {r.doc_id: r for r in mixing.mix(table(spark, rows), weights=(1, 3)).collect()}
    mine = [(i, n) for i, n, s in rows if s == "a"]
    weigh = lambda n: int(min(2, max(0.5, n / 200)) * 16 + 0.5)
    e = expected([(n, weigh(n)) for _, n in mine], got[0].target)
    ranks, need = [], got[0].target
    for (i, n), x in zip(mine, e, strict=True):
        need -= int(x) * n
        u = (int(hashlib.md5(f"mix{i}".encode()).hexdigest()[:13], 16) + 0.5) / (1 << 52)
        p = x - int(x)
        if p > 0:
            ranks.append(((u / (1 - u)) / (p / (1 - p)), i, n))
    want, upto = {i: int(x) for (i, _), x in zip(mine, e, strict=True)}, 0
    for _, i, n in sorted(ranks):
        upto += n
        want[i] += upto - n / 2 <= need
    assert {i: got[i].copies for i, _ in mine} == want
    assert len({round(x, 6) for x in e}) > 10  # inclusion differs from document to document


def test_sample_keeps_columns_of_any_name(spark):
    names = "doc_id long, text string, source string, `a.b` long, `__n` string, key long, row long, copies string, take int"
    rows = [(i if i % 5 else None, f"t{i % 3} u", "s", i % 2, "n", i, None, "c", 4) for i in range(60)] + [(3, "t0 u", "s", 1, "n", 3, None, "c", 4)] * 20
    docs = spark.createDataFrame(rows, names)
    out = mixing.sample(docs, share=1.3)
    assert out.schema == docs.schema
    plan = Counter()
    for r in mixing.mix(docs, share=1.3).collect():
        plan[r.doc_id, r["size"]] += r.copies
    got = out.collect()
    assert Counter((r.doc_id, len(r.text.split())) for r in got) == +plan
    assert set(map(tuple, got)) <= set(rows) and max(Counter(map(tuple, got)).values()) <= 2 * 21


def test_empty_table(spark):
    assert mixing.mix(table(spark, [])).count() == 0
    assert mixing.sample(table(spark, [])).count() == 0


def test_weights_of_documents(spark):
    """Expected copies follow the weights within a source; the source still gets its target."""
    rows = [(i, 10, "a", [0.5, 1.0, 2.0][i % 3]) for i in range(900)] + [(1000, 10, "a", None), (1001, 10, "a", -1.0), (1002, 7, "b", 0.0)]
    docs = spark.createDataFrame([(i, "w " * n, s, w) for i, n, s, w in rows], "doc_id long, text string, source string, score double")
    got = {r.doc_id: r for r in mixing.mix(docs, weights=(1, 1), weight=docs.score).collect()}
    copies = [sum(got[i].copies for i in range(k, 900, 3)) / 300 for k in range(3)]
    assert copies[0] < 0.75 * copies[1] and copies[1] < 0.75 * copies[2] + 0.3 and all(r.copies <= 2 for r in got.values())
    assert got[1000].copies == got[1001].copies == got[1002].copies == 0
    assert abs(sum(r.taken for r in got.values() if r.source == "a") - got[0].target) <= 5
