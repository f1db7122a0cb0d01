import random
import re

import numpy as np
import pyarrow as pa
import pytest

from answergauge.llm import quality_classifier, quality_rules, text_block

SCHEMA = "doc_id long, text string, score string"
TEXTS = [
    "", None, " \n\t", "a b c a b c d", "x x x x x", "é\x0bà #$\n\né\x0bà #$\nb\x85c", "a\nb\na\n \n \nb\r\nb", "one", "x|y <b>&%*", "l1 w\nl2\nl1 w\nl1 w \nl2", "日本 語\n日本 語",
]


_MORSE = ["".join(two[bin(i).count("1") & 1] for i in range(1024)) for two in ("ab", "ba")]
#: Words and lines that a polynomial hash modulo a power of two takes for equal.
TEXTS += ["\n".join(_MORSE), " ".join([*_MORSE, "x", _MORSE[1], _MORSE[0], "x"]), " ".join(_MORSE * 3), f"{_MORSE[0]} a\n{_MORSE[1]} a\n{_MORSE[0]} a"]


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines, seen, dup = text.split("\n"), set(), 0
    for x in lines:
        if re.search(r"[^\x20\x09-\x0D]", x):
            dup += x in seen
            seen.add(x)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    covered = {k for i, w in enumerate(windows) if windows.count(w) > 1 for k in range(i, i + 3)}
    failed = len(words) < 50 or 100 * len(covered) > 50 * len(words)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered), failed


def corpus():
    rng = random.Random(1)
    words = [f"w{i}" for i in range(80)]
    texts = TEXTS + [" ".join(rng.choices(words[:5], k=rng.randint(1, 90))) for _ in range(20)]
    return texts + [" ".join(w + rng.choice(["", "", "###"][k % 2 :]) for w in rng.choices(words, k=70)) for k in range(40)]


@pytest.mark.parametrize("size", [1, 40, 2 << 20])
def test_base_rules_equal_brute_force(spark, size, monkeypatch):
    monkeypatch.setattr(text_block, "BYTES", size)
    texts = corpus()
    ratios = np.zeros(1 << quality_rules.BITS, np.float32)
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts, pa.string())], names=["doc_id", "text"])
    (out,) = quality_rules._scored(ratios)(iter([batch]))
    assert [tuple(r.values())[1:6] for r in out.to_pylist()] == [brute(t)[:5] for t in texts]


def test_base_rules_where_hashes_collide(monkeypatch):
    monkeypatch.setattr(text_block, "mixed", lambda x: np.zeros_like(x))
    rng = random.Random(5)
    texts = TEXTS + [" ".join(rng.choices(["longword" + c for c in "abc"] + ["\n", "x"], k=60)) for _ in range(10)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts, pa.string())], names=["doc_id", "text"])
    (out,) = quality_rules._scored(np.zeros(1 << quality_rules.BITS, np.float32))(iter([batch]))
    assert [tuple(r.values())[1:6] for r in out.to_pylist()] == [brute(t)[:5] for t in texts]


def test_verdict_follows_the_likelihood_ratio(spark):
    rng = random.Random(2)
    words = [f"w{i}" for i in range(60)]
    rows = [(i, " ".join(w + "###" * (i % 3 == 0) for w in rng.choices(words, k=80)), "x") for i in range(150)] + [(500 + i, t, None) for i, t in enumerate(TEXTS)]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    trusted = spark.createDataFrame([(i,) for i in range(1, 150) if i % 3 and i < 90] + [(None,), (9999,)], "doc_id long")
    got = {r.doc_id: r for r in quality_rules.apply_rules(docs, trusted).collect()}
    assert len(got) == len(rows)
    assert all(got[i].kept == bool(i % 3) for i in range(150))
    # the score, from counts by a plain loop
    counts, good = {}, {}
    chosen = {r.doc_id for r in trusted.collect()}
    grams = lambda t: [(w,) for w in (t or "").split()] + list(zip((t or "").split(), (t or "").split()[1:], strict=False))
    for i, t, _ in rows:
        if i < 500:
            for g in grams(t):
                counts[g] = counts.get(g, 0) + 1
                good[g] = good.get(g, 0) + (i in chosen)
    extra = sum(len(grams(t)) for i, t, _ in rows if i >= 500)
    scale = (sum(counts.values()) + extra) / sum(good.values())
    ratio = {g: np.log(good[g] * scale + 1) - np.log(counts[g] + 1) for g in counts}
    off = [abs(got[i].score - np.mean([ratio[g] for g in grams(t)])) for i, t, _ in rows[:150]]
    assert np.median(off) < 0.02 and max(off) < 0.2  # some pairs of words share a bucket


def test_all_trusted_documents_count(spark):
    docs = spark.range(60_000).selectExpr("id as doc_id", "concat('u', id % 1000) as text")
    trusted = docs.select("doc_id")
    assert not quality_rules.log_ratios(docs, trusted).any()  # the two corpora are one
    # rows of a frequent id count each, rows without an id only as raw
    docs = spark.createDataFrame([(1, "a")] * 30 + [(2, "b")] * 10 + [(None, "c")] * 20, "doc_id long, text string")
    found = quality_rules.log_ratios(docs, trusted.where("doc_id = 1").unionByName(spark.createDataFrame([(None,)], "doc_id long")))
    want = sorted([np.log(61) - np.log(31), -np.log(11), -np.log(21)])
    assert np.allclose(sorted(found[found != 0]), want)


@pytest.mark.parametrize("bits", [15, 17, 26])
def test_the_bitmap_leaves_out_no_trusted_document(spark, bits, monkeypatch):
    monkeypatch.setattr(quality_rules, "MAP_BITS", bits)
    rows = spark.range(40_000).selectExpr("id * 7 as id", "'t' as text")
    ids = spark.range(3_000).selectExpr("id * 14 as id")
    left = quality_rules._maybe(rows, ids)
    assert left.columns == rows.columns and left.join(ids, "id", "left_semi").count() == 3_000
    n = left.count()
    assert n < 3_000 + 37_000 * (1.2 * 3_000 / (1 << bits) + 0.002)


def test_without_trusted_documents_the_base_rules_decide(spark):
    docs = spark.createDataFrame([(1, " ".join(map(str, range(60))), "x"), (2, "a", "y")], SCHEMA)
    none = spark.createDataFrame([], "doc_id long")
    assert {r.doc_id: (r.kept, r.score) for r in quality_rules.apply_rules(docs, none).collect()} == {1: (True, 0.0), 2: (False, 0.0)}
    assert quality_rules.apply_rules(docs.limit(0), none).count() == 0


def rated(rng, n):
    """Documents of three grades by the words in them, a tenth of the ratings wrong."""
    fill = [f"w{i}" for i in range(200)]
    rows = []
    for i in range(n):
        grade = rng.choice([0, 1, 2, 2, 2])
        words = rng.choices(fill, k=rng.randint(5, 150))
        if grade == 0:
            words = [w + "&&&" for w in words]
        if grade == 1:
            for k in range(0, len(words), 12):
                words[k] = rng.choice(["badword", "worseword"])
        rows.append((i, " ".join(words), grade))
    return rows


def test_classifier_on_held_out_documents(spark):
    rng = random.Random(4)
    rows = rated(rng, 1500)
    docs = spark.createDataFrame([(i, t, "x") for i, t, _ in rows] + [(2000, None, "y"), (2001, "", "y")], SCHEMA)
    ratings = spark.createDataFrame([(i, g if rng.random() > 0.1 else rng.randint(0, 2)) for i, _, g in rows if i < 900] + [(None, 1), (3, None), (9999, 2), (5, 7)], "doc_id long, grade int")
    model = quality_classifier.train(docs, ratings, 3)
    assert (np.diff(model.thresholds) >= 0).all()
    got = {r.doc_id: r for r in quality_classifier.score_documents(docs, model).collect()}
    assert len(got) == len(rows) + 2 and all(0 <= r.expected_grade <= 2 and r.tail_prob <= r.expected_grade / 2 + 1e-9 for r in got.values())
    held = [(g, got[i]) for i, _, g in rows if i >= 900]
    assert np.mean([r.kept == (g == 2) for g, r in held]) > 0.93
    assert np.mean([round(r.expected_grade) == g for g, r in held]) > 0.9
    again = quality_classifier.train(docs.repartition(5), ratings, 3)
    assert (again.weights == model.weights).all() and (again.thresholds == model.thresholds).all()
    odd = docs.withColumnRenamed("x", "a.b") if "x" in docs.columns else docs.withColumnRenamed("score", "a.b")
    assert quality_classifier.select_documents(odd, model).schema == odd.schema
    kept = quality_classifier.select_documents(docs, model)
    assert kept.schema == docs.schema and {r.doc_id for r in kept.collect()} == {i for i, r in got.items() if r.kept}


def plain_features(text):
    """Features by a plain loop: named instead of hashed."""
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    found = {}
    for k, word in enumerate(words):
        for name in (("word", word), ("tail", word.encode()[-3:])):
            found[name] = found.get(name, 0) + 1
        if k and words[k - 1] == word:
            found["again"] = found.get("again", 0) + 1
    out = {name: (n / len(words)) ** 0.5 for name, n in found.items()}
    return out | {("length", min(int(np.log2(1 + len(words))), 20)): quality_classifier.LENGTH}


def test_features_and_scores_equal_plain_loops(monkeypatch):
    """Scores of a random model by dictionaries of named features; few texts, so hardly two names share a bucket."""
    rng = random.Random(6)
    texts = TEXTS + [" ".join(rng.choices(["a", "b", "ab ab", "longerword", "é" * 5, "x"], k=rng.randint(1, 30))) for _ in range(30)]
    (found,) = [quality_classifier.features(b) for _, _, b in text_block.blocks(pa.array(texts, pa.string()))]
    text, bucket, value = found
    of_name = {}
    for i, t in enumerate(texts):
        mine = dict(zip(bucket[text == i].tolist(), value[text == i].tolist(), strict=True))
        want = plain_features(t)
        assert np.allclose(sorted(mine.values()), sorted(want.values()))
        for b, v in mine.items():
            of_name.setdefault(b, set()).add(frozenset(n for n, x in want.items() if abs(x - v) < 1e-9))
    names = {b: frozenset.intersection(*s) for b, s in of_name.items()}
    assert all(names.values())  # each bucket is one name throughout
    weights = np.random.default_rng(1).normal(size=1 << quality_classifier.BITS).astype(np.float32)
    model = quality_classifier.Model(weights, np.array([-0.4, 0.9]))
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts, pa.string())], names=["doc_id", "text"])
    (out,) = quality_classifier._scored(model)(iter([batch]))
    for i, r in enumerate(out.to_pylist()):
        score = sum(v * weights[b] for b, v in zip(bucket[text == i], value[text == i], strict=True))
        tails = [1 / (1 + np.exp(-(score - c))) for c in model.thresholds]
        assert abs(r["expected_grade"] - sum(tails)) < 1e-6 and abs(r["tail_prob"] - tails[1]) < 1e-6


def test_fit_follows_the_slope_of_the_likelihood():
    """At the end of the fit no small change of a weight or threshold makes the ratings much more likely."""
    rng = np.random.default_rng(0)
    n = 200
    x = rng.normal(size=n)
    grade = np.digitize(x + 0.3 * rng.logistic(size=n), [-0.7, 0.4])
    model = quality_classifier.fit(np.arange(n), np.full(n, 3), x, grade, np.full(n, 1 / n), 3)

    def loss(w, cuts):
        below = np.vstack([np.zeros(n), 1 / (1 + np.exp(-(cuts[:, None] - w * x))), np.ones(n)])
        return -np.log(below[grade + 1, np.arange(n)] - below[grade, np.arange(n)]).mean()

    w, cuts = float(model.weights[3]), model.thresholds
    here = loss(w, cuts)
    for d in (-0.05, 0.05):
        assert loss(w + d, cuts) > here - 1e-3
        assert all(loss(w, cuts + d * e) > here - 1e-3 for e in np.eye(2))


def test_no_ratings_and_no_documents(spark):
    docs = spark.createDataFrame([(1, "a", "x")], SCHEMA)
    none = spark.createDataFrame([], "doc_id long, grade int")
    assert quality_classifier.train(docs, none, 3) is None
    assert [tuple(r) for r in quality_classifier.score_documents(docs, None).collect()] == [(1, None, None, True)]
    model = quality_classifier.Model(np.zeros(1 << quality_classifier.BITS, np.float32), np.array([-1.0, 1.0]))
    assert quality_classifier.score_documents(docs.limit(0), model).count() == 0
    labels = spark.createDataFrame([(1, 0, 1), (2, 1, 1), (3, 1, 0), (4, None, 0), (5, 1, None)], "doc_id long, quality int, toxic int")
    assert [r.grade for r in quality_classifier.grades_of_labels(labels).orderBy("doc_id").collect()] == [0, 1, 2, None, None]
