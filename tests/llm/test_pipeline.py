import random
import re
from collections import Counter

import pytest

import corpus_pipeline
from answergauge.llm import mixing, quality_classifier, queries
from tests.llm.test_simhash import brute_components, brute_fingerprint, near


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Documents of three sources: prose, junk, copies and near copies, and ratings of some."""
    rng = random.Random(7)
    words = [f"w{i}" for i in range(400)]
    rows = []
    for i in range(240):
        text = rng.choices(words, k=rng.randint(30, 200))
        rows.append((i, " ".join(w + "&&&" if i % 8 == 0 else w for w in text), "en", f"s{i % 3}", 0))
    for i in range(240, 270):
        k = (i - 240) * 7 + 1
        text = rows[k][1]
        if i % 2:
            text = text.replace(" ", "\n ", 3)  # a copy but for white space
        else:
            first, _, rest = text.partition(" ")
            text = f"{first.upper()} {rest}"  # a copy but for case
        rows.append((i, text, "en", rows[k][3], 0))
    path = str(tmp_path_factory.mktemp("corpus"))
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{path}/documents.parquet")
    labels = [(i, int(i % 8 != 0), 0) for i in range(200)] + [(i, 1, 1) for i in range(2, 3)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return path


def test_each_stage(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, seen = docs.columns, []
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, folder)
        rows = out.collect()
        if name != "packing":
            assert out.columns == columns, name
            docs = spark.createDataFrame(rows, out.schema)
        seen.append((name, rows))
    by = dict(seen)
    kept = {r.doc_id for r in by["quality classifier"]}
    assert len([i for i in range(240) if i % 8 == 0 and i in kept]) <= 2 and len([i for i in range(240) if i % 8 and i in kept]) >= 200
    # exact dedup: the smallest id of each text, white space aside
    least = {}
    for r in by["quality classifier"]:
        least[" ".join(r.text.split())] = min(r.doc_id, least.get(" ".join(r.text.split()), r.doc_id))
    assert {r.doc_id for r in by["exact dedup"]} == set(least.values())
    # near copies: case apart, what is left are the first 240
    lower = {}
    for r in by["exact dedup"]:
        key = " ".join(r.text.lower().split())
        lower[key] = min(r.doc_id, lower.get(key, r.doc_id))
    assert {r.doc_id for r in by["SimHash near-dedup"]} == set(lower.values())
    # the mix takes what its plan says
    want = Counter()
    for r in mixing.mix(spark.createDataFrame(by["SimHash near-dedup"])).collect():
        want[r.doc_id] += r.copies
    assert Counter(r.doc_id for r in by["mixing sources"]) == +want
    # packing covers all tokens
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(queries.tokenizer_path())
    total = sum(len(t.encode(r.text, add_special_tokens=False).ids) + 1 for r in by["mixing sources"])
    assert sum(r.length for r in by["packing"]) == total


def test_every_row_is_accounted_for(spark, tmp_path):
    """Null ids, repeated ids with other texts, repeated rows, and columns of any names, stage by stage against plain loops."""
    rng = random.Random(3)
    words = [f"w{i}" for i in range(300)]
    rows = []
    for i in range(120):
        text = " ".join(rng.choices(words, k=rng.randint(40, 160)))
        rows.append((i if i % 10 else None, text, f"s{i % 2}" if i % 9 else None, i, "n", i))
        if i % 6 == 0:
            rows.append((rows[-1][0], text.replace(" ", "\t", 2), *rows[-1][2:]))  # the same id, a copy
        if i % 8 == 0:
            rows.append((i - 1 if i else 0, " ".join(rng.choices(words, k=60)), *rows[-1][2:]))  # a used id, another text
        if i % 7 == 0:
            rows.append((rows[-1][0], rows[-1][1].upper(), *rows[-1][2:]))  # a near copy
        if i % 11 == 0:
            rows.append(rows[-1])
    rows += [(500, None, "s1", 0, "n", 1), (501, "", None, 0, None, 1), (None, None, None, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, `a.b` long, __n string, row long").repartition(3)
    spark.createDataFrame([(i, 1, 0) for i in range(40)] + [(500, 0, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    stages = dict(corpus_pipeline.STAGES)
    pair = lambda r: (r[0], r[1])
    kept = quality_classifier.score_documents(docs, quality_classifier.train(docs, quality_classifier.grades_of_labels(spark.read.parquet(f"{tmp_path}/labels.parquet")), 3)).where("kept")
    out = stages["quality classifier"](spark, docs, str(tmp_path))
    assert out.schema == docs.schema and Counter(r.doc_id for r in out.collect()) == Counter(r.doc_id for r in kept.collect())
    # exact dedup, of all rows
    out = stages["exact dedup"](spark, docs, str(tmp_path))
    least = {}
    for r in rows:
        key = re.sub("[ \t-\r]+", " ", r[1] or "")
        ids = [x for x in (r[0], least.get(key)) if x is not None]
        least[key] = min(ids, default=None)
    got = out.collect()
    assert out.schema == docs.schema and set(map(tuple, got)) <= set(rows)
    assert sorted((re.sub("[ \t-\r]+", " ", r.text or ""), r.doc_id) for r in got) == sorted(least.items())
    # near-dedup, of all rows: one of each component of fingerprints, by id, then fingerprint
    out = stages["SimHash near-dedup"](spark, docs, str(tmp_path))
    fps = {r[1]: brute_fingerprint(r[1]) for r in rows}
    nodes = {f: f for f in fps.values()}
    root = brute_components(nodes, near(nodes))
    groups = {}
    for r in rows:
        signed = fps[r[1]] - (1 << 64) if fps[r[1]] >> 63 else fps[r[1]]
        groups.setdefault(root[fps[r[1]]], []).append((r[0] is None, r[0] or 0, signed))
    got = out.collect()
    assert out.schema == docs.schema and set(map(tuple, got)) <= set(rows) and len(got) == len(groups)
    assert sorted((r.doc_id is None, r.doc_id or 0, fps[r.text]) for r in got) == sorted((a, i, f % (1 << 64)) for a, i, f in map(min, groups.values()))
    # the mix, and packing, of all rows
    out = stages["mixing sources"](spark, docs, str(tmp_path))
    want = Counter()
    for r in mixing.mix(docs).collect():
        want[r.doc_id, r["size"]] += r.copies
    got = out.collect()
    assert out.schema == docs.schema and set(map(tuple, got)) <= set(rows)
    assert Counter((r.doc_id, len((r.text or "").split())) for r in got) == +want
    packed = stages["packing"](spark, docs, str(tmp_path)).collect()
    assert Counter(r.doc_id for r in packed if r.start == 0) == Counter(r[0] for r in rows)


def test_run(spark, folder):
    out = corpus_pipeline.run(spark, folder)
    again = corpus_pipeline.run(spark, folder)
    key = lambda r: (r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens)
    pieces = lambda rows: Counter((r.doc_id, r.doc_tokens) for r in rows if r.start == 0)
    a, b = out.collect(), again.collect()
    assert pieces(a) == pieces(b) and sum(r.length for r in a) == sum(r.length for r in b) and all(key(r) for r in a)


def test_without_ratings_all_documents_go_on(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    assert quality_classifier.select_documents(docs, None).count() == docs.count()
