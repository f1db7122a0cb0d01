import pytest
from pyspark.sql import functions as F

from answergauge.llm import exact_dedup, mixing, packing, quality_classifier, quality_rules, queries, sharding, simhash, store

CLASHING = "doc_id long, text string, size long, hash long, shard int, slot long, digest string, keep_id long, fp long, component_id long, source string, target double, n long, key string, u double, start long, id long, good boolean, u_ int, `a.b` string"


def test_lookup_finds_every_row(spark, monkeypatch):
    monkeypatch.setattr(store, "HEAVY_SHARE", 4)
    rows = spark.range(400).select(F.when(F.col("id") < 200, "hot").otherwise(F.concat(F.lit("k"), F.col("id") % 50)).alias("key"), "id")
    table = rows.groupBy("key").agg(F.count("*").alias("n"), F.min("id").alias("least"))
    got = store.lookup(rows, table, "key", "n", 400)
    want = rows.join(table, "key")
    assert sorted(got.select(*want.columns).collect()) == sorted(want.collect())
    assert store.lookup(rows.limit(0), table.limit(0), "key", "n", 0).count() == 0


def test_shared_folder_is_that_of_the_session(spark):
    assert store.new_path(spark, "x").startswith(spark.conf.get("spark.checkpoint.dir"))
    assert store.new_path(spark, "x") != store.new_path(spark, "x")
    df = store.cut(spark.range(5))
    assert "Scan ExistingRDD" in df._jdf.queryExecution().executedPlan().toString() and df.count() == 5


@pytest.fixture(scope="module")
def clashing(spark):
    """Documents with columns named like those that operators make, with nulls, repeats and a third of equal texts."""
    rows = []
    for i in range(90):
        text = None if i == 7 else "" if i == 8 else "same text of many" if i % 3 == 0 else f"word{i} " * (i % 11 + 1)
        rows.append((i if i != 20 else 19, text, 1, None, 3, None, "d", None, 5, None, None if i % 4 == 0 else f"s{i % 4}", 0.5, 9, None, 0.1, 3, 4, None, 1, "z"))
    rows.append((None, "no id", *([None] * 18)))
    return spark.createDataFrame(rows, CLASHING).repartition(3)


def test_clashing_names_and_nulls(spark, clashing):
    n = clashing.count()
    assert sharding.shard_documents(clashing).count() == n
    index = exact_dedup.DigestIndex(spark, store.new_path(spark, "t"), buckets=4)
    labelled = exact_dedup.label_duplicates(clashing, index)
    assert labelled.count() == n and labelled.where("group_size = 30").count() == 30
    kept = exact_dedup.drop_duplicates(clashing, exact_dedup.DigestIndex(spark, store.new_path(spark, "t"), buckets=4))
    assert kept.schema == clashing.schema and kept.count() == labelled.where("kept").count()
    assert mixing.mix(clashing).count() == n and mixing.sample(clashing).schema == clashing.schema
    assert simhash.near_duplicates(clashing).count() == n
    assert simhash.drop_near_duplicates(clashing).schema == clashing.schema
    model = quality_classifier.train(clashing, spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id long, grade int"), 2)
    assert quality_classifier.score_documents(clashing, model).count() == n
    assert quality_classifier.select_documents(clashing, model, cut=0.0).count() == n
    assert quality_rules.apply_rules(clashing, clashing.where("doc_id < 40").select("doc_id")).count() == n
    packed = packing.pack_documents(clashing, queries.tokenizer_path())
    assert packed.where("start = 0").count() == n


def test_a_very_long_text(spark):
    long = "word next " * 400_000
    docs = spark.createDataFrame([(1, long, "a"), (2, "short", "a"), (3, long.upper(), "b")], "doc_id long, text string, source string")
    assert {r.doc_id: r.component_id for r in simhash.near_duplicates(docs).collect()} == {1: 1, 2: 2, 3: 1}
    assert sum(r.length for r in packing.pack_documents(docs.where("doc_id = 1"), queries.tokenizer_path()).collect()) > 800_000
    assert {r["size"] for r in mixing.mix(docs).collect()} == {800_000, 1}
