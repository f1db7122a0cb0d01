import hashlib
import re

from pyspark.sql import functions as F

from answergauge.llm import exact_dedup, store

SCHEMA = "doc_id long, text string, digest string"


def index_of(spark):
    return exact_dedup.DigestIndex(spark, store.new_path(spark, "test"), buckets=4)


def brute(rows):
    norm = [re.sub("[ \t-\r]+", " ", t or "") for _, t in rows]
    groups = {}
    for (i, _), n in zip(rows, norm, strict=True):
        groups.setdefault(n, []).append(i)
    out, seen = [], set()
    for (i, _), n in zip(rows, norm, strict=True):
        ids = [x for x in groups[n] if x is not None]
        keep = min(ids) if ids else None
        out.append((i, keep, len(groups[n]), i == keep and (n, i) not in seen, hashlib.sha256(n.encode()).hexdigest()))
        seen.add((n, i))
    return sorted(out, key=str)


def test_labels_equal_brute_force(spark):
    rows = [(7, "a b"), (3, "a \t\n b"), (3, "a b"), (9, None), (8, ""), (5, "  "), (4, " "), (None, "z"), (12, "z"), (11, "é" * 9000), (13, "a  b ")]
    rows += [(100 + i, f"t {i % 5}") for i in range(60)]
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], SCHEMA)
    got = exact_dedup.label_duplicates(docs, index_of(spark)).collect()
    assert sorted((tuple(r) for r in got), key=str) == brute(rows)


def test_index_persists_and_later_batches_are_compared_with_it(spark):
    index = index_of(spark)
    first = spark.createDataFrame([(1, "a", "x"), (2, "b", "y")], SCHEMA)
    second = spark.createDataFrame([(0, "a", "x"), (3, "c", "y"), (4, "c", "z")], SCHEMA)
    assert [tuple(r) for r in exact_dedup.drop_duplicates(first, index).orderBy("doc_id").collect()] == [(1, "a", "x"), (2, "b", "y")]
    again = exact_dedup.DigestIndex(spark, index.path, buckets=4)  # opened from its folder
    assert [tuple(r) for r in exact_dedup.drop_duplicates(second, again).collect()] == [(3, "c", "y")]
    assert again.table().count() == 3
    assert exact_dedup.drop_duplicates(first, again).count() == 2  # the same batch again finds its own rows
    assert again.table().count() == 3


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_index_join_uses_its_buckets(spark):
    index = index_of(spark)
    index.add(spark.createDataFrame([(1, "a", "x")], SCHEMA))
    batch = spark.createDataFrame([(1, "a", "x")], SCHEMA).select(exact_dedup.digest_of(F.col("text")).alias("digest"))
    with index.ordered() as known:
        plan = plan_of(batch.join(known.hint("merge"), "digest", "left_anti"))
    assert "SortMergeJoin" in plan and "Bucketed: true" in plan
    assert plan.count("Exchange hashpartitioning") == 1 and plan.count("Sort [") == 1  # the batch's alone


def test_three_appends_and_a_rewrite(spark, monkeypatch):
    """After the rewrite each bucket is one sorted file, so the join sorts nothing of the index; a cut-off rewrite doesn't count."""
    monkeypatch.setattr(exact_dedup, "FILES", 3)
    index = index_of(spark)
    batches = [spark.createDataFrame([(100 * k + i, f"t{k}.{i}", "x") for i in range(50)] + [(7, "t0.0", "y")], SCHEMA) for k in range(5)]
    for k, docs in enumerate(batches):
        kept = exact_dedup.drop_duplicates(docs, index)
        assert kept.count() == 50
        assert index.table().count() == 50 * (k + 1)
    assert index.number == 2 and index._appends() <= 2  # written anew after the fourth
    index.compact()
    assert index.number == 3 and index._appends() == 1 and index.table().count() == 250
    spark.range(1).write.parquet(f"{index.path}/00000009-4")
    (index.files.delete(spark._jvm.org.apache.hadoop.fs.Path(f"{index.path}/00000009-4/_SUCCESS"), False))
    index.close()
    again = exact_dedup.DigestIndex(spark, index.path)
    assert (again.number, again.buckets) == (3, 4)
    with again.ordered() as known:
        plan = plan_of(batches[0].select(exact_dedup.digest_of(F.col("text")).alias("digest")).join(known.hint("merge"), "digest", "left_anti"))
    assert "Bucketed: true" in plan and plan.count("Sort [") == 1
    assert exact_dedup.drop_duplicates(batches[3], again).count() == 50
    again.close()


def test_a_bucket_is_one_file_however_many_tasks_write(spark, monkeypatch):
    frame = type(spark.range(0))
    dealt = frame.repartition
    rows = [(i, f"text {i % 150}") for i in range(200)]
    for tasks in (11, 4):
        with monkeypatch.context() as m:
            m.setattr(frame, "repartition", lambda self, n, *cols, tasks=tasks: dealt(self, max(tasks, n), *cols))
            index = index_of(spark)
            kept = exact_dedup.drop_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), index)
            assert sorted(r.doc_id for r in kept.collect()) == list(range(150))
            assert index.number == 1 and len(index.table().inputFiles()) == 4 and index._appends() == 1
            index.compact()
            assert len(index.table().inputFiles()) == 4 and index.table().count() == 150
            if tasks == 4:  # each task has one bucket, its own
                seats = index.table().repartition(4, index._seat()).select(F.spark_partition_id().alias("task"), F.pmod(F.hash("digest"), F.lit(4)).alias("bucket"))
                assert {(r.task, r.bucket) for r in seats.distinct().collect()} == {(k, k) for k in range(4)}
            index.close()


def test_buckets_grow_with_the_rows():
    assert exact_dedup.buckets_for(0) == exact_dedup.buckets_for(10**6) == 64
    for rows in (10**9, 10**11):
        assert rows / exact_dedup.PER_BUCKET <= exact_dedup.buckets_for(rows) < 2 * rows / exact_dedup.PER_BUCKET + 64


def test_columns_of_any_name_stay(spark):
    rows = [(1, "a", "x", 1, "k"), (1, "a", "x", 1, "k"), (2, "a", "y", 2, "k"), (None, "b", "z", 3, "k"), (None, "b", "z", 3, "k")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, `__digest` string, `a.b` long, key string")
    kept = exact_dedup.drop_duplicates(docs, index_of(spark))
    assert plan_of(kept).count("Exchange hashpartitioning") == 2  # the rows once, and the keys
    assert kept.schema == docs.schema and sorted(map(tuple, kept.collect()), key=str) == sorted([rows[0], rows[3]], key=str)


def test_empty_table(spark):
    assert exact_dedup.label_duplicates(spark.createDataFrame([], SCHEMA), index_of(spark)).count() == 0
