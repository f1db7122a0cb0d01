"""Each query of the package on the smallest tables, against SQL or plain loops, with the columns of its contract."""

import hashlib
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest

from answergauge.llm import queries
from tests.llm.test_quality import brute as plain_rules
from tests.llm.test_simhash import brute_components, brute_fingerprint, near

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def texts(spark):
    return {r.doc_id: r.text for r in spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text").collect()}


@pytest.fixture(scope="module")
def ids_of(texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(queries.tokenizer_path())
    return {i: t.encode(x or "", add_special_tokens=False).ids for i, x in texts.items()}


def rows_of(spark, name, columns):
    out = queries.queries()[name](spark, FOLDER)
    assert [c for c in out.columns if c in columns] == columns or set(columns) <= set(out.columns)
    return out.collect()


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


@pytest.mark.parametrize("name", ["op2_exact_dedup", "op4_mixture", "op7_warc"])
def test_queries_with_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "pages"):
        con.execute(f"create view {t} as select * from '{FOLDER}/{t}.parquet'")
    want = con.execute(queries.oracle_sql()[name])
    names = [c[0] for c in want.description]
    got = queries.queries()[name](spark, FOLDER)
    assert sorted(got.columns) == sorted(names)
    assert sorted((tuple(r[n] for n in names) for r in got.collect()), key=str) == sorted(want.fetchall(), key=str)


def test_shards(spark, texts):
    rows = rows_of(spark, "op1_shards", ["doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"])
    assert {r.doc_id for r in rows} == set(texts) and len(rows) == len(texts)
    shard_of, slots, fill = {}, defaultdict(list), defaultdict(int)
    for r in rows:
        data = (texts[r.doc_id] or "").encode()
        assert (r["size"], r.text_crc32, r.law, r.grown_shard) == (len(data) + 1, zlib.crc32(data), "bytes", None)
        assert shard_of.setdefault(data, r.shard) == r.shard
        slots[r.shard].append(r.slot)
        fill[r.shard] += r["size"]
    assert set(fill) <= set(range(16)) and all(sorted(s) == list(range(len(s))) for s in slots.values())
    group = defaultdict(int)
    for t in texts.values():
        group[t or ""] += len((t or "").encode()) + 1
    assert max(fill.values()) <= max(sum(group.values()) / 16 + max(group.values()), max(group.values()))


def test_rules(spark, texts):
    rows = rows_of(spark, "op3_quality_rules", ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"])
    assert {r.doc_id for r in rows} == set(texts)
    for r in rows:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == plain_rules(texts[r.doc_id])
        assert not (r.kept and r.base_failed)


def test_classifier(spark, texts):
    rows = rows_of(spark, "op5_quality_classifier", ["doc_id", "expected_grade", "tail_prob", "kept"])
    assert {r.doc_id for r in rows} == set(texts) and all(r.kept == (r.tail_prob >= 0.5) for r in rows)
    good = {r.doc_id: r.quality == 1 and r.toxic == 0 for r in spark.read.parquet(f"{FOLDER}/labels.parquet").collect()}
    rated = [r for r in rows if r.doc_id in good]
    assert np.mean([r.kept == good[r.doc_id] for r in rated]) > 0.9


def test_packing(spark, ids_of):
    rows = rows_of(spark, "op6_packing", ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        ids = [*ids_of[r.doc_id], 1]
        assert r.doc_tokens == len(ids) and r.length > 0 and r.ids_crc32 == crc(ids[r.start : r.start + r.length])
        pieces[r.doc_id].append((r.start, r.length))
        sequences[r.sequence_id].append((r.offset, r.length))
    for places, end in [(p, len(ids_of[i]) + 1) for i, p in pieces.items()] + [(p, None) for p in sequences.values()]:
        at = 0
        for start, length in sorted(places):
            assert start == at
            at += length
        assert at == end if end is not None else at <= 2048
    assert set(pieces) == set(ids_of)
    total = sum(len(x) + 1 for x in ids_of.values())
    parts = spark.read.parquet(f"{FOLDER}/documents.parquet").rdd.getNumPartitions()
    assert len(sequences) <= 1.01 * total / 2048 + 2 * parts


def test_token_files(spark, ids_of):
    rows = {r.doc_id: r for r in rows_of(spark, "op8_token_files", ["doc_id", "start", "n_tokens", "ids_crc32"])}
    at = 0
    for i in sorted(ids_of):
        ids = [*ids_of[i], 0]
        assert (rows[i].start, rows[i].n_tokens, rows[i].ids_crc32) == (at, len(ids), crc(ids))
        at += len(ids)


def test_near_duplicates(spark, texts):
    rows = {r.doc_id: r for r in rows_of(spark, "op9_simhash", ["doc_id", "fingerprint", "component_id"])}
    fps = {i: brute_fingerprint(t) for i, t in texts.items()}
    assert {i: r.fingerprint for i, r in rows.items()} == {i: f"{f:016x}" for i, f in fps.items()}
    assert {i: r.component_id for i, r in rows.items()} == brute_components(fps, near(fps))


def test_dedup_by_a_plain_loop(spark, texts):
    rows = {r.doc_id: r for r in rows_of(spark, "op2_exact_dedup", ["doc_id", "keep_id", "group_size", "kept", "text_sha256"])}
    norm = {i: re.sub("[ \t-\r]+", " ", t or "") for i, t in texts.items()}
    first = {}
    for i in sorted(norm):
        first.setdefault(norm[i], i)
    for i, r in rows.items():
        assert (r.keep_id, r.kept, r.text_sha256) == (first[norm[i]], first[norm[i]] == i, hashlib.sha256(norm[i].encode()).hexdigest())
