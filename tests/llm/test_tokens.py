import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

from answergauge.llm import packing, queries, text_block, token_store, tokens

SCHEMA = "doc_id long, text string, ids string"
TEXTS = [
    "", None, " ", "  a  b \n c", " x", "\n\n y  ", "a\x1c b", "a\x85 b", "a b  　c", "don't   's 't n't's", "<|endoftext|> x", "a\t b \t c", "\n \n x", "z" * 9000, "é" * 300 + " ß", "日本 語 日本", "a ́b ²3 ½x", "Hello, world! It's 12 o'clock."
]


@pytest.fixture(scope="module")
def plain():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(queries.tokenizer_path())
    return lambda text: t.encode(text or "", add_special_tokens=False).ids


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def encoded(encoder, texts):
    out = []
    for _, _, block in text_block.blocks(pa.array(texts, pa.string())):
        ids, bounds = encoder.encode(block)
        out += [ids[bounds[k] : bounds[k + 1]].tolist() for k in range(block.n)]
    return out


def thue_morse(n):
    """A word over a and b, and its complement: any polynomial hash modulo a power of two takes the two for one."""
    bits = [bin(i).count("1") & 1 for i in range(n)]
    return "".join("ab"[b] for b in bits), "".join("ba"[b] for b in bits)


def test_pieces_are_told_apart_by_their_bytes(plain, monkeypatch):
    s, t = thue_morse(1024)
    texts = [f"{s}\n{t}", s, t, f"{s}1{t}", f"x {t} {s}"]
    assert encoded(tokens.PieceEncoder(queries.tokenizer_path()), texts) == [plain(x) for x in texts]
    # and if all hashes of longer pieces were one
    monkeypatch.setattr(text_block, "mixed", lambda x: np.zeros_like(x))
    monkeypatch.setattr(tokens, "mixed", lambda x: np.zeros_like(x))
    rng = random.Random(8)
    texts += ["".join(rng.choices("abc1 ", weights=[9, 9, 9, 1, 1], k=400)) for _ in range(20)] + ["sameverylongword " * 3]
    assert encoded(tokens.PieceEncoder(queries.tokenizer_path()), texts) == [plain(x) for x in texts]


def test_strings_of_the_tokenizers_own_tokens(plain):
    rng = random.Random(9)
    texts = ["".join(rng.choices(["<|endoftext|>", "<|endoftext|", "|>", " ", "  ", "a", "\n", "é", "'s"], k=rng.randint(1, 12))) for _ in range(500)]
    texts += ["<|endof", "text|>", "<|endoftext|><|endoftext|>"]
    assert plain("<|endoftext|> x") == [50256, 2124]
    assert encoded(tokens.PieceEncoder(queries.tokenizer_path()), texts) == [plain(x) for x in texts]
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(queries.tokenizer_path())
    t.encode_special_tokens = True
    assert encoded(tokens.PieceEncoder(queries.tokenizer_path(), plain=True), texts) == [t.encode(x, add_special_tokens=False).ids for x in texts]


@pytest.mark.parametrize("kept", [3, 400_000])
@pytest.mark.parametrize("size", [1, 60, 2 << 20])
def test_pieces_give_the_ids_of_the_text(plain, kept, size, monkeypatch):
    monkeypatch.setattr(tokens, "KEPT", kept)
    monkeypatch.setattr(text_block, "BYTES", size)
    rng = random.Random(size)
    marks = [*"ab'sZ09 .,-#\n\t\r", "é", "×", "÷", "…", "’", "\u2009", "\u00a0", "\u3000", "\u2028", "日", "œ", "\x1c", "\x85", "²", "\u0301", "'s", "'ll", "  ", "\n\n", " \n", "😀"]
    texts = TEXTS * 2 + [" ".join(t or "" for t in TEXTS)] + ["".join(rng.choices(marks, k=rng.randint(0, 30))) for _ in range(2000)]
    assert encoded(tokens.PieceEncoder(queries.tokenizer_path()), texts) == [plain(t) for t in texts]


def test_difference_is_near_equal():
    rng = np.random.default_rng(1)
    for n, k in ((1, 1), (3, 5), (10, 3), (200, 60), (500, 7)):
        sizes = rng.integers(1, 1000, n).tolist()
        windows = packing.difference(sizes, k)
        assert len(windows) == k and sorted(i for w in windows for i in w) == list(range(n))
        sums = [sum(sizes[i] for i in w) for w in windows]
        assert max(sums) - min(sums) <= max(sizes)
    assert sorted(sum((4, 5, 6, 7, 8)[i] for i in w) for w in packing.difference([4, 5, 6, 7, 8], 2)) == [14, 16]


def plain_differencing(sizes, k):
    """Karmarkar-Karp as it is told: tuples of k sums, the two with the largest difference added in opposite order."""
    held = [(-s, i, [s] + [0] * (k - 1)) for i, s in enumerate(sizes)]
    serial = len(sizes)
    while len(held) > 1:
        held.sort()
        (_, _, a), (_, _, b), *held = held
        sums = sorted((x + y for x, y in zip(a, reversed(b), strict=True)), reverse=True)
        serial += 1
        held.append((sums[-1] - sums[0], serial, sums))
    return held[0][2]


def test_differencing_equals_the_plain_one():
    rng = np.random.default_rng(5)
    for n, k in ((1, 1), (4, 2), (9, 4), (40, 3), (60, 17), (150, 40), (30, 45)):
        sizes = rng.choice(100_000, n, replace=False).tolist()
        windows = packing.difference(sizes, k)
        assert sorted(sum(sizes[i] for i in w) for w in windows) == sorted(plain_differencing(sizes, k))


def test_pack_covers_every_item_once():
    rng = np.random.default_rng(2)
    cases = [rng.integers(1, 2048, n).tolist() for n in (0, 1, 2, 50, 700, 2048)] + [[410] * 900, [1025] * 700, [1] * 5000, [2047] * 300, [683] * 500 + [7] * 20]
    for sizes in cases:
        windows = packing.pack(sizes)
        assert all(0 < sum(p[2] for p in w) <= 2048 for w in windows)
        covered = sorted(p for w in windows for p in w)
        for i, s in enumerate(sizes):
            at = 0
            for _, start, length in (p for p in covered if p[0] == i):
                assert start == at
                at += length
            assert at == s
        least = -(-sum(sizes) // 2048)
        assert least <= len(windows) <= least * 1.01 + 1


def test_the_window_count_rises_until_all_fit():
    sizes = [410] * 50  # four to a window, though five would be the least count's
    windows = packing.fitting(sizes, 2048)
    assert max(sum(sizes[i] for i in w) for w in windows) <= 2048 and 13 <= len(windows) <= 14
    assert sorted(i for w in windows for i in w) == list(range(50))
    assert packing.fitting([], 2048) == []


def test_packed_documents(spark, plain):
    rng = np.random.default_rng(3)
    rows = [(i // 2, t, "x") for i, t in enumerate(TEXTS)] + [(100 + i, "ab cd " * int(rng.integers(0, 900)), "y") for i in range(60)] + [(None, "q", "")]
    out = packing.pack_documents(spark.createDataFrame(rows, SCHEMA).coalesce(1), queries.tokenizer_path(), with_ids=True).collect()
    whole = sorted((str(i), plain(t) + [1]) for i, t, _ in rows)
    pieces = {}
    for r in out:
        assert crc(r.ids) == r.ids_crc32 and len(r.ids) == r.length
        pieces.setdefault((str(r.doc_id), r.doc_tokens), []).append((r.start, r.ids))
    for (i, n), found in pieces.items():  # rows that repeat an id and a length are covered together
        same = [ids for j, ids in whole if j == i and len(ids) == n]
        assert sum(len(ids) for _, ids in found) == n * len(same)
        assert all(any(ids[a : a + len(p)] == p for ids in same) for a, p in found)
    sequences = {}
    for r in out:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for s in sequences.values():
        at = 0
        for offset, length in sorted(s):
            assert offset == at
            at += length
        assert at <= 2048
    assert len(sequences) <= -(-sum(len(ids) for _, ids in whole) // 2048) * 1.01 + 1


def test_token_files(spark, plain, tmp_path):
    rows = [(len(TEXTS) - i // 2, t, "x") for i, t in enumerate(TEXTS)] + [(None, "q", "")]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    token_store.write_tokens(docs, f"{tmp_path}/t", queries.tokenizer_path())
    out = token_store.read_checksums(spark, f"{tmp_path}/t").orderBy("start").collect()
    ids = {}
    for i, t, _ in rows:
        ids.setdefault(i, []).append(plain(t) + [0])
    at = 0
    assert [r.doc_id for r in out] == sorted((i for i, _, _ in rows), key=lambda i: -1 if i is None else i)
    for r in out:
        assert r.start == at and (r.n_tokens, r.ids_crc32) in [(len(x), crc(x)) for x in ids[r.doc_id]]
        at += r.n_tokens
    few = token_store.read_tokens(spark, f"{tmp_path}/t").where("doc_id = 12")
    assert "GreaterThan" in (plan := few._jdf.queryExecution().executedPlan().toString()) or "EqualTo(doc_id,12)" in plan
    assert sorted(r.ids for r in few.collect()) == sorted(ids[12])
    plan = token_store.read_metadata(spark, f"{tmp_path}/t")._jdf.queryExecution().executedPlan().toString()
    assert "ids:array" not in plan


def test_encodings(spark, tmp_path):
    import glob

    import pyarrow.parquet as pq

    docs = spark.createDataFrame([(i, "a b c", "x") for i in range(500)], SCHEMA).coalesce(1)
    token_store.write_tokens(docs, f"{tmp_path}/e", queries.tokenizer_path())
    group = pq.ParquetFile(glob.glob(f"{tmp_path}/e/*.parquet")[0]).metadata.row_group(0)
    kinds = {group.column(k).path_in_schema: group.column(k) for k in range(group.num_columns)}
    assert "DELTA_BINARY_PACKED" in kinds["doc_id"].encodings
    assert any("DICT" in e for e in kinds["ids.list.element"].encodings)
    assert all(c.has_offset_index for c in kinds.values())


def test_empty_table(spark, tmp_path):
    docs = spark.createDataFrame([], SCHEMA)
    assert packing.pack_documents(docs, queries.tokenizer_path()).count() == 0
    token_store.write_tokens(docs, f"{tmp_path}/n", queries.tokenizer_path())
    assert token_store.read_checksums(spark, f"{tmp_path}/n").count() == 0
