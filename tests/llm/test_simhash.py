import random

import numpy as np
import pytest
import xxhash

from answergauge.llm import components, simhash

SCHEMA = "doc_id long, text string, fp string"


def brute_fingerprint(text):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        words = words.replace(c, " ")
    words = [w for w in words.split(" ") if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(nodes, links):
    root = {n: n for n in nodes}

    def find(n):
        while root[n] != n:
            root[n] = root[root[n]]
            n = root[n]
        return n

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def near(fps):
    return [(a, b) for a, x in fps.items() for b, y in fps.items() if a < b and (x ^ y).bit_count() <= 3]


def test_fingerprints():
    rng = random.Random(1)
    texts = ["", " \n", "One", "Two words", "É é\x0bÀ b\x85c", "a\xa0b c d", "x " * 70000]
    texts += [" ".join(rng.choices(["the", "Of", "to", "é"], k=n)) for n in (3, 4, 255, 256, 257, 258, 2000)]
    for t in texts:
        assert simhash.fingerprint(t.encode(), simhash._spread()) == brute_fingerprint(t), t[:20]


@pytest.mark.parametrize("step", [4, 1 << 21])
def test_index_joins_all_that_are_near_and_no_others(step, monkeypatch):
    monkeypatch.setattr(simhash, "STEP", step)
    rng = random.Random(step)
    top = rng.getrandbits(16) << 48
    codes = {top | rng.getrandbits(48) for _ in range(60)}
    for c in list(codes):
        for _ in range(4):
            codes.add(c ^ sum(1 << b for b in rng.sample(range(48), rng.randint(1, 5))))
    base = top | rng.getrandbits(48)
    codes |= {base ^ x for x in range(32)} | {base ^ (1 << a | 1 << b) for a in range(48) for b in range(a)}
    codes = np.array(sorted(codes), np.uint64)
    group = np.array([rng.randint(0, 1) for _ in codes], np.int64)
    order = np.lexsort((simhash.gray_rank(codes), group))
    group, codes = group[order], codes[order]
    label = np.arange(len(codes))
    for a, b in simhash.GrayIndex(group, codes, 16).links(3):
        label = simhash.merge(label, a, b)
    fps = dict(enumerate(codes.tolist()))
    want = brute_components(fps, [(a, b) for a, b in near(fps) if group[a] == group[b]])
    assert label.tolist() == [want[i] for i in range(len(codes))]


def test_gray_neighbours_differ_in_one_bit():
    codes = np.arange(64, dtype=np.uint64)
    ordered = codes[np.argsort(simhash.gray_rank(codes))]
    assert all(int(a ^ b).bit_count() == 1 for a, b in zip(ordered, ordered[1:], strict=False))


def test_whole_groups_are_dropped():
    """Comparisons of a member of one upper node hardly grow with the members."""
    rng = np.random.default_rng(6)
    looked = {}
    for n in (2000, 16000):
        codes = np.unique(rng.integers(0, 1 << 48, n, dtype=np.uint64))
        codes = codes[np.argsort(simhash.gray_rank(codes))]
        index = simhash.GrayIndex(np.zeros(len(codes), np.int64), codes, 16)
        assert sum(len(a) for a, _ in index.links(3)) < 20
        looked[n] = index.pairs / len(codes)
    assert looked[16000] < 3 * looked[2000] and looked[16000] < 16000 / 16  # eight times the members


@pytest.mark.parametrize("blocks", [4, 5, 6])
def test_all_near_pairs_share_a_pattern(blocks):
    rng = random.Random(blocks)
    choices = simhash.patterns(blocks)
    for _ in range(300):
        x = rng.getrandbits(64)
        y = x ^ sum(1 << b for b in rng.sample(range(64), 3))
        shared = 0
        for p in choices:
            a, b = (int(simhash.arranged(np.array([c], np.uint64), p)[0]) for c in (x, y))
            assert a.bit_count() == x.bit_count() and (a ^ b).bit_count() == 3
            shared += a >> (64 - simhash.shared_bits(p)) == b >> (64 - simhash.shared_bits(p))
        assert shared
    assert [simhash.blocks_for(n) for n in (0, 10**6, 10**8, 10**10, 10**13)] == [4, 4, 4, 5, 7]


@pytest.mark.parametrize("segment,members", [(8, 4096), (16384, 4096), (8, 0)])
def test_links_over_several_tasks(spark, segment, members, monkeypatch):
    monkeypatch.setattr(simhash, "SEGMENT", segment)
    monkeypatch.setattr(simhash, "MEMBERS", members)
    if not members:
        monkeypatch.setattr(simhash, "blocks_for", lambda n: 5)
    rng = random.Random(segment)
    fps = {}
    for _ in range(20):
        c = rng.getrandbits(64)
        for _ in range(rng.randint(1, 12)):
            fps.setdefault(c, len(fps) + 5)
            c ^= sum(1 << b for b in rng.sample(range(64), rng.randint(1, 5)))
    rows = [(f - (1 << 64) if f >> 63 else f, n) for f, n in fps.items()]
    links = [tuple(r) for r in simhash.links(spark.createDataFrame(rows, "fp long, node long")).collect()]
    by_node = {n: f for f, n in fps.items()}
    assert brute_components(by_node, links) == brute_components(by_node, near(by_node))


def test_components_of_a_long_chain_and_a_hub(spark):
    rng = random.Random(3)
    chain = list(range(100, 160))
    rng.shuffle(chain)
    links = list(zip(chain, chain[1:], strict=False)) + [(500, k) for k in range(200, 260)] + [(7, 7), (8, 9), (9, 8)]
    got = {r.node: r.component for r in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    want = brute_components({n for p in links for n in p if n != 7}, [p for p in links if p[0] != 7])
    assert got == want


def test_documents_equal_brute_force(spark):
    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(300)]
    rows = [(9, None), (4, ""), (11, "a"), (11, "a"), (3, "A"), (None, "z z z z")]
    for k in range(30):
        words = rng.choices(vocabulary, k=rng.choice([2, 40, 150]))
        for j in range(rng.choice([1, 1, 4])):
            rows.append((1000 - 10 * k - j, " ".join(words)))
            words[rng.randrange(len(words))] = "x"
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], SCHEMA)
    fps = {(i, t): brute_fingerprint(t) for i, t in rows}
    least = {}
    for (i, _), f in fps.items():
        if i is not None:
            least[f] = min(i, least.get(f, i))
    roots = brute_components(set(least.values()), near({n: f for f, n in least.items()}))
    want = sorted(((i, fps[i, t], roots[least[fps[i, t]]] if fps[i, t] in least else None) for i, t in rows), key=str)
    got = sorted(((r.doc_id, r.fp % (1 << 64), r.component_id) for r in simhash.near_duplicates(docs).collect()), key=str)
    assert got == want
    kept = simhash.drop_near_duplicates(docs.where("doc_id is not null"))
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted({c for _, _, c in want if c is not None})


def test_null_and_repeated_ids_lose_no_text(spark):
    rng = random.Random(8)
    a, b, c, d, e = (rng.choices([f"w{i}" for i in range(300)], k=60) for _ in range(5))
    texts = lambda words: (" ".join(words), " ".join(words).upper())
    rows = [(None, texts(a)[0]), (None, texts(a)[1]), (None, texts(b)[0]), (3, texts(c)[0]), (5, texts(c)[1]), (5, texts(d)[0]), (9, texts(d)[1]), (9, texts(d)[1]), (None, texts(d)[0]), (7, texts(e)[0]), (7, texts(e)[0])]
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], SCHEMA).repartition(3)
    kept = simhash.drop_near_duplicates(docs)
    assert kept.columns == docs.columns
    got = sorted(((r.doc_id, r.text.lower()) for r in kept.collect()), key=str)
    assert got == sorted([(None, texts(a)[0]), (None, texts(b)[0]), (3, texts(c)[0]), (5, texts(d)[0]), (7, texts(e)[0])], key=str)
    named = docs.selectExpr("doc_id", "text", "1 as `a.b`", "2 as __fp", "3 as row")
    assert sorted(((r.doc_id, r.text.lower()) for r in simhash.drop_near_duplicates(named).collect()), key=str) == got
    assert simhash.drop_near_duplicates(named).columns == named.columns
    one = spark.createDataFrame([(None, None, "x")] * 3, SCHEMA)
    assert [tuple(r) for r in simhash.drop_near_duplicates(one).collect()] == [(None, None, "x")]


def test_empty_table(spark):
    assert simhash.near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0
