import random
import zlib
from collections import defaultdict

import pytest

from answergauge.llm import sharding

SCHEMA = "doc_id long, text string, shard string"


def least_capacity(sizes, n):
    """The least capacity by trying all of them that can be an answer."""
    def fits(c):
        used, left = 1, c
        for s in sizes:
            if s > c:
                return False
            if s > left:
                used, left = used + 1, c
            left -= s
        return used <= n

    low, high = max(sizes), sum(sizes)
    while low < high:
        mid = (low + high) // 2
        low, high = (low, mid) if fits(mid) else (mid + 1, high)
    return low


@pytest.mark.parametrize("n", [1, 2, 5, 16])
def test_cuts_are_minimax(spark, n, monkeypatch):
    monkeypatch.setattr(sharding, "FIRST_BITS", 3)
    rng = random.Random(n)
    hashes = sorted({rng.randrange(-(2**63), 2**63) for _ in range(300)}) + list(range(2**62, 2**62 + 40))
    rows = sorted({h: rng.choice([1, 1, 5, 40, 300]) for h in hashes}.items())
    groups = spark.createDataFrame(rows, "hash long, size long")
    cuts, capacity = sharding.minimax_cuts(groups, n)
    assert capacity == least_capacity([s for _, s in rows], n)
    assert len(cuts) <= n and cuts[-1] == rows[-1][0]
    fill = defaultdict(int)
    for h, s in rows:
        fill[sum(h > c for c in cuts)] += s
    assert max(fill.values()) <= capacity
    if n == 5:
        assert max(fill.values()) - min(fill.values()) <= 2 * 300


@pytest.mark.parametrize("hot", [35_000, 39_000, 200])
def test_a_hot_group_below_the_fair_share(spark, hot):
    """Many groups and one that is nearly a shard: the bounds on the capacity stay close, and no plan grows with the cells."""
    rng = random.Random(hot)
    rows = sorted({rng.randrange(-(2**63), 2**63): 10 for _ in range(60_000)}.items())
    rows[len(rows) // 3] = (rows[len(rows) // 3][0], hot)
    groups = spark.createDataFrame(rows, "hash long, size long")
    cuts, capacity = sharding.minimax_cuts(groups.repartition(4), 16)
    assert capacity == least_capacity([s for _, s in rows], 16)
    assert len(cuts) == 16 and cuts[-1] == rows[-1][0]
    fill = defaultdict(int)
    for h, s in rows:
        fill[sum(h > c for c in cuts)] += s
    assert max(fill.values()) <= capacity


def test_shards_are_contiguous_with_large_groups_first(spark):
    rng = random.Random(3)
    rows = sorted({rng.randrange(-(2**63), 2**63): rng.randint(1, 20) for _ in range(500)}.items())
    for k, size in ((100, 9000), (300, 4000)):
        rows[k] = (rows[k][0], size)
    own, cuts, capacity = sharding.plan_shards(spark.createDataFrame(rows, "hash long, size long"), 8)
    assert own == [rows[100][0], rows[300][0]]
    rest = [(h, s) for h, s in rows if h not in own]
    assert capacity == least_capacity([s for _, s in rest], 6) and cuts == sorted(cuts) and len(cuts) == 6


def test_rows_of_a_shard(spark):
    texts = ["", None, "é", "a" * 5000, "b", "b", "b"] + [f"t{i}" * (i % 7) for i in range(200)]
    docs = spark.createDataFrame([(i // 2, t, "x") for i, t in enumerate(texts)], SCHEMA)
    out = sharding.shard_documents(docs, 4).collect()
    assert len(out) == len(texts)
    by_crc = defaultdict(set)
    slots = defaultdict(list)
    for r in out:
        by_crc[r.text_crc32, r["size"]].add(r.shard)
        slots[r.shard].append(r.slot)
    assert all(len(v) == 1 for v in by_crc.values())
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    assert sorted((r.size, r.text_crc32) for r in out) == sorted((len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for t in texts)
    # the one text that is more than a fair share stands alone, the others are near equal
    fill = defaultdict(int)
    for r in out:
        fill[r.shard] += r["size"]
    small = sorted(fill.values())[:-1]
    assert max(fill.values()) == 5001 and len(small) == 3 and max(small) - min(small) < 60


def test_empty_table(spark):
    assert sharding.shard_documents(spark.createDataFrame([], SCHEMA), 16).count() == 0
