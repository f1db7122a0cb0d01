import gzip
import hashlib
import random

import pytest

from answergauge.llm import warc

SCHEMA = "page_id long, url string, html string, file string"


def pages():
    rng = random.Random(1)
    long = "<p>" + "é" * 200 + "\r\n\r\nWARC/1.1\r\n</p>"
    rows = [(9, "http://a.example/x", long), (3, "http://b.example/y z\r\nX: 1", long), (3, "http://b.example/", long), (4, None, long), (5, "u", None), (6, "", ""), (7, "http://A.example:80/x", "s" * 99), (8, "http://www.a.example/x", "s" * 99), (None, "n", "t" * 100), (11, "n", "t" * 100)]
    return rows + [(100 + i, f"https://h{rng.randint(0, 4)}.example/p{rng.randint(0, 9)}?b=2&a=1", f"page {rng.randint(0, 20)} " * 30) for i in range(150)]


def expected(rows):
    first = {}
    for i, _, h in rows:
        if i is not None:
            first[h or ""] = min(i, first.get(h or "", i))
    out = []
    for i, _, h in rows:
        data = (h or "").encode()
        again = len(data) >= 100 and i != first.get(h or "")
        out.append((i, len(data), hashlib.sha256(data).hexdigest(), "revisit" if again else "response", first[h] if again else None))
    return sorted(out, key=str)


@pytest.fixture(scope="module")
def archives(spark, tmp_path_factory):
    path = f"{tmp_path_factory.mktemp('warc')}/w"
    docs = spark.createDataFrame([(*r, "x") for r in pages()], SCHEMA).repartition(3)
    warc.write_archives(docs, path)
    return path


def test_round_trip(spark, archives):
    got = warc.read_archives(spark, archives, with_payload=True).collect()
    assert sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got), key=str) == expected(pages())
    payloads = {(i, (h or "").encode()) for i, _, h in pages()}
    assert all((r.page_id, bytes(r.payload)) in payloads for r in got if r.record_type == "response")
    assert {r.url for r in got if r.page_id == 9} == {"http://a.example/x"}


def test_offsets_point_at_records(spark, archives):
    for r in warc.read_archives(spark, archives).collect()[:40]:
        data = gzip.decompress(open(f"{archives}/{r.file}", "rb").read())[r.offset : r.offset + r.length]
        assert data.startswith(b"WARC/1.1\r\nWARC-Type: " + r.record_type.encode()) and data.endswith(b"\r\n\r\n")


@pytest.mark.parametrize("small", [False, True])
def test_histories_are_in_order(spark, archives, small, monkeypatch):
    if small:
        for name, value in (("RUN", 7), ("BLOCK", 2), ("RANGE", 40), ("SAMPLED", 4)):
            monkeypatch.setattr(warc, name, value)
    got = warc.capture_histories(spark, archives).orderBy("place").collect()
    assert [r.place for r in got] == list(range(len(got))) and sorted(got, key=lambda r: (r.range, r.position)) == got
    keys = [warc._key(r.asDict()) for r in got]
    assert keys == sorted(keys) and len(got) == len(pages())
    assert len({r.range for r in got}) > 1 or not small
    assert sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got), key=str) == expected(pages())


class Counted(int):
    """A number that counts how often it is compared."""

    times = 0

    def __lt__(self, other):
        Counted.times += 1
        return int(self) < int(other)


def test_many_runs_cost_a_path_each():
    rng = random.Random(4)
    runs = [sorted(rng.randrange(10**9) for _ in range(6)) for _ in range(2000)]
    blocks = sorted(([Counted(x) for x in r[i : i + 2]], k) for k, r in enumerate(runs) for i in (0, 2, 4))
    Counted.times = 0
    out = [int(x) for x in warc.merge_blocks((k, b) for b, k in blocks)]
    assert out == sorted(x for r in runs for x in r)
    assert Counted.times < 3 * len(out) * 12  # not runs times runs


def test_a_tree_takes_heads_in_any_order():
    rng = random.Random(5)
    for _ in range(200):
        tree, heads = warc.LoserTree(), {}
        for _ in range(60):
            run = rng.randint(0, min(tree.runs, 20))
            heads[run] = rng.choice([None, rng.randint(0, 9)])
            tree.put(run, heads[run])
            least = min(((h, k) for k, h in heads.items() if h is not None), default=(None, None))
            assert tree.winner() == least[1]


def test_dates_are_utc_and_pages_are_bounded_in_files(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "ARCHIVE_BYTES", 100_000)
    rows = [(i, f"http://h.example/{i}", f"{i} " * (2000 if i < 100 else 5), "x") for i in range(400)] + [(7, "http://h.example/7", "7 " * 2000, "x")] * 40
    zone = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "Asia/Tokyo")
    try:
        warc.write_archives(spark.createDataFrame(rows, SCHEMA).coalesce(2), f"{tmp_path}/u")
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)
    got = warc.read_archives(spark, f"{tmp_path}/u").collect()
    assert len(got) == len(rows) and len({r.file for r in got}) > 3
    assert {r.time for r in got if r.page_id == 0} == {"1970-01-01T00:00:00Z"} and {r.time for r in got if r.page_id == 399} == {"1970-01-01T00:06:39Z"}
    when = spark.sql("select timestamp_seconds(-1) as a, timestamp_seconds(951868799) as b")
    assert tuple(when.select(warc.utc(when.a), warc.utc(when.b)).first()) == ("1969-12-31T23:59:59Z", "2000-02-29T23:59:59Z")


def test_merge_opens_blocks_as_they_are_reached():
    rng = random.Random(2)
    for n in (0, 1, 2, 5, 13):
        runs = [sorted(rng.randint(0, 50) for _ in range(rng.randint(1, 40))) for _ in range(n)]
        blocks = sorted(((r[i : i + 3], k) for k, r in enumerate(runs) for i in range(0, len(r), 3)), key=lambda b: (b[0][0], b[1]))
        opened, out = [], []

        def feed(blocks=blocks, opened=opened):
            for block, run in blocks:
                opened.append(block[0])
                yield run, block

        for x in warc.merge_blocks(feed()):
            out.append(x)
            assert len(opened) <= 1 + sum(b[0][0] <= x for b in blocks)
        assert out == sorted(x for r in runs for x in r)


def test_url_key():
    assert warc.url_key("HTTP://www2.A.example:80/X?b=2&a=1#f") == "example,a)/x?a=1&b=2"
    assert [warc.url_key(u) for u in (None, "", "http://[bad", "http://h")] == ["", "", "http://[bad", "h)/"]


def test_empty_table(spark, tmp_path):
    warc.write_archives(spark.createDataFrame([], SCHEMA), f"{tmp_path}/e")
    assert warc.capture_histories(spark, f"{tmp_path}/e").count() == 0
