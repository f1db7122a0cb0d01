"""Web archives: records written and read, and an index of captures merged from sorted runs.

Writing and reading. Pages become WARC/1.1 records in gzip files that Spark's text writer puts into the given folder
(a record is headers, an empty line and a block, and the separator of records is the two line ends that close one).
Of records with equal payloads the one with the smallest id is a response, the others are revisits that refer to it.
Readers go by Content-Length, so payloads may hold anything.

Index. Each task that reads archives sorts its captures in runs of RUN rows, by URL key, time and id, and cuts the
runs at the bounds of ranges and into blocks. The blocks of a range come to one task in order of their first capture,
and a loser tree merges the runs they belong to: a block is opened when the merge gets to its first capture, so a task
holds a block of each run, not its range. Bounds are quantiles of a sample by hash of whole captures, so captures of one
URL, however many, are dealt out over ranges. The order over all ranges is (range, position), or place.
"""

from __future__ import annotations

import gzip
import hashlib
import io
from bisect import bisect_right
from collections.abc import Iterator
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import store

#: Payloads of fewer bytes are never revisits. Bytes of records that go to one file, about.
LEAST, ARCHIVE_BYTES = 100, 32 << 20
#: Captures in a run, in a block, in a range (about), and sampled for each bound.
RUN, BLOCK, RANGE, SAMPLED = 100_000, 2048, 200_000, 32
#: Captures in the sample at most: beyond that many ranges, there are fewer for each bound, and one at least.
SAMPLE = 1 << 17
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
CRLF = "\r\n"


def utc(when: Column) -> Column:
    """A timestamp as WARC writes it, whatever the session's time zone."""
    second = F.unix_seconds(when)
    day = F.date_from_unix_date(F.floor(second / 86400).cast("int")).cast("string")
    of_day = F.pmod(second, F.lit(86400))
    two = lambda part: F.lpad(F.floor(part).cast("string"), 2, "0")
    return F.concat(day, F.lit("T"), two(of_day / 3600), F.lit(":"), two(F.pmod(of_day, F.lit(3600)) / 60), F.lit(":"), two(F.pmod(of_day, F.lit(60))), F.lit("Z"))


def _line(col: Column) -> Column:
    """A header's value on one line."""
    for raw, coded in (("\r", "%0D"), ("\n", "%0A"), ("\t", "%09"), (" ", "%20")):
        col = F.replace(col, F.lit(raw), F.lit(coded))
    return col


def record_types(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """page_id, payload_digest, payload_bytes, n, record_type, refers_to: a row for each distinct (id, payload), n of them.

    Null payloads count as empty. Rows that repeat both the id and the payload have the same record type.
    """
    html = F.coalesce(store.col(html_col), F.lit(""))
    each = pages.select(store.col(id_col).alias("page_id"), F.sha2(html.cast("binary"), 256).alias("payload_digest"), F.octet_length(html).cast("long").alias("payload_bytes"))
    rows = store.cut(each.groupBy("page_id", "payload_digest", "payload_bytes").agg(F.count("*").alias("n")))
    long = rows.where(F.col("payload_bytes") >= LEAST)
    groups = store.cut(long.groupBy("payload_digest").agg(F.min("page_id").alias("first_id"), F.count("*").alias("ids")))
    typed = store.lookup(long, groups, "payload_digest", "ids", long.count())
    again = ~F.col("page_id").eqNullSafe(F.col("first_id"))
    short = rows.where(F.col("payload_bytes") < LEAST)
    return typed.select(
        "page_id", "payload_digest", "payload_bytes", "n", F.when(again, "revisit").otherwise("response").alias("record_type"), F.when(again, F.col("first_id")).alias("refers_to")
    ).unionByName(short.withColumns({"record_type": F.lit("response"), "refers_to": F.lit(None).cast(rows.schema["page_id"].dataType)}))


def write_archives(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", time: Column | None = None) -> None:
    """Write a record for each row of pages below path. time: when the page was taken; by default, its id in seconds."""
    types = store.cut(record_types(pages, id_col, html_col))
    # Of rows that repeat, each is a record.
    size, rows, most = types.agg(F.sum((F.when(F.col("record_type") == "response", F.col("payload_bytes")).otherwise(0) + 600) * F.col("n")), F.sum("n"), F.max("n")).first()
    html = F.coalesce(store.col(html_col), F.lit(""))
    when = time if time is not None else F.timestamp_seconds(F.pmod(F.coalesce(store.col(id_col).cast("long"), F.lit(0)), F.lit(10**10)))
    key = store.name_of(F.col("digest"), F.col("id"))
    parts = pages.select(store.col(id_col).alias("id"), store.col(url_col).cast("string").alias("url"), html.alias("html"), utc(when).alias("date"), F.sha2(html.cast("binary"), 256).alias("digest")).withColumn("key", key)
    kinds = types.select(store.name_of(F.col("payload_digest"), F.col("page_id")).alias("key"), "payload_bytes", "record_type", "refers_to", "n")
    # The join deals pages out by hash, each page once, so large ones don't stand together in a file.
    found = store.lookup(parts, kinds, "key", "n", rows) if rows and most > rows / store.HEAVY_SHARE and most > 1 else parts.join(kinds.hint("merge"), "key")
    name = lambda col: F.concat(F.lit("<urn:x-page:"), F.coalesce(col.cast("string"), F.lit("")), F.lit(":"), F.substring("digest", 1, 16), F.lit(">"))
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "), F.col("payload_bytes").cast("string"), F.lit(CRLF * 2))
    block = F.when(F.col("record_type") == "response", F.concat(http, "html")).otherwise(http)
    headers = {
        "WARC-Type": F.col("record_type"),
        "WARC-Record-ID": name(F.col("id")),
        "WARC-Date": F.col("date"),
        "WARC-Target-URI": _line(F.col("url")),
        "WARC-Payload-Digest": F.concat(F.lit("sha256:"), "digest"),
        "WARC-Profile": F.when(F.col("record_type") == "revisit", F.lit(PROFILE)),
        "WARC-Refers-To": F.when(F.col("record_type") == "revisit", name(F.col("refers_to"))),
        "Content-Type": F.lit("application/http;msgtype=response"),
        "Content-Length": F.octet_length("block").cast("string"),
    }
    lines = [F.lit("WARC/1.1")] + [F.when(v.isNotNull(), F.concat(F.lit(f"{k}: "), v)) for k, v in headers.items()]
    records = found.withColumn("block", block).select(F.concat(F.concat_ws(CRLF, *lines), F.lit(CRLF * 2), "block").alias("value"))
    each = max(1, int(ARCHIVE_BYTES * (rows or 1) / (size or 1)))
    records.write.option("lineSep", CRLF * 2).option("compression", "gzip").option("maxRecordsPerFile", each).text(path)


def url_key(url: str | None) -> str:
    """The key that captures of a URL have in common: host reversed, no scheme, port, www or fragment, query sorted."""
    if not url:
        return ""
    try:
        parts = urlsplit(url.strip().lower())
        host = parts.hostname or ""
    except ValueError:
        return url.strip().lower()
    labels = host.split(".")
    if len(labels) > 1 and labels[0].rstrip("0123456789") == "www":
        labels = labels[1:]
    query = "&".join(sorted(parts.query.split("&")))
    return ",".join(reversed(labels)) + ")" + (parts.path or "/") + (f"?{query}" if query else "")


def parse(archive: Iterator[bytes] | io.BufferedIOBase) -> Iterator[tuple[dict[str, str], bytes, int, int]]:
    """(headers in lower case, block, offset, length) of each record of an uncompressed archive."""
    at = 0
    while True:
        line = archive.readline()
        if not line:
            return
        if line != b"WARC/1.1\r\n":
            raise ValueError(f"no record at {at}: {line[:40]!r}")
        size, headers = len(line), {}
        while (line := archive.readline()) not in (b"\r\n", b""):
            size += len(line)
            key, _, value = line.decode().rstrip("\r\n").partition(": ")
            headers[key.lower()] = value
        length = int(headers["content-length"])
        block = archive.read(length)
        if len(block) != length or archive.read(4) != b"\r\n\r\n":
            raise ValueError(f"the record at {at} is cut off")
        size += 2 + length + 4
        yield headers, block, at, size
        at += size


CAPTURE = "url_key string, time string, page_id {id}, url string, file string, offset long, length long, record_type string, payload_digest string, payload_bytes long, refers_to {id}"


def _captures(kind: pa.DataType, with_payload: bool):
    whole = pa.types.is_integer(kind)

    def page_of(name: str | None):
        text = name[len("<urn:x-page:") :].rsplit(":", 1)[0] if name else ""
        return (int(text) if whole else text) if text else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [c.split()[0] for c in CAPTURE.split(", ")] + ["payload"] * with_payload
        kinds = [pa.string(), pa.string(), kind, pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), kind] + [pa.binary()] * with_payload
        for batch in batches:
            for path, content in zip(batch.column(0), batch.column(1), strict=True):
                file, rows, size = path.as_py().rpartition("/")[2], [], 0
                with gzip.GzipFile(fileobj=io.BytesIO(content.as_buffer())) as archive:
                    for headers, block, offset, length in parse(io.BufferedReader(archive, 1 << 16)):
                        head, _, payload = block.partition(b"\r\n\r\n")
                        declared = int(head.rpartition(b"Content-Length: ")[2])
                        digest = headers["warc-payload-digest"].removeprefix("sha256:")
                        kind_ = headers["warc-type"]
                        if kind_ == "response" and (len(payload) != declared or hashlib.sha256(payload).hexdigest() != digest):
                            raise ValueError(f"{file}, {offset}: the payload isn't what its digest says")
                        url = headers.get("warc-target-uri")
                        row = (url_key(url), headers["warc-date"], page_of(headers["warc-record-id"]), url, file, offset, length, kind_, digest, declared, page_of(headers.get("warc-refers-to")))
                        rows.append(row + ((payload,) if with_payload else ()))
                        size += len(payload) if with_payload else 0
                        if len(rows) == 4096 or size > 16 << 20:
                            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)
                            rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    return run


def read_archives(spark: SparkSession, path: str, id_type: str = "bigint", with_payload: bool = False) -> DataFrame:
    """The captures in the archives below path, each checked against its digest; with the payloads if asked for."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path).select("path", "content")
    kind = spark.createDataFrame([], f"id {id_type}").schema
    from pyspark.sql.pandas.types import to_arrow_type

    arrow = to_arrow_type(kind["id"].dataType)
    return files.mapInArrow(_captures(arrow, with_payload), CAPTURE.format(id=id_type) + (", payload binary" if with_payload else ""))


class LoserTree:
    """The least of the heads of some runs. A run without a head loses against all; ties go to the run that came first.

    Runs are leaves; there is room for twice as many whenever they don't suffice. An inner node has the run that lost there.
    """

    def __init__(self):
        self.heads: list = [None]
        self.tree = [0]  # losers at inner nodes, the winner at 0
        self.runs = 0

    def _beats(self, a: int, b: int) -> bool:
        x, y = self.heads[a], self.heads[b]
        return x is not None and (y is None or x < y or (x == y and a < b))

    def _grow(self) -> None:
        """Twice the leaves: the winner so far meets the first of the new ones, that all have no head, at the root."""
        old, width = self.tree, len(self.heads)
        self.heads += [None] * width
        self.tree = [old[0], width] + [0] * (2 * width - 2)
        for k in range(1, width):  # the tree so far is the left half, its node k one level lower
            top = 1 << (k.bit_length() - 1)
            self.tree[k + top] = old[k]
            # of the right half's leaves, the first of each node wins
            level = width // top
            self.tree[k + 2 * top] = width + (k - top) * level + level // 2

    def _lead(self, run: int) -> None:
        """Make a run the winner, as if it had come first in all its matches; others' matches are as they were."""
        leaf, level, behind = len(self.heads) + run, 1, 0
        while node := leaf >> level:
            lost = self.tree[node]
            if (len(self.heads) + lost) >> (level - 1) == leaf >> (level - 1):
                # The run's own side lost here. The run that won here is the next one found to have lost on that side.
                if behind:
                    self.tree[behind] = lost
                behind = node
            level += 1
        if behind:
            self.tree[behind] = self.tree[0]
        self.tree[0] = run

    def put(self, run: int, head) -> None:
        """Give a run its next head, or None, and replay its matches on the way up. A new run has the number runs."""
        while run >= len(self.heads):
            self._grow()
        self.runs = max(self.runs, run + 1)
        if run != self.tree[0]:
            self._lead(run)
        self.heads[run] = head
        node, now = (len(self.heads) + run) // 2, run
        while node:
            if self._beats(self.tree[node], now):
                now, self.tree[node] = self.tree[node], now
            node //= 2
        self.tree[0] = now

    def winner(self) -> int | None:
        return self.tree[0] if self.heads[self.tree[0]] is not None else None


def merge_blocks(blocks: Iterator[tuple[int, list]]) -> Iterator:
    """The entries of all blocks in order. blocks: (run, ascending entries), ascending by their first entries."""
    tree, runs, queues = LoserTree(), {}, []
    ahead = next(blocks, None)
    while True:
        while ahead is not None:
            at = tree.winner()
            if at is not None and tree.heads[at] < ahead[1][0]:
                break
            leaf = runs.setdefault(ahead[0], len(runs))
            if leaf == len(queues):
                queues.append([])
            queues[leaf].append(iter(ahead[1]))
            if leaf == tree.runs or tree.heads[leaf] is None:
                tree.put(leaf, next(queues[leaf][0]))
            ahead = next(blocks, None)
        at = tree.winner()
        if at is None:
            return
        yield tree.heads[at]
        head = None
        while queues[at] and (head := next(queues[at][0], None)) is None:
            queues[at].pop(0)
        tree.put(at, head)


def _key(row: dict) -> tuple:
    return (row["url_key"], row["time"], row["page_id"] is not None, row["page_id"] or 0, row["file"], row["offset"])


def _runs(bounds: list[tuple], entry: pa.DataType):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, count, held = TaskContext.get().partitionId(), 0, []

        def blocks() -> pa.RecordBatch:
            held.sort(key=_key)
            out: list[tuple[int, list]] = []
            for row in held:
                range_id = bisect_right(bounds, _key(row))
                if not out or out[-1][0] != range_id or len(out[-1][1]) == BLOCK:
                    out.append((range_id, []))
                out[-1][1].append(row)
            return pa.RecordBatch.from_arrays(
                [pa.array([r for r, _ in out], pa.int32()), pa.array([(task << 32) + count] * len(out), pa.int64()), pa.array([b for _, b in out], pa.list_(entry))], names=["range", "run", "block"]
            )

        for batch in batches:
            held += batch.to_pylist()
            if len(held) >= RUN:
                yield blocks()
                held, count = [], count + 1
        if held:
            yield blocks()

    return run


def _merged(entry: pa.DataType):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from itertools import groupby

        class Entry(tuple):
            """The key of a capture, and the capture."""

            def __lt__(self, other):
                return self[0] < other[0]

            def __eq__(self, other):
                return self[0] == other[0]

        def rows():
            for batch in batches:
                for k in range(batch.num_rows):
                    yield batch.column(0)[k].as_py(), batch.column(1)[k].as_py(), [Entry((_key(x), x)) for x in batch.column(2)[k].as_py()]

        kinds = [pa.int32(), pa.int64(), *(f.type for f in entry)]
        names = ["range", "position", *(f.name for f in entry)]
        for range_id, blocks in groupby(rows(), key=lambda b: b[0]):
            held, at = [], 0
            for e in merge_blocks((run, block) for _, run, block in blocks):
                held.append((range_id, at, *(e[1][n] for n in names[2:])))
                at += 1
                if len(held) == 8192:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held, strict=True), kinds, strict=True)], names=names)
                    held = []
            if held:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held, strict=True), kinds, strict=True)], names=names)

    return run


def _bounds(captures: DataFrame, count: int) -> list[tuple]:
    """Keys that cut the captures into ranges of about RANGE (of more, once SAMPLE ranges of these don't do)."""
    ranges = min(SAMPLE, -(-count // RANGE))
    if ranges < 2:
        return []
    each = max(1, min(SAMPLED, SAMPLE // ranges))
    # Rows with the smallest hashes; those of about twice the sample's share are looked at, so the sort is of a bounded size.
    keys = captures.select("url_key", "time", "page_id", "file", "offset", F.xxhash64("url_key", "time", "page_id", "file", "offset").alias("h"))
    share = min(1.0, (2 * ranges * each + 1000) / count)
    some = keys.where(F.col("h") <= F.lit(min(2**63 - 1, int(share * 2**64) - 2**63))).orderBy("h", "file", "offset").limit(ranges * each).collect()
    return sorted(_key(r.asDict()) for r in some)[each::each]


def merge_index(captures: DataFrame) -> DataFrame:
    """captures with range, position (in the range) and place (in all of the index, gapless from 0).

    In order of place they go by URL key, time and id. An empty table gives none.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    captures = store.cut(captures)
    bounds = _bounds(captures, captures.count())
    entry = pa.struct(to_arrow_schema(captures.schema))
    kind = captures.schema.simpleString()
    blocks = captures.mapInArrow(_runs(bounds, entry), f"range int, run long, block array<{kind}>")
    first = [F.col("block")[0][c] for c in ("url_key", "time", "page_id", "file", "offset")]
    dealt = blocks.repartition("range").sortWithinPartitions("range", *first)
    merged = store.cut(dealt.mapInArrow(_merged(entry), f"range int, position long, {', '.join(f'{f.name} {f.dataType.simpleString()}' for f in captures.schema)}"))
    sizes = merged.groupBy("range").agg(F.count("*").alias("size"))  # SAMPLE rows at most
    before = sizes.select("range", F.coalesce(F.sum("size").over(Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    return merged.join(F.broadcast(before), "range").withColumn("place", F.col("before") + F.col("position")).drop("before")


def capture_histories(spark: SparkSession, path: str, id_type: str = "bigint") -> DataFrame:
    """The captures of the archives below path, ordered by place: URL by URL, and each by time.

    Null ids sort first, null URLs have the empty key. Captures that agree in all of it go by file and offset.
    """
    return merge_index(read_archives(spark, path, id_type))
