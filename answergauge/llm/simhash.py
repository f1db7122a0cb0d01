"""SimHash near-dedup with a Gray-order hierarchical index.

Fingerprints are reduced to distinct ones first, so copies cost nothing more. The bits are cut into blocks; two fingerprints
that differ in at most three bits agree in all blocks but three, so the upper nodes of the index are the patterns of that
many blocks: of one of four blocks (16 bits, each fingerprint goes to four upper nodes), or, once these would have more than
MEMBERS members on average, of two of five blocks, and so on (blocks_for). Any linked pair meets below one. Below an upper
node, fingerprints (their bits in such an order that the shared blocks lead) are sorted by Gray rank. Members that share
further masked patterns then stand together, LEVEL bits at a time; the pattern is kept once, in their node. Nodes are
compared with nodes, differences add up on the way down, and a pair of nodes is dropped with all below it once the sum is
over the limit. It is taken as a whole, too: if the sum and all bits that vary below make no more than the limit, all
members are linked, without a look at the pairs.

Below a node only a spanning forest of the links goes out, so links grow with the members, not with their square. An
upper node with more than SEGMENT members is dealt out over several tasks, pairs of segments each.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from . import store
from .components import components

SHINGLE, SEED, LIMIT = 3, 42, 3
#: Bits of a level below an upper node, and members of an upper node, on average, beyond which more blocks are shared.
LEVEL, MEMBERS = 4, 4096
#: Members of an upper node that one task compares with each other, and pairs that are looked at in one step.
SEGMENT, STEP = 16384, 1 << 21
#: Rows that are summed before a lane of eight bits could overflow, and rows that are spread at once.
LANE, ROWS = 255, 255 * 256


def _spread() -> np.ndarray:
    """For each byte, its bits as the eight byte lanes of a word."""
    bits = (np.arange(256)[:, None] >> np.arange(8)) & 1
    return np.ascontiguousarray(bits.astype(np.uint8)).view(np.uint64).ravel()


def fingerprint(text: bytes, spread: np.ndarray, size: int = SHINGLE, seed: int = SEED) -> int:
    """The 64-bit SimHash of a text in UTF-8; see fingerprints()."""
    from itertools import repeat

    import xxhash

    words = text.lower().split()  # of bytes: A-Z alone, and the six ASCII white spaces
    if not words:
        return 0
    n = max(1, len(words) - size + 1)
    if len(words) < size:
        hashes = iter([xxhash.xxh64_intdigest(b" ".join(words), seed)])
    else:
        hashes = map(xxhash.xxh64_intdigest, map(b" ".join, zip(*(words[k:] for k in range(size)), strict=False)), repeat(seed))
    counts = np.zeros(64, np.int64)
    for at in range(0, n, ROWS):
        rows = min(ROWS, n - at)
        lanes = spread[np.fromiter(hashes, np.uint64, rows).view(np.uint8).reshape(rows, 8)]
        whole = rows - rows % LANE
        if whole:
            counts += lanes[:whole].reshape(-1, LANE, 8).sum(axis=1).view(np.uint8).reshape(-1, 64).sum(axis=0, dtype=np.int64)
        if whole < rows:
            counts += lanes[whole:].sum(axis=0).view(np.uint8)
    return int(np.packbits(counts * 2 > n, bitorder="little").view(np.uint64)[0])


def _fingerprint_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    spread = _spread()
    for batch in batches:
        out = np.zeros(batch.num_rows, np.uint64)
        for i, text in enumerate(batch.column(1).cast(pa.large_binary())):
            if text.is_valid:
                out[i] = fingerprint(text.as_py(), spread)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out.view(np.int64))], names=["doc_id", "fp"])


def _with_fingerprint(text_at: int, name: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pair = pa.RecordBatch.from_arrays([batch.column(text_at), batch.column(text_at)], names=["doc_id", "text"])
            for out in _fingerprint_batches(iter([pair])):
                yield pa.RecordBatch.from_arrays([*batch.columns, out.column(1)], names=[*batch.schema.names, name])

    return run


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fp long for each row: bits set in over half of the XXH64 of its shingles of three words.

    A-Z are lower-cased. A text of one or two words is one shingle; one without words, or null, has fingerprint 0.
    """
    rows = docs.select(store.col(id_col).alias("doc_id"), store.col(text_col).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(_fingerprint_batches, f"doc_id {kind}, fp long")


def gray_rank(codes: np.ndarray) -> np.ndarray:
    """The place of each code in Gray order."""
    rank = codes.copy()
    for shift in (1, 2, 4, 8, 16, 32):
        rank ^= rank >> np.uint64(shift)
    return rank


def blocks_for(n: int) -> int:
    """Into how many blocks the bits are cut for so many fingerprints."""
    blocks = LIMIT + 1
    while n >> min(map(shared_bits, patterns(blocks))) > MEMBERS and blocks < 2 * LIMIT + 2:
        blocks += 1
    return blocks


def patterns(blocks: int) -> list[list[tuple[int, int]]]:
    """The choices of blocks, as (first bit, last bit) from the upper end, that all pairs within LIMIT bits agree in one of."""
    edge = [64 * k // blocks for k in range(blocks + 1)]
    return [[(edge[k], edge[k + 1]) for k in some] for some in combinations(range(blocks), blocks - LIMIT)]


def shared_bits(pattern: list[tuple[int, int]]) -> int:
    return sum(b - a for a, b in pattern)


def arranged(fp: np.ndarray, pattern: list[tuple[int, int]]) -> np.ndarray:
    """Fingerprints with the bits of a pattern in front, the others behind, in order."""
    rest, at = [], 0
    for a, b in [*pattern, (64, 64)]:
        rest, at = [*rest, (at, a)], b
    out, used = np.zeros_like(fp), 0
    for a, b in [*pattern, *rest]:
        if b > a:
            bits = fp >> np.uint64(64 - b) & np.uint64((1 << (b - a)) - 1)
            used += b - a
            out |= bits << np.uint64(64 - used)
    return out


class GrayIndex:
    """Nodes over codes that are sorted by group and Gray rank; a level for each LEVEL bits of the codes below the shared ones."""

    def __init__(self, group: np.ndarray, codes: np.ndarray, shared: int):
        """group: int64, equal for codes under one upper node; the upper shared bits of these are equal."""
        n = len(codes)
        self.codes, self.pairs = codes, 0  # and pairs of nodes that were looked at
        change = np.concatenate(([True], group[1:] != group[:-1])) if n else np.zeros(0, bool)
        self.levels = []  # first member of each node, members, pattern, varying bits below, bits below, children's bounds in the next level
        ends = [*range(shared, 64, LEVEL), 64]
        starts = []
        for end in ends:
            prefix = codes >> np.uint64(64 - end)
            new = change.copy()
            new[1:] |= prefix[1:] != prefix[:-1]
            starts.append(np.flatnonzero(new))
        for depth, (first, end) in enumerate(zip(starts, ends, strict=True)):
            low = np.uint64((1 << (64 - end)) - 1)
            size = np.diff(np.append(first, n))
            vary = np.bitwise_or.reduceat(codes ^ np.repeat(codes[first], size), first) & low if n else codes[:0]
            pattern = (codes[first] >> np.uint64(64 - end)) & np.uint64((1 << LEVEL) - 1)
            child = np.searchsorted(starts[depth + 1], np.append(first, n)) if depth + 1 < len(ends) else None
            self.levels.append((first, size, pattern, vary, low, child))

    def links(self, limit: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Links (members a, members b) that join all that differ in at most limit bits, and no others."""
        first, *_ = self.levels[0]
        top = np.arange(len(first))
        stack = [(0, top, top, np.zeros(len(top), np.int64))]
        while stack:
            depth, a, b, sums = stack.pop()
            first, size, _, vary, low, child = self.levels[depth]
            alone = (a == b) & (size[a] == 1)
            a, b, sums = a[~alone], b[~alone], sums[~alone]
            # Members of a and b differ in the sum, and below in bits that vary or in which the first ones differ.
            below = vary[a] | vary[b] | ((self.codes[first[a]] ^ self.codes[first[b]]) & low)
            whole = sums + np.bitwise_count(below) <= limit
            if whole.any():
                yield from self._join(first, size, a[whole], b[whole])
                a, b, sums = a[~whole], b[~whole], sums[~whole]
            if child is None or not len(a):
                continue
            wide = child[a + 1] - child[a]
            high = child[b + 1] - child[b]
            ends = np.cumsum(wide * high)
            at = 0
            while at < len(a):
                to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + STEP, "right")))
                stack.extend(self._step(depth + 1, a[at:to], b[at:to], sums[at:to], child, limit))
                at = to

    def _step(self, depth, a, b, sums, child, limit):
        """The pairs of children of pairs of nodes whose sum of differences is within the limit."""
        pattern = self.levels[depth][2]
        wide, high = child[a + 1] - child[a], child[b + 1] - child[b]
        if len(a) == 1 and wide[0] * high[0] > STEP:  # one pair with many children: rows of it at a time
            rows = max(1, STEP // int(high[0]))
            spans = [(np.arange(x, min(x + rows, int(child[a[0] + 1]))), b, sums) for x in range(int(child[a[0]]), int(child[a[0] + 1]), rows)]
        else:
            spans = [(None, b, sums)]
        for left, _, _ in spans:
            if left is None:
                total = wide * high
                pair = np.repeat(np.arange(len(a)), total)
                k = np.arange(int(total.sum())) - np.repeat(np.cumsum(total) - total, total)
                x, y = child[a][pair] + k // high[pair], child[b][pair] + k % high[pair]
            else:
                pair = np.zeros(len(left) * int(high[0]), np.int64)
                x, y = np.repeat(left, int(high[0])), np.tile(np.arange(int(child[b[0]]), int(child[b[0] + 1])), len(left))
            keep = (a[pair] != b[pair]) | (x <= y)
            self.pairs += len(pair)
            pair, x, y = pair[keep], x[keep], y[keep]
            new = sums[pair] + np.bitwise_count(pattern[x] ^ pattern[y])
            near = new <= limit
            yield depth, x[near], y[near], new[near]

    def _join(self, first, size, a, b):
        """Links that join all members of a with all of b (each pair is known to be within the limit)."""
        yield first[a], first[b]
        for node in (a, b):
            many = np.unique(node[size[node] > 1])
            if len(many):
                n = size[many]
                start = np.repeat(first[many], n - 1)
                step = np.arange(int((n - 1).sum())) - np.repeat(np.cumsum(n - 1) - (n - 1), n - 1) + 1
                yield start, start + step


def merge(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """label, a forest of smallest members, with the members a and b joined."""
    while True:
        x, y = label[a], label[b]
        apart = x != y
        if not apart.any():
            return label
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        while True:
            up = label[label]
            if (up == label).all():
                break
            label = up


def _forest(group: np.ndarray, pattern: list[tuple[int, int]], fp: np.ndarray, node: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """Links between nodes, a spanning forest for each group; groups are upper nodes of one pattern."""
    codes = arranged(fp, pattern)
    order = np.lexsort((gray_rank(codes), group))
    group, codes, node = group[order], codes[order], node[order]
    label = np.arange(len(codes))
    for a, b in GrayIndex(group, codes, shared_bits(pattern)).links(limit):
        label = merge(label, a, b)
    moved = np.flatnonzero(label != np.arange(len(label)))
    return node[moved], node[label[moved]]


def _linker(choices: list[list[tuple[int, int]]]):
    """Rows (pattern, upper, part, fp, node), sorted by the first three, into links (a, b)."""

    def linked(table: pa.Table) -> Iterator[pa.RecordBatch]:
        pattern, upper, part, fp, node = (table.column(k).to_numpy() for k in range(5))
        new = (upper[1:] != upper[:-1]) | (part[1:] != part[:-1]) | (pattern[1:] != pattern[:-1])
        group = np.concatenate(([0], np.cumsum(new)))
        for k in np.unique(pattern):
            some = pattern == k
            a, b = _forest(group[some], choices[k], fp[some].view(np.uint64), node[some], LIMIT)
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        rows = 0
        for batch in batches:
            held.append(batch)
            rows += batch.num_rows
            if rows >= 1 << 16:
                table = pa.Table.from_batches(held).combine_chunks()
                differs = np.zeros(rows, bool)
                for k in range(3):
                    column = table.column(k).to_numpy()
                    differs |= column != column[-1]
                last = int(np.flatnonzero(differs)[-1]) + 1 if differs.any() else 0  # the last group may go on
                if last:
                    yield from linked(table.slice(0, last))
                held, rows = table.slice(last).to_batches(), rows - last
        if rows:
            yield from linked(pa.Table.from_batches(held).combine_chunks())

    return run


def links(distinct: DataFrame) -> DataFrame:
    """Links (a, b) between ids of fingerprints that make the same components as all pairs within LIMIT bits.

    distinct: fp long, node long; fingerprints are distinct.
    """
    choices = patterns(blocks_for(distinct.count()))

    def value(pattern: list[tuple[int, int]]) -> Column:
        out = F.lit(0).cast("long")
        for a, b in pattern:
            out = F.shiftleft(out, b - a).bitwiseOR(F.shiftrightunsigned("fp", 64 - b).bitwiseAND(F.lit((1 << (b - a)) - 1).cast("long")))
        return out

    upper = F.explode(F.array(*[F.struct(F.lit(k).alias("pattern"), value(p).alias("upper")) for k, p in enumerate(choices)])).alias("u")
    sent = distinct.select("fp", "node", upper).select("fp", "node", "u.pattern", "u.upper")
    counts = sent.groupBy("pattern", "upper").agg(F.count("*").alias("n"))
    large = store.cut(counts.where(F.col("n") > SEGMENT).select("pattern", "upper", F.ceil(F.col("n") * 2 / SEGMENT).cast("int").alias("segments")))
    # Of one of four blocks there are 4 * 65536 upper nodes, so the large ones are a small table, whatever the data.
    dealt = sent.join(F.broadcast(large) if len(choices) == LIMIT + 1 else large, ["pattern", "upper"], "left")
    own = F.pmod(F.xxhash64("fp"), F.col("segments")).cast("int")
    other = F.explode(F.when(F.col("segments").isNull(), F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.col("segments") - 1)))
    dealt = dealt.withColumn("own", F.coalesce(own, F.lit(0))).withColumn("other", other)
    part = F.shiftleft(F.least("own", "other").cast("long"), 32) + F.greatest("own", "other")
    dealt = dealt.select("pattern", "upper", part.alias("part"), "fp", "node")
    return dealt.repartition("pattern", "upper", "part").sortWithinPartitions("pattern", "upper", "part").mapInArrow(_linker(choices), "a long, b long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fp, component_id for each row of docs: fingerprints link at LIMIT differing bits or fewer.

    component_id is the smallest id that can be reached over links, the row's own included. Null and empty texts
    have fingerprint 0 and are linked like others. Ids are integers; a row with a null id gets the component of its
    fingerprint, null if no row of that fingerprint has an id. Repeated rows each get a row. An empty table gives an
    empty result.
    """
    rows = store.cut(fingerprints(docs, id_col, text_col))
    distinct = store.cut(rows.groupBy("fp").agg(F.min("doc_id").cast("long").alias("node"), F.count("*").alias("n")))
    known = components(links(distinct.where("node is not null").select("fp", "node")))
    table = distinct.join(known.withColumnRenamed("node", "known"), F.col("node") == F.col("known"), "left")
    table = store.cut(table.select("fp", "n", F.coalesce("component", "node").alias("component_id")))
    found = store.lookup(rows, table, "fp", "n", rows.count())
    return found.select(F.col("doc_id").alias(id_col), "fp", "component_id")


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Of each component of fingerprints one row, with all its columns as they were: the one with the smallest id.

    Components are of fingerprints alone, so texts that share an id, or have none, are told apart. A row with a null id
    stays only where no row of its component has an id; of rows with one id the smallest fingerprint stays, of equal rows any.
    """
    rows = store.cut(fingerprints(docs, id_col, text_col))
    distinct = store.cut(rows.groupBy("fp").agg(F.min("doc_id").alias("id"), F.count("*").alias("n")))
    known = components(links(distinct.select("fp", F.col("fp").alias("node")))).withColumnRenamed("node", "fp")
    table = distinct.join(known, "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    least = table.groupBy("component").agg(F.min(F.struct(F.col("id").isNull().alias("without"), "id", "fp")).alias("row"))
    stays = store.cut(least.select("row.id", "row.fp"))
    total, ids = rows.agg(F.count("*"), F.count_distinct("doc_id")).first()
    if total == ids:  # an id says which row
        keys = stays.select(F.col("id").alias("key"))
        return store.marked(docs, store.col(id_col)).join(keys.hint("merge"), "key", "left_semi").select("row.*")
    plain = store.numbered(docs)
    with_fp = plain.mapInArrow(_with_fingerprint(docs.columns.index(text_col), "fp"), StructType([*plain.schema.fields, StructField("fp", LongType())]))
    key = store.name_of(F.col("fp"), F.col(f"c{docs.columns.index(id_col)}"))
    row = F.struct(*[F.col(f"c{k}").alias(c) for k, c in enumerate(docs.columns)])
    return store.pick(with_fp.select(key.alias("key"), row.alias("row")), stays.select(store.name_of(F.col("fp"), F.col("id")).alias("key")))
