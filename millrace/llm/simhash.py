"""SimHash near-dedup by deletion-variant signatures.

A text's fingerprint has 64 bits: a bit is 1 if it is set in over half of the XXH64 hashes of the
text's word shingles. Two fingerprints that differ in at most ``max_bits`` bits, cut into
``max_bits // 2 + 1`` segments, have a segment in which they differ by at most one bit. So each distinct
fingerprint is indexed under each whole segment, and under each segment with one bit left out;
fingerprints that differ by at most one bit in a segment meet under an equal key, and are verified there.

Only connectivity is needed, so a bucket never gives all its pairs: a small one (up to ``SMALL``)
gives each link in the one bucket that is responsible for it, a larger one a spanning tree of each linked
set (whole segments) or one link for each two sets it joins (a bit left out; links within either
side are found under the whole segment). Trees have few children a node, so no node is a hub.

Scale: a fingerprint is sent once for each group of ``TOGETHER`` bits of a segment (21 times at three segments), to where all buckets are
scanned that leave out one of these bits; they are made there. Entries are packed by the task that makes them, a row for each part with 10 bytes an entry. Exact copies are one fingerprint from the first aggregate on. A bucket of more than ``BLOCK``
fingerprints is cut into blocks; each pair of blocks is a group of its own of at most ``2 * BLOCK`` rows
on average, for buckets of up to a thousand million. Which buckets are large follows from counts of whole segments, those above ``BLOCK /
2`` only; these are sent to the tasks up to ``LARGE_SENT`` and joined beyond.

Defined cases: a text without words (null, empty) has fingerprint 0, linked like any other; fewer
words than a shingle give one shingle; repeated rows are alike; a null id gets its group's component but is
no component's id (a group of null ids only has a null component); an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import connected
from .shared import stage, unstage

WORDS, SEED, MAX_BITS = 4, 42, 4
BLOCK, SMALL = 4096, 8
#: Bits of a segment whose variants are scanned in one place: buckets that agree in the segment's other bits.
TOGETHER = 3
#: Values of segments that make large buckets, sent to every task up to this number (16 MB); beyond it buckets learn their blocks in a join.
LARGE_SENT = 1 << 20
#: Entries of the index that a task makes and packs at once, and that four parts hold.
ENTRIES = 1_300_000
_U = np.uint64


def shingle_hashes(text: str | None, words: int = WORDS, seed: int = SEED) -> np.ndarray:
    """XXH64 of each shingle of ``words`` words, in order; words are split at ASCII white space, A-Z lower-cased."""
    parts = (text or "").encode().lower().split()
    if not parts:
        return np.empty(0, _U)
    joined, hashed = b" ".join(parts), xxhash.xxh64_intdigest
    if len(parts) <= words:
        return np.array([hashed(joined, seed)], _U)
    ends = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)) + 1)
    starts = [0, *ends[:-words].tolist()]
    return np.fromiter([hashed(joined[s:e], seed) for s, e in zip(starts, (ends[words - 1 :] - 1).tolist())], _U, len(starts))


def simhash(hashes: np.ndarray) -> int:
    """The bits that are set in over half of ``hashes``, as a signed 64-bit integer."""
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 4096):
        some = hashes[at : at + 4096]
        counts += np.unpackbits(some.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.uint32)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view(np.int64)[0])


def fingerprints(docs: DataFrame, words: int = WORDS, seed: int = SEED, id_col="doc_id", text_col="text") -> DataFrame:
    def fingerprint(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [simhash(shingle_hashes(t, words, seed)) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.int64())], ["doc_id", "fp"])

    plain = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return plain.mapInArrow(fingerprint, "doc_id long, fp long")


class Segments:
    """The segments of a fingerprint, and their variants: each whole segment, and each with one bit left out.

    A row of the index is ``(x, fp)``; x holds the kind of fingerprint and the variant (9 bits together), and for a bucket that is cut into blocks
    their number and the two blocks that meet (18 bits each). ``masks`` of a variant keep the bits of a fingerprint that make its bucket.

    Sent are entries ``(v, pair, fp)``: v holds the kind and a code, that of a variant or (after those) of a group of variants; pair is the rest of x.
    """

    def __init__(self, max_bits: int, count: int | None = None, kinds: int = 1) -> None:
        self.max_bits, self.kinds, n = max_bits, kinds, count or max(3, max_bits // 2 + 1)
        edges = [64 * i // n for i in range(n + 1)]
        self.spans = [(lo, hi - lo) for lo, hi in zip(edges, edges[1:])]
        self.variants = [(s, None) for s in range(n)] + [(s, bit) for s, (_, width) in enumerate(self.spans) for bit in range(width)]
        if len(self.variants) * kinds > 512:
            raise ValueError("more than 512 variants")
        self.whole = np.array([((1 << w) - 1) << lo for lo, w in self.spans], _U)
        # for each variant: its segment, the bit of the fingerprint that it leaves out, and the bits that it keeps
        self.segment_of = np.array([s for s, _ in self.variants])
        self.bit_of = np.array([0 if b is None else 1 << self.spans[s][0] + b for s, b in self.variants], _U)
        self.masks = self.whole[self.segment_of] & ~self.bit_of
        # groups: variants that leave out neighbouring bits, a whole segment with its first; a group keeps the bits that none of them leaves out
        self.group_of = np.empty(len(self.variants), np.int64)
        self.groups: list[list[int]] = []
        for s, (lo, width) in enumerate(self.spans):
            first, n_groups = len(self.groups), max(1, width // TOGETHER)
            self.groups += [[] for _ in range(n_groups)]
            for number, (segment, bit) in enumerate(self.variants):
                if segment == s:
                    self.group_of[number] = first + ((bit or 0) * n_groups) // width
                    self.groups[self.group_of[number]].append(number)
        self.codes = len(self.variants) + len(self.groups)
        self.group_masks = np.array([self.whole[self.segment_of[g[0]]] & ~np.bitwise_or.reduce(self.bit_of[g]) for g in self.groups], _U)
        self.group_sizes = np.array([len(g) for g in self.groups])
        self.group_starts = np.cumsum(self.group_sizes) - self.group_sizes
        self.by_group = np.concatenate(self.groups)

    def variant(self, x: np.ndarray) -> np.ndarray:
        return (x >> _U(54)).astype(np.int64) % len(self.variants)

    def part(self, v: np.ndarray, pair: np.ndarray, fps: np.ndarray, parts: int) -> np.ndarray:
        """Where an entry is scanned, 0 to ``parts`` - 1: a bucket with blocks by itself, all others with their group."""
        code, n = v % self.codes, len(self.variants)
        variant, blocks = np.minimum(code, n - 1), pair > 0
        group = np.where(code < n, self.group_of[variant], code - n)
        mask = np.where(blocks, self.masks[variant], self.group_masks[group])
        place = (np.where(blocks, code, n + group) + (v - code)).astype(_U) << _U(48)
        mixed = ((fps & mask) ^ ((place ^ pair) * _U(0xD6E8FEB86659FD93))) * _U(0x9E3779B97F4A7C15)
        return ((mixed >> _U(32)) % _U(parts)).astype(np.int32)

    def rows(self, v: np.ndarray, pair: np.ndarray, fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The rows ``(x, fp)`` of the index that entries stand for."""
        code, n = v % self.codes, len(self.variants)
        first = (v // self.codes) * n
        single, many = np.flatnonzero(code < n), np.flatnonzero(code >= n)
        sizes = self.group_sizes[code[many] - n]
        of = np.repeat(many, sizes)
        at = np.repeat(self.group_starts[code[many] - n], sizes) + np.arange(len(of)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        x = np.concatenate([(first[single] + code[single]).astype(_U) << _U(54) | pair[single], (first[of] + self.by_group[at]).astype(_U) << _U(54)])
        return x, np.concatenate([fps[single], fps[of]])

    def value(self, fps: np.ndarray, segment: int) -> np.ndarray:
        lo, width = self.spans[segment]
        return fps >> _U(lo) & _U((1 << width) - 1)

    def bucket(self, x: Column, fp: Column) -> Column:
        """The bits that, with x, name a row's bucket."""
        masks = F.array(*[F.lit(int(m)) for m in self.masks.view(np.int64)])
        variant = F.pmod(F.shiftrightunsigned(x, 54), F.lit(len(self.variants))).cast("int")
        return fp.bitwiseAND(F.get(masks, variant))


def _block(fps: np.ndarray, n: np.ndarray) -> np.ndarray:
    return ((fps * _U(0x9E3779B97F4A7C15)) >> _U(33)) % n.astype(_U)


def _dealt(x: np.ndarray, fps: np.ndarray, blocks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows of the index with their blocks: a fingerprint of a bucket of n blocks meets each block once, n rows in all."""
    if not (blocks > 1).any():
        return x, fps
    one, split = blocks <= 1, np.flatnonzero(blocks > 1)
    n = blocks[split]
    rows, own = np.repeat(split, n), np.repeat(_block(fps[split], n), n)
    other = (np.arange(len(rows)) - np.repeat(np.cumsum(n) - n, n)).astype(_U)
    pairs = x[rows] | np.repeat(n, n).astype(_U) << _U(36) | np.minimum(own, other) << _U(18) | np.maximum(own, other)
    return np.concatenate([x[one], pairs]), np.concatenate([fps[one], fps[rows]])


Counts = dict[tuple[int, int], tuple[np.ndarray, np.ndarray]]


def _index(kind: int, fps: np.ndarray, segments: Segments, large: Counts) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Entries (v, pair, fp). large: by kind and segment, sorted values and counts of those that make large buckets.

    A fingerprint of which no bucket of a group has blocks is sent with the group, others with each variant of it.
    """
    first = kind * segments.codes

    def count(segment: int, value: np.ndarray) -> np.ndarray:
        values, counts = large[kind, segment]
        at = np.minimum(np.searchsorted(values, value), len(values) - 1)
        return np.where(values[at] == value, counts[at], BLOCK // 2)

    for group, numbers in enumerate(segments.groups):
        segment, plain = int(segments.segment_of[numbers[0]]), np.ones(len(fps), bool)
        if (kind, segment) in large:
            value, blocks = segments.value(fps, segment), []
            own = count(segment, value)
            for number in numbers:
                bit = segments.variants[number][1]
                members = own if bit is None else own + count(segment, value ^ _U(1 << bit))
                blocks.append(-(-members // BLOCK))
            plain = np.max(blocks, axis=0) <= 1
            for number, n in zip(numbers, blocks):
                pair, held = _dealt(np.zeros(int((~plain).sum()), _U), fps[~plain], n[~plain])
                yield np.full(len(held), first + number), pair, held
        held = fps[plain]
        yield np.full(len(held), first + len(segments.variants) + group), np.zeros(len(held), _U), held


def _sets(fps: np.ndarray, max_bits: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Places of the fingerprints and of those that they were reached from, by linked set; breadth first, over those not yet reached."""
    left, found = np.arange(len(fps)), []
    while len(left):
        reached, came, queue, left = [int(left[0])], [-1], [int(left[0])], left[1:]
        while queue and len(left):
            at = queue.pop()
            near = np.bitwise_count(fps[left] ^ fps[at]) <= max_bits
            if near.any():
                new = left[near].tolist()
                left = left[~near]
                reached += new
                came += [at] * len(new)
                queue += new
        found.append((np.array(reached), np.array(came)))
    return found


def _tree(fps: np.ndarray, max_bits: int, direct: bool) -> Iterator[tuple[int, int]]:
    for some, came in _sets(fps, max_bits):
        for i in range(1, len(some)):
            yield int(some[i]), int(came[i] if direct else some[(i - 1) // 8])


def _across(fps: np.ndarray, side: np.ndarray, max_bits: int) -> Iterator[tuple[int, int]]:
    """One link for each two linked sets, one on either side, that some link joins."""
    a, b = np.flatnonzero(~side), np.flatnonzero(side)
    if not len(a) or not len(b):
        return
    of = np.empty(len(b), np.int64)
    for number, (some, _) in enumerate(_sets(fps[b], max_bits)):
        of[some] = number
    for some, _ in _sets(fps[a], max_bits):
        open_b = np.arange(len(b))
        for one in a[some].tolist():
            near = open_b[np.bitwise_count(fps[b[open_b]] ^ fps[one]) <= max_bits]
            if len(near):
                numbers, first = np.unique(of[near], return_index=True)
                yield from ((one, int(b[x])) for x in near[first].tolist())
                open_b = open_b[~np.isin(of[open_b], numbers)]
            if not len(open_b):
                break


def _linked(x: np.ndarray, fps: np.ndarray, segments: Segments, direct: bool = False) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Links as arrays of places, from rows sorted by x and bucket that hold whole buckets."""
    variant = segments.variant(x)
    bucket = fps & segments.masks[variant]
    starts = np.flatnonzero(np.concatenate([[True], (x[1:] != x[:-1]) | (bucket[1:] != bucket[:-1])]))
    sizes = np.diff(np.append(starts, len(x)))
    blocks = x[starts] >> _U(36) & _U((1 << 18) - 1)
    small = (sizes > 1) & (sizes <= SMALL) & (blocks == 0)
    size_at = np.repeat(np.where(small, sizes, 0), sizes)
    place = np.arange(len(x)) - np.repeat(starts, sizes)
    for step in range(1, SMALL):
        i = np.flatnonzero(place + step < size_at)
        if not len(i):
            break
        i = i[np.bitwise_count(fps[i] ^ fps[i + step]) <= segments.max_bits]
        gap = fps[i] ^ fps[i + step]
        near = np.bitwise_count(gap[:, None] & segments.whole[None, :]) <= 1
        own = variant[i]
        # of the buckets in which two fingerprints meet, one gives their link
        good = near.argmax(1) == segments.segment_of[own] if len(i) else np.zeros(0, bool)
        good = good & ((gap & segments.whole[segments.segment_of[own]]) == segments.bit_of[own])
        yield i[good], i[good] + step
    for run in np.flatnonzero((sizes > 1) & ~small).tolist():
        at, n = int(starts[run]), int(sizes[run])
        some, bit = fps[at : at + n], segments.bit_of[variant[at]]
        first, second = int(x[at] >> _U(18) & _U((1 << 18) - 1)), int(x[at] & _U((1 << 18) - 1))
        if first != second:
            own = _block(some, np.full(n, int(blocks[run])))
            links = list(_across(some, own == _U(second), segments.max_bits))
        elif bit:
            links = list(_across(some, (some & bit) != 0, segments.max_bits))
        else:
            links = list(_tree(some, segments.max_bits, direct))
        if links:
            found = np.array(links) + at
            yield found[:, 0], found[:, 1]


def _large(prints: DataFrame, segments: Segments) -> DataFrame:
    """``(kind, segment, value, n)`` of the values of whole segments that more than half a block of fingerprints have."""
    values = [F.struct(F.lit(s).alias("segment"), F.shiftrightunsigned("fp", lo).bitwiseAND(F.lit((1 << width) - 1)).alias("value")) for s, (lo, width) in enumerate(segments.spans)]
    each = prints.select("kind", F.explode(F.array(*values)).alias("v")).select("kind", "v.segment", "v.value")
    return each.groupBy("kind", "segment", "value").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > BLOCK // 2)


def _bucket_blocks(large: DataFrame, segments: Segments) -> DataFrame:
    """``(x, bucket, blocks)`` of the buckets of more than one block: a value's own, and those that leave out one of its bits."""
    n = len(segments.variants)
    shapes = [F.struct(F.lit(number).cast("long").alias("number"), F.lit(s).alias("segment"), F.lit(int(segments.masks.view(np.int64)[number])).alias("mask"), F.lit(segments.spans[s][0]).alias("lo"), F.lit(bit is None).alias("whole")) for number, (s, bit) in enumerate(segments.variants)]
    each = large.withColumn("v", F.explode(F.array(*shapes))).where("v.segment = segment")
    x = F.shiftleft(F.col("kind").cast("long") * n + F.col("v.number"), 54)
    bucket = F.expr("shiftleft(value, v.lo)").bitwiseAND(F.col("v.mask"))
    met = each.groupBy(x.alias("x"), bucket.alias("bucket"), "v.whole").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("sides"))
    members = F.col("n") + F.when(F.col("whole"), 0).otherwise((2 - F.col("sides")) * (BLOCK // 2))
    return met.select("x", "bucket", F.ceil(members / BLOCK).cast("long").alias("blocks")).where("blocks > 1")


def links(prints: DataFrame, max_bits: int = MAX_BITS, count: int | None = None, kinds: int = 1, direct: bool = False, entries: int = ENTRIES) -> DataFrame:
    """Edges ``(kind, a, b)`` between fingerprints whose components are those of all links of a kind; rows ``(kind, fp)``, distinct.

    Edges of large buckets make shallow trees; with ``direct`` each edge is itself a link of at most ``max_bits``.
    ``count`` segments instead of ``max_bits // 2 + 1`` find only fingerprints that are within one bit in some segment. A task makes and packs ``entries``
    entries at once, some 100 bytes each while it does.
    """
    segments = Segments(max_bits, count, kinds)
    spark = prints.sparkSession
    large = stage(_large(prints, segments), "large")
    if large.count() <= LARGE_SENT:
        often = large.orderBy("kind", "segment", "value").toArrow().to_pandas()
        sent = spark.sparkContext.broadcast({k: (g["value"].to_numpy(_U), g["n"].to_numpy(np.int64)) for k, g in often.groupby(["kind", "segment"])})
    else:
        sent = None

    def packed(v: np.ndarray, pair: np.ndarray, fps: np.ndarray) -> pa.RecordBatch:
        """A row ``(part, v, pairs, fps)`` for each part: its entries end to end, by v. pairs is null where no bucket has blocks."""
        part = segments.part(v, pair, fps, parts)
        order = np.lexsort((pair, v, part))
        v, pair, fps, part = v[order], pair[order], fps[order], part[order]
        starts = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]]))
        ends = np.append(starts, len(v)).astype(np.int32)
        blob = lambda a: pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer((ends * a.itemsize).astype(np.int32)), pa.py_buffer(a.tobytes())])
        pairs = blob(pair) if pair.any() else pa.nulls(len(starts), pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(part[starts]), blob(v.astype(np.uint16)), pairs, blob(fps)], ["part", "v", "pairs", "fps"])

    total = prints.count() * len(segments.variants)
    tasks, parts = -(-total // entries), 4 * -(-total // ENTRIES)

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def done() -> pa.RecordBatch:
            kind, fps = (np.concatenate([b.column(i).to_numpy() for b in held]) for i in (0, 1))
            made = [entry for k in np.unique(kind).tolist() for entry in _index(k, fps[kind == k].view(_U), segments, sent.value)]
            held.clear()
            return packed(*map(np.concatenate, zip(*made)))

        for batch in batches:
            for at in range(0, batch.num_rows, 5000):
                held.append(batch.slice(at, 5000))
                if sum(b.num_rows for b in held) >= entries // len(segments.variants):
                    yield done()
        if any(b.num_rows for b in held):
            yield done()

    def plain_index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kind, fps = (c.to_numpy() for c in batch.columns)
            for number in range(len(segments.variants)):
                x = (kind.astype(_U) * _U(len(segments.variants)) + _U(number)) << _U(54)
                yield pa.RecordBatch.from_arrays([pa.array(x.view(np.int64)), pa.array(fps)], ["x", "fp"])

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, fps, blocks = (c.to_numpy() for c in batch.columns)
            for at in range(0, len(x), 64):
                made, held = _dealt(*(v[at : at + 64].view(t) for v, t in ((x, _U), (fps, _U), (blocks, np.int64))))
                kind, variant = np.divmod((made >> _U(54)).astype(np.int64), len(segments.variants))
                yield packed(kind * segments.codes + variant, made & _U((1 << 54) - 1), held)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def found(rows: list[tuple]) -> pa.RecordBatch:
            fps = np.frombuffer(b"".join(r[2] for r in rows), _U)
            v = np.frombuffer(b"".join(r[0] for r in rows), np.uint16).astype(np.int64)
            x, fps = segments.rows(v, np.frombuffer(b"".join(r[1] or bytes(len(r[2])) for r in rows), _U), fps)
            order = np.lexsort((fps & segments.masks[segments.variant(x)], x))
            x, fps = x[order], fps[order]
            pairs = list(_linked(x, fps, segments, direct))
            at = np.concatenate([p[0] for p in pairs] or [np.empty(0, np.int64)])
            to = np.concatenate([p[1] for p in pairs] or [np.empty(0, np.int64)])
            kind = (x[at] >> _U(54)).astype(np.int32) // len(segments.variants)
            return pa.RecordBatch.from_arrays([pa.array(kind, pa.int32()), pa.array(fps[at].view(np.int64)), pa.array(fps[to].view(np.int64))], ["kind", "a", "b"])

        now, rows = None, []
        for batch in batches:
            for part, *row in zip(*(c.to_pylist() for c in batch.columns)):
                if part != now:
                    if rows:
                        yield found(rows)
                    now, rows = part, []
                rows.append(row)
        if rows:
            yield found(rows)

    schema = "part int, v binary, pairs binary, fps binary"
    if sent is not None:
        # a task with few fingerprints would make short rows
        rows = prints.select(F.col("kind").cast("int"), "fp").coalesce(max(tasks, 1)).mapInArrow(index, schema)
    else:  # too many large values to send: buckets meet their number of blocks in a join
        blocks = stage(_bucket_blocks(large, segments), "blocks")
        keyed = prints.select(F.col("kind").cast("int"), "fp").mapInArrow(plain_index, "x long, fp long")
        keyed = keyed.withColumn("bucket", segments.bucket(F.col("x"), F.col("fp"))).join(blocks, ["x", "bucket"], "left")
        rows = keyed.select("x", "fp", F.coalesce("blocks", F.lit(1).cast("long")).alias("blocks")).mapInArrow(deal, schema)
    return rows.repartition(max(parts, 1), "part").sortWithinPartitions("part").mapInArrow(scan, "kind int, a long, b long")


def components(docs: DataFrame, max_bits: int = MAX_BITS, words: int = WORDS, seed: int = SEED, id_col="doc_id", text_col="text") -> DataFrame:
    """``(doc_id, fingerprint, component_id)`` for each row of ``docs``."""
    found = stage(fingerprints(docs, words, seed, id_col, text_col), "fingerprints")
    least = stage(found.groupBy("fp").agg(F.min("doc_id").alias("least")), "nodes")
    edges = stage(links(least.select(F.lit(0).alias("kind"), "fp"), max_bits).select("a", "b"), "links")
    roots = connected(edges)
    rooted = least.join(roots, least["fp"] == roots["node"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    named = stage(rooted.groupBy("root").agg(F.min("least").alias("component_id")).join(rooted, "root").select("fp", "component_id"), "components")
    unstage(edges, roots)
    return found.join(named, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
