"""Near copies by the Jaccard similarity of word shingles: SimHash fingerprints find candidates, exact sets decide.

1. *Sets.* A text is the set of XXH64 hashes of its word shingles. Rows of equal sets are one node from the first
   aggregate on.
2. *Candidates.* One fingerprint of 64 bits cannot tell a similarity of 0.8 (9.7 bits differ on average) from chance without losing most
   pairs. So a set has ``PRINTS`` fingerprints, each of the same hashes mixed anew. Each is cut into three segments, and
   deletion-variant signatures (:mod:`.simhash`) find fingerprints of which a segment differs by at most one bit and the whole by ``NEAR`` at
   most. Such nodes are candidates if all their fingerprints together differ by ``FAR`` bits at most.
   Sets of up to ``FEW`` shingles, which fingerprints tell apart badly, meet exactly instead: of two such sets of similarity ``share`` or more, the rarest ``n - ceil(share n) + 1``
   shingles of each have one in common. Rarity is counted over all such sets; sets that share a rare shingle are candidates, each with the least of them.
3. *Links.* Candidates make clusters; all sets of a cluster are compared exactly, and only pairs of similarity ``share`` or more are linked.

Sets of up to a dozen shingles always meet those of similarity 0.8. Larger ones of similarity 0.8 meet with probability 0.95 (each segment: 0.13), of 0.85 with 0.99, of 0.9 with 0.9997; tests measure it.

Scale: the index has 21 entries of 10 bytes for each fingerprint, which stand for 67; its buckets are those of :mod:`.simhash`. Only sets that meet another
are read again, once each. A cluster of more than ``BLOCK`` weight (a node, or each ``HASHES`` hashes of it) is cut into blocks, and each
pair of blocks is compared by itself: work there grows with the square of the cluster. Within a group, sets that
are linked are reached breadth first, so a group of like texts costs one pass and only unlike ones cost a pass each.

Defined cases: texts without words (null, empty) are alike and like no other; fewer words than a shingle give one
shingle; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import connected
from .shared import forget_others, stage, unstage
from .simhash import ENTRIES, links, shingle_hashes, simhash

WORDS, SEED, SHARE = 5, 42, 0.8
#: Fingerprints of a set; bits that one of them may differ in, and all of them together.
PRINTS, NEAR, FAR = 7, 14, 110
#: Largest set that meets others by its rarest shingles: partners of sets of up to 12.
FEW = 15
BLOCK, HASHES = 4096, 500
#: Rows of candidates (24 bytes each) that are broadcast to where the texts are; more meet them in a shuffle.
ROWS_SENT = 2_000_000
_U = np.uint64
_MASKS = np.random.default_rng(SEED).integers(0, 1 << 64, PRINTS, _U)


def shingle_set(text: str | None, words: int = WORDS, seed: int = SEED) -> np.ndarray:
    return np.unique(shingle_hashes(text, words, seed))


def mixed(hashes: np.ndarray, mask: np.uint64) -> np.ndarray:
    """Other hashes out of hashes: every bit depends on all bits (rounds of shifts and multiplications by odd constants)."""
    x = hashes ^ mask
    for shift, odd in ((32, 0x9E3779B97F4A7C15), (29, 0xD6E8FEB86659FD93), (32, 1)):
        x = (x ^ (x >> _U(shift))) * _U(odd)
    return x


def fingerprints(hashes: np.ndarray) -> list[int]:
    """``PRINTS`` fingerprints of a set, signed; none for an empty set."""
    return [simhash(mixed(hashes, mask)) for mask in _MASKS] if len(hashes) else []


def linked_sets(sets: list[np.ndarray], share: float = SHARE) -> list[list[int]]:
    """Places of the sets, by what is linked through pairs of Jaccard similarity ``share`` or more; breadth first."""
    sizes = np.array([len(s) for s in sets])
    if not sizes.all():
        empty, others = np.flatnonzero(sizes == 0).tolist(), np.flatnonzero(sizes)
        return [empty, *([others[i] for i in some] for some in linked_sets([sets[i] for i in others], share))] if len(others) else [empty]
    values, flat = np.unique(np.concatenate(sets), return_inverse=True)
    bounds = np.concatenate([[0], np.cumsum(sizes)])
    numbers = [flat[lo:hi] for lo, hi in zip(bounds, bounds[1:])]
    held = np.zeros(len(values), bool)
    left, found = np.arange(len(sets)), []
    at, starts = flat, bounds[:-1]
    whole = len(left)  # sets that ``at`` holds, some of which are reached since
    places = left
    open_ = np.ones(len(sets), bool)
    for first in range(len(sets)):
        if not open_[first]:
            continue
        open_[first] = False
        reached, queue = [first], [first]
        while queue:
            if 2 * open_.sum() < whole:
                places = np.flatnonzero(open_)
                if not len(places):
                    break
                whole = len(places)
                at = np.concatenate([numbers[i] for i in places])
                starts = np.concatenate([[0], np.cumsum(sizes[places])[:-1]])
            one = queue.pop()
            held[numbers[one]] = True
            common = np.add.reduceat(held[at], starts, dtype=np.int64)
            held[numbers[one]] = False
            near = open_[places] & (common / (sizes[places] + sizes[one] - common) >= share)
            new = places[near].tolist()
            open_[new] = False
            reached += new
            queue += new
        found.append(reached)
    return found


def _sketches(rows: DataFrame, words: int, seed: int) -> DataFrame:
    """``(row, key, size, prints, few)`` of rows ``(row, text)``; equal sets have equal keys, and ``few`` is a set of up to ``FEW`` shingles itself."""

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget_others()
        for batch in (b.slice(at, 500) for b in batches for at in range(0, b.num_rows, 500)):
            keys, sizes, prints, few = [], [], [], []
            for text in batch.column(1).to_pylist():
                own = shingle_set(text, words, seed)
                keys.append(xxhash.xxh3_128_digest(own.tobytes()))
                sizes.append(len(own))
                prints.append(fingerprints(own))
                few.append(own.view(np.int64) if 0 < len(own) <= FEW else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(keys, pa.binary()), pa.array(sizes, pa.int64()), pa.array(prints, pa.list_(pa.int64())), pa.array(few, pa.list_(pa.int64()))], ["row", "key", "size", "prints", "few"])

    return rows.select("row", "text").mapInArrow(sketch, "row long, key binary, size long, prints array<long>, few array<long>")


def _rare_meetings(nodes: DataFrame, share: float) -> DataFrame:
    """``(a, b)``: small sets with the least node that has one of their rarest shingles among its own; rows ``(node, few)``."""
    each = stage(nodes.where("few is not null").select("node", F.size("few").alias("n"), F.explode("few").alias("hash")), "few")
    # the n of a shingle's sets decides which of a set's shingles are rare; equal counts go by the hash
    counted = each.join(each.groupBy("hash").agg(F.count(F.lit(1)).alias("held")), "hash")
    ordered = counted.groupBy("node", "n").agg(F.array_sort(F.collect_list(F.struct("held", "hash"))).alias("by"))  # FEW at most
    # ceil without the rounding error of a product
    most = F.col("n") - F.ceil(F.col("n") * share - 1e-9) + 1
    rare = stage(ordered.select("node", F.explode(F.slice("by", 1, most.cast("int"))).alias("r")).where("r.held > 1").select("node", "r.hash"), "rare")
    met = rare.groupBy("hash").agg(F.min("node").alias("least"))
    return rare.join(met, "hash").where("node != least").select(F.col("node").alias("a"), F.col("least").alias("b"))


def _clusters(nodes: DataFrame, share: float) -> DataFrame:
    """``(node, root)`` for each node of rows ``(node, prints, few)`` that is a candidate with another."""
    each = nodes.select("node", F.posexplode("prints").alias("kind", "fp"))
    held = stage(each.groupBy("kind", "fp").agg(F.min("node").alias("least"), F.count(F.lit(1)).alias("n")), "prints")
    found = stage(links(held.select("kind", "fp"), NEAR, 3, PRINTS, direct=True, entries=ENTRIES // 3).distinct(), "print-links")
    same = each.join(held.where("n > 1").drop("n"), ["kind", "fp"]).where("node != least").select(F.col("node").alias("a"), F.col("least").alias("b"))
    at = lambda end: held.select("kind", F.col("fp").alias(end), F.col("least").alias(f"node_{end}"))
    unlike = found.join(at("a"), ["kind", "a"]).join(at("b"), ["kind", "b"]).select(F.col("node_a").alias("a"), F.col("node_b").alias("b"))
    met = stage(same.union(unlike).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a != b").distinct(), "candidates")
    own = lambda end: nodes.select(F.col("node").alias(end), F.col("prints").alias(f"prints_{end}"))
    bits = F.aggregate(F.zip_with("prints_a", "prints_b", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)
    near = stage(met.join(own("a"), "a").join(own("b"), "b").where(bits <= FAR).select("a", "b"), "near")
    near = stage(near.union(_rare_meetings(nodes, share)).distinct(), "near-or-rare")
    unstage(held, found, met)
    return connected(near)


def _links(clustered: DataFrame, words: int, seed: int, share: float) -> DataFrame:
    """Edges ``(a, b)`` whose components are those of all links; rows ``(root, blocks, node, text)``."""

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                some = batch.slice(at, 1000)
                sets = [shingle_set(t, words, seed).view(np.int64) for t in some.column(3).to_pylist()]
                ends = np.concatenate([[0], np.cumsum([len(s) for s in sets])])
                held = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(sets)))
                yield pa.RecordBatch.from_arrays([*some.columns[:3], held], ["root", "blocks", "node", "hashes"])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, nodes, sets = None, [], []
        a: list[int] = []
        b: list[int] = []

        def finish() -> None:
            for some in linked_sets(sets, share) if len(sets) > 1 else []:
                for i in range(1, len(some)):
                    a.append(nodes[some[i]])
                    b.append(nodes[some[(i - 1) // 8]])

        for batch in batches:
            held = batch.column(4)
            flat, ends = held.values.to_numpy().view(_U), held.offsets.to_numpy()
            for i, (root, low, high, node) in enumerate(zip(*(batch.column(c).to_pylist() for c in range(4)))):
                if (root, low, high) != group:
                    finish()
                    group, nodes, sets = (root, low, high), [], []
                nodes.append(node)
                sets.append(flat[ends[i] : ends[i + 1]].copy())
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])
            a.clear()
            b.clear()
        finish()
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    sets = clustered.select("root", "blocks", "node", "text").mapInArrow(hashed, "root long, blocks long, node long, hashes array<long>")
    own = F.pmod(F.xxhash64("node"), F.col("blocks"))
    dealt = sets.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    dealt = dealt.select("root", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"), "node", "hashes")
    return dealt.repartition("root", "low", "high").sortWithinPartitions("root", "low", "high", "node").mapInArrow(scan, "a long, b long")


def components(rows: DataFrame, share: float = SHARE, words: int = WORDS, seed: int = SEED) -> DataFrame:
    """``(row, component)`` for each of ``rows`` ``(row, text)``: the least row that it is linked with through others.

    ``row`` is a unique number; ``rows`` is read twice, so it has to be a staged table.
    """
    sketches = stage(_sketches(rows, words, seed), "sketches")
    nodes = stage(sketches.groupBy("key").agg(F.min("row").alias("node"), F.min("size").alias("size")), "nodes")
    printed = stage(sketches.select(F.col("row").alias("node"), "prints", "few").join(nodes.select("node"), "node"), "printed")
    loose = _clusters(printed, share).join(nodes.select("node", "size"), "node")
    loose = stage(loose.select("node", "root", "size"), "clusters")
    unstage(printed)
    weight = F.sum(F.ceil(F.greatest(F.lit(1), F.col("size") / HASHES)))
    large = loose.groupBy("root").agg(weight.alias("weight")).where(F.col("weight") > BLOCK)
    large = large.select("root", F.ceil(F.col("weight") / BLOCK).cast("long").alias("blocks"))  # a row for each BLOCK nodes at most
    large = stage(large, "large")
    cut = loose.join(F.broadcast(large) if large.count() <= ROWS_SENT else large, "root", "left").select("node", "root", F.coalesce("blocks", F.lit(1).cast("long")).alias("blocks"))
    cut = stage(cut, "cut")
    sent = F.broadcast(cut) if cut.count() <= ROWS_SENT else cut
    clustered = rows.select(F.col("row").alias("node"), "text").join(sent, "node")
    roots = stage(connected(stage(_links(clustered, words, seed, share), "links")), "roots")
    named = nodes.join(roots, "node", "left").select("key", F.coalesce("root", "node").alias("component"))
    return sketches.select("row", "key").join(stage(named, "named"), "key").select("row", "component")


def spare_rows(rows: DataFrame, order: list[Column], share: float = SHARE, words: int = WORDS, seed: int = SEED) -> DataFrame:
    """``(row)`` of all rows of each component but its first by ``order``: what goes if one row of a group of near copies stays."""
    found = stage(components(rows.select("row", "text"), share, words, seed), "components")
    large = found.groupBy("component").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("component")
    met = found.join(large, "component").join(rows.drop("text"), "row")
    first = met.groupBy("component").agg(F.min(F.struct(*order, "row"))["row"].alias("first"))
    return stage(met.join(first, "component").where("row != first").select("row"), "spare")
