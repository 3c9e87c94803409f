"""The near-duplicate stage against brute-force Jaccard similarity of shingles."""

import random

import numpy as np
import pytest

from millrace.llm import pipeline_stages, resemblance, simhash
from tests.llm.test_operators import brute_components

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def kept(spark, texts):
    """Rows that stay of ``(doc_id, text)``, as such pairs in order."""
    docs = spark.createDataFrame([(d, t, "en", "x", len(t or "")) for d, t in texts], COLUMNS)
    done = pipeline_stages.drop_near_copies(spark, docs.repartition(3), "")
    assert done.columns == docs.columns
    return sorted(((r.doc_id, r.text) for r in done.collect()), key=str)


def shingles(text):
    words = (text or "").lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def alike(a, b):
    return len(a & b) / len(a | b) >= 0.8 if a or b else True


def test_near_copies_at_the_edge(spark):
    """Pairs of similarity 0.80 to 0.90, which one fingerprint and 7 bits mostly lose, and of 0.70 to 0.80."""
    draw = random.Random(5)
    texts = []
    for i in range(150):
        words = [f"w{draw.randrange(10**6)}" for _ in range(200)]
        other = list(words)
        for at in range(3, 3 + 9 * (1 + i % 6), 9):
            other[at] = f"x{i}y{at}"
        texts += [(2 * i, " ".join(words)), (2 * i + 1, " ".join(other))]
    sets = {d: shingles(t) for d, t in texts}
    pairs = [d for d in sets if d % 2 and alike(sets[d], sets[d - 1])]
    assert 60 <= len(pairs) <= 130
    stay = {d for d, _ in kept(spark, texts)}
    assert stay >= set(sets) - set(pairs)
    assert len(set(pairs) - stay) >= 0.95 * len(pairs)


def test_documents_against_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("doc_id is not null").limit(600)
    texts = [(r.doc_id, r.text) for r in docs.collect()]
    sets = {d: shingles(t) for d, t in texts}
    roots = brute_components(sorted(sets), lambda a, b: min(len(sets[a]), len(sets[b])) >= 0.8 * max(len(sets[a]), len(sets[b])) and alike(sets[a], sets[b]))
    assert [d for d, _ in sorted(kept(spark, texts))] == sorted(set(roots.values()))


def test_linked_sets():
    """Linked sets are those of all pairs, also through others."""
    draw = np.random.default_rng(1)
    base = draw.integers(0, 1 << 63, 400).astype(np.uint64)
    sets = [np.unique(base[i : i + 100]) for i in range(0, 300, 8)] + [np.unique(draw.integers(0, 1 << 63, 50).astype(np.uint64)) for _ in range(20)] + [np.empty(0, np.uint64)] * 2
    of = [set(s.tolist()) for s in sets]
    roots = brute_components(list(range(len(of))), lambda a, b: alike(of[a], of[b]))
    found = {int(i): min(map(int, some)) for some in resemblance.linked_sets(sets) for i in some}
    assert found == roots


def test_blocks(spark, monkeypatch):
    """A cluster of many blocks: each text is linked with the next only, so all hang together by pairs of blocks."""
    monkeypatch.setattr(resemblance, "BLOCK", 5)
    words = [f"w{i}" for i in range(1200)]
    assert [d for d, _ in kept(spark, [(i, " ".join(words[20 * i : 20 * i + 220])) for i in range(40)])] == [0]


def test_unlike_texts_stay(spark):
    """Texts whose fingerprints are near but whose shingles are not: short ones against each other and against texts without words."""
    draw = random.Random(3)
    texts = [(i, " ".join(f"w{draw.randrange(10**6)}" for _ in range(6))) for i in range(4000)]
    texts += [(4000, ""), (4001, None), (4002, " \n ")]
    prints = [simhash.simhash(simhash.shingle_hashes(t, 5)) for _, t in texts]
    assert sum((p & (1 << 64) - 1).bit_count() <= 7 for p in prints[:4000]) and min(np.bitwise_count(np.uint64(p & (1 << 64) - 1) ^ np.array(prints[:i]).view(np.uint64)).min() for i, p in enumerate(prints[:4000]) if i) <= 7
    assert sorted(d for d, _ in kept(spark, texts)) == list(range(4001))


def test_one_row_of_a_group_stays(spark):
    """Rows count, not ids: repeated rows, missing ids, and an id of two texts."""
    one, two, three, four = (" ".join(f"{c}{i}" for i in range(30)) for c in "abcd")
    texts = [(5, one), (5, one), (7, one), (None, two), (None, two), (None, three), (9, three), (7, four), (3, four), (7, "alone here")]
    assert kept(spark, texts) == sorted([(5, one), (None, two), (9, three), (3, four), (7, "alone here")], key=str)


@pytest.mark.parametrize("block,max_bits,count", [(4096, 4, None), (8, 4, None), (8, 14, 3)])
def test_groups_of_variants_lose_no_bucket(monkeypatch, block, max_bits, count):
    """Entries of all tasks, scanned part by part, link what lies within one bit in a segment and ``max_bits`` in all."""
    monkeypatch.setattr(simhash, "BLOCK", block)
    rng, segments, parts = np.random.default_rng(5), simhash.Segments(max_bits, count, 2), 7
    seeds = rng.integers(0, 1 << 64, 40, np.uint64)
    near = [s ^ np.bitwise_or.reduce(np.uint64(1) << rng.choice(64, 3, False).astype(np.uint64)) for s in seeds for _ in range(5)]
    alike = seeds[0] ^ (rng.integers(0, 1 << 20, 60, np.uint64) << np.uint64(44))  # two whole segments in common
    fps = np.unique(np.concatenate([seeds, np.array(near, np.uint64), alike]))
    large = {}
    for kind in range(2):
        for s in range(len(segments.spans)):
            values, n = np.unique(segments.value(fps, s), return_counts=True)
            if (n > block // 2).any():
                large[kind, s] = values[n > block // 2], n[n > block // 2]
    entries = [np.concatenate(c) for c in zip(*(e for kind in range(2) for some in np.array_split(fps, 3) for e in simhash._index(kind, some, segments, large)))]
    assert len(entries[0]) < 2 * len(fps) * len(segments.variants) or large
    part, found = segments.part(*entries, parts), set()
    for p in range(parts):
        x, held = segments.rows(*(c[part == p] for c in entries))
        order = np.lexsort((held & segments.masks[segments.variant(x)], x))
        x, held = x[order], held[order]
        for a, b in simhash._linked(x, held, segments, True):
            found |= {(int(x[i] >> np.uint64(54)) // len(segments.variants), *sorted((int(held[i]), int(held[j])))) for i, j in zip(a, b)}

    def roots(edges):
        at = {int(f): int(f) for f in fps}
        moved = True
        while moved:
            moved = False
            for a, b in edges:
                low = min(at[a], at[b])
                moved |= at[a] != low or at[b] != low
                at[a] = at[b] = low
        return at

    gaps = fps[:, None] ^ fps[None, :]
    close = (np.bitwise_count(gaps) <= max_bits) & (np.bitwise_count(gaps[..., None] & segments.whole) <= 1).any(-1)
    expected = roots([(int(fps[i]), int(fps[j])) for i, j in zip(*np.nonzero(np.triu(close, 1)))])
    for kind in range(2):
        assert roots([e[1:] for e in found if e[0] == kind]) == expected
