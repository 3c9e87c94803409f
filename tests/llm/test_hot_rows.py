"""Tables of which a third or more are equal rows: results stay right and no task holds most of them; small sets of shingles lose no link."""

import random

import numpy as np
import pytest

from millrace.llm import ann, sketch, token_store
from millrace.llm.shared import new_path
from tests.llm.test_operators import brute_components, docs, library_ids, vocabulary  # noqa: F401
from tests.llm.test_resemblance import alike, kept, shingles


def test_token_files_of_equal_rows(spark, vocabulary):  # noqa: F811
    rows = [(None, None)] * 300 + [(7, "same text")] * 300 + [(i, f"own {i}") for i in range(300)]
    shards = token_store.write_tokens(docs(spark, rows), new_path(spark, "tokens"), vocabulary("word_bpe_49k.json"), 2, 12)
    sizes = [r.docs for r in shards.collect()]
    assert sum(sizes) == 900 and max(sizes) <= 2 * np.median(sizes)
    got = sorted((r.start, r.doc_id, r.n_tokens) for r in token_store.read_documents(shards).collect())
    assert [g[1] for g in got] == sorted((d for d, _ in rows), key=lambda d: -1 if d is None else d)
    starts = np.cumsum([0] + [g[2] for g in got])
    assert [g[0] for g in got] == starts[:-1].tolist()
    assert sorted(((d, len(x)) for d, x in library_ids(vocabulary, rows, 2)), key=str) == sorted(((g[1], g[2]) for g in got), key=str)


@pytest.mark.parametrize("parts", [1, 16])
def test_fingerprints_of_equal_rows(spark, parts):
    text = "a text that very many documents hold " * 3
    rows = [(None, None)] * 200 + [(500, text)] * 400 + [(i, f"document {i} of its own words {i * i}") for i in range(300)] + [(900, "last")]
    found = sketch.compare_with_next(docs(spark, rows), parts=parts).collect()
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0)))
    print_of = lambda t: sketch.encode(sketch.sketch(t or ""))
    want = []
    for (d, t), (_, n) in zip(order, order[1:] + order[:1]):
        want.append((d, len(t or ""), print_of(t), sketch.likeness(sketch.sketch(t or ""), sketch.sketch(n or ""))))
    assert sorted(((r.doc_id, r.n_chars, r.fingerprint, r.near_next) for r in found), key=str) == sorted(want, key=str)


def test_one_id_on_many_vectors(spark, monkeypatch):
    """Blocks cut rows of one id too, and every row of it is found."""
    monkeypatch.setattr(ann, "BLOCK", 50)
    rng = np.random.default_rng(3)
    rows = [(7, rng.normal(size=8).tolist()) for _ in range(300)] + [(20 * i, rng.normal(size=8).tolist()) for i in range(1, 16)]
    t = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    found = ann.nearest(t, t.vec_id % 20 == 0).collect()
    hits = 0
    for q, v in rows[300:]:
        scores = sorted(((-float(np.dot(v, w)), i) for i, w in rows if i != q))[:20]
        got = {(r["rank"], round(r.score, 9)) for r in found if r.query_id == q}
        assert len(got) == 20
        hits += len(got & {(k, round(-s, 9)) for k, (s, _) in enumerate(scores, 1)})
    assert hits >= 0.9 * 15 * 20


@pytest.mark.parametrize("n", [4, 5, 9, 12])
def test_small_sets_lose_no_link(spark, n):
    """Pairs of ``n`` shingles and at least four in five of them in common, beside frequent passages that many short texts hold."""
    draw = random.Random(n)
    word = lambda: f"w{draw.randrange(10**6)}"
    common = [word() for _ in range(5)]
    texts = []
    for i in range(150):
        words = [word() for _ in range(n + 4)]
        # a word more at the end adds one shingle: n of n + 1 in common
        texts += [(2 * i, " ".join(words)), (2 * i + 1, " ".join([*words, word()]))]
    texts += [(1000 + i, " ".join(common + [word() for _ in range(n)])) for i in range(100)]
    sets = {d: shingles(t) for d, t in texts}
    roots = brute_components(sorted(sets), lambda a, b: alike(sets[a], sets[b]))
    assert sum(roots[d] != d for d in roots) >= 150
    assert [d for d, _ in sorted(kept(spark, texts))] == sorted(set(roots.values()))
