"""Manifest, tree-joined BPE and delta Lloyd against brute-force versions."""

import hashlib
import math
import zlib

import numpy as np
import pyarrow.parquet as pq
import pytest

from millrace.llm import delta_lloyd, merkle, tree_bpe
from pyspark.sql import functions as F

LONG = "word " * 30_000


@pytest.fixture(scope="module")
def vocabulary():
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library(vocabulary):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(vocabulary)


# --- 11 manifest

sha = lambda x: hashlib.sha256(x.encode()).hexdigest()


def brute_manifest(rows, fanout=3):
    def leaf(row):
        return sha("".join("-" if x is None else f"{len(str(x).encode())}:{x}" for x in row))

    def climb(nodes):
        levels = [nodes]
        while len(levels[-1]) > 1:
            levels.append([sha("".join(levels[-1][i : i + fanout])) for i in range(0, len(levels[-1]), fanout)])
        return levels

    def path(levels, i):
        out = []
        for level in levels[:-1]:
            first = i - i % fanout
            out.append(("".join(level[first:i]), "".join(level[i + 1 : first + fanout])))
            i //= fanout
        return out

    first = lambda x: (x is not None, x if not isinstance(x, str) else x.encode())
    groups = {}
    for row in rows:
        groups.setdefault(row[1], []).append(row)
    names = sorted(groups, key=first)
    trees = []
    for name in names:
        groups[name].sort(key=lambda r: (r[0] is not None, r[0], leaf(r)))
        trees.append(climb([leaf(r) for r in groups[name]]))
    over = climb([t[-1][0] for t in trees])
    root, out = over[-1][0], []
    for g, name in enumerate(names):
        for i, row in enumerate(groups[name]):
            steps = path(trees[g], i) + path(over, g)
            changed = row
            if row[0] is not None and zlib.crc32(str(row[0]).encode()) % 2 == 0 and row[4] is not None:
                changed = (*row[:4], row[4].replace("\n", ""))
            at = leaf(changed)
            for before, after in steps:
                at = sha(before + at + after)
            out.append((row[0], leaf(row), trees[g][-1][0], root, sha("".join(b + a for b, a in steps)), at, at == root))
    return sorted(out, key=str)


def document_rows():
    rows = [(i, f"s{i % 7}", "en", i % 50, f"text\nof {i}") for i in range(60)]
    rows += [(i, "hot", None, None, "same text\n" if i % 3 else "plain") for i in range(100, 190)]
    rows += [(None, None, None, None, None)] * 3 + [(5, None, "é", 3, ""), (7, "é", "日本", 0, LONG), (7, "hot", "en", 1, "x\ny"), (7, "hot", "en", 1, "x\ny"), (8, "", "en", 1, "\n\n"), (None, "hot", None, None, "a\nb")]
    return rows


def as_documents(spark, rows):
    made = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string")
    return made.withColumn("leaf", F.lit(1)).withColumn("sid", F.lit("x")).withColumn("i", F.lit(2)).withColumn("root", F.lit("r"))


@pytest.mark.parametrize("levels", [1, 2, 6])
def test_manifest(spark, levels):
    rows = document_rows()
    found = merkle.document_manifest(as_documents(spark, rows).repartition(5), levels=levels, with_path=levels == 2).collect()
    names = "doc_id leaf subroot root proof_sha256 folded_root verified".split()
    assert sorted((tuple(r[n] for n in names) for r in found), key=str) == brute_manifest(rows)
    if levels == 2:
        assert all(merkle.check_proof(r.leaf, r.path, r.root) for r in found)
        assert not any(merkle.check_proof(sha("other"), r.path, r.root) for r in found)


@pytest.mark.parametrize("rows", [[(4, "a", "en", 1, "t\n")], [(1, "a", None, 1, "x"), (2, "b", None, 1, "y\n")], [(i, "a", "en", 1, "q") for i in range(9)]])
def test_small_manifests(spark, rows):
    found = merkle.document_manifest(as_documents(spark, rows), levels=1).collect()
    assert sorted((tuple(r) for r in found), key=str) == brute_manifest(rows)


def test_manifest_of_equal_rows(spark):
    rows = [(1, "a", "en", 1, "q")] * 400 + [(i, "b", "en", 1, "q") for i in range(200)]
    spread = merkle.numbered(as_documents(spark, rows).select(F.col("source").alias("grp"), F.col("doc_id").alias("ord"), F.unhex(F.lit("00")).alias("leaf"), F.lit(None).cast("binary").alias("folded"), F.xxhash64(F.monotonically_increasing_id()).alias("salt")))
    assert {(r.sid, r.i) for r in spread.collect()} == {(0, i) for i in range(400)} | {(1, i) for i in range(200)}
    assert sorted((tuple(r) for r in merkle.document_manifest(as_documents(spark, rows)).collect()), key=str) == brute_manifest(rows)
    assert merkle.document_manifest(as_documents(spark, [])).count() == 0


# --- 12 BPE by tree concatenation

ODD = ["<|endoftext|>", "a<|endoftext|>  <|endo", "  <|endoftext|> 's", "՘a₏1\U00010940", "it's we'll I'VE 'tis", " \t\n  \r\n x  ", "é‍👩‍👩‍👧", "\x00\x1c\x1f\x85 ", "ß" * 300, "12345" * 50, "aaaa" * 99, "=" * 777, "日本語" * 200, "don''t", "퟿"]


def random_texts(n, seed=7):
    rng = np.random.default_rng(seed)
    parts = ["a", "the", " the", "'s", "'re", " ", "  ", "\n", "\t", "1", "23", "é", "日", "🙂", "<|endoftext|>", "<|endo", ".", "...", "tion", "ing ", "՘", "aaaaaaaa", "xyzzy", "'"]
    return ["".join(rng.choice(parts, rng.integers(1, 120))) for _ in range(n)]


def test_pieces_and_joins(vocabulary, library):
    bpe = tree_bpe.TreeBpe.load(vocabulary)
    rng = np.random.default_rng(1)
    for text in ODD + random_texts(300) + ["".join(rng.choice(list("abe"), 400)), "ab" * 700, "a" * 1500, "x" + "é" * 900]:
        want = library.encode(text, add_special_tokens=False).ids
        assert bpe.encode(text).tolist() == want, text
        for size in (1, 3, 17, 64):
            if len(text) > 400 and size < 17:
                continue
            ids = bpe.join_all([bpe.encode_block(text[i : i + size]) for i in range(0, len(text), size)])
            assert (ids & tree_bpe._ID).tolist() == want, (text, size)
            assert bpe.decode(ids) == text == library.decode(want, skip_special_tokens=False)


def test_merges_are_leftmost_lowest(vocabulary, library):
    bpe = tree_bpe.TreeBpe.load(vocabulary)
    rng = np.random.default_rng(4)
    for alphabet in ("ab", "tionhe", "aé"):
        for n in (5, 40, 90, 300):
            text = "".join(rng.choice(list(alphabet), n))
            want = library.encode(text, add_special_tokens=False).ids
            assert bpe.encode_bytes(text.encode()) == bpe.merged([bpe.base[b] for b in text.encode()]) == want


@pytest.mark.parametrize("block,levels", [(64, 1), (100, 2), (tree_bpe.BLOCK, 3)])
def test_tree_documents(spark, sf_dir, vocabulary, library, block, levels):
    texts = pq.read_table(f"{sf_dir}/documents.parquet", columns=["text"])["text"].to_pylist()[:40]
    rows = [(None, None), (None, "null id"), (1, ""), (3, "one"), (3, "one"), (6, "a" * 5000), (6, "a" * 5000), (7, LONG[:40_000])]
    rows += list(enumerate(ODD + random_texts(20) + texts, 10))
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("row", F.lit("x")).withColumn("node", F.lit(1)).withColumn("ids", F.lit(0)).repartition(3)
    found = tree_bpe.encode_documents(docs, vocabulary, block, levels, with_ids=True).collect()
    want = []
    for d, t in rows:
        ids = library.encode(t or "", add_special_tokens=False).ids
        text = library.decode(ids, skip_special_tokens=False)
        want.append((d, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(text.encode()).hexdigest(), ids, text))
    assert sorted((tuple(r) for r in found), key=str) == sorted(want, key=str)
    assert tree_bpe.encode_documents(docs.limit(0), vocabulary).count() == 0


# --- 13 delta Lloyd

def brute_lloyd(rows, k=8, rounds=10, dims=64):
    kept = [(i, [math.floor(1024 * float(x)) for x in v]) for i, v in rows if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)]
    at = lambda r: (r[0] is None, hashlib.sha256(f"3:{r[0]}".encode()).hexdigest() if r[0] is not None else "", r[1])
    centroids = [v for _, v in sorted(kept, key=at)[:k]]

    def nearest(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c)), j) for j, c in enumerate(centroids))

    for _ in range(rounds):
        owners = [nearest(v)[1] for _, v in kept]
        for j in range(len(centroids)):
            own = [v for (_, v), o in zip(kept, owners) if o == j]
            if own:
                centroids[j] = [sum(x) // len(own) for x in zip(*own)]
    done = [(i, *nearest(v)[::-1]) for i, v in kept]
    inertia = {}
    for _, c, d in done:
        inertia[c] = inertia.get(c, 0) + d
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return sorted(((i, c, d, inertia[c], sum(inertia.values()), digest[c]) for i, c, d in done), key=str)


def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("row", F.lit("x")).withColumn("cluster", F.lit(1)).withColumn("moved", F.lit(2))


def test_delta_lloyd(spark):
    rng = np.random.default_rng(5)
    rows = [(i, (rng.normal(size=4) + 3 * (i % 5)).tolist()) for i in range(300)]
    rows += [(None, [1.0, -1.0, 0.5, 0.25]), (7, [1.0, 2.0, 3.0, 4.0]), (7, [1.0, 2.0, 3.0, 4.0]), (900, None), (901, [1.0]), (902, [1.0, None, 1.0, 1.0]), (903, [math.inf, 0.0, 0.0, 0.0]), (904, [math.nan] * 4), (905, [])]
    for rounds in (0, 1, 10):
        found = delta_lloyd.cluster(vectors(spark, rows).repartition(4), dims=4, rounds=rounds)
        assert sorted((tuple(r) for r in found.collect()), key=str) == brute_lloyd(rows, dims=4, rounds=rounds)


@pytest.mark.parametrize("rows", [[], [(1, None)], [(1, [0.5, -0.5]), (2, [0.5, -0.5])], [(i, [1.0, 1.0]) for i in range(50)], [(i, [float(i % 3), -1e-9]) for i in range(40)]])
def test_degenerate_clusters(spark, rows):
    found = delta_lloyd.cluster(vectors(spark, rows), dims=2, rounds=3)
    assert sorted((tuple(r) for r in found.collect()), key=str) == brute_lloyd(rows, dims=2, rounds=3)


def test_only_what_changed_is_compared():
    rng = np.random.default_rng(2)
    x, before = rng.integers(-50, 50, (500, 3)), rng.integers(-50, 50, (6, 3))
    none = np.full(500, -1)
    owner, distance = delta_lloyd.nearest(x, none, none, before, np.ones(6, bool))
    after, changed = before.copy(), np.array([False, True, False, False, True, False])
    after[changed] += 3
    want = ((x[:, None] - after) ** 2).sum(axis=2)
    got = delta_lloyd.nearest(x, owner, distance, after, changed)
    assert (got[0] == want.argmin(axis=1)).all() and (got[1] == want.min(axis=1)).all()


def test_vectors_are_not_shuffled_each_round(spark):
    rng = np.random.default_rng(5)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        state = delta_lloyd.Rounds(delta_lloyd.integer_vectors(vectors(spark, [(i, rng.normal(size=2).tolist()) for i in range(100)]), 2), 3, 2, "3:")
        state.assign()
        plan = spark.table(state.vectors).join(spark.table(state.assigned), "row")._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "Exchange" not in plan
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_components_too_large_for_a_distance(spark):
    with pytest.raises(Exception, match="or more"):
        delta_lloyd.cluster(vectors(spark, [(1, [1e9, 0.0])]), dims=2).collect()
