"""Merkle manifest of a dataset: a tree over each group's rows, and one over the groups, reduced by superblocks.

**Method.** A leaf is a digest of a row's fields. Leaves are numbered within their group by ranges of
(group, order), so that a group of any size is spread over many tasks; one row for each range goes to the driver.
*Superblock reduction*: the nodes of a group are cut into buckets of ``fanout ** levels`` consecutive ones
(729 by default); ``applyInPandas`` collapses that many levels of a bucket at once, and the bucket roots are
the nodes of the next round, until each group has one. The groups' roots go through the same rounds as leaves of the upper tree.
Proofs are then handed down: each bucket meets the proof of its root (one row), and its nodes' own siblings are put before it, lower
proofs first. Leaves are read twice, 64 bytes each; texts are read once and no proof is shuffled below its bucket.

**Scale.** No task holds more than a bucket; rounds are the logarithm of the largest group to base 729. A group or order value
that a third of all rows hold is cut by a staged salt, even where whole rows are equal.

**Defined cases.** A null field is ``-``, which no value can give (values begin with a length). Null groups and null order values are
kept, first in order. Rows that are equal in group and order value follow one another by their leaf; equal rows are leaves of their own. An
empty table has no rows. Columns that are not fields are ignored. Tampering is a column of its own: where it is null, the row is untampered.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import stage

FANOUT, LEVELS = 3, 6
PATH = "array<struct<before:string,after:string>>"


def digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def leaf_digest(*fields: Column) -> Column:
    """Hex digest of fields, each ``-`` if null, else its UTF-8 byte count, ``:`` and the value."""
    texts = [f.cast("string") for f in fields]
    return F.sha2(F.concat(*[F.when(t.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t)) for t in texts]), 256)


def layers(hashes: list[str], fanout: int, most: int | None) -> list[list[str]]:
    """The nodes and what ``most`` levels make of them; None: up to the one root."""
    out = [hashes]
    while len(out[-1]) > 1 if most is None else len(out) <= most:
        last = out[-1]
        out.append([digest("".join(last[i : i + fanout])) for i in range(0, len(last), fanout)])
    return out


def siblings(tree: list[list[str]], at: int, fanout: int) -> list[tuple[str, str]]:
    """What stands before and after a node in its run, level by level."""
    path = []
    for layer in tree[:-1]:
        first = at - at % fanout
        path.append(("".join(layer[first:at]), "".join(layer[at + 1 : first + fanout])))
        at //= fanout
    return path


def fold(leaf: str, path: list[tuple[str, str]]) -> str:
    for before, after in path:
        leaf = digest(before + leaf + after)
    return leaf


def _most(first: int, rows: int, fanout: int, levels: int) -> int | None:
    """Levels that a bucket collapses: all of them if it is full or has others before it; up to its root if it is its group's only one."""
    return None if first == 0 and rows < fanout**levels else levels


def numbered(rows: DataFrame) -> DataFrame:
    """``(grp, ord, leaf, folded, salt)`` to ``(sid, i, ord, leaf, folded)``: the group's place among groups, and the leaf's in its group, from 0."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, run, place = None, -1, 0
        for batch in batches:
            runs, places = [], []
            for group in batch.column(1).to_pylist():
                if run < 0 or group != last:
                    last, run, place = group, run + 1, 0
                runs.append(run)
                places.append(place)
                place += 1
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(runs, pa.int64()), pa.array(places, pa.int64()), *batch.columns[1:]], names)

    names = ["part", "run", "place", "grp", "ord", "leaf", "folded"]
    spark = rows.sparkSession
    placed = rows.repartitionByRange("grp", "ord", "leaf", "salt").sortWithinPartitions("grp", "ord", "leaf").withColumn("part", F.spark_partition_id())
    placed = placed.select("part", "grp", "ord", "leaf", "folded")
    kinds = dict(placed.dtypes)
    placed = stage(placed.mapInArrow(counted, f"part int, run long, place long, grp {kinds['grp']}, ord {kinds['ord']}, leaf binary, folded binary"), "leaves-in-order")
    runs = placed.groupBy("part", "run").agg(F.count(F.lit(1)).alias("n"), F.first("grp").alias("grp"))
    # one row for each range of rows, however many groups it holds
    ends = runs.groupBy("part").agg(F.min_by(F.struct("grp", "n"), "run").alias("first"), F.max_by(F.struct("grp", "n"), "run").alias("last"), F.count(F.lit(1)).alias("runs"))
    starts, groups, open_group, held = [], 0, None, 0
    for r in sorted(ends.collect(), key=lambda r: r["part"]):
        goes_on = groups > 0 and r["first"]["grp"] == open_group
        starts.append((r["part"], groups - goes_on, held if goes_on else 0))
        held = r["last"]["n"] + (held if goes_on and r["runs"] == 1 else 0)
        open_group, groups = r["last"]["grp"], groups - goes_on + r["runs"]
    bases = spark.createDataFrame(starts, "part int, base long, held long")
    place = F.col("place") + F.when(F.col("run") == 0, F.col("held")).otherwise(0)
    return placed.join(F.broadcast(bases), "part").select((F.col("base") + F.col("run")).alias("sid"), place.alias("i"), "ord", "leaf", "folded")


def _bucketed(nodes: DataFrame, fanout: int, levels: int) -> DataFrame:
    return nodes.withColumn("bucket", F.expr(f"i div {fanout**levels}"))


def reduced(nodes: DataFrame, fanout: int, levels: int) -> list[DataFrame]:
    """Rounds of superblock reduction of ``(sid, i, h)``: the nodes themselves, then bucket roots, until every ``sid`` has one row."""

    def collapse(nodes: pd.DataFrame) -> pd.DataFrame:
        nodes = nodes.sort_values("i", ignore_index=True)
        hashes = [bytes(h).hex() for h in nodes["h"]]
        bucket = int(nodes["bucket"][0])
        root = layers(hashes, fanout, _most(bucket, len(hashes), fanout, levels))[-1][0]
        return pd.DataFrame({"sid": [nodes["sid"][0]], "i": [bucket], "h": [bytes.fromhex(root)]})

    rounds = [nodes]
    while True:
        made = _bucketed(rounds[-1], fanout, levels).groupBy("sid", "bucket").applyInPandas(collapse, "sid long, i long, h binary")
        rounds.append(stage(made, f"bucket-roots-{len(rounds)}"))
        if not rounds[-1].where("i > 0").head(1):
            return rounds


def handed_down(nodes: DataFrame, above: DataFrame, fanout: int, levels: int) -> DataFrame:
    """The path to the root of each node ``(sid, i, h)``: its own in the bucket, then that of the bucket ``(sid, i, path, subroot)``."""

    def paths(key: tuple, nodes: pd.DataFrame, above: pd.DataFrame) -> pd.DataFrame:
        nodes = nodes.sort_values("i", ignore_index=True)
        tree = layers([bytes(h).hex() for h in nodes["h"]], fanout, _most(int(key[1]), len(nodes), fanout, levels))
        upper = list(above["path"][0])
        own = [[{"before": b, "after": a} for b, a in siblings(tree, j, fanout)] + upper for j in range(len(nodes))]
        return pd.DataFrame({"sid": nodes["sid"], "i": nodes["i"], "path": own, "subroot": above["subroot"][0]})

    below = _bucketed(nodes, fanout, levels).groupBy("sid", "bucket")
    return below.cogroup(above.groupBy("sid", "i")).applyInPandas(paths, f"sid long, i long, path {PATH}, subroot string")


def _paths_above(rounds: list[DataFrame], top: DataFrame, fanout: int, levels: int) -> DataFrame:
    """Paths of the nodes of round 1 from those of the last, ``top``."""
    for nodes in rounds[-2:0:-1]:
        top = handed_down(nodes, top, fanout, levels)
    return top


def manifest(
    docs: DataFrame, fields: tuple[str, ...], group: str, order: str, tampered: Column | None = None, tampered_field: str | None = None, fanout: int = FANOUT, levels: int = LEVELS, with_path: bool = False
) -> DataFrame:
    """Each row's ``order``, ``leaf``, ``subroot``, ``root``, ``proof_sha256``, ``folded_root`` and ``verified``; with ``with_path`` its ``path`` too.

    ``tampered`` replaces ``tampered_field`` where it is not null; the row's root is folded from that leaf and the original siblings.
    """
    other = F.lit(None).cast("string") if tampered is None else leaf_digest(*[F.coalesce(tampered, F.col(f).cast("string")) if f == tampered_field else F.col(f) for f in fields])
    changed = F.lit(None).cast("binary") if tampered is None else F.when(tampered.isNotNull(), F.unhex(other))
    leaves = docs.select(F.col(group).alias("grp"), F.col(order).alias("ord"), F.unhex(leaf_digest(*[F.col(f) for f in fields])).alias("leaf"), changed.alias("folded"), F.xxhash64(F.monotonically_increasing_id()).alias("salt"))
    nodes = stage(numbered(stage(leaves, "leaves")), "numbered-leaves")
    lower = reduced(nodes.select("sid", "i", F.col("leaf").alias("h")), fanout, levels)
    subroots = stage(lower[-1].select(F.lit(0).cast("long").alias("sid"), F.col("sid").alias("i"), "h"), "subroots")
    upper = reduced(subroots, fanout, levels)
    top = upper[-1].select("sid", "i", F.array().cast(PATH).alias("path"), F.hex("h").alias("subroot"))
    found = upper[-1].select(F.lower(F.hex("h")).alias("root")).head()
    root = found["root"] if found else ""
    over = handed_down(upper[0], _paths_above(upper, top, fanout, levels), fanout, levels)
    over = over.select(F.col("i").alias("sid"), "path").join(lower[-1].select("sid", F.lower(F.hex("h")).alias("subroot")), "sid")
    above = _paths_above(lower, over.select("sid", F.lit(0).cast("long").alias("i"), "path", "subroot"), fanout, levels)

    def proofs(key: tuple, nodes: pd.DataFrame, above: pd.DataFrame) -> pd.DataFrame:
        nodes = nodes.sort_values("i", ignore_index=True)
        hashes = [bytes(h).hex() for h in nodes["leaf"]]
        tree = layers(hashes, fanout, _most(int(key[1]), len(nodes), fanout, levels))
        upper = [(x["before"], x["after"]) for x in above["path"][0]]
        rest = "".join(b + a for b, a in upper)
        out: dict[str, list] = {"proof_sha256": [], "folded_root": [], "path": []}
        for j, changed in enumerate(nodes["folded"]):
            path = siblings(tree, j, fanout)
            out["proof_sha256"].append(digest("".join(b + a for b, a in path) + rest))
            out["folded_root"].append(fold(hashes[j] if changed is None else bytes(changed).hex(), path + upper))
            if with_path:
                out["path"].append([{"before": b, "after": a} for b, a in path + upper])
        if not with_path:
            del out["path"]
        return pd.DataFrame({"ord": nodes["ord"], "leaf": hashes, "subroot": above["subroot"][0], "root": root, **out, "verified": [x == root for x in out["folded_root"]]})

    kind = dict(nodes.dtypes)["ord"]
    schema = f"ord {kind}, leaf string, subroot string, root string, proof_sha256 string, folded_root string" + f", path {PATH}" * with_path + ", verified boolean"
    # null ids would turn a pandas column into floats; they travel as text and are cast back
    bucketed = _bucketed(nodes.withColumn("ord", F.col("ord").cast("string")), fanout, levels).groupBy("sid", "bucket")
    done = bucketed.cogroup(above.groupBy("sid", "i")).applyInPandas(proofs, schema.replace(f"ord {kind}", "ord string", 1))
    return done.withColumn("ord", F.col("ord").cast(kind)).withColumnRenamed("ord", order)


def document_manifest(docs: DataFrame, **options) -> DataFrame:
    """The manifest of ``documents`` by source; tampering takes the line breaks out of texts whose id has an even checksum."""
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "source", "lang", "n_chars", "text")
    even = F.crc32(F.col("doc_id").cast("string")) % 2 == 0
    tampered = F.when(even, F.translate("text", "\n", ""))
    return manifest(plain, ("doc_id", "source", "lang", "n_chars", "text"), "source", "doc_id", tampered, "text", **options)


def check_proof(leaf: str, path: list, root: str) -> bool:
    """Whether a leaf's digest and its path (rows of ``before`` and ``after``) lead to ``root``."""
    return fold(leaf, [(x["before"], x["after"]) for x in path]) == root


def oracle_sql(lower_levels: int = 14, upper_levels: int = 6) -> str:
    """The same manifest in DuckDB SQL, level by level: enough for ``3 ** lower_levels`` rows of a source and ``3 ** upper_levels`` sources."""
    # the checksum's 8 steps a byte, by its reversed polynomial
    bits = "list_reduce(range(8), lambda d, j: xor(d >> 1, CASE WHEN d % 2 = 1 THEN 3988292384 ELSE 0 END), xor(c, b))"
    characters = "list_transform(range(1, length(doc_id::VARCHAR) + 1), lambda p: ascii(substr(doc_id::VARCHAR, p, 1))::BIGINT)"
    checksum = f"xor(list_reduce({characters}, lambda c, b: {bits}, 4294967295::BIGINT), 4294967295::BIGINT)"
    field = lambda c: f"CASE WHEN {c} IS NULL THEN '-' ELSE octet_length(encode({c}::VARCHAR))::VARCHAR || ':' || {c}::VARCHAR END"
    leaf = lambda text: "sha256(" + " || ".join(field(c) for c in ("doc_id", "source", "lang", "n_chars", text)) + ")"
    steps = [
        "raw AS MATERIALIZED (SELECT doc_id, source, " + leaf("text") + " AS leaf, " + leaf("replace(text, chr(10), '')") + " AS changed FROM documents)",
        "a0 AS MATERIALIZED (SELECT dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS g, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, leaf AS h, count(*) OVER (PARTITION BY source) AS n, doc_id, changed FROM raw)",
    ]
    for name, levels in (("a", lower_levels), ("b", upper_levels)):
        if name == "b":
            steps.append(f"b0 AS MATERIALIZED (SELECT 0 AS g, g AS i, h, count(*) OVER () AS n FROM a{lower_levels})")
        for k in range(levels):
            steps.append(
                f"{name}{k + 1} AS MATERIALIZED (SELECT g, i // 3 AS i, CASE WHEN any_value(n) > 1 THEN sha256(string_agg(h, '' ORDER BY i)) ELSE any_value(h) END AS h, (any_value(n) + 2) // 3 AS n FROM {name}{k} GROUP BY g, i // 3)"
            )
            run = "PARTITION BY g, i // 3 ORDER BY i ROWS BETWEEN"
            steps.append(
                f"{name}s{k} AS MATERIALIZED (SELECT g, i, n > 1 AS more, coalesce(string_agg(h, '') OVER ({run} UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS l, coalesce(string_agg(h, '') OVER ({run} 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS r FROM {name}{k})"
            )
    steps.append(
        f"f0 AS MATERIALIZED (SELECT doc_id, g, i, g AS u, h AS leaf, '' AS proof, CASE WHEN {checksum} % 2 = 0 THEN changed ELSE h END AS h FROM a0)"
    )
    at = 0
    for name, levels in (("a", lower_levels), ("b", upper_levels)):
        key, place = ("s.g = f.g", "i") if name == "a" else ("true", "u")
        for k in range(levels):
            steps.append(
                f"f{at + 1} AS MATERIALIZED (SELECT f.* EXCLUDE ({place}, proof, h), f.{place} // 3 AS {place}, proof || l || r AS proof, CASE WHEN more THEN sha256(l || h || r) ELSE h END AS h FROM f{at} f JOIN {name}s{k} s ON {key} AND s.i = f.{place})"
            )
            at += 1
    return (
        "WITH " + ", ".join(steps) + f" SELECT doc_id, leaf, a.h AS subroot, b.h AS root, sha256(proof) AS proof_sha256, f.h AS folded_root, f.h = b.h AS verified"
        f" FROM f{at} f JOIN a{lower_levels} a ON a.g = f.g JOIN b{upper_levels} b ON true"
    )
