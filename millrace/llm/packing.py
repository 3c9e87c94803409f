"""Sequence packing: best-fit decreasing over a segment tree of remaining capacities.

A document's ids are cut into full windows first; what is left over (shorter than a window) is
packed best-fit decreasing with the rest of its shard. Shards are a hash of the row (not of its id alone, which
a third of all rows may share), of about :data:`SHARD_DOCS` documents each, so no task packs more than that, however large the
table is; each shard leaves a few open windows at its end.

Defined cases: a null text is an empty one and holds only the end id; a null id is packed like any
other; repeated rows are packed once each; an empty table gives no pieces; other columns of the
input are ignored, whatever their names; ties in length go to the smaller id. A text that holds a special token of the vocabulary
literally gets that token's id, as the library gives it.
"""

from __future__ import annotations

from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tokens import WordEncoder

SHARD_DOCS = 8192
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, copy long"
_PIECE_NAMES = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "copy"]


class CapacityTree:
    """Counts of open windows by remaining capacity; finds the least capacity that still fits."""

    def __init__(self, most: int) -> None:
        self.width = 1 << most.bit_length()
        self.count = [0] * (2 * self.width)

    def add(self, capacity: int, n: int) -> None:
        at = capacity + self.width
        while at:
            self.count[at] += n
            at >>= 1

    def tightest(self, need: int) -> int:
        """The least capacity >= ``need`` that some open window has, or -1."""
        count, at = self.count, need + self.width
        if count[at]:
            return need
        while at > 1:
            if not at & 1 and count[at + 1]:
                at += 1
                while at < self.width:
                    at = 2 * at if count[2 * at] else 2 * at + 1
                return at - self.width
            at >>= 1
        return -1


def best_fit_decreasing(lengths: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """(sequence, offset) of each piece; lengths are 1..window, ties keep their order."""
    order = np.argsort(-lengths, kind="stable")
    sequence, offset = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    tree, open_by, made = CapacityTree(window), [[] for _ in range(window + 1)], 0
    for i in order.tolist():
        need = int(lengths[i])
        room = tree.tightest(need)
        if room < 0:
            at, room, made = made, window, made + 1
        else:
            at = open_by[room].pop()
            tree.add(room, -1)
        sequence[i], offset[i] = at, window - room
        if room > need:
            open_by[room - need].append(at)
            tree.add(room - need, 1)
    return sequence, offset


def cut_pieces(docs: DataFrame, tokenizer: str, window: int, end_id: int, id_col="doc_id", text_col="text", with_ids=False) -> DataFrame:
    """One row per piece: full windows of each document from its start, then the rest."""

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, end = WordEncoder.load(tokenizer), np.uint32(end_id).astype("<u4").tobytes()
        for batch in (b.slice(at, 500) for b in batches for at in range(0, b.num_rows, 500)):
            out: list[list] = [[] for _ in range(6 + with_ids)]
            ids, texts, copies = (c.to_pylist() for c in batch.columns)
            for doc, raw, copy in zip(ids, map(encoder.encode, texts), copies):
                raw += end
                n = len(raw) // 4
                for start in range(0, n, window):
                    part = raw[4 * start : 4 * (start + window)]
                    for column, value in zip(out, (doc, start, len(part) // 4, crc32(part), n, copy, part)):
                        column.append(value)
            arrays = [pa.array(x, pa.int64()) for x in out[:6]]
            if with_ids:
                arrays.append(pa.array(out[6], pa.binary()))
            yield pa.RecordBatch.from_arrays(arrays, _PIECE_NAMES + ["ids"] * with_ids)

    # `copy` tells repeated rows of one id apart: pieces of a row stay in one shard.
    plain = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    plain = plain.withColumn("copy", F.monotonically_increasing_id())
    return plain.mapInArrow(pieces, PIECES + (", ids binary" if with_ids else ""))


def pack_documents(docs: DataFrame, tokenizer: str, window: int = 2048, end_id: int = 1, id_col="doc_id", text_col="text", with_ids=False) -> DataFrame:
    """Pieces with their ``sequence_id`` and ``offset``; with ``with_ids`` also the ids themselves.

    ``sequence_id`` is the shard's number and the sequence's place in the shard; ids have gaps.
    """
    shards = max(1, -(-docs.count() // SHARD_DOCS))
    cut = cut_pieces(docs, tokenizer, window, end_id, id_col, text_col, with_ids)
    cut = cut.withColumn("shard", F.pmod(F.xxhash64("doc_id", "copy"), F.lit(shards)))

    def packed(table: pa.Table) -> pa.Table:
        table = table.sort_by([(name, "ascending") for name in ("doc_id", "copy", "start")])
        lengths, shard = table["length"].to_numpy(), table["shard"][0].as_py()
        sequence, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
        full = lengths == window
        rest_sequence, rest_offset = best_fit_decreasing(lengths[~full], window)
        sequence[~full], offset[~full] = rest_sequence, rest_offset
        sequence[full] = (rest_sequence.max(initial=-1) + 1) + np.arange(full.sum())
        table = table.append_column("sequence_id", pa.array(sequence + (shard << 40)))
        return table.append_column("offset", pa.array(offset)).drop_columns(["shard", "copy"])

    schema = PIECES.replace(", copy long", "") + (", ids binary" if with_ids else "") + ", sequence_id long, offset long"
    return cut.groupBy("shard").applyInArrow(packed, schema)


def sequences(pieces: DataFrame, window: int = 2048, pad_id: int = 0) -> DataFrame:
    """The packed rows themselves: ``input_ids``, and ``document`` numbering each row's documents from 1.

    ``pieces`` come from :func:`pack_documents` with ids. A sequence is padded to ``window`` (document
    0 marks padding), except where its length is a power of two.
    """

    def joined(table: pa.Table) -> pa.Table:
        table = table.sort_by("offset")
        ids = np.concatenate([np.frombuffer(x.as_py(), "<u4") for x in table["ids"]]).astype(np.int32)
        which = np.repeat(np.arange(1, table.num_rows + 1), table["length"].to_numpy()).astype(np.int32)
        missing = 0 if len(ids) & (len(ids) - 1) == 0 else window - len(ids)
        ids, which = np.pad(ids, (0, missing), constant_values=pad_id), np.pad(which, (0, missing))
        return pa.table({"sequence_id": table["sequence_id"][:1], "input_ids": [ids], "document": [which]})

    kept = pieces.select("sequence_id", "offset", "length", "ids")
    return kept.groupBy("sequence_id").applyInArrow(joined, "sequence_id long, input_ids array<int>, document array<int>")
