"""BPE encoding and decoding by tree concatenation.

**Encoding.** A tokenizer's pattern splits a text into pieces, and merges of neighbouring tokens, lowest rank and leftmost first, encode each
piece. A sequence of tokens is the encoding of its bytes exactly if each token encodes to itself and each neighbouring pair encodes
to itself: before a first merge across a border both sides go through the merges they would go through alone. So encodings can be
concatenated: around a join the tokens of a window are encoded again, and the window grows until its first token is the left side's and its last token is
the right side's. Then every pair in the result is a pair of one of three encodings, and the result is exact.

*Within a piece* halves are encoded down to :data:`LEAF` bytes and joined pairwise. *Across a text* blocks of code points are encoded in parallel, each as if it
stood alone, and neighbouring blocks are joined in a tree, ``2 ** LEVELS`` of them a shuffle. A split depends on what stands left of it only through the last split, and
on at most :data:`SEEN` code points to the right. So a join encodes from a split of the left block that far before the border, up to a split of the right block that both
the window and the block have, as far before the window's end; a piece that crosses the border is joined by tokens.

**Decoding.** Ids become bytes by slices of one table, and bytes become text (malformed UTF-8 becomes U+FFFD, as the library has it).

**Scale.** Texts of up to ``block`` code points are encoded where they are scanned. Only longer ones are shuffled: their text once, by
(row, block), then their ids once for each factor of 8 in their number of blocks. What meets in one task is one document's ids at most.

**Defined cases.** Null and empty texts have no ids and decode to the empty text. Null and repeated ids and equal rows are rows of their own. Added tokens that a text
holds literally become their id, as the library does by default. Other columns are ignored. Vocabularies with a normalizer, a prefix
space, or added tokens that strip or normalise are refused.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import stage

#: a piece up to so many bytes is encoded at once; code points (of up to 4 bytes) to the right that a split can depend on
LEAF, SEEN = 64, 16
#: code points a block, levels of the tree a shuffle
BLOCK, LEVELS = 1 << 15, 3
PIECES_KEPT, LONGEST_KEPT = 300_000, 200
#: marks a token that begins a piece
_FIRST = np.uint32(1 << 31)
_ID = np.uint32((1 << 31) - 1)
_loaded: dict[str, "TreeBpe"] = {}

#: the pattern of byte-level vocabularies that name none of their own (fixed value)
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def _byte_letters() -> list[str]:
    """The letter that stands for each byte in a byte-level vocabulary: itself if printable, else the next one from U+0100 on."""
    printable = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(0x100, 0x200))
    return [chr(b) if b in printable else chr(next(spare)) for b in range(256)]


class _Cache(dict):
    """Pieces met so far and their ids as bytes."""

    def __init__(self, bpe: "TreeBpe") -> None:
        super().__init__()
        self.bpe = bpe

    def __missing__(self, piece: str) -> bytes:
        found = np.array(self.bpe.encode_bytes(piece.encode()), "<u4").tobytes()
        if len(piece) <= LONGEST_KEPT:
            if len(self) > PIECES_KEPT:
                self.clear()
            self[piece] = found
        return found


class TreeBpe:
    def __init__(self, path: str) -> None:
        import regex
        from tokenizers import Tokenizer

        with open(path) as file:
            spec = json.load(file)
        model, split, added = spec["model"], spec["pre_tokenizer"], spec["added_tokens"]
        plain = split["type"] == "ByteLevel" and split["use_regex"] and not split["add_prefix_space"]
        odd = any(t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"] for t in added)
        if model["type"] != "BPE" or spec["normalizer"] or not plain or odd or model.get("dropout") or model.get("ignore_merges"):
            raise ValueError(f"{path} is not a plain byte-level BPE vocabulary")
        letters = _byte_letters()
        byte_of = {letter: b for b, letter in enumerate(letters)}
        vocab = model["vocab"]
        self.base = [vocab[x] for x in letters]
        pairs = (m.split(" ") if isinstance(m, str) else m for m in model["merges"])
        self.merges = {(vocab[a], vocab[b]): (rank, vocab[a + b]) for rank, (a, b) in enumerate(pairs)}
        held = [b""] * (max([*vocab.values(), *(t["id"] for t in added)]) + 1)
        for token, i in vocab.items():
            held[i] = bytes(byte_of[x] for x in token)
        for t in added:
            held[t["id"]] = t["content"].encode()
        self.lengths = np.array([len(x) for x in held], np.int64)
        self.starts = np.concatenate([[0], np.cumsum(self.lengths)[:-1]])
        self.held, self.blob = held, np.frombuffer(b"".join(held), np.uint8)
        self.added = {t["content"]: t["id"] for t in added}
        self.find_added = re.compile("|".join(map(re.escape, sorted(self.added, key=len, reverse=True)))) if added else None
        self.find = regex.compile(PATTERN).findall
        self.library = Tokenizer.from_file(path).pre_tokenizer
        #: code points whose kind (letter, number, space) both pattern libraries see alike: 1; those that only the tokenizers' one knows: 2; not tried yet: 0
        self.kinds = np.zeros(0x110000, np.uint8)
        self.kinds[:128] = 1
        self.ids_of = _Cache(self)

    @classmethod
    def load(cls, path: str) -> "TreeBpe":
        if path not in _loaded:
            _loaded[path] = cls(path)
        return _loaded[path]

    # --- splitting

    def _alike(self, text: str) -> bool:
        if text.isascii():
            return True
        points = np.frombuffer(text.encode("utf-32-le"), "<u4")
        for c in np.unique(points[self.kinds[points] == 0]):
            probe = f"a{chr(c)}1{chr(c)}.{chr(c)} {chr(c)}{chr(c)}x"
            self.kinds[c] = 1 if self.find(probe) == self._by_library(probe) else 2
        return not (self.kinds[points] == 2).any()

    def _by_library(self, text: str) -> list[str]:
        return [text[a:b] for _, (a, b) in self.library.pre_tokenize_str(text)]

    def pieces(self, text: str) -> Iterator[tuple[str, bool]]:
        """Pieces of a text, and whether each is an added token."""
        split, at = self.find if self._alike(text) else self._by_library, 0
        for found in self.find_added.finditer(text) if self.find_added else ():
            for piece in split(text[at : found.start()]):
                yield piece, False
            yield found.group(), True
            at = found.end()
        for piece in split(text[at:]):
            yield piece, False

    # --- one piece

    def merged(self, tokens: list[int]) -> list[int]:
        """Merges by rank, leftmost first: the definition."""
        merges, n = self.merges, len(tokens)
        if n <= LEAF // 2:
            while len(tokens) > 1:
                best, at = None, -1
                for i in range(len(tokens) - 1):
                    found = merges.get((tokens[i], tokens[i + 1]))
                    if found and (best is None or found[0] < best[0]):
                        best, at = found, i
                if best is None:
                    break
                tokens = [*tokens[:at], best[1], *tokens[at + 2 :]]
            return tokens
        tokens, after, before, heap = list(tokens), [*range(1, n), -1], [-1, *range(n - 1)], []
        for i in range(n - 1):
            if found := merges.get((tokens[i], tokens[i + 1])):
                heap.append((found[0], i, tokens[i], tokens[i + 1], found[1]))
        heapq.heapify(heap)
        while heap:
            _, i, a, b, made = heapq.heappop(heap)
            j = after[i]
            if tokens[i] != a or j < 0 or tokens[j] != b:
                continue
            tokens[i], tokens[j] = made, -1
            after[i] = after[j]
            if after[i] >= 0:
                before[after[i]] = i
            for left in (before[i], i):
                if left >= 0 and after[left] >= 0 and (found := merges.get((tokens[left], tokens[after[left]]))):
                    heapq.heappush(heap, (found[0], left, tokens[left], tokens[after[left]], found[1]))
        return [t for t in tokens if t >= 0]

    def encode_bytes(self, piece: bytes) -> list[int]:
        """A piece's ids: halves down to leaves, joined in a tree."""
        if len(piece) <= LEAF:
            return self.merged([self.base[b] for b in piece])
        half = LEAF * -(-len(piece) // (2 * LEAF))
        return self.join(self.encode_bytes(piece[:half]), self.encode_bytes(piece[half:]))

    def join(self, left: list[int], right: list[int]) -> list[int]:
        """The ids of two neighbouring stretches of one piece, together."""
        if not left or not right:
            return left or right
        width = 4
        while True:
            a, b = left[-width:], right[:width]
            again = self.merged([self.base[x] for token in a + b for x in self.held[token]])
            if (width >= len(left) or again[0] == a[0]) and (width >= len(right) or again[-1] == b[-1]):
                return left[:-width] + again + right[width:]
            width *= 2

    # --- texts

    def encode(self, text: str | None) -> np.ndarray:
        """A whole text's ids."""
        if not text:
            return np.empty(0, "<u4")
        ids_of = self.ids_of
        if self.find_added is None or not self.find_added.search(text):
            found = map(ids_of.__getitem__, self.find(text) if self._alike(text) else self._by_library(text))
        else:
            found = (np.uint32(self.added[p]).tobytes() if special else ids_of[p] for p, special in self.pieces(text))
        return np.frombuffer(b"".join(found), "<u4")

    def encode_block(self, text: str) -> np.ndarray:
        """Ids of a text that stands alone, each piece's first one marked."""
        return self._marked([[self.added[p]] if special else np.frombuffer(self.ids_of[p], "<u4") for p, special in self.pieces(text)])

    @staticmethod
    def _marked(pieces: list) -> np.ndarray:
        if not pieces:
            return np.empty(0, np.uint32)
        out = np.concatenate([np.asarray(p, np.uint32) for p in pieces])
        out[np.concatenate([[0], np.cumsum([len(p) for p in pieces])[:-1]])] |= _FIRST
        return out

    def join_blocks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Marked ids of two neighbouring blocks, together; the blocks need not end at splits."""
        if not len(left) or not len(right):
            return np.concatenate([left, right])
        splits_left, splits_right = np.flatnonzero(left & _FIRST), np.append(np.flatnonzero(right & _FIRST), len(right))
        last, first = splits_left[-1], splits_right[1]
        last_bytes, first_bytes = self.size(left[last:]), self.size(right[:first])
        # the last split that nothing right of the border can move
        at = len(splits_left) - 1
        while at and self.size(left[splits_left[at] :]) < 4 * SEEN:
            at -= 1
        start, width = splits_left[at], 16
        while True:
            end = splits_right[min(np.searchsorted(splits_right, width), len(splits_right) - 1)]
            raw_left, raw_right = self.bytes_of(left[start:]), self.bytes_of(right[:end])
            border, offset, offsets, again = len(raw_left), 0, [], []
            for piece, special in self.pieces((raw_left + raw_right).decode()):
                size = len(piece.encode())
                if special:
                    ids = [self.added[piece]]
                elif offset == border - last_bytes and offset + size == border + first_bytes:
                    ids = self.join((left[last:] & _ID).tolist(), (right[:first] & _ID).tolist())
                else:
                    ids = np.frombuffer(self.ids_of[piece], "<u4")
                offsets.append(offset)
                again.append(ids)
                offset += size
            if end == len(right):
                return np.concatenate([left[:start], self._marked(again)])
            # a split that both have, with all that it can depend on inside the window
            own = {border + b: s for s, b in zip(splits_right, np.append(0, np.cumsum(self.lengths[right[:end] & _ID]))[splits_right[splits_right <= end]]) if border + b + 4 * SEEN <= offset}
            agreed = next((i for i, o in enumerate(offsets) if o in own), None)
            if agreed is not None:
                return np.concatenate([left[:start], self._marked(again[:agreed]), right[own[offsets[agreed]] :]])
            width *= 2

    def join_all(self, blocks: list[np.ndarray]) -> np.ndarray:
        """Neighbouring blocks joined pairwise, level by level."""
        while len(blocks) > 1:
            blocks = [self.join_blocks(*blocks[i : i + 2]) if i + 1 < len(blocks) else blocks[i] for i in range(0, len(blocks), 2)]
        return blocks[0]

    # --- decoding

    def size(self, ids: np.ndarray) -> int:
        return int(self.lengths[ids & _ID].sum())

    def bytes_of(self, ids: np.ndarray) -> bytes:
        """The bytes that ids stand for, marks or not."""
        some = np.asarray(ids, np.uint32) & _ID
        n = self.lengths[some]
        ends = np.cumsum(n)
        return self.blob[np.repeat(self.starts[some] - ends + n, n) + np.arange(ends[-1] if len(ends) else 0)].tobytes()

    def decode(self, ids: np.ndarray) -> str:
        return self.bytes_of(ids).decode("utf-8", "replace")


_RESULT = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def encode_documents(docs: DataFrame, vocabulary: str, block: int = BLOCK, levels: int = LEVELS, id_col="doc_id", text_col="text", with_ids: bool = False) -> DataFrame:
    """Each document's number of ids, and digests of its ids and of the text they decode to; with ``with_ids`` also these two."""

    def results(bpe: TreeBpe, doc_ids: pa.Array, encoded: Iterator[np.ndarray]) -> pa.RecordBatch:
        out: list[list] = [[], [], [], [], []]
        for ids in encoded:
            text = bpe.decode(ids)
            out[0].append(len(ids))
            out[1].append(hashlib.sha256(ids.astype("<u4", copy=False).tobytes()).hexdigest())
            out[2].append(hashlib.sha256(text.encode()).hexdigest())
            if with_ids:
                out[3].append(ids)
                out[4].append(text)
        arrays = [doc_ids, pa.array(out[0], pa.int64()), pa.array(out[1], pa.string()), pa.array(out[2], pa.string())]
        if with_ids:
            arrays += [pa.array(out[3], pa.list_(pa.int32())), pa.array(out[4], pa.string())]
        return pa.RecordBatch.from_arrays(arrays, names)

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = TreeBpe.load(vocabulary)
        for batch in batches:
            yield results(bpe, batch.column(0), map(bpe.encode, batch.column(1).to_pylist()))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, doc_id, text in zip(*(c.to_pylist() for c in batch.columns)):
                parts = [text[i : i + block] for i in range(0, len(text), block)]
                n = len(parts)
                yield pa.RecordBatch.from_arrays([pa.array([row] * n, pa.int64()), pa.array([doc_id] * n, pa.int64()), pa.array(range(n), pa.int64()), pa.array(parts, pa.string()), pa.array([n - 1] * n, pa.int64())], ["row", "doc_id", "node", "text", "last"])

    def encoded_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = TreeBpe.load(vocabulary)
        for batch in batches:
            ids = [bpe.encode_block(x).tobytes() for x in batch.column(3).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(ids, pa.binary())], ["row", "doc_id", "node", "ids"])

    def joined(nodes: pa.Table) -> pa.Table:
        bpe = TreeBpe.load(vocabulary)
        nodes = nodes.sort_by("node")
        blocks = [np.frombuffer(x.as_py(), np.uint32) for x in nodes.column("ids")]
        ids = bpe.join_all(blocks).tobytes()
        return pa.table({"row": nodes["row"][:1], "doc_id": nodes["doc_id"][:1], "node": pa.array([nodes["node"][0].as_py() >> levels], pa.int64()), "ids": pa.array([ids], pa.binary())})

    def finished(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = TreeBpe.load(vocabulary)
        for batch in batches:
            yield results(bpe, batch.column(0), (np.frombuffer(x.as_py(), np.uint32) & _ID for x in batch.column(1)))

    names = [f.split()[0] for f in _RESULT.split(", ")] + ["ids", "decoded"] * with_ids
    schema = _RESULT + ", ids array<int>, decoded string" * with_ids
    plain = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    long_text = F.coalesce(F.char_length("text") > block, F.lit(False))
    done = plain.where(~long_text).mapInArrow(whole, schema)
    longer = plain.where(long_text).select(F.monotonically_increasing_id().alias("row"), "doc_id", "text")
    blocks = stage(longer.mapInArrow(cut, "row long, doc_id long, node long, text string, last long"), "text-blocks")
    most = blocks.agg(F.max("last").alias("last")).head()["last"]
    height = 1
    while most is not None:
        # texts that a tree of this height joins; each block is encoded once
        taller = most >> (levels * height)
        some = blocks.where((F.col("last") < 1 << (levels * height)) & (F.col("last") >= (1 << (levels * (height - 1)) if height > 1 else 0)))
        nodes = some.select("row", "doc_id", "node", "text").repartition("row", "node").mapInArrow(encoded_blocks, "row long, doc_id long, node long, ids binary")
        for _ in range(height):
            nodes = nodes.groupBy("row", F.shiftright("node", levels).alias("parent")).applyInArrow(joined, "row long, doc_id long, node long, ids binary")
        done = done.unionByName(nodes.select("doc_id", "ids").mapInArrow(finished, schema))
        if not taller:
            break
        height += 1
    return done
