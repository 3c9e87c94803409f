"""Byte-level BPE: a lazily determinised transducer encodes, a streaming state machine decodes.

**Encoding.** For ranks in which every token's parts have lower ranks than the token, a sequence of
tokens is the BPE encoding of its bytes exactly if each token encodes to itself and each
neighbouring pair is *stable* (merging the pair's bytes gives the same two tokens). So encoding is a
non-deterministic transducer whose configurations are (last whole token, place in the trie of token
bytes), and a prefix of the input has exactly one configuration between two tokens. It is made
deterministic on demand: a state is the set of live configurations with the tokens each has not
yet shared with the others; a transition emits what they have in common. Lookahead is bounded by
the longest token's bytes. Transitions are remembered until there are :data:`TRANSITIONS_KEPT` of them.

**Decoding.** Ids become bytes by slices of one table; :class:`Utf8Stream` turns chunks of bytes into text
and carries the open bytes of a split character from one chunk to the next.

Defined cases: null and empty texts have no ids; malformed UTF-8 in decoded bytes becomes U+FFFD in text
(bytes are returned as they are); null ids and repeated rows are kept; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TRANSITIONS_KEPT, PIECES_KEPT, CHUNK = 2_000_000, 500_000, 1 << 16
_NEVER = 1 << 60
_loaded: dict[tuple[str, str], "Codec"] = {}


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


class Transducer:
    """Encodes one piece (a match of the split pattern) byte by byte."""

    def __init__(self, ranks: dict[bytes, int]) -> None:
        self.ranks = ranks
        self.token = {rank: token for token, rank in ranks.items()}
        self.child: dict[int, int] = {}
        self.ends = [-1]
        for token, rank in ranks.items():
            node = 0
            for byte in token:
                key = node << 8 | byte
                node = self.child.get(key, 0)
                if not node:
                    node = self.child[key] = len(self.ends)
                    self.ends.append(-1)
            self.ends[node] = rank
        self.halves: dict[int, tuple[int, int] | None] = {}
        self.spines: dict[tuple[int, int], list[int]] = {}
        self.stable_pairs: dict[int, bool] = {}
        self.forget()

    def forget(self) -> None:
        start = ((-1, 0, ()),)
        self.states, self.number = [start], {start: 0}
        self.flush: list[tuple[int, ...]] = [()]
        self.step: dict[int, tuple[int, tuple[int, ...]]] = {}

    def merged(self, piece: bytes, below: int = _NEVER) -> list[bytes]:
        """Plain BPE by ranks under ``below``: the definition, used to take single tokens apart."""
        parts = [piece[i : i + 1] for i in range(len(piece))]
        while len(parts) > 1:
            rank, at = min((self.ranks.get(a + b, _NEVER), i) for i, (a, b) in enumerate(zip(parts, parts[1:])))
            if rank >= below:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def split(self, rank: int) -> tuple[int, int] | None:
        """The two tokens whose merge makes this one; None for single bytes; (-1, -1) if merging never gives it."""
        if rank not in self.halves:
            token = self.token[rank]
            parts = self.merged(token, rank) if len(token) > 1 else []
            self.halves[rank] = None if not parts else (self.ranks[parts[0]], self.ranks[parts[1]]) if len(parts) == 2 else (-1, -1)
        return self.halves[rank]

    def spine(self, rank: int, side: int) -> list[int]:
        """A token, its left (0) or right (1) half, that one's, and so on to a single byte."""
        found = self.spines.get((rank, side))
        if found is None:
            half = self.split(rank)
            found = self.spines[rank, side] = [rank] + (self.spine(half[side], side) if half else [])
        return found

    def stable(self, left: int, right: int) -> bool:
        """Whether these two tokens, side by side, stay as they are.

        Both are rebuilt from single bytes in the order of ranks; the pair fails if the tokens that touch at
        the border would merge before their own next merge on either side.
        """
        key = left << 32 | right
        known = self.stable_pairs.get(key)
        if known is not None:
            return known
        a, b = self.spine(left, 1), self.spine(right, 0)
        i, j, result = len(a) - 1, len(b) - 1, True
        while True:
            across = self.ranks.get(self.token[a[i]] + self.token[b[j]], _NEVER)
            next_a, next_b = a[i - 1] if i else _NEVER, b[j - 1] if j else _NEVER
            if across < next_a and across <= next_b and across != _NEVER:
                result = False
                break
            if not i and not j:
                break
            if next_a <= next_b:
                i -= 1
            else:
                j -= 1
        if len(self.stable_pairs) > TRANSITIONS_KEPT:
            self.stable_pairs.clear()
        self.stable_pairs[key] = result
        return result

    def _advance(self, state: int, byte: int) -> tuple[int, tuple[int, ...]]:
        live, whole = [], None
        for last, node, owed in self.states[state]:
            at = self.child.get(node << 8 | byte)
            if at is None:
                continue
            live.append((last, at, owed))
            token = self.ends[at]
            if token >= 0 and self.split(token) != (-1, -1) and (last < 0 or self.stable(last, token)):
                whole = (token, 0, owed + (token,))
        if whole:
            live.append(whole)
        shared = 0
        first = live[0][2]
        for k in range(min(len(c[2]) for c in live)):
            if any(c[2][k] != first[k] for c in live):
                break
            shared = k + 1
        emitted, to = first[:shared], tuple((last, node, owed[shared:]) for last, node, owed in live)
        if to not in self.number:
            self.number[to] = len(self.states)
            self.states.append(to)
            self.flush.append(next((owed for _, node, owed in to if node == 0), ()))
        found = self.step[state << 8 | byte] = (self.number[to], emitted)
        return found

    def encode(self, piece: bytes) -> list[int]:
        whole = self.ranks.get(piece)
        if whole is not None:
            return [whole]
        if len(self.step) > TRANSITIONS_KEPT:
            self.forget()
        out: list[int] = []
        state, step = 0, self.step
        for byte in piece:
            found = step.get(state << 8 | byte) or self._advance(state, byte)
            state = found[0]
            if found[1]:
                out += found[1]
        out += self.flush[state]
        return out


#: Fixed values of UTF-8: the number of continuation bytes that a leading byte calls for.
_FOLLOWING = [0] * 192 + [0] * 2 + [1] * 30 + [2] * 16 + [3] * 5 + [0] * 11


class Utf8Stream:
    """Bytes in, text out; a character split between chunks waits for its remaining bytes."""

    def __init__(self) -> None:
        self.open = b""

    def feed(self, chunk: bytes, last: bool = False) -> str:
        data = self.open + chunk
        end = len(data)
        if not last:
            # states: bytes still to come for the last leading byte; only the last three bytes matter
            for back in range(1, min(3, end) + 1):
                byte = data[end - back]
                if byte & 0xC0 != 0x80:
                    if _FOLLOWING[byte] >= back:
                        end -= back
                    break
        self.open = data[end:]
        return data[:end].decode("utf-8", "replace")


class _Pieces(dict):
    """Pieces met so far: their ids as decimal text and as 32-bit integers."""

    def __init__(self, transducer: Transducer) -> None:
        super().__init__()
        self.transducer = transducer

    def __missing__(self, piece: str) -> tuple[str, bytes]:
        ids = self.transducer.encode(piece.encode())
        if len(self) > PIECES_KEPT:
            self.clear()
        found = self[piece] = (",".join(map(str, ids)), np.array(ids, "<u4").tobytes())
        return found


class Codec:
    def __init__(self, path: str, pattern: str) -> None:
        import regex

        ranks = read_ranks(path)
        self.find = regex.compile(pattern).findall
        self.pieces = _Pieces(Transducer(ranks))
        most = max(ranks.values()) + 1
        tokens = [b""] * most
        for token, rank in ranks.items():
            tokens[rank] = token
        self.lengths = np.array([len(t) for t in tokens], np.int64)
        self.starts = np.concatenate([[0], np.cumsum(self.lengths)[:-1]])
        self.blob = np.frombuffer(b"".join(tokens), np.uint8)

    @classmethod
    def load(cls, path: str, pattern: str) -> "Codec":
        if (path, pattern) not in _loaded:
            _loaded[path, pattern] = cls(path, pattern)
        return _loaded[path, pattern]

    def encode(self, text: str | None) -> tuple[np.ndarray, str]:
        """Ids, and the same as decimal text joined by commas."""
        if not text:
            return np.empty(0, "<u4"), ""
        pieces = self.pieces
        found = [pieces[x] for x in self.find(text)]
        return np.frombuffer(b"".join([x[1] for x in found]), "<u4"), ",".join([x[0] for x in found])

    def bytes_of(self, ids: np.ndarray) -> Iterator[bytes]:
        """The bytes of ``ids``, in chunks of :data:`CHUNK` ids."""
        for at in range(0, len(ids), CHUNK):
            some = ids[at : at + CHUNK]
            n = self.lengths[some]
            ends = np.cumsum(n)
            yield self.blob[np.repeat(self.starts[some] - ends + n, n) + np.arange(ends[-1])].tobytes()

    def decode(self, ids: np.ndarray) -> Iterator[str]:
        stream = Utf8Stream()
        for chunk in self.bytes_of(ids):
            yield stream.feed(chunk)
        yield stream.feed(b"", last=True)


def encode_documents(docs: DataFrame, ranks: str, pattern: str, id_col="doc_id", text_col="text", with_ids=False) -> DataFrame:
    """Each document's number of ids, digest of its ids, and digest of what the ids decode to; with ``with_ids`` the ids and the decoded text too."""

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec.load(ranks, pattern)
        for batch in batches:
            out: list[list] = [[], [], [], [], []]
            for text in batch.column(1).to_pylist():
                ids, decimal = codec.encode(text)
                digest = hashlib.sha256()
                decoded = []
                for part in codec.decode(ids):
                    digest.update(part.encode())
                    if with_ids:
                        decoded.append(part)
                out[0].append(len(ids))
                out[1].append(hashlib.sha256(decimal.encode()).hexdigest())
                out[2].append(digest.hexdigest())
                if with_ids:
                    out[3].append(ids)
                    out[4].append("".join(decoded))
            arrays = [batch.column(0), pa.array(out[0], pa.int64()), pa.array(out[1], pa.string()), pa.array(out[2], pa.string())]
            if with_ids:
                arrays += [pa.array(out[3], pa.list_(pa.int32())), pa.array(out[4], pa.string())]
            yield pa.RecordBatch.from_arrays(arrays, names)

    names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] + ["ids", "decoded"] * with_ids
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + (", ids array<int>, decoded string" if with_ids else "")
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(coded, schema)
