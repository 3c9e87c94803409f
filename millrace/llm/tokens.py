"""Token ids of whole texts by the installed ``tokenizers`` library.

White space never enters a token of the word vocabulary, so a text's ids are those of its
white-space-separated words one after another. A task keeps the ids of the words it has met
(bounded, see :data:`WORDS_KEPT`) and gives the library only what is new to it. Texts of Latin letters and common symbols are put in lower case first, and
their words are cut into pieces (letters, a digit, a run of symbols) by the vocabulary's own pattern: a piece is given to the library once, whatever stands before and after it.
Words are held in two halves: when the newer one is full it becomes the older one, whose words go back to the newer when they are met again; what is not met in that time is forgotten.
"""

from __future__ import annotations

import json
import os
import re
from unicodedata import is_normalized

import numpy as np

from .shared import remembers

#: Words whose ids a worker remembers, about (a single text's words are held together).
WORDS_KEPT = 600_000
#: str.split() also splits at these, which the vocabulary's pattern takes as symbols.
_SEPARATORS = re.compile("[\x1c-\x1f]")
#: What texts may hold to be cut here: characters that are in NFC in any order, of which Python and the library know the same lower case, and whose kind is settled:
#: ASCII but for control characters, Latin letters (but U+0130, whose lower case is two characters), dashes, quotes, the euro sign.
_UNSETTLED = re.compile("[^\t\n\r -~\u00a1-\u00ac\u00ae-\u012f\u0131-\u017f\u2010-\u2027\u20ac]")
_LETTERS, _NUMBERS = "a-z\u00aa\u00b5\u00ba\u00df-\u00f6\u00f8-\u017f", "0-9\u00b2\u00b3\u00b9\u00bc-\u00be"
#: The pattern for which the vocabulary was made, and the same over these characters in lower case.
_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_PIECE = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTERS}]+|[{_NUMBERS}]|[^\\s{_LETTERS}{_NUMBERS}]+")
_loaded: dict[str, "WordEncoder"] = {}
remembers(_loaded.clear)


class WordEncoder:
    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.library = Tokenizer.from_file(path)
        # for words that are normalised and split already
        self.plain = Tokenizer.from_file(path)
        self.plain.normalizer = None
        self.plain.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        # tokens that the library takes out of a text before it is split: such texts go to it whole
        added = sorted({t.content for t in self.library.get_added_tokens_decoder().values()})
        self.added = re.compile("|".join(map(re.escape, added)), re.IGNORECASE) if added else None
        # whether pieces are those of the pattern that is known here, after a normaliser to NFC and lower case
        made = json.loads(self.library.to_str())
        steps = made["normalizer"] or {}
        splits = (made["pre_tokenizer"] or {}).get("pretokenizers") or [{}]
        self.cuts = [n["type"] for n in steps.get("normalizers", [])] == ["NFC", "Replace", "Lowercase"] and splits[0].get("pattern") == {"Regex": _PATTERN}
        self.words: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        vocabulary = self.library.get_vocab(with_added_tokens=True)
        self.ends_word = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends_word[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True

    @classmethod
    def load(cls, path: str) -> "WordEncoder":
        """One per worker process and vocabulary file."""
        if path not in _loaded:
            _loaded[path] = cls(path)
        return _loaded[path]

    def _library_ids(self, texts: list[str]) -> list[bytes]:
        found = self.library.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(e.ids, dtype="<u4").tobytes() for e in found]

    def encode(self, text: str | None) -> bytes:
        """The ids of ``text`` (null: empty) as little-endian unsigned 32-bit integers."""
        if not text:
            return b""
        settled = self.cuts and not _UNSETTLED.search(text)
        if self.added is not None and self.added.search(text) or not settled and _SEPARATORS.search(text):
            return self._library_ids([text])[0]
        words = (text.lower() if settled else text).split()
        found = list(map(self.words.get, words))
        if None in found:
            if len(self.words) > WORDS_KEPT // 2:
                self.older, self.words = self.words, {}
            known, older = self.words, self.older
            new = {w for w, ids in zip(words, found) if ids is None}
            known.update({w: older[w] for w in new if w in older})
            learn = [w for w in new if w not in known]
            if learn:
                self._learn(learn, settled)
            found = [known[w] if ids is None else ids for w, ids in zip(words, found)]
        return b"".join(found)

    def _learn(self, words: list[str], settled: bool) -> None:
        """Remember the ids of ``words``, of a text that is settled or not."""
        known, older = self.words, self.older
        if not settled:
            known.update(self._learned(words))
            return
        cut = list(map(_PIECE.findall, words))
        new = {p for pieces in cut for p in pieces if p not in known and p not in older}
        known.update(self._learned(list(new)))
        for word, pieces in zip(words, cut):
            if len(pieces) > 1:
                known[word] = b"".join([known[p] if p in known else older[p] for p in pieces])

    def _learned(self, words: list[str]) -> dict[str, bytes]:
        """The ids of each of ``words``.

        Those that are one piece to the vocabulary, in lower case and NFC, are given to the library as one text without its normaliser and pattern,
        whose ids are cut at the end-of-word token that each ends with.
        """
        found: dict[str, bytes] = {}
        simple = [w for w in words if w.isalpha() and (w.islower() if w.isascii() else w == w.lower() and is_normalized("NFC", w))]
        if simple:
            ids = np.array(self.plain.encode_batch_fast([" ".join(simple)], add_special_tokens=False)[0].ids, "<u4")
            stops = np.flatnonzero(self.ends_word[ids]) + 1
            if len(stops) == len(simple):
                raw, stops = ids.tobytes(), (4 * stops).tolist()
                found.update(zip(simple, [raw[a:b] for a, b in zip([0, *stops], stops)]))
        others = [w for w in words if w not in found] if len(found) < len(words) else []
        if others:
            found.update(zip(others, self._library_ids(others)))
        return found
