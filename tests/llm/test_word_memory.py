"""The memory of words in two halves: ids do not depend on how many are kept, and the halves stay bounded."""

import numpy as np
import pytest

from millrace.llm import tokens

public_tokenizers = pytest.importorskip("public_tokenizers")


@pytest.mark.parametrize("kept", [2, 7, 40, 1000])
def test_ids_whatever_is_kept(monkeypatch, kept):
    monkeypatch.setattr(tokens, "WORDS_KEPT", kept)
    encoder = tokens.WordEncoder(public_tokenizers.path("word_bpe_49k.json"))
    rng = np.random.default_rng(3)
    texts = [" ".join(f"wörd{i}, x{i % 7}." for i in rng.zipf(1.4, 20) % 60) for _ in range(50)] + ["", None, "the the the"]
    for text in texts:
        expected = encoder.library.encode(text or "", add_special_tokens=False).ids
        assert encoder.encode(text) == np.array(expected, "<u4").tobytes()
        assert max(len(encoder.words), len(encoder.older)) <= kept // 2 + 40  # a text has 40 words
