"""Findings of round 3: words of the token files, pairs of voters, memory of line dedup."""

import numpy as np
import pytest

from millrace.llm import tokens

public_tokenizers = pytest.importorskip("public_tokenizers")


def encoder() -> tokens.WordEncoder:
    return tokens.WordEncoder(public_tokenizers.path("word_bpe_49k.json"))


def test_forms_of_a_word_are_learned_once():
    own, given = encoder(), []

    class Counting:
        def __init__(self, library):
            self.library = library

        def encode_batch_fast(self, texts, **more):
            given.extend(w for t in texts for w in t.split())
            return self.library.encode_batch_fast(texts, **more)

    text = "Oftionnten oftionnten, OFTIONNTEN. (oftionnten) \u00c9cole \u00e9cole, \u00c9COLE. oftionnten's"
    expected = own.library.encode(text, add_special_tokens=False).ids
    own.plain, own.library = Counting(own.plain), Counting(own.library)
    assert own.encode(text) == np.array(expected, "<u4").tobytes()
    assert sum("ften" in w.lower() or "oftionnten" in w.lower() for w in given) == 1 and sum("cole" in w.lower() for w in given) == 1


def test_settled_characters_are_those_of_the_library():
    own = encoder()
    assert own.cuts
    marks = [chr(i) for i in range(1, 0x2100) if not 0xD800 <= i < 0xE000]
    texts = [f"Ab{c}Cd {c}{c} 1{c}2, {c}'s{c}. '{c}" for c in marks] + ["DON'T we'll 'Til x'sa it's\t\r\n a..b,,c ... 12\u00bd\u00b2"]
    for text in texts:
        assert own.encode(text) == np.array(own.library.encode(text, add_special_tokens=False).ids, "<u4").tobytes(), text
    assert not tokens._UNSETTLED.search("na\u00efve \u2019 \u20ac") and tokens._UNSETTLED.search("e\u0301") and tokens._UNSETTLED.search("\u0130")


def test_pairs_of_voters_are_rows_of_a_matrix(spark):
    """Sets of 60 votes of 60 voters, in 50 partitions: a task sends a row for each voter, not for each pair, and tasks go by the number of sets."""
    from millrace.llm import toxicity

    n, sets = 60, [(list(range(i % 3, 60)), 1 + i % 4) for i in range(500)] + [([], 7000), ([5, 9], 2)]
    votes = spark.createDataFrame(sets, "votes array<int>, n long").repartition(50)
    fired = np.zeros((len(sets), n))
    for i, (own, _) in enumerate(sets):
        fired[i, own] = 1
    many = np.array([m for _, m in sets])
    pairs = (fired * many[:, None]).T @ fired
    sent = []
    plain = type(votes).mapInArrow

    def counted(self, function, *more):
        done = plain(self, function, *more)
        sent.append(done.count())
        return done

    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(type(votes), "mapInArrow", counted)
        total, _, found, both = toxicity._pair_counts(votes.coalesce(2), None, n, True)
        toxicity.fit_label_model(votes, np.full(n, 0.5), np.full(n, 0.01))
    assert total == many.sum() and np.allclose(found[0], pairs.diagonal()) and np.allclose(both, pairs - np.diag(pairs.diagonal()))
    # a row a voter, one for all documents, and one a group
    tasks = spark.sparkContext.defaultParallelism
    assert sent[0] <= 2 * (n + 1) and max(sent[1:]) <= tasks * (2 * n + 1)


def test_tasks_of_line_dedup_forget_words_and_take_slices(monkeypatch):
    import pyarrow as pa

    from millrace.llm import line_dedup, shared

    class Task:
        def mapInArrow(self, function, schema):  # noqa: N802
            return function

    forgot = []
    monkeypatch.setattr(shared, "_forget", [lambda: forgot.append(1)])
    n, line = 1800, "a line of more than forty characters, number "
    batch = pa.record_batch([pa.array([0] * n, pa.int32()), pa.array(range(n), pa.int64()), pa.array(range(n), pa.int64()), pa.array([f"{line}{i}\nshort" for i in range(n)])], ["batch", "doc_id", "tie", "text"])
    made = list(line_dedup.keyed_lines(Task())(iter([batch])))
    assert forgot and max(b.num_rows for b in made) <= 500
    rows = [r for b in made for r in b.to_pylist()]
    assert [r["doc_id"] for r in rows] == list(range(n)) and all(r["key"] == line_dedup.line_key(f"{line}{r['doc_id']}".encode()) for r in rows)
