"""Every qualifying term of the toxicity operator counts, however many there are."""

import random

from millrace.llm import toxicity


def test_rare_terms_vote(spark):
    """Far more than 256 terms qualify; those of the rarest word, last by z, still find its documents."""
    draw = random.Random(7)
    word = lambda: "".join(draw.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(9))
    plain, common, rare = [word() for _ in range(60)], [word() for _ in range(80)], word()
    bad = [w for w in common for _ in range(16)] + [rare] * 8
    rows = [(i, " ".join(draw.sample(plain, 8) + [w] * (w is not None))) for i, w in enumerate([*bad, *[None] * 14_000])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i < len(bad))) for i, _ in rows], "doc_id long, toxic int")
    scorer = toxicity.fit(docs, labels)
    assert len(scorer.terms) > 256 and "=" + rare in scorer.terms
    assert {r.doc_id for r in toxicity.score(docs, scorer).collect() if r.predicted} == set(range(len(bad)))
