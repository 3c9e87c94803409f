"""Toxicity by weak supervision: many lexicon and pattern voters, a generative label model, a linear classifier.

1. *Voters.* Terms are whole words and word beginnings of 4 to 6 characters that one, two or three different words of
   the text share (patterns that cover inflected and run-on forms). Each term's number of toxic and other labelled documents is counted over all rows that may
   teach; every term that is surprisingly toxic becomes a voter. A voter votes "toxic" where its term occurs.
2. *Label model.* Over all documents and without labels: voters are grouped by their correlations, and EM estimates for each
   group the share of documents with a hidden toxic cause, and for each voter how often it fires with that cause
   and without. Given the cause, voters still correlate (ten spellings of one word); a voter's weight is one over the sum of these correlations.
3. *Classifier.* A logistic regression on the terms, taught the label model's posteriors (as weighted rows of either
   class), of the distinct sets of votes of all documents and how many have each.
4. *Score.* Each whole text once, by the terms it holds.

Words are split at ASCII white space, lower-cased, and stripped of punctuation at both ends.

Scale: counting terms and every EM step are aggregates, combined before the shuffle; only the parameters
(the square of the number of voters at most) come to the driver. A document's terms are distinct, so a term in every document costs one row a
task. Texts are split for counting (labelled rows only) and for votes, which are staged and give the scores, and are never shuffled but to meet their labels.

Defined cases: null and empty texts hold no term and get the score of that; rows with a null id are scored but do
not teach; repeated labels of an id count as their largest; without any toxic label that may teach, every score is 0; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import forget_others, stage, unstage

THRESHOLD, ROUNDS = 0.3, 8
#: A voter's toxic count must be so many standard deviations above what its frequency lets expect, and so large.
LEAST_Z, LEAST_COUNT = 6.0, 3
#: Voters that correlate so much form a group, such as those of one language.
TOGETHER = 0.25
#: A beginning may stand for up to ``LEVELS`` terms: how many words begin so, at that rate in each SPAN words.
LEVELS, SPAN = 3, 400
PREFIXES, WORDS_KEPT, TERMS_HELD = (4, 5, 6), 200_000, 300_000
#: Distinct sets of votes of a task of the label model.
SETS = 20_000
#: Labels up to this number are broadcast (24 MB at most); more are joined by a shuffle.
LABELS_SENT = 1_000_000
_STRIP = ".,;:!?\"'()[]{}<>|*#$%&…«»„“”‘’-_/\\~`^+=@"


def teaches(doc_id: int) -> bool:
    """Whether a row's label may be learned from: the remainder of its id's CRC-32 by 4 is not 2."""
    return zlib.crc32(str(doc_id).encode()) % 4 != 2


def word_terms(word: str) -> list[str]:
    """``=word`` and its beginnings, of a lower-case word."""
    word = word.strip(_STRIP)
    return ["=" + word, *(word[:n] for n in PREFIXES if len(word) >= n)] if word else []


def levels(count: int, n_words: int) -> int:
    """How often a beginning counts as repeated, 1 to ``LEVELS``: by distinct words, and no rarer than that in each ``SPAN`` words."""
    return max(1, min(LEVELS, count, int(count * SPAN / n_words)))


def text_terms(text: str | None) -> set[str]:
    """The terms of a text: ``=word``, and ``beginning*m`` if at least m different words begin so."""
    words = set((text or "").lower().split())
    held = Counter(chain.from_iterable(map(word_terms, words)))
    return {t if t[0] == "=" else f"{t}*{m}" for t, n in held.items() for m in range(1, 2 if t[0] == "=" or n == 1 else levels(n, len(words)) + 1)}


class TermFinder:
    """The numbers of known terms that a text holds; remembers the words that it has met."""

    def __init__(self, terms: list[str]) -> None:
        self.exact = {t: i for i, t in enumerate(terms) if t[0] == "="}
        self.begins: dict[str, list[tuple[int, int]]] = {}
        for i, t in enumerate(terms):
            if t[0] != "=":
                self.begins.setdefault(t[:-2], []).append((int(t[-1]), i))
        self.words: dict[str, tuple[str, ...]] = {}

    def __call__(self, text: str | None) -> list[int]:
        words = set((text or "").lower().split())
        hits: list[str] = []
        known = self.words
        for word in words:
            own = known.get(word)
            if own is None:
                if len(known) >= WORDS_KEPT:
                    known.clear()
                own = known[word] = tuple(t for t in word_terms(word) if t in self.exact or t in self.begins)
            if own:
                hits += own
        found: list[int] = []
        for term, n in Counter(hits).items():
            if term in self.exact:
                found.append(self.exact[term])
            else:
                most = levels(n, len(words))
                found += [i for m, i in self.begins[term] if m <= most]
        return sorted(found)


# --- 1. voters ---

def term_counts(taught: DataFrame) -> DataFrame:
    """``(term, toxic, other)``: documents of either label that hold a term; rows ``(text, toxic)``."""

    def terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget_others()
        counts: tuple[Counter, Counter] = (Counter(), Counter())

        def counted() -> pa.RecordBatch:
            names = list(counts[0].keys() | counts[1].keys())
            columns = [pa.array([c[t] for t in names], pa.int64()) for c in counts]
            for c in counts:
                c.clear()
            return pa.RecordBatch.from_arrays([pa.array(names, pa.string()), columns[1], columns[0]], ["term", "toxic", "other"])

        for batch in batches:
            for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                counts[toxic].update(text_terms(text))
                if len(counts[0]) + len(counts[1]) >= TERMS_HELD:
                    yield counted()
        yield counted()

    held = taught.select("text", F.col("toxic").cast("int").alias("toxic")).mapInArrow(terms, "term string, toxic long, other long")
    return held.groupBy("term").agg(F.sum("toxic").alias("toxic"), F.sum("other").alias("other"))


def choose_voters(taught: DataFrame, share: float) -> list[tuple[str, int, int]]:
    """Terms (and their toxic and other documents) of rows ``(text, toxic)`` of which a ``share`` is toxic, the most surprisingly toxic first."""
    if not 0 < share < 1:
        return []
    held = F.col("toxic") + F.col("other")
    z = (F.col("toxic") - held * share) / F.sqrt(held * share * (1 - share))
    good = (F.col("toxic") >= LEAST_COUNT) & (F.col("toxic") >= 3 * F.col("other")) & (z >= LEAST_Z)
    chosen = term_counts(taught).where(good).orderBy(F.desc(z), "term")
    return [(r["term"], r["toxic"], r["other"]) for r in chosen.collect()]


# --- 2. label model ---

class LabelModel:
    """Groups of correlated voters, each with a hidden cause that makes a document toxic.

    prior: P(cause) by group; hit and false: P(voter fires) with its group's cause and without; weight: how much of
    a voter's evidence is its own. Groups are independent: a document is toxic if any cause is there.
    """

    def __init__(self, group: np.ndarray, prior: np.ndarray, hit: np.ndarray, false: np.ndarray, weight: np.ndarray) -> None:
        self.group, self.weight = group, weight
        self.prior, self.hit = np.clip(prior, 1e-5, 0.5), np.clip(hit, 1e-4, 0.99)
        self.false = np.clip(false, 1e-7, 0.9 * self.hit)
        silent = weight * (np.log1p(-self.hit) - np.log1p(-self.false))
        self.fired = weight * (np.log(self.hit) - np.log(self.false)) - silent
        self.base = np.log(self.prior) - np.log1p(-self.prior) + np.bincount(group, silent, len(prior))

    def causes(self, votes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The groups that ``votes`` are of, and P(cause) of each."""
        groups, at = np.unique(self.group[votes], return_inverse=True)
        odds = self.base[groups] + np.bincount(at, self.fired[votes], len(groups))
        return groups, _chance(odds)

    def posterior(self, votes: list[np.ndarray]) -> np.ndarray:
        clean = np.log1p(-_chance(self.base))
        none, out = clean.sum(), np.empty(len(votes))
        for i, own in enumerate(votes):
            groups, p = self.causes(own)
            out[i] = -np.expm1(none - clean[groups].sum() + np.log1p(-p).sum())
        return out


def _chance(odds: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(odds, -30, 30)))


def _ints(column: pa.Array) -> list[np.ndarray]:
    return [np.array(x, np.int64) for x in column.to_pylist()]


def _pair_counts(votes: DataFrame, model: LabelModel | None, n: int, pairs: bool) -> tuple[float, np.ndarray, np.ndarray, np.ndarray]:
    """One pass over rows ``(votes, n)``: documents, expected causes by group, fired with and without cause, and both fired with cause.

    Without a model every vote counts as one with its cause, whatever its group. A task sends a row for each voter that fires in it, which
    holds the voters that fire with it as a sparse row of the matrix of pairs, and one for each group.
    """

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, fired = 0.0, np.zeros((2, n))
        caused, seen = np.zeros(n), np.zeros(n)
        both: dict[int, float] = {}
        for batch in batches:
            for own, m in zip(_ints(batch.column(0)), batch.column(1).to_pylist()):
                total += m
                p = np.ones(len(own))
                if model is not None and len(own):
                    groups, q = model.causes(own)
                    caused[groups] += q * m
                    seen[groups] += m
                    p = q[np.searchsorted(groups, model.group[own])]
                fired[0, own] += p * m
                fired[1, own] += (1 - p) * m
                if pairs:
                    for i, a in enumerate(own.tolist()):
                        for b in own[i + 1 :].tolist():
                            if model is None or model.group[a] == model.group[b]:
                                both[a * n + b] = both.get(a * n + b, 0.0) + p[i] * m
        if model is not None:
            k = len(model.base)
            caused[:k] += (total - seen[:k]) * _chance(model.base)
        voters, groups = np.flatnonzero(fired.any(0)), np.flatnonzero(caused)
        flat = np.array(sorted(both), np.int64)
        ends = np.concatenate([[0], np.searchsorted(flat, (voters + 1) * n), np.full(len(groups) + 1, len(flat))])
        none = np.zeros(len(groups) + 1)
        arrays = [np.concatenate([voters, n + groups, [-1]]), np.concatenate([fired[0, voters], caused[groups], [total]]), np.concatenate([fired[1, voters], none])]
        lists = [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(x)) for x in (flat % n, np.array([both[x] for x in flat.tolist()], float))]
        yield pa.RecordBatch.from_arrays([*map(pa.array, arrays), *lists], ["at", "a", "b", "others", "sums"])

    def added(table: pa.Table) -> pa.Table:
        """The sum of the rows of one voter or group."""
        others, place = np.unique(pc.list_flatten(table["others"]).to_numpy(), return_inverse=True)
        sums = np.bincount(place, pc.list_flatten(table["sums"]).to_numpy(), len(others))
        return pa.table([table["at"][:1].combine_chunks(), *(pa.array([pc.sum(table[c]).as_py()]) for c in "ab"), pa.array([others], pa.list_(pa.int64())), pa.array([sums], pa.list_(pa.float64()))], ["at", "a", "b", "others", "sums"])

    kinds = "at long, a double, b double, others array<long>, sums array<double>"
    rows = votes.mapInArrow(sums, kinds).groupBy("at")
    rows = rows.applyInArrow(added, kinds) if pairs else rows.agg(F.sum("a").alias("a"), F.sum("b").alias("b")).select("*", F.lit(None), F.lit(None))
    total, fired, caused, both = 0.0, np.zeros((2, n)), np.zeros(n), np.zeros((n, n) if pairs else (0, 0))
    for at, a, b, others, with_cause in rows.collect():
        if at < 0:
            total = a
        elif at < n:
            fired[:, at] = a, b
            if others:
                both[at, others] = both[others, at] = with_cause
        else:
            caused[at - n] = a
    return total, caused, fired, both


def _together(own: np.ndarray, both: np.ndarray, total: float) -> np.ndarray:
    """Correlations of 0/1 variables as a share of the largest that their frequencies allow, from their counts."""
    p = own / max(total, 1e-9)
    most = np.minimum.outer(p, p) * (1 - np.maximum.outer(p, p))
    found = np.divide(both / max(total, 1e-9) - np.outer(p, p), most, out=np.zeros_like(both), where=most > 0)
    np.fill_diagonal(found, 1.0)
    return found


def _groups(together: np.ndarray) -> np.ndarray:
    """The number of each voter's group: that of the first group whose first voter it goes ``TOGETHER`` with."""
    group, first = np.zeros(len(together), np.int64), []
    for i in range(len(together)):
        near = [g for g, j in enumerate(first) if together[i, j] >= TOGETHER]
        if not near:
            first.append(i)
        group[i] = near[0] if near else len(first) - 1
    return group


def fit_label_model(votes: DataFrame, hit: np.ndarray, false: np.ndarray, rounds: int = ROUNDS) -> LabelModel:
    """EM over rows ``(votes array<int>, n long)``: distinct sets of votes and how many documents have each.

    ``hit`` and ``false`` are where it starts from: how often voters fire in toxic and in other labelled documents.
    """
    n = len(hit)
    # tasks by the number of sets, however many partitions they come in: each sends its own sums
    votes = votes.coalesce(max(votes.sparkSession.sparkContext.defaultParallelism, -(-votes.count() // SETS)))
    total, _, fired, both = _pair_counts(votes, None, n, True)
    group = _groups(_together(fired[0], both, total))
    k = group.max() + 1
    prior = np.array([fired[0][group == g].max() for g in range(k)]) / max(total, 1.0)
    model = LabelModel(group, prior, hit, false, np.ones(n))
    for step in range(rounds):
        pairs = step in (1, rounds // 2)
        total, caused, fired, both = _pair_counts(votes, model, n, pairs)
        if not total:
            return model
        with_cause = np.maximum(caused[group], 1e-6)
        weight = model.weight
        if pairs:
            p = fired[0] / with_cause
            joint = both / with_cause[:, None]
            spread = np.sqrt(np.outer(p * (1 - p), p * (1 - p)))
            alike = np.divide(joint - np.outer(p, p), spread, out=np.zeros_like(both), where=(spread > 1e-9) & (both > 0))
            np.fill_diagonal(alike, 1.0)
            weight = 1 / np.where(alike >= 0.2, np.minimum(alike, 1.0), 0.0).sum(1)
        model = LabelModel(group, caused[:k] / total, (fired[0] + 0.1) / (with_cause + 1), (fired[1] + 0.01) / (total - with_cause + 1), weight)
    return model


# --- 3. and 4. classifier ---

def fit_classifier(votes: DataFrame, model: LabelModel, n: int) -> tuple[np.ndarray, float]:
    """Weights and intercept of a logistic regression on terms, taught posteriors; rows ``(votes, n)``."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import CountVectorizerModel

    def taught(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p = model.posterior(_ints(batch.column(0)))
            many = batch.column(1).to_numpy().astype(float)
            for label, weight in ((1.0, p * many), (0.0, (1 - p) * many)):
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.full(len(p), label)), pa.array(weight)], ["votes", "label", "weight"])

    rows = votes.mapInArrow(taught, "votes array<int>, label double, weight double").where("weight > 1e-6")
    sparse = CountVectorizerModel.from_vocabulary([str(i) for i in range(n)], "votes", "features", minTF=1.0)
    data = sparse.transform(rows.withColumn("votes", F.col("votes").cast("array<string>"))).select("features", "label", "weight")
    fitted = LogisticRegression(weightCol="weight", regParam=1e-6, maxIter=100, standardization=False).fit(data)
    return fitted.coefficients.toArray(), float(fitted.intercept)


class Scorer:
    """Terms, their weights and an intercept: what scores a text."""

    def __init__(self, terms: list[str], weights: np.ndarray, intercept: float) -> None:
        self.terms, self.weights, self.intercept = terms, weights, intercept

    def of_votes(self, votes: list[np.ndarray]) -> np.ndarray:
        """Scores of texts by the numbers of the terms that they hold."""
        if not self.terms:
            return np.zeros(len(votes))
        odds = np.array([self.intercept + self.weights[v].sum() for v in votes])
        return 1 / (1 + np.exp(-np.clip(odds, -40, 40)))

    def scores(self) -> Callable[[list[str | None]], np.ndarray]:
        find = TermFinder(self.terms)

        def of(texts: list[str | None]) -> np.ndarray:
            return self.of_votes([np.array(find(t), np.int64) for t in texts])

        return of


def fit(docs: DataFrame, labels: DataFrame, id_col="doc_id", text_col="text") -> Scorer:
    """Learn from ``labels`` (doc_id, toxic) of the rows that may teach, and from the texts of all ``docs``."""
    return fit_and_vote(docs, labels, (id_col,), id_col, text_col)[0]


def fit_and_vote(docs: DataFrame, labels: DataFrame, keep: tuple[str, ...], id_col="doc_id", text_col="text") -> tuple[Scorer, DataFrame]:
    """The scorer, and a staged table ``(row, votes)``: a struct of the columns ``keep`` of each row, and its votes, all that a score depends on."""
    plain = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    may = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(4)) != 2
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
    known = known.where(F.col("toxic").isin(0, 1) & may).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    known = stage(known, "labels")
    total = known.agg(F.count(F.lit(1)).alias("n"), F.avg("toxic").alias("share")).first()
    sent = F.broadcast(known) if total["n"] <= LABELS_SENT else known
    voters = choose_voters(plain.join(sent, "doc_id").select("text", "toxic"), total["share"] or 0.0)
    terms = [v[0] for v in voters]

    @F.pandas_udf("array<int>")
    def vote(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        forget_others()
        find = TermFinder(terms)
        for texts in batches:
            yield pd.Series([find(t) for t in texts.tolist()])

    row = F.struct(*[F.col(c) for c in keep]).alias("row")
    voted = stage(docs.select(row, vote(F.col(text_col)).alias("votes")), "votes")
    if not voters:
        return Scorer([], np.empty(0), 0.0), voted
    toxic = total["share"] * total["n"]
    hit, false = (np.array([v[i] for v in voters], float) for i in (1, 2))
    hit, false = hit / toxic, (false + 0.5) / (total["n"] - toxic + 1)
    sets = stage(voted.groupBy("votes").agg(F.count(F.lit(1)).alias("n")), "vote-sets")
    model = fit_label_model(sets, hit, false)
    scorer = Scorer(terms, *fit_classifier(sets, model, len(terms)))
    unstage(sets, known)
    return scorer, voted


def learn_and_score(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, id_col="doc_id", text_col="text") -> DataFrame:
    """:func:`score` of the rows of ``docs`` by what :func:`fit` learns from them, their texts read once for both."""
    scorer, voted = fit_and_vote(docs, labels, (id_col,), id_col, text_col)
    known = voted.select(F.col("row")[id_col].cast("long").alias("doc_id"), "votes")

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = scorer.of_votes(_ints(batch.column(1)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found), pa.array((found >= threshold).astype(np.int32))], ["doc_id", "score", "predicted"])

    return _with_fold(known.mapInArrow(scored, "doc_id long, score double, predicted int"))


def _with_fold(done: DataFrame) -> DataFrame:
    held_out = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(4)) == 2, F.lit(False))
    return done.select("doc_id", held_out.alias("held_out"), "score", "predicted")


def clean_rows(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, id_col="doc_id", text_col="text") -> DataFrame:
    """The rows of ``docs`` that score below ``threshold`` by what :func:`fit` learns from them, with all their columns."""
    scorer, voted = fit_and_vote(docs, labels, tuple(docs.columns), id_col, text_col)

    @F.pandas_udf("boolean")
    def clean(votes: pd.Series) -> pd.Series:
        return pd.Series(scorer.of_votes([np.asarray(v, np.int64) for v in votes]) < threshold)

    return voted.where(clean("votes")).select("row.*")


def score(docs: DataFrame, scorer: Scorer, threshold: float = THRESHOLD, id_col="doc_id", text_col="text") -> DataFrame:
    """``(doc_id, held_out, score, predicted)`` of each row; held out: the row's label may not teach."""

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = scorer.scores()
        for batch in batches:
            found = of(batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found), pa.array((found >= threshold).astype(np.int32))], ["doc_id", "score", "predicted"])

    plain = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    done = plain.mapInArrow(scored, "doc_id long, score double, predicted int")
    return _with_fold(done)


def keep_clean(docs: DataFrame, scorer: Scorer, threshold: float = THRESHOLD, text_col="text") -> DataFrame:
    """The rows of ``docs`` that score below ``threshold``, with all their columns."""

    @F.pandas_udf("boolean")
    def clean(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        of = scorer.scores()
        for texts in batches:
            yield pd.Series(of(texts.tolist()) < threshold)

    return docs.where(clean(F.col(text_col)))
