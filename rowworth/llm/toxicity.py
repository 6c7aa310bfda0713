"""Toxicity by weak supervision: mined voters, a generative label model, a linear classifier."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rowworth.llm.text import U64, batches, fold, hash_sample, mix, span_hashes
from rowworth.session import settle

#: labelled rows that the models are fitted on, at most
FIT_ROWS = 16_000
#: words and word beginnings that the classifier knows
FEATURES = 6_000
VOTERS = 24
#: words and beginnings that vote: the strongest ones, and how much likelier each has to be in marked rows at least
VOTING, LIKELIER = 4 * VOTERS, 5.0
_LETTER = np.zeros(256, dtype=bool)
_LETTER[[*range(ord("0"), ord("9") + 1), *range(ord("a"), ord("z") + 1), *range(128, 256)]] = True
_STEMS = (4, 5, 6)


def text_features(text: str | None) -> np.ndarray:
    """Distinct hashes of a text's words, and of the first 4, 5 and 6 bytes of longer ones."""
    buffer = fold(text)
    inside = np.zeros(len(buffer) + 2, dtype=np.int8)
    inside[1:-1] = _LETTER[buffer]
    edge = np.diff(inside)
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    found = [span_hashes(buffer, starts, ends)]
    for number, size in enumerate(_STEMS):
        long = ends - starts > size
        stems = span_hashes(buffer, starts[long], starts[long] + size)
        found.append(mix(stems + U64(number + 1)))
    return np.unique(np.concatenate(found)).view(np.int64)


def _feature_counts(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for texts, toxic in batches(["text", "toxic"], rows):
        found = [text_features(t) for t in texts]
        named = np.concatenate([f * 0 + t for f, t in zip(found, toxic)] or [np.empty(0, dtype=np.int64)])
        whole, at = np.unique(np.concatenate(found), return_inverse=True)
        ones = np.bincount(at, weights=named, minlength=len(whole)).astype(np.int64)
        all_ = np.bincount(at, minlength=len(whole)).astype(np.int64)
        yield pa.record_batch({"feature": pa.array(whole), "ones": pa.array(ones), "docs": pa.array(all_)})


def _known_features(known: np.ndarray):
    """Places in the sorted array `known` of each text's features."""

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for texts, toxic in batches(["text", "toxic"], rows):
            places = []
            for text in texts:
                found = text_features(text)
                at = np.minimum(np.searchsorted(known, found), len(known) - 1)
                places.append(at[known[at] == found].tolist())
            yield pa.record_batch({"places": pa.array(places, pa.list_(pa.int64())), "toxic": pa.array(toxic, pa.int32())})

    return run


class LabelModel:
    """Two classes, voters that fire or not, each with a rate in either class.

    Rates are fitted by expectation-maximisation on votes alone, from a given start. Voters that
    fire together within a class repeat each other: the correlation left within the classes is
    estimated, and a voter's evidence is divided by how much of it the others repeat. The last
    voter is the mark a row was given; it repeats no other and is right in `trust` of the rows at most.
    """

    def __init__(self, votes: np.ndarray, start: np.ndarray, prior: float, rounds: int = 25, trust: float = 0.99):
        self.prior = min(max(prior, 1e-3), 1 - 1e-3)
        posterior = start
        for _ in range(rounds):
            self.rates = np.stack([self._rates(votes, posterior), self._rates(votes, 1 - posterior)])
            self.rates[:, -1] = np.clip(self.rates[:, -1], 1 - trust, trust)
            self.share = self._overlap(votes, posterior)
            new = self.posterior(votes)
            if np.abs(new - posterior).max(initial=0.0) < 1e-6:
                break
            posterior = new

    @staticmethod
    def _rates(votes: np.ndarray, weight: np.ndarray) -> np.ndarray:
        return np.clip((weight @ votes + 0.5) / (weight.sum() + 1.0), 1e-4, 1 - 1e-4)

    def _overlap(self, votes: np.ndarray, posterior: np.ndarray) -> np.ndarray:
        left = votes - posterior[:, None] * self.rates[0] - (1 - posterior)[:, None] * self.rates[1]
        spread = np.sqrt((left**2).mean(axis=0)) + 1e-9
        self.correlation = (left.T @ left) / len(left) / np.outer(spread, spread)
        share = 1.0 / np.maximum(np.clip(self.correlation[:, :-1], 0, 1).sum(axis=1), 1.0)
        share[-1] = 1.0
        return share

    def posterior(self, votes: np.ndarray) -> np.ndarray:
        fires = np.log(self.rates[0] / self.rates[1])
        silent = np.log((1 - self.rates[0]) / (1 - self.rates[1]))
        # a voter that is silent beside others that fire abstains: few texts hold words of every lexicon
        none = (votes[:, :-1].sum(axis=1) == 0)[:, None]
        quiet = np.where(none, 1 - votes, 0)
        quiet[:, -1] = 1 - votes[:, -1]
        odds = np.log(self.prior / (1 - self.prior)) + votes @ (self.share * fires) + quiet @ (self.share * silent)
        return 1 / (1 + np.exp(-np.clip(odds, -500, 500)))


def fit_linear(places: list[list[int]], target: np.ndarray, width: int, rounds: int = 400, decay: float = 1e-4) -> tuple[np.ndarray, float]:
    """Logistic regression on posterior labels: accelerated gradient steps over all rows.

    Plain steps and a quadratic penalty share the weight among words that always come together
    (those of a copied text), so that words seen in many texts carry it.
    """
    lengths = np.array([len(p) for p in places])
    columns = np.concatenate([np.asarray(p, dtype=np.int64) for p in places] or [np.empty(0, dtype=np.int64)])
    rows = np.repeat(np.arange(len(places)), lengths)
    columns, rows = np.append(columns, np.full(len(places), width)), np.append(rows, np.arange(len(places)))
    penalty = np.append(np.full(width, decay), 0.0)

    def forward(w):
        return np.bincount(rows, weights=w[columns], minlength=len(places))

    def back(e):
        return np.bincount(columns, weights=e[rows], minlength=width + 1)

    probe = np.ones(width + 1)
    for _ in range(20):
        probe = back(forward(probe)) / len(places)
        probe /= np.linalg.norm(probe)
    bend = 0.3 * np.linalg.norm(back(forward(probe)) / len(places)) + decay
    weights = now = np.zeros(width + 1)
    pace = 1.0
    for _ in range(rounds):
        error = 1 / (1 + np.exp(-np.clip(forward(now), -500, 500))) - target
        new = now - (back(error) / len(places) + penalty * now) / bend
        next_pace = (1 + np.sqrt(1 + 4 * pace**2)) / 2
        now = new + (pace - 1) / next_pace * (new - weights)
        weights, pace = new, next_pace
    return weights[:-1], float(weights[-1])


def _scores(known: np.ndarray, weights: np.ndarray, bias: float):
    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in batches(["doc_id", "text"], rows):
            out = []
            for text in texts:
                margin = bias
                if len(known):
                    found = text_features(text)
                    at = np.minimum(np.searchsorted(known, found), len(known) - 1)
                    margin += float(weights[at[known[at] == found]].sum())
                out.append(1 / (1 + np.exp(-np.clip(margin, -500, 500))))
            yield pa.record_batch({"doc_id": pa.array(ids, pa.int64()), "score": pa.array(out, pa.float64())})

    return run


def score_toxicity(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, fit_rows: int = FIT_ROWS) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of `docs(doc_id, text)`.

    Rows whose crc32 of the doc_id as text leaves 1 modulo 3 are held out: nothing is learned from
    them. Of the other rows that `labels(doc_id, toxic)` marks, at most `fit_rows` are fitted on.
    Words and word beginnings that occur much more in marked rows make VOTERS lexicons and
    patterns; a generative model of their votes and the mark gives posterior labels with each voter's accuracy
    and the correlations between voters; a linear classifier over FEATURES words and beginnings
    is trained on those posteriors and scores every whole text. Label, language, source and
    doc_id are no inputs of a score.

    Null and empty texts get the score of a text without known words. A null doc_id counts as not
    held out. Repeated rows get equal results. Without marked rows of both kinds every score is
    the base rate. An empty table gives no row.
    """
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False))
    usable = labels.where("doc_id IS NOT NULL AND toxic IN (0, 1)").where(~held)
    drawn = hash_sample(usable.groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic")), fit_rows, "doc_id")
    # at most fit_rows rows of two numbers
    fit = settle(docs.select("doc_id", "text").join(F.broadcast(drawn), "doc_id").select("text", "toxic"))
    total, ones = fit.agg(F.count(F.lit(1)), F.coalesce(F.sum("toxic"), F.lit(0))).first()
    known, weights, bias = np.empty(0, dtype=np.int64), np.zeros(0), float(np.log((ones + 0.5) / (total - ones + 0.5)))
    if 0 < ones < total:
        counts = fit.mapInArrow(_feature_counts, "feature long, ones long, docs long").groupBy("feature")
        counts = counts.agg(F.sum("ones").alias("ones"), F.sum("docs").alias("docs")).where("docs >= 5")
        odds = F.log((F.col("ones") + 0.5) / (ones + 1)) - F.log((F.col("docs") - F.col("ones") + 0.5) / (total - ones + 1))
        # evidence for one class or the other: log odds times how often it was seen
        top = counts.withColumn("odds", odds).orderBy(F.desc(F.abs("odds") * F.sqrt("docs")), "feature").limit(FEATURES).collect()
        top.sort(key=lambda r: r.feature)
        known = np.array([r.feature for r in top], dtype=np.int64)
        strength = np.array([r.odds for r in top])
        seen = np.array([r.docs for r in top])
        rows = fit.mapInArrow(_known_features(known), "places array<long>, toxic int").collect()
        # voters: the features that speak for the class, dealt out by rank, so that each is a lexicon of its own
        speak = np.flatnonzero(strength > np.log(LIKELIER))
        speak = speak[np.argsort(-strength[speak] * np.sqrt(seen[speak]), kind="stable")][:VOTING]
        voter_of = np.full(len(known), -1)
        voter_of[speak] = np.arange(len(speak)) % VOTERS
        votes = np.zeros((len(rows), VOTERS + 1))
        for i, r in enumerate(rows):
            voters = voter_of[np.asarray(r.places, dtype=np.int64)] if r.places else np.empty(0, dtype=np.int64)
            votes[i, voters[voters >= 0]] = 1
            votes[i, -1] = r.toxic
        start = np.array([0.9 if r.toxic else 0.1 for r in rows])
        model = LabelModel(votes, start, ones / total)
        # no voter has anything to say against the mark of a row without votes
        unheard = votes[:, :-1].sum(axis=1) == 0
        posterior = np.where(unheard, votes[:, -1], model.posterior(votes))
        weights, bias = fit_linear([r.places for r in rows], posterior, len(known))
    scored = docs.select("doc_id", "text").mapInArrow(_scores(known, weights, bias), "doc_id long, score double")
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
