"""Toxicity by weak supervision: voters, a generative label model, a linear classifier on its posterior labels."""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import pick
from .training import Ftrl, fitted, held_out, labelled_sample, logistic

#: Labelled documents learnt from at most: the one bound on rows.
MOST_ROWS = 12_000
#: A unit of text becomes a lexicon voter if so many toxic documents hold it, if it is so much likelier there
#: (a natural logarithm), and if chance would explain that no better than so many deviations.  There is no bound on voters.
LEAST_DOCS, LEAST_GAIN, LEAST_Z = 3, 3.0, 5.0
#: Rounds of the label model, rounds after which its dependencies are found anew, and the least evidence for one (nats over all rows).
ROUNDS, REBUILT, LEAST_EVIDENCE = 30, (3, 8, 15), 10.0
CACHED_WORDS = 400_000
#: A small general lexicon, each entry one voter.
LEXICON = """
idiot idiots moron morons stupid dumb trash garbage loser losers scum pathetic disgusting worthless clown hate kill ugly filthy vermin parasite
imbecile cretin fool jerk bastard bitch coward liar freak creep pig rat maggot scumbag dirtbag lowlife degenerate subhuman brainless clueless
idiota idiotas imbécil imbéciles estúpido estúpida tonto basura asqueroso inútil payaso cerdo cobarde
idiot imbécile stupide crétin débile ordure minable dégoûtant clown lâche porc
dummkopf trottel blödmann vollidiot abschaum widerlich wertlos versager schwein feigling
""".split()
#: Insults addressed to someone, threats, dismissals, masked insults, and shouting.
PATTERNS = {
    "you are": re.compile(r"\b(?:you(?:'re| are)?|u r) (?:an? |such an? |all )?(?:idiot|moron|loser|clown|scum|trash|pathetic|worthless|disgusting|stupid)s?\b", re.I),
    "threat": re.compile(r"\b(?:i|we)(?:'ll| will| am going to) (?:kill|hurt|find|destroy) you\b", re.I),
    "wish": re.compile(r"\b(?:go (?:die|kill yourself|to hell)|drop dead|hope you die)\b", re.I),
    "silence": re.compile(r"\b(?:shut up|shut your mouth|nobody asked you|get lost)\b", re.I),
    "all of them": re.compile(r"\b(?:hate|kill|despise) (?:all|every one of|those|these) \w+", re.I),
    "masked": re.compile(r"\b(?:id[*#@!]ot|m[*#@0]ron|st[*#@]pid|tr[*#@4]sh|l[*#@0]ser)\b", re.I),
    "shouting": re.compile(r"(?:\b[A-Z]{3,}\b\W+){6,}!|!{4,}"),
}
_WORD = re.compile(r"[^\W\d_]+")


def units(word: str) -> tuple[str, ...]:
    """What may vote when ``word`` stands in a text: the word, and its openings of four to six letters."""
    return (word, *(f"{word[:k]}*" for k in (4, 5, 6) if len(word) > k))


def words(text: str) -> set[str]:
    return set(_WORD.findall(text.lower()))


def views(bag: set[str]) -> list[set[str]]:
    """The units of all words of a text, without their marks: words, and openings of four, five and six letters."""
    return [bag, *({w[:k] for w in bag if len(w) > k} for k in (4, 5, 6))]


def mined(bags: list[set[str]], y: np.ndarray) -> list[str]:
    """Units that stand in toxic documents far more often than in others: lexicon and opening voters, as labels suggest them."""
    toxic = [Counter() for _ in range(4)]
    for bag, t in zip(bags, y):
        if t:
            for held, view in zip(toxic, views(bag)):
                held.update(view)
    often = [{u for u, n in held.items() if n >= LEAST_DOCS} for held in toxic]
    rest = [Counter() for _ in range(4)]
    for bag, t in zip(bags, y):
        if not t:
            for held, view, good in zip(rest, views(bag), often):
                held.update(view & good)
    n1, n0, found = max(1.0, y.sum()), max(1.0, len(y) - y.sum()), []
    for end, good, held, other in zip(("", "*", "*", "*"), often, toxic, rest):
        for u in good:
            share = (held[u] + other[u]) / (n1 + n0)
            gain = np.log((held[u] + 0.5) / (n1 + 1)) - np.log((other[u] + 0.5) / (n0 + 1))
            z = (held[u] / n1 - other[u] / n0) / np.sqrt(max(share * (1 - share), 1e-12) * (1 / n1 + 1 / n0))
            if gain > LEAST_GAIN and z > LEAST_Z:
                found.append(u + end)
    return sorted(found)


def dependencies(votes: np.ndarray, q: np.ndarray, least: float) -> np.ndarray:
    """For each voter the one it depends on most given the class, or -1: a maximum spanning forest of conditional mutual information.

    Chow and Liu's tree, grown voter by voter (Prim); an edge needs ``least`` nats over all rows.  A row of
    the matrix of informations is made when its voter joins, so the matrix is never held.
    """
    n, m = votes.shape
    weights = (q.astype(np.float64), 1 - q.astype(np.float64))
    sides = [(w, max(w.sum(), 1e-9), votes.T @ w.astype(np.float32) / max(w.sum(), 1e-9)) for w in weights]
    parent, best, source, joined = np.full(m, -1), np.full(m, -1.0), np.full(m, -1), np.zeros(m, bool)
    for _ in range(m):
        k = int(np.where(joined, -2.0, best).argmax())
        joined[k] = True
        if best[k] > least:
            parent[k] = source[k]
        fires = np.flatnonzero(votes[:, k])
        info = np.zeros(m)
        for w, total, share in sides:
            both = (votes[fires] * w[fires, None].astype(np.float32)).sum(0) / total
            a, b = share[k], share
            for joint, apart in ((both, a * b), (a - both, a * (1 - b)), (b - both, (1 - a) * b), (1 - a - b + both, (1 - a) * (1 - b))):
                joint = np.maximum(joint, 1e-12)
                info += total * joint * np.log(joint / np.maximum(apart, 1e-12))
        better = (info > best) & ~joined
        best[better], source[better] = info[better], k
    return parent


def first_weights(votes: np.ndarray) -> np.ndarray:
    """What each voter counts at first: more if it fires rarely, less if others fire with it (by the sum of squared correlations)."""
    n, m = votes.shape
    rate = np.clip(votes.mean(0, dtype=np.float64), 1e-6, 1 - 1e-6)
    spread, weight = np.sqrt(rate * (1 - rate)), np.zeros(m)
    for k in range(m):
        both = votes[votes[:, k] > 0].sum(0) / n
        weight[k] = -np.log(rate[k]) / max(1.0, (((both - rate * rate[k]) / (spread * spread[k])) ** 2).sum())
    return weight.astype(np.float32)


class LabelModel:
    """A generative model of voters alone, without any label: a hidden class, each voter's rates of firing in it, and dependencies.

    A vote is 1 where a voter fires and 0 where it abstains.  Given the class, a voter's firing depends on
    at most one other's (``parent``), so a group of voters that say the same counts about once.  Rates
    and forest are found by expectation-maximisation from weighted vote counts; class 1 is the one in which
    voters fire more.  ``rates``: of firing in class 1 and 0, the voters' accuracies.
    """

    def __init__(self, votes: np.ndarray):
        votes = votes.astype(np.float32)
        n, m = votes.shape
        said = votes @ first_weights(votes)
        q = np.clip(0.02 + 0.3 * said / max(said[said > 0].mean() if (said > 0).any() else 1.0, 1e-9), 0.02, 0.95)
        self.parent, self.rates = np.full(m, -1), np.zeros((2, m))
        for step in range(ROUNDS):
            if step in REBUILT:
                self.parent = dependencies(votes, q, LEAST_EVIDENCE)
            own, has = np.flatnonzero(self.parent < 0), np.flatnonzero(self.parent >= 0)
            above = votes[:, self.parent[has]]
            both, sums = votes[:, has] * above, []
            for c, w in ((1, q), (0, 1 - q)):
                w = w.astype(np.float32)
                total = float(w.sum())
                rate = self.rates[c] = np.clip((votes.T @ w + 0.05) / (total + 1.0), 1e-6, 1 - 1e-6)
                up, fired = above.T @ w, both.T @ w
                with_it = np.clip((fired + rate[has]) / (up + 1.0), 1e-6, 1 - 1e-6)
                without = np.clip((votes[:, has].T @ w - fired + rate[has]) / (total - up + 1.0), 1e-6, 1 - 1e-6)
                odds = lambda p: np.log(p / (1 - p))
                sums.append(
                    np.log(max(total, 1e-9) / n) + np.log(1 - rate[own]).sum() + votes[:, own] @ odds(rate[own])
                    + np.log(1 - without).sum() + votes[:, has] @ odds(without) + above @ np.log((1 - with_it) / (1 - without)) + both @ (odds(with_it) - odds(without))
                )
            before, q = q, logistic(sums[0] - sums[1])
            if step > REBUILT[-1] and np.abs(q - before).max() < 1e-3:
                break
        turned = self.rates[1].sum() < self.rates[0].sum()
        self.rates = self.rates[::-1] if turned else self.rates
        self.posterior = 1 - q if turned else q


def distinct_columns(votes: np.ndarray) -> np.ndarray:
    """Places of voters that fire at all, one of those that fire in the very same rows: the others add nothing."""
    packed = np.ascontiguousarray(np.packbits(votes > 0, axis=0).T)
    first = {}
    for k, column in enumerate(packed):
        if column.any():
            first.setdefault(column.tobytes(), k)
    return np.array(sorted(first.values()), np.int64)


def fit(texts: list[str], y: np.ndarray) -> list[tuple[str, float]]:
    """(unit or pattern, weight) of the linear classifier, and its constant under an empty name.

    Labels suggest which units may vote; the label model sees the votes alone, and the classifier learns its posterior.
    """
    bags = [words(t) for t in texts]
    names = mined(bags, y)
    names += sorted(set(LEXICON) - set(names))
    place = {u: k for k, u in enumerate([*names, *PATTERNS])}
    known = [{u for u in place if u not in PATTERNS and not u.endswith("*")}, *({u[:-1] for u in place if u.endswith("*") and len(u) == k + 1} for k in (4, 5, 6))]
    rows = []
    for text, bag in zip(texts, bags):
        found = {place[u + end] for end, view, good in zip(("", "*", "*", "*"), views(bag), known) for u in view & good}
        rows.append(np.array(sorted(found | {place[p] for p, r in PATTERNS.items() if r.search(text)}), np.int64))
    votes = np.zeros((len(texts), len(place)), np.uint8)
    for i, at in enumerate(rows):
        votes[i, at] = 1
    target = LabelModel(votes[:, distinct_columns(votes)]).posterior
    model = Ftrl(len(place) + 1, alpha=0.3, l1=0.05)
    for _ in range(6):
        for at, t in zip(rows, target):
            model.learn(np.append(at, len(place)), np.ones(len(at) + 1), t)
    w = model.weights()
    return [(u, float(w[k])) for u, k in place.items() if w[k]] + [("", float(w[-1]))]


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", most_rows: int = MOST_ROWS) -> dict[str, float]:
    """The classifier: a weight for each voter, learnt from a bounded sample of labelled rows.

    Null labels and ids, and rows of the held-out fold, are not read; without labelled rows there is no weight.
    """
    return dict(fitted(labelled_sample(docs, labels, label, most_rows), fit))


class Scorer:
    def __init__(self, model: dict[str, float]):
        self.model, self.constant = model, model.get("", 0.0)
        self.patterns = [(r, model[p]) for p, r in PATTERNS.items() if model.get(p)]
        self.known: dict[str, tuple[str, ...]] = {}

    def score(self, text: str | None) -> float:
        text = text or ""
        if len(self.known) > CACHED_WORDS:
            self.known.clear()
        known, model, found = self.known, self.model, set()
        for w in set(text.lower().split()):
            hits = known.get(w)
            if hits is None:
                hits = known[w] = tuple(u for part in _WORD.findall(w) for u in units(part) if u in model)
            if hits:
                found.update(hits)
        total = self.constant + sum(model[u] for u in sorted(found)) + sum(v for r, v in self.patterns if r.search(text))
        return float(logistic(np.float64(total)))


def scored(docs: DataFrame, model: dict[str, float], threshold: float = 0.5) -> DataFrame:
    """doc_id, held_out, score, predicted of every row's whole text.

    A null or blank text has the constant's score; null ids and repeated rows are scored like any other,
    equal texts equally; a text of any length is read whole, and a voter counts once in it; a score equal
    to the threshold predicts 1; without labels every score is 0.5; an empty table gives an empty one;
    other columns are left out.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        scorer = Scorer(held.value)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([scorer.score(t.as_py()) for t in batch.column(1)], pa.float64())], names=["doc_id", "score"])

    found = pick(docs, doc_id="long", text="string").mapInArrow(run, "doc_id long, score double")
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def harmless(docs: DataFrame, model: dict[str, float], threshold: float = 0.5) -> DataFrame:
    """The rows of ``docs``, all columns, whose text scores below ``threshold``.

    Each row is judged by its own whole text, cast to a string; null and blank texts have the constant's
    score; null ids and repeated rows are judged like any other, a score equal to the threshold goes; an
    empty table gives an empty one; columns of any name and type pass through.
    """
    held, at = docs.sparkSession.sparkContext.broadcast(model), docs.columns.index("text")

    def run(batches):
        scorer = Scorer(held.value)
        for batch in batches:
            yield batch.filter(pa.array([scorer.score(t.as_py()) < threshold for t in batch.column(at).cast(pa.string())], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
