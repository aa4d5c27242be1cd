"""Weak supervision for toxicity: many lexicon and pattern voters, a generative label model of their accuracies and correlations, and a linear
classifier trained on the model's posterior labels."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfwave.llm.common import map_texts

WORD = re.compile(r"\w{3,}")
#: Voters that need no labels: general insults, and forms of address that attack.
SEEDS = ("disgusting", "filth", "idiot", "idiots", "imbecile", "loser", "losers", "moron", "pathetic", "scum", "stupid", "trash", "vermin", "worthless")
ATTACK = re.compile(r"\b(?:shut up|go to hell|hate (?:you|them|these)|you(?: are|'re) (?:a |an |so |such )?(?:an? )?(?:stupid|dumb|pathetic|worthless|disgusting))\b")


@dataclass(frozen=True)
class Plan:
    """Bounds and choices of a fit."""

    sample: int = 16_000  # most labelled rows it learns from, those of the least key hash
    voters: int = 1200  # most induced voters
    least: int = 6  # toxic rows of the sample a voter occurs in
    lift: float = 6.0  # times as often in toxic rows as in others
    evidence: float = 25.0  # toxic rows times the logarithm of that ratio
    heads: tuple[int, ...] = (4, 5, 6)  # lengths of word beginnings that are tried as patterns
    human: float = 0.97  # taken accuracy of a given label, itself a voter


def tokens(text: str) -> set[str]:
    return set(WORD.findall(text.lower()))


def signs(text: str, heads: tuple[int, ...]) -> set[str]:
    """What a text may be voted on by: its words, and the beginnings of longer words (with a star)."""
    words = tokens(text)
    found = set(words)
    for k in heads:
        found.update(w[:k] + "*" for w in words if len(w) > k)
    return found


@dataclass(frozen=True)
class Model:
    words: dict[str, int]
    stems: dict[int, dict[str, int]]
    weights: np.ndarray
    bias: float
    accuracies: list[tuple[str, float, float, float]] = field(default_factory=list)  # voter, rate in toxic, rate in others, share it counts for

    def votes(self, text: str) -> list[int]:
        """Numbers of the voters that fire; the last one is the attack pattern."""
        words = tokens(text)
        hit = {self.words[w] for w in self.words.keys() & words}
        for k, stems in self.stems.items():
            hit.update(stems[s] for s in stems.keys() & {w[:k] for w in words if len(w) > k})
        if ATTACK.search(text.lower()):
            hit.add(len(self.weights) - 1)
        return sorted(hit)

    def score(self, text: str) -> float:
        z = self.bias + sum(self.weights[v] for v in self.votes(text))
        return float(1 / (1 + np.exp(-np.clip(z, -40, 40))))


def sample_rows(docs: DataFrame, labels: DataFrame, plan: Plan, key: str, label: str, text: str) -> DataFrame:
    """(text, toxic) of at most plan.sample labelled rows; the sample's ids have that bound, so they are broadcast and texts are not moved."""
    picked = (labels.where(F.col(key).isNotNull() & F.col(label).isin(0, 1)).groupBy(F.col(key).alias("__key")).agg(F.max(label).alias("toxic"))
              .orderBy(F.xxhash64("__key"), "__key").limit(plan.sample))
    return docs.select(F.col(key).alias("__key"), F.coalesce(F.col(text), F.lit("")).alias("text")).join(F.broadcast(picked), "__key").select("text", F.col("toxic").cast("int").alias("toxic"))


def induced(rows: DataFrame, plan: Plan) -> list[str]:
    """Words and stems that occur in toxic rows far more often than in others, strongest first; counted by task and summed."""
    heads = plan.heads

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = (Counter(), Counter())
        for batch in batches:
            for t, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                seen[y].update(signs(t, heads))
                seen[y][""] += 1  # the number of rows
        keys = list(seen[0].keys() | seen[1].keys())
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array([seen[1][k] for k in keys], pa.int64()), pa.array([seen[0][k] for k in keys], pa.int64())], ["sign", "bad", "good"])

    sums = rows.mapInArrow(count, "sign string, bad bigint, good bigint").groupBy("sign").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good"))
    # the row of the empty sign holds the totals and comes first
    best = sums.where(f"sign = '' or bad >= {plan.least}")
    got = best.select("sign", "bad", "good", (F.col("bad") / (F.col("good") + 1.0)).alias("odds")).orderBy(F.col("sign") != "", F.desc("odds"), F.desc("bad"), "sign").limit(4 * plan.voters + 1).collect()
    if not got or got[0]["sign"] != "" or not got[0]["bad"]:
        return []
    bad, good = got[0]["bad"], got[0]["good"]
    strong = [(r["bad"] * np.log(((r["bad"] + .5) / (bad + 1)) / ((r["good"] + .5) / (good + 1))), r["sign"]) for r in got[1:]
              if (r["bad"] + .5) / (bad + 1) >= plan.lift * (r["good"] + .5) / (good + 1)]
    return [s for _, s in sorted((x for x in strong if x[0] >= plan.evidence), key=lambda x: (-x[0], x[1]))[:plan.voters]]


def label_model(votes: np.ndarray, given: np.ndarray, count: np.ndarray, human: float, rounds: int = 15) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Posterior P(toxic) of each row, rates of each voter in toxic and other rows, and the share each voter counts for.

    A Bernoulli mixture fitted by expectation maximisation from the given labels, which stay one voter of accuracy `human`. Voters that fire together
    beyond what the class explains share one vote: each counts 1 / (1 + sum of its positive residual correlations)."""
    q = np.where(given > 0, human, 1 - human)
    share = np.ones(votes.shape[1])
    for k in range(rounds):
        a, b = count @ q, count @ (1 - q)
        one, zero = ((count * q) @ votes + .1) / (a + 2), ((count * (1 - q)) @ votes + .1) / (b + 2)
        prior = np.clip(a / (a + b), 1e-3, 1 - 1e-3)
        if k == 1:
            rest = votes - np.outer(q, one) - np.outer(1 - q, zero)
            cov = (rest * count[:, None]).T @ rest / count.sum()
            sd = np.sqrt(np.maximum(np.diag(cov), 1e-9))
            rho = cov / np.outer(sd, sd)
            np.fill_diagonal(rho, 0)
            share = 1 / (1 + np.where(rho > .1, rho, 0).sum(axis=1))
        fire, quiet = np.log(one / zero), np.log((1 - one) / (1 - zero))
        z = np.log(prior / (1 - prior)) + votes @ (share * (fire - quiet)) + (share * quiet).sum() + np.where(given > 0, 1, -1) * np.log(human / (1 - human))
        q = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
    return q, one, zero, share


def linear(votes: np.ndarray, target: np.ndarray, count: np.ndarray, ridge: float = 1.0, rounds: int = 12) -> tuple[np.ndarray, float]:
    """Logistic regression on soft labels by Newton steps; rows stand for `count` equal ones."""
    x = np.hstack([votes, np.ones((len(votes), 1))])
    penalty = np.full(x.shape[1], ridge)
    penalty[-1] = 1e-6
    w = np.zeros(x.shape[1])
    p = np.clip(np.average(target, weights=count), 1e-3, 1 - 1e-3)
    w[-1] = np.log(p / (1 - p))
    for _ in range(rounds):
        q = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (count * (q - target)) + penalty * w
        curve = (x * (count * np.maximum(q * (1 - q), 1e-4))[:, None]).T @ x + np.diag(penalty)
        step = np.linalg.solve(curve, slope)
        w -= step * min(1.0, 5 / max(np.abs(step).max(), 1e-9))
    return w[:-1], float(w[-1])


def fit(docs: DataFrame, labels: DataFrame, plan: Plan = Plan(), key: str = "doc_id", label: str = "toxic", text: str = "text") -> Model:
    """The model from at most plan.sample labelled rows of `docs`. With no toxic label among them the seed voters stand with taken rates."""
    rows = sample_rows(docs, labels, plan, key, label, text)
    signs_ = induced(rows, plan)
    names = [*dict.fromkeys([*SEEDS, *signs_])]
    words = {s: k for k, s in enumerate(names) if not s.endswith("*")}
    stems: dict[int, dict[str, int]] = {}
    for k, s in enumerate(names):
        if s.endswith("*"):
            stems.setdefault(len(s) - 1, {})[s[:-1]] = k
    blank = Model(words, stems, np.zeros(len(names) + 1), 0.0)

    def vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(list(map(blank.votes, batch.column(0).to_pylist())), pa.list_(pa.int32())), batch.column(1)], ["votes", "toxic"])

    # rows of equal votes are one row; at most plan.sample
    got = rows.mapInArrow(vote, "votes array<int>, toxic int").groupBy("votes", "toxic").agg(F.count("*").alias("times")).orderBy("toxic", F.col("votes").cast("string")).collect() if signs_ else []
    if not got:
        return Model(words, stems, np.append(np.where([n in SEEDS for n in names], 4.0, 0.0), 4.0), -3.0)
    votes, given, times = np.zeros((len(got), len(names) + 1)), np.array([r["toxic"] for r in got]), np.array([r["times"] for r in got], float)
    for k, r in enumerate(got):
        votes[k, r["votes"]] = 1
    posterior, one, zero, share = label_model(votes, given, times, plan.human)
    w, b = linear(votes, posterior, times)
    return Model(words, stems, w, b, list(zip([*names, "(attack)"], one.tolist(), zero.tolist(), share.tolist(), strict=True)))


def toxicity(docs: DataFrame, model: Model, threshold: float = 0.3, text: str = "text", keep=None) -> DataFrame:
    """Adds score (0 to 1) and predicted (1 from `threshold` on) to every row, from its whole text alone; the model holds at most some thousand
    voters. Null or empty text gets the score of no votes. Repeated rows get equal scores."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def score(texts: list[str]) -> dict:
        got = list(map(shared.value.score, texts))
        return {"score": got, "predicted": pa.array([int(s >= threshold) for s in got], pa.int32())}

    return map_texts(docs, score, "score double, predicted int", text, keep)


def held_out(key: str = "doc_id"):
    """A fixed quarter of the keys, on which no label is learned."""
    return F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")) % 4 == 2
