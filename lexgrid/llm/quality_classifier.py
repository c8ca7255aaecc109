"""Quality classifier by positive-unlabelled learning.

Trusted positives are the rows labelled 1, the unlabelled set is text without a label; labels of 0 are not used. A logistic
model over text statistics minimises the non-negative unbiased risk. The class prior is estimated from the same two sets: a
first model tells positives from unlabelled text, and among its thresholds the one of least upper confidence bound gives the
ratio of the shares above it, taken on halves that this model was not fitted on.

The fit sees a bounded sample: at most SAMPLE positives and SAMPLE unlabelled rows, those with the smallest seeded hashes
of their ids. Scoring covers all rows and whole texts, as one expression of built-in functions without a shuffle.

Defined cases: null and empty texts are scored as texts of zero counts; long texts are read whole. Rows of a null id are scored,
are not held out, and teach nothing. A doc_id with several labels counts once, with the smallest; one with several rows teaches
once, with the smallest features; repeated rows are scored alike. Without any positive row, or any unlabelled one, there is
nothing to learn and all scores are 0.5. An empty table gives no rows. Extra columns pass through; in `score` those named as a
result are replaced by it, `keep` leaves all as they are.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexgrid.llm.common import count_of, let, words

SAMPLE, STEPS, RATE, DECAY, SEED = 20_000, 600, 0.05, 1e-4, 11
THRESHOLD = 0.3
#: Chance that the bound of the prior fails, and the weight of its width.
DELTA, GAMMA = 0.1, 0.01

FEATURES = ("symbols", "stars", "pipes", "marks", "capitals", "digits", "stops", "commas", "spaces", "other", "log_words", "word_size", "distinct", "repeated_lines", "long_lines")


def features(text: Column) -> Column:
    """An array of len(FEATURES) doubles: shares of kinds of characters, word and line statistics."""
    t = F.coalesce(text, F.lit(""))

    def of(size: Column, w: Column, lines: Column) -> Column:
        share = lambda chars: count_of(t, chars) / size
        n = F.greatest(F.size(w), F.lit(1)).cast("double")
        m = F.size(lines).cast("double")
        return F.array(
            share("#$%&<>^~_=+@\\\\\\[\\]{}"), share("*"), share("|"), share("!?"), share("A-Z"), share("0-9"), share("."), share(",;:"), n / size, share("\\x00-\\x08\\x0E-\\x1F\\uFFFD"),
            F.log1p(F.size(w).cast("double")), F.length(F.array_join(w, "")) / n, F.size(F.array_distinct(w)) / n, 1 - F.size(F.array_distinct(lines)) / m, F.log1p(size / m),
        )

    return let(F.greatest(F.length(t), F.lit(1)).cast("double"), lambda size: let(words(t), lambda w: let(F.split(t, "\n"), lambda lines: of(size, w, lines))))


@dataclass(frozen=True)
class Model:
    """score = 1 / (1 + exp(-(bias + sum of weight * expand(feature))))."""

    mean: tuple[float, ...]
    scale: tuple[float, ...]
    weight: tuple[float, ...]
    bias: float
    prior: float

    def score(self, x: Column) -> Column:
        """Of an array of features: each enters as itself and, bounded, as its square root."""
        terms = F.lit(self.bias)
        k = len(FEATURES)
        for i in range(k):
            v = F.get(x, F.lit(i))
            terms = terms + F.lit(self.weight[i] / self.scale[i]) * (v - F.lit(self.mean[i]))
            terms = terms + F.lit(self.weight[k + i] / self.scale[k + i]) * (F.sqrt(F.abs(v)) - F.lit(self.mean[k + i]))
        return 1 / (1 + F.exp(-F.greatest(F.least(terms, F.lit(50.0)), F.lit(-50.0))))


def expand(x: np.ndarray) -> np.ndarray:
    return np.column_stack([x, np.sqrt(np.abs(x))])


def fit_arrays(positive: np.ndarray, unlabelled: np.ndarray, prior: float | None) -> Model:
    """Minimise prior * R+(positive) + max(0, R-(unlabelled) - prior * R-(positive)) with the logistic loss, by Adam.

    Where the bracket falls below zero, the step goes against it instead, as the non-negative estimator does. Without a prior
    the model just tells the two sets from each other.
    """
    p, u = expand(positive), expand(unlabelled)
    both = np.vstack([p, u])
    mean, scale = both.mean(0), both.std(0)
    scale[scale < 1e-9] = 1.0
    p, u = (p - mean) / scale, (u - mean) / scale
    w, b = np.zeros(p.shape[1]), 0.0
    m, v = np.zeros(len(w) + 1), np.zeros(len(w) + 1)
    sigmoid = lambda z: 1 / (1 + np.exp(-np.clip(z, -50, 50)))
    for step in range(1, STEPS + 1):
        fp, fu = sigmoid(p @ w + b), sigmoid(u @ w + b)
        # gradients by the margin: loss of label 1 is fp - 1, of label 0 is fp
        gp_pos, gp_neg, gu_neg = (fp - 1) / len(p), fp / len(p), fu / len(u)
        r_neg = 0.0 if prior is None else np.mean(-np.log(np.maximum(1 - fu, 1e-12))) - prior * np.mean(-np.log(np.maximum(1 - fp, 1e-12)))
        if prior is None:
            gw, gb = p.T @ gp_pos + u.T @ gu_neg, gp_pos.sum() + gu_neg.sum()
        elif r_neg >= 0:
            gw = prior * (p.T @ (gp_pos - gp_neg)) + u.T @ gu_neg
            gb = prior * (gp_pos - gp_neg).sum() + gu_neg.sum()
        else:
            gw = prior * (p.T @ gp_neg) - u.T @ gu_neg
            gb = prior * gp_neg.sum() - gu_neg.sum()
        g = np.append(gw + DECAY * w, gb)
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        move = RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        w, b = w - move[:-1], b - move[-1]
    return Model(tuple(map(float, mean)), tuple(map(float, scale)), tuple(map(float, w)), float(b), 0.5 if prior is None else prior)


def margins(model: Model, x: np.ndarray) -> np.ndarray:
    return (expand(x) - np.array(model.mean)) / np.array(model.scale) @ np.array(model.weight) + model.bias


def estimate_prior(positive: np.ndarray, unlabelled: np.ndarray) -> float:
    """The share of positives among the unlabelled rows: the ratio of the shares above the best threshold of a score.

    The score tells unlabelled rows from positives. Each half is judged by the model of the other.
    """
    scores = []
    for a, b in ((0, 1), (1, 0)):
        model = fit_arrays(positive[a::2], unlabelled[a::2], None) if len(positive) > 1 and len(unlabelled) > 1 else fit_arrays(positive, unlabelled, None)
        scores.append((margins(model, positive[b::2]), margins(model, unlabelled[b::2])))
    ratios = []
    for p, u in scores:
        if not len(p) or not len(u):
            continue
        cuts = np.unique(p)
        above_p = 1 - np.searchsorted(np.sort(p), cuts, side="left") / len(p)
        above_u = 1 - np.searchsorted(np.sort(u), cuts, side="left") / len(u)
        width = np.sqrt(np.log(4 / DELTA) / 2 / len(u)) + np.sqrt(np.log(4 / DELTA) / 2 / len(p))
        best = int(np.argmin(above_u / above_p + (1 + GAMMA) * width / above_p))
        ratios.append(above_u[best] / above_p[best])
    return float(np.clip(np.mean(ratios), 0.02, 0.98))


def held_out(key: Column) -> Column:
    return F.coalesce(F.crc32(key.cast("string")) % 5 == 0, F.lit(False))


def drawn(keys: DataFrame, key: str, sample: int) -> DataFrame:
    """The `sample` keys of least seeded hash, of distinct ones; most are put aside before any is sorted."""
    draw = F.xxhash64(F.lit(SEED), F.col(key))
    n = keys.count()
    if n > 4 * sample:  # the expected number below the bound is 2 * sample
        keys = keys.where(draw < F.lit(-(2**63) + 2**64 * 2 * sample // n))
    return keys.orderBy(draw, key).limit(sample)


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality", sample: int = SAMPLE) -> Model:
    """Learn from the positives among the labelled rows that aren't held out, and from rows without a label that aren't either."""
    k, known = F.col(f"`{key}`").alias("k"), labels.select(F.col(f"`{key}`").alias("k"), F.col(f"`{label}`").alias("y")).where("k IS NOT NULL")
    rows = docs.select(k, F.col(f"`{text}`").alias("text")).where("k IS NOT NULL")
    positive = known.where(~held_out(F.col("k")) & F.col("y").isNotNull()).groupBy("k").agg(F.min("y").alias("y")).where("y = 1").select("k")
    positive = positive.join(rows.select("k").distinct(), "k", "left_semi")
    unlabelled = rows.where(~held_out(F.col("k"))).select("k").distinct().join(known.select("k"), "k", "left_anti")
    role = drawn(positive, "k", sample).withColumn("y", F.lit(1)).unionByName(drawn(unlabelled, "k", sample).withColumn("y", F.lit(0)))
    found = rows.join(F.broadcast(role), "k").select("k", "y", features(F.col("text")).alias("x")).groupBy("k", "y").agg(F.min("x").alias("x"))
    got = found.select("y", "x").orderBy("k").toArrow()  # at most 2 * sample rows of numbers
    y = np.asarray(got.column("y"))
    x = np.asarray(got.column("x").combine_chunks().flatten(), dtype=float).reshape(len(y), len(FEATURES))
    positives, others = x[y == 1], x[y == 0]
    if not len(positives) or not len(others):
        return Model((0.0,) * 2 * len(FEATURES), (1.0,) * 2 * len(FEATURES), (0.0,) * 2 * len(FEATURES), 0.0, 0.5)
    return fit_arrays(positives, others, estimate_prior(positives, others))


def score_of(model: Model, text: str) -> Column:
    return let(features(F.col(f"`{text}`")), model.score)


def score(docs: DataFrame, model: Model, text: str = "text", key: str = "doc_id") -> DataFrame:
    """All columns of docs plus `held_out`, `score` and `predicted`."""
    added = {"held_out": held_out(F.col(f"`{key}`")), "score": score_of(model, text)}
    d = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c not in (*added, "predicted")], *[x.alias(n) for n, x in added.items()])
    return d.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def keep(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """The rows that the model predicts to be good, as they are."""
    return docs.where(score_of(model, text) >= THRESHOLD)
