"""Quality score by positive-unlabelled learning.

Trusted positives are documents labelled good; the unlabelled set is plain corpus text, good and
bad. The share of good text in it, the class prior, is estimated from first positive-versus-
unlabelled models: the smallest ratio of the two upper tails. There is one such model a fold, and
Spark counts every unlabelled row once, by the model of the fold that did not learn from it. The
scorer then minimises the
non-negative unbiased risk  prior * R+(positives) + max(0, R-(unlabelled) - prior * R-(positives))
with the sigmoid loss. Its margins become probabilities by a logistic curve fitted on labelled
training rows.

The gradients use about `POSITIVES`, `UNLABELLED` and `CHECKED` rows drawn by a hash; the
prior and the scores cover every row and its whole text. Only text enters a score.

Defined cases: null and empty texts get the score of the empty text. Without positives every text
scores 0.5. Without labelled bad rows the margin's own logistic value is the score. Of several
labels of a doc_id the lowest counts. Unlabelled rows are drawn by doc_id and text, so rows without an
id are not drawn all at once. Equal texts have equal scores. A very long text is one row of one task. Empty tables give empty results; `accepted`
keeps other columns, whatever their names.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leasebook.llm.common import map_rows
from leasebook.llm.linear import fold, gram_counts, logistic, part_of_one, unit

POSITIVES, UNLABELLED, CHECKED = 2500, 5000, 1500
FOLDS = 5
GRAMS = 1 << 10
LONGEST = 3
ACCEPT = 0.3
WIDEST = 5.0

_SHAPE = np.zeros(256, np.uint8)
for _b in range(256):
    _c = chr(_b)
    _SHAPE[_b] = 0 if _b >= 128 or _c.islower() else 1 if _c.isupper() else 2 if _c.isdigit() else 3 if _c.isspace() else 4


def measures(raw: bytes) -> list[float]:
    """Shape of a text: lengths, kinds of characters, repetition of words and lines."""
    shape = np.bincount(_SHAPE[np.frombuffer(raw, np.uint8)], minlength=5) / max(len(raw), 1)
    words = raw.split()
    lines = [x for x in raw.split(b"\n") if x.strip()]
    n, m = max(len(words), 1), max(len(lines), 1)
    counts = Counter(words)
    top = [c for _, c in counts.most_common(3)] + [0, 0, 0]
    same = sum(a == b for a, b in zip(words, words[1:])) / n
    marked = sum(not w[-1:].isalnum() and w[-1] < 128 for w in words) / n
    sentence = sum(x.rstrip()[-1:] in (b".", b"!", b"?") for x in lines) / m
    return [
        *shape, np.log1p(len(raw)) / 10, np.log1p(len(words)) / 10, len(raw) / n / 20, len(counts) / n, top[0] / n, sum(top[:3]) / n,
        same, marked, len(set(lines)) / m, np.log1p(len(raw) / m) / 10, sentence, sum(len(w) == 1 for w in words) / n,
        sum(w.isupper() for w in words) / n, sum(len(w) > 20 for w in words) / n, min(len(words), 5) / 5,
    ]


def features(raw: bytes) -> np.ndarray:
    shape = np.array(measures(raw), np.float32)
    return np.concatenate([shape, shape * shape, unit(gram_counts(raw, LONGEST, GRAMS))])


@dataclass
class QualityModel:
    centre: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    prior: float
    slope: float = 1.0
    shift: float = 0.0

    def margins(self, x: np.ndarray) -> np.ndarray:
        return scaled(x, self.centre, self.scale) @ self.weights

    def scores(self, x: np.ndarray) -> np.ndarray:
        return logistic(self.slope * self.margins(x) + self.shift)


def scaled(x: np.ndarray, centre: np.ndarray, scale: np.ndarray) -> np.ndarray:
    """Standardised and held within `WIDEST`; the many n-grams count a tenth of a measure; a last column of ones."""
    x = np.clip((x - centre) / scale, -WIDEST, WIDEST)
    x[:, -GRAMS:] /= 10
    return np.hstack([x, np.ones((len(x), 1))]).astype(np.float32)


def _descend(gradient, size: int, rows: int, turns: int, batch: int = 1024, rate: float = 0.01, seed: int = 11) -> np.ndarray:
    """Adam over shuffled batches of row numbers."""
    weights, mean, square, step = np.zeros(size), np.zeros(size), np.zeros(size), 0
    order = np.random.default_rng(seed)
    for _ in range(turns):
        shuffled = order.permutation(rows)
        for at in range(0, rows, batch):
            g = gradient(weights, shuffled[at: at + batch])
            step += 1
            mean, square = 0.9 * mean + 0.1 * g, 0.999 * square + 0.001 * g * g
            weights = weights - rate * (mean / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.999**step)) + 1e-8)
    return weights


def thresholds(positive: np.ndarray) -> np.ndarray:
    return np.quantile(positive, np.linspace(0.02, 0.98, 49))


def class_prior(positive: list[np.ndarray], above: np.ndarray, rows: int) -> float:
    """Share of positives in unlabelled rows, from the margins of rows not trained on.

    `positive` has the margins of each fold; `above` counts the unlabelled rows, of `rows`, that reach
    each of their fold's thresholds. At every one the unlabelled upper tail is at least prior
    times the positives' one; the smallest ratio, with a margin for the numbers of rows, is the estimate.
    """
    n = sum(len(p) for p in positive)
    tail_p = sum((p[:, None] >= thresholds(p)).sum(axis=0) for p in positive) / n
    tail_u = above / rows
    slack = np.sqrt(np.log(100) / (2 * rows)) + np.sqrt(np.log(100) / (2 * n))
    best = ((tail_u + slack) / tail_p).argmin()
    return float(np.clip(tail_u[best] / tail_p[best], 0.05, 0.98))


Tails = Callable[[list[QualityModel], list[np.ndarray]], tuple[np.ndarray, int]]


def train(positive: np.ndarray, unlabelled: np.ndarray, folds: np.ndarray, tails: Tails, turns: int = 40, penalty: float = 1e-2) -> QualityModel:
    """`folds` are those of the unlabelled rows; `tails` counts all rows of the corpus that reach each threshold
    by the model of their fold, and the rows themselves."""
    x = np.vstack([positive, unlabelled])
    centre, scale = x.mean(axis=0), x.std(axis=0) + 1e-3
    x = scaled(x, centre, scale)
    is_p = np.arange(len(x)) < len(positive)
    place = np.concatenate([np.arange(len(positive)) % FOLDS, folds])

    def first(k: int) -> QualityModel:
        learn = np.flatnonzero(place != k)

        def apart(w, rows):  # positive against unlabelled, logistic loss, both sides of equal weight
            rows = learn[rows]
            y = is_p[rows]
            weight = np.where(y, 0.5 / max(y.sum(), 1), 0.5 / max((~y).sum(), 1))
            return x[rows].T @ ((logistic(x[rows] @ w) - y) * weight) + 1e-3 * w

        return QualityModel(centre, scale, _descend(apart, x.shape[1], len(learn), 15), 0.0)

    firsts = [first(k) for k in range(FOLDS)]
    # A fold without positives takes all of them.
    held = [x[is_p & (place == k)] if (is_p & (place == k)).any() else x[is_p] for k in range(FOLDS)]
    margins = [h @ m.weights for h, m in zip(held, firsts)]
    prior = class_prior(margins, *tails(firsts, [thresholds(m) for m in margins]))

    def risk(w, rows):
        p, u = x[rows[is_p[rows]]], x[rows[~is_p[rows]]]
        if not len(p) or not len(u):
            return np.zeros_like(w)
        at_p, at_u = logistic(p @ w), logistic(u @ w)  # loss of a row as negative; as positive it is one minus this
        slope_p, slope_u = p.T @ (at_p * (1 - at_p)) / len(p), u.T @ (at_u * (1 - at_u)) / len(u)
        rest = slope_u - prior * slope_p
        if at_u.mean() - prior * at_p.mean() < 0:
            return -rest + penalty * w  # the negative risk fell under zero: step back
        return -prior * slope_p + rest + penalty * w

    return QualityModel(centre, scale, _descend(risk, x.shape[1], len(x), turns), prior)


def calibrate(model: QualityModel, good: np.ndarray, bad: np.ndarray) -> None:
    """Logistic curve over the margins of labelled rows (Newton steps, smoothed targets)."""
    if not len(bad) or not len(good):
        return
    m = np.concatenate([model.margins(good), model.margins(bad)])
    spread = max(m.std(), 1e-6)
    design = np.column_stack([m / spread, np.ones(len(m))])
    target = np.concatenate([np.full(len(good), (len(good) + 1) / (len(good) + 2)), np.full(len(bad), 1 / (len(bad) + 2))])
    w = np.zeros(2)
    for _ in range(50):
        p = logistic(design @ w)
        curve = design.T @ (design * (p * (1 - p))[:, None]) + 1e-3 * np.eye(2)
        w -= np.linalg.solve(curve, design.T @ (p - target) + 1e-3 * w)
    model.slope, model.shift = float(w[0] / spread), float(w[1])


def fit(docs: DataFrame, labels: DataFrame) -> QualityModel | None:
    """Learn from `docs` (doc_id, text) and `labels` (doc_id, quality); None without positives."""
    marked = labels.where("quality IS NOT NULL AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    counts = {r["quality"]: r["n"] for r in marked.groupBy("quality").agg(F.count(F.lit(1)).alias("n")).collect()}  # 0 and 1
    total = docs.count()
    want = {1: POSITIVES + CHECKED, 0: CHECKED}
    share = F.when(F.col("quality") == 1, want[1] / max(counts.get(1, 0), 1)).otherwise(want[0] / max(counts.get(0, 0), 1))
    chosen = marked.where(part_of_one("doc_id") < share)  # about `want` rows, whatever the labels' number
    source = docs.select(F.col("doc_id").alias("doc_id"), F.col("text").cast("binary").alias("raw"))
    in_fold = F.pmod(F.xxhash64("raw", "doc_id"), F.lit(FOLDS)).cast("int")
    plain = source.where(part_of_one("doc_id", "raw") < UNLABELLED / max(total, 1))

    def tails(firsts: list[QualityModel], cuts: list[np.ndarray]) -> tuple[np.ndarray, int]:
        shared = docs.sparkSession.sparkContext.broadcast(firsts)

        def reached(batch: dict[str, list]) -> Iterator[tuple]:
            found = np.zeros(len(cuts[0]) + 1, np.int64)
            fold_of = np.array(batch["fold"])
            x = np.array([features(raw or b"") for raw in batch["raw"]])
            for k in np.unique(fold_of):
                at = np.searchsorted(cuts[k], shared.value[k].margins(x[fold_of == k]), "right")
                found += np.bincount(at, minlength=len(found))
            yield from ((at, int(n)) for at, n in enumerate(found) if n)

        counts = map_rows(source.select("raw", in_fold.alias("fold")), reached, "reached int, n long").groupBy("reached").agg(F.sum("n").alias("n"))
        numbers = np.zeros(len(cuts[0]) + 1)
        for row in counts.collect():  # one row a threshold
            numbers[row["reached"]] = row["n"]
        return numbers[::-1].cumsum()[::-1][1:], max(int(numbers.sum()), 1)

    def prepare(batch: dict[str, list]) -> Iterator[tuple]:
        for kind, raw in zip(batch["kind"], batch["raw"]):
            yield kind, features(raw or b"").tobytes()

    drawn = (
        source.join(F.broadcast(chosen), "doc_id").select(F.col("quality").cast("int").alias("kind"), "raw")
        .unionByName(plain.select((F.lit(2) + in_fold).alias("kind"), "raw"))
    )
    rows = [(r["kind"], bytes(r["x"])) for r in map_rows(drawn, prepare, "kind int, x binary", 64).toLocalIterator()]
    rows.sort()
    by = {k: np.frombuffer(b"".join(x for kind, x in rows if kind == k), np.float32).reshape(-1, len(features(b""))) for k in range(2 + FOLDS)}
    unlabelled = np.vstack([by[2 + k] for k in range(FOLDS)])
    if not len(by[1]) or not len(unlabelled):
        return None
    folds = np.repeat(np.arange(FOLDS), [len(by[2 + k]) for k in range(FOLDS)])
    order = np.random.default_rng(3).permutation(len(by[1]))
    cut = max(1, len(order) * POSITIVES // want[1])
    model = train(by[1][order[:cut]], unlabelled, folds, tails)
    calibrate(model, by[1][order[cut:]], by[0])
    return model


def score(docs: DataFrame, model: QualityModel | None) -> DataFrame:
    """Per row of `docs`: doc_id, id, th, score."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def rate(batch: dict[str, list]) -> Iterator[tuple]:
        if batch["raw"]:
            known = shared.value
            values = known.scores(np.array([features(x or b"") for x in batch["raw"]])) if known else [0.5] * len(batch["raw"])
            yield from zip(batch["doc_id"], (float(v) for v in values))

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("raw"))
    return map_rows(rows, rate, "doc_id long, score double")


def learned_and_scored(docs: DataFrame, labels: DataFrame, parts: int = 5, held: int = 0) -> DataFrame:
    """Learn on all folds but one, score all rows; adds held_out and predicted."""
    model = fit(docs.where(fold("doc_id", parts) != held), labels.where(fold("doc_id", parts) != held))
    return score(docs, model).select(
        "doc_id", (fold("doc_id", parts) == held).alias("held_out"), "score", (F.col("score") >= ACCEPT).cast("int").alias("predicted"))


def accepted(docs: DataFrame, labels: DataFrame, parts: int = 5, held: int = 0) -> DataFrame:
    """`docs` without the rows whose score is under `ACCEPT`; columns as they are.

    The score is added to each row in one pass, so rows need no key and repeated rows all stay.
    """
    model = fit(docs.where(fold("doc_id", parts) != held), labels.where(fold("doc_id", parts) != held))
    if model is None:
        return docs
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def rate(raw: pd.Series) -> pd.Series:
        out = np.empty(len(raw))
        for at in range(0, len(raw), 256):
            out[at: at + 256] = shared.value.scores(np.array([features(x or b"") for x in raw.iloc[at: at + 256]]))
        return pd.Series(out)

    return docs.where(rate(F.col("text").cast("binary")) >= ACCEPT)
