"""Language of a text, in two steps: its family, then its language within the family.

Languages are grouped into families by the likeness of their training centroids (average link,
about the square root of their number). One-versus-one linear support vector machines choose the
family; others, trained only on the family's languages, tell those apart. Features are byte
n-grams of the lower-cased letters, so spelling decides, not case, digits or marks.

The machines are fitted on a sample of labelled rows: at most `PER_LANGUAGE` rows, drawn by a hash of
doc_id and text, of each of the `LANGUAGES` most frequent languages (of equally frequent ones the first by name).
Prediction covers every row and its whole text.

Defined cases: null texts and texts without letters are `und` with score 0, as are all texts if
there is nothing to learn from. A single learned language is given to every text with letters.
Of equal votes and margins the language first by name wins. Repeated rows are each learned from and each
predicted alike. A very long text is one row of one task. Empty tables give empty results; other
columns are left behind.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leasebook.llm.common import map_rows
from leasebook.llm.linear import fold, gram_counts, logistic, part_of_one, svm, unit

PER_LANGUAGE = 400
LANGUAGES = 128
SIZE = 1 << 12
LONGEST = 4
UNDETERMINED = "und"
SHARPNESS = 3.0

_WORD = regex.compile(r"\p{L}+")


def features(text: str) -> np.ndarray | None:
    words = _WORD.findall(text.lower())
    return unit(gram_counts(f" {' '.join(words)} ".encode("utf-8", "replace"), LONGEST, SIZE)) if words else None


class Duels:
    """One machine for each pair of classes; the class with most wins, then with the largest margins, is chosen."""

    def __init__(self, x: np.ndarray, labels: np.ndarray, classes: list):
        self.classes, self.pairs = classes, list(combinations(range(len(classes)), 2))
        fits = []
        for i, j in self.pairs:
            rows = (labels == classes[i]) | (labels == classes[j])
            fits.append(svm(x[rows], np.where(labels[rows] == classes[i], 1.0, -1.0)))
        self.weights = np.array(fits, np.float32)

    def choose(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index of the class and a certainty between 0 and 1, per row."""
        if not self.pairs:
            return np.zeros(len(x), np.int64), np.ones(len(x))
        margins = x @ self.weights[:, :-1].T + self.weights[:, -1]
        wins, sums = np.zeros((len(x), len(self.classes))), np.zeros((len(x), len(self.classes)))
        closest = np.full((len(x), len(self.classes)), np.inf)
        for k, (i, j) in enumerate(self.pairs):
            for c, m in ((i, margins[:, k]), (j, -margins[:, k])):
                wins[:, c] += m > 0
                sums[:, c] += m
                closest[:, c] = np.minimum(closest[:, c], m)
        best = (wins + np.tanh(sums / len(self.pairs)) * 0.49).argmax(axis=1)
        return best, logistic(SHARPNESS * closest[np.arange(len(x)), best])


class LanguageModel:
    def __init__(self, x: np.ndarray, labels: np.ndarray):
        languages = sorted(set(labels.tolist()))
        self.families = families({lang: x[labels == lang].mean(axis=0) for lang in languages})
        of = {lang: k for k, members in enumerate(self.families) for lang in members}
        kinds = np.array([of[lang] for lang in labels])
        self.between = Duels(x, kinds, list(range(len(self.families))))
        self.within = [Duels(x[kinds == k], labels[kinds == k], members) for k, members in enumerate(self.families)]

    def predict(self, x: np.ndarray) -> tuple[list[str], np.ndarray]:
        family, sure = self.between.choose(x)
        names, scores = np.empty(len(x), object), sure.copy()
        for k, duels in enumerate(self.within):
            rows = np.flatnonzero(family == k)
            if len(rows):
                best, certain = duels.choose(x[rows])
                names[rows] = np.array(duels.classes, object)[best]
                scores[rows] *= certain
        return names.tolist(), scores


def families(centroids: dict[str, np.ndarray]) -> list[list[str]]:
    """Join the two likest groups of languages until about the square root of their number is left."""
    groups = [[lang] for lang in sorted(centroids)]
    scaled = {k: v / max(np.linalg.norm(v), 1e-12) for k, v in centroids.items()}
    while len(groups) > max(1, round(len(centroids) ** 0.5)):
        like = lambda p: np.mean([scaled[a] @ scaled[b] for a in groups[p[0]] for b in groups[p[1]]])
        i, j = max(combinations(range(len(groups)), 2), key=like)
        groups[i] = sorted(groups[i] + groups.pop(j))
    return groups


def fit(rows: DataFrame, per_language: int = PER_LANGUAGE, languages: int = LANGUAGES) -> LanguageModel | None:
    """Learn from (doc_id, text, lang); None if no row has a language and a letter.

    The broadcast counts have at most `languages` rows, so training texts are read where they lie.
    """
    known = rows.where("lang IS NOT NULL AND text IS NOT NULL").select("doc_id", "text", "lang")
    counts = known.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "lang").limit(languages)
    drawn = (
        known.withColumn("draw", part_of_one("doc_id", "text")).join(F.broadcast(counts), "lang")
        .where(F.col("draw") < F.lit(1.1 * per_language) / F.col("n")).select("draw", "lang", "text")
    )

    def prepare(batch: dict[str, list]) -> Iterator[tuple]:
        for draw, lang, text in zip(batch["draw"], batch["lang"], batch["text"]):
            x = features(text)
            if x is not None:
                yield draw, lang, x.tobytes()

    kept: dict[str, list] = {}
    for row in map_rows(drawn, prepare, "draw double, lang string, x binary", 64).toLocalIterator():
        kept.setdefault(row["lang"], []).append((row["draw"], bytes(row["x"])))
    sample = [(lang, x) for lang in sorted(kept) for _, x in sorted(kept[lang])[:per_language]]
    if not sample:
        return None
    x = np.frombuffer(b"".join(x for _, x in sample), np.float32).reshape(len(sample), SIZE)
    return LanguageModel(x, np.array([lang for lang, _ in sample], object))


def identify(docs: DataFrame, model: LanguageModel | None) -> DataFrame:
    """Per row of `docs`: doc_id, lang_pred, score."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def predict(batch: dict[str, list]) -> Iterator[tuple]:
        found = [features(t) if t is not None else None for t in batch["text"]]
        rows = [i for i, x in enumerate(found) if x is not None] if shared.value is not None else []
        names, scores = shared.value.predict(np.array([found[i] for i in rows])) if rows else ([], [])
        out = dict(zip(rows, zip(names, (float(s) for s in scores))))
        for i, doc_id in enumerate(batch["doc_id"]):
            yield doc_id, *out.get(i, (UNDETERMINED, 0.0))

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return map_rows(rows, predict, "doc_id long, lang_pred string, score double")


def learned_and_identified(docs: DataFrame, parts: int = 4, held: int = 2) -> DataFrame:
    """Learn on all folds but one, predict all rows; adds held_out."""
    model = fit(docs.where(fold("doc_id", parts) != held))
    return identify(docs, model).withColumn("held_out", fold("doc_id", parts) == held)
