"""Small linear models, trained with numpy on bounded samples, and hashed byte n-grams."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


def gram_counts(raw: bytes, longest: int, size: int) -> np.ndarray:
    """Counts of all byte n-grams of 1 to `longest` (at most 8) bytes, hashed to `size` places."""
    out = np.zeros(size)
    data = np.frombuffer(raw, np.uint8).astype(np.uint64)
    gram = np.zeros(len(data), np.uint64)
    for n in range(1, min(longest, len(data)) + 1):
        gram = (gram[: len(data) - n + 1] << np.uint64(8)) | data[n - 1:]
        place = ((gram + np.uint64(n)) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40)
        out += np.bincount((place % np.uint64(size)).astype(np.int64), minlength=size)
    return out


def unit(x: np.ndarray) -> np.ndarray:
    """Square roots of counts, scaled to length one."""
    x = np.sqrt(x)
    return (x / max(np.linalg.norm(x), 1e-12)).astype(np.float32)


def svm(x: np.ndarray, y: np.ndarray, cost: float = 10.0, turns: int = 30, seed: int = 7) -> np.ndarray:
    """Linear support vector machine (squared hinge loss) by dual coordinate descent; y is +1 or -1.

    The last weight is the intercept.
    """
    x = np.hstack([x, np.ones((len(x), 1), np.float32)])
    weight, alpha = np.zeros(x.shape[1]), np.zeros(len(x))
    diagonal = (x * x).sum(axis=1) + 0.5 / cost
    order = np.random.default_rng(seed)
    for _ in range(turns):
        for i in order.permutation(len(x)):
            gradient = y[i] * (x[i] @ weight) - 1 + alpha[i] * 0.5 / cost
            new = max(alpha[i] - gradient / diagonal[i], 0.0)
            if new != alpha[i]:
                weight += (new - alpha[i]) * y[i] * x[i]
                alpha[i] = new
    return weight.astype(np.float32)


def logistic(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def part_of_one(*columns: str) -> Column:
    """A number in [0, 1) from a hash of the columns: the same row always draws the same number."""
    return F.pmod(F.xxhash64(*columns), F.lit(1 << 30)) / F.lit(float(1 << 30))


def fold(doc_id: str, parts: int) -> Column:
    """crc32 of the id as text, modulo `parts`; a null id is in fold 1, so it is never held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % parts, F.lit(1))
