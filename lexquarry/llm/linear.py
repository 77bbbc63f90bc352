"""Logistic regression on hashed features, fitted on the driver from a bounded sample."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BITS = 18


def bounded_sample(df: DataFrame, key: str, most: int) -> DataFrame:
    """About ``most`` rows of ``df``, the same on every run: those with the least hashes of ``key``.

    Only for fitting; nothing is scored or counted on it. ``df`` is counted first.
    """
    total = df.count()
    if total <= most:
        return df
    return df.where(F.pmod(F.xxhash64(F.col(key).cast("string")), F.lit(1_000_000)) < int(1_000_000 * most / total))


def hashed(names: Sequence[str], bits: int = BITS) -> np.ndarray:
    """The distinct places of some feature names."""
    mask = (1 << bits) - 1
    return np.array(sorted({zlib.crc32(n.encode("utf-8", "surrogatepass")) & mask for n in names}), np.int64)


class Rows:
    """Sparse binary rows: the places of row i are flat[at[i]:at[i + 1]]."""

    def __init__(self, rows: Sequence[np.ndarray]):
        self.at = np.concatenate([[0], np.cumsum([len(r) for r in rows])]).astype(np.int64)
        self.flat = np.concatenate(rows) if len(rows) else np.zeros(0, np.int64)

    def __len__(self) -> int:
        return len(self.at) - 1

    def take(self, pick: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(places, row numbers within pick) of the rows in pick."""
        size = self.at[pick + 1] - self.at[pick]
        owner = np.repeat(np.arange(len(pick)), size)
        inside = np.arange(len(owner)) - np.repeat(np.cumsum(size) - size, size)
        return self.flat[np.repeat(self.at[pick], size) + inside], owner

    def scores(self, w: np.ndarray, b: float) -> np.ndarray:
        part = np.concatenate([[0.0], np.cumsum(w[self.flat])])
        return part[self.at[1:]] - part[self.at[:-1]] + b


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -35, 35)))


class Logistic:
    """Weights and bias. ``fit`` minimises the weighted log loss plus ``l2`` per weight and, for
    pairs of rows that differ only in what must not matter, ``tie`` times the squared difference of
    their scores (the counterfactual penalty)."""

    def __init__(self, bits: int = BITS):
        self.bits = bits
        self.w = np.zeros(1 << bits)
        self.b = 0.0

    def fit(
        self, rows: Rows, y: np.ndarray, weight: np.ndarray, epochs: int = 6, rate: float = 0.3, l2: float = 1e-6,
        pairs: tuple[Rows, Rows] | None = None, tie: float = 0.0, batch: int = 256, seed: int = 7,
    ) -> Logistic:
        rng = np.random.default_rng(seed)
        square, square_b = np.full(len(self.w), 1e-8), 1e-8

        def step(places: np.ndarray, gradient: np.ndarray, bias: float) -> None:
            nonlocal square_b
            at, back = np.unique(places, return_inverse=True)
            g = np.bincount(back, gradient) + l2 * self.w[at]
            square[at] += g * g
            self.w[at] -= rate * g / np.sqrt(square[at])
            square_b += bias * bias
            self.b -= rate * bias / np.sqrt(square_b)

        for _ in range(epochs):
            order = rng.permutation(len(rows))
            for i in range(0, len(order), batch):
                pick = order[i : i + batch]
                places, owner = rows.take(pick)
                z = np.bincount(owner, self.w[places], minlength=len(pick)) + self.b
                error = weight[pick] * (sigmoid(z) - y[pick]) / len(pick)
                step(places, error[owner], float(error.sum()))
                if pairs is not None and tie and len(pairs[0]):
                    pick = rng.integers(0, len(pairs[0]), min(batch, len(pairs[0])))
                    (pa_, oa), (pb, ob) = pairs[0].take(pick), pairs[1].take(pick)
                    n = len(pick)
                    gap = np.bincount(oa, self.w[pa_], minlength=n) - np.bincount(ob, self.w[pb], minlength=n)
                    g = tie * np.clip(gap, -2, 2) / n
                    step(np.concatenate([pa_, pb]), np.concatenate([g[oa], -g[ob]]), 0.0)
        return self

    def score(self, names: Sequence[str]) -> float:
        return float(self.w[hashed(names, self.bits)].sum() + self.b)


Features = Callable[[str], Sequence[str]]
