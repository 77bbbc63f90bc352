"""String similarities as vectorised functions, 0 to 100."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import DoubleType


def lcs_length(a: str, b: str) -> int:
    """Length of the longest common subsequence, bit-parallel."""
    if not a or not b:
        return 0
    masks: dict[str, int] = {}
    for i, c in enumerate(a):
        masks[c] = masks.get(c, 0) | 1 << i
    full = (1 << len(a)) - 1
    s = full
    for c in b:
        u = s & masks.get(c, 0)
        s = (s + u | s - u) & full
    return len(a) - s.bit_count()


def ratio(a: str, b: str) -> float:
    return 100.0 * 2 * lcs_length(a, b) / (len(a) + len(b)) if a or b else 100.0


def stretch_starts(a: str, b: str) -> np.ndarray:
    """For each k from 1 to the length of ``b`` the number c such that the longest common subsequence of ``a``
    and ``b[x:y]`` is as long as there are k in x < k <= y with c <= x.

    One table serves all stretches of ``b``; it is filled along its diagonals, whose cells do not depend on
    each other.
    """
    n, m = len(a), len(b)
    rows, columns = (np.frombuffer(x.encode("utf-32-le", "surrogatepass"), np.uint32) for x in (a[::-1], b))
    kind = np.int16 if m < 32000 else np.int32
    left = np.zeros(n, kind)  # of the row whose letter stands there in ``rows``
    above = np.arange(1, m + 1, dtype=kind)
    for d in range(n + m - 1):  # row i, column j with i + j = d; rows are stored backwards
        i, j = min(d, n - 1), max(0, d - n + 1)
        count = min(i, m - 1 - j) + 1
        r = n - 1 - i
        u, v = left[r : r + count], above[j : j + count]
        same = rows[r : r + count] == columns[j : j + count]
        low, high = np.minimum(u, v), np.maximum(u, v)
        np.copyto(high, u, where=same)
        np.copyto(low, v, where=same)
        left[r : r + count], above[j : j + count] = low, high
    return above.astype(np.int64)


def _covered(first: np.ndarray) -> np.ndarray:
    """For x from 0, the number of k (from 1) with first[k - 1] <= x < k; first[k - 1] is at most k."""
    m = len(first)
    return np.cumsum(np.bincount(first, minlength=m + 1)[:m] - (np.arange(m) > 0))


def window_scores(short: str, long: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ratios of ``short`` with stretches of ``long``, which is not shorter: with each of its length by start,
    with each shorter one at the front by length, and with each shorter one at the back by start."""
    n, m = len(short), len(long)
    c = stretch_starts(short, long)
    k = np.arange(1, m + 1)
    whole = 200.0 * _covered(np.maximum(c, k - n))[: m - n + 1] / (2 * n)
    front = 200.0 * np.cumsum(c == 0)[: n - 1] / (n + k[: n - 1])
    back = 200.0 * _covered(c)[m - n + 1 :] / (n + k[: n - 1][::-1])
    return whole, front, back


def _grams(text: str, size: int) -> np.ndarray:
    """A hash of the ``size`` letters at each place; equal letters have equal hashes."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    out = np.zeros(max(len(codes) - size + 1, 0), np.uint64)
    for k in range(size):
        out = out * np.uint64(0x9E3779B97F4A7C15) + codes[k : k + len(out)]
    return out


def possible_windows(short: str, long: str, least: float) -> np.ndarray:
    """Whether each window of ``long``, as long as ``short``, can have a partial ratio of ``least`` with it.

    A stretch of k letters that has L in common with the n of ``short`` needs 2L >= r(n + k), so that a share of
    (2 - 2r) / (2 - r) of ``short`` is missing at most where nothing is put in. A letter that is missing breaks q runs of
    q letters, one that is put in q - 1; for small q the first is the worst case. All other runs stand in the window.
    """
    n, m, r = len(short), len(long), least / 100
    possible = np.ones(m - n + 1, bool)
    for q in (3, 4):
        need = int(np.ceil(n - q + 1 - q * n * (2 - 2 * r) / (2 - r) - 1e-9))
        if need > 0 and q * (1 - r) < 1 - r / 2:
            met = np.concatenate([[0], np.cumsum(np.isin(_grams(long, q), _grams(short, q)))])
            possible &= met[n - q + 1 :][: m - n + 1] - met[: m - n + 1] >= need
    return possible


def best_window(short: str, long: str, least: float) -> int | None:
    """Start of the window of ``long``, as long as ``short``, of the highest partial ratio with it, of at least ``least``.

    Of equal ones the window that has more of ``short`` as a whole counts, then the first. Only stretches of
    possible windows are compared; in them all windows are bounded by their longest common subsequence, and
    those that can reach the best are scored.
    """
    n = len(short)
    sizes = np.arange(1, n + 1)
    edges = np.flatnonzero(np.diff(np.concatenate([[False], possible_windows(short, long, least), [False]]).astype(np.int8)))
    best = (least, -1, 0)
    for first, last in edges.reshape(-1, 2).tolist():
        stretch = long[first : last - 1 + n]
        m = len(stretch)
        c = stretch_starts(short, stretch)
        common = _covered(np.maximum(c, np.arange(1, m + 1) - n))[: m - n + 1]
        bound = 200.0 * common / (n + common)
        for x in np.argsort(-bound, kind="stable").tolist():
            if bound[x] < best[0]:
                break
            inside = np.maximum(c[x : x + n] - x, 0)
            front = 200.0 * np.cumsum(inside == 0) / (n + sizes)
            back = 200.0 * _covered(inside) / (n + sizes[::-1])
            best = max(best, (float(max(front.max(), back.max())), int(common[x]), -x - first))
    return -best[2] if best[1] >= 0 else None


def partial_ratio(a: str, b: str) -> float:
    """The best ratio of the shorter string with a stretch of the longer one, stretches at its ends may be shorter."""
    short, long = (a, b) if len(a) <= len(b) else (b, a)
    if not short:
        return 100.0 if not long else 0.0
    if short in long:
        return 100.0
    return float(max(x.max(initial=0.0) for x in window_scores(short, long)))


def token_set_ratio(a: str, b: str) -> float:
    x, y = set(a.split()), set(b.split())
    if not x or not y:
        return 0.0
    both, left, right = (" ".join(sorted(s)) for s in (x & y, x - y, y - x))
    if both and (not left or not right):
        return 100.0
    one, two = f"{both} {left}".strip(), f"{both} {right}".strip()
    scores = [ratio(one, two)]
    if both:
        scores += [ratio(both, one), ratio(both, two)]
    return max(scores)


def _pairwise(f):
    @pandas_udf(DoubleType())
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([None if x is None or y is None else f(x, y) for x, y in zip(a.tolist(), b.tolist())], dtype="float64")

    return run


ratio_col, partial_ratio_col, token_set_ratio_col = _pairwise(ratio), _pairwise(partial_ratio), _pairwise(token_set_ratio)
