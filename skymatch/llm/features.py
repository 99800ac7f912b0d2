"""Numbers that describe a whole text, and the two linear models learned from them.

A text becomes the square roots of its byte frequencies and some figures on its
shape. The cost is linear in the text and a few KB of memory a row.
"""

from __future__ import annotations

import math
import operator

import numpy as np

UPPER, DIGIT = bytes(range(65, 91)), bytes(range(48, 58))
MARK = bytes(c for c in range(33, 127) if not chr(c).isalnum())
#: Length of `features`.
WIDTH = 256 + 11


def features(text: str | None) -> np.ndarray:
    """float32 vector of a whole text; null and empty texts give the same one."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    out, n = np.zeros(WIDTH, "f4"), len(raw)
    if not n:
        return out
    counts = np.bincount(np.frombuffer(raw, "u1"), minlength=256)
    out[:256] = np.sqrt(counts / n)
    words = raw.split()
    held = max(1, len(words))
    marked = sum(w[-1] in MARK for w in words)
    out[256:] = (
        math.log1p(n), counts[65:91].sum() / n, counts[48:58].sum() / n, sum(counts[c] for c in MARK) / n, counts[128:].sum() / n, counts[10] / n,
        math.log(max(1, len(set(words)))) / math.log(held + 1), sum(map(operator.eq, words, words[1:])) / held, n / held / 10, marked / held, math.log1p(held),
    )
    return out


def scaling(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Mean and spread of the columns; a constant column keeps spread 1."""
    spread = x.std(axis=0)
    return x.mean(axis=0), np.where(spread > 1e-6, spread, 1.0)


def standard(x: np.ndarray, mean: np.ndarray, spread: np.ndarray, short: float = 48.0) -> np.ndarray:
    """Scaled features, drawn towards the mean for texts of few bytes, whose frequencies say little."""
    n = np.expm1(x[:, 256:257].astype("f8"))
    return (x - mean) / spread * (n / (n + short))


def rank_weights(better: np.ndarray, worse: np.ndarray, pairs: int = 8_000, rounds: int = 200, penalty: float = 1e-3, seed: int = 7) -> np.ndarray:
    """Bradley-Terry: weights whose score differences explain that ``better[i]`` is preferred to ``worse[j]``.

    Preference pairs are drawn evenly from both sides; the logistic loss on
    their feature differences is minimised by accelerated gradient steps.
    """
    draw = np.random.default_rng(seed)
    diff = better[draw.integers(0, len(better), pairs)] - worse[draw.integers(0, len(worse), pairs)]
    step = 4.0 / (float(np.square(diff).sum(axis=1).mean()) + 4 * penalty)
    w = ahead = np.zeros(diff.shape[1])
    for k in range(rounds):
        slope = -(diff.T @ (1 / (1 + np.exp(np.clip(diff @ ahead, -30, 30))))) / pairs + penalty * ahead
        new = ahead - step * slope
        w, ahead = new, new + (k / (k + 3)) * (new - w)
    return w


def class_weights(x: np.ndarray, y: np.ndarray, classes: int, rounds: int = 300, penalty: float = 1e-3) -> np.ndarray:
    """Softmax regression (features and a constant, by class) by accelerated gradient steps."""
    x = np.hstack([x, np.ones((len(x), 1))])
    wanted = np.eye(classes)[y]
    step = 2.0 / (float(np.square(x).sum(axis=1).mean()) / 2 + penalty)
    w = ahead = np.zeros((x.shape[1], classes))
    for k in range(rounds):
        slope = x.T @ (posteriors(x @ ahead) - wanted) / len(x) + penalty * ahead
        new = ahead - step * slope
        w, ahead = new, new + (k / (k + 3)) * (new - w)
    return w


def posteriors(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)
