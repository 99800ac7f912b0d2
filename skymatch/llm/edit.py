"""Edit distance within a small bound, for many pairs of strings at once."""

from __future__ import annotations

import numpy as np

#: Characters held at once, about.
ROOM = 4_000_000


def points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")


def within(a: list[np.ndarray], b: list[np.ndarray], bound: int) -> np.ndarray:
    """For each pair of code-point arrays, whether their edit distance is at most ``bound`` (< 32)."""
    out = np.zeros(len(a), bool)
    size = np.array([len(x) for x in a], "i8"), np.array([len(x) for x in b], "i8")
    fits = np.abs(size[0] - size[1]) <= bound
    brief = fits & (np.minimum(*size) <= bound)  # shorter than the band: the plain table
    for i in np.nonzero(brief)[0]:
        out[i] = _table(a[i], b[i]) <= bound
    order = np.nonzero(fits & ~brief)[0]
    order = order[np.argsort(size[0][order], kind="stable")]
    start = 0
    while start < len(order):
        end = start + 1
        while end < len(order) and (end - start + 1) * (size[0][order[end]] + 2 * bound) <= ROOM:
            end += 1
        some = order[start:end]
        out[some] = _banded([a[i] for i in some], [b[i] for i in some], bound)
        start = end
    return out


def _table(a: np.ndarray, b: np.ndarray) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a.tolist(), 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b.tolist(), 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def _banded(a: list[np.ndarray], b: list[np.ndarray], bound: int) -> np.ndarray:
    """Bit-parallel columns of the edit table, cut to a band of 2 * bound + 1 rows around the diagonal.

    Bit t of a word is row (column + t - bound). The vertical steps of one
    column are bit words; they move down one row as the band does. The value at
    the band's lower edge is followed until it meets the last row, and then
    along that row to the last column. Pairs past hope are left out as they go.
    """
    width = 2 * bound + 1
    m, n = np.array([len(x) for x in a]), np.array([len(x) for x in b])
    rows = np.zeros((len(a), int(m.max()) + 2 * width), "u4")  # shifted by the bound, so that row 0 of the band exists
    cols = np.zeros((len(a), int(n.max())), "u4")
    rows[:] = 0xFFFFFFFF
    for k, (x, y) in enumerate(zip(a, b, strict=True)):
        rows[k, bound : bound + len(x)] = x
        cols[k, : len(y)] = y
    one, full = np.uint64(1), np.uint64((1 << width) - 1)
    plus = np.full(len(a), (full >> np.uint64(bound)) << np.uint64(bound), "u8")
    minus = np.zeros(len(a), "u8")
    score = np.full(len(a), bound)
    live = np.arange(len(a))
    out = np.zeros(len(a), bool)
    weights = one << np.arange(width, dtype="u8")
    for j in range(int(n.max())):
        match = ((rows[:, j : j + width] == cols[:, j : j + 1]) * weights).sum(axis=1, dtype="u8")
        diagonal = ((((match & plus) + plus) ^ plus) | match | minus) & full
        up, down = (minus | ~(diagonal | plus)) & full, diagonal & plus
        sinking = j < m - bound
        edge = np.uint64(width - 1)
        last = np.clip(m - 1 - j + bound, 0, width - 1).astype("u8")
        flat = ((up >> last) & one).astype("i8") - ((down >> last) & one).astype("i8")
        score = score + np.where(sinking, 1 - ((diagonal >> edge) & one).astype("i8"), flat)
        shifted = diagonal >> one
        plus, minus = (down | ~(shifted | up)) & full, shifted & up
        ended = j == n - 1
        if ended.any():
            out[live[ended]] = score[ended] <= bound
        if ended.any() or j % 32 == 31:
            stay = ~ended & ~(sinking & (score > 2 * bound + n - m))
            if not stay.all():
                live, rows, cols, m, n, plus, minus, score = (v[stay] for v in (live, rows, cols, m, n, plus, minus, score))
                if not len(live):
                    break
    return out
