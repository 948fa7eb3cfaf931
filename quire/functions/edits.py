"""Which of many titles may be few edits apart (numpy): a bound from their first characters that loses no pair."""

from __future__ import annotations

import numpy as np

#: Characters of each title that the bound looks at: bits of a word.
WIDTH = 32
#: The bound is looked at after every so many characters.
STEP = 4
#: Pairs that are looked at together.
BATCH = 16384


class Titles:
    """Distinct titles by length and content: their lengths, and a row of character numbers for each of the first places."""

    def __init__(self, titles: list[str]):
        self.order = sorted(range(len(titles)), key=lambda i: (len(titles[i]), titles[i]))
        self.text = [titles[i] for i in self.order]
        self.length = np.array([len(x) for x in self.text], np.int64)
        self.points = np.full((len(titles), WIDTH), -1, np.int64)
        for row, x in zip(self.points, self.text, strict=True):
            start = np.frombuffer(x[:WIDTH].encode("utf-32-le", "surrogatepass"), np.uint32)
            row[: len(start)] = start

    def numbered(self, alphabet: np.ndarray) -> np.ndarray:
        return np.ascontiguousarray(np.searchsorted(alphabet, self.points).T)


def near(one: Titles, other: Titles | None, reach: np.ndarray, edits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places in one, and in other (None: in one, each pair once), of pairs a, b that may be edits[length of b] apart.

    a is not longer than b, b not longer than reach[length of a]; with another
    list, titles of one are also looked for as b, and then pairs come as they
    are in the lists, those of equal length once.
    """
    if other is None:
        return _ahead(one, one, "own", reach, edits)
    x, y = _ahead(one, other, "left", reach, edits)
    v, u = _ahead(other, one, "right", reach, edits)
    return np.concatenate([x, u]), np.concatenate([y, v])


def _ahead(short: Titles, long: Titles, side: str, reach: np.ndarray, edits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of a title and one that is as long (side: left; own: and comes later) or longer; titles of one length together, BATCH pairs at a time."""
    alphabet = np.unique(np.concatenate([short.points.ravel(), long.points.ravel()]))
    own, theirs = short.numbered(alphabet), long.numbered(alphabet)
    left, right = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    lengths, first, count = np.unique(short.length, return_index=True, return_counts=True)
    for m, i, n in zip(lengths.tolist(), first.tolist(), count.tolist(), strict=True):
        end = int(np.searchsorted(long.length, reach[m], "right"))
        while n:
            begin = i + 1 if side == "own" else int(np.searchsorted(long.length, m, side))
            take = min(n, max(1, BATCH // max(1, end - begin)))
            if begin < end:
                k, at = _bounded(own[: min(m, WIDTH), i : i + take], m, theirs[:, begin:end], long.length[begin:end], edits, len(alphabet))
                k, at = k + i, at + begin
                left.append(k[at > k] if side == "own" else k)
                right.append(at[at > k] if side == "own" else at)
            i, n = i + take, n - take
    return np.concatenate(left), np.concatenate(right)


def _bounded(short: np.ndarray, m: int, long: np.ndarray, length: np.ndarray, edits: np.ndarray, alphabet: int) -> tuple[np.ndarray, np.ndarray]:
    """Columns of short (titles of length m) and of long (of these lengths, none less than m) that the bound leaves.

    The edit matrix of two starts is filled a column at a time, as bits
    (Myers, Hyyrö), for all pairs at once. A path to the last corner pays a
    step for each diagonal between it and the corner's, so the cell of the
    corner's diagonal in any column is no more than the distance.
    """
    last, rows = short.shape
    bit = np.uint32(1) << np.arange(WIDTH, dtype=np.uint32)
    below = np.append(bit - np.uint32(1), np.uint32(0xFFFFFFFF))  # the lowest r bits
    peq = np.zeros((rows, alphabet), np.uint32)
    for r in range(last):
        peq[np.arange(rows), short[r]] |= bit[r]
    size = len(length)
    k = at = None  # of the pairs that are left; None: all
    d, off = np.tile(edits[length], rows), np.tile(length - m, rows)
    vp, vn = np.full(rows * size, 0xFFFFFFFF, np.uint32), np.zeros(rows * size, np.uint32)
    x, d0, hp = (np.empty(rows * size, np.uint32) for _ in range(3))
    for j in range(1, last + 1):
        if k is None:
            for r in range(rows):
                np.take(peq[r], long[j - 1], out=x[r * size : (r + 1) * size], mode="clip")
        else:
            x = peq[k, long[j - 1, at]]
        np.bitwise_or(x, vn, out=x)
        np.bitwise_and(x, vp, out=d0)
        np.add(d0, vp, out=d0)
        np.bitwise_xor(d0, vp, out=d0)
        np.bitwise_or(d0, x, out=d0)
        np.bitwise_or(vp, d0, out=hp)
        np.invert(hp, out=hp)
        np.bitwise_or(hp, vn, out=hp)
        np.bitwise_and(vp, d0, out=x)
        np.add(hp, hp, out=hp)
        np.bitwise_or(hp, 1, out=hp)
        np.add(x, x, out=x)
        np.bitwise_and(hp, d0, out=vn)
        np.bitwise_or(hp, d0, out=hp)
        np.invert(hp, out=hp)
        np.bitwise_or(hp, x, out=vp)
        if j % STEP == 0 and j > edits[m] or j == last:
            row = j - off
            mask = below[np.maximum(row, 0)]
            bound = j + np.bitwise_count(vp & mask).astype(np.int64) - np.bitwise_count(vn & mask)
            keep = np.flatnonzero((bound <= d) | (row < 0))
            if len(keep) < 0.75 * len(d) or j == last:
                k, at = (keep // size, keep % size) if k is None else (k[keep], at[keep])
                d, off, vp, vn = d[keep], off[keep], vp[keep], vn[keep]
                d0, hp = np.empty(len(keep), np.uint32), np.empty(len(keep), np.uint32)
            if not len(keep):
                break
    return k, at
