"""Suffix arrays by induced sorting, and common prefixes in text order.

The text is classified into S and L suffixes; the substrings between leftmost S suffixes (LMS) are sorted by one induction, named, and their names sorted
by recursion where they repeat; a second induction gives the array. Over bytes an induction goes bucket by bucket, whole batches at once;
over names, of which there are about as many as buckets, suffix by suffix.
"""

from __future__ import annotations

import numpy as np


def _types(t: np.ndarray) -> np.ndarray:
    """True for suffixes smaller than the next one. The end is smaller than everything."""
    up = np.zeros(len(t), dtype=bool)
    step = np.sign(np.diff(t.astype(np.int64)))
    turn = np.flatnonzero(np.append(step, -1))  # where the next symbol differs, or the text ends
    of = turn[np.searchsorted(turn, np.arange(len(t)))]
    up[:] = np.append(step, -1)[of] > 0
    return up


def _by_bucket(t: np.ndarray, up: np.ndarray, lms: np.ndarray, k: int) -> np.ndarray:
    """The order of all suffixes that follows from the order of LMS suffixes ``lms``, in batches. Symbols are below ``k``, few."""
    lower: list[list[np.ndarray]] = [[] for _ in range(k)]

    def deal(at: np.ndarray, into: list[list[np.ndarray]], own: int) -> np.ndarray:
        """Puts suffixes at the end of their buckets in their order; those of bucket ``own`` are returned."""
        if not len(at):
            return at
        symbols = t[at]
        order = np.argsort(symbols, kind="stable")
        at, symbols = at[order], symbols[order]
        cuts = np.append(np.append(0, np.flatnonzero(symbols[1:] != symbols[:-1]) + 1), len(at))
        mine = at[:0]
        for a, b in zip(cuts, cuts[1:], strict=False):
            into[symbols[a]].append(at[a:b])
            if symbols[a] == own:
                mine = at[a:b]
        return mine

    seeds: list[np.ndarray] = [np.zeros(0, dtype=np.int64)] * k
    order = np.argsort(t[lms], kind="stable")
    cuts = np.searchsorted(t[lms][order], np.arange(k + 1))
    for c in range(k):
        seeds[c] = lms[order[cuts[c] : cuts[c + 1]]]
    none = np.zeros(0, dtype=np.int64)
    lower[t[-1]].append(np.array([len(t) - 1]))  # what stands before the end
    for c in range(k):
        batch = np.concatenate(lower[c]) if lower[c] else none
        while len(batch):
            before = batch[batch > 0] - 1
            batch = deal(before[~up[before]], lower, c)
        before = seeds[c][seeds[c] > 0] - 1
        deal(before[~up[before]], lower, -1)
    upper: list[list[np.ndarray]] = [[] for _ in range(k)]  # from the last one backwards
    for c in range(k - 1, -1, -1):
        batch = np.concatenate(upper[c]) if upper[c] else none
        while len(batch):
            before = batch[batch > 0] - 1
            batch = deal(before[up[before]], upper, c)
        held = np.concatenate(lower[c])[::-1] if lower[c] else none
        before = held[held > 0] - 1
        deal(before[up[before]], upper, -1)
    return np.concatenate([x for c in range(k) for x in (*lower[c], *[p[::-1] for p in reversed(upper[c])])])


def _one_by_one(t: np.ndarray, up: np.ndarray, lms: np.ndarray, k: int) -> np.ndarray:
    """The same, for many symbols."""
    n = len(t)
    sizes = np.bincount(t, minlength=k)
    ends = np.cumsum(sizes)
    # of each suffix the symbol of the one before it in the text, if that one is to be induced; an entry more, for places not filled yet (-1)
    lower, upper = (np.concatenate([[-1], np.where(kind, t, -1)[:-1], [-1]]).tolist() for kind in (~up, up))
    out = [-1] * n
    tail = ends.tolist()
    for p, c in zip(lms[::-1].tolist(), t[lms[::-1]].tolist(), strict=True):
        tail[c] -= 1
        out[tail[c]] = p
    head = (ends - sizes).tolist()
    c = int(t[-1])
    out[head[c]] = n - 1
    head[c] += 1
    for p in out:  # places are filled ahead of where they are read
        c = lower[p]
        if c >= 0:
            at = head[c]
            out[at] = p - 1
            head[c] = at + 1
    tail = ends.tolist()
    for p in reversed(out):
        c = upper[p]
        if c >= 0:
            at = tail[c] - 1
            out[at] = p - 1
            tail[c] = at
    return np.array(out, dtype=np.int64)


FEW = 1024  # symbols up to which an induction goes by bucket


def _names(t: np.ndarray, ordered: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Names in the order of LMS substrings ``ordered`` of ``sizes``; equal ones share theirs."""
    padded = np.append(t.astype(np.int64), -1)
    same = np.append(False, sizes[1:] == sizes[:-1])
    at, step = np.flatnonzero(same), 0
    while len(at):
        equal = padded[ordered[at] + step] == padded[ordered[at - 1] + step]
        same[at[~equal]] = False
        step += 1
        at = at[equal]
        at = at[sizes[at] > step]
    return np.cumsum(~same) - 1


def suffix_array(t: np.ndarray) -> np.ndarray:
    """The starts of all suffixes of the symbols ``t`` (0 or more) in ascending order; a suffix that begins another comes before it."""
    if len(t) < 2:
        return np.arange(len(t))
    k = int(t.max()) + 1
    up = _types(t)
    induce = _by_bucket if k <= FEW else _one_by_one
    lms = np.flatnonzero(up[1:] & ~up[:-1]) + 1
    order = induce(t, up, lms, k)
    if not len(lms):
        return order
    place = np.full(len(t), -1)
    place[lms] = np.arange(len(lms))
    ordered = order[place[order] >= 0]
    sizes = np.append(lms[1:] + 1, len(t) + 1) - lms  # with the first symbol of the next, or the end
    names = _names(t, ordered, sizes[place[ordered]])
    if names[-1] + 1 < len(lms):
        text = np.empty(len(lms), dtype=np.int64)
        text[place[ordered]] = names
        ordered = lms[suffix_array(text)]
    return induce(t, up, ordered, k)


def common_prefixes(t: np.ndarray, order: np.ndarray, starts: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Permuted common prefixes: of each position the length it shares with the suffix before it in ``order``, and where that one begins (-1: there is none).

    Where the symbol before both is the same, the length is that of the position before less one, so only the others, and ``starts``, are compared, up to
    ``most`` symbols; from one of ``starts`` to the next the lengths are right up to the distance to ``most`` symbols from it.
    """
    before = np.full(len(t), -1, dtype=np.int64)
    before[order[1:]] = order[:-1]
    fresh = (before <= 0) | (np.arange(len(t)) == 0)
    rest = np.flatnonzero(~fresh)
    fresh[rest] = t[rest - 1] != t[before[rest] - 1]
    fresh[starts] = True
    at = np.flatnonzero(fresh)
    padded = np.concatenate([t, np.full(most + 8, np.iinfo(t.dtype).max, dtype=t.dtype)])
    length = np.zeros(len(at), dtype=np.int64)
    live = np.flatnonzero(before[at] >= 0)
    span = np.arange(8)
    while len(live):
        a, b = at[live] + length[live], before[at[live]] + length[live]
        equal = (padded[a[:, None] + span] == padded[b[:, None] + span]) & (a[:, None] + span < len(t)) & (b[:, None] + span < len(t))
        run = np.where(equal.all(axis=1), 8, np.argmin(equal, axis=1))
        length[live] += run
        live = live[(run == 8) & (length[live] < most)]
    last = np.maximum.accumulate(np.where(fresh, np.arange(len(t)), 0))
    whole = np.zeros(len(t), dtype=np.int64)
    whole[at] = length
    return np.maximum(whole[last] - (np.arange(len(t)) - last), 0), before
