"""Suffix arrays by induced sorting, and permuted longest common prefixes, in numpy.

Suffixes are classified as smaller or larger than the next one. The leftmost smaller ones (LMS) cut the text into substrings, which one
round of induction sorts; they are named by rank, and the string of names, at most half as long, is sorted by the same method in
turn: its suffixes give the order of the LMS suffixes, and a second round induces all others from them in linear time. The recursion
ends where all names differ.

Induction goes through the suffixes in order. How many larger (smaller) suffixes a symbol has is known beforehand, so it is known which
places are final; each step takes all suffixes up to the first place that is not, so that numpy moves whole waves, whatever
the alphabet: bytes, or names.

Permuted common prefixes are computed where they can't follow from the position before (the preceding symbols differ); all
others are one less than their neighbour's, which a running maximum fills in.
"""

from __future__ import annotations

import numpy as np


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Start of each suffix of the bytes `text`, in order; a suffix that is a prefix of another comes first."""
    if len(text) < 2:
        return np.arange(len(text), dtype=np.int32)
    return _sorted(np.append(text.astype(np.int32) + 1, np.int32(0)))[1:]  # 0 ends the text and is smaller than all


def _sorted(t: np.ndarray) -> np.ndarray:
    """Suffixes of a string of numbers in order; its last symbol is 0, which stands nowhere else."""
    n = len(t)
    if n < 3:
        return np.arange(n, dtype=np.int32)[::-1]
    small = _types(t)
    lms = np.flatnonzero(small[1:] & ~small[:-1]).astype(np.int32) + 1
    sa = _induced(t, small, lms[np.argsort(t[lms], kind="stable")])
    is_lms = np.zeros(n, bool)
    is_lms[lms] = True
    by_substring = sa[is_lms[sa]]
    names = _names(t, lms, by_substring)
    if names[-1] + 1 == len(lms):
        return _induced(t, small, by_substring)
    of = np.empty(n, np.int32)
    of[by_substring] = names
    return _induced(t, small, lms[_sorted(of[lms])])  # the end's name is 0, and no other's


def _types(t: np.ndarray) -> np.ndarray:
    """Which suffixes are smaller than the next one; equal symbols do as the one after them."""
    n = len(t)
    step = np.sign(t[1:].astype(np.int32) - t[:-1])  # 1: smaller than the next symbol
    step = np.append(step, 1)
    where = np.where(step != 0, np.arange(n), n)
    after = np.minimum.accumulate(where[::-1])[::-1]
    return step[after] > 0


def _induced(t: np.ndarray, small: np.ndarray, lms: np.ndarray) -> np.ndarray:
    """All suffixes in order, from the LMS suffixes in theirs (or sorted by first symbol: then LMS substrings come out sorted)."""
    n = len(t)
    counts = np.bincount(t)
    ends = np.cumsum(counts)
    heads = ends - counts
    smaller = np.bincount(t[small], minlength=len(counts))
    sa = np.full(n, -1, np.int32)
    chars = t[lms]
    own = np.bincount(chars, minlength=len(counts))
    before = np.cumsum(own) - own
    sa[ends[chars] - own[chars] + np.arange(len(lms)) - before[chars]] = lms
    # larger suffixes: each bucket from its head on, until it has all of them
    front, full, at, bucket = heads.copy(), ends - smaller, 0, 0
    while at < n:
        bucket = _open(front, full, bucket, 1)
        hi = int(front[bucket]) if bucket < len(counts) else n
        _put(sa, t, small, sa[at:hi], front, False)
        at = hi
    # smaller suffixes: each bucket from its end on
    back, full, at, bucket = ends.copy(), ends - smaller, n, len(counts) - 1
    sa[0], back[0] = n - 1, 0
    while at > 0:
        bucket = _open(back, full, bucket, -1)
        lo = int(back[bucket]) if bucket >= 0 else 0
        _put(sa, t, small, sa[lo:at][::-1], back, True)
        at = lo
    return sa


def _open(reached: np.ndarray, full: np.ndarray, bucket: int, step: int) -> int:
    """The next bucket from `bucket` on, upwards or downwards, that lacks some suffixes; one beyond the last if none does."""
    if 0 <= bucket < len(full) and reached[bucket] != full[bucket]:
        return bucket
    size = 16
    while 0 <= bucket < len(full):
        if step > 0:
            lacking = reached[bucket : bucket + size] != full[bucket : bucket + size]
        else:
            lo = max(0, bucket - size + 1)
            lacking = (reached[lo : bucket + 1] != full[lo : bucket + 1])[::-1]
        if lacking.any():
            return bucket + step * int(lacking.argmax())
        bucket += step * len(lacking)
        size *= 4
    return bucket


def _put(sa: np.ndarray, t: np.ndarray, small: np.ndarray, known: np.ndarray, at: np.ndarray, wanted: bool) -> None:
    """Put the suffixes before the known ones, if of the wanted type, next in their buckets."""
    new = known[known > 0] - 1
    new = new[small[new] == wanted]
    if not len(new):
        return
    chars = t[new]
    if len(new) > 1:
        order = chars.argsort(kind="stable")
        new, chars = new[order], chars[order]
        rank = np.arange(len(new)) - chars.searchsorted(chars)
    else:
        rank = 0
    # of equal symbols the last one tells where the bucket has got to
    if wanted:
        places = at[chars] - 1 - rank
        at[chars] = places
    else:
        places = at[chars] + rank
        at[chars] = places + 1
    sa[places] = new


def _names(t: np.ndarray, lms: np.ndarray, ordered: np.ndarray) -> np.ndarray:
    """Rank of each LMS substring in `ordered`; equal ones share it."""
    length = np.empty(len(t), np.int32)
    length[lms] = np.diff(np.append(lms, len(t))) + 1
    size = length[ordered]
    same = size[1:] == size[:-1]
    left, right = ordered[:-1], ordered[1:]
    active, k = np.flatnonzero(same), 0
    last = len(t) - 1
    while len(active):
        differ = t[np.minimum(left[active] + k, last)] != t[np.minimum(right[active] + k, last)]
        same[active[differ]] = False
        active = active[~differ]
        k += 1
        active = active[size[active] > k]
    return np.append(0, np.cumsum(~same)).astype(np.int32)


def common_prefixes(text: np.ndarray, sa: np.ndarray) -> np.ndarray:
    """For each position the common prefix of its suffix with the one before it in order (permuted order: by position)."""
    n = len(text)
    if not n:
        return np.zeros(0, np.int64)
    before = np.full(n, -1, np.int64)
    before[sa[1:]] = sa[:-1]
    here = np.arange(n)
    apart = (here == 0) | (before <= 0)
    apart[1:] |= text[:-1] != text[np.maximum(before[1:] - 1, 0)]
    ask = here[apart & (before >= 0)]
    eight = np.zeros(n + 8, np.uint64)
    padded = np.concatenate([text, np.zeros(16, np.uint8)])
    for k in range(8):
        eight |= padded[k : k + n + 8].astype(np.uint64) << np.uint64(8 * k)
    length = np.zeros(n, np.int64)
    active, other, done = ask, before[ask], 0
    while len(active):
        most = n - np.maximum(active, other) - done
        x = eight[np.minimum(active + done, n)] ^ eight[np.minimum(other + done, n)]
        equal = np.where(x == 0, 8, np.bitwise_count((x & (~x + np.uint64(1))) - np.uint64(1)) // 8).astype(np.int64)
        equal = np.minimum(equal, np.maximum(most, 0))
        length[active] = done + equal
        on = (equal == 8) & (most > 8)
        active, other, done = active[on], other[on], done + 8
    reach = np.where(apart, length + here, 0)
    return np.where(before >= 0, np.maximum.accumulate(reach) - here, 0)
