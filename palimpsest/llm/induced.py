"""Suffix arrays by induced sorting, and common prefixes in text order.

Types, buckets and names are numpy arrays. The two scans, in which each entry may put another one ahead of itself, take one of two ways.
Where buckets are long (the bytes of a text), they go in batches: the entries of a stretch of the array are induced together
as long as none of them lands inside the stretch, and the stretch ends where the first one does. Where they are short (the names of
deeper levels), they are loops over lists, with what they look up worked out beforehand. Either way the result is that of the
entry-by-entry scan, and work is linear in the length, apart from sorting symbols inside a batch or bucket.
"""

from __future__ import annotations

import numpy as np

#: Entries per bucket, on average, from which scans go in batches.
CROWDED = 500
LEAST, MOST = 64, 1 << 16


def _stable_ranks(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each entry, how many equal ones stand before it; the distinct keys and their counts."""
    order = np.argsort(keys, kind="stable")
    ordered = keys[order]
    starts = np.flatnonzero(np.append(True, ordered[1:] != ordered[:-1]))
    counts = np.diff(np.append(starts, len(keys)))
    ranks = np.empty(len(keys), np.int64)
    ranks[order] = np.arange(len(keys)) - np.repeat(starts, counts)
    return ranks, ordered[starts], counts


def _scan(sa: np.ndarray, s: np.ndarray, wanted: np.ndarray, border: np.ndarray, forward: bool) -> None:
    """Put the predecessors of type ``wanted`` at the borders of their buckets, moving the borders inward.

    Forward fills buckets from the front (L-type), backward from the back (S-type).
    """
    n, step = len(sa), LEAST
    done = 0  # entries scanned, from the front or from the back
    while done < n:
        size = min(step, n - done)
        block = sa[done : done + size] if forward else sa[n - done - size : n - done][::-1]
        at = np.flatnonzero(block > 0)
        before = block[at] - 1
        hit = wanted[before]
        at, before = at[hit], before[hit]
        if not len(at):
            done, step = done + size, min(MOST, 2 * step)
            continue
        keys = s[before]
        ranks, distinct, counts = _stable_ranks(keys)
        # distance of the target from the start of the scan, so both directions read alike
        target = border[keys] + ranks if forward else n - 1 - (border[keys] - ranks)
        first = int(target.min())
        if first < done + size:
            good = at < first - done
            at, before, keys, target = at[good], before[good], keys[good], target[good]
            _, distinct, counts = _stable_ranks(keys)
            size = first - done
            step = max(LEAST, 2 * size)
        else:
            step = min(MOST, 2 * step)
        sa[target if forward else n - 1 - target] = before
        border[distinct] += counts if forward else -counts
        done += size


def _induce(s: np.ndarray, lms: np.ndarray, s_type: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Sort all suffixes (or LMS substrings) from the order of ``lms``."""
    n = len(s)
    ends = np.cumsum(counts)
    # ``lms`` stand at the ends of their buckets, in their order
    keys = s[lms]
    order = np.argsort(keys, kind="stable")
    upto = np.bincount(keys, minlength=len(counts))
    first = np.cumsum(upto) - upto
    start = np.full(n, n, np.int64)  # n: nothing yet
    start[(ends - upto)[keys[order]] + np.arange(len(lms)) - first[keys[order]]] = lms[order]
    # for each suffix the bucket of the one before it, where that is of the type in question
    if n > CROWDED * len(counts):
        return _induced_in_batches(start, s, s_type, ends, counts)
    before = np.append(-1, s[:-1])
    before_type = np.append(True, s_type[:-1])
    left = np.append(np.where(before_type, -1, before), -1).tolist()
    right = np.append(np.where(before_type, before, -1), -1)
    right[0] = -1
    right = right.tolist()
    sa = start.tolist()
    head = (ends - counts).tolist()
    for j in sa:  # the list grows ahead of the loop
        bucket = left[j]
        if bucket >= 0:
            place = head[bucket]
            sa[place] = j - 1
            head[bucket] = place + 1
    found = np.array(sa)
    put = found < n
    put[put] = s_type[found[put]]
    found[put] = n
    found[0] = n - 1  # the sentinel
    sa = found.tolist()
    tail = (ends - 1).tolist()
    tail[0] = 0
    for j in reversed(sa):
        bucket = right[j]
        if bucket >= 0:
            place = tail[bucket]
            sa[place] = j - 1
            tail[bucket] = place - 1
    return np.array(sa)


def _induced_in_batches(sa: np.ndarray, s: np.ndarray, s_type: np.ndarray, ends: np.ndarray, counts: np.ndarray) -> np.ndarray:
    n = len(s)
    sa[sa == n] = -1
    _scan(sa, s, ~s_type, ends - counts, True)
    smaller = sa >= 0
    smaller[smaller] = s_type[sa[smaller]]
    sa[smaller] = -1
    sa[0] = n - 1  # the sentinel
    _scan(sa, s, s_type & (np.arange(n) < n - 1), ends - 1, False)
    return sa


def suffix_array(s: np.ndarray) -> np.ndarray:
    """``s``: integers from 0; the last is 0 and the only 0. Returns the starts of all suffixes in order."""
    n = len(s)
    if n == 1:
        return np.zeros(1, np.int64)
    differs = np.append(s[:-1] != s[1:], True)
    next_change = np.minimum.accumulate(np.where(differs, np.arange(n), n)[::-1])[::-1]
    s_type = np.append(s, -1)[next_change] < np.append(s, [-1, -1])[next_change + 1]
    s_type[n - 1] = True
    is_lms = np.append(False, s_type[1:] & ~s_type[:-1])
    lms = np.flatnonzero(is_lms)
    counts = np.bincount(s)
    sa = _induce(s, lms, s_type, counts)
    ordered = sa[is_lms[sa]]
    # name the LMS substrings: equal neighbours in this order share a name
    place = np.empty(n, np.int64)
    place[lms] = np.arange(len(lms))
    length = np.diff(np.append(lms, n - 1)) + 1
    a, b = ordered[:-1], ordered[1:]
    size = length[place[a]]
    active = np.flatnonzero(size == length[place[b]])
    same = np.zeros(len(a), bool)
    offset = 0
    while len(active):
        active = active[s[a[active] + offset] == s[b[active] + offset]]
        offset += 1
        over = size[active] <= offset
        same[active[over]] = True
        active = active[~over]
    names = np.empty(len(lms), np.int64)
    names[place[ordered]] = np.cumsum(np.append(0, ~same))
    if same.any():
        order = suffix_array(names)
    else:
        order = np.argsort(names)
    return _induce(s, lms[order], s_type, counts)


def common_prefixes(s: np.ndarray, sa: np.ndarray, stop: int) -> np.ndarray:
    """For each suffix in text order, the length it shares with the suffix before it in ``sa``.

    A symbol of at most ``stop`` ends a match. Where the symbols before both suffixes are equal the value is one
    less than its left neighbour's; only the others are compared.
    """
    n = len(s)
    before = np.empty(n, np.int64)
    before[sa[1:]] = sa[:-1]
    before[sa[0]] = -1
    left, other = np.append(-1, s[:-1]), np.append(-2, s[:-1])[np.maximum(before, 0)]
    compared = (left != other) | (left <= stop) | (before <= 0)
    starts = np.flatnonzero(compared)
    a, b = starts, np.maximum(before[starts], 0)
    shared = np.zeros(len(starts), np.int64)
    active = np.flatnonzero(before[starts] >= 0)
    offset = 0
    while len(active):
        x, y = a[active] + offset, b[active] + offset
        active = active[(s[x] == s[y]) & (s[x] > stop)]
        offset += 1
        shared[active] = offset
    from_start = np.maximum.accumulate(np.where(compared, np.arange(n), 0))
    values = np.zeros(n, np.int64)
    values[starts] = shared
    return np.maximum(values[from_start] - (np.arange(n) - from_start), 0)
