"""Suffix arrays by induced sorting, and permuted common prefixes.

`suffix_array` sorts the leftmost-smaller substrings by one induction, names them, sorts the suffixes of the
string of names, by recursion where names repeat, and induces all others from those in one pass up and one
down. A pass handles a bucket at a time with array operations. Names are many and their buckets small, so a
name is written as two digits, whose buckets are large again; where that would not shorten the string,
`_by_names` makes the same passes entry by entry.
"""

from __future__ import annotations

import numpy as np


def _smaller(t: np.ndarray) -> np.ndarray:
    """Which suffixes are smaller than the one that follows. The last symbol of t is its only least one."""
    step = np.sign(np.diff(t.astype("int32")))
    at = np.where(step != 0, np.arange(len(step)), len(step))
    following = np.minimum.accumulate(at[::-1])[::-1]
    return np.append(step[following] > 0, True)


def _induced(t: np.ndarray, small: np.ndarray, seeds: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """All suffixes, induced from leftmost-smaller ones in the order that `seeds` has within each bucket."""
    ends = np.cumsum(sizes)
    starts = ends - sizes
    out = np.full(len(t), -1, dtype="int64")
    symbols = t[seeds]
    order = np.argsort(symbols, kind="stable")
    seeds, symbols = seeds[order], symbols[order]
    placed = np.bincount(symbols, minlength=len(sizes))
    firsts = np.cumsum(placed) - placed
    buckets = np.flatnonzero(sizes).tolist()

    head = starts.copy()
    for c in buckets:
        at, first = int(starts[c]), int(starts[c])
        while at < head[c]:  # larger ones of this bucket bring others of it
            block = out[at : head[c]]
            at = int(head[c])
            before = block[block > 0] - 1
            own = before[(t[before] == c) & ~small[before]]
            out[at : at + len(own)] = own
            head[c] += len(own)
        full = np.concatenate((out[first : head[c]], seeds[firsts[c] : firsts[c] + placed[c]]))
        before = full[full > 0] - 1
        symbol = t[before]
        keep = ~small[before] & (symbol > c)
        _deal(out, head, before[keep], symbol[keep], 1)

    tail = ends.copy()
    for c in reversed(buckets):
        last = at = int(ends[c])
        while at > tail[c]:
            block = out[tail[c] : at][::-1]
            at = int(tail[c])
            before = block[block > 0] - 1
            own = before[(t[before] == c) & small[before]]
            out[at - len(own) : at] = own[::-1]
            tail[c] -= len(own)
        if c == 0:
            break
        full = np.concatenate((out[tail[c] : last][::-1], out[starts[c] : head[c]][::-1]))
        before = full[full > 0] - 1
        symbol = t[before]
        keep = small[before] & (symbol < c)
        _deal(out, tail, before[keep], symbol[keep], -1)
    out[0] = len(t) - 1
    return out


def _deal(out: np.ndarray, edge: np.ndarray, suffixes: np.ndarray, symbols: np.ndarray, way: int) -> None:
    """Append suffixes, in their order, at the heads of their buckets, or at the tails when way is -1."""
    if not len(suffixes):
        return
    order = np.argsort(symbols, kind="stable")
    s = symbols[order]
    groups = np.flatnonzero(np.append(True, s[1:] != s[:-1]))
    lengths = np.diff(np.append(groups, len(s)))
    within = np.arange(len(s)) - np.repeat(groups, lengths)
    out[edge[s] + within if way > 0 else edge[s] - 1 - within] = suffixes[order]
    edge[s[groups]] += way * lengths


def suffix_array(t: np.ndarray, symbols: int, bound: float = np.inf) -> np.ndarray:
    """Suffix array of t, integers below `symbols`, the last of which is 0 and occurs nowhere else.

    `bound`: a string of digits must be shorter, so that every level of the recursion is.
    """
    if len(t) == 1:
        return np.zeros(1, dtype="int64")
    if symbols > 1024:
        base = int(np.ceil(np.sqrt(symbols)))
        if base > 1024 or 2 * len(t) + 1 > bound:
            return np.array(_by_names(t.tolist(), symbols), dtype="int64")
        digits = np.append(np.stack((t // base, t % base), axis=1).ravel() + 1, 0).astype("uint16")
        order = suffix_array(digits, base + 1)
        return order[(order % 2 == 0) & (order < 2 * len(t))] // 2
    t = t.astype("uint16")
    small = _smaller(t)
    sizes = np.bincount(t, minlength=symbols)
    left = np.flatnonzero(small[1:] & ~small[:-1]) + 1
    once = _induced(t, small, left, sizes)
    is_left = np.zeros(len(t), dtype=bool)
    is_left[left] = True
    order = once[is_left[once]]
    names, n = _names(t, left, order)
    if n == len(left):
        return _induced(t, small, order, sizes)
    inner = suffix_array(names, n, 0.9 * len(t))
    return _induced(t, small, left[inner], sizes)


def _names(t: np.ndarray, left: np.ndarray, order: np.ndarray) -> tuple[np.ndarray, int]:
    """Ranks of the leftmost-smaller substrings, in the order of the text; equal ones get equal ranks."""
    length = np.append(np.diff(left) + 1, 1)
    place = np.zeros(len(t), dtype="int64")
    place[left] = np.arange(len(left))
    a, b = order[:-1], order[1:]
    size = length[place[b]]
    differs = size != length[place[a]]
    live = np.flatnonzero(~differs)
    step = 0
    while len(live):
        apart = t[a[live] + step] != t[b[live] + step]
        differs[live[apart]] = True
        step += 1
        live = live[~apart]
        live = live[size[live] > step]
    rank = np.append(0, np.cumsum(differs))
    names = np.zeros(len(left), dtype="int64")
    names[place[order]] = rank
    return names, int(rank[-1]) + 1


def _by_names(t: list[int], symbols: int) -> list[int]:
    """The same sort, entry by entry, for many symbols."""
    n = len(t)
    if n == 1:
        return [0]
    small = bytearray(n)
    small[-1] = 1
    for i in range(n - 2, -1, -1):
        small[i] = t[i] < t[i + 1] or (t[i] == t[i + 1] and small[i + 1])
    sizes = [0] * symbols
    for x in t:
        sizes[x] += 1
    ends, total = [], 0
    for s in sizes:
        total += s
        ends.append(total)
    left = [i for i in range(1, n) if small[i] and not small[i - 1]]

    def induce(seeds: list[int]) -> list[int]:
        out = [-1] * n
        tail = ends[:]
        for i in reversed(seeds):
            tail[t[i]] -= 1
            out[tail[t[i]]] = i
        head = [e - s for e, s in zip(ends, sizes, strict=True)]
        for i in range(n):
            j = out[i] - 1
            if j >= 0 and not small[j]:
                out[head[t[j]]] = j
                head[t[j]] += 1
        tail = ends[:]
        for i in range(n - 1, -1, -1):
            j = out[i] - 1
            if j >= 0 and small[j]:
                tail[t[j]] -= 1
                out[tail[t[j]]] = j
        out[0] = n - 1
        return out

    is_left = bytearray(n)
    for i in left:
        is_left[i] = 1
    order = [i for i in induce(left) if is_left[i]]
    names, count = _names(np.array(t, dtype="int64"), np.array(left, dtype="int64"), np.array(order, dtype="int64"))
    if count == len(left):
        return induce(order)
    inner = suffix_array(names, count)
    return induce([left[i] for i in inner])


def common_prefixes(raw: np.ndarray, suffixes: np.ndarray, most: int, heads: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """For each place: the place before it in the suffix array (-1 for none), and their common prefix, `most` at most.

    `heads`: where parts begin. With them the prefixes are right as far as the end of their part, if none is longer than `most`.

    `raw` has a byte for each symbol but the sentinel. In the order of the text a common prefix is one less
    than the last place's, unless the bytes before both differ; only those places are compared.
    """
    n = len(raw)
    order = suffixes[1:]  # without the sentinel
    before = np.full(n, -1, dtype="int64")
    before[order[1:]] = order[:-1]
    free = np.ones(n, dtype=bool)
    inner = np.flatnonzero((before > 0) & (np.arange(n) > 0))
    free[inner] = raw[inner - 1] != raw[before[inner] - 1]
    if heads is not None:
        free[heads] = True
    length = np.zeros(n, dtype="int64")
    padded = np.concatenate((raw, np.zeros(most + 8, dtype="u1")))
    words = np.ndarray(shape=(n + most,), dtype="<u8", buffer=padded.data, strides=(1,))
    live = np.flatnonzero(free & (before >= 0))
    done = 0
    while len(live) and done < most:
        apart = words[live + done] ^ words[before[live] + done]
        same = apart == 0
        first = apart[~same]
        low = first & (~first + np.uint64(1))  # the lowest bit that differs
        length[live[~same]] = done + (np.log2(low.astype("float64")).astype("int64") >> 3)
        live, done = live[same], done + 8
        length[live] = done
    places = np.arange(n)
    source = np.maximum.accumulate(np.where(free, places, -1))
    length = np.where(before < 0, 0, length[source] - (places - source))
    # Beyond the end there is nothing.
    return before, np.minimum(np.maximum(length, 0), n - np.maximum(places, before))
