"""Suffix arrays by linear grouping along Lyndon prefixes.

Suffixes that share their Lyndon prefix (the longest Lyndon word that they start with) form a group.  The first phase
starts from groups by first symbol and takes them in descending order.  Each suffix of the group finds the previous
suffix of a smaller group by pointers; that suffix's prefix grows by one or more copies of the group's prefix, so it
moves behind the rest of its own group, further with more copies.  The second phase emits the suffixes in ascending
order: each emitted suffix gives the next place in their groups to the suffixes whose Lyndon prefix ends where it
starts, which are found along the same pointers.  Every suffix is moved and emitted a bounded number of times; nothing
is renamed and nothing recurses.
"""

from __future__ import annotations


def suffix_array(text: list[int]) -> list[int]:
    """Starts of the suffixes in ascending order.  The last symbol must be smaller than all others and occur once."""
    n = len(text)
    order = sorted(range(n), key=text.__getitem__)
    group, place = [0] * n, [0] * n  # start of the suffix's group in ``order``, and its own place there
    sizes: dict[int, int] = {}
    start, last = 0, None
    for k, i in enumerate(order):
        if text[i] != last:
            start, last = k, text[i]
            sizes[start] = 0
        group[i], place[i] = start, k
        sizes[start] += 1
    prev = [-1] * n
    end = n
    while end:
        g = group[order[end - 1]]
        copies: dict[int, int] = {}
        for i in order[g:end] if end - g < 2 else sorted(order[g:end]):
            j = i - 1
            while j >= 0 and group[j] > g:
                j = prev[j]
            if j >= 0 and group[j] == g:
                j = prev[j]
            prev[i] = j
            if j >= 0:
                copies[j] = copies.get(j, 0) + 1
        end = g
        if len(copies) == 1:
            (p,) = copies
            h = group[p]
            if sizes[h] > 1:
                to = h + sizes[h] - 1
                _swap(order, place, place[p], to)
                sizes[h] -= 1
                sizes[to] = 1
                group[p] = to
        elif copies:
            _split(order, place, group, sizes, copies)
    out = [0] * n
    free = dict.fromkeys(sizes, 0)
    for s in sizes:
        free[s] = s
    done = [False] * n
    out[0] = n - 1
    done[n - 1] = True
    for k in range(n):
        j = out[k] - 1
        while j >= 0 and not done[j]:
            g = group[j]
            at = free[g]
            out[at] = j
            free[g] = at + 1
            done[j] = True
            j = prev[j]
    return out


def _swap(order: list[int], place: list[int], a: int, b: int) -> None:
    if a != b:
        x, y = order[a], order[b]
        order[a], order[b] = y, x
        place[x], place[y] = b, a


def _split(order: list[int], place: list[int], group: list[int], sizes: dict[int, int], copies: dict[int, int]) -> None:
    """Move each suffix that grew behind the rest of its group, those that grew by more copies further."""
    tail: dict[int, int] = {}
    made: dict[tuple[int, int], int] = {}
    for p in sorted(copies, key=copies.__getitem__, reverse=True):
        h = group[p]
        to = tail.get(h)
        if to is None:
            to = h + sizes[h]
        tail[h] = to = to - 1
        _swap(order, place, place[p], to)
        made[h, copies[p]] = to
    old, top = {h: sizes[h] for h in tail}, {}
    for (h, _), s in sorted(made.items(), key=lambda x: -x[1]):
        sizes[s] = top.get(h, h + old[h]) - s
        top[h] = s
    for h, first in tail.items():
        if first > h:
            sizes[h] = first - h
    for p, s in [(p, made[group[p], copies[p]]) for p in copies]:
        group[p] = s


def repeated(text: list[int], starts, length: int) -> list[list[int]]:
    """Groups of two or more of ``starts`` (a set) whose next ``length`` symbols are equal; text as in ``suffix_array``."""
    out, run, last = [], [], None
    for i in suffix_array(text):
        if i not in starts:
            continue
        own = text[i : i + length]
        if own == last:
            run.append(i)
        else:
            if len(run) > 1:
                out.append(run)
            run, last = [i], own
    if len(run) > 1:
        out.append(run)
    return out
