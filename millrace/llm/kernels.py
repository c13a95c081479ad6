"""Vectorised text kernels on numpy arrays: many documents at a time, no Python loop over words or bytes."""

from __future__ import annotations

import numpy as np

U64 = np.uint64
#: Odd base of the polynomial word hash, and its inverse modulo 2**64.
BASE = 0x9E3779B97F4A7C15 | 1
INVERSE = pow(BASE, -1, 1 << 64)

_powers: dict[str, np.ndarray] = {}
#: Powers that a worker keeps.
KEPT_POWERS = (1 << 22) + 1


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and BASE**-i for i < n, modulo 2**64."""
    def table(base: int, size: int) -> np.ndarray:
        row = np.full(size, base, U64)
        row[0] = 1
        return np.multiply.accumulate(row)

    if n > KEPT_POWERS:  # not kept for the life of a worker
        return table(BASE, n), table(INVERSE, n)
    if len(_powers.get("up", ())) < n:
        size = min(KEPT_POWERS, max(n, 1 << 20))
        _powers["up"], _powers["down"] = table(BASE, size), table(INVERSE, size)
    return _powers["up"][:n], _powers["down"][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def seeds(n: int, seed: int) -> np.ndarray:
    """n odd 64-bit multipliers."""
    return mix(np.arange(1, n + 1, dtype=U64) * U64(0xD1342543DE82EF95) + U64(seed)) | U64(1)


def chunks(texts, limit: int = 1 << 20):
    """(first index, list of bytes) for runs of texts of about ``limit`` bytes; null counts as empty."""
    run: list[bytes] = []
    first = size = 0
    for i, text in enumerate(texts):
        run.append(raw := b"" if text is None else text.encode("utf-8", "surrogatepass"))
        size += len(raw)
        if size >= limit or len(run) >= 20_000:
            yield first, run
            run, first, size = [], i + 1, 0
    if run:
        yield first, run


def joined(run: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts with one line feed after each, and where each text starts (one more entry at the end)."""
    data = np.frombuffer(b"\n".join(run) + b"\n", np.uint8)
    starts = np.zeros(len(run) + 1, np.int64)
    np.cumsum([len(x) + 1 for x in run], out=starts[1:])
    return data, starts


def lower(data: np.ndarray) -> np.ndarray:
    """A-Z in lower case; other bytes stay."""
    return data + ((data >= 65) & (data <= 90)).astype(np.uint8) * np.uint8(32)


def space(data: np.ndarray) -> np.ndarray:
    """True at 0x20 and 0x09 to 0x0D."""
    return (data == 32) | ((data >= 9) & (data <= 13))


def runs(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of True."""
    edge = np.flatnonzero(np.diff(np.concatenate(([False], mask, [False])).astype(np.int8)))
    return edge[::2], edge[1::2]


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """P with P[j] - P[i] = sum of (byte + 1) * BASE**place over i <= place < j."""
    up, _ = powers(len(data) + 1)
    out = np.zeros(len(data) + 1, U64)
    np.cumsum((data.astype(U64) + U64(1)) * up[:-1], out=out[1:])
    return out


def range_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of data[start:end], independent of where it stands."""
    _, down = powers(len(prefix))
    return mix((prefix[end] - prefix[start]) * down[start])


#: Bytes that are hashed at once; a longer run goes in segments that end at white space.
SEGMENT = 1 << 22
WHITE = np.isin(np.arange(256), [32, *range(9, 14)])


def word_hashes(run: list[bytes], blank: np.ndarray = WHITE) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every lower-cased word of every text, in order, and for each text where its words start.

    blank: which bytes separate words.  Memory beyond the run itself is that of a segment, or of the longest word.
    """
    data, starts = joined(run)
    hashes, begins = [], []
    a = 0
    while a < len(data):
        b = min(len(data), a + SEGMENT)
        if b < len(data):
            gap = np.flatnonzero(blank[data[a:b]])
            step = SEGMENT
            while not len(gap) and b < len(data):  # a word that fills the segment
                step *= 2
                b = min(len(data), a + step)
                gap = np.flatnonzero(blank[data[a:b]])
            b = a + int(gap[-1]) + 1 if len(gap) else b
        part = lower(data[a:b])
        begin, end = runs(~blank[part])
        hashes.append(range_hash(prefix_hash(part), begin, end))
        begins.append(begin + a)
        a = b
    return np.concatenate(hashes), np.searchsorted(np.concatenate(begins), starts)


def shingle_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """Hash of each run of n words; of the whole sequence if it is shorter; none without words."""
    if not len(words):
        return words
    n = min(n, len(words))
    out = np.full(len(words) - n + 1, n, U64)
    for i in range(n):
        out = out * U64(BASE) + words[i : len(words) - n + 1 + i]
    return mix(out)


def shingle_sets(texts, n: int):
    """For each text the sorted array of distinct shingle hashes."""
    for _, run in chunks(texts):
        words, at = word_hashes(run)
        for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
            yield np.unique(shingle_hashes(words[a:b], n))
