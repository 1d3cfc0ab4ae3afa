"""Word and shingle hashes of many texts at once, in NumPy.

Words are runs of bytes other than ASCII white space. A word's hash is a polynomial
of its bytes modulo 2**64, mixed; a shingle's is a weighted sum of its words', mixed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 2**64)
_WEIGHTS = np.array([pow(0xD6E8FEB86659FD93, k, 2**64) for k in range(1, 9)], dtype=np.uint64)
PIECE = 1 << 20


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """The finalizer of splitmix64."""
    with np.errstate(over="ignore"):
        z = x + np.uint64((0x9E3779B97F4A7C15 * (seed + 1)) % 2**64)
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return z ^ (z >> np.uint64(31))


class _Powers:
    up = np.ones(1, dtype=np.uint64)
    down = np.ones(1, dtype=np.uint64)

    @classmethod
    def of(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(cls.up) < n:
            with np.errstate(over="ignore"):
                for name, factor in (("up", _BASE), ("down", _INVERSE)):
                    each = np.full(max(n, 2 * _CHUNK, 2 * len(getattr(cls, name))), factor, dtype=np.uint64)
                    each[0] = 1
                    setattr(cls, name, np.cumprod(each, dtype=np.uint64))
        return cls.up[:n], cls.down[:n]


def runs(texts: list[str | None], size: int = PIECE) -> Iterator[tuple[int, int]]:
    """Spans of texts of about so many characters, one text at least."""
    start, total = 0, 0
    for n, t in enumerate(texts):
        total += len(t or "")
        if total >= size:
            yield start, n + 1
            start, total = n + 1, 0
    if start < len(texts):
        yield start, len(texts)


#: Bytes that are hashed at a time, so that what is computed of each byte stays in a core's cache.
_CHUNK = 1 << 16


def _hashed(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words in an array of bytes that begins and ends with white space, and where each word begins."""
    white = (x == 32) | ((x - np.uint8(9)) <= 4)
    edges = np.flatnonzero(white[:-1] != white[1:]) + 1
    starts, ends = edges[::2], edges[1::2]
    out = np.empty(len(starts), dtype=np.uint64)
    at = 0
    with np.errstate(over="ignore"):
        while at < len(starts):
            first = starts[at]
            to = max(at + 1, int(np.searchsorted(ends, first + _CHUNK, "right")))
            up, down = _Powers.of(int(ends[to - 1] - first) + 1)
            total = np.zeros(len(up), dtype=np.uint64)
            each = total[1:]
            each[:] = x[first : ends[to - 1]]
            each += np.uint64(1)
            each *= up[:-1]
            np.cumsum(each, out=each)
            s, e = starts[at:to] - first, ends[at:to] - first
            out[at:to] = (total[e] - total[s]) * down[s] + (e - s).astype(np.uint64)
            at = to
        return mix(out), starts


def word_hashes(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words in order, and for each text (and the end) where its words begin."""
    raw = [(t or "").encode("utf-8", "replace") for t in texts]
    hashes, starts = _hashed(np.frombuffer(b" " + b" ".join(raw) + b" ", dtype=np.uint8))
    return hashes, np.searchsorted(starts, np.cumsum([1, *[len(r) + 1 for r in raw]]))


def line_words(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all words in order, the line of each, and for each text (and the end) the number of its first line; lines are counted over all texts."""
    raw = b"\n".join([b"", *[(t or "").encode("utf-8", "replace") for t in texts], b""])
    x = np.frombuffer(raw, dtype=np.uint8)
    hashes, starts = _hashed(x)
    breaks = np.flatnonzero(x == 10)
    line = np.repeat(np.arange(len(breaks)), np.diff(np.searchsorted(starts, breaks), append=len(starts)))
    lines = np.array([(t or "").count("\n") + 1 for t in texts], dtype=np.int64)
    return hashes, line, np.concatenate([[0], np.cumsum(lines)])


def distinct(owner: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct (owner, hash) pairs in order of owner; owners are small numbers in order."""
    order = np.argsort((owner.astype(np.uint64) << np.uint64(40)) | (hashes >> np.uint64(24)))
    o, h = owner[order], hashes[order]
    same = (o[1:] == o[:-1]) & ((h[1:] ^ h[:-1]) >> np.uint64(24) == 0)
    if (same & (h[1:] != h[:-1])).any():  # hashes that agree in their high bits alone
        order = np.lexsort((hashes, owner))
        o, h = owner[order], hashes[order]
        same = (o[1:] == o[:-1]) & (h[1:] == h[:-1])
    new = np.concatenate([[True], ~same])[: len(o)]
    return o[new], h[new]


def shingles(texts: list[str | None], size: int = 5) -> list[np.ndarray]:
    """The sorted distinct shingles of each text: of so many words; of all its words where it has fewer; none where it has none."""
    out: list[np.ndarray] = []
    for a, z in runs(texts):
        words, at = word_hashes(texts[a:z])
        with np.errstate(over="ignore"):
            n = max(0, len(words) - size + 1)
            sums = np.zeros(n, dtype=np.uint64)
            for k in range(size):
                sums += words[k : k + n] * _WEIGHTS[k]
            mixed = mix(sums, 1)
            for s, e in zip(at[:-1], at[1:], strict=True):
                if e - s >= size:
                    out.append(np.unique(mixed[s : e - size + 1]))
                elif e > s:
                    out.append(mix(np.sum(words[s:e] * _WEIGHTS[: e - s], dtype=np.uint64, keepdims=True), 2))
                else:
                    out.append(np.empty(0, dtype=np.uint64))
    return out
