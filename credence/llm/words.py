"""Hashes of the words of many texts at once, in numpy."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

_U = np.uint64
#: Bytes that part words: space and the control characters 9 to 13.
WHITE = bytes([0x20, *range(0x09, 0x0E)])
#: White space and all ASCII that is neither a letter nor a digit.
NOT_WORD = bytes(b for b in range(128) if not chr(b).isalnum())
_BASE = 0x9E3779B97F4A7C15
_powers = [np.ones(1, _U), np.ones(1, _U)]


def mixed(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit mix (the finaliser of SplitMix64) of each number."""
    z = x + _U((_BASE * (seed + 1)) & 0xFFFFFFFFFFFFFFFF)
    z = (z ^ (z >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> _U(27))) * _U(0x94D049BB133111EB)
    return z ^ (z >> _U(31))


def _weights(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base, and of its inverse, modulo 2^64."""
    if len(_powers[0]) < n:
        size = max(n, 1 << 16)
        for i, base in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            steps = np.full(size, base, _U)
            steps[0] = 1
            _powers[i] = np.multiply.accumulate(steps)
    return _powers[0][:n], _powers[1][:n]


class Words:
    """Cuts texts into words, lower-casing A to Z, and hashes each word to 64 bits."""

    def __init__(self, breaks: bytes = WHITE):
        self.breaks = np.zeros(256, bool)
        self.breaks[list(breaks)] = True
        self.value = mixed(np.arange(256, dtype=_U), 99) | _U(1)
        self.value[65:91] = self.value[97:123]
        self.value[self.breaks] = 0

    def _hashes(self, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Hash and first byte of each word of a stretch that starts and ends between words."""
        broken = self.breaks[data]
        edge = np.flatnonzero(np.diff(np.concatenate([[True], broken, [True]]).view(np.int8)))
        starts, ends = edge[0::2], edge[1::2]
        up, down = _weights(len(data))
        sums = np.concatenate([np.zeros(1, _U), np.cumsum(self.value[data] * up, dtype=_U)])
        return mixed((sums[ends] - sums[starts]) * down[starts], 5), starts

    def of(self, texts: list[str | None], piece: int = 1 << 20) -> Iterator[tuple[int, np.ndarray]]:
        """(place, word hashes) of each text in order; a long text is hashed in pieces cut between words."""
        held, sizes, first = [], [], 0

        def flush():
            data = np.frombuffer(b" ".join(held) + b" ", np.uint8)
            hashes, starts = self._hashes(data)
            cuts = np.searchsorted(starts, np.concatenate([[0], np.cumsum(np.array(sizes) + 1)]))
            return [(first + i, hashes[cuts[i] : cuts[i + 1]]) for i in range(len(sizes))]

        for i, text in enumerate(texts):
            raw = text.encode() if text else b""
            if len(raw) > piece:
                if held:
                    yield from flush()
                held, sizes = [], []
                yield i, self._long(raw, piece)
                first = i + 1
                continue
            held.append(raw)
            sizes.append(len(raw))
            if sum(sizes) > piece:
                yield from flush()
                held, sizes, first = [], [], i + 1
        if held:
            yield from flush()

    def _long(self, raw: bytes, piece: int) -> np.ndarray:
        out, at, data = [], 0, np.frombuffer(raw, np.uint8)
        while at < len(data):
            end = min(len(data), at + piece)
            while end < len(data):  # on to the next break
                stop = np.flatnonzero(self.breaks[data[end : end + 4096]])
                if len(stop):
                    end += int(stop[0])
                    break
                end = min(len(data), end + 4096)
            out.append(self._hashes(data[at:end])[0])
            at = end
        return np.concatenate(out)


def shingles(words: np.ndarray, size: int = 4) -> np.ndarray:
    """Hashes of the distinct runs of ``size`` words, in ascending order; fewer words are one run, none none."""
    n = len(words)
    if n == 0:
        return np.zeros(0, _U)
    width = min(n, size)
    out = np.full(n - width + 1, width, _U)
    for k in range(width):
        out = mixed(out + words[k : n - width + 1 + k], k)
    return np.unique(out)
