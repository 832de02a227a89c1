"""Hashed word shingles of whole texts, many texts at a time.

Words are maximal runs of other bytes than the space and \\x09 to \\x0D, with A-Z lower-cased. A word's hash is a
polynomial of its bytes, taken from running sums over the whole buffer and then mixed; a shingle's hash combines
those of its words. All arithmetic is on unsigned 64-bit integers and wraps.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

BASE = np.uint64(0x9E3779B97F4A7C15)
INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
BATCH = 1 << 18

_lower = np.arange(256, dtype=np.uint64)
_lower[65:91] += 32
_space = np.zeros(256, dtype=bool)
_space[[32, *range(9, 14)]] = True
_powers: list[np.ndarray] = []


def _tables(n: int = BATCH) -> list[np.ndarray]:
    """Powers of the base and of its inverse, to n at least; kept up to a batch's size."""
    if not _powers:
        _powers[:] = _made(BATCH)
    return _powers if n <= BATCH else _made(n)


def _made(n: int) -> list[np.ndarray]:
    return [np.cumprod(np.concatenate(([np.uint64(1)], np.full(n, b)))) for b in (BASE, INVERSE)]


def power(n: int) -> np.uint64:
    return np.uint64(pow(int(BASE), n, 1 << 64))


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _words(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Polynomials of the words in a buffer of at most about a batch, their lengths, and where they begin."""
    raw = np.frombuffer(data, dtype=np.uint8)
    inside = np.concatenate(([False], ~_space[raw], [False]))
    change = np.flatnonzero(inside[1:] != inside[:-1])
    starts, ends = change[::2], change[1::2]
    powers, inverse = _tables(len(raw))
    sums = np.concatenate(([np.uint64(0)], np.cumsum(_lower[raw] * powers[: len(raw)])))
    return (sums[ends] - sums[starts]) * inverse[starts], (ends - starts).astype(np.uint64), starts


def _long(data: bytes) -> np.ndarray:
    """Hashes of the words of one long text, piece by piece; a word that a cut goes through is put together again."""
    out, cut = [], None
    for at in range(0, len(data), BATCH):
        size = min(BATCH, len(data) - at)
        values, lengths, starts = _words(data[at : at + size])
        goes_on = len(starts) > 0 and starts[-1] + int(lengths[-1]) == size and at + size < len(data)
        if cut is not None and len(starts) and starts[0] == 0:
            values[:1] = cut[0] + power(int(cut[1][0])) * values[:1]
            lengths[:1] += cut[1]
        elif cut is not None:
            out.append(mix(cut[0] + cut[1]))
        cut = (values[-1:], lengths[-1:]) if goes_on else None
        n = len(values) - goes_on
        out.append(mix(values[:n] + lengths[:n]))
    return np.concatenate(out)


def word_hashes(texts: list[str | None]) -> Iterator[tuple[int, np.ndarray]]:
    """(place, hashes of its words) for every text, in order. Texts are hashed together up to a batch's bytes, and
    longer ones a batch at a time, so memory is bounded but for the hashes themselves."""
    held: list[bytes] = []
    first = size = 0

    def out() -> Iterator[tuple[int, np.ndarray]]:
        values, lengths, starts = _words(b"\n".join(held))
        hashes = mix(values + lengths)
        begins = np.cumsum([0] + [len(x) + 1 for x in held])
        cuts = np.searchsorted(starts, begins)
        for j in range(len(held)):
            yield first + j, hashes[cuts[j] : cuts[j + 1]]

    for k, text in enumerate(texts):
        data = (text or "").encode("utf-8", "surrogatepass")
        if held and size + len(data) > BATCH:
            yield from out()
            held, size = [], 0
        if len(data) > BATCH:
            yield k, _long(data)
            continue
        if not held:
            first = k
        held.append(data)
        size += len(data) + 1
    if held:
        yield from out()


def shingle_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """A hash for each run of n words, in order; of fewer words, one for the whole sequence."""
    if not len(words):
        return words
    n_own = min(n, len(words))
    count = len(words) - n_own + 1
    h = np.full(count, np.uint64(n_own))
    for j in range(n_own):
        h = h * BASE + words[j : j + count]
    return mix(h)


def shingle_rarity(words: np.ndarray, n: int, commonness: np.ndarray) -> np.ndarray:
    """The sum of the words' commonness, by their top bits, for each shingle."""
    if not len(words):
        return words
    n_own = min(n, len(words))
    count = len(words) - n_own + 1
    common = commonness[words >> np.uint64(64 - len(commonness).bit_length() + 1)].astype(np.uint64)
    total = np.zeros(count, dtype=np.uint64)
    for j in range(n_own):
        total += common[j : j + count]
    return total
