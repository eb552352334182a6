"""Hashes of all words of a text, in order, without a Python object for each word."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

#: Bytes of text that are hashed at once.
PIECE = 1 << 16
ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F], np.uint64)
#: A random number for each byte value, and powers of an odd number and of its inverse for the places in a piece of text.
BYTE_VALUES = np.random.default_rng(20250117).integers(0, 1 << 64, 256, dtype=np.uint64)
IS_SPACE = np.isin(np.arange(256), list(b" \t\n\x0b\x0c\r"))
POWERS, INVERSES = (np.cumprod(np.full(PIECE, p, np.uint64)) for p in (ODD[0], np.uint64(pow(int(ODD[0]), -1, 1 << 64))))


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * ODD[1]
    return h ^ (h >> np.uint64(29))


def _piece_words(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, first bytes) of the words of a piece: the sum over its bytes of value times power, from a running sum.

    The difference of the sums at a word's ends, divided by the power at its start, depends on the word alone.
    """
    data = np.frombuffer(raw, np.uint8)
    powers, inverses = POWERS, INVERSES
    if len(data) > len(powers):  # one very long word
        powers, inverses = (np.cumprod(np.full(len(data), p[0], np.uint64)) for p in (POWERS, INVERSES))
    space = np.concatenate([[True], IS_SPACE[data], [True]])
    first, last = np.flatnonzero(space[:-1] & ~space[1:]), np.flatnonzero(~space[:-1] & space[1:]) - 1
    if not len(first):
        return np.empty(0, np.uint64), first
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(BYTE_VALUES[data] * powers[:len(data)])])
    return mixed((sums[last + 1] - sums[first]) * inverses[first]), first


def long_words(raw: bytes) -> np.ndarray:
    """Hashes of the words of a text of any length, worked off in pieces that end between words."""
    out, start = [], 0
    while start < len(raw):
        end = min(len(raw), start + PIECE)
        if end < len(raw):
            cut = max(raw.rfind(bytes([c]), start, end) for c in b" \t\n\x0b\x0c\r")
            if cut < 0:  # a word longer than a piece
                found = [at for c in b" \t\n\x0b\x0c\r" if (at := raw.find(bytes([c]), end)) >= 0]
                cut = min(found, default=len(raw) - 1)
            end = cut + 1
        out.append(_piece_words(raw[start:end])[0])
        start = end
    return np.concatenate(out) if out else np.empty(0, np.uint64)


def texts_words(texts: list[str]) -> Iterator[np.ndarray]:
    """The hash of each word of each text, in order; short texts are worked off many at a time."""
    held, size = [], 0

    def done():
        hashes, first = _piece_words(b"\n".join(held))
        return np.split(hashes, np.searchsorted(first, np.cumsum([len(t) + 1 for t in held])[:-1]))

    for text in texts:
        raw = text.encode("utf-8", "surrogatepass").lower()
        if held and size + len(raw) >= PIECE:
            yield from done()
            held, size = [], 0
        if len(raw) >= PIECE:
            yield long_words(raw)
            continue
        held.append(raw)
        size += len(raw) + 1
    if held:
        yield from done()
