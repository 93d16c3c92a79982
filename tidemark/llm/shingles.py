"""64-bit hashes of words and word shingles, made for whole batches of texts at once with numpy.

A word's hash is a polynomial over its bytes, taken from prefix sums modulo 2**64 and then mixed, so a batch costs a
few passes over its bytes. Two different words or shingles of a corpus share a hash with a chance of about 2**-64.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

_P = np.uint64(0x9E3779B97F4A7C15 | 1)
_P_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_PIECE = 1 << 18
_powers: list[np.ndarray] = []


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse from 0 to n - 1."""
    if not _powers or len(_powers[0]) < n:
        with np.errstate(over="ignore"):
            _powers[:] = [np.concatenate([[np.uint64(1)], np.cumprod(np.full(max(n, 2 * _PIECE) - 1, p, np.uint64))]) for p in (_P, _P_INVERSE)]
    return _powers[0][:n], _powers[1][:n]


def _piece_words(raw: np.ndarray, lower: bool) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and starts of the words in bytes that neither begin nor end inside a word."""
    if lower:
        raw = raw + ((raw >= 65) & (raw <= 90)) * np.uint8(32)
    blank = (raw == 32) | ((raw >= 9) & (raw <= 13))
    edge = np.diff(np.concatenate([[True], blank, [True]]).view(np.int8))
    starts, ends = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    power, inverse = _power(len(raw) + 1)
    with np.errstate(over="ignore"):
        sums = np.concatenate([[np.uint64(0)], np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * power[: len(raw)])])
        value = (sums[ends] - sums[starts]) * inverse[starts]
        return _mix(value + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)), starts


def word_hashes(texts: list[str | None], lower: bool) -> Iterator[np.ndarray]:
    """For each text the hashes of its words in order. lower: A-Z count as a-z."""
    held: list[bytes] = []
    size = 0

    def flush() -> Iterator[np.ndarray]:
        joined = np.frombuffer(b"\n".join(held) + b"\n", np.uint8)
        hashes, starts = _piece_words(joined, lower)
        ends = np.cumsum([len(x) + 1 for x in held])
        yield from np.split(hashes, np.searchsorted(starts, ends[:-1]))

    for text in texts:
        raw = text.encode("utf-8", "surrogatepass") if isinstance(text, str) else b""
        if len(raw) > _PIECE:
            if held:
                yield from flush()
                held, size = [], 0
            yield _long(raw, lower)
            continue
        if held and size + len(raw) > _PIECE:
            yield from flush()
            held, size = [], 0
        held.append(raw)
        size += len(raw) + 1
    if held:
        yield from flush()


def _long(raw: bytes, lower: bool) -> np.ndarray:
    """The words of a text that is larger than a piece: it is cut at blanks, so that memory stays bounded by a piece."""
    out, at = [], 0
    while at < len(raw):
        end = min(at + _PIECE, len(raw))
        while end < len(raw) and raw[end] not in b" \t\n\x0b\x0c\r":
            end += 1
        out.append(_piece_words(np.frombuffer(raw[at:end], np.uint8), lower)[0])
        at = end
    return np.concatenate(out)


def shingle_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Hashes of the runs of k words; with fewer words the whole sequence counts as one run; without words, none."""
    if not len(words):
        return words
    width = min(k, len(words))
    with np.errstate(over="ignore"):
        total = np.full(len(words) - width + 1, np.uint64(width * 0x2545F4914F6CDD1D & (1 << 64) - 1))
        for i in range(width):
            total = _mix(total) + words[i : len(words) - width + 1 + i] * np.uint64(0x9FB21C651E98DF25)
        return _mix(total)
