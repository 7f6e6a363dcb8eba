"""Words and runs of words as 64-bit hashes in numpy, without a Python object a word."""

import re

import numpy as np
import xxhash

ODD = np.uint64(0x9E3779B97F4A7C15)
MIX = np.uint64(0xBF58476D1CE4E5B9)
#: Bytes hashed at once, and the length from which words are hashed one by one instead.
CHUNK, LONG = 1 << 18, 128
SPACE = re.compile(rb"[\x20\x09-\x0D]")
WORD = re.compile(rb"[^\x20\x09-\x0D]+")

_IS_WORD = np.ones(256, bool)
_IS_WORD[[32, *range(9, 14)]] = False
_BYTE = np.random.default_rng(5).integers(0, 2**64, 256, dtype=np.uint64) * _IS_WORD
_POWER = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(2 * CHUNK, ODD)]))
_INVERSE = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(2 * CHUNK, np.uint64(pow(int(ODD), -1, 2**64)))]))


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * MIX
    return h ^ (h >> np.uint64(29))


def _hashed(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """One hash a word, from differences of prefix sums of byte values times powers; words of LONG bytes by xxhash. Where words start and end."""
    if len(data) > 2 * CHUNK:  # holds one huge word
        found = [(m.start(), m.end()) for m in WORD.finditer(data)]
        h = [xxhash.xxh64_intdigest(data[i:j]) if j - i >= LONG else int(_hashed(data[i:j])[0][0]) for i, j in found]
        return np.array(h, np.uint64), *np.array(found, np.int64).reshape(-1, 2).T
    b = np.frombuffer(data, np.uint8)
    word = np.zeros(len(b) + 2, bool)
    word[1:-1] = _IS_WORD[b]
    starts, ends = np.flatnonzero(word[1:-1] & ~word[:-2]), np.flatnonzero(word[1:-1] & ~word[2:]) + 1
    sums = np.zeros(len(b) + 1, np.uint64)
    np.cumsum(_BYTE[b] * _POWER[: len(b)], out=sums[1:])
    lengths = ends - starts
    h = mixed((sums[ends] - sums[starts]) * _INVERSE[starts] + lengths.astype(np.uint64) * MIX)
    for i in np.flatnonzero(lengths >= LONG):
        h[i] = xxhash.xxh64_intdigest(data[starts[i] : ends[i]])
    return h, starts, ends


def placed_words(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the words [^\\x20\\x09-\\x0D]+ of UTF-8 bytes, in order, and the bytes at which they start and end."""
    out, i = [], 0
    while i < len(data):
        j = len(data)
        if j - i > CHUNK:
            space = SPACE.search(data, i + CHUNK)
            j = space.start() if space else j
        h, starts, ends = _hashed(data[i:j])
        out.append((h, starts + i, ends + i))
        i = j
    if not out:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    return tuple(np.concatenate(x) for x in zip(*out))


def word_hashes(data: bytes) -> np.ndarray:
    """Hashes of the words [^\\x20\\x09-\\x0D]+ of UTF-8 bytes, in order."""
    return placed_words(data)[0]


def run_hashes(words: np.ndarray, k: int, odd: np.uint64 = ODD) -> np.ndarray:
    """Hash of each run of k consecutive words; empty if there are fewer."""
    n = max(0, len(words) - k + 1)
    h, done, power, length = np.zeros(n, np.uint64), 0, words, 1
    while n and done < k:  # runs of 1, 2, 4, ... words, put together for the bits of k from the right
        if k & length:
            at = k - done - length
            h += power[at : at + n] * np.uint64(pow(int(odd), done, 2**64))
            done += length
        if done < k:
            power = power[:-length] * np.uint64(pow(int(odd), length, 2**64)) + power[length:]
            length *= 2
    return mixed(h)
