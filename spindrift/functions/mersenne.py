"""The Mersenne Twister that seeded draws come from, for columns of seeds and for places far ahead in one stream.

A task can begin anywhere in a stream: the words obey a linear recurrence, so the state many steps ahead is the
exclusive-or of early states that the remainder of a power of x by the recurrence's polynomial names.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
from numpy.lib.stride_tricks import sliding_window_view

# Fixed values of the generator: words, distance in the recurrence, its degree, and its constants.
WORDS, MIDDLE, DEGREE = 624, 397, 19937
TWIST, UPPER, LOWER = 0x9908B0DF, 0x80000000, 0x7FFFFFFF
FIRST_SEED, FIRST_FACTOR, KEY_FACTOR, LAST_FACTOR = 19650218, 1812433253, 1664525, 1566083941
#: Seeds worked off together.
TOGETHER = 4_096


@lru_cache(maxsize=1)
def _base() -> np.ndarray:
    """The words that seeding by a key starts from."""
    out = [FIRST_SEED]
    for i in range(1, WORDS):
        out.append((FIRST_FACTOR * (out[-1] ^ (out[-1] >> 30)) + i) & 0xFFFFFFFF)
    return np.array(out, np.uint32)


def tempered(y: np.ndarray) -> np.ndarray:
    y = y ^ (y >> np.uint32(11))
    y = y ^ ((y << np.uint32(7)) & np.uint32(0x9D2C5680))
    y = y ^ ((y << np.uint32(15)) & np.uint32(0xEFC60000))
    return y ^ (y >> np.uint32(18))


def first_outputs(seeds: np.ndarray, n: int) -> np.ndarray:
    """The first ``n`` (at most 227) 32-bit outputs of the standard generator for each seed, a non-negative
    64-bit integer: an array (n, seeds)."""
    seeds = np.asarray(seeds, np.uint64)
    low, high = (seeds & np.uint64(0xFFFFFFFF)).astype(np.uint32), (seeds >> np.uint64(32)).astype(np.uint32)
    two = high > 0
    key = [low, np.where(two, high + np.uint32(1), low)]  # a key of one word is added again and again
    words = np.repeat(_base()[:, None], len(seeds), axis=1)
    place = 1
    for step in range(WORDS):
        before = words[place - 1]
        words[place] = (words[place] ^ ((before ^ (before >> np.uint32(30))) * np.uint32(KEY_FACTOR))) + key[step % 2]
        place += 1
        if place == WORDS:
            words[0], place = words[-1], 1
    for _ in range(WORDS - 1):
        before = words[place - 1]
        words[place] = (words[place] ^ ((before ^ (before >> np.uint32(30))) * np.uint32(LAST_FACTOR))) - np.uint32(place)
        place += 1
        if place == WORDS:
            words[0], place = words[-1], 1
    words[0] = UPPER
    y = (words[:n] & np.uint32(UPPER)) | (words[1 : n + 1] & np.uint32(LOWER))
    return tempered(words[MIDDLE : MIDDLE + n] ^ (y >> np.uint32(1)) ^ (y & np.uint32(1)) * np.uint32(TWIST))


def first_below(seeds: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """For each seed and size what the standard generator draws first from ``range(size)``: the first output
    whose leading bits are below the size."""
    seeds, sizes = np.asarray(seeds, np.uint64), np.asarray(sizes, np.int64)
    out = np.empty(len(seeds), np.int64)
    bits = np.array([int(s).bit_length() for s in np.unique(sizes)], np.uint32)[np.searchsorted(np.unique(sizes), sizes)] if len(sizes) else np.zeros(0, np.uint32)
    for first in range(0, len(seeds), TOGETHER):
        few = slice(first, first + TOGETHER)
        todo = np.arange(len(seeds))[few]
        for tries in (8, 227):  # one in 256 at most needs the second round
            made = first_outputs(seeds[todo], tries) >> (np.uint32(32) - bits[todo])
            good = made < sizes[todo]
            found = good.any(0)
            out[todo[found]] = made[good.argmax(0), np.arange(len(todo))][found]
            todo = todo[~found]
            if not len(todo):
                break
        else:
            raise ArithmeticError("no draw in 227 outputs")
    return out


def start(seed: int) -> np.ndarray:
    """The words of numpy's legacy generator for a seed, before its first output."""
    return np.random.RandomState(seed).get_state()[1]


def at(words: np.ndarray) -> np.random.RandomState:
    """The generator that goes on from these words."""
    out = np.random.RandomState()
    out.set_state(("MT19937", words, WORDS))
    return out


def outputs(generator: np.random.RandomState, n: int) -> np.ndarray:
    """Its next 32-bit outputs."""
    return generator.randint(0, 1 << 32, size=n, dtype=np.uint32)


def stream_words(words: np.ndarray, n: int) -> np.ndarray:
    """At least ``n`` words of the recurrence from these on, untempered."""
    out, generator = [words], at(words)
    while len(out) * WORDS < n:
        outputs(generator, WORDS)
        out.append(generator.get_state()[1])
    return np.concatenate(out)


@lru_cache(maxsize=1)
def polynomial() -> int:
    """The recurrence's polynomial over two elements, bit i for x to the i: the shortest recurrence of one bit of
    the stream (Berlekamp and Massey)."""
    bits = (stream_words(start(1), 2 * DEGREE + 2)[1:] & 1).tolist()
    now, last, length, since, seen = 1, 1, 0, 1, 0
    for n, bit in enumerate(bits[: 2 * DEGREE]):
        seen = seen << 1 | bit
        if (now & seen).bit_count() & 1:
            if 2 * length <= n:
                now, last, length, since = now ^ last << since, now, n + 1 - length, 1
                continue
            now ^= last << since
        since += 1
    return int(bin(now)[2:].zfill(length + 1)[::-1], 2)


def reduced(p: int, by: int) -> int:
    """The remainder of one polynomial by another."""
    degree = by.bit_length()
    while (more := p.bit_length() - degree) >= 0:
        p ^= by << more
    return p


@lru_cache(maxsize=64)
def power_of_x(steps: int) -> int:
    """x to the ``steps`` by the recurrence's polynomial."""
    by, out = polynomial(), 1
    for bit in bin(steps)[2:]:
        out = reduced(int(bin(out)[2:], 4), by)  # a square has the same bits, spread
        if bit == "1":
            out = reduced(out << 1, by)
    return out


def ahead(words: np.ndarray, steps: int) -> np.ndarray:
    """The words ``steps`` outputs later."""
    if not steps:
        return words
    named = power_of_x(steps)
    bits = np.flatnonzero(np.unpackbits(np.frombuffer(named.to_bytes(DEGREE // 8 + 1, "little"), np.uint8), bitorder="little"))
    windows = sliding_window_view(stream_words(words, DEGREE + WORDS), WORDS)
    return np.bitwise_xor.reduce(windows[bits], axis=0)
