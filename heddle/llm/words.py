"""Hashes of words, of windows of words and of whole texts, over batches of texts at a time.

A hash has two halves of 64 bits. A word's is taken eight bytes at a time, a window's from those of shorter
windows, each time by a multiplication, a sum and a mixing step that is not linear, so that no pattern of
repeated letters or words cancels. Long words and whole texts take BLAKE2b digests. Of 10**13 different windows
two share both halves with a probability of about 10**-13, so that equal hashes count as equal words.
"""

from __future__ import annotations

from hashlib import blake2b

import numpy as np

BLANKS = np.zeros(256, bool)
BLANKS[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_SEGMENT = 1 << 18  # bytes taken apart at a time
_LONG = 128  # bytes; longer words are hashed one by one
_SEEDS = [np.uint64(0xD6E8FEB86659FD93), np.uint64(0xA0761D6478BD642F)]
_FACTORS = [np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)]


def mix(h: np.ndarray) -> np.ndarray:
    """The finishing step of SplitMix64."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _segments(texts: list[bytes]):
    """Stretches of the texts, each ending between words: lists of (text number, stretch)."""
    held, size = [], 0
    for k, text in enumerate(texts):
        at = 0
        if len(text) > _SEGMENT and held:  # words come in the order of texts
            yield held
            held, size = [], 0
        while len(text) - at > _SEGMENT:
            stop = at + _SEGMENT
            while stop < len(text) and not BLANKS[text[stop]]:
                stop += 1
            yield [(k, text[at:stop])]
            at = stop
        rest = text[at:] if at else text
        if size + len(rest) > _SEGMENT and held:
            yield held
            held, size = [], 0
        held.append((k, rest))
        size += len(rest)
    if held:
        yield held


def _long_word(word: bytes) -> np.ndarray:
    return np.frombuffer(blake2b(word, digest_size=16).digest(), np.uint64)


def _hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, which: tuple[int, ...]) -> list[np.ndarray]:
    """The wanted halves for each data[start:end]; ``data`` goes on for eight bytes or more after the last end."""
    lanes = np.lib.stride_tricks.as_strided(data[:8].view(np.uint64), (len(data) - 7,), (1,))  # eight bytes from each place on
    sizes = ends - starts
    out = [mix(sizes.astype(np.uint64) + _SEEDS[half]) for half in which]
    short = np.flatnonzero(sizes <= _LONG)
    for at in range(0, _LONG, 8):
        short = short[sizes[short] > at]
        if not len(short):
            break
        lane = lanes[starts[short] + at]
        unused = np.maximum(at + 8 - sizes[short], 0).astype(np.uint64) * np.uint64(8)
        lane = lane << unused  # the first bytes are the low ones
        for hashes, half in zip(out, which):
            hashes[short] = mix(hashes[short] * _FACTORS[half] + lane)
    for k in np.flatnonzero(sizes > _LONG):
        digest = _long_word(data[starts[k] : ends[k]].tobytes())
        for hashes, half in zip(out, which):
            hashes[k] = digest[half]
    return out


def word_hashes(texts: list[bytes], which: tuple[int, ...] = (0,)) -> tuple[list[np.ndarray], np.ndarray]:
    """For each of the wanted halves (0, 1) the hashes of all words in order; and how many words each text has."""
    out: list[list[np.ndarray]] = [[] for _ in which]
    counts = np.zeros(len(texts), np.int64)
    for segment in _segments(texts):
        data = np.frombuffer(b" ".join(s for _, s in segment) + b" " * 9, np.uint8)
        blank = BLANKS[data]
        edge = np.empty(len(data), bool)
        edge[0] = not blank[0]
        edge[1:] = blank[1:] != blank[:-1]
        places = np.flatnonzero(edge)
        starts, ends = places[0::2], places[1::2]
        limits = np.cumsum([len(s) + 1 for _, s in segment])
        np.add.at(counts, [k for k, _ in segment], np.diff(np.searchsorted(starts, limits), prepend=0))
        for hashes, found in zip(out, _hashes(data, starts, ends, which)):
            hashes.append(found)
    return [np.concatenate(h) if h else np.zeros(0, np.uint64) for h in out], counts


def window_hashes(words: np.ndarray, size: int, which: int = 0) -> np.ndarray:
    """The hash of words[i:i + size] for each i; windows may run across texts."""
    if len(words) < size:
        return np.zeros(0, np.uint64)
    # windows of 1, 2, 4 and so on words; those that add up to the size are put together
    power, width, whole, done = words, 1, None, 0
    while True:
        if size & width:
            if whole is None:
                whole = power
            else:
                n = len(words) - done - width + 1
                whole = mix(whole[:n] * _FACTORS[which] + power[done : done + n])
            done += width
        if done == size:
            return whole if size > 1 else mix(words)
        power = mix(power[:-width] * _FACTORS[which] + power[width:])
        width *= 2


def window_starts(counts: np.ndarray, size: int) -> np.ndarray:
    """Places, among all words, where a window of one text starts."""
    n = int(counts.sum())
    ends = np.repeat(np.cumsum(counts), counts)
    return np.flatnonzero(np.arange(n) + size <= ends)


def text_hashes(texts: list[bytes]) -> np.ndarray:
    """In a row per text the two halves of the hash of its words, whatever separates them; zeros for a text without words."""
    out = np.zeros((len(texts), 2), np.uint64)
    for k, text in enumerate(texts):
        words = text.split()
        if words:
            out[k] = np.frombuffer(blake2b(b" ".join(words), digest_size=16).digest(), np.uint64)
    return out
