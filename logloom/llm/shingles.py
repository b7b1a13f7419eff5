"""64-bit hashes of words and word shingles, for whole texts, in numpy."""

import hashlib

import numpy as np

_CHUNK = 1 << 20
_LONG_WORD = 1 << 16
_random = np.random.default_rng(20240229)
_VALUE = _random.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_VALUE[65:91] = _VALUE[97:123]  # A-Z count as a-z
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_STEP = np.uint64(0x9E3779B97F4A7C15)
_PLACES = _random.integers(1, 1 << 63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _powers(n: int, step: int) -> np.ndarray:
    out = np.full(n, step & (1 << 64) - 1, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


_UP = _powers(_CHUNK + _LONG_WORD + 2, int(_STEP))
_DOWN = _powers(_CHUNK + _LONG_WORD + 2, pow(int(_STEP), -1, 1 << 64))


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _spans(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    edge = np.diff(np.concatenate([[True], _SPACE[data], [True]]).astype(np.int8))
    return np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)


def word_hashes(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(hash, first byte) of each word of a buffer, a stretch of about a megabyte at a time."""
    hashes, places, begin = [], [], 0
    while begin < len(text):
        end = begin + _CHUNK
        while end < len(text) and not _SPACE[text[end]]:
            end += 1
        data = np.frombuffer(text, np.uint8, count=min(end, len(text)) - begin, offset=begin)
        first, last = _spans(data)
        length = last - first
        if len(data) < len(_UP):
            sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_VALUE[data] * _UP[: len(data)], dtype=np.uint64)])
            found = mix((sums[last] - sums[first]) * _DOWN[first] + length.astype(np.uint64))
        else:
            found = np.zeros(len(first), np.uint64)
            for i in np.flatnonzero(length <= _LONG_WORD):
                word = data[first[i] : last[i]]
                found[i] = mix(np.array([(_VALUE[word] * _UP[: len(word)]).sum(dtype=np.uint64) + np.uint64(len(word))]))[0]
        for i in np.flatnonzero(length > _LONG_WORD):
            word = data[first[i] : last[i]].tobytes().lower()  # of bytes: ASCII only
            found[i] = int.from_bytes(hashlib.blake2b(word, digest_size=8).digest(), "little")
        hashes.append(found)
        places.append(first + begin)
        begin = end
    none = np.zeros(0, np.uint64)
    return np.concatenate([none, *hashes]), np.concatenate([np.zeros(0, np.int64), *places])


def shingle_sets(rows: list[str], width: int) -> list[np.ndarray]:
    """The ascending distinct hashes of each text's ``width``-word shingles.

    A text of fewer words has one shingle, all of its words; one without words has none.
    """
    encoded = [t.encode() for t in rows]
    words, places = word_hashes(b"\n".join(encoded))
    ends = np.cumsum([len(b) + 1 for b in encoded])
    stops = np.searchsorted(places, ends)
    out, begin = [], 0
    whole = np.zeros(0, np.uint64)
    if len(words) >= width:
        count = len(words) - width + 1
        whole = mix(sum((words[k : k + count] * _PLACES[k] for k in range(width)), np.zeros(count, np.uint64)))
    for end in stops:
        n = end - begin
        if n >= width:
            found = np.sort(whole[begin : end - width + 1])
            found = found[np.concatenate([[True], found[1:] != found[:-1]])]
        elif n:
            found = mix((words[begin:end] * _PLACES[:n]).sum(keepdims=True, dtype=np.uint64) + np.uint64(n) * _PLACES[63])
        else:
            found = np.zeros(0, np.uint64)
        out.append(found)
        begin = end
    return out
