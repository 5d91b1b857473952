"""Places of word windows in one long text, in linear time."""
from bisect import bisect_left

import numpy as np

# the characters of SPACE_CLASS, none of which lies beyond U+3000
_SPACES = np.array([c for c in range(0x3001) if chr(c).isspace()], dtype=np.uint32)
# odd base of the rolling hash; equal hashes are always verified on the text
_BASE = 0x9E3779B97F4A7C15
_MOD = 1 << 64


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base % _MOD, dtype=np.uint64)
    out[:1] = 1
    return np.cumprod(out, dtype=np.uint64)


def word_spans(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of every word of a text."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    solid = np.concatenate(([False], ~np.isin(codes, _SPACES), [False]))
    turns = np.flatnonzero(solid[1:] != solid[:-1])
    return turns[0::2], turns[1::2]


def _inner_hashes(words: list[str], sizes: np.ndarray, size: int) -> np.ndarray:
    """Hash of the words between the first and the last one of every full window."""
    codes = np.frombuffer(" ".join(words).encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64) + np.uint64(1)
    starts = np.concatenate(([0], np.cumsum(sizes + 1)[:-1]))
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(codes * _powers(_BASE, len(codes)), dtype=np.uint64)))
    first, last = starts[1:len(words) - size + 2], (starts + sizes)[size - 2:len(words) - 1]
    return (sums[last] - sums[first]) * _powers(pow(_BASE, -1, _MOD), len(codes))[first]


def window_places(text: str, size: int, step: int) -> list[int]:
    """1-based place of each window's first verbatim occurrence at or after the place before it, 0 for none.

    Windows are ``size`` words joined by one space and start at every ``step``-th word;
    after a window without a place the search starts at the front again. A full window can
    only occur where its inner words are whole words with single spaces between them, so
    places are looked up by the hash of the inner words and then compared with the text.
    Windows cut short by the end, fewer than ``size / step + 1``, are searched plainly.
    """
    starts, ends = word_spans(text)
    words = [text[a:b] for a, b in zip(starts.tolist(), ends.tolist())]
    n, full = len(words), len(words) - size + 1
    order, keys, hashes = np.zeros(0, np.int64), None, None
    if size >= 3 and full > 0:
        hashes = _inner_hashes(words, ends - starts, size)
        # joints[i]: one plain space between the words i and i + 1
        joints = np.array([text[e] == " " for e in ends[:-1].tolist()], dtype=np.int64) * (starts[1:] - ends[:-1] == 1)
        before = np.concatenate(([0], np.cumsum(joints)))
        order = np.flatnonzero(before[size - 1:] - before[:full] == size - 1)
        order = order[np.argsort(hashes[order], kind="stable")]
        keys = hashes[order]
    inner = starts.tolist()
    out, at = [], 0
    for s in range(0, n, step):
        body = " ".join(words[s:s + size])
        if keys is None or s >= full:
            place = text.find(body, at)
        else:
            place, head = -1, len(words[s]) + 1
            lo, hi = np.searchsorted(keys, hashes[s], "left"), np.searchsorted(keys, hashes[s], "right")
            for i in range(bisect_left(order, at, lo, hi, key=lambda j: inner[j + 1] - head), hi):
                if text.startswith(body, inner[order[i] + 1] - head):
                    place = inner[order[i] + 1] - head
                    break
        out.append(place + 1)
        at = max(0, place)
    return out
