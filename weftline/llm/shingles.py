"""Sets of word shingles as sorted 64-bit hashes, from Arrow buffers with numpy."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from .common import ship, worker_cache

ship(__name__)

WORDS = 5
CHUNK = 1 << 20
U = np.uint64
_rng = np.random.default_rng(7)
_space = np.zeros(256, dtype=bool)
_space[[0x20, *range(0x09, 0x0E)]] = True
_code = _rng.integers(1, 1 << 63, 256, dtype=np.uint64)
_code[ord("A") : ord("Z") + 1] = _code[ord("a") : ord("z") + 1]
BASE = 0x9E3779B97F4A7C15 | 1
UNBASE = pow(BASE, -1, 1 << 64)
STEP = 0xD6E8FEB86659FD93


def mix64(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> U(33))
    x = x * U(0xFF51AFD7ED558CCD)
    x = x ^ (x >> U(33))
    x = x * U(0xC4CEB9FE1A85EC53)
    return x ^ (x >> U(33))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE to the powers 0 to n, and the inverses."""
    kept = worker_cache()
    if "shingle_up" not in kept or len(kept["shingle_up"]) <= n:
        size = max(n + 1, CHUNK + 1)
        for key, base in (("shingle_up", BASE), ("shingle_down", UNBASE)):
            steps = np.full(size, base, dtype=np.uint64)
            steps[0] = 1
            kept[key] = np.cumprod(steps)
    return kept["shingle_up"], kept["shingle_down"]


def word_hashes(data: np.ndarray, starts: np.ndarray, space: np.ndarray = _space) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of a chunk of bytes, and where each starts; starts: where texts begin, which ends a word as a space does; space: of each byte, whether it ends words."""
    n = len(data)
    word = ~space[data]
    first = word.copy()
    first[1:] &= ~word[:-1]
    begin = starts[starts < n]
    first[begin] = word[begin]
    at = np.flatnonzero(first)
    if not len(at):
        return np.zeros(0, dtype=np.uint64), at
    last = word.copy()
    last[:-1] &= ~word[1:]
    cutting = begin[begin > 0] - 1
    last[cutting] |= word[cutting]
    end = np.flatnonzero(last) + 1
    up, down = powers(n)
    sums = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum(_code[data] * up[:n], out=sums[1:])
    return mix64((sums[end] - sums[at]) * down[at] + (end - at).astype(np.uint64)), at


def texts_of(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Chunks of whole texts: first row, row after the last, bytes, starts in them. Null texts are empty."""
    column = column.fill_null("") if column.null_count else column
    column = column.cast(pa.large_string()) if column.type != pa.large_string() else column
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2], dtype=np.uint8) if column.buffers()[2] else np.zeros(0, dtype=np.uint8)
    row = 0
    while row < len(column):
        to = max(row + 1, int(np.searchsorted(offsets, offsets[row] + CHUNK, side="right")) - 1)
        yield row, to, data[offsets[row] : offsets[to]], offsets[row : to + 1] - offsets[row]
        row = to


def words_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of a chunk of texts, and the number of words before each text's first. A text longer than CHUNK is hashed in pieces cut at spaces."""
    if len(data) <= 2 * CHUNK:
        found, at = word_hashes(data, offsets[:-1])
        return found, np.searchsorted(at, offsets)
    parts, start = [], 0
    while start < len(data):  # one text alone
        end = min(len(data), start + CHUNK)
        while end < len(data) and not _space[data[end]]:
            ahead = np.flatnonzero(_space[data[end : end + CHUNK]])
            end = end + int(ahead[0]) if len(ahead) else min(len(data), end + CHUNK)
        parts.append(word_hashes(data[start:end], np.zeros(1, dtype=np.int64))[0])
        start = end
    found = np.concatenate(parts)
    return found, np.array([0, len(found)])


def shingle_sets(column: pa.Array, words: int = WORDS) -> Iterator[np.ndarray]:
    """For each text the sorted distinct hashes of its shingles: of all words at once if there are fewer, none without words."""
    weights = np.array([pow(STEP, k, 1 << 64) for k in range(words)], dtype=np.uint64)
    for _, _, data, offsets in texts_of(column):
        found, before = words_of(data, offsets)
        whole = np.zeros(max(0, len(found) - words + 1), dtype=np.uint64)
        for k in range(words):
            whole += found[k : k + len(whole)] * weights[k]
        whole = mix64(whole)
        for a, b in zip(before[:-1], before[1:], strict=True):
            if b - a >= words:
                yield np.unique(whole[a : b - words + 1])
            elif b > a:
                yield mix64((found[a:b] * weights[: b - a]).sum(keepdims=True) + U(b - a))
            else:
                yield np.zeros(0, dtype=np.uint64)
