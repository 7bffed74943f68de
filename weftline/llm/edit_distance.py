"""Banded bit-parallel edit distance: a column of 2k + 1 cells around the diagonal is two machine words of vertical differences."""

from __future__ import annotations

from .common import ship

ship(__name__)


def within(a: str, b: str, most: int) -> bool:
    """Whether the edit distance of a and b is at most `most`."""
    if abs(len(a) - len(b)) > most:
        return False
    # what both share at either end changes nothing
    n, k = min(len(a), len(b)), 0
    while k < n and a[k : k + 64] == b[k : k + 64]:
        k += 64
    k = min(k, n)
    while k < n and a[k] == b[k]:
        k += 1
    a, b = a[k:], b[k:]
    n, k = min(len(a), len(b)), 0
    while k < n and a[len(a) - 1 - k] == b[len(b) - 1 - k]:
        k += 1
    a, b = a[: len(a) - k], b[: len(b) - k]
    if not a or not b or not most:
        return max(len(a), len(b)) <= most
    width = 2 * most + 1
    full, low = (1 << width) - 1, 1 << (width - 1)
    up, down = full & ~((1 << most) - 1), 0
    distance, slack = most, 2 * most
    for j, c in enumerate(b):
        equal = 0
        for i in range(max(0, j - most), min(len(a), j + most + 1)):
            if a[i] == c:
                equal |= 1 << (i - j + most)
        diagonal = ((((equal & up) + up) ^ up) | equal | down) & full
        right = (down | ~(diagonal | up)) & full
        left = diagonal & up
        distance += not diagonal & low
        if distance > most + slack:
            return False
        if j == len(b) - 1:
            up, down = ((left << 1) | ~(diagonal | (right << 1))) & full, diagonal & (right << 1) & full
        else:
            up, down = (left | ~((diagonal >> 1) | right)) & full, (diagonal >> 1) & right
    for i in range(len(a), len(b) + most):  # from the band's last row up to the last row of a
        bit = 1 << (i - len(b) + 1 + most)
        distance -= bool(up & bit) - bool(down & bit)
    return distance <= most
