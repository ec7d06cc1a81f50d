"""Z-order (Morton) keys: two coordinates interleaved bit by bit, so that near cells have near keys."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# (shift, mask) steps that put a gap behind every bit of a number below 2**31
_STEPS = [(16, 0x0000FFFF0000FFFF), (8, 0x00FF00FF00FF00FF), (4, 0x0F0F0F0F0F0F0F0F), (2, 0x3333333333333333), (1, 0x5555555555555555)]


def _spread(v: Column) -> Column:
    v = v.cast("long")
    for shift, mask in _STEPS:
        v = v.bitwiseOR(F.shiftleft(v, shift)).bitwiseAND(F.lit(mask))
    return v


def morton(x: Column, y: Column) -> Column:
    """Key of a cell; coordinates are non-negative and below 2**31."""
    return _spread(x).bitwiseOR(F.shiftleft(_spread(y), 1))


def ranges(x0: int, y0: int, x1: int, y1: int, most: int = 16) -> list[tuple[int, int]]:
    """Key ranges (inclusive) that cover the cells x0..x1, y0..y1, at most ``most`` of them.

    Quadrants inside the window become a range each; ranges with the smallest gaps between them are joined until few enough
    are left, so the cover may hold more cells, never fewer.
    """
    found: list[tuple[int, int]] = []
    bits = max(x1, y1, 1).bit_length()
    todo = [(0, 0, 0, bits)]
    while todo:
        key, left, top, level = todo.pop()
        side = (1 << level) - 1
        if left > x1 or top > y1 or left + side < x0 or top + side < y0:
            continue
        if level == 0 or (x0 <= left and left + side <= x1 and y0 <= top and top + side <= y1):
            found.append((key, key + (1 << 2 * level) - 1))
            continue
        half, quarter = 1 << (level - 1), 1 << 2 * (level - 1)
        todo += [(key + q * quarter, left + (q & 1) * half, top + (q >> 1) * half, level - 1) for q in range(4)]
    found.sort()
    joined = [found[0]] if found else []
    for a, b in found[1:]:
        if a == joined[-1][1] + 1:
            joined[-1] = joined[-1][0], b
        else:
            joined.append((a, b))
    while len(joined) > most:
        k = min(range(1, len(joined)), key=lambda i: joined[i][0] - joined[i - 1][1])
        joined[k - 1 : k + 1] = [(joined[k - 1][0], joined[k][1])]
    return joined
