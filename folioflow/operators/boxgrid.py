"""Boxes of one page in a grid of several levels, kept up to date while boxes merge.

A box lies in the level whose cells are at least as large as it, so it fills four
cells at most; a search looks at the cells that its region covers, level by level.
A level of which a region covers more cells than the level has filled is read
through its filled cells instead.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import floor, frexp

Box = tuple[float, float, float, float]


class BoxGrid:
    def __init__(self):
        self.levels: dict[int, dict[tuple[int, int], list[int]]] = {}
        self.boxes: dict[int, Box] = {}

    @staticmethod
    def _level(box: Box) -> int:
        return frexp(max(box[2] - box[0], box[3] - box[1], 1e-3))[1]  # the extent is at most 2 ** level

    @staticmethod
    def _span(box: Box, level: int) -> tuple[int, int, int, int]:
        side = 2.0 ** level
        return floor(box[0] / side), floor(box[1] / side), floor(box[2] / side), floor(box[3] / side)

    def add(self, key: int, box: Box) -> None:
        self.boxes[key] = box
        level = self._level(box)
        cells = self.levels.setdefault(level, {})
        x0, y0, x1, y1 = self._span(box, level)
        for x in range(x0, x1 + 1):
            for y in range(y0, y1 + 1):
                cells.setdefault((x, y), []).append(key)

    def remove(self, key: int) -> None:
        box = self.boxes.pop(key)
        level = self._level(box)
        cells = self.levels[level]
        x0, y0, x1, y1 = self._span(box, level)
        for x in range(x0, x1 + 1):
            for y in range(y0, y1 + 1):
                held = cells[x, y]
                held.remove(key)
                if not held:
                    del cells[x, y]

    def near(self, region: Box) -> Iterator[int]:
        """Keys of the boxes that share a point with the region or its edge; a key may come up to four times."""
        a0, b0, a1, b1 = region
        boxes = self.boxes
        for level, cells in self.levels.items():
            x0, y0, x1, y1 = self._span(region, level)
            if (x1 - x0 + 1) * (y1 - y0 + 1) > len(cells):
                found = [c for c in cells if x0 <= c[0] <= x1 and y0 <= c[1] <= y1]
            else:
                found = [(x, y) for x in range(x0, x1 + 1) for y in range(y0, y1 + 1) if (x, y) in cells]
            for cell in found:
                for key in cells[cell]:
                    c0, d0, c1, d1 = boxes[key]
                    if c0 <= a1 and c1 >= a0 and d0 <= b1 and d1 >= b0:
                        yield key


def without(region: Box, hole: Box) -> Iterator[Box]:
    """Up to four boxes that cover the region outside the hole."""
    x0, y0, x1, y1 = region
    h0, k0, h1, k1 = max(x0, hole[0]), max(y0, hole[1]), min(x1, hole[2]), min(y1, hole[3])
    if h0 >= h1 or k0 >= k1:
        yield region
        return
    if y0 < k0:
        yield x0, y0, x1, k0
    if k1 < y1:
        yield x0, k1, x1, y1
    if x0 < h0:
        yield x0, k0, h0, k1
    if h1 < x1:
        yield h1, k0, x1, k1
