"""Pixels of a rendered page: runs of ink, their eight-neighbour components, and the accounting that proves them."""

from __future__ import annotations

import hashlib

import numpy as np

#: A pixel is ink if its darkest channel is not white; faint ink is at least this light.
FAINT = 224


def runs(rgb: np.ndarray) -> np.ndarray:
    """(row, first, last) of each horizontal run of ink, in reading order; rgb is height by width by 3."""
    ink = np.pad(rgb.min(axis=2) != 255, ((0, 0), (1, 1)))
    step = np.diff(ink.astype(np.int8), axis=1)
    row, first = np.nonzero(step == 1)
    _, end = np.nonzero(step == -1)
    return np.stack([row, first, end - 1], axis=1)


def components(found: np.ndarray) -> np.ndarray:
    """The component of each run, named by its first run; runs of neighbouring rows that touch, corners too, are one."""
    n = len(found)
    top = np.arange(n)

    def root(i: int) -> int:
        while top[i] != i:
            top[i] = top[top[i]]
            i = top[i]
        return i

    starts = np.searchsorted(found[:, 0], np.arange(found[-1, 0] + 2)) if n else np.zeros(1, dtype=int)
    for r in range(1, len(starts) - 1):
        i, j = starts[r - 1], starts[r]
        while i < starts[r] and j < starts[r + 1]:
            if found[i, 1] <= found[j, 2] + 1 and found[j, 1] <= found[i, 2] + 1:
                a, b = root(i), root(j)
                top[max(a, b)] = min(a, b)
            if found[i, 2] < found[j, 2]:
                i += 1
            else:
                j += 1
    return np.array([root(i) for i in range(n)], dtype=np.int64)


def observe(rgb: np.ndarray) -> dict:
    """Components with boxes and pixel counts, faint pixels, a digest, and whether all ink is accounted for once."""
    found = runs(rgb)
    names = components(found)
    length = found[:, 2] - found[:, 1] + 1 if len(found) else np.zeros(0, dtype=int)
    parts = []
    for name in np.unique(names):
        own = found[names == name]
        parts.append({"left": int(own[:, 1].min()), "top": int(own[:, 0].min()), "right": int(own[:, 2].max()) + 1, "bottom": int(own[:, 0].max()) + 1, "pixels": int(length[names == name].sum())})
    dark = rgb.min(axis=2)
    return {
        "components": parts,
        "ink": int((dark != 255).sum()),
        "faint": int(((dark != 255) & (dark >= FAINT)).sum()),
        "sha256": hashlib.sha256(np.ascontiguousarray(rgb).tobytes()).hexdigest(),
        "accounted": sum(p["pixels"] for p in parts) == int((dark != 255).sum()),
    }
