"""Pairs inside groups of any size: groups are cut into chunks, chunks meet in tiles.

A tile task reports, per member, how many others it is linked to and the smallest member of
its linked set inside the tile. So links are counted exactly once, while a dense group of m
members leaves as m rows per tile instead of m * m pairs.
"""

from __future__ import annotations

import numpy as np

#: Members of a chunk at most; a tile holds two chunks, so its matrix stays within 16 MB.
CHUNK = 1024


def roots(linked: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Smallest id of each row's connected set; ``linked`` is a symmetric boolean matrix."""
    root = np.full(len(ids), -1, dtype=np.int64)
    done = np.zeros(len(ids), dtype=bool)
    degree = linked.any(axis=1)
    root[~degree] = ids[~degree]
    done[~degree] = True
    for start in np.flatnonzero(degree):
        if done[start]:
            continue
        member = np.zeros(len(ids), dtype=bool)
        member[start] = True
        front = np.array([start])
        while len(front):
            reached = linked[front].any(axis=0) & ~member
            member |= reached
            front = np.flatnonzero(reached)
        root[member] = ids[member].min()
        done |= member
    return root


def symmetric(block: np.ndarray) -> np.ndarray:
    """The square matrix of a block of left against right members."""
    n, m = block.shape
    out = np.zeros((n + m, n + m), dtype=bool)
    out[:n, n:] = block
    out[n:, :n] = block.T
    return out
