"""Stream the groups of a sorted partition, across the borders of Arrow batches."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd


def runs(keys: np.ndarray) -> np.ndarray:
    """Bounds of the runs of equal values: run i is [bounds[i], bounds[i + 1])."""
    if not len(keys):
        return np.zeros(1, np.int64)
    return np.concatenate(([0], np.flatnonzero(keys[1:] != keys[:-1]) + 1, [len(keys)]))


def sorted_groups(batches: Iterable[pd.DataFrame], key: str) -> Iterator[dict[str, np.ndarray]]:
    """Each group's columns as arrays; the partition must be sorted by ``key``."""
    held: list[dict[str, np.ndarray]] = []

    def joined() -> dict[str, np.ndarray]:
        return {c: np.concatenate([h[c] for h in held]) for c in held[0]}

    for pdf in batches:
        cols = {c: pdf[c].to_numpy() for c in pdf.columns}
        bounds = runs(cols[key])
        for lo, hi in zip(bounds[:-1], bounds[1:]):
            piece = {c: x[lo:hi] for c, x in cols.items()}
            if held and held[0][key][0] != piece[key][0]:
                yield joined()
                held = []
            held.append(piece)
    if held:
        yield joined()
