"""Bounded lists of the first k rows of each group, on Arrow tables.

A task keeps at most k rows a group of what it has read, so what it writes
does not grow with its rows; lists of several tasks merge by the same rule.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


def first_k(rows: pa.Table, group: str, order: Sequence[str], k: int) -> pa.Table:
    """The first k rows of each value of ``group`` (a number), by the columns
    ``order`` (nulls first), in that order."""
    keys = [(c, "ascending") for c in (group, *order)]
    rows = rows.take(pc.sort_indices(rows, sort_keys=keys, null_placement="at_start"))
    return rows.filter(pa.array(places(rows[group].to_numpy()) < k))


def places(group: np.ndarray) -> np.ndarray:
    """Place of each row within its run of equal group values."""
    if not len(group):
        return np.zeros(0, np.int64)
    starts = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
    return np.arange(len(group)) - np.repeat(starts, np.diff(np.append(starts, len(group))))
