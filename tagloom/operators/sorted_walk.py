"""Walking a sorted partition in runs of whole groups, for operators that emit from sorted order."""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Sorted rows that are gathered before whole groups among them are worked off.
CHUNK = 1 << 18


def whole_groups(batches: Iterator[pa.RecordBatch], keys: list[int]) -> Iterator[tuple[list[np.ndarray], bool, bool]]:
    """Runs of rows that end where a group ends, as (columns, holds the partition's first row, holds its last row).

    A group is a run of equal values in the columns ``keys``, which hold no nulls. Memory is bounded by the larger of
    ``CHUNK`` rows and one group's part of the partition; every row is copied once or twice, however long its group. Every column becomes
    a numpy array; nulls of nullable columns must be marked by another column, as they come out with a filler.
    """
    held: list[list[np.ndarray]] = []  # pieces that end with the group that is open
    fresh: list[list[np.ndarray]] = []
    first, waiting = True, 0

    def filled(column: pa.Array) -> np.ndarray:
        if column.null_count:
            column = column.fill_null("" if pa.types.is_string(column.type) else False if pa.types.is_boolean(column.type) else 0)
        return column.to_numpy(zero_copy_only=False)

    def joined(pieces: list[list[np.ndarray]]) -> list[np.ndarray]:
        return pieces[0] if len(pieces) == 1 else [np.concatenate(x) for x in zip(*pieces)]

    def cut_of(chunk: list[np.ndarray]) -> int:
        """Where the last group of the chunk begins."""
        other = np.zeros(len(chunk[0]), bool)
        for k in keys:
            other |= chunk[k] != chunk[k][-1]
        return int(np.flatnonzero(other)[-1]) + 1 if other.any() else 0

    for b in batches:
        if not b.num_rows:
            continue
        fresh.append([filled(c) for c in b.columns])
        waiting += b.num_rows
        if waiting < CHUNK:
            continue
        chunk = joined(fresh)
        fresh, waiting = [], 0
        cut = cut_of(chunk)
        if cut:
            yield joined([*held, [x[:cut] for x in chunk]]), first, False
            held, first = [[x[cut:] for x in chunk]], False
        elif held and any(held[-1][k][-1] != chunk[k][0] for k in keys):
            yield joined(held), first, False
            held, first = [chunk], False
        else:
            held.append(chunk)
    if held or fresh:
        yield joined([*held, *fresh]), first, True
