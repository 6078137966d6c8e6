"""Whole groups of rows inside Arrow tasks."""

import numpy as np
import pyarrow as pa


def whole_groups(batches, key: str):
    """One table per value of ``key``; rows of a value are consecutive, as after a sort by it."""
    held = []
    for batch in batches:
        if not batch.num_rows:
            continue
        codes = batch.column(key).dictionary_encode().indices.to_numpy(zero_copy_only=False)
        cuts = [0, *(np.flatnonzero(codes[1:] != codes[:-1]) + 1).tolist(), batch.num_rows]
        for begin, end in zip(cuts, cuts[1:]):
            part = batch.slice(begin, end - begin)
            if held and held[-1].column(key)[0] != part.column(key)[0]:
                yield pa.Table.from_batches(held)
                held = []
            held.append(part)
    if held:
        yield pa.Table.from_batches(held)


def ragged(starts, lengths):
    """Positions of runs laid end to end: run i begins at ``starts[i]`` and has ``lengths[i]`` places."""
    total = int(lengths.sum())
    return np.repeat(starts - (np.cumsum(lengths) - lengths), lengths) + np.arange(total)
