"""Whole groups from a stream of key-sorted Arrow batches."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa


def whole_groups(batches: Iterable[pa.RecordBatch], key: str) -> Iterator[tuple[pa.Table, list[tuple[int, int]]]]:
    """Tables that hold only complete groups of equal ``key`` (a long), with
    the row range of each; holds one batch and one group at most."""
    held: list[pa.RecordBatch] = []

    def cut(table: pa.Table):
        k = table.column(key).to_numpy()
        at = [0, *(np.flatnonzero(k[1:] != k[:-1]) + 1).tolist(), len(k)]
        return table, list(zip(at[:-1], at[1:]))

    for batch in batches:
        if not batch.num_rows:
            continue
        k = batch.column(batch.schema.get_field_index(key)).to_numpy()
        change = np.flatnonzero(k[1:] != k[:-1])
        if held and held[-1].column(held[-1].schema.get_field_index(key))[-1].as_py() != k[0]:
            yield cut(pa.Table.from_batches(held))
            held = []
        if len(change):
            last = int(change[-1]) + 1  # the last group may go on in the next batch
            yield cut(pa.Table.from_batches([*held, batch.slice(0, last)]))
            held = [batch.slice(last)]
        else:
            held.append(batch)
    if held:
        yield cut(pa.Table.from_batches(held))
