"""Arrow batches cut at the borders of sorted groups."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


def whole_groups(batches: Iterator[pa.RecordBatch], keys: list[str], rows: int = 1 << 15) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Tables of whole groups of `keys`, by which the batches are sorted, and the row each group starts at."""
    rest: pa.Table | None = None
    for batch in batches:
        table = pa.Table.from_batches([batch])
        rest = table if rest is None else pa.concat_tables([rest, table])
        if rest.num_rows >= rows:
            starts = group_starts(rest, keys)
            if len(starts) > 1:
                cut = int(starts[-1])
                yield rest.slice(0, cut).combine_chunks(), starts[:-1]
                rest = rest.slice(cut)
    if rest is not None and rest.num_rows:
        yield rest.combine_chunks(), group_starts(rest, keys)


def group_starts(table: pa.Table, keys: list[str]) -> np.ndarray:
    new = np.zeros(table.num_rows, bool)
    new[0] = True
    for key in keys:
        column = table[key].combine_chunks()
        a, b = column.slice(1), column.slice(0, len(column) - 1)
        differ = pc.fill_null(pc.not_equal(a, b), False).to_numpy(zero_copy_only=False)
        nulls = column.is_null().to_numpy(zero_copy_only=False)
        new[1:] |= differ | (nulls[1:] != nulls[:-1])
    return np.flatnonzero(new)
