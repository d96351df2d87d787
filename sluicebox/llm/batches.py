"""Arrow batches in slices of bounded size, and column names that clash with no other."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


def slices(batches: Iterator[pa.RecordBatch], text: int = 1, rows: int = 500, size: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of at most ``rows`` rows whose texts (column number ``text``) have about ``size``
    bytes together; a longer text is a slice of its own."""
    for batch in batches:
        if not batch.num_rows:
            continue
        bytes_ = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False)
        ends = np.cumsum(bytes_, dtype=np.int64)
        first = 0
        while first < batch.num_rows:
            before = int(ends[first - 1]) if first else 0
            last = int(np.searchsorted(ends, before + size, side="right"))
            last = min(max(last, first + 1), first + rows, batch.num_rows)
            yield batch.slice(first, last - first)
            first = last


def fresh(columns: Iterable[str], *names: str) -> list[str]:
    """The names, each with as many underscores as keep it apart from the columns (case ignored)."""
    taken, out = {c.lower() for c in columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out
