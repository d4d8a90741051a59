"""List and text columns of Arrow batches, worked off in pieces of bounded size."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa


def parts(rows: pa.ListArray, size: int = 1 << 18) -> Iterator[pa.ListArray]:
    """Runs of rows with about `size` entries each, one row at least: a batch of long texts is worked off in pieces."""
    total = np.cumsum([n or 0 for n in rows.value_lengths().to_pylist()])
    at = 0
    while at < len(rows):
        done = int(total[at - 1]) if at else 0
        stop = max(at + 1, int(np.searchsorted(total, done + size, "right")))
        yield rows.slice(at, stop - at)
        at = stop


def byte_parts(texts: pa.StringArray, size: int) -> Iterator[pa.StringArray]:
    """Runs of texts of about `size` bytes together, one text at least."""
    ends = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset:texts.offset + len(texts) + 1] if len(texts) else ()
    at = 0
    while at < len(texts):
        stop = max(at + 1, int(np.searchsorted(ends, ends[at] + size, "right")) - 1)
        yield texts.slice(at, stop - at)
        at = stop


def with_entries(rows: pa.ListArray, entries: pa.Array) -> pa.ListArray:
    """The rows with other entries, as many and in the same places; a null row stays null."""
    ends = np.cumsum([n or 0 for n in rows.value_lengths().to_pylist()], dtype=np.int64)
    offsets = pa.array(np.append(0, ends).astype(np.int32))
    return pa.ListArray.from_arrays(offsets, entries, mask=rows.is_null() if rows.null_count else None)
